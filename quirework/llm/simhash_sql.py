"""DuckDB SQL for the SimHash query: XXH64 in 128-bit integers, bits by majority, links of all pairs, components by recursion.

It serves as a check on small tables: all pairs of fingerprints are compared, and reachability is listed pair by pair.
"""

from __future__ import annotations

# Fixed values of the public XXH64 specification.
P1 = 11400714785074694791
P2 = 14029467366897019727
P3 = 1609587929392839161
P4 = 9650029242287828579
P5 = 2870177450012600261

MASK = (1 << 64) - 1


def const(value: int) -> str:
    return f"{value & MASK}::uhugeint"


def low(x: str) -> str:
    """The lower 64 bits."""
    return f"(({x}) & {const(MASK)})"


def times(x: str, factor: int) -> str:
    return low(f"({x}) * {const(factor)}")


def turned(x: str, bits: int) -> str:
    """64 bits turned to the left."""
    return low(f"(({x}) << {bits}) | (({x}) >> {64 - bits})")


def mixed_in(state: str, lane: str) -> str:
    """A lane of 8 bytes taken into an accumulator."""
    return times(turned(low(f"{state} + {times(lane, P2)}"), 31), P1)


def number(first: str, count: int) -> str:
    """`count` bytes of the hex digits x from byte `first` on, least byte first, as a number."""
    digits = " || ".join(f"substr(x, 2 * ({first}) + {2 * k + 1}, 2)" for k in reversed(range(count)))
    return f"('0x' || {digits})::uhugeint"


def folded(start: str, lanes: str, step: str) -> str:
    """h and then each lane k of a list through a step."""
    return f"list_reduce(list_prepend({start}, {lanes}), lambda h, k: {step})"


def xxh64(texts: str, seed: int) -> str:
    """SELECT of (x, h) for a relation of hex digits x: the hash of each, as an unsigned number."""
    starts = [seed + P1 + P2, seed + P2, seed, seed - P1]
    lanes = [folded(const(v), f"list_transform(range(0, n // 32), lambda i: {number(f'32 * i + {8 * k}', 8)})", mixed_in("h", "k")) for k, v in enumerate(starts)]
    merged = low(" + ".join(turned(f"v{k}", r) for k, r in enumerate((1, 7, 12, 18))))
    for k in range(4):
        merged = low(f"{times(f'xor({merged}, m{k})', P1)} + {const(P4)}")
    zero = const(0)
    eights = f"list_transform(range(n // 32 * 4, n // 8), lambda i: {number('8 * i', 8)})"
    four = f"case when n % 8 >= 4 then [{number('n // 8 * 8', 4)}] else [] end"
    ones = f"list_transform(range(n // 4 * 4, n), lambda i: {number('i', 1)})"
    after_8 = low(f"{times(turned(f'xor(h, {mixed_in(zero, chr(107))})', 27), P1)} + {const(P4)}")
    after_4 = low(f"{times(turned(f'xor(h, {times(chr(107), P1)})', 23), P2)} + {const(P3)}")
    after_1 = times(turned(f"xor(h, {times('k', P5)})", 11), P1)
    return f"""select x, xor(h, h >> 32) as h from (
  select x, {times('xor(h, h >> 29)', P3)} as h from (
  select x, {times('xor(h, h >> 33)', P2)} as h from (
  select x, {folded('h', ones, after_1)} as h from (
  select x, n, {folded('h', four, after_4)} as h from (
  select x, n, {folded('h', eights, after_8)} as h from (
  select x, n, {low('n::uhugeint + case when n >= 32 then ' + 'merged' + f' else {const(seed + P5)} end')} as h from (
  select x, n, {merged} as merged from (
  select *, {', '.join(f'{mixed_in(zero, f"v{k}")} as m{k}' for k in range(4))} from (
  select x, n, {', '.join(f'{lane} as v{k}' for k, lane in enumerate(lanes))} from (select x, length(x) // 2 as n from {texts}))))))))))"""


#: Columns as the query's: doc_id, fingerprint, component_id.
OP6_SQL = rf"""
with recursive w as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as w from documents),
shingles as (select doc_id, hex(encode(array_to_string(w[i:i + 3], ' '))) as x from (select doc_id, w, unnest(range(1, greatest(len(w) - 3, 1) + 1)) as i from w where len(w) > 0)),
hashes as materialized (select x, h::ubigint as h from ({xxh64('(select distinct x from shingles)', 42)})),
counted as (select doc_id, count(*) as n, {', '.join(f'sum((h >> {b}) & 1) as b{b}' for b in range(64))} from shingles join hashes using (x) group by doc_id),
prints as (select w.doc_id, coalesce({' + '.join(f'case when 2 * b{b} > n then {1 << b}::hugeint else 0 end' for b in range(64))}, 0::hugeint) as fp from w left join counted using (doc_id)),
nodes as materialized (select fp, min(doc_id) as least from prints group by fp),
links as materialized (select a.fp as a, b.fp as b from nodes a join nodes b on a.fp <> b.fp where bit_count(xor(a.fp, b.fp)) <= 4),
reached as (select fp as node, fp as other from nodes union select node, b from reached join links on other = a),
firsts as (select node, min(least) as component_id from reached join nodes on other = fp group by node)
select doc_id, lpad(lower(printf('%x', (fp >> 32)::bigint)), 8, '0') || lpad(lower(printf('%x', (fp & 4294967295)::bigint)), 8, '0') as fingerprint, component_id
from prints join firsts on fp = node
"""
