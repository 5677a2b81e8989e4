"""Join of documents by the Jaccard similarity of their word shingles, by grouped prefixes.

A document's set is its distinct shingles as 64-bit hashes, and equal sets are one from the start, by 128-bit digests. With shingles in one global
order, rare ones first, two sets as similar as wanted have a shingle in common among the first tenth of each. The order: shingles in the lowest
quarter of the hash range by the number of sets that have them, then all others by hash; so document frequencies are counted for a quarter of all
shingles only, and a set whose first tenth occurs nowhere else has no candidates and is never sent anywhere.

Sets of one size with identical prefixes are one group. Groups meet where they share a shingle of their prefixes, and pass bounds by size, by place of
the shingle and by counts of shingles in 32 classes. Only a spanning forest of the group pairs that pass is kept, so thousands of near copies
give thousands of rows and not their pairs. Each component of candidates is then expanded to its member sets, which are compared exactly; a comparison
is left out only where the two are known to be linked by others. Large components are compared in parts: every part with one
common member first, and then the sets that this has not joined with all parts.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quirework.llm.common import batch, durable, join_few, text_columns
from quirework.llm.runs import mixed, powers
from quirework.llm.simhash import components
from quirework.llm.simhash import forest as stars

SHINGLE = 3
#: Similarity in hundredths.
LEAST = 90
#: Hashes under this bound are ordered by document frequency.
COUNTED = np.uint64(1 << 62)
CLASSES = 32
#: Bytes of text whose words are hashed at once; letters of a word that a polynomial hashes, longer words take XXH3.
PIECE, LONG_WORD = 1 << 22, 64
#: Sets that one task compares with each other at most, and their shingles; groups of one shingle that meet in one task.
PART_SETS, PART_SHINGLES, BUCKET = 2048, 1 << 22, 4096
#: Digests of sets that a task remembers, to send each set's shingles once.
REMEMBERED = 1 << 18

_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_STEP = np.uint64(0xD6E8FEB86659FD93)


def word_hashes(data: np.ndarray, starts: np.ndarray, stops: np.ndarray) -> np.ndarray:
    """64-bit hashes of the words data[starts:stops], some 100,000 words at a time."""
    up, _ = powers(LONG_WORD, 0x9E3779B97F4A7C15)
    out = np.zeros(len(starts), np.uint64)
    for k in range(0, len(starts), 1 << 17):
        a, z = starts[k : k + (1 << 17)], stops[k : k + (1 << 17)]
        sizes = z - a
        begin = np.cumsum(sizes) - sizes
        place = np.arange(sizes.sum()) - np.repeat(begin, sizes)
        symbols = data[np.repeat(a, sizes) + place].astype(np.uint64) + np.uint64(1)
        out[k : k + (1 << 17)] = mixed(np.add.reduceat(symbols * up[np.minimum(place, LONG_WORD - 1)], begin))
        for i in np.flatnonzero(sizes > LONG_WORD):
            out[k + i] = xxhash.xxh3_64_intdigest(data[a[i] : z[i]].tobytes(), 1)
    return out


def shingle_sets(texts: pa.Array, shingle: int = SHINGLE) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text, A-Z in lower case; with fewer words one hash of the whole sequence, without words none."""
    whole = texts.cast(pa.large_string())
    offsets = np.frombuffer(whole.buffers()[1], np.int64)[whole.offset : whole.offset + len(whole) + 1]
    data = _LOWER[np.frombuffer(whole.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]]
    offsets = offsets - offsets[0]
    solid = ~_SPACE[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    starts = np.flatnonzero(solid & (edge[:-1] | ~np.concatenate([[False], solid[:-1]])))
    stops = np.flatnonzero(solid & (edge[1:] | ~np.concatenate([solid[1:], [False]]))) + 1
    words = word_hashes(data, starts, stops)
    bounds = np.searchsorted(starts, offsets)
    hashes = mixed(words ^ np.uint64(shingle))
    for i in range(1, shingle):
        hashes = mixed(hashes[:-1] * _STEP + words[i:])  # those that go on into the next text are left out below
    sets = []
    for a, z in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
        if z - a >= shingle:
            sets.append(np.unique(hashes[a : z - shingle + 1]))
        elif z > a:
            h = mixed(words[a : a + 1] ^ np.uint64(z - a))
            for i in range(a + 1, z):
                h = mixed(h * _STEP + words[i])
            sets.append(h)
        else:
            sets.append(np.zeros(0, np.uint64))
    return sets


def prefix_length(n, least: int = LEAST):
    """In how many of n ordered shingles a similar set must be met."""
    return n - (least * n + 99) // 100 + 1


def overlap(a, b, least: int = LEAST):
    """Shingles that similar sets of sizes a and b have in common at least."""
    return (least * (a + b) + 99 + least) // (100 + least)


def class_counts(own: np.ndarray) -> np.ndarray:
    """Shingles of a set in each of 32 classes, as 16-bit integers; their Manhattan distance bounds the difference of two sets from below."""
    return np.minimum(np.bincount((own & np.uint64(CLASSES - 1)).astype(np.int64), minlength=CLASSES), 32_767).astype(np.int16)


def _pieces(b: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    ends = np.cumsum(np.asarray(pc.binary_length(b.column("text"))))
    k = 0
    while k < len(b):
        n = max(1, int(np.searchsorted(ends, (ends[k - 1] if k else 0) + PIECE, "right")) - k)
        yield b.slice(k, n)
        k += n


def _lists(values: list[np.ndarray]) -> pa.Array:
    ends = np.concatenate([[0], np.cumsum([len(v) for v in values])]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([np.zeros(0, np.int64), *(v.view(np.int64) for v in values)])))


def document_sets(docs: DataFrame, shingle: int, least: int) -> DataFrame:
    """(doc_id, row_hash, n, k0, k1, counted, counts, first): size and digest of each document's set, and the shingles that its prefix may have.

    first are the hashes in the counted range, `counted` many, and if these are fewer than a prefix, further ones. A task sends them once for sets it has met.
    """

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        met: set[bytes] = set()
        for b in batches:
            for piece in _pieces(b):
                sets = shingle_sets(piece.column("text"), shingle)
                digests = [xxhash.xxh3_128_digest(s.tobytes()) for s in sets]
                counted = [int(np.searchsorted(s, COUNTED)) for s in sets]
                first = []
                for s, d, c in zip(sets, digests, counted, strict=True):
                    first.append(s[:0] if d in met else s[: max(c, prefix_length(len(s), least))])
                    met.add(d)
                if len(met) > REMEMBERED:
                    met.clear()
                keys = np.frombuffer(b"".join(digests), np.int64).reshape(-1, 2)
                yield batch(doc_id=piece.column("doc_id"), row_hash=piece.column("row_hash"), n=np.array([len(s) for s in sets], np.int64), k0=keys[:, 0], k1=keys[:, 1],
                            counted=np.array(counted, np.int64), counts=[class_counts(s).tobytes() for s in sets], first=_lists(first))

    rows = docs.withColumn("row_hash", F.xxhash64("text"))
    return rows.mapInArrow(scan, "doc_id long, row_hash long, n long, k0 long, k1 long, counted long, counts binary, first array<long>")


def prefixes(own: DataFrame, sets: DataFrame, least: int) -> DataFrame:
    """(no, n, shingle, place): the prefix of each distinct set, but for shingles that no other set has; places count from 1.

    own has the shingles by row number `no`, sets one row number for each distinct set.
    """
    pairs = own.select("no", "counted", F.posexplode("first").alias("at", "shingle"))
    counted = pairs.where("at < counted").select("shingle", "no")
    repeated = counted.groupBy("shingle").agg(F.count("*").alias("df")).where("df > 1")
    sizes = sets.select("no", "n", "counted")
    shared = counted.join(repeated, "shingle").join(sizes, "no")
    by_set = Window.partitionBy("no")
    place = F.col("counted") - F.count("*").over(by_set) + F.row_number().over(by_set.orderBy("df", "shingle"))
    length = F.col("n") - F.floor((F.col("n") * least + 99) / 100) + 1
    columns = ["no", "n", "shingle", "place"]
    rare = shared.withColumn("place", place).where(F.col("place") <= length).select(*columns)
    rest = pairs.where("at >= counted").join(sizes.select("no", "n"), "no").select("no", "n", "shingle", (F.col("at") + 1).cast("long").alias("place"))
    return rare.unionByName(rest.select(*columns))


def prefix_groups(prefix: DataFrame, least: int) -> DataFrame:
    """(no, group, n, prefix): sets of one size with identical prefixes have one group, the smallest number among them.

    prefix is an array of (place, shingle). A prefix with a shingle that no other set has, which shows as a place left out, is identical to no other.
    """
    rows = prefix.groupBy("no", "n").agg(F.array_sort(F.collect_list(F.struct("place", "shingle"))).alias("prefix"))  # a tenth of a document at most
    length = F.col("n") - F.floor((F.col("n") * least + 99) / 100) + 1
    keyed = rows.withColumn("alone", F.when(F.size("prefix") < length, F.col("no")).otherwise(F.lit(-1)))
    groups = keyed.groupBy("n", "alone", "prefix").agg(F.min("no").alias("group"), F.count("*").alias("members"))
    return keyed.join(groups, ["n", "alone", "prefix"]).select("no", "group", "n", "prefix", "members")


def split(rows: DataFrame, key: str, most: int) -> DataFrame:
    """rows with their key replaced by a cell (key, i, j): keys of more than `most` rows are cut in parts, and each two parts meet in a cell."""
    large = rows.groupBy(key).agg(F.count("*").alias("_n")).where(F.col("_n") > most).select(F.col(key).alias("_key"), F.ceil(F.col("_n") / most).cast("int").alias("_parts"))
    met = rows.join(large, rows[key] == large["_key"], "left").withColumn("_parts", F.coalesce("_parts", F.lit(1)))
    own = F.pmod(F.xxhash64("group"), F.col("_parts")).cast("int")
    pairs = met.withColumn("_own", own).withColumn("_other", F.explode(F.sequence(F.lit(0), F.col("_parts") - 1)))
    return pairs.withColumn("cell", F.struct(F.col(key).alias("key"), F.least("_own", "_other").alias("i"), F.greatest("_own", "_other").alias("j"))).drop("_key", "_parts", "_own", "_other")


def in_cells(rows: DataFrame, columns: list[str], forest: Callable[..., tuple[np.ndarray, np.ndarray]]) -> DataFrame:
    """Links (a, b) that forest() finds in cells of rows, each node linked with the least one that it is connected to there.

    forest() is given the bounds of some whole cells and the columns, sorted by cell and first column.
    """

    def run(whole: pa.Table) -> Iterator[pa.RecordBatch]:
        cell = np.asarray(whole.column("cell"))
        begin = np.flatnonzero(np.concatenate([[True], cell[1:] != cell[:-1]]))
        a, b = stars(*forest(np.append(begin, len(cell)), *(whole.column(c).combine_chunks() for c in columns)))
        if len(a):
            yield batch(a=a, b=b)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for b in batches:
            if not len(b):
                continue
            cell = np.asarray(b.column("cell"))
            whole = int(np.searchsorted(cell, cell[-1]))  # the last cell may go on
            if whole or held and np.asarray(held[-1].column("cell"))[-1] != cell[-1]:
                yield from run(pa.Table.from_batches([*held, b.slice(0, whole)]))
                held = []
            held.append(b.slice(whole))
        if held:
            yield from run(pa.Table.from_batches(held))

    # cells are told apart by 64 bits: two that fall together are compared with each other as well, which adds no link that isn't one
    numbered = rows.withColumn("cell", F.xxhash64("cell")).select("cell", *columns)
    return numbered.repartition("cell").sortWithinPartitions("cell", columns[0]).mapInArrow(scan, "a long, b long")


def spanning(begin: np.ndarray, near: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of rows that connect, within each cell, what near(rows, rows) connects.

    All rows are compared with their cell's first at once, then rows that a search has reached with those that it hasn't, until a cell has none left.
    """
    sizes = np.diff(begin)
    hub = np.repeat(begin[:-1], sizes)
    rows = np.flatnonzero(hub != np.arange(begin[-1]))
    hit = near(hub[rows], rows)
    one, two = [hub[rows[hit]]], [rows[hit]]
    missed = np.zeros(begin[-1], bool)
    missed[rows[~hit]] = True
    for k in np.flatnonzero((np.add.reduceat(missed, begin[:-1], dtype=np.int64) > 0) & (sizes > 2)) if len(rows) else ():
        own = np.arange(begin[k] + 1, begin[k + 1])
        left, reached = own[missed[own]], own[~missed[own]].tolist()
        while len(left):
            row = reached.pop() if reached else left[0]
            left = left[left != row]
            got = near(np.full(len(left), row), left)
            one.append(np.full(got.sum(), row))
            two.append(left[got])
            reached += left[got].tolist()
            left = left[~got]
    return np.concatenate(one), np.concatenate(two)


def candidate_forest(least: int) -> Callable[..., tuple[np.ndarray, np.ndarray]]:
    """Links between groups of one shingle that the bounds let pass, reduced to a forest."""

    def forest(begin, group, n, place, counts, members):
        group, n, place = (np.asarray(c) for c in (group, n, place))
        several = np.asarray(members) > 1  # one group's members have different counts of classes
        classes = np.frombuffer(b"".join(counts.to_pylist()), np.int16).reshape(-1, CLASSES).astype(np.int32)

        def near(v, u):
            got = np.zeros(len(u), bool)
            for k in range(0, len(u), 1 << 16):
                x, y = v[k : k + (1 << 16)], u[k : k + (1 << 16)]
                need = overlap(n[x], n[y], least)
                ok = (100 * np.minimum(n[x], n[y]) >= least * np.maximum(n[x], n[y])) & (1 + np.minimum(n[x] - place[x], n[y] - place[y]) >= need)
                at = np.flatnonzero(ok)
                apart = np.abs(classes[x[at]] - classes[y[at]]).sum(axis=1)
                ok[at] = several[x[at]] | several[y[at]] | (apart <= n[x[at]] + n[y[at]] - 2 * need[at])
                got[k : k + (1 << 16)] = ok
            return got

        a, b = spanning(begin, near)
        return group[a], group[b]

    return forest


def exact_forest(least: int) -> Callable[..., tuple[np.ndarray, np.ndarray]]:
    """Links between sets, exactly, reduced to a forest."""

    def forest(begin, no, own):
        no = np.asarray(no)
        sets = [np.frombuffer(x, np.uint64) for x in own.to_pylist()]
        n = np.array([len(s) for s in sets], np.int64)
        classes = np.stack([class_counts(s) for s in sets]).astype(np.int32)

        def common(row: int, others: np.ndarray) -> np.ndarray:
            own, out = sets[row], []
            step = max(1, PART_SHINGLES // max(1, int(n[others].max())))
            for k in range(0, len(others), step):
                some = others[k : k + step]
                values = np.concatenate([sets[i] for i in some.tolist()])
                met = own[np.minimum(np.searchsorted(own, values), len(own) - 1)] == values
                out.append(np.add.reduceat(met, np.cumsum(n[some]) - n[some], dtype=np.int64))
            return np.concatenate(out)

        def near(v, u):
            need = overlap(n[v], n[u], least)
            ok = 100 * np.minimum(n[v], n[u]) >= least * np.maximum(n[v], n[u])
            at = np.flatnonzero(ok)
            ok[at] = np.abs(classes[v[at]] - classes[u[at]]).sum(axis=1) <= n[v[at]] + n[u[at]] - 2 * need[at]
            at = np.flatnonzero(ok)
            for run in np.split(at, np.flatnonzero(np.diff(v[at])) + 1) if len(at) else ():
                ok[run] = common(int(v[run[0]]), u[run]) >= need[run]
            return ok

        a, b = spanning(begin, near)
        return no[a], no[b]

    return forest


def candidate_members(rows: DataFrame, candidates: DataFrame, own: DataFrame, shingle: int) -> DataFrame:
    """(no, root, own): the whole set of each candidate, as the bytes of its hashes, from its text; root is its component of candidates."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for piece in _pieces(b):
                yield batch(no=piece.column("no"), root=piece.column("root"), own=[s.tobytes() for s in shingle_sets(piece.column("text"), shingle)])

    few = durable(candidates.join(own.select("no", "doc_id", "row_hash"), F.col("node") == F.col("no")).select("doc_id", "row_hash", "no", "root"))
    texts = join_few(rows.withColumn("row_hash", F.xxhash64("text")), few, "inner").dropDuplicates(["no"])  # repeated rows have one text
    return texts.select("no", "root", "text").mapInArrow(scan, "no long, root long, own binary")


def exact_links(members: DataFrame, least: int) -> DataFrame:
    """Links (a, b) that connect what the similar ones among the members of each root connect.

    Members of a root are dealt out in parts, the member of the smallest number to every part. What is joined with it in its part needs no more
    comparisons with others of its kind; the rest of a root of several parts then meets all parts.
    """
    parts = F.greatest(F.ceil(F.count("*") / PART_SETS), F.ceil(F.sum(F.length("own")) / (8 * PART_SHINGLES))).cast("int")
    per = durable(members.groupBy("root").agg(parts.alias("parts"), F.min("no").alias("hub")))
    dealt = members.join(per, "root").withColumn("part", F.pmod(F.xxhash64("no"), F.col("parts")).cast("int"))
    first = dealt.withColumn("at", F.explode(F.when(F.col("no") == F.col("hub"), F.sequence(F.lit(0), F.col("parts") - 1)).otherwise(F.array("part"))))
    links = durable(in_cells(first.withColumn("cell", F.struct("root", "at")), ["no", "own"], exact_forest(least)))
    if per.where("parts > 1").isEmpty():
        return links
    labels = components(links)
    large = dealt.where("parts > 1").join(labels.select(F.col("node").alias("no"), F.col("root").alias("label")), "no", "left").withColumn("label", F.coalesce("label", "no"))
    hubs = large.where("no = hub").select("root", F.col("label").alias("hub_label"))
    marked = large.join(hubs, "root").withColumn("open", F.col("label") != F.col("hub_label"))
    open_parts = marked.where("open").groupBy("root").agg(F.ceil(F.count("*") / PART_SETS).cast("int").alias("open_parts"))
    both = durable(marked.join(open_parts, "root").select("no", "own", "root", "part", "parts", "open", "open_parts"))
    rows = both.where("open").withColumn("i", F.pmod(F.xxhash64(F.lit(1), "no"), F.col("open_parts")).cast("int")).withColumn("j", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    columns = both.withColumn("j", F.col("part")).withColumn("i", F.explode(F.sequence(F.lit(0), F.col("open_parts") - 1)))
    cells = rows.select("root", "i", "j", "no", "own").unionByName(columns.select("root", "i", "j", "no", "own"))
    return links.unionByName(in_cells(cells.withColumn("cell", F.struct("root", "i", "j")), ["no", "own"], exact_forest(least)))


def similar_documents(docs: DataFrame, shingle: int = SHINGLE, least: int = LEAST, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id): one row per document, component_id being the smallest doc_id reachable over links, itself included.

    Two documents are linked if 100 * shingles in common >= least * shingles in either. Null texts and texts without words have no shingles and no links;
    their component is their own id. Texts of fewer words than a shingle are linked with texts of the same words. Repeated
    ids are judged row by row; a null id is never the smallest unless a component has no other. Other columns are ignored; an empty table
    gives an empty result.
    """
    rows = text_columns(docs, id_col, text_col)
    own = durable(document_sets(rows, shingle, least).withColumn("no", F.monotonically_increasing_id()))
    sent = F.when(F.size("first") > 0, F.col("no"))
    sets = durable(own.where("n > 0").groupBy("k0", "k1").agg(F.min(sent).alias("no"), F.min("n").alias("n"), F.min("counted").alias("counted"), F.min("doc_id").alias("least_id")))
    groups = durable(prefix_groups(prefixes(own, sets, least), least))
    postings = groups.where("no = group").select("group", "n", "members", F.explode("prefix").alias("p")).select("group", "n", "members", "p.shingle", "p.place")
    met = split(postings.join(own.select(F.col("no").alias("group"), "counts"), "group"), "shingle", BUCKET)
    pairs = in_cells(met, ["group", "n", "place", "counts", "members"], candidate_forest(least))
    same = groups.where("no != group").select(F.col("no").alias("a"), F.col("group").alias("b"))
    candidates = components(pairs.unionByName(same).distinct())
    members = durable(candidate_members(rows, candidates, own, shingle))
    linked = components(exact_links(members, least))
    grouped = sets.join(linked, sets["no"] == linked["node"], "left").select("k0", "k1", "least_id", F.coalesce("root", "no").alias("root"))
    smallest = grouped.groupBy("root").agg(F.min("least_id").alias("component"))
    table = grouped.join(smallest, "root").select("k0", "k1", "component")
    out = own.select("doc_id", "n", "k0", "k1").join(table, ["k0", "k1"], "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("component")).otherwise(F.col("doc_id")).alias("component_id"))
