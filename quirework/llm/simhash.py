"""Near duplicates by SimHash and a segment-popcount embedding.

A fingerprint of 64 bits falls into 32 segments of two bits; the counts of set bits in the segments are
its embedding. One flipped bit moves one count by one, so the Manhattan distance of two embeddings
is never more than the Hamming distance of the fingerprints. The grid has seven axes, blocks of four or five segments, and a cell
of every three axes: of two embeddings at Manhattan distance four at most, at least three blocks have equal counts, so the two
share a cell, with neighbouring cells left to other axes. Within a cell, pairs pass the Manhattan bound, then the exact test.
A cell of many fingerprints is split in parts, which meet pair by pair in tasks of their own. What leaves a cell is a
spanning forest of its links, so a large group of near copies gives as many rows as it has fingerprints, not their square.
"""

from __future__ import annotations

import itertools
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quirework.llm.common import LOWER_ASCII, WORD, batch, durable, join_few, packed, text_columns

SHINGLE = 4
SEED = 42
MAX_DISTANCE = 4
#: Blocks that two linked fingerprints have in common at least; and fingerprints of a cell that one task compares with each other.
AGREE = 3
CELL_ROWS = 4096
ODD = 0x5555555555555555
#: Links held at once before a cell's or partition's forest is formed from them.
FOREST_EDGES = 1 << 20


def simhash(text: str, shingle: int = SHINGLE) -> int:
    """The fingerprint of one text as a signed 64-bit integer; zero without words."""
    words = re.findall(WORD, text.translate(LOWER_ASCII))
    if not words:
        return 0
    joined = " ".join(words).encode("utf-8", "surrogatepass")
    lengths = np.fromiter((len(w) if w.isascii() else len(w.encode("utf-8", "surrogatepass")) for w in words), np.int64, len(words))
    ends = np.cumsum(lengths + 1) - 1
    n = max(1, len(words) - shingle + 1)
    starts = np.concatenate(([0], ends[:-1] + 1))[:n].tolist()
    stops = ends[min(shingle, len(words)) - 1 :].tolist()
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter((digest(joined[a:b], SEED) for a, b in zip(starts, stops, strict=True)), np.uint64, n)
    counts = np.zeros(64, np.int64)
    for k in range(0, n, 1 << 16):  # bits of one block of hashes at a time
        block = hashes[k : k + (1 << 16)].view(np.uint8).reshape(-1, 8)
        counts += np.unpackbits(block, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = np.packbits(counts * 2 > n, bitorder="little")
    return int(bits.view(np.int64)[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, keyed: bool = False) -> DataFrame:
    """(doc_id, fp) for every row, keyed also row_hash, a hash of the text; null text counts as empty and gets fingerprint zero."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            key = {"row_hash": b.column("row_hash")} if keyed else {}
            yield batch(doc_id=b.column("doc_id"), **key, fp=np.fromiter((simhash(t, shingle) for t in b.column("text").to_pylist()), np.int64, len(b)))

    texts = text_columns(docs, id_col, text_col)
    if keyed:
        return texts.withColumn("row_hash", F.xxhash64("text")).mapInArrow(scan, "doc_id long, row_hash long, fp long")
    return texts.mapInArrow(scan, "doc_id long, fp long")


def embedding(fp: Column) -> Column:
    """Bit counts of the 32 two-bit segments, each in unary (0, 1, 3), so that Manhattan distance is the number of differing bits."""
    odd, up = F.lit(ODD), F.shiftrightunsigned(fp, 1)
    some = fp.bitwiseOR(up).bitwiseAND(odd)
    both = fp.bitwiseAND(up).bitwiseAND(odd)
    return some.bitwiseOR(F.shiftleft(both, 1))


def block_bounds(blocks: int) -> list[tuple[int, int]]:
    """(first bit, bits) of each block; a block is a run of whole segments."""
    cuts = [2 * (32 * k // blocks) for k in range(blocks + 1)]
    return [(a, b - a) for a, b in itertools.pairwise(cuts)]


def cells(prints: DataFrame, agree: int, distance: int = MAX_DISTANCE) -> DataFrame:
    """(cell, fp): every fingerprint in the grid cell of each choice of `agree` blocks out of distance + agree."""
    bounds = block_bounds(distance + agree)
    e = embedding(F.col("fp"))
    codes = [F.shiftrightunsigned(e, a).bitwiseAND(F.lit((1 << n) - 1)) for a, n in bounds]
    keys = [F.xxhash64(F.lit(t), *(codes[k] for k in chosen)) for t, chosen in enumerate(itertools.combinations(range(len(bounds)), agree))]
    return prints.select(F.explode(F.array(*keys)).alias("cell"), "fp")


def split_cells(spread: DataFrame, most: int = CELL_ROWS) -> DataFrame:
    """(cell, fp): cells of more than `most` fingerprints as several, one for each pair of their parts; two fingerprints still meet."""
    large = spread.groupBy("cell").agg(F.count("*").alias("n")).where(F.col("n") > most)
    parts = large.select(F.col("cell").alias("_cell"), F.ceil(F.col("n") / most).cast("int").alias("parts"))
    met = spread.join(parts, F.col("cell") == F.col("_cell"), "left").withColumn("parts", F.coalesce("parts", F.lit(1)))
    own = F.pmod(F.xxhash64(F.lit(1), "fp"), F.col("parts")).cast("int")
    pairs = met.select("cell", "fp", "parts", own.alias("own"), F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("other"))
    pair = F.xxhash64("cell", F.least("own", "other"), F.greatest("own", "other"))
    return pairs.select(F.when(F.col("parts") > 1, pair).otherwise(F.col("cell")).alias("cell"), "fp")


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links (node, root) with the same connected components as the links (a, b)."""
    nodes, index = np.unique(np.concatenate([a, b]), return_inverse=True)
    u, v = index[: len(a)], index[len(a) :]
    root = np.arange(len(nodes))
    while True:
        low = np.minimum(root[u], root[v])
        new = root.copy()
        for side in (root[u], root[v]):
            np.minimum.at(new, side, low)
        while not np.array_equal(new, jumped := new[new]):
            new = jumped
        if np.array_equal(new, root):
            break
        root = new
    child = np.flatnonzero(root != np.arange(len(nodes)))
    return nodes[child], nodes[root[child]]


def links_in_cells(cell: np.ndarray, fp: np.ndarray, distance: int) -> tuple[np.ndarray, np.ndarray]:
    """A forest of the links within cells; rows are sorted by cell. Works through the k-th neighbours of all rows at once."""
    code = fp.view(np.uint64)
    up = code >> np.uint64(1)
    some, both = (code | up) & np.uint64(ODD), (code & up) & np.uint64(ODD)
    embedded = some | (both << np.uint64(1))
    held: list[tuple[np.ndarray, np.ndarray]] = []
    n_held, k = 0, 1
    left = np.arange(len(cell) - 1) if len(cell) else np.arange(0)
    while len(left := left[left + k < len(cell)]) and len(left := left[cell[left] == cell[left + k]]):
        near = left[np.bitwise_count(embedded[left] ^ embedded[left + k]) <= distance]
        near = near[np.bitwise_count(code[near] ^ code[near + k]) <= distance]
        if len(near):
            held.append((fp[near], fp[near + k]))
            n_held += len(near)
        if n_held > FOREST_EDGES:
            held = [forest(*map(np.concatenate, zip(*held, strict=True)))]
            n_held = len(held[0][0])
            if n_held > FOREST_EDGES // 2:
                n_held = 0
        k += 1
    return forest(*map(np.concatenate, zip(*held, strict=True))) if held else (fp[:0], fp[:0])


def fingerprint_links(prints: DataFrame, distance: int = MAX_DISTANCE, agree: int = AGREE, most: int = CELL_ROWS) -> DataFrame:
    """Links (a, b) between distinct fingerprints at Hamming distance up to `distance`, reduced to forests.

    Any two linked fingerprints share a cell, so the forests connect exactly what the links connect. With more blocks to agree in,
    cells are finer and each fingerprint is in more of them.
    """

    def search(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rest_cell, rest_fp = np.zeros(0, np.int64), np.zeros(0, np.int64)
        for b in itertools.chain(batches, [None]):
            if b is not None:
                rest_cell, rest_fp = np.concatenate([rest_cell, b["cell"].to_numpy()]), np.concatenate([rest_fp, b["fp"].to_numpy()])
                whole = int(np.searchsorted(rest_cell, rest_cell[-1])) if len(rest_cell) else 0  # the last cell may go on
                if whole < 50_000:
                    continue
            else:
                whole = len(rest_cell)
            x, y = links_in_cells(rest_cell[:whole], rest_fp[:whole], distance)
            rest_cell, rest_fp = rest_cell[whole:], rest_fp[whole:]
            if len(x):
                yield pd.DataFrame({"a": x, "b": y})

    spread = split_cells(cells(prints, agree, distance), most).repartition("cell").sortWithinPartitions("cell", "fp")
    return spread.mapInPandas(search, "a long, b long")


def components(links: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, root) of every node with links, root being the smallest node connected to it.

    Alternating large-star and small-star rounds; each round's links are written to the shared folder. Rounds grow
    with the logarithm of a component's size. The links of a large component meet at its root: minima are formed before the
    shuffle, and the join with them is one that adaptive execution splits where a key is skewed.
    """

    def star(pairs: DataFrame, large: bool) -> DataFrame:
        one = pairs.select(F.col("a").alias("u"), F.col("b").alias("v"))
        both = one.unionByName(pairs.select(F.col("b").alias("u"), F.col("a").alias("v"))) if large else one
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        out = both.join(least, "u")
        out = out.where(F.col("v") > F.col("u")).select(F.col("v").alias("a"), F.col("m").alias("b")) if large else out.select(F.explode(F.array("v", "u")).alias("a"), F.col("m").alias("b"))
        return out.where(F.col("a") != F.col("b")).distinct()

    def signature(pairs: DataFrame) -> tuple:
        return tuple(pairs.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())

    down = links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a != b").distinct()
    now = durable(down)
    seen = signature(now)
    for _ in range(max_rounds):
        now = durable(star(star(now, True), False))
        new = signature(now)
        if new == seen:
            return now.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("root"))).distinct()
        seen = new
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")


def component_firsts(own: DataFrame, key: Column, distance: int = MAX_DISTANCE, agree: int = AGREE) -> DataFrame:
    """(print, least): for each fingerprint of own, the least key of all rows in its component."""
    prints = durable(own.groupBy("fp").agg(F.min(key).alias("first")))
    roots = components(fingerprint_links(prints.select("fp"), distance, agree))
    grouped = prints.join(roots, prints["fp"] == roots["node"], "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
    smallest = grouped.groupBy("root").agg(F.min("first").alias("least"))
    return grouped.join(smallest, "root").select(F.col("fp").alias("print"), "least")


def near_duplicates(docs: DataFrame, distance: int = MAX_DISTANCE, shingle: int = SHINGLE, agree: int = AGREE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, fp, component_id (the smallest doc_id reachable over links, itself included).

    Null and empty texts have fingerprint zero and are linked like any other. Exact copies share a
    fingerprint and so a component. Repeated ids are judged row by row; a null id is never the smallest unless
    the component has no other. Other columns are ignored; an empty table gives an empty result.
    """
    own = durable(fingerprints(docs, id_col, text_col, shingle))
    table = component_firsts(own, F.col("doc_id"), distance, agree).withColumnRenamed("least", "component_id")
    return own.join(table, own["fp"] == table["print"], "left").select("doc_id", "fp", "component_id")


def keep_one_of_each(docs: DataFrame, distance: int = MAX_DISTANCE, shingle: int = SHINGLE, without_id_stay: bool = True) -> DataFrame:
    """The documents of the table that stay: one row of each group, that of the smallest doc_id, all its columns as they were.

    Rows are told apart by id and text, so rows of one id with texts of different groups are judged apart; of several rows with the smallest
    id, the one of the least text hash stays, and of rows that repeat id and text, one. Rows without an id stay, or, with without_id_stay
    false, come last in their group. Only rows that go or repeat are shuffled with their texts.
    """
    text = F.coalesce(docs["text"], F.lit(""))
    own = durable(fingerprints(docs, shingle=shingle, keyed=True))
    least = component_firsts(own, F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "row_hash"), distance)
    stays = F.col("doc_id").eqNullSafe(F.col("least.doc_id")) & (F.col("row_hash") == F.col("least.row_hash"))
    groups = own.join(least, F.col("fp") == F.col("print")).where(F.lit(not without_id_stay) | F.col("doc_id").isNotNull())
    per_row = groups.groupBy("doc_id", "row_hash").agg(F.count("*").alias("rows"), F.bool_and(~stays).alias("goes"))
    few = durable(per_row.where("goes or rows > 1").select("doc_id", "row_hash", "goes"))
    met = join_few(packed(docs, doc_id=docs["doc_id"].cast("long"), row_hash=F.xxhash64(text)), few)
    once = met.where("not goes").dropDuplicates(["doc_id", "row_hash"])
    return met.where("goes is null").select("_row.*").unionByName(once.select("_row.*"))


def near_duplicate_digest(docs: DataFrame) -> DataFrame:
    """near_duplicates() with the fingerprint as 16 lowercase hex digits."""
    return near_duplicates(docs).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
