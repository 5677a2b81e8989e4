"""Exact top-k search with a vector-approximation file.

The file holds blocks of some thousand vectors as cells of one byte a component, apart from the vectors themselves. Queries scan the
cells, block by block: a cell's corner gives an approximate inner product, and what a vector may lie beyond the corner bounds it
from above and below. A vector stays a candidate if its upper bound reaches the k-th lower bound of its query. Exact vectors are then
fetched in the order of the upper bounds, in two steps: the best few of each query give a score that k vectors surely reach, and of the
others only those are fetched whose bound may beat it. A Bloom filter of the wanted ids keeps all other vectors out of the shuffle.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quirework.llm.common import durable, join_few

SCALE = 1024
#: Queries and vectors of one block.
QUERY_BLOCK = 512
BLOCK_ROWS = 2048
#: Vectors that are fetched first, as a multiple of k.
FIRST = 3


def usable_vectors(embeddings: DataFrame) -> DataFrame:
    """(vec_id, v) with components as doubles. Rows without id, or with null or non-finite components, are left out."""
    x = embeddings["embedding"].cast("array<double>")
    finite = F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))))
    good = embeddings["vec_id"].isNotNull() & embeddings["embedding"].isNotNull() & F.coalesce(finite, F.lit(False))
    return embeddings.where(good).select(embeddings["vec_id"].cast("long").alias("vec_id"), x.alias("v"))


def scaled(vectors: list[np.ndarray], scale: int) -> np.ndarray:
    """Integer components, as doubles, of vectors of one length."""
    out = np.floor(np.stack([np.asarray(v, np.float64) for v in vectors]) * scale)
    if not np.isfinite(out).all():
        raise ValueError("a scaled component is beyond what a double holds")
    return out


def _blocks(b: pd.DataFrame, rows: int) -> Iterator[pd.DataFrame]:
    """The rows of a batch by length, so many at a time."""
    dims = b["v"].map(len)
    for dim in sorted(set(dims)):
        own = b[dims == dim]
        for k in range(0, len(own), rows):
            yield own.iloc[k : k + rows]


def cell_file(vectors: DataFrame, scale: int) -> DataFrame:
    """(dim, n, width, ids, cells): blocks of vectors as one byte a component; a cell is `width` integers wide, the least power of two that fits the block."""

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for own in _blocks(b, BLOCK_ROWS):
                exact = scaled(list(own["v"]), scale)
                width = 2.0 ** max(0, math.ceil(math.log2(max(1.0, np.abs(exact).max(initial=0) / 127))))
                cells = np.floor(exact / width).astype(np.int8)
                yield pd.DataFrame({"dim": [exact.shape[1]], "n": [len(own)], "width": [width], "ids": [own["vec_id"].to_numpy(np.int64).tobytes()], "cells": [cells.tobytes()]})

    return vectors.mapInPandas(pack, "dim int, n int, width double, ids binary, cells binary")


def query_blocks(asked: DataFrame, scale: int) -> DataFrame:
    """(q_dim, q_n, q_ids, q_exact): blocks of queries with their integer components."""

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for own in _blocks(b, QUERY_BLOCK):
                exact = scaled(list(own["v"]), scale)
                yield pd.DataFrame({"q_dim": [exact.shape[1]], "q_n": [len(own)], "q_ids": [own["vec_id"].to_numpy(np.int64).tobytes()], "q_exact": [exact.tobytes()]})

    return asked.mapInPandas(pack, "q_dim int, q_n int, q_ids binary, q_exact binary")


def bounds(query: np.ndarray, cells: np.ndarray, width: float) -> tuple[np.ndarray, np.ndarray]:
    """(below, above): the inner products of a query with vectors of these cells lie between, rounding included."""
    corner = (cells * width) @ query
    more, less = (width - 1) * query[query > 0].sum(), (width - 1) * query[query < 0].sum()
    slack = 1e-9 * (1 + np.abs(cells) @ np.abs(query) * width + more - less)
    return corner + less - slack, corner + more + slack


def candidates(cells: DataFrame, asked: DataFrame, k: int) -> DataFrame:
    """(query_id, vec_id, below, above): vectors that may be among the k best of a query, by their cells only.

    Query blocks meet cell blocks. Spark broadcasts one side only if it is under the session's limit, else partitions meet in pairs.
    A task keeps, for each query, the k highest lower bounds that it has seen.
    """

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        reached: dict[int, np.ndarray] = {}
        for b in batches:
            for row in b.itertuples(index=False):
                if row.dim != row.q_dim:
                    continue
                ids = np.frombuffer(row.ids, np.int64)
                cell = np.frombuffer(row.cells, np.int8).reshape(row.n, row.dim).astype(np.float64)
                q_ids, q = np.frombuffer(row.q_ids, np.int64), np.frombuffer(row.q_exact, np.float64).reshape(row.q_n, row.q_dim)
                out = []
                for query_id, query in zip(q_ids.tolist(), q, strict=True):
                    below, above = bounds(query, cell, row.width)
                    other = ids != query_id
                    seen = np.concatenate([reached.get(query_id, np.zeros(0)), below[other]])
                    reached[query_id] = np.partition(seen, len(seen) - k)[-k:] if len(seen) > k else seen
                    least = reached[query_id].min() if len(reached[query_id]) == k else -np.inf
                    near = np.flatnonzero(other & (above >= least))
                    out.append(pd.DataFrame({"query_id": np.full(len(near), query_id), "vec_id": ids[near], "below": below[near], "above": above[near]}))
                yield pd.concat(out)

    return cells.crossJoin(asked).mapInPandas(scan, "query_id long, vec_id long, below double, above double")


def inner(a: np.ndarray, b: np.ndarray) -> int:
    """The exact inner product of integer components; in Python integers where doubles would not hold it."""
    if np.abs(a) @ np.abs(b) < 2.0**53:
        return int(a @ b)
    total = sum(int(x) * int(y) for x, y in zip(a.tolist(), b.tolist(), strict=True))
    if not -(2**63) <= total < 2**63:
        raise OverflowError("a score is beyond 64 bits")
    return total


def exact_scores(wanted: DataFrame, vectors: DataFrame, asked: DataFrame, scale: int) -> DataFrame:
    """(query_id, vec_id, score) of the pairs in wanted; of vectors, only those named are shuffled."""
    ids = durable(wanted.select("vec_id").distinct())
    found = join_few(vectors, ids, "inner", ("vec_id",))
    q = asked.select(F.col("vec_id").alias("query_id"), F.col("v").alias("q"))
    rows = wanted.select("query_id", "vec_id").join(q, "query_id").join(found, "vec_id").where(F.size("q") == F.size("v"))

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            got = [inner(np.floor(np.asarray(x, np.float64) * scale), np.floor(np.asarray(y, np.float64) * scale)) for x, y in zip(b["q"], b["v"], strict=True)]
            yield pd.DataFrame({"query_id": b["query_id"], "vec_id": b["vec_id"], "score": np.array(got, np.int64)})

    return rows.mapInPandas(score, "query_id long, vec_id long, score long")


def top_k(embeddings: DataFrame, queries: DataFrame, k: int = 10, scale: int = SCALE) -> DataFrame:
    """(query_id, rank, vec_id, score): for every query row the k highest integer inner products, ties to the smaller vec_id.

    Rows of either table without an id, with a null vector, or with null or non-finite components take no part. A query is
    compared with the vectors of its own length, as others have no inner product with it, itself (its vec_id) excepted; it gets fewer than
    k rows if there are fewer. Repeated query rows count once, repeated vectors each. A score beyond 64 bits is an error. Other
    columns are ignored; an empty table gives an empty result.
    """
    vectors = usable_vectors(embeddings)
    asked = durable(usable_vectors(queries).dropDuplicates(["vec_id"]))
    parts = max(1, math.ceil(asked.count() / QUERY_BLOCK))
    cells = durable(cell_file(vectors, scale))
    found = candidates(cells, durable(query_blocks(asked.repartition(parts), scale)), k)
    # a row for each vector, also where vectors repeat an id
    by_bound = Window.partitionBy("query_id").orderBy(F.col("above").desc(), "vec_id")
    by_floor = Window.partitionBy("query_id").orderBy(F.col("below").desc())
    ranked = durable(found).withColumn("floor_rank", F.row_number().over(by_floor))
    least = ranked.withColumn("least", F.max(F.when(F.col("floor_rank") == k, F.col("below"))).over(Window.partitionBy("query_id")))
    near = durable(least.where(F.col("least").isNull() | (F.col("above") >= F.col("least"))).withColumn("place", F.row_number().over(by_bound)).select("query_id", "vec_id", "above", "place"))
    first = durable(exact_scores(near.where(F.col("place") <= FIRST * k).select("query_id", "vec_id").distinct(), vectors, asked, scale))
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    reached = first.withColumn("rank", F.row_number().over(order)).where(F.col("rank") == k).select("query_id", F.col("score").alias("reached"))
    others = near.where(F.col("place") > FIRST * k).join(reached, "query_id", "left").where(F.col("reached").isNull() | (F.col("above") >= F.col("reached")))
    others = others.select("query_id", "vec_id").distinct().join(first.select("query_id", "vec_id").distinct(), ["query_id", "vec_id"], "left_anti")
    scores = first.unionByName(exact_scores(others, vectors, asked, scale))
    return scores.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
