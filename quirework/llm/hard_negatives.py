"""Hard-negative mining with Kronecker-packed inner products.

The integer components of several candidates are biased to be non-negative and put in separated fields of one integer, wide enough that no
field can run into the next. One multiplication by an anchor's component, biased as well, then multiplies all of them, the sums
over the components are sums in every field, and shifts and masks unpack exact scores; the biases are taken out by the sums of the components.
The wide integers are doubles up to 2**53, which hold integers exactly and which matrix products multiply fast; where components are
so large that no field fits, Python's integers take their place, with any number of fields.

Candidates are written once as packed blocks. Blocks of anchors, the stated query set, meet them twice: first for each anchor's best rows of its own label, then, with
their scores as bounds, for the best rows of other labels in the bounds. A task keeps the best few of each search only.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quirework.llm.common import durable

SCALE, POSITIVES, NEGATIVES = 256, 5, 10
#: Negatives lie between these hundredths of the positive's score.
LEAST, MOST = 30, 90
ANCHOR_BLOCK, CANDIDATE_BLOCK = 512, 2048
#: Bits of an integer that a double holds exactly; fields of a wide integer where doubles don't do.
DOUBLE_BITS, PYTHON_FIELDS = 53, 16


def usable_rows(embeddings: DataFrame) -> DataFrame:
    """(vec_id, label, v): rows with an id, a label and a vector of finite components; every seventh id has the next label."""
    x = embeddings["embedding"].cast("array<double>")
    finite = F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))))
    good = embeddings["vec_id"].isNotNull() & embeddings["label"].isNotNull() & embeddings["embedding"].isNotNull() & F.coalesce(finite, F.lit(False))
    vec_id, label = embeddings["vec_id"].cast("long"), embeddings["label"].cast("long")
    return embeddings.where(good).select(vec_id.alias("vec_id"), F.when(vec_id % 7 == 0, (label + 1) % 10).otherwise(label).alias("label"), x.alias("v"))


def integers(vectors: list, scale: int) -> np.ndarray:
    """Rows of integer components floor(scale * x), as 64-bit integers."""
    out = np.floor(np.stack([np.asarray(v, np.float64) for v in vectors]) * scale)
    if np.abs(out).max(initial=0) >= 2**61:
        raise OverflowError("a scaled component is beyond 61 bits")
    return out.astype(np.int64)


def packed_products(anchors: np.ndarray, candidates: np.ndarray) -> np.ndarray:
    """All inner products of integer rows, as a table (anchors, candidates) of exact 64-bit integers."""
    (n, dim), p, q = candidates.shape, -int(anchors.min(initial=0)), -int(candidates.min(initial=0))
    a, b = anchors + p, candidates + q  # biased: from 0 up
    a_top, b_top = int(a.max(initial=0)), int(b.max(initial=0))
    width = max(1, (dim * a_top * b_top).bit_length())  # a field holds the largest sum
    kind, fields = (np.float64, DOUBLE_BITS // width) if width <= DOUBLE_BITS else (object, PYTHON_FIELDS)
    shifts = np.array([1 << (width * f) for f in range(fields)], kind)
    columns = np.concatenate([b, np.zeros((-n % fields, dim), np.int64)]).reshape(fields, -(-n // fields), dim)
    wide = (columns.astype(kind) * shifts[:, None, None]).sum(axis=0)  # wide integer k has candidate f * len(wide) + k in field f
    product = a.astype(kind) @ wide.T
    # 64-bit integers from here on if all terms below fit, else Python's
    exact = np.int64 if dim * max(a_top, p) * max(b_top, q) < 2**59 else object
    product = product.astype(np.int64 if kind is np.float64 else object)
    sums = np.concatenate([(product >> (width * f)) & ((1 << width) - 1) for f in range(fields)], axis=1)[:, :n].astype(exact)
    # with x = a - p and y = b - q: sum(x * y) = sum(a * b) - q * sum(a) - p * sum(b) + dim * p * q
    scores = sums - q * a.astype(exact).sum(axis=1)[:, None] - p * b.astype(exact).sum(axis=1)[None, :] + dim * p * q
    if exact is object and scores.size and max(abs(scores.max()), abs(scores.min())) >= 2**62:
        raise OverflowError("a score is beyond 62 bits")
    return scores.astype(np.int64)


class Best:
    """The k best rows of each of some searches: higher score first, then smaller id."""

    def __init__(self, searches: int, k: int) -> None:
        self.k = k
        self.search, self.score, self.id = (np.zeros(0, np.int64) for _ in range(3))
        self.floor = np.full(searches, np.iinfo(np.int64).min)

    def add(self, search: np.ndarray, score: np.ndarray, ids: np.ndarray) -> None:
        if not len(search):
            return
        search, score, ids = np.concatenate([self.search, search]), np.concatenate([self.score, score]), np.concatenate([self.id, ids])
        order = np.lexsort((ids, -score, search))
        search = search[order]
        first = np.searchsorted(search, search)
        place = np.arange(len(search)) - first
        top = order[place < self.k]
        full = place == self.k - 1
        self.floor[search[full]] = score[order[full]]
        self.search, self.score, self.id = search[place < self.k], score[top], ids[top]


def blocks_of(rows: DataFrame, size: int, scale: int, prefix: str = "", limits: Callable[[pd.Series], np.ndarray] | None = None) -> DataFrame:
    """Blocks of rows of one vector length: dim, n, and ids, labels and integer components as bytes; with limits, bounds of their column found."""

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            dims = b["v"].map(len)
            for dim in sorted(set(dims)):
                same = b[dims == dim]
                for k in range(0, len(same), size):
                    own = same.iloc[k : k + size]
                    x = integers(list(own["v"]), scale)
                    narrow = next(t for t in (np.int8, np.int16, np.int32, np.int64) if np.abs(x).max(initial=0) <= np.iinfo(t).max)
                    parts = [dim, len(own), own["vec_id"].to_numpy(np.int64).tobytes(), own["label"].to_numpy(np.int64).tobytes(), np.dtype(narrow).itemsize, x.astype(narrow).tobytes()]
                    parts += [limits(own["found"]).tobytes()] if limits else []
                    yield pd.DataFrame({c: [value] for c, value in zip(columns, parts, strict=True)})

    columns = {prefix + c: t for c, t in (("dim", "int"), ("n", "int"), ("ids", "binary"), ("labels", "binary"), ("bytes", "int"), ("x", "binary"))} | ({f"{prefix}bounds": "binary"} if limits else {})
    return rows.mapInPandas(pack, ", ".join(f"{c} {t}" for c, t in columns.items()))


def _open(row, prefix: str = "") -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    get = lambda c: getattr(row, prefix + c)
    x = np.frombuffer(get("x"), f"i{get('bytes')}").astype(np.int64).reshape(get("n"), get("dim"))
    return np.frombuffer(get("ids"), np.int64), np.frombuffer(get("labels"), np.int64), x


def best_positives(anchors: DataFrame, candidates: DataFrame, k: int) -> DataFrame:
    """(anchor_id, positive_id, positive_score): the k best other rows of each anchor's label that a task has seen."""

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[bytes, tuple[np.ndarray, Best]] = {}
        for b in batches:
            for row in b.itertuples(index=False):
                if row.dim != row.a_dim:
                    continue
                ids, labels, x = _open(row)
                a_ids, a_labels, a = _open(row, "a_")
                _, best = held.setdefault(row.a_ids, (a_ids, Best(len(a_ids), k)))
                scores = packed_products(a, x)
                fits = (a_labels[:, None] == labels[None, :]) & (a_ids[:, None] != ids[None, :]) & (scores >= best.floor[:, None])
                i, j = np.nonzero(fits)
                best.add(i, scores[i, j], ids[j])
        for a_ids, best in held.values():
            yield pd.DataFrame({"anchor_id": a_ids[best.search], "positive_id": best.id, "positive_score": best.score})

    return candidates.crossJoin(anchors).mapInPandas(scan, "anchor_id long, positive_id long, positive_score long")


def best_negatives(anchors: DataFrame, candidates: DataFrame, k: int) -> DataFrame:
    """(anchor_id, slot, negative_id, negative_score): for each anchor and positive the k best rows of other labels within the bounds that a task has seen.

    Blocks of anchors have bounds: (low, high) of each anchor and positive, positives in the order of their slots.
    """

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[bytes, tuple[np.ndarray, list[Best]]] = {}
        for b in batches:
            for row in b.itertuples(index=False):
                if row.dim != row.a_dim:
                    continue
                ids, labels, x = _open(row)
                a_ids, a_labels, a = _open(row, "a_")
                limits = np.frombuffer(row.a_bounds, np.int64).reshape(2, len(a_ids), -1)
                _, bests = held.setdefault(row.a_ids, (a_ids, [Best(len(a_ids), k) for _ in range(limits.shape[2])]))
                scores = packed_products(a, x)
                other = a_labels[:, None] != labels[None, :]
                for slot, best in enumerate(bests):
                    low, high = np.maximum(limits[0, :, slot], best.floor), limits[1, :, slot]
                    i, j = np.nonzero((scores >= low[:, None]) & (scores <= high[:, None]) & other)
                    best.add(i, scores[i, j], ids[j])
        for a_ids, bests in held.values():
            for slot, best in enumerate(bests):
                yield pd.DataFrame({"anchor_id": a_ids[best.search], "slot": np.full(len(best.id), slot + 1, np.int32), "negative_id": best.id, "negative_score": best.score})

    return candidates.crossJoin(anchors).mapInPandas(scan, "anchor_id long, slot int, negative_id long, negative_score long")


def score_bounds(slots: int, least: int, most: int) -> Callable[[pd.Series], np.ndarray]:
    """(2, rows, slots): the least and the highest score of a negative for each positive found; nothing lies between those of an empty slot."""

    def limits(found: pd.Series) -> np.ndarray:
        out = np.zeros((2, len(found), slots), np.int64)
        out[0] = 1
        for i, entries in enumerate(found):
            for e in entries:
                score = int(e["positive_score"])
                out[:, i, e["slot"] - 1] = -(-least * score // 100), most * score // 100
        return out

    return limits


def mine_negatives(embeddings: DataFrame, every: int = 100, positives: int = POSITIVES, negatives: int = NEGATIVES, scale: int = SCALE, least: int = LEAST, most: int = MOST) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score): hard negatives of every anchor, a row whose id is divisible by `every`.

    Rows without id or label, with a null vector, or with null or non-finite components take no part; rows are compared with rows of their own
    vector length only. Of rows that repeat an anchor's id, the one of the least (label, vector) is the anchor, and none of them is a row of its own
    search; as positives and negatives repeated rows count each. Equal scores come by the smaller id. An anchor without positives, or a positive without
    negatives in its bounds, as when its score is negative, gives no rows. Components beyond 61 bits and scores beyond 62 are an error. Other
    columns are ignored; an empty table gives an empty result.
    """
    rows = usable_rows(embeddings)
    by_id = rows.where(F.col("vec_id") % every == 0).groupBy("vec_id").agg(F.min(F.struct("label", "v")).alias("least"))
    anchors = durable(by_id.select("vec_id", "least.label", "least.v"))
    n_blocks = max(1, math.ceil(anchors.count() / ANCHOR_BLOCK))
    candidates = durable(blocks_of(rows, CANDIDATE_BLOCK, scale))
    asked = durable(blocks_of(anchors.repartition(n_blocks), ANCHOR_BLOCK, scale, "a_"))
    order = Window.partitionBy("anchor_id").orderBy(F.col("positive_score").desc(), "positive_id")
    found = best_positives(asked, candidates, positives).withColumn("slot", F.row_number().over(order)).where(F.col("slot") <= positives)
    pairs = durable(found)
    scores = pairs.groupBy(F.col("anchor_id").alias("vec_id")).agg(F.collect_list(F.struct("slot", "positive_score")).alias("found"))  # `positives` entries at most
    again = durable(blocks_of(anchors.join(scores, "vec_id").repartition(n_blocks), ANCHOR_BLOCK, scale, "a_", score_bounds(positives, least, most)))
    order = Window.partitionBy("anchor_id", "slot").orderBy(F.col("negative_score").desc(), "negative_id")
    best = best_negatives(again, candidates, negatives).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= negatives)
    return best.join(pairs, ["anchor_id", "slot"]).select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
