"""Mixing sources to target weights by systematic sampling.

Every document of a source expects the same number of copies r = target / source size. The prefix sum of
these expectations runs along the source, one offset u in [0, 1) is added, and a document is emitted once
for each integer that the sum crosses at it: floor(r), or one more. Along the order, documents of like
size are neighbours, so that the words taken stay near the target.

The prefix sum is never a window over a whole source. Documents are ranked in strata (source, size class,
hash bucket); strata totals, some thousand rows a source at most, are summed up along each source.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quirework.llm.common import durable

#: Weights of the sources in code point order, repeating.
WEIGHTS = (5, 2, 1)
SHARE = 1.5
CEILING = 2.0
#: Leading hex digits of a document's hash that choose one of 256 buckets of a size class; and size classes in each doubling of the size.
SALT_DIGITS = 2
CLASSES = 8


def word_count(text: Column) -> Column:
    """Words of the contract, by splitting at its white space, which is faster than matching them."""
    return F.coalesce(F.size(F.array_remove(F.split(text, r"[\x20\x09-\x0D]+"), "")), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, ceiling: float = CEILING) -> DataFrame:
    """(source, source_size, target) from rows (source, size).

    Sources by code point, null last, take the weights in turn and share share x all words. A source
    stops at ceiling x its size; what it leaves goes to the others by weight. The level at which this
    settles comes from prefix sums over the sources in the order in which they fill, not from rounds.
    A table of one row a source; only it is ordered as a whole.
    """
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    rank = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    w = F.element_at(F.array(*(F.lit(float(x)) for x in weights)), (rank % len(weights) + 1).cast("int"))
    per = per.select("source", "source_size", w.alias("weight"))
    per = per.withColumn("cap", F.lit(float(ceiling)) * F.col("source_size"))
    fills = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    before = fills.rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy()
    per = per.select(
        "*",
        F.coalesce(F.sum("cap").over(before), F.lit(0.0)).alias("full"),
        F.sum("weight").over(fills.rowsBetween(Window.currentRow, Window.unboundedFollowing)).alias("open_weight"),
        (F.lit(float(share)) * F.sum("source_size").over(whole)).alias("budget"),
    )
    # level: what a weight of 1 gets if all sources before this one are full and this and later ones are not
    per = per.withColumn("level", (F.col("budget") - F.col("full")) / F.col("open_weight"))
    is_open = F.col("cap") > F.col("level") * F.col("weight")
    settled = F.min(F.when(is_open, F.struct(F.col("cap") / F.col("weight"), F.col("level")))).over(whole)["level"]
    return per.select("source", "source_size", F.coalesce(F.least("cap", settled * F.col("weight")), F.col("cap")).alias("target"))


def _digest(seed: int, value: Column) -> Column:
    """32 hex digits for a value, null included, that SQL engines agree on."""
    return F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.concat(F.lit("v"), value.cast("string")), F.lit("n"))))


def _offset(source: Column, seed: int) -> Column:
    """One number in [0, 1) for each source, the same at every run, from 52 bits."""
    return F.conv(F.substring(_digest(seed, source), 1, 13), 16, 10).cast("double") / F.lit(float(1 << 52))


def _planned(docs: DataFrame, kept: list[Column], seed: int, weights: tuple[float, ...], share: float, ceiling: float) -> DataFrame:
    """Ranks every document in its source and counts the integers crossed at it; kept are columns that come along."""
    base = docs.select(
        docs["doc_id"].cast("long").alias("doc_id"),
        docs["source"].cast("string").alias("source"),
        word_count(docs["text"]).alias("size"),
        F.xxhash64(docs["text"]).alias("text_hash"),
        *kept,
    )
    if not kept:  # small rows, read three times: words are counted once
        base = durable(base)
    targets = source_targets(base.select("source", "size"), weights, share, ceiling)
    ratio = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    targets = targets.withColumn("ratio", ratio).withColumn("offset", _offset(F.col("source"), seed))
    order = _digest(seed, F.col("doc_id"))
    placed = base.select(
        "*",
        F.floor(F.log2(F.col("size") + 1.0) * CLASSES).cast("int").alias("size_class"),
        F.substring(order, 1, SALT_DIGITS).alias("salt"),
        order.alias("ord"),
    )
    strata = ["source", "size_class", "salt"]
    totals = placed.groupBy(strata).agg(F.count("*").alias("n"))
    along = Window.partitionBy("source").orderBy("size_class", "salt").rowsBetween(Window.unboundedPreceding, -1)
    starts = totals.select(*strata, F.coalesce(F.sum("n").over(along), F.lit(0)).alias("before"))
    inside = Window.partitionBy(*strata).orderBy("ord", "doc_id", "text_hash")
    ranked = placed.withColumn("rank", F.row_number().over(inside)).alias("r")
    same = F.col("r.source").eqNullSafe(F.col("s.source")) & (F.col("r.size_class") == F.col("s.size_class")) & (F.col("r.salt") == F.col("s.salt"))
    known = ranked.join(starts.alias("s"), same).select("r.*", "s.before").alias("d")
    known = known.join(targets.alias("t"), F.col("d.source").eqNullSafe(F.col("t.source"))).select("d.*", "t.source_size", "t.target", "t.ratio", "t.offset")
    last = F.col("before") + F.col("rank")
    crossed = lambda n: F.floor(F.col("offset") + n * F.col("ratio"))
    return known.withColumn("copies", (crossed(last) - crossed(last - 1)).cast("long"))


def mix_sources(docs: DataFrame, seed: int = 42, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, ceiling: float = CEILING) -> DataFrame:
    """One row per document: doc_id, source, size, source_size, target, copies, taken = copies x size.

    Null text has size 0; empty documents get copies like others, of no words. A null source is a
    source of its own, last in order. Equal sizes are ordered by a hash of the id, then by id and text hash,
    so that reruns agree; of repeated rows it doesn't matter which is which. Other columns are ignored,
    an empty table gives an empty result.
    """
    planned = _planned(docs, [], seed, weights, share, ceiling)
    return planned.select("doc_id", "source", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"))


def mixed_documents(docs: DataFrame, seed: int = 42, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, ceiling: float = CEILING) -> DataFrame:
    """The mix itself: every input row once for each of its copies, with the input's columns only."""
    whole = F.struct(*(docs[c] for c in docs.columns)).alias("row")
    planned = _planned(docs, [whole], seed, weights, share, ceiling)
    return planned.select("row", F.explode(F.array_repeat(F.lit(1), F.col("copies").cast("int")))).select("row.*")
