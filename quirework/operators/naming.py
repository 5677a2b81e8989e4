"""Distinct output names of a batch, whatever the case, in input order.

A file takes its stem, or if that is taken the stem with the least free suffix (2), (3), ... A name can be taken by two kinds of files only: those
of that stem, and, as a suffix, those of the stem without its closing (n), its parent. So files meet inside one root only, the stem
without all closing (n). Small roots run through a task one by one. In a large root nothing is done file by file:

* files of a stem are numbered by running counts over blocks of positions;
* a child, a stem with closing (n), owns its name if fewer files of the parent ask for a suffix before the child's first file than the free
  numbers up to n; which numbers are free is handed on from child to child in the order of n, level by level from the root;
* the j-th file that asks for a suffix gets j + 1 and one more for each number that children own up to there, a running count again.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quirework.durable import durable

#: Files of a root that one task names; positions of a block, whose counts are formed before they are summed.
LARGE_ROOT, BLOCK = 100_000, 1 << 16


def running(rows: DataFrame, keys: list[str], at: str, weight: str, name: str) -> DataFrame:
    """rows with the sum of weight over rows of equal keys up to theirs in the order of at, a whole number, weightless rows first at one place.

    Sums of blocks are formed first, so that a key with many rows is summed in as many tasks as it has blocks.
    """
    cut = rows.withColumn("_block", F.floor(F.col(at) / BLOCK))
    blocks = cut.groupBy(*keys, "_block").agg(F.sum(weight).alias("_sum"))
    before = F.sum("_sum").over(Window.partitionBy(*keys).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1))
    inside = F.sum(weight).over(Window.partitionBy(*keys, "_block").orderBy(at, weight).rowsBetween(Window.unboundedPreceding, Window.currentRow))
    offsets = blocks.select(*keys, "_block", F.coalesce(before, F.lit(0)).alias("_before"))
    return cut.join(offsets, [*keys, "_block"]).withColumn(name, F.col("_before") + inside).drop("_block", "_before")


def small_roots(files: DataFrame) -> DataFrame:
    """(batch_id, pos, out_name) of files (batch_id, root, pos, stem), root by root in order."""

    def name(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, taken, tried = None, set(), {}
        for b in batches:
            out = []
            for batch, r, s in zip(b["batch_id"], b["root"], b["stem"], strict=True):
                if key != (batch, r):
                    key, taken, tried = (batch, r), set(), {}
                candidate, suffix = f"{s}.pdf", tried.get(s.lower(), 2)  # names stay taken, so smaller suffixes need no second look
                while candidate.lower() in taken:
                    candidate, suffix = f"{s} ({suffix}).pdf", suffix + 1
                tried[s.lower()] = suffix
                taken.add(candidate.lower())
                out.append(candidate)
            yield b[["batch_id", "pos"]].assign(out_name=out)

    ordered = files.select("batch_id", "pos", "stem", "root").repartition("batch_id", "root").sortWithinPartitions("batch_id", "root", "pos")
    return ordered.mapInPandas(name, "batch_id long, pos long, out_name string")


def _owned(children: DataFrame) -> DataFrame:
    """(batch_id, low, owned) of children (batch_id, parent, low, n, asked): asked is how many files of the parent ask for a suffix before the child's first file.

    With b numbers under n owned by other children, the parent's next number is n when n - 1 - b files have asked.
    """

    def hand_on(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, owned = None, 0
        for b in batches:
            out = np.zeros(len(b), bool)
            for k, (batch, parent, n, asked) in enumerate(zip(b["batch_id"], b["parent"], b["n"], b["asked"], strict=True)):
                if key != (batch, parent):
                    key, owned = (batch, parent), 0
                out[k] = n - 1 - owned > asked
                owned += int(out[k])
            yield b[["batch_id", "low"]].assign(owned=out)

    ordered = children.repartition("batch_id", "parent").sortWithinPartitions("batch_id", "parent", "n")
    return ordered.mapInPandas(hand_on, "batch_id long, low string, owned boolean")


def large_roots(files: DataFrame) -> DataFrame:
    """(batch_id, pos, out_name), the same names as small_roots() gives."""
    key = ["batch_id", "low"]
    own = durable(files.select("batch_id", "pos", "stem", F.lower("stem").alias("low")))
    stems = own.groupBy(*key).agg(F.min("pos").alias("first"))
    closing = r" \(([1-9][0-9]{0,17})\)$"
    number = F.regexp_extract("low", closing, 1).try_cast("long")
    level = F.length(F.regexp_extract("low", r"((?: \([0-9]+\))*)$", 1)) - F.length(F.regexp_replace(F.regexp_extract("low", r"((?: \([0-9]+\))*)$", 1), r"\(", ""))
    named = stems.withColumn("n", number).withColumn("parent", F.when(F.col("n") >= 2, F.regexp_replace("low", closing, ""))).withColumn("level", level)
    parents = named.select("batch_id", F.col("low").alias("parent"))
    related = durable(named.join(parents, ["batch_id", "parent"], "left_semi"))  # children of stems that some file has
    # files of the parent before each child's first one: children are weightless rows among them
    marks = related.select("batch_id", F.col("parent").alias("low"), F.col("first").alias("pos"), F.lit(0).cast("long").alias("one"), F.col("low").alias("child"))
    placed = durable(running(own.select(*key, "pos", F.lit(1).cast("long").alias("one"), F.lit(None).cast("string").alias("child"), "stem").unionByName(marks, allowMissingColumns=True), key, "pos", "one", "rank"))
    before = placed.where("one = 0").select("batch_id", F.col("child").alias("low"), F.col("rank").alias("files"))
    open_children = durable(related.join(before, key).select(*key, "parent", "n", "level", "files"))
    lost: DataFrame | None = None  # stems whose name a parent has taken before their first file
    known = None
    for depth in [r.level for r in open_children.select("level").distinct().orderBy("level").collect()]:  # as many as closing (n) stand behind one another
        level_rows = open_children.where(F.col("level") == depth)
        if lost is not None:
            level_rows = level_rows.join(lost.select("batch_id", F.col("low").alias("parent"), F.lit(1).alias("_lost")), ["batch_id", "parent"], "left").withColumn("_lost", F.coalesce("_lost", F.lit(0)))
        else:
            level_rows = level_rows.withColumn("_lost", F.lit(0))
        # the parent's first file asks for no suffix if the name is its own
        asked = F.greatest(F.col("files") - 1 + F.col("_lost"), F.lit(0))
        flags = level_rows.withColumn("asked", asked)
        decided = durable(_owned(flags.select("batch_id", "parent", "low", "n", "asked")).join(level_rows.select(*key, "parent", "n"), key))
        known = decided if known is None else known.unionByName(decided)
        lost = known.where("not owned")
    if known is None:
        known = related.select(*key, F.lit(True).alias("owned"), "parent", "n")
    gone = known.where("not owned").select(*key, F.lit(1).alias("_lost"))
    ranked = placed.where("one = 1").select(*key, "pos", "stem", "rank").join(gone, key, "left").withColumn("j", F.col("rank") - 1 + F.coalesce("_lost", F.lit(0)))
    # of the numbers that children own, the i-th is passed over from the (n - i)-th asking on
    order = Window.partitionBy("batch_id", "parent").orderBy("n")
    passed = known.where("owned").select("batch_id", F.col("parent").alias("low"), (F.col("n") - F.row_number().over(order)).alias("j"), F.lit(1).cast("long").alias("skip"))
    both = ranked.where("j > 0").select(*key, "pos", "stem", "j", F.lit(0).cast("long").alias("skip")).unionByName(passed, allowMissingColumns=True)
    # owned numbers come first at one place
    counted = running(both.withColumn("at", 2 * F.col("j") + 1 - F.col("skip")), key, "at", "skip", "skipped").where("skip = 0")
    suffixed = counted.select("batch_id", "pos", F.concat("stem", F.lit(" ("), (F.col("j") + 1 + F.col("skipped")).cast("string"), F.lit(").pdf")).alias("out_name"))
    return suffixed.unionByName(ranked.where("j = 0").select("batch_id", "pos", F.concat("stem", F.lit(".pdf")).alias("out_name")))


def unique_output_names(manifest: DataFrame, large: int = LARGE_ROOT) -> DataFrame:
    """(batch_id, pos, out_name): distinct names, whatever the case, in input order; a suffix never takes a name that another file owns.

    Positions are distinct in a batch. A root of more than `large` files is named in many tasks, others in one each.
    """
    stem = F.regexp_replace("file_name", r"\.[^.]+$", "")
    stem = F.when(stem == "", F.col("file_name")).otherwise(stem)
    files = manifest.select(F.col("batch_id").cast("long").alias("batch_id"), F.col("pos").cast("long").alias("pos"), stem.alias("stem"), F.regexp_replace(F.lower(stem), r"( \(\d+\))+$", "").alias("root"))
    many = durable(files.groupBy("batch_id", "root").agg(F.count("*").alias("n")).where(F.col("n") > large).select("batch_id", "root"))
    if many.isEmpty():
        return small_roots(files)
    return small_roots(files.join(many, ["batch_id", "root"], "left_anti")).unionByName(large_roots(files.join(many, ["batch_id", "root"], "left_semi")))
