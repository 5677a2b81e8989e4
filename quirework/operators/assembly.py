"""Documents from parts: combining, merging, reordering, naming, budgets."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def combine_documents(manifest: DataFrame, pages: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(pages of each batch with a global page number, skipped documents, failed batches): unreadable parts are left out and listed.

    A batch without any readable part fails: (batch_id, reason).
    """
    good = manifest.where("readable").select("doc_id", "batch_id", "pos").join(pages.select("doc_id", "ordinal"), "doc_id")
    number = F.row_number().over(Window.partitionBy("batch_id").orderBy("pos", "ordinal"))
    failed = manifest.groupBy("batch_id").agg(F.bool_or("readable").alias("any")).where("not any").select("batch_id", F.lit("nothing-readable").alias("reason"))
    return good.select("batch_id", number.alias("page_no"), "doc_id", "ordinal"), manifest.where("not readable").select("batch_id", "pos", "doc_id", "file_name"), failed


def merge_documents(manifest: DataFrame, pages: DataFrame, max_bytes: int) -> tuple[DataFrame, DataFrame]:
    """(pages, failed batches): a batch with fewer than two inputs, or with one that is unreadable or too large, fails as a whole."""
    per = manifest.groupBy("batch_id").agg(F.count("*").alias("inputs"), F.bool_and("readable").alias("readable"), F.max("size_bytes").alias("largest"))
    reason = F.when(F.col("inputs") < 2, "too-few").when(~F.col("readable"), "unreadable").when(F.col("largest") > max_bytes, "too-large")
    judged = per.withColumn("reason", reason)
    fine = manifest.join(judged.where("reason is null").select("batch_id"), "batch_id", "left_semi")
    return combine_documents(fine, pages)[0], judged.where("reason is not null").select("batch_id", "reason")


def validate_page_edits(edits: DataFrame, manifest: DataFrame) -> DataFrame:
    """(doc_id, source_index, violation): out of range, duplicate, or turned by other than quarter turns; documents without any edit as empty."""
    times = F.count("*").over(Window.partitionBy("doc_id", "source_index"))
    known = edits.join(manifest.select("doc_id", "page_count"), "doc_id").withColumn("times", times)
    bad = F.array_compact(F.array(
        F.when((F.col("source_index") < 0) | (F.col("source_index") >= F.col("page_count")), "out-of-range"),
        F.when(F.col("times") > 1, "duplicate"),
        F.when(F.col("rotation") % 90 != 0, "rotation"),
    ))
    found = known.select("doc_id", "source_index", F.explode(bad).alias("violation")).distinct()
    empty = manifest.join(edits, "doc_id", "left_anti").select("doc_id", F.lit(None).cast("long").alias("source_index"), F.lit("empty").alias("violation"))
    return found.unionByName(empty)


def apply_page_edits(pages: DataFrame, edits: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(kept, deleted): the keep-list is the final order; pages that aren't listed go; turns add to the page's own."""
    listed = edits.select("doc_id", "position", (F.col("source_index") + 1).alias("ordinal"), F.col("rotation").alias("turn"))
    kept = pages.join(listed, ["doc_id", "ordinal"]).select("doc_id", "position", "page_id", F.pmod(F.col("rotation") + F.col("turn"), F.lit(360)).alias("rotation"))
    return kept, pages.join(listed, ["doc_id", "ordinal"], "left_anti").select("doc_id", "ordinal", "page_id")


def sequence_changed(before: DataFrame, after: DataFrame) -> DataFrame:
    """(doc_id, changed): whether the sequence of page ids differs; both sides are (doc_id, ordinal, page_id)."""
    b, a = before.select("doc_id", "ordinal", F.col("page_id").alias("was")), after.select("doc_id", "ordinal", F.col("page_id").alias("now"))
    return b.join(a, ["doc_id", "ordinal"], "full").groupBy("doc_id").agg(F.bool_or(~F.col("was").eqNullSafe(F.col("now"))).alias("changed"))


def place_imported_pages(state_pages: DataFrame, assets: DataFrame) -> DataFrame:
    """(doc_id, placed, page_id): pages in final order; imported ones whose asset is missing, or whose index is past its end, leave no hole."""
    met = state_pages.join(assets.select("asset", "pages_in_asset"), "asset", "left")
    there = F.col("asset").isNull() | (F.col("asset_index") < F.coalesce("pages_in_asset", F.lit(0)))
    order = Window.partitionBy("doc_id").orderBy("ordinal")
    return met.where(there).select("doc_id", F.row_number().over(order).alias("placed"), "page_id")


def batch_budget_cut(items: DataFrame, budget: int) -> DataFrame:
    """The items with processed and stopped_early: one is processed while the bytes before it are within the budget; the crossing one is kept."""
    before = Window.partitionBy("batch_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    rows = items.withColumn("processed", F.coalesce(F.sum("out_bytes").over(before), F.lit(0)) <= budget)
    return rows.withColumn("stopped_early", ~F.min("processed").over(Window.partitionBy("batch_id")))
