"""Page ranges: from typed text to rows, sets, runs and parts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quirework.functions import trimmed

# Fixed value: a range as typed.
RANGE = r"^(\d*)\s*-\s*(\d*)$"


def _tokens(selections: DataFrame, manifest: DataFrame) -> DataFrame:
    """(sel_id, doc_id, pos, token, n, low, high, single): the tokens of each selection of a document with pages; blank ones are skipped."""
    known = selections.join(manifest.select("doc_id", F.col("page_count").alias("n")), "doc_id").where("n >= 1")
    split = known.select("sel_id", "doc_id", "n", F.posexplode(F.split("range_text", ",")).alias("pos", "raw")).withColumn("token", trimmed(F.col("raw"))).where("token <> ''")
    start, end = F.regexp_extract("token", RANGE, 1), F.regexp_extract("token", RANGE, 2)
    is_range = F.col("token").rlike(RANGE) & ~((start == "") & (end == ""))
    # a number too long for a long lies beyond the last page
    clamp = lambda c: F.least(F.greatest(F.coalesce(c.try_cast("long"), F.col("n")), F.lit(1)), F.col("n"))
    low = F.when(is_range, F.when(start == "", F.lit(1)).otherwise(clamp(start)))
    high = F.when(is_range, F.when(end == "", F.col("n")).otherwise(clamp(end)))
    number = F.when(F.col("token").rlike(r"^\d+$"), F.col("token").try_cast("long"))
    single = F.when((number >= 1) & (number <= F.col("n")), number)
    return split.select("sel_id", "doc_id", "pos", "token", "n", low.alias("low"), high.alias("high"), single.alias("single"))


def expand_page_ranges(selections: DataFrame, manifest: DataFrame) -> DataFrame:
    """(sel_id, doc_id, ordinal, page): pages in typed order, repeats kept; 5-2 counts down, ends are clamped, open ends reach the edge."""
    rows = _tokens(selections, manifest).withColumn("pages", F.when(F.col("low").isNotNull(), F.sequence("low", "high")).when(F.col("single").isNotNull(), F.array("single")))
    pages = rows.select("sel_id", "doc_id", "pos", F.posexplode("pages").alias("k", "page"))
    return pages.select("sel_id", "doc_id", F.row_number().over(Window.partitionBy("sel_id").orderBy("pos", "k")).alias("ordinal"), "page")


def invalid_selection_tokens(selections: DataFrame, manifest: DataFrame) -> DataFrame:
    """(sel_id, pos, token): what couldn't be read, as typed."""
    return _tokens(selections, manifest).where("low is null and single is null").select("sel_id", "pos", "token")


def page_set(selections: DataFrame, manifest: DataFrame, scope: str = "typed") -> DataFrame:
    """(sel_id, page): each selected page once; scope 'all' selects every page."""
    if scope == "all":
        known = selections.join(manifest.where("page_count >= 1").select("doc_id", "page_count"), "doc_id")
        return known.select("sel_id", F.explode(F.sequence(F.lit(1).cast("long"), "page_count")).alias("page"))
    return expand_page_ranges(selections, manifest).select("sel_id", "page").distinct()


def summarize_page_runs(rows: DataFrame) -> DataFrame:
    """(sel_id, text): consecutive pages, in the given order, back to a text such as 1-3, 7."""
    order = Window.partitionBy("sel_id").orderBy("ordinal")
    marked = rows.withColumn("starts", F.coalesce((F.col("page") != F.lag("page").over(order) + 1).cast("int"), F.lit(1)))
    runs = marked.withColumn("run", F.sum("starts").over(order)).groupBy("sel_id", "run").agg(F.min("page").alias("a"), F.max("page").alias("b"))
    text = F.when(F.col("a") == F.col("b"), F.col("a").cast("string")).otherwise(F.concat_ws("-", "a", "b"))
    parts = F.sort_array(F.collect_list(F.struct("run", text.alias("text"))))
    return runs.groupBy("sel_id").agg(F.array_join(F.transform(parts, lambda p: p["text"]), ", ").alias("text"))


def split_into_parts(manifest: DataFrame, k: Column) -> DataFrame:
    """(doc_id, part, from_page, to_page): k contiguous runs as equal as can be, the longer ones first, none empty."""
    n = F.col("page_count")
    rows = manifest.where("page_count >= 1").withColumn("k", F.least(F.floor(k), n)).where("k >= 1")
    rows = rows.select("doc_id", "page_count", "k", F.explode(F.sequence(F.lit(1).cast("long"), F.col("k"))).alias("part"))
    size, extra = F.floor(n / F.col("k")), n % F.col("k")
    start = (F.col("part") - 1) * size + F.least(F.col("part") - 1, extra) + 1
    return rows.select("doc_id", "part", start.alias("from_page"), (start + size + F.when(F.col("part") <= extra, 1).otherwise(0) - 1).alias("to_page"))


def extract_pages(pages: DataFrame, selection: DataFrame, asked: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(pages, empty): the selected pages of each document in selection order, repeats kept, as sel_id, ordinal and the page's columns; and
    the selections of asked (sel_id, doc_id) that select nothing."""
    chosen = selection.select("sel_id", "doc_id", "ordinal", F.col("page").alias("source_ordinal"))
    found = chosen.join(pages.withColumnRenamed("ordinal", "source_ordinal"), ["doc_id", "source_ordinal"])
    return found, asked.select("sel_id", "doc_id").join(selection, "sel_id", "left_anti")


def search_corpus(docs: DataFrame, cols: list[str], query: str) -> DataFrame:
    """Rows whose columns, joined by spaces, hold the query whatever the case; an empty query returns all."""
    asked = query.strip().lower()
    return docs if not asked else docs.where(F.lower(F.concat_ws(" ", *cols)).contains(asked))
