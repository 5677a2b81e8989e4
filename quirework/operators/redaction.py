"""Proof that what was painted over is gone from the produced documents."""

from __future__ import annotations

from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quirework.functions import one_space, trimmed

SLACK = 1.0
#: Boxes of a page up to which each of its fragments is compared with all of them.
FEW_BOXES = 256
#: Points of a cell's side, and cells beyond which a box or fragment is compared apart from the grid.
CELL, MOST_CELLS = 64.0, 4096
#: Cells, off any grid, in which wide boxes meet all fragments of their page, and wide fragments the boxes of the grid.
WIDE_BOX, WIDE_FRAGMENT = (-(2**60), 0), (-(2**60), 1)
OVERLAP = "x1 > bx0 and x0 < bx1 and y1 > by0 and y0 < by1"


def _cells(x0: Column, y0: Column, x1: Column, y1: Column) -> tuple[Column, Column]:
    """(number of cells, cells) that a rectangle touches; infinite and missing sides give a number beyond any bound."""
    lo_x, lo_y, hi_x, hi_y = (F.floor(c / CELL) for c in (x0, y0, x1, y1))
    n = F.coalesce((x1 - x0 + 2 * CELL) * (y1 - y0 + 2 * CELL) / (CELL * CELL), F.lit(float("inf")))
    far = F.greatest(*(F.abs(c) for c in (x0, y0, x1, y1))) > 2.0**50
    row = lambda j: F.transform(F.sequence(lo_x, hi_x), lambda i: F.struct(i.alias("cx"), j.alias("cy")))
    return F.when(F.isnan(n) | far, F.lit(float("inf"))).otherwise(n), F.flatten(F.transform(F.sequence(lo_y, hi_y), row))


def _apart(cell: tuple[int, int]) -> Column:
    """A list of one cell off the grid."""
    return F.array(F.struct(F.lit(cell[0]).cast("long").alias("cx"), F.lit(cell[1]).cast("long").alias("cy")))


def _mask(cells: Column) -> Column:
    """64 bits in which a cell sets the one of its column and row modulo 8: rectangles without a common bit have no common cell."""
    bit = lambda c: F.call_function("shiftleft", F.lit(1).cast("long"), (F.pmod(c["cx"], F.lit(8)) * 8 + F.pmod(c["cy"], F.lit(8))).cast("int"))
    return F.aggregate(cells, F.lit(0).cast("long"), lambda m, c: m.bitwiseOR(bit(c)))


def words_under_boxes(fragments: DataFrame, boxes: DataFrame, slack: float = SLACK) -> DataFrame:
    """(doc_id, page_no, frag_no, str): fragments that overlap a box of their page, with some slack on every side.

    On a page of at most FEW_BOXES boxes each fragment is compared with all of them where it is: fragments dealt out by doc_id and page_no are
    not moved. On other pages boxes and fragments meet in the cells of a grid, so that no page is a task of all pairs. boxes are read twice.
    """
    page, key = ["doc_id", "page_no"], ["doc_id", "page_no", "frag_no", "str"]
    b = boxes.select(*page, (F.col("x") - slack).alias("bx0"), (F.col("y") - slack).alias("by0"), (F.col("x") + F.col("width") + slack).alias("bx1"), (F.col("y") + F.col("height") + slack).alias("by1"))
    f = fragments.select(*key, F.col("x").alias("x0"), F.col("y").alias("y0"), (F.col("x") + F.col("width")).alias("x1"), (F.col("y") + F.col("height")).alias("y1"))
    b = b.withColumn("n", F.count("*").over(Window.partitionBy(*page)))
    few, many = b.where(F.col("n") <= FEW_BOXES).drop("n").hint("shuffle_hash"), b.where(F.col("n") > FEW_BOXES).drop("n").repartition(*page)  # if none, it is seen then
    near = f.join(few, (f["doc_id"] == few["doc_id"]) & (f["page_no"] == few["page_no"]) & F.expr(OVERLAP), "left_semi").select(*key).distinct()
    return near.unionByName(_met_in_grid(f, many))


def _met_in_grid(f: DataFrame, b: DataFrame) -> DataFrame:
    """The fragments that overlap a box, found in the cells of a grid that both touch.

    What touches thousands of cells is compared with all others of its page instead. Only fragments with a cell in the mask of their page's
    boxes are sent to the grid.
    """
    page, key = ["doc_id", "page_no"], ["doc_id", "page_no", "frag_no", "str"]
    (b_n, b_cells), (f_n, f_cells) = _cells(*(F.col(f"b{c}") for c in ("x0", "y0", "x1", "y1"))), _cells(*(F.col(c) for c in ("x0", "y0", "x1", "y1")))
    b_mask, f_mask = (F.when(n <= MOST_CELLS, _mask(cells)).otherwise(F.lit(-1)) for n, cells in ((b_n, b_cells), (f_n, f_cells)))
    pages = b.groupBy(*page).agg(F.bit_or(b_mask).alias("mask"), F.bool_or(~(b_n <= MOST_CELLS)).alias("wide"))
    f = f.join(pages.hint("shuffle_hash"), page).where(f_mask.bitwiseAND(F.col("mask")) != 0)
    f_at = F.concat(F.when(f_n <= MOST_CELLS, f_cells).otherwise(_apart(WIDE_FRAGMENT)), F.when(F.col("wide"), _apart(WIDE_BOX)).otherwise(F.array().cast("array<struct<cx:bigint,cy:bigint>>")))
    b_at = F.when(b_n <= MOST_CELLS, F.concat(b_cells, _apart(WIDE_FRAGMENT))).otherwise(_apart(WIDE_BOX))
    spread = lambda df, cells: df.withColumn("cell", F.explode(cells)).select("*", "cell.cx", "cell.cy").drop("cell", "mask", "wide")
    return spread(f, f_at).join(spread(b, b_at), [*page, "cx", "cy"]).where(OVERLAP).select(*key).distinct()


def painted_keys(fragments: DataFrame, boxes: DataFrame, slack: float = SLACK) -> DataFrame:
    """(doc_id, page_no, frag_no) of the fragments that overlap a box of their page, with some slack on every side."""
    return words_under_boxes(fragments, boxes, slack).select("doc_id", "page_no", "frag_no").distinct()


def without_painted(fragments: DataFrame, painted: DataFrame) -> DataFrame:
    """(doc_id, page_no, frag_no, str): the fragments that are not among the painted ones (doc_id, page_no, frag_no).

    A page's painted numbers come to its fragments as one list: fragments dealt out by doc_id and page_no are not moved.
    """
    page = ["doc_id", "page_no"]
    gone = painted.groupBy(*page).agg(F.collect_set("frag_no").alias("gone"))
    met = fragments.select(*page, "frag_no", "str").join(gone.hint("shuffle_hash"), page, "left")
    return met.where(~F.coalesce(F.array_contains("gone", F.col("frag_no")), F.lit(False))).drop("gone")


def page_runs(fragments: DataFrame) -> DataFrame:
    """(doc_id, page_no, frag_no, str): each page as one fragment that says what its fragments say, in their order, with a space between them."""
    said = F.sort_array(F.collect_list(F.struct("frag_no", "str")))
    return fragments.groupBy("doc_id", "page_no").agg(F.min("frag_no").alias("frag_no"), F.array_join(F.transform(said, lambda p: p["str"]), " ").alias("str"))


def redaction_needles(words: DataFrame) -> DataFrame:
    """(doc_id, word, needle): words of three characters or more with a letter or digit, and their form to search for."""
    word = trimmed(F.col("str"))
    worth = words.select("doc_id", word.alias("word")).where((F.length("word") >= 3) & F.col("word").rlike(r"[\p{L}\p{N}]")).distinct()
    return worth.withColumn("needle", one_space(F.lower("word")))


def redaction_survivors(needles: DataFrame, fragments: DataFrame, fields: DataFrame | None = None) -> DataFrame:
    """(doc_id, word): needles that the produced document still says, in its text or in a field's value (doc_id, value).

    Each text is sent once, to where its document's needles are sent, and read once: an automaton finds all of them in one pass.
    """
    pages = F.sort_array(F.collect_list(F.struct("page_no", "frag_no", "str")))
    own = needles.groupBy("doc_id").agg(F.collect_set("needle").alias("needles"))
    said = fragments.groupBy("doc_id").agg(F.array_join(F.transform(pages, lambda p: p["str"]), " ").alias("said")).join(own.hint("shuffle_hash"), "doc_id")
    if fields is not None:
        said = said.unionByName(fields.select("doc_id", F.col("value").alias("said")).join(own, "doc_id"))
    said = said.where("said is not null").withColumn("said", one_space(F.lower("said")))

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            docs, found = [], []
            for doc, said, wanted in zip(*(b.column(c).to_pylist() for c in ("doc_id", "said", "needles")), strict=True):
                automaton = ahocorasick.Automaton()
                for needle in wanted:
                    automaton.add_word(needle, needle)
                automaton.make_automaton()
                hits = {needle for _, needle in automaton.iter(said)}
                docs += [doc] * len(hits)
                found += hits
            yield pa.RecordBatch.from_arrays([pa.array(docs, pa.int64()), pa.array(found, pa.string())], ["doc_id", "needle"])

    hits = said.select("doc_id", "said", "needles").mapInArrow(search, "doc_id long, needle string").distinct()
    return needles.join(hits, ["doc_id", "needle"], "left_semi").select("doc_id", "word").distinct()


def release_gate(docs: DataFrame, survivors: DataFrame) -> DataFrame:
    """(doc_id, released, survivors): documents with survivors are withheld, with the words in order."""
    held = survivors.groupBy("doc_id").agg(F.array_join(F.array_sort(F.collect_set("word")), "|").alias("survivors"))
    return docs.select("doc_id").distinct().join(held, "doc_id", "left").select("doc_id", F.col("survivors").isNull().alias("released"), "survivors")
