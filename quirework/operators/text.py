"""Text from positioned fragments and OCR trees: words, lines, paragraphs, documents.

Windows run inside one page (doc_id, page_no), never over a whole document or table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quirework.functions import ends_blank, settings, starts_blank, trimmed
from quirework.sources.formats import WIN_ANSI

#: A gap counts as a space from this share of the type size on.
SPACE_GAP_EM = 0.24
PARAGRAPH_GAP = 1.5

OCR_TREE = "struct<blocks:array<struct<paragraphs:array<struct<lines:array<struct<words:array<struct<text:string,bbox:struct<x0:double,y0:double,x1:double,y1:double>,confidence:double>>>>>>>>>"


def ocr_words(pages: DataFrame) -> DataFrame:
    """(doc_id, page_no, word_no, text, x0, y0, x1, y1, confidence) from a page's result as JSON.

    Malformed trees give no rows; blank words and inverted or missing boxes are dropped; a missing confidence is 0.
    """
    rows = pages.select("doc_id", "page_no", F.from_json("result", OCR_TREE).alias("r"))
    words = F.flatten(F.flatten(F.flatten(F.transform("r.blocks", lambda b: F.transform(b["paragraphs"], lambda p: F.transform(p["lines"], lambda x: x["words"]))))))
    flat = rows.select("doc_id", "page_no", F.posexplode(words).alias("word_no", "w"))
    box = F.col("w.bbox")
    flat = flat.select("doc_id", "page_no", "word_no", trimmed(F.col("w.text")).alias("text"), *(box[k].alias(k) for k in ("x0", "y0", "x1", "y1")), F.coalesce("w.confidence", F.lit(0.0)).alias("confidence"))
    return flat.where("text <> '' and x1 > x0 and y1 > y0")


def ocr_document_text(page_texts: DataFrame, words: DataFrame) -> DataFrame:
    """(doc_id, text, words, has_words): page texts (doc_id, page_no, text) under their headings, and whether any word was found."""
    pages = F.sort_array(F.collect_list(F.struct("page_no", F.concat(F.lit("--- Page "), F.col("page_no").cast("string"), F.lit(" ---\n"), "text").alias("t"))))
    texts = page_texts.groupBy("doc_id").agg(F.array_join(F.transform(pages, lambda p: p["t"]), "\n\n").alias("text"))
    found = words.groupBy("doc_id").agg(F.count("*").alias("words"))
    return texts.join(found, "doc_id", "left").select("doc_id", "text", F.coalesce("words", F.lit(0)).alias("words"), F.col("words").isNotNull().alias("has_words"))


def text_layer_fit(words: DataFrame, glyphs: DataFrame, scale: float, page_height: float) -> DataFrame:
    """(doc_id, page_no, word_no, font_size, x, y): the size at which each word spans its printed width, and its place on the page.

    glyphs (ch, w in thousandths of the size) is one font's short table; characters that it lacks have no width.
    """
    chars = words.select("doc_id", "page_no", "word_no", F.explode(F.split("text", "")).alias("ch")).where("ch <> ''")
    widths = chars.join(settings(glyphs, 200_000), "ch", "left").groupBy("doc_id", "page_no", "word_no").agg(F.sum(F.coalesce("w", F.lit(0.0))).alias("units"))
    met = words.join(widths, ["doc_id", "page_no", "word_no"])
    h, target = (F.col("y1") - F.col("y0")) / scale, (F.col("x1") - F.col("x0")) / scale
    start = F.greatest(0.8 * h, F.lit(1.0))
    natural = F.col("units") / 1000 * start
    size = F.when(natural <= 0, start).otherwise(F.least(F.greatest(start * target / natural, 0.3 * h), 1.6 * h))
    return met.select("doc_id", "page_no", "word_no", F.round(size, 6).alias("font_size"), (F.col("x0") / scale).alias("x"), (page_height - F.col("y1") / scale).alias("y"))


def encodability_audit(texts: DataFrame) -> DataFrame:
    """(source, texts, changed, dropped, first_unsupported): texts with characters that standard fonts can't encode, by slice; line ends don't count.

    One pass takes the runs of encodable characters out, which leaves the lost ones in their order.
    """
    lost = texts.select("source", F.regexp_replace("text", rf"[{WIN_ANSI}\r\n\t]++", "").alias("lost"))
    first = F.nullif(F.substring("lost", 1, 1), F.lit(""))
    return lost.groupBy("source").agg(F.count("*").alias("texts"), F.count_if(F.length("lost") > 0).alias("changed"), F.sum(F.length("lost")).cast("long").alias("dropped"), F.min(first).alias("first_unsupported"))


def text_fragments(items: DataFrame) -> DataFrame:
    """(doc_id, page_no, frag_no, str, x, y, width, height, has_eol) from raw items; markers without text go, a missing height falls back to the matrix, then to 10."""
    m = F.col("transform")
    height = F.coalesce(F.nullif("height", F.lit(0.0)), F.nullif(F.abs(F.get(m, 3)), F.lit(0.0)), F.lit(10.0))
    return items.where("str is not null and transform is not null").select(
        "doc_id", "page_no", "frag_no", "str", F.coalesce(F.get(m, 4), F.lit(0.0)).alias("x"), F.coalesce(F.get(m, 5), F.lit(0.0)).alias("y"), F.coalesce("width", F.lit(0.0)).alias("width"), height.alias("height"), F.coalesce("has_eol", F.lit(False)).alias("has_eol")
    )


def group_lines(fragments: DataFrame) -> DataFrame:
    """The fragments with line_no from 0: a line ends at its mark, or where the baseline moves by over half the type size."""
    w = Window.partitionBy("doc_id", "page_no").orderBy("frag_no")
    before = F.lag(F.struct("y", "height", "has_eol")).over(w)
    rows = fragments.withColumn("prev", before)
    breaks = F.col("prev.has_eol") | (F.abs(F.col("y") - F.col("prev.y")) > F.greatest("height", "prev.height") * 0.5)
    return rows.withColumn("breaks", F.coalesce(breaks, F.lit(False)).cast("int")).withColumn("line_no", F.sum("breaks").over(w)).drop("prev", "breaks")


def line_texts(lines: DataFrame) -> DataFrame:
    """(doc_id, page_no, line_no, text, y): fragments of a line joined, with a space only where the gap is wide and none is there; y is the first one's."""
    w = Window.partitionBy("doc_id", "page_no", "line_no").orderBy("frag_no")
    prev = F.lag(F.struct("str", "x", "width", "height")).over(w)
    rows = lines.withColumn("prev", prev)
    spaced = ends_blank(F.col("prev.str")) | starts_blank(F.col("str"))
    wide = F.col("x") - (F.col("prev.x") + F.col("prev.width")) > F.greatest("height", "prev.height") * SPACE_GAP_EM
    piece = F.when(F.col("prev").isNotNull() & wide & ~spaced, F.concat(F.lit(" "), "str")).otherwise(F.col("str"))
    pieces = rows.select("doc_id", "page_no", "line_no", "frag_no", "y", piece.alias("piece"))
    parts = F.sort_array(F.collect_list(F.struct("frag_no", "piece")))
    return pieces.groupBy("doc_id", "page_no", "line_no").agg(F.array_join(F.transform(parts, lambda p: p["piece"]), "").alias("text"), F.min_by("y", "frag_no").alias("y"))


def _gaps(lines: DataFrame) -> DataFrame:
    """Lines that aren't blank, with the distance to the one above and the page's typical one."""
    page = Window.partitionBy("doc_id", "page_no")
    rows = lines.where(trimmed(F.col("text")) != "").withColumn("gap", F.lag("y").over(page.orderBy("line_no")) - F.col("y"))
    return rows.withColumn("typical", F.coalesce(F.expr("percentile_disc(0.5) within group (order by case when gap > 0 then gap end) over (partition by doc_id, page_no)"), F.lit(0.0)))


def typical_line_gap(lines: DataFrame) -> DataFrame:
    """(doc_id, page_no, typical): the lower median of the positive distances between lines of a page; 0 if there are none."""
    return _gaps(lines).groupBy("doc_id", "page_no").agg(F.first("typical").alias("typical"))


def paragraphs(lines: DataFrame) -> DataFrame:
    """(doc_id, page_no, para_no, text): lines joined by a space, or without the hyphen where a word was broken.

    A paragraph ends where the text moves up, or where the distance is over 1.5 times the page's typical one.
    """
    w = Window.partitionBy("doc_id", "page_no").orderBy("line_no")
    rows = _gaps(lines).withColumn("prev", F.lag("text").over(w))
    opens = F.coalesce((F.col("gap") < 0) | ((F.col("typical") > 0) & (F.col("gap") > F.col("typical") * PARAGRAPH_GAP)), F.lit(True))
    rows = rows.withColumn("opens", opens).withColumn("para_no", F.sum(F.col("opens").cast("int")).over(w) - 1)
    rejoins = F.col("prev").rlike(r"[-‐‑]$") & F.col("text").rlike(r"^[a-zß-ÿ]") & ~F.col("opens")
    rows = rows.withColumn("rejoins", rejoins).withColumn("cut", F.coalesce(F.lead("rejoins").over(w), F.lit(False)))
    body = F.when(F.col("cut"), F.expr("substring(text, 1, length(text) - 1)")).otherwise(F.col("text"))
    piece = F.when(F.col("opens") | F.col("rejoins"), body).otherwise(F.concat(F.lit(" "), body))
    parts = F.sort_array(F.collect_list(F.struct("line_no", "piece")))
    grouped = rows.withColumn("piece", piece).groupBy("doc_id", "page_no", "para_no").agg(F.array_join(F.transform(parts, lambda p: p["piece"]), "").alias("text"))
    return grouped.withColumn("text", trimmed(F.col("text"))).where("text <> ''")


def document_text(paras: DataFrame, manifest: DataFrame) -> DataFrame:
    """(doc_id, text, has_text): paragraphs in page order, one a line, with a blank one between pages; documents without text flagged."""
    pages = F.sort_array(F.collect_list(F.struct("para_no", "text")))
    by_page = paras.groupBy("doc_id", "page_no").agg(F.array_join(F.transform(pages, lambda p: p["text"]), "\n").alias("page"))
    all_pages = F.sort_array(F.collect_list(F.struct("page_no", "page")))
    texts = by_page.groupBy("doc_id").agg(F.array_join(F.transform(all_pages, lambda p: p["page"]), "\n\n").alias("text"))
    return manifest.select("doc_id").join(texts, "doc_id", "left").select("doc_id", F.coalesce("text", F.lit("")).alias("text"), F.col("text").isNotNull().alias("has_text"))


def has_real_text(fragments: DataFrame, manifest: DataFrame) -> DataFrame:
    """(doc_id, has_real_text): whether the first three pages hold over 200 characters each on average."""
    looked = F.least(F.lit(3), "page_count")
    first = fragments.where("page_no <= 3").join(manifest.select("doc_id", "page_count"), "doc_id").where(F.col("page_no") <= looked)
    chars = first.groupBy("doc_id").agg(F.sum(F.length(trimmed(F.col("str")))).alias("chars"))
    return manifest.join(chars, "doc_id", "left").select("doc_id", (F.coalesce("chars", F.lit(0)) / F.greatest(looked, F.lit(1)) > 200).alias("has_real_text"))
