"""Benchmark decontamination with a distributed positional inverted index.

One pass over the texts stores the postings (document, position, term) of all words that the benchmark has; everything after
reads these. Each window of an item is looked up through its two rarest terms, by the counts of the whole corpus. A posting that
meets an item's term lies on a diagonal, position in the document minus position in the item. Where both lists meet
on one diagonal the whole window is verified against the postings, and runs of consecutive words tell which windows occur: exact
phrase matches. Where they meet on diagonals close together, the words around are counted: proximity matches. All of it is DataFrame
operations.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quirework.llm.common import durable, join_few, lower_ascii, packed

WINDOW = 10
#: What stands between words once A-Z are lower-cased.
BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: A term list is broadcast up to this many rows (some 10 MB); beyond that the join shuffles.
BROADCAST_TERMS = 100_000
#: Stands behind the last word of each text, so that its position is the number of words; it can't be in a word.
END, END_TERM = "\x00", -1
#: Of a proximity match: positions that a word may be away from its place, and the share of a window's words that are there.
SLACK = 3
SHARE = 0.8


def terms(text: Column) -> Column:
    """The words of a text as an array; null text has none."""
    ascii_only = F.octet_length(text) == F.char_length(text)  # lower() is much faster, but lowers other letters too
    lowered = F.when(ascii_only, F.lower(text)).otherwise(lower_ascii(text))
    return F.coalesce(F.array_remove(F.split(lowered, BETWEEN), ""), F.array().cast("array<string>"))


def _bounded(df: DataFrame, rows: int) -> DataFrame:
    return F.broadcast(df) if rows <= BROADCAST_TERMS else df


@dataclass
class Index:
    """Tables of one run: items (item, item_id, n, w, words), places (item, n, w, at, term), windows (item, start, w, term_1, at_1,
    term_2, at_2) and postings (doc_id, row_hash, pos, term), each written to the shared folder. term numbers a word, row_hash tells rows with one id apart."""

    items: DataFrame
    places: DataFrame
    windows: DataFrame
    postings: DataFrame


def positional_index(docs: DataFrame, items: DataFrame, window: int = WINDOW) -> Index:
    """Reads the texts once. A window that has a word which no document has is left out; items without words take no part."""
    test = items.select(items["item_id"], terms(items["text"]).alias("words")).where(F.size("words") > 0).distinct()
    test = durable(test.select(F.monotonically_increasing_id().alias("item"), "item_id", "words", F.size("words").alias("n"), F.least(F.lit(window), F.size("words")).alias("w")))
    named = test.select("item", "n", "w", F.posexplode("words").alias("at", "word"))
    vocabulary = durable(named.select("word").distinct().withColumn("term", F.monotonically_increasing_id()))
    n_terms = vocabulary.count()
    end = vocabulary.sparkSession.range(1).select(F.lit(END).alias("word"), F.lit(END_TERM).cast("long").alias("term"))
    tokens = docs.select(docs["doc_id"], F.xxhash64(docs["text"]).alias("row_hash"), F.posexplode(F.concat(terms(docs["text"]), F.array(F.lit(END)))).alias("pos", "word"))
    postings = durable(tokens.join(_bounded(vocabulary.unionByName(end), n_terms), "word").select("doc_id", "row_hash", "pos", "term"))
    places = durable(named.join(_bounded(vocabulary, n_terms), "word").select("item", "n", "w", "at", "term"))
    counted = postings.where(F.col("term") != END_TERM).groupBy("term").agg(F.count("*").alias("df"))
    weighed = places.join(counted, "term", "left").fillna(0, ["df"])
    starts = F.sequence(F.greatest(F.lit(0), F.col("at") - F.col("w") + 1), F.least(F.col("at"), F.col("n") - F.col("w")))
    inside = weighed.select("item", "w", F.explode(starts).alias("start"), "at", "term", "df")
    order = Window.partitionBy("item", "start").orderBy("df", "at")
    ranked = inside.withColumns({"rank": F.row_number().over(order), "least": F.min("df").over(Window.partitionBy("item", "start"))}).where("least > 0 and rank <= 2")
    # a window of one word has itself as the second
    rarest = ranked.groupBy("item", "start", "w").agg(F.min_by("term", "rank").alias("term_1"), F.min_by("at", "rank").alias("at_1"), F.max_by("term", "rank").alias("term_2"), F.max_by("at", "rank").alias("at_2"))
    return Index(test, places, durable(rarest), postings)


def _lists(index: Index) -> DataFrame:
    """(item, first, doc_id, row_hash, diagonal, at, role): postings of rarest (role 1) and second rarest terms (role 2) of windows,
    which share them if they have the same rarest place `first`."""
    one = index.windows.select("item", F.col("at_1").alias("first"), F.col("term_1").alias("term"), F.col("at_1").alias("at"), F.lit(1).alias("role"))
    two = index.windows.select("item", F.col("at_1").alias("first"), F.col("term_2").alias("term"), F.col("at_2").alias("at"), F.lit(2).alias("role"))
    lookups = durable(one.unionByName(two).distinct())
    met = index.postings.join(_bounded(lookups, lookups.count()), "term")
    return met.select("item", "first", "doc_id", "row_hash", (F.col("pos") - F.col("at")).alias("diagonal"), "at", "role")


def phrase_matches(index: Index) -> DataFrame:
    """(doc_id, row_hash, item, low, high): runs of positions in which every word is in an occurrence of a window of the item."""
    both = _lists(index).groupBy("item", "first", "doc_id", "row_hash", "diagonal").agg(F.bit_or("role").alias("roles")).where("roles = 3")
    found = durable(both.select("item", "doc_id", "row_hash", "diagonal").distinct())
    have = join_few(index.postings, durable(found.select("doc_id", "row_hash").distinct()), "inner").select(F.col("doc_id").alias("_d"), F.col("row_hash").alias("_h"), F.col("pos").alias("_p"), F.col("term").alias("_t")).distinct()
    want = found.join(index.places, "item").withColumn("pos", F.col("diagonal") + F.col("at"))
    met = want.join(have, (F.col("row_hash") == F.col("_h")) & (F.col("pos") == F.col("_p")) & (F.col("term") == F.col("_t")) & F.col("doc_id").eqNullSafe(F.col("_d")))
    # consecutive words of the item on one diagonal; a run as long as a window is made of windows
    along = Window.partitionBy("item", "doc_id", "row_hash", "diagonal").orderBy("at")
    runs = met.withColumn("run", F.col("at") - F.row_number().over(along)).groupBy("item", "doc_id", "row_hash", "diagonal", "w", "run").agg(F.min("pos").alias("low"), F.max("pos").alias("high"))
    return runs.where(F.col("high") - F.col("low") + 1 >= F.col("w")).select("doc_id", "row_hash", "item", "low", "high")


def proximity_matches(index: Index, slack: int = SLACK, share: float = SHARE) -> DataFrame:
    """(doc_id, row_hash, item, start, pos, found, w): windows of items that occur with words put in, left out or changed.

    Window start of the item counts as met if both its rarest words stand in the document, at most `slack` positions nearer or further
    from each other than in the item, and if `found` of its w words, at least a share of `share`, stand at most `slack` positions from where
    the rarest word, at position pos, would put them. Exact occurrences are among them.
    """
    lists = _lists(index)
    step = slack + 1
    bucket = F.floor(F.col("diagonal") / step)
    one = lists.where("role = 1").select("item", "first", "doc_id", "row_hash", "diagonal", F.explode(F.array(bucket - 1, bucket, bucket + 1)).alias("bucket"))
    two = lists.where("role = 2").select("item", "first", F.col("doc_id").alias("_d"), "row_hash", F.col("diagonal").alias("_g"), F.col("at").alias("at_2"), bucket.alias("bucket"))
    near = one.join(two, ["item", "first", "row_hash", "bucket"]).where(F.col("doc_id").eqNullSafe(F.col("_d")) & (F.abs(F.col("diagonal") - F.col("_g")) <= slack))
    near = durable(near.select("item", "first", "at_2", "doc_id", "row_hash", "diagonal").distinct())
    windows = index.windows.select("item", F.col("at_1").alias("first"), "at_2", "start")
    met = near.join(windows, ["item", "first", "at_2"]).select("item", "start", "doc_id", "row_hash", "diagonal", F.col("first").alias("anchor"))
    place = F.floor((F.col("diagonal") + F.col("at")) / step)
    want = met.join(index.places, "item").where((F.col("at") >= F.col("start")) & (F.col("at") < F.col("start") + F.col("w")))
    want = want.withColumn("bucket", F.explode(F.array(place - 1, place, place + 1)))
    have = join_few(index.postings, durable(near.select("doc_id", "row_hash").distinct()), "inner")
    have = have.select(F.col("doc_id").alias("_d"), F.col("row_hash").alias("_h"), F.col("pos").alias("_p"), F.col("term").alias("_t"), F.floor(F.col("pos") / step).alias("_b"))
    same = (F.col("row_hash") == F.col("_h")) & (F.col("term") == F.col("_t")) & (F.col("bucket") == F.col("_b")) & F.col("doc_id").eqNullSafe(F.col("_d"))
    seen = want.join(have, same).where(F.abs(F.col("_p") - F.col("diagonal") - F.col("at")) <= slack)
    counted = seen.groupBy("doc_id", "row_hash", "item", "start", (F.col("diagonal") + F.col("anchor")).alias("pos"), "w").agg(F.count_distinct("at").alias("found"))
    return counted.where(F.col("found") >= F.col("w") * F.lit(share)).select("doc_id", "row_hash", "item", "start", "pos", "found", "w")


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select(docs["doc_id"].cast("long").alias("doc_id"), F.coalesce(docs["text"], F.lit("")).alias("text"))


def near_contamination(docs: DataFrame, items: DataFrame, window: int = WINDOW, slack: int = SLACK, share: float = SHARE) -> DataFrame:
    """(doc_id, row_hash, item_id, start, pos, found, w): proximity_matches() of documents and benchmark items, with the items' ids."""
    index = positional_index(_texts(docs), items, window)
    return proximity_matches(index, slack, share).join(index.items.select("item", "item_id"), "item").drop("item")


def decontaminate(docs: DataFrame, items: DataFrame, window: int = WINDOW) -> DataFrame:
    """One row per document: doc_id, n_words, n_hit, n_items, items_sha256, contaminated.

    A window is `window` consecutive words of an item; an item with fewer words, but not none, is one window. Null texts
    have no words. Rows with one id but different texts are judged apart, repeated rows alike. Items without an id count as one
    item, which has no part in items_sha256. Other columns are ignored; an empty table on either side gives zero hits or no rows.
    """
    index = positional_index(_texts(docs), items, window)
    hits = phrase_matches(index).join(index.items.select("item", "item_id"), "item")
    positions = F.array_distinct(F.flatten(F.collect_list(F.sequence("low", "high"))))
    per = hits.groupBy(F.col("doc_id").alias("_d"), F.col("row_hash").alias("_h")).agg(
        F.size(positions).cast("long").alias("n_hit"),
        F.count_distinct(F.struct("item_id")).alias("n_items"),
        F.array_join(F.array_sort(F.collect_set(F.col("item_id").cast("string"))), ",").alias("ids"),
    )
    rows = index.postings.where(F.col("term") == END_TERM).select("doc_id", "row_hash", F.col("pos").cast("long").alias("n_words"))
    joined = rows.join(per, (F.col("row_hash") == F.col("_h")) & F.col("doc_id").eqNullSafe(F.col("_d")), "left")
    return joined.select(
        "doc_id",
        "n_words",
        F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"),
        F.coalesce("n_items", F.lit(0)).cast("long").alias("n_items"),
        F.sha2(F.coalesce("ids", F.lit("")).cast("binary"), 256).alias("items_sha256"),
        (F.coalesce("n_hit", F.lit(0)) > 0).alias("contaminated"),
    )


def clean_documents(docs: DataFrame, items: DataFrame, window: int = WINDOW) -> DataFrame:
    """The documents without any hit, all columns as they were."""
    bad = durable(phrase_matches(positional_index(_texts(docs), items, window)).select("doc_id", "row_hash").distinct())
    text = F.coalesce(docs["text"], F.lit(""))
    return join_few(packed(docs, doc_id=docs["doc_id"].cast("long"), row_hash=F.xxhash64(text)), bad, "left_anti").select("_row.*")
