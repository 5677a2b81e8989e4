"""Substring search for many queries at once, over an index of trigrams."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quirework.durable import durable
from quirework.functions import settings, trimmed

GRAM = 3
#: Lists of postings that are intersected for a query, the shortest ones; trigrams of queries that tasks know beforehand.
RAREST, KNOWN_GRAMS = 3, 1 << 20
#: Different queries that tasks know beforehand.
KNOWN_QUERIES = 100_000


def trigrams(text: str) -> np.ndarray:
    """The distinct trigrams of a text, three code points of 21 bits each."""
    c = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
    return np.unique(c[:-2] << 42 | c[1:-1] << 21 | c[2:]) if len(c) >= GRAM else np.zeros(0, np.int64)


def postings(texts: DataFrame, key: str, wanted: np.ndarray | None = None) -> DataFrame:
    """(key, gram) for each distinct trigram of texts (key, said); with wanted, a sorted array, of those only."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            grams = [trigrams(t) for t in b.column("said").to_pylist()]
            if wanted is not None:
                grams = [g[wanted[np.minimum(np.searchsorted(wanted, g), len(wanted) - 1)] == g] if len(wanted) else g[:0] for g in grams]
            rows = np.repeat(np.arange(len(b)), [len(g) for g in grams])
            yield pa.RecordBatch.from_arrays([b.column(key).take(pa.array(rows)), pa.array(np.concatenate([np.zeros(0, np.int64), *grams]))], [key, "gram"])

    return texts.select(key, "said").mapInArrow(scan, f"{key} long, gram long")


def known(grams: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """Where in wanted, a sorted array, the trigrams are that it has."""
    at = np.minimum(np.searchsorted(wanted, grams), len(wanted) - 1)
    return at[wanted[at] == grams] if len(wanted) else at[:0]


def gram_counts(texts: DataFrame, wanted: np.ndarray) -> DataFrame:
    """(gram, docs): in how many texts (said) each of the wanted trigrams is, summed in the reading tasks."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros(len(wanted), np.int64)
        for b in batches:
            for text in b.column("said").to_pylist():
                n[known(trigrams(text), wanted)] += 1
        yield pa.RecordBatch.from_arrays([pa.array(wanted[n > 0]), pa.array(n[n > 0])], ["gram", "docs"])

    return texts.select("said").mapInArrow(scan, "gram long, docs long").groupBy("gram").agg(F.sum("docs").alias("docs"))


def search_known(texts: DataFrame, asked: list[str], docs_with: dict[int, int]) -> DataFrame:
    """(doc_id, asked): the texts (doc_id, said) that hold a query of three characters or more; docs_with tells in how many texts a trigram is.

    Each text is searched where it is read, for the queries whose rarest trigrams it has.
    """
    rare = [sorted(trigrams(a).tolist(), key=lambda g: (docs_with.get(g, 0), g))[:RAREST] for a in asked]
    need = np.array([len(r) for r in rare], np.int64)
    grams, of = np.array([g for r in rare for g in r], np.int64), np.repeat(np.arange(len(rare)), need)
    order = np.argsort(grams, kind="stable")
    owners, (wanted, starts) = of[order], np.unique(grams[order], return_index=True)
    ends = np.append(starts[1:], len(owners))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows, found = [], []
            for row, text in enumerate(b.column("said").to_pylist()):
                met = [owners[starts[k] : ends[k]] for k in known(trigrams(text), wanted)]
                if met:
                    q, n = np.unique(np.concatenate(met), return_counts=True)
                    hits = [asked[k] for k in q[n == need[q]] if asked[k] in text]
                    rows += [row] * len(hits)
                    found += hits
            yield pa.RecordBatch.from_arrays([b.column("doc_id").take(pa.array(rows, pa.int64())), pa.array(found, pa.string())], ["doc_id", "asked"])

    return texts.select("doc_id", "said").mapInArrow(scan, "doc_id long, asked string")


def search_many(docs: DataFrame, cols: list[str], queries: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """(query_id, doc_id): the documents whose columns, joined by spaces, hold a query (query_id, query), whatever the case and without white space around it.

    Queries of three characters or more go by their rarest trigrams: only documents with all of these are searched. Tasks that can be told the queries
    do that where they read a text, and nothing but finds is moved; for more queries, the documents in the shortest lists of an index are intersected.
    Shorter ones, of which there may be 10,000 different, are searched for in all documents; an empty or null query finds all. Rows without an id
    are not found. Only trigrams that some query has are indexed, as long as tasks can be told them; beyond that, all.
    """
    said = docs.where(docs[id_col].isNotNull()).select(docs[id_col].cast("long").alias("doc_id"), F.lower(F.concat_ws(" ", *cols)).alias("said"))
    asked = durable(queries.select(F.col("query_id").cast("long").alias("query_id"), F.coalesce(F.lower(trimmed(F.col("query"))), F.lit("")).alias("said")))
    short = F.length("said") < GRAM
    few = settings(asked.where(short).select(F.col("said").alias("asked")).distinct())
    scanned = said.join(few, F.contains("said", "asked")).join(asked.where(short).withColumnRenamed("said", "asked"), "asked").select("query_id", "doc_id")

    grams = durable(postings(asked.where(~short), "query_id"))
    some = [r.gram for r in grams.select("gram").distinct().limit(KNOWN_GRAMS + 1).collect()]
    texts = [r.said for r in asked.where(~short).select("said").distinct().limit(KNOWN_QUERIES + 1).collect()]
    if len(some) <= KNOWN_GRAMS and len(texts) <= KNOWN_QUERIES:
        docs_with = {r.gram: r.docs for r in gram_counts(said, np.sort(np.array(some, np.int64))).collect()}
        found = search_known(said, texts, docs_with).join(asked.withColumnRenamed("said", "asked"), "asked")
        return scanned.unionByName(found.select("query_id", "doc_id"))
    index = durable(postings(said, "doc_id", np.sort(np.array(some, np.int64)) if len(some) <= KNOWN_GRAMS else None))
    sizes = index.groupBy("gram").agg(F.count("*").alias("docs"))
    by_size = Window.partitionBy("query_id").orderBy(F.coalesce("docs", F.lit(0)), "gram")
    rare = grams.join(sizes, "gram", "left").withColumn("k", F.row_number().over(by_size)).where(F.col("k") <= RAREST)
    rare = rare.withColumn("lists", F.count("*").over(Window.partitionBy("query_id"))).select("query_id", "gram", "lists")
    met = index.distinct().join(rare, "gram").groupBy("query_id", "doc_id", "lists").agg(F.count("*").alias("n")).where("n = lists")
    found = met.join(asked.withColumnRenamed("said", "asked"), "query_id").join(said, "doc_id").where(F.contains("said", "asked"))
    return scanned.unionByName(found.select("query_id", "doc_id"))
