"""What the training-data operators share: table access, durable cuts of lineage, small text rules."""

from __future__ import annotations

import functools

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quirework.durable import durable  # noqa: F401

#: Words of the contracts: runs of anything but the six ASCII white space characters.
WORD = r"[^\x20\x09-\x0D]+"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: str.translate table that lower-cases A-Z and nothing else.
LOWER_ASCII = {ord(c): ord(c.lower()) for c in UPPER}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One input table of a data folder; the folder may be in any store that Spark reads."""
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def lower_ascii(text: Column) -> Column:
    """Lower-case A-Z only, in the JVM."""
    return F.translate(text, UPPER, UPPER.lower())


def batch(**columns) -> pa.RecordBatch:
    """An Arrow batch from arrays, numpy arrays and lists of strings or bytes; input columns pass through untouched, nulls included."""
    arrays = [c if isinstance(c, pa.Array) else pa.array(c, pa.string()) if isinstance(c, list) and (not c or isinstance(c[0], str)) else pa.array(c) for c in columns.values()]
    return pa.RecordBatch.from_arrays(arrays, list(columns))


def text_columns(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Only the id and the text, null text as empty; other columns of the input, whatever their names, are left out."""
    return docs.select(docs[id_col].cast("long").alias("doc_id"), F.coalesce(docs[text_col], F.lit("")).alias("text"))


def join_few(docs: DataFrame, few: DataFrame, how: str = "left", on: tuple[str, ...] = ("doc_id", "row_hash")) -> DataFrame:
    """docs joined with few on the columns `on` (null equals null), where most rows of docs have no partner.

    few has one row a key. A blocked Bloom filter of its keys, at most 2**20 blocks whatever the data, is broadcast; only rows
    of docs that pass it are shuffled to the exact join, the others are taken as they are (left, left_anti) or left out (inner). docs is read twice.
    With more keys than such a filter can tell apart, all rows go to the join. The rows are the same either way.
    """
    from quirework.llm.url_filter import USEFUL_KEYS, bloom_filter, possible_members

    key = lambda df: F.xxhash64(*(df[c] for c in on))
    keys = few.select(key(few).alias("key"))
    n_keys = keys.count()
    other = few.withColumnsRenamed({c: f"_few_{c}" for c in on})
    if n_keys > USEFUL_KEYS:
        same = functools.reduce(lambda a, b: a & b, (docs[c].eqNullSafe(other[f"_few_{c}"]) for c in on))
        return docs.join(other, same, how).drop(*(f"_few_{c}" for c in on))
    marked = possible_members(docs.withColumn("_few", key(docs)), "_few", bloom_filter(keys, "key", n_keys)).drop("_few")
    near, rest = marked.where("_possible").drop("_possible"), marked.where("not _possible").drop("_possible")
    same = functools.reduce(lambda a, b: a & b, (near[c].eqNullSafe(other[f"_few_{c}"]) for c in on))
    met = near.join(other, same, how).drop(*(f"_few_{c}" for c in on))
    return met if how == "inner" else met.unionByName(rest, allowMissingColumns=True)


def packed(docs: DataFrame, **keys: Column) -> DataFrame:
    """Key columns beside the whole row in one struct, so that no column of the table can clash with a key; select("_row.*") unpacks."""
    return docs.select(*(c.alias(k) for k, c in keys.items()), F.struct(*(docs[c] for c in docs.columns)).alias("_row"))
