"""Texts that a 32-bit hash can't tell apart, in rows with one id and without: each loses what it repeats itself, and nothing else."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from quirework.llm import substring_dedup, suffix_dedup

REPEAT = " ".join(f"shared{k}" for k in range(70))
OWN = " ".join(f"lonely{k}x" for k in range(70))


@pytest.fixture(scope="module")
def pair(spark):
    """A text with the repeat and one without it, of equal Murmur hashes."""
    texts = lambda base: spark.range(200_000).select(F.concat(F.lit(base + " "), "id").alias("text")).withColumn("h", F.hash("text"))
    row = texts(REPEAT).join(texts(OWN).withColumnRenamed("text", "other"), "h").orderBy("text").first()
    assert row is not None
    return row["text"], row["other"]


@pytest.mark.parametrize("own_id", [None, 5])
def test_colliding_rows(spark, pair, own_id):
    one, two = pair
    df = spark.createDataFrame([(own_id, one), (own_id, two), (1, REPEAT + " end")], "doc_id long, text string")
    removed = {r.n_bytes: r.n_removed for r in suffix_dedup.remove_repeated(df).collect()}
    assert removed[len(two)] == 0 and removed[len(one)] >= len(REPEAT)
    left = {r.kept for r in substring_dedup.dedup_substrings(df).collect()}
    assert two in left
    if own_id:
        assert not any(k.startswith("shared") and not k.endswith("end") for k in left)
