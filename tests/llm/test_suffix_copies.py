"""Runs that occur several times: two of their places are compared in a shard, and what is found holds for all."""

from __future__ import annotations

import collections

import numpy as np
from pyspark.sql import functions as F
import pytest

from quirework.llm import suffix_dedup


def plain(texts, window):
    """(n_bytes, n_removed, kept) of each text by counting every window."""
    data = [t.encode() for t in texts]
    count = collections.Counter(d[k : k + window] for d in data for k in range(len(d) - window + 1))
    out = []
    for d in data:
        gone = np.zeros(len(d), bool)
        for k in range(len(d) - window + 1):
            if count[d[k : k + window]] > 1:
                gone[k : k + window] = True
        out.append((len(d), int(gone.sum()), np.frombuffer(d, np.uint8)[~gone].tobytes()))
    return out


@pytest.mark.parametrize("runs_a_shard", [1000, 2])
def test_copies_near_copies_and_repeated_rows(spark, monkeypatch, runs_a_shard):
    monkeypatch.setattr(suffix_dedup, "RUNS_A_SHARD", runs_a_shard)
    rng = np.random.default_rng(4)

    def letters(n):
        return "".join(rng.choice(list("abcdefgh "), n))

    base = letters(1500)
    near = [base[:k] + letters(5) + base[k:] for k in (90, 700, 1300)]
    texts = [base] * 4 + near + [letters(900), letters(300) + base[400:820] + letters(300), "ab" * 500]
    ids = list(range(len(texts))) + [0] * 5
    rows = texts + [base] * 5  # one row six times
    docs = spark.createDataFrame(list(zip(ids, rows, strict=True)), "doc_id long, text string").repartition(4)
    got = sorted((r["doc_id"], r["n_bytes"], r["n_removed"], bytes(r["kept"])) for r in suffix_dedup.remove_repeated(docs).collect())
    assert got == sorted((i, *w) for i, w in zip(ids, plain(rows, suffix_dedup.WINDOW), strict=True))


def test_hits_come_from_the_arrays(spark):
    """Every stretch that goes is found in a shard; equal runs are asked for at two places however many there are."""
    rng = np.random.default_rng(5)
    text = "".join(rng.choice(list("abcdefgh "), 3000))
    docs = spark.createDataFrame([(i, text) for i in range(40)], "doc_id long, text string")
    docs = docs.withColumns({"row": docs["doc_id"], "row2": F.lit(0).cast("long")})
    different = suffix_dedup.grouped(suffix_dedup.all_runs(docs, 400))
    asked = suffix_dedup.compared(different)
    assert asked.count() == 2 * different.count()
    hits = suffix_dedup.shard_hits(suffix_dedup.contexts(docs, asked, 400), 400).collect()
    assert {r["row"] for r in hits} == {0}
    assert sum(r["n"] for r in hits) == len(text) - 399
