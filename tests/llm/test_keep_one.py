"""Rows that share an id, and rows without one, in the pipeline's near-duplicate stage."""

from __future__ import annotations

import collections

import numpy as np

import corpus_pipeline

from quirework.llm import common, url_filter

from .test_operators import odd


def test_rows_are_judged_by_id_and_text(spark):
    rng = np.random.default_rng(6)
    a, b, c, d = (" ".join(f"w{x}" for x in rng.integers(0, 10**6, 60)) for _ in range(4))
    rows = [(2, a), (7, b), (7, a), (7, b), (9, c), (None, c), (None, d), (None, d), (None, a), (8, d[:0]), (8, None)]
    docs = odd(spark, [t for _, t in rows], [i for i, _ in rows])
    kept = corpus_pipeline.drop_near_duplicates(spark, docs, "")
    assert kept.columns == docs.columns
    got = collections.Counter((r.doc_id, r.text or "") for r in kept.collect())
    assert got == collections.Counter([(2, a), (7, b), (9, c), (None, d), (8, "")])
    assert corpus_pipeline.drop_near_duplicates(spark, docs.where("false"), "").count() == 0


def test_joins_with_few_rows_are_the_same_with_and_without_a_filter(spark, monkeypatch):
    docs = spark.createDataFrame([(i % 7 if i % 5 else None, i % 3, f"t{i}") for i in range(60)], "doc_id long, row_hash int, text string")
    few = spark.createDataFrame([(1, 1, "a"), (None, 0, "b"), (3, 2, "c"), (99, 0, "d")], "doc_id long, row_hash int, mark string")
    for how in ("left", "inner", "left_anti"):
        other = few.select("doc_id", "row_hash") if how == "left_anti" else few
        rows = []
        for keys in (url_filter.USEFUL_KEYS, 0):
            monkeypatch.setattr(url_filter, "USEFUL_KEYS", keys)
            got = common.join_few(docs, other, how)
            rows.append(collections.Counter(map(tuple, got.select("doc_id", "row_hash", "text", *(["mark"] if how != "left_anti" else [])).collect())))
            monkeypatch.undo()
        assert rows[0] == rows[1] and sum(rows[0].values()) == {"left": 60, "inner": sum(1 for i in range(60) if ((i % 7 if i % 5 else None), i % 3) in {(1, 1), (None, 0), (3, 2)}), "left_anti": 60 - sum(1 for i in range(60) if ((i % 7 if i % 5 else None), i % 3) in {(1, 1), (None, 0), (3, 2)})}[how]


def test_urls_of_repeated_rows_without_ids(spark):
    rows = [(None, "http://a.b/c"), (None, "http://a.b/c"), (None, None), (None, None), (1, "http://x.y/z")]
    got = collections.Counter(tuple(r) for r in url_filter.filter_urls(spark.createDataFrame(rows, "page_id long, url string")).select("page_id", "host", "verdict").collect())
    assert got == collections.Counter({(None, "a.b", "block"): 2, (None, "", "allow"): 2, (1, "x.y", "allow"): 1})
