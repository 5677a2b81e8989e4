"""The SQL of the operators, and the pipeline against plain versions of its stages."""

from __future__ import annotations

import collections
from pathlib import Path

import duckdb
import pytest

import compare_sql
import corpus_pipeline
from quirework.llm import mixing, pii, queries, toxicity
from quirework.llm.common import table

from .test_operators import SF, documents, plain_components, plain_contamination, plain_simhash

import pyarrow.parquet as pq


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_same_rows_as_sql(spark, name):
    con = duckdb.connect()
    for p in Path(SF).glob("*.parquet"):
        con.execute(f"create view {p.stem} as select * from read_parquet('{p}')")
    df = queries.QUERIES[name](spark, SF)
    cols = sorted(df.columns)
    cur = con.execute(queries.ORACLES[name])
    have = [d[0] for d in cur.description]
    assert sorted(have) == cols
    assert collections.Counter(tuple(compare_sql.norm(r[c]) for c in cols) for r in df.collect()) == collections.Counter(tuple(compare_sql.norm(r[have.index(c)]) for c in cols) for r in cur.fetchall())


def test_pipeline(spark):
    docs = documents()
    raw = table(spark, SF, "documents")
    scores = {r.doc_id: r.predicted for r in toxicity.toxicity_scores(raw, toxicity.train(raw, table(spark, SF, "labels"))).collect()}
    left = {i: t for i, t in zip(docs.doc_id, docs.text, strict=True) if not scores[i]}
    stage = corpus_pipeline.STAGES[0][1](spark, raw, SF)
    assert {r.doc_id for r in stage.collect()} == set(left) and stage.columns == raw.columns
    groups = plain_components({i: plain_simhash(t) for i, t in left.items()})
    left = {i: t for i, t in left.items() if groups[i] == i}
    items = pq.read_table(f"{SF}/benchmark.parquet").to_pandas()
    dirty = {r[0] for r in plain_contamination(left.items(), zip(items.item_id, items.text, strict=True)) if r[-1]}
    left = {i: pii.masked(t, pii.find_spans(t)) for i, t in left.items() if i not in dirty}
    ran = corpus_pipeline.run(spark, SF)
    assert ran.columns == raw.columns
    rows = collections.Counter((r.doc_id, r.text) for r in ran.collect())
    mixed = spark.createDataFrame([(i, left[i], s) for i, s in zip(docs.doc_id, docs.source, strict=True) if i in left], "doc_id long, text string, source string")
    copies = {r.doc_id: r.copies for r in mixing.mix_sources(mixed).collect()}
    assert rows == collections.Counter({(i, t): copies[i] for i, t in left.items() if copies[i]}) and set(copies.values()) <= {0, 1, 2}
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "simhash_near_dedup", "benchmark_decontamination", "pii", "mixing"]


def test_odd_documents_go_through_every_stage(spark, tmp_path):
    """Nulls in any column, empty and very long texts, repeated rows, columns with the names that stages use, and empty tables."""
    rows = [(1, None, "en", "a", 0), (None, "some words", None, None, None), (None, "some words", None, None, None), (2, "", "en", "a", 1), (3, "word " * 30_000, "en", "b", 2), (4, "call +49 30 1234567 now", "de", "b", 3), (5, "alpha beta", "de", None, 4)]
    docs = spark.createDataFrame([(*r, "x", 7, True, "c") for r in rows], "doc_id long, text string, lang string, source string, n_chars long, row_hash string, size long, goes boolean, _possible string")
    spark.createDataFrame([(1, "alpha beta"), (None, None)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame([(1, 1, None), (None, None, 1)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    for table_rows, want in ((docs, [7, 5, 4, 4]), (docs.where("false"), [0, 0, 0, 0])):
        kept = table_rows
        for (name, stage), n in zip(corpus_pipeline.STAGES, [*want, None], strict=True):
            kept = stage(spark, kept, str(tmp_path))
            assert kept.columns == docs.columns, name
            assert n is None or kept.count() == n, name
        if want[0]:
            assert {r.text for r in kept.collect()} >= {"some words"} and kept.where("text like '%1234567%'").count() == 0
        else:
            assert kept.count() == 0
