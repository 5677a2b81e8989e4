"""The sink that can be run again, heads of files, searches for many queries, boxes in a grid, many needles in one pass."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from quirework.operators import redaction, search, selection
from quirework.plans.fixtures import derive
from quirework.sources import corpus

SF = "/root/testdata/sf0.001"


def tables(spark, batches):
    manifest = derive(spark, SF, "doc_manifest").where(F.col("batch_id").isin(*batches))
    parts = selection.split_into_parts(manifest, F.lit(3)).join(manifest.select("doc_id", "batch_id"), "doc_id")
    return parts, derive(spark, SF, "doc_pages").select("doc_id", "ordinal", "page_id")


def read(spark, path):
    return sorted(tuple(r) for r in spark.read.parquet(path).select("batch_id", "doc_id", "part", "ordinal", "page_id").collect())


def test_a_run_of_one_batch_leaves_the_others(spark, tmp_path):
    path = str(tmp_path / "parts")
    manifest = corpus.write_parts(*tables(spark, [0, 1, 2]), path, ("batch_id",))
    all_rows = read(spark, path)
    assert {r.folder for r in manifest.collect()} == {f"batch_id={k}" for k in range(3)} and sum(r.rows for r in manifest.collect()) == len(all_rows)
    parts, pages = tables(spark, [1])
    corpus.write_parts(parts, pages.withColumn("page_id", F.concat(F.lit("new"), "page_id")), path, ("batch_id",))
    again = read(spark, path)
    assert [r for r in again if r[0] != 1] == [r for r in all_rows if r[0] != 1]
    assert [(*r[:4], r[4].removeprefix("new")) for r in again if r[0] == 1] == [r for r in all_rows if r[0] == 1] and any(r[4].startswith("new") for r in again)
    assert spark.read.parquet(f"{path}/_manifest").select("run").distinct().count() == 2


def test_a_run_that_fails_midway_changes_nothing(spark, tmp_path):
    path = str(tmp_path / "parts")
    corpus.write_parts(*tables(spark, [0, 1]), path, ("batch_id",))
    before = read(spark, path)
    parts, pages = tables(spark, [0, 1, 2])
    broken = pages.withColumn("page_id", F.when(F.col("doc_id") == 25, F.raise_error(F.lit("broken page"))).otherwise("other"))
    with pytest.raises(Exception, match="broken page"):
        corpus.write_parts(parts, broken, path, ("batch_id",))
    assert read(spark, path) == before and spark.read.parquet(f"{path}/_manifest").select("run").distinct().count() == 1
    assert not [*tmp_path.glob("parts/_staging*")]


def test_heads_of_files(spark, tmp_path):
    heads = {r.asset: (r.declared_kind, bytes.fromhex(r.head_hex)) for r in derive(spark, SF, "image_assets").limit(60).collect()}
    for asset, (kind, head) in heads.items():
        (tmp_path / f"{asset}.{kind}").write_bytes(head + b"\0" * 5000)
    (tmp_path / "no picture, 100% text.jpeg").write_bytes(b"GI")
    (tmp_path / "empty.png").write_bytes(b"")  # Spark lists no empty files
    (tmp_path / "deep").mkdir()
    (tmp_path / "deep" / "x.png").write_bytes(b"\x89PNG")
    got = {tuple(r) for r in corpus.audit_asset_types(corpus.read_asset_heads(spark, str(tmp_path))).collect()}
    want: dict = {("jpg", "unknown"): 1, ("png", "png"): 1}
    for kind, head in heads.values():
        key = kind, "png" if head[:3] == b"\x89PN" else "jpg" if head[:3] == b"\xff\xd8\xff" else "unknown"
        want[key] = want.get(key, 0) + 1
    assert got == {(*k, n) for k, n in want.items()}


def test_many_queries(spark):
    rng = random.Random(1)
    docs = [(k, " ".join(rng.choice(["Straße", "tion", "nation of", "ab", "日本語", "x"]) for _ in range(rng.randrange(8))), rng.choice(["S1", None])) for k in range(80)] + [(None, "nation of", "S1"), (5, None, None), (7, "only seven", None)]
    queries = list(enumerate(["NATION OF", " tion ", "日本語", "日本", "ab x", "", None, "  ", "x", "zzz", "s1 ab", "straße", "a" * 50, "only seven"]))
    got = sorted(tuple(r) for r in search.search_many(spark.createDataFrame(docs, "doc_id long, text string, source string"), ["source", "text"], spark.createDataFrame(queries, "query_id long, query string")).collect())
    want = [(q, d) for q, asked in queries for d, t, s in docs if d is not None and (asked or "").strip().lower() in " ".join(x for x in (s, t) if x is not None).lower()]
    assert got == sorted(want)


def test_all_trigrams_if_there_are_too_many(spark, monkeypatch):
    monkeypatch.setattr(search, "KNOWN_GRAMS", 2)
    docs = spark.createDataFrame([(1, "alpha beta"), (2, "beta gamma")], "doc_id long, text string")
    queries = spark.createDataFrame([(1, "beta"), (2, "gamma"), (3, "alpha b")], "query_id long, query string")
    assert sorted(tuple(r) for r in search.search_many(docs, ["text"], queries).collect()) == [(1, 1), (1, 2), (2, 2), (3, 1)]


def test_boxes_in_a_grid(spark):
    rng = random.Random(2)
    rect = lambda wide: (rng.uniform(-200, 900), rng.uniform(-200, 900), rng.choice([0.0, 5.0, 64.0, 70.0, wide]), rng.choice([0.0, 8.0, 64.0, wide]))
    frags = [(1, p, k, f"w{k}", *rect(1000.0)) for p in (1, 2, 3) for k in range(150)] + [(1, 1, 900, "huge", -1e6, -1e6, 2e6, 2e6), (1, 1, 901, "nan", float("nan"), 0.0, 1.0, 1.0)]
    boxes = [(1, p, *rect(300.0)) for p in (1, 2) for _ in range(25)] + [(1, 2, -1e7, 100.0, 2e7, 30.0), (1, 1, 0.0, 0.0, float("inf"), 1.0), (2, 1, 0.0, 0.0, 1e3, 1e3)]
    got = {tuple(r)[1:3] for r in redaction.words_under_boxes(
        spark.createDataFrame(frags, "doc_id long, page_no int, frag_no int, str string, x double, y double, width double, height double"),
        spark.createDataFrame(boxes, "doc_id long, page_no int, x double, y double, width double, height double")).collect()}
    meets = lambda f, b: f[0] == b[0] and f[1] == b[1] and f[4] + f[6] > b[2] - 1 and f[4] < b[2] + b[4] + 1 and f[5] + f[7] > b[3] - 1 and f[5] < b[3] + b[5] + 1
    want = {(f[1], f[2]) for f in frags if f[3] != "nan" and any(meets(f, b) for b in boxes)}
    assert {k for k in got if k[1] != 901} == want and (1, 900) in got


def test_a_page_of_many_boxes(spark):
    """Ten thousand boxes and fragments on one page: cells meet, not all pairs."""
    place = lambda n: (F.col("id") % 100 * n + 0.0, F.floor(F.col("id") / 100) * n + 0.0)
    (x, y), (bx, by) = place(10), place(10)
    frags = spark.range(10_000).select(F.lit(1).alias("doc_id"), F.lit(1).alias("page_no"), F.col("id").alias("frag_no"), F.lit("w").alias("str"), x.alias("x"), y.alias("y"), F.lit(4.0).alias("width"), F.lit(4.0).alias("height"))
    boxes = spark.range(10_000).select(F.lit(1).alias("doc_id"), F.lit(1).alias("page_no"), (bx + 5.5).alias("x"), (by + 0.0).alias("y"), F.when(F.col("id") % 2 == 0, 1.0).otherwise(4.0).alias("width"), F.lit(2.0).alias("height"))
    assert redaction.words_under_boxes(frags, boxes, 0.0).count() == 0
    assert redaction.words_under_boxes(frags, boxes, 1.6).count() == 10_000


def test_needles_inside_and_across_words(spark):
    needles = redaction.redaction_needles(spark.createDataFrame([(1, "Smith"), (1, "smi"), (1, "th  x"), (1, "none"), (2, "Smith"), (3, "abc")], "doc_id long, str string"))
    frags = spark.createDataFrame([(1, 1, 0, "Black"), (1, 1, 1, "smith"), (1, 2, 0, "x"), (2, 1, 0, None)], "doc_id long, page_no int, frag_no int, str string")
    forms = spark.createDataFrame([(3, "xABCx"), (3, None)], "doc_id long, value string")
    assert {tuple(r) for r in redaction.redaction_survivors(needles, frags, forms).collect()} == {(1, "Smith"), (1, "smi"), (1, "th  x"), (3, "abc")}
