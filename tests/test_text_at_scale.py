"""Texts at scale: words stay where their pages were dealt to, boxes and words meet in few rows, and one pass audits a text."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from quirework.operators import redaction, search, text
from quirework.plans import text as plans
from quirework.plans.fixtures import derive
from quirework.plans.registry import QUERIES

SF = "/root/testdata/sf0.001"


def exchanges(df) -> list[str]:
    """What the plan moves between tasks, by the keys that deal it out."""
    return re.findall(r"^\W*Exchange (\w+(?:\([^)]*\))?)", df._jdf.queryExecution().executedPlan().toString(), re.M)


def test_items_are_made_without_moving_words(spark):
    assert exchanges(QUERIES["t5_text_fragments"](spark, SF)) == []


def test_words_stay_with_their_pages(spark):
    for name in ("t6_group_lines", "t7_line_texts", "t8_typical_line_gap", "t9_paragraphs"):
        assert len(exchanges(QUERIES[name](spark, SF))) == 1, name


def test_offsets_in_long_lines(spark):
    """Lines of several pieces, of words and of blanks, about the ends of pieces."""
    ends = [n for k in (1, 2, 3, 20) for n in (16 * k - 1, 16 * k, 16 * k + 1)]
    docs = [(n, " ".join("é𝒳x"[: 1 + j % 3] if (n + j) % 5 else "" for j in range(n))) for n in ends]
    got = derive(spark, SF, "text_items", documents=spark.createDataFrame(docs, "doc_id long, text string")).select("doc_id", "frag_no", "str", "x0").collect()
    want = []
    for n, line in docs:
        at = 0
        for j, word in enumerate(line.split(" ")):
            want.append((n, j, word, at / 10 if j else None))
            at += 50 * len(word) + (5 if j % 7 == 0 else 28)
    assert sorted(tuple(r) for r in got) == want


def test_fragments_of_odd_texts(spark):
    odd = [(1, None), (2, ""), (3, " "), (4, "\n"), (5, "a  b\n\n c é日本 𝒳𝒳 x\n" * 30), (None, "x y\nz"), (6, "a " * 100 + "\r\n b")]
    got = derive(spark, SF, "text_items", documents=spark.createDataFrame(odd, "doc_id long, text string")).collect()
    want = []
    for doc, whole in odd:
        numbers: dict = {}
        for i, line in enumerate([] if whole is None else whole.split("\n")):
            at, words = 0, line.split(" ")
            for j, word in enumerate(words):
                numbers[i // 40] = n = numbers.get(i // 40, -1) + 1
                y = 800 - 12 * (i % 40) - 20 * (i % 40 // 4)
                want.append((doc, i // 40 + 1, n, word, at / 10 if j else None, y, 5 * len(word), 10, j == len(words) - 1 and i % 3 != 0))
                at += 50 * len(word) + (5 if (i + j) % 7 == 0 else 28)
    order = lambda r: (r[0] is None, r[0] or 0, r[1], r[2])
    assert sorted((tuple(r) for r in got), key=order) == sorted(want, key=order)


def test_fragments_are_not_moved_to_find_the_painted(spark):
    """Only what may touch a box is sent to the grid: the plan never deals all fragments out by their number."""
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        found = exchanges(redaction.words_under_boxes(*plans.painted_over(spark, SF)))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert sum("cx" in x for x in found) == 2 and not [x for x in found if "frag_no" in x and "str" not in x]


def test_audit_keeps_the_order_of_lost_characters(spark):
    rows = [("a", "plain\ttext\r\n"), ("a", "x日本y\n"), ("b", None), ("b", ""), ("c", "𝒳é€\u0007"), ("c", "\u0007a")]
    got = {tuple(r) for r in text.encodability_audit(spark.createDataFrame(rows, "source string, text string")).collect()}
    assert got == {("a", 2, 1, 2, "日"), ("b", 2, 0, 0, None), ("c", 2, 2, 3, "\u0007")}


def test_pages_of_fragments_read_as_their_fragments(spark):
    frags = spark.createDataFrame([(1, 1, 1, "smith"), (1, 1, 0, "Black"), (1, 2, 0, "x"), (2, 1, 0, None), (1, 2, 1, "gone")], "doc_id long, page_no int, frag_no int, str string")
    kept = redaction.without_painted(frags, frags.where(F.col("str") == "gone"))
    assert {tuple(r) for r in redaction.page_runs(kept).collect()} == {(1, 1, 0, "Black smith"), (1, 2, 0, "x"), (2, 1, 0, "")}


def test_known_queries_move_only_finds(spark, monkeypatch):
    """No postings for queries that tasks can be told; texts, ids and queries may repeat."""
    monkeypatch.setattr(search, "postings", lambda texts, key, wanted=None, f=search.postings: f(texts, key, wanted) if key == "query_id" else 1 / 0)
    docs = spark.createDataFrame([(1, "alpha beta"), (1, "gamma"), (2, "beta gamma"), (3, ""), (None, "beta")], "doc_id long, text string")
    queries = spark.createDataFrame([(1, "BETA"), (2, "gamma"), (3, "alpha b"), (4, "beta"), (5, "alpha gamma"), (6, "aaaa")], "query_id long, query string")
    assert sorted(tuple(r) for r in search.search_many(docs, ["text"], queries).collect()) == [(1, 1), (1, 2), (2, 1), (2, 2), (3, 1), (4, 1), (4, 2)]


def test_no_fragment_leaves_a_page_of_few_boxes(spark):
    """What ran, not only what was planned: the grid is for pages of many boxes, and there are none."""
    df = redaction.words_under_boxes(*plans.painted_over(spark, SF))
    assert df.collect()
    ran = df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    assert "Final Plan" in ran and not [x for x in re.findall(r"Exchange \w+\([^)]*\)", ran) if "cx" in x or "frag_no" in x]


def test_pages_of_few_and_of_many_boxes(spark, monkeypatch):
    frags = [(d, p, i, f"w{i}", float(7 * i % 900), float(50 * (i % 9)), 5.0 * (i % 4), 10.0) for d in (1, 2) for p in (1, 2) for i in range(60)] + [(3, 1, 0, "lone", 0.0, 0.0, 1e9, 1.0)]
    boxes = [(1, 1, 0.0, 0.0, 100.0, 60.0)] * 2 + [(1, 2, 30.0 * k, 40.0 * k, 31.0, 12.0) for k in range(8)] + [(2, 1, 10.0, -1e9, 3.0, 2e9), (2, 1, 500.0, 49.0, 9.0, 9.0), (3, 1, 5e8, 0.0, 1.0, 1.0), (4, 1, 0.0, 0.0, 9.0, 9.0)]
    want = {f[:4] for f in frags for b in boxes if f[:2] == b[:2] and f[4] + f[6] > b[2] - 1 and f[4] < b[2] + b[4] + 1 and f[5] + f[7] > b[3] - 1 and f[5] < b[3] + b[5] + 1}
    f = spark.createDataFrame(frags, "doc_id long, page_no long, frag_no int, str string, x double, y double, width double, height double")
    b = spark.createDataFrame(boxes, "doc_id long, page_no long, x double, y double, width double, height double")
    for most in (0, 1, 2, 256):
        monkeypatch.setattr(redaction, "FEW_BOXES", most)
        assert sorted(tuple(r) for r in redaction.words_under_boxes(f, b).collect()) == sorted(want), most


def test_painted_words_go_without_moving_the_others(spark):
    frags = spark.createDataFrame([(1, 1, 0, "a"), (1, 1, 1, "b"), (1, 1, None, "c"), (None, 1, 1, "d"), (1, 2, 1, "e")], "doc_id long, page_no int, frag_no int, str string")
    painted = spark.createDataFrame([(1, 1, 1), (1, 1, 1), (1, 1, 7), (None, 1, 1), (1, 1, None)], "doc_id long, page_no int, frag_no int")
    kept = redaction.without_painted(frags.repartition(4, "doc_id", "page_no"), painted)
    assert not [x for x in exchanges(kept) if "frag_no" in x]
    assert sorted(r["str"] for r in kept.collect()) == ["a", "c", "d", "e"]
