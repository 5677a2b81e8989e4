"""Literal cases, second implementations and invariants of the document operators."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from quirework.operators import assembly, editlog, naming, redaction, selection, stamps, structure, text
from quirework.plans.fixtures import derive

SF = "/root/testdata/sf0.001"

RANGES = [
    ("1-3, 5", 10, [1, 2, 3, 5], []),
    ("5-2", 10, [5, 4, 3, 2], []),
    ("8-", 10, [8, 9, 10], []),
    ("-3", 10, [1, 2, 3], []),
    ("50-60", 10, [10], []),
    ("0-3", 10, [1, 2, 3], []),
    ("1, banana, 99, -", 10, [1], ["banana", "99", "-"]),
    ("  1 , , 2 - 3  ", 10, [1, 2, 3], []),
    ("99999999999999999999-2", 4, [4, 3, 2], []),
    ("99999999999999999999", 4, [], ["99999999999999999999"]),
    (" 2", 4, [2], []),
    ("1-3", 0, [], []),
    ("", 5, [], []),
]


def test_page_ranges(spark):
    rows = [(i, i, r) for i, (r, *_) in enumerate(RANGES)]
    sel = spark.createDataFrame(rows, "sel_id long, doc_id long, range_text string")
    man = spark.createDataFrame([(i, n) for i, (_, n, *_) in enumerate(RANGES)], "doc_id long, page_count long")
    pages, bad = {}, {}
    for r in selection.expand_page_ranges(sel, man).orderBy("sel_id", "ordinal").collect():
        pages.setdefault(r.sel_id, []).append(r.page)
    for r in selection.invalid_selection_tokens(sel, man).orderBy("sel_id", "pos").collect():
        bad.setdefault(r.sel_id, []).append(r.token)
    assert [(pages.get(i, []), bad.get(i, [])) for i in range(len(RANGES))] == [(p, b) for *_, p, b in RANGES]


@pytest.mark.parametrize(("pages", "text_"), [([1, 2, 3, 7, 9, 10], "1-3, 7, 9-10"), ([1, 1, 2], "1, 1-2"), ([3, 2, 1], "3, 2, 1")])
def test_page_runs(spark, pages, text_):
    rows = spark.createDataFrame([(1, k, p) for k, p in enumerate(pages)], "sel_id long, ordinal long, page long")
    assert selection.summarize_page_runs(rows).first().text == text_


def test_parts_cover_each_page_once(spark):
    man = spark.createDataFrame([(k, n) for k, n in enumerate((700, 13, 1, 3, 0))], "doc_id long, page_count long")
    for k in (1, 2, 4, 6, 10):
        rows = selection.split_into_parts(man, F.lit(k)).orderBy("doc_id", "part").collect()
        for d, n in enumerate((700, 13, 1, 3)):
            own = [(r.from_page, r.to_page) for r in rows if r.doc_id == d]
            assert [p for a, b in own for p in range(a, b + 1)] == list(range(1, n + 1))
            sizes = [b - a + 1 for a, b in own]
            assert len(own) == min(k, n) and sizes == sorted(sizes, reverse=True) and max(sizes) - min(sizes) <= 1


def test_names_never_collide(spark):
    names = ["Clase 1.pptx", "Clase 1.docx", "Clase 1 (2).pptx", "clase 1.ppt", ".pptx", "a.b.docx", "A.B.doc", "x"]
    man = spark.createDataFrame([(1, k, n) for k, n in enumerate(names)], "batch_id long, pos long, file_name string")
    got = [r.out_name for r in naming.unique_output_names(man).orderBy("pos").collect()]
    taken, want = set(), []
    for n in names:
        stem = n.rsplit(".", 1)[0] if "." in n and n.rsplit(".", 1)[0] else n
        c, k = f"{stem}.pdf", 2
        while c.lower() in taken:
            c, k = f"{stem} ({k}).pdf", k + 1
        taken.add(c.lower())
        want.append(c)
    assert got == want and len({g.lower() for g in got}) == len(got)


def plain_state(pc, edits):
    """A second implementation: pages as [id, turns, crop, raster] and marks, one edit after another."""
    pages, marks = [[f"o{i}", 0, None, None] for i in range(pc)], []
    ids = lambda: [p[0] for p in pages]
    for e in edits:
        at = ids().index(e.before_id) if e.before_id in ids() else None
        if e.kind == "delete" and e.page_id in ids() and set(ids()) != {e.page_id}:
            pages = [p for p in pages if p[0] != e.page_id]
            marks = [m for m in marks if m[1] != e.page_id]
        elif e.kind == "move" and e.page_id in ids():
            page = pages[ids().index(e.page_id)]
            rest = [p for p in pages if p is not page]
            anchor = [p[0] for p in rest]
            if e.before_id is None or e.before_id in anchor:
                rest.insert(len(rest) if e.before_id is None else anchor.index(e.before_id), page)
                pages = rest
        elif e.kind == "insert":
            pages[len(pages) if at is None else at : 0 if at is None else at] = [[f"i{e.seq}:{e.asset}:{i}", 0, None, None] for i in e.indices]
        elif e.kind == "insertImages":
            pages[len(pages) if at is None else at : 0 if at is None else at] = [[f"g{e.seq * 1000 + k}:{a}", 0, None, None] for k, a in enumerate(e.assets)]
        elif e.kind in ("rotate", "crop", "raster"):
            for p in pages:
                if p[0] == e.page_id:
                    if e.kind == "rotate":
                        p[1] = (p[1] + e.turns) % 4
                    else:
                        p[2 if e.kind == "crop" else 3] = e.payload
        elif e.kind == "draw" and e.page_id in ids():
            marks.append((e.mark_id, e.page_id))
        elif e.kind == "erase":
            marks = [m for m in marks if m[0] != e.mark_id]
    return pages, marks


def test_state_at_every_cursor(spark):
    log = derive(spark, SF, "edit_log").where("doc_id % 3 = 0")
    man = log.select("doc_id", "pc").distinct()
    rows = sorted(log.collect(), key=lambda r: (r.doc_id, r.seq))
    assert {r.kind for r in rows} >= {"insert", "insertImages", "move", "delete", "crop", "raster", "draw", "erase"} and any(r.page_id and r.page_id[0] in "ig" for r in rows)
    docs = {r.doc_id: r.pc for r in rows}
    cursors = spark.createDataFrame([(d, c) for d in docs for c in range(-1, 1 + sum(r.doc_id == d for r in rows))], "doc_id long, cursor int")
    state = editlog.state_at(man, log, cursors)
    pages, shown, marks = {}, {}, {}
    for r in state["pages"].orderBy("doc_id", "cursor", "ordinal").collect():
        pages.setdefault((r.doc_id, r.cursor), []).append(r.page_id)
    for r in state["attributes"].collect():
        shown.setdefault((r.doc_id, r.cursor), set()).add((r.page_id, r.turns, r.crop, r.raster))
    for r in state["marks"].collect():
        marks.setdefault((r.doc_id, r.cursor), []).append((r.mark_id, r.page_id))
    for d, c in pages:
        want, drawn = plain_state(docs[d], [r for r in rows if r.doc_id == d and r.seq < c])
        assert pages[d, c] == [p[0] for p in want] and shown[d, c] == {tuple(p) for p in want}
        assert sorted(marks.get((d, c), [])) == sorted(drawn)
    assert len(pages) == cursors.count()


LOG = "doc_id long, seq long, kind string, page_id string, before_id string, asset string, indices array<long>, assets array<string>, mark_id string"


def test_fold_inserts_and_last_page(spark):
    man = spark.createDataFrame([(1, 2), (2, 1), (3, 1)], "doc_id long, pc int")
    edits = [
        (1, 0, "insert", None, "o1", "a", [4, 4, 5], None, None), (1, 1, "insertImages", None, "gone", None, None, ["p", "q"], None), (1, 2, "move", "o0", "o0", None, None, None, None),
        (1, 3, "move", "i0:a:4", None, None, None, None, None), (1, 4, "delete", "o1", None, None, None, None, None), (1, 5, "insert", None, None, "b", [], None, None),
        (2, 0, "delete", "o0", None, None, None, None, None), (3, 0, "insert", None, "o0", "a", [1], None, None), (3, 1, "draw", "i0:a:1", None, None, None, None, "m1"), (3, 2, "draw", "o0", None, None, None, None, "m2"), (3, 3, "draw", "gone", None, None, None, None, "m3"),
    ]
    log = spark.createDataFrame(edits, LOG)
    fold = editlog.page_order_fold(man, log)
    got = {r.doc_id: (r.pages, [(x.page, x.seq) for x in r.deletes]) for r in fold.collect()}
    assert got[1] == (["o0", "i0:a:4", "i0:a:5", "g1000:p", "g1001:q", "i0:a:4"], [("o1", 4)])
    assert got[2] == (["o0"], []) and got[3] == (["i0:a:1", "o0"], [])
    assert {r.mark_id for r in editlog.live_marks(log, editlog.final_pages(fold)).collect()} == {"m1", "m2"}


def test_metadata_null_takes_back(spark):
    log = spark.createDataFrame([(1, 0, "metadata", "title", "a"), (1, 1, "metadata", "title", None), (1, 2, "metadata", "author", "b")], "doc_id long, seq long, kind string, field string, new_value string")
    assert [tuple(r) for r in editlog.metadata_at(log).collect()] == [(1, "author", "b")]


def test_changed_pages(spark):
    b = spark.createDataFrame([(1, "o0", "x"), (1, "o1", "y"), (1, "o2", "z")], "doc_id long, page_id string, signature string")
    a = spark.createDataFrame([(1, "o0", "x"), (1, "o1", "Y"), (1, "i0", "w")], "doc_id long, page_id string, signature string")
    assert {(r.page_id, r.change) for r in editlog.changed_pages(b, a).collect()} == {("o1", "changed"), ("o2", "removed"), ("i0", "added")}


def test_reachable_and_unreachable_split_the_objects(spark):
    edges = spark.createDataFrame([("r", "a"), ("a", "b"), ("b", "a"), ("b", "x"), ("x", "c"), ("z", "a")], "src string, dst string")
    nodes = spark.createDataFrame([(n,) for n in "rabxcz"], "node string")
    got = structure.reachable_objects(edges, nodes.where("node = 'r'"), nodes.where("node = 'x'"))
    assert {r.node for r in got.collect()} == {"r", "a", "b"}
    assert {r.node for r in structure.unreachable_objects(nodes, got).collect()} == {"x", "c", "z"}


def fragments(spark, rows):
    return spark.createDataFrame([(1, 1, k, *r) for k, r in enumerate(rows)], "doc_id long, page_no int, frag_no long, str string, x double, y double, width double, height double, has_eol boolean")


def test_paragraphs(spark):
    rows = [("Hello", 0.0, 100.0, 25.0, 10.0, False), ("wor-", 28.0, 100.0, 20.0, 10.0, True), ("ld", 0.0, 88.0, 10.0, 10.0, False), (" .", 10.0, 88.0, 10.0, 10.0, True), ("Next", 0.0, 76.0, 20.0, 10.0, True), ("New", 0.0, 50.0, 10.0, 10.0, True), ("Up", 0.0, 90.0, 10.0, 10.0, False)]
    lines = text.line_texts(text.group_lines(fragments(spark, rows)))
    assert [r.text for r in text.paragraphs(lines).orderBy("para_no").collect()] == ["Hello world . Next", "New", "Up"]


def test_broken_ocr_trees_give_no_rows(spark):
    good = '{"blocks":[{"paragraphs":[{"lines":[{"words":[{"text":" a ","bbox":{"x0":0,"y0":0,"x1":1,"y1":1}},{"text":"b","bbox":{"x0":2,"y0":0,"x1":1,"y1":1},"confidence":9},{"text":"c"},{"text":" "}]}]}]}]}'
    df = spark.createDataFrame([(1, 1, good), (2, 1, "nonsense"), (3, 1, None), (4, 1, '{"blocks":null}')], "doc_id long, page_no int, result string")
    assert [(r.doc_id, r.text, r.confidence) for r in text.ocr_words(df).collect()] == [(1, "a", 0.0)]


def test_release_gate_withholds_survivors(spark):
    frags = fragments(spark, [("Secret", 0.0, 0.0, 30.0, 10.0, False), ("ok", 50.0, 0.0, 10.0, 10.0, False)])
    boxes = spark.createDataFrame([(1, 1, 0.0, 0.0, 31.0, 10.0)], "doc_id long, page_no int, x double, y double, width double, height double")
    needles = redaction.redaction_needles(redaction.words_under_boxes(frags, boxes))
    assert [r.word for r in needles.collect()] == ["Secret"]
    left = redaction.redaction_survivors(needles, frags)
    assert redaction.release_gate(frags, left).first().released is False
    assert redaction.release_gate(frags, redaction.redaction_survivors(needles, frags.where("frag_no = 1"))).first().released is True


def test_numbers_and_gestures(spark):
    pages = spark.createDataFrame([(1, 5), (1, 2), (1, 9)], "doc_id long, ordinal long")
    assert [r.label for r in stamps.number_pages(pages, 3, "de").orderBy("ordinal").collect()] == ["3 de 5", "4 de 5", "5 de 5"]
    drags = spark.createDataFrame([(1, 9.0, 9.0, 1.0, 2.0), (2, 0.0, 0.0, 2.0, 50.0)], "id long, x1 double, y1 double, x2 double, y2 double")
    assert [tuple(r) for r in stamps.normalize_gestures(drags).collect()] == [(1, 1.0, 2.0, 8.0, 7.0)]


def test_parts_are_written_and_read_again(spark, tmp_path):
    from quirework.sources import corpus

    pages = derive(spark, SF, "doc_pages").where("doc_id < 20")
    parts = selection.split_into_parts(derive(spark, SF, "doc_manifest").where("doc_id < 20"), F.lit(3))
    corpus.write_parts(parts, pages, str(tmp_path / "parts"))
    back = spark.read.parquet(str(tmp_path / "parts"))
    assert back.count() == pages.count() and back.select("doc_id", "part").distinct().count() == parts.count()


def test_corpus_is_read_with_declared_types(spark):
    from quirework.sources import corpus

    tables = corpus.load_corpus(spark, SF)
    assert set(tables) == set(corpus.SCHEMAS) and tables["documents"].where("readable").count() > 0
