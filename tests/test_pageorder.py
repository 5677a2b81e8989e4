"""The linked list of pages against lists that are copied at each edit, and states at cursors against logs cut at the cursor."""

from __future__ import annotations

import random
import time

from pyspark.sql import functions as F

from quirework.operators import editlog
from quirework.operators.pageorder import PageOrder
from quirework.plans.fixtures import derive

SF = "/root/testdata/sf0.001"


def step(pages, kind, page, before, added):
    """One edit on a list, as it reads."""
    if kind == "delete":
        rest = [p for p in pages if p != page]
        return rest if rest else pages
    if kind == "move" and page in pages:
        rest = [*pages]
        rest.remove(page)
        if before is not None and before not in rest:
            return pages
        at = rest.index(before) if before is not None else len(rest)
        return [*rest[:at], page, *rest[at:]]
    if kind in ("insert", "insertImages"):
        at = pages.index(before) if before in pages else len(pages)
        return [*pages[:at], *added, *pages[at:]]
    return pages


def test_random_edits():
    for seed in range(60):
        rng = random.Random(seed)
        pages = [f"o{i}" for i in range(rng.randrange(5))]
        order, ids = PageOrder(pages), [f"o{i}" for i in range(5)] + ["none"]
        for k in range(80):
            kind = rng.choice(["delete", "move", "move", "insert"])
            added = rng.choice([[], [f"i{k}"], [f"i{k}", f"i{k}"], [f"i{k}", f"j{k}"]]) if kind == "insert" else None
            page, before = rng.choice(ids), rng.choice([*ids, None])
            ids += added or []
            took = order.edit(kind, page, before, added)
            after = step(pages, kind, page, before, added)
            assert took == (kind == "delete" and len(after) < len(pages))
            pages = after
            assert [*order] == pages and order.size == len(pages)


def test_many_edits_of_many_pages():
    order, rng = PageOrder(f"o{i}" for i in range(10_000)), random.Random(0)
    began = time.perf_counter()
    for _ in range(100_000):
        order.edit("move", f"o{rng.randrange(10_000)}", f"o{rng.randrange(10_000)}", None)
    assert time.perf_counter() - began < 10 and len(set(order)) == 10_000


def test_states_at_cursors_are_states_of_cut_logs(spark):
    log = derive(spark, SF, "edit_log").where("doc_id % 7 = 0")
    manifest = log.select("doc_id", "pc").distinct()
    asked = (-5, 0, 1, 13, 13, 40, 10**6)
    at = editlog.state_at(manifest, log, manifest.select("doc_id", F.explode(F.array(*map(F.lit, asked))).alias("cursor")))
    for cursor in (13, 10**6):
        cut = editlog.whole_state(manifest, log.where(F.col("seq") < cursor))
        for part, df in cut.items():
            columns = sorted(df.columns)
            rows = lambda d: sorted((tuple(r) for r in d.select(*columns).collect()), key=repr)  # noqa: E731, B023
            want = rows(df.where(F.coalesce(*editlog.SETTINGS).isNotNull())) if part == "settings" else rows(df)
            got = at[part].where(F.col("cursor") == cursor)
            assert rows(got.where(F.coalesce(*editlog.SETTINGS).isNotNull()) if part == "settings" else got) == want, (cursor, part)
