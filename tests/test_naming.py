"""Names of large roots against naming file by file."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from quirework.operators import naming


def plain(stems):
    taken, out = set(), []
    for s in stems:
        name, n = f"{s}.pdf", 2
        while name.lower() in taken:
            name, n = f"{s} ({n}).pdf", n + 1
        taken.add(name.lower())
        out.append(name)
    return out


def files(spark, batches):
    rows = [(b, 3 * k, f"{s}.docx") for b, stems in enumerate(batches) for k, s in enumerate(stems)]
    return spark.createDataFrame(rows, "batch_id long, pos long, file_name string").repartition(3)


@pytest.mark.parametrize("block", [1 << 16, 4])
def test_many_tasks_give_the_names_of_one(spark, monkeypatch, block):
    monkeypatch.setattr(naming, "BLOCK", block)
    rng = random.Random(block)
    tails = ["", "", " (2)", " (3)", " (4)", " (5)", " (7)", " (2) (2)", " (3) (2)", " (2) (3)", " (2) (2) (2)", " (02)", " (1)", " (0)", " (99999999999999999999)"]
    batches = [[rng.choice(["a", "A", "b"]) + rng.choice(tails[: rng.randrange(2, len(tails) + 1)]) for _ in range(rng.randrange(60))] for _ in range(40)]
    batches += [["x"] * 30, ["x (2)"] * 5 + ["x"] * 5, ["x"] * 5 + ["x (2)", "x (9)", "x (6)"] + ["x"] * 6, ["y (3)", "y (2)", "y", "y", "y (2)", "y"]]
    got: dict = {}
    for r in naming.unique_output_names(files(spark, batches), large=0).orderBy("batch_id", "pos").collect():
        got.setdefault(r.batch_id, []).append(r.out_name)
    for b, stems in enumerate(batches):
        assert got.get(b, []) == plain(stems), stems


def test_a_batch_of_files_named_alike(spark):
    """One root in many tasks, a small one beside it."""
    n = 300_000
    df = spark.range(n).selectExpr("1L as batch_id", "id as pos", f"case when id = {n - 1} then 'scan (4).png' when id = 0 then 'scan (3).png' when id = 7 then 'other.png' else 'Scan.png' end as file_name")
    got = naming.unique_output_names(df)
    assert got.select(F.lower("out_name")).distinct().count() == n
    names = {r.pos: r.out_name for r in got.where(f"pos in (0, 1, 2, 3, 7, 8, {n - 2}, {n - 1})").collect()}
    assert names == {0: "scan (3).pdf", 1: "Scan.pdf", 2: "Scan (2).pdf", 3: "Scan (4).pdf", 7: "other.pdf", 8: "Scan (8).pdf", n - 2: f"Scan ({n - 2}).pdf", n - 1: "scan (4) (2).pdf"}
