"""Long chains and cycles in object graphs and outlines: few rounds, whole results."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from quirework.operators import structure


@pytest.fixture
def rounds(monkeypatch):
    """Counts the tables that a search writes, one a round."""
    seen: list[int] = []
    write = structure.durable
    monkeypatch.setattr(structure, "durable", lambda df: (seen.append(1), write(df))[1])
    return seen


def plain(edges, roots, barriers):
    out: dict = {}
    for a, b in edges:
        out.setdefault(a, []).append(b)
    met, todo = set(), [r for r in roots if r not in barriers]
    while todo:
        n = todo.pop()
        if n not in met:
            met.add(n)
            todo += [m for m in out.get(n, []) if m not in barriers]
    return met


def test_a_chain_of_ten_thousand(spark, rounds):
    links = spark.range(10_000).selectExpr("id as src", "id + 1 as dst").unionByName(spark.range(10_000).selectExpr("id as src", "-id - 1 as dst"))  # each with a leaf
    nodes = spark.range(1).selectExpr("id as node")
    assert structure.reachable_objects(links, nodes, nodes.where("false")).count() == 20_001
    assert len(rounds) <= 20


def test_long_lists_of_siblings(spark, rounds):
    n = 4_000
    links = spark.range(n).selectExpr("id as node", f"case when id % 100 = 7 then {n} + id end as first_child", f"case when id < {n} - 1 then id + 1 end as next_node")
    kids = spark.range(n, 2 * n).selectExpr("id as node", "cast(null as long) as first_child", "cast(null as long) as next_node")
    items = links.unionByName(kids).select("node", F.concat(F.lit("d"), "node").alias("dest"), F.lit("none").alias("action_dest"))
    resolved = items.selectExpr("dest", "'p' || node as page")
    live = spark.range(0, 2 * n, 2).selectExpr("'p' || id as page")
    got = {r.node for r in structure.live_bookmarks(items, links, spark.range(1).selectExpr("id as node"), resolved, live).collect()}
    assert got == {x for x in range(n) if x % 2 == 0} | {n + x for x in range(7, n, 100) if (n + x) % 2 == 0}
    assert len(rounds) <= 20


@pytest.mark.parametrize("seed", [1, 2])
def test_odd_graphs(spark, seed):
    rng = random.Random(seed)
    edges = [(k, k + 1) for k in range(300)] + [(300, 5), (40, 40)] + [(500 + k, 500 + (k + 1) % 70) for k in range(70)]  # a chain back into itself, a loop, a cycle apart
    edges += [(rng.randrange(300), 1000 + rng.randrange(200)) for _ in range(150)] + [(1000 + rng.randrange(200), 1000 + rng.randrange(200)) for _ in range(150)]
    edges += [(250, 530)] if seed == 2 else []
    for roots, barriers in (([0], []), ([0, 510], [120]), ([7, 7], [7]), ([], [])):
        e, r, b = (spark.createDataFrame(rows, schema) for rows, schema in ((edges, "src long, dst long"), ([(x,) for x in roots], "node long"), ([(x,) for x in barriers], "node long")))
        got = [x.node for x in structure.reachable_objects(e, r, b).collect()]
        assert len(got) == len(set(got)) and set(got) == plain(edges, roots, barriers)
