"""Proximity matches, very long items and items without an id."""

from __future__ import annotations

import collections

import numpy as np

from quirework.llm import decontaminate

from .test_operators import odd, plain_contamination


def plain_proximity(docs, items, window, slack, share):
    """By the docstring: document frequencies of words, the two rarest of each window, and the words near their places."""
    texts = {i: t.split() for i, t in docs}
    df = collections.Counter(w for t in texts.values() for w in t)
    out = set()
    for item, text in items:
        words = text.split()
        w = min(window, len(words))
        for start in range(len(words) - w + 1):
            ranked = sorted(range(start, start + w), key=lambda at: (df[words[at]], at))
            if not df[words[ranked[0]]]:
                continue
            one, two = ranked[0], ranked[min(1, w - 1)]
            for i, t in texts.items():
                at = lambda k, t=t: [p for p, x in enumerate(t) if x == words[k]]
                for p in at(one):
                    if any(abs((q - two) - (p - one)) <= slack for q in at(two)):
                        found = sum(any(abs(q - (p - one + k)) <= slack for q in at(k)) for k in range(start, start + w))
                        if found >= w * share:
                            out.add((i, item, start, p, found, w))
    return out


def test_proximity(spark):
    rng = np.random.default_rng(3)
    items = [(k, " ".join(f"w{x}" for x in rng.integers(0, 60, int(n)))) for k, n in enumerate((25, 14, 4, 1, 12))]
    docs = []
    for i in range(40):
        words = [f"w{x}" for x in rng.integers(0, 200, 30)]
        if i % 2:  # a passage with words changed, put in or left out
            passage = items[i % 5][1].split()
            for _ in range(i % 4):
                k = int(rng.integers(0, len(passage)))
                passage[k : k + int(rng.integers(0, 2))] = [f"x{i}"] * int(rng.integers(0, 2))
            words[10:10] = passage
        docs.append((i, " ".join(words)))
    d = spark.createDataFrame(docs, "doc_id long, text string")
    b = spark.createDataFrame(items, "item_id long, text string")
    got = {(r.doc_id, r.item_id, r.start, r.pos, r.found, r.w) for r in decontaminate.near_contamination(d, b).collect()}
    assert got == plain_proximity(docs, items, 10, 3, 0.8) and len({g[0] for g in got}) > 10
    exact = {r[0] for r in plain_contamination(docs, items) if r[-1]}
    assert exact < {g[0] for g in got}
    assert decontaminate.near_contamination(d.where("false"), b).count() == decontaminate.near_contamination(d, b.where("false")).count() == 0


def test_long_item_and_items_without_id(spark):
    rng = np.random.default_rng(4)
    words = [f"w{x}" for x in rng.integers(0, 3000, 20_000)]
    items = [(1, " ".join(words)), (None, "alpha beta"), (None, "gamma"), (2, " ".join(["same"] * 5000))]
    docs = [(1, " ".join(words)), (2, " ".join([*words[500:509], "x", *words[700:715]])), (3, "alpha beta gamma"), (4, " ".join(["same"] * 30)), (5, "")]
    d = odd(spark, [t for _, t in docs], [i for i, _ in docs])
    b = spark.createDataFrame(items, "item_id long, text string")
    got = {r.doc_id: r for r in decontaminate.decontaminate(d, b).collect()}
    assert [got[i].n_hit for i in (1, 2, 3, 4, 5)] == [20_000, 15, 3, 30, 0]
    assert [got[i].n_items for i in (1, 2, 3, 4, 5)] == [1, 1, 1, 1, 0]
    assert [got[i].n_words for i in (1, 2, 3, 4, 5)] == [20_000, 25, 3, 30, 0]
