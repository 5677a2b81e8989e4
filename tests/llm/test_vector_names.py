"""Top-k search where the table has columns named like the operator's own."""

from __future__ import annotations

import random

from quirework.llm import vector_search


def test_clashing_names_change_nothing(spark):
    rng = random.Random(1)
    rows = [(k, [rng.choice((-0.5, 0.25, 0.5, 1.0)) for _ in range(8)]) for k in range(60)]
    plain = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    names = ("v", "score", "rank", "query_id", "above", "below", "place", "dim", "ids", "cells", "q", "n", "reached", "least")
    more = spark.createDataFrame([(*r, *(k for k in range(len(names)))) for r in rows], "vec_id long, embedding array<float>, " + ", ".join(f"`{n}` int" for n in names))
    want = sorted(tuple(r) for r in vector_search.top_k(plain, plain.where("vec_id % 20 = 0"), 4).collect())
    assert len(want) == 12 and sorted(tuple(r) for r in vector_search.top_k(more, more.where("vec_id % 20 = 0"), 4).collect()) == want
    scores = {(a, b): sum(int(1024 * x) * int(1024 * y) for x, y in zip(dict(rows)[a], dict(rows)[b], strict=True)) for a in (0, 20, 40) for b in range(60) if a != b}
    assert want == sorted((a, k + 1, b, s) for a in (0, 20, 40) for k, (s, b) in enumerate(sorted(((s, b) for (q, b), s in scores.items() if q == a), key=lambda x: (-x[0], x[1]))[:4]))
