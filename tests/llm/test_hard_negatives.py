"""Hard negatives against a plain search, and packed products against plain ones."""

from __future__ import annotations

import math
import random

import numpy as np
import pytest

from quirework.llm import hard_negatives as hard


@pytest.mark.parametrize(("low", "high", "dim"), [(-160, 160, 64), (-5, 0, 3), (0, 9, 1), (-(10**6), 10**6, 64), (-(2**29), 2**29, 5), (0, 1, 7), (5, 9, 4), (-3, -2, 2)])
def test_packed_products(low, high, dim):
    rng = np.random.default_rng(1)
    a, b = rng.integers(low, high + 1, (7, dim)), rng.integers(low, high + 1, (33, dim))
    assert (hard.packed_products(a, b) == a.astype(object) @ b.astype(object).T).all()


def test_scores_beyond_62_bits_are_an_error():
    x = np.full((1, 1), 2**40)
    with pytest.raises(OverflowError):
        hard.packed_products(x, x)


def plain(rows, every):
    use = []
    for i, label, v in rows:
        if i is None or label is None or v is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        use.append((i, (label + 1) % 10 if i % 7 == 0 else label, [math.floor(256 * float(np.float32(x))) for x in v]))
    out, anchors = [], {}
    for i, label, v in use:
        if i % every == 0:
            anchors[i] = min(anchors.get(i, (label, v)), (label, v))
    for a, (label, v) in anchors.items():
        scored = sorted((-sum(x * y for x, y in zip(v, w, strict=True)), i, own) for i, own, w in use if i != a and len(w) == len(v))
        for p, i, _ in [s for s in scored if s[2] == label][:5]:
            found = [(n, j) for n, j, own in scored if own != label and 30 * -p <= 100 * -n <= 90 * -p]
            out += [(a, i, k + 1, j, -p, -n) for k, (n, j) in enumerate(found[:10])]
    return sorted(out)


def test_against_a_plain_search(spark):
    rng = random.Random(5)
    grid = [x / 16 for x in range(-12, 25)]
    rows = [(k, rng.randrange(4), [rng.choice(grid) for _ in range(6)]) for k in range(400)]
    rows += [(k, 1, [0.5] * 6) for k in range(400, 430)] + [(500, 2, [-1.0] * 6), (600, None, [1.0] * 6), (700, 3, None), (800, 3, [1.0, None, 1.0, 1.0, 1.0, 1.0])]
    rows += [(900, 3, [float("nan")] * 6), (901, 3, [float("inf")] * 6), (1000, 1, [0.25, 0.5]), (1001, 1, [0.5, 0.5]), (1002, 2, [0.25, 0.25]), (None, 1, [1.0] * 6), (1100, 1, [])]
    rows += rows[100:103]  # an anchor, and others, twice
    df = spark.createDataFrame([(*r, 1.0, 2) for r in rows], "vec_id long, label int, embedding array<float>, score double, slot int")
    got = sorted(tuple(r) for r in hard.mine_negatives(df, every=20).collect())
    assert got == plain(rows, 20) and len({r[0] for r in got}) > 10
    assert hard.mine_negatives(df.limit(0)).collect() == []
    assert hard.mine_negatives(df.where("vec_id % 20 <> 0"), every=20).collect() == []
