"""The grouped prefix join against all pairs, with small parts so that large components and frequent shingles are split."""

from __future__ import annotations

import random
import re

import pytest

from quirework.llm import jaccard_join as jac

LOWER = {i: i + 32 for i in range(65, 91)}


def shingles(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    return {tuple(words[k : k + 3]) for k in range(max(1, len(words) - 2))} if words else set()


def plain(rows):
    sets = [shingles(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for i, a in enumerate(sets):
        for j in range(i):
            if a and sets[j] and 100 * len(a & sets[j]) >= 90 * len(a | sets[j]):
                root[find(i)] = find(j)
    least: dict[int, int] = {}
    for k, (d, _) in enumerate(rows):
        if d is not None:
            least[find(k)] = min(d, least.get(find(k), d))
    return sorted(((d, len(s), (least.get(find(k)) if s else d)) for k, ((d, _), s) in enumerate(zip(rows, sets, strict=True))), key=repr)


def texts(rng):
    base = [" ".join(f"w{rng.randrange(300)}" for _ in range(n)) for n in (10, 11, 20, 45, 60, 120, 200)]
    line = " ".join(f"common{k}" for k in range(40))
    rows = []
    for b in base:
        for _ in range(25):
            words = b.split()
            for _ in range(rng.randrange(max(1, len(words) // 40) + 1)):
                k = rng.randrange(len(words))
                words[k : k + 1] = rng.choice([[], [f"n{rng.randrange(50)}"], [words[k], "extra"]])
            rows.append("  ".join(words).upper() if rng.random() < 0.3 else " ".join(words))
    rows += [f"{line} {b[:40]}" for b in base] + [line, line + " x", f"y {line}"] * 3
    rows += [None, "", " \n\t", "one", "One", "one two", "ONE  two", "two one", "a b c", "a b c a b c", "é É é", "x" * 100, "x" * 100, "x" * 101]
    rows += [" ".join(f"q{k}" for k in range(9)), " ".join(f"q{k}" for k in range(10)), " ".join(f"long{k}" for k in range(9000))]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("small", [False, True])
def test_against_all_pairs(spark, monkeypatch, small):
    if small:
        monkeypatch.setattr(jac, "PART_SETS", 4)
        monkeypatch.setattr(jac, "BUCKET", 3)
    rows = list(enumerate(texts(random.Random(7))))
    rows += [(3, "a b c d e f g h i j k"), (3, rows[10][1]), rows[5], rows[5], (None, rows[20][1]), (None, "all alone here"), (None, None)]
    df = spark.createDataFrame([(d, t, 1, 2, 3) for d, t in rows], "doc_id long, text string, no int, root int, n int")
    got = sorted((tuple(r) for r in jac.similar_documents(df.repartition(5)).collect()), key=repr)
    assert got == plain(rows)


def test_no_documents(spark):
    assert jac.similar_documents(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_a_chain_that_one_hub_does_not_join(spark, monkeypatch):
    """Neighbours are linked, others not, and parts are smaller than the chain."""
    monkeypatch.setattr(jac, "PART_SETS", 5)
    words = [f"c{k}" for k in range(160)]
    rows = [(k, " ".join(words[2 * k : 2 * k + 100])) for k in range(30)]
    got = {r.doc_id: r.component_id for r in jac.similar_documents(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {d: c for d, _, c in plain(rows)} and set(got.values()) == {0}


def test_words_with_equal_polynomials_are_told_apart(spark):
    """Words whose letters follow the Thue-Morse sequence and its opposite, on which polynomials modulo powers of two agree."""
    bits = [bin(k).count("1") % 2 for k in range(4096)]
    one, two = "".join("ab"[b] for b in bits), "".join("ba"[b] for b in bits)
    rows = [(1, one), (2, two), (3, one), (4, f"{one} x y"), (5, f"{two} x y")]
    got = {r.doc_id: r.component_id for r in jac.similar_documents(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: 1, 2: 2, 3: 1, 4: 4, 5: 5}
