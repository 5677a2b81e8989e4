"""Source divergence against a plain count, on tables with odd rows."""

from __future__ import annotations

import collections
import random
import re

import pyarrow as pa

from quirework.llm import divergence

TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = {i: i + 32 for i in range(65, 91)}


def plain(rows, min_docs, top):
    rows = [tuple(x or "" for x in r) for r in rows]
    docs, langs, groups = collections.Counter(), collections.Counter(), collections.defaultdict(collections.Counter)
    for text, lang, source in rows:
        words = TERM.findall(text.translate(LOWER))
        groups[lang, source].update(words)
        docs.update((lang, w) for w in set(words))
        langs.update((lang, w) for w in words)
    out = []
    for (lang, source), own in groups.items():
        kept = [w for (x, w), n in docs.items() if x == lang and n >= min_docs]
        v, total = len(kept), sum(langs[lang, w] for w in kept)
        share = lambda n, size: 1 + 1_000_000_000 * (n + 5) // (size + 5 * v)  # noqa: E731, B023
        size = lambda g: sum(g[w] for w in kept)  # noqa: E731, B023
        pairs = []
        for (x, other), theirs in groups.items():
            if x == lang and other != source:
                pairs.append((-sum(abs(share(own[w], size(own)) - share(theirs[w], size(theirs))) for w in kept), other.encode(), other))
        terms = [(share(langs[lang, w], total) - share(own[w], size(own)), w.encode(), w) for w in kept if own[w]]
        for part, found, most in (("pair", pairs, None), ("term", [t for t in terms if t[0] < 0], top)):
            out += [(lang, source, part, item, -value, k + 1) for k, (value, _, item) in enumerate(sorted(found)[:most])]
    return sorted(out)


def test_against_a_plain_count(spark):
    rng = random.Random(3)
    words = ["Alpha", "beta", "été", "日本", "日", "z", "Ω", "x1y", "don't"] + [f"w{'abcdefgh'[k % 8]}{'klmnop'[k // 8]}" for k in range(40)]
    rows = [(" ".join(rng.choices(words, k=rng.randrange(30))), rng.choice(["en", "de", None, ""]), rng.choice(["s1", "s2", "é", None, "S1"])) for _ in range(240)]
    rows += [(None, "en", "only null"), ("", "fr", "s1"), ("beta", "fr", "s2"), ("1 2 3", "xx", "alone"), ("beta " * 500, "en", "s1")] + [("beta Alpha", "en", "s1")] * 3
    df = spark.createDataFrame([(i, t, g, s, 9, "n", "v") for i, (t, g, s) in enumerate(rows)], "doc_id long, text string, lang string, source string, n int, term string, value string")
    for min_docs, top in ((5, 50), (12, 3), (1, 7), (10**6, 50)):
        got = sorted(tuple(r) for r in divergence.source_divergence(df, min_docs, top).collect())
        assert got == plain(rows, min_docs, top)
    assert divergence.source_divergence(df.limit(0)).collect() == []


def test_slices_of_batches():
    """Pieces of a batch are counted like the whole."""
    rows = [(f"Word{'abc'[k % 3]} AND more {'text ' * (k % 7)}", "en", f"s{k % 2}") for k in range(300)]
    b = pa.RecordBatch.from_pylist([{"text": t, "lang": g, "source": s} for t, g, s in rows])
    count = lambda parts: sum((collections.Counter({(r["source"], r["term"]): r["n"] for r in divergence._count(p).to_pylist()}) for p in parts), collections.Counter())
    assert count([b]) == count([b.slice(k, 70) for k in range(0, 300, 70)]) and count([b])["s0", "and"] == 150


def test_many_sources(spark):
    """More sources than one task sums at once."""
    rows = [(" ".join(f"t{chr(97 + (k * j) % 26)}" for j in range(1, 9)), "en", f"s{k % 150:03d}") for k in range(450)]
    df = spark.createDataFrame(rows, "text string, lang string, source string")
    got = sorted(tuple(r) for r in divergence.source_divergence(df, 30, 50).collect())
    assert got == plain(rows, 30, 50)
