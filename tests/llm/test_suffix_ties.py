"""Suffix arrays that stop at a depth, over passages longer than that depth."""

from __future__ import annotations

import collections

import numpy as np
import pytest

from quirework.llm import suffix_dedup


def passages(rng, n, length, letters):
    """n texts; every third holds one passage of `length` letters, each time with other letters around."""
    alphabet = np.array(list("abcdefghijklmnopqrst")[:letters])
    passage = "".join(rng.choice(alphabet, length))
    return ["".join(rng.choice(alphabet, 30)) + (passage if k % 3 == 0 else "") + "".join(rng.choice(alphabet, 30)) for k in range(n)]


@pytest.mark.parametrize("depth", [20, 64])
def test_prefixes_behind_ties(depth, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "LANES", 8)  # so that lengths are carried on in a short text
    rng = np.random.default_rng(9)
    for length in range(depth, 4 * depth, 3):
        data = "".join(passages(rng, 30, length, 4)).encode()
        order = suffix_dedup.suffix_array(np.frombuffer(data, np.uint8), depth)
        prefixes = suffix_dedup.common_prefixes(np.frombuffer(data, np.uint8), order, depth)
        for k in range(1, len(data)):
            x, y = data[order[k - 1] :][:depth], data[order[k] :][:depth]
            assert prefixes[k] == next((i for i, (p, q) in enumerate(zip(x, y, strict=False)) if p != q), min(len(x), len(y)))


def test_no_unique_window_counts_as_repeated(monkeypatch):
    monkeypatch.setattr(suffix_dedup, "LANES", 8)
    rng = np.random.default_rng(10)
    for _ in range(20):
        texts = [t.encode() for length in (449, 577, 769) for t in passages(rng, 9, length, 3)]
        texts = [t + rng.choice(list(b"abc"), 400).astype(np.uint8).tobytes() for t in texts]
        shard = suffix_dedup.Shard(texts, [len(t) - 399 for t in texts], 400)
        windows = [t[k : k + 400] for t in texts for k in range(len(t) - 399)]
        count = collections.Counter(windows)
        assert shard.twice()[shard.valid].tolist() == [count[w] > 1 for w in windows]
