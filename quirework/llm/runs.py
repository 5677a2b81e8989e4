"""Content-defined runs of windows, shared by the two operators on repeated passages.

A sequence of n symbols has n - w + 1 windows of w symbols. Each takes as its value the least hash of the k-grams inside it, and
consecutive windows with one value form a run, cut at w - k + 1 windows. Value and cut depend on nothing but
content, so two equal windows, wherever they stand, have one value; and long equal passages have equal runs.
"""

from __future__ import annotations

import numpy as np

BASE = 0x9E3779B97F4A7C15
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def powers(n: int, base: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i modulo 2**64 for i under n, kept for the next call."""
    got = _powers.get(base)
    if got is None or len(got[0]) < n:
        size = 1 << max(16, n.bit_length())
        up, down = np.ones(size, np.uint64), np.ones(size, np.uint64)
        up[1:] = np.cumprod(np.full(size - 1, base, np.uint64), dtype=np.uint64)
        down[1:] = np.cumprod(np.full(size - 1, pow(base, -1, 1 << 64), np.uint64), dtype=np.uint64)
        got = _powers[base] = up, down
    return got[0][:n], got[1][:n]


def mixed(x: np.ndarray) -> np.ndarray:
    """Spreads 64-bit values; a bijection."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Rolling:
    """Hashes of any stretches of one symbol sequence, by prefix sums of a polynomial modulo 2**64."""

    def __init__(self, symbols: np.ndarray, base: int = BASE) -> None:
        up, self.down = powers(len(symbols) + 1, base)
        self.sums = np.zeros(len(symbols) + 1, np.uint64)
        np.cumsum(symbols * up[:-1], out=self.sums[1:])

    def hashes(self, starts: np.ndarray, stops: np.ndarray) -> np.ndarray:
        return mixed((self.sums[stops] - self.sums[starts]) * self.down[starts])

    def grams(self, length: int) -> np.ndarray:
        """Hashes of all stretches of one length."""
        return mixed((self.sums[length:] - self.sums[:-length]) * self.down[: len(self.sums) - length])


def sliding_least(x: np.ndarray, width: int) -> np.ndarray:
    """The least of each `width` consecutive values."""
    n = len(x)
    pad = -n % width
    full = np.concatenate([x, np.full(pad, np.iinfo(x.dtype).max, x.dtype)]).reshape(-1, width)
    ahead = np.minimum.accumulate(full, axis=1).ravel()
    behind = np.minimum.accumulate(full[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[: n - width + 1], ahead[width - 1 : n])


def window_runs(grams: np.ndarray, window: int, gram: int, begins: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(value, first window, windows) of each run of sequences that stand one behind the other, from begins to ends.

    grams are the hashes of all stretches of `gram` symbols of the whole. Windows over an end are in no run, and no run goes over one.
    """
    width = window - gram + 1
    least = sliding_least(grams, width)
    m = len(least)
    inside = covered(m, begins, ends - begins - window + 1, 1)
    breaks = np.concatenate([[True], (least[1:] != least[:-1]) | (inside[1:] != inside[:-1])])
    breaks[begins[begins < m]] = True
    starts = np.flatnonzero(breaks)
    lengths = np.diff(np.concatenate([starts, [m]]))
    starts, lengths = starts[inside[starts]], lengths[inside[starts]]
    pieces = -(-lengths // width)
    if len(pieces) and pieces.max() > 1:  # equal values for longer than a window: periodic text
        piece = np.arange(pieces.sum()) - np.repeat(np.cumsum(pieces) - pieces, pieces)
        starts, rest = np.repeat(starts, pieces) + piece * width, np.repeat(lengths, pieces) - piece * width
        lengths = np.minimum(rest, width)
    return least[starts], starts, lengths


def covered(n: int, starts: np.ndarray, windows: np.ndarray, window: int) -> np.ndarray:
    """Which of n symbols are covered by runs of `windows` windows from `starts`."""
    edge = np.zeros(n + 1, np.int32)
    np.add.at(edge, starts, 1)
    np.add.at(edge, np.minimum(starts + windows + window - 1, n), -1)
    return np.cumsum(edge[:-1]) > 0
