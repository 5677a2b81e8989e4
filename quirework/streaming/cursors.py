"""Undo, redo and append commands of one document, composed to a summary that can be applied to any earlier state.

A state is (cursor, undone): undo moves one from the cursor to undone if there is one, redo moves one back, append adds one to the cursor and
forgets what was undone. What stands before the first append of a stretch is kept as runs of undo and redo; a run that is no longer than both its
neighbours leaves no trace, so what is left rises and then falls, and has some sqrt(n) runs. From the first append on nothing is undone,
so the rest depends on the cursor only: it is a list of pieces on which the cursor and the undone are constant or grow with the cursor before.
"""

from __future__ import annotations

import bisect
from collections.abc import Iterable


def add_run(runs: list[int], k: int) -> None:
    """k redo, or -k undo, behind the runs."""
    if runs and (runs[-1] > 0) == (k > 0):
        runs[-1] += k
    else:
        runs.append(k)
    while len(runs) > 2 and abs(runs[-2]) <= min(abs(runs[-3]), abs(runs[-1])):
        runs[-3:] = [sum(runs[-3:])]


def run_on(state: tuple[int, int], k: int) -> tuple[int, int]:
    """A state after k redo, or -k undo."""
    cursor, undone = state
    k = min(k, undone) if k > 0 else -min(-k, cursor)
    return cursor + k, undone - k


Piece = tuple[int, int, int, int, int]


def run_on_pieces(pieces: list[Piece], k: int) -> list[Piece]:
    """Pieces (from, cursor, its growth, undone, its growth) after k redo, or -k undo. What the run takes from is cut where it is used up."""
    out: list[Piece] = []
    for i, (x, c, dc, u, du) in enumerate(pieces):
        end = pieces[i + 1][0] if i + 1 < len(pieces) else None
        have, grows = (u, du) if k > 0 else (c, dc)
        size, sign = abs(k), 1 if k > 0 else -1
        cut = x if have >= size else x + size - have if grows else end
        if cut != x:  # all of it is taken
            out.append((x, c + sign * have, dc + sign * grows, u - sign * have, du - sign * grows))
        if cut is not None and (end is None or cut < end):
            at = cut - x
            out.append((cut, c + dc * at + k, dc, u + du * at - k, du))
    return merged(out)


def merged(pieces: Iterable[Piece]) -> list[Piece]:
    """Pieces without those that go on as the one before."""
    out: list[Piece] = []
    for p in pieces:
        if out:
            x, c, dc, u, du = out[-1]
            at = p[0] - x
            if (c + dc * at, dc, u + du * at, du) == p[1:]:
                continue
        out.append(p)
    return out


class Commands:
    """The summary of some commands in order. pieces are None before the first append."""

    def __init__(self) -> None:
        self.runs: list[int] = []
        self.pieces: list[Piece] | None = None
        self._rest: list[int] = []

    def add(self, command: str) -> None:
        if command == "append":
            self._settle()
            if self.pieces is None:
                self.pieces = [(0, 0, 1, 0, 0)]
            self.pieces = merged((x, c + 1, dc, 0, 0) for x, c, dc, _, _ in self.pieces)
        else:
            add_run(self.runs if self.pieces is None else self._rest, -1 if command == "undo" else 1)

    def _settle(self) -> None:
        for k in self._rest:
            self.pieces = run_on_pieces(self.pieces, k)
        self._rest = []

    def parts(self) -> tuple[list[int], list[list[int]] | None]:
        """(runs, pieces) as plain lists."""
        self._settle()
        return self.runs, None if self.pieces is None else [list(p) for p in self.pieces]


def after(state: tuple[int, int], runs: Iterable[int], pieces: list | None) -> tuple[int, int]:
    """A state after the commands of a summary."""
    for k in runs:
        state = run_on(state, k)
    if pieces is None:
        return state
    x, c, dc, u, du = pieces[bisect.bisect_right([p[0] for p in pieces], state[0]) - 1]
    return c + dc * (state[0] - x), u + du * (state[0] - x)
