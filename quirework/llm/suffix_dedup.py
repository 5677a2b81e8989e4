"""Exact removal of repeated byte strings with suffix arrays.

A 400-byte string is a window; every byte in a window that also starts elsewhere goes. Suffix arrays over all bytes
of a corpus would sort mostly text that occurs once. So windows are first cut into content-defined runs (see runs.py): equal windows
get equal values, wherever they stand, and whatever a value's runs have in common lies in the runs of that value. A value with a single run has
nothing to remove; the runs of all other values go to shards by value, of runs with equal bytes (by XXH3's 128 bits) the first and the last.

A shard concatenates the bytes of its runs, sorts their suffixes by Larsson-Sadakane refinement in numpy, takes common
prefixes by Kasai's scan, and finds the windows that stand in it twice. A value with more runs than a shard takes is split
over several; these are joined pair by pair with binary search of the one's windows in the other's array. What is found in the first of
several equal runs holds for all of them.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quirework.llm.common import batch, durable, join_few
from quirework.llm.runs import Rolling, covered, mixed, window_runs

WINDOW = 400
GRAM = 40
#: Bytes at which small cells make a shard, whose keys then fit a core's cache, and different runs of one value that go to one shard before the value is split.
SHARD_BYTES = 1 << 17
RUNS_A_SHARD = 1000
#: Bytes of documents that are hashed together.
TOGETHER = 1 << 18
#: The key of a row: 128 bits of its id and text, so that only rows which are equal in both share one.
ROW = ("row", "row2")
#: Text positions that Kasai's scan follows side by side.
LANES = 8192


def suffix_array(text: np.ndarray, depth: int) -> np.ndarray:
    """Positions of `text` (uint8) in the order of their suffixes, sorted by `depth` bytes at least; ties in any order.

    Larsson and Sadakane: suffixes start in groups by their first bytes; each round sorts the suffixes of groups with several members by
    the group of the suffix h further on, and h doubles. What is sorted is one integer of group, further group and position, which
    numpy sorts many times faster than it sorts indirectly. Beyond the end of the text there is less than any byte.
    """
    n = len(text)
    bits = max(1, n.bit_length())  # of a position, and of a group's number plus one
    if 3 * bits > 63:
        raise ValueError("a shard holds less than two million bytes")
    present = np.zeros(256, bool)
    present[text] = True
    code = (np.cumsum(present) * present)[text].astype(np.uint64)  # bytes as dense numbers from 1
    width = int(present.sum()).bit_length()
    h = (64 - bits) // width
    code = np.concatenate([code, np.zeros(h, np.uint64)])
    key = np.zeros(n, np.uint64)
    for k in range(h):
        key = (key << np.uint64(width)) | code[k : k + n]
    low = np.uint64((1 << bits) - 1)
    key = np.sort((key << np.uint64(bits)) | np.arange(n, dtype=np.uint64))
    order = (key & low).astype(np.int64)
    key >>= np.uint64(bits)
    group = np.zeros(n + depth * 2, np.uint64)  # a group's number is the place of its first suffix, plus one; 0 beyond the end
    slots = np.arange(n)
    while True:
        starts = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        sizes = np.diff(np.concatenate([starts, [len(slots)]]))
        group[order[slots]] = np.repeat(slots[starts] + 1, sizes).astype(np.uint64)
        slots = slots[np.repeat(sizes > 1, sizes)]
        if h >= depth or not len(slots):
            return order
        at = order[slots]
        key = np.sort((group[at] << np.uint64(2 * bits)) | (group[at + h] << np.uint64(bits)) | at.astype(np.uint64))
        order[slots] = (key & low).astype(np.int64)
        key >>= np.uint64(bits)
        h *= 2


def common_prefixes(text: np.ndarray, order: np.ndarray, most: int) -> np.ndarray:
    """Kasai: at each place of the suffix array the common prefix with the suffix before it, up to `most` bytes.

    The scan goes by text position and carries the length on, less one; it runs in lanes, each over its own stretch of the text.
    `order` need only be sorted by `most` bytes. Of two suffixes that tie there, the next ones may stand the other way round; the
    length then says nothing about the suffix before, and the comparison starts from the first byte.
    """
    n = len(text)
    place = np.empty(n, np.int64)
    place[order] = np.arange(n)
    before = np.full(n, -1, np.int64)
    before[order[1:]] = order[:-1]
    padded = np.concatenate([text, np.zeros(most + 16, np.uint8)])
    size = n + most + 8
    words = np.zeros(size, np.uint64)
    for k in range(8):
        words |= padded[k : k + size].astype(np.uint64) << np.uint64(8 * k)
    stretch = -(-n // LANES)
    out = np.zeros(n, np.int64)
    lanes = np.arange(0, n, stretch)
    length = np.zeros(len(lanes), np.int64)
    next_place = np.append(place, n)[before + 1]  # of the suffix after the one before; n beyond the end
    for step in range(stretch):
        live = np.flatnonzero(lanes + step < n)
        i = lanes[live] + step
        j = before[i]
        carried = (j >= 0) & (next_place[i - 1] < place[i])
        h = np.where(carried, np.maximum(length[live] - 1, 0), 0)
        room = np.where(j >= 0, np.minimum(most, n - np.maximum(i, j)), 0)
        going = np.flatnonzero(h < room)
        while len(going):
            differ = words[i[going] + h[going]] ^ words[j[going] + h[going]]
            low = differ & (~differ + np.uint64(1))
            same = np.where(differ == 0, 8, np.bitwise_count(low - np.uint64(1)) >> 3).astype(np.int64)
            h[going] += same
            going = going[(same == 8) & (h[going] < room[going])]
        h = np.minimum(h, room)
        length[live] = h
        out[place[i]] = h
    return out


class Shard:
    """Runs of windows and the suffix array over their bytes."""

    def __init__(self, texts: list[bytes], windows: list[int], window: int) -> None:
        self.window = window
        self.text = np.frombuffer(b"".join(texts), np.uint8)
        lengths = np.fromiter(map(len, texts), np.int64, len(texts))
        self.starts = np.cumsum(lengths) - lengths
        self.windows = np.asarray(windows, np.int64)
        self.valid = covered(len(self.text), self.starts, self.windows, 1)  # where a window starts
        self.order = suffix_array(self.text, window)

    def twice(self) -> np.ndarray:
        """Which positions start a window that starts at another position of the shard too."""
        same = common_prefixes(self.text, self.order, self.window) >= self.window
        group = np.cumsum(~same) - 1
        count = np.bincount(group, weights=self.valid[self.order])
        out = np.zeros(len(self.text), bool)
        out[self.order] = count[group] > 1
        return out & self.valid

    def strings(self, positions: np.ndarray) -> np.ndarray:
        view = np.lib.stride_tricks.sliding_window_view(self.text, self.window)
        return np.ascontiguousarray(view[positions]).view(f"S{self.window}").ravel()

    def found_in(self, other: Shard, block: int = 4096) -> np.ndarray:
        """Which of this shard's windows start in the other one, by binary search in its array."""
        slots = other.order[other.valid[other.order]]
        mine = np.flatnonzero(self.valid)
        out = np.zeros(len(self.text), bool)
        for k in range(0, len(mine) if len(slots) else 0, block):
            some = mine[k : k + block]
            want = self.strings(some)
            low, high = np.zeros(len(some), np.int64), np.full(len(some), len(slots))
            while (open_ := low < high).any():
                middle = (low + high) // 2
                less = open_ & (other.strings(slots[np.minimum(middle, len(slots) - 1)]) < want)
                low, high = np.where(less, middle + 1, low), np.where(open_ & ~less, middle, high)
            hit = low < len(slots)
            hit[hit] = other.strings(slots[low[hit]]) == want[hit]
            out[some] = hit
        return out

    def hits(self, marked: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(run, offset, windows) of the marked stretches of windows, cut at the ends of runs."""
        edge = np.diff(np.concatenate([[False], marked, [False]]).view(np.int8))
        edge[self.starts] |= marked[self.starts]  # a run's first window starts a stretch
        begin = np.flatnonzero(edge[:-1] == 1)
        total = np.cumsum(marked)
        k = np.searchsorted(self.starts, begin, "right") - 1
        n = np.diff(np.concatenate([total[begin] - 1, [total[-1] if len(total) else 0]]))
        return k, begin - self.starts[k], n


def holds_itself(grams: np.ndarray, value: np.ndarray, start: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Whether a run may hold one window twice.

    Two equal windows at a distance d of a run make their text periodic by d, so the run's least gram stands among its first d, before
    the place of the run's last window. Elsewhere it stands in all windows of the run, so not before that place.
    """
    first = np.cumsum(n) - n
    early = grams[np.arange(int(n.sum())) + np.repeat(start - first, n)] == np.repeat(value, n)
    early[first + n - 1] = False
    return np.logical_or.reduceat(early, first) if len(n) else np.zeros(0, bool)


NAMES = ("v", "c", "c2", "row", "row2", "start", "n", "periodic")


def all_runs(docs: DataFrame, window: int) -> DataFrame:
    """(v, c, c2, row, row2, start, n, periodic): value, digest of the bytes (128 bits), place and number of windows of every run."""

    def runs_of(rows: list, rows2: list, texts: list[bytes]) -> pa.RecordBatch:
        """Of several documents at once, as one sequence in which no window reaches over an end."""
        lengths = np.fromiter(map(len, texts), np.int64, len(texts))
        ends = np.cumsum(lengths)
        data = b"".join(texts)
        grams = Rolling(mixed(np.frombuffer(data, np.uint8).astype(np.uint64) + np.uint64(1))).grams(GRAM)
        value, start, n = window_runs(grams, window, GRAM, ends - lengths, ends)
        stop = start + n + window - 1
        doc = np.searchsorted(ends, start, "right")
        digest, view = xxhash.xxh3_128_digest, memoryview(data)
        content = np.frombuffer(b"".join([digest(view[x:y]) for x, y in zip(start.tolist(), stop.tolist(), strict=True)]), np.int64).reshape(-1, 2)
        periodic = holds_itself(grams, value, start, n)
        place = (start - (ends - lengths)[doc]).astype(np.int32)
        columns = value.view(np.int64), content[:, 0], content[:, 1], np.array(rows, np.int64)[doc], np.array(rows2, np.int64)[doc], place, n.astype(np.int32), periodic
        return batch(**dict(zip(NAMES, columns, strict=True)))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows, rows2, texts, held = [], [], [], 0
            for row, row2, text in zip(*(b.column(c).to_pylist() for c in ("row", "row2", "text")), strict=True):
                data = text.encode("utf-8", "surrogatepass")
                if len(data) >= window:
                    rows.append(row), rows2.append(row2), texts.append(data)
                    held += len(data)
                if held >= TOGETHER:
                    yield runs_of(rows, rows2, texts)
                    rows, rows2, texts, held = [], [], [], 0
            if texts:
                yield runs_of(rows, rows2, texts)

    return docs.mapInArrow(scan, "v long, c long, c2 long, row long, row2 long, start int, n int, periodic boolean")


def grouped(runs: DataFrame) -> DataFrame:
    """One row for each different run: (v, c, c2, times, periodic, first, last), the places being structs of row, row2, start, n."""
    place = F.struct("row", "row2", "start", "n")
    return runs.groupBy("v", "c", "c2").agg(F.count("*").alias("times"), F.max("periodic").alias("periodic"), F.min(place).alias("first"), F.max(place).alias("last"))


def compared(different: DataFrame) -> DataFrame:
    """(v, c, c2, times, shards, copy, row, row2, start, n): the runs that may share windows with others of their value or with themselves.

    A run that occurs several times comes twice, at its first place and, as copy, at its last; shards is what the value takes.
    """
    several = different.groupBy("v").agg(F.count("*").alias("k"), F.max("times").alias("most"), F.bool_or("periodic").alias("own")).where("k > 1 or most > 1 or own")
    met = different.join(several.select(F.col("v").alias("_v"), "k"), F.col("v") == F.col("_v"))
    places = F.when(F.col("times") > 1, F.array("first", "last")).otherwise(F.array("first"))
    rows = met.select("v", "c", "c2", "times", F.ceil(F.col("k") / RUNS_A_SHARD).cast("int").alias("shards"), F.posexplode(places).alias("at", "place"))
    return rows.select("v", "c", "c2", "times", "shards", (F.col("at") == 1).alias("copy"), "place.*")


KEYS = ("v", "c", "c2", "times", "copy", "row", "row2", "start", "n")
KEY_TYPES = "v long, c long, c2 long, times long, copy boolean, row long, row2 long, start int, n int"


def contexts(docs: DataFrame, runs: DataFrame, window: int) -> DataFrame:
    """(a, b, side, KEYS, data): the bytes of the runs, in each cell of shards (a, b) that they take part in; copies only in that of their own shard."""
    wanted = F.struct("v", "c", "c2", "times", "copy", "start", "n", "shards")
    few = durable(runs.groupBy("row", "row2").agg(F.collect_list(wanted).alias("wanted")))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lists = b.column("wanted")
            flat = lists.flatten()
            of = np.repeat(np.arange(len(b)), np.diff(lists.offsets.to_numpy()))
            run = {k: flat.field(k).to_numpy(zero_copy_only=False) for k in ("v", "c", "c2", "times", "copy", "start", "n", "shards")}
            run |= {k: b.column(k).to_numpy(zero_copy_only=False)[of] for k in ("row", "row2")}
            shards = run.pop("shards")
            side = (run["c"] % shards).astype(np.int32)
            data = [t.encode("utf-8", "surrogatepass") for t in b.column("text").to_pylist()]
            # a row for each cell (side, other) of the run's value, of which most have one
            k = np.repeat(np.arange(len(of)), shards)
            other = (np.arange(len(k)) - np.repeat(np.cumsum(shards) - shards, shards)).astype(np.int32)
            stay = ~run["copy"][k] | (other == side[k])
            k, other = k[stay], other[stay]
            stop = run["start"] + run["n"] + window - 1
            pieces = [data[d][x:y] for d, x, y in zip(of[k].tolist(), run["start"][k].tolist(), stop[k].tolist(), strict=True)]
            cells = {"a": np.minimum(side[k], other), "b": np.maximum(side[k], other), "side": side[k]}
            yield batch(**cells, **{name: run[name][k] for name in KEYS}, data=pa.array(pieces, pa.binary()))

    met = join_few(docs, few, "inner", ROW).select("row", "row2", "text", "wanted")
    return met.mapInArrow(cut, f"a int, b int, side int, {KEY_TYPES}, data binary")


def shard_hits(cells: DataFrame, window: int) -> DataFrame:
    """(v, c, c2, times, row, row2, start, at, n): stretches of windows, `at` windows behind the start of a run, that stand elsewhere too.

    Of a run that occurs several times the first place is given.
    """

    Rows = tuple[dict[str, np.ndarray], list[bytes]]  # columns, data

    def joined(parts: list[Rows]) -> Rows:
        return {k: np.concatenate([p[0][k] for p in parts]) for k in parts[0][0]}, [x for p in parts for x in p[1]]

    def found(rows: dict[str, np.ndarray], shard: Shard, marked: np.ndarray, wanted: np.ndarray) -> pa.RecordBatch:
        k, at, n = shard.hits(marked)
        stay = wanted[k]
        k, at, n = k[stay], at[stay], n[stay]
        names = ("v", "c", "c2", "times", "row", "row2", "start")
        return batch(**{name: rows[name][k] for name in names}, at=at.astype(np.int32), n=n.astype(np.int32))

    def one(rows: dict[str, np.ndarray], data: list[bytes]) -> Iterator[pa.RecordBatch]:
        shard = Shard(data, rows["n"], window)
        yield found(rows, shard, shard.twice(), ~rows["copy"])

    def two(rows: dict[str, np.ndarray], data: list[bytes], a: int, b: int) -> Iterator[pa.RecordBatch]:
        """Runs that occur several times have been found in their own shard; they are only what the others are looked up in."""
        sides = [np.flatnonzero(rows["side"] == s) for s in (a, b)]
        if all(map(len, sides)):
            halves = [{name: x[k] for name, x in rows.items()} for k in sides]
            left, right = (Shard([data[i] for i in k.tolist()], half["n"], window) for k, half in zip(sides, halves, strict=True))
            yield found(halves[0], left, left.found_in(right), halves[0]["times"] == 1)
            yield found(halves[1], right, right.found_in(left), halves[1]["times"] == 1)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        whole: list[Rows] = []  # cells of one shard each, finished
        size = 0
        cell: list[Rows] = []  # the cell that goes on
        key: tuple | None = None
        last: tuple | None = None

        def finish() -> Iterator[pa.RecordBatch]:
            nonlocal whole, size
            if not cell:
                return
            if key[1] != key[2]:
                yield from two(*joined(cell), key[1], key[2])
                return
            more = sum(len(x) for _, data in cell for x in data)
            if whole and size + more > 2 * SHARD_BYTES:
                yield from one(*joined(whole))
                whole, size = [], 0
            whole += cell
            size += more
            if size >= SHARD_BYTES:
                yield from one(*joined(whole))
                whole, size = [], 0

        for b in batches:
            rows = {name: b.column(name).to_numpy(zero_copy_only=False) for name in ("a", "b", "side", *KEYS)}
            data = b.column("data").to_pylist()
            places = list(zip(*(rows[name].tolist() for name in ("v", "a", "b", "c", "c2", "copy")), strict=True))
            # one row for each place: rows of documents that come several times with one id repeat theirs
            fresh = [i for i, place in enumerate(places) if place != (places[i - 1] if i else last)]
            last = places[-1] if places else last
            for cell_key, group in itertools.groupby(fresh, key=lambda i: places[i][:3]):  # noqa: B023
                if key != cell_key:
                    yield from finish()
                    cell, key = [], cell_key
                k = list(group)
                cell.append(({name: x[k] for name, x in rows.items()}, [data[i] for i in k]))
        yield from finish()
        if whole:
            yield from one(*joined(whole))

    ordered = cells.repartition("v", "a", "b").sortWithinPartitions("v", "a", "b", "c", "c2", "copy")
    return ordered.mapInArrow(scan, "v long, c long, c2 long, times long, row long, row2 long, start int, at int, n int")


def remove_repeated(docs: DataFrame, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, n_bytes, n_removed, n_spans (maximal removed stretches), kept (the bytes that stay, in order).

    A byte goes if a window over it also starts at another place of the input, in the same document or another one. Null text counts as
    empty. Repeated rows repeat each other; null ids are ids like others. Other columns are ignored; an empty table gives an empty result.
    """
    if window <= GRAM:
        raise ValueError(f"a window has more than {GRAM} bytes")
    text, doc_id = F.coalesce(docs[text_col], F.lit("")), docs[id_col].cast("long")
    keys = (F.xxhash64(F.lit(k), doc_id, text).alias(name) for k, name in enumerate(ROW))
    docs = docs.select(doc_id.alias("doc_id"), *keys, text.alias("text"))
    runs = durable(all_runs(docs, window))
    different = durable(grouped(runs))
    hits = durable(shard_hits(contexts(docs, compared(different), window), window))
    alone = hits.where("times = 1").select(*ROW, (F.col("start") + F.col("at")).alias("start"), "n")
    first = hits.where("times > 1").select("v", "c", "c2", "at", F.col("n").alias("found"))
    equal = runs.join(first, ["v", "c", "c2"]).select(*ROW, (F.col("start") + F.col("at")).alias("start"), F.col("found").alias("n"))
    spans = alone.unionByName(equal).groupBy(*ROW).agg(F.collect_list(F.struct("start", "n")).alias("spans"))
    changed = join_few(docs, durable(spans), on=ROW)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for text, found in zip(b.column("text").to_pylist(), b.column("spans").to_pylist(), strict=True):
                data = text.encode("utf-8", "surrogatepass")
                if found is None or len(found) == 0:
                    out.append((len(data), 0, 0, data))
                    continue
                gone = covered(len(data), np.array([r["start"] for r in found]), np.array([r["n"] for r in found]), window)
                kept = np.frombuffer(data, np.uint8)[~gone].tobytes()
                out.append((len(data), int(gone.sum()), int((np.diff(np.concatenate([[0], gone.view(np.int8)])) == 1).sum()), kept))
            n_bytes, n_removed, n_spans, left = zip(*out, strict=True) if out else ((), (), (), ())
            yield batch(doc_id=b.column("doc_id"), n_bytes=np.array(n_bytes, np.int64), n_removed=np.array(n_removed, np.int64), n_spans=np.array(n_spans, np.int64), kept=pa.array(left, pa.binary()))

    return changed.mapInArrow(cut, "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary")


def repeated_bytes_digest(docs: DataFrame) -> DataFrame:
    """remove_repeated() with the kept bytes as a hash."""
    return remove_repeated(docs).select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
