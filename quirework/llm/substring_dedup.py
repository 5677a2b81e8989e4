"""Substring dedup by difference-cover anchors.

Residues D modulo v form a difference cover: for any two positions i and j there is a shift under v that brings both onto
residues in D. Hashing the stretches of 50 - v + 1 words at cover positions only, a fifth of all, is therefore enough: any two equal
windows of 50 words share an anchor that is aligned in both. Anchors met in two documents
extend to all windows that hold them; these are compared by hashes of 128 bits (two independent ones of each word, in two polynomials), and a
window stays with the smallest doc_id. Tasks find partners among the rows they hold before they send any, so hot hashes stay small.
Exact copies of whole documents are found first, so that none of their words is hashed again.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quirework.llm.common import WORD, batch, durable, join_few
from quirework.llm.runs import Rolling, covered

WINDOW = 50
#: The period and its perfect difference set: each residue but 0 is the difference of exactly one pair.
PERIOD = 31
COVER = (1, 5, 11, 24, 25, 27)
#: Rows that a task holds to find partners among them before it sends them on, and parts of a group of exact copies.
HELD_ROWS = 400_000
SALTS = 16
#: The key of a row: its id and 64 bits of its text, which only have to tell rows of one id apart.
ROW = ("doc_id", "row")
#: Words whose hashes a task keeps.
CACHED_WORDS = 200_000
SECOND_BASE = 0xD6E8FEB86659FD93
WORDS = re.compile(WORD)
IS_COVER = np.isin(np.arange(PERIOD), COVER)


class Digests(dict):
    """16 bytes for each word, kept until there are too many."""

    def __missing__(self, word: str) -> bytes:
        if len(self) > CACHED_WORDS:
            self.clear()
        digest = self[word] = xxhash.xxh3_128_digest(word.encode("utf-8", "surrogatepass"))
        return digest


def word_hashes(words: list[str], seen: Digests) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit hashes of each word."""
    pairs = np.frombuffer(b"".join([seen[w] for w in words]), np.uint64).reshape(-1, 2)
    return pairs[:, 0], pairs[:, 1]


def place(positions: np.ndarray, again: np.ndarray) -> np.ndarray:
    """A position, and above it a bit that says whether the hash recurs in the document."""
    return (again.astype(np.int64) << np.int64(31)) | positions.astype(np.int64)


def once_each(h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(index of the first of each hash, whether it recurs): a document sends each hash once, however often it repeats it."""
    in_order = np.sort(h)
    if not (in_order[1:] == in_order[:-1]).any():
        return np.arange(len(h)), np.zeros(len(h), bool)
    _, first, count = np.unique(h, return_index=True, return_counts=True)
    order = np.argsort(first)
    return first[order], count[order] > 1


def cover_positions(n: int, length: int) -> np.ndarray:
    """Positions under n - length + 1 whose residue is in the cover."""
    at = np.arange(n - length + 1)
    return at[IS_COVER[at % PERIOD]]


def groups(*keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(start, size) of the groups of equal keys in sorted rows."""
    new = np.zeros(len(keys[0]), bool)
    new[:1] = True
    for k in keys:
        new[1:] |= k[1:] != k[:-1]
    starts = np.flatnonzero(new)
    return starts, np.diff(np.concatenate([starts, [len(new)]]))


Columns = dict[str, np.ndarray]


def combined(parts: list[tuple[np.ndarray, ...]], names: tuple[str, ...]) -> Columns:
    """The rows of several documents, sorted by hashes and doc_id, which stand before row and at."""
    columns = dict(zip(names, map(np.concatenate, zip(*parts, strict=True)), strict=True))
    order = np.lexsort([columns[k] for k in reversed(names[:-2])])
    return {k: v[order] for k, v in columns.items()}


def dealt(columns: Columns, done: np.ndarray) -> pa.RecordBatch:
    """Rows for the shuffle with key: those whose group is decided (done) are spread by document, the others meet by their hash."""
    spread = (columns["doc_id"].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)).view(np.int64)
    return batch(**columns, done=done, key=np.where(done, spread, columns["h"]))


def anchors(docs: DataFrame, window: int) -> DataFrame:
    """(h, doc_id, row, at, done, key): hashes at cover positions.

    Hashes that a task itself meets in several documents need no more partners: their rows are done, and only that of the smallest doc_id
    goes on to meet those of other tasks. So a line that a third of all documents have makes one row a batch.
    """
    length = window - PERIOD + 1

    def out(parts: list[tuple[np.ndarray, ...]]) -> pa.RecordBatch:
        rows = combined(parts, ("h", "doc_id", "row", "at"))
        starts, sizes = groups(rows["h"])
        several = rows["doc_id"][starts] != rows["doc_id"][starts + sizes - 1]
        again = np.concatenate([np.arange(len(rows["h"])), starts[several]])  # the first row of each stays for other tasks
        done = np.concatenate([np.repeat(several, sizes), np.zeros(int(several.sum()), bool)])
        return dealt({k: v[again] for k, v in rows.items()}, done)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = Digests()
        parts, held = [], 0
        for b in batches:
            for doc_id, row, text in zip(*(b.column(c).to_pylist() for c in ("doc_id", "row", "text")), strict=True):
                words = WORDS.findall(text)
                if len(words) < window:
                    continue
                at = cover_positions(len(words), length)
                h = Rolling(word_hashes(words, seen)[0]).hashes(at, at + length)
                first, again = once_each(h)
                parts.append((h[first].view(np.int64), np.full(len(first), doc_id), np.full(len(first), row), place(at[first], again)))
                held += len(first)
                if held > HELD_ROWS:
                    yield out(parts)
                    parts, held = [], 0
        if parts:
            yield out(parts)

    return docs.mapInArrow(scan, "h long, doc_id long, row long, at long, done boolean, key long")


def in_several(rows: DataFrame) -> DataFrame:
    """(doc_id, row, at) of the rows whose h is in two documents or more."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_h, open_doc, several = None, None, False  # the hash that the last batch ended in
        held: list[tuple[np.ndarray, ...]] = []  # its rows, all of one document so far
        for b in batches:
            done, h, doc, row, at = (b.column(c).to_numpy(zero_copy_only=False) for c in ("done", "h", "doc_id", "row", "at"))
            if done.any():
                yield batch(doc_id=doc[done], row=row[done], at=at[done])
                h, doc, row, at = h[~done], doc[~done], row[~done], at[~done]
            if not len(h):
                continue
            starts, sizes = groups(h)
            many = doc[starts] != doc[starts + sizes - 1]
            if open_h == h[0]:
                many[0] |= several or doc[0] != open_doc
                if many[0]:
                    for d, r, x in held:
                        yield batch(doc_id=d, row=r, at=x)
                    held = []
            else:
                held, several = [], False
            last = starts[-1]
            keep = np.repeat(many, sizes)
            held = [] if many[-1] else [*(held if open_h == h[-1] and len(starts) == 1 else []), (doc[last:], row[last:], at[last:])]
            open_h, open_doc, several = h[-1], doc[-1], bool(many[-1])
            if keep.any():
                yield batch(doc_id=doc[keep], row=row[keep], at=at[keep])

    return rows.repartition("key").sortWithinPartitions("done", "h", "doc_id").mapInArrow(scan, "doc_id long, row long, at long")


def windows_at(docs: DataFrame, window: int) -> DataFrame:
    """(h, h2, doc_id, row, at, done, key): 128-bit hashes of the windows around the anchors that docs carries in column places.

    Of a window that a task meets in several documents, all but the row of the smallest doc_id are done: they are to be removed.
    """
    length = window - PERIOD + 1

    def out(parts: list[tuple[np.ndarray, ...]]) -> pa.RecordBatch:
        rows = combined(parts, ("h", "h2", "doc_id", "row", "at"))
        starts, sizes = groups(rows["h"], rows["h2"])
        return dealt(rows, rows["doc_id"] > np.repeat(rows["doc_id"][starts], sizes))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = Digests()
        parts, held = [], 0
        for b in batches:
            lists = b.column("places")
            offsets, flat = lists.offsets.to_numpy(), lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
            offsets = offsets - offsets[0]
            for k, (doc_id, row, text, again) in enumerate(zip(*(b.column(c).to_pylist() for c in ("doc_id", "row", "text", "again")), strict=True)):
                words = WORDS.findall(text)
                first, second = word_hashes(words, seen)
                rolling = Rolling(first)
                at = flat[offsets[k] : offsets[k + 1]]
                if again:
                    everywhere = cover_positions(len(words), length)
                    at = everywhere[np.isin(rolling.hashes(everywhere, everywhere + length), rolling.hashes(at, at + length))]
                lows = np.maximum(at - (PERIOD - 1), 0)
                starts = np.flatnonzero(covered(len(words), lows, at - lows + 1, 1)[: len(words) - window + 1])
                h = rolling.hashes(starts, starts + window)
                one, recurs = once_each(h)
                starts = starts[one]
                h2 = Rolling(second, SECOND_BASE).hashes(starts, starts + window)
                parts.append((h[one].view(np.int64), h2.view(np.int64), np.full(len(starts), doc_id), np.full(len(starts), row), place(starts, recurs)))
                held += len(starts)
                if held > HELD_ROWS:
                    yield out(parts)
                    parts, held = [], 0
        if parts:
            yield out(parts)

    return docs.mapInArrow(scan, "h long, h2 long, doc_id long, row long, at long, done boolean, key long")


def not_first(rows: DataFrame) -> DataFrame:
    """(doc_id, row, at) of the rows whose (h, h2) is also in a smaller document."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_key, first = None, 0
        for b in batches:
            done, h, h2, doc, row, at = (b.column(c).to_numpy(zero_copy_only=False) for c in ("done", "h", "h2", "doc_id", "row", "at"))
            if done.any():
                yield batch(doc_id=doc[done], row=row[done], at=at[done])
                h, h2, doc, row, at = h[~done], h2[~done], doc[~done], row[~done], at[~done]
            if not len(h):
                continue
            starts, sizes = groups(h, h2)
            least = doc[starts]
            if open_key == (h[0], h2[0]):
                least[0] = first
            open_key, first = (h[-1], h2[-1]), least[-1]
            later = doc > np.repeat(least, sizes)
            if later.any():
                yield batch(doc_id=doc[later], row=row[later], at=at[later])

    return rows.repartition("key").sortWithinPartitions("done", "h", "h2", "doc_id").mapInArrow(scan, "doc_id long, row long, at long")


def by_document(rows: DataFrame) -> DataFrame:
    """(doc_id, row, places, again) from rows (doc_id, row, at); again: whether some of the hashes recur in the document."""
    bits = lambda mask: F.col("at").bitwiseAND(F.lit(mask))
    split = rows.select("doc_id", "row", bits(0x7FFFFFFF).cast("int").alias("at"), (bits(0x80000000) != 0).alias("again"))
    return split.groupBy("doc_id", "row").agg(F.collect_list("at").alias("places"), F.bool_or("again").alias("again"))


def exact_copies(docs: DataFrame) -> DataFrame:
    """(doc_id, row) of the documents whose whole text is also that of a smaller doc_id. A large group of copies is split by salts."""
    salt = F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).cast("int")
    marks = docs.where("doc_id is not null").select("doc_id", "row", F.sha2(F.col("text").cast("binary"), 256).alias("mark"), salt.alias("salt"))
    first = marks.groupBy("mark").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last")).where("last > first")
    salted = first.select("mark", "first", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    return marks.join(salted, ["mark", "salt"]).where("doc_id > first").select("doc_id", "row").distinct()


def dedup_substrings(docs: DataFrame, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, n_words, n_removed, kept (its words that stay, joined by one space).

    Words covered by a window whose words also stand in a document with a smaller id are removed, judged on the input. Null
    texts have no words. Rows without id have no order: they lose nothing and take nothing from others. Rows with one id don't take from each
    other, whether their texts are equal or not. Other columns are ignored; an empty table gives an empty result.
    """
    if window < PERIOD + 1:
        raise ValueError(f"a window has at least {PERIOD + 1} words")
    text = F.coalesce(docs[text_col], F.lit(""))
    docs = docs.select(docs[id_col].cast("long").alias("doc_id"), F.xxhash64(text).alias("row"), text.alias("text"))
    copies = durable(exact_copies(docs))
    own = join_few(docs.where("doc_id is not null"), copies, "left_anti", ROW)
    met = durable(by_document(in_several(anchors(own, window))))
    around = windows_at(join_few(docs.where("doc_id is not null"), met, "inner", ROW).select("doc_id", "row", "text", "places", "again"), window)
    removed = by_document(not_first(around)).unionByName(copies.withColumns({"places": F.lit(None).cast("array<int>"), "again": F.lit(False)}))
    changed = join_few(docs, durable(removed.withColumn("changed", F.lit(True))), on=ROW)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = Digests()
        for b in batches:
            n_words, n_removed, left = [], [], []
            for text, places, again, touched in zip(*(b.column(c).to_pylist() for c in ("text", "places", "again", "changed")), strict=True):
                words = WORDS.findall(text)
                gone = np.zeros(len(words), bool)
                if touched is True and len(words) >= window:
                    if places is None:  # a copy of a whole document
                        gone[:] = True
                    else:
                        at = np.asarray(places, np.int64)
                        if again:
                            everywhere = Rolling(word_hashes(words, seen)[0]).grams(window)
                            at = np.flatnonzero(np.isin(everywhere, everywhere[at]))
                        gone = covered(len(words), at, np.ones(len(at), np.int64), window)
                kept = " ".join(words) if not gone.any() else " ".join([w for w, g in zip(words, gone.tolist(), strict=True) if not g])
                n_words.append(len(words))
                n_removed.append(int(gone.sum()))
                left.append(kept)
            yield batch(doc_id=b.column("doc_id"), n_words=np.array(n_words, np.int64), n_removed=np.array(n_removed, np.int64), kept=left)

    return changed.mapInArrow(cut, "doc_id long, n_words long, n_removed long, kept string")


def substring_digest(docs: DataFrame) -> DataFrame:
    """dedup_substrings() with the kept words as a hash."""
    return dedup_substrings(docs).select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))
