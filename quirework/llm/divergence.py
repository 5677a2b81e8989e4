"""Source divergence audit: how far the words of each source lie from those of the other sources of its language, and which words make it.

Counts are formed in the tasks that read the texts, batch by batch, and summed by Spark. The ranking of terms never sorts terms: terms with
equal counts in the group and in the language share one cell, a cell has one value, cells of equal values are merged, and their cumulative
multiplicity says which of them reach the wanted ranks. Only those are expanded to their terms, in the order of the terms' UTF-8 bytes.
All arithmetic is on integers; products that may pass 64 bits are decimals.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quirework.llm.common import batch, durable

#: What stands between terms, for RE2: everything but ASCII letters and characters beyond ASCII.
BETWEEN = r"[\x00-\x40\x5B-\x60\x7B-\x7F]+"
MIN_DOCS, TOP, SMOOTHING, UNIT = 30, 50, 5, 1_000_000_000
#: Sources whose distances to all others one task sums at once; and cells of a block of terms by sources.
SOURCE_BLOCK = 64
BLOCK_CELLS = 1 << 19
#: Bytes of text that are split at once.
PIECE = 1 << 24


def _pieces(b: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """A batch in pieces of some 16 MB of text; a longer text is one piece."""
    ends = np.cumsum(np.asarray(pc.binary_length(b.column("text"))))
    k = 0
    while k < len(b):
        n = max(1, int(np.searchsorted(ends, (ends[k - 1] if k else 0) + PIECE, "right")) - k)
        yield b.slice(k, n)
        k += n


def _count(b: pa.RecordBatch) -> pa.RecordBatch:
    """(lang, source, term, n, docs) of the terms of some documents."""
    # lower-cased before the cast: pyarrow's ascii_lower reads slices of large strings from a wrong place
    lists = pc.split_pattern_regex(pc.ascii_lower(b.column("text")).cast(pa.large_string()), BETWEEN)
    words, row = lists.flatten(), np.asarray(pc.list_parent_indices(lists)).astype(np.int64)
    coded = words.dictionary_encode()
    terms, code = coded.dictionary, np.asarray(coded.indices).astype(np.int64)
    term_of = np.asarray(pc.not_equal(terms, ""))[code] if len(terms) else np.zeros(0, bool)
    row, code = row[term_of], code[term_of]  # splitting leaves empty strings at the ends
    pairs = pa.StructArray.from_arrays([b.column("lang"), b.column("source")], ["lang", "source"])
    seen: dict[tuple, int] = {}
    group_of = np.array([seen.setdefault((x["lang"], x["source"]), len(seen)) for x in pairs.to_pylist()], np.int64)
    first = {v: k for k, v in seen.items()}
    n_terms = max(1, len(terms))
    in_doc = np.unique(row * n_terms + code)  # each term of a document once
    keys, n = np.unique(group_of[row] * n_terms + code, return_counts=True)
    doc_keys, docs = np.unique(group_of[in_doc // n_terms] * n_terms + in_doc % n_terms, return_counts=True)
    assert np.array_equal(keys, doc_keys)
    group = keys // n_terms
    take = lambda part: pa.array([first[g][part] for g in range(len(first))], pa.string()).take(pa.array(group))
    return batch(lang=take(0), source=take(1), term=terms.take(pa.array(keys % n_terms)).cast(pa.string()), n=n.astype(np.int64), docs=docs.astype(np.int64))


def term_counts(docs: DataFrame) -> DataFrame:
    """(lang, source, term, n, docs): occurrences of each term in each group, and the documents of the group that have it."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for piece in _pieces(b):
                yield _count(piece)

    counted = docs.mapInArrow(scan, "lang string, source string, term string, n long, docs long")
    return counted.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def share(count: Column, total: Column, kept: Column) -> Column:
    """1 + floor(10**9 * (count + 5) / (total + 5 * kept)), exactly."""
    wide = lambda c: c.cast("decimal(28,0)")
    top = (wide(count) + SMOOTHING) * F.lit(UNIT).cast("decimal(10,0)")
    return F.call_function("div", top, wide(total) + wide(kept) * SMOOTHING) + 1


def pair_distances(shares: DataFrame, groups: DataFrame) -> DataFrame:
    """(lang, source, item, value): sums of |p - q| over all kept terms for each two sources of a language, both ways round.

    shares is (lang, term, no, p), with rows for occurring terms only; groups (lang, source, no, zero), no numbering the sources of a
    language from 0, zero being the share of a term that doesn't occur. A term is one row with at most one entry a source. A task sums
    the distances of SOURCE_BLOCK sources to all others, so it holds that many rows of the matrix and not the square of the sources.
    """
    zeros = groups.groupBy("lang").agg(F.transform(F.array_sort(F.collect_list(F.struct("no", "zero"))), lambda x: x["zero"]).alias("zeros"))
    terms = shares.groupBy("lang", "term").agg(F.collect_list(F.struct("no", "p")).alias("have")).join(zeros, "lang")
    blocks = terms.select("lang", "have", "zeros", F.explode(F.sequence(F.lit(0), F.floor((F.size("zeros") - 1) / SOURCE_BLOCK).cast("int"))).alias("block"))

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[tuple[str, int], np.ndarray] = {}
        for b in batches:
            langs, block = b.column("lang").to_pylist(), np.asarray(b.column("block"))
            have, zero_lists = b.column("have"), b.column("zeros")
            entries, parent = have.flatten(), np.asarray(pc.list_parent_indices(have)).astype(np.int64)
            no, p = np.asarray(entries.field("no")).astype(np.int64), np.asarray(entries.field("p"))
            rows_of: dict[tuple[str, int], list[int]] = {}
            for k, key in enumerate(zip(langs, block.tolist(), strict=True)):
                rows_of.setdefault(key, []).append(k)
            begin = np.searchsorted(parent, np.arange(len(b) + 1))
            for (lang, part), rows in rows_of.items():
                zero = np.array(zero_lists[rows[0]].as_py(), np.int64)
                own = slice(part * SOURCE_BLOCK, (part + 1) * SOURCE_BLOCK)
                total = sums.setdefault((lang, part), np.zeros((len(zero[own]), len(zero)), np.int64))
                step = max(1, BLOCK_CELLS // len(zero))
                for k in range(0, len(rows), step):
                    at = np.array(rows[k : k + step])
                    sizes = begin[at + 1] - begin[at]
                    from_ = np.repeat(begin[at] - np.cumsum(sizes) + sizes, sizes) + np.arange(sizes.sum())
                    table = np.tile(zero, (len(at), 1))
                    table[np.repeat(np.arange(len(at)), sizes), no[from_]] = p[from_]
                    for i, column in enumerate(table[:, own].T):
                        total[i] += np.abs(table - column[:, None]).sum(axis=0)
        for (lang, part), total in sums.items():
            i, j = np.indices(total.shape)
            yield batch(lang=[lang] * total.size, a=(i.ravel() + part * SOURCE_BLOCK).astype(np.int32), b=j.ravel().astype(np.int32), value=total.ravel())

    sums = blocks.mapInArrow(measure, "lang string, a int, b int, value long").groupBy("lang", "a", "b").agg(F.sum("value").alias("value"))
    one = groups.select("lang", "source", F.col("no").alias("a"))
    two = groups.select("lang", F.col("source").alias("item"), F.col("no").alias("b"))
    return one.join(two, "lang").where("a != b").join(sums, ["lang", "a", "b"], "left").select("lang", "source", "item", F.coalesce("value", F.lit(0)).alias("value"))


def top_terms(counts: DataFrame, groups: DataFrame, top: int = TOP) -> DataFrame:
    """(lang, source, item, value, rank): of each group the terms that are more frequent there than in the language, by difference, to rank `top`.

    counts is (lang, source, term, n, lang_n). Cells are (n, lang_n); at most `top` values of a group can reach the wanted ranks.
    """
    key, cell = ["lang", "source"], ["lang", "source", "n", "lang_n"]
    cells = counts.groupBy(*cell).agg(F.count("*").alias("terms")).join(groups, key)
    p, q = share(F.col("n"), F.col("total"), F.col("kept")), share(F.col("lang_n"), F.col("lang_total"), F.col("kept"))
    valued = durable(cells.select(*cell, "terms", (p - q).alias("value")).where("value > 0"))
    merged = valued.groupBy(*key, "value").agg(F.sum("terms").alias("terms"))
    by_value = Window.partitionBy(*key).orderBy(F.col("value").desc())
    few = merged.withColumn("k", F.row_number().over(by_value)).where(F.col("k") <= top)
    before = F.sum("terms").over(by_value.rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("terms")
    reached = few.withColumn("before", before).where(F.col("before") < top).select(*key, "value", "before")
    open_cells = valued.join(reached, [*key, "value"]).select(*cell, "value", "before")
    place = F.row_number().over(Window.partitionBy(*key, "value").orderBy("term"))
    ranked = counts.join(open_cells, cell).withColumn("place", place).where(F.col("place") <= top).withColumn("rank", (F.col("before") + F.col("place")).cast("int"))
    return ranked.where(F.col("rank") <= top).select("lang", "source", F.col("term").alias("item"), "value", "rank")


def source_divergence(docs: DataFrame, min_docs: int = MIN_DOCS, top: int = TOP) -> DataFrame:
    """(lang, source, part, item, value, rank) for every group (lang, source) of the documents.

    Part "pair" has the other sources of the language with the summed difference of the shares, all ranks; part "term" the terms whose share is
    higher in the group than in the language, to rank `top`. A language keeps the terms that at least min_docs of its documents have.
    Null texts, languages and sources are read as empty, and an empty name is a name like others. Equal values are ranked by the
    UTF-8 bytes of the item. Repeated rows count each; other columns are ignored; groups without terms take part; an empty table gives an
    empty result, and a language with one source no pairs.
    """
    rows = docs.select(*(F.coalesce(docs[c], F.lit("")).alias(c) for c in ("text", "lang", "source")))
    counts = durable(term_counts(rows))
    whole = Window.partitionBy("lang", "term")
    frequent = counts.withColumn("lang_n", F.sum("n").over(whole)).withColumn("lang_docs", F.sum("docs").over(whole)).where(F.col("lang_docs") >= min_docs)
    kept = durable(frequent.select("lang", "source", "term", "n", "lang_n"))
    totals = kept.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    langs = kept.groupBy("lang", "term").agg(F.first("lang_n").alias("n")).groupBy("lang").agg(F.count("*").alias("kept"), F.sum("n").alias("lang_total"))
    number = F.row_number().over(Window.partitionBy("lang").orderBy("source")) - 1  # one row a source
    known = rows.select("lang", "source").distinct().withColumn("no", number).join(totals, ["lang", "source"], "left").join(langs, "lang", "left")
    filled = known.select("lang", "source", "no", *(F.coalesce(c, F.lit(0)).alias(c) for c in ("total", "kept", "lang_total")))
    zero = F.when(F.col("kept") > 0, share(F.lit(0), F.col("total"), F.col("kept"))).otherwise(F.lit(0))
    groups = durable(filled.withColumn("zero", zero))
    shares = kept.join(groups.select("lang", "source", "no", "total", "kept"), ["lang", "source"]).select("lang", "term", "no", share(F.col("n"), F.col("total"), F.col("kept")).alias("p"))
    by_value = Window.partitionBy("lang", "source").orderBy(F.col("value").desc(), "item")
    pairs = pair_distances(shares, groups.select("lang", "source", "no", "zero")).withColumn("rank", F.row_number().over(by_value))
    out = lambda df, part: df.select("lang", "source", F.lit(part).alias("part"), "item", "value", "rank")
    return out(pairs, "pair").unionByName(out(top_terms(kept, groups.select("lang", "source", "total", "kept", "lang_total"), top), "term"))
