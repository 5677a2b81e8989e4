"""Aggregate reports: errors by kind, sizes, batch outcomes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Kinds in the order in which they are tried, each with the messages that mean it.
ERROR_KINDS = (
    ("encrypted", r"(?i)^PasswordException$|password|is encrypted"),
    ("invalid", r"(?i)^InvalidPDFException$|^UnknownErrorException$|invalid pdf|failed to parse|no pdf header"),
    ("assets", r"(?i)fetch|network|load failed|importScripts|worker"),
    ("too-large", r"(?i)detached|out of memory|allocation|maximum call stack"),
)


def error_kind(message: Column, known: Column | None = None) -> Column:
    """The kind of an error: as given by a tool, else the first that its message fits, else unknown."""
    kind = F.lit("unknown")
    for name, pattern in reversed(ERROR_KINDS):
        kind = F.when(message.rlike(pattern), name).otherwise(kind)
    return kind if known is None else F.coalesce(known, kind)


def classify_errors(log: DataFrame) -> DataFrame:
    """(day, kind, n); a column known, if the log has one, holds the kind that a tool gave itself: any of these, unsupported-image or cancelled."""
    known = F.col("known") if "known" in log.columns else None
    return log.groupBy("day", error_kind(F.col("message"), known).alias("kind")).agg(F.count("*").alias("n"))


def size_report(outputs: DataFrame, slice_col: str) -> DataFrame:
    """(slice, files, in_bytes, out_bytes, saved_percent, grew): totals of a slice, percent saved as a whole number, files that grew."""
    saved = F.round((1 - F.sum("out_bytes") / F.sum("in_bytes")) * 100).cast("long")
    return outputs.groupBy(slice_col).agg(F.count("*").alias("files"), F.sum("in_bytes").alias("in_bytes"), F.sum("out_bytes").alias("out_bytes"), saved.alias("saved_percent"), F.count_if(F.col("out_bytes") > F.col("in_bytes")).alias("grew"))


def batch_outcome(items: DataFrame) -> DataFrame:
    """(batch_id, converted, failed, timed_out, skipped, pages) of items that carry processed."""
    done, ok = F.col("processed"), F.col("status") == "ok"
    return items.groupBy("batch_id").agg(F.count_if(done & ok).alias("converted"), F.count_if(done & ~ok).alias("failed"), F.count_if(done & F.col("timed_out")).alias("timed_out"), F.count_if(~done).alias("skipped"), F.coalesce(F.sum(F.when(done & ok, F.col("page_count"))), F.lit(0)).alias("pages"))
