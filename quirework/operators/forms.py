"""Form fields: inventory, filling, and verification of what was produced."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def field_inventory(fields: DataFrame) -> DataFrame:
    """(doc_id, type, fields, filled): fields of each type, and those that have a value."""
    return fields.groupBy("doc_id", "type").agg(F.count("*").alias("fields"), F.count_if(F.coalesce("value", F.lit("")) != "").alias("filled"))


def fill_fields(fields: DataFrame, wanted: DataFrame) -> DataFrame:
    """(doc_id, field, filled, skipped_label): wanted values that fields take; a dropdown or radio takes its options or an empty value, which clears it.

    Unknown fields are skipped. What is skipped carries a readable label. fields has options array<string>.
    """
    met = wanted.select("doc_id", "field", "wanted").join(fields.select("doc_id", "field", "type", "options"), ["doc_id", "field"], "left")
    choice = F.col("type").isin("dropdown", "radio")
    fits = F.col("type").isNotNull() & (~choice | (F.col("wanted") == "") | F.coalesce(F.array_contains("options", F.col("wanted")), F.lit(False)))
    label = F.trim(F.regexp_replace(F.regexp_replace("field", "[<>]", ""), "[_.]", " "))
    return met.select("doc_id", "field", fits.alias("filled"), F.when(~fits, label).alias("skipped_label"))


def verify_fields(wanted: DataFrame, produced: DataFrame) -> DataFrame:
    """(doc_id, field, problem): wanted values that the produced document lacks, has otherwise, or doesn't draw. produced is (doc_id, field, found, drawn)."""
    met = wanted.join(produced.withColumn("there", F.lit(True)), ["doc_id", "field"], "left")
    problem = F.when(F.col("there").isNull(), "missing").when(~F.col("found").eqNullSafe(F.col("wanted")), "mismatch").when(~F.col("drawn"), "not-drawn")
    return met.select("doc_id", "field", problem.alias("problem")).where("problem is not null")
