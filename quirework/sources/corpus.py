"""Reading a corpus, routing and admitting files, writing parts."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quirework.durable import remove
from quirework.sources import formats

#: Columns that each input table must have, as DDL.
SCHEMAS = {
    "documents": "doc_id bigint, text string, lang string, source string, n_chars bigint",
    "pages": "page_id bigint, url string, html string",
    "labels": "doc_id bigint, quality int, toxic int",
    "conversations": "conv_id bigint, turn bigint, role string, text string",
    "benchmark": "item_id bigint, text string",
}


def load_corpus(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """The tables read with their declared types; documents carry readable, false where the text is missing."""
    tables = {name: spark.read.schema(ddl).parquet(f"{sf_dir.rstrip('/')}/{name}.parquet") for name, ddl in SCHEMAS.items()}
    tables["documents"] = tables["documents"].withColumn("readable", F.col("text").isNotNull() & (F.col("text") != ""))
    return tables


def route_files(manifest: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(routed, rejected): each file with filter, family and legacy of its suffix; files of unknown suffix apart."""
    spark = manifest.sparkSession
    known = F.broadcast(spark.createDataFrame(formats.FORMATS, "extension string, filter string, family string, legacy boolean"))  # a fixed short list
    rows = manifest.withColumn("extension", F.lower(F.regexp_extract("file_name", r"(\.[^.]+)$", 1)))
    return rows.join(known, "extension"), rows.join(known, "extension", "left_anti")


def read_asset_heads(spark: SparkSession, path: str, size: int = 16) -> DataFrame:
    """(path, length, declared_kind, head_hex): the files under a path, by their suffix, and their first bytes.

    Spark's binaryFile source lists them without reading contents; tasks then open each file and read its head only, whatever its length. The files'
    store must be one that Arrow's file systems open, such as local disks, HDFS, S3 and GCS. Empty files are not listed.
    """

    def heads(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = []
            for uri in b.column("path").to_pylist():
                scheme, _, name = uri.partition(":")
                # names are as they are, not encoded as in a URI
                store, name = (pa.fs.LocalFileSystem(), name) if scheme == "file" else pa.fs.FileSystem.from_uri(uri)
                with store.open_input_file(name) as f:
                    found.append(f.read(size).hex().upper())
            yield pa.RecordBatch.from_arrays([b.column("path"), b.column("length"), pa.array(found, pa.string())], ["path", "length", "head_hex"])

    listed = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "length")
    kind = F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1))
    return listed.mapInArrow(heads, "path string, length long, head_hex string").select("path", "length", F.when(kind == "jpeg", "jpg").otherwise(kind).alias("declared_kind"), "head_hex")


def audit_asset_types(assets: DataFrame, head_hex: str = "head_hex") -> DataFrame:
    """(declared_kind, sniffed, n): kinds as declared beside those that the first bytes, such as read_asset_heads() gives, show."""
    head = F.upper(F.col(head_hex))
    sniffed = F.when(head.startswith("89504E"), "png").when(head.startswith("FFD8FF"), "jpg").otherwise("unknown")
    return assets.groupBy("declared_kind", sniffed.alias("sniffed")).agg(F.count("*").alias("n"))


def admit_files(manifest: DataFrame) -> DataFrame:
    """Every file against every tool's ceilings: doc_id, tool, admitted, reason (too-large, too-many-pages or null)."""
    limits = F.broadcast(manifest.sparkSession.createDataFrame(formats.LIMITS, "tool string, max_bytes bigint, max_pages bigint"))  # four rows
    reason = F.when(F.col("size_bytes") > F.col("max_bytes"), "too-large").when(F.col("page_count") > F.col("max_pages"), "too-many-pages")
    return manifest.join(limits).select("doc_id", "tool", reason.isNull().alias("admitted"), reason.alias("reason"))


def part_names(parts: DataFrame, manifest: DataFrame) -> DataFrame:
    """(doc_id, part, name): sortable names of parts, padded to the width of the document's last part."""
    last = parts.groupBy("doc_id").agg(F.max("part").alias("parts"))
    stem = F.regexp_replace("file_name", r"\.[^.]+$", "")
    met = parts.join(last, "doc_id").join(manifest.select("doc_id", "file_name"), "doc_id")
    number = F.lpad(F.col("part").cast("string"), F.length(F.col("parts").cast("string")), F.lit("0"))
    return met.select("doc_id", "part", F.concat(stem, F.lit("-"), number, F.lit(".pdf")).alias("name"))


def write_parts(parts: DataFrame, pages: DataFrame, path: str, by: tuple[str, ...] = ("doc_id", "part")) -> DataFrame:
    """Writes the pages of every part (doc_id, part, from_page, to_page and further columns), in one folder for each value of `by`; returns the run's manifest.

    Folders of single parts suit exports; a corpus of many small documents takes a column with fewer values, such as the batch. Rows go to a
    staging folder first: a run that fails while it computes them changes nothing. Then the folders of this run's values, and no others, are
    replaced, and last the run's manifest (run, folder, rows) is added under _manifest: a run without one has to be repeated, which is
    safe. Large folders get several files and small ones share tasks, by the session's advisory partition size.
    """
    spark, run = pages.sparkSession, uuid.uuid4().hex
    p = pages.withColumnRenamed("doc_id", "_page_doc")
    met = parts.join(p, (F.col("doc_id") == F.col("_page_doc")) & F.col("ordinal").between(F.col("from_page"), F.col("to_page"))).drop("_page_doc")
    staged = f"{path.rstrip('/')}/_staging-{run}"
    try:
        met.hint("rebalance", *by).write.parquet(staged)
        rows = spark.read.schema(met.schema).parquet(staged)
        rows.hint("rebalance", *by).write.partitionBy(*by).mode("overwrite").option("partitionOverwriteMode", "dynamic").parquet(path)
        folder = F.concat_ws("/", *(F.concat(F.lit(f"{c}="), F.col(c).cast("string")) for c in by))
        manifest = rows.groupBy(folder.alias("folder")).agg(F.count("*").alias("rows")).select(F.lit(run).alias("run"), "folder", "rows")
        manifest.coalesce(1).write.mode("append").parquet(f"{path.rstrip('/')}/_manifest")
    finally:
        remove(spark, staged)
    return spark.read.parquet(f"{path.rstrip('/')}/_manifest").where(F.col("run") == run)
