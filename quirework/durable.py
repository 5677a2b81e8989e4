"""Cutting lineage for iterative jobs: results are written to the folder that all executors share, and read again."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


_local: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir. Only a session whose executors are threads of the driver may do without; it gets a temporary one.

    That one is remembered here, by application, as a running session takes no new spark.checkpoint.dir; it goes when the process ends.
    """
    found = spark.conf.get("spark.checkpoint.dir", "") or spark.sparkContext.getConf().get("spark.checkpoint.dir", "")
    if found:
        return found.rstrip("/")
    master = spark.sparkContext.master
    if master != "local" and not master.startswith("local["):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    app = spark.sparkContext.applicationId
    if app not in _local:
        _local[app] = tempfile.mkdtemp(prefix="quirework-")
        atexit.register(shutil.rmtree, _local[app], ignore_errors=True)
    return _local[app]


def own_dir(spark: SparkSession) -> str:
    """The folder of this application within the shared one."""
    return f"{shared_dir(spark)}/quirework-{spark.sparkContext.applicationId}"


def durable(df: DataFrame) -> DataFrame:
    """The same rows from a written table: a lost executor loses nothing, and plans don't grow from round to round."""
    spark = df.sparkSession
    path = f"{own_dir(spark)}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def remove(spark: SparkSession, folder: str) -> None:
    """Deletes a folder, in whatever store it is."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def clear(spark: SparkSession) -> None:
    """Deletes what this application has written with durable(); call it once the results that read it have been stored."""
    remove(spark, own_dir(spark))
