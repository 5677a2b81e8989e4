"""One place that builds a local session for tests, the bench and small runs."""

from __future__ import annotations

from pyspark.sql import SparkSession


def local_session(cpus: int | str = 8, **conf: str) -> SparkSession:
    """A local session with UTC time and adaptive execution; a cluster brings its own."""
    n = str(cpus)
    settings = {
        "spark.sql.shuffle.partitions": n if n.isdigit() else "8",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        "spark.driver.memory": "12g",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    } | conf
    spark = SparkSession.builder.master(f"local[{n}]").appName("quirework").config(map=settings).getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark
