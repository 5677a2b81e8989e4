"""Where intermediate tables go."""

from __future__ import annotations

import os
import subprocess
import sys
from pathlib import Path
from types import SimpleNamespace

import pytest
from pyspark.sql import functions as F

from quirework import durable
from quirework.functions import settings


def test_written_rows_and_clearing(spark):
    df = durable.durable(spark.range(5).withColumn("x", F.col("id") * 2))
    assert sorted(map(tuple, df.collect())) == [(i, 2 * i) for i in range(5)]
    folder = Path(durable.own_dir(spark).removeprefix("file:"))
    assert folder.is_dir()
    durable.clear(spark)
    assert not folder.exists()


@pytest.mark.parametrize("master", ["yarn", "spark://h:7077", "local-cluster[2,1,1024]"])
def test_a_cluster_without_a_shared_folder_is_an_error(master):
    conf = SimpleNamespace(get=lambda key, other: other)
    fake = SimpleNamespace(conf=conf, sparkContext=SimpleNamespace(master=master, getConf=lambda: conf))
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        durable.shared_dir(fake)


def test_settings_are_broadcast_after_counting(spark):
    assert settings(spark.range(10), 10).count() == 10
    with pytest.raises(ValueError, match="at most"):
        settings(spark.range(11), 10)


STOCK = """
import sys
import __spark_entry__ as entry
from quirework.session import local_session
spark = local_session(4)
assert not spark.conf.get("spark.checkpoint.dir", "")
failed = {}
for name, query in entry.queries().items():
    if name in sys.argv[1:] or len(sys.argv) == 1:
        try:
            query(spark, "/root/testdata/sf0.001").write.format("noop").mode("overwrite").save()
        except Exception as e:
            failed[name] = str(e)[:300]
assert not failed, failed
"""


def test_a_stock_session_runs_the_queries_that_cut_lineage(tmp_path):
    """Without any Spark configuration: a fresh process, an empty SPARK_CONF_DIR and no spark.checkpoint.dir."""
    root = Path(__file__).resolve().parent.parent
    cuts = [p.stem for p in (root / "quirework" / "operators").glob("*.py") if "durable" in p.read_text()]
    assert "structure" in cuts
    names = ["d1_reachable_objects", "d3_live_fields", "d6_live_bookmarks", "r3_redaction_survivors", "s5_write_parts"]
    env = {"PATH": os.environ["PATH"], "HOME": str(tmp_path), "SPARK_CONF_DIR": str(tmp_path), "PYTHONPATH": str(root), "TMPDIR": str(tmp_path)} | {k: v for k, v in os.environ.items() if k == "JAVA_HOME"}
    said = subprocess.run([sys.executable, "-B", "-c", STOCK, *names], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=900)
    assert said.returncode == 0, said.stderr[-2000:]
    assert not [*tmp_path.glob("quirework-*")]
