"""The driver entry: every query has a plan, and works without the training-data folders and the pipeline."""

from __future__ import annotations

import re
import shutil
import subprocess
import sys
from pathlib import Path

import __spark_entry__ as entry

ROOT = Path(__file__).resolve().parent.parent


def test_entry_runs(spark):
    df = entry.entry(spark)
    assert df.columns == ["doc_id", "text", "has_text"] and df.count() > 0


def test_names():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert all(re.fullmatch(r"[a-z]\d+_[a-z0-9_]+|op\d+_[a-z0-9_]+|pipeline", n) for n in entry.queries())


def test_without_the_training_data_folders(tmp_path):
    copy = tmp_path / "repo"
    shutil.copytree(ROOT, copy, ignore=shutil.ignore_patterns(".git", "llm", "corpus_pipeline.py", "__pycache__", ".pytest_cache", "spark-warehouse"))
    code = "import __spark_entry__ as e; q = e.queries(); assert len(q) > 70 and not any(n.startswith('op') or n == 'pipeline' for n in q); print(len(e.oracle_sql()))"
    said = subprocess.run([sys.executable, "-B", "-c", code], cwd=copy, env={"PATH": "/usr/bin:/bin"}, capture_output=True, text=True, timeout=120)
    assert said.returncode == 0, said.stderr


def test_nothing_else_imports_the_training_data_package():
    for p in (ROOT / "quirework").rglob("*.py"):
        if "llm" not in p.parts:
            assert "quirework.llm" not in p.read_text(), p
