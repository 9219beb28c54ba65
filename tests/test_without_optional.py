"""The library without its optional subpackage and pipeline: the entry still imports and lists the other queries."""

import os
import shutil
import subprocess
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parent.parent


@pytest.mark.parametrize("pipeline", [False, True])
def test_entry_without_the_optional_part(tmp_path, pipeline):
    """With the pipeline's file gone too, and with only the folders gone."""
    if pipeline:
        shutil.copy(ROOT / "corpus_pipeline.py", tmp_path)
    shutil.copytree(ROOT / "lorestone", tmp_path / "lorestone", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(ROOT / "__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; from lorestone.queries import QUERIES, ORACLE_SQL; assert set(e.queries()) == set(QUERIES) and e.oracle_sql() == ORACLE_SQL; print(len(QUERIES))"
    done = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env={"PATH": "/usr/bin:/bin", "PYTHONPATH": str(tmp_path)}, capture_output=True, text=True, check=False)
    assert done.returncode == 0, done.stderr
    assert int(done.stdout) > 80


def test_workers_find_the_package_from_any_folder(tmp_path):
    code = f"""
import sys
sys.path.insert(0, {str(ROOT)!r})
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local[1]").config("spark.ui.enabled", "false").getOrCreate()
import __spark_entry__ as e
print(e.queries()["source_entities"](spark, "").count())
"""
    done = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env={k: v for k, v in os.environ.items() if k != "PYTHONPATH"}, capture_output=True, text=True, check=False)
    assert done.returncode == 0, done.stderr[-2000:]
    assert int(done.stdout) > 20


def test_entry_does_not_hide_a_broken_import(tmp_path):
    shutil.copytree(ROOT / "lorestone", tmp_path / "lorestone", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(ROOT / "__spark_entry__.py", tmp_path)
    (tmp_path / "corpus_pipeline.py").write_text("import no_such_module\n")
    done = subprocess.run([sys.executable, "-c", "import __spark_entry__"], cwd=tmp_path, env={"PATH": "/usr/bin:/bin", "PYTHONPATH": str(tmp_path)}, capture_output=True, text=True, check=False)
    assert done.returncode != 0 and "no_such_module" in done.stderr
