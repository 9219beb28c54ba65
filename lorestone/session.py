"""Makes the package importable on the executors."""

from __future__ import annotations

import functools
import os
import tempfile
import zipfile
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

ROOT = Path(__file__).resolve().parent


def ship(spark: SparkSession) -> None:
    """Sends the package once for each context, unless the workers find it themselves: on PYTHONPATH or in the working folder."""
    context = spark.sparkContext
    paths = {os.path.realpath(p) for p in [*os.environ.get("PYTHONPATH", "").split(os.pathsep), os.getcwd()] if p}
    if str(ROOT.parent) in paths or getattr(context, "_lorestone_shipped", False):
        return
    at = os.path.join(tempfile.mkdtemp(prefix="lorestone-code-"), "lorestone.zip")
    with zipfile.ZipFile(at, "w", zipfile.ZIP_DEFLATED) as z:
        for f in sorted(ROOT.rglob("*.py")):
            z.write(f, f"lorestone/{f.relative_to(ROOT)}")
    context.addPyFile(at)
    context._lorestone_shipped = True


def shipping(query: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    @functools.wraps(query)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        ship(spark)
        return query(spark, sf_dir)

    return run
