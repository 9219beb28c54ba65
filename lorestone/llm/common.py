"""Helpers that the training-data operators share: tables, staged results and row numbers."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share, from spark.checkpoint.dir.

    Where the session names none: in local mode a temporary folder, else a folder of the warehouse, which is shared too.
    """
    context = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir")
    if named:
        return named
    own = getattr(context, "_lorestone_shared", None)
    if own is None:
        if context.master.startswith("local[") or context.master == "local":
            own = "file://" + tempfile.mkdtemp(prefix="lorestone-")
        else:
            own = f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/_lorestone"
        context._lorestone_shared = own
    return own


def stage(df: DataFrame, name: str) -> DataFrame:
    """Writes ``df`` to the shared folder and reads it back: lineage ends there, and a lost executor costs no earlier stage."""
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/lorestone-{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._staged_at = path
    return out


def drop_staged(*staged: DataFrame) -> None:
    """Removes what stage() wrote, once nothing that is still to run reads it."""
    for df in staged:
        context = df.sparkSession.sparkContext
        path = context._jvm.org.apache.hadoop.fs.Path(df._staged_at)
        path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, True)


def shuffle_partitions(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions", "200")))


def prefix_sums(totals: list[tuple[int, int]]) -> tuple[dict[int, int], int]:
    """Exclusive prefix sums of (part, total), in the order of the parts, and the sum of all."""
    at, out = 0, {}
    for part, n in sorted(totals):
        out[part] = at
        at += n
    return out, at


def lower_ascii(column):
    """A-Z become a-z; every other character stays as it is."""
    return F.translate(column, UPPER, LOWER)


def free_name(columns: list[str], name: str) -> str:
    """``name`` with as many underscores ahead as no column has, whatever its case; so a helper column never meets one of the caller's."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name
