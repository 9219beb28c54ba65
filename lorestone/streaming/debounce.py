"""Debouncing of file events: events of one path that follow each other within a gap are one change."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lorestone.sources.store import shared_dir


def sessions(events: DataFrame, gap: str) -> DataFrame:
    """(path, first, last, events, action). ``events``: path, ts, event_type. Batch or stream; a stream needs a watermark on ts.

    The last event decides: a change that ends in a deletion deletes. A creation that is deleted within one session cancels out.
    """
    last = F.max_by("event_type", "ts")
    first = F.min_by("event_type", "ts")
    out = events.groupBy("path", F.session_window("ts", gap).alias("w")).agg(F.count(F.lit(1)).alias("events"), first.alias("_first"), last.alias("_last"), F.max("ts").alias("last"))
    action = F.when((F.col("_first") == "created") & (F.col("_last") == "deleted"), "none").when(F.col("_last") == "deleted", "delete").otherwise("index")
    return out.select("path", F.col("w.start").alias("first"), "last", "events", action.alias("action"))


def moves(events: DataFrame) -> DataFrame:
    """A move is a deletion of the source and a creation of the target. ``events``: path, target, ts, event_type."""
    one = lambda p, t: F.struct(F.col(p).alias("path"), F.lit(t).alias("event_type"))
    plain = F.array(F.struct(F.col("path"), F.col("event_type")))
    return events.withColumn("e", F.explode(F.when(F.col("event_type") == "moved", F.array(one("path", "deleted"), one("target", "created"))).otherwise(plain))).select("e.path", "e.event_type", "ts")


QUIET, EXPIRED, MOST_PENDING = 2, 300, 100  # seconds after which a path is ready, after which it is forgotten; paths that are flushed at once


def action_of(first, last):
    return F.when((first == "created") & (last == "deleted"), "none").when(last == "deleted", "delete").otherwise("index")


def pending(events: DataFrame, now, path: str = "path", quiet: int = QUIET, expired: int = EXPIRED) -> DataFrame:
    """(path, events, status, flushed, action) of every path at the moment ``now``: ready after ``quiet`` seconds without an event, expired after ``expired``, else waiting.

    ``flushed`` tells what a forced flush takes, which is all that has not expired.
    """
    each = events.groupBy(path).agg(F.count(F.lit(1)).alias("events"), F.max("ts").alias("_last"), F.min_by("event_type", "ts").alias("_a"), F.max_by("event_type", "ts").alias("_b"))
    silent = F.unix_seconds(now) - F.unix_seconds("_last")
    status = F.when(silent > expired, "expired").when(silent >= quiet, "ready").otherwise("waiting")
    return each.select(path, "events", status.alias("status"), (silent <= expired).alias("flushed"), action_of(F.col("_a"), F.col("_b")).alias("action"))


def checked_again(seen: DataFrame, again: DataFrame) -> DataFrame:
    """(path, action): files that were there when seen, or are there after the delay, are indexed; the others deleted. ``seen``: path, there; ``again``: path."""
    back = again.select("path").distinct().withColumn("_back", F.lit(True))
    return seen.join(back, "path", "left").select("path", F.when(F.col("there") | F.coalesce("_back", F.lit(False)), "index").otherwise("delete").alias("action"))


def counters(events: DataFrame, project: str) -> DataFrame:
    """(project, events, files, kinds, last): what a watcher saw."""
    return events.groupBy(project).agg(F.count(F.lit(1)).alias("events"), F.countDistinct("path").alias("files"), F.countDistinct("event_type").alias("kinds"), F.unix_micros(F.max("ts")).alias("last"))


def completed(lines: DataFrame, pattern: str, expected: int) -> DataFrame:
    """(log, line, files): the first line of each log at which the numbers that ``pattern`` captures add up to ``expected``, null if they never do, and the sum up to there. ``lines``: log, n, line."""
    number = F.coalesce(F.regexp_extract("line", pattern, 1).try_cast("long"), F.lit(0).cast("long"))
    done = F.sum(number).over(Window.partitionBy("log").orderBy("n"))
    each = lines.withColumn("done", done)
    stop = F.min(F.when(F.col("done") >= expected, F.col("n")))
    return each.groupBy("log").agg(stop.alias("line"), F.min(F.when(F.col("done") >= expected, F.col("done"))).alias("_all"), F.max("done").alias("_some")).select("log", "line", F.coalesce("_all", "_some").alias("files"))


def run_available(spark: SparkSession, path: str, gap: str, delay: str) -> DataFrame:
    """Debounces what is in a Parquet folder as a stream, once, and gives the closed sessions; state and results live on shared storage."""
    at = f"{shared_dir(spark)}/debounce-{uuid.uuid4().hex}"
    table = spark.read.parquet(path)
    reader = spark.readStream.schema(table.schema)
    folder, _, name = path.rstrip("/").rpartition("/")
    single = all(f.rstrip("/").endswith(f"/{name}") for f in table.inputFiles())  # a stream reads folders: a single file is picked from its own
    source = reader.option("pathGlobFilter", name).parquet(folder) if single else reader.parquet(path)
    events = source.select(F.col("user_id").alias("path"), F.col("ts").cast("timestamp").alias("ts"), "event_type").withWatermark("ts", delay)
    query = sessions(events, gap).writeStream.format("parquet").option("path", f"{at}/out").option("checkpointLocation", f"{at}/state").outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.parquet(f"{at}/out")
