"""Versioned collections on shared storage, and readers of files and chat logs."""

from __future__ import annotations

import hashlib
import json
import re
import tempfile
import uuid
from collections.abc import Callable
from typing import NamedTuple

from pyspark.errors import AnalysisException, PySparkException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lorestone.operators.chat import normalized
from lorestone.operators.rows import payload_filter
from lorestone.operators.state import clear_automatic

METRICS = ("cosine", "euclidean", "dot")


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir; unset, a temporary folder in local mode, else a folder of the warehouse."""
    context = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir")
    if named:
        return named.rstrip("/")
    if context.master.startswith("local[") or context.master == "local":
        if not hasattr(context, "_lorestone_store"):
            context._lorestone_store = "file://" + tempfile.mkdtemp(prefix="lorestone-")
        return context._lorestone_store
    return spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_lorestone"


def staged(df: DataFrame, name: str) -> DataFrame:
    """Written to the shared folder and read back: what is used twice is computed once, and lineage ends there."""
    at = f"{shared_dir(df.sparkSession)}/staged/{name}-{uuid.uuid4().hex}"
    df.write.parquet(at)
    out = df.sparkSession.read.schema(df.schema).parquet(at)
    out._staged_at = at
    return out


def dropped(df: DataFrame) -> None:
    """Deletes what ``staged`` wrote, once nothing reads it any more."""
    fs, at = _folder(df.sparkSession, df._staged_at)
    fs.delete(at, True)


def numbered(df: DataFrame, order: list[str], name: str = "number") -> DataFrame:
    """Adds ``name``: 0, 1, ... in the order of ``order``. One range shuffle sorts the rows, each partition numbers its own, and sums over the partitions' counts tell where each begins."""
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    at = F.monotonically_increasing_id()
    held = staged(df.repartitionByRange(parts, *order).sortWithinPartitions(*order).withColumn(name, at), "numbered")
    part = F.shiftright(name, 33).cast("int")
    begins, n = [], 0
    for r in held.groupBy(part.alias("part")).agg(F.count(F.lit(1)).alias("n")).orderBy("part").collect():  # a row for each partition
        begins.append((r["part"], n))
        n += r["n"]
    first = df.sparkSession.createDataFrame(begins, "_part int, _first long")
    inside = F.col(name).bitwiseAND(F.lit((1 << 33) - 1))
    return held.withColumn("_part", part).join(F.broadcast(first), "_part").withColumn(name, inside + F.col("_first")).drop("_part", "_first")


def _folder(spark: SparkSession, path: str):
    """(file system, path) of any store that Spark reads."""
    context = spark.sparkContext
    at = context._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(context._jsc.hadoopConfiguration()), at


def _names(spark: SparkSession, path: str) -> list[str]:
    fs, at = _folder(spark, path)
    return sorted(s.getPath().getName() for s in fs.listStatus(at)) if fs.exists(at) else []


class Result(NamedTuple):
    """What a write did: rows asked for, rows that are stored for them, errors by batch."""

    asked: int
    stored: int
    errors: tuple[str, ...] = ()

    @property
    def success(self) -> bool:
        return not self.errors and self.stored >= self.asked

    @property
    def success_rate(self) -> float:
        return 1.0 if not self.asked else round(self.stored / self.asked, 6)

    def __add__(self, other: Result) -> Result:
        return Result(self.asked + other.asked, self.stored + other.stored, self.errors + other.errors)


class Versions:
    """A table as a chain of immutable versions in a folder; every write makes the next one, readers keep theirs. A version without Spark's success mark does not count."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root

    @property
    def version(self) -> int:
        done = [int(n[1:]) for n in _names(self.spark, self.root) if n[:1] == "v" and n[1:].isdigit() and "_SUCCESS" in _names(self.spark, f"{self.root}/{n}")]
        return max(done, default=0)

    def path(self, version: int | None = None) -> str:
        return f"{self.root}/v{self.version if version is None else version}"

    def write(self, rows: DataFrame) -> DataFrame:
        at = self.path(self.version + 1)
        rows.write.mode("overwrite").parquet(at)  # over what a failed write left
        return self.spark.read.schema(rows.schema).parquet(at)

    def read(self, version: int | None = None) -> DataFrame:
        return self.spark.read.parquet(self.path(version))

    def drop(self) -> None:
        fs, at = _folder(self.spark, self.root)
        fs.delete(at, True)


STATE = "path string, hash string, size long, mtime double"


class State(Versions):
    """The file state of a collection: (path, hash, size, mtime), and the statistics of its runs beside it."""

    def load(self) -> DataFrame:
        """Empty where there is none, or where what is there cannot be read as a state."""
        try:
            found = self.read().select(F.col("path").cast("string"), F.col("hash").cast("string"), F.col("size").cast("long"), F.col("mtime").cast("double")) if self.version else None
        except AnalysisException:  # no Parquet files, or other columns
            found = None
        return found if found is not None else self.spark.createDataFrame([], STATE)

    def save_statistics(self, numbers: dict[str, float]) -> None:
        Versions(self.spark, f"{self.root}/_statistics").write(self.spark.createDataFrame([(k, float(v)) for k, v in numbers.items()], "name string, value double"))

    def statistics(self) -> dict[str, float]:
        kept = Versions(self.spark, f"{self.root}/_statistics")
        return {r["name"]: r["value"] for r in kept.read().collect()} if kept.version else {}  # a few numbers


class Collection(Versions):
    """A named table of points below a root, which is found again by its name. Points are keyed by ``id``; the last of equal keys wins."""

    def __init__(self, spark: SparkSession, name: str, root: str | None = None, metric: str = "cosine", sizes: dict[str, int] | None = None):
        """``sizes``: the lengths of the named vectors, as dense and sparse."""
        if metric not in METRICS:
            raise ValueError(f"metric must be one of {METRICS}")
        if not re.fullmatch(r"[\w.-]+", name):
            raise ValueError("a name has letters, digits, dots, dashes and underscores")
        super().__init__(spark, f"{root or shared_dir(spark) + '/collections'}/{name}")
        self.name, self.metric, self.sizes = name, metric, sizes or {}
        self.state = State(spark, f"{self.root}/state")
        self.cache = SearchCache()

    def write(self, rows: DataFrame) -> DataFrame:
        self.cache.clear()
        return super().write(rows)

    def upsert(self, rows: DataFrame, key: str = "id", order: str | None = None) -> DataFrame:
        """Stored rows with a new row's key give way to it; of new rows with one key the last by ``order`` stays, without it the one with the largest hash."""
        last = F.col(order) if order else F.xxhash64(*[F.to_json(F.struct(F.col(c))) for c in rows.columns])
        new = rows.withColumn("_r", F.row_number().over(Window.partitionBy(key).orderBy(F.desc(last)))).where("_r = 1").drop("_r")
        if not self.version:
            return self.write(new)
        return self.write(self.read().join(new.select(key), key, "left_anti").unionByName(new, allowMissingColumns=True))

    def reliable_upsert(self, rows: DataFrame, key: str = "id") -> Result:
        """As upsert, and counts what is stored of it afterwards. Lost tasks are tried again by Spark."""
        asked = rows.select(key).distinct()
        stored = self.upsert(rows, key).select(key)
        n = asked.count()
        return Result(n, stored.join(asked, key, "left_semi").count())

    def batch_upsert(self, batches: list[DataFrame], key: str = "id") -> Result:
        """One after the other; the error of one does not stop the rest."""
        total = Result(0, 0)
        for rows in batches:
            try:
                total += self.reliable_upsert(rows, key)
            except (AnalysisException, PySparkException) as e:
                total += Result(0, 0, (type(e).__name__,))
        return total

    def delete(self, ids: DataFrame, key: str = "id") -> DataFrame:
        return self.write(self.read().join(ids.select(key).distinct(), key, "left_anti"))

    def count(self) -> int:
        return self.read().count() if self.version else 0

    def scroll(self, conditions: dict[str, object] | None = None, limit: int | None = None, after: int | None = None, key: str = "id") -> DataFrame:
        """The rows that fit, by key, behind the key ``after``: a page is asked for by the last key of the one before, so that none is read twice or missed. Without ``limit`` all rows, unordered."""
        rows = payload_filter(self.read(), conditions or {})
        if after is not None:
            rows = rows.where(F.col(key) > after)
        return rows if limit is None else rows.orderBy(key).limit(limit)

    def clear(self, keep_manual: bool = True) -> DataFrame:
        """Leaves the rows a person wrote, or none; the state goes with the rest."""
        self.state.drop()
        rows = self.read()
        return self.write(clear_automatic(rows) if keep_manual else rows.where("false"))

    def info(self) -> dict[str, object]:
        return {"name": self.name, "metric": self.metric, "points": self.count(), "version": self.version, **{f"{k}_size": v for k, v in self.sizes.items()}, "has_sparse": "sparse" in self.sizes}


class SearchCache:
    """Results by what was asked; a write clears them. Entries are plans over staged tables, not rows."""

    def __init__(self, most: int = 1000):
        self.kept: dict[str, DataFrame] = {}
        self.most, self.hits = most, 0

    @staticmethod
    def key(**asked: object) -> str:
        return hashlib.md5(json.dumps(asked, sort_keys=True, default=str).encode()).hexdigest()

    def get(self, find: Callable[[], DataFrame], **asked: object) -> DataFrame:
        k = self.key(**asked)
        if k in self.kept:
            self.hits += 1
        else:
            if len(self.kept) >= self.most:
                self.kept.pop(next(iter(self.kept)))  # the oldest
            self.kept[k] = find()
        return self.kept[k]

    def clear(self) -> None:
        self.kept.clear()


class Catalog:
    """The collections below a root: made, found again, listed, dropped. What a collection is, is kept beside its versions."""

    def __init__(self, spark: SparkSession, root: str | None = None):
        self.spark, self.root = spark, root or f"{shared_dir(spark)}/collections"

    def names(self) -> list[str]:
        return [n for n in _names(self.spark, self.root) if "meta" in _names(self.spark, f"{self.root}/{n}")]

    def exists(self, name: str) -> bool:
        return name in self.names()

    def create(self, name: str, metric: str = "cosine", dense: int = 0, sparse: int = 0) -> Collection:
        """With named vectors of the lengths ``dense`` and ``sparse``, where they are not 0."""
        if self.exists(name):
            raise ValueError(f"{name} is there already")
        made = Collection(self.spark, name, self.root, metric, {k: v for k, v in (("dense", dense), ("sparse", sparse)) if v})
        self.spark.createDataFrame([(metric, dense, sparse)], "metric string, dense int, sparse int").coalesce(1).write.json(f"{made.root}/meta")
        return made

    def open(self, name: str) -> Collection:
        if not self.exists(name):
            raise KeyError(name)
        meta = self.spark.read.schema("metric string, dense int, sparse int").json(f"{self.root}/{name}/meta").first()
        return Collection(self.spark, name, self.root, meta["metric"], {k: meta[k] for k in ("dense", "sparse") if meta[k]})

    def ensure(self, name: str, **options) -> Collection:
        return self.open(name) if self.exists(name) else self.create(name, **options)

    def drop(self, name: str) -> bool:
        """Whether there was one."""
        there = self.exists(name)
        if there:
            self.open(name).drop()
        return there


def store(spark: SparkSession, config: dict[str, str]) -> Catalog:
    """The store that a configuration names: ``backend`` and its ``root``."""
    if config.get("backend", "parquet") not in BACKENDS:
        raise ValueError(f"backend must be one of {sorted(BACKENDS)}")
    return BACKENDS[config.get("backend", "parquet")](spark, config.get("root"))


BACKENDS: dict[str, Callable[..., Catalog]] = {"parquet": Catalog}


def files(spark: SparkSession, path: str, globs: str = "*") -> DataFrame:
    """(file, text, length, modified) of the files below a folder."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", globs).load(path)
    return found.select(F.col("path").alias("file"), F.col("content").cast("string").alias("text"), "length", F.col("modificationTime").alias("modified"))


def modified_since(found: DataFrame, state: DataFrame) -> DataFrame:
    """Files newer than the latest time in the state, which is one number; all of them where the state is empty or knows none of the files (it is of another tree)."""
    last = state.join(found.select(F.col("file").alias("path")), "path", "left_semi").agg(F.max("mtime").alias("last"))
    return found.join(F.broadcast(last)).where(F.col("last").isNull() | (F.col("modified").cast("double") > F.col("last"))).drop("last")


def snapshot(found: DataFrame) -> DataFrame:
    """(path, hash, size, mtime) of files: what a state keeps."""
    text = F.coalesce(F.col("text"), F.lit(""))
    mtime = F.col("modified").cast("double") if "modified" in found.columns else F.lit(0.0)
    return found.select(F.col("file").alias("path"), F.sha2(text, 256).alias("hash"), F.octet_length(text).cast("long").alias("size"), mtime.alias("mtime"))


def saved_state(texts: DataFrame) -> DataFrame:
    """(id, path, hash) of state files in JSON, in either layout: files by path, or such a map under ``files``; keys that start with ``_`` are metadata. A corrupt text is empty. ``texts``: id, json."""
    entry = "map<string,struct<hash:string>>"
    nested = F.from_json(F.get_json_object("json", "$.files"), entry)
    flat = F.map_filter(F.from_json("json", entry), lambda k, _: ~k.startswith("_"))
    entries = F.when(F.get_json_object("json", "$.files").isNotNull(), nested).otherwise(flat)
    return texts.select("id", F.explode(entries).alias("path", "entry")).select("id", "path", F.col("entry.hash").alias("hash"))


def chat_lines(spark: SparkSession, path: str) -> DataFrame:
    """(id, json): the lines of chat logs, numbered within the read."""
    return spark.read.text(path).select(F.monotonically_increasing_id().alias("id"), F.col("value").alias("json"))


def chat_files(spark: SparkSession, path: str, most: int | None = None) -> DataFrame:
    """(file, modified) of the chat logs below a folder, newest first; the ``most`` newest, if given."""
    found = files(spark, path, "*.jsonl").select("file", "modified").orderBy(F.desc("modified"), "file")
    return found if most is None else found.limit(most)


def conversations(spark: SparkSession, path: str, most: int | None = None) -> DataFrame:
    """(conv_id, turn, role, text) of the chat logs below a folder, of the ``most`` newest files, if given: one conversation a file, malformed lines skipped, empty ones left out."""
    wanted = chat_files(spark, path, most)
    lines = files(spark, path, "*.jsonl").join(wanted.select("file"), "file", "left_semi").select("file", F.posexplode(F.split("text", "\n")).alias("turn", "json"))
    said = normalized(lines.select(F.struct("file", "turn").alias("id"), "json"))
    name = F.regexp_extract("id.file", r"([^/]+)\.jsonl$", 1)
    return said.select(name.alias("conv_id"), F.col("id.turn").cast("long").alias("turn"), "role", F.col("content").alias("text"))
