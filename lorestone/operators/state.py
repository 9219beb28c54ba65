"""Incremental state: file and entity differences, upserts, deletions, merges. Tables are immutable; each function returns the new one."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def difference(before: DataFrame, now: DataFrame, keys: list[str], hash_col: str = "hash") -> DataFrame:
    """(keys, change): added, removed, modified or unchanged, by one full outer join. Keys that start with ``_`` are metadata and skipped."""
    plain = lambda df: df.where(~F.col(keys[0]).cast("string").startswith("_"))
    both = plain(before).select(*keys, F.col(hash_col).alias("_b"), F.lit(True).alias("_in_b")).join(plain(now).select(*keys, F.col(hash_col).alias("_n"), F.lit(True).alias("_in_n")), keys, "full_outer")
    change = F.when(F.col("_in_b").isNull(), "added").when(F.col("_in_n").isNull(), "removed").when(F.col("_b").eqNullSafe(F.col("_n")), "unchanged").otherwise("modified")
    return both.select(*keys, change.alias("change"))


def upsert(stored: DataFrame, rows: DataFrame, key: str, order: str) -> DataFrame:
    """Stored rows replaced by rows of the same key; of several new ones the last by ``order``."""
    last = rows.withColumn("_r", F.row_number().over(Window.partitionBy(key).orderBy(F.desc(order)))).where("_r = 1").drop("_r", order)
    return stored.join(last, key, "left_anti").unionByName(last)


def delete(stored: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    return stored.join(ids.select(key).distinct(), key, "left_anti")


def merge_state(stored: DataFrame, processed: DataFrame, deleted: DataFrame) -> DataFrame:
    """The file state after a run: old entries overwritten by path, deleted ones gone."""
    kept = stored.join(processed.select("path"), "path", "left_anti").unionByName(processed)
    return kept.join(deleted.select("path"), "path", "left_anti")


def new_content(rows: DataFrame, stored: DataFrame) -> DataFrame:
    """Rows whose content hash is not stored yet, one for each hash (the smallest id)."""
    fresh = rows.join(stored.select("content_hash").distinct(), "content_hash", "left_anti")
    return fresh.withColumn("_r", F.row_number().over(Window.partitionBy("content_hash").orderBy("id"))).where("_r = 1").drop("_r")


def keep_first(rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    return rows.withColumn("_r", F.row_number().over(Window.partitionBy(*keys).orderBy(order))).where("_r = 1").drop("_r")


def compare_sets(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """(key, side): left, right or both."""
    both = left.select(key).distinct().withColumn("_l", F.lit(1)).join(right.select(key).distinct().withColumn("_r", F.lit(1)), key, "full_outer")
    return both.select(key, F.when(F.col("_r").isNull(), "left").when(F.col("_l").isNull(), "right").otherwise("both").alias("side"))


def vectored_delta(before: DataFrame, now: DataFrame, processed: DataFrame, key: str) -> DataFrame:
    """(key, change): new, deleted, or modified (processed and in both)."""
    sides = compare_sets(before, now, key)
    touched = processed.select(key).distinct().withColumn("_p", F.lit(True))
    change = F.when(F.col("side") == "right", "new").when(F.col("side") == "left", "deleted").when(F.col("_p"), "modified")
    return sides.join(touched, key, "left").select(key, change.alias("change")).where("change IS NOT NULL")


#: Fields that only automation writes. Fixed values.
AUTOMATION_FIELDS = ("line_number", "ast_data", "signature", "docstring", "full_name", "ast_type", "start_line", "end_line", "source_hash", "parsed_at")


def manual(rows: DataFrame) -> DataFrame:
    """Rows a person wrote: no file path, no relation target, no automation field, a name, a type and some content. ``rows``: fields array and named columns."""
    written = ~F.exists("fields", lambda f: f.isin(*AUTOMATION_FIELDS))
    filled = lambda c: F.coalesce(F.trim(c) != "", F.lit(False))
    return rows.where(F.col("file_path").isNull() & F.col("relation_target").isNull() & written & filled("entity_name") & filled("entity_type") & filled("content"))


def clear_automatic(rows: DataFrame) -> DataFrame:
    """The rows that stay when a collection is cleared: those without a file path that are no relation."""
    return rows.where(F.col("file_path").isNull() & F.col("relation_target").isNull())


def missing_metadata(chunks: DataFrame) -> DataFrame:
    """Implementation rows without a metadata row of the same file, type and name."""
    keys = ["file_path", "entity_type", "entity_name"]
    return chunks.where("chunk_type = 'implementation'").join(chunks.where("chunk_type = 'metadata'").select(*keys).distinct(), keys, "left_anti").select(*keys)


def replace_changed(stored: DataFrame, fresh: DataFrame, changed: DataFrame) -> DataFrame:
    """Stored metadata and implementation rows of changed entities give way to the fresh ones, whether or not their content is stored; other fresh rows are added if their content is new for them.

    ``changed``: file_path, entity_name. Rows: id, file_path, entity_name, chunk_type, content_hash.
    """
    keys = ["file_path", "entity_name"]
    touched = changed.select(*keys).distinct()
    chunk = F.col("chunk_type").isin("metadata", "implementation")
    kept = stored.where(~chunk).unionByName(stored.where(chunk).join(touched, keys, "left_anti").select(*stored.columns))
    new = fresh.join(touched, keys, "left_semi").select(*stored.columns)
    rest = fresh.join(touched, keys, "left_anti").join(kept.select("id", "content_hash"), ["id", "content_hash"], "left_anti").select(*stored.columns)
    added = new.unionByName(rest).dropDuplicates(["id"])
    return kept.join(added.select("id"), "id", "left_anti").unionByName(added)


def known_names(rows: DataFrame) -> DataFrame:
    """(name) of stored rows; a row of grouped sections stands for each of its headers too. ``rows``: entity_name, headers."""
    return rows.select(F.explode(F.array_union(F.array("entity_name"), F.coalesce("headers", F.array().cast("array<string>")))).alias("name")).where("name <> ''").distinct()


def of_file(rows: DataFrame, path: str) -> DataFrame:
    """Rows of a file: those with its path, and its own entity by name."""
    return rows.where((F.col("file_path") == path) | (F.col("entity_name") == path))


def of_file_by_two_searches(rows: DataFrame, path: str, key: str = "id") -> DataFrame:
    """The same from two searches, each row once, as stores without an OR give it."""
    return rows.where(F.col("file_path") == path).unionByName(rows.where(F.col("entity_name") == path)).dropDuplicates([key])


def by_chunk_type(rows: DataFrame) -> DataFrame:
    """(chunk_type, entities): the rows of one file as lists of (id, entity_name) by chunk type."""
    return rows.groupBy("chunk_type").agg(F.sort_array(F.collect_list(F.struct("id", "entity_name"))).alias("entities"))


def recorded_files(payloads: DataFrame, root: str) -> DataFrame:
    """(path) of file entities in either payload layout, relative to ``root``. ``payloads``: json."""
    from lorestone.operators.builders import relative_path

    at = lambda p: F.get_json_object("json", p)
    kind = F.coalesce(at("$.entity_type"), at("$.metadata.entity_type"))
    return payloads.where((kind == "file") & (at("$.metadata.file_path") != "")).select(relative_path(at("$.metadata.file_path"), root).alias("path")).distinct()


def relation_hashes(relations: DataFrame) -> DataFrame:
    """(file_path, hashes): for every file the map from its relations' ids to their content hashes. ``relations``: file_path, id, content_hash."""
    return relations.groupBy("file_path").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("id", "content_hash")))).alias("hashes"))


def probe(names: DataFrame, stored: DataFrame) -> DataFrame:
    """Adds ``exists``: whether an entity has a metadata row. ``names``: entity_name."""
    there = stored.where("chunk_type = 'metadata'").select("entity_name").distinct().withColumn("_e", F.lit(True))
    return names.join(there, "entity_name", "left").withColumn("exists", F.coalesce("_e", F.lit(False))).drop("_e")


def should_process(files: DataFrame, batch: str) -> DataFrame:
    """(batch, files, unchanged, should_process): a batch is worked on if fewer files are unchanged than it has. ``files``: old and new hashes."""
    same = F.count(F.when(F.col("old").eqNullSafe(F.col("new")) & F.col("new").isNotNull(), 1))
    return files.groupBy(batch).agg(F.count(F.lit(1)).alias("files"), same.alias("unchanged")).withColumn("should_process", F.col("unchanged") < F.col("files"))
