"""Composite plans: what changed since the last run is extracted, what vanished is deleted, the rest is stored by content; then relations that lost an end go."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lorestone.functions.text import chunk_id, content_hash, point_id
from lorestone.operators.extract import extract
from lorestone.operators.graph import hash_orphans, orphans, phantom_calls, pre_storage_filter
from lorestone.operators.rows import keyword_text
from lorestone.operators.state import difference, merge_state
from lorestone.sources.store import Collection, snapshot

Embedder = Callable[[DataFrame], DataFrame]  # (content_hash, content) to (content_hash, vector)


def points(files: DataFrame) -> DataFrame:
    """(id, chunk_id, file_path, entity_name, entity_type, relation_target, chunk_type, content, content_bm25, content_hash) of all entities, relations and chunks.

    The id comes from the chunk id alone, so it outlives a move within the file; the second and later points of one chunk id in a file are told apart by their order.
    """
    rows = extract(files).where("row <> 'error'")
    kind = F.when(F.col("row") == "entity", "metadata").when(F.col("row") == "relation", "relation").when(F.col("kind") == "metadata", "metadata").otherwise("implementation")
    target = F.when(F.col("row") == "relation", F.col("other"))
    observations = F.coalesce(F.from_json(F.when(F.col("row") == "entity", F.col("detail")), "array<string>"), F.array().cast("array<string>"))
    described = F.when(F.size(observations) > 0, F.array_join(observations, " | ")).otherwise(F.concat_ws("::", "name", "kind", "other"))
    key = chunk_id(F.col("file"), F.col("kind"), F.concat_ws("->", F.col("name"), target), kind)
    keyword = F.when(kind == "metadata", keyword_text(F.col("name"), F.col("kind"), F.col("file"), observations))  # keyword search is over metadata alone
    out = rows.select(key.alias("chunk_id"), "line", F.col("file").alias("file_path"), F.col("name").alias("entity_name"), F.col("kind").alias("entity_type"), target.alias("relation_target"), kind.alias("chunk_type"), F.coalesce("content", described).alias("content"), keyword.alias("content_bm25"))
    of_file = Window.partitionBy("file_path", "chunk_id").orderBy("line", "content")  # one chunk id in one file
    out = out.withColumn("_n", F.row_number().over(of_file))
    key = F.when(F.col("_n") == 1, F.col("chunk_id")).otherwise(F.concat_ws("::", "chunk_id", F.col("_n").cast("string")))
    return out.select(point_id(key).alias("id"), key.alias("chunk_id"), *out.columns[2:-1]).withColumn("content_hash", content_hash(F.col("content")))


def with_vectors(fresh: DataFrame, stored: DataFrame | None, embed: Embedder) -> DataFrame:
    """Adds ``vector``: that of a stored row of the same content, else one that ``embed`` makes, once for each content."""
    contents = fresh.groupBy("content_hash").agg(F.first("content").alias("content"))
    if stored is None or "vector" not in stored.columns:
        made = embed(contents)
    else:
        kept = stored.groupBy("content_hash").agg(F.first("vector").alias("vector"))
        made = embed(contents.join(kept, "content_hash", "left_anti")).unionByName(kept)
    return fresh.join(made, "content_hash", "left")


def changes(collection: Collection, files: DataFrame) -> DataFrame:
    """(path, change) of the files against the collection's state."""
    return difference(collection.state.load(), snapshot(files), ["path"])


def index(collection: Collection, files: DataFrame, embed: Embedder | None = None, full: bool = False, partial: bool = False) -> DataFrame:
    """The points after a run over the files of a tree, all of them; with ``partial`` over some, where a missing file is not a deleted one.

    Only files that are new or changed are extracted (all with ``full``). Points of theirs that vanished and points of deleted files go; the same content in two files
    is stored for each, its vector made once. A run in which no file changed writes nothing.
    """
    state = snapshot(files)
    change = changes(collection, files)
    gone = change.where("change = 'removed'").select("path") if not partial else change.where("false").select("path")
    touched = change.where("change <> 'removed'" if full else "change IN ('added', 'modified')").select("path")
    if collection.version and not full and touched.isEmpty() and gone.isEmpty():
        return collection.read()
    fresh = points(files.join(touched.select(F.col("path").alias("file")), "file", "left_semi"))
    stored = collection.read() if collection.version else None
    if embed:
        fresh = with_vectors(fresh, stored, embed)
    if stored is not None:
        replaced = touched.unionAll(gone).select(F.col("path").alias("file_path"))
        fresh = stored.join(replaced, "file_path", "left_anti").unionByName(fresh, allowMissingColumns=True)
    collection.write(resolved(fresh))
    merged = merge_state(collection.state.load(), state.join(touched, "path", "left_semi"), gone)
    collection.state.write(merged)
    out = collection.read()
    collection.state.save_statistics({"points": float(out.count()), "files": float(collection.state.read().count())})
    return out


def index_file(collection: Collection, file: DataFrame, embed: Embedder | None = None) -> DataFrame:
    """One file, or a few, of a tree that is indexed already; an early exit if its hash is the stored one."""
    return index(collection, file, embed, partial=True)


def delete_files(collection: Collection, paths: DataFrame) -> DataFrame:
    """The points and the state of deleted files (path) go, then the relations that lost an end."""
    out = collection.write(resolved(collection.read().join(paths.select(F.col("path").alias("file_path")), "file_path", "left_anti")))
    collection.state.write(collection.state.load().join(paths.select("path"), "path", "left_anti"))
    return out


def should_process(change: DataFrame) -> bool:
    """Whether a run has anything to do: fewer files unchanged than there are."""
    n = change.agg(F.count(F.lit(1)).alias("all"), F.count(F.when(F.col("change") == "unchanged", 1)).alias("same")).first()
    return n["same"] < n["all"]


def resolved(rows: DataFrame) -> DataFrame:
    """The points without relations that nothing resolves."""
    relation = F.col("chunk_type") == "relation"
    names = rows.where(~relation).select(F.col("entity_name").alias("name")).distinct()
    relations = rows.where(relation).select(F.col("entity_name").alias("src"), F.col("relation_target").alias("dst"), F.col("entity_type").alias("kind")).distinct()
    code = rows.where("chunk_type = 'implementation'").select("entity_name", "content")
    kept = cleanup(pre_storage_filter(relations, names), names, code)
    same = F.col("entity_name").eqNullSafe(F.col("src")) & F.col("relation_target").eqNullSafe(F.col("dst")) & F.col("entity_type").eqNullSafe(F.col("kind"))
    return rows.where(~relation).unionByName(rows.where(relation).join(kept, same, "left_semi"))


def graph(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Names and the relations worth storing."""
    rows = extract(files)
    names = rows.where("row = 'entity'").select("name").distinct()
    relations = rows.where("row = 'relation'").select(F.col("name").alias("src"), F.col("other").alias("dst"), "kind").distinct()
    return names, pre_storage_filter(relations, names)


def cleanup(relations: DataFrame, names: DataFrame, code: DataFrame | None = None) -> DataFrame:
    """The relations that stay after both steps: of those with an unknown end the ones that nothing resolves go; then calls that the code of their source does not make. ``code``: entity_name, content."""
    lost = orphans(hash_orphans(relations, names), names)
    kept = relations.join(lost, ["src", "dst", "kind"], "left_anti")
    if code is None:
        return kept
    calls = kept.where("kind = 'calls'")
    phantom = phantom_calls(calls, code)
    return kept.where("kind <> 'calls'").unionByName(calls.join(phantom, ["src", "dst"], "left_anti").select(*kept.columns))
