"""Joins over entity, relation and chunk tables: orphans, module resolution, phantom calls, scopes, degrees.

Every test is an equi join, semi join or anti join on names; suffix and dotted-name resolution is turned into keys first.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Extensions of files that may be the target of a relation without being indexed. Fixed values.
EXTERNAL_EXTENSIONS = ("json", "csv", "txt", "xml", "yaml", "yml", "xlsx", "xls", "ini", "toml", "html", "css", "log", "md", "pdf", "doc", "docx", "png", "jpg", "jpeg", "gif", "svg", "bin", "dat")


def external_file(name):
    return F.lower(F.element_at(F.split(name, r"\."), -1)).isin(*EXTERNAL_EXTENSIONS) & name.contains(".")


def hash_orphans(relations: DataFrame, names: DataFrame) -> DataFrame:
    """Relations with an end that is no entity. ``relations``: src, dst, ...; ``names``: name."""
    known = names.select("name").distinct()
    here = relations.join(known.withColumnsRenamed({"name": "src"}).withColumn("_s", F.lit(True)), "src", "left").join(known.withColumnsRenamed({"name": "dst"}).withColumn("_d", F.lit(True)), "dst", "left")
    return here.where(F.col("_s").isNull() | F.col("_d").isNull()).select(*relations.columns)


def module_keys(names: DataFrame) -> DataFrame:
    """(key, name): every way a Python file can be imported: its path, its dotted suffixes, its base name."""
    stem = F.regexp_replace("name", r"(/__init__)?\.py$", "")
    parts = F.split(stem, "/")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts) - i + 1), "."))
    files = names.where(F.col("name").endswith(".py"))
    return files.select(F.explode(F.array_distinct(suffixes)).alias("key"), "name").where("key <> ''").distinct()


def resolve_imports(imports: DataFrame, names: DataFrame) -> DataFrame:
    """Adds ``resolved`` to (src, dst): the target is an entity, a file reachable by a dotted suffix, or a relative name of one."""
    exact = names.select(F.col("name").alias("dst")).distinct().withColumn("_e", F.lit(True))
    keys = module_keys(names).select(F.col("key").alias("_key")).distinct().withColumn("_m", F.lit(True))
    wanted = imports.withColumn("_key", F.regexp_replace("dst", r"^\.+", ""))
    out = wanted.join(exact, "dst", "left").join(keys, "_key", "left")
    return out.withColumn("resolved", F.coalesce("_e", "_m", F.lit(False))).select(*imports.columns, "resolved")


def pre_storage_filter(relations: DataFrame, names: DataFrame) -> DataFrame:
    """Relations worth storing: calls with a known target, imports that resolve, all others."""
    known = names.select(F.col("name").alias("dst")).distinct()
    calls = relations.where("kind = 'calls'").join(known, "dst", "left_semi")
    imports = resolve_imports(relations.where("kind = 'imports'"), names).where("resolved").drop("resolved")
    return relations.where("kind NOT IN ('calls', 'imports')").unionByName(calls).unionByName(imports)


def orphans(relations: DataFrame, names: DataFrame) -> DataFrame:
    """Relations to delete: an unresolved source, or a target that is neither an entity nor resolvable nor an external file."""
    known = names.select(F.col("name").alias("src")).distinct()
    lost = relations.join(known, "src", "left_anti")
    kept = resolve_imports(relations.join(known, "src", "left_semi"), names)
    return lost.unionByName(kept.where(~F.col("resolved") & ~external_file(F.col("dst"))).drop("resolved"))


def phantom_calls(calls: DataFrame, implementations: DataFrame) -> DataFrame:
    """Calls whose source has implementation rows, none of which has ``target(`` ahead of a ``#`` on any line. ``implementations``: entity_name, content."""
    pairs = calls.select("src", "dst").distinct().join(implementations.select(F.col("entity_name").alias("src"), "content"), "src")
    found = F.exists(F.split("content", "\n"), lambda line: F.contains(F.substring_index(line, "#", 1), F.concat(F.col("dst"), F.lit("("))))
    return pairs.groupBy("src", "dst").agg(F.max(found).alias("found")).where("NOT found").select("src", "dst")


def changed_relations(relations: DataFrame, changed: DataFrame) -> DataFrame:
    """Relations with an end that is a changed id, or that ends in ``::`` and one. ``changed``: id."""
    ids = changed.select("id").distinct()
    last = lambda c: F.element_at(F.split(c, "::"), -1)
    ends = relations.withColumn("_id", F.explode(F.array_distinct(F.array("src", last("src"), "dst", last("dst")))))
    return ends.join(ids, ends["_id"] == ids["id"], "left_semi").drop("_id").distinct()


def degrees(relations: DataFrame) -> DataFrame:
    """(name, in_degree, out_degree)."""
    ends = relations.select(F.explode(F.array(F.struct(F.col("src").alias("name"), F.lit(0).alias("i"), F.lit(1).alias("o")), F.struct(F.col("dst").alias("name"), F.lit(1).alias("i"), F.lit(0).alias("o")))).alias("e")).select("e.*")
    return ends.groupBy("name").agg(F.sum("i").alias("in_degree"), F.sum("o").alias("out_degree"))


def smart_view(nodes: DataFrame, relations: DataFrame, per_type: int) -> DataFrame:
    """The most important entities of each type: public names count 5, each reference 3; ties by name."""
    scored = nodes.join(degrees(relations), "name", "left").withColumn("priority", F.when(F.col("name").startswith("_"), 0).otherwise(5) + 3 * F.coalesce("in_degree", F.lit(0)))
    order = Window.partitionBy("entity_type").orderBy(F.desc("priority"), "name")
    return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= per_type).select("entity_type", "rank", "name", F.col("priority").cast("long").alias("priority"))


def implementation_scope(chunks: DataFrame, names: DataFrame, scope: str, most: int) -> DataFrame:
    """Implementation rows for each asked name. minimal: the rows of that name; logical: and those of the same file that it calls; dependencies: and those it calls or imports anywhere.

    ``chunks``: entity_name, file_path, calls, imports_used; ``names``: name. The most first ones by name stay, the asked one always first.
    """
    own = chunks.join(names.withColumnRenamed("name", "entity_name"), "entity_name", "left_semi")
    found = own.select(F.col("entity_name").alias("asked"), "entity_name", "file_path", F.lit(0).alias("hop"))
    if scope != "minimal":
        wanted = F.col("calls") if scope == "logical" else F.array_union("calls", "imports_used")
        hops = own.select(F.col("entity_name").alias("asked"), F.col("file_path").alias("_file"), F.explode(wanted).alias("_name"))
        other = chunks.select("entity_name", "file_path").join(hops, F.col("entity_name") == F.col("_name"))
        if scope == "logical":
            other = other.where("file_path = _file")
        found = found.unionByName(other.select("asked", "entity_name", "file_path", F.lit(1).alias("hop")))
    found = found.groupBy("asked", "entity_name", "file_path").agg(F.min("hop").alias("hop"))
    order = Window.partitionBy("asked").orderBy("hop", "entity_name", "file_path")
    return found.withColumn("rank", F.row_number().over(order)).where((F.col("hop") == 0) | (F.col("rank") <= most)).select("asked", "entity_name", "file_path", "hop")


def components(edges: DataFrame, keep) -> DataFrame:
    """(id, component): the smallest id that can be reached, for every end of the edges (a, b). Stars are hung to smaller ones until nothing changes; ``keep`` writes a pass out and reads it back."""
    now = keep(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    before = None
    while True:
        state = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == before or not state[0]:
            ends = now.select(F.col("u").alias("id"), F.col("v").alias("component")).unionAll(now.select(F.col("v").alias("id"), F.col("v").alias("component")))
            return ends.groupBy("id").agg(F.min("component").alias("component"))
        before = state
        both = now.unionAll(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        now = keep(large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").unionAll(least.select("u", F.col("m").alias("v"))).distinct())
