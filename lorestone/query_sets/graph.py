"""Graph and state queries over the star schema seen as a knowledge graph, and over small literal tables where the schema has no counterpart."""

from __future__ import annotations

from pyspark.sql import functions as F

from lorestone.operators import graph as G
from lorestone.operators import state as S
from lorestone.sources.tables import chunks, contains_edges, nodes, table

EDGES = """(SELECT 'c' || o_custkey AS src, 'o' || o_orderkey AS dst, 'contains' AS kind FROM orders
UNION ALL SELECT 'o' || l_orderkey, 'p' || l_partkey, 'references' FROM lineitem UNION ALL SELECT 'p' || l_partkey, 's' || l_suppkey, 'imports' FROM lineitem)"""
NODES = """(SELECT 'c' || c_custkey AS name, 'class' AS entity_type FROM customer UNION ALL SELECT 'o' || o_orderkey, 'function' FROM orders
UNION ALL SELECT 'p' || p_partkey, 'file' FROM part UNION ALL SELECT 's' || s_suppkey, 'module' FROM supplier)"""

#: (src, dst, kind) and names of a small source tree. Every row stands in both engines.
RELATIONS = (
    ("app.main", "load", "calls"), ("app.main", "missing", "calls"), ("app.main", "pkg.util.load", "imports"), ("app.main", ".util", "imports"), ("app.main", "util.load", "imports"),
    ("app.main", "numpy", "imports"), ("app.main", "data/settings.json", "imports"), ("gone", "load", "calls"), ("load", "app.main", "calls"), ("a::load", "b::run", "references"), ("load", "run", "references"),
)
NAMES = ("app.main", "load", "run", "pkg/util/load.py", "pkg/util/__init__.py", "src/util.py", "README.md")
CODE = (
    ("app.main", "src/app.py", "x = load(1)\n# missing(2)\nreturn x", ["load", "run"], ["pkg.helper"]),
    ("load", "src/app.py", "def load(n):\n    return run (n)  # app.main(", ["app.main"], []),
    ("run", "src/run.py", "def run(n):\n    return n", [], []),
    ("pkg.helper", "pkg/helper.py", "def helper(): pass", ["load"], ["run"]),
)


def _rows(spark, rows, schema):
    return spark.createDataFrame([tuple(r) for r in rows], schema)


def relations(spark):
    return _rows(spark, RELATIONS, "src string, dst string, kind string")


def names(spark):
    return _rows(spark, [(n,) for n in NAMES], "name string")


def code(spark):
    return _rows(spark, CODE, "entity_name string, file_path string, content string, calls array<string>, imports_used array<string>")


def _q(v):
    if isinstance(v, list):
        return "[" + ", ".join(map(_q, v)) + "]::VARCHAR[]"
    return "NULL" if v is None else "'" + v.replace("'", "''") + "'" if isinstance(v, str) else str(v)


def values(rows, columns: str) -> str:
    return "(SELECT * FROM (VALUES " + ", ".join("(" + ", ".join(map(_q, r)) + ")" for r in rows) + f") AS v({columns}))"


REL = values(RELATIONS, "src, dst, kind")
NAM = values([(n,) for n in NAMES], "name")
COD = values(CODE, "entity_name, file_path, content, calls, imports_used")
RESOLVED = f"""(SELECT r.*, (dst IN (SELECT name FROM {NAM}) OR regexp_replace(dst, '^\\.+', '') IN (
  SELECT unnest(list_transform(range(1, len(p) + 1), lambda i: array_to_string(p[i:], '.'))) FROM (SELECT string_split(regexp_replace(name, '(/__init__)?\\.py$', ''), '/') AS p FROM {NAM} WHERE suffix(name, '.py')))) AS resolved FROM {REL} r)"""
EXT = "(contains(dst, '.') AND lower(string_split(dst, '.')[-1]) IN (" + ", ".join(f"'{e}'" for e in G.EXTERNAL_EXTENSIONS) + "))"


def orphan_relations(spark, sf_dir):
    """References to parts of an odd id are taken as lost entities."""
    known = nodes(spark, sf_dir).where("entity_type <> 'file' OR CAST(substring(name, 2) AS BIGINT) % 2 = 0")
    return G.hash_orphans(contains_edges(spark, sf_dir), known).groupBy("kind").agg(F.count(F.lit(1)).alias("orphans"), F.countDistinct("dst").alias("targets"))


def orphan_cleanup(spark, sf_dir):
    return G.orphans(relations(spark), names(spark)).select("src", "dst", "kind")


def module_resolution(spark, sf_dir):
    return G.resolve_imports(relations(spark), names(spark))


def pre_storage_orphan_filter(spark, sf_dir):
    return G.pre_storage_filter(relations(spark), names(spark)).select("src", "dst", "kind")


def phantom_calls(spark, sf_dir):
    return G.phantom_calls(relations(spark).where("kind = 'calls'"), code(spark))


def changed_relations(spark, sf_dir):
    return G.changed_relations(relations(spark), names(spark).where("name IN ('load', 'README.md')").withColumnRenamed("name", "id")).select("src", "dst", "kind")


def calls_from_chunks(spark, sf_dir):
    """Calls named in chunks whose target is an entity."""
    return code(spark).select(F.col("entity_name").alias("src"), F.explode("calls").alias("dst")).join(names(spark).withColumnRenamed("name", "dst"), "dst", "left_semi").select("src", "dst").distinct()


def scoped(scope, most):
    return lambda spark, sf_dir: G.implementation_scope(code(spark), _rows(spark, [("app.main",), ("run",)], "name string"), scope, most)


def scope_sql(wanted: str, same_file: bool) -> str:
    hop = "" if wanted == "" else f" UNION ALL SELECT a.entity_name, b.entity_name, b.file_path, 1 FROM c a JOIN c b ON list_contains({wanted}, b.entity_name) {'AND a.file_path = b.file_path' if same_file else ''} WHERE a.entity_name IN ('app.main', 'run')"
    return f"WITH c AS {COD}, f AS (SELECT entity_name AS asked, entity_name, file_path, 0 AS hop FROM c WHERE entity_name IN ('app.main', 'run'){hop}) SELECT asked, entity_name, file_path, min(hop) AS hop FROM f GROUP BY ALL"


def graph_degrees(spark, sf_dir):
    return G.degrees(contains_edges(spark, sf_dir))


def graph_smart(spark, sf_dir):
    return G.smart_view(nodes(spark, sf_dir), contains_edges(spark, sf_dir), 20)


def graph_relationships(spark, sf_dir):
    """Edges that touch suppliers of one nation, by a semi join."""
    some = table(spark, sf_dir, "supplier").where("s_nationkey = 3").select(F.concat(F.lit("s"), F.col("s_suppkey").cast("string")).alias("dst"))
    return contains_edges(spark, sf_dir).join(some, "dst", "left_semi").groupBy("src", "dst", "kind").agg(F.count(F.lit(1)).alias("edges"))


def graph_type_breakdown(spark, sf_dir):
    return nodes(spark, sf_dir).groupBy("entity_type").agg(F.count(F.lit(1)).alias("entities"))


# state
BEFORE = "SELECT doc_id AS path, sha256(text) AS hash FROM documents WHERE doc_id % 7 <> 3"
NOW = "SELECT doc_id AS path, sha256(CASE WHEN doc_id % 5 = 0 THEN text || '!' ELSE text END) AS hash FROM documents WHERE doc_id % 11 <> 4"


def _before(spark, sf_dir):
    return table(spark, sf_dir, "documents").where("doc_id % 7 <> 3").select(F.col("doc_id").alias("path"), F.sha2("text", 256).alias("hash"))


def _now(spark, sf_dir):
    return table(spark, sf_dir, "documents").where("doc_id % 11 <> 4").select(F.col("doc_id").alias("path"), F.sha2(F.when(F.col("doc_id") % 5 == 0, F.concat("text", F.lit("!"))).otherwise(F.col("text")), 256).alias("hash"))


def state_diff(spark, sf_dir):
    return S.difference(_before(spark, sf_dir), _now(spark, sf_dir), ["path"])


def diff_sketch(spark, sf_dir):
    return state_diff(spark, sf_dir).groupBy("change").agg(F.count(F.lit(1)).alias("entities"), F.min("path").alias("first"))


DIFF = f"(SELECT path, CASE WHEN b.hash IS NULL THEN 'added' WHEN n.hash IS NULL THEN 'removed' WHEN b.hash = n.hash THEN 'unchanged' ELSE 'modified' END AS change FROM ({BEFORE}) b FULL JOIN ({NOW}) n USING (path))"


def set_compare(spark, sf_dir):
    return S.compare_sets(_before(spark, sf_dir), _now(spark, sf_dir), "path")


def vectored_delta(spark, sf_dir):
    touched = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("path"))
    return S.vectored_delta(_before(spark, sf_dir), _now(spark, sf_dir), touched, "path")


def upsert_merge(spark, sf_dir):
    """New versions of every fifth document and one more of every tenth replace what is stored."""
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.length("text").alias("n"))
    fresh = docs.where("id % 5 = 0").select("id", (F.col("n") + 1).alias("n"), F.lit(1).alias("at")).unionByName(docs.where("id % 10 = 0").select((F.col("id")).alias("id"), (F.col("n") + 2).alias("n"), F.lit(2).alias("at")))
    return S.upsert(docs, fresh, "id", "at")


def delete_points(spark, sf_dir):
    gone = table(spark, sf_dir, "labels").where("quality = 0").select("doc_id")
    return S.delete(table(spark, sf_dir, "documents").select("doc_id", "lang"), gone, "doc_id")


def state_merge(spark, sf_dir):
    return S.merge_state(_before(spark, sf_dir), _now(spark, sf_dir).where("path % 3 = 0"), table(spark, sf_dir, "labels").where("toxic = 1").select(F.col("doc_id").alias("path")))


def content_hash_dedup(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.sha2("text", 256).alias("content_hash"))
    return S.new_content(rows, rows.where("id % 10 = 0").select("content_hash"))


def exact_duplicates(spark, sf_dir):
    return table(spark, sf_dir, "documents").groupBy(F.sha2("text", 256).alias("content_hash")).agg(F.count(F.lit(1)).alias("copies"), F.min("doc_id").alias("first")).where("copies > 1")


def relation_keep_first(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_linenumber")
    return S.keep_first(lines, ["l_orderkey", "l_partkey"], "l_linenumber")


def missing_metadata(spark, sf_dir):
    return S.missing_metadata(chunks(spark, sf_dir)).groupBy("entity_type").agg(F.count(F.lit(1)).alias("missing"))


def high_water_mark(spark, sf_dir):
    return table(spark, sf_dir, "events").groupBy("event_type").agg(F.max("ts").alias("last_run"))


ROWS = (
    (1, "note", "decision", None, None, "kept by hand", ["tags"]), (2, "f", "function", "a.py", None, "body", ["signature"]), (3, "x", "relation", None, "y", "x to y", ["relation_type"]),
    (4, "g", "function", None, None, "auto", ["line_number"]), (5, "", "decision", None, None, "no name", []), (6, "empty", "pattern", None, None, "  ", []), (7, "idea", "ideas", None, None, "text", []),
)
COLS = "id, entity_name, entity_type, file_path, relation_target, content, fields"
ROW = values(ROWS, COLS)


def _stored(spark):
    return _rows(spark, ROWS, "id long, entity_name string, entity_type string, file_path string, relation_target string, content string, fields array<string>")


def manual_rows(spark, sf_dir):
    return S.manual(_stored(spark)).select("id", "entity_name")


def clear_preserve_manual(spark, sf_dir):
    return S.clear_automatic(_stored(spark)).select("id")


def manual_relations(spark, sf_dir):
    """Edges connected to a chosen set of entities at either end."""
    chosen = table(spark, sf_dir, "part").where("p_size = 7").select(F.concat(F.lit("p"), F.col("p_partkey").cast("string")).alias("name"))
    edges = contains_edges(spark, sf_dir).distinct()
    return edges.join(chosen.withColumnRenamed("name", "src"), "src", "left_semi").unionByName(edges.join(chosen.withColumnRenamed("name", "dst"), "dst", "left_semi")).distinct().groupBy("kind").agg(F.count(F.lit(1)).alias("edges"))


QUERIES = {
    "orphan_relations": (orphan_relations, f"WITH n AS (SELECT name FROM {NODES} WHERE entity_type <> 'file' OR CAST(name[2:] AS BIGINT) % 2 = 0) SELECT kind, count(*) AS orphans, count(DISTINCT dst) AS targets FROM {EDGES} WHERE src NOT IN (SELECT name FROM n) OR dst NOT IN (SELECT name FROM n) GROUP BY kind"),
    "orphan_cleanup": (orphan_cleanup, f"SELECT src, dst, kind FROM {RESOLVED} WHERE src NOT IN (SELECT name FROM {NAM}) OR (NOT resolved AND NOT {EXT})"),
    "module_resolution": (module_resolution, f"SELECT * FROM {RESOLVED}"),
    "pre_storage_orphan_filter": (pre_storage_orphan_filter, f"SELECT src, dst, kind FROM {RESOLVED} WHERE CASE kind WHEN 'calls' THEN dst IN (SELECT name FROM {NAM}) WHEN 'imports' THEN resolved ELSE true END"),
    "phantom_calls": (phantom_calls, f"SELECT src, dst FROM {REL} r JOIN {COD} c ON r.src = c.entity_name WHERE kind = 'calls' GROUP BY src, dst HAVING NOT bool_or(len(list_filter(string_split(content, chr(10)), lambda l: contains(string_split(l, '#')[1], dst || '('))) > 0)"),
    "changed_relations": (changed_relations, f"SELECT DISTINCT src, dst, kind FROM {REL} WHERE string_split(src, '::')[-1] IN ('load', 'README.md') OR string_split(dst, '::')[-1] IN ('load', 'README.md')"),
    "calls_from_chunks": (calls_from_chunks, f"SELECT DISTINCT src, dst FROM (SELECT entity_name AS src, unnest(calls) AS dst FROM {COD}) WHERE dst IN (SELECT name FROM {NAM})"),
    "implementation_minimal": (scoped("minimal", 1), scope_sql("", False)),
    "implementation_logical": (scoped("logical", 20), scope_sql("a.calls", True)),
    "implementation_dependencies": (scoped("dependencies", 30), scope_sql("list_concat(a.calls, a.imports_used)", False)),
    "graph_degrees": (graph_degrees, f"SELECT name, CAST(sum(i) AS BIGINT) AS in_degree, CAST(sum(o) AS BIGINT) AS out_degree FROM (SELECT src AS name, 0 AS i, 1 AS o FROM {EDGES} UNION ALL SELECT dst, 1, 0 FROM {EDGES}) GROUP BY name"),
    "graph_smart": (graph_smart, f"WITH d AS (SELECT dst AS name, count(*) AS i FROM {EDGES} GROUP BY dst) SELECT entity_type, CAST(row_number() OVER (PARTITION BY entity_type ORDER BY 5 + 3 * coalesce(i, 0) DESC, name) AS INTEGER) AS rank, name, CAST(5 + 3 * coalesce(i, 0) AS BIGINT) AS priority FROM {NODES} LEFT JOIN d USING (name) QUALIFY rank <= 20"),
    "graph_relationships": (graph_relationships, f"SELECT src, dst, kind, count(*) AS edges FROM {EDGES} WHERE dst IN (SELECT 's' || s_suppkey FROM supplier WHERE s_nationkey = 3) GROUP BY ALL"),
    "graph_type_breakdown": (graph_type_breakdown, f"SELECT entity_type, count(*) AS entities FROM {NODES} GROUP BY ALL"),
    "state_diff": (state_diff, f"SELECT * FROM {DIFF}"),
    "diff_sketch": (diff_sketch, f"SELECT change, count(*) AS entities, min(path) AS first FROM {DIFF} GROUP BY change"),
    "set_compare": (set_compare, f"SELECT path, CASE WHEN n.hash IS NULL THEN 'left' WHEN b.hash IS NULL THEN 'right' ELSE 'both' END AS side FROM ({BEFORE}) b FULL JOIN ({NOW}) n USING (path)"),
    "vectored_delta": (vectored_delta, f"SELECT path, CASE WHEN b.hash IS NULL THEN 'new' WHEN n.hash IS NULL THEN 'deleted' ELSE 'modified' END AS change FROM ({BEFORE}) b FULL JOIN ({NOW}) n USING (path) WHERE b.hash IS NULL OR n.hash IS NULL OR path IN (SELECT doc_id FROM labels)"),
    "upsert_merge": (upsert_merge, "SELECT doc_id AS id, CAST(length(text) + CASE WHEN doc_id % 10 = 0 THEN 2 WHEN doc_id % 5 = 0 THEN 1 ELSE 0 END AS INTEGER) AS n FROM documents"),
    "delete_points": (delete_points, "SELECT doc_id, lang FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE quality = 0)"),
    "state_merge": (state_merge, f"WITH p AS (SELECT * FROM ({NOW}) WHERE path % 3 = 0) SELECT * FROM (SELECT * FROM ({BEFORE}) WHERE path NOT IN (SELECT path FROM p) UNION ALL SELECT * FROM p) WHERE path NOT IN (SELECT doc_id FROM labels WHERE toxic = 1)"),
    "content_hash_dedup": (content_hash_dedup, "SELECT min(doc_id) AS id, sha256(text) AS content_hash FROM documents WHERE sha256(text) NOT IN (SELECT sha256(text) FROM documents WHERE doc_id % 10 = 0) GROUP BY content_hash"),
    "exact_duplicates": (exact_duplicates, "SELECT sha256(text) AS content_hash, count(*) AS copies, min(doc_id) AS first FROM documents GROUP BY content_hash HAVING count(*) > 1"),
    "relation_keep_first": (relation_keep_first, "SELECT l_orderkey, l_partkey, min(l_linenumber) AS l_linenumber FROM lineitem GROUP BY ALL"),
    "missing_metadata": (missing_metadata, "SELECT lang AS entity_type, count(*) AS missing FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels) GROUP BY lang"),
    "high_water_mark": (high_water_mark, "SELECT event_type, max(ts) AS last_run FROM events GROUP BY event_type"),
    "manual_rows": (manual_rows, f"SELECT id, entity_name FROM {ROW} WHERE file_path IS NULL AND relation_target IS NULL AND trim(entity_name) <> '' AND trim(content) <> '' AND NOT list_has_any(fields, [{', '.join(_q(f) for f in S.AUTOMATION_FIELDS)}])"),
    "clear_preserve_manual": (clear_preserve_manual, f"SELECT id FROM {ROW} WHERE file_path IS NULL AND relation_target IS NULL"),
    "manual_relations": (manual_relations, f"WITH c AS (SELECT 'p' || p_partkey AS name FROM part WHERE p_size = 7) SELECT kind, count(*) AS edges FROM (SELECT DISTINCT * FROM {EDGES}) WHERE src IN (SELECT name FROM c) OR dst IN (SELECT name FROM c) GROUP BY kind"),
}
