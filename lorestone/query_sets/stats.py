"""Statistics queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from lorestone.operators import stats as S
from lorestone.query_sets.graph import EDGES, _rows, values
from lorestone.sources.tables import chunks, contains_edges, table

CHUNKS = """(SELECT doc_id AS id, source || '/' || doc_id AS file_path, 'doc_' || doc_id AS entity_name, lang AS entity_type, text AS content, 'implementation' AS chunk_type FROM documents
UNION ALL SELECT doc_id, source || '/' || doc_id, 'doc_' || doc_id, lang, concat_ws(' | ', 'Document: doc_' || doc_id, 'Language: ' || lang, 'Description: ' || text), 'metadata' FROM documents WHERE doc_id IN (SELECT doc_id FROM labels))"""
HEALTH = ((1, "green", 0, 0, 0), (2, "green", 1000, 985, 5), (3, "GREEN", 1000, 930, 40), (4, "green", 1000, 100, 90), (5, "yellow", 10, 10, 300), (6, "grey", 10, 0, 1), (7, "red", 1, 1, 1), (8, "odd", 1, 1, 1))
NAMES = (("test_run",), ("my_temp_x",), ("Function_a",), ("clean",), ("old_new_",), ("data_copy_",), ("x",))


def entity_breakdown(spark, sf_dir):
    return S.breakdown(chunks(spark, sf_dir), ["entity_type", "chunk_type"])


def chunk_ratio(spark, sf_dir):
    return S.chunk_mix(chunks(spark, sf_dir))


def file_bloat_topn(spark, sf_dir):
    """Customers are files and orders their entities, by priority."""
    return S.file_bloat(table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("file"), F.col("o_orderpriority").alias("type")), 15, 22, 15)


def content_quality_bands(spark, sf_dir):
    return chunks(spark, sf_dir).groupBy("chunk_type", S.length_band(F.col("content")).alias("band")).agg(F.count(F.lit(1)).alias("entities"))


def duplicate_signatures(spark, sf_dir):
    return S.signatures(chunks(spark, sf_dir).where("chunk_type = 'implementation'"))


def duplicate_names(spark, sf_dir):
    return table(spark, sf_dir, "part").groupBy("p_name").agg(F.count(F.lit(1)).alias("copies")).where("copies > 1")


def generic_names(spark, sf_dir):
    rows = _rows(spark, NAMES, "name string").select(S.generic_pattern(F.col("name")).alias("pattern")).where("pattern IS NOT NULL")
    return rows.groupBy("pattern").agg(F.count(F.lit(1)).alias("names"))


def relation_density(spark, sf_dir):
    """Entities with at least five outgoing edges, by kind."""
    out = contains_edges(spark, sf_dir).groupBy("src", "kind").agg(F.count(F.lit(1)).alias("n"))
    return out.groupBy("kind").agg(F.count(F.lit(1)).alias("sources"), F.count(F.when(F.col("n") >= 5, 1)).alias("dense"), F.round(F.avg("n"), 6).alias("avg_out"), F.max("n").alias("max_out"))


def db_overview_rollup(spark, sf_dir):
    """Nations and segments as collections: counts at every level."""
    c = table(spark, sf_dir, "customer")
    out = c.rollup("c_mktsegment", "c_nationkey").agg(F.count(F.lit(1)).alias("points"), F.round(F.sum("c_acctbal"), 2).alias("balance"))
    return out.select(F.coalesce("c_mktsegment", F.lit("ALL")).alias("segment"), F.coalesce("c_nationkey", F.lit(-1)).alias("nation"), "points", "balance")


def health_class(spark, sf_dir):
    rows = _rows(spark, HEALTH, "id int, status string, points long, indexed long, segments long")
    return rows.select("id", S.health(F.col("status"), F.col("points"), F.col("indexed")).alias("health"), S.segment_class(F.col("segments")).alias("segments"), F.round(F.col("indexed") / F.greatest("points", F.lit(1)), 3).alias("ratio"), F.round(F.col("segments") * 1000 / F.greatest("points", F.lit(1)), 2).alias("per_1k"))


def top_types_per_file(spark, sf_dir):
    return S.top_groups(table(spark, sf_dir, "events"), "user_id", "event_type", 2)


def cross_category_mix(spark, sf_dir):
    """Shares of languages among all chunks and among metadata."""
    total = F.count(F.lit(1))
    c = chunks(spark, sf_dir).groupBy("entity_type").agg(total.alias("n"), F.count(F.when(F.col("chunk_type") == "metadata", 1)).alias("manual"))
    return c.select("entity_type", "n", F.round(F.col("manual") / F.col("n"), 6).alias("share"))


def distinct_files(spark, sf_dir):
    return chunks(spark, sf_dir).groupBy(F.element_at(F.split("file_path", "/"), 1).alias("folder")).agg(F.countDistinct("file_path").alias("files"))


def run_delta(spark, sf_dir):
    """Rows of each day's type with the change against the day before."""
    from pyspark.sql import Window

    day = table(spark, sf_dir, "events").groupBy("event_type", F.to_date("ts").alias("day")).agg(F.count(F.lit(1)).alias("rows"))
    before = F.lag("rows").over(Window.partitionBy("event_type").orderBy("day"))
    return day.select("event_type", F.col("day").cast("string").alias("day"), "rows", (F.col("rows") - F.coalesce(before, F.lit(0))).alias("delta"))


def usage_rollup(spark, sf_dir):
    """Tokens and price of the texts by source, at a fixed price for 1000 tokens."""
    t = F.greatest(F.lit(1), F.floor(F.length("text") / 4))
    return table(spark, sf_dir, "documents").groupBy("source").agg(F.sum(t).alias("tokens"), F.count(F.lit(1)).alias("requests")).select("source", "tokens", "requests", F.round(F.col("tokens") * 0.00002 / 1000, 9).alias("cost"))


BANDS = "CASE WHEN content IS NULL OR length(content) = 0 THEN 'empty' WHEN length(content) < 20 THEN 'very_short' WHEN length(content) < 50 THEN 'short' WHEN length(content) < 200 THEN 'medium' ELSE 'long' END"
QUERIES = {
    "entity_breakdown": (entity_breakdown, f"SELECT 'entity_type' AS dimension, entity_type AS value, count(*) AS entities FROM {CHUNKS} GROUP BY 2 UNION ALL SELECT 'chunk_type', chunk_type, count(*) FROM {CHUNKS} GROUP BY 2 UNION ALL SELECT 'all', NULL, count(*) FROM {CHUNKS}"),
    "chunk_ratio": (chunk_ratio, f"WITH g AS (SELECT entity_type, count(*) FILTER (chunk_type = 'metadata') AS metadata, count(*) FILTER (chunk_type = 'implementation') AS implementation, min(length(content)) AS min_length, max(length(content)) AS max_length, round(avg(length(content)), 4) AS avg_length FROM {CHUNKS} GROUP BY 1) SELECT *, round(metadata / implementation, 6) AS ratio, CASE WHEN ratio > 2 THEN 'HIGH' WHEN ratio > 1.5 THEN 'MODERATE' ELSE 'BALANCED' END AS ratio_class FROM g"),
    "file_bloat_topn": (file_bloat_topn, "WITH t AS (SELECT o_custkey AS file, o_orderpriority AS type, count(*) AS n FROM orders GROUP BY ALL), f AS (SELECT file, CAST(sum(n) AS BIGINT) AS entities FROM t GROUP BY file HAVING sum(n) > 15 ORDER BY 2 DESC, 1 LIMIT 15), r AS (SELECT *, row_number() OVER (PARTITION BY file ORDER BY n DESC, type) AS r FROM t) SELECT file, entities, CASE WHEN entities > 22 THEN 'CRITICAL' ELSE 'HIGH' END AS severity, string_agg(type, ',' ORDER BY r) AS top_types FROM f JOIN r USING (file) WHERE r <= 3 GROUP BY file, entities"),
    "content_quality_bands": (content_quality_bands, f"SELECT chunk_type, {BANDS} AS band, count(*) AS entities FROM {CHUNKS} GROUP BY ALL"),
    "duplicate_signatures": (duplicate_signatures, "SELECT text[1:100] AS signature, count(*) AS copies FROM documents WHERE length(text) > 20 GROUP BY 1 HAVING count(*) > 1"),
    "duplicate_names": (duplicate_names, "SELECT p_name, count(*) AS copies FROM part GROUP BY 1 HAVING count(*) > 1"),
    "generic_names": (generic_names, "SELECT list_filter([" + ", ".join(f"'{p}'" for p in S.GENERIC_NAMES) + f"], lambda p: contains(lower(name), p))[1] AS pattern, count(*) AS names FROM {values(NAMES, 'name')} GROUP BY 1 HAVING pattern IS NOT NULL"),
    "relation_density": (relation_density, f"WITH o AS (SELECT src, kind, count(*) AS n FROM {EDGES} GROUP BY ALL) SELECT kind, count(*) AS sources, count(*) FILTER (n >= 5) AS dense, round(avg(n), 6) AS avg_out, max(n) AS max_out FROM o GROUP BY kind"),
    "db_overview_rollup": (db_overview_rollup, "SELECT coalesce(c_mktsegment, 'ALL') AS segment, coalesce(c_nationkey, -1) AS nation, count(*) AS points, round(sum(c_acctbal), 2) AS balance FROM customer GROUP BY ROLLUP (c_mktsegment, c_nationkey)"),
    "health_class": (health_class, f"SELECT id, CASE upper(status) WHEN 'GREEN' THEN CASE WHEN points = 0 THEN 'EMPTY' WHEN indexed >= points * 0.98 THEN 'HEALTHY' WHEN indexed >= points * 0.9 THEN 'INDEXING' ELSE 'DEGRADED' END WHEN 'YELLOW' THEN 'OPTIMIZING' WHEN 'GREY' THEN 'OPTIMIZATION_PENDING' WHEN 'RED' THEN 'FAILED' ELSE 'UNKNOWN' END AS health, CASE WHEN segments <= 0 THEN 'UNKNOWN' WHEN segments <= 10 THEN 'OPTIMAL' WHEN segments <= 50 THEN 'GOOD' WHEN segments <= 100 THEN 'ACCEPTABLE' ELSE 'FRAGMENTED' END AS segments, round(indexed / greatest(points, 1), 3) AS ratio, round(segments * 1000 / greatest(points, 1), 2) AS per_1k FROM {values(HEALTH, 'id, status, points, indexed, segments')}"),
    "top_types_per_file": (top_types_per_file, "SELECT user_id, event_type, count(*) AS n, CAST(row_number() OVER (PARTITION BY user_id ORDER BY count(*) DESC, event_type) AS INTEGER) AS rank FROM events GROUP BY 1, 2 QUALIFY rank <= 2"),
    "cross_category_mix": (cross_category_mix, f"SELECT entity_type, count(*) AS n, round(count(*) FILTER (chunk_type = 'metadata') / count(*), 6) AS share FROM {CHUNKS} GROUP BY 1"),
    "distinct_files": (distinct_files, f"SELECT string_split(file_path, '/')[1] AS folder, count(DISTINCT file_path) AS files FROM {CHUNKS} GROUP BY 1"),
    "run_delta": (run_delta, "WITH d AS (SELECT event_type, CAST(CAST(ts AS DATE) AS VARCHAR) AS day, count(*) AS rows FROM events GROUP BY ALL) SELECT *, rows - coalesce(lag(rows) OVER (PARTITION BY event_type ORDER BY day), 0) AS delta FROM d"),
    "usage_rollup": (usage_rollup, "SELECT source, CAST(sum(greatest(1, length(text) // 4)) AS BIGINT) AS tokens, count(*) AS requests, round(tokens * 0.00002 / 1000, 9) AS cost FROM documents GROUP BY source"),
}
