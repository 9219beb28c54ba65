"""Queries over collections and their state: made, written, read in pages, cleared; and over what is read back."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from lorestone.operators import json_stream as J
from lorestone.operators import state as S
from lorestone.plans import embedding as E
from lorestone.query_sets.graph import ROW, _rows, _stored, values
from lorestone.query_sets.scalars import SRC, _sources
from lorestone.query_sets.stats import CHUNKS
from lorestone.sources.store import Catalog, saved_state, shared_dir, snapshot
from lorestone.sources.tables import chunks, table

GROUPED = (("Guide (+2 more)", ["Guide", "Setup", "Usage"]), ("load", None), ("Guide", ["Guide"]), ("", ["Last"]))
PAYLOADS = (
    ('{"entity_type": "file", "metadata": {"file_path": "/home/p/a.py"}}',), ('{"metadata": {"entity_type": "file", "file_path": "b/c.md"}}',), ('{"metadata": {"entity_type": "function", "file_path": "/home/p/a.py"}}',),
    ('{"entity_type": "file", "metadata": {"file_path": "/else/d.py"}}',), ('{"entity_type": "file", "metadata": {}}',), ('{"entity_type": "file", "metadata": {"file_path": "/home/p/a.py"}}',),
)
STATES = ((1, '{"files": {"a.py": {"hash": "1"}, "_x": {"hash": "2"}}, "_statistics": {"hash": "9"}}'), (2, '{"b.py": {"hash": "3"}, "_statistics": {"hash": "9"}}'), (3, "{broken"), (4, "{}"))
STREAM = ('{"meta": {"items": [1]}, "items": [{"title": "One", "body": "B", "replies": [{"text": "r1", "children": [{"text": "r2"}]}]}, 5, {"id": 7, "text": "T"}, {"text": "Z"}], "n": 3, "posts": [{"name": "P", "author": "me"}]}', '{"messages": [{"content": "hi"}], "items": [{"text": "cut')
CONFIG = (("defaults", 1, "model", "small"), ("defaults", 2, "limit", "10"), ("environment", 1, "limit", "20"), ("settings", 1, "model", "large"), ("settings", 2, "model", "larger"), ("project", 1, "limit", "30"), ("other", 1, "limit", "99"), ("overrides", 1, "extra", "1"))


def _catalog(spark) -> Catalog:
    return Catalog(spark, f"{shared_dir(spark)}/catalog-{uuid.uuid4().hex}")


def collection_catalog(spark, sf_dir):
    """A collection for each language, found again by name; one is dropped."""
    store, docs = _catalog(spark), table(spark, sf_dir, "documents")
    for lang, metric in (("en", "cosine"), ("de", "dot"), ("fr", "euclidean"), ("en", "dot")):
        c = store.ensure(lang, metric=metric, dense=64, sparse=1000 if lang == "fr" else 0)
        if not c.version:
            c.upsert(docs.where(F.col("lang") == lang).select(F.col("doc_id").alias("id"), "source"))
    store.drop("de")
    infos = [store.open(n).info() for n in store.names()]
    return _rows(spark, [(i["name"], i["metric"], i["points"], i["has_sparse"], store.exists("de")) for i in infos], "name string, metric string, points long, has_sparse boolean, dropped_is_there boolean")


def upsert_last_wins(spark, sf_dir):
    """Orders by customer, written twice: of equal keys in one write the last by order key stays."""
    c = _catalog(spark).create("orders")
    o = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("id"), "o_orderkey")
    c.upsert(o.where("o_orderkey % 2 = 0"), order="o_orderkey")
    return c.upsert(o.where("o_orderkey % 3 = 0"), order="o_orderkey")


def batch_upserts(spark, sf_dir):
    """Sums over batches, one of which has no key and fails."""
    c = _catalog(spark).create("parts")
    p = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), "p_size")
    done = c.batch_upsert([p.where("id % 2 = 0"), p.select("p_size"), p.where("id % 2 = 1")])
    return _rows(spark, [(done.asked, done.stored, len(done.errors), done.success, done.success_rate, c.count())], "asked long, stored long, errors int, success boolean, success_rate double, points long")


def cleared_collection(spark, sf_dir):
    """What stays when all but people's notes is cleared; the state is gone too."""
    c = _catalog(spark).create("notes")
    c.upsert(_stored(spark))
    c.state.write(snapshot(_sources(spark)))
    c.clear()
    return c.read().select("id", "entity_name", F.lit(c.state.load().count()).alias("state_rows"))


def run_statistics(spark, sf_dir):
    """Numbers of a run, kept beside the state and read back."""
    c = _catalog(spark).create("stats")
    n = table(spark, sf_dir, "documents").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("source").alias("s")).first()
    c.state.save_statistics({"points": 0, "sources": 0})
    c.state.save_statistics({"points": n["n"], "sources": n["s"]})
    return _rows(spark, sorted(c.state.statistics().items()), "name string, value double")


def scrolled_page(spark, sf_dir):
    """The third page of 50 rows of one status, each page asked for by the last key of the one before."""
    c = _catalog(spark).create("orders")
    c.write(table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), "o_orderstatus"))
    after = None
    for _ in range(2):
        after = c.scroll({"o_orderstatus": "O"}, 50, after).agg(F.max("id")).first()[0]
    return c.scroll({"o_orderstatus": "O"}, 50, after)


def changed_entities(spark, sf_dir):
    """Labelled documents as changed entities: their stored rows give way to fresh ones of other content."""
    c = chunks(spark, sf_dir).select((F.col("id") * 2 + (F.col("chunk_type") == "metadata").cast("int")).alias("id"), "file_path", "entity_name", "chunk_type", F.md5("content").alias("content_hash"))
    fresh = c.where("id % 4 < 2").withColumn("content_hash", F.concat(F.lit("new"), "content_hash"))
    changed = c.where("chunk_type = 'metadata'").select("file_path", "entity_name")
    return S.replace_changed(c.where("id % 6 < 4"), fresh, changed).groupBy("chunk_type", F.col("content_hash").startswith("new").alias("fresh")).agg(F.count(F.lit(1)).alias("points"))


def grouped_headers(spark, sf_dir):
    return S.known_names(_rows(spark, GROUPED, "entity_name string, headers array<string>"))


def entities_for_file(spark, sf_dir):
    """The rows of one file or name, from one search and from two, and how many lists by chunk type they make."""
    c = chunks(spark, sf_dir).withColumn("id", F.concat_ws("/", F.col("id").cast("string"), "chunk_type"))
    name = "doc_100"
    both = S.of_file(c, name).withColumn("way", F.lit("one")).unionByName(S.of_file_by_two_searches(c, name).withColumn("way", F.lit("two")))
    lists = S.by_chunk_type(S.of_file(c, name)).select(F.explode("entities").alias("e"), "chunk_type").select(F.col("e.id").alias("id"), "chunk_type", F.lit("lists").alias("way"))
    return both.select("id", "chunk_type", "way").unionByName(lists)


def recorded_files(spark, sf_dir):
    return S.recorded_files(_rows(spark, PAYLOADS, "json string"), "/home/p")


def state_files(spark, sf_dir):
    """Files of state texts in both layouts; a corrupt text is empty."""
    return saved_state(_rows(spark, STATES, "id int, json string"))


def state_snapshot(spark, sf_dir):
    """The snapshot of a tree; a state that is not there adds nothing."""
    c = _catalog(spark).create("state")
    return snapshot(_sources(spark)).unionByName(c.state.load()).select("path", "hash", "size")


def relation_hash_maps(spark, sf_dir):
    """For every customer the map of its orders' relations; its entries."""
    o = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("file_path"), F.col("o_orderkey").cast("string").alias("id"), F.md5(F.col("o_orderkey").cast("string")).alias("content_hash"))
    return S.relation_hashes(o).select("file_path", F.explode("hashes").alias("id", "content_hash"))


def entity_probe(spark, sf_dir):
    c = chunks(spark, sf_dir)
    return S.probe(c.select("entity_name").distinct(), c).groupBy("exists").agg(F.count(F.lit(1)).alias("names"))


def unchanged_batches(spark, sf_dir):
    """Orders as files of their customers' batches, their status as a hash; urgent ones have changed."""
    o = table(spark, sf_dir, "orders").select("o_custkey", F.col("o_orderstatus").alias("new"), F.when(F.col("o_orderpriority") != "1-URGENT", F.col("o_orderstatus")).alias("old"))
    return S.should_process(o, "o_custkey")


def search_cache(spark, sf_dir):
    """The same search twice is one; a write clears what is kept."""
    c = _catalog(spark).create("cached")
    c.write(table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), "p_size"))
    ask = lambda size: c.cache.get(lambda: c.scroll({"p_size": size}), size=size)
    sizes = [ask(7), ask(7), ask(8)]
    n, hits = len(c.cache.kept), c.cache.hits
    c.upsert(_rows(spark, [(-1, 7)], "id long, p_size long"))
    return _rows(spark, [(sizes[1].count(), ask(7).count(), n, hits, len(c.cache.kept))], "before long, after long, kept int, hits int, kept_after int")


def streamed_items(spark, sf_dir):
    """Items of large JSON texts in batches of two, at most three of an array; replies at any depth; a text that breaks off gives what came before."""
    files = _rows(spark, [(f"f{i}.json", t) for i, t in enumerate(STREAM)], "file string, text string")
    return J.items(files, most=3, batch=2)


def streaming_admission(spark, sf_dir):
    rows = [(f, c, J.is_streamed(f, c)) for f in ("a.json", "B.JSON", "c.py") for c in (True, False)]
    return _rows(spark, rows, "file string, content_only boolean, streamed boolean")


def hash_embeddings(spark, sf_dir):
    """Vectors that depend on the text alone, made once for each content."""
    d = table(spark, sf_dir, "documents").select(F.sha2("text", 256).alias("content_hash"), F.col("text").alias("content")).dropDuplicates(["content_hash"])
    made = E.embedder({"provider": "hash", "size": 8})(d)
    return made.select("content_hash", F.round(F.aggregate("vector", F.lit(0.0), lambda s, x: s + x), 6).alias("total"), F.round(F.get("vector", F.lit(3)), 6).alias("fourth"))


def config_layers(spark, sf_dir):
    return E.layered(_rows(spark, CONFIG, "layer string, n int, key string, value string"))


STR = values([(f"f{i}.json", t) for i, t in enumerate(STREAM)], "file, text")
HEX = "CAST('0x' || sha256('0:' || text)[{a}:{b}] AS INTEGER) / 127.5 - 1.0"
QUERIES = {
    "collection_catalog": (collection_catalog, "SELECT lang AS name, CASE lang WHEN 'en' THEN 'cosine' ELSE 'euclidean' END AS metric, count(*) AS points, lang = 'fr' AS has_sparse, false AS dropped_is_there FROM documents WHERE lang IN ('en', 'fr') GROUP BY lang"),
    "upsert_last_wins": (upsert_last_wins, "WITH b AS (SELECT o_custkey AS id, max(o_orderkey) AS o FROM orders WHERE o_orderkey % 3 = 0 GROUP BY 1), a AS (SELECT o_custkey AS id, max(o_orderkey) AS o FROM orders WHERE o_orderkey % 2 = 0 GROUP BY 1) SELECT id, o AS o_orderkey FROM b UNION ALL SELECT id, o FROM a WHERE id NOT IN (SELECT id FROM b)"),
    "batch_upserts": (batch_upserts, "SELECT count(*) AS asked, count(*) AS stored, CAST(1 AS INTEGER) AS errors, false AS success, 1.0::DOUBLE AS success_rate, count(*) AS points FROM part"),
    "cleared_collection": (cleared_collection, f"SELECT id, entity_name, 0::BIGINT AS state_rows FROM {ROW} WHERE file_path IS NULL AND relation_target IS NULL"),
    "run_statistics": (run_statistics, "SELECT 'points' AS name, count(*)::DOUBLE AS value FROM documents UNION ALL SELECT 'sources', count(DISTINCT source)::DOUBLE FROM documents"),
    "scrolled_page": (scrolled_page, "SELECT o_orderkey AS id, o_orderstatus FROM orders WHERE o_orderstatus = 'O' ORDER BY 1 LIMIT 50 OFFSET 100"),
    "changed_entities": (changed_entities, f"""WITH c AS (SELECT id * 2 + (chunk_type = 'metadata')::INT AS id, file_path, entity_name, chunk_type FROM {CHUNKS}), m AS (SELECT file_path, entity_name FROM c WHERE chunk_type = 'metadata'),
k AS (SELECT * FROM c WHERE id % 6 < 4 AND (file_path, entity_name) NOT IN (SELECT (file_path, entity_name) FROM m)), f AS (SELECT * FROM c WHERE id % 4 < 2)
SELECT chunk_type, fresh, count(*) AS points FROM (SELECT id, chunk_type, true AS fresh FROM f UNION ALL SELECT id, chunk_type, false FROM k WHERE id NOT IN (SELECT id FROM f)) GROUP BY ALL"""),
    "grouped_headers": (grouped_headers, f"SELECT DISTINCT name FROM (SELECT entity_name AS name FROM {values(GROUPED, 'entity_name, headers')} UNION ALL SELECT unnest(headers) FROM {values(GROUPED, 'entity_name, headers')}) WHERE name <> ''"),
    "entities_for_file": (entities_for_file, f"SELECT id || '/' || chunk_type AS id, chunk_type, way FROM {CHUNKS}, (VALUES ('one'), ('two'), ('lists')) AS w(way) WHERE file_path = 'doc_100' OR entity_name = 'doc_100'"),
    "recorded_files": (recorded_files, f"WITH j AS (SELECT CAST(json AS JSON) AS j FROM {values(PAYLOADS, 'json')}) SELECT DISTINCT CASE WHEN starts_with(p, '/home/p/') THEN p[9:] ELSE p END AS path FROM (SELECT j->>'$.metadata.file_path' AS p, coalesce(j->>'$.entity_type', j->>'$.metadata.entity_type') AS k FROM j) WHERE k = 'file' AND p <> ''"),
    "state_files": (state_files, f"""WITH j AS (SELECT id, try_cast(json AS JSON) AS j FROM {values(STATES, 'id, json')}), f AS (SELECT id, coalesce((j->'$.files'), j) AS f, (j->'$.files') IS NOT NULL AS nested FROM j WHERE j IS NOT NULL), e AS (SELECT id, nested, f, unnest(json_keys(f)) AS path FROM f)
SELECT CAST(id AS INTEGER) AS id, path, json_extract_string(f, '$."' || path || '".hash') AS hash FROM e WHERE nested OR NOT starts_with(path, '_')"""),
    "state_snapshot": (state_snapshot, f"SELECT file AS path, sha256(text) AS hash, CAST(octet_length(encode(text)) AS BIGINT) AS size FROM {SRC}"),
    "relation_hash_maps": (relation_hash_maps, "SELECT o_custkey AS file_path, CAST(o_orderkey AS VARCHAR) AS id, md5(CAST(o_orderkey AS VARCHAR)) AS content_hash FROM orders"),
    "entity_probe": (entity_probe, "SELECT doc_id IN (SELECT doc_id FROM labels) AS exists, count(*) AS names FROM documents GROUP BY 1"),
    "unchanged_batches": (unchanged_batches, "SELECT o_custkey, count(*) AS files, count(*) FILTER (o_orderpriority <> '1-URGENT') AS unchanged, count(*) FILTER (o_orderpriority <> '1-URGENT') < count(*) AS should_process FROM orders GROUP BY 1"),
    "search_cache": (search_cache, "SELECT count(*) AS before, count(*) + 1 AS after, CAST(2 AS INTEGER) AS kept, CAST(1 AS INTEGER) AS hits, CAST(1 AS INTEGER) AS kept_after FROM part WHERE p_size = 7"),
    "streamed_items": (streamed_items, f"""WITH RECURSIVE a AS (SELECT file, k AS field, o, CAST(CAST(text AS JSON)->k AS JSON[]) AS l FROM (SELECT * FROM {STR} WHERE file = 'f0.json'), (VALUES ('items', 1), ('posts', 2)) AS v(k, o)),
i AS (SELECT file, field, o, unnest(l) AS x, generate_subscripts(l, 1) - 1 AS index FROM a), m AS (SELECT *, row_number() OVER (PARTITION BY file ORDER BY o, index) - 1 AS place FROM i WHERE json_type(x) = 'OBJECT' AND index < 3),
t(file, field, index, place, path, x) AS (SELECT file, field, index, place, '', x FROM m UNION ALL SELECT file, field, index, place, path || '0', coalesce((x->'$.replies[0]'), (x->'$.children[0]')) FROM t WHERE coalesce((x->'$.replies[0]'), (x->'$.children[0]')) IS NOT NULL),
s AS (SELECT file, field, index, place, string_agg(concat_ws(chr(10), coalesce(x->>'$.title', x->>'$.name'), 'Author: ' || (x->>'$.author'), x->>'$.body', x->>'$.text'), chr(10) ORDER BY path) AS text FROM t GROUP BY ALL)
SELECT s.file, s.field, CAST(s.index AS INTEGER) AS index, CAST(s.place // 2 AS INTEGER) AS batch, rtrim(s.field, 's') || '_' || CASE WHEN coalesce(m.x->>'$.title', m.x->>'$.name') IS NOT NULL THEN (s.index + 1) || '_' || coalesce(m.x->>'$.title', m.x->>'$.name') ELSE coalesce(m.x->>'$.id', CAST(s.index + 1 AS VARCHAR)) END AS name, s.text
FROM s JOIN m ON s.file = m.file AND s.place = m.place UNION ALL SELECT file, 'messages', 0, 0, 'message_1', regexp_extract(text, '"content": "([^"]*)"', 1) FROM {STR} WHERE file = 'f1.json'"""),
    "streaming_admission": (streaming_admission, "SELECT file, content_only, content_only AND suffix(lower(file), '.json') AS streamed FROM (VALUES ('a.json'), ('B.JSON'), ('c.py')) AS f(file), (VALUES (true), (false)) AS c(content_only)"),
    "hash_embeddings": (hash_embeddings, f"SELECT DISTINCT sha256(text) AS content_hash, round({' + '.join(HEX.format(a=2 * k + 1, b=2 * k + 2) for k in range(8))}, 6) AS total, round({HEX.format(a=7, b=8)}, 6) AS fourth FROM documents"),
    "config_layers": (config_layers, f"WITH l AS (SELECT *, list_position(['defaults', 'environment', 'settings', 'project', 'overrides'], layer) AS p FROM {values(CONFIG, 'layer, n, key, value')}) SELECT key, arg_max(value, p * 100 + n) AS value, arg_max(layer, p * 100 + n) AS layer FROM l WHERE p > 0 GROUP BY key"),
}
