"""Streams, extractors and composite plans."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from lorestone.operators.extract import extract
from lorestone.plans import lifecycle as L
from lorestone.query_sets.extractors import FLAT, FLAT_SQL
from lorestone.query_sets.graph import COD, EXT, NAM, REL, RESOLVED, _rows, code, names, relations, values
from lorestone.query_sets.scalars import _sources
from lorestone.sources.store import Catalog, Collection, shared_dir
from lorestone.sources.tables import table
from lorestone.streaming import debounce as D

MORE = (
    ("x.js", "import a from './a'\nexport class Box extends Base {}\nconst f = (x) => x\nfunction go() {}"), ("x.css", ".a, .b { --c: 1 }\n#d { }\n@import 'e.css';"), ("package.json", '{"name": "n", "dependencies": {"left": "1"}, "items": [{"title": "T", "body": "B", "replies": [{"text": "R"}]}]}'),
    ("c.yaml", "services:\n  web:\n    image: x"), ("t.csv", "a,b\n1,2\n3,4"), ("s.ini", "[one]\nk = v\n"), ("bad.py", "def ("), ("n.bin", "x"), ("l.txt", "a line that is long enough"),
)
MOVES = (("a", None, "2024-01-01 00:00:00", "modified"), ("b", "c", "2024-01-01 00:00:01", "moved"), ("d", None, "2024-01-01 00:00:02", "created"), ("d", None, "2024-01-01 00:00:03", "deleted"))


def debounce_sessions(spark, sf_dir):
    """Events of one user within two hours are one session."""
    e = table(spark, sf_dir, "events").select(F.col("user_id").alias("path"), F.col("ts").cast("timestamp").alias("ts"), "event_type")
    return D.sessions(e, "2 hours").select("path", F.unix_micros("first").alias("first"), F.unix_micros("last").alias("last"), "events")


def file_moves(spark, sf_dir):
    rows = _rows(spark, MOVES, "path string, target string, ts string, event_type string")
    return D.moves(rows)


def debounce_actions(spark, sf_dir):
    rows = D.moves(_rows(spark, MOVES, "path string, target string, ts string, event_type string")).withColumn("ts", F.to_timestamp("ts"))
    return D.sessions(rows, "10 seconds").select("path", "events", "action")


def stream_debounce(spark, sf_dir):
    """The sessions a stream closed, of those that ended well before its watermark, whatever its batches were."""
    closed = D.run_available(spark, f"{sf_dir}/events.parquet", "2 hours", "1 day").select("path", F.unix_micros("first").alias("first"), F.unix_micros("last").alias("last"), "events")
    end = table(spark, sf_dir, "events").agg((F.max(F.unix_micros(F.col("ts").cast("timestamp"))) - 86_400_000_000 - 2 * 7_200_000_000).alias("end"))
    return closed.join(F.broadcast(end)).where("last < end").drop("end")


def source_entities(spark, sf_dir):
    return extract(_sources(spark).unionAll(_rows(spark, MORE, "file string, text string")))


def markdown_chunks(spark, sf_dir):
    """Documents read as Markdown files."""
    docs = table(spark, sf_dir, "documents").select(F.concat(F.lit("doc"), F.col("doc_id").cast("string"), F.lit(".md")).alias("file"), "text")
    return extract(docs).where("row = 'chunk'").select("file", "name", "line", F.sha2("content", 256).alias("content_hash"))


def _indexed(spark) -> Collection:
    """A tree that was indexed, then a file changed and moved its lines, one was deleted, one came with the content of another; indexed again."""
    store = Catalog(spark, f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}").ensure("tree")
    L.index(store, _rows(spark, BEFORE, "file string, text string"))
    L.index(store, _rows(spark, FLAT, "file string, text string"))
    return store


def index_pipeline(spark, sf_dir):
    """What is stored after both runs: the points of the second tree, by ids that do not depend on lines."""
    return _indexed(spark).read().select(F.col("id").cast("string").alias("id"), "file_path", "entity_name", "entity_type", "chunk_type", "content_hash")


def index_changes(spark, sf_dir):
    """What a third run would find changed, with one more file changed and one gone."""
    third = _rows(spark, FLAT, "file string, text string").where("file <> 'c.txt'").withColumn("text", F.when(F.col("file") == "b.csv", F.lit("x,z")).otherwise(F.col("text")))
    return L.changes(_indexed(spark), third)


def deleted_files(spark, sf_dir):
    """The files that still have points after two were deleted."""
    store = _indexed(spark)
    out = L.delete_files(store, _rows(spark, [("a.ini",), ("c.txt",)], "path string"))
    return out.groupBy("file_path").agg(F.count(F.lit(1)).alias("points")).join(store.state.load().select(F.col("path").alias("file_path"), "size"), "file_path")


def single_file(spark, sf_dir):
    """One file indexed into a stored tree, then once more unchanged: an early exit, so no version more."""
    store = _indexed(spark)
    one = _rows(spark, [("f.cfg", "[four]\nr = 1")], "file string, text string")
    L.index_file(store, one)
    version = store.version
    L.index_file(store, one)
    same = F.lit(store.version == version).alias("early_exit")
    return store.read().where("file_path = 'f.cfg'").select("entity_name", "entity_type", same)


def graph_cleanup(spark, sf_dir):
    """Both steps: relations with an end that nothing resolves, then calls that the code of their source does not make."""
    return L.cleanup(relations(spark).distinct(), names(spark), code(spark).select("entity_name", "content"))


SENTENCES = (
    (1, 0, "2024-01-01 00:00:00", "created"), (1, 1, "2024-01-01 00:00:01", "modified"), (2, 0, "2024-01-01 00:00:00", "modified"), (2, 1, "2024-01-01 00:00:04", "deleted"), (3, 0, "2024-01-01 00:00:02", "created"),
    (3, 1, "2024-01-01 00:00:03", "deleted"), (4, 0, "2024-01-01 00:00:00", "created"), (4, 1, "2024-01-01 00:10:00", "modified"), (5, 0, "2024-01-01 00:10:01", "modified"),
)


def pending_files(spark, sf_dir):
    """At a moment: paths that are quiet for two seconds are ready, those silent for five minutes expired, the rest wait; a forced flush takes all that wait."""
    events = _rows(spark, SENTENCES, "path long, n int, ts string, event_type string").withColumn("ts", F.to_timestamp("ts"))
    return D.pending(events, F.to_timestamp(F.lit("2024-01-01 00:10:02")), "path")


def missing_again(spark, sf_dir):
    """Files that were missing when their change was seen, checked again after the delay: there again (an atomic save) is indexed, still gone is deleted."""
    e = table(spark, sf_dir, "orders")
    seen = e.select(F.col("o_orderkey").alias("path"), (F.col("o_orderkey") % 3 != 0).alias("there"))
    again = e.where("o_orderkey % 2 = 0").select(F.col("o_orderkey").alias("path"))
    return D.checked_again(seen, again).groupBy("action").agg(F.count(F.lit(1)).alias("files"))


def watcher_counters(spark, sf_dir):
    """Counts of what a watcher saw and did, by user as project."""
    e = table(spark, sf_dir, "events").select(F.col("user_id").alias("project"), F.col("event_id").alias("path"), F.col("ts").cast("timestamp").alias("ts"), "event_type")
    return D.counters(e, "project")


def completion(spark, sf_dir):
    """The line of a log at which the awaited number of files is done; lines behind it do not count."""
    log = [(1, 1, "indexed 2 files"), (1, 2, "noise"), (1, 3, "indexed 3 files"), (1, 4, "indexed 9 files"), (2, 1, "indexed 1 files")]
    return D.completed(_rows(spark, log, "log long, n int, line string"), r"indexed (\d+) files", 5)


BEFORE = (("a.ini", "[one]\nk = v\nold = 1\n[two]\nz = 0"), ("b.csv", "x,y\n1,2"), ("c.txt", "a line that is long enough"), ("d.ini", "[gone]\nq = 1"), FLAT[-1])
#: The points of FLAT: their keys and contents.
POINTS = f"""(SELECT *, concat_ws('::', file, kind, CASE WHEN row = 'relation' THEN name || '->' || other ELSE name END, chunk_type) AS key FROM
(SELECT file, row, name, other, kind, CASE row WHEN 'entity' THEN 'metadata' ELSE 'implementation' END AS chunk_type, CASE row WHEN 'entity' THEN concat_ws('::', name, kind, other) ELSE content END AS content FROM ({FLAT_SQL})))"""
CLOSED = "WITH e AS (SELECT user_id AS path, epoch_us(ts) AS t, event_type FROM events), g AS (SELECT *, CASE WHEN t - lag(t) OVER w < 7200000000 THEN 0 ELSE 1 END AS new FROM e WINDOW w AS (PARTITION BY path ORDER BY t)), s AS (SELECT *, sum(new) OVER (PARTITION BY path ORDER BY t) AS k FROM g) SELECT path, min(t) AS first, max(t) AS last, count(*) AS events FROM s GROUP BY path, k HAVING max(t) < (SELECT max(t) FROM e) - 86400000000 - 2 * 7200000000"
QUERIES = {
    "debounce_sessions": (debounce_sessions, "WITH e AS (SELECT user_id AS path, epoch_us(ts) AS t FROM events), g AS (SELECT *, CASE WHEN t - lag(t) OVER w < 7200000000 THEN 0 ELSE 1 END AS new FROM e WINDOW w AS (PARTITION BY path ORDER BY t)), s AS (SELECT *, sum(new) OVER (PARTITION BY path ORDER BY t) AS k FROM g) SELECT path, min(t) AS first, max(t) AS last, count(*) AS events FROM s GROUP BY path, k"),
    "file_moves": (file_moves, f"SELECT path, event_type, ts FROM {values(MOVES, 'path, target, ts, event_type')} WHERE event_type <> 'moved' UNION ALL SELECT path, 'deleted', ts FROM {values(MOVES, 'path, target, ts, event_type')} WHERE event_type = 'moved' UNION ALL SELECT target, 'created', ts FROM {values(MOVES, 'path, target, ts, event_type')} WHERE event_type = 'moved'"),
    "debounce_actions": (debounce_actions, f"""WITH m AS (SELECT * FROM {values(MOVES, 'path, target, ts, event_type')}), e AS (SELECT path, ts::TIMESTAMP AS ts, event_type FROM m WHERE event_type <> 'moved' UNION ALL SELECT path, ts::TIMESTAMP, 'deleted' FROM m WHERE event_type = 'moved' UNION ALL SELECT target, ts::TIMESTAMP, 'created' FROM m WHERE event_type = 'moved'),
g AS (SELECT *, CASE WHEN ts - lag(ts) OVER w < INTERVAL 10 SECOND THEN 0 ELSE 1 END AS new FROM e WINDOW w AS (PARTITION BY path ORDER BY ts)), s AS (SELECT *, sum(new) OVER (PARTITION BY path ORDER BY ts) AS k FROM g)
SELECT path, count(*) AS events, CASE WHEN arg_min(event_type, ts) = 'created' AND arg_max(event_type, ts) = 'deleted' THEN 'none' WHEN arg_max(event_type, ts) = 'deleted' THEN 'delete' ELSE 'index' END AS action FROM s GROUP BY path, k"""),
    "stream_debounce": (stream_debounce, CLOSED),
    "source_entities": (source_entities, None),
    "markdown_chunks": (markdown_chunks, None),
    "index_pipeline": (index_pipeline, f"SELECT CAST(CAST('0x' || sha256(key)[1:16] AS UBIGINT) AS VARCHAR) AS id, file AS file_path, name AS entity_name, kind AS entity_type, chunk_type, sha256(content) AS content_hash FROM {POINTS}"),
    "index_changes": (index_changes, f"SELECT file AS path, CASE file WHEN 'c.txt' THEN 'removed' WHEN 'b.csv' THEN 'modified' ELSE 'unchanged' END AS change FROM {values(FLAT, 'file, text')}"),
    "deleted_files": (deleted_files, f"SELECT file AS file_path, count(*) AS points, (SELECT octet_length(encode(text)) FROM {values(FLAT, 'file, text')} t WHERE t.file = p.file) AS size FROM {POINTS} p WHERE file NOT IN ('a.ini', 'c.txt') GROUP BY file"),
    "single_file": (single_file, "SELECT entity_name, entity_type, true AS early_exit FROM (VALUES ('f.cfg', 'file'), ('four', 'section'), ('four.r', 'key')) AS v(entity_name, entity_type)"),
    "graph_cleanup": (graph_cleanup, f"""SELECT DISTINCT src, dst, kind FROM {RESOLVED} r WHERE NOT (src NOT IN (SELECT name FROM {NAM}) OR (NOT resolved AND NOT {EXT}))
AND NOT (kind = 'calls' AND src IN (SELECT entity_name FROM {COD}) AND (src, dst) IN (SELECT (src, dst) FROM {REL} r JOIN {COD} c ON r.src = c.entity_name WHERE kind = 'calls' GROUP BY src, dst HAVING NOT bool_or(len(list_filter(string_split(content, chr(10)), lambda l: contains(string_split(l, '#')[1], dst || '('))) > 0)))"""),
    "pending_files": (pending_files, f"""WITH p AS (SELECT path, count(*) AS events, max(ts::TIMESTAMP) AS last, arg_min(event_type, ts) AS a, arg_max(event_type, ts) AS b FROM {values(SENTENCES, 'path, n, ts, event_type')} GROUP BY path), q AS (SELECT *, date_diff('second', last, TIMESTAMP '2024-01-01 00:10:02') AS quiet FROM p)
SELECT path, events, CASE WHEN quiet > 300 THEN 'expired' WHEN quiet >= 2 THEN 'ready' ELSE 'waiting' END AS status, quiet <= 300 AS flushed, CASE WHEN a = 'created' AND b = 'deleted' THEN 'none' WHEN b = 'deleted' THEN 'delete' ELSE 'index' END AS action FROM q"""),
    "missing_again": (missing_again, "SELECT CASE WHEN o_orderkey % 3 <> 0 OR o_orderkey % 2 = 0 THEN 'index' ELSE 'delete' END AS action, count(*) AS files FROM orders GROUP BY 1"),
    "watcher_counters": (watcher_counters, "SELECT user_id AS project, count(*) AS events, count(DISTINCT event_id) AS files, count(DISTINCT event_type) AS kinds, epoch_us(max(ts)) AS last FROM events GROUP BY 1"),
    "completion": (completion, "WITH l AS (SELECT * FROM (VALUES (1, 1, 'indexed 2 files'), (1, 2, 'noise'), (1, 3, 'indexed 3 files'), (1, 4, 'indexed 9 files'), (2, 1, 'indexed 1 files')) AS v(log, n, line)), d AS (SELECT *, sum(coalesce(try_cast(regexp_extract(line, 'indexed (\\d+) files', 1) AS BIGINT), 0)) OVER (PARTITION BY log ORDER BY n) AS done FROM l) SELECT CAST(log AS BIGINT) AS log, CAST(min(n) FILTER (done >= 5) AS INTEGER) AS line, CAST(max(done) FILTER (done < 5 OR done >= 5) AS BIGINT) AS files FROM (SELECT *, min(n) FILTER (done >= 5) OVER (PARTITION BY log) AS stop FROM d) WHERE stop IS NULL OR n <= stop GROUP BY log"),
}
