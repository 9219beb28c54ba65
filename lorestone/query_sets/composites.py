"""Chat index and edit guard queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from lorestone.functions.text import content_hash
from lorestone.operators import graph as G
from lorestone.plans import chat_index as I
from lorestone.plans import guard as U
from lorestone.query_sets.chat import CATS, HITS
from lorestone.query_sets.graph import EDGES, NODES, _rows, values
from lorestone.sources.tables import contains_edges, nodes, table

EDITS = (("Write", "a.py", "def load():\n    return 1"), ("Read", "a.py", "x"), ("Edit", "b.md", "text"), ("Edit", "c.py", "import os"), ("Write", "d.py", "# @allow-duplicate: needed\ndef load(): pass"), ("Write", "e.py", "class Fresh:\n    def run(self): pass"))
REPLIES = ((1, 'Here: ```json\n{"hasIssues": true, "reason": "seen"}\n```'), (2, '{"hasIssues": false}'), (3, "nothing"))


def chat_index(spark, sf_dir):
    """The hash is of the extract, as in the twin; the index itself stores one of the whole text."""
    return I.summaries(table(spark, sf_dir, "conversations")).select("conv_id", "key", "category", content_hash(F.col("content")).alias("content_hash"))


def chat_html(spark, sf_dir):
    return I.html_report(table(spark, sf_dir, "conversations")).select("conv_id", F.md5("html").alias("html_md5"))


def guard_admission(spark, sf_dir):
    return U.admitted(_rows(spark, EDITS, "tool string, file string, text string")).select("file", "tool", "verdict")


def guard_duplicates(spark, sf_dir):
    return U.duplicates(_rows(spark, EDITS, "tool string, file string, text string"), _rows(spark, [("load",), ("run",)], "name string"))


def guard_reply(spark, sf_dir):
    return _rows(spark, REPLIES, "id int, text string").select("id", *U.reply(F.col("text")))


def graph_entities(spark, sf_dir):
    """Entities that stand in a relation, by kind, with their degrees."""
    d = G.degrees(contains_edges(spark, sf_dir))
    return nodes(spark, sf_dir).join(d, "name").groupBy("entity_type").agg(F.count(F.lit(1)).alias("entities"), F.sum("in_degree").alias("in_degree"), F.sum("out_degree").alias("out_degree"))


TALK = "(SELECT conv_id, string_agg(upper(role) || ': ' || text, chr(10) || chr(10) ORDER BY turn) AS content FROM conversations GROUP BY conv_id)"
QUERIES = {
    "chat_index": (chat_index, f"WITH h AS (SELECT *, {HITS} AS h FROM {TALK}) SELECT conv_id, 'chat_summary_' || md5(conv_id::VARCHAR)[1:8] AS key, CASE WHEN list_max(h) = 0 THEN 'implementation_pattern' ELSE ({CATS})[list_position(h, list_max(h))] END AS category, sha256(content[1:300]) AS content_hash FROM h"),
    "chat_html": (chat_html, "SELECT conv_id, md5('<html><body>' || string_agg('<p class=''' || role || '''>' || replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;') || '</p>', '' ORDER BY turn) || '</body></html>') AS html_md5 FROM conversations GROUP BY conv_id"),
    "guard_admission": (guard_admission, f"SELECT file, tool, CASE WHEN tool NOT IN ('Write', 'Edit', 'MultiEdit') OR NOT suffix(file, '.py') THEN 'skipped' WHEN contains(text, '@allow-duplicate:') THEN 'overridden' WHEN starts_with(text, 'import ') THEN 'trivial' ELSE 'look' END AS verdict FROM {values(EDITS, 'tool, file, text')}"),
    "guard_duplicates": (guard_duplicates, f"SELECT file, name FROM (SELECT file, unnest(regexp_extract_all(text, '(?m)^\\s*(?:async\\s+def|def|class)\\s+(\\w+)', 1)) AS name FROM {values(EDITS, 'tool, file, text')} WHERE tool IN ('Write', 'Edit') AND suffix(file, '.py') AND NOT contains(text, '@allow') AND NOT starts_with(text, 'import')) WHERE name IN ('load', 'run')"),
    "guard_reply": (guard_reply, f"WITH b AS (SELECT id, try_cast(regexp_extract(text, '(?s)(\\{{.*\\}})', 1) AS JSON) AS j FROM {values(REPLIES, 'id, text')}) SELECT id, coalesce(j->>'$.hasIssues', 'false') = 'true' AS flagged, coalesce(j->>'$.reason', '') AS reason FROM b"),
    "graph_entities": (graph_entities, f"WITH o AS (SELECT src AS name, count(*) AS n FROM {EDGES} GROUP BY 1), i AS (SELECT dst AS name, count(*) AS n FROM {EDGES} GROUP BY 1) SELECT entity_type, count(*) AS entities, CAST(sum(coalesce(i.n, 0)) AS BIGINT) AS in_degree, CAST(sum(coalesce(o.n, 0)) AS BIGINT) AS out_degree FROM {NODES} e LEFT JOIN o USING (name) LEFT JOIN i USING (name) WHERE o.n IS NOT NULL OR i.n IS NOT NULL GROUP BY 1"),
}
