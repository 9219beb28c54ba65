"""Row-builder queries: literal tables where the driver's tables have no counterpart, whole tables elsewhere."""

from __future__ import annotations

from pyspark.sql import functions as F

from lorestone.operators import rows as R
from lorestone.operators import search as S
from lorestone.query_sets.graph import NAM, REL, _rows, names, relations, values
from lorestone.query_sets.scalars import SRC, _sources
from lorestone.query_sets.search import ITEMS, _texts_asked, keyword_sql
from lorestone.query_sets.stats import CHUNKS
from lorestone.sources.tables import chunks, table, texts

ENT = (("load", "function", ["description: reads a file", "method: one", "method: two"], "src/io/load.py"), ("", "class", [], "a.py"), ("userName", "variable", [], "b.py"), (None, "class", ["x"], "c.py"), ("Box", "class", ["note"], None))
LINES = ((1, "# comment"), (2, "a = 1"), (3, "b=x=y"), (4, ""), (5, "flag = TRUE"), (6, "a = 2.5"), (7, "nothing"))
JSONS = ((1, '{"items": [{"title": " T ", "body": "B", "author": "me", "replies": [{"author": "you", "text": "R"}]}, {"id": "7", "content": "C"}, {}]}'), (2, '{"other": []}'), (3, '{"items": []}'))
NOTES = (
    (1, "# Title\n\nSearch... ⌘K\n* [Login](https://x.y/login)\n**bold** and `code`\n- item\n\n\n\nOn this page\n\nCopy page\nCopy\nWas this page helpful? Yes No\nx linkedin discord\n"), (2, "no title"),
    (3, "## Sub\n![img](a.png) text\n* [Next page](https://docs.x.y/next)\n* * *\nsee the\n[guide](z)\nsee the\nword"), (4, "## \n[\u200b](https://docs.x.y/a#b)\nText\n##\n[One](https://docs.x.y/1)[Two](https://docs.x.y/2)\n  Check the\nlist"),
)
DOCSTRINGS = ((1, "Validates and returns the input."), (2, "Nothing."), (3, "Parses text, raises errors"))
SAVED = (("note", "decision", "kept"), ("load", "pattern", "seen"))
CHANGES = (("a.py", None, "1"), ("b.py", "1", "1"), ("c.py", "1", "2"))


def entity_defaults(spark, sf_dir):
    e = _rows(spark, ENT, "name string, entity_type string, observations array<string>, file string")
    return R.entities(e).select("name", F.array_join("observations", "|").alias("observations"))


def bm25_content_format(spark, sf_dir):
    e = _rows(spark, ENT, "name string, entity_type string, observations array<string>, file string").where("name <> ''")
    return e.select("name", R.keyword_text(F.col("name"), F.col("entity_type"), F.col("file"), F.col("observations")).alias("content"))


def has_implementation(spark, sf_dir):
    """Labelled documents are metadata rows, documents of an even id the implementations; German stands for a type without."""
    c = chunks(spark, sf_dir)
    meta = c.where("chunk_type = 'metadata'").select("entity_name", F.when(F.col("entity_type") == "de", "variable").otherwise("function").alias("entity_type"))
    return R.with_implementation_flag(meta, c.where("chunk_type = 'implementation' AND id % 2 = 0"))


def removed_entities(spark, sf_dir):
    """Orders as files and their lines as entities: lines with a return flag are gone, orders of an odd id were not parsed."""
    line = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("file_path"), F.col("l_linenumber").alias("entity_name"), "l_returnflag")
    return R.removed_entities(line.drop("l_returnflag"), line.where("l_returnflag = 'N' AND file_path % 2 = 0")).select("file_path", "entity_name").distinct()


def settings_file(spark, sf_dir):
    return R.settings(_rows(spark, LINES, "n int, text string"))


def corpus_fingerprint(spark, sf_dir):
    return R.corpus_fingerprint(texts(spark, sf_dir))


def cache_eviction(spark, sf_dir):
    """Part keys of the orders' lines asked in order, a cache of 500."""
    asked = table(spark, sf_dir, "lineitem").select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("at"), F.col("l_partkey").alias("key"))
    return R.evicted(asked, 500)


def json_items(spark, sf_dir):
    return R.items(_rows(spark, JSONS, "id int, json string"), "items")


def docs_noise(spark, sf_dir):
    return _rows(spark, NOTES, "id int, text string").select("id", R.without_noise(F.col("text")).alias("clean"), R.page_title(F.col("text")).alias("title"))


def markdown_html(spark, sf_dir):
    return _rows(spark, NOTES, "id int, text string").select("id", R.markdown_to_html(F.col("text")).alias("html"))


def docstring_behaviours(spark, sf_dir):
    return _rows(spark, DOCSTRINGS, "id int, text string").select("id", F.array_join(R.behaviours(F.col("text")), ",").alias("behaviours"))


def framework_tags(spark, sf_dir):
    return _sources(spark).select("file", F.array_join(R.framework_tags(F.col("text")), ",").alias("tags"))


def quality_scores(spark, sf_dir):
    d = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id")
    size = F.least(F.length("text") / 2000, F.lit(1.0))
    return d.select("doc_id", R.quality_score([(F.col("quality"), 0.3), (1 - F.col("toxic"), 0.25), (size, 0.2), ((F.col("lang") == "en").cast("int"), 0.15), ((F.col("n_chars") > 100).cast("int"), 0.1)]).alias("score"))


def backup_manual(spark, sf_dir):
    return R.backup(_rows(spark, SAVED, "entity_name string, entity_type string, content string"), relations(spark)).select("id", F.length("json").alias("n"))


def restore_manual(spark, sf_dir):
    saved = R.backup(_rows(spark, SAVED, "entity_name string, entity_type string, content string"), relations(spark).where("false"))
    stored = saved.where("id = 'note'").select(F.conv(F.substring(F.sha2("id", 256), 1, 16), 16, 10).cast("decimal(20,0)").cast("string").alias("point_id"))
    return R.restore(saved, stored).select("point_id", "id")


def file_status(spark, sf_dir):
    c = _rows(spark, CHANGES, "file string, old string, new string")
    return c.select("file", F.when(F.col("old").isNull(), "ADDED").when(F.col("old") == F.col("new"), "UNCHANGED").otherwise("MODIFIED").alias("status"))


def relation_hashes(spark, sf_dir):
    """Hashes of a file's relations, counted and folded into one per customer."""
    o = table(spark, sf_dir, "orders").select("o_custkey", F.md5(F.concat_ws("::", F.col("o_custkey").cast("string"), F.lit("contains"), F.col("o_orderkey").cast("string"))).alias("h"))
    return o.groupBy("o_custkey").agg(F.count(F.lit(1)).alias("relations"), F.md5(F.array_join(F.sort_array(F.collect_list("h")), "")).alias("digest"))


def payload_filter(spark, sf_dir):
    """Equality on several payload fields at once."""
    return table(spark, sf_dir, "orders").where("o_orderstatus = 'F' AND o_orderpriority = '1-URGENT'").select("o_orderkey", "o_custkey")


def search_similar_chunks(spark, sf_dir):
    """Keyword mode with a filter on entity type or chunk type."""
    c = chunks(spark, sf_dir).where("entity_type = 'fr' OR chunk_type = 'metadata'").select((F.col("id") * 2 + (F.col("chunk_type") == "metadata").cast("int")).alias("id"), F.col("content").alias("text"))
    return S.keyword(c, _texts_asked(spark, sf_dir), 50)


def name_universe(spark, sf_dir):
    """Stored names and those of the run, once each."""
    return names(spark).unionAll(relations(spark).select(F.col("src").alias("name"))).distinct()


def entities_of_file(spark, sf_dir):
    """Names of each file by chunk type, for all files."""
    return chunks(spark, sf_dir).groupBy("file_path").agg(F.count(F.when(F.col("chunk_type") == "metadata", 1)).alias("metadata"), F.count(F.when(F.col("chunk_type") == "implementation", 1)).alias("implementation"))


def inactive_conversations(spark, sf_dir):
    """Users without an event in the last 24 hours of the log."""
    e = table(spark, sf_dir, "events")
    last = e.agg(F.max("ts").alias("now"))
    return e.groupBy("user_id").agg(F.max("ts").alias("seen")).join(F.broadcast(last)).where(F.unix_micros(F.col("now").cast("timestamp")) - F.unix_micros(F.col("seen").cast("timestamp")) > 24 * 3_600_000_000).select("user_id")


def checklist(spark, sf_dir):
    """A Markdown checklist of conversations, one line each, told done by their last role."""
    c = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.max_by("role", "turn").alias("last"), F.count(F.lit(1)).alias("turns"))
    return c.select("conv_id", F.concat(F.when(F.col("last") == "assistant", "- [x] ").otherwise("- [ ] "), F.lit("conversation "), F.col("conv_id").cast("string"), F.lit(" ("), F.col("turns").cast("string"), F.lit(" turns)")).alias("line"))


ENTS, JSN, NOT = values(ENT, "name, entity_type, observations, file"), values(JSONS, "id, json"), values(NOTES, "id, text")
SAV = values(SAVED, "entity_name, entity_type, content")
TAGGED = lambda kind: f"list_transform(list_filter(observations, lambda o: starts_with(lower(o), '{kind}:')), lambda o: trim(string_split(o, ':')[-1]))"
CLEAN = "text"
for _p in R.NOISE:  # without look-ahead: what follows is kept by a group
    _p = _p.replace("{site}", R.DOCS_SITE).replace(r"\u200b", "\u200b")
    _p = _p.replace(r"(?!\w)", r"([^\w]|\z)").replace(r"(?=\[)", r"(\[)")
    CLEAN = f"regexp_replace({CLEAN}, '(?mi){_p}', '{chr(92) + '1' if _p.endswith(')') and '(' in _p and not _p.endswith(chr(92) + ')') else ''}', 'g')"
MARKED = "text"
for _p, _r in ((r"(?m)^### (.+)$", r"<h3>\1</h3>"), (r"(?m)^## (.+)$", r"<h2>\1</h2>"), (r"(?m)^# (.+)$", r"<h1>\1</h1>"), (r"\*\*(.+?)\*\*", r"<strong>\1</strong>"), (r"`([^`]+)`", r"<code>\1</code>"), (r"(?m)^- (.+)$", r"<li>\1</li>")):
    MARKED = f"regexp_replace({MARKED}, '{_p}', '{_r}', 'g')"
HASHED = "CAST('0x' || sha256(text)[{a}:{b}] AS UBIGINT)"
QUERIES = {
    "entity_defaults": (entity_defaults, f"SELECT name, CASE WHEN len(observations) > 0 THEN array_to_string(observations, '|') ELSE upper(entity_type[1]) || entity_type[2:] || ': ' || name END AS observations FROM {ENTS} WHERE trim(name) <> ''"),
    "bm25_content_format": (bm25_content_format, f"SELECT name, array_to_string(list_filter([name, name, lower(replace(regexp_replace(name, '([a-z])([A-Z])', '\\1 \\2', 'g'), '_', ' ')), {TAGGED('description')}[1], entity_type, string_split(file, '/')[-1], array_to_string({TAGGED('method')}[1:4], ' ')], lambda p: p IS NOT NULL AND trim(p) <> ''), ' ') AS content FROM {ENTS} WHERE name <> ''"),
    "has_implementation": (has_implementation, "SELECT 'doc_' || doc_id AS entity_name, CASE WHEN lang = 'de' THEN 'variable' ELSE 'function' END AS entity_type, lang <> 'de' AND doc_id % 2 = 0 AS has_implementation FROM documents WHERE doc_id IN (SELECT doc_id FROM labels)"),
    "removed_entities": (removed_entities, "WITH p AS (SELECT DISTINCT l_orderkey AS file_path, l_linenumber AS entity_name FROM lineitem WHERE l_returnflag = 'N' AND l_orderkey % 2 = 0) SELECT DISTINCT l_orderkey AS file_path, l_linenumber AS entity_name FROM lineitem WHERE l_orderkey IN (SELECT file_path FROM p) AND (l_orderkey, l_linenumber) NOT IN (SELECT (file_path, entity_name) FROM p)"),
    "settings_file": (settings_file, f"WITH s AS (SELECT n, trim(string_split(text, '=')[1]) AS key, trim(substr(text, strpos(text, '=') + 1)) AS value FROM {values(LINES, 'n, text')} WHERE NOT starts_with(trim(text), '#') AND contains(text, '=')) SELECT key, value, CASE WHEN lower(value) IN ('true', 'false') THEN 'bool' WHEN regexp_full_match(value, '-?\\d+') THEN 'int' WHEN regexp_full_match(value, '-?\\d+\\.\\d+') THEN 'float' ELSE 'text' END AS kind FROM s QUALIFY row_number() OVER (PARTITION BY key ORDER BY n DESC) = 1"),
    "corpus_fingerprint": (corpus_fingerprint, f"SELECT count(*) AS texts, CAST(sum({HASHED.format(a=1, b=12)}) AS VARCHAR) AS first, CAST(sum({HASHED.format(a=13, b=24)}) AS VARCHAR) AS second FROM documents"),
    "cache_eviction": (cache_eviction, "WITH f AS (SELECT l_partkey AS key, min(l_orderkey * 10 + l_linenumber) AS first FROM lineitem GROUP BY 1), n AS (SELECT count(*) AS t FROM f) SELECT key, first, row_number() OVER (ORDER BY first, key) <= CASE WHEN t <= 500 THEN 0 ELSE ((t - 501) // 250) * 250 + 250 END AS evicted FROM f, n"),
    "json_items": (json_items, f"""WITH a AS (SELECT id, CAST(json::JSON->'$.items' AS JSON[]) AS l FROM {JSN}), e AS (SELECT id, unnest(l) AS i, generate_subscripts(l, 1) AS k FROM a)
SELECT id, CAST(k - 1 AS INTEGER) AS index, CASE WHEN i->>'$.title' IS NOT NULL THEN 'item_' || k || '_' || trim(i->>'$.title') WHEN i->>'$.id' IS NOT NULL THEN 'item_' || (i->>'$.id') ELSE 'item_' || k END AS name,
trim(concat_ws(chr(10), i->>'$.title', 'Author: ' || (i->>'$.author'), i->>'$.content', i->>'$.body', i->>'$.text', nullif(array_to_string(list_transform(CAST(i->'$.replies' AS JSON[]), lambda r: concat_ws(chr(10), 'Author: ' || (r->>'$.author'), r->>'$.content', r->>'$.body', r->>'$.text')), chr(10)), ''))) AS text FROM e"""),
    "docs_noise": (docs_noise, f"SELECT id, regexp_replace(regexp_replace(regexp_replace({CLEAN}, '\\n\\s*\\n\\s*\\n', chr(10) || chr(10), 'g'), '(?m)^\\s+', '', 'g'), '^\\s+|\\s+$', '', 'g') AS clean, coalesce(nullif(regexp_extract(text, '(?m)^#\\s+(.+)', 1), ''), 'Untitled') AS title FROM {NOT}"),
    "markdown_html": (markdown_html, f"SELECT id, {MARKED} AS html FROM {NOT}"),
    "docstring_behaviours": (docstring_behaviours, "SELECT id, array_to_string(list_filter([" + ", ".join(f"'{b}'" for b in R.BEHAVIOURS) + f"], lambda b: contains(lower(text), b)), ',') AS behaviours FROM {values(DOCSTRINGS, 'id, text')}"),
    "framework_tags": (framework_tags, "SELECT file, array_to_string(list_filter([" + ", ".join("CASE WHEN " + " OR ".join(f"contains(text, '{m}')" for m in marks) + f" THEN '{n}' END" for n, marks in R.FRAMEWORKS.items()) + f"], lambda t: t IS NOT NULL), ',') AS tags FROM {SRC}"),
    "quality_scores": (quality_scores, "SELECT doc_id, round(quality * 0.3 + (1 - toxic) * 0.25 + least(length(text) / 2000, 1) * 0.2 + (lang = 'en')::INT * 0.15 + (n_chars > 100)::INT * 0.1, 6) AS score FROM documents JOIN labels USING (doc_id)"),
    "backup_manual": (backup_manual, f"SELECT entity_name AS id, CAST(length(json_object('entity_name', entity_name, 'entity_type', entity_type, 'content', content)) AS INTEGER) AS n FROM {SAV} UNION ALL SELECT DISTINCT src || '::' || kind || '::' || dst, CAST(length(json_object('src', src, 'kind', kind, 'dst', dst)) AS INTEGER) FROM {REL} WHERE src IN ('note', 'load') OR dst IN ('note', 'load')"),
    "restore_manual": (restore_manual, f"SELECT CAST(CAST('0x' || sha256(entity_name)[1:16] AS UBIGINT) AS VARCHAR) AS point_id, entity_name AS id FROM {SAV} WHERE entity_name <> 'note'"),
    "file_status": (file_status, f"SELECT file, CASE WHEN old IS NULL THEN 'ADDED' WHEN old = new THEN 'UNCHANGED' ELSE 'MODIFIED' END AS status FROM {values(CHANGES, 'file, old, new')}"),
    "relation_hashes": (relation_hashes, "WITH h AS (SELECT o_custkey, md5(o_custkey || '::contains::' || o_orderkey) AS h FROM orders) SELECT o_custkey, count(*) AS relations, md5(string_agg(h, '' ORDER BY h)) AS digest FROM h GROUP BY 1"),
    "payload_filter": (payload_filter, "SELECT o_orderkey, o_custkey FROM orders WHERE o_orderstatus = 'F' AND o_orderpriority = '1-URGENT'"),
    "search_similar_chunks": (search_similar_chunks, keyword_sql(f"SELECT id * 2 + (chunk_type = 'metadata')::INT AS id, content AS text FROM {CHUNKS} WHERE entity_type = 'fr' OR chunk_type = 'metadata'", ITEMS, 50)),
    "name_universe": (name_universe, f"SELECT name FROM {NAM} UNION SELECT src FROM {REL}"),
    "entities_of_file": (entities_of_file, f"SELECT file_path, count(*) FILTER (chunk_type = 'metadata') AS metadata, count(*) FILTER (chunk_type = 'implementation') AS implementation FROM {CHUNKS} GROUP BY 1"),
    "inactive_conversations": (inactive_conversations, "SELECT user_id FROM events GROUP BY 1 HAVING epoch_us((SELECT max(ts) FROM events)) - epoch_us(max(ts)) > 24 * 3600000000"),
    "checklist": (checklist, "SELECT conv_id, CASE WHEN arg_max(role, turn) = 'assistant' THEN '- [x] ' ELSE '- [ ] ' END || 'conversation ' || conv_id || ' (' || count(*) || ' turns)' AS line FROM conversations GROUP BY 1"),
}
