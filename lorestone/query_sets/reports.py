"""Reports over chats and collections, searches by mode, and what is alike."""

from __future__ import annotations

from pyspark.sql import functions as F

from lorestone.functions.text import word_count
from lorestone.operators import builders as B
from lorestone.operators import chat as C
from lorestone.operators import search as S
from lorestone.operators import stats as A
from lorestone.plans import chat_index as I
from lorestone.plans import clusters as K
from lorestone.query_sets.chat import MARK, TALK, TEXT, talk
from lorestone.query_sets.graph import EDGES, _rows, values
from lorestone.query_sets.search import COSINE, DENSE_SQL, DOCS, ITEMS, TOKENS_SQL, _asked, _dense50, _ranked, _sparse50, _texts_asked, keyword_sql
from lorestone.query_sets.stats import CHUNKS
from lorestone.sources.store import staged
from lorestone.sources.tables import chunks, contains_edges, nodes, table, texts, vectors

LOG = (
    (1, 1, '{"type": "user", "message": {"role": "user", "content": "hello there "}}'), (1, 2, '{"type": "user", "message": {"role": "user", "content": "Caveat: generated"}}'), (1, 3, '{"type": "user", "message": {"role": "user", "content": "run <command-name>x"}}'),
    (1, 4, '{"type": "assistant", "message": {"role": "assistant", "content": [{"type": "text", "text": "one"}, {"type": "tool_use"}, {"type": "text", "text": "two"}]}}'), (1, 5, "broken {"), (1, 6, '{"type": "system", "message": {"role": "user", "content": "no"}}'),
    (1, 7, '{"type": "user", "message": {"role": "user", "content": [{"type": "text", "text": "parts"}]}}'), (1, 8, '{"type": "user", "message": {"role": "user", "content": "  "}}'),
)
LISTED = (("# Chats",), ("- [ ] **Session ID**: abc-1 (open)",), ("- [x] **Session ID**: def-2",), ("  - [x] **Session ID**: abc-1",), ("**Session ID**: none",), ("- [ ] other",))
PRICES = (("small", 0.00002), ("large", 0.00013))


def chat_messages(spark, sf_dir):
    """What people and assistants said, without system texts, with line numbers."""
    return C.spoken(_rows(spark, LOG, "id long, line int, json string"))


def listed_sessions(spark, sf_dir):
    return C.listed_sessions(_rows(spark, LISTED, "text string"))


def chat_topics(spark, sf_dir):
    """Of the stored conversations and of the small log."""
    stored, small = table(spark, sf_dir, "conversations"), talk(spark)
    one = lambda m, s: C.topics(m).select(F.lit(s).alias("source"), "conv_id", F.array_join("topics", ",").alias("topics"))
    return one(stored, "stored").unionAll(one(small, "small"))


def chat_report_categories(spark, sf_dir):
    return C.report_categories(C.conversation_text(table(spark, sf_dir, "conversations")))


def chat_durations(spark, sf_dir):
    """Events of a user as a conversation."""
    e = table(spark, sf_dir, "events").select(F.col("user_id").alias("conv_id"), F.col("ts").cast("timestamp").alias("ts"))
    return C.durations(e).select("conv_id", F.unix_micros("first").alias("first"), F.unix_micros("last").alias("last"), "duration_minutes")


def chat_full_metadata(spark, sf_dir):
    """Counts, words, code, language and times of conversations; users' events stand for the times."""
    c = table(spark, sf_dir, "conversations")
    e = table(spark, sf_dir, "events").select(F.col("user_id").alias("conv_id"), F.col("ts").cast("timestamp").alias("ts"))
    out = C.metadata(c, word_count(F.col("text"))).join(C.primary_language(c), "conv_id", "left").join(C.durations(e), "conv_id", "left")
    return out.select("conv_id", "messages", "words", "has_code", "roles", "language", F.unix_micros("first").alias("first"), F.unix_micros("last").alias("last"))


def chat_active(spark, sf_dir):
    """Users with an event in the last 24 hours of the log: too fresh to be summarised."""
    e = table(spark, sf_dir, "events").select(F.col("user_id").alias("conv_id"), F.col("ts").cast("timestamp").alias("ts"))
    now = e.agg(F.max("ts")).first()[0]
    return C.active(e, F.lit(now))


def chat_summary_files(spark, sf_dir):
    """Both forms of each conversation's summary file, by name and checksum of what they say."""
    m = table(spark, sf_dir, "conversations")
    s = I.summaries(m).join(m.groupBy("conv_id").agg(F.count(F.lit(1)).alias("messages")), "conv_id")
    md = C.summary_files(s, "markdown").select("name", F.md5("content").alias("digest"))
    js = C.summary_files(s, "json").select("name", F.md5(F.concat_ws("|", *[F.get_json_object("content", f"$.{k}") for k in ("session_id", "summary", "category", "message_count")])).alias("digest"))
    return md.unionAll(js)


def chat_search(spark, sf_dir):
    """Keyword search over whole conversations."""
    c = C.conversation_text(table(spark, sf_dir, "conversations")).select(F.col("conv_id").alias("id"), F.col("content").alias("text"))
    return S.keyword(c, _texts_asked(spark, sf_dir), 5)


def search_modes(spark, sf_dir):
    """One set of queries by each mode. The texts are searched once: the keyword mode has the first rows of the hybrid mode's keyword leg."""
    docs, v = texts(spark, sf_dir), vectors(spark, sf_dir)
    queries = staged(_asked(spark, sf_dir).join(docs.withColumnRenamed("id", "query_id"), "query_id"), "queries")
    sparse = S.keyword(docs, queries.select("query_id", "text"), S.leg_size(S.LIMIT))
    out = [S.search(m, queries, v.join(docs.select("id"), "id", "left_semi") if m == "semantic" else v, docs, sparse=sparse).withColumn("mode", F.lit(m)) for m in S.MODES]
    return out[0].unionByName(out[1]).unionByName(out[2])


def search_payload(spark, sf_dir):
    """The nearest vectors with their labels."""
    v = vectors(spark, sf_dir)
    return S.with_payload(S.dense(v, _asked(spark, sf_dir), 3), v.select("id", F.col("kind").alias("label")))


def fitted_keywords(spark, sf_dir):
    """A vocabulary fitted on the documents of an even id, and the sparse vectors of the others by it."""
    d = texts(spark, sf_dir)
    out = S.FittedKeywords(d.where("id % 2 = 0")).embed(d.where("id % 2 = 1"))
    return out.groupBy("id").agg(F.count(F.lit(1)).alias("terms"), F.sum("idx").alias("places"), F.round(F.sum(F.col("weight").cast("decimal(18,6)")), 6).cast("double").alias("weights"))


def metadata_keywords(spark, sf_dir):
    """Keyword search where metadata rows alone have keyword vectors."""
    c = chunks(spark, sf_dir).where("chunk_type = 'metadata'").select("id", F.col("content").alias("text"))
    return S.keyword(c, _texts_asked(spark, sf_dir), 10)


def memory_clusters(spark, sf_dir):
    """Vectors of one label that are alike, by the smallest id of what they are linked with."""
    return K.alike(vectors(spark, sf_dir).withColumnRenamed("kind", "domain"), 0.3)


def _marked(spark, sf_dir):
    return chunks(spark, sf_dir).withColumn("is_manual", F.col("chunk_type") == "metadata")


def database_overview(spark, sf_dir):
    """Types as collections: points, people's notes (labelled rows stand for them), the rest, files."""
    return A.overview(_marked(spark, sf_dir), "entity_type")


def extension_totals(spark, sf_dir):
    return A.extension_totals(_marked(spark, sf_dir).withColumn("file_path", F.concat_ws(".", "file_path", F.when(F.col("id") % 3 > 0, F.col("entity_type")))))


def category_mix(spark, sf_dir):
    """Nodes of the graph by category, customers as people's notes, parts as documentation."""
    n = nodes(spark, sf_dir).select(F.col("name").alias("entity_name"), F.when(F.col("entity_type") == "file", "documentation").otherwise(F.col("entity_type")).alias("entity_type"), (F.col("entity_type") == "class").alias("is_manual"))
    return A.category_mix(n, contains_edges(spark, sf_dir), B.CODE_TYPES)


def manual_share(spark, sf_dir):
    return A.manual_share(_marked(spark, sf_dir))


def embedder_usage(spark, sf_dir):
    """Documents as requests, long ones of the larger model."""
    d = table(spark, sf_dir, "documents").select(F.when(F.length("text") > 1000, "large").when(F.length("text") > 100, "small").otherwise("none").alias("embedder"), F.greatest(F.lit(1), F.floor(F.length("text") / 4)).alias("tokens"))
    return A.usage(d, _rows(spark, PRICES, "embedder string, price double"))


def run_success(spark, sf_dir):
    """Events of a user as items of a run; views went well."""
    e = table(spark, sf_dir, "events").select(F.col("user_id").alias("run"), (F.col("event_id") % 3 != 0).alias("ok"), F.col("ts").cast("timestamp").alias("ts"))
    return A.run_success(e)


def overlapping_sections(spark, sf_dir):
    """Chunks of Markdown texts: no text of a section is lost by grouping, however it was parted and joined."""
    from lorestone.operators.extract import extract

    words = " ".join(f"word{k}" for k in range(40))
    text = "# Top\nintro\n" + "\n".join(f"## Part {k}\n" + f"{words}.\n\n" * (1 + k * k) for k in range(9))
    c = extract(_rows(spark, [("a.md", text)], "file string, text string")).where("row = 'chunk' AND kind = 'implementation'")
    plain = F.regexp_replace("content", r"(?s)\n\n\[Previous context: .*\]$", "")
    return c.agg(F.count(F.lit(1)).alias("chunks"), F.sum(F.size(F.regexp_extract_all(plain, F.lit(r"word\d+"), F.lit(0)))).alias("words"), F.max(F.length(plain) <= 4 * 1000 + 400).alias("bounded")).select("words", "bounded")


LG, LS = values(LOG, "id, line, json"), values(LISTED, "text")
PART = "list_transform(list_filter(CAST(c AS JSON[]), lambda p: p->>'$.type' = 'text'), lambda p: p->>'$.text')"
TOPIC = "(SELECT {s} AS source, * FROM {t})"
LANG = "(SELECT source, conv_id, arg_min(tag, (-n) * 1000000 + first) AS language FROM (SELECT source, conv_id, tag, count(*) AS n, min(turn * 1000 + pos) AS first FROM (SELECT source, conv_id, turn, unnest(regexp_extract_all(text, '```(\\w+)', 1)) AS tag, generate_subscripts(regexp_extract_all(text, '```(\\w+)', 1), 1) AS pos FROM m) WHERE tag NOT IN ('bash', 'shell', 'sh', 'text') GROUP BY ALL) GROUP BY ALL)"
HITS = " UNION ALL ".join(f"SELECT conv_id, {i} AS place, '{c}' AS category, " + " + ".join(f"contains(lower(content), '{k}')::INT" for k in keys) + " AS hits FROM t" for i, (c, keys) in enumerate(C.CATEGORIES.items()))
KEYS = "(SELECT conv_id, string_agg(word, ' ' ORDER BY r) AS query FROM (SELECT conv_id, word, n, row_number() OVER (PARTITION BY conv_id ORDER BY n DESC, word) AS r FROM (SELECT conv_id, word, count(*) AS n FROM (SELECT conv_id, unnest(regexp_split_to_array(lower(text), '\\s+')) AS word FROM conversations) WHERE length(word) > 4 AND word NOT IN (" + ", ".join(f"'{w}'" for w in C.STOP_WORDS) + ") GROUP BY ALL)) WHERE r <= 3 AND n > 1 GROUP BY conv_id)"
BEST = "[" + ", ".join("len(list_filter([" + ", ".join(f"'{k}'" for k in keys) + "], lambda k: contains(lower(content), k)))" for keys in C.CATEGORIES.values()) + "]"
NAMES = "[" + ", ".join(f"'{c}'" for c in C.CATEGORIES) + "]"
EVENT_TIMES = "(SELECT user_id AS conv_id, epoch_us(min(ts)) AS first, epoch_us(max(ts)) AS last FROM events GROUP BY 1)"
_dense10 = _ranked(DENSE_SQL.format(expr=COSINE, where="AND q.vec_id IN (SELECT doc_id FROM documents) AND v.vec_id IN (SELECT doc_id FROM documents)"), 10)
_sparse10 = _sparse50.replace("rank <= 50", "rank <= 10")
QUERIES = {
    "chat_messages": (chat_messages, f"""WITH j AS (SELECT id, line, try_cast(json AS JSON) AS j FROM {LG}), p AS (SELECT id, line, j->>'$.type' AS type, j->>'$.message.role' AS role, (j->'$.message.content') AS c FROM j WHERE j IS NOT NULL),
t AS (SELECT id, line, type, role, trim(CASE WHEN json_type(c) = 'ARRAY' THEN array_to_string({PART}, ' ') ELSE c->>'$' END) AS content FROM p)
SELECT id, CAST(line AS INTEGER) AS line, role, content FROM t WHERE type = role AND content <> '' AND (role = 'assistant' OR NOT (starts_with(content, 'Caveat:') OR contains(content, '<command-name>')))"""),
    "listed_sessions": (listed_sessions, f"SELECT DISTINCT regexp_extract(text, '\\*\\*Session ID\\*\\*:\\s*(\\S+)', 1) AS session FROM {LS} WHERE regexp_matches(trim(text), '^- \\[[ x]\\].*\\*\\*Session ID')"),
    "chat_topics": (chat_topics, f"""WITH m AS (SELECT 'stored' AS source, conv_id, turn, role, text FROM conversations UNION ALL SELECT 'small', conv_id, turn, role, text FROM {values(TALK, 'conv_id, turn, role, text')}), n AS (SELECT *, row_number() OVER (PARTITION BY source, conv_id ORDER BY turn) AS n FROM m),
e AS (SELECT source, conv_id, bool_or(n <= 5 AND regexp_matches(lower(text), 'error|debug|fix')) AS d, bool_or({MARK}) AS c FROM n WHERE n <= 10 GROUP BY ALL)
SELECT source, conv_id, coalesce(nullif(concat_ws(',', language, CASE WHEN d THEN 'debugging' END, CASE WHEN c THEN 'coding' END), ''), 'general') AS topics FROM e LEFT JOIN {LANG} USING (source, conv_id)"""),
    "chat_report_categories": (chat_report_categories, f"WITH t AS (SELECT conv_id, content FROM {TEXT.format(s=1, t='conversations')}), h AS ({HITS}), r AS (SELECT *, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY hits DESC, place) AS INTEGER) AS rank FROM h WHERE hits > 0) SELECT conv_id, rank, category, ([0.95, 0.85, 0.75])[rank]::DOUBLE AS score FROM r WHERE rank <= 3"),
    "chat_durations": (chat_durations, f"SELECT *, round((last - first) / 60000000, 4) AS duration_minutes FROM {EVENT_TIMES}"),
    "chat_full_metadata": (chat_full_metadata, f"""WITH m AS (SELECT 1 AS source, * FROM conversations), g AS (SELECT conv_id, count(*) AS messages, CAST(sum(len(list_filter(regexp_split_to_array(text, '\\s+'), lambda w: w <> ''))) AS BIGINT) AS words, bool_or({MARK}) AS has_code, count(DISTINCT role) AS roles FROM m GROUP BY 1)
SELECT conv_id, messages, words, has_code, roles, language, first, last FROM g LEFT JOIN {LANG} USING (conv_id) LEFT JOIN {EVENT_TIMES} USING (conv_id)"""),
    "chat_active": (chat_active, "SELECT user_id AS conv_id FROM events GROUP BY 1 HAVING epoch_us((SELECT max(ts) FROM events)) - epoch_us(max(ts)) <= 24 * 3600000000"),
    "chat_summary_files": (chat_summary_files, f"""WITH t AS (SELECT conv_id, content, {BEST} AS h FROM {TEXT.format(s=1, t='conversations')}), s AS (SELECT conv_id, content[1:300] AS content, CASE WHEN list_max(h) = 0 THEN 'implementation_pattern' ELSE ({NAMES})[list_position(h, list_max(h))] END AS category, coalesce(query, '') AS query, n FROM t LEFT JOIN {KEYS} USING (conv_id) JOIN (SELECT conv_id, count(*) AS n FROM conversations GROUP BY 1) USING (conv_id))
SELECT conv_id || '_summary.md' AS name, md5('# Chat Summary: ' || conv_id || chr(10) || chr(10) || '**Messages:** ' || n || chr(10) || '**Category:** ' || category || chr(10) || chr(10) || '## Summary' || chr(10) || content || chr(10) || chr(10) || '## Topics' || chr(10) || replace(query, ' ', ', ') || chr(10)) AS digest FROM s
UNION ALL SELECT conv_id || '_summary.json', md5(concat_ws('|', conv_id, content, category, n)) FROM s"""),
    "chat_search": (chat_search, keyword_sql(f"SELECT conv_id AS id, content AS text FROM {TEXT.format(s=1, t='conversations')}", ITEMS, 5)),
    "search_modes": (search_modes, f"""WITH a AS ({_dense50}), b AS ({_sparse50}), s AS (SELECT query_id, id, round(coalesce(0.5 / (60 + a.rank), 0) + coalesce(0.5 / (60 + b.rank), 0), 6) AS score FROM a FULL JOIN b USING (query_id, id)),
h AS ({_ranked('SELECT * FROM s')}), d AS ({_dense10}), k AS ({_sparse10}) SELECT *, 'hybrid' AS mode FROM h UNION ALL SELECT *, 'semantic' FROM d UNION ALL SELECT *, 'keyword' FROM k"""),
    "search_payload": (search_payload, f"WITH d AS ({_ranked(DENSE_SQL.format(expr=COSINE, where=''), 3)}) SELECT d.*, v.label FROM d JOIN embeddings v ON v.vec_id = d.id"),
    "fitted_keywords": (fitted_keywords, f"""WITH f AS (SELECT doc_id AS id, unnest(list_distinct({TOKENS_SQL.format('text')})) AS term FROM documents WHERE doc_id % 2 = 0), n AS (SELECT count(*) AS n FROM documents WHERE doc_id % 2 = 0),
w AS (SELECT term, row_number() OVER (ORDER BY term) - 1 AS idx, round(greatest(0.0, ln((any_value(n) - count(*) + 0.5) / (count(*) + 0.5))), 6) AS weight FROM f, n GROUP BY term),
p AS (SELECT doc_id AS id, unnest(list_distinct({TOKENS_SQL.format('text')})) AS term FROM documents WHERE doc_id % 2 = 1)
SELECT id, count(*) AS terms, CAST(sum(idx) AS BIGINT) AS places, CAST(sum(CAST(weight AS DECIMAL(18,6))) AS DOUBLE) AS weights FROM p JOIN w USING (term) WHERE weight > 0 GROUP BY id"""),
    "metadata_keywords": (metadata_keywords, keyword_sql(f"SELECT id, content AS text FROM {CHUNKS} WHERE chunk_type = 'metadata'", ITEMS, 10)),
    "memory_clusters": (memory_clusters, """WITH RECURSIVE e AS MATERIALIZED (SELECT q.vec_id AS a, v.vec_id AS b FROM embeddings q JOIN embeddings v ON q.label = v.label AND q.vec_id <> v.vec_id AND list_cosine_similarity(q.embedding::DOUBLE[], v.embedding::DOUBLE[]) > 0.3),
g(id, other) AS (SELECT a, a FROM e UNION SELECT g.id, e.b FROM g JOIN e ON g.other = e.a) SELECT id, min(other) AS cluster FROM g GROUP BY id"""),
    "database_overview": (database_overview, f"SELECT entity_type, count(*) AS points, count(*) FILTER (chunk_type = 'metadata') AS manual, count(*) FILTER (chunk_type <> 'metadata') AS automated, count(DISTINCT file_path) AS files FROM {CHUNKS} GROUP BY 1"),
    "extension_totals": (extension_totals, f"SELECT CASE WHEN id % 3 > 0 THEN entity_type ELSE '' END AS extension, count(*) AS points, count(DISTINCT file_path) AS files FROM {CHUNKS} GROUP BY 1"),
    "category_mix": (category_mix, f"""WITH n AS (SELECT 'c' || c_custkey AS name, 'manual' AS category FROM customer UNION ALL SELECT 'o' || o_orderkey, 'code' FROM orders UNION ALL SELECT 'p' || p_partkey, 'documentation' FROM part UNION ALL SELECT 's' || s_suppkey, 'other' FROM supplier), o AS (SELECT src, count(*) AS n FROM {EDGES} GROUP BY src)
SELECT category, count(*) AS entities, CAST(sum(coalesce(o.n, 0)) AS BIGINT) AS relations, count(*) FILTER (o.n >= 5) AS hubs, round(sum(coalesce(o.n, 0)) / count(*), 4) AS relations_per_entity FROM n LEFT JOIN o ON o.src = n.name GROUP BY category"""),
    "manual_share": (manual_share, f"SELECT entity_type, count(*) FILTER (chunk_type = 'metadata') AS manual, count(*) FILTER (chunk_type <> 'metadata') AS automatic FROM {CHUNKS} GROUP BY 1"),
    "embedder_usage": (embedder_usage, f"WITH d AS (SELECT CASE WHEN length(text) > 1000 THEN 'large' WHEN length(text) > 100 THEN 'small' ELSE 'none' END AS embedder, greatest(1, length(text) // 4) AS t FROM documents) SELECT embedder, count(*) AS requests, CAST(sum(t) AS BIGINT) AS tokens, round(sum(t) * any_value(price)::DOUBLE / 1000, 6) AS cost, round(sum(t) / count(*), 4) AS tokens_per_request FROM d LEFT JOIN {values(PRICES, 'embedder, price')} p USING (embedder) GROUP BY embedder"),
    "run_success": (run_success, "SELECT user_id AS run, round(count(*) FILTER (event_id % 3 <> 0) / count(*), 6) AS success_rate, (epoch_us(max(ts)) - epoch_us(min(ts))) / 1000000 AS duration FROM events GROUP BY 1"),
    "overlapping_sections": (overlapping_sections, "SELECT CAST(sum(40 * (1 + k * k)) AS BIGINT) AS words, true AS bounded FROM range(9) t(k)"),
}
