"""Chat and chunking queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from lorestone.functions.text import word_count
from lorestone.operators import chat as C
from lorestone.operators import chunking as K
from lorestone.query_sets.graph import _rows, values
from lorestone.sources.tables import table, texts

RAW = (
    (1, '{"message": {"role": "user", "content": "hello"}}'), (2, '{"role": "assistant", "content": [{"type": "text", "text": "a"}, {"type": "image", "text": "x"}, {"type": "text", "text": "b"}]}'),
    (3, '{"type": "response", "text": "done"}'), (4, "not json"), (5, '{"role": "user", "content": ""}'), (6, '{"type": "user", "content": "plain"}'),
)
TALK = (
    (1, 0, "user", "There is an error and a crash, fix the bug"), (1, 1, "assistant", "```python\ndef f(): pass\n``` and ```sql\nSELECT 1\n```"), (2, 0, "user", "A new idea for the roadmap"), (2, 1, "assistant", "```bash\nls\n``` ```js\nconst a = 1\n```"),
    (3, 0, "user", "nothing to see"), (3, 1, "assistant", "config and docker setup"), (4, 0, "user", "pattern pattern problem"), (4, 1, "user", "``` no tag"),
)


def talk(spark):
    return _rows(spark, TALK, "conv_id long, turn long, role string, text string")


def message_normalize(spark, sf_dir):
    return C.normalized(_rows(spark, RAW, "id long, json string"))


def conversation_text(spark, sf_dir):
    return C.conversation_text(table(spark, sf_dir, "conversations"))


def chat_metadata(spark, sf_dir):
    return C.metadata(table(spark, sf_dir, "conversations"), word_count(F.col("text")))


def chat_category(spark, sf_dir):
    """Of the conversations and of a small literal log whose keywords are known."""
    stored = C.conversation_text(table(spark, sf_dir, "conversations")).select(F.lit("stored").alias("source"), "conv_id", "content")
    small = C.conversation_text(talk(spark)).select(F.lit("small").alias("source"), "conv_id", "content")
    return stored.unionAll(small).select("source", "conv_id", C.category(F.col("content")).alias("category"))


def chat_keywords(spark, sf_dir):
    return C.keywords(table(spark, sf_dir, "conversations"))


def primary_language(spark, sf_dir):
    return C.primary_language(talk(spark))


def code_messages(spark, sf_dir):
    return talk(spark).select("conv_id", "turn", C.has_code(F.col("text")).alias("has_code"))


def chat_limit(spark, sf_dir):
    """The newest conversations, a top-k report."""
    return table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.count(F.lit(1)).alias("turns")).orderBy(F.desc("conv_id")).limit(20)


def line_chunks(spark, sf_dir):
    return K.line_chunks(texts(spark, sf_dir)).select("id", "chunk", "start_line", F.sha2("content", 256).alias("content_hash"))


def overlap_context(spark, sf_dir):
    return K.with_overlap(K.line_chunks(texts(spark, sf_dir), 5)).select("id", "chunk", F.length("overlap").alias("overlap_length"), F.md5("overlap").alias("overlap_md5"))


def token_batches(spark, sf_dir):
    """Batches of texts by source, of at most 5000 estimated tokens and 8 texts."""
    docs = table(spark, sf_dir, "documents").select("source", "doc_id", F.greatest(F.lit(1), F.floor(F.length("text") / 4)).alias("tokens"))
    return K.budget_batches(docs, "source", "doc_id", "tokens", 5000, 8)


TEXT = "(SELECT {s} AS source, conv_id, string_agg(upper(role) || ': ' || text, chr(10) || chr(10) ORDER BY turn) AS content FROM {t} GROUP BY conv_id)"
HITS = "[" + ", ".join("len(list_filter([" + ", ".join(f"'{k}'" for k in keys) + "], lambda k: contains(lower(content), k)))" for keys in C.CATEGORIES.values()) + "]"
CATS = "[" + ", ".join(f"'{c}'" for c in C.CATEGORIES) + "]"
MARK = " OR ".join(f"contains(text, '{m}')" for m in C.CODE_MARKERS)
LINES_SQL = "(SELECT doc_id AS id, list_transform(string_split(text, chr(10)), lambda s: CASE WHEN length(s) > 1000 THEN s[1:1000] || '...' ELSE s END) AS p FROM documents)"
CHUNK_SQL = "(SELECT id, CAST(c AS INTEGER) AS chunk, array_to_string(p[c * {n} + 1:c * {n} + {n}], chr(10)) AS content FROM " + LINES_SQL + ", unnest(range(0, (len(p) - 1) // {n} + 1)) AS u(c))"
QUERIES = {
    "message_normalize": (message_normalize, f"""WITH r AS (SELECT id, try_cast(json AS JSON) AS j FROM {values(RAW, 'id, json')}), x AS (SELECT id, coalesce(j->>'$.message.role', j->>'$.role', CASE j->>'$.type' WHEN 'response' THEN 'assistant' ELSE j->>'$.type' END) AS role,
coalesce(j->'$.message.content', j->'$.content', j->'$.text') AS c FROM r)
SELECT id, role, content FROM (SELECT id, role, CASE WHEN json_type(c) = 'ARRAY' THEN array_to_string(list_transform(list_filter(CAST(c AS JSON[]), lambda p: p->>'$.type' = 'text'), lambda p: p->>'$.text'), chr(10)) ELSE c->>'$' END AS content FROM x) WHERE role IS NOT NULL AND content <> ''"""),
    "conversation_text": (conversation_text, f"SELECT conv_id, content FROM {TEXT.format(s=1, t='conversations')}"),
    "chat_metadata": (chat_metadata, f"SELECT conv_id, count(*) AS messages, CAST(sum(len(list_filter(regexp_split_to_array(text, '\\s+'), lambda w: w <> ''))) AS BIGINT) AS words, bool_or({MARK}) AS has_code, count(DISTINCT role) AS roles FROM conversations GROUP BY conv_id"),
    "chat_category": (chat_category, f"WITH t AS (SELECT * FROM {TEXT.format(s=chr(39) + 'stored' + chr(39), t='conversations')} UNION ALL SELECT * FROM {TEXT.format(s=chr(39) + 'small' + chr(39), t=values(TALK, 'conv_id, turn, role, text'))}), h AS (SELECT source, conv_id, {HITS} AS h FROM t) SELECT source, conv_id, CASE WHEN list_max(h) = 0 THEN 'implementation_pattern' ELSE ({CATS})[list_position(h, list_max(h))] END AS category FROM h"),
    "chat_keywords": (chat_keywords, "WITH w AS (SELECT conv_id, unnest(regexp_split_to_array(lower(text), '\\s+')) AS word FROM conversations), c AS (SELECT conv_id, word, count(*) AS n FROM w WHERE length(word) > 4 AND word NOT IN (" + ", ".join(f"'{w}'" for w in C.STOP_WORDS) + ") GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY n DESC, word) AS r FROM c) SELECT conv_id, string_agg(word, ' ' ORDER BY r) AS query FROM r WHERE r <= 3 AND n > 1 GROUP BY conv_id"),
    "primary_language": (primary_language, f"WITH g AS (SELECT conv_id, turn, unnest(regexp_extract_all(text, '```(\\w+)', 1)) AS tag, generate_subscripts(regexp_extract_all(text, '```(\\w+)', 1), 1) AS pos FROM {values(TALK, 'conv_id, turn, role, text')}), c AS (SELECT conv_id, tag, count(*) AS n, min(turn * 1000 + pos) AS first FROM g WHERE tag NOT IN ('bash', 'shell', 'sh', 'text') GROUP BY ALL) SELECT conv_id, tag AS language FROM c QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY n DESC, first) = 1"),
    "code_messages": (code_messages, f"SELECT conv_id, turn, {MARK} AS has_code FROM {values(TALK, 'conv_id, turn, role, text')}"),
    "chat_limit": (chat_limit, "SELECT conv_id, count(*) AS turns FROM conversations GROUP BY 1 ORDER BY 1 DESC LIMIT 20"),
    "line_chunks": (line_chunks, f"SELECT id, chunk, chunk * 50 + 1 AS start_line, sha256(content) AS content_hash FROM {CHUNK_SQL.format(n=50)} WHERE length(trim(content)) > 10"),
    "overlap_context": (overlap_context, f"WITH c AS (SELECT * FROM {CHUNK_SQL.format(n=5)} WHERE length(trim(content)) > 10), o AS (SELECT id, chunk, coalesce(right(lag(content) OVER (PARTITION BY id ORDER BY chunk), 200), '') AS o FROM c) SELECT id, chunk, CAST(length(o) AS INTEGER) AS overlap_length, md5(o) AS overlap_md5 FROM o"),
    "token_batches": (token_batches, """WITH RECURSIVE d AS (SELECT source, doc_id, greatest(1, length(text) // 4) AS t, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS r FROM documents),
b AS (SELECT source, doc_id, r, t AS s, 1 AS n, 0 AS batch FROM d WHERE r = 1 UNION ALL
SELECT d.source, d.doc_id, d.r, CASE WHEN s + t <= 5000 AND n < 8 THEN s + t ELSE t END, CASE WHEN s + t <= 5000 AND n < 8 THEN n + 1 ELSE 1 END, CASE WHEN s + t <= 5000 AND n < 8 THEN batch ELSE batch + 1 END FROM b JOIN d ON d.source = b.source AND d.r = b.r + 1)
SELECT source, doc_id, batch FROM b"""),
}
