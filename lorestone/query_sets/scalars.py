"""Scalar, page, code and file queries."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from lorestone.functions import text as X
from lorestone.operators import code as C
from lorestone.operators import files as P
from lorestone.operators import web as W
from lorestone.query_sets.graph import _rows, values
from lorestone.sources.tables import chunks, table

SOURCES = (
    ("a.py", "import os\nfrom .util import load as l\nimport a.b.c, sys\nx = load_data(1)\nfoo(bar(2))\ntry:\n    pass\nexcept ValueError as e:\n    raise\nif x:\n    for y in x: os.path.join(y)"),
    ("b.py", "import os\n# note\nfrom sys import argv"), ("c.py", "LIMIT = 3\nNAME = 'x'"), ("d.py", "value = 4"), ("e.py", ""), ("f.py", "def run():\n    return getattr(a, 'b')\nclass Abc(Base):\n    async def go(self): call_me()\n# @allow-duplicate: kept on purpose"),
    ("g.md", "# Title\ntext\n## Part one\n```\n# not a header\n```\n### Deep\n## Part two "), ("h.py", "print(1)\nwhile True:\n    with open(p) as f: pass"),
)
FILES = (("src/a.py", 10), ("src/b.txt", 10), ("node_modules/x.py", 10), ("src/big.py", 2_000_000), ("tests/test_a.py", 5), ("README.md", 5), ("build/lib/c.py", 5), ("src/a.py", 10))
ENTITIES = (("getUserName", ["class: A", "purpose: b", "plain"]), ("run_all", ["Function: x"]), ("plain", []))
STAMPS = (("2024-01-02T03:04:05Z",), ("2024-01-02T03:04:05+02:00",), ("1704164645",), ("2024-01-02 03:04:05",), ("nonsense",))
PAGES = (
    (1, '<a href="#x">1</a><a class="k l" href="/y">2</a><a href="mailto:z">3</a><form action="/go"></form><img src="a.png"><script src="https://x/y.js"></script><my-box id="b1" data-component="Menu"></my-box><style>.k, .m{--c: 1} #b1 {x:y} p{m:0}</style>'),
    (2, ""), (3, "<p>none</p>"),
)
INCLUDE, EXCLUDE = ["*.py", "*.md"], ["node_modules/", "build/", "test_*"]


def _sources(spark):
    return _rows(spark, SOURCES, "file string, text string")


def content_hash(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", X.content_hash(F.col("text")).alias("content_hash"), F.md5("text").alias("md5"))


def point_id(spark, sf_dir):
    c = chunks(spark, sf_dir)
    key = X.chunk_id(F.col("file_path"), F.col("entity_type"), F.col("entity_name"), F.col("chunk_type"))
    return c.select(key.alias("chunk_id"), X.point_id(key).cast("string").alias("point_id"))


def relation_chunk_id(spark, sf_dir):
    """Order lines as relations; the context is left out for every other one."""
    line = table(spark, sf_dir, "lineitem")
    s = lambda c: F.col(c).cast("string")
    return line.select("l_orderkey", "l_linenumber", X.relation_id(s("l_orderkey"), F.lit("references"), s("l_partkey"), F.lit(None).cast("string"), F.when(F.col("l_linenumber") % 2 == 0, F.col("l_returnflag"))).alias("relation_id"))


def token_estimate(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", X.token_estimate(F.col("text")).alias("tokens"), X.word_count(F.col("text")).alias("words"), X.cost(X.token_estimate(F.col("text")), 0.00013).alias("cost"))


def truncate_text(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(X.truncated(F.col("text"), 60)).alias("cut_md5"), F.length(X.truncated(F.col("text"), 60)).alias("cut_length"))


def backoff_delay(spark, sf_dir):
    return spark.range(10).select(F.col("id").alias("attempt"), X.backoff(F.col("id")).alias("delay"))


def metadata_chunk_weighting(spark, sf_dir):
    return _rows(spark, ENTITIES, "name string, observations array<string>").select("name", X.weighted_observations(F.col("observations")).alias("content"), X.split_name(F.col("name")).alias("words"))


def naive_timestamps(spark, sf_dir):
    return _rows(spark, STAMPS, "value string").select("value", X.naive_timestamp(F.col("value")).cast("string").alias("at"))


def path_encoding(spark, sf_dir):
    return chunks(spark, sf_dir).select("file_path", X.encode_path(F.col("file_path")).alias("encoded")).distinct()


def html_strip(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", F.md5(X.plain_text(F.col("html"))).alias("text_md5"), F.length(X.plain_text(F.col("html"))).alias("n_chars"))


def html_links(spark, sf_dir):
    return W.links(table(spark, sf_dir, "pages").select("page_id", "html").unionAll(_rows(spark, PAGES, "page_id long, html string").select((-F.col("page_id")).alias("page_id"), "html")))


def html_class_refs(spark, sf_dir):
    return W.class_references(table(spark, sf_dir, "pages"))


def html_inline_css(spark, sf_dir):
    return W.inline_css(table(spark, sf_dir, "pages").select("page_id", "html").unionAll(_rows(spark, PAGES, "page_id long, html string").select((-F.col("page_id")).alias("page_id"), "html")))


def html_components(spark, sf_dir):
    return W.components(_rows(spark, PAGES, "page_id long, html string"))


def page_changes(spark, sf_dir):
    """Pages of a scrape against the one before by MD5: every third page changed, every fifth is new."""
    now = table(spark, sf_dir, "pages").select("page_id", "url", F.md5("html").alias("hash"))
    before = now.where("page_id % 5 <> 0").select("page_id", F.when(F.col("page_id") % 3 == 0, "x").otherwise(F.col("hash")).alias("old"))
    return now.join(before, "page_id", "left").select("page_id", F.when(F.col("old").isNull(), "new").when(F.col("old") == F.col("hash"), "same").otherwise("changed").alias("change"))


def python_calls(spark, sf_dir):
    return _sources(spark).select("file", F.array_join(C.calls(F.col("text")), ",").alias("calls"), F.array_join(F.filter(C.calls(F.col("text")), C.meaningful), ",").alias("meaningful"))


def code_metrics(spark, sf_dir):
    n = C.complexity(F.col("text"))
    return _sources(spark).select("file", F.array_join(C.qualified_names(F.col("text")), ",").alias("imports_used"), F.array_join(C.exceptions(F.col("text")), ",").alias("exceptions"), n.alias("complexity"), C.complexity_label(n).alias("label"))


def import_scan(spark, sf_dir):
    return C.imports(_sources(spark))


def markdown_headers(spark, sf_dir):
    return C.headers(_sources(spark).where("file LIKE '%.md'"))


def guard_triviality(spark, sf_dir):
    return _sources(spark).where("file LIKE '%.py'").select("file", C.triviality(F.col("text")).alias("kind"), C.override_reason(F.col("text")).alias("reason"), F.array_join(C.definitions(F.col("text")), ",").alias("definitions"))


def json_keys(spark, sf_dir):
    """Keys of the events' properties with their counts."""
    keys = table(spark, sf_dir, "events").select("event_type", F.explode(F.json_object_keys("props")).alias("key"))
    return keys.groupBy("event_type", "key").agg(F.count(F.lit(1)).alias("n"))


def json_values(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", F.get_json_object("props", "$.k").cast("long").alias("k"))


def file_filter(spark, sf_dir):
    return P.admitted(_rows(spark, FILES, "path string, length long"), INCLUDE, EXCLUDE)


def rate_window(spark, sf_dir):
    """For each event the events and the value of its user in the 60 minutes before it."""
    e = table(spark, sf_dir, "events").select("event_id", "user_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("at"), "value")
    w = Window.partitionBy("user_id").orderBy("at").rangeBetween(-3_600_000_000, 0)
    return e.select("event_id", F.count(F.lit(1)).over(w).alias("requests"), F.round(F.sum(F.col("value").cast("decimal(18,6)")).over(w).cast("double"), 4).alias("tokens"))


SRC, PAG, FIL = values(SOURCES, "file, text"), values(PAGES, "page_id, html"), values(FILES, "path, length")
BOTH = f"(SELECT page_id, html FROM pages UNION ALL SELECT -page_id, html FROM {PAG})"
CUT = "CASE WHEN length(text) <= 240 THEN text ELSE CASE WHEN contains(text[1:240], ' ') AND 240 - strpos(reverse(text[1:240]), ' ') > 192 THEN text[1:240 - strpos(reverse(text[1:240]), ' ')] ELSE text[1:240] END || '...' END"
ALL = "list_sort(list_distinct(regexp_extract_all({t}, '{p}', 1)))"
PLAIN = "array_to_string(list_filter(string_split(text, chr(10)), lambda s: NOT regexp_matches(trim(s), '^(async )?def |^class ')), chr(10))"
CALLS = ALL.format(t=PLAIN, p=r"([A-Za-z_][A-Za-z0-9_]*)\s*\(")
COMMON = ", ".join(f"'{w}'" for w in C.COMMON_CALLS)
REAL = "list_filter(list_transform(string_split(text, chr(10)), lambda s: trim(s)), lambda s: s <> '' AND NOT starts_with(s, '#'))"
STRIP = "html"
for _p, _r, _o in (
    (r"(?s)<\?php.*?\?>", "", "g"), (r"(?is)<script[^>]*>.*?</script>", "", "g"), (r"(?is)<style[^>]*>.*?</style>", "", "g"), (r"(?i)<br\s*/?>", "\n", "g"), (r"(?i)</p>", "\n\n", "g"), (r"(?i)<p[^>]*>", "", "g"),
    (r"(?i)<li[^>]*>", "• ", "g"), (r"(?i)</li>", "\n", "g"), (r"<[^>]+>", "", "g"),
):
    STRIP = f"regexp_replace({STRIP}, '{_p}', '{_r}', '{_o}')"
for _p, _r in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "''"), ("&amp;", "&")):
    STRIP = f"replace({STRIP}, '{_p}', '{_r}')"
for _p, _r in ((r"\r\n", "\n"), (r"\n{3,}", "\n\n"), (r"[ \t]+", " "), (r" +\n", "\n"), (r"\n +", "\n"), (r"^\s+|\s+$", "")):
    STRIP = f"regexp_replace({STRIP}, '{_p}', '{_r}', 'g')"
GLOBS = "(regexp_matches(path, '\\.(py|md)$'))"
QUERIES = {
    "content_hash": (content_hash, "SELECT doc_id, sha256(text) AS content_hash, md5(text) AS md5 FROM documents"),
    "point_id": (point_id, "WITH c AS (SELECT source || '/' || doc_id || '::' || lang || '::doc_' || doc_id || '::implementation' AS k FROM documents UNION ALL SELECT source || '/' || doc_id || '::' || lang || '::doc_' || doc_id || '::metadata' FROM documents WHERE doc_id IN (SELECT doc_id FROM labels)) SELECT k AS chunk_id, CAST(CAST('0x' || sha256(k)[1:16] AS UBIGINT) AS VARCHAR) AS point_id FROM c"),
    "relation_chunk_id": (relation_chunk_id, "SELECT l_orderkey, l_linenumber, l_orderkey || '::references::' || l_partkey || CASE WHEN l_linenumber % 2 = 0 THEN '::' || l_returnflag ELSE '' END AS relation_id FROM lineitem"),
    "token_estimate": (token_estimate, "SELECT doc_id, greatest(1, length(text) // 4) AS tokens, len(list_filter(regexp_split_to_array(text, '\\s+'), lambda w: w <> '')) AS words, round(tokens * 0.00013 / 1000, 9) AS cost FROM documents"),
    "truncate_text": (truncate_text, f"SELECT doc_id, md5({CUT}) AS cut_md5, CAST(length({CUT}) AS INTEGER) AS cut_length FROM documents"),
    "backoff_delay": (backoff_delay, "SELECT i AS attempt, least(pow(2.0, i), 60.0) AS delay FROM range(10) r(i)"),
    "metadata_chunk_weighting": (metadata_chunk_weighting, f"SELECT name, array_to_string(flatten(list_transform(observations, lambda o: list_transform(range(CASE WHEN regexp_matches(lower(o), '^(class|function|method|interface|signature):') THEN 3 WHEN regexp_matches(lower(o), '^(purpose|responsibility|description):') THEN 2 ELSE 1 END), lambda i: o))), ' | ') AS content, lower(replace(regexp_replace(name, '([a-z])([A-Z])', '\\1 \\2', 'g'), '_', ' ')) AS words FROM {values(ENTITIES, 'name, observations')}"),
    "naive_timestamps": (naive_timestamps, f"SELECT value, CAST(CASE WHEN regexp_full_match(value, '\\d+(\\.\\d+)?') THEN make_timestamp(CAST(CAST(value AS DOUBLE) * 1000000 AS BIGINT)) ELSE try_cast(regexp_replace(value, '(Z|[+-]\\d\\d:\\d\\d)$', '') AS TIMESTAMP) END AS VARCHAR) AS at FROM {values(STAMPS, 'value')}"),
    "path_encoding": (path_encoding, "SELECT source || '/' || doc_id AS file_path, source || '-' || doc_id AS encoded FROM documents"),
    "html_strip": (html_strip, f"SELECT page_id, md5(t) AS text_md5, CAST(length(t) AS INTEGER) AS n_chars FROM (SELECT page_id, {STRIP} AS t FROM pages)"),
    "html_links": (html_links, f"""SELECT page_id, 'anchor' AS kind, target FROM (SELECT page_id, unnest(regexp_extract_all(html, '(?i)<a\\s[^>]*?href\\s*=\\s*["'']([^"'']+)["'']', 1)) AS target FROM {BOTH}) WHERE NOT regexp_matches(target, '(?i)^(#|javascript:|mailto:)')
UNION ALL SELECT page_id, 'form', unnest(regexp_extract_all(html, '(?i)<form\\s[^>]*?action\\s*=\\s*["'']([^"'']+)["'']', 1)) FROM {BOTH}
UNION ALL SELECT * FROM (SELECT page_id, 'resource', unnest(regexp_extract_all(html, '(?i)<(?:script|img|link)\\s[^>]*?(?:src|href)\\s*=\\s*["'']([^"'']+)["'']', 1)) AS target FROM {BOTH}) WHERE NOT regexp_matches(target, '(?i)^(https?:)?//')"""),
    "html_class_refs": (html_class_refs, """SELECT DISTINCT page_id, '.' || n AS class_name FROM (SELECT page_id, unnest(regexp_split_to_array(c, '\\s+')) AS n FROM (SELECT page_id, unnest(regexp_extract_all(html, '(?i)<[a-z][^>]*?\\sclass\\s*=\\s*["'']([^"'']+)["'']', 1)) AS c FROM pages)) WHERE n <> ''"""),
    "html_inline_css": (html_inline_css, f"""WITH c AS (SELECT page_id, unnest(regexp_extract_all(html, '(?is)<style[^>]*>(.*?)</style>', 1)) AS css FROM {BOTH})
SELECT DISTINCT * FROM (SELECT page_id, 'class' AS kind, unnest(regexp_extract_all(css, '\\.([A-Za-z_][\\w-]*)\\s*[{{,]', 1)) AS name FROM c UNION ALL SELECT page_id, 'id', unnest(regexp_extract_all(css, '#([A-Za-z_][\\w-]*)\\s*[{{,]', 1)) FROM c
UNION ALL SELECT page_id, 'variable', unnest(regexp_extract_all(css, '(--[\\w-]+)\\s*:', 1)) FROM c UNION ALL SELECT page_id, 'element', unnest(regexp_extract_all(css, '(?:^|\\}})\\s*([a-z][a-z0-9]*)\\s*\\{{', 1)) FROM c)"""),
    "html_components": (html_components, f"""SELECT DISTINCT * FROM (SELECT page_id, 'id' AS kind, unnest(regexp_extract_all(html, '(?i)\\sid\\s*=\\s*["'']([^"'']+)["'']', 1)) AS name FROM {PAG} UNION ALL SELECT page_id, 'custom', unnest(regexp_extract_all(html, '(?i)<([a-z][a-z0-9]*-[a-z0-9-]+)[\\s>/]', 1)) FROM {PAG}
UNION ALL SELECT page_id, 'component', unnest(regexp_extract_all(html, '(?i)data-component\\s*=\\s*["'']([^"'']+)["'']', 1)) FROM {PAG})"""),
    "page_changes": (page_changes, "SELECT page_id, CASE WHEN page_id % 5 = 0 THEN 'new' WHEN page_id % 3 = 0 THEN 'changed' ELSE 'same' END AS change FROM pages"),
    "python_calls": (python_calls, f"SELECT file, array_to_string({CALLS}, ',') AS calls, array_to_string(list_filter({CALLS}, lambda n: NOT list_contains([{COMMON}], n) AND length(n) > 2 AND (contains(n, '_') OR length(n) > 4 OR regexp_matches(n, '[a-z][A-Z]'))), ',') AS meaningful FROM {SRC}"),
    "code_metrics": (code_metrics, f"WITH m AS (SELECT file, array_to_string({ALL.format(t='text', p='([A-Za-z_][A-Za-z0-9_]*[.][A-Za-z_][A-Za-z0-9_]*)')}, ',') AS imports_used, array_to_string({ALL.format(t='text', p='except[ ]+([A-Za-z_][A-Za-z0-9_.]*)')}, ',') AS exceptions, CAST(1" + "".join(f" + (length(text) - length(replace(text, '{w}', ''))) // {len(w)}" for w in C.COMPLEXITY_WORDS) + f" AS INTEGER) AS complexity FROM {SRC}) SELECT *, CASE WHEN complexity > 5 THEN 'high' WHEN complexity >= 2 THEN 'moderate' ELSE 'low' END AS label FROM m"),
    "import_scan": (import_scan, f"WITH l AS (SELECT file, unnest(string_split(text, chr(10))) AS s, generate_subscripts(string_split(text, chr(10)), 1) AS line FROM {SRC}) SELECT file, CAST(line AS INTEGER) AS line, coalesce(nullif(regexp_extract(s, '^\\s*from\\s+([.\\w]+)\\s+import\\s', 1), ''), nullif(regexp_extract(s, '^\\s*import\\s+([.\\w]+)', 1), '')) AS module FROM l WHERE module IS NOT NULL"),
    "markdown_headers": (markdown_headers, f"WITH l AS (SELECT file, unnest(string_split(text, chr(10))) AS s, generate_subscripts(string_split(text, chr(10)), 1) AS line FROM {SRC} WHERE file LIKE '%.md'), f AS (SELECT *, count(*) FILTER (starts_with(s, '```')) OVER (PARTITION BY file ORDER BY line) AS fences FROM l) SELECT file, CAST(line AS INTEGER) AS line, CAST(length(regexp_extract(s, '^(#+)', 1)) AS INTEGER) AS level, regexp_extract(s, '^#+\\s+(.*?)\\s*$', 1) AS title FROM f WHERE regexp_matches(s, '^#{{1,2}}\\s+\\S') AND fences % 2 = 0"),
    "guard_triviality": (guard_triviality, f"WITH r AS (SELECT file, text, {REAL} AS r FROM {SRC} WHERE file LIKE '%.py') SELECT file, CASE WHEN len(r) = 0 THEN 'empty' WHEN len(list_filter(r, lambda s: NOT regexp_matches(s, '^(import|from)\\s'))) = 0 THEN 'import_only' WHEN regexp_matches(text, '(?m)^\\s*(async\\s+def|def|class)\\s+\\w+') THEN 'definition' WHEN len(list_filter(r, lambda s: NOT regexp_matches(s, '^[A-Z][A-Z0-9_]*\\s*='))) = 0 THEN 'constant' WHEN len(r) <= 2 AND len(list_filter(r, lambda s: NOT regexp_matches(s, '^[A-Za-z_][\\w.]*\\s*=[^=]'))) = 0 THEN 'assignment' ELSE 'other' END AS kind, nullif(trim(regexp_extract(text, '(?i)(?:#|//)\\s*@?allow-duplicate:\\s*([^\\n]+)', 1)), '') AS reason, array_to_string(regexp_extract_all(text, '(?m)^\\s*(?:async\\s+def|def|class)\\s+(\\w+)', 1), ',') AS definitions FROM r"),
    "json_keys": (json_keys, "SELECT event_type, key, count(*) AS n FROM (SELECT event_type, unnest(json_keys(props)) AS key FROM events) GROUP BY ALL"),
    "json_values": (json_values, "SELECT event_id, CAST(props->>'$.k' AS BIGINT) AS k FROM events"),
    "file_filter": (file_filter, f"SELECT DISTINCT path, length FROM {FIL} WHERE {GLOBS} AND NOT regexp_matches('/' || path, '/(node_modules|build)/') AND NOT regexp_matches(path, '(^|/)test_[^/]*$') AND length <= 1048576"),
    "rate_window": (rate_window, "SELECT event_id, count(*) OVER w AS requests, round(CAST(sum(CAST(value AS DECIMAL(18,6))) OVER w AS DOUBLE), 4) AS tokens FROM events WINDOW w AS (PARTITION BY user_id ORDER BY epoch_us(ts) RANGE BETWEEN 3600000000 PRECEDING AND CURRENT ROW)"),
}
