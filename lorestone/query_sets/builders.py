"""Queries over row builders: texts, payloads, keys and tests of entities, relations, chats and edits."""

from __future__ import annotations

from pyspark.sql import functions as F

from lorestone.operators import builders as B
from lorestone.operators import code as C
from lorestone.operators.rows import payload_filter as filtered
from lorestone.query_sets.graph import ROW, _rows, _stored, values
from lorestone.sources.tables import table

RELS = (
    ("a", "b", "calls", None, None, None), ("a", "", "calls", None, 0.5, None), ("x", "y", "references", "seen", 0.25, None), ("y", "x", "uses", None, 1.5, None), ("f.py", "os", "imports", None, 1.0, "module"), ("f.py", "d.csv", "imports", "ctx", None, "pandas_csv_read"),
    ("C", "D", "inherits", None, 0.0, None), ("f.py", "C", "contains", None, -0.1, None), (None, "z", "uses", None, None, None), ("p", "q", "uses", None, 0.9, None),
)
RCOLS = "src, dst, kind, context, confidence, import_type"
MADE = (
    ("load", "function", "io.py", 3, "load(path)", "Reads a file", []), ("Box", "class", "box.py", 1, None, "Holds", ["Base", "Other"]), ("src/io.py", "file", "src/io.py", 1, None, None, []), ("Makefile", "file", "Makefile", 1, None, None, []), ("bare", "function", None, None, None, None, []),
)
MCOLS = "name, kind, file, line, signature, docstring, bases"
CHATS = (("s1", "chat_summary", "About x", "2024-01-01"), ("s2", "chat_detail", "More", None))
PATHS = (("/home/p/src/a.py",), ("src/b.py",), ("/other/c.py",), ("/home/pq/d.py",))
TREE = (("pkg/util.py",), ("pkg/sub/__init__.py",), ("main.py",), ("docs/x.md",))
MODULES = (("pkg.util",), ("pkg.sub",), ("pkg.gone",), ("main",), ("os",), ("docs",), (".rel",), ("_hidden",), ("pkg",))
ERRORS = (("Rate limit reached", 0), ("HTTP 503", 2), ("HTTP 503", 3), ("bad request", 0), ("Connection reset", 1), (None, 0))
EDITS = (("Write", "a\nb", None, None, None), ("Edit", None, "y", "z\nw", "x\ny\n"), ("Edit", None, "gone", "n", "x"), ("Edit", None, "o", "n", None), ("Read", None, None, None, None))
PROMPTS = (("please DUPS OFF now",), ("dups on",), ("what is dups status?",), ("hello",))
COMMENTS = (("# @allow-duplicate: kept",), ("x = 1  // @allow-duplicate",), ("/* @allow-duplicate: block */",), ("# MEMORY_GUARD_ALLOW: why not",), ("// memory_guard_allow",), ("nothing",))
NAMED = (("i",), ("x",), ("total",), ("_",), ("tmp",), ("$",))
EXTRA = ((1, {"a": "1", "b": "2"}, {"b": "3", "c": None}), (2, {"a": None}, {"d": "4"}), (3, {"a": "1"}, None))


def _rel(spark):
    return _rows(spark, RELS, "src string, dst string, kind string, context string, confidence double, import_type string")


def _made(spark):
    return _rows(spark, MADE, "name string, kind string, file string, line int, signature string, docstring string, bases array<string>")


def _said():
    c = F.col
    return B.default_observations(c("kind"), c("name"), c("file"), c("line"), c("signature"), c("docstring"), c("bases"))


def valid_relations(spark, sf_dir):
    return B.valid_relations(_rel(spark)).select("src", "dst", "kind", "confidence")


def bidirectional_relations(spark, sf_dir):
    return B.bidirectional(_rel(spark).where("src IS NOT NULL").select("src", "dst", "kind"))


def relation_contexts(spark, sf_dir):
    c = F.col
    return _rel(spark).select("src", "dst", "kind", F.coalesce("context", B.relation_context(c("kind"), c("src"), c("dst"), c("import_type"))).alias("context"))


def relation_payloads(spark, sf_dir):
    """JSON whose optional keys are left out, and the key in the old layout."""
    c = F.col
    json = B.relation_payload(c("src"), c("kind"), c("dst"), c("context"), F.coalesce("confidence", F.lit(1.0)), c("import_type"))
    key = B.legacy_relation_key(c("src"), c("kind"), c("dst"), c("import_type"))
    return _rel(spark).where("src IS NOT NULL").select(*[F.get_json_object(json, f"$.{k}").alias(k) for k in ("entity_name", "relation_target", "content", "context", "confidence")], F.get_json_object(json, "$.metadata.import_type").alias("import_type"), F.size(F.json_object_keys(json)).alias("keys"), key.alias("legacy_key"), B.point_id32(key).alias("legacy_id"))


def chat_payloads(spark, sf_dir):
    c = F.col
    json = B.chat_payload(c("chat"), c("kind"), c("content"), c("stamp"))
    return _rows(spark, CHATS, "chat string, kind string, content string, stamp string").select(json.alias("json"))


def entity_builders(spark, sf_dir):
    return _made(spark).select("name", F.array_join(_said(), "|").alias("observations"))


def embedding_texts(spark, sf_dir):
    """The texts of entities and relations that are embedded, and what an entity's difference is taken of."""
    c = F.col
    entity = _made(spark).select("name", B.entity_text(c("kind"), c("name"), _said(), c("docstring"), c("signature")).alias("text"), B.diff_content(c("docstring"), _said()).alias("diff"))
    return entity.unionAll(_rel(spark).where("src IS NOT NULL").select(F.concat_ws("->", "src", "dst").alias("name"), B.relation_text(c("src"), c("kind"), c("dst"), c("context")).alias("text"), F.lit(None).cast("string").alias("diff")))


def entity_payloads(spark, sf_dir):
    """Documents as stored chunks: hash and nested metadata."""
    d = table(spark, sf_dir, "documents")
    json = B.entity_payload(F.col("doc_id").cast("string"), F.col("lang"), F.col("source"), F.lit("implementation"), F.col("text"))
    return d.select("doc_id", F.get_json_object(json, "$.content_hash").alias("content_hash"), F.get_json_object(json, "$.metadata.entity_type").alias("entity_type"), F.get_json_object(json, "$.metadata.file_path").alias("file_path"))


def merged_payloads(spark, sf_dir):
    rows = _rows(spark, EXTRA, "id int, a map<string,string>, b map<string,string>")
    merged = F.map_entries(B.merged_maps(F.col("a"), F.col("b")))
    return rows.select("id", F.array_join(F.array_sort(F.transform(merged, lambda e: F.concat_ws("=", e["key"], e["value"]))), ",").alias("merged"))


def chunk_points(spark, sf_dir):
    """Vectors as points: hybrid where the id is even, as a sparse vector stands beside, else dense."""
    v = table(spark, sf_dir, "embeddings").select(F.concat(F.lit("v"), F.col("vec_id").cast("string")).alias("key"), F.col("embedding").alias("dense"), F.when(F.col("vec_id") % 2 == 0, F.lit("1:0.5")).alias("sparse"))
    return B.points(v, "key", "dense", "sparse").select("key", "point_id", "kind")


def relative_paths(spark, sf_dir):
    return _rows(spark, PATHS, "path string").select("path", B.relative_path(F.col("path"), "/home/p").alias("relative"))


def manual_list(spark, sf_dir):
    return B.manual_list(_stored(spark).withColumn("observations", F.when(F.col("id") == 6, F.array(F.lit("seen")))))


def replaced_entities(spark, sf_dir):
    """Order lines as entities, in replacement mode over the orders of one status."""
    e = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("file_path"), "l_linenumber")
    return B.replaced(e, table(spark, sf_dir, "orders").where("o_orderstatus = 'P'").select(F.col("o_orderkey").alias("file_path")), True).groupBy("file_path").agg(F.count(F.lit(1)).alias("entities"))


def internal_imports(spark, sf_dir):
    return B.internal_imports(_rows(spark, MODULES, "module string"), _rows(spark, TREE, "path string"))


def retryable_errors(spark, sf_dir):
    return _rows(spark, ERRORS, "error string, attempt int").select("error", "attempt", F.coalesce(B.retryable(F.col("error"), F.col("attempt")), F.lit(False)).alias("retry"))


def edit_descriptions(spark, sf_dir):
    e = _rows(spark, EDITS, "tool string, content string, old string, new string, file_text string")
    return e.select("tool", B.edit_description(*[F.col(c) for c in e.columns]).alias("description"))


def bypass_commands(spark, sf_dir):
    return _rows(spark, PROMPTS, "prompt string").select("prompt", B.bypass_command(F.col("prompt")).alias("action"))


def override_comments(spark, sf_dir):
    return _rows(spark, COMMENTS, "text string").select("text", C.override_reason(F.col("text")).alias("reason"))


def signed_changes(spark, sf_dir):
    """Orders of customers against those of their neighbours by key."""
    o = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n"))
    before = o.select((F.col("o_custkey") + 1).alias("o_custkey"), F.col("n").alias("p"))
    return o.join(before, "o_custkey", "left").select("o_custkey", B.signed_change(F.col("n"), F.coalesce("p", F.lit(0))).alias("change"))


def type_vocabularies(spark, sf_dir):
    """The types of the stored rows by vocabulary."""
    kind = F.when(F.col("entity_type").isin(*B.MANUAL_TYPES), "manual").when(F.col("entity_type").isin(*B.CODE_TYPES), "code").otherwise("other")
    return _stored(spark).groupBy("entity_type").agg(F.first(kind).alias("vocabulary"), F.count(F.lit(1)).alias("n"))


def javascript_variables(spark, sf_dir):
    """Names that are entities, at module level and inside a function."""
    from lorestone.operators.javascript_source import is_variable

    return _rows(spark, [(n, is_variable(n), is_variable(n, "function")) for (n,) in NAMED], "name string, module boolean, inside boolean")


def payload_conditions(spark, sf_dir):
    """Equality on several fields; a condition that is no scalar does not count."""
    return filtered(table(spark, sf_dir, "lineitem"), {"l_returnflag": "N", "l_linenumber": 1, "l_orderkey": ["x"]}).groupBy("l_suppkey").agg(F.count(F.lit(1)).alias("n"))


REL, MAD = values(RELS, RCOLS), values(MADE, MCOLS)
CONTEXT = "coalesce(context, CASE kind WHEN 'contains' THEN src || ' contains ' || dst WHEN 'calls' THEN src || ' calls ' || dst WHEN 'inherits' THEN src || ' inherits from ' || dst WHEN 'imports' THEN 'Imports ' || coalesce(import_type, 'module') END)"
SAID = r"""list_filter(CASE kind WHEN 'file' THEN ['File: ' || string_split(name, '/')[-1], 'Path: ' || name, 'Extension: ' || regexp_extract(string_split(name, '/')[-1], '(\.[^.]*)$', 1)] ELSE [CASE kind WHEN 'class' THEN 'Class: ' ELSE 'Function: ' END || name, 'Defined in: ' || file, 'Line: ' || line,
CASE WHEN kind = 'class' THEN 'Inherits from: ' || nullif(array_to_string(bases, ', '), '') ELSE 'Signature: ' || signature END, 'Description: ' || docstring] END, lambda o: o IS NOT NULL)"""
AUTO = ", ".join(f"'{f}'" for f in ("line_number", "ast_data", "signature", "docstring", "full_name", "ast_type", "start_line", "end_line", "source_hash", "parsed_at", *B.AUTO_ONLY_FIELDS))
FENCE = "'```' || chr(10) || {0} || chr(10) || '```'"
OLD, NEW, ALL = FENCE.format("old"), FENCE.format("new"), FENCE.format("content")
AT = "CASE WHEN contains(file_text, old) THEN len(string_split(string_split(file_text, old)[1], chr(10))) END"
BOTH = "list_sort(list_filter(list_transform(list_distinct(list_concat(map_keys(a), coalesce(map_keys(b), []))), lambda k: k || '=' || coalesce(b[k], a[k])), lambda x: x IS NOT NULL))"
MAPS = "(VALUES " + ", ".join(f"({i}, {'MAP ' + str(a).replace('None', 'NULL')}, {'MAP ' + str(b).replace('None', 'NULL') if b is not None else 'NULL'})" for i, a, b in EXTRA) + ") AS v(id, a, b)"
REASON = "CASE " + " ".join(f"WHEN regexp_matches(text, '(?i){p}') THEN coalesce(nullif(trim(regexp_replace(regexp_extract(text, '(?i){p}', 1), '\\s*\\*/\\s*$', '')), ''), '{C.NO_REASON}')" for p in C.OVERRIDES) + " END"
QUERIES = {
    "valid_relations": (valid_relations, f"SELECT src, dst, kind, coalesce(confidence, 1.0)::DOUBLE AS confidence FROM {REL} WHERE src <> '' AND dst <> '' AND coalesce(confidence, 1.0) BETWEEN 0 AND 1"),
    "bidirectional_relations": (bidirectional_relations, f"SELECT src, dst, kind FROM {REL} WHERE src IS NOT NULL UNION SELECT dst, src, kind FROM {REL} WHERE src IS NOT NULL AND kind IN ('references', 'uses')"),
    "relation_contexts": (relation_contexts, f"SELECT src, dst, kind, {CONTEXT} AS context FROM {REL}"),
    "relation_payloads": (relation_payloads, f"""WITH r AS (SELECT *, concat_ws('::', src, kind, dst, import_type, context) AS content, concat_ws('-', src, kind, dst, import_type) AS legacy_key, CASE WHEN confidence <> 1 THEN confidence END AS c FROM {REL} WHERE src IS NOT NULL)
SELECT src AS entity_name, dst AS relation_target, content, context, CAST(c AS DOUBLE)::VARCHAR AS confidence, import_type, CAST(7 + (context IS NOT NULL)::INT + (c IS NOT NULL)::INT AS INTEGER) AS keys, legacy_key, CAST('0x' || sha256(legacy_key)[1:8] AS BIGINT) AS legacy_id FROM r"""),
    "chat_payloads": (chat_payloads, f"SELECT '{{\"chunk_type\":\"' || kind || '\",\"entity_name\":\"chat_' || chat || '\",\"entity_type\":\"chat\",\"content\":\"' || content || '\",\"type\":\"chunk\"' || coalesce(',\"timestamp\":\"' || stamp || '\"', '') || '}}' AS json FROM {values(CHATS, 'chat, kind, content, stamp')}"),
    "entity_builders": (entity_builders, f"SELECT name, array_to_string({SAID}, '|') AS observations FROM {MAD}"),
    "embedding_texts": (embedding_texts, f"SELECT name, concat_ws(' | ', kind || ': ' || name, array_to_string({SAID}, ' '), 'Description: ' || docstring, 'Signature: ' || signature) AS text, concat_ws(' | ', 'Description: ' || docstring, array_to_string({SAID}, ' | ')) AS diff FROM {MAD} UNION ALL SELECT src || '->' || dst, concat_ws(' | ', 'Relation: ' || src || ' ' || kind || ' ' || dst, 'Context: ' || context), NULL FROM {REL} WHERE src IS NOT NULL"),
    "entity_payloads": (entity_payloads, "SELECT doc_id, sha256(text) AS content_hash, lang AS entity_type, source AS file_path FROM documents"),
    "merged_payloads": (merged_payloads, f"SELECT id, array_to_string({BOTH}, ',') AS merged FROM {MAPS}"),
    "chunk_points": (chunk_points, "SELECT 'v' || vec_id AS key, CAST(CAST('0x' || sha256('v' || vec_id)[1:16] AS UBIGINT) AS VARCHAR) AS point_id, CASE WHEN embedding IS NULL THEN 'payload' WHEN vec_id % 2 = 0 THEN 'hybrid' ELSE 'dense' END AS kind FROM embeddings"),
    "relative_paths": (relative_paths, f"SELECT path, CASE WHEN starts_with(path, '/home/p/') THEN path[9:] ELSE path END AS relative FROM {values(PATHS, 'path')}"),
    "manual_list": (manual_list, f"SELECT id, CASE WHEN entity_name = '' THEN 'Untitled' ELSE entity_name END AS title, entity_type, coalesce(nullif(trim(content), ''), CASE id WHEN 6 THEN 'seen' END, '') AS content FROM {ROW} WHERE file_path IS NULL AND relation_target IS NULL AND NOT list_has_any(fields, [{AUTO}])"),
    "replaced_entities": (replaced_entities, "SELECT l_orderkey AS file_path, count(*) AS entities FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'P') GROUP BY 1"),
    "internal_imports": (internal_imports, rf"WITH k AS (SELECT replace(regexp_replace(path, '(/__init__)?\.py$', ''), '/', '.') AS m FROM {values(TREE, 'path')} WHERE suffix(path, '.py') UNION SELECT string_split(path, '/')[1] FROM {values(TREE, 'path')} WHERE contains(path, '/')) SELECT module, starts_with(module, '.') OR (NOT starts_with(module, '_') AND module IN (SELECT m FROM k)) AS internal FROM {values(MODULES, 'module')}"),
    "retryable_errors": (retryable_errors, f"SELECT error, CAST(attempt AS INTEGER) AS attempt, coalesce(regexp_matches(lower(error), '{'|'.join(B.TRANSIENT)}') AND attempt < 3, false) AS retry FROM {values(ERRORS, 'error, attempt')}"),
    "edit_descriptions": (edit_descriptions, f"""SELECT tool, CASE tool WHEN 'Write' THEN 'NEW FILE CONTENT (' || len(string_split(content, chr(10))) || ' lines):' || chr(10) || {ALL} WHEN 'Edit' THEN 'EDIT OPERATION:' || chr(10) || 'REMOVING (' || len(string_split(old, chr(10))) || ' lines' || coalesce(', line ' || {AT}, '') || '):' || chr(10) || {OLD} || chr(10)
|| 'ADDING (' || len(string_split(new, chr(10))) || ' lines' || coalesce(', starting line ' || {AT}, '') || '):' || chr(10) || {NEW} ELSE '' END AS description FROM {values(EDITS, 'tool, content, old, new, file_text')}"""),
    "bypass_commands": (bypass_commands, f"SELECT prompt, CASE WHEN contains(lower(prompt), 'dups off') THEN 'disable' WHEN contains(lower(prompt), 'dups on') THEN 'enable' WHEN contains(lower(prompt), 'dups status') THEN 'status' END AS action FROM {values(PROMPTS, 'prompt')}"),
    "override_comments": (override_comments, f"SELECT text, {REASON} AS reason FROM {values(COMMENTS, 'text')}"),
    "signed_changes": (signed_changes, "WITH o AS (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1), j AS (SELECT o.o_custkey, o.n, coalesce(p.n, 0) AS p FROM o LEFT JOIN o p ON p.o_custkey = o.o_custkey - 1) SELECT o_custkey, CASE WHEN n = p AND p <= 0 THEN CAST(n AS VARCHAR) ELSE n || ' (' || CASE WHEN n >= p THEN '+' ELSE '' END || (n - p) || ')' END AS change FROM j"),
    "type_vocabularies": (type_vocabularies, f"SELECT entity_type, CASE WHEN entity_type IN ({', '.join(repr(t) for t in B.MANUAL_TYPES)}) THEN 'manual' WHEN entity_type IN ({', '.join(repr(t) for t in B.CODE_TYPES)}) THEN 'code' ELSE 'other' END AS vocabulary, count(*) AS n FROM {ROW} GROUP BY 1, 2"),
    "javascript_variables": (javascript_variables, f"SELECT name, NOT (name IN ('i', 'j', 'k', 'index', 'item', 'key', 'value', 'temp', 'tmp') OR (length(name) = 1 AND NOT regexp_matches(name, '[a-hm-np-zq-w]'))) AS module, false AS inside FROM {values(NAMED, 'name')}"),
    "payload_conditions": (payload_conditions, "SELECT l_suppkey, count(*) AS n FROM lineitem WHERE l_returnflag = 'N' AND l_linenumber = 1 GROUP BY 1"),
}
