"""Extractor queries over small literal trees. The twins read the same texts by line rules, which hold for these texts though not for every source."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import functions as F

from lorestone.operators import python_source as P
from lorestone.operators import sections as M
from lorestone.operators.extract import extract
from lorestone.query_sets.graph import _rows, values

PYTHON = (
    ("pkg/shapes.py", 'import os, sys\nfrom .base import Shape\ntry:\n    import fast\nexcept ImportError:\n    import slow\n\nLIMIT = 3\nfirst, (second, *rest) = LIMIT, (1, 2)\nfor item in rest:\n    seen = item\n\n\nclass Box(Shape, base.Named):\n    """Holds things. Not many."""\n\n    size = 1\n\n    def __init__(self, size: int):\n        self.size = size\n\n    async def open(self) -> bool:\n        inner = 1\n        return inner\n\n\ndef create(n, m: str = "x") -> Box:\n    """Creates a box and validates it. Then more."""\n    def local():\n        pass\n    if (found := n):\n        return Box(n)\n    return Box(m)\n'),
    ("pkg/io.py", 'import json\nimport pandas as pd\n\n\n@cached\ndef load_all(path):\n    """Parses a file."""\n    with open("data.txt") as f:\n        pass\n    frame = pd.read_csv("in.csv")\n    frame.to_json("out.json")\n    text = folder.read_text("utf.txt")\n    json.load("r")\n    try:\n        reply = requests.get("http://x.y/z")\n    except (KeyError, OSError):\n        raise LoadError("no")\n    return yaml.load("c.yaml")\n'),
    ("pkg/broken.py", "def ("),
)
SCRIPT = (
    ("web/app.ts", "import a from './a'\nimport { b } from \"react\"\nimport './style'\nconst cfg = require('./cfg.json')\n// function no() {}\nexport class Panel extends ns.Base {\n}\nclass Plain {\n}\ninterface Shape {\n}\nexport async function load(url) {\n  let inner = 1\n  if (inner && url) { throw new LoadError(url) }\n  return fetch(\"data/x.json\")\n}\nconst go = (x) => {\n  return x ? 1 : 2\n}\nconst text = 'function fake() {'\nlet i = 0\nvar total = 2\n"),
    ("web/util.js", "export * from './shared'\nfunction first() {\n  for (const t of list) { while (t) { } }\n}\n"),
)
OTHER = (
    ("a.css", ".box, .item > p { color: red }\n#main { --gap: 1px }\n@import \"base.css\";\n.box:hover { margin: 0 }"), ("package.json", '{"name": "n", "dependencies": {"left": "1", "right": "2"}, "devDependencies": {"test": "3"}}'), ("web/tsconfig.json", '{"extends": "./base.json", "compilerOptions": {"strict": true, "target": "es6"}}'),
    (".github/workflows/ci.yml", "on: push\njobs:\n  build:\n    steps:\n      - uses: actions/checkout@v4\n      - run: make\n  test:\n    steps:\n      - uses: actions/cache@v3\n"), ("docker-compose.yml", "services:\n  web:\n    image: nginx:1\n  db:\n    image: pg:2\nvolumes:\n  data:\n"),
    ("k8s.yaml", "apiVersion: v1\nkind: Pod\nmetadata:\n  name: one\n---\napiVersion: v1\nkind: Service\nmetadata:\n  name: two\n"), ("note.txt", "short"), ("log.txt", "a line that is long enough"),
)
FLAT = (("a.ini", "[two]\nz = 0\nnew = 3"), ("b.csv", "x,y\n1,2"), ("e.csv", "x,y\n1,2"), ("c.txt", "a line that is long enough"), ("f.cfg", "[one]\nkey = v\nkey2 = w\n[three]\nq = 1"))
GUIDE = (("guide.md", "# Guide\nWelcome to the guide.\n## Setup\n### Linux\nInstall it on Linux.\n### Windows\n\n## Usage\nRun the thing and look.\n#### Deep\nVery deep text here.\n# Next\n\n## Empty\n## Last\nThe last words of it."), ("none.md", "no headers at all"))


def _tree(spark, rows):
    return extract(_rows(spark, rows, "file string, text string"))


def python_definitions(spark, sf_dir):
    """Classes, methods and functions with their lines; functions inside functions are none. A file that cannot be parsed is an error."""
    return _tree(spark, PYTHON).where("(row = 'entity' AND kind IN ('class', 'function', 'method')) OR row = 'error'").select("file", "name", F.when(F.col("row") == "error", "error").otherwise(F.col("kind")).alias("kind"), "line")


def python_imports(spark, sf_dir):
    """Also those in branches and handlers."""
    return _tree(spark, PYTHON).where("kind = 'imports'").select("file", F.col("other").alias("module"), "line")


def python_variables(spark, sf_dir):
    """Names bound in modules, classes and their blocks, by tuples and walrus too; not those of functions."""
    return _tree(spark, PYTHON).where("row = 'entity' AND kind IN ('variable', 'constant')").select("file", "name", "kind", "line")


def python_inheritance(spark, sf_dir):
    return _tree(spark, PYTHON).where("kind = 'inherits'").select("file", "name", F.col("other").alias("base"))


def python_file_operations(spark, sf_dir):
    return _tree(spark, PYTHON).where(F.col("kind").isin(*set(P.FILE_CALLS.values()))).select("file", F.col("other").alias("target"), "kind", "line")


def python_observations(spark, sf_dir):
    """What is said of functions: purpose, behaviours, return type, parameters, decorators."""
    each = _tree(spark, PYTHON).where("row = 'entity' AND kind IN ('function', 'method')").select("file", "name", F.explode(F.from_json("detail", "array<string>")).alias("observation"))
    return each.where(F.col("observation").rlike(r"^(Purpose|Behaviors|->|Parameters|Decorator)"))


def python_semantics(spark, sf_dir):
    """Complexity and exceptions of top-level functions."""
    kind = "struct<complexity:int,exceptions_handled:array<string>>"
    each = _tree(spark, PYTHON).where("row = 'chunk' AND name IN ('create', 'load_all')").select("file", "name", F.from_json("detail", kind).alias("d"))
    return each.select("file", "name", "d.complexity", F.array_join("d.exceptions_handled", ",").alias("exceptions"))


def javascript_entities(spark, sf_dir):
    return _tree(spark, SCRIPT).where("row = 'entity' AND kind <> 'file'").select("file", "name", "kind", "line")


def javascript_relations(spark, sf_dir):
    """Imports of the tree's own files, loaded JSON, base classes, what is thrown."""
    return _tree(spark, SCRIPT).where("row = 'relation' AND kind IN ('imports', 'json_load', 'inherits', 'throws')").select("name", "other", "kind", "line")


def javascript_complexity(spark, sf_dir):
    each = _tree(spark, SCRIPT).where("row = 'chunk' AND name IN ('load', 'go', 'first')")
    return each.select("file", "name", F.get_json_object("detail", "$.complexity").cast("int").alias("complexity"))


def css_entities(spark, sf_dir):
    return _tree(spark, OTHER).where("file = 'a.css' AND row IN ('entity', 'relation') AND kind <> 'file'").select("row", F.coalesce("other", "name").alias("name"), "kind", "line")


def special_json(spark, sf_dir):
    """Dependencies of a package, options of a TypeScript configuration."""
    rows = _tree(spark, OTHER).where("kind IN ('dependencies', 'devDependencies', 'option') OR (file LIKE '%tsconfig.json' AND kind = 'imports')")
    return rows.select("file", F.when(F.col("row") == "entity", F.col("name")).otherwise(F.col("other")).alias("name"), "kind", F.when(F.col("row") == "entity", F.col("other")).alias("value"))


def yaml_parts(spark, sf_dir):
    """Kinds of files; jobs, services and resources; what they use."""
    rows = _tree(spark, OTHER).where("kind IN ('workflow', 'compose', 'kubernetes', 'job', 'service', 'resource', 'uses') AND file LIKE '%.y%ml'")
    return rows.select("file", "name", "other", "kind")


def flat_files(spark, sf_dir):
    """Sections and keys of settings, columns of tables, chunks of plain texts."""
    return _tree(spark, FLAT).select("file", "row", "name", "other", "kind", F.sha2(F.coalesce("content", F.lit("")), 256).alias("content_hash"))


def whole_file_chunks(spark, sf_dir):
    """Styles, package files and short texts are a chunk each."""
    return _tree(spark, OTHER).where("row = 'chunk' AND name = file").select("file", F.sha2("content", 256).alias("content_hash"))


def markdown_sections(spark, sf_dir):
    """Sections with text and where they end; titles of empty ones are counted in the next."""

    def run(batches):
        for batch in batches:
            out: tuple[list, ...] = ([], [], [], [], [], [])
            for file, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                for s in M.sections(text or ""):
                    for col, v in zip(out, (file, s.title, s.level, s.line, s.end, s.content), strict=True):
                        col.append(v)
            kinds = (pa.string(), pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds, strict=True)], names=["file", "title", "level", "line", "end", "content"])

    found = _rows(spark, GUIDE, "file string, text string").mapInArrow(run, "file string, title string, level int, line int, end int, content string")
    return found.select("file", "title", "level", "line", F.col("end").alias("last"), F.md5("content").alias("content_md5"))


def _lines(rows):
    return f"(SELECT file, s, CAST(n AS INTEGER) AS line FROM (SELECT file, unnest(string_split(text, chr(10))) AS s, generate_subscripts(string_split(text, chr(10)), 1) AS n FROM {values(rows, 'file, text')} WHERE file <> 'pkg/broken.py'))"


PL, SL, OL, FL = _lines(PYTHON), _lines(SCRIPT), _lines(OTHER), _lines(FLAT)
# the definition a line lies in: the last one at its indentation or less, for texts that indent by four
DEFS = rf"""(SELECT file, line, s, indent, word, name, last_value(CASE WHEN indent = 0 THEN word END IGNORE NULLS) OVER w AS top FROM
(SELECT file, line, s, length(regexp_extract(s, '^( *)', 1)) AS indent, regexp_extract(s, '^ *(?:async )?(def|class) ', 1) AS word, regexp_extract(s, '^ *(?:async )?(?:def|class) (\w+)', 1) AS name FROM {PL}) WHERE word <> '' WINDOW w AS (PARTITION BY file ORDER BY line))"""
INSIDE = rf"""(SELECT file, line, s, last_value(CASE WHEN s <> '' AND NOT starts_with(s, ' ') THEN s END IGNORE NULLS) OVER w AS top, last_value(CASE WHEN regexp_matches(s, '^    (async )?\w') AND NOT starts_with(s, '        ') THEN s END IGNORE NULLS) OVER w AS second FROM {PL} WINDOW w AS (PARTITION BY file ORDER BY line))"""
CALLS = values(tuple((k, v, k.startswith(".")) for k, v in P.FILE_CALLS.items()), "call, kind, method")
MODES = ", ".join(f"'{m}'" for m in sorted(P.MODES))
FUNCTION = rf"(SELECT file, name, line, s AS head, lead(s) OVER (PARTITION BY file ORDER BY line) AS next, lag(s) OVER (PARTITION BY file ORDER BY line) AS before FROM (SELECT p.file, p.line, p.s, d.name FROM {PL} p LEFT JOIN {DEFS} d ON p.file = d.file AND p.line = d.line AND d.word = 'def' AND (d.indent = 0 OR d.indent = 4 AND d.top = 'class')))"
DOC = "regexp_extract(next, '^ *\"\"\"(.*)\"\"\"$', 1)"
VERBS = "validates?|authenticates?|processes?|handles?|manages?|creates?|deletes?|updates?|retrieves?|calculates?|generates?|transforms?|parses?|formats?"
PARAMS = r"list_transform(list_filter(string_split(regexp_extract(head, 'def \w+\((.*)\)', 1), ', '), lambda p: p <> ''), lambda p: trim(string_split(p, ' = ')[1]))"
BODY = rf"(SELECT file, line, s, last_value(CASE WHEN regexp_matches(s, '^(async )?def ') THEN regexp_extract(s, 'def (\w+)', 1) WHEN s <> '' AND NOT starts_with(s, ' ') THEN '' END IGNORE NULLS) OVER (PARTITION BY file ORDER BY line) AS name FROM {PL})"
BRANCH = r"^ *(if|elif|for|while|try|except|with|async for|async with)\b"
SBODY = r"(SELECT file, line, s, last_value(coalesce(nullif(regexp_extract(s, '^(?:export )?(?:async )?function (\w+)', 1), ''), nullif(regexp_extract(s, '^const (\w+) = \(.*=> \{$', 1), ''), CASE WHEN lag = '}' THEN '' END) IGNORE NULLS) OVER (PARTITION BY file ORDER BY line) AS name FROM (SELECT *, lag(s) OVER (PARTITION BY file ORDER BY line) AS lag FROM " + SL + "))"
COUNT = " + ".join(f"(length(s) - length(replace(s, '{w}', ''))) // {len(w)}" for w in ("if", "else if", "for", "while", "case", "catch", "?", "&&", "||"))
SETTINGS = rf"(SELECT file, line, s, last_value(nullif(regexp_extract(s, '^\[(\w+)\]', 1), '') IGNORE NULLS) OVER (PARTITION BY file ORDER BY line) AS section FROM {FL} WHERE file LIKE '%.ini' OR file LIKE '%.cfg')"
FLAT_SQL = rf"""SELECT file, 'entity' AS row, file AS name, CASE WHEN file LIKE '%.csv' THEN CAST(len(string_split(text, chr(10))) - 1 AS VARCHAR) END AS other, 'file' AS kind, '' AS content FROM {values(FLAT, 'file, text')}
UNION ALL SELECT file, 'entity', section, NULL, 'section', '' FROM {SETTINGS} WHERE starts_with(s, '[')
UNION ALL SELECT file, 'entity', section || '.' || trim(string_split(s, '=')[1]), section, 'key', '' FROM {SETTINGS} WHERE contains(s, '=')
UNION ALL SELECT file, 'entity', unnest(string_split(s, ',')), file, 'column', '' FROM {FL} WHERE file LIKE '%.csv' AND line = 1
UNION ALL SELECT file, 'chunk', file || '_chunk_1', NULL, 'implementation', text FROM {values(FLAT, 'file, text')} WHERE file LIKE '%.txt'"""
GL = f"(SELECT *, count(*) OVER (PARTITION BY file) AS n FROM {_lines(GUIDE)})"
HEADS = r"(SELECT file, line, n, length(regexp_extract(s, '^(#+)', 1)) AS level, trim(regexp_extract(s, '^#+(.*)', 1)) AS title FROM " + GL + " WHERE regexp_matches(s, '^#+ *[^ #]'))"
ENDS = f"(SELECT h.*, coalesce((SELECT min(x.line) - 1 FROM {HEADS} x WHERE x.file = h.file AND x.line > h.line AND CASE WHEN h.level = 1 THEN x.level <= 2 ELSE x.level <= h.level + 1 END), n) AS last FROM {HEADS} h)"
TEXTS = f"(SELECT e.*, trim((SELECT coalesce(string_agg(s, chr(10) ORDER BY g.line), '') FROM {GL} g WHERE g.file = e.file AND g.line > e.line AND g.line <= e.last), chr(10) || ' ') AS content FROM {ENDS} e)"
QUERIES = {
    "python_definitions": (python_definitions, f"SELECT file, name, CASE WHEN word = 'class' THEN 'class' WHEN indent = 0 THEN 'function' ELSE 'method' END AS kind, line FROM {DEFS} WHERE indent = 0 OR (indent = 4 AND top = 'class') UNION ALL SELECT file, file, 'error', 1 FROM {values(PYTHON, 'file, text')} WHERE NOT regexp_matches(text, '(?m)^(def|class|import) ?\\w')"),
    "python_imports": (python_imports, rf"SELECT file, CASE WHEN starts_with(trim(s), 'from') THEN regexp_extract(s, 'from ([.\w]+) import', 1) ELSE m END AS module, line FROM (SELECT file, s, line, unnest(list_transform(string_split(regexp_extract(s, '^ *(?:import|from) (.*)', 1), ', '), lambda m: string_split(m, ' ')[1])) AS m FROM {PL} WHERE regexp_matches(s, '^ *(import|from) '))"),
    "python_variables": (python_variables, rf"""SELECT file, name, CASE WHEN name = upper(name) THEN 'constant' ELSE 'variable' END AS kind, line FROM (
SELECT file, line, unnest(regexp_extract_all(regexp_extract(s, '^ *([\w ,*()]+?) = ', 1), '\w+')) AS name FROM {INSIDE} WHERE regexp_matches(s, '^ *[\w ,*()]+ = ') AND NOT regexp_matches(top, '^(async )?def ') AND (NOT starts_with(s, '        ') OR NOT regexp_matches(second, ' def '))
UNION ALL SELECT file, line, regexp_extract(s, '(\w+) :=', 1) FROM {PL} WHERE contains(s, ':='))"""),
    "python_inheritance": (python_inheritance, rf"SELECT file, regexp_extract(s, 'class (\w+)', 1) AS name, unnest(string_split(regexp_extract(s, '\((.*)\)', 1), ', ')) AS base FROM {PL} WHERE regexp_matches(s, '^class \w+\(')"),
    "python_file_operations": (python_file_operations, rf"""WITH c AS (SELECT file, line, regexp_extract(s, '([\w.]+)\("', 1) AS call, regexp_extract(s, '\("([^"]*)"', 1) AS target FROM {PL} WHERE regexp_matches(s, '[\w.]+\("'))
SELECT file, target, kind, line FROM c JOIN {CALLS} f ON c.call = f.call OR (f.method AND suffix(c.call, f.call)) WHERE target NOT IN ({MODES})"""),
    "python_observations": (python_observations, rf"""SELECT file, name, 'Purpose: ' || string_split({DOC}, '.')[1] || '.' AS observation FROM {FUNCTION} WHERE name IS NOT NULL AND {DOC} <> ''
UNION ALL SELECT file, name, 'Behaviors: ' || array_to_string(list_sort(list_distinct(regexp_extract_all(lower({DOC}), '\b({VERBS})\b')))[1:3], ', ') FROM {FUNCTION} WHERE name IS NOT NULL AND regexp_matches(lower({DOC}), '\b({VERBS})\b')
UNION ALL SELECT file, name, '-> ' || regexp_extract(head, '-> (.*):', 1) FROM {FUNCTION} WHERE name IS NOT NULL AND contains(head, '->')
UNION ALL SELECT file, name, 'Parameters: ' || len({PARAMS}) || ' parameters: ' || array_to_string({PARAMS}, ', ') FROM {FUNCTION} WHERE name IS NOT NULL AND len({PARAMS}) > 0
UNION ALL SELECT file, name, 'Decorator: ' || before[2:] FROM {FUNCTION} WHERE name IS NOT NULL AND starts_with(before, '@')"""),
    "python_semantics": (python_semantics, rf"SELECT file, name, CAST(1 + count(*) FILTER (regexp_matches(s, '{BRANCH}')) AS INTEGER) AS complexity, array_to_string(list_sort(list_distinct(flatten(list(list_concat(regexp_extract_all(regexp_extract(s, 'except (.*):', 1), '\w+'), regexp_extract_all(s, 'raise (\w+Error)', 1)))))), ',') AS exceptions FROM {BODY} WHERE name <> '' GROUP BY file, name"),
    "javascript_entities": (javascript_entities, rf"""SELECT file, regexp_extract(s, '(?:class|interface|function) (\w+)', 1) AS name, regexp_extract(s, '(class|interface|function) ', 1) AS kind, line FROM {SL} WHERE regexp_matches(s, '^(export )?(async )?(class|interface|function) ')
UNION ALL SELECT file, regexp_extract(s, '^(?:const|let|var) (\w+)', 1), CASE WHEN contains(s, '=>') THEN 'function' ELSE 'variable' END, line FROM {SL} WHERE regexp_matches(s, '^(const|let|var) \w+') AND NOT regexp_matches(s, '^(const|let|var) (i|j|k) ')"""),
    "javascript_relations": (javascript_relations, rf"""SELECT file AS name, regexp_extract(s, '[''"](\.[^''"]*)', 1) AS other, CASE WHEN contains(s, '.json') THEN 'json_load' ELSE 'imports' END AS kind, line FROM {SL} WHERE regexp_matches(s, '^(import|export \*|const \w+ = require).*[''"]\.')
UNION ALL SELECT file, regexp_extract(s, 'fetch\("([^"]*)', 1), 'json_load', line FROM {SL} WHERE contains(s, 'fetch(')
UNION ALL SELECT regexp_extract(s, 'class (\w+)', 1), regexp_extract(s, 'extends ([\w.]+)', 1), 'inherits', line FROM {SL} WHERE contains(s, ' extends ')
UNION ALL SELECT name, regexp_extract(s, 'throw new (\w+)', 1), 'throws', line FROM {SBODY} WHERE contains(s, 'throw new')"""),
    "javascript_complexity": (javascript_complexity, f"SELECT file, name, CAST(1 + sum({COUNT}) AS INTEGER) AS complexity FROM {SBODY} WHERE name IN ('load', 'go', 'first') GROUP BY file, name"),
    "css_entities": (css_entities, rf"""SELECT 'entity' AS row, name, kind, min(line) AS line FROM (SELECT line, unnest(regexp_extract_all(string_split(s, '{{')[1], '\.([A-Za-z][\w-]*)', 1)) AS name, 'class' AS kind FROM {OL} WHERE file = 'a.css' AND contains(s, '{{')
UNION ALL SELECT line, unnest(regexp_extract_all(string_split(s, '{{')[1], '#([A-Za-z][\w-]*)', 1)), 'id' FROM {OL} WHERE file = 'a.css' AND contains(s, '{{') UNION ALL SELECT line, unnest(regexp_extract_all(s, '(--[\w-]+)\s*:', 1)), 'variable' FROM {OL} WHERE file = 'a.css') GROUP BY ALL
UNION ALL SELECT 'relation', regexp_extract(s, '@import "([^"]*)', 1), 'imports', line FROM {OL} WHERE file = 'a.css' AND contains(s, '@import')"""),
    "special_json": (special_json, f"""WITH j AS (SELECT file, CAST(text AS JSON) AS j FROM {values(OTHER, 'file, text')} WHERE file LIKE '%.json')
SELECT file, unnest(json_keys(j, '$.dependencies')) AS name, 'dependencies' AS kind, NULL AS value FROM j WHERE file = 'package.json' UNION ALL SELECT file, unnest(json_keys(j, '$.devDependencies')), 'devDependencies', NULL FROM j WHERE file = 'package.json'
UNION ALL SELECT file, 'compilerOptions.' || k, 'option', CAST(json_extract(j, '$.compilerOptions.' || k) AS VARCHAR) FROM (SELECT file, j, unnest(json_keys(j, '$.compilerOptions')) AS k FROM j WHERE file LIKE '%tsconfig.json') UNION ALL SELECT file, j->>'$.extends', 'imports', NULL FROM j WHERE file LIKE '%tsconfig.json'"""),
    "yaml_parts": (yaml_parts, rf"""WITH l AS (SELECT file, line, s, last_value(CASE WHEN regexp_matches(s, '^\w+:') THEN regexp_extract(s, '^(\w+):', 1) END IGNORE NULLS) OVER w AS top, last_value(CASE WHEN regexp_matches(s, '^  \w+:') THEN regexp_extract(s, '^  (\w+):', 1) END IGNORE NULLS) OVER w AS second,
last_value(CASE WHEN starts_with(s, 'kind:') THEN s[7:] END IGNORE NULLS) OVER w AS kind FROM {OL} WHERE file LIKE '%.y%ml' WINDOW w AS (PARTITION BY file ORDER BY line))
SELECT file, file AS name, NULL AS other, CASE WHEN contains(file, 'workflows') THEN 'workflow' WHEN contains(file, 'docker') THEN 'compose' ELSE 'kubernetes' END AS kind FROM l GROUP BY file
UNION ALL SELECT file, second, NULL, CASE top WHEN 'jobs' THEN 'job' ELSE 'service' END FROM l WHERE top IN ('jobs', 'services') AND regexp_matches(s, '^  \w+:')
UNION ALL SELECT file, kind || '/' || regexp_extract(s, 'name: (\w+)', 1), NULL, 'resource' FROM l WHERE regexp_matches(s, '^  name:')
UNION ALL SELECT file, CASE WHEN contains(s, 'uses:') THEN file ELSE second END, regexp_extract(s, '(?:uses|image): (.*)', 1), 'uses' FROM l WHERE regexp_matches(s, '(uses|image): ')"""),
    "flat_files": (flat_files, f"SELECT file, row, name, other, kind, sha256(content) AS content_hash FROM ({FLAT_SQL})"),
    "whole_file_chunks": (whole_file_chunks, f"SELECT file, sha256(text) AS content_hash FROM {values(OTHER, 'file, text')} WHERE file <> 'log.txt'"),
    "markdown_sections": (markdown_sections, rf"""WITH t AS (SELECT *, length(content) <= {M.EMPTY} AS bare FROM {TEXTS}), g AS (SELECT *, coalesce(sum(CASE WHEN bare THEN 0 ELSE 1 END) OVER (PARTITION BY file ORDER BY line ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS part FROM t), c AS (SELECT *, count(*) FILTER (bare) OVER (PARTITION BY file, part) AS empty FROM g)
SELECT file, title || CASE WHEN empty > 0 THEN ' (+' || empty || ' more)' ELSE '' END AS title, CAST(level AS INTEGER) AS level, line, CAST(last AS INTEGER) AS last, md5(content) AS content_md5 FROM c WHERE NOT bare
UNION ALL SELECT file, '', 1, 1, 1, md5(text) FROM {values(GUIDE, 'file, text')} WHERE NOT contains(text, '#')"""),
}
