"""Entities, relations and implementation chunks from source files, one row each. A file that cannot be parsed gives an error row, never a failed job.

Each language is a function of (file, text) in a registry by extension; a task runs it over its Arrow batches. Python uses the standard syntax tree,
JavaScript a scanner of tokens and brackets, Markdown its sections; the others use line rules.
"""

from __future__ import annotations

import configparser
import csv
import io
import json
import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from lorestone.operators import javascript_source, python_source, sections
from lorestone.operators.parsed import Row

SCHEMA = "file string, row string, name string, other string, kind string, line int, content string, detail string"
#: Arrays whose objects are content, of a JSON file. Fixed values.
ITEM_ARRAYS = ("site_pages", "items", "articles", "posts", "data", "entries", "records", "results", "content")
registry: dict[str, Callable[[str, str], Iterator[Row]]] = {}


def parser(*extensions: str):
    def add(f):
        registry.update(dict.fromkeys(extensions, f))
        return f

    return add


parser(".py")(python_source.python)
parser(".js", ".jsx", ".ts", ".tsx", ".mjs", ".cjs")(javascript_source.javascript)


def whole(file: str, text: str) -> Iterator[Row]:
    """The file itself as a chunk, if it has any text."""
    if text.strip():
        yield Row("chunk", file, None, "implementation", 1, text)


@parser(".css", ".scss", ".sass")
def css(file: str, text: str) -> Iterator[Row]:
    yield Row("entity", file, None, "file", 1, None)
    seen = set()
    # comments, strings, addresses and imports name no selectors
    plain = re.sub(r"""(?s)/\*.*?\*/|"[^"\n]*"|'[^'\n]*'|url\([^)]*\)|@import[^;]*;""", lambda m: re.sub(r"[^\n]", " ", m[0]), text)
    for kind, rule in (("class", r"\.([A-Za-z_][\w-]*)(?=[^{}]*\{)"), ("id", r"#([A-Za-z_][\w-]*)(?=[^{}:;]*\{)"), ("variable", r"(--[\w-]+)\s*:")):
        for m in re.finditer(rule, plain):
            if (kind, m[1]) not in seen:
                seen.add((kind, m[1]))
                yield Row("entity", m[1], None, kind, text.count("\n", 0, m.start()) + 1, None)
    for m in re.finditer(r"""@import\s+(?:url\()?["']([^"']+)["']""", text):
        yield Row("relation", file, m[1], "imports", text.count("\n", 0, m.start()) + 1, None)
    yield from whole(file, text)


#: What a page's markup names: (row kind, pattern); as operators.web, which reads tables of pages.
MARKUP = (
    ("id", r"""\sid\s*=\s*["']([^"']+)["']"""), ("custom", r"<([a-z][a-z0-9]*-[a-z0-9-]+)[\s>/]"), ("component", r"""data-component\s*=\s*["']([^"']+)["']"""),
)


@parser(".html", ".htm")
def html(file: str, text: str) -> Iterator[Row]:
    yield Row("entity", file, None, "file", 1, None)
    at = lambda m: text.count("\n", 0, m.start()) + 1
    for kind, rule in MARKUP:
        for m in re.finditer("(?i)" + rule, text):
            yield Row("entity", m[1], None, kind, at(m), None)
    for m in re.finditer(r"""(?i)<a\s[^>]*?href\s*=\s*["']([^"']+)["']""", text):
        if not re.match(r"(?i)#|javascript:|mailto:", m[1]):
            yield Row("relation", file, m[1], "links", at(m), None)
    for m in re.finditer(r"""(?i)<(?:script|img|link)\s[^>]*?(?:src|href)\s*=\s*["']([^"']+)["']""", text):
        if not re.match(r"(?i)(?:https?:)?//", m[1]):
            yield Row("relation", file, m[1], "imports", at(m), None)
    for m in re.finditer(r"""(?i)<[a-z][^>]*?\sclass\s*=\s*["']([^"']+)["']""", text):
        for name in m[1].split():
            yield Row("relation", file, f".{name}", "uses", at(m), None)
    for m in re.finditer(r"(?is)<style[^>]*>(.*?)</style>", text):
        for name in sorted(set(re.findall(r"\.([A-Za-z_][\w-]*)\s*[{,]", m[1]))):
            yield Row("entity", f".{name}", None, "class", at(m), None)
    yield from whole(file, text)


@parser(".json")
def json_file(file: str, text: str) -> Iterator[Row]:
    data = json.loads(text)
    yield Row("entity", file, None, "file", 1, None)
    todo: list[tuple[str, object, str]] = [("", data, file)]
    while todo:
        path, value, parent = todo.pop(0)
        if isinstance(value, dict):
            for k, v in value.items():
                own = f"{path}.{k}" if path else k
                yield Row("entity", own, parent, "object" if isinstance(v, dict) else "array" if isinstance(v, list) else "value", 1, None)
                yield Row("relation", parent, own, "contains", 1, None)
                todo.append((own, v, own))
        elif isinstance(value, list):
            todo += [(path + "[]", v, parent) for v in value if isinstance(v, dict)]
    if not isinstance(data, dict):
        yield from whole(file, text)
        return
    base = file.rpartition("/")[2]
    if base == "package.json":
        for section in ("dependencies", "devDependencies"):
            for package in data[section] if isinstance(data.get(section), dict) else ():
                yield Row("relation", file, package, section, 1, None)
    if re.fullmatch(r"tsconfig[\w.-]*\.json", base):
        if isinstance(data.get("extends"), str):
            yield Row("relation", file, data["extends"], "imports", 1, None)
        options = data.get("compilerOptions")
        for name, value in options.items() if isinstance(options, dict) else ():
            yield Row("entity", f"compilerOptions.{name}", json.dumps(value), "option", 1, None)
    found = False
    for name in ITEM_ARRAYS:
        for i, item in enumerate(data[name]) if isinstance(data.get(name), list) else ():
            if isinstance(item, dict):
                found = True
                yield Row("chunk", item_name(name, i, item), None, name.rstrip("s"), 1, item_text(item))
    if not found:
        yield from whole(file, text)


def item_name(array: str, index: int, item: dict) -> str:
    one = array.rstrip("s")
    title = next((str(item[f]).strip()[:100] for f in ("title", "name", "subject", "headline") if isinstance(item.get(f), str) and item[f].strip()), None)
    if item.get("chunk_number") is not None:
        return f"{one}_{item['chunk_number']}" + (f"_{title}" if title else "")
    if title:
        return f"{one}_{index + 1}_{title}"
    key = next((item[f] for f in ("id", "_id", "uuid", "slug") if item.get(f) is not None), None)
    return f"{one}_{key}" if key is not None else f"{one}_{index + 1}"


def author_of(item: dict) -> str | None:
    author = item.get("author")
    if isinstance(author, dict):
        author = author.get("name") or author.get("username")
    return author if isinstance(author, str) and author.strip() else None


def item_text(item: dict) -> str:
    """Title, author, bodies and the replies at any depth, which are written in the order they stand."""
    out: list[str] = []
    todo = [item]
    while todo:
        now = todo.pop()
        text = lambda fields, now=now: [now[f].strip() for f in fields if isinstance(now.get(f), str) and now[f].strip()]
        author = author_of(now)
        out += [*text(("title", "name", "subject"))[:1], *([f"Author: {author}"] if author else []), *text(("content", "body", "text", "description", "summary"))]
        replies = [r for f in ("replies", "comments", "children") if isinstance(now.get(f), list) for r in now[f] if isinstance(r, dict)]
        todo += reversed(replies)
    return "\n".join(out)


def yaml_kind(file: str, text: str) -> str:
    """By the path first, then by the content."""
    if ".github/workflows" in file:
        return "workflow"
    if "docker-compose" in file or re.search(r"(?m)^services:", text):
        return "compose"
    return "kubernetes" if re.search(r"(?m)^apiVersion:", text) and re.search(r"(?m)^kind:", text) else "config"


@parser(".yaml", ".yml")
def yaml(file: str, text: str) -> Iterator[Row]:
    """Keys by indentation; the jobs of workflows, the services of compose files and the resources of Kubernetes documents are entities of their own."""
    kind = yaml_kind(file, text)
    yield Row("entity", file, None, kind, 1, None)
    stack: list[tuple[int, str]] = []
    resource: dict[str, str] = {}
    for n, line in enumerate([*text.split("\n"), "---"], 1):
        if line.startswith("---"):
            if kind == "kubernetes" and "kind" in resource:
                name = f"{resource['kind']}/{resource.get('metadata.name', '')}"
                yield Row("entity", name, None, "resource", n, None)
                yield Row("relation", file, name, "contains", n, None)
            stack, resource = [], {}
            continue
        m = re.match(r"""^(\s*)((?:- )*)(["']?)([\w.\-/ ]*[\w.\-/])\3:(?:\s+(.*?))?\s*$""", line)
        if not m or line.lstrip().startswith("#"):
            continue
        depth = len(m[1]) + len(m[2])
        while stack and stack[-1][0] >= depth:
            stack.pop()
        own = ".".join([*(k for _, k in stack), m[4]])
        yield Row("entity", own, None, "key", n, None)
        yield Row("relation", ".".join(k for _, k in stack) or file, own, "contains", n, None)
        if m[5] and not m[5].startswith("#"):
            resource.setdefault(own, m[5].strip("\"'"))
        part = {("workflow", "jobs"): "job", ("compose", "services"): "service"}.get((kind, stack[0][1] if len(stack) == 1 else ""))
        if part:
            yield Row("entity", m[4], None, part, n, None)
            yield Row("relation", file, m[4], "contains", n, None)
        if kind == "workflow" and m[4] == "uses" and m[5]:
            yield Row("relation", file, m[5].strip("\"'"), "uses", n, None)
        if kind == "compose" and len(stack) == 2 and m[4] == "image" and m[5]:
            yield Row("relation", stack[1][1], m[5].strip("\"'"), "uses", n, None)
        stack.append((depth, m[4]))
    yield from whole(file, text)


@parser(".csv")
def csv_file(file: str, text: str) -> Iterator[Row]:
    rows = list(csv.reader(io.StringIO(text)))
    yield Row("entity", file, str(max(0, len(rows) - 1)), "file", 1, None)
    for name in rows[0] if rows else ():
        yield Row("entity", name.strip(), file, "column", 1, None)


@parser(".ini", ".conf", ".cfg")
def ini(file: str, text: str) -> Iterator[Row]:
    config = configparser.ConfigParser(interpolation=None, strict=False, allow_no_value=True)
    config.read_string(text)
    yield Row("entity", file, None, "file", 1, None)
    for section in config.sections():
        yield Row("entity", section, None, "section", 1, None)
        for key in config[section]:
            if key not in config.defaults():
                yield Row("entity", f"{section}.{key}", section, "key", 1, None)


@parser(".md", ".markdown")
def markdown(file: str, text: str) -> Iterator[Row]:
    """Headers of the first two levels as entities; chunks of grouped sections, each with a metadata row."""
    yield Row("entity", file, None, "file", 1, None)
    for title, level, i in sections.headers(text.split("\n")):
        if level <= 2:
            yield Row("entity", title, None, "documentation", i + 1, None)
            yield Row("relation", file, title, "contains", i + 1, None)
    for c in sections.chunks(text):
        about = {"headers": list(c.titles), "token_count": c.tokens, "section_count": len(c.titles), "word_count": len(c.content.split()), "line_count": c.content.count("\n") + 1, "end_line": c.end}
        content = c.content + (f"\n\n[Previous context: ...{c.overlap}]" if c.overlap else "")
        yield Row("chunk", c.title or file, None, "implementation", c.line, content, json.dumps(about))
        yield Row("chunk", c.title or file, None, "metadata", c.line, sections.metadata_text(c), json.dumps(about))


@parser(".txt", ".log")
def plain(file: str, text: str) -> Iterator[Row]:
    """Blocks of fifty lines, as operators.chunking.line_chunks cuts them; a file that is too short for a block is one chunk."""
    yield Row("entity", file, None, "file", 1, None)
    lines = [s if len(s) <= 1000 else s[:1000] + "..." for s in text.split("\n")]
    if len(text.strip()) <= 10:
        yield from whole(file, text)
    for i in range(0, len(lines), 50):
        content = "\n".join(lines[i : i + 50])
        if len(content.strip()) > 10:
            yield Row("chunk", f"{file}_chunk_{i // 50 + 1}", None, "implementation", i + 1, content)


def rows_of(file: str, text: str | None) -> list[Row]:
    extension = "." + file.rpartition(".")[2].lower() if "." in file else ""
    use = registry.get(extension)
    if use is None:
        return [Row("error", file, None, "no parser", 1)]
    try:
        return list(use(file, text or ""))
    except Exception as e:  # whatever a parser meets in one file must not end the job
        return [Row("error", file, None, type(e).__name__, getattr(e, "lineno", None) or 1)]


def extract(files: DataFrame) -> DataFrame:
    """``files``: file, text. A null text is an empty one; files without a parser give an error row."""

    def run(batches):
        for batch in batches:
            out: tuple[list, ...] = ([], [], [], [], [], [], [], [])
            for file, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                for r in rows_of(file or "", text.as_py()):
                    for col, v in zip(out, (file, *r), strict=True):
                        col.append(v)
            kinds = (pa.string(), pa.string(), pa.string(), pa.string(), pa.string(), pa.int32(), pa.string(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds, strict=True)], names=["file", "row", "name", "other", "kind", "line", "content", "detail"])

    return files.select("file", "text").mapInArrow(run, SCHEMA)
