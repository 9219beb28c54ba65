"""Python sources by the standard syntax tree: entities with observations, relations, file operations, implementation chunks with what their code uses."""

from __future__ import annotations

import ast
import json
import re
from collections.abc import Iterator

from lorestone.operators.code import COMMON_CALLS
from lorestone.operators.parsed import Row

#: Calls that read or write files, and the type of the relation they give; names with a dot in front are methods of anything. Fixed values.
FILE_CALLS = {
    "open": "file_open", "json.load": "json_load", "json.dump": "json_write", "json.loads": "json_parse", "yaml.load": "yaml_load", "yaml.dump": "yaml_write", "pickle.load": "pickle_load", "pickle.dump": "pickle_write",
    "csv.reader": "csv_read", "csv.writer": "csv_write", "pandas.read_json": "pandas_json_read", "pandas.read_csv": "pandas_csv_read", "pandas.read_excel": "pandas_excel_read", "pd.read_json": "pandas_json_read",
    "pd.read_csv": "pandas_csv_read", "pd.read_excel": "pandas_excel_read", ".to_json": "pandas_json_write", ".to_csv": "pandas_csv_write", ".to_excel": "pandas_excel_write", ".read_text": "path_read_text",
    ".read_bytes": "path_read_bytes", ".write_text": "path_write_text", ".write_bytes": "path_write_bytes", "requests.get": "requests_get", "requests.post": "requests_post", "urllib.request.urlopen": "urllib_open",
    "configparser.read": "config_ini_read", "toml.load": "toml_read", "xml.etree.ElementTree.parse": "xml_parse",
}
#: Strings that are file modes, so no target of a relation. Fixed values.
MODES = frozenset(("r", "w", "a", "x", "b", "t", "rb", "wb", "ab", "rt", "wt", "at", "r+", "w+", "a+", "x+"))
#: Docstring verbs that tell what a function does. Fixed values.
BEHAVIOURS = re.compile(r"\b(validates?|authenticates?|processes?|handles?|manages?|creates?|deletes?|updates?|retrieves?|calculates?|generates?|transforms?|parses?|formats?)\b")
DEFINITIONS = (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef)
BRANCHES = (ast.If, ast.For, ast.AsyncFor, ast.While, ast.Try, ast.TryStar, ast.ExceptHandler, ast.With, ast.AsyncWith)


def dotted(node: ast.AST) -> str | None:
    if isinstance(node, ast.Name):
        return node.id
    if isinstance(node, ast.Attribute):
        left = dotted(node.value)
        return f"{left}.{node.attr}" if left else node.attr
    return None


def targets(node: ast.AST) -> Iterator[str]:
    """Names bound by an assignment target: names in tuples, lists and starred parts; attributes are none."""
    if isinstance(node, ast.Name):
        yield node.id
    elif isinstance(node, (ast.Tuple, ast.List)):
        for e in node.elts:
            yield from targets(e)
    elif isinstance(node, ast.Starred):
        yield from targets(node.value)


def statements(node: ast.AST) -> Iterator[ast.stmt]:
    """The statements right inside one, of every list it has: bodies, branches, handlers and cases."""
    for _, value in ast.iter_fields(node):
        for child in value if isinstance(value, list) else ():
            if isinstance(child, ast.stmt):
                yield child
            elif isinstance(child, (ast.ExceptHandler, ast.match_case)):
                yield from statements(child)


def is_meaningful(name: str) -> bool:
    """As operators.code.meaningful: no common name, and with an underscore, more than four letters, or capitals inside."""
    return bool(name) and name not in COMMON_CALLS and len(name) > 2 and ("_" in name or len(name) > 4 or name[0].isupper() and any(c.isupper() for c in name[1:]))


def calls_in(node: ast.AST) -> list[str]:
    """Sorted meaningful names that are called; a method's object stands in front if its name is short."""
    found = set()
    for call in (n for n in ast.walk(node) if isinstance(n, ast.Call)):
        name = dotted(call.func)
        if not name:
            continue
        *objects, last = name.split(".")
        if is_meaningful(last):
            found.add(last)
            if objects and len(objects[-1]) < 10:
                found.add(f"{objects[-1]}.{last}")
    return sorted(found)


def exceptions_in(node: ast.AST) -> list[str]:
    """Sorted names of exceptions that are caught, or raised if they are called errors."""
    found = set()
    for n in ast.walk(node):
        if isinstance(n, ast.ExceptHandler) and n.type is not None:
            for e in n.type.elts if isinstance(n.type, ast.Tuple) else [n.type]:
                if name := dotted(e):
                    found.add(name.split(".")[-1])
        elif isinstance(n, ast.Raise) and n.exc is not None:
            name = dotted(n.exc.func if isinstance(n.exc, ast.Call) else n.exc)
            if name and ("Error" in name or "Exception" in name):
                found.add(name.split(".")[-1])
    return sorted(found)


def complexity_of(node: ast.AST) -> int:
    return 1 + sum(isinstance(n, BRANCHES) for n in ast.walk(node))


def purpose_of(docstring: str) -> str:
    """The first sentence of the text outside tags and comment marks."""
    tag = re.search(r"\s*@\w+", docstring)
    if "\n" not in docstring and tag and docstring[: tag.start()].strip():
        return docstring[: tag.start()].strip()
    lines = (re.sub(r"^\*+\s?", "", s.strip()) for s in docstring.replace("/**", "").replace("*/", "").strip().split("\n"))
    text = " ".join(s.strip() for s in lines if s.strip() and not s.strip().startswith("@")).strip()
    return text.split(".")[0] + "." if "." in text else text or docstring[:100]


def section_of(docstring: str, name: str) -> str:
    """The text of a docstring section, up to an empty line or the next section."""
    m = re.search(rf"(?is){name}:\s*(.*?)(?=\n\s*\n|\n\s*(?:Args?|Returns?|Raises?):|\Z)", docstring)
    return m[1].strip() if m else ""


def docstring_observations(docstring: str) -> list[str]:
    out = []
    if args := section_of(docstring, "Args?"):
        names = re.findall(r"(\w+):\s*", args)
        out.append(f"Parameters: {', '.join(names[:3])}" if names else "Has parameter documentation")
    if returned := section_of(docstring, "Returns?"):
        first = returned.split("\n")[0].strip()
        out.append(f"Returns: {first[:50]}{'...' if len(first) > 50 else ''}")
    if raised := section_of(docstring, "Raises?"):
        names = re.findall(r"(\w+(?:Error|Exception)):", raised)
        out.append(f"Raises: {', '.join(names[:3])}" if names else "Documents exceptions")
    if re.search(r"(?i)Examples?:", docstring):
        out.append("Has usage examples")
    if verbs := sorted(set(BEHAVIOURS.findall(docstring.lower()))):
        out.append(f"Behaviors: {', '.join(verbs[:3])}")
    return out


def parameters_of(node: ast.FunctionDef | ast.AsyncFunctionDef) -> list[str]:
    a = node.args
    return [f"{p.arg}: {ast.unparse(p.annotation)}" if p.annotation else p.arg for p in (*a.posonlyargs, *a.args, *a.kwonlyargs)]


def function_observations(node: ast.FunctionDef | ast.AsyncFunctionDef) -> list[str]:
    out, docstring = [], ast.get_docstring(node)
    if docstring:
        out += [f"Purpose: {purpose_of(docstring)}", *docstring_observations(docstring)]
    if calls := calls_in(node):
        out.append(f"Calls: {', '.join(calls[:5])}")
    if caught := exceptions_in(node):
        out.append(f"Handles: {', '.join(caught)}")
    if node.returns:
        out.append(f"-> {ast.unparse(node.returns)}")
    returned = sorted({ast.unparse(n.value) for n in ast.walk(node) if isinstance(n, ast.Return) and n.value})
    if len(returned) == 1:
        out.append(f"Returns: single value ({returned[0][:20]}{'...' if len(returned[0]) > 20 else ''})")
    elif returned:
        out.append(f"Returns: multiple patterns ({len(returned)} different)")
    if names := parameters_of(node):
        out.append(f"Parameters: {len(names)} parameters: {', '.join(names)}")
    out += [f"Decorator: {ast.unparse(d)}" for d in node.decorator_list]
    n = complexity_of(node)
    if n >= 2:
        out.append(f"Complexity: {n} ({'high' if n > 5 else 'moderate'})")
    waits = any(isinstance(x, ast.Await) for x in ast.walk(node))
    if isinstance(node, ast.AsyncFunctionDef) or waits:
        out.append(f"Async: {', '.join(['async function'] * isinstance(node, ast.AsyncFunctionDef) + ['uses await'] * waits)}")
    return out


def class_observations(node: ast.ClassDef) -> list[str]:
    out, docstring = [], ast.get_docstring(node)
    if docstring and docstring.split(".")[0].strip():
        out.append(f"Responsibility: {docstring.split('.')[0].strip()}")
    every = {n.name for n in ast.walk(node) if isinstance(n, (ast.FunctionDef, ast.AsyncFunctionDef))}
    methods = sorted(m for m in every if not m.startswith("__") or m == "__init__")
    if methods:
        out.append(f"Key methods: {', '.join(methods[:5])}")
    if bases := [b for b in map(dotted, node.bases) if b]:
        out.append(f"Inherits from: {', '.join(bases)}")
    for pattern, holds in (("Singleton", "__new__" in every), ("Factory", any("create" in m.lower() or "build" in m.lower() for m in methods)), ("Observer", any("notify" in m.lower() or "observe" in m.lower() for m in methods))):
        if holds:
            out.append(f"{pattern} pattern")
    stored = sorted({n.attr for n in ast.walk(node) if isinstance(n, ast.Attribute) and isinstance(n.ctx, ast.Store) and isinstance(n.value, ast.Name) and n.value.id == "self"})
    if stored:
        out.append(f"Attributes: {', '.join(stored[:3])}")
    return out


def uses_of(node: ast.AST) -> dict:
    """What the code of a definition uses: the metadata of its implementation chunk. Types come from annotations, as no outside analyser runs."""
    out = {"calls": calls_in(node), "imports_used": sorted({d for n in ast.walk(node) if isinstance(n, ast.Attribute) and (d := dotted(n)) and "." in d and not d.startswith("self.")}), "exceptions_handled": exceptions_in(node), "complexity": complexity_of(node)}
    if not isinstance(node, ast.ClassDef):
        out["inferred_types"] = {"signature": f"({', '.join(parameters_of(node))})" + (f" -> {ast.unparse(node.returns)}" if node.returns else "")}
    return out


def file_operations(tree: ast.AST) -> Iterator[tuple[str, str, int]]:
    """(target, type, line) of calls that name a file by a string; ``Path("x").open()`` too."""
    for call in (n for n in ast.walk(tree) if isinstance(n, ast.Call)):
        name = dotted(call.func) or ""
        kind = FILE_CALLS.get(name) or (FILE_CALLS.get("." + call.func.attr) if isinstance(call.func, ast.Attribute) else None)
        strings = [a for a in call.args if isinstance(a, ast.Constant) and isinstance(a.value, str) and a.value and a.value not in MODES]
        if kind and strings:
            yield strings[0].value, kind, call.lineno
        owner = call.func.value if isinstance(call.func, ast.Attribute) else None
        if isinstance(owner, ast.Call) and (dotted(owner.func) or "").split(".")[-1] == "Path" and call.func.attr in ("open", "read_text", "read_bytes", "write_text", "write_bytes"):
            for a in owner.args[:1]:
                if isinstance(a, ast.Constant) and isinstance(a.value, str) and a.value:
                    yield a.value, "path_open" if call.func.attr == "open" else FILE_CALLS["." + call.func.attr], call.lineno


def python(file: str, text: str) -> Iterator[Row]:
    """Locals of functions are no entities; names bound in blocks of modules and classes are."""
    tree = ast.parse(text)
    yield Row("entity", file, None, "file", 1, None, json.dumps([f"File: {file.rpartition('/')[2]}", f"Path: {file}", "Extension: .py", f"Size: {len(text.encode())} bytes"]))
    todo: list[tuple[ast.stmt, str, bool]] = [(n, file, False) for n in tree.body]
    while todo:
        node, parent, in_class = todo.pop(0)
        if isinstance(node, DEFINITIONS):
            a_class = isinstance(node, ast.ClassDef)
            kind = "class" if a_class else "method" if in_class else "function"
            yield Row("entity", node.name, ast.get_docstring(node), kind, node.lineno, None, json.dumps(class_observations(node) if a_class else function_observations(node)))
            yield Row("relation", parent, node.name, "contains", node.lineno)
            yield Row("chunk", node.name, None, "implementation", node.lineno, ast.get_source_segment(text, node), json.dumps(uses_of(node)))
            if a_class:
                for base in filter(None, map(dotted, node.bases)):
                    yield Row("relation", node.name, base, "inherits", node.lineno)
                todo = [(n, node.name, True) for n in node.body] + todo
            else:
                for name in sorted({n.split(".")[-1] for c in ast.walk(node) if isinstance(c, ast.Call) and (n := dotted(c.func))}):
                    yield Row("relation", node.name, name, "calls", node.lineno)
        elif isinstance(node, (ast.Assign, ast.AnnAssign, ast.AugAssign)):
            for t in node.targets if isinstance(node, ast.Assign) else [node.target]:
                for name in targets(t):
                    yield Row("entity", name, parent, "constant" if name.isupper() else "variable", node.lineno)
        else:
            todo = [(n, parent, in_class) for n in statements(node)] + todo
    for node in ast.walk(tree):
        if isinstance(node, ast.Import):
            for a in node.names:
                yield Row("relation", file, a.name, "imports", node.lineno)
        elif isinstance(node, ast.ImportFrom):
            yield Row("relation", file, "." * node.level + (node.module or ""), "imports", node.lineno)
        elif isinstance(node, ast.NamedExpr):
            yield Row("entity", node.target.id, file, "variable", node.lineno)
    for target, kind, line in file_operations(tree):
        yield Row("relation", file, target, kind, line)
