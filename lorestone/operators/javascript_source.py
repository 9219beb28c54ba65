"""JavaScript and TypeScript by tokens and brackets: functions, classes, methods, fields, interfaces, module variables, imports, file loads, throws, decorators.

Comments go and strings are blanked first, so that brackets and words inside them do not count. A stack of brackets then says what every token lies in;
names bound inside functions and blocks are no entities.
"""

from __future__ import annotations

import bisect
import json
import re
from collections.abc import Iterator

from lorestone.operators.parsed import Row

TOKEN = re.compile(r"[A-Za-z_$][\w$]*|=>|\.\.\.|[{}()\[\];,=:@.*?]|\S")
NAME = re.compile(r"[A-Za-z_$][\w$]*\Z")
#: Names of loop counters and temporaries that are no variables worth an entity. Fixed values.
TEMPORARY = frozenset(("i", "j", "k", "index", "item", "key", "value", "temp", "tmp"))
SHORT = frozenset("xyzabcdefghnmpqrstuvw")  # single letters that are
NOT_METHODS = frozenset("if for while switch catch function return new typeof await super constructor_ else do".split())
MODIFIERS = frozenset("public private protected static readonly abstract async override declare get set".split())
#: What complexity counts, as substrings. Fixed values.
BRANCHES = ("if", "else if", "for", "while", "case", "catch", "?", "&&", "||")


def is_variable(name: str, scope: str = "module") -> bool:
    """Whether a bound name is an entity: of the module's scope or a class's, no temporary, no odd single letter."""
    return scope in ("module", "class") and name not in TEMPORARY and not (len(name) <= 1 and name not in SHORT)


def complexity(code: str) -> int:
    return 1 + sum(code.count(w) for w in BRANCHES)


def calls(code: str) -> list[str]:
    return sorted(set(re.findall(r"(\w+)\s*\(", code)))


def blanked(text: str) -> tuple[str, dict[int, str]]:
    """The text with comments and the insides of strings as spaces (quotes and line ends stay), and the strings by the places of their opening quotes."""
    out, strings, i, n = list(text), {}, 0, len(text)
    blank = lambda a, b: out.__setitem__(slice(a, b), ["\n" if c == "\n" else " " for c in text[a:b]])
    while i < n:
        c = text[i]
        if text.startswith("//", i) or text.startswith("/*", i):
            end = text.find("\n", i) if text[i + 1] == "/" else text.find("*/", i + 2)
            end = n if end < 0 else end if text[i + 1] == "/" else end + 2
            blank(i, end)
            i = end
        elif c in "\"'`":
            end = i + 1
            while end < n and text[end] != c and (c == "`" or text[end] != "\n"):
                end += 2 if text[end] == "\\" else 1
            end = min(end, n)
            strings[i] = text[i + 1 : end]
            blank(i + 1, end)
            i = end + 1
        else:
            i += 1
    return "".join(out), strings


def _pattern_names(tokens: list[str]) -> list[str]:
    """Names that a destructuring pattern binds: the last of ``key: name``, those of nested patterns, without defaults."""
    out, depth, default = [], 0, None  # the depth of a default value that is being passed over
    for i, t in enumerate(tokens):
        if t in ("}", "]", ")"):
            depth -= 1
            default = None if default is not None and depth < default else default
        elif t == "," and depth == default:
            default = None
        elif t in ("{", "[", "("):
            depth += 1
        elif t == "=" and default is None:
            default = depth
        elif default is None and NAME.match(t) and (i + 1 >= len(tokens) or tokens[i + 1] != ":"):
            out.append(t)
    return out


class Scanner:
    """One pass over the tokens of a source; ``scopes`` holds (kind, name, start) of what the open brackets belong to."""

    def __init__(self, file: str, text: str):
        self.file, self.text = file, text
        self.code, self.strings = blanked(text)
        self.places = sorted(self.strings)
        found = [(m[0], m.start()) for m in TOKEN.finditer(self.code)]
        self.tokens, self.at = [t for t, _ in found], [p for _, p in found]
        self.lines = [m.start() for m in re.finditer("\n", text)]
        self.scopes: list[tuple[str, str, int]] = []
        self.rows: list[Row] = []
        self.match = self._brackets()

    def _brackets(self) -> dict[int, int]:
        out, stack = {}, []
        for i, t in enumerate(self.tokens):
            if t in "{[(":
                stack.append(i)
            elif t in "}])" and stack:
                out[stack.pop()] = i
        return out

    def line(self, k: int) -> int:
        return bisect.bisect_left(self.lines, self.at[k]) + 1

    def get(self, k: int) -> str:
        return self.tokens[k] if 0 <= k < len(self.tokens) else ""

    def string_in(self, k: int) -> str | None:
        """The first string among the arguments in the bracket at token k."""
        end = self.at[self.match.get(k, len(self.tokens) - 1)]
        i = bisect.bisect_right(self.places, self.at[k])
        return self.strings[self.places[i]] if i < len(self.places) and self.places[i] < end else None

    def scope(self) -> str:
        return self.scopes[-1][0] if self.scopes else "module"

    def owner(self) -> str:
        return next((name for kind, name, _ in reversed(self.scopes) if kind in ("function", "class") and name), self.file)

    def entity(self, name: str, kind: str, start: int, end: int | None = None, signature: str | None = None) -> None:
        parent = next((n for k, n, _ in reversed(self.scopes) if k == "class"), self.file)
        code = self.text[self.at[start] : self.at[end] + 1] if end is not None else None
        seen = [f"{kind.capitalize()}: {name}"] + ([f"Signature: {signature}"] if signature else [])
        self.rows.append(Row("entity", name, None, kind, self.line(start), None, json.dumps(seen)))
        self.rows.append(Row("relation", parent, name, "contains", self.line(start)))
        if code is not None:
            uses = {"calls": calls(blanked(code)[0]), "complexity": complexity(code)}
            self.rows.append(Row("chunk", name, None, "implementation", self.line(start), code, json.dumps(uses)))
            if kind in ("function", "method"):
                self.rows.extend(Row("relation", name, c, "calls", self.line(start)) for c in uses["calls"] if c not in NOT_METHODS and c != name)

    def body(self, k: int) -> int | None:
        """The bracket of the body behind a parameter list at token k, past a return type; None if there is none."""
        j = self.match.get(k, k) + 1
        if self.get(j) != ":":
            return j if self.get(j) == "{" else None
        depth = 0
        while j < len(self.tokens) and j < self.match.get(k, k) + 40:
            t = self.tokens[j]
            if t == "{" and not depth:
                return j
            if t in ";=}" and not depth:
                return None
            depth += (t in "([<") - (t in ")]>")
            j += 1
        return None

    def signature(self, name: str, k: int) -> str:
        return f"{name}{' '.join(self.text[self.at[k] : self.at[self.match.get(k, k)] + 1].split())}"

    def run(self) -> list[Row]:
        opens: dict[int, tuple[str, str]] = {}  # scopes by the tokens of their opening brackets
        k = 0
        while k < len(self.tokens):
            t = self.tokens[k]
            if t in "{([":
                inner = "block" if t == "{" and self.scope() != "class" or self.get(k - 1) == "for" else self.scope()
                self.scopes.append((*opens.get(k, (inner, "")), k))
            elif t in "})]":
                if self.scopes:
                    self.scopes.pop()
            else:
                self.token(k, t, opens)
            k += 1
        return self.rows

    def token(self, k: int, t: str, opens: dict[int, tuple[str, str]]) -> None:
        before, after = self.get(k - 1), self.get(k + 1)
        if t == "function" or (t == "class" and before != "."):
            j = k + 1 + (after == "*")
            name = self.get(j) if NAME.match(self.get(j)) and self.get(j) not in ("extends", "implements") else ""
            if t == "class":
                start = next((i for i in range(j, min(j + 40, len(self.tokens))) if self.tokens[i] == "{"), None)
                if start is not None:
                    opens[start] = ("class", name)
                    if name:
                        self.entity(name, "class", k, self.match.get(start, start))
                        if "extends" in self.tokens[j:start]:
                            e = self.tokens.index("extends", j, start) + 1
                            parts = [self.get(e)]
                            while self.get(e + 1) == ".":
                                e += 2
                                parts.append(self.get(e))
                            self.rows.append(Row("relation", name, ".".join(parts), "inherits", self.line(k)))
            else:
                bracket = next((i for i in range(j, min(j + 30, len(self.tokens))) if self.tokens[i] == "("), None)
                start = self.body(bracket) if bracket is not None else None
                if start is not None:
                    opens[start] = ("function", name)
                    if name:
                        self.entity(name, "function", k, self.match.get(start, start), self.signature(name, bracket))
        elif t in ("interface", "enum") and NAME.match(after) and self.get(k + 2) in ("{", "extends", "<"):
            start = next((i for i in range(k, min(k + 40, len(self.tokens))) if self.tokens[i] == "{"), k)
            self.entity(after, "interface" if t == "interface" else "enum", k, self.match.get(start, start))
            opens[start] = ("block", "")
        elif t in ("const", "let", "var") and after != "enum":
            self.variables(k, opens)
        elif t == "=>" and after == "{" and k + 1 not in opens:
            opens[k + 1] = ("function", "")
        elif t == "throw" and after == "new" and NAME.match(self.get(k + 2)):
            self.rows.append(Row("relation", self.owner(), self.get(k + 2), "throws", self.line(k)))
        elif t == "@" and NAME.match(after):
            follows = next((self.get(i + 1) for i in range(k, min(k + 60, len(self.tokens))) if self.tokens[i] == "class"), None)
            self.rows.append(Row("relation", follows or self.owner(), after, "decorated_by", self.line(k)))
        elif self.scope() == "class" and NAME.match(t) and self.tokens[self.scopes[-1][2]] == "{":
            self.member(k, t, opens)
        if t == "import" or t == "export":
            self.imports(k)
        elif t in ("require", "fetch", "readFileSync", "readFile") and after == "(":
            target = self.string_in(k + 1)
            if target and (target.endswith(".json") or t == "require" and target.startswith((".", "/"))):
                self.rows.append(Row("relation", self.file, target, "json_load" if target.endswith(".json") else "imports", self.line(k)))

    def imports(self, k: int) -> None:
        """Of ``import … from "x"``, ``import "x"``, ``import("x")``, ``export … from "x"``; packages are external."""
        end = next((i for i in range(k + 1, len(self.tokens)) if self.tokens[i] in (";", "\"", "'") or self.tokens[i] in ("const", "function", "class", "let", "var", "default", "import", "=")), None)
        if end is not None and self.tokens[end] in "\"'" and (self.get(end - 1) in ("from", "import", "(") or end == k + 1):
            target = self.strings.get(self.at[end])
            if target and target.startswith((".", "/")):
                self.rows.append(Row("relation", self.file, target, "json_load" if target.endswith(".json") else "imports", self.line(k)))

    def member(self, k: int, t: str, opens: dict[int, tuple[str, str]]) -> None:
        before, after = self.get(k - 1), self.get(k + 1)
        if t in NOT_METHODS or before in (".", "=", "new", "=>", "@") or t in MODIFIERS and NAME.match(after):
            return
        if after == "(" and (start := self.body(k + 1)) is not None:
            opens[start] = ("function", t)
            self.entity(t, "method", k, self.match.get(start, start), self.signature(t, k + 1))
        elif after in ("=", ";", ":") and before in ("{", ";", "}", *MODIFIERS, "#", ",", '"', "'") or after in ("=", ";", ":") and self.line(k) != self.line(k - 1):
            self.entity(t, "variable", k)

    def variables(self, k: int, opens: dict[int, tuple[str, str]]) -> None:
        """The names of a declaration at module level; an arrow function or function expression is a function."""
        scope = "module" if not self.scopes else self.scope()
        j = k + 1
        names: list[str] = []
        if self.get(j) in ("{", "["):
            end = self.match.get(j, j)
            names, j = _pattern_names(self.tokens[j + 1 : end]), end + 1
        elif NAME.match(self.get(j)):
            names, j = [self.get(j)], j + 1
        while j < len(self.tokens) and self.tokens[j] not in ("=", ";", ",", "of", "in") and self.line(j) == self.line(k):
            j = self.match.get(j, j) + 1  # a type
        if self.get(j) == "=" and len(names) == 1:
            e = j + 1 + (self.get(j + 1) == "async")
            arrow = self.match[e] + 1 if self.get(e) == "(" and e in self.match else e + 1 if NAME.match(self.get(e)) else e
            while self.get(arrow) not in ("=>", ";", "=", "") and arrow < e + 40 and self.get(e) == "(" and self.get(self.match.get(e, e) + 1) == ":":
                arrow += 1  # a return type
            if self.get(arrow) == "=>":
                start = arrow + 1 if self.get(arrow + 1) == "{" else None
                if start is not None:
                    opens[start] = ("function", names[0])
                if scope == "module":
                    self.entity(names[0], "function", k, self.match.get(start, start) if start is not None else None, self.signature(names[0], e) if self.get(e) == "(" else None)
                return
            if self.get(e) == "function" and scope == "module":
                bracket = next((i for i in range(e, min(e + 30, len(self.tokens))) if self.tokens[i] == "("), None)
                start = self.body(bracket) if bracket is not None else None
                if start is not None:
                    self.entity(names[0], "function", k, self.match.get(start, start), self.signature(names[0], bracket))
                return
        for name in names:
            if is_variable(name, scope):
                self.entity(name, "variable", k)


def javascript(file: str, text: str) -> Iterator[Row]:
    yield Row("entity", file, None, "file", 1)
    yield from Scanner(file, text).run()
