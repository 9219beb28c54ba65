"""Source text by rules that need no syntax tree: calls, imports, exceptions, complexity, triviality, admission of edits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Names that say nothing about a call. Fixed values.
COMMON_CALLS = (
    "print", "len", "str", "int", "float", "bool", "list", "dict", "set", "tuple", "range", "enumerate", "zip", "map", "filter", "sum", "min", "max", "abs", "isinstance", "hasattr", "getattr", "setattr", "delattr", "type", "super",
    "open", "input", "format", "join", "split", "strip", "replace", "find", "append", "extend", "insert", "remove", "pop", "get", "keys", "values", "items", "update", "clear", "copy", "sort", "reverse", "count", "index",
)
COMPLEXITY_WORDS = ("if ", "for ", "while ", "except", "with ")


def lines(text: Column) -> Column:
    return F.split(text, "\n")


def calls(text: Column) -> Column:
    """Sorted distinct names before an opening bracket, on lines that define nothing."""
    plain = F.array_join(F.filter(lines(text), lambda s: ~F.trim(s).rlike(r"^(async )?def |^class ")), "\n")
    return F.array_sort(F.array_distinct(F.regexp_extract_all(plain, F.lit(r"([A-Za-z_][A-Za-z0-9_]*)\s*\("), F.lit(1))))


def meaningful(name: Column) -> Column:
    """Not a common name, and with an underscore, more than four characters, or camel case."""
    return ~name.isin(*COMMON_CALLS) & (F.length(name) > 2) & (F.contains(name, F.lit("_")) | (F.length(name) > 4) | name.rlike("[a-z][A-Z]"))


def qualified_names(text: Column) -> Column:
    return F.array_sort(F.array_distinct(F.regexp_extract_all(text, F.lit(r"([A-Za-z_][A-Za-z0-9_]*\.[A-Za-z_][A-Za-z0-9_]*)"), F.lit(1))))


def exceptions(text: Column) -> Column:
    return F.array_sort(F.array_distinct(F.regexp_extract_all(text, F.lit(r"except\s+([A-Za-z_][A-Za-z0-9_.]*)"), F.lit(1))))


def complexity(text: Column) -> Column:
    """One and every occurrence of a branching word."""
    return sum(((F.length(text) - F.length(F.replace(text, F.lit(w), F.lit("")))) / len(w) for w in COMPLEXITY_WORDS), F.lit(1)).cast("int")


def complexity_label(n: Column) -> Column:
    return F.when(n > 5, "high").when(n >= 2, "moderate").otherwise("low")


def imports(files: DataFrame) -> DataFrame:
    """(file, line, module) of import lines. ``files``: file, text."""
    each = files.select("file", F.posexplode(lines(F.col("text"))).alias("line", "s"))
    module = F.coalesce(F.nullif(F.regexp_extract("s", r"^\s*from\s+([.\w]+)\s+import\s", 1), F.lit("")), F.nullif(F.regexp_extract("s", r"^\s*import\s+([.\w]+)", 1), F.lit("")))
    return each.select("file", (F.col("line") + 1).alias("line"), module.alias("module")).where("module IS NOT NULL")


def headers(files: DataFrame) -> DataFrame:
    """(file, line, level, title) of first and second level headers outside code fences."""
    each = files.select("file", F.posexplode(lines(F.col("text"))).alias("line", "s"), lines(F.col("text")).alias("all"))
    fences = F.size(F.filter(F.slice("all", 1, F.col("line") + 0), lambda s: s.startswith("```")))
    return each.where(F.col("s").rlike(r"^#{1,2}\s+\S") & (fences % 2 == 0)).select("file", (F.col("line") + 1).alias("line"), F.length(F.regexp_extract("s", r"^(#+)", 1)).alias("level"), F.regexp_extract("s", r"^#+\s+(.*?)\s*$", 1).alias("title"))


def triviality(text: Column) -> Column:
    """The first that holds: empty, import_only, definition, constant, assignment, other."""
    real = F.filter(F.transform(lines(text), lambda s: F.trim(s)), lambda s: (s != "") & ~s.startswith("#"))
    importing = F.forall(real, lambda s: s.rlike(r"^(import|from)\s"))
    defining = text.rlike(r"(?m)^\s*(async\s+def|def|class)\s+\w+")
    constant = F.forall(real, lambda s: s.rlike(r"^[A-Z][A-Z0-9_]*\s*="))
    assigning = (F.size(real) <= 2) & F.forall(real, lambda s: s.rlike(r"^[A-Za-z_][\w.]*\s*=[^=]"))
    return F.when(F.size(real) == 0, "empty").when(importing, "import_only").when(defining, "definition").when(constant, "constant").when(assigning, "assignment").otherwise("other")


#: Comments that allow a duplicate, each with its reason as the group. Fixed values.
OVERRIDES = (r"#\s*@allow-duplicate(?:\s*:\s*(.+))?", r"//\s*@allow-duplicate(?:\s*:\s*(.+))?", r"/\*\s*@allow-duplicate(?:\s*:\s*(.+))?\s*\*/", r"#\s*MEMORY_GUARD_ALLOW(?:\s*:\s*(.+))?", r"//\s*MEMORY_GUARD_ALLOW(?:\s*:\s*(.+))?")
NO_REASON = "Override comment detected"


def override_reason(text: Column) -> Column:
    """The reason given in an override comment, NO_REASON if it gives none, null without such a comment."""
    out = F.lit(None).cast("string")
    for pattern in reversed(OVERRIDES):
        reason = F.trim(F.regexp_replace(F.regexp_extract(text, "(?i)" + pattern, 1), r"\s*\*/\s*$", ""))
        out = F.when(text.rlike("(?i)" + pattern), F.coalesce(F.nullif(reason, F.lit("")), F.lit(NO_REASON))).otherwise(out)
    return out


def definitions(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(r"(?m)^\s*(?:async\s+def|def|class)\s+(\w+)"), F.lit(1))
