"""Row builders and small row tests: entities, flags, texts for keyword search, settings, items, backups, edits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lorestone.functions.text import point_id, split_name

NO_IMPLEMENTATION = ("import", "variable", "constant")
#: Patterns of site furniture in scraped documentation, removed in this order, any case, ``^`` and ``$`` at line ends. Fixed values.
NOISE = (
    r"Search\.\.\.\s*⌘K", r"Search\.\.\.", r"\*\s*\[Research\].*?\n", r"\*\s*\[Login\].*?\n", r"\*\s*\[Support\].*?\n", r"\*\s*\[Sign up\].*?\n", r"Was this page helpful\?\s*Yes\s*No", r"x\s*linkedin\s*discord",
    r"On this page\s*\n", r"Copy page\s*\n", r"^Copy\s*$", r"\* \[.*?\]\({site}.*?\)\n", r"\[.*?\]\({site}.*?\)\[.*?\]\({site}.*?\)", r"## \s*\n\[\u200b\]\({site}.*?\)\n", r"\[\u200b\]\({site}.*?\)\n", r"\* \* \*\s*\n",
    r"Check the\s*\n", r"see the\s*\n(?!\w)", r"##\s*\n(?=\[)",
)
DOCS_SITE = r"https://docs\."  # how the addresses of the documentation's own pages start
FRAMEWORKS = {"django": ("from django", "models.Model"), "flask": ("from flask", "@app.route"), "fastapi": ("from fastapi", "FastAPI("), "pytest": ("import pytest", "@pytest"), "pandas": ("import pandas", "pd."), "async": ("async def", "await ")}
BEHAVIOURS = ("validates", "processes", "handles", "manages", "creates", "updates", "deletes", "returns", "raises", "calculates", "transforms", "parses", "loads", "saves")


def entities(rows: DataFrame) -> DataFrame:
    """Entities with a name; without observations they get ``Type: name``."""
    named = rows.where(F.coalesce(F.trim("name") != "", F.lit(False)))
    default = F.array(F.concat(F.initcap("entity_type"), F.lit(": "), F.col("name")))
    return named.withColumn("observations", F.when(F.coalesce(F.size("observations"), F.lit(0)) > 0, F.col("observations")).otherwise(default))


def with_implementation_flag(metadata: DataFrame, implementations: DataFrame) -> DataFrame:
    names = implementations.select("entity_name").distinct().withColumn("_i", F.lit(True))
    flag = F.coalesce("_i", F.lit(False)) & ~F.col("entity_type").isin(*NO_IMPLEMENTATION)
    return metadata.join(names, "entity_name", "left").withColumn("has_implementation", flag).drop("_i")


def removed_entities(stored: DataFrame, parsed: DataFrame) -> DataFrame:
    """Stored (file, name) that are gone, of the files that were parsed."""
    return stored.join(parsed.select("file_path").distinct(), "file_path", "left_semi").join(parsed.select("file_path", "entity_name").distinct(), ["file_path", "entity_name"], "left_anti")


def keyword_text(name: Column, kind: Column, file: Column, observations: Column) -> Column:
    """What is indexed for keyword search: the name twice, its words, the first description, the type, the file's name and four methods."""
    described = F.get(F.transform(F.filter(observations, lambda o: F.lower(o).startswith("description:")), lambda o: F.trim(F.substring_index(o, ":", -1))), F.lit(0))
    methods = F.array_join(F.slice(F.transform(F.filter(observations, lambda o: F.lower(o).startswith("method:")), lambda o: F.trim(F.substring_index(o, ":", -1))), 1, 4), " ")
    parts = F.array(name, name, split_name(name), described, kind, F.element_at(F.split(file, "/"), -1), methods)
    return F.array_join(F.filter(parts, lambda p: F.coalesce(F.trim(p) != "", F.lit(False))), " ")


def settings(lines: DataFrame) -> DataFrame:
    """(key, value, kind) of ``key=value`` lines, the last of a key; comments and blanks go. ``lines``: line number n, text."""
    kept = lines.where(~F.trim("text").startswith("#") & F.contains("text", F.lit("=")))
    value = F.trim(F.expr("substring(text, instr(text, '=') + 1)"))
    kind = F.when(F.lower(value).isin("true", "false"), "bool").when(value.rlike(r"^-?\d+$"), "int").when(value.rlike(r"^-?\d+\.\d+$"), "float").otherwise("text")
    out = kept.select("n", F.trim(F.substring_index("text", "=", 1)).alias("key"), value.alias("value"), kind.alias("kind"))
    return out.groupBy("key").agg(F.max_by(F.struct("value", "kind"), "n").alias("v")).select("key", "v.value", "v.kind")


def corpus_fingerprint(docs: DataFrame) -> DataFrame:
    """One row that does not depend on the order of the texts: their number and the sums of two halves of their hashes."""
    h = F.sha2("text", 256)
    part = lambda a: F.sum(F.conv(F.substring(h, a, 12), 16, 10).cast("decimal(38,0)"))
    return docs.agg(F.count(F.lit(1)).alias("texts"), part(1).cast("string").alias("first"), part(13).cast("string").alias("second"))


def evicted(requests: DataFrame, capacity: int) -> DataFrame:
    """(key, first, evicted): keys in the order of their first request; whenever ``capacity`` are held, the older half goes. ``requests``: at, key. No task numbers all keys."""
    from lorestone.sources.store import numbered

    first = requests.groupBy("key").agg(F.min("at").alias("first"))
    placed = numbered(first, ["first", "key"], "_place")
    total = placed.agg(F.count(F.lit(1)).alias("total"))
    half = capacity // 2
    gone = F.when(F.col("total") <= capacity, 0).otherwise(F.floor((F.col("total") - capacity - 1) / half) * half + half)
    return placed.join(F.broadcast(total)).select("key", "first", (F.col("_place") < gone).alias("evicted"))


def items(rows: DataFrame, array: str) -> DataFrame:
    """(id, index, name, text) of the objects in one array of JSON texts: title, author, body, and the replies one level down. ``rows``: id, json."""
    kind = "struct<id:string,title:string,name:string,author:string,content:string,body:string,text:string,replies:array<struct<author:string,content:string,body:string,text:string>>>"
    each = rows.select("id", F.posexplode(F.from_json(F.get_json_object("json", f"$.{array}"), f"array<{kind}>")).alias("index", "i"))
    title = F.coalesce("i.title", "i.name")
    one = array.rstrip("s")
    name = F.when(title.isNotNull(), F.concat(F.lit(one + "_"), (F.col("index") + 1).cast("string"), F.lit("_"), F.substring(F.trim(title), 1, 100))).when(F.col("i.id").isNotNull(), F.concat(F.lit(one + "_"), F.col("i.id"))).otherwise(F.concat(F.lit(one + "_"), (F.col("index") + 1).cast("string")))
    replies = F.transform("i.replies", lambda r: F.concat_ws("\n", F.when(r["author"].isNotNull(), F.concat(F.lit("Author: "), r["author"])), r["content"], r["body"], r["text"]))
    text = F.concat_ws("\n", title, F.when(F.col("i.author").isNotNull(), F.concat(F.lit("Author: "), F.col("i.author"))), "i.content", "i.body", "i.text", F.array_join(replies, "\n"))
    return each.select("id", "index", name.alias("name"), F.trim(text).alias("text"))


def without_noise(text: Column, site: str = DOCS_SITE) -> Column:
    """Without the furniture of ``site``, a pattern for the start of its addresses; white space settled."""
    for pattern in NOISE:
        text = F.regexp_replace(text, "(?mi)" + pattern.replace("{site}", site).replace("\\u200b", "\u200b"), "")
    text = F.regexp_replace(text, r"\n\s*\n\s*\n", "\n\n")
    return F.regexp_replace(F.regexp_replace(text, r"(?m)^\s+", ""), r"^\s+|\s+$", "")


def page_title(text: Column) -> Column:
    return F.coalesce(F.nullif(F.regexp_extract(text, r"(?m)^#\s+(.+)", 1), F.lit("")), F.lit("Untitled"))


def markdown_to_html(text: Column) -> Column:
    for pattern, put in ((r"(?m)^### (.+)$", "<h3>$1</h3>"), (r"(?m)^## (.+)$", "<h2>$1</h2>"), (r"(?m)^# (.+)$", "<h1>$1</h1>"), (r"\*\*(.+?)\*\*", "<strong>$1</strong>"), (r"`([^`]+)`", "<code>$1</code>"), (r"(?m)^- (.+)$", "<li>$1</li>")):
        text = F.regexp_replace(text, pattern, put)
    return text


def framework_tags(text: Column) -> Column:
    def found(name: str, marks: tuple[str, ...]) -> Column:
        hit = F.lit(False)
        for m in marks:
            hit = hit | F.contains(text, F.lit(m))
        return F.when(hit, name)

    return F.array_compact(F.array(*[found(n, m) for n, m in FRAMEWORKS.items()]))


def behaviours(docstring: Column) -> Column:
    return F.filter(F.array(*[F.lit(b) for b in BEHAVIOURS]), lambda b: F.contains(F.lower(docstring), b))


def quality_score(parts: list[tuple[Column, float]]) -> Column:
    """A weighted sum of scores from 0 to 1."""
    return F.round(sum((c * w for c, w in parts), F.lit(0.0)), 6)


def backup(manual: DataFrame, relations: DataFrame) -> DataFrame:
    """(id, json): manual rows and the relations that touch one, as JSON lines."""
    names = manual.select("entity_name").distinct()
    touching = relations.join(names.withColumnRenamed("entity_name", "src"), "src", "left_semi").unionByName(relations.join(names.withColumnRenamed("entity_name", "dst"), "dst", "left_semi")).distinct()
    rows = manual.select(F.col("entity_name").alias("id"), F.to_json(F.struct("entity_name", "entity_type", "content")).alias("json"))
    return rows.unionByName(touching.select(F.concat_ws("::", "src", "kind", "dst").alias("id"), F.to_json(F.struct("src", "kind", "dst")).alias("json")))


def restore(saved: DataFrame, stored: DataFrame) -> DataFrame:
    """(point_id, id, json) of what is not stored yet."""
    return saved.withColumn("point_id", point_id(F.col("id")).cast("string")).join(stored.select("point_id").distinct(), "point_id", "left_anti")


SCALARS = (str, int, float, bool)


def payload_filter(rows: DataFrame, conditions: dict[str, object]) -> DataFrame:
    """Rows that equal every scalar condition; conditions of other kinds are ignored, a name with a dot is a nested field."""
    for name, value in conditions.items():
        if isinstance(value, SCALARS):
            rows = rows.where(F.col(name) == F.lit(value))
    return rows
