"""Pages: links, class references, inline styles, ids and components; by regular expressions inside the JVM."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _each(pages: DataFrame, pattern: str, group: int, name: str, source: str = "html") -> DataFrame:
    return pages.select("page_id", F.explode(F.regexp_extract_all(source, F.lit(pattern), F.lit(group))).alias(name))


def links(pages: DataFrame) -> DataFrame:
    """(page_id, kind, target): anchors but fragments, scripts and mail; form actions; local resources."""
    anchors = _each(pages, r'(?i)<a\s[^>]*?href\s*=\s*["\']([^"\']+)["\']', 1, "target").where(~F.col("target").rlike(r"(?i)^(#|javascript:|mailto:)")).withColumn("kind", F.lit("anchor"))
    forms = _each(pages, r'(?i)<form\s[^>]*?action\s*=\s*["\']([^"\']+)["\']', 1, "target").withColumn("kind", F.lit("form"))
    local = _each(pages, r'(?i)<(?:script|img|link)\s[^>]*?(?:src|href)\s*=\s*["\']([^"\']+)["\']', 1, "target").where(~F.col("target").rlike(r"(?i)^(https?:)?//")).withColumn("kind", F.lit("resource"))
    return anchors.unionByName(forms).unionByName(local).select("page_id", "kind", "target")


def class_references(pages: DataFrame) -> DataFrame:
    """(page_id, class_name): each class that a page's elements name, once."""
    lists = _each(pages, r'(?i)<[a-z][^>]*?\sclass\s*=\s*["\']([^"\']+)["\']', 1, "names")
    return lists.select("page_id", F.explode(F.split("names", r"\s+")).alias("name")).where("name <> ''").select("page_id", F.concat(F.lit("."), "name").alias("class_name")).distinct()


def inline_css(pages: DataFrame) -> DataFrame:
    """(page_id, kind, name) of classes, ids, variables and plain selectors that style elements define."""
    css = _each(pages, r"(?is)<style[^>]*>(.*?)</style>", 1, "css")
    rule = lambda pattern, kind: _each(css, pattern, 1, "name", "css").withColumn("kind", F.lit(kind))
    found = rule(r"\.([A-Za-z_][\w-]*)\s*[{,]", "class").unionByName(rule(r"#([A-Za-z_][\w-]*)\s*[{,]", "id")).unionByName(rule(r"(--[\w-]+)\s*:", "variable")).unionByName(rule(r"(?:^|\})\s*([a-z][a-z0-9]*)\s*\{", "element"))
    return found.select("page_id", "kind", "name").distinct()


def components(pages: DataFrame) -> DataFrame:
    """(page_id, kind, name): element ids, custom elements and data-component values."""
    ids = _each(pages, r'(?i)\sid\s*=\s*["\']([^"\']+)["\']', 1, "name").withColumn("kind", F.lit("id"))
    custom = _each(pages, r"(?i)<([a-z][a-z0-9]*-[a-z0-9-]+)[\s>/]", 1, "name").withColumn("kind", F.lit("custom"))
    data = _each(pages, r'(?i)data-component\s*=\s*["\']([^"\']+)["\']', 1, "name").withColumn("kind", F.lit("component"))
    return ids.unionByName(custom).unionByName(data).select("page_id", "kind", "name").distinct()
