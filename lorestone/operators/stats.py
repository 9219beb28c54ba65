"""Collection statistics: breakdowns, ratios, bloat, quality, health."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Prefix patterns of names that say little; the first that a name contains counts. Fixed values.
GENERIC_NAMES = ("test_", "temp_", "tmp_", "debug_", "sample_", "example_", "function_", "method_", "class_", "var_", "item_", "data_", "new_", "old_", "backup_", "copy_", "draft_")


def breakdown(chunks: DataFrame, columns: list[str]) -> DataFrame:
    """(dimension, value, entities): counts by each column and in all, by one pass over grouping sets."""
    sets = ", ".join(f"({c})" for c in columns)
    view = chunks.select(*columns)
    grouped = view.groupingSets([[F.col(c)] for c in columns] + [[]], *columns).agg(F.count(F.lit(1)).alias("entities"), F.grouping_id().alias("g")) if sets else None
    which = F.lit("all")
    value = F.lit(None).cast("string")
    for i, c in enumerate(columns):
        one = sum(1 << (len(columns) - 1 - j) for j in range(len(columns)) if j != i)
        which = F.when(F.col("g") == one, c).otherwise(which)
        value = F.when(F.col("g") == one, F.col(c).cast("string")).otherwise(value)
    return grouped.select(which.alias("dimension"), value.alias("value"), "entities")


def ratio_class(ratio: Column, balanced: float = 1.5, moderate: float = 2.0) -> Column:
    return F.when(ratio > moderate, "HIGH").when(ratio > balanced, "MODERATE").otherwise("BALANCED")


def chunk_mix(chunks: DataFrame) -> DataFrame:
    """By type: metadata and implementation rows, their ratio and its class, and content lengths."""
    n = lambda t: F.count(F.when(F.col("chunk_type") == t, 1))
    size = F.length("content")
    out = chunks.groupBy("entity_type").agg(n("metadata").alias("metadata"), n("implementation").alias("implementation"), F.min(size).cast("long").alias("min_length"), F.max(size).cast("long").alias("max_length"), F.round(F.avg(size), 4).alias("avg_length"))
    ratio = F.round(F.col("metadata") / F.col("implementation"), 6)
    return out.withColumn("ratio", ratio).withColumn("ratio_class", ratio_class(F.col("ratio")))


def file_bloat(rows: DataFrame, more_than: int, critical: int, most: int, types: int = 3) -> DataFrame:
    """(file, entities, severity, top_types): files with more than ``more_than`` entities, the ``most`` largest. ``rows``: file, type."""
    by_type = rows.groupBy("file", "type").agg(F.count(F.lit(1)).alias("n"))
    ranked = by_type.withColumn("r", F.row_number().over(Window.partitionBy("file").orderBy(F.desc("n"), "type")))
    files = ranked.groupBy("file").agg(F.sum("n").alias("entities"), F.array_join(F.transform(F.sort_array(F.collect_list(F.when(F.col("r") <= types, F.struct("r", "type")))), lambda x: x["type"]), ",").alias("top_types"))
    order = [F.desc("entities"), F.col("file")]
    return files.where(F.col("entities") > more_than).orderBy(*order).limit(most).select("file", "entities", F.when(F.col("entities") > critical, "CRITICAL").otherwise("HIGH").alias("severity"), "top_types")


def length_band(text: Column) -> Column:
    n = F.length(text)
    return F.when(text.isNull() | (n == 0), "empty").when(n < 20, "very_short").when(n < 50, "short").when(n < 200, "medium").otherwise("long")


def generic_pattern(name: Column) -> Column:
    out = F.lit(None).cast("string")
    for p in reversed(GENERIC_NAMES):
        out = F.when(F.contains(F.lower(name), F.lit(p)), p).otherwise(out)
    return out


def signatures(rows: DataFrame, size: int = 100, least: int = 20) -> DataFrame:
    """(signature, copies): first characters that several contents share."""
    return rows.where(F.length("content") > least).groupBy(F.substring("content", 1, size).alias("signature")).agg(F.count(F.lit(1)).alias("copies")).where("copies > 1")


def health(status: Column, points: Column, indexed: Column) -> Column:
    s = F.upper(status)
    green = F.when(points == 0, "EMPTY").when(indexed >= points * 0.98, "HEALTHY").when(indexed >= points * 0.90, "INDEXING").otherwise("DEGRADED")
    return F.when(s == "GREEN", green).when(s == "YELLOW", "OPTIMIZING").when(s == "GREY", "OPTIMIZATION_PENDING").when(s == "RED", "FAILED").otherwise("UNKNOWN")


def segment_class(segments: Column) -> Column:
    return F.when(segments <= 0, "UNKNOWN").when(segments <= 10, "OPTIMAL").when(segments <= 50, "GOOD").when(segments <= 100, "ACCEPTABLE").otherwise("FRAGMENTED")


def top_groups(rows: DataFrame, group: str, value: str, k: int) -> DataFrame:
    """(group, value, n, rank): the most frequent values of each group."""
    counted = rows.groupBy(group, value).agg(F.count(F.lit(1)).alias("n"))
    return counted.withColumn("rank", F.row_number().over(Window.partitionBy(group).orderBy(F.desc("n"), value))).where(F.col("rank") <= k)


def overview(rows: DataFrame, collection: str) -> DataFrame:
    """(collection, points, manual, automated, files): automated is what is not manual. ``rows``: is_manual, file_path."""
    n = rows.groupBy(collection).agg(F.count(F.lit(1)).alias("points"), F.count(F.when(F.col("is_manual"), 1)).alias("manual"), F.countDistinct("file_path").alias("files"))
    return n.withColumn("automated", F.col("points") - F.col("manual"))


def extension_totals(rows: DataFrame) -> DataFrame:
    """(extension, points, files) over all collections; a path without an extension has none. ``rows``: file_path."""
    extension = F.lower(F.regexp_extract("file_path", r"\.([^./]+)$", 1))
    return rows.groupBy(extension.alias("extension")).agg(F.count(F.lit(1)).alias("points"), F.countDistinct("file_path").alias("files"))


def category_mix(rows: DataFrame, relations: DataFrame, code: tuple[str, ...], many: int = 5) -> DataFrame:
    """(category, entities, relations, relations_per_entity, hubs): documentation, code, manual and other; hubs have at least ``many`` relations that leave them. ``rows``: entity_name, entity_type, is_manual; ``relations``: src."""
    kind = F.when(F.col("is_manual"), "manual").when(F.col("entity_type") == "documentation", "documentation").when(F.col("entity_type").isin(*code), "code").otherwise("other")
    out = relations.groupBy(F.col("src").alias("entity_name")).agg(F.count(F.lit(1)).alias("_n"))
    each = rows.withColumn("category", kind).join(out, "entity_name", "left").withColumn("_n", F.coalesce("_n", F.lit(0)))
    mixed = each.groupBy("category").agg(F.count(F.lit(1)).alias("entities"), F.sum("_n").alias("relations"), F.count(F.when(F.col("_n") >= many, 1)).alias("hubs"))
    return mixed.withColumn("relations_per_entity", F.round(F.col("relations") / F.col("entities"), 4))


def manual_share(rows: DataFrame) -> DataFrame:
    """(entity_type, manual, automatic)."""
    return rows.groupBy("entity_type").agg(F.count(F.when(F.col("is_manual"), 1)).alias("manual"), F.count(F.when(~F.col("is_manual"), 1)).alias("automatic"))


def usage(requests: DataFrame, prices: DataFrame) -> DataFrame:
    """(embedder, requests, tokens, cost, tokens_per_request): by model, with its price for a thousand tokens. ``requests``: embedder, tokens; ``prices``: embedder, price."""
    n = requests.groupBy("embedder").agg(F.count(F.lit(1)).alias("requests"), F.sum("tokens").alias("tokens"))
    return n.join(prices, "embedder", "left").select("embedder", "requests", "tokens", F.round(F.col("tokens") * F.col("price") / 1000, 6).alias("cost"), F.round(F.col("tokens") / F.col("requests"), 4).alias("tokens_per_request"))


def run_success(runs: DataFrame) -> DataFrame:
    """(run, success_rate, duration): the share of items that went well, 1 if there were none; seconds from the first to the last. ``runs``: run, ok, ts."""
    rate = F.coalesce(F.round(F.count(F.when(F.col("ok"), 1)) / F.count("ok"), 6), F.lit(1.0))
    return runs.groupBy("run").agg(rate.alias("success_rate"), ((F.unix_micros(F.max("ts")) - F.unix_micros(F.min("ts"))) / 1_000_000).alias("duration"))
