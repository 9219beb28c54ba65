"""Guard of edits: which need a look, and what they define that is already known."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lorestone.operators import code as C

TOOLS, EXTENSIONS = ("Write", "Edit", "MultiEdit"), ("py", "js", "ts", "jsx", "tsx", "java", "go", "rs", "cpp", "c")


def admitted(edits: DataFrame) -> DataFrame:
    """Adds ``verdict``: skipped (another tool or file type), overridden (a reason is given), trivial, or look. ``edits``: tool, file, text."""
    known = F.col("tool").isin(*TOOLS) & F.element_at(F.split("file", r"\."), -1).isin(*EXTENSIONS)
    trivial = C.triviality(F.col("text")).isin("empty", "import_only", "constant", "assignment")
    return edits.withColumn("verdict", F.when(~known, "skipped").when(C.override_reason(F.col("text")).isNotNull(), "overridden").when(trivial, "trivial").otherwise("look"))


def duplicates(edits: DataFrame, names: DataFrame) -> DataFrame:
    """(file, name): definitions of edits to look at that are known names."""
    new = admitted(edits).where("verdict = 'look'").select("file", F.explode(C.definitions(F.col("text"))).alias("name"))
    return new.join(names.select("name").distinct(), "name", "left_semi").select("file", "name")


def reply(text):
    """(flagged, reason) of a verdict in JSON, bare or in a fence."""
    bare = F.coalesce(F.nullif(F.regexp_extract(text, r"(?s)```(?:json)?\s*(\{.*?\})\s*```", 1), F.lit("")), F.regexp_extract(text, r"(?s)(\{.*\})", 1))
    return (F.lower(F.coalesce(F.get_json_object(bare, "$.hasIssues"), F.lit("false"))) == "true").alias("flagged"), F.coalesce(F.get_json_object(bare, "$.reason"), F.lit("")).alias("reason")
