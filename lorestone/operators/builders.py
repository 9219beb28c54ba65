"""Rows of entities, relations, chats and points as stored: texts, payloads, keys, the tests a row must pass."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lorestone.functions.text import content_hash, point_id, relation_id

#: Relations that hold in both directions. Fixed values.
BIDIRECTIONAL = ("references", "uses")
#: Fields that only automation writes, besides operators.state.AUTOMATION_FIELDS, as the list form of the manual test knows them. Fixed values.
AUTO_ONLY_FIELDS = ("file_hash", "parser_version", "indexed_at")
#: Entity types of people's notes, and of code. Fixed values.
MANUAL_TYPES = (
    "optimization_pattern", "milestone", "solution", "bug", "performance-metric", "feature-verification", "task-completion", "technical-analysis", "debugging-analysis", "project_milestone",
    "verification_report", "system_validation", "completed_optimization", "performance_improvement", "refactoring_project", "design_patterns", "architecture_pattern", "verification_plan", "checklist", "verification_result",
    "technical_pattern", "solution_pattern", "test", "analysis-report", "code-pattern", "code-analysis", "infrastructure-analysis", "critical-bug", "debugging-report", "bug-reproduction",
    "bug-analysis", "workflow_pattern", "configuration_pattern", "best_practice", "implementation_note", "decision_record", "learning", "insight", "code_analysis", "debugging_solution",
    "project_architecture", "reference", "research_summary", "section", "documentation", "manual_test", "user_note", "comment", "annotation", "summary",
    "guide", "tutorial", "example", "template", "specification", "requirement", "design_document", "meeting_notes", "decision", "changelog",
    "release_notes", "troubleshooting", "faq", "howto", "tips", "tricks", "active_issue", "ideas",
)
CODE_TYPES = ("file", "function", "class", "variable", "import", "directory", "project")
#: Words of errors that pass. Fixed values.
TRANSIENT = ("rate limit", "timeout", "connection", "temporary", "503", "502", "429")


def valid_relations(relations: DataFrame) -> DataFrame:
    """Relations with both ends and a confidence from 0 to 1; one without a confidence has 1."""
    filled = lambda c: F.coalesce(F.col(c) != "", F.lit(False))
    return relations.withColumn("confidence", F.coalesce("confidence", F.lit(1.0))).where(filled("src") & filled("dst") & F.col("confidence").between(0.0, 1.0))


def bidirectional(relations: DataFrame) -> DataFrame:
    """The relations, and those that hold in both directions turned round, each once."""
    turned = relations.where(F.col("kind").isin(*BIDIRECTIONAL)).select(*[F.col({"src": "dst", "dst": "src"}.get(c, c)).alias(c) for c in relations.columns])
    return relations.unionByName(turned).distinct()


def relation_context(kind: Column, src: Column, dst: Column, import_type: Column) -> Column:
    """What is said of a relation that has no context of its own."""
    both = lambda verb: F.concat(src, F.lit(f" {verb} "), dst)
    return F.when(kind == "contains", both("contains")).when(kind == "calls", both("calls")).when(kind == "inherits", both("inherits from")).when(kind == "imports", F.concat(F.lit("Imports "), F.coalesce(import_type, F.lit("module"))))


def default_observations(kind: Column, name: Column, file: Column, line: Column, signature: Column, docstring: Column, bases: Column) -> Column:
    """What is said of a function, class or file that was not looked into."""
    said = lambda label, c: F.when(c.isNotNull(), F.concat(F.lit(f"{label}: "), c.cast("string")))
    extension = F.regexp_extract(name, r"[^/]*?(\.[^./]*)?$", 1)
    of_file = F.array(said("File", F.element_at(F.split(name, "/"), -1)), said("Path", name), said("Extension", extension))
    defined = [said("Defined in", file), said("Line", line)]
    of_function = F.array(said("Function", name), *defined, said("Signature", signature), said("Description", docstring))
    of_class = F.array(said("Class", name), *defined, said("Inherits from", F.when(F.size(bases) > 0, F.array_join(bases, ", "))), said("Description", docstring))
    return F.array_compact(F.when(kind == "file", of_file).when(kind == "class", of_class).otherwise(of_function))


def entity_text(kind: Column, name: Column, observations: Column, docstring: Column, signature: Column) -> Column:
    """The text of an entity that is embedded."""
    return F.concat_ws(" | ", F.concat(kind, F.lit(": "), name), F.array_join(observations, " "), F.concat(F.lit("Description: "), docstring), F.concat(F.lit("Signature: "), signature))


def relation_text(src: Column, kind: Column, dst: Column, context: Column) -> Column:
    return F.concat_ws(" | ", F.concat(F.lit("Relation: "), src, F.lit(" "), kind, F.lit(" "), dst), F.concat(F.lit("Context: "), context))


def diff_content(docstring: Column, observations: Column) -> Column:
    """What an entity's difference is taken of."""
    return F.concat_ws(" | ", F.concat(F.lit("Description: "), docstring), F.array_join(observations, " | "))


def entity_payload(name: Column, kind: Column, file: Column, chunk_type: Column, content: Column, extra: Column | None = None) -> Column:
    """JSON of a stored chunk; ``extra``, a map, is merged into its metadata, null values are left out."""
    metadata = F.map_from_arrays(F.array(F.lit("entity_type"), F.lit("file_path")), F.array(kind, file))
    return F.to_json(F.struct(name.alias("entity_name"), chunk_type.alias("chunk_type"), content.alias("content"), content_hash(content).alias("content_hash"), F.lit("chunk").alias("type"), merged_maps(metadata, extra).alias("metadata")))


def merged_maps(first: Column, second: Column | None) -> Column:
    """One map of both; the second's values win, null maps and null values are left out."""
    both = first if second is None else F.map_zip_with(first, F.coalesce(second, F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>"))), lambda _, a, b: F.coalesce(b, a))
    return F.map_filter(both, lambda _, v: v.isNotNull())


def relation_payload(src: Column, kind: Column, dst: Column, context: Column, confidence: Column, import_type: Column) -> Column:
    """JSON of a stored relation: the context, a confidence other than 1 and the import type only where there are any."""
    content = relation_id(src, kind, dst, import_type, context)
    metadata = F.struct(F.lit("relation").alias("entity_type"), import_type.alias("import_type"))
    return F.to_json(F.struct(F.lit("relation").alias("chunk_type"), src.alias("entity_name"), dst.alias("relation_target"), kind.alias("relation_type"), content.alias("content"), context.alias("context"), F.when(confidence != 1.0, confidence).alias("confidence"), F.lit("chunk").alias("type"), metadata.alias("metadata")))


def chat_payload(chat: Column, kind: Column, content: Column, timestamp: Column) -> Column:
    return F.to_json(F.struct(kind.alias("chunk_type"), F.concat(F.lit("chat_"), chat).alias("entity_name"), F.lit("chat").alias("entity_type"), content.alias("content"), F.lit("chunk").alias("type"), timestamp.alias("timestamp")))


def legacy_relation_key(src: Column, kind: Column, dst: Column, import_type: Column) -> Column:
    """The key of relation points in the old layout."""
    return F.concat_ws("-", src, kind, dst, import_type)


def point_id32(key: Column) -> Column:
    """The first 8 hexadecimal digits of the SHA-256 as a number, as plain stores use them."""
    return F.conv(F.substring(F.sha2(key, 256), 1, 8), 16, 10).cast("long")


def points(rows: DataFrame, key: str, vector: str | None = None, sparse: str | None = None) -> DataFrame:
    """Adds ``point_id`` of ``key`` and ``kind``: hybrid with both vectors, dense with one, payload with none."""
    has = lambda c: F.col(c).isNotNull() if c else F.lit(False)
    return rows.withColumns({"point_id": point_id(F.col(key)).cast("string"), "kind": F.when(has(vector) & has(sparse), "hybrid").when(has(vector), "dense").otherwise("payload")})


def relative_path(path: Column, root: str) -> Column:
    """The path below ``root``; a relative path, and one outside, stay."""
    inside = root.rstrip("/") + "/"
    return F.when(path.startswith(inside), F.substring(path, len(inside) + 1, 1 << 30)).otherwise(path)


def manual_list(rows: DataFrame) -> DataFrame:
    """The list form of the manual test: the top level alone, no fields of automation, a name and a type, content or not. Documentation is not listed; a row without content shows its first observation. ``rows`` has fields and observations."""
    from lorestone.operators.state import AUTOMATION_FIELDS

    written = ~F.exists("fields", lambda f: f.isin(*AUTOMATION_FIELDS, *AUTO_ONLY_FIELDS))
    kept = rows.where(F.col("file_path").isNull() & F.col("relation_target").isNull() & written & F.col("entity_name").isNotNull() & F.col("entity_type").isNotNull() & (F.col("entity_type") != "documentation"))
    content = F.coalesce(F.nullif(F.trim("content"), F.lit("")), F.get("observations", F.lit(0)), F.lit(""))
    return kept.select("id", F.when(F.col("entity_name") == "", "Untitled").otherwise(F.col("entity_name")).alias("title"), "entity_type", content.alias("content"))


def replaced(entities: DataFrame, processed: DataFrame, replacing: bool) -> DataFrame:
    """Entities whose file is being processed in replacement mode. ``processed``: file_path."""
    return entities.join(processed.select("file_path").distinct(), "file_path", "left_semi") if replacing else entities.where("false")


def internal_imports(imports: DataFrame, files: DataFrame) -> DataFrame:
    """Adds ``internal``: relative imports, and modules that are a file or a package of the tree. ``imports``: module; ``files``: path from the root."""
    stem = F.regexp_replace("path", r"(/__init__)?\.py$", "")
    modules = files.where(F.col("path").endswith(".py")).select(F.replace(stem, F.lit("/"), F.lit(".")).alias("module"))
    folders = files.select(F.explode(F.split(F.regexp_extract("path", r"^([^/]+)/", 1), ",")).alias("module")).where("module <> ''")  # a bare import of a top folder
    known = modules.unionAll(folders).distinct().withColumn("_known", F.lit(True))
    hidden = F.col("module").startswith("_")
    return imports.join(known, "module", "left").withColumn("internal", F.col("module").startswith(".") | (~hidden & F.coalesce("_known", F.lit(False)))).drop("_known")


def retryable(error: Column, attempt: Column, most: int = 3) -> Column:
    """Whether an error's text tells of one that passes, and tries are left."""
    text = F.lower(error)
    hit = F.lit(False)
    for word in TRANSIENT:
        hit = hit | F.contains(text, F.lit(word))
    return hit & (attempt < most)


def edit_description(tool: Column, content: Column, old: Column, new: Column, file_text: Column) -> Column:
    """What an edit does, with the line where the old text stands, if it does."""
    n = lambda c: F.size(F.split(c, "\n")).cast("string")
    fence = lambda c: F.concat(F.lit("```\n"), c, F.lit("\n```"))
    at = F.when(F.contains(file_text, old), F.size(F.split(F.split_part(file_text, old, F.lit(1)), "\n")).cast("string"))
    removing = F.concat(F.lit("REMOVING ("), n(old), F.lit(" lines"), F.coalesce(F.concat(F.lit(", line "), at), F.lit("")), F.lit("):\n"), fence(old))
    adding = F.concat(F.lit("ADDING ("), n(new), F.lit(" lines"), F.coalesce(F.concat(F.lit(", starting line "), at), F.lit("")), F.lit("):\n"), fence(new))
    written = F.concat(F.lit("NEW FILE CONTENT ("), n(content), F.lit(" lines):\n"), fence(content))
    return F.when(tool == "Write", written).when(tool == "Edit", F.concat(F.lit("EDIT OPERATION:\n"), removing, F.lit("\n"), adding)).otherwise("")


def bypass_command(prompt: Column) -> Column:
    """The action that a prompt asks of the duplicate guard, or null."""
    text = F.lower(F.trim(prompt))
    return F.when(F.contains(text, F.lit("dups off")), "disable").when(F.contains(text, F.lit("dups on")), "enable").when(F.contains(text, F.lit("dups status")), "status")


def signed_change(current: Column, previous: Column) -> Column:
    change = current - previous
    sign = F.when(change >= 0, F.lit("+")).otherwise("")
    return F.when((change == 0) & (previous <= 0), current.cast("string")).otherwise(F.concat(current.cast("string"), F.lit(" ("), sign, change.cast("string"), F.lit(")")))
