"""Chat logs: normalising messages, conversation metadata, categories, keywords, languages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Keywords of each category, matched as lower-case substrings; the order decides ties. Fixed values.
CATEGORIES = {
    "debugging_pattern": ("error", "exception", "bug", "fix", "debug", "traceback", "stack trace", "memory leak", "crash", "failure", "issue", "problem", "troubleshoot"),
    "implementation_pattern": ("class", "function", "method", "algorithm", "pattern", "best practice", "code", "solution", "implement", "create", "build", "develop"),
    "integration_pattern": ("API", "service", "integration", "database", "authentication", "pipeline", "external", "third-party", "connect", "interface", "endpoint"),
    "configuration_pattern": ("config", "environment", "deploy", "setup", "docker", "CI/CD", "install", "settings", "parameters", "variables", "build", "deployment"),
    "architecture_pattern": ("architecture", "design", "structure", "component", "system", "module", "organization", "framework", "pattern", "design pattern"),
    "performance_pattern": ("performance", "optimization", "scalability", "memory", "speed", "bottleneck", "cache", "efficient", "fast", "slow", "optimize", "scale"),
    "knowledge_insight": ("research", "learning", "methodology", "strategy", "analysis", "insight", "findings", "discovery", "understanding", "lesson"),
    "active_issue": ("active", "issue", "bug", "problem", "todo", "fixme", "hack", "workaround", "blocked", "investigate", "urgent", "critical", "blocker", "regression"),
    "ideas": ("idea", "feature", "suggestion", "enhancement", "brainstorm", "concept", "proposal", "future", "roadmap", "vision", "inspiration", "innovation"),
}
DEFAULT_CATEGORY = "implementation_pattern"
#: Fence tags that are no languages, marks of code, words that say nothing. Fixed values.
NOT_LANGUAGES = ("bash", "shell", "sh", "text")
CODE_MARKERS = ("```", "def ", "class ", "function ", "import ", "const ", "SELECT ")
STOP_WORDS = ("about", "would", "could", "should", "there", "these")


def normalized(raw: DataFrame) -> DataFrame:
    """(id, role, content) from JSON lines: nested ``message``, flat ``role`` and ``content``, or ``type`` with response standing for the assistant. Lists of parts are joined. Other lines go."""
    at = lambda path: F.get_json_object("json", path)
    role = F.coalesce(at("$.message.role"), at("$.role"), F.when(at("$.type") == "response", "assistant").otherwise(at("$.type")))
    content = F.coalesce(at("$.message.content"), at("$.content"), at("$.text"))
    parts = F.from_json(content, "array<struct<type:string,text:string>>")
    joined = F.array_join(F.transform(F.filter(parts, lambda p: p["type"] == "text"), lambda p: p["text"]), "\n")
    return raw.select("id", role.alias("role"), F.when(content.startswith("[{"), joined).otherwise(content).alias("content")).where("role IS NOT NULL AND content IS NOT NULL AND content <> ''")


def conversation_text(messages: DataFrame) -> DataFrame:
    """(conv_id, content): ``ROLE: text`` of each turn in order, an empty line between; the turns of one conversation only."""
    one = F.struct("turn", F.concat(F.upper("role"), F.lit(": "), "text").alias("line"))
    return messages.groupBy("conv_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(one)), lambda m: m["line"]), "\n\n").alias("content"))


def has_code(text: Column) -> Column:
    out = F.lit(False)
    for marker in CODE_MARKERS:
        out = out | F.contains(text, F.lit(marker))
    return out


def metadata(messages: DataFrame, words: Column) -> DataFrame:
    return messages.groupBy("conv_id").agg(F.count(F.lit(1)).alias("messages"), F.sum(words).alias("words"), F.max(has_code(F.col("text"))).alias("has_code"), F.countDistinct("role").alias("roles"))


def category(text: Column) -> Column:
    lower = F.lower(text)
    hits = [sum((F.contains(lower, F.lit(k)).cast("int") for k in keys), F.lit(0)) for keys in CATEGORIES.values()]
    best = F.greatest(*hits)
    out = F.lit(DEFAULT_CATEGORY)
    for name, n in reversed(list(zip(CATEGORIES, hits, strict=True))):
        out = F.when((best > 0) & (n == best), name).otherwise(out)
    return out


def primary_language(messages: DataFrame) -> DataFrame:
    """(conv_id, language): the most frequent fence tag; of equals the one seen first."""
    tags = messages.select("conv_id", "turn", F.posexplode(F.regexp_extract_all("text", F.lit(r"```(\w+)"), F.lit(1))).alias("pos", "tag")).where(~F.col("tag").isin(*NOT_LANGUAGES))
    counted = tags.groupBy("conv_id", "tag").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("turn", "pos")).alias("first"))
    order = Window.partitionBy("conv_id").orderBy(F.desc("n"), "first")
    return counted.withColumn("r", F.row_number().over(order)).where("r = 1").select("conv_id", F.col("tag").alias("language"))


def keywords(messages: DataFrame, most: int = 5, kept: int = 3) -> DataFrame:
    """(conv_id, query): words of more than four characters said more than once, the first ``kept`` of the ``most`` frequent; ties by word."""
    words = messages.select("conv_id", F.explode(F.split(F.lower("text"), r"\s+")).alias("word")).where(F.length("word") > 4).where(~F.col("word").isin(*STOP_WORDS))
    counted = words.groupBy("conv_id", "word").agg(F.count(F.lit(1)).alias("n"))
    ranked = counted.withColumn("r", F.row_number().over(Window.partitionBy("conv_id").orderBy(F.desc("n"), "word"))).where((F.col("r") <= most) & (F.col("n") > 1) & (F.col("r") <= kept))
    return ranked.groupBy("conv_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("r", "word"))), lambda x: x["word"]), " ").alias("query"))


#: User texts that are a system's, not a person's: how they start, what they hold. Fixed values.
SYSTEM_STARTS, SYSTEM_MARKS = ("Caveat:",), ("<command-name>", "<local-command-stdout>", "This session is being continued")
DEBUG_WORDS = ("error", "debug", "fix")


def spoken(raw: DataFrame) -> DataFrame:
    """(id, line, role, content) of what people and assistants said in log lines: system texts and empty ones go, text parts are joined by spaces. ``raw``: id, line, json; other lines go."""
    at = lambda path: F.get_json_object("json", path)
    content = at("$.message.content")
    parts = F.transform(F.filter(F.from_json(content, "array<struct<type:string,text:string>>"), lambda p: p["type"] == "text"), lambda p: F.coalesce(p["text"], F.lit("")))
    text = F.trim(F.when(content.startswith("["), F.array_join(parts, " ")).otherwise(content))
    system = F.lit(False)
    for start in SYSTEM_STARTS:
        system = system | text.startswith(start)
    for mark in SYSTEM_MARKS:
        system = system | F.contains(text, F.lit(mark))
    said = raw.select("id", "line", at("$.type").alias("type"), at("$.message.role").alias("role"), text.alias("content"), system.alias("_system"))
    return said.where((F.col("type") == F.col("role")) & F.col("role").isin("user", "assistant") & (F.col("content") != "") & ((F.col("role") == "assistant") | ~F.col("_system"))).select("id", "line", "role", "content")


def listed_sessions(lines: DataFrame) -> DataFrame:
    """(session) ids that a Markdown checklist names. ``lines``: text."""
    listed = F.trim("text").rlike(r"^- \[[ x]\].*\*\*Session ID\*\*:")
    return lines.where(listed).select(F.regexp_extract("text", r"\*\*Session ID\*\*:\s*(\S+)", 1).alias("session")).where("session <> ''").distinct()


def topics(messages: DataFrame) -> DataFrame:
    """(conv_id, topics): the language, debugging if one of the first five turns speaks of it, coding if one of the first ten has code; general without any."""
    place = F.row_number().over(Window.partitionBy("conv_id").orderBy("turn"))
    early = messages.withColumn("_n", place).where(F.col("_n") <= 10)
    debugging = F.lit(False)
    for word in DEBUG_WORDS:
        debugging = debugging | F.contains(F.lower("text"), F.lit(word))
    each = early.groupBy("conv_id").agg(F.max((F.col("_n") <= 5) & debugging).alias("_d"), F.max(has_code(F.col("text"))).alias("_c")).join(primary_language(messages), "conv_id", "left")
    found = F.array_compact(F.array(F.col("language"), F.when(F.col("_d"), "debugging"), F.when(F.col("_c"), "coding")))
    return each.select("conv_id", F.when(F.size(found) > 0, found).otherwise(F.array(F.lit("general"))).alias("topics"))


#: The score of a report's first, second and third category. Fixed values.
REPORT_SCORES = (0.95, 0.85, 0.75)


def report_categories(text: DataFrame) -> DataFrame:
    """(conv_id, rank, category, score): the three categories with most of their keywords in the text, ties in the order of the categories; those without any take no rank. ``text``: conv_id, content."""
    lower = F.lower("content")
    hits = F.array(*[F.struct(F.lit(i).alias("place"), F.lit(name).alias("category"), sum((F.contains(lower, F.lit(k)).cast("int") for k in keys), F.lit(0)).alias("hits")) for i, (name, keys) in enumerate(CATEGORIES.items())])
    each = text.select("conv_id", F.explode(hits).alias("h")).select("conv_id", "h.*").where("hits > 0")
    ranked = each.withColumn("rank", F.row_number().over(Window.partitionBy("conv_id").orderBy(F.desc("hits"), "place"))).where("rank <= 3")
    return ranked.select("conv_id", "rank", "category", F.get(F.array(*[F.lit(x) for x in REPORT_SCORES]), F.col("rank") - 1).alias("score"))


def durations(messages: DataFrame, conversation: str = "conv_id", at: str = "ts") -> DataFrame:
    """(conversation, first, last, duration_minutes): of the messages with a time."""
    out = messages.groupBy(conversation).agg(F.min(at).alias("first"), F.max(at).alias("last"))
    return out.withColumn("duration_minutes", F.round((F.unix_micros("last") - F.unix_micros("first")) / 60_000_000, 4))


def active(messages: DataFrame, now, hours: int = 24, conversation: str = "conv_id", at: str = "ts") -> DataFrame:
    """(conversation) of those with a message in the last ``hours`` before ``now``: they are not summarised yet."""
    return messages.groupBy(conversation).agg(F.max(at).alias("_last")).where(F.unix_micros(now) - F.unix_micros("_last") <= hours * 3_600_000_000).select(conversation)


def summary_files(summaries: DataFrame, form: str) -> DataFrame:
    """(name, content): a file for each summary, ``form`` json or markdown. ``summaries``: conv_id, category, query, content, messages."""
    if form not in ("json", "markdown"):
        raise ValueError("form must be json or markdown")
    one = F.col("conv_id").cast("string")
    if form == "json":
        body = F.to_json(F.struct(one.alias("session_id"), F.col("content").alias("summary"), F.split("query", " ").alias("topics"), F.col("category"), F.col("messages").alias("message_count")))
    else:
        body = F.concat(F.lit("# Chat Summary: "), one, F.lit("\n\n**Messages:** "), F.col("messages").cast("string"), F.lit("\n**Category:** "), F.coalesce("category", F.lit("uncategorized")), F.lit("\n\n## Summary\n"), F.col("content"), F.lit("\n\n## Topics\n"), F.replace(F.col("query"), F.lit(" "), F.lit(", ")), F.lit("\n"))
    return summaries.select(F.concat(one, F.lit("_summary.json" if form == "json" else "_summary.md")).alias("name"), body.alias("content"))


def write_summary_files(summaries: DataFrame, form: str, path: str) -> None:
    """Each summary as a line of its own under its name: a partitioned text table, which any store takes."""
    summary_files(summaries, form).withColumnRenamed("content", "value").write.partitionBy("name").text(path)
