"""Chat index: conversations become summary rows with a category, keywords and an extract, stored by content hash."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lorestone.functions.text import content_hash, point_id
from lorestone.operators import chat as C
from lorestone.operators.state import new_content
from lorestone.sources.store import Collection


def summaries(messages: DataFrame, most: int = 300) -> DataFrame:
    """(id, conv_id, key, category, query, content, content_hash): the first ``most`` characters stand for a summary, the hash is of the key and the whole text."""
    text = C.conversation_text(messages).withColumn("category", C.category(F.col("content")))
    out = text.join(C.keywords(messages), "conv_id", "left").select("conv_id", F.concat(F.lit("chat_summary_"), F.substring(F.md5(F.col("conv_id").cast("string")), 1, 8)).alias("key"), "category", F.coalesce("query", F.lit("")).alias("query"), F.substring("content", 1, most).alias("content"), F.col("content").alias("_whole"))
    return out.select(point_id(F.col("key")).alias("id"), "*", content_hash(F.concat_ws("\n", "key", "_whole")).alias("content_hash")).drop("_whole")


def index(collection: Collection, messages: DataFrame) -> DataFrame:
    rows = summaries(messages)
    return collection.upsert(new_content(rows, collection.read()) if collection.version else rows)


def html_report(messages: DataFrame) -> DataFrame:
    """(conv_id, html): one page for each conversation, text escaped."""
    safe = F.replace(F.replace(F.replace("text", F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    turn = F.struct("turn", F.concat(F.lit("<p class='"), F.col("role"), F.lit("'>"), safe, F.lit("</p>")).alias("h"))
    return messages.groupBy("conv_id").agg(F.concat(F.lit("<html><body>"), F.array_join(F.transform(F.sort_array(F.collect_list(turn)), lambda t: t["h"]), ""), F.lit("</body></html>")).alias("html"))
