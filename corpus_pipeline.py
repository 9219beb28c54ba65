"""A corpus pipeline over `documents`: toxicity, near-duplicates, benchmark decontamination, personal data, packing.

Every stage works on all that the one before it kept. Toxicity drops documents whose score is at least its threshold; near-dedup keeps the
document with the smallest id of each group; decontamination drops documents in which a benchmark phrase occurs; personal data is
replaced in the text, whose n_chars follows; packing gives the pieces of the training sequences. All stages but the last return the columns of documents.

A null or empty text is scored by the bias, has no words and no personal data, and is packed as the end id alone. Rows that repeat an id stay or go together in
near-dedup; rows without an id stay. Of equal documents the smallest id stays. An empty table gives no piece. Columns beside doc_id, text and n_chars go through unread; a column
named score, n_words, spans, items or base is refused by the stage that would write it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lorestone.llm import decontaminate, near_dedup, packing, pii, toxicity
from lorestone.llm.common import drop_staged, read, stage


def without_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    scored = toxicity.score(docs.select(*docs.columns), toxicity.fitted(spark, sf_dir, docs))
    return scored.where(F.col("score") < toxicity.THRESHOLD).select(*docs.columns)


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return near_dedup.keep_one(docs)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.decontaminate(docs, read(spark, sf_dir, "benchmark"))


def without_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pii.redact(docs).withColumn("n_chars", F.coalesce(F.length("text").cast("long"), "n_chars"))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.digest(packing.pack(docs))


STAGES = [
    ("toxicity", without_toxic),
    ("near_dedup", without_near_copies),
    ("decontamination", without_benchmark),
    ("personal_data", without_personal_data),
    ("packing", packed),
]
ORACLE_SQL = None  # several stages cannot be expressed in SQL; tests hold run() against a brute-force version


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages in order; each result but the last is written and read again."""
    docs, before = read(spark, sf_dir, "documents"), None
    for i, (name, step) in enumerate(STAGES):
        out = step(spark, docs, sf_dir)
        if i + 1 == len(STAGES):
            return out
        docs = stage(out, f"pipeline-{name}")
        if before is not None:
            drop_staged(before)  # what it kept is in the next result
        before = docs
    return docs
