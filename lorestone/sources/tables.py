"""The stored tables seen as files, chunks, vectors, messages, events and a graph."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, file_path, entity_name, entity_type, chunk_type, content): a document is an implementation chunk, a labelled one a metadata chunk too, of observations that hold the whole text."""
    docs = table(spark, sf_dir, "documents")
    base = docs.select(F.col("doc_id").alias("id"), F.concat_ws("/", "source", F.col("doc_id").cast("string")).alias("file_path"), F.concat(F.lit("doc_"), F.col("doc_id").cast("string")).alias("entity_name"), F.col("lang").alias("entity_type"), F.col("text").alias("content"))
    labelled = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("id"))
    meta = base.join(labelled, "id", "left_semi").withColumn("content", F.concat_ws(" | ", F.concat(F.lit("Document: "), "entity_name"), F.concat(F.lit("Language: "), "entity_type"), F.concat(F.lit("Description: "), "content")))
    return base.withColumn("chunk_type", F.lit("implementation")).unionByName(meta.withColumn("chunk_type", F.lit("metadata")))


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"), F.col("label").alias("kind"))


def texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text")


def contains_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(src, dst, kind): customers contain orders, orders contain lines, lines reference parts."""
    orders, lines = table(spark, sf_dir, "orders"), table(spark, sf_dir, "lineitem")
    name = lambda p, c: F.concat(F.lit(p), F.col(c).cast("string"))
    return (
        orders.select(name("c", "o_custkey").alias("src"), name("o", "o_orderkey").alias("dst"), F.lit("contains").alias("kind"))
        .unionAll(lines.select(name("o", "l_orderkey").alias("src"), name("p", "l_partkey").alias("dst"), F.lit("references").alias("kind")))
        .unionAll(lines.select(name("p", "l_partkey").alias("src"), name("s", "l_suppkey").alias("dst"), F.lit("imports").alias("kind")))
    )


def nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(name, entity_type) of the graph."""
    one = lambda t, p, c, kind: table(spark, sf_dir, t).select(F.concat(F.lit(p), F.col(c).cast("string")).alias("name"), F.lit(kind).alias("entity_type"))
    return one("customer", "c", "c_custkey", "class").unionAll(one("orders", "o", "o_orderkey", "function")).unionAll(one("part", "p", "p_partkey", "file")).unionAll(one("supplier", "s", "s_suppkey", "module"))
