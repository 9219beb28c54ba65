"""Chunks of texts: by lines, with overlap, by token budget."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

LINES, LINE_CUT, LEAST = 50, 1000, 10
OVERLAP = 200


def line_chunks(docs: DataFrame, lines: int = LINES, cut: int = LINE_CUT, least: int = LEAST) -> DataFrame:
    """(id, chunk, start_line, content): ``lines`` lines each, long lines cut and marked; chunks of at most ``least`` characters go. Row by row, without a shuffle."""
    parts = F.transform(F.split("text", "\n"), lambda s: F.when(F.length(s) > cut, F.concat(F.substring(s, 1, cut), F.lit("..."))).otherwise(s))
    starts = F.sequence(F.lit(0), F.floor((F.size(parts) - 1) / lines).cast("int"))
    grouped = F.transform(starts, lambda i: F.struct(i.alias("chunk"), F.array_join(F.slice(parts, i * lines + 1, F.lit(lines)), "\n").alias("content")))
    out = docs.select("id", F.explode(grouped).alias("c")).select("id", F.col("c.chunk").alias("chunk"), (F.col("c.chunk") * lines + 1).alias("start_line"), F.col("c.content").alias("content"))
    return out.where(F.length(F.trim("content")) > least)


def with_overlap(chunks: DataFrame, size: int = OVERLAP) -> DataFrame:
    """Adds ``overlap``: the last ``size`` characters of the chunk before in the same text."""
    before = F.lag("content").over(Window.partitionBy("id").orderBy("chunk"))
    return chunks.withColumn("overlap", F.coalesce(F.when(F.length(before) > size, F.substring(before, -size, size)).otherwise(before), F.lit("")))


def budget_batches(rows: DataFrame, group: str, order: str, cost: str, limit: int, most: int) -> DataFrame:
    """(group, order, batch): rows of a group in order, a new batch where the sum would exceed ``limit`` or the count ``most``.

    A fold over sorted rows as they stream by: its state is one group's open batch, so a group of any size needs no memory. A null cost is 0.
    """
    plain = rows.select(group, F.col(order).cast("long").alias(order), F.coalesce(F.col(cost).cast("long"), F.lit(0)).alias("_cost"))

    def run(batches):
        last, batch, total, n = object(), 0, 0, 0
        for part in batches:
            out = []
            for g, c in zip(part.column(0).to_pylist(), part.column(2).to_pylist(), strict=True):
                if g != last:
                    last, batch, total, n = g, 0, 0, 0
                elif total + c > limit or n >= most:
                    batch, total, n = batch + 1, 0, 0
                total, n = total + c, n + 1
                out.append(batch)
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(out, pa.int32())], names=[group, order, "batch"])

    kind = f"`{group}` {rows.schema[group].dataType.simpleString()}, `{order}` long, batch int"
    return plain.repartition(group).sortWithinPartitions(group, order).mapInArrow(run, kind)
