"""Notes of one domain that say the same: vectors linked by their cosine, joined into clusters."""

from __future__ import annotations

import functools

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lorestone.operators.graph import components
from lorestone.sources.store import staged

BLOCK = 4096  # rows that are sent to all tasks at once
SLICE = 1024


class _Forest:
    """Links that join different parts, among the rows of a block and of a slice."""

    def __init__(self, n: int):
        self.part = np.arange(n)
        self.links: list[tuple[int, int]] = []

    def join(self, i: int, others: np.ndarray) -> None:
        for j in others.tolist():
            if self.part[j] != self.part[i]:
                self.part[self.part == self.part[j]] = self.part[i]
                self.links.append((i, j))


def _links(rows: DataFrame, block: list, least: float) -> DataFrame:
    """(a, b): a spanning forest of the links between the block and each slice of the rows."""
    shared = rows.sparkSession.sparkContext.broadcast(block)

    def run(batches):
        ids = np.array([r[0] for r in shared.value], np.int64)
        kinds = np.array([f"{r[1]}/{len(r[2])}" for r in shared.value])
        for batch in batches:
            for start in range(0, batch.num_rows, SLICE):
                part = batch.slice(start, SLICE)
                own, domains, units = part.column(0).to_numpy(), part.column(1).to_pylist(), part.column(2).to_pylist()
                here = np.array([f"{d}/{len(u)}" for d, u in zip(domains, units, strict=True)])
                forest = _Forest(len(ids) + len(own))
                for kind in np.intersect1d(kinds, here):
                    x, y = np.flatnonzero(kinds == kind), np.flatnonzero(here == kind)
                    alike = np.array([shared.value[i][2] for i in x]) @ np.array([units[j] for j in y]).T > least
                    for r in np.flatnonzero(alike.any(axis=1)).tolist():
                        j = y[alike[r]]
                        forest.join(int(x[r]), len(ids) + j[own[j] != ids[x[r]]])
                both = np.concatenate([ids, own])
                yield pa.RecordBatch.from_arrays([pa.array([int(both[i]) for i, _ in forest.links], pa.int64()), pa.array([int(both[j]) for _, j in forest.links], pa.int64())], names=["a", "b"])

    found = staged(rows.mapInArrow(run, "a long, b long").distinct(), "alike-links")
    shared.destroy()
    return found


def alike(rows: DataFrame, least: float = 0.85) -> DataFrame:
    """(id, cluster): rows that are linked with another one of their domain by a cosine above ``least``, and the smallest id they are linked with over any number of links.

    ``rows``: id, vector, domain. Vectors without a length, and those of other lengths, are linked with nothing. Rows are taken in blocks, each against all rows: no task holds a domain,
    and what a task gives is at most a link for each of its rows and the block's. The work is quadratic, which suits notes that people write.
    """
    size = F.sqrt(F.aggregate("vector", F.lit(0.0), lambda s, x: s + x.cast("double") * x))
    unit = rows.where("vector IS NOT NULL").select(F.col("id").cast("long").alias("id"), F.col("domain").cast("string").alias("domain"), F.transform("vector", lambda x: x.cast("double") / size).alias("unit"), size.alias("size")).where("size > 0").drop("size")
    unit = staged(unit, "alike-rows")
    found, block = [], []
    for r in unit.toLocalIterator():  # a block at a time
        block.append((r["id"], r["domain"], r["unit"]))
        if len(block) == BLOCK:
            found.append(_links(unit, block, least))
            block = []
    if block:
        found.append(_links(unit, block, least))
    links = functools.reduce(DataFrame.unionAll, found) if found else rows.sparkSession.createDataFrame([], "a long, b long")
    return components(links, lambda df: staged(df, "alike")).withColumnRenamed("component", "cluster")
