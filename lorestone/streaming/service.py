"""One debounced stream for each project: add, remove, status; a batch index comes first."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from lorestone.sources.store import shared_dir


class Watchers:
    """Projects by name; ``handle`` gets each micro-batch of changed rows, as last seen in that batch."""

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.queries: dict[str, object] = {}

    def add(self, name: str, changes: DataFrame, handle: Callable[[DataFrame, int], None], initial: Callable[[], None] | None = None, available: bool = False) -> None:
        """``changes``: a streaming DataFrame. ``available``: take what is there and stop, else go on every two seconds."""
        if name in self.queries:
            raise ValueError(f"{name} is watched already")
        if initial:
            initial()
        writer = changes.writeStream.foreachBatch(handle).option("checkpointLocation", f"{shared_dir(self.spark)}/watch-{name}-{uuid.uuid4().hex}")
        self.queries[name] = (writer.trigger(availableNow=True) if available else writer.trigger(processingTime="2 seconds")).start()

    def remove(self, name: str) -> None:
        self.queries.pop(name).stop()

    def status(self) -> dict[str, bool]:
        return {name: q.isActive for name, q in self.queries.items()}

    def drain(self) -> None:
        for q in self.queries.values():
            q.processAllAvailable() if q.isActive else None

    def stop(self) -> None:
        for name in list(self.queries):
            self.remove(name)
