"""Embedders and configuration: functions of tables, chosen by name."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

Embedder = Callable[[DataFrame], DataFrame]
#: Configuration layers, the last one that names a key decides. Fixed values.
LAYERS = ("defaults", "environment", "settings", "project", "overrides")


def hashed(text: Column, size: int = 16) -> Column:
    """A vector of ``size`` numbers from -1 to 1 that only depends on the text: for tests and for runs without a model."""
    digest = F.concat(*[F.sha2(F.concat(F.lit(f"{k}:"), text), 256) for k in range(-(-size // 32))])
    number = lambda k: F.conv(F.substring(digest, 2 * k + 1, 2), 16, 10).cast("double") / 127.5 - 1.0
    return F.array(*[number(k) for k in range(size)])


def hash_embedder(size: int = 16) -> Embedder:
    """(content_hash, content) to (content_hash, vector)."""
    return lambda contents: contents.select("content_hash", hashed(F.col("content"), size).alias("vector"))


registry: dict[str, Callable[..., Embedder]] = {"hash": hash_embedder}


def embedder(config: dict[str, object]) -> Embedder:
    """The embedder that a configuration names by ``provider``; its other entries are the embedder's options."""
    options = dict(config)
    name = options.pop("provider", "hash")
    if name not in registry:
        raise ValueError(f"provider must be one of {sorted(registry)}")
    return registry[name](**options)


def layered(entries: DataFrame) -> DataFrame:
    """(key, value, layer) that counts: of the highest layer, and in a layer the last line. ``entries``: layer, n, key, value; unknown layers are refused by leaving them out."""
    place = F.array_position(F.array(*[F.lit(x) for x in LAYERS]), F.col("layer"))
    ranked = entries.where(place > 0).withColumn("_r", F.row_number().over(Window.partitionBy("key").orderBy(F.desc(place), F.desc("n"))))
    return ranked.where("_r = 1").select("key", "value", "layer")
