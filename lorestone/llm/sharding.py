"""Sharding by a Feistel permutation with cycle walking over global row numbers.

Rows are numbered 0..N-1 in the order of (id, checksum, size). A keyed Feistel network permutes the smallest power of four
that holds N; a value outside 0..N-1 is permuted again until it falls inside (cycle walking), so the numbers 0..N-1 are
permuted among themselves. Shard and slot follow from the permuted number alone: ``p % shards`` and ``p // shards``. Counts
of two shards differ by at most one and slots are gapless, whatever the data look like. The same seed and the same rows give
the same result, and :func:`place` finds any row's place without looking at other rows.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import free_name, prefix_sums, read, shuffle_partitions, stage

ROUNDS = 6
SEED = 20_240_229
C1, C2 = 0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93  # odd multipliers of the mix
PART_BITS = 33  # monotonically_increasing_id keeps the partition above these bits


def half_bits(n: int) -> int:
    """Bits of each half of the Feistel block for ``n`` rows."""
    return max(1, (max(2, n - 1).bit_length() + 1) // 2)


def _mixed(x: np.ndarray, key: int) -> np.ndarray:
    """A keyed 64-bit mix (multiply, shift, xor), on unsigned integers that wrap."""
    x = (x + np.uint64(key)) * np.uint64(C1)
    x ^= x >> np.uint64(32)
    x *= np.uint64(C2)
    return x ^ (x >> np.uint64(29))


def round_keys(seed: int) -> list[int]:
    return [(seed * 0x2545F4914F6CDD1D + r * 0xA24BAED4963EE407) % (1 << 64) for r in range(ROUNDS)]


def permute(x: np.ndarray, n: int, seed: int = SEED) -> np.ndarray:
    """The permutation of 0..n-1, applied to each of ``x``."""
    h = np.uint64(half_bits(n))
    mask = np.uint64((1 << int(h)) - 1)
    keys = round_keys(seed)
    out = x.astype(np.uint64)
    todo = np.arange(len(out))
    while len(todo):
        left, right = out[todo] >> h, out[todo] & mask
        for key in keys:
            left, right = right, left ^ (_mixed(right, key) & mask)
        out[todo] = (left << h) | right
        todo = todo[out[todo] >= np.uint64(n)]
    return out.astype(np.int64)


def place(row: int, n: int, shards: int, seed: int = SEED) -> tuple[int, int]:
    """Shard and slot of the row with global number ``row`` among ``n``."""
    p = int(permute(np.array([row]), n, seed)[0])
    return p % shards, p // shards


def number_rows(df: DataFrame, order: list[str], name: str) -> tuple[DataFrame, int]:
    """Adds ``row_number`` (0..N-1 in the order of ``order``) and gives N.

    One range shuffle sorts the rows; each partition numbers its own, and the prefix sums over the partitions' counts, one
    number for each partition, give the first number of each. No window gathers all rows in one task.
    """
    parts = shuffle_partitions(df.sparkSession)
    one = F.monotonically_increasing_id()
    at_col = free_name(df.columns, "_at")
    held = stage(df.repartitionByRange(parts, *order).sortWithinPartitions(*order).withColumn(at_col, one), name)
    part = F.shiftright(at_col, PART_BITS)
    counts = held.groupBy(part.alias("part")).agg(F.count(F.lit(1)).alias("n")).collect()  # a row for each partition
    first, n = prefix_sums([(r["part"], r["n"]) for r in counts])

    firsts = held.sparkSession.sparkContext.broadcast(np.array([first.get(p, 0) for p in range(max(first, default=0) + 1)]))

    @F.pandas_udf(T.LongType())
    def numbered(at: pd.Series) -> pd.Series:
        return pd.Series(firsts.value[at.to_numpy() >> PART_BITS] + (at.to_numpy() & ((1 << PART_BITS) - 1)))

    return held.withColumn("row_number", numbered(at_col)).drop(at_col), n


def shard(df: DataFrame, order: list[str], shards: int, seed: int = SEED) -> DataFrame:
    """Adds ``shard`` and ``slot`` to rows that are ordered, and so numbered, by ``order``.

    An empty table gives an empty table. Rows that agree in all of ``order`` are interchangeable. Null ids are numbered
    first. ``df`` should be narrow: it goes through one shuffle. Columns named row_number, shard or slot are refused (ValueError); all others stay.
    """
    if shards < 1:
        raise ValueError("shards must be positive")
    clash = {"row_number", "shard", "slot"} & {c.lower() for c in df.columns}
    if clash:
        raise ValueError(f"columns {sorted(clash)} are in use")
    numbered, n = number_rows(df, order, "sharding")

    @F.pandas_udf(T.LongType())
    def permuted(row: pd.Series) -> pd.Series:
        return pd.Series(permute(row.to_numpy(), n, seed))

    p = free_name(numbered.columns, "_p")
    out = numbered.withColumn(p, permuted("row_number"))
    return out.withColumns({"shard": (F.col(p) % shards).cast("int"), "slot": F.expr(f"`{p}` div {shards}L")}).drop(p)


def op1_feistel_sharding(spark, sf_dir: str, shards: int = 40) -> DataFrame:
    """Law `rows`: counts differ by at most one. A null text counts no bytes and has the checksum of an empty one."""
    text = F.coalesce(F.col("text"), F.lit(""))
    docs = read(spark, sf_dir, "documents").select("doc_id", (F.octet_length(text) + 16).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"))
    out = shard(docs, ["doc_id", "text_crc32", "size"], shards)
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def _feistel_sql(source: str, half: str) -> str:
    """``source`` has x; the result has x permuted once. One nested SELECT for each step, as each is used twice by the next."""
    m = f"{1 << 64}::UHUGEINT"
    sql = f"SELECT *, (x >> {half})::UBIGINT AS l, (x & ((1::UBIGINT << {half}) - 1))::UBIGINT AS r FROM ({source})"
    for key in round_keys(SEED):
        sql = f"SELECT *, ((r::UHUGEINT + {key}::UHUGEINT) % {m} * {C1}::UHUGEINT % {m})::UBIGINT AS a FROM ({sql})"
        sql = f"SELECT * EXCLUDE (a), (xor(a, a >> 32)::UHUGEINT * {C2}::UHUGEINT % {m})::UBIGINT AS b FROM ({sql})"
        sql = f"SELECT * EXCLUDE (l, r, b), r AS l, xor(l, xor(b, b >> 29) & ((1::UBIGINT << {half}) - 1)) AS r FROM ({sql})"
    return f"SELECT * EXCLUDE (l, r, x), (l << {half}) | r AS x FROM ({sql})"


def _sql(shards: int) -> str:
    """The twin: CRC-32 byte by byte from a table that is computed here, row numbers by a window, cycle walking by recursion."""
    shift = lambda e: f"CASE WHEN {e} & 1 = 1 THEN xor({e} >> 1, 3988292384::UBIGINT) ELSE {e} >> 1 END"
    steps = "SELECT i::UBIGINT AS c, i FROM range(256) t(i)"
    for _ in range(8):
        steps = f"SELECT {shift('c')} AS c, i FROM ({steps})"
    step = _feistel_sql("SELECT row, n, half, x FROM walk WHERE x >= n OR NOT begun", "half").replace("SELECT * EXCLUDE (l, r, x)", "SELECT row, n, half, true AS begun", 1)
    return f"""
WITH RECURSIVE crc_table AS MATERIALIZED (SELECT list(c ORDER BY i) AS t FROM ({steps})),
bytes AS (SELECT doc_id, octet_length(encode(coalesce(text, ''))) AS n_bytes, hex(encode(coalesce(text, ''))) AS h FROM documents),
sums AS (
  SELECT doc_id, n_bytes + 16 AS size, xor(list_reduce(list_transform(range(n_bytes), lambda i: ('0x' || h[2 * i + 1:2 * i + 2])::UBIGINT), lambda s, b: xor(s >> 8, t[(xor(s & 255, b) + 1)::BIGINT]), 4294967295::UBIGINT), 4294967295::UBIGINT)::BIGINT AS text_crc32 FROM bytes, crc_table
),
numbered AS MATERIALIZED (SELECT *, row_number() OVER (ORDER BY doc_id NULLS FIRST, text_crc32, size) - 1 AS row, count(*) OVER () AS n FROM sums),
walk(row, n, half, begun, x) AS (
  SELECT row, n, greatest(1, (length(bin(greatest(2, n - 1))) + 1) // 2)::UBIGINT, false, row::UBIGINT FROM numbered
  UNION ALL ({step})
)
SELECT doc_id, size, text_crc32, 'rows' AS law, (x % {shards})::INTEGER AS shard, (x // {shards})::BIGINT AS slot, NULL::INTEGER AS grown_shard
FROM walk JOIN numbered USING (row) WHERE begun AND x < walk.n
"""


OP1_SQL = _sql(40)
