"""The difference-cover algorithm over tables: suffixes of texts of any total size in order, and the windows that neighbours share.

Positions that are 1 or 2 modulo 3 are sampled. The bytes at each, HEAD at most, are sorted by a range shuffle and named by prefix sums over the partitions;
if names repeat, the string of names is ordered the same way by triples of names, in one task once it fits a bucket, and whole by one sort once its triples reach LENGTH.
HEAD is a multiple of 3, so that places a head apart are sampled alike; two rounds of jobs reach LENGTH, where triples of bytes would need five. Then all positions are merged: splitters, taken from the sampled order, deal every suffix to a
bucket by the comparisons that the cover allows, buckets are merged in memory, and neighbours are compared across their ends too. Every text ends in a symbol of its
own, which is less than all bytes. Only prefixes of LENGTH bytes must come together, so the recursion ends when names stand for that many; ties there are broken by position.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop_staged, shuffle_partitions, stage

BUCKET = 1 << 18  # suffixes of a bucket, about
HEAD = 69  # bytes of a first name at most, a multiple of 3; three of them are longer than LENGTH
OVERSAMPLED = 16  # candidates for each splitter, so that buckets are alike
U = np.uint64


def _arrow(names: str, *columns: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=names.split())


def _shifted(df: DataFrame, bases: dict[int, tuple[int, ...]], key: str, names: list[str]) -> DataFrame:
    """Adds to the columns ``names`` the numbers of the row's ``key``: one row for each partition or bucket."""
    columns = [[*bases], *([v[k] for v in bases.values()] for k in range(len(names)))]
    table = df.sparkSession.createDataFrame(pa.table([pa.array(c, pa.int64()) for c in columns], names=["_key", *(f"_{n}" for n in names)]))  # stays with the driver, no job
    joined = df.join(F.broadcast(table), F.col(key).cast("long") == F.col("_key"))
    return joined.withColumns({n: F.col(n) + F.col(f"_{n}") for n in names}).drop("_key", *(f"_{n}" for n in names))


def placed(pieces: DataFrame) -> DataFrame:
    """(start, f1, f2, piece): the pieces one behind the other, a place for the end symbol between them; gaps spread their starts over all residues."""

    def run(batches):
        part, at = TaskContext.get().partitionId(), 0
        for batch in batches:
            f1 = batch.column(0).to_numpy()
            size = np.array([len(p) for p in batch.column(2).to_pylist()], np.int64) + 1 + f1 % 3
            ends = at + np.cumsum(size)
            at = int(ends[-1]) if len(ends) else at
            n = len(size)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(n, part, np.int64)), pa.array(ends - size), pa.array(ends), *batch.columns], names=["part", "start", "end", "f1", "f2", "piece"])

    rows = stage(pieces.select("f1", "f2", "piece").mapInArrow(run, "part long, start long, end long, f1 long, f2 long, piece binary"), "suffixes-placed")
    bases, at = {}, 0
    for r in rows.groupBy("part").agg(F.max("end").alias("end")).orderBy("part").collect():  # a row for each partition
        bases[r["part"]] = (at,)
        at += r["end"]
    return _shifted(rows, bases, "part", ["start"]).select("start", "f1", "f2", "piece")


def _heads(texts: DataFrame, width: int) -> DataFrame:
    """(pos, head, end) of the sampled places of the texts and their ends: the next ``width`` bytes, fewer where the text ends, and its end symbol if it stands among them, else 0."""

    def run(batches):
        for batch in batches:
            for start, piece in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                data = np.frombuffer(piece, np.uint8)
                n = len(data)
                every = np.lib.stride_tricks.sliding_window_view(np.concatenate([data, np.zeros(width, np.uint8)]), width)
                sampled = np.flatnonzero((start + np.arange(n + 1)) % 3)
                for k in range(0, len(sampled), 1 << 14):
                    at = sampled[k : k + (1 << 14)]
                    sizes = np.minimum(width, n - at)
                    offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
                    flat = every[at][np.arange(width) < sizes[:, None]]
                    head = pa.Array.from_buffers(pa.binary(), len(at), [None, pa.py_buffer(offsets), pa.py_buffer(flat)])
                    yield _arrow("pos head end", start + at, head, np.where(n - at < width, -1 - start - n, 0))

    return texts.select("start", "piece").mapInArrow(run, "pos long, head binary, end long")


def _letters(texts: DataFrame, length: int) -> DataFrame:
    """(pos, s0, s1) of every place of the texts and their ends, two hashes of its window, 0 where none fits, and the text's start."""
    from .suffix_dedup import gram_hashes

    names = "pos s0 s1 w1 w2 start"

    def run(batches):
        for batch in batches:
            for start, piece in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                data = np.frombuffer(piece, np.uint8)
                n = len(data)
                s = np.concatenate([data.astype(np.int64) + 1, [-1 - start - n, 0]])
                w = np.zeros((2, n + 1), np.int64)
                if n >= length:
                    w[0, : n - length + 1] = gram_hashes(data, length).view(np.int64)
                    w[1, : n - length + 1] = gram_hashes(data ^ np.uint8(0x5A), length).view(np.int64)
                yield _arrow(names, start + np.arange(n + 1), s[:-1], s[1:], w[0], w[1], np.full(n + 1, start))

    return texts.select("start", "piece").mapInArrow(run, ", ".join(f"{c} long" for c in names.split()))


def _named(places: DataFrame, key: list[str]) -> tuple[DataFrame, DataFrame, bool]:
    """(pos, name, row) of the places, by the columns ``key`` in order; what is staged for it; whether all names differ."""
    parts = shuffle_partitions(places.sparkSession)
    ordered = places.select("pos", *key).repartitionByRange(parts, *key, "pos").sortWithinPartitions(*key, "pos")
    names = "pos part name row first last"

    def run(batches):
        part, name, row = TaskContext.get().partitionId(), 0, 0
        first = last = None
        for batch in batches:
            pos, *columns = batch.columns
            n = len(pos)
            if not n:
                continue
            new = np.zeros(n, bool)
            for c in columns:
                new[1:] |= pc.not_equal(c[1:], c[:-1]).to_numpy(zero_copy_only=False)
            head, tail = (repr([c[k].as_py() for c in columns]) for k in (0, n - 1))
            new[0] = head != last
            first, last = first or head, tail
            none = pa.nulls(n, pa.string())
            yield _arrow(names, pos, np.full(n, part), name + np.cumsum(new), row + np.arange(n), none, none)
            name, row = name + int(new.sum()), row + n
        if first:  # one row for the partition: how many names and rows, its first and its last key
            yield _arrow(names, *(np.array([x], np.int64) for x in (-1, part, name, row)), pa.array([first]), pa.array([last]))

    found = stage(ordered.mapInArrow(run, "pos long, part long, name long, row long, first string, last string"), "suffixes-names")
    bases, name, row, last = {}, 0, 0, None
    for r in found.where("pos < 0").orderBy("part").collect():  # a row for each partition
        same = r["first"] == last
        bases[r["part"]] = (name - same, row)
        name, row, last = name - same + r["name"], row + r["row"], r["last"]
    return _shifted(found.where("pos >= 0").select("pos", "part", "name", "row"), bases, "part", ["name", "row"]).drop("part"), found, name == row


def _less(rows: list[np.ndarray], fixed: list[np.ndarray]) -> np.ndarray:
    """For each of the tuples ``rows`` how many of the tuples ``fixed`` are less."""
    flag = np.concatenate([np.zeros(len(rows[0]), bool), np.ones(len(fixed[0]), bool)])
    order = np.lexsort((flag, *(np.concatenate([r, f]) for r, f in zip(rows[::-1], fixed[::-1], strict=True))))
    out = np.empty(len(flag), np.int64)
    out[order] = np.cumsum(flag[order])
    return out[: len(rows[0])]


def _ahead(rest: dict[str, np.ndarray], sampled: dict[str, np.ndarray]) -> np.ndarray:
    """For each suffix of ``rest``, of residue 0, how many of the sampled ones are less: by a symbol and the ranks behind it, or by two symbols."""
    one, two = sampled["pos"] % 3 == 1, sampled["pos"] % 3 == 2
    pick = lambda at, *names: [sampled[n][at] for n in names]
    return _less([rest[n] for n in ("s0", "r1")], pick(one, "s0", "r1")) + _less([rest[n] for n in ("s0", "s1", "r2")], pick(two, "s0", "s1", "r2"))


COLUMNS = ("pos", "s0", "s1", "r0", "r1", "r2")


def _bucketed(places: DataFrame, ranks: DataFrame, more: tuple[str, ...]) -> DataFrame:
    """The places with the ranks at and behind them, each in its bucket; staged."""
    at = F.array(*[F.struct((F.col("pos") - k).alias("pos"), *[(F.col("rank") if j == k else F.lit(None).cast("long")).alias(f"r{j}") for j in range(3)]) for k in range(3)])
    near = ranks.select(F.explode(at).alias("x")).select("x.*")
    own = [*places.select("s0", "s1", *more).columns]
    none = F.lit(None).cast("long")
    both = places.select("pos", *own, *[none.alias(f"r{j}") for j in range(3)]).unionByName(near.select("pos", *[none.alias(c) for c in own], "r0", "r1", "r2"))
    full = both.groupBy("pos").agg(*[F.max(c).alias(c) for c in own], *[F.coalesce(F.max(f"r{j}"), F.lit(0)).alias(f"r{j}") for j in range(3)]).where("s0 IS NOT NULL")
    full = stage(full.select(*COLUMNS, *more), "suffixes-places")
    n = full.count()
    buckets = -(-n // BUCKET)
    every = max(1, n * 2 // 3 // (OVERSAMPLED * buckets)) if buckets > 1 else 0
    chosen = full.where("pos % 3 <> 0").where(F.pmod(F.xxhash64("pos"), F.lit(every)) == 0).select(*COLUMNS).orderBy("r0").collect() if every else []  # about OVERSAMPLED for each bucket
    chosen = chosen[OVERSAMPLED - 1 :: OVERSAMPLED]
    fixed = full.sparkSession.sparkContext.broadcast({c: np.array([r[c] for r in chosen], np.int64) for c in COLUMNS})

    def run(batches):
        for batch in batches:
            x = {c: batch.column(i).to_numpy() for i, c in enumerate(COLUMNS)}
            bucket = np.searchsorted(fixed.value["r0"], x["r0"], side="right")
            rest = x["pos"] % 3 == 0
            bucket[rest] = _ahead({c: v[rest] for c, v in x.items()}, fixed.value)
            yield pa.RecordBatch.from_arrays([pa.array(bucket.astype(np.int64)), *batch.columns], names=["bucket", *batch.schema.names])

    dealt = full.mapInArrow(run, "bucket long, " + ", ".join(f"{c} long" for c in full.columns))
    dealt._staged = full
    return dealt


def _merged(table: pa.Table) -> np.ndarray:
    """The order of a bucket's rows."""
    x = {c: table.column(c).to_numpy() for c in COLUMNS}
    rest, sampled = np.flatnonzero(x["pos"] % 3 == 0), np.flatnonzero(x["pos"] % 3 != 0)
    sampled = sampled[np.argsort(x["r0"][sampled], kind="stable")]
    rest = rest[np.lexsort((x["r1"][rest], x["s0"][rest]))]
    # suffixes that share more than the recursion tells apart may be told apart differently by either residue: they stay in one order
    at = np.maximum.accumulate(_ahead({c: v[rest] for c, v in x.items()}, {c: v[sampled] for c, v in x.items()})) + np.arange(len(rest))
    free = np.ones(len(x["pos"]), bool)
    free[at] = False
    out = np.empty(len(free), np.int64)
    out[at], out[free] = rest, sampled
    return out


def _ranked_here(string: DataFrame) -> DataFrame:
    """(pos, rank) of a string that fits a bucket, by the same algorithm in one task."""
    from .suffix_dedup import suffix_array

    def run(table: pa.Table) -> pa.Table:
        pos, name = table.column("pos").to_numpy(), table.column("s0").to_numpy()
        order = np.argsort(pos)
        pos, symbols = pos[order], np.unique(name, return_inverse=True)[1][order] + 1
        return pa.table([pa.array(pos[suffix_array(symbols)]), pa.array(np.arange(1, len(pos) + 1))], names=["pos", "rank"])

    return string.select(F.lit(0).alias("all"), "pos", "s0").groupBy("all").applyInArrow(run, "pos long, rank long")


def _ranked(places: DataFrame, key: list[str], width: int, depth: int) -> tuple[DataFrame, list[DataFrame]]:
    """(pos, rank) of the sampled places, ranks from 1; and what is staged for it. ``key``: columns that hold the next ``width`` symbols."""
    named, found, unique = _named(places.where("pos % 3 <> 0"), key)
    if unique or depth == 0:
        return named.select("pos", (F.col("row") + 1).alias("rank")), [found]
    # names of places that are ``width`` apart stand one behind the other: a chain for each sampled residue modulo ``width``
    chain = found.agg(F.max("pos")).first()[0] // width + 4
    to = F.expr(f"(pos % {width} div 3 * 2 + pos % 3 - 1) * {chain} + pos div {width}")
    at = F.array(*[F.struct((to - k).alias("pos"), *[(F.col("name") if j == k else F.lit(None).cast("long")).alias(f"s{j}") for j in range(3)]) for k in range(3)])
    shorter = named.select(F.explode(at).alias("x")).select("x.*").groupBy("pos").agg(F.max("s0").alias("s0"), *[F.coalesce(F.max(f"s{j}"), F.lit(0)).alias(f"s{j}") for j in (1, 2)])
    shorter = stage(shorter.where("s0 IS NOT NULL"), "suffixes-string")
    drop_staged(found)
    back = F.expr(f"pos % {chain} * {width} + pos div {chain} div 2 * 3 + pos div {chain} % 2 + 1")
    if shorter.count() <= BUCKET:
        ranks = stage(_ranked_here(shorter), "suffixes-ranks")
        drop_staged(shorter)
        return ranks.select(back.alias("pos"), "rank"), [ranks]
    triple = ["s0", "s1", "s2"]
    if depth == 1:  # triples reach as far as is asked for: their order is that of all places, sampled or not
        named, found, _ = _named(shorter, triple)
        drop_staged(shorter)
        return named.select(back.alias("pos"), (F.col("row") + 1).alias("rank")), [found]
    ranks, used = _ranked(shorter, triple, 3, depth - 1)
    dealt = _bucketed(shorter, ranks, ())

    def run(table: pa.Table) -> pa.Table:
        order = _merged(table)
        return pa.table([table.column("pos").take(pa.array(order)), table.column("bucket").take(pa.array(order)), pa.array(np.arange(1, len(order) + 1))], names=["pos", "bucket", "rank"])

    merged = stage(dealt.groupBy("bucket").applyInArrow(run, "pos long, bucket long, rank long"), "suffixes-merged")
    drop_staged(shorter, dealt._staged, *used)
    bases, n = {}, 0
    for r in merged.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).orderBy("bucket").collect():  # a row for each bucket
        bases[r["bucket"]] = (n,)
        n += r["n"]
    ranks = _shifted(merged, bases, "bucket", ["rank"])
    return ranks.select(back.alias("pos"), "rank"), [merged]


def repeated(pieces: DataFrame, length: int) -> DataFrame:
    """(f1, f2, lo, hi): the windows of ``length`` bytes that start from lo up to and without hi and start elsewhere in the pieces too, as whole runs. ``pieces``: f1, f2, piece, of any number and size."""
    kind = "f1 long, f2 long, lo int, hi int"
    if pieces.isEmpty():
        return pieces.sparkSession.createDataFrame([], kind)
    texts = placed(pieces)
    width, depth = min(HEAD, 3 * -(-length // 9)), 0
    while width * 3**depth < length:
        depth += 1
    ranks, used = _ranked(_heads(texts, width), ["head", "end"], width, depth)
    dealt = _bucketed(_letters(texts, length), ranks, ("w1", "w2", "start"))
    names = "start pos bucket edge w1 w2"

    def run(table: pa.Table) -> pa.Table:
        order = _merged(table)
        pos, start, w1, w2 = (table.column(c).to_numpy()[order] for c in ("pos", "start", "w1", "w2"))
        same = (w1[1:] == w1[:-1]) & (w2[1:] == w2[:-1]) & ((w1[1:] != 0) | (w2[1:] != 0))
        hit = np.zeros(len(order), bool)
        hit[1:] |= same
        hit[:-1] |= same
        rows = np.concatenate([np.flatnonzero(hit), [0, len(order) - 1]])  # and the bucket's ends
        edge = np.concatenate([np.zeros(int(hit.sum()), np.int64), [1, 2]])
        bucket = np.full(len(rows), table.column("bucket")[0].as_py(), np.int64)
        return pa.table([pa.array(c) for c in (start[rows], pos[rows], bucket, edge, w1[rows], w2[rows])], names=names.split())

    found = stage(dealt.groupBy("bucket").applyInArrow(run, ", ".join(f"{c} long" for c in names.split())), "suffixes-hits")
    drop_staged(dealt._staged, *used)
    ends, last = [], None
    for r in found.where("edge > 0").orderBy("bucket", "edge").collect():  # two rows for each bucket
        if r["edge"] == 1 and last and (r["w1"], r["w2"]) == (last["w1"], last["w2"]) != (0, 0):
            ends += [(last["start"], last["pos"]), (r["start"], r["pos"])]
        last = r
    hits = found.where("edge = 0").select("start", "pos")
    if ends:
        hits = hits.unionAll(found.sparkSession.createDataFrame(ends, "start long, pos long"))
    runs = hits.groupBy("start").agg(F.collect_set("pos").alias("places"))  # of one piece

    def ranges(batches):
        for batch in batches:
            out: tuple[list, ...] = ([], [], [])
            for start, places in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                at = np.sort(places.values.to_numpy()) - start
                cut = np.flatnonzero(np.diff(at) > 1)
                lo, hi = at[np.concatenate([[0], cut + 1])], at[np.concatenate([cut, [len(at) - 1]])] + 1
                for column, values in zip(out, (np.full(len(lo), start), lo, hi), strict=True):
                    column.append(values)
            kinds = (pa.int64(), pa.int32(), pa.int32())
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([np.zeros(0, np.int64), *c]), k) for c, k in zip(out, kinds, strict=True)], names=["start", "lo", "hi"])

    found = runs.mapInArrow(ranges, "start long, lo int, hi int")
    return found.join(texts.select("start", "f1", "f2"), "start").select("f1", "f2", "lo", "hi")
