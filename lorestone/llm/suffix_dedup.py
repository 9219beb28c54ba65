"""Repeated passages by distributed suffix arrays, built with the difference-cover algorithm.

A byte string of LENGTH bytes is a window. Suffixes that share a window must meet in one sort, so text is first dealt out by content: each
window is named by the least hash among its GRAM-byte substrings, which equal windows share, and neighbouring windows of one name form a
segment. A name that one place of the corpus gave cannot belong to a repeated window, and segments with the same bytes are counted, not
compared. What is left, different segments of one name, goes to shards; a shard's suffix array is built by sorting sampled triples,
recursing on their names and merging the remaining suffixes, and windows are equal where adjacent suffixes share LENGTH bytes. Segments of
a name with more text than a shard holds are parted anew by FINE_GRAM-byte substrings; the names that still have too much go through the same algorithm
over tables (distributed_suffixes), which no task holds whole.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import drop_staged, free_name, read, shuffle_partitions, stage
from .distributed_suffixes import repeated

LENGTH = 200
GRAM = 64
SHARD_BYTES = 400_000  # of text in one task's suffix array
PIECE = 1 << 15  # windows of a segment at most; longer ones, of periodic text, are cut
MANY = 1000  # segments of a name beyond which, as beyond SHARD_BYTES, each is parted anew by longer substrings
FINE_GRAM = 184
BROADCAST_NAMES = 1_000_000  # of 8 bytes
U = np.uint64
A, B = U(0xBF58476D1CE4E5B9), U(0x94D049BB133111EB)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> U(30))) * A
    x = (x ^ (x >> U(27))) * B
    return x ^ (x >> U(31))


def gram_hashes(data: np.ndarray, k: int) -> np.ndarray:
    """A hash of every k-byte substring, by doubling."""
    part, size, out, done = _mixed(data.astype(U) + U(0x9E3779B97F4A7C15)), 1, None, 0
    join = lambda x, y: (x ^ (x >> U(31))) * A + y
    while True:
        if k & size:
            if out is None:
                out = part
            else:
                n = len(part) - done
                out = join(out[:n], part[done : done + n])
            done += size
        if size * 2 > k:
            return _mixed(out)
        n = len(part) - size
        part = join(part[:n], part[size : size + n])
        size *= 2


def window_minima(x: np.ndarray, width: int) -> np.ndarray:
    """The minimum of every ``width`` neighbours, by doubling."""
    part, size = x, 1
    while size * 2 <= width:
        part = np.minimum(part[:-size], part[size:])
        size *= 2
    n = len(x) - width + 1
    return part[:n] if size == width else np.minimum(part[:n], part[width - size : width - size + n])


def segments(data: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(name, lo, hi, again): the windows from lo up to and without hi have that name; whether several places of the text gave it."""
    if len(data) < length:
        return np.zeros(0, U), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool)
    h, width = gram_hashes(data, gram), length - gram + 1
    least = window_minima(h, width)
    # a place gave a name if it is the least of some window around it; then no window around it has a larger one
    edge = np.zeros(width - 1, U)
    gave = h[h == ~window_minima(~np.concatenate([edge, least, edge]), width)]
    values, times = np.unique(gave, return_counts=True)
    new = np.flatnonzero(np.concatenate([[True], least[1:] != least[:-1]]))
    end = np.concatenate([new[1:], [len(least)]])
    cuts = -(-(end - new) // PIECE)
    if (cuts > 1).any():
        part = np.arange(int(cuts.sum())) - np.repeat(np.cumsum(cuts) - cuts, cuts)
        end, new = np.minimum(np.repeat(new, cuts) + (part + 1) * PIECE, np.repeat(end, cuts)), np.repeat(new, cuts) + part * PIECE
    name = least[new]
    return name, new, end, times[np.searchsorted(values, name)] > 1


def keys(*groups: tuple[np.ndarray, ...]) -> list[np.ndarray]:
    """One number for each tuple of a group's columns, in the tuples' order and comparable between the groups: packed where they fit 62 bits, else ranks from one sort."""
    widths = [max(1, max((int(g[k].max(initial=0)).bit_length() for g in groups), default=1)) for k in range(len(groups[0]))]
    if sum(widths) <= 62:
        out = []
        for g in groups:
            key = g[0].astype(np.int64)
            for column, width in zip(g[1:], widths[1:], strict=True):
                key = (key << width) | column
            out.append(key)
        return out
    columns = [np.concatenate([g[k] for g in groups]) for k in range(len(groups[0]))]
    order = np.lexsort(columns[::-1])
    new = np.zeros(len(order), bool)
    for c in columns:
        new[1:] |= c[order[1:]] != c[order[:-1]]
    rank = np.empty(len(order), np.int64)
    rank[order] = np.cumsum(new)
    return np.split(rank, np.cumsum([len(g[0]) for g in groups])[:-1])


def suffix_array(s: np.ndarray) -> np.ndarray:
    """Suffix array of symbols >= 1, by difference cover modulo 3; a suffix that ends sorts ahead of its continuations."""
    n = len(s)
    if n < 3:
        return np.array(sorted(range(n), key=lambda i: s[i:].tolist()), np.int64)
    t = np.concatenate([s.astype(np.int64), np.zeros(3, np.int64)])
    n0, n1 = (n + 2) // 3, (n + 1) // 3
    first = np.arange(1, n + (n0 - n1), 3)  # with one place behind the end if that makes both halves separable
    sampled = np.concatenate([first, np.arange(2, n, 3)])
    [triple] = keys((t[sampled], t[sampled + 1], t[sampled + 2]))
    order = np.argsort(triple, kind="stable")
    in_order = triple[order]
    name = np.cumsum(np.concatenate([[1], in_order[1:] != in_order[:-1]]))
    if name[-1] < len(sampled):
        names = np.empty(len(sampled), np.int64)
        names[order] = name
        del triple, in_order, name, order  # the recursion needs the memory
        order = suffix_array(names)
    rank = np.zeros(n + 3, np.int64)
    places = sampled[order]
    rank[places] = np.arange(1, len(order) + 1)
    places = places[places < n]
    rest = np.arange(0, n, 3)
    [key] = keys((t[rest], rank[rest + 1]))
    rest = rest[np.argsort(key, kind="stable")]
    ones, twos = places[places % 3 == 1], places[places % 3 == 2]
    a, b = keys(*((t[p], rank[p + 1]) for p in (ones, rest)))
    ahead = np.searchsorted(a, b)
    a, b = keys(*((t[p], t[p + 1], rank[p + 2]) for p in (twos, rest)))
    ahead += np.searchsorted(a, b)
    out = np.empty(n, np.int64)
    at = ahead + np.arange(len(rest))
    free = np.ones(n, bool)
    free[at] = False
    out[at] = rest
    out[free] = places
    return out


def repeated_windows(texts: list[bytes], length: int) -> list[np.ndarray]:
    """For each text, which of its windows start elsewhere in ``texts`` too, by adjacent suffixes."""
    sizes = np.array([len(t) for t in texts])
    flat = np.frombuffer(b"".join(t + b"\0" for t in texts), np.uint8)
    starts = np.cumsum(sizes + 1) - sizes - 1
    symbols = flat.astype(np.int64) + 2
    symbols[starts + sizes] = 1
    sa = suffix_array(symbols)
    full = np.zeros(len(flat), bool)  # where a window starts
    for a, n in zip(starts.tolist(), sizes.tolist(), strict=True):
        full[a : a + max(0, n - length + 1)] = True
    padded = np.concatenate([flat, np.zeros(8, np.uint8)])
    eight = np.zeros(len(flat), U)
    for k in range(8):
        eight = (eight << U(8)) | padded[k : k + len(flat)]
    near = np.flatnonzero(full[sa[:-1]] & full[sa[1:]])
    for k in [*range(0, length - 7, 8), *([length - 8] if length >= 8 else [])]:
        near = near[eight[sa[near] + k] == eight[sa[near + 1] + k]]
    if length < 8:
        for k in range(length):
            near = near[flat[sa[near] + k] == flat[sa[near + 1] + k]]
    hit = np.zeros(len(flat), bool)
    hit[sa[near]] = hit[sa[near + 1]] = True
    return [hit[a : a + max(0, n - length + 1)] for a, n in zip(starts.tolist(), sizes.tolist(), strict=True)]


def ranges_of(flags: np.ndarray) -> list[tuple[int, int]]:
    edge = np.flatnonzero(np.diff(np.concatenate([[0], flags.astype(np.int8), [0]])))
    return list(zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True))




def _named(docs: DataFrame, length: int, gram: int) -> DataFrame:
    def run(batches):
        for batch in batches:
            for k in range(0, batch.num_rows, 200):
                part = batch.slice(k, 200)
                row, names, los, his, agains = [], [], [], [], []
                for i, text in enumerate(part.column(2)):
                    name, lo, hi, again = segments(np.frombuffer(text.as_py() or b"", np.uint8), length, gram)
                    row.append(np.full(len(name), i))
                    names.append(name.view(np.int64))
                    los.append(lo)
                    his.append(hi)
                    agains.append(again)
                take = pa.array(np.concatenate(row))
                yield pa.RecordBatch.from_arrays([part.column(0).take(take), part.column(1).take(take), pa.array(np.concatenate(names)), pa.array(np.concatenate(los).astype(np.int32)), pa.array(np.concatenate(his).astype(np.int32)), pa.array(np.concatenate(agains))], names=["d", "h", "name", "lo", "hi", "again"])

    return docs.select("d", "h", "text").mapInArrow(run, "d long, h long, name long, lo int, hi int, again boolean")


def _cut(docs: DataFrame, length: int) -> DataFrame:
    """One row for each segment in ``parts``, with its bytes and two hashes of them."""
    import xxhash

    def run(batches):
        for batch in batches:
            for k in range(0, batch.num_rows, 100):
                part = batch.slice(k, 100)
                row, names, los, n, f1, f2, texts, agains = [], [], [], [], [], [], [], []
                for i, (text, parts) in enumerate(zip(part.column(2), part.column(3), strict=True)):
                    text = text.as_py()
                    for s in parts.as_py():
                        piece = text[s["lo"] : s["hi"] + length - 1]
                        f = xxhash.xxh3_128_intdigest(piece)
                        row.append(i)
                        names.append(s["name"])
                        los.append(s["lo"])
                        n.append(s["hi"] - s["lo"])
                        f1.append(f >> 64)
                        f2.append(f & (2**64 - 1))
                        texts.append(piece)
                        agains.append(s["again"])
                take = pa.array(row, pa.int64())
                signed = lambda x: pa.array(np.array(x, U).view(np.int64))
                yield pa.RecordBatch.from_arrays([part.column(0).take(take), part.column(1).take(take), pa.array(names, pa.int64()), pa.array(los, pa.int32()), pa.array(n, pa.int32()), signed(f1), signed(f2), pa.array(texts, pa.binary()), pa.array(agains, pa.bool_())], names=["d", "h", "name", "lo", "n", "f1", "f2", "piece", "again"])

    return docs.mapInArrow(run, "d long, h long, name long, lo int, n int, f1 long, f2 long, piece binary, again boolean")


def _parted(many: DataFrame, length: int) -> DataFrame:
    """Segments of names that have very many, parted anew: their windows are named by longer substrings, together with the old name. g1 and g2 are hashes of the new piece."""
    import xxhash

    def run(batches):
        for batch in batches:
            out: tuple[list, ...] = ([], [], [], [], [], [], [], [], [])
            for name, f1, f2, piece in zip(*(batch.column(c).to_pylist() for c in range(4)), strict=True):
                for fine, lo, hi, again in zip(*(x.tolist() for x in segments(np.frombuffer(piece, np.uint8), length, max(1, min(FINE_GRAM, length - 1)))), strict=True):
                    part = piece[lo : hi + length - 1]
                    g = xxhash.xxh3_128_intdigest(part)
                    for col, v in zip(out, ((fine * 31 + name) % 2**64 - 2**63, f1, f2, lo, hi - lo, (g >> 64) - 2**63, g % 2**64 - 2**63, part, again), strict=True):
                        col.append(v)
            types = (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.binary(), pa.bool_())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, types, strict=True)], names=["name", "f1", "f2", "off", "n", "g1", "g2", "piece", "again"])

    return many.mapInArrow(run, "name long, f1 long, f2 long, off int, n int, g1 long, g2 long, piece binary, again boolean")


def _compared(parts: DataFrame, length: int) -> DataFrame:
    """(f1, f2, lo, hi): windows of a segment that stand elsewhere among the different segments of its name too."""
    bound = SHARD_BYTES

    def run(batches):
        names, rows, size = [], [], 0

        def flush():
            if size > 2 * bound:
                raise ValueError(f"a shard has {size} bytes of text")
            out: tuple[list, ...] = ([], [], [], [])
            for (f1, f2, _), flags in zip(rows, repeated_windows([r[2] for r in rows], length), strict=True):
                for lo, hi in ranges_of(flags):
                    for col, v in zip(out, (f1, f2, lo, hi), strict=True):
                        col.append(v)
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, (pa.int64(), pa.int64(), pa.int32(), pa.int32()), strict=True)], names=["f1", "f2", "lo", "hi"])

        for batch in batches:
            for name, *row in zip(*(batch.column(c).to_pylist() for c in range(4)), strict=True):
                if size >= bound and name != names[-1]:
                    yield flush()
                    names, rows, size = [], [], 0
                names.append(name)
                rows.append(row)
                size += len(row[2])
        if rows:
            yield flush()

    return parts.mapInArrow(run, "f1 long, f2 long, lo int, hi int")


def _split(groups: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(name, f1, f2, piece) of different pieces to compare: those of names that fit a shard, and those of names that do not; and the staged sizes they are read by."""
    by_name = groups.groupBy("name").agg(F.count(F.lit(1)).alias("kinds"), F.sum(F.octet_length("piece")).alias("bytes"), F.max("again").alias("twice"))
    by_name = stage(by_name.where("kinds > 1 OR twice"), "repeats-sizes")
    crowded = (F.col("kinds") > MANY) | (F.col("bytes") > SHARD_BYTES)
    rows = lambda g: g.select("name", "f1", "f2", "piece")
    names = by_name.where(crowded).select("name")
    if names.count() <= BROADCAST_NAMES:  # each has much text; else the join is left to the planner
        names = F.broadcast(names)
    return rows(groups.join(names, "name", "left_anti").join(by_name.where(~crowded), "name")), rows(groups.join(names, "name")), by_name


def _sharded(few: DataFrame, length: int) -> DataFrame:
    return _compared(few.repartition(shuffle_partitions(few.sparkSession), "name").sortWithinPartitions("name", "f1", "f2"), length)


def find_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH) -> DataFrame:
    """Adds ``spans`` to every row: disjoint ranges (start, end) of UTF-8 bytes, in order and not touching, covered by strings of ``length`` bytes that start elsewhere too.

    Strings never cross documents; overlapping occurrences count, within a document too. Null, empty and shorter texts have no spans. Repeated rows are repeats
    of each other. A column named spans is refused (ValueError); all others stay.
    """
    if length < 2:
        raise ValueError("length must be at least 2")
    if "spans" in (c.lower() for c in docs.columns):
        raise ValueError("a column is named spans")
    gram = max(1, min(GRAM, length // 2))
    text = F.col(text_col).cast("binary")
    d_col, h_col = free_name(docs.columns, "_d"), free_name(docs.columns, "_h")
    keyed = docs.withColumns({d_col: F.coalesce(F.col(id_col).cast("long"), F.lit(-(2**63))), h_col: F.xxhash64(text)})
    plain = keyed.select(F.col(d_col).alias("d"), F.col(h_col).alias("h"), text.alias("text"))
    named = stage(_named(plain, length, gram), "repeats-names")
    shared = named.groupBy("name").agg(F.count(F.lit(1)).alias("times"), F.max("again").alias("again")).where("times > 1 OR again").select("name")
    # rows that repeat an id and a text have the same segments twice; they are kept once here and counted below
    kept = named.join(shared, "name").groupBy("d", "h").agg(F.collect_set(F.struct("name", "lo", "hi", "again")).alias("parts"))  # of one document
    kept = stage(kept, "repeats-shared")
    drop_staged(named)
    cut = stage(_cut(plain.join(kept, ["d", "h"]), length), "repeats-segments")
    drop_staged(kept)
    groups = cut.groupBy("name", "f1", "f2").agg(F.count(F.lit(1)).alias("times"), F.first("piece").alias("piece"), F.first("n").alias("n"), F.max("again").alias("again"))
    groups = stage(groups, "repeats-groups")
    few, many, sizes = _split(groups)
    # names with too many segments for a shard: pieces by a longer name, equal ones counted as above, found in pieces first and then placed in their segments
    fine = stage(_parted(many, length), "repeats-fine")
    pieces = stage(fine.groupBy("name", F.col("g1").alias("f1"), F.col("g2").alias("f2")).agg(F.count(F.lit(1)).alias("times"), F.first("piece").alias("piece"), F.first("n").alias("n"), F.max("again").alias("again")), "repeats-pieces")
    fine_few, fine_many, fine_sizes = _split(pieces)
    used = [fine, pieces, sizes, fine_sizes]
    whole = lambda g: g.where("times > 1").select("f1", "f2", F.lit(0).alias("lo"), F.col("n").alias("hi"))
    inner = _sharded(fine_few, length).unionAll(repeated(fine_many, length)).unionAll(whole(pieces)).withColumnsRenamed({"f1": "g1", "f2": "g2"})
    placed = fine.select("f1", "f2", "off", "g1", "g2").join(inner, ["g1", "g2"]).select("f1", "f2", (F.col("off") + F.col("lo")).alias("lo"), (F.col("off") + F.col("hi")).alias("hi"))
    found = _sharded(few, length).unionAll(placed).unionAll(whole(groups))
    hits = cut.select("d", "h", "f1", "f2", F.col("lo").alias("at")).join(found, ["f1", "f2"]).select("d", "h", (F.col("at") + F.col("lo")).alias("lo"), (F.col("at") + F.col("hi")).alias("hi"))
    spans = _merged(hits.groupBy("d", "h").agg(F.collect_set(F.struct("lo", "hi")).alias("ranges")), length)  # of one document
    spans = stage(spans.withColumnsRenamed({"d": d_col, "h": h_col}), "repeats-spans")
    drop_staged(cut, groups, *used)
    none = F.array().cast("array<struct<start:bigint,end:bigint>>")
    return keyed.join(spans, [d_col, h_col], "left").select(*docs.columns, F.coalesce("spans", none).alias("spans"))


def _merged(found: DataFrame, length: int) -> DataFrame:
    """(d, h, spans): window starts lo..hi cover the bytes lo..hi + length - 1; ranges that meet are one."""
    kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))

    def run(batches):
        for batch in batches:
            out = []
            for ranges in batch.column(2):
                lo, hi = (ranges.values.field(f).to_numpy().astype(np.int64) for f in ("lo", "hi"))
                order = np.argsort(lo, kind="stable")
                lo, end = lo[order], np.maximum.accumulate(hi[order] + length - 1)
                new = np.concatenate([[True], lo[1:] > end[:-1]])
                last = np.concatenate([np.flatnonzero(new)[1:] - 1, [len(end) - 1]])
                out.append([{"start": a, "end": b} for a, b in zip(lo[new].tolist(), end[last].tolist(), strict=True)])
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, kind)], names=["d", "h", "spans"])

    return found.mapInArrow(run, "d long, h long, spans array<struct<start:bigint,end:bigint>>")


def without_spans(text: bytes, spans: list[dict]) -> bytes:
    out, at = [], 0
    for s in spans:
        out.append(text[at : s["start"]])
        at = s["end"]
    return b"".join([*out, text[at:]])


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH) -> DataFrame:
    """The rows with ``kept``, the bytes of the text that no span covers, and ``spans``. Cutting can split a character, so ``kept`` is binary. A column named kept is refused (ValueError)."""
    if "kept" in (c.lower() for c in docs.columns):
        raise ValueError("a column is named kept")
    found = find_repeats(docs, id_col, text_col, length)
    at = found.columns.index(text_col)

    def run(batches):
        for batch in batches:
            for k in range(0, batch.num_rows, 200):
                part = batch.slice(k, 200)
                texts = part.column(at).cast(pa.binary()).to_pylist()
                kept = [without_spans(t or b"", s) for t, s in zip(texts, part.column(part.num_columns - 1).to_pylist(), strict=True)]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(kept, pa.binary())], names=[*part.schema.names, "kept"])

    return found.mapInArrow(run, T.StructType([*found.schema.fields, T.StructField("kept", T.BinaryType())]))


def op10_difference_cover(spark, sf_dir: str) -> DataFrame:
    out = remove_repeats(read(spark, sf_dir, "documents").select("doc_id", "text"))
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    return out.select("doc_id", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"), removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


OP10_SQL = r"""
WITH d AS (
  SELECT doc_id, encode(coalesce(text, '')) AS b FROM documents
), p AS MATERIALIZED (
  SELECT doc_id, k, sha256(b[k:k + 199]) AS h FROM (SELECT doc_id, b, octet_length(b) AS n FROM d), unnest(range(1, n - 198)) AS u(k)
), q AS (
  SELECT doc_id, k FROM p WHERE h IN (SELECT h FROM p GROUP BY h HAVING count(*) > 1)
), o AS (
  SELECT doc_id, k, CASE WHEN k - lag(k) OVER (PARTITION BY doc_id ORDER BY k) <= 200 THEN 0 ELSE 1 END AS new FROM q
), g AS (
  SELECT doc_id, k, sum(new) OVER (PARTITION BY doc_id ORDER BY k) AS run FROM o
), r AS (
  SELECT doc_id, run, min(k) AS lo, max(k) + 199 AS hi FROM g GROUP BY doc_id, run
), z AS (
  SELECT doc_id, lo, hi, coalesce(lag(hi) OVER (PARTITION BY doc_id ORDER BY lo), 0) AS last FROM r
), y AS (
  SELECT doc_id, count(*) AS n_spans, sum(hi - lo + 1) AS n_removed, max(hi) AS hi, string_agg(hex(b[last + 1:lo - 1]), '' ORDER BY lo) AS kept FROM z JOIN d USING (doc_id) GROUP BY doc_id
)
SELECT doc_id, octet_length(b) AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, coalesce(n_spans, 0) AS n_spans,
  CASE WHEN n_spans IS NULL THEN sha256(b) ELSE sha256(unhex(kept || hex(b[y.hi + 1:]))) END AS kept_sha256 FROM d LEFT JOIN y USING (doc_id)
"""
