"""Benchmark decontamination by an FM-index for each training shard.

Words of the benchmark get numbers; a document word outside that vocabulary can be in no occurrence, so it only separates. A
shard (a run of documents on one task) is the text of its remaining runs of words, at least as long as the shortest phrase. Its
suffix array gives the Burrows-Wheeler transform, held as a wavelet matrix; every phrase, a window of consecutive item words, is
searched backwards through wavelet ranks, all phrases of one length at a time. Occurrences are located by walking back to the
nearest sampled suffix position, and merged into spans of words.
"""

from __future__ import annotations

import functools

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import free_name, read, stage

WINDOW = 10
SHARD_WORDS = 1 << 20
SHARD_BYTES = 64 << 20
SAMPLING = 8
BENCHMARK_BYTES = 8 << 20  # of benchmark text whose phrases are sent to the executors at once; a larger benchmark is taken in as many blocks as needed
PHRASES = 1 << 17  # that are searched together
#: ASCII letters and digits and every byte of a longer UTF-8 character are parts of words, A-Z as a-z; the rest separates.
WORD_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))


def words_of(text: bytes) -> list[bytes]:
    return text.translate(WORD_BYTES).split()


def suffix_array(text: np.ndarray) -> np.ndarray:
    """Suffix array by prefix doubling; only suffixes that still tie are sorted again. The text ends in a unique smallest symbol."""
    n = len(text)
    width = max(1, int(text.max(initial=0)).bit_length())
    depth = max(1, min(62 // width, n))
    key = np.zeros(n, np.int64)
    for d in range(depth):
        key = (key << width) | np.concatenate([text[d:], np.zeros(min(d, n), text.dtype)]).astype(np.int64)
    sa = np.argsort(key, kind="stable")
    key = key[sa]
    new = np.concatenate([[True], key[1:] != key[:-1]])
    rank = np.empty(n, np.int64)
    rank[sa] = np.flatnonzero(new)[np.cumsum(new) - 1]
    tied = np.flatnonzero(~(new & np.concatenate([new[1:], [True]])))  # places in sa whose group has more than one
    while len(tied):
        at = sa[tied]
        after = at + depth
        second = np.where(after < n, rank[np.minimum(after, n - 1)] + 1, 0)
        order = np.lexsort((second, rank[at]))
        at, first, second = at[order], rank[at][order], second[order]
        sa[tied] = at
        new = np.concatenate([[True], (first[1:] != first[:-1]) | (second[1:] != second[:-1])])
        rank[at] = tied[np.flatnonzero(new)[np.cumsum(new) - 1]]
        tied = tied[~(new & np.concatenate([new[1:], [True]]))]
        depth *= 2
    return sa


class WaveletMatrix:
    """Rank and access over a sequence of symbols below ``sigma``; a level for each bit, with prefix counts of ones."""

    def __init__(self, seq: np.ndarray, sigma: int):
        self.bits = max(1, (sigma - 1).bit_length())
        self.ones, self.zeros = [], []
        for level in range(self.bits - 1, -1, -1):
            bit = ((seq >> level) & 1).astype(np.int32)
            ones = np.concatenate([np.zeros(1, np.int32), np.cumsum(bit, dtype=np.int32)])
            self.ones.append(ones)
            self.zeros.append(len(seq) - int(ones[-1]))
            seq = np.concatenate([seq[bit == 0], seq[bit == 1]])
        self.begin = np.zeros(sigma, np.int64)
        self.begin = self._down(np.arange(sigma), self.begin)

    def _down(self, c: np.ndarray, i: np.ndarray) -> np.ndarray:
        for k, (ones, zeros) in enumerate(zip(self.ones, self.zeros, strict=True)):
            one = ones[i]
            i = np.where((c >> (self.bits - 1 - k)) & 1, zeros + one, i - one)
        return i

    def rank(self, c: np.ndarray, i: np.ndarray) -> np.ndarray:
        """Occurrences of c among the first i symbols."""
        return self._down(c, i) - self.begin[c]

    def access(self, i: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Symbols at i and their ranks there."""
        c = np.zeros(len(i), np.int64)
        for ones, zeros in zip(self.ones, self.zeros, strict=True):
            one = ones[i]
            bit = ones[i + 1] - one
            c = (c << 1) | bit
            i = np.where(bit, zeros + one, i - one)
        return c, i - self.begin[c]


class FMIndex:
    """Backward search and locate over ``text``; symbols are 1..sigma-1, and 0 ends the text."""

    def __init__(self, text: np.ndarray, sigma: int, sampling: int = SAMPLING):
        text = np.concatenate([text, [0]]).astype(np.int64)
        sa = suffix_array(text)
        self.n = len(text)
        self.wavelet = WaveletMatrix(text[sa - 1], sigma)
        self.before = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=sigma))])[:-1]
        sampled = sa % sampling == 0
        self.marked = sampled
        self.marks = np.concatenate([[0], np.cumsum(sampled)])
        self.samples = sa[sampled]

    def search(self, phrases: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each row of ``phrases``, its range in the suffix array (empty: begin = end)."""
        begin, end = np.zeros(len(phrases), np.int64), np.full(len(phrases), self.n)
        live = np.arange(len(phrases))
        for j in range(phrases.shape[1] - 1, -1, -1):
            c = phrases[live, j]
            begin[live] = self.before[c] + self.wavelet.rank(c, begin[live])
            end[live] = self.before[c] + self.wavelet.rank(c, end[live])
            live = live[begin[live] < end[live]]
        end = np.maximum(begin, end)
        return begin, end

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Text positions of suffix-array rows."""
        rows, steps, out = rows.copy(), 0, np.empty(len(rows), np.int64)
        todo = np.arange(len(rows))
        while len(todo):
            here = self.marked[rows[todo]]
            done = todo[here]
            out[done] = self.samples[self.marks[rows[done]]] + steps
            todo = todo[~here]
            if len(todo):
                c, r = self.wavelet.access(rows[todo])
                rows[todo] = self.before[c] + r
                steps += 1
        return out


class Phrases:
    """The windows of the items' words as arrays, made once for a block of the benchmark and sent to the executors.

    ``number``: a number for each word; ``ids``: the numbered words of all items, one after the other; ``by_length``: for each window length the places in ``ids``
    of the different windows, and which items have them: those of window i are owners[starts[i]:starts[i + 1]], numbers in ``names``.
    """

    def __init__(self, items: list[tuple[str, bytes]], window: int):
        self.number: dict[bytes, int] = {}
        self.names = sorted({name for name, _ in items})
        place = {name: i for i, name in enumerate(self.names)}
        parts, first, owner, size = [], [], [], []
        at = 0
        for name, text in items:
            words = words_of(text)
            if not words:
                continue
            parts.append(np.fromiter((self.number.setdefault(w, len(self.number) + 2) for w in words), np.int32, len(words)))  # 0 ends a text, 1 separates
            n = max(1, len(words) - window + 1)
            first.append(np.arange(at, at + n, dtype=np.int32))
            owner.append(np.full(n, place[name], np.int32))
            size.append(np.full(n, min(window, len(words)), np.int32))
            at += len(words)
        none = np.zeros(0, np.int32)
        self.ids, first, owner, size = (np.concatenate(x) if x else none for x in (parts, first, owner, size))
        self.sigma = len(self.number) + 2
        self.by_length: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}
        for length in np.unique(size).tolist():
            start, own = first[size == length], owner[size == length]
            rows = np.ascontiguousarray(self.ids[start[:, None] + np.arange(length, dtype=np.int32)])
            _, one, which = np.unique(rows.view(np.dtype((np.void, 4 * length))).ravel(), return_index=True, return_inverse=True)
            del rows
            pairs = np.unique((which.astype(np.int64) << 32) | own)
            begin = np.searchsorted(pairs >> 32, np.arange(len(one) + 1))
            self.by_length[length] = (start[one], begin, (pairs & 0xFFFFFFFF).astype(np.int32))
        self.shortest = min(self.by_length, default=0)


def merged(begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The union of ranges, as disjoint ranges that do not touch."""
    order = np.lexsort((end, begin))
    begin, end = begin[order], np.maximum.accumulate(end[order])
    new = np.concatenate([[True], begin[1:] > end[:-1]])
    return begin[new], end[np.concatenate([np.flatnonzero(new)[1:] - 1, [len(end) - 1]])]


class Shard:
    """Gathers documents; ``finish`` gives for each its number of words, its spans and its items."""

    def __init__(self, phrases: Phrases):
        self.p = phrases
        self.counts: list[np.ndarray] = []
        self.runs: list[np.ndarray] = []
        self.where: list[tuple[np.ndarray, np.ndarray]] = []
        self.docs = self.size = 0

    def add(self, texts: list[bytes]) -> None:
        get = self.p.number.get
        split = [words_of(t) for t in texts]
        counts = np.array([len(s) for s in split], np.int64)
        total = int(counts.sum())
        ids = np.ones(total + len(split), np.int64)  # a separator after each document
        starts = np.cumsum(counts + 1) - counts - 1
        for s, at in zip(split, starts.tolist(), strict=True):
            if s:
                ids[at : at + len(s)] = np.fromiter((get(w, 1) for w in s), np.int64, len(s))
        known = np.concatenate([[0], (ids > 1).astype(np.int8), [0]])
        edge = np.flatnonzero(np.diff(known))
        begin, end = edge[::2], edge[1::2]
        long = end - begin >= max(1, self.p.shortest)
        begin, end = begin[long], end[long]
        size = end - begin + 1  # with the separator behind it
        at = np.repeat(begin - np.cumsum(size) + size, size) + np.arange(int(size.sum()))
        doc = np.searchsorted(starts, at, side="right") - 1
        run = ids[at]
        run[np.cumsum(size) - 1] = 1
        self.runs.append(run)
        self.where.append((doc + self.docs, at - starts[doc]))
        self.counts.append(counts)
        self.docs += len(texts)
        self.size += len(run)

    def finish(self) -> tuple[np.ndarray, list[list[tuple[int, int]]], list[list[str]]]:
        counts = np.concatenate(self.counts) if self.counts else np.zeros(0, np.int64)
        spans: list[list[tuple[int, int]]] = [[] for _ in range(self.docs)]
        items: list[list[str]] = [[] for _ in range(self.docs)]
        text = np.concatenate(self.runs) if self.runs else np.zeros(0, np.int64)
        if not len(text) or not self.p.by_length:
            return counts, spans, items
        doc, word = (np.concatenate(x) for x in zip(*self.where, strict=True))
        index = FMIndex(text, self.p.sigma)
        begins, ends, owned = [], [], [set() for _ in range(self.docs)]
        for length, (places, starts, owners) in self.p.by_length.items():
            for k in range(0, len(places), PHRASES):
                some = places[k : k + PHRASES]
                lo, hi = index.search(self.p.ids[some[:, None] + np.arange(length, dtype=np.int32)].astype(np.int64))
                found = np.flatnonzero(hi > lo)
                n = hi[found] - lo[found]
                rows = np.repeat(lo[found] - np.cumsum(n) + n, n) + np.arange(int(n.sum()))
                if not len(rows):
                    continue
                at = index.locate(rows)
                begins.append(at)
                ends.append(at + length)
                pairs = np.unique(np.stack([doc[at], np.repeat(found + k, n)]), axis=1)
                for d, w in pairs.T.tolist():
                    owned[d].update(owners[starts[w] : starts[w + 1]].tolist())
        if not begins:
            return counts, spans, items
        for a, b in zip(*merged(np.concatenate(begins), np.concatenate(ends)), strict=True):
            spans[doc[a]].append((int(word[a]), int(word[a] + b - a)))
        for d, s in enumerate(spans):
            spans[d] = sorted(s)
            items[d] = [self.p.names[i] for i in sorted(owned[d])]
        return counts, spans, items


ADDED = [
    T.StructField("n_words", T.LongType()),
    T.StructField("spans", T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))),
    T.StructField("items", T.ArrayType(T.StringType())),
]


def _find(docs: DataFrame, text_col: str, items: list[tuple[str, bytes]], window: int) -> DataFrame:
    """Adds n_words, spans and items of one block of the benchmark."""
    shared = docs.sparkSession.sparkContext.broadcast(Phrases(items, window))
    at = docs.columns.index(text_col)
    kinds = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))

    def run(batches):
        phrases = shared.value
        shard, held, size = Shard(phrases), [], 0

        def flush():
            counts, spans, names = shard.finish()
            done = 0
            for batch in held:
                n = batch.num_rows
                dicts = [[{"start": a, "end": b} for a, b in s] for s in spans[done : done + n]]
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(counts[done : done + n]), pa.array(dicts, kinds), pa.array(names[done : done + n], pa.list_(pa.string()))], names=[*batch.schema.names, "n_words", "spans", "items"])
                done += n

        for batch in batches:
            for k in range(0, batch.num_rows, 500):
                part = batch.slice(k, 500)
                texts = [t or b"" for t in part.column(at).cast(pa.binary()).to_pylist()]
                shard.add(texts)
                held.append(part)
                size += sum(map(len, texts))
                if shard.size >= SHARD_WORDS or size >= SHARD_BYTES:
                    yield from flush()
                    shard, held, size = Shard(phrases), [], 0
        if held:
            yield from flush()

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, *ADDED]))


def find_benchmark(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", window: int = WINDOW, block_bytes: int = BENCHMARK_BYTES) -> DataFrame:
    """Adds ``n_words``, ``spans`` (disjoint ranges of word numbers inside occurrences, in order) and ``items`` (sorted ids) to every row.

    A null or empty text has no words. An item with fewer words than the window is one phrase; one without words, or a null id or text, is none. Repeated
    items and documents are treated each for itself. Spans that touch are one. An empty benchmark finds nothing. Columns of ``docs`` named n_words, spans
    or items are refused (ValueError). The benchmark is sent to the executors in blocks of about ``block_bytes`` of text. With more than one block the rows are
    numbered and written once; what a block finds is kept by row number, and merged.
    """
    clash = {"n_words", "spans", "items"} & {c.lower() for c in docs.columns}
    if clash:
        raise ValueError(f"columns {sorted(clash)} are in use")
    items = benchmark.where(F.col(item_col).isNotNull() & F.col(item_text_col).isNotNull()).select(F.col(item_col).cast("string").alias("item"), F.col(item_text_col).alias("words"))
    total = items.agg(F.sum(F.octet_length("words"))).first()[0] or 0
    blocks = max(1, -(-total // block_bytes))
    take = lambda b: [(r["item"], r["words"].encode()) for r in items.where(F.pmod(F.xxhash64("item", "words"), F.lit(blocks)) == b).toLocalIterator()]
    if blocks == 1:
        return _find(docs, text_col, take(0), window)
    row = free_name(docs.columns, "_row")
    numbered = stage(docs.withColumn(row, F.monotonically_increasing_id()), "decontaminate")
    texts = numbered.select(F.col(row).alias("row"), F.col(text_col).alias("text"))
    found = [stage(_find(texts, "text", take(b), window).drop("text").where((F.size("spans") > 0) if b else F.lit(True)), "decontaminate-found") for b in range(blocks)]
    # the first block has a row for every document; of one document the others have a row for each block at most
    each = functools.reduce(DataFrame.unionAll, found).groupBy(F.col("row").alias(row)).agg(F.max("n_words").alias("n_words"), _merged_spans(F.array_sort(F.flatten(F.collect_list("spans")))).alias("spans"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"))
    return numbered.join(each, row).select(*docs.columns, "n_words", "spans", "items")


def _merged_spans(spans):
    """The union of sorted ranges, in SQL."""
    kind = "array<struct<start:bigint,end:bigint>>"

    def add(done, s):
        last = F.element_at(done, -1)
        joined = F.concat(F.slice(done, 1, F.size(done) - 1), F.array(F.struct(last["start"].alias("start"), F.greatest(last["end"], s["end"]).alias("end"))))
        return F.when(F.size(done) == 0, F.array(s)).when(last["end"] >= s["start"], joined).otherwise(F.concat(done, F.array(s)))

    return F.aggregate(spans, F.array().cast(kind), lambda done, s: add(done, s).cast(kind))


def decontaminate(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", **options) -> DataFrame:
    """The documents in which no phrase of the benchmark occurs, with their columns."""
    return find_benchmark(docs, benchmark, text_col, **options).where(F.size("spans") == 0).select(*docs.columns)


def op7_fm_index(spark, sf_dir: str) -> DataFrame:
    found = find_benchmark(read(spark, sf_dir, "documents").select("doc_id", "text"), read(spark, sf_dir, "benchmark"))
    hit = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    return found.select("doc_id", "n_words", hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.size("spans") > 0).alias("contaminated"))


OP7_SQL = r"""
WITH w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), i AS (
  SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark
), p AS (
  SELECT DISTINCT item, least(len(w), 10) AS size, array_to_string(w[k:k + 9], ' ') AS phrase FROM i, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS u(k) WHERE len(w) > 0
), s AS (
  SELECT doc_id, size, k, array_to_string(w[k:k + size - 1], ' ') AS phrase FROM w, (SELECT DISTINCT size FROM p) AS z, unnest(range(1, len(w) - size + 2)) AS u(k)
), h AS (
  SELECT doc_id, k, s.size, item FROM s JOIN p ON s.phrase = p.phrase AND s.size = p.size
), c AS (
  SELECT doc_id, count(DISTINCT x) AS n_hit FROM (SELECT DISTINCT doc_id, k, size FROM h), unnest(range(k, k + size)) AS u(x) GROUP BY doc_id
), n AS (
  SELECT doc_id, count(DISTINCT item) AS n_items, array_to_string(list_sort(list(DISTINCT item)), ',') AS items FROM h GROUP BY doc_id
)
SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256, n_hit IS NOT NULL AS contaminated
FROM w LEFT JOIN c USING (doc_id) LEFT JOIN n USING (doc_id)
"""
