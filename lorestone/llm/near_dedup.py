"""Near-duplicate documents by a multi-index Hamming join of b-bit MinHash signatures.

A signature has CHUNKS * WIDTH minima of b bits. Two signatures that differ in at most CHUNKS * (ERRORS + 1) - 1 minima differ in at most
ERRORS of some chunk (pigeonhole), so enumerating every way to leave ERRORS minima out of each chunk gives both a common key: no pair under that
distance is missed. A pair with a similarity of 0.8 exceeds it with a chance of 5.2e-5. Documents with equal shingle sets are one node from
the start. Only components are asked for, so a bucket of one key gives a spanning forest of its pairs within the distance, not all of them; the forests
join nodes into coarse groups that hold every link. Inside a group links are confirmed on the full sets, again as a spanning forest.

Large buckets and groups are dealt to blocks of bounded size, so that no task needs one whole. Every block compares its members with each other and with
a few representatives of the group, which joins near copies of one text in linear work. A second round takes what is still apart: the members outside
their group's largest component meet all its blocks, and only pairs of different components are compared. So every pair is compared or joined
already, and the work beyond the blocks is members outside the largest component times members.
"""

from __future__ import annotations

import functools
import itertools

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop_staged, free_name, read, stage

WORDS, PERCENT = 5, 80
CHUNKS, WIDTH, ERRORS = 15, 5, 1
SIZE = CHUNKS * WIDTH
MOST = CHUNKS * (ERRORS + 1) - 1  # minima that may differ
BLOCK = 2048  # rows of a block at most
BLOCK_SHINGLES = 2_000_000  # and shingles, unless one document has more
REPRESENTATIVES = 32  # of a group of several blocks, by a hash
CHUNK_ROWS = 20_000
KEPT_WORDS = 200_000
BROADCAST_IDS = 1_000_000  # ids of 8 bytes that are sent to the executors at most; more are joined
SLICE = 4096
U = np.uint64
LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


class Shingles:
    """Sorted distinct 64-bit fingerprints of a text's word shingles. Words are what ASCII white space separates, A-Z lowered."""

    def __init__(self, words: int):
        import xxhash

        self.n, self.fingerprint = words, xxhash.xxh64_intdigest
        self.kept: dict[bytes, int] = {}

    def __call__(self, text: bytes) -> np.ndarray:
        words = text.translate(LOWER).split()
        if not words:
            return np.zeros(0, U)
        if len(self.kept) > KEPT_WORDS:
            self.kept.clear()
        kept = self.kept
        for w in set(words).difference(kept):
            kept[w] = self.fingerprint(w)
        h = np.fromiter(map(kept.__getitem__, words), U, len(words))
        size = min(self.n, len(h))
        out = h[: len(h) - size + 1].copy()
        for k in range(1, size):
            out = _mixed(out) * U(0x9E3779B97F4A7C15) + h[k : len(h) - size + 1 + k]
        return np.unique(_mixed(out + U(len(h) if len(h) < self.n else 0)))


@functools.lru_cache(maxsize=4)
def shingles_for(words: int) -> Shingles:
    """One for each worker process, so that its words outlive a task."""
    return Shingles(words)


def _permutations() -> tuple[np.ndarray, np.ndarray]:
    at = np.arange(1, SIZE + 1, dtype=U)
    return _mixed(at * U(0x9E3779B97F4A7C15)) | U(1), _mixed(at * U(0xD1B54A32D192ED03))


def signature(shingles: np.ndarray) -> bytes:
    """The lowest byte of each of SIZE mixed minima."""
    a, b = _permutations()
    least = np.full(SIZE, ~U(0))
    for k in range(0, len(shingles), SLICE):
        least = np.minimum(least, (shingles[k : k + SLICE, None] * a + b).min(axis=0))
    return _mixed(least).astype(np.uint8).tobytes()


def _signatures(docs: DataFrame, words: int) -> DataFrame:
    def run(batches):
        shingles = shingles_for(words)
        for batch in batches:
            n, f1, f2, sigs = [], [], [], []
            for text in batch.column(1):
                s = shingles(text.as_py() or b"")
                n.append(len(s))
                f1.append(int(s.sum(dtype=U)) if len(s) else 0)
                f2.append(int(np.bitwise_xor.reduce(_mixed(s + U(77)))) if len(s) else 0)
                sigs.append(signature(s) if len(s) else b"")
            ids = batch.column(0)
            yield pa.RecordBatch.from_arrays([ids, pa.array(n, pa.int64()), pa.array(np.array(f1, U).view(np.int64)), pa.array(np.array(f2, U).view(np.int64)), pa.array(sigs, pa.binary())], names=["doc_id", "n", "f1", "f2", "sig"])

    return docs.mapInArrow(run, "doc_id long, n long, f1 long, f2 long, sig binary")


def chunk_keys(sigs: np.ndarray) -> np.ndarray:
    """(node, key): a key for each chunk and each way to leave ERRORS of its minima out."""
    out = []
    for c in range(CHUNKS):
        chunk = sigs[:, c * WIDTH : (c + 1) * WIDTH].astype(U)
        for k, left in enumerate(itertools.combinations(range(WIDTH), ERRORS)):
            key = np.full(len(sigs), c * 1000 + k, U)
            for j in range(WIDTH):
                if j not in left:
                    key = (key << U(8)) | chunk[:, j]
            out.append(_mixed(key))
    return np.stack(out, axis=1)


def _keys(nodes: DataFrame) -> DataFrame:
    def run(batches):
        for batch in batches:
            for k in range(0, batch.num_rows, 2000):
                part = batch.slice(k, 2000)
                keys = chunk_keys(np.frombuffer(b"".join(part.column(1).to_pylist()), np.uint8).reshape(-1, SIZE))
                ids = np.repeat(part.column(0).to_numpy(), keys.shape[1])
                yield pa.RecordBatch.from_arrays([pa.array(keys.ravel().view(np.int64)), pa.array(ids)], names=["key", "id"])

    return nodes.select("id", "sig").mapInArrow(run, "key long, id long")


class Parts:
    """The rows of a block in parts: at first those of one label, then of linked ones."""

    def __init__(self, labels: np.ndarray):
        self.labels = labels
        self.part = np.unique(labels, return_inverse=True)[1]
        self.joined = False

    def join(self, i: int, others: np.ndarray) -> None:
        for j in others.tolist():
            if self.part[j] != self.part[i]:
                self.part[self.part == self.part[j]] = self.part[i]
                self.joined = True

    def stars(self) -> tuple[np.ndarray, np.ndarray]:
        """(a, b): in each part every label and the smallest one, where they differ. Stars come to their components in few passes."""
        if not self.joined:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        least = np.full(len(self.part), np.iinfo(np.int64).max)
        np.minimum.at(least, self.part, self.labels)
        pairs = np.unique(np.stack([self.labels, least[self.part]]), axis=1)
        return tuple(pairs[:, pairs[0] != pairs[1]])

    def names(self, guest: np.ndarray) -> np.ndarray:
        """A name for every row's part that holds in other blocks too: the smallest representative in it; without one its smallest row."""
        least, known = (np.full(len(self.part), np.iinfo(np.int64).max) for _ in range(2))
        np.minimum.at(least, self.part, self.labels)
        np.minimum.at(known, self.part[guest], self.labels[guest])
        have = np.zeros(len(least), bool)
        have[self.part[guest]] = True
        return np.where(have, known, least)[self.part]


def _dealt(rows: DataFrame, group: str, large: DataFrame) -> DataFrame:
    """(group, block, blocks, guest, label, id) of the first round: each row in its block, and the representatives of groups of several blocks in all blocks. ``large``: group, size, blocks of those."""
    few = large.count() <= BROADCAST_IDS
    held = rows.select(group, "id").join(F.broadcast(large) if few else large, group, "left")
    held = held.withColumns({"blocks": F.coalesce("blocks", F.lit(1)), "label": F.col("id")})
    place = F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int")
    chosen = F.coalesce(F.pmod(F.xxhash64("id", F.lit(1)), F.col("size")) < REPRESENTATIVES, F.lit(False))
    # a representative is a member of all blocks but its own, where it stands as one already
    where = F.when(chosen, F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda b: F.struct(b.alias("block"), F.lit(True).alias("guest")))).otherwise(F.array(F.struct(place.alias("block"), F.lit(False).alias("guest"))))
    return held.withColumn("at", F.explode(where)).select(group, F.col("at.block").alias("block"), "blocks", F.col("at.guest").alias("guest"), "label", "id")


def _still_apart(named: DataFrame, group: str) -> DataFrame:
    """The rows of the second round: groups whose parts have several names, where the rows outside the largest part are guests of all blocks. ``named``: group, block, blocks, id, label."""
    sizes = named.groupBy(group, "label").agg(F.count(F.lit(1)).alias("size"))
    main = sizes.groupBy(group).agg(F.max_by("label", F.struct("size", -F.col("label"))).alias("main"), F.count(F.lit(1)).alias("parts")).where("parts > 1").drop("parts")
    main = stage(main, "near-main")  # of groups of several blocks alone
    open_ = named.join(F.broadcast(main) if main.count() <= BROADCAST_IDS else main, group)
    every = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda b: F.struct(b.alias("block"), (b != F.col("block")).alias("guest")))
    where = F.when(F.col("label") != F.col("main"), every).otherwise(F.array(F.struct(F.col("block"), F.lit(False).alias("guest"))))
    return open_.withColumn("at", F.explode(where)).select(group, F.col("at.block").alias("block"), "blocks", F.col("at.guest").alias("guest"), "label", "id")


FOUND = "a long, b long, {0} long, block int, blocks int"


def _two_rounds(dealt: DataFrame, group: str, compare) -> DataFrame:
    """The edges (a, b) that ``compare`` (rows, whether members of a block are compared with each other) finds in both rounds.

    Of groups of several blocks it also gives each member's part: there ``a`` is the id, ``b`` the name of the part, and ``blocks`` more than 0.
    """
    first = stage(compare(dealt, True), "near-links")
    edges = first.where("blocks = 0").select("a", "b")
    named = first.where("blocks > 0").select(group, "block", "blocks", F.col("a").alias("id"), F.col("b").alias("label"))
    if named.isEmpty():  # no group of several blocks
        return _once(edges, first)
    apart = stage(_still_apart(named, group), "near-apart")
    second = stage(compare(apart, False), "near-links")
    return _once(edges.unionAll(second.where("blocks = 0").select("a", "b")), first, apart, second)


def _once(edges: DataFrame, *used: DataFrame) -> DataFrame:
    out = stage(edges.distinct(), "near-edges")
    drop_staged(*used)
    return out


def _chunks(batches, keys: int, rows: int, size_col: int | None = None, most: int = 0):
    """Record batches sorted by their first ``keys`` columns, as tables that end between groups and have about ``rows`` rows or ``most`` in a column's sum."""
    held, n, total = [], 0, 0
    for batch in batches:
        cut = 0
        if n >= rows or (most and total >= most):
            ends = np.zeros(batch.num_rows, bool)
            last = held[-1]
            for k in range(keys):
                col = batch.column(k).to_numpy()
                ends |= col != np.concatenate([last.column(k).to_numpy()[-1:], col[:-1]])
            first = np.flatnonzero(ends)
            if len(first):
                cut = int(first[0])
                if cut:
                    held.append(batch.slice(0, cut))
                yield pa.Table.from_batches(held)
                held, n, total = [], 0, 0
        held.append(batch.slice(cut))
        n += batch.num_rows - cut
        if most:
            total += int(batch.column(size_col).slice(cut).to_numpy().sum())
    if n:
        yield pa.Table.from_batches(held)


def _groups(table: pa.Table, keys: int) -> tuple[np.ndarray, np.ndarray]:
    new = np.zeros(table.num_rows, bool)
    new[:1] = True
    for k in range(keys):
        col = table.column(k).to_numpy()
        new[1:] |= col[1:] != col[:-1]
    begin = np.flatnonzero(new)
    return begin, np.concatenate([begin[1:], [table.num_rows]])


def _allowed(na, nb, percent: int):
    return 100 * np.minimum(na, nb) >= percent * np.maximum(na, nb)


class Found:
    """Collects edges, and of blocks of large groups the names of their members' parts, as a batch of FOUND."""

    def __init__(self, group: str):
        self.group = group
        self.columns: tuple[list, ...] = ([], [], [], [], [])

    def add(self, parts: Parts, ids: np.ndarray, guest: np.ndarray, group: int, block: int, blocks: int, within: bool) -> None:
        a, b = parts.stars()
        none = np.zeros(len(a), np.int64)
        rows = [(a, b, none + group, none + block, none)]
        if within and blocks > 1:
            # a representative is named once, in the block that its id deals it to: named by that block's parts
            own = ~guest | (_home(ids, blocks) == block)
            names = parts.names(guest)[own]
            rows.append((ids[own], names, np.full(len(names), group), np.full(len(names), block), np.full(len(names), blocks)))
        for r in rows:
            for column, values in zip(self.columns, r, strict=True):
                column.append(values)

    def batch(self) -> pa.RecordBatch:
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32())
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate([np.zeros(0, np.int64), *c]), k) for c, k in zip(self.columns, kinds, strict=True)], names=["a", "b", self.group, "block", "blocks"])


def _home(ids: np.ndarray, blocks: int) -> np.ndarray:
    """A block for each representative, in which it is named."""
    return (_mixed(ids.view(U)) % U(blocks)).astype(np.int64)


def _coarse(members: DataFrame, nodes: DataFrame, percent: int) -> DataFrame:
    """(a, b): spanning forests of the pairs within the distance in each bucket."""
    large = members.groupBy("key").agg(F.count(F.lit(1)).alias("size")).where(F.col("size") > BLOCK).withColumn("blocks", F.ceil(F.col("size") / BLOCK).cast("int"))

    def compare(rows: DataFrame, within: bool) -> DataFrame:
        rows = rows.join(nodes.select("id", "n", "sig"), "id").select("key", "block", "blocks", "guest", "label", "id", "n", "sig")
        rows = rows.repartition("key", "block").sortWithinPartitions("key", "block", "n")

        def run(batches):
            for table in _chunks(batches, 2, CHUNK_ROWS):
                key, block, blocks, guest, label, ids, n = (table.column(k).to_numpy() for k in range(7))
                sig = np.frombuffer(b"".join(table.column(7).to_pylist()), np.uint8).reshape(-1, SIZE)
                begin, end = _groups(table, 2)
                found = Found("key")
                # most buckets are pairs
                two = begin[(end - begin == 2) & (blocks[begin] == 1)]
                ok = two[((sig[two] != sig[two + 1]).sum(axis=1) <= MOST) & _allowed(n[two], n[two + 1], percent) & (label[two] != label[two + 1])]
                none = np.zeros(len(ok), np.int64)
                for column, values in zip(found.columns, (label[ok], label[ok + 1], key[ok], none, none), strict=True):
                    column.append(values)
                more = (end - begin > 2) | (blocks[begin] > 1)
                for lo, hi in zip(begin[more].tolist(), end[more].tolist(), strict=True):
                    parts = Parts(label[lo:hi])
                    s, m, g = sig[lo:hi], n[lo:hi], guest[lo:hi]
                    for i in range(hi - lo - 1):
                        j = i + 1 + np.flatnonzero((parts.part[i + 1 :] != parts.part[i]) & _allowed(m[i + 1 :], m[i], percent) & (within | (g[i + 1 :] != g[i])))
                        if len(j):
                            parts.join(i, j[(s[j] != s[i]).sum(axis=1) <= MOST])
                    found.add(parts, ids[lo:hi], g, int(key[lo]), int(block[lo]), int(blocks[lo]), within)
                yield found.batch()

        return rows.mapInArrow(run, FOUND.format("key"))

    return _two_rounds(_dealt(members, "key", large), "key", compare)


def _full_sets(docs: DataFrame, ids: DataFrame, words: int) -> DataFrame:
    """(id, shingles) of the documents with these ids."""
    few = ids.count() <= BROADCAST_IDS
    needed = docs.join(F.broadcast(ids) if few else ids, F.col("doc_id") == F.col("id"), "left_semi")

    def run(batches):
        shingles = shingles_for(words)
        for batch in batches:
            for k in range(0, batch.num_rows, 500):
                part = batch.slice(k, 500)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([shingles(t.as_py() or b"").tobytes() for t in part.column(1)], pa.binary())], names=["id", "shingles"])

    return needed.select("doc_id", "text").mapInArrow(run, "id long, shingles binary")


def _linked(guest: np.ndarray, labels: np.ndarray, sets: list[np.ndarray], sig: np.ndarray, within: bool, percent: int) -> Parts:
    """The parts that confirmed links make of one block's labels; with ``within`` also those between members, else only those of members and guests."""
    n = np.array([len(s) for s in sets])
    parts = Parts(labels)
    _, flat = np.unique(np.concatenate(sets), return_inverse=True)
    starts = np.cumsum(n) - n
    mark = np.zeros(int(flat.max(initial=-1)) + 1, bool)
    for i in range(len(n) - 1):
        j = i + 1 + np.flatnonzero((parts.part[i + 1 :] != parts.part[i]) & _allowed(n[i + 1 :], n[i], percent) & (within | (guest[i + 1 :] != guest[i])))
        j = j[(sig[j] != sig[i]).sum(axis=1) <= MOST]
        if not len(j):
            continue
        mine = flat[starts[i] : starts[i] + n[i]]
        mark[mine] = True
        size = n[j]
        at = np.repeat(starts[j] - np.cumsum(size) + size, size) + np.arange(int(size.sum()))
        common = np.add.reduceat(mark[flat[at]].astype(np.int64), np.cumsum(size) - size)
        mark[mine] = False
        parts.join(i, j[100 * common >= percent * (n[i] + size - common)])
    return parts


def _confirmed(groups: DataFrame, nodes: DataFrame, docs: DataFrame, words: int, percent: int) -> DataFrame:
    """(a, b): spanning forests of the links inside the coarse groups (id, component): 100 * |intersection| >= percent * |union| on the full sets."""
    known = groups.join(nodes.select("id", "n"), "id").withColumnRenamed("component", "coarse")
    sizes = known.groupBy("coarse").agg(F.count(F.lit(1)).alias("size"), F.sum("n").alias("total"))
    large = sizes.withColumn("blocks", F.ceil(F.greatest(F.col("size") / BLOCK, F.col("total") / BLOCK_SHINGLES)).cast("int")).where("blocks > 1").drop("total")
    # a node is in one group; its set is made once, unless it represents its group or is compared again
    ids = groups.select("id")

    def compare(rows: DataFrame, within: bool) -> DataFrame:
        rows = rows.join(nodes.select("id", "n", "sig"), "id").join(_full_sets(docs, ids if within else rows.select("id").distinct(), words), "id")
        rows = rows.select("coarse", "block", "blocks", "guest", "label", "id", "n", "sig", "shingles").repartition("coarse", "block").sortWithinPartitions("coarse", "block", "n")

        def run(batches):
            for table in _chunks((b.slice(k, 1000) for b in batches for k in range(0, b.num_rows, 1000)), 2, CHUNK_ROWS, 6, BLOCK_SHINGLES // 2):
                coarse, block, blocks, guest, label, ids = (table.column(k).to_numpy() for k in range(6))
                sig = np.frombuffer(b"".join(table.column(7).to_pylist()), np.uint8).reshape(-1, SIZE)
                sets = [np.frombuffer(x.as_py(), U) for x in table.column(8)]
                found = Found("coarse")
                for lo, hi in zip(*(x.tolist() for x in _groups(table, 2)), strict=True):
                    if hi - lo > 1 or blocks[lo] > 1:
                        parts = _linked(guest[lo:hi], label[lo:hi], sets[lo:hi], sig[lo:hi], within, percent)
                        found.add(parts, ids[lo:hi], guest[lo:hi], int(coarse[lo]), int(block[lo]), int(blocks[lo]), within)
                yield found.batch()

        return rows.mapInArrow(run, FOUND.format("coarse"))

    return _two_rounds(_dealt(known, "coarse", large), "coarse", compare)


def components(edges: DataFrame) -> DataFrame:
    """(id, component) for every end of the edges (a, b): the smallest id that can be reached. Alternating large and small stars.

    A star replaces the links of a node by links to its smallest neighbour; each pass is two sums and two joins, written out, until nothing changes.
    """
    now = stage(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "stars")
    before = None
    while True:
        state = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == before or state[0] == 0:
            ends = now.select(F.col("u").alias("id"), F.col("v").alias("component")).unionAll(now.select(F.col("v").alias("id"), F.col("v").alias("component")))
            out = stage(ends.groupBy("id").agg(F.min("component").alias("component")), "components")
            drop_staged(now)
            return out
        before = state
        both = now.select("u", "v").unionAll(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        large = stage(large, "stars")
        drop_staged(now)
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").unionAll(least.select("u", F.col("m").alias("v"))).distinct()
        now = stage(small, "stars")
        drop_staged(large)


def cluster(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for each row of ``docs``; links join texts with 100 * |intersection| >= percent * |union| of their shingle sets.

    A text with fewer words than a shingle is one shingle; a null text, or one without words, has none and is linked with nothing. Rows that repeat an id
    belong together. A row with a null id is linked with nothing and is its own (null) component, kept. Ids are integers. Other columns are ignored.
    """
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("binary").alias("text"))
    signed = stage(_signatures(docs, words), "near-signatures")
    some = signed.where("n > 0 AND doc_id IS NOT NULL")
    nodes = stage(some.groupBy("f1", "f2", "n").agg(F.min("doc_id").alias("id"), F.first("sig").alias("sig")), "near-nodes")
    keys = _keys(nodes)
    shared = keys.groupBy("key").agg(F.count(F.lit(1)).alias("size")).where("size > 1").select("key")
    members = stage(keys.join(shared, "key"), "near-members")
    near = _coarse(members, nodes, percent)
    groups = components(near)
    links = _confirmed(groups, nodes, docs, words, percent)
    # rows that repeat an id with another text are linked through the id
    same = some.select("f1", "f2", "n", "doc_id").join(nodes, ["f1", "f2", "n"]).select(F.col("doc_id").alias("a"), F.col("id").alias("b")).where("a <> b").distinct()
    labels = components(same.unionAll(links))
    drop_staged(nodes, members, near, groups, links)
    out = signed.select("doc_id", F.col("n").alias("n_shingles")).join(labels.withColumnRenamed("id", "doc_id"), "doc_id", "left")
    out = out.withColumn("component_id", F.coalesce("component", "doc_id"))
    return out.select("doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """One document of each group stays, the one with the smallest id, with its columns. Rows that repeat its id all stay."""
    name = free_name(docs.columns, "_gone")
    gone = cluster(docs, id_col, text_col, words, percent).where(~F.col("kept")).select(F.col("doc_id").alias(name)).distinct()
    return docs.join(gone, F.col(id_col).cast("long") == F.col(name), "left_anti")


def op6_hamming_join(spark, sf_dir: str) -> DataFrame:
    return cluster(read(spark, sf_dir, "documents"), words=2)


OP6_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents
), s AS MATERIALIZED (
  SELECT DISTINCT doc_id, array_to_string(w[k:k + 1], ' ') AS shingle FROM w, unnest(range(1, greatest(len(w) - 1, 1) + 1)) AS u(k) WHERE len(w) > 0
), n AS MATERIALIZED (
  SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id
), f AS (
  SELECT shingle, count(*) AS df FROM s GROUP BY shingle
), r AS MATERIALIZED (
  SELECT doc_id, shingle, row_number() OVER (PARTITION BY doc_id ORDER BY df, shingle) AS place, n FROM s JOIN f USING (shingle) JOIN n USING (doc_id)
), t AS MATERIALIZED (
  SELECT doc_id, shingle, n FROM r WHERE place <= n - ceil(0.8 * n) + 1
), c AS MATERIALIZED (
  SELECT DISTINCT a.doc_id AS a, b.doc_id AS b FROM t a JOIN t b ON a.shingle = b.shingle AND a.doc_id < b.doc_id AND 100 * least(a.n, b.n) >= 80 * greatest(a.n, b.n)
), l AS MATERIALIZED (
  SELECT a, b FROM c JOIN s x ON x.doc_id = a JOIN s y ON y.doc_id = b AND x.shingle = y.shingle JOIN n p ON p.doc_id = a JOIN n q ON q.doc_id = b
  GROUP BY a, b, p.n, q.n HAVING 100 * count(*) >= 80 * (p.n + q.n - count(*))
), e AS MATERIALIZED (
  SELECT a, b FROM l UNION ALL SELECT b, a FROM l
), g(doc_id, other) AS (
  SELECT doc_id, doc_id FROM documents UNION SELECT g.doc_id, e.b FROM g JOIN e ON g.other = e.a
), m AS (
  SELECT doc_id, min(other) AS component_id FROM g GROUP BY doc_id
)
SELECT doc_id, coalesce(n.n, 0) AS n_shingles, component_id, doc_id = component_id AS kept FROM m LEFT JOIN n USING (doc_id)
"""
