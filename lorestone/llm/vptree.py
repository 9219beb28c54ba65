"""Nearest neighbours by a vantage-point tree for each shard.

Vectors are dealt to shards of bounded size by a hash of their ids. A shard's task builds a vantage-point tree over its distinct vectors:
a node holds a vantage point and the median distance to it, which splits the rest into an inner and an outer part. Queries visit
the likelier part first; the other is pruned if the triangle inequality, relaxed by a factor, rules it out: at factor one only what cannot
hold a neighbour goes, so the search is exact; larger factors prune more and may lose neighbours. Shard results are merged by distance and id.

Factor 1.5 keeps a recall of 0.9 and more where the lengths of the vectors' components fall off, and 0.999 on `embeddings`, whose components are
independent: there no bound of any factor up to 2 rules out more than 3 % of the distances, so the queries use factor 1.
"""

from __future__ import annotations

import functools
import pickle

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import read, stage

SHARD_ROWS = 16_384
LEAF = 128
BLOCK = 4096  # queries that are sent to the executors at once
FACTOR = 1.0
SLACK = 1e-9  # of the distances that a bound was computed from, for rounding
ROUNDING = 1e-9  # of the squared lengths that a matrix product was computed from
CANDIDATES, OTHERS = 8, 64
TOGETHER = 256  # queries that go through the tree together
LARGE = 1e150


def distances(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Euclidean distances (query, vector), squares added in the order of the components, in double precision."""
    total = np.zeros((len(q), len(x)))
    for j in range(x.shape[1]):
        d = q[:, j, None] - x[None, :, j]
        total += d * d
    return np.sqrt(total)


class Tree:
    """Nodes are tuples: of a leaf its rows; of others the vantage point, the least and greatest distance to it of either part, and the parts."""

    def __init__(self, x: np.ndarray, leaf: int = LEAF):
        """``x``: distinct vectors, in double precision."""
        self.x, self.leaf = x, leaf
        self.norms = (x * x).sum(axis=1)
        self.computed = 0  # distances to leaf rows and vantage points, of all searches
        self.nodes: list[tuple] = []
        self.root = self._build(np.arange(len(x))) if self._tame(x) else -1

    @staticmethod
    def _tame(x: np.ndarray) -> bool:
        """Whether no square overflows. Other vectors are compared one by one, without bounds."""
        return bool(np.abs(x).max(initial=0) < LARGE)

    def _vantage(self, rows: np.ndarray) -> np.ndarray:
        """Of CANDIDATES rows the one whose distances to a few others spread most; both are picked by a fixed seed."""
        pick = np.random.default_rng(len(rows))
        some, others = pick.choice(rows, CANDIDATES), pick.choice(rows, OTHERS)
        return self.x[some[int(distances(self.x[some], self.x[others]).std(axis=1).argmax())]]

    def _build(self, rows: np.ndarray) -> int:
        if len(rows) > self.leaf:
            vantage = self._vantage(rows)
            d = distances(vantage[None], self.x[rows])[0]
            radius = float(np.partition(d, len(d) // 2)[len(d) // 2])
            near = d <= radius
            if near.all():
                near = d < radius
            if near.any():
                bounds = [(float(part.min()), float(part.max())) for part in (d[near], d[~near])]
                node = (vantage, *bounds, self._build(rows[near]), self._build(rows[~near]))
                self.nodes.append(node)
                return len(self.nodes) - 1
        self.nodes.append((rows,))
        return len(self.nodes) - 1

    def _leaf(self, q: np.ndarray, rows: np.ndarray, worst: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Distances (query, row), and which were skipped (and are inf), as a matrix product shows that the row is farther than the query's worst so far, rounding allowed for."""
        sizes = (q * q).sum(axis=1)[:, None] + self.norms[rows][None]
        about = sizes - 2.0 * (q @ self.x[rows].T)
        skipped = about > (worst * worst)[:, None] + ROUNDING * sizes
        at, of = np.nonzero(~skipped)
        total = np.zeros(len(at))
        for j in range(q.shape[1]):  # as distances() adds them
            d = q[at, j] - self.x[rows[of], j]
            total += d * d
        out = np.full(about.shape, np.inf)
        out[at, of] = np.sqrt(total)
        return out, skipped

    def _homes(self, q: np.ndarray) -> np.ndarray:
        """For each query the leaf that the closer part of every node leads to."""
        home, todo = np.empty(len(q), np.int64), [(self.root, np.arange(len(q)))]
        while todo:
            at, some = todo.pop()
            node = self.nodes[at]
            if len(node) == 1:
                home[some] = at
                continue
            d = distances(q[some], node[0][None])[:, 0]
            close = np.maximum(node[1][0] - d, d - node[1][1]) <= np.maximum(node[2][0] - d, d - node[2][1])
            todo += [(child, who) for child, who in ((node[3], some[close]), (node[4], some[~close])) if len(who)]
        return home

    def search(self, q: np.ndarray, k: int, factor: float = FACTOR) -> tuple[np.ndarray, np.ndarray]:
        """Distances and rows of the k nearest for each query, nearest first, ties by the smaller row; inf and -1 where there are fewer.

        Every query looks into its home leaf first. Then queries with neighbouring homes go through the tree together, part by part in the
        order of their mean bounds; a query leaves where its own bound rules a part out.
        """
        none = len(self.x)  # stands after every row
        best, rows = np.full((len(q), k), np.inf), np.full((len(q), k), none)

        def merge(some: np.ndarray, found: np.ndarray, d: np.ndarray, skipped: np.ndarray) -> None:
            hit = ((d <= best[some, -1:]) & ~skipped).any(axis=1)
            who = some[hit]
            both = np.concatenate([best[who], d[hit]], axis=1)
            ids = np.concatenate([rows[who], np.where(skipped[hit], none, found[None])], axis=1)
            order = np.lexsort((ids, both), axis=1)[:, :k]
            best[who], rows[who] = np.take_along_axis(both, order, 1), np.take_along_axis(ids, order, 1)

        def look(some: np.ndarray, at: int) -> None:
            found = self.nodes[at][0]
            self.computed += len(some) * len(found)
            merge(some, found, *self._leaf(q[some], found, best[some, -1]))

        if not len(q):
            return best, rows
        if self.root < 0 or not self._tame(q):
            merge(np.arange(len(q)), np.arange(none), distances(q, self.x), np.zeros((len(q), none), bool))
            return best, np.where(rows == none, -1, rows)
        home = self._homes(q)
        by_home = np.argsort(home, kind="stable")
        for some in np.split(by_home, np.flatnonzero(np.diff(home[by_home])) + 1):
            look(some, int(home[some[0]]))
        for start in range(0, len(q), TOGETHER):
            some = by_home[start : start + TOGETHER]
            todo = [(self.root, some, np.zeros(len(some)), 0.0)]
            while todo:
                at, some, bound, scale = todo.pop()
                live = bound * factor <= best[some, -1] + SLACK * scale
                some, bound = some[live], bound[live]
                if not len(some):
                    continue
                node = self.nodes[at]
                if len(node) == 1:
                    some = some[home[some] != at]
                    if len(some):
                        look(some, at)
                    continue
                vantage, inner, outer, near, far = node
                self.computed += len(some)
                d = distances(q[some], vantage[None])[:, 0]
                scale = max(scale, float(d.max() + outer[1]))
                parts = [(child, some, np.maximum(bound, np.maximum(low - d, d - high)), scale) for child, (low, high) in ((near, inner), (far, outer))]
                todo += sorted(parts, key=lambda p: -float(p[2].mean()))  # the last is visited first
        return best, np.where(rows == none, -1, rows)


class Shard:
    """The vectors of one shard: equal ones stand in the tree once, with their ids in order."""

    def __init__(self, ids: np.ndarray, x: np.ndarray):
        order = np.argsort(ids, kind="stable")
        ids, x = ids[order], np.ascontiguousarray(x[order] + 0.0)  # no negative zeros
        same = x.view(np.dtype((np.void, x.dtype.itemsize * x.shape[1]))).ravel()
        _, first, inverse = np.unique(same, return_index=True, return_inverse=True)
        by_id = np.argsort(first)  # so that of equal distances the vector with the smallest id is nearer
        place = np.empty(len(first), np.int64)
        place[by_id] = np.arange(len(first))
        first, inverse = first[by_id], place[inverse]
        self.ids = ids[np.argsort(inverse, kind="stable")]
        self.starts = np.concatenate([[0], np.cumsum(np.bincount(inverse))])
        self.tree = Tree(x[first])

    def packed(self) -> bytes:
        """With single precision where that loses nothing, so that a staged tree is no larger than its rows."""
        small = self.tree.x.astype(np.float32)
        self.tree.x = small if (small == self.tree.x).all() else self.tree.x
        return pickle.dumps(self, protocol=5)

    @classmethod
    def unpacked(cls, raw: bytes) -> Shard:
        out = pickle.loads(raw)  # written by packed() in the same job
        out.tree.x = out.tree.x.astype(np.float64)
        return out

    def search(self, query_ids: np.ndarray, q: np.ndarray, k: int, factor: float) -> tuple[list[int], list[int], list[float]]:
        """The k nearest ids for each query but its own id."""
        best, rows = self.tree.search(q, k + 1, factor)
        out: tuple[list[int], list[int], list[float]] = ([], [], [])
        for i, own in enumerate(query_ids.tolist()):
            found = []
            for d, r in zip(best[i].tolist(), rows[i].tolist(), strict=True):
                if r >= 0:
                    found += [(d, v) for v in self.ids[self.starts[r] : min(self.starts[r + 1], self.starts[r] + k + 1)].tolist() if v != own]
            for d, v in sorted(found)[:k]:
                out[0].append(own)
                out[1].append(v)
                out[2].append(d)
        return out


def usable(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(id, v) of rows with an id whose vector is not null, empty or zero and whose components are all finite numbers."""
    v = F.col(vector_col)
    finite = F.forall(v, lambda c: F.coalesce(~F.isnan(c) & (F.abs(c.cast("double")) != float("inf")), F.lit(False)))
    return vectors.where(F.col(id_col).isNotNull() & v.isNotNull() & finite & F.exists(v, lambda c: c != 0)).select(F.col(id_col).cast("long").alias("id"), v.cast("array<double>").alias("v"))


def planted(rows: DataFrame, shard_rows: int) -> DataFrame:
    """(size, tree): a tree for each shard of the distinct rows (id, v), written out, so that every block of queries reads it instead of dealing the vectors anew."""
    rows = rows.dropDuplicates(["id", "v"])
    shards = max(1, -(-rows.count() // shard_rows))
    dealt = rows.withColumns({"shard": F.pmod(F.xxhash64("id", "v"), F.lit(shards)), "size": F.size("v")})

    def run(table: pa.Table) -> pa.Table:
        n = table.column("size")[0].as_py()
        x = table.column("v").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(-1, n)
        return pa.table([pa.array([n], pa.int32()), pa.array([Shard(table.column("id").to_numpy(), x).packed()], pa.binary())], names=["size", "tree"])

    return stage(dealt.groupBy("shard", "size").applyInArrow(run, "size int, tree binary"), "vptree-trees")


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 10, id_col: str = "vec_id", vector_col: str = "embedding", factor: float = FACTOR, shard_rows: int = SHARD_ROWS, block: int = BLOCK) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest vectors of each query, all if there are fewer, ties by smaller id.

    Vectors that are null, empty, zero or hold null or non-finite components take no part, nor do rows with a null id. Only vectors of equal
    length are compared. A row with the query's own id is no neighbour. Rows that repeat an id and a vector count once. Queries are taken in blocks,
    each against all shards; a block's result is written and its broadcast given up before the next one is sent.
    """
    if k < 1 or factor < 1:
        raise ValueError("k and factor must be at least 1")
    spark = vectors.sparkSession
    trees = planted(usable(vectors, id_col, vector_col), shard_rows)
    asked = stage(usable(queries, id_col, vector_col).dropDuplicates(["id", "v"]), "vptree-queries")
    schema = "query_id long, vec_id long, score double"
    parts = []

    def one_block(ids: list[int], matrix: list[list[float]]) -> DataFrame:
        by_size = {n: (np.array([i for i, v in zip(ids, matrix, strict=True) if len(v) == n]), np.array([v for v in matrix if len(v) == n])) for n in {len(v) for v in matrix}}
        shared = spark.sparkContext.broadcast(by_size)

        def run(batches):
            for batch in batches:
                for n, raw in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                    if n in shared.value:
                        out = Shard.unpacked(raw.as_py()).search(*shared.value[n], k, factor)
                        yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.float64())], names=["query_id", "vec_id", "score"])

        found = stage(trees.mapInArrow(run, schema), "vptree-found")
        shared.destroy()
        return found

    ids, matrix = [], []
    for r in asked.toLocalIterator():  # no more than a block is held
        ids.append(r["id"])
        matrix.append(r["v"])
        if len(ids) == block:
            parts.append(one_block(ids, matrix))
            ids, matrix = [], []
    if ids:
        parts.append(one_block(ids, matrix))
    found = functools.reduce(DataFrame.unionAll, parts) if parts else spark.createDataFrame([], schema)
    order = Window.partitionBy("query_id").orderBy("score", "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def op9_vantage_points(spark, sf_dir: str) -> DataFrame:
    vectors = read(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return nearest(vectors, vectors.where(F.col("vec_id") % 100 == 0))


OP9_SQL = """
WITH v AS (
  SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0 AND len(list_filter(embedding, lambda c: c <> 0)) > 0
), p AS (
  SELECT q.vec_id AS query_id, v.vec_id, sqrt(list_reduce(list_transform(list_zip(q.e, v.e), lambda c: (c[1] - c[2]) * (c[1] - c[2])), lambda s, c: s + c)) AS score FROM v q JOIN v ON q.vec_id <> v.vec_id AND len(q.e) = len(v.e) WHERE q.vec_id % 100 = 0
)
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score, vec_id) AS INTEGER) AS rank, vec_id, score FROM p
QUALIFY rank <= 10
"""
