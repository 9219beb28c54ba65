"""Toxicity by a character n-gram linear classifier whose features are scaled by naive Bayes log-count ratios.

A document's features are the distinct character n-grams of its lower-cased words, hashed into buckets. On a bounded sample of labelled
rows, bucket j gets the log-count ratio r[j] of naive Bayes; a logistic regression is trained on the telling features scaled by r,
its weights folded into one number for each bucket. Every task keeps the features of its own rows, and the regression's gradients are sums
over tasks; what the driver holds are a few vectors of one number for each bucket. Scoring sums the folded numbers over a document's distinct n-grams.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import read, stage

SIZES = (3, 4, 5, 6)
BITS = 20
MAX_ROWS = 16_384  # labelled rows that are used at most, chosen by a hash of their ids
TELLING = 4.0  # standard deviations by which a bucket's share of toxic rows must differ from all rows' to enter the regression
SAMPLE_PARTS = 16
CHUNKS = 64
THRESHOLD = 0.7
EVALUATIONS, HISTORY, TOLERANCE = 60, 8, 1e-4  # of the regression's loss at most; steps that L-BFGS remembers; of the first gradient's length
PENALTY = 1e-4


class Grams:
    """Distinct hashed n-grams of texts; a word has a space before and behind it, and all else than letters and digits separates."""

    def __init__(self, bits: int = BITS):
        self.bits = bits
        self.seen = np.zeros(1 << bits, np.int64)

    def __call__(self, text: str) -> np.ndarray:
        code = np.frombuffer((" " + text.lower() + " ").encode("utf-32-le", "replace"), np.uint32)
        plain = (code < 0x80) & ((code < 48) | ((code > 57) & (code < 97)) | (code > 122))
        code = np.where(plain, np.uint32(32), code)
        code = code[np.concatenate([[True], (code[1:] != 32) | (code[:-1] != 32)])].astype(np.uint64)
        h = code * np.uint64(0x9E3779B97F4A7C15)
        out, at = [], h
        for n in range(2, max(SIZES) + 1):
            if len(h) < n:
                break
            at = (at[:-1] ^ (at[:-1] >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) + h[n - 1 :]
            if n in SIZES:
                out.append(((at ^ (at >> np.uint64(31))) * np.uint64(0x94D049BB133111EB)) >> np.uint64(64 - self.bits))
        if not out:
            return np.zeros(0, np.int64)
        g = np.concatenate(out).astype(np.int64)
        order = np.arange(len(g))
        self.seen[g] = order
        return g[self.seen[g] == order]


def _loss(rows: DataFrame, scales, weight: tuple[float, float]):
    """A function of (weights and, last, the bias) that gives the logistic loss over ``rows`` (y, features) and its gradient, summed over the tasks."""
    context = rows.sparkSession.sparkContext

    def at(w: np.ndarray) -> tuple[float, np.ndarray]:
        shared = context.broadcast(w)

        def run(batches):
            v, gradient, loss = shared.value[:-1] * scales.value, np.zeros(len(shared.value)), 0.0
            for batch in batches:
                features = [np.frombuffer(f.as_py(), np.int32) for f in batch.column(1)]
                y = np.array(batch.column(0).to_pylist()) > 0
                size = np.array([len(f) for f in features])
                row, col = np.repeat(np.arange(len(y)), size), np.concatenate(features)
                z = np.bincount(row, v[col], minlength=len(y)) + shared.value[-1]
                share = np.where(y, weight[1], weight[0])
                loss += float((share * np.logaddexp(0, np.where(y, -z, z))).sum())
                g = share * (1 / (1 + np.exp(-np.clip(z, -500, 500))) - y)
                gradient[:-1] += np.bincount(col, g[row], minlength=len(v))
                gradient[-1] += g.sum()
            gradient[:-1] *= scales.value
            yield pa.RecordBatch.from_arrays([pa.array([loss]), pa.array([gradient.tobytes()], pa.binary())], names=["loss", "gradient"])

        loss, gradient = PENALTY / 2 * float(w[:-1] @ w[:-1]), np.append(PENALTY * w[:-1], 0.0)
        for r in rows.mapInArrow(run, "loss double, gradient binary").toLocalIterator(prefetchPartitions=True):  # a row for each task
            loss += r["loss"]
            gradient += np.frombuffer(r["gradient"])
        shared.destroy()
        return loss, gradient

    return at


def minimised(loss, w: np.ndarray, evaluations: int = EVALUATIONS) -> np.ndarray:
    """L-BFGS with halved steps: as few evaluations as there can be, as each is a pass over the rows."""
    steps: list[tuple[np.ndarray, np.ndarray]] = []
    value, g = loss(w)
    first, used = float(np.linalg.norm(g)), 1
    while used < evaluations and np.linalg.norm(g) > TOLERANCE * first:
        d, kept = -g, []
        for s, y in reversed(steps):
            a = (s @ d) / (s @ y)
            kept.append(a)
            d = d - a * y
        if steps:
            d = d * (steps[-1][0] @ steps[-1][1]) / (steps[-1][1] @ steps[-1][1])
        for (s, y), a in zip(steps, reversed(kept), strict=True):
            d = d + (a - (y @ d) / (s @ y)) * s
        rate = 1.0 if steps else 1.0 / max(first, 1e-300)
        while used < evaluations:
            now, g_now = loss(w + rate * d)
            used += 1
            if now <= value + 1e-4 * rate * float(g @ d):
                break
            rate /= 2
        else:
            break
        s, y = rate * d, g_now - g
        if s @ y > 1e-12 * np.linalg.norm(s) * np.linalg.norm(y):
            steps = [*steps, (s, y)][-HISTORY:]
        w, value, g = w + s, now, g_now
    return w


def train(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str, max_rows: int = MAX_ROWS, bits: int = BITS) -> tuple[np.ndarray, float]:
    """One weight for each bucket, and the bias. Rows with a null id or label are not used; of several labels the largest counts.

    Without both classes all weights are 0 and the bias gives the only class, or 0 where there is no label at all.
    """
    few = labels.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull()).groupBy(F.col(id_col).alias("_id")).agg(F.max(F.col(label_col).cast("int")).alias("_y"))
    few = few.orderBy(F.xxhash64("_id"), "_id").limit(max_rows)
    sample = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text")).join(F.broadcast(few), "_id")  # at most max_rows rows of two numbers
    sample = stage(sample.select("_y", "_text").repartition(SAMPLE_PARTS), "toxicity")
    n = 1 << bits

    def count(batches):
        grams, found = Grams(bits), np.zeros((2, n), np.int32)
        rows = np.zeros(2, np.int64)
        for batch in batches:
            for y, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                found[int(y > 0), grams(text.as_py() or "")] += 1
                rows[int(y > 0)] += 1
        parts = [found[:, k : k + n // CHUNKS].tobytes() for k in range(0, n, n // CHUNKS)]
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(CHUNKS), pa.int64()), pa.array(np.full(CHUNKS, rows[0])), pa.array(np.full(CHUNKS, rows[1])), pa.array(parts, pa.binary())], names=["chunk", "n0", "n1", "found"])

    def add(table: pa.Table) -> pa.Table:
        total = sum(np.frombuffer(x.as_py(), np.int32) for x in table.column("found"))
        return pa.table([table.column("chunk").slice(0, 1), pa.array([sum(table.column("n0").to_pylist())]), pa.array([sum(table.column("n1").to_pylist())]), pa.array([total.tobytes()], pa.binary())], names=["chunk", "n0", "n1", "found"])

    shape = "chunk long, n0 long, n1 long, found binary"
    found, rows = np.zeros((2, n), np.float32), np.zeros(2)
    for r in sample.mapInArrow(count, shape).groupBy("chunk").applyInArrow(add, shape).toLocalIterator():  # CHUNKS rows of fixed size
        found[:, r["chunk"] * (n // CHUNKS) : (r["chunk"] + 1) * (n // CHUNKS)] = np.frombuffer(r["found"], np.int32).reshape(2, -1)
        rows[:] = r["n0"], r["n1"]
    if not rows.all():
        return np.zeros(n, np.float32), 20.0 if rows[1] else -20.0
    share = (found + 1) / (rows[:, None] + 2)
    ratio = np.log(share[1] / share[0])
    total, toxic = found.sum(0), rows[1] / rows.sum()
    telling = np.abs(found[1] - total * toxic) / np.sqrt(total * toxic * (1 - toxic) + 0.5)
    chosen = np.flatnonzero((telling >= TELLING) & (total > 1))
    place = np.full(n, -1, np.int32)
    place[chosen] = np.arange(len(chosen))
    context = docs.sparkSession.sparkContext
    places, scales = context.broadcast(place), context.broadcast(ratio[chosen])

    def select(batches):
        grams = Grams(bits)
        for batch in batches:
            kept = []
            for text in batch.column(1):
                f = places.value[grams(text.as_py() or "")]
                kept.append(np.sort(f[f >= 0]).tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(kept, pa.binary())], names=["y", "features"])

    # 4 bytes for each telling n-gram of at most max_rows rows, parted over SAMPLE_PARTS tasks
    selected = stage(sample.mapInArrow(select, "y int, features binary"), "toxicity-features")
    fitted = minimised(_loss(selected, scales, (0.5 / rows[0], 0.5 / rows[1])), np.zeros(len(chosen) + 1))
    weights = np.zeros(n, np.float32)
    weights[chosen] = fitted[:-1] * ratio[chosen]
    places.destroy()
    scales.destroy()
    return weights, float(fitted[-1])


def score(docs: DataFrame, model: tuple[np.ndarray, float], text_col: str = "text") -> DataFrame:
    """Adds ``score``, from 0 to 1, to every row; a null or empty text is scored by the bias alone. Repeated rows get the same score. A column of that name is replaced."""
    docs = docs.drop("score")
    shared = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index(text_col)

    def run(batches):
        weights, bias = shared.value
        grams = Grams(int(np.log2(len(weights))))
        for batch in batches:
            z = np.array([weights[grams(t.as_py() or "")].sum(dtype=np.float64) for t in batch.column(at)]) + bias
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(1 / (1 + np.exp(-np.clip(z, -50, 50))), pa.float64())], names=[*batch.schema.names, "score"])

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField("score", T.DoubleType())]))


def held_out(id_col: str = "doc_id"):
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def fitted(spark, sf_dir: str, docs: DataFrame | None = None) -> tuple[np.ndarray, float]:
    """Trained on the labelled rows that are not held out."""
    documents = read(spark, sf_dir, "documents") if docs is None else docs
    return train(documents, read(spark, sf_dir, "labels").where(~held_out()), "doc_id", "text", "toxic")


def op8_naive_bayes_ngrams(spark, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    out = score(docs, fitted(spark, sf_dir))
    return out.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
