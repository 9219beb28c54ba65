"""Dense, sparse and fused search over chunk tables.

Queries are a stated set against all rows, taken in blocks of bounded size that are broadcast; dense and sparse scores are products of
matrices, of which a task keeps the k best rows for each query. Scores are rounded before ranking, so that the order does not depend on how a sum was split; ties go to the smaller id.
"""

from __future__ import annotations

import functools

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from lorestone.functions.text import tokens
from lorestone.sources.store import dropped, numbered, staged

RRF_K, ALPHA, LIMIT = 60, 0.5, 10
QUERY_ROWS = 4096  # queries that are sent to the tasks at once
QUERY_TERMS = 1_000_000  # terms of such queries
SLICE = 1024  # rows that are compared with them at once
CELLS = 4_000_000  # numbers of differences that are held at once
PRODUCTS = 1_000_000  # products of weights that are held at once
TASKS, LEAST_TASKS = 4, 32  # that a core gets of a search, and that there may be at least
OFTEN = 1 / 150  # share of the pairs of a text and a query from which a term's products cost less as a full matrix


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def euclid(a: Column, b: Column) -> Column:
    return F.sqrt(F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") - y.cast("double")), F.lit(0.0), lambda s, x: s + x * x))


def cosine(a: Column, b: Column) -> Column:
    size = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(size > 0, dot(a, b) / size)


METRICS = {"cosine": (cosine, False), "dot": (dot, False), "euclid": (euclid, True)}


def query_block(queries: DataFrame) -> DataFrame:
    """Broadcast if the queries are few; else left to the planner."""
    return F.broadcast(queries) if queries.limit(QUERY_ROWS + 1).count() <= QUERY_ROWS else queries


def query_blocks(queries: DataFrame) -> list[DataFrame]:
    """The queries in blocks of about QUERY_ROWS rows, dealt by a hash of query_id."""
    return _dealt(queries, -(-queries.count() // QUERY_ROWS))


def _dealt(queries: DataFrame, blocks: int) -> list[DataFrame]:
    return [queries.where(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == b) for b in range(blocks)] if blocks > 1 else [queries]


def _few_tasks(rows: DataFrame) -> DataFrame:
    """The same rows in no more tasks than the cores need: each task hands on k rows for each query, so what is shuffled does not grow with tasks times queries."""
    return rows.coalesce(max(LEAST_TASKS, TASKS * rows.sparkSession.sparkContext.defaultParallelism))


def top(scored: DataFrame, by: list[str], k: int, ascending: bool = False, id_col: str = "id") -> DataFrame:
    score = F.col("score").asc() if ascending else F.col("score").desc()
    order = Window.partitionBy(*by).orderBy(score, F.col(id_col))
    return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def _measured(x: np.ndarray, q: np.ndarray, metric: str) -> np.ndarray:
    """Scores (query, row), rounded; null where a vector has no length."""
    product = q @ x.T
    if metric == "euclid":
        out = np.empty(product.shape)
        step = max(1, CELLS // max(1, q.size))
        for k in range(0, len(x), step):  # differences, as the squares of close vectors cancel out
            out[:, k : k + step] = np.sqrt(((q[:, None, :] - x[None, k : k + step, :]) ** 2).sum(axis=2))
    elif metric == "cosine":
        size = np.sqrt((q * q).sum(axis=1))[:, None] * np.sqrt((x * x).sum(axis=1))[None]
        out = np.divide(product, size, out=np.full(product.shape, np.nan), where=size > 0)
    else:
        out = product
    return np.floor(np.abs(out) * 1e6 + 0.5) / 1e6 * np.sign(out)


def _best_here(rows: DataFrame, queries: DataFrame, k: int, metric: str, threshold: float | None) -> DataFrame:
    """(query_id, id, score): for each query the k best of every task, by products of matrices; ties by id, so the k best of all are among them."""
    asked = queries.select("query_id", F.col("query").cast("array<double>")).where("query IS NOT NULL").collect()  # a block of bounded size
    shared = rows.sparkSession.sparkContext.broadcast(([r[0] for r in asked], [r[1] for r in asked]))
    sign = 1.0 if METRICS[metric][1] else -1.0
    plain = rows.select("id", F.col("vector").cast("array<double>").alias("vector")).where("vector IS NOT NULL")

    def run(batches):
        names, given = shared.value
        sizes = np.array([len(g) for g in given])
        # by query: places in ``names``, signed scores and ids of the best so far
        who, best, ids = np.zeros(0, np.int64), np.zeros(0), np.zeros(0, np.int64)
        limit = np.full(len(names), np.inf)
        matrices = {n: (np.flatnonzero(sizes == n), np.array([g for g in given if len(g) == n])) for n in set(sizes.tolist())}
        for batch in batches:
            for start in range(0, batch.num_rows, SLICE):
                part = batch.slice(start, SLICE)
                vectors = part.column(1)
                flat, lengths = vectors.flatten().to_numpy(zero_copy_only=False), pc.list_value_length(vectors).to_numpy(zero_copy_only=False)
                for n in set(lengths.tolist()) & set(matrices):
                    at = np.flatnonzero(lengths == n)
                    x = (flat.reshape(-1, n) if len(at) == part.num_rows else np.array([vectors[int(i)].as_py() for i in at])).astype(np.float64)
                    places, q = matrices[n]
                    score = _measured(x, q, metric)
                    good = sign * score <= limit[places][:, None]
                    if threshold is not None:
                        good &= score <= threshold if sign > 0 else score >= threshold
                    i, j = np.nonzero(good)
                    who, best, ids = np.concatenate([who, places[i]]), np.concatenate([best, sign * score[i, j]]), np.concatenate([ids, part.column(0).to_numpy()[at][j]])
                    order = np.lexsort((ids, best, who))
                    who, best, ids = who[order], best[order], ids[order]
                    first = np.searchsorted(who, np.arange(len(names)))
                    kept = np.arange(len(who)) - first[who] < k
                    who, best, ids = who[kept], best[kept], ids[kept]
                    full = np.bincount(who, minlength=len(names)) == k
                    ends = np.searchsorted(who, np.arange(len(names)), side="right") - 1
                    limit[full] = best[ends[full]]
        yield pa.RecordBatch.from_arrays([pa.array([names[w] for w in who.tolist()], pa.int64()), pa.array(ids, pa.int64()), pa.array(sign * best + 0.0, pa.float64())], names=["query_id", "id", "score"])

    return _few_tasks(plain.select(F.col("id").cast("long").alias("id"), "vector")).mapInArrow(run, "query_id long, id long, score double")


def dense(rows: DataFrame, queries: DataFrame, k: int = LIMIT, metric: str = "cosine", threshold: float | None = None) -> DataFrame:
    """(query_id, id, score, rank). ``rows``: id, vector and whatever filter was applied; ``queries``: query_id, query. Ids are integers; only vectors of equal length are compared.

    Every block of queries goes to all tasks once; a task keeps k rows for each query, so what is shuffled does not grow with the rows of a task.
    """
    ascending = METRICS[metric][1]
    parts = [_best_here(rows, block, k, metric, threshold) for block in query_blocks(queries)]
    return top(functools.reduce(DataFrame.unionAll, parts), ["query_id"], k, ascending)


MODES = ("semantic", "keyword", "hybrid")


def search(mode: str, queries: DataFrame, rows: DataFrame | None = None, docs: DataFrame | None = None, k: int = LIMIT, alpha: float = ALPHA, threshold: float | None = None, sparse: DataFrame | None = None) -> DataFrame:
    """(query_id, id, score, rank) by the mode's search. ``queries`` has query_id, and query (a vector) or text, as the mode needs; both for hybrid.

    ``sparse``: what ``keyword`` found for these queries and texts with at least ``leg_size(k)`` rows a query, where several modes share it.
    A mode that is not known, or one whose tables or columns are missing, is refused (ValueError).
    """
    if mode not in MODES:
        raise ValueError(f"mode must be one of {MODES}")
    for needed, column, given in (("keyword", "query", rows), ("semantic", "text", docs)):
        if mode != needed and (given is None or column not in queries.columns):
            raise ValueError(f"{mode} search needs {'vectors' if column == 'query' else 'texts'} and queries with {column}")
    if not 0 <= alpha <= 1:
        raise ValueError("alpha must be from 0 to 1")
    if mode == "semantic":
        return dense(rows, queries.select("query_id", "query"), k, threshold=threshold)
    n = k if mode == "keyword" else leg_size(k)
    texts = keyword(docs, queries.select("query_id", "text"), n) if sparse is None else sparse.where(F.col("rank") <= n)
    return texts if mode == "keyword" else fused(dense(rows, queries.select("query_id", "query"), n), texts, k, alpha, threshold or 0.0)


def with_payload(found: DataFrame, payload: DataFrame) -> DataFrame:
    """(query_id, id, score, rank) and the payload's columns, by id."""
    return found.join(payload, "id", "left")


class FittedKeywords:
    """A vocabulary with weights, fitted once and used for later texts: terms it does not know do not count."""

    def __init__(self, docs: DataFrame):
        self.weights = staged(term_weights(docs).join(vocabulary_index(docs), "term"), "keywords")

    def embed(self, docs: DataFrame) -> DataFrame:
        """(id, idx, weight): the sparse vectors of the texts; weights of 0 are left out."""
        return postings(docs).join(self.weights.where("weight > 0"), "term").select("id", "idx", "weight")


def postings(docs: DataFrame) -> DataFrame:
    """(id, term) for each distinct term of each text."""
    return docs.select("id", F.explode(F.array_distinct(tokens(F.col("text")))).alias("term"))


def document_frequency(docs: DataFrame) -> DataFrame:
    return postings(docs).groupBy("term").agg(F.count(F.lit(1)).alias("df"))


def corpus_stats(docs: DataFrame) -> DataFrame:
    n = F.size(tokens(F.col("text")))
    vocabulary = document_frequency(docs).agg(F.count(F.lit(1)).alias("vocabulary"))
    return docs.agg(F.count(F.lit(1)).alias("corpus_size"), F.round(F.avg(n), 6).alias("avg_tokens"), F.min(n).cast("long").alias("min_tokens"), F.max(n).cast("long").alias("max_tokens")).join(vocabulary)


def term_weights(docs: DataFrame) -> DataFrame:
    """(term, idx, df, weight): the place of a term among the sorted terms, and max(0, ln((N - df + .5) / (df + .5)))."""
    n = docs.agg(F.count(F.lit(1)).alias("n"))
    weight = F.greatest(F.lit(0.0), F.log((F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5)))
    return document_frequency(docs).join(F.broadcast(n)).select("term", "df", F.round(weight, 6).alias("weight"))


def vocabulary_index(docs: DataFrame) -> DataFrame:
    """(term, idx): sorted terms numbered from 0; no task numbers all of them."""
    return numbered(document_frequency(docs).select("term"), ["term"], "idx").select("term", "idx")


def _places(docs: DataFrame, known: list[str]) -> DataFrame:
    """(id, places): the distinct terms of each text by their places in ``known``; texts that have none of them are left out."""
    shared = docs.sparkSession.sparkContext.broadcast(known)

    def run(batches):
        names = pa.array(shared.value, pa.string())
        for batch in batches:
            terms = batch.column(1)
            flat = terms.flatten()
            place = pc.index_in(flat, value_set=names.cast(flat.type))
            row = np.repeat(np.arange(batch.num_rows), pc.list_value_length(terms).to_numpy(zero_copy_only=False))[pc.is_valid(place).to_numpy(zero_copy_only=False)]
            size = np.bincount(row, minlength=batch.num_rows)
            places = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(size)]), pa.int32()), place.drop_null())
            yield pa.RecordBatch.from_arrays([batch.column(0), places], names=["id", "places"]).filter(pa.array(size > 0))

    terms = docs.where("text IS NOT NULL").select("id", F.array_distinct(tokens(F.col("text"))).alias("terms"))  # a filter on the terms would read the texts twice
    return terms.mapInArrow(run, f"id {docs.schema['id'].dataType.simpleString()}, places array<int>")


def _sortable(ids: pa.Array) -> np.ndarray:
    if pa.types.is_integer(ids.type) and not ids.null_count:
        return ids.to_numpy(zero_copy_only=False)
    return pc.rank(ids, sort_keys="ascending", null_placement="at_start", tiebreaker="dense").to_numpy()


def _best_texts(here: DataFrame, shared, name_type: str, k: int) -> DataFrame:
    """(query_id, id, score): for each query the k best texts of every task; ties by id, so the k best of all are among them. ``here``: id, places, and times if a place counts more than once."""

    def run(batches):
        names, begins, who, worth, often, matrix = shared.value
        width, column = np.diff(begins), np.full(len(begins) - 1, -1)
        column[often] = np.arange(len(often))
        limit, pool, held = np.zeros(len(names)), [], 0

        def settled():
            """The k best of the pool; what they leave to beat goes to ``limit``."""
            q, best, ids = np.concatenate([p[0] for p in pool]), np.concatenate([p[1] for p in pool]), pa.concat_arrays([p[2] for p in pool])
            order = np.lexsort((_sortable(ids), -best, q))
            q = q[order]
            order = order[np.arange(len(q)) - np.searchsorted(q, q) < k]
            q, best, ids = np.concatenate([p[0] for p in pool])[order], best[order], ids.take(pa.array(order))
            ends = np.searchsorted(q, np.arange(len(names)), side="right") - 1
            full = np.bincount(q, minlength=len(names)) == k
            limit[full] = np.maximum(limit[full], best[ends[full]])
            return q, best, ids

        for batch in batches:
            flat, lengths = batch.column(1).flatten().to_numpy(zero_copy_only=False), pc.list_value_length(batch.column(1)).to_numpy(zero_copy_only=False)
            times = batch.column(2).flatten().to_numpy(zero_copy_only=False) if batch.num_columns > 2 else None
            row, offsets = np.repeat(np.arange(batch.num_rows), lengths), np.concatenate([[0], np.cumsum(lengths)])
            cost = np.cumsum(np.bincount(row, weights=width[flat], minlength=batch.num_rows) + len(names) + len(often))
            cuts = [0, *(np.flatnonzero(np.diff(cost // PRODUCTS)) + 1).tolist(), batch.num_rows]
            for start, end in zip(cuts, cuts[1:]):
                part = slice(offsets[start], offsets[end])
                t, r, n = flat[part], row[part] - start, end - start
                given = np.zeros((n, len(often)))
                at = column[t] >= 0
                given[r[at], column[t[at]]] = 1 if times is None else times[part][at]
                score = given @ matrix
                w = width[t]
                place = np.arange(w.sum()) + np.repeat(begins[t] - (np.cumsum(w) - w), w)
                value = worth[place] if times is None else worth[place] * np.repeat(times[part], w)
                score += np.bincount(np.repeat(r * len(names), w) + who[place], weights=value, minlength=score.size).reshape(score.shape)
                if not pool and n >= k:  # so that the first rows do not all go to the pool
                    np.maximum(limit, np.partition(np.ascontiguousarray(score.T), n - k, axis=1)[:, n - k], out=limit)
                i, q = np.nonzero((score > 0) & (score >= limit - 1e-6))  # before rounding
                if not len(i):
                    continue
                pool.append((q, np.floor(score[i, q] * 1e6 + 0.5) / 1e6, batch.column(0).take(pa.array(start + i))))
                held += len(i)
                if held > 2 * max(len(names) * k, 1 << 15):
                    pool = [settled()]
                    held = len(pool[0][0])
        if pool:
            q, best, ids = settled()
            yield pa.RecordBatch.from_arrays([names.take(pa.array(q)), ids, pa.array(best)], names=["query_id", "id", "score"])

    return _few_tasks(here).mapInArrow(run, f"query_id {name_type}, id {here.schema['id'].dataType.simpleString()}, score double")


def keyword(docs: DataFrame, queries: DataFrame, k: int = LIMIT) -> DataFrame:
    """(query_id, id, score, rank) by the sum of products of positive weights.

    For each block of queries the texts are read into words once, and only the places of the terms that are asked for are written out; frequencies, and so
    weights, are those of the whole corpus. Products are summed inside a task, which keeps k texts for each query: no pair of a text and a query is shuffled.
    Rows of one id count together, as do queries of one query_id.
    """
    asked = staged(queries.select("query_id", F.array_distinct(tokens(F.col("text"))).alias("terms")), "asked").where(F.size("terms") > 0)
    rows, terms = asked.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.size("terms")), F.lit(0))).first()
    n = docs.count()
    repeated = staged(docs.groupBy("id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(F.col("id").alias("again")), "repeated")
    blocks = _dealt(asked, max(-(-rows // QUERY_ROWS), -(-terms // QUERY_TERMS)))
    return functools.reduce(DataFrame.unionAll, [_keyword_block(docs, block, k, n, None if repeated.isEmpty() else repeated) for block in blocks])


def _keyword_block(docs: DataFrame, block: DataFrame, k: int, n: int, repeated: DataFrame | None) -> DataFrame:
    found = block.collect()  # a block of bounded size
    names = list(dict.fromkeys(r["query_id"] for r in found))
    known = sorted({t for r in found for t in r["terms"]})
    number, place = {q: i for i, q in enumerate(names)}, {t: i for i, t in enumerate(known)}
    who = np.array([number[r["query_id"]] for r in found for _ in r["terms"]], np.int64)
    term = np.array([place[t] for r in found for t in r["terms"]], np.int64)
    here = staged(_places(docs, known), "places")
    weight = F.round(F.greatest(F.lit(0.0), F.log((F.lit(n) - F.col("df") + 0.5) / (F.col("df") + 0.5))), 6)
    counted = here.select(F.explode("places").alias("place")).groupBy("place").agg(F.count(F.lit(1)).alias("df")).select("place", "df", weight.alias("weight"))
    weights, df = np.zeros(len(known)), np.zeros(len(known))
    for r in counted.where("weight > 0").collect():  # a row for each term of the block
        weights[r["place"]], df[r["place"]] = r["weight"], r["df"]
    asked = np.bincount(term, minlength=len(known))
    often = np.flatnonzero((df > 0) & (df * asked > OFTEN * n * len(names)))
    matrix = np.zeros((len(often), len(names)))
    column = np.full(len(known), -1)
    column[often] = np.arange(len(often))
    full = column[term] >= 0
    np.add.at(matrix, (column[term[full]], who[full]), weights[term[full]] ** 2)
    rest = np.flatnonzero(~full & (weights[term] > 0))
    rest = rest[np.argsort(term[rest], kind="stable")]
    begins = np.searchsorted(term[rest], np.arange(len(known) + 1))
    name_type = block.schema["query_id"].dataType
    shared = here.sparkSession.sparkContext.broadcast((pa.array(names, to_arrow_type(name_type)), begins, who[rest], weights[term[rest]] ** 2, often, matrix))
    if repeated is None:
        best = _best_texts(here, shared, name_type.simpleString(), k)
    else:
        same = F.col("id").eqNullSafe(F.col("again"))
        merged = here.join(repeated, same, "left_semi").select("id", F.explode("places").alias("place")).groupBy("id", "place").agg(F.count(F.lit(1)).cast("int").alias("times"))
        merged = merged.groupBy("id").agg(F.collect_list(F.struct("place", "times")).alias("all")).select("id", F.col("all.place").alias("places"), F.col("all.times").alias("times"))
        best = _best_texts(here.join(repeated, same, "left_anti"), shared, name_type.simpleString(), k).unionAll(_best_texts(merged, shared, name_type.simpleString(), k))
    out = staged(top(best, ["query_id"], k), "keyword")
    dropped(here)
    return out


def fused(first: DataFrame, second: DataFrame, k: int = LIMIT, alpha: float = ALPHA, threshold: float = 0.0) -> DataFrame:
    """(query_id, id, score, rank): reciprocal ranks of two legs; a missing leg counts nothing."""
    a = first.select("query_id", "id", F.col("rank").alias("ra"))
    b = second.select("query_id", "id", F.col("rank").alias("rb"))
    score = F.coalesce(F.lit(alpha) / (RRF_K + F.col("ra")), F.lit(0.0)) + F.coalesce(F.lit(1 - alpha) / (RRF_K + F.col("rb")), F.lit(0.0))
    scored = a.join(b, ["query_id", "id"], "full_outer").select("query_id", "id", F.round(score, 6).alias("score")).where(F.col("score") >= threshold)
    return top(scored, ["query_id"], k)


def leg_size(k: int) -> int:
    return max(3 * k, 50)


def hybrid(rows: DataFrame, docs: DataFrame, queries: DataFrame, k: int = LIMIT) -> DataFrame:
    """``queries``: query_id, query (vector), text."""
    n = leg_size(k)
    return fused(dense(rows, queries.select("query_id", "query"), n), keyword(docs, queries.select("query_id", "text"), n), k)


def retrieval_metrics(found: DataFrame, relevant: DataFrame, k: int) -> DataFrame:
    """(queries, recall, precision, mrr, map, ndcg) at k. ``found``: query_id, id, rank; ``relevant``: query_id, id."""
    hit = found.where(F.col("rank") <= k).join(relevant.withColumn("hit", F.lit(1)), ["query_id", "id"], "left")
    seen = F.sum(F.coalesce("hit", F.lit(0))).over(Window.partitionBy("query_id").orderBy("rank"))
    hit = hit.withColumn("seen", seen)
    each = hit.groupBy("query_id").agg(
        F.sum(F.coalesce("hit", F.lit(0))).alias("hits"),
        F.min(F.when(F.col("hit") == 1, F.col("rank"))).alias("first"),
        F.sum(F.when(F.col("hit") == 1, F.col("seen") / F.col("rank")).otherwise(0.0)).alias("precisions"),
        F.sum(F.when(F.col("hit") == 1, F.lit(1.0) / F.log2(F.col("rank") + 1)).otherwise(0.0)).alias("dcg"),
    )
    all_ = relevant.groupBy("query_id").agg(F.count(F.lit(1)).alias("total"))
    each = all_.join(each, "query_id", "left")
    ideal = F.aggregate(F.sequence(F.lit(1), F.least("total", F.lit(k)).cast("int")), F.lit(0.0), lambda s, i: s + F.lit(1.0) / F.log2(i + 1))
    avg = lambda c: F.round(F.avg(F.coalesce(c, F.lit(0.0))), 6)
    return each.withColumn("ideal", ideal).agg(
        F.count(F.lit(1)).alias("queries"), avg(F.col("hits") / F.col("total")).alias("recall"), avg(F.col("hits") / k).alias("precision"),
        avg(1.0 / F.col("first")).alias("mrr"), avg(F.col("precisions") / F.least("total", F.lit(k))).alias("map"), avg(F.col("dcg") / F.col("ideal")).alias("ndcg"),
    )
