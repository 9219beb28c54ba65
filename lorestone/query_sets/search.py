"""Search queries. Dense queries are the vectors of every 100th id against all rows; text queries are all of `benchmark`."""

from __future__ import annotations

from pyspark.sql import functions as F

from lorestone.functions.text import tokens
from lorestone.operators import search as S
from lorestone.sources.tables import table, texts, vectors

TOKENS_SQL = r"list_filter(regexp_extract_all(lower({0}), '[\p{{L}}\p{{N}}\p{{M}}_]+'), lambda x: length(x) > 1 AND regexp_full_match(x, '[a-z0-9]+'))"
DENSE_SQL = """
SELECT q.vec_id AS query_id, v.vec_id AS id, round({expr}, 6) AS score FROM embeddings q, embeddings v WHERE q.vec_id % 100 = 0 {where}
"""
COSINE = "list_cosine_similarity(q.embedding::DOUBLE[], v.embedding::DOUBLE[])"
DOT = "list_inner_product(q.embedding::DOUBLE[], v.embedding::DOUBLE[])"
EUCLID = "list_distance(q.embedding::DOUBLE[], v.embedding::DOUBLE[])"
RANK_SQL = "SELECT query_id, id, score, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score {order}, id) AS INTEGER) AS rank FROM ({inner}) QUALIFY rank <= {k}"


def _ranked(inner: str, k: int = 10, order: str = "DESC") -> str:
    return RANK_SQL.format(inner=inner, k=k, order=order)


def _asked(spark, sf_dir):
    return vectors(spark, sf_dir).where(F.col("id") % 100 == 0).select(F.col("id").alias("query_id"), F.col("vector").alias("query"))


def _texts_asked(spark, sf_dir):
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), "text")


def dense_topk(spark, sf_dir):
    return S.dense(vectors(spark, sf_dir), _asked(spark, sf_dir))


def dense_topk_filtered(spark, sf_dir):
    return S.dense(vectors(spark, sf_dir).where(F.col("kind") == 1), _asked(spark, sf_dir), 5)


def score_threshold_search(spark, sf_dir):
    return S.dense(vectors(spark, sf_dir), _asked(spark, sf_dir), 20, threshold=0.3)


def dot_topk(spark, sf_dir):
    return S.dense(vectors(spark, sf_dir), _asked(spark, sf_dir), metric="dot")


def euclid_topk(spark, sf_dir):
    return S.dense(vectors(spark, sf_dir), _asked(spark, sf_dir), metric="euclid")


def bm25_doc_freq(spark, sf_dir):
    return S.document_frequency(texts(spark, sf_dir))


def bm25_corpus_stats(spark, sf_dir):
    return S.corpus_stats(texts(spark, sf_dir))


def bm25_vocabulary_index(spark, sf_dir):
    return S.vocabulary_index(texts(spark, sf_dir))


def bm25_sparse_vector(spark, sf_dir):
    """(id, terms, weight_sum): the stored sparse vectors, summed up for comparison."""
    docs = texts(spark, sf_dir)
    return S.postings(docs).join(S.term_weights(docs), "term").groupBy("id").agg(F.count(F.lit(1)).alias("terms"), F.sum(F.col("weight").cast("decimal(18,6)")).cast("double").alias("weight_sum"))


def keyword_topk(spark, sf_dir):
    return S.keyword(texts(spark, sf_dir), _texts_asked(spark, sf_dir), 50)


def hybrid_rrf(spark, sf_dir):
    """Queries that have both a vector and a text: ids divisible by 100 of both tables."""
    docs = texts(spark, sf_dir)
    queries = _asked(spark, sf_dir).join(docs.withColumnRenamed("id", "query_id"), "query_id")
    return S.hybrid(vectors(spark, sf_dir), docs, queries)


def unified_search_union(spark, sf_dir):
    """The code leg and the chat leg of one query set, side by side, best first."""
    code = S.keyword(texts(spark, sf_dir), _texts_asked(spark, sf_dir)).select("query_id", F.lit("code").alias("leg"), "id", "score")
    talk = table(spark, sf_dir, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("id"), "text")
    chat = S.keyword(talk, _texts_asked(spark, sf_dir)).select("query_id", F.lit("chat").alias("leg"), "id", "score")
    both = code.unionAll(chat).withColumn("key", F.concat("leg", F.col("id").cast("string")))
    return S.top(both, ["query_id"], 10, id_col="key").select("query_id", "leg", "id", "score", "rank")


def entity_type_filter_search(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").where(F.col("lang").isin("en", "de")).select(F.col("doc_id").alias("id"), "text")
    return S.keyword(docs, _texts_asked(spark, sf_dir), 5)


def retrieval_metrics(spark, sf_dir):
    """Dense search judged by labels: relevant are the other vectors with the query's label."""
    v = vectors(spark, sf_dir)
    asked = v.where(F.col("id") % 100 == 0)
    found = S.dense(v, asked.select(F.col("id").alias("query_id"), F.col("vector").alias("query")), 10)
    relevant = v.join(S.query_block(asked.select(F.col("id").alias("query_id"), "kind")), "kind").select("query_id", "id")
    return S.retrieval_metrics(found, relevant, 10)


def tokenized_texts(spark, sf_dir):
    return texts(spark, sf_dir).select("id", F.size(tokens(F.col("text"))).cast("long").alias("n_tokens"), F.sha2(F.array_join(tokens(F.col("text")), " "), 256).alias("tokens_sha256"))


def keyword_sql(docs: str, queries: str, k: int) -> str:
    return f"""
WITH d AS ({docs}), q AS ({queries}),
p AS (SELECT id, unnest(list_distinct({TOKENS_SQL.format('text')})) AS term FROM d),
a AS (SELECT query_id, unnest(list_distinct({TOKENS_SQL.format('text')})) AS term FROM q),
w AS (SELECT term, round(greatest(0.0, ln(((SELECT count(*) FROM d) - count(*) + 0.5) / (count(*) + 0.5))), 6) AS weight FROM p GROUP BY term),
s AS (SELECT query_id, id, round(sum(weight * weight), 6) AS score FROM p JOIN w USING (term) JOIN a USING (term) WHERE weight > 0 GROUP BY ALL)
{_ranked('SELECT * FROM s', k)}"""


DOCS = "SELECT doc_id AS id, text FROM documents"
ITEMS = "SELECT item_id AS query_id, text FROM benchmark"
_dense50 = _ranked(DENSE_SQL.format(expr=COSINE, where="AND q.vec_id IN (SELECT doc_id FROM documents)"), 50)
_sparse50 = keyword_sql(DOCS, "SELECT doc_id AS query_id, text FROM documents WHERE doc_id % 100 = 0 AND doc_id IN (SELECT vec_id FROM embeddings)", 50)

QUERIES = {
    "dense_topk": (dense_topk, _ranked(DENSE_SQL.format(expr=COSINE, where=""))),
    "dense_topk_filtered": (dense_topk_filtered, _ranked(DENSE_SQL.format(expr=COSINE, where="AND v.label = 1"), 5)),
    "score_threshold_search": (score_threshold_search, _ranked("SELECT * FROM (" + DENSE_SQL.format(expr=COSINE, where="") + ") WHERE score >= 0.3", 20)),
    "dot_topk": (dot_topk, _ranked(DENSE_SQL.format(expr=DOT, where=""))),
    "euclid_topk": (euclid_topk, _ranked(DENSE_SQL.format(expr=EUCLID, where=""), 10, "ASC")),
    "bm25_doc_freq": (bm25_doc_freq, f"SELECT term, count(*) AS df FROM (SELECT unnest(list_distinct({TOKENS_SQL.format('text')})) AS term FROM documents) GROUP BY term"),
    "bm25_corpus_stats": (bm25_corpus_stats, f"""WITH t AS (SELECT {TOKENS_SQL.format('text')} AS w FROM documents)
SELECT count(*) AS corpus_size, round(avg(len(w)), 6) AS avg_tokens, min(len(w)) AS min_tokens, max(len(w)) AS max_tokens, (SELECT count(DISTINCT x) FROM (SELECT unnest(w) AS x FROM t)) AS vocabulary FROM t"""),
    "bm25_vocabulary_index": (bm25_vocabulary_index, f"SELECT term, row_number() OVER (ORDER BY term) - 1 AS idx FROM (SELECT DISTINCT unnest({TOKENS_SQL.format('text')}) AS term FROM documents)"),
    "bm25_sparse_vector": (bm25_sparse_vector, f"""WITH p AS (SELECT doc_id AS id, unnest(list_distinct({TOKENS_SQL.format('text')})) AS term FROM documents),
w AS (SELECT term, round(greatest(0.0, ln(((SELECT count(*) FROM documents) - count(*) + 0.5) / (count(*) + 0.5))), 6) AS weight FROM p GROUP BY term)
SELECT id, count(*) AS terms, CAST(sum(CAST(weight AS DECIMAL(18,6))) AS DOUBLE) AS weight_sum FROM p JOIN w USING (term) GROUP BY id"""),
    "keyword_topk": (keyword_topk, keyword_sql(DOCS, ITEMS, 50)),
    "hybrid_rrf": (hybrid_rrf, f"""WITH a AS ({_dense50}), b AS ({_sparse50}),
s AS (SELECT query_id, id, round(coalesce(0.5 / (60 + a.rank), 0) + coalesce(0.5 / (60 + b.rank), 0), 6) AS score FROM a FULL JOIN b USING (query_id, id))
{_ranked('SELECT * FROM s')}"""),
    "unified_search_union": (unified_search_union, f"""WITH c AS ({keyword_sql(DOCS, ITEMS, 10)}), t AS ({keyword_sql('SELECT conv_id * 1000 + turn AS id, text FROM conversations', ITEMS, 10)}),
u AS (SELECT query_id, 'code' AS leg, id, score FROM c UNION ALL SELECT query_id, 'chat', id, score FROM t)
SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, leg || id::VARCHAR) AS INTEGER) AS rank FROM u QUALIFY rank <= 10"""),
    "entity_type_filter_search": (entity_type_filter_search, keyword_sql(DOCS + " WHERE lang IN ('en', 'de')", ITEMS, 5)),
    "retrieval_metrics": (retrieval_metrics, f"""WITH f AS ({_ranked(DENSE_SQL.format(expr=COSINE, where=''))}),
r AS (SELECT q.vec_id AS query_id, v.vec_id AS id FROM embeddings q JOIN embeddings v ON q.label = v.label WHERE q.vec_id % 100 = 0),
h AS (SELECT f.query_id, f.rank, (r.id IS NOT NULL)::INT AS hit FROM f LEFT JOIN r ON f.query_id = r.query_id AND f.id = r.id),
s AS (SELECT *, sum(hit) OVER (PARTITION BY query_id ORDER BY rank) AS seen FROM h),
e AS (SELECT query_id, sum(hit) AS hits, min(CASE WHEN hit = 1 THEN rank END) AS first, sum(CASE WHEN hit = 1 THEN seen / rank ELSE 0 END) AS precisions, sum(CASE WHEN hit = 1 THEN 1 / log2(rank + 1) ELSE 0 END) AS dcg FROM s GROUP BY query_id),
t AS (SELECT query_id, count(*) AS total FROM r GROUP BY query_id),
x AS (SELECT t.*, e.* EXCLUDE (query_id), list_sum(list_transform(range(1, least(total, 10) + 1), lambda i: 1 / log2(i + 1))) AS ideal FROM t LEFT JOIN e USING (query_id))
SELECT count(*) AS queries, round(avg(coalesce(hits / total, 0)), 6) AS recall, round(avg(coalesce(hits / 10, 0)), 6) AS precision, round(avg(coalesce(1 / first, 0)), 6) AS mrr,
       round(avg(coalesce(precisions / least(total, 10), 0)), 6) AS map, round(avg(coalesce(dcg / ideal, 0)), 6) AS ndcg FROM x"""),
    "tokenized_texts": (tokenized_texts, f"SELECT doc_id AS id, len({TOKENS_SQL.format('text')}) AS n_tokens, sha256(array_to_string({TOKENS_SQL.format('text')}, ' ')) AS tokens_sha256 FROM documents"),
}
