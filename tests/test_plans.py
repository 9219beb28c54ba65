"""Physical plans: filters and columns reach the scan, nothing runs row by row in Python, no Cartesian product."""

import pytest

from lorestone.queries import QUERIES

RUN_JOBS = {"stream_debounce", "index_pipeline", "graph_cleanup"}
ONE_ROW = {  # beside one row of totals
    "bm25_corpus_stats", "bm25_sparse_vector", "keyword_topk", "unified_search_union", "entity_type_filter_search", "search_similar_chunks", "cache_eviction", "inactive_conversations",
    "hybrid_rrf", "search_modes", "chat_search", "metadata_keywords",
}


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", sorted(set(QUERIES) - RUN_JOBS))
def test_plan(spark, sf, name):
    text = plan(QUERIES[name](spark, sf))
    assert "CartesianProduct" not in text
    assert "BatchEvalPython" not in text
    if name not in ONE_ROW:
        assert "BroadcastNestedLoopJoin" not in text


def test_pushdown(spark, sf):
    text = plan(QUERIES["payload_filter"](spark, sf))
    assert "EqualTo(o_orderstatus,F), EqualTo(o_orderp" in text  # Spark shortens the rest
    assert "ReadSchema: struct<o_orderkey:bigint,o_custkey:bigint,o_orderstatus:string,o_orderpriority:string>" in text


def test_pruning(spark, sf):
    assert "ReadSchema: struct<event_type:string,ts:timestamp_ntz>" in plan(QUERIES["high_water_mark"](spark, sf)).replace("struct<ts:timestamp_ntz,event_type:string>", "struct<event_type:string,ts:timestamp_ntz>")


def test_top_k_is_partial(spark, sf):
    assert plan(QUERIES["dense_topk"](spark, sf)).count("WindowGroupLimit") == 2
