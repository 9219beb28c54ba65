"""The training-data queries and, where SQL can express one, its DuckDB twin."""

from __future__ import annotations

from . import decontaminate, html_extract, near_dedup, packing, pii, sharding, suffix_dedup, toxicity, url_filter, vptree

QUERIES = {
    "op1_feistel_sharding": sharding.op1_feistel_sharding,
    "op2_wildcard_automaton": url_filter.op2_wildcard_automaton,
    "op3_candidate_boosting": pii.op3_candidate_boosting,
    "op4_concatenate_and_cut": packing.op4_concatenate_and_cut,
    "op5_wrapper_induction": html_extract.op5_wrapper_induction,
    "op6_hamming_join": near_dedup.op6_hamming_join,
    "op7_fm_index": decontaminate.op7_fm_index,
    "op8_naive_bayes_ngrams": toxicity.op8_naive_bayes_ngrams,
    "op9_vantage_points": vptree.op9_vantage_points,
    "op10_difference_cover": suffix_dedup.op10_difference_cover,
}

ORACLE_SQL = {
    "op1_feistel_sharding": sharding.OP1_SQL,
    "op6_hamming_join": near_dedup.OP6_SQL,
    "op7_fm_index": decontaminate.OP7_SQL,
    "op10_difference_cover": suffix_dedup.OP10_SQL,
    "op2_wildcard_automaton": url_filter.OP2_SQL,
    "op9_vantage_points": vptree.OP9_SQL,
}
