"""Queries of the subpackage over the given tables, and oracle SQL where SQL can say them."""

from __future__ import annotations

from siterank.llm import (
    ann, exact_dedup, length_buckets, lm_scoring, near_dedup, packing, piece_ids, quality, ranked_search, span_dedup, token_alignment, token_file, toxicity,
)

QUERIES = {
    "op1_ann": ann.op1_ann,
    "op2_token_file": token_file.op2_token_file,
    "op3_packing": packing.op3_packing,
    "op4_sentencepiece": piece_ids.op4_sentencepiece,
    "op5_near_dedup": near_dedup.op5_near_dedup,
    "op6_toxicity": toxicity.op6_toxicity,
    "op7_exact_dedup": exact_dedup.op7_exact_dedup,
    "op8_span_dedup": span_dedup.op8_span_dedup,
    "op9_lm_scoring": lm_scoring.op9_lm_scoring,
    "op10_quality": quality.op10_quality,
    "op11_ranked_search": ranked_search.op11_ranked_search,
    "op12_token_alignment": token_alignment.op12_token_alignment,
    "op13_length_buckets": length_buckets.op13_length_buckets,
}

ORACLES = {
    "op7_exact_dedup": exact_dedup.OP7_SQL,
    "op11_ranked_search": ranked_search.OP11_SQL,
}
