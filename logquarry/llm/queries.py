"""The queries of the corpus operators and their DuckDB SQL."""

from __future__ import annotations

from logquarry.llm import (
    alignment,
    cost_packing,
    divergence,
    exact_dedup,
    merge_dropout,
    near_dedup,
    packing,
    quality,
    secret_scans,
    substring_dedup,
    token_counts,
    token_records,
    topk_search,
)

QUERIES = {
    "op1_topk_search": topk_search.op1_topk_search,
    "op2_best_fit_packing": packing.op2_best_fit_packing,
    "op3_substring_dedup": substring_dedup.op3_substring_dedup,
    "op4_merge_dropout": merge_dropout.op4_merge_dropout,
    "op5_near_dedup": near_dedup.op5_near_dedup,
    "op6_quality_classifier": quality.op6_quality_classifier,
    "op7_exact_dedup": exact_dedup.op7_exact_dedup,
    "op8_token_records": token_records.op8_token_records,
    "op9_token_counts": token_counts.op9_token_counts,
    "op10_secret_scans": secret_scans.op10_secret_scans,
    "op11_divergence_audit": divergence.op11_divergence_audit,
    "op12_alignment": alignment.op12_alignment,
    "op13_cost_packing": cost_packing.op13_cost_packing,
}

SQL = {
    "op1_topk_search": topk_search.OP1_SQL,
    "op3_substring_dedup": substring_dedup.OP3_SQL,
    "op7_exact_dedup": exact_dedup.OP7_SQL,
    "op11_divergence_audit": divergence.OP11_SQL,
}
