"""Queries of this subpackage and their DuckDB SQL, by name."""

from __future__ import annotations

from lumenframe.llm import ann, conversations, license_scan, mixing, mixing_lm, near_dedup, packing, pii, quality_model, quality_rules, resample, secret_scan, substring_dedup

QUERIES = {
    "op1_ordinal_quality": quality_model.op1_ordinal_quality,
    "op2_context_mixing_lm": mixing_lm.op2_context_mixing_lm,
    "op3_simhash_dedup": near_dedup.op3_simhash_dedup,
    "op4_secret_scan": secret_scan.op4_secret_scan,
    "op5_license_scan": license_scan.op5_license_scan,
    "op6_prefix_forest": ann.op6_prefix_forest,
    "op7_contextual_pii": pii.op7_contextual_pii,
    "op8_sum_of_squares_packing": packing.op8_sum_of_squares_packing,
    "op9_quality_rules": quality_rules.op9_quality_rules,
    "op10_pfair_mix": mixing.op10_pfair_mix,
    "op11_importance_resampling": resample.op11_importance_resampling,
    "op12_conversation_repair": conversations.op12_conversation_repair,
    "op13_substring_dedup": substring_dedup.op13_substring_dedup,
}
SQL = {
    "op5_license_scan": license_scan.OP5_SQL,
    "op9_quality_rules": quality_rules.OP9_SQL,
    "op11_importance_resampling": resample.OP11_SQL,
    "op12_conversation_repair": conversations.OP12_SQL,
    "op13_substring_dedup": substring_dedup.OP13_SQL,
}
