"""Registered queries of the training-data operators, and SQL where it can say the same."""

from __future__ import annotations

from textloom.llm import decontamination, fill_middle, language_id, mixing, ngram_join, periodic_runs, quality, secret_scan, sharding, substring_dedup, suffix_array_dedup, token_output, toxicity

QUERIES = {
    "op1_token_output": token_output.op1_token_output,
    "op2_sharding": sharding.op2_sharding,
    "op3_toxicity": toxicity.op3_toxicity,
    "op4_language_id": language_id.op4_language_id,
    "op5_mixing": mixing.op5_mixing,
    "op6_substring_dedup": substring_dedup.op6_substring_dedup,
    "op7_ngram_join": ngram_join.op7_ngram_join,
    "op8_suffix_array_dedup": suffix_array_dedup.op8_suffix_array_dedup,
    "op9_decontamination": decontamination.op9_decontamination,
    "op10_quality_rules": quality.op10_quality_rules,
    "op11_fill_middle": fill_middle.op11_fill_middle,
    "op12_periodic_runs": periodic_runs.op12_periodic_runs,
    "op13_secret_scan": secret_scan.op13_secret_scan,
}

ORACLE_SQL = {
    "op5_mixing": mixing.OP5_SQL,
    "op6_substring_dedup": substring_dedup.OP6_SQL,
    "op7_ngram_join": ngram_join.OP7_SQL,
    "op11_fill_middle": fill_middle.OP11_SQL,
    "op13_secret_scan": secret_scan.OP13_SQL,
}
