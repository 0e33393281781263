"""The queries of this subpackage and the SQL of those that SQL can express."""

from __future__ import annotations

from strataloom.llm import chat_format, exact_dedup, language_id, lexical_search, license_scan, near_dedup, packing, quality_rules, source_mix, substring_dedup, suffix_dedup, token_counts, turn_repair

QUERIES = {
    "op1_substring_dedup": substring_dedup.query,
    "op2_token_counts": token_counts.query,
    "op3_license_scan": license_scan.query,
    "op4_near_dedup": near_dedup.query,
    "op5_source_mix": source_mix.query,
    "op6_quality_rules": quality_rules.query,
    "op7_packing": packing.query,
    "op8_language_id": language_id.query,
    "op9_chat_format": chat_format.query,
    "op10_exact_dedup": exact_dedup.query,
    "op11_turn_repair": turn_repair.query,
    "op12_suffix_dedup": suffix_dedup.query,
    "op13_lexical_search": lexical_search.query,
}

ORACLES = {
    "op4_near_dedup": near_dedup.ORACLE,
    "op5_source_mix": source_mix.ORACLE,
    "op6_quality_rules": quality_rules.ORACLE,
    "op9_chat_format": chat_format.ORACLE,
    "op10_exact_dedup": exact_dedup.ORACLE,
    "op13_lexical_search": lexical_search.ORACLE,
}
