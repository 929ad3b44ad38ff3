"""The queries of this package and their SQL, for the driver's entry module."""

from __future__ import annotations

from . import decontaminate, jaccard, language, nearest, packing, quality, secrets, substrings, token_store, url_rules

QUERIES = {
    "op1_best_fit_packing": packing.op1_best_fit_packing,
    "op10_secrets": secrets.op10_secrets,
    "op2_language": language.op2_language,
    "op3_ngram_jaccard": jaccard.op3_ngram_jaccard,
    "op4_nearest": nearest.op4_nearest,
    "op5_substring_dedup": substrings.op5_substring_dedup,
    "op6_quality": quality.op6_quality,
    "op7_token_store": token_store.op7_token_store,
    "op8_url_rules": url_rules.op8_url_rules,
    "op9_decontamination": decontaminate.op9_decontamination,
}

ORACLE_SQL = {"op3_ngram_jaccard": jaccard.OP3_SQL, "op5_substring_dedup": substrings.OP5_SQL, "op8_url_rules": url_rules.OP8_SQL}
