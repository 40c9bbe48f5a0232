"""The queries of this subpackage, by name, and the SQL of those that SQL can express."""

from __future__ import annotations

from . import exact_dedup, licenses, mixing, ngram_join, packing, quality, sharding, substring, tokens, warc

QUERIES = {
    "op1_substring_dedup": substring.op1,
    "op2_token_counts": tokens.op2,
    "op3_best_fit_packing": packing.op3,
    "op4_warc": warc.op4,
    "op5_sharding": sharding.op5,
    "op6_quality_rules": quality.op6,
    "op7_source_mixing": mixing.op7,
    "op8_license_scan": licenses.op8,
    "op9_ngram_jaccard_join": ngram_join.op9,
    "op10_exact_dedup": exact_dedup.op10,
}

ORACLES = {
    "op1_substring_dedup": substring.SQL,
    "op4_warc": warc.SQL,
    "op5_sharding": sharding.SQL,
    "op6_quality_rules": quality.SQL,
    "op9_ngram_jaccard_join": ngram_join.SQL,
    "op10_exact_dedup": exact_dedup.SQL,
}
