"""Queries of this subpackage, and the SQL of those that SQL can express."""

from __future__ import annotations

from . import additive_quantiser, jaccard_join, license_scan, quality_rules, secret_scan, source_mix, sst_output, suffix_dedup, url_filter, window_packing

QUERIES = {
    "op1_url_filter": url_filter.query,
    "op2_additive_quantiser": additive_quantiser.query,
    "op3_quality_perplexity": quality_rules.query,
    "op4_source_mix": source_mix.query,
    "op5_sst_output": sst_output.query,
    "op6_license_scan": license_scan.query,
    "op7_jaccard_forest": jaccard_join.query,
    "op8_secret_scan": secret_scan.query,
    "op9_suffix_dedup": suffix_dedup.query,
    "op10_window_packing": window_packing.query,
}

ORACLES: dict[str, str] = {"op1_url_filter": url_filter.SQL, "op4_source_mix": source_mix.SQL}
