"""The registered queries of this folder and their SQL."""

from __future__ import annotations

from . import embedding_dedup, jaccard_join, license_scan, metric_search, mixing, packing, quality_crf, quality_rules, suffix_dedup, target_resampling, token_alignment, url_filter, warc

QUERIES = {
    "op1_suffix_dedup": suffix_dedup.query,
    "op2_url_filter": url_filter.query,
    "op3_quality_rules": quality_rules.query,
    "op4_best_fit_packing": packing.query,
    "op5_warc": warc.query,
    "op6_embedding_dedup": embedding_dedup.query,
    "op7_license_scan": license_scan.query,
    "op8_jaccard_join": jaccard_join.query,
    "op9_quality_crf": quality_crf.query,
    "op10_mix_sources": mixing.query,
    "op11_target_resampling": target_resampling.query,
    "op12_token_alignment": token_alignment.query,
    "op13_metric_search": metric_search.query,
}

ORACLE_SQL = {
    "op2_url_filter": url_filter.SQL,
    "op3_quality_rules": quality_rules.SQL,
    "op5_warc": warc.SQL,
    "op7_license_scan": license_scan.SQL,
    "op10_mix_sources": mixing.SQL,
    "op11_target_resampling": target_resampling.SQL,
    "op13_metric_search": metric_search.SQL,
}
