"""The queries of this package, by the names under which the entry module registers them."""

from __future__ import annotations

from recordloom.llm import bpe, decontamination, minhash_dedup, quality_rules, quality_vote, secret_scan, token_counts, token_files, url_filter, warc

QUERIES = {
    "op1_quality_rules": quality_rules.query,
    "op2_url_filter": url_filter.query,
    "op3_token_files": token_files.query,
    "op4_decontamination": decontamination.query,
    "op5_warc": warc.query,
    "op6_bpe": bpe.query,
    "op7_token_counts": token_counts.query,
    "op8_secret_scan": secret_scan.query,
    "op9_quality_vote": quality_vote.query,
    "op10_minhash_dedup": minhash_dedup.query,
    "quality_rule_ablation": quality_rules.ablation_query,
    "quality_policy_report": quality_rules.report_query,
}

ORACLE_SQL = {
    "op1_quality_rules": quality_rules.SQL,
    "op2_url_filter": url_filter.SQL,
    "op5_warc": warc.SQL,
    "quality_rule_ablation": quality_rules.ABLATION_SQL,
    "quality_policy_report": quality_rules.REPORT_SQL,
}
