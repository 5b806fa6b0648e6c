"""The queries of this subpackage and, where SQL can express them, their DuckDB SQL."""

from __future__ import annotations

from wayspark.llm import decontamination, hard_negatives, language_id, mixing, pii, quality_classifier, quality_rules, secrets, simhash_dedup, spelling, token_counts, url_filter, warc

QUERIES = {
    "op1_quality_classifier": quality_classifier.op1_quality_classifier,
    "op2_decontamination": decontamination.op2_decontamination,
    "op3_url_filters": url_filter.op3_url_filters,
    "op4_token_counts": token_counts.op4_token_counts,
    "op5_quality_rules": quality_rules.op5_quality_rules,
    "op5_quality_rules_ablation": quality_rules.op5_quality_rules_ablation,
    "op6_language_id": language_id.op6_language_id,
    "op7_simhash_near_dedup": simhash_dedup.op7_simhash_near_dedup,
    "op8_pii": pii.op8_pii,
    "op9_mixing": mixing.op9_mixing,
    "op9_mixing_order": mixing.op9_mixing_order,
    "op10_secret_scans": secrets.op10_secret_scans,
    "op11_spelling_variants": spelling.op11_spelling_variants,
    "op12_hard_negatives": hard_negatives.op12_hard_negatives,
    "op13_warc": warc.op13_warc,
}
ORACLES = {
    "op2_decontamination": decontamination.OP2_SQL,
    "op5_quality_rules": quality_rules.OP5_SQL,
    "op5_quality_rules_ablation": quality_rules.OP5_ABLATION_SQL,
    "op9_mixing": mixing.OP9_SQL,
    "op9_mixing_order": mixing.OP9_ORDER_SQL,
    "op10_secret_scans": secrets.OP10_SQL,
    "op11_spelling_variants": spelling.OP11_SQL,
    "op12_hard_negatives": hard_negatives.OP12_SQL,
    "op13_warc": warc.OP13_SQL,
}
