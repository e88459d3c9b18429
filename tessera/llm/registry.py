"""Queries of this subpackage and, where SQL can express them, their DuckDB text."""

from __future__ import annotations

from . import classifier, decontaminate, jaccard, licenses, mixing, oracles, quality_rules, quotes, suffix_dedup, tokens, warc

QUERIES = {
    "op1_quality_rules": quality_rules.op1_quality_rules,
    "op2_warc": warc.op2_warc,
    "op3_mixing": mixing.op3_mixing,
    "op4_license_scan": licenses.op4_license_scan,
    "op5_quality_classifier": classifier.op5_quality_classifier,
    "op6_quotation_linking": quotes.op6_quotation_linking,
    "op7_suffix_dedup": suffix_dedup.op7_suffix_dedup,
    "op8_jaccard_join": jaccard.op8_jaccard_join,
    "op9_token_output": tokens.op9_token_output,
    "op10_decontamination": decontaminate.op10_decontamination,
}
ORACLES = oracles.ORACLES
