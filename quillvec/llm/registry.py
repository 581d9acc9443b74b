"""Registered queries of the corpus operators and, where SQL can express them, their SQL twins."""

from __future__ import annotations

from quillvec.llm import fuzzy_fingerprints, language_id, mixing, near_dedup, pii_crf, quality_classifier, quality_rules, secret_scan, sentencepiece, url_filter


def queries():
    return {
        "op1_source_mixing": mixing.query,
        "op2_minmax_dedup": near_dedup.query,
        "op3_sentencepiece": sentencepiece.query,
        "op4_quality_rules": quality_rules.query,
        "op5_language_id": language_id.query,
        "op6_pii_crf": pii_crf.query,
        "op7_secret_scan": secret_scan.query,
        "op8_fuzzy_fingerprints": fuzzy_fingerprints.query,
        "op9_url_filter": url_filter.query,
        "op10_quality_classifier": quality_classifier.query,
    }


def oracle_sql():
    return {"op1_source_mixing": mixing.SQL, "op4_quality_rules": quality_rules.SQL, "op9_url_filter": url_filter.sql()}
