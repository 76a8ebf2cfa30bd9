"""Queries and SQL of the training-data operators and of the pipeline."""

from __future__ import annotations

import corpus_pipeline

from . import ann, clustering, decontaminate, jaccard_join, language_id, license_scan, merkle, mixing, quality, suffix_dedup, token_output, url_filter, warc


def queries() -> dict:
    return {
        "op1_license_scan": license_scan.op1_license_scan,
        "op2_mixing": mixing.op2_mixing,
        "op3_warc": warc.op3_warc,
        "op4_language_id": language_id.op4_language_id,
        "op5_decontaminate": decontaminate.op5_decontaminate,
        "op6_jaccard_join": jaccard_join.op6_jaccard_join,
        "op7_ann": ann.op7_ann,
        "op8_suffix_dedup": suffix_dedup.op8_suffix_dedup,
        "op9_token_output": token_output.op9_token_output,
        "op10_url_filter": url_filter.op10_url_filter,
        "op11_merkle": merkle.op11_merkle,
        "op12_clustering": clustering.op12_clustering,
        "op13_quality": quality.op13_quality,
        "pipeline": corpus_pipeline.run,
    }


def oracle_sql() -> dict[str, str]:
    """Where SQL can express a query; the others are held against brute force in the tests."""
    return {
        "op1_license_scan": license_scan.OP1_SQL,
        "op2_mixing": mixing.OP2_SQL,
        "op3_warc": warc.OP3_SQL,
        "op6_jaccard_join": jaccard_join.OP6_SQL,
        "op10_url_filter": url_filter.OP10_SQL,
        "op11_merkle": merkle.OP11_SQL,
        "op12_clustering": clustering.OP12_SQL,
    }
