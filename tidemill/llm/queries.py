"""The queries of this package and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tidemill.llm import audit, chat, decontaminate, doubling, licenses, mixing, neardup, pii, quality, search, suffixes, toxicity, urls

Query = Callable[[SparkSession, str], DataFrame]


def queries() -> dict[str, Query]:
    return {
        "op1_url_templates": urls.op1_url_templates,
        "op2_source_mix": mixing.op2_source_mix,
        "op3_two_stage_suffixes": suffixes.op3_two_stage_suffixes,
        "op4_prefix_jaccard": neardup.op4_prefix_jaccard,
        "op5_quality_rules": quality.op5_quality_rules,
        "op6_kneser_ney_toxicity": toxicity.op6_kneser_ney_toxicity,
        "op7_simhash_windows": decontaminate.op7_simhash_windows,
        "op8_feistel_pii": pii.op8_feistel_pii,
        "op9_level_doubling": doubling.op9_level_doubling,
        "op10_chat_format": chat.op10_chat_format,
        "op11_filter_audit": audit.op11_filter_audit,
        "op12_license_signatures": licenses.op12_license_signatures,
        "op13_threshold_search": search.op13_threshold_search,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op10_chat_format": chat.OP10_SQL,
        "op11_filter_audit": audit.OP11_SQL,
        "op12_license_signatures": licenses.OP12_SQL,
        "op13_threshold_search": search.OP13_SQL,
    }
