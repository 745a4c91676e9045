"""Names of the corpus queries and their oracle SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

import corpus_pipeline
from skyweave.llm import op1_tokens, op2_quality, op3_decontam, op4_capjoin, op5_minhash, op6_pii, op7_toxicity, op8_mixing, op9_html, op10_substrings, op11_codes, op12_order


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_token_ids": op1_tokens.query,
        "op2_rule_quality": op2_quality.query,
        "op3_qgram_decontam": op3_decontam.query,
        "op4_cap_join": op4_capjoin.query,
        "op5_minhash_components": op5_minhash.query,
        "op6_weak_pii": op6_pii.query,
        "op7_toxic_segments": op7_toxicity.query,
        "op8_entropy_mix": op8_mixing.query,
        "op9_html_text": op9_html.query,
        "op10_suffix_dedup": op10_substrings.query,
        "op11_elkan_codes": op11_codes.query,
        "op12_order_minhash": op12_order.query,
        "pipeline": corpus_pipeline.run,
    }


def oracle_sql() -> dict[str, str]:
    return {"op11_elkan_codes": op11_codes.oracle()}
