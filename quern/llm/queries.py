"""Queries of the training-data operators, with the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from quern.llm import bpe, decontaminate, html, quality, secrets, sharding, simhash, suffix, tokenids, toxicity


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_suffix_dedup": suffix.op1,
        "op2_quality_rules": quality.op2,
        "op3_bpe": bpe.op3,
        "op4_secrets": secrets.op4,
        "op5_html_extract": html.op5,
        "op6_simhash": simhash.op6,
        "op7_decontaminate": decontaminate.op7,
        "op8_sharding": sharding.op8,
        "op9_toxicity": toxicity.op9,
        "op10_token_ids": tokenids.op10,
    }


def oracle_sql() -> dict[str, str]:
    return {"op2_quality_rules": quality.ORACLE, "op7_decontaminate": decontaminate.ORACLE}
