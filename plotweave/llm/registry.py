"""Queries of this package and the SQL that states them, where SQL can."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from plotweave.llm import decontam, lines, lm, minhash, mixing, quality, sharding, simhash, tokens, toxicity

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_benchmark_decontamination": decontam.query,
    "op2_source_mixing": mixing.query,
    "op3_lm_scoring": lm.query,
    "op4_quality_classifier": quality.query,
    "op5_simhash_near_dedup": simhash.query,
    "op6_document_fingerprints": minhash.query,
    "op7_toxicity": toxicity.query,
    "op8_line_dedup": lines.query,
    "op9_token_output": tokens.query,
    "op10_sharding": sharding.query,
}
SQL: dict[str, str] = {
    "op2_source_mixing": mixing.SQL,
}
