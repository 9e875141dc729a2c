"""The queries of this subpackage and their DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import decontamination, exact_dedup, line_dedup, ngram_join, packing, pii, sharding, substring_dedup, tokens, toxicity


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    """One entry per operator, over its whole table with production parameters."""
    return {
        "op1_sharding": sharding.op1,
        "op2_tokens": tokens.op2,
        "op3_packing": packing.op3,
        "op4_ngram_jaccard": ngram_join.op4,
        "op5_toxicity": toxicity.op5,
        "op6_line_dedup": line_dedup.op6,
        "op7_exact_dedup": exact_dedup.op7,
        "op8_decontamination": decontamination.op8,
        "op9_pii": pii.op9,
        "op10_substring_dedup": substring_dedup.op10,
    }


def oracle_sql() -> dict[str, str]:
    """DuckDB SQL for those that SQL can express."""
    return {"op7_exact_dedup": exact_dedup.OP7_SQL}
