"""Queries over the training-text tables, for the entry module."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession

from . import (
    decontamination,
    license_scan,
    ngram_join,
    oracles,
    pii,
    quality_classifier,
    quality_rules,
    secret_scan,
    source_mixing,
    substring_dedup,
    toxicity,
)
from .shipping import ship

Query = Callable[[SparkSession, str], DataFrame]

_QUERIES: list[Query] = [
    source_mixing.op1_source_mixing,
    quality_rules.op2_quality_rules,
    pii.op3_pii_surrogates,
    license_scan.op4_license_scan,
    substring_dedup.op5_substring_dedup,
    quality_classifier.op6_quality_classifier,
    ngram_join.op7_ngram_join,
    toxicity.op8_toxicity,
    decontamination.op9_benchmark_decontamination,
    secret_scan.op10_secret_scan,
]


def _shipped(query: Query) -> Query:
    @wraps(query)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        ship(spark)
        return query(spark, sf_dir)

    return run


def queries() -> dict[str, Query]:
    return {q.__name__: _shipped(q) for q in _QUERIES}


def oracle_sql() -> dict[str, str]:
    return oracles.oracle_sql()
