"""Queries of the training-data operators and their SQL equivalents."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from aerolake.llm import ann, bpe, clustering, html_extraction, licenses, mixing, pii, quality, sharding, simhash, spelling, token_files, topk

MODULES = [ann, bpe, clustering, html_extraction, licenses, mixing, pii, quality, sharding, simhash, spelling, token_files, topk]


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for m in MODULES for name, f in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for m in MODULES for name, sql in getattr(m, "ORACLES", {}).items()}
