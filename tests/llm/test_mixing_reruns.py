"""Reruns of the mix agree to the last bit, however rows are dealt; what cannot converge is reported."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from aerolake.llm import mixing


def sizes_table(spark, parts: int):
    r = random.Random(3)
    rows = [(s, r.randrange(1, 400), r.randrange(1, 30)) for s in ("a", "b", None) for _ in range(200)]
    return spark.createDataFrame(rows, "source string, size long, n long").groupBy("source", "size").agg(F.sum("n").alias("n")).repartition(parts, F.rand(parts))


def solved(spark, parts: int, **options):
    sizes = sizes_table(spark, parts)
    sources = sizes.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("source_size"), F.sum("n").alias("n_docs"))
    return {r.source: (r.target, r.lam) for r in mixing.solve_multipliers(sizes, mixing.source_targets(sources), **options).collect()}


def test_multipliers_are_bit_equal(spark):
    assert solved(spark, 1) == solved(spark, 7) == solved(spark, 3)


def test_no_convergence_is_an_error(spark):
    with pytest.raises(ArithmeticError):
        solved(spark, 1, steps=1)


def test_extra_columns_of_equal_rows(spark):
    """Rows that differ in further columns only: which of them are copied does not depend on how rows are dealt."""
    rows = [(1, "w " * 30, "web", i) for i in range(7)] + [(i, "w " * i, "books", 0) for i in range(2, 20)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, extra int")
    runs = [sorted(map(tuple, mixing.apply_mix(docs.repartition(p)).collect())) for p in (1, 5)]
    assert runs[0] == runs[1]
