"""Hashes, JSON numbers and seeded draws."""

from __future__ import annotations

import json
import math

import numpy as np
from pyspark.sql import functions as F

from aerolake.functions import encoding


def fnv(data: bytes) -> int:
    h = 2166136261
    for b in data:
        h = (h ^ b) * 16777619 % 2**32
    return h


def test_fnv1a(spark):
    texts = ["", "a", "foobar", "Größe 東京", "x" * 3000]
    got = {r.t: r.h for r in spark.createDataFrame([(t,) for t in [*texts, None]], "t string").select("t", encoding.fnv1a(F.col("t")).alias("h")).collect()}
    assert got == {t: fnv(t.encode()) for t in texts} | {None: None}
    assert got["foobar"] == 0xBF9CF968 and got["a"] == 0xE40C292C


def test_json_numbers(spark):
    values = [1.5, -0.0, 1e300, float("inf"), float("-inf"), float("nan"), None]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v double").withColumn("j", encoding.json_number(F.col("v"))).withColumn("b", encoding.from_json_number(F.col("j")))
    rows = df.orderBy("i").collect()
    assert [json.loads(r.j) for r in rows] == [1.5, 0.0, 1e300, "Infinity", "-Infinity", None, None]
    assert [r.b for r in rows] == [1.5, 0.0, 1e300, math.inf, -math.inf, None, None]


def test_draws(spark):
    df = spark.range(20000).select("id", encoding.uniform(F.lit(7), F.col("id")).alias("u"), encoding.normal(F.lit(7), F.col("id")).alias("n"))
    a, b = df.toPandas(), df.repartition(7).toPandas().sort_values("id")
    assert (a.u.to_numpy() == b.u.to_numpy()).all() and a.u.min() >= 0 and a.u.max() < 1 and abs(a.u.mean() - 0.5) < 0.01
    assert abs(a.n.mean()) < 0.03 and abs(a.n.std() - 1) < 0.03 and np.isfinite(a.n).all()
    assert abs((a.n.abs() < 1.96).mean() - 0.95) < 0.01
    other = spark.range(100).select(encoding.uniform(F.lit(8), F.col("id")).alias("u")).toPandas().u
    assert not (other.to_numpy() == a.u.to_numpy()[:100]).any()
