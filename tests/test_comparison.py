"""Bias ratios, hindcast, forecast and sector means on small tables."""

from __future__ import annotations

import datetime as dt

import pytest
from pyspark.sql import functions as F

from aerolake.operators import comparison

T0 = dt.datetime(2024, 6, 20)


def at(h: float) -> dt.datetime:
    return T0 + dt.timedelta(hours=h)


def now(spark):
    return F.lit(str(T0)).cast("timestamp_ntz")


def test_bias_ratios(spark):
    """Forty-eight pairs are enough; hours before the window, without a model value or with none above 0, are no pairs."""
    nan = float("nan")
    observed = [(at(-i), 10.0, 20.0 if i != 3 else nan, 50.0, 30.0, None) for i in range(60)] + [(at(-24 * 14), 999.0, 999.0, 999.0, 999.0, 999.0), (at(1), 999.0, 999.0, 999.0, 999.0, 999.0)]
    model = [(at(-i), 5.0 if i < 48 else 0.0, 100.0 if i < 47 else None, nan if i % 2 else 10.0, 1.0) for i in range(60)] + [(at(-24 * 14), 1.0, 1.0, 1.0, 1.0), (at(1), 1.0, 1.0, 1.0, 1.0)]
    o = spark.createDataFrame(observed, "t timestamp_ntz, no2 double, nox double, o3 double, pm10 double, pm25 double")
    m = spark.createDataFrame(model, "t timestamp_ntz, no2 double, o3 double, pm10 double, pm25 double")
    got = {r.pollutant: (r.ratio, r.n, r.source) for r in comparison.bias_ratios(o, m, now(spark)).collect()}
    assert got["no2"] == (2.0, 48, "live") and got["o3"] == (0.86, 47, "default") and got["pm10"] == (1.2, 30, "default") and got["pm25"] == (0.85, 0, "default")
    assert got["nox_no2"] == (2.0, 59, "live")
    background = {r.t: r for r in comparison.corrected(m, comparison.bias_ratios(o, m, now(spark))).collect()}[at(0)]
    assert (background.bg_no2, background.bg_nox, background.bg_o3, background.bg_pm10) == (10.0, 20.0, 86.0, 12.0)
    empty = comparison.bias_ratios(o.filter("false"), m, now(spark)).collect()
    assert {r.source for r in empty} == {"default"} and len(empty) == 5


def test_hindcast(spark):
    measured = spark.createDataFrame([(at(0), 5.0, 0), (at(0), 6.0, 1), (at(-71), 7.0, 0), (at(-72), 8.0, 0), (at(1), 9.0, 1)], "t timestamp_ntz, v double, validated int")
    modelled = spark.createDataFrame([(at(0), 4.0, 1.0), (at(-5), 3.0, 1.0), (at(2), 1.0, 1.0)], "t timestamp_ntz, total double, background double")
    got = {r.t: r for r in comparison.hindcast(measured, modelled, now(spark)).collect()}
    assert sorted(got) == [at(-i) for i in range(71, -1, -1)]
    assert tuple(got[at(0)])[1:] == (5.0, 6.0, 4.0, 1.0, 2.0, 8.0)
    assert tuple(got[at(-71)])[1:] == (7.0, None, None, None, None, None) and got[at(-5)].model == 3.0 and got[at(-6)].raw is None


def test_forecast(spark):
    """Seventy-two hours after now; without measures the scenario is today; the background comes from the model where it reaches."""
    rows = [(at(h), 2.0, 300.0, 0.0, 20.0, [1e-4] * 4, [1e-2] * 4, 77.0) for h in range(-3, 80)]
    hours = spark.createDataFrame(rows, "t timestamp_ntz, u double, sw double, cc double, t2 double, gamma array<double>, age array<double>, bg_pm10 double")
    background = spark.createDataFrame([(at(h), 10.0) for h in range(0, 50)], "t timestamp_ntz, bg_pm10 double")
    same = comparison.forecast(hours, background, now(spark), "pm10", 1.0, 1.4, {}).collect()
    assert sorted(r.t for r in same) == [at(h) for h in range(1, 73)]
    assert all(r.today == r.scenario and r.today > r.background for r in same)
    assert {round(r.background, 9) for r in same if r.t < at(50)} == {10.0} and {round(r.background, 9) for r in same if r.t >= at(50)} == {25.6}
    less = comparison.forecast(hours, background, now(spark), "pm10", 1.0, 1.4, {"traffic": F.lit(50.0)}).collect()
    assert all(r.background < r.scenario < r.today for r in less)


def test_rose_comparison(spark):
    rows = [(10.0, 2.0, 1.0, 4.0), (350.0, 0.1, 3.0, 6.0), (90.0, 2.0, 5.0, None), (90.0, None, 5.0, 1.0), (None, 2.0, 5.0, 1.0), (180.0, 2.0, 2.0, 2.0)]
    hours = spark.createDataFrame(rows, "direction double, u double, m double, o double")
    assert sorted(map(tuple, comparison.rose_comparison(hours, F.col("m"), F.col("o")).collect())) == [(0, 2, 2.0, 5.0), (8, 1, 2.0, 2.0)]
    assert pytest.approx(2.0) == comparison.RATIOS["no2"] + 0.23
