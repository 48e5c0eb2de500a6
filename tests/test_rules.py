"""Small rules worked out by hand: the cascade of responses, parameters by source, places in a series, sampling, documents, formulas."""

from __future__ import annotations

import datetime as dt
import json
import math
import random

import pytest
from pyspark.sql import functions as F

from aerolake.functions import places, weather
from aerolake.operators import cleaning, lookups, receptor, summaries
from aerolake.sources import sinks


def value(spark, **columns):
    return spark.range(1).select(*(c.alias(n) for n, c in columns.items())).first()


def arrays(*rows):
    return [F.array(*(F.lit(x).cast("double") for x in r)) for r in rows]


def test_carried_over(spark):
    """By ratio where today's share is real, else by difference, scaled, not under zero; missing counts as nothing."""
    table, scenario, today = arrays((10, 4, 6, None), (5, 3, 0.1, 2), (10, 1, 0.2, 0))
    got = value(spark, x=receptor.carried_over(table, scenario, today)).x
    scale = 20 / 11.2
    assert list(got) == pytest.approx([10 * 5 / 10, 4 * 3 / 1, max(0, 6 + (0.1 - 0.2) * scale), 2 * scale])
    table, scenario, today = arrays((1, 1), (0, 5), (0, 0))
    assert list(value(spark, x=receptor.carried_over(table, scenario, today)).x) == [1.0, 6.0]  # nothing today: scale 1
    table, scenario, today = arrays((1, 100), (0, 50), (4, 100))
    assert list(value(spark, x=receptor.carried_over(table, scenario, today)).x)[0] == pytest.approx(max(0, 1 - 4 * 101 / 104))


def test_responses_cascade(spark):
    """Every source in turn, for the scenario and for today."""
    side = lambda rows: spark.createDataFrame(rows, "direction double, grp string, gamma array<double>")
    fields = spark.createDataFrame(
        [
            ("trees", "g10", 0.0, "D", [1.0]),  # the table's grid
            ("trees", "g5", 22.5, "D", [6.0]), ("today", "g5", 22.5, "D", [3.0]),  # another grid, with today's of the same
            ("trees", "g5", 45.0, "D", [7.0]), ("today", "g7", 45.0, "D", [3.0]),  # another grid, without
            ("trees", "g5", 67.5, "D", [8.0]),  # no row in the table
            ("today", "g10", 90.0, "D", [9.0]),  # only today's, on the table's grid
            ("today", "g5", 112.5, "D", [9.5]),  # only today's, elsewhere
        ],
        "scenario string, grid string, direction double, grp string, gamma array<double>",
    )
    every = [22.5 * k for k in range(8)]
    table = side([(d, "D", [10.0]) for d in every if d not in (67.5, 135.0, 157.5)])
    last = side([(135.0, "D", [0.5])])
    directions = spark.createDataFrame([(d, "D") for d in every], "direction double, grp string")
    got = {r.direction: (None if r.gamma is None else r.gamma[0], r.source) for r in receptor.responses(directions, fields, table, last, "trees", "g10").collect()}
    assert got == {0.0: (1.0, "field"), 22.5: (20.0, "field"), 45.0: (7.0, "field"), 67.5: (8.0, "field"), 90.0: (9.0, "field"), 112.5: (10.0, "table"), 135.0: (0.5, "fallback"), 157.5: (None, None)}
    today = {r.direction: (None if r.gamma is None else r.gamma[0], r.source) for r in receptor.responses(directions, fields, table, last, "today", "g10").collect()}
    assert today[90.0] == (9.0, "field") and today[22.5] == (10.0, "table") and today[112.5] == (10.0, "table") and today[135.0] == (0.5, "fallback")


@pytest.mark.parametrize(
    ("calibrated", "grids", "want"),
    [
        (True, (None, None), {"fallback": (1.3, 1.2, "calibrated"), "table": (2.0, 1.9, "calibrated")}),
        (True, ("a", "a"), {"fallback": (1.3, 1.2, "calibrated"), "table": (2.0, 1.9, "calibrated")}),
        (True, ("a", "b"), {"fallback": (1.3, 1.2, "calibrated"), "table": (1.0, 1.4, "uncalibrated")}),
        (False, (None, None), {"fallback": (1.0, 1.4, "raw"), "table": (1.0, 1.4, "raw")}),
    ],
)
def test_parameters_by_source(spark, calibrated, grids, want):
    beta, u0, status = receptor.calibration(F.col("s"), {"plume": (1.3, 1.2), "flow": (2.0, 1.9)}, calibrated, *grids)
    rows = spark.createDataFrame([("fallback",), ("table",)], "s string").select("s", beta.alias("b"), u0.alias("u"), status.alias("t")).collect()
    assert {r.s: (r.b, r.u, r.t) for r in rows} == want


def test_hours(spark):
    t = lambda s: F.lit(s).cast("timestamp_ntz")
    at = lambda s: value(spark, i=lookups.hour_index(t(s), t("2024-01-01 00:00:00"), 24)).i
    assert [at(s) for s in ("2024-01-01 00:00:00", "2024-01-01 05:20:00", "2024-01-01 05:40:00", "2024-01-01 23:00:00", "2024-01-02 00:00:00", "2023-12-31 23:00:00")] == [0, 5, 6, 23, -1, -1]
    series = spark.createDataFrame([("a", dt.datetime(2024, 1, 1, 5), 1.0)], "key string, t timestamp_ntz, v double")
    assert cleaning.on_the_hour(series).count() == 1
    with pytest.raises(Exception, match="off the hour"):
        cleaning.on_the_hour(series.withColumn("t", F.col("t") + F.expr("INTERVAL 1 SECOND"))).collect()


def test_sampling_follows_the_weights(spark):
    """Draws fall to the first row whose running share exceeds them; a row without weight is never drawn."""
    weights = spark.createDataFrame([("a", 1, 1.0), ("b", 2, 0.0), ("c", 3, 3.0)], "name string, k int, w double")
    shares = summaries.cumulative_share(weights, "k").select("k", "share")
    r = random.Random(1)
    draws = [0.0, 0.2499, 0.25, 0.999] + [r.random() for _ in range(500)]
    got = {d.r: d.k for d in summaries.sampled(shares, spark.createDataFrame([(x,) for x in draws], "r double"), "k").collect()}
    assert len(got) == len(set(draws)) and all(k == (1 if x < 0.25 else 3) for x, k in got.items())


def test_documents(spark):
    rows = spark.createDataFrame([("x", 2, 1.5), ("x", 1, None), ("y", 1, 0.0)], "key string, n int, v double")
    got = {d.key: json.loads(d.json) for d in sinks.documents(rows, "key").collect()}
    assert got == {"x": [{"n": 1}, {"n": 2, "v": 1.5}], "y": [{"n": 1, "v": 0.0}]}


def test_groups_of_stability(spark):
    """A group is its own group and has its representative's mixing height and Obukhov length."""
    rows = spark.createDataFrame([(c,) for c in ("A", "B", "C", "D", "E", "F", "AC", "EF", "x", None)], "c string")
    c = F.col("c")
    got = {r.c: r for r in rows.select("c", weather.stability_group(c).alias("g"), weather.representative(c).alias("r"), weather.mixing_height(c, F.lit(None).cast("double")).alias("h"), weather.obukhov(c, 0.8).alias("l")).collect()}
    assert {k: v.g for k, v in got.items()} == {"A": "AC", "B": "AC", "C": "AC", "D": "D", "E": "EF", "F": "EF", "AC": "AC", "EF": "EF", "x": "D", None: "D"}
    assert (got["AC"].h, got["B"].h, got["EF"].h, got["x"].h) == (520.0, 520.0, 100.0, 135.0)
    assert got["AC"].l == got["B"].l == pytest.approx(1 / (-0.037 + 0.029 * math.log10(0.5))) and got["EF"].l == got["F"].l > 0 and got["D"].l == math.inf == got["x"].l


def test_vector_mean(spark):
    wind = spark.createDataFrame([(2.0, 350.0), (2.0, 10.0), (5.0, None), (None, 90.0)], "u double, d double")
    speed, bearing, mean, n = weather.vector_mean(F.col("u"), F.col("d"))
    got = wind.agg(speed.alias("s"), bearing.alias("b"), mean.alias("m"), n.alias("n")).first()
    assert got.s == pytest.approx(2 * math.cos(math.radians(10))) and min(got.b, 360 - got.b) < 1e-9 and (got.m, got.n) == (2.0, 2)


def test_formulas(spark):
    got = value(spark, l=places.lerp(F.lit(2.0), F.lit(6.0), F.lit(0.25)), a=places.smoothstep(0.0, 10.0, F.lit(-1.0)), b=places.smoothstep(0.0, 10.0, F.lit(5.0)), c=places.smoothstep(0.0, 10.0, F.lit(20.0)), d=places.smoothstep(0.0, 10.0, F.lit(2.5)))
    assert (got.l, got.a, got.b, got.c) == (3.0, 0.0, 0.5, 1.0) and got.d == pytest.approx(0.15625)
    months = spark.range(1, 13).select(F.col("id").cast("int").alias("m")).select("m", places.month_temperature(F.col("m")).alias("t"), places.heating_month(F.col("m")).alias("h"), places.leaf_month(F.col("m")).alias("f")).collect()
    assert max(months, key=lambda r: r.t).m == 7 and months[0].t == pytest.approx(-0.3) and [r.m for r in months if not r.h] == list(range(4, 10)) and [r.m for r in months if r.f] == list(range(5, 11))


@pytest.mark.parametrize("by", [True, False])
def test_quantiles_with_outliers_and_ties(spark, by):
    """Heavy bins are divided again: outliers of any size, equal values, one value, a lone group."""
    import numpy as np

    r = np.random.default_rng(3)
    groups = {"a": [*r.normal(size=500), 1e12, -1e300, 5e-324], "b": [2.0] * 40, "c": [1.0, 2.0], "d": [*([0.0] * 90), *r.uniform(0, 1e-9, 30), 1e9], "e": [None], "f": [7.0], "h": [-1.7e308, 1.7e308, 0.0, 5e-324, 1e-323]}
    rows = spark.createDataFrame([(g, None if v is None else float(v)) for g, vs in groups.items() for v in vs], "g string, v double").repartition(7)
    shares = [0.0, 0.25, 0.5, 0.997, 1.0]
    got = summaries.quantiles(rows, "v", shares, *(["g"] if by else [])).collect()
    want = groups if by else {None: [v for vs in groups.values() for v in vs]}
    assert len(got) == len([g for g, vs in want.items() if any(v is not None for v in vs)])
    for q in got:
        values = sorted(v for v in want[q.g if by else None] if v is not None)
        assert q.n == len(values)
        for i, s in enumerate(shares):
            at = s * (len(values) - 1)
            low, high = values[math.floor(at)], values[math.ceil(at)]
            if high - low < math.inf:
                assert q[f"q{i}"] == pytest.approx(low + (high - low) * (at - math.floor(at)), rel=1e-12, abs=1e-300)
    assert summaries.quantiles(rows.filter("false"), "v", shares, "g").count() == 0


def test_ranked_over_many_tasks(spark):
    r = random.Random(4)
    rows = [("hot" if r.random() < 0.7 else r.choice("abc"), r.randrange(50), i) for i in range(3000)]
    df = spark.createDataFrame(rows, "g string, x int, id int").repartition(5)
    got = {(p.g, p.id): p.place for p in lookups.ranked(df, "place", ["x", "id"], "g").collect()}
    want: dict = {}
    for g, x, i in sorted(rows):
        want.setdefault(g, []).append(i)
    assert got == {(g, i): n for g, ids in want.items() for n, i in enumerate(ids, 1)}
    assert lookups.ranked(df.filter("false"), "place", ["x", "id"], "g").count() == 0
