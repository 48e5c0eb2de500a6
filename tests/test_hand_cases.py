"""Cases worked out by hand at boundaries: clock changes, limits, calms, halves, missing values."""

from __future__ import annotations

import datetime as dt

import pytest
from pyspark.sql import functions as F

from aerolake.functions import calendar, chemistry, emissions, places, weather
from aerolake.operators import series, statistics, summaries


def value(spark, c):
    return spark.range(1).select(c.alias("x")).first().x


def at(text):
    return F.to_timestamp(F.lit(text))


@pytest.mark.parametrize(
    ("end", "local"),
    [
        ("2025-01-01 00:00:00", (2025, 1, 0)),  # 00:00 UTC ends the local hour that starts at 00:00
        ("2024-12-31 23:00:00", (2024, 12, 23)),  # the hour from 23:00 local belongs to the old year
        ("2025-03-30 01:00:00", (2025, 3, 1)),  # last hour of winter time
        ("2025-03-30 02:00:00", (2025, 3, 3)),  # 02:00 local is left out
        ("2025-10-26 01:00:00", (2025, 10, 2)),  # 02:00 local twice
        ("2025-10-26 02:00:00", (2025, 10, 2)),
    ],
)
def test_local_start(spark, end, local):
    s = calendar.local_start(at(end))
    row = spark.range(1).select(F.year(s), F.month(s), F.hour(s)).first()
    assert tuple(row) == local


def test_local_days(spark):
    days = [value(spark, calendar.hours_in_local_day(F.lit(d).cast("date"))) for d in ("2025-03-30", "2025-10-26", "2025-06-01")]
    assert days == [23, 25, 24]
    assert value(spark, calendar.last_sunday(F.lit(2025), 3)) == dt.date(2025, 3, 30)
    assert value(spark, calendar.from_local(F.lit("2025-01-01").cast("date"), F.lit(24))) == dt.datetime(2025, 1, 1, 23)
    assert value(spark, calendar.from_local(F.lit("2025-03-30").cast("date"), F.lit(2))) is None
    assert value(spark, calendar.utc_month(at("2025-02-01 00:00:00"))) == 202501


def test_index_limits(spark):
    level = lambda p, v, s="european": value(spark, chemistry.index_level(F.lit(p), F.lit(v).cast("double"), s))
    assert [level("no2", v) for v in (10.0, 10.1, 100.0, 150.0, 150.1)] == [1, 2, 4, 5, 6]
    assert [level("pm10", 20.0, "national"), level("pm10", 20.5, "national"), level("co", 1.0), level("no2", None)] == [1, 2, 0, 0]
    assert value(spark, chemistry.band(F.lit(10.0), (10.0, 25.0))) == 2
    assert value(spark, chemistry.index_colour(F.lit(6))) == "#7D2181" and value(spark, chemistry.index_colour(F.lit(0))) == "#6F6F6F"


def test_wind(spark):
    none = F.lit(None).cast("double")
    uniform = [1 / 16] * 16
    for d, u in ((none, F.lit(3.0)), (F.lit(90.0), none), (F.lit(90.0), F.lit(0.4))):
        assert value(spark, weather.direction_weights(d, u)) == uniform
    w = value(spark, weather.direction_weights(F.lit(90.0), F.lit(4.0)))
    assert max(range(16), key=w.__getitem__) == 4 and abs(w[3] / w[4] - 2.718281828459045**-0.5) < 1e-12
    assert value(spark, weather.rose_sector(F.lit(90.0), none)) is None
    assert value(spark, weather.rose_sector(none, F.lit(3.0))) == -1
    assert value(spark, weather.sector(F.lit(11.25))) == 1 and value(spark, weather.sector(F.lit(348.75))) == 0


def test_halves_to_even(spark):
    assert [value(spark, summaries.packed_int16(F.lit(v), 1.0)) for v in (0.5, 1.5, 2.5, -0.5, 40000.0)] == [0, 2, 2, 0, 32767]
    assert [value(spark, calendar.half_even(F.lit(v), 1)) for v in (0.25, 0.75, -0.25)] == [0.2, 0.8, -0.2]


def test_indicator(spark):
    """One pair of 200 against 100 ug/m3 of NO2: doubt is 0.24 * 200 for a measurement at the reference value."""
    df = spark.createDataFrame([(200.0, 100.0)], "o double, p double")
    assert abs(df.agg(chemistry.quality_indicator(F.col("o"), F.col("p"), "no2").alias("x")).first().x - 100 / (2 * 0.24 * 200)) < 1e-12


def test_chemistry_keeps_nitrogen_and_oxidant(spark):
    out = chemistry.no2_scheme(F.lit(50.0), F.lit(16.0), F.lit(24.0), F.lit(54.0), F.lit(60.0), F.lit(0.004), F.lit(4e-4))
    row = spark.range(1).select(*(c.alias(k) for k, c in out.items())).first()
    p = chemistry.PPB
    assert abs(row.nox - 74.0) < 1e-9 and abs(row.no2 / p["no2"] + row.no / p["no"] - 74.0 / p["no2"]) < 1e-9
    assert abs(row.no2 / p["no2"] + row.o3 / p["o3"] - row.ox) < 1e-9
    still = chemistry.no2_scheme(F.lit(0.0), F.lit(16.0), F.lit(24.0), F.lit(54.0), F.lit(0.0), F.lit(0.004), F.lit(4e-4))
    assert abs(value(spark, still["no2"]) - 16.0) < 1e-9
    assert abs(chemistry.PPB["o3"] - 1.99534) < 1e-4


def test_traffic(spark):
    """A holiday Thursday (1 May 2025) runs like a Sunday; mean factors are 1."""
    assert abs(sum(emissions.DAY_FACTORS) / 7 - 1) < 1e-12 and abs(sum(emissions.HOUR_SHARES["weekday"]) - 1) < 1e-12
    t = at("2025-05-01 08:00:00")  # local 09:00 to 10:00
    want = 24 * emissions.HOUR_SHARES["sunday"][9] * emissions.DAY_FACTORS[6] * emissions.MONTH_FACTORS[4]
    assert abs(value(spark, emissions.traffic_factor(t)) - want) < 1e-12
    calm = emissions.group_strengths("nox", t, {"car_free_b": F.lit(True)}, "auto")
    assert value(spark, calm["B"]) == 0 and value(spark, calm["D"]) == 0 and value(spark, calm["A"]) > 0


def test_eighteen_pairs(spark):
    """17 common hours make no day even if each series has 20."""
    rows = [("a", dt.datetime(2025, 6, 1, h), 1.0) for h in range(0, 20)] + [("b", dt.datetime(2025, 6, 1, h), 0.5) for h in range(3, 23)]
    s = spark.createDataFrame(rows, "key string, t timestamp_ntz, v double")
    assert series.paired_daily(s, "a", "b").count() == 0
    assert series.paired_daily(s, "a", "b", 17).count() == 1


def test_exceedances_keep_years_without_any(spark):
    rows = [("no2", dt.datetime(2024, 12, 31, 22), 250.0), ("no2", dt.datetime(2024, 12, 31, 23), 200.0), ("no2", dt.datetime(2025, 1, 1, 0), 10.0)]
    s = spark.createDataFrame(rows, "key string, t timestamp_ntz, v double")
    got = {(r.rule, r.year): (r.n, r.valid) for r in statistics.exceedances(s).collect()}
    assert got == {("no2_1h_200", 2024): (1, 2), ("no2_1h_200", 2025): (0, 1)}


def test_quantiles_by_bins(spark):
    values = [0.0] * 500 + [float(i) for i in range(101)] + [1e9]
    s = spark.createDataFrame([("k", v) for v in values], "key string, v double")
    import numpy as np

    row = summaries.quantiles(s, "v", [0.1, 0.5, 0.9, 1.0], "key").first()
    assert np.allclose([row.q0, row.q1, row.q2, row.q3], np.quantile(values, [0.1, 0.5, 0.9, 1.0])) and row.n == len(values)


def test_buildings_and_roads(spark):
    tags = lambda **k: F.create_map(*(F.lit(x) for kv in k.items() for x in kv)) if k else F.create_map().cast("map<string,string>")
    of = lambda t, area=200.0: tuple(value(spark, c if not isinstance(c, str) else F.lit(c)) for c in places.building(t, F.lit(area)).values())
    assert of(tags(building="yes", height="12,5 m")) == (12.5, 0.0, "height")
    levels = F.create_map(F.lit("building"), F.lit("yes"), F.lit("building:levels"), F.lit("4"))
    assert of(levels) == (17.5, 0.0, "levels") and of(levels, 50.0) == (12.0, 0.0, "small")
    assert of(tags(building="roof")) == (5.0, 4.0, "type") and of(tags(building="church")) == (18.0, 0.0, "type")
    road = lambda t: tuple(value(spark, c) for c in places.road(t).values())
    assert road(tags(highway="primary", oneway="yes")) == (0, 1, 2, "C", 22500)
    assert road(tags(highway="secondary_link", lanes="1;2")) == (1, 0, 2, "C", 6250)
    assert road(tags(highway="footway")) == (5, 0, 0, None, 0)
