"""Sinks, holidays and contracts on small tables."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from aerolake.functions import calendar, weather
from aerolake.operators import cleaning
from aerolake.sources import sinks


def test_write_if_changed(spark, tmp_path):
    folder = str(tmp_path / "out")
    a = spark.createDataFrame([(1, "x"), (1, "x"), (2, None)], "k int, s string").withColumn("made", F.lit(1))
    assert sinks.write_if_changed(spark, a, folder, "made")
    assert not sinks.write_if_changed(spark, a.withColumn("made", F.lit(2)), folder, "made")
    assert sinks.write_if_changed(spark, a.distinct(), folder, "made")  # a repeated row counts
    assert sinks.current(spark, folder) == 1
    assert spark.read.parquet(f"{folder}/v=1").count() == 2


def test_easter(spark):
    from dateutil.easter import easter

    got = spark.range(1900, 2100).select("id", calendar.easter(F.col("id").cast("int")).alias("e")).collect()
    assert all(r.e == easter(r.id) for r in got)


def test_holidays(spark):
    days = [dt.date(2025, 4, 21), dt.date(2025, 6, 19), dt.date(2025, 4, 20), dt.date(2025, 4, 22), dt.date(2025, 5, 30)]
    rows = spark.createDataFrame([(d,) for d in days], "d date").select(calendar.day_type_with_holidays(F.col("d")).alias("t")).collect()
    assert [r.t for r in rows] == ["sunday", "sunday", "sunday", "weekday", "sunday"]


def test_hours_in_year(spark):
    got = spark.createDataFrame([(2024,), (2025,)], "y int").select(calendar.hours_in_local_year(F.col("y")).alias("h")).collect()
    assert [r.h for r in got] == [8784, 8760]


def test_unit_contract(spark):
    good = spark.createDataFrame([("m", 1.0)], "unit string, v double")
    assert cleaning.unit_contract(good, "unit", "m").count() == 1
    with pytest.raises(Exception, match="unit other than m"):
        cleaning.unit_contract(spark.createDataFrame([("km", 1.0)], "unit string, v double"), "unit", "m").collect()


def test_packed_missing_and_extremes(spark):
    values = [None, 0.0, -0.1, 1e9, -1e9, float("nan"), 12.34]
    rows = spark.createDataFrame([("a", i, v) for i, v in enumerate(values)], "key string, t int, v double")
    back = cleaning.unpacked(cleaning.packed(rows, 0.1, "key"), 0.1, "key").orderBy("i").collect()
    assert [None if r.v is None else round(r.v, 6) for r in back] == [None, 0.0, -0.1, 3276.7, -3276.7, None, 12.3]


def test_stability_cases(spark):
    cases = [(1.0, 1000.0, None, "A"), (5.5, 700.0, None, "C"), (7.0, 1000.0, 0.0, "C"), (None, 500.0, 0.0, "D"), (1.0, 0.0, 96.0, "D"), (1.0, None, 20.0, "F"), (2.0, 0.0, None, "E"), (4.0, 0.0, 20.0, "E"), (9.0, 0.0, 20.0, "D")]
    rows = spark.createDataFrame(cases, "u double, s double, c double, want string").select("want", weather.stability(F.col("u"), F.col("s"), F.col("c")).alias("got")).collect()
    assert [r.got for r in rows] == [r.want for r in rows]


def test_sorted_csv(spark, tmp_path):
    rows = spark.createDataFrame([(2, 1, "so2"), (1, 2, "zz"), (1, 2, "no2"), (1, 1, "no")], "t int, station int, param string")
    sinks.sorted_csv(rows, str(tmp_path / "c"), ["no", "no2", "so2"])
    got = spark.read.option("header", True).csv(str(tmp_path / "c"))
    assert sorted((r.t, r.station, r.param) for r in got.collect()) == [("1", "1", "no"), ("1", "2", "no2"), ("1", "2", "zz"), ("2", "1", "so2")]
