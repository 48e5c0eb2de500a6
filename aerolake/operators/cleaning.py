"""Cleaning of long series (key, t, v) and rules on what comes first."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Plausible ranges of station measurements by parameter; other parameters are never filtered.
PLAUSIBLE = {"ws": (0.0, 40.0), "wd": (0.0, 360.0), "t": (-40.0, 50.0), "rh": (0.0, 100.5)}
STATIONS = ("z1", "z4")


def is_plausible(key: Column, v: Column) -> Column:
    """False for a station's value outside its parameter's range (bounds count as inside)."""
    out = F.lit(False)
    for name, (low, high) in PLAUSIBLE.items():
        out = out | (F.split_part(key, F.lit("."), F.lit(2)).eqNullSafe(name) & ~v.between(low, high))
    return ~(F.split_part(key, F.lit("."), F.lit(1)).isin(*STATIONS) & out)


def plausible(series: DataFrame) -> DataFrame:
    """The series without a station's implausible values."""
    return series.filter(is_plausible(F.col("key"), F.col("v")))


def without_sentinels(series: DataFrame, limit: float = -900.0) -> DataFrame:
    """The series without values at or below ``limit``, which stand for missing ones."""
    return series.filter(F.col("v").isNotNull() & (F.col("v") > limit))


def sentinels(series: DataFrame, limit: float = -900.0) -> DataFrame:
    """Rows that are sentinels, by key."""
    return series.groupBy("key").agg(F.count_if(F.col("v") <= limit).alias("sentinels"), F.count("*").alias("n"))


def on_the_hour(series: DataFrame) -> DataFrame:
    """The series; a job that reads a time off the hour fails."""
    whole = F.date_trunc("HOUR", F.col("t").cast("timestamp")) == F.col("t").cast("timestamp")
    return series.withColumn("t", F.when(whole, F.col("t")).otherwise(F.raise_error(F.concat(F.lit("off the hour: "), F.col("t").cast("string")))))


def dropped(series: DataFrame) -> DataFrame:
    """Rows kept and dropped as implausible, by key."""
    good = is_plausible(F.col("key"), F.col("v"))
    return series.groupBy("key").agg(F.count_if(good).alias("kept"), F.count_if(~good).alias("dropped"))


def first_wins(rows: DataFrame, sequence: str, *by: str) -> DataFrame:
    """The row of least ``sequence`` for each key; whole rows travel through one partial aggregate."""
    best = rows.groupBy(*by).agg(F.min_by(F.struct(*(c for c in rows.columns if c not in by)), sequence).alias("_b"))
    return best.select(*by, "_b.*")


def trim_tail(series: DataFrame, *values: str) -> DataFrame:
    """Rows up to the last one that holds any of the values; later ones are all empty."""
    last = series.filter(F.coalesce(*values).isNotNull()).agg(F.max("t").alias("_last"))
    return series.join(F.broadcast(last), F.col("t") <= F.col("_last")).drop("_last")  # one row


def every_kth(series: DataFrame, k: int) -> DataFrame:
    """The first, (k+1)th, (2k+1)th ... row of each key in time order."""
    place = F.row_number().over(Window.partitionBy("key").orderBy("t"))
    return series.withColumn("_n", place).filter(F.col("_n") % k == 1 % k).drop("_n")


def unit_contract(rows: DataFrame, unit: str, expected: str) -> DataFrame:
    """The rows; a job that reads one with another unit fails. The check is part of the plan, so nothing is read twice."""
    return rows.withColumn(unit, F.when(F.col(unit) == expected, F.col(unit)).otherwise(F.raise_error(F.concat(F.lit(f"unit other than {expected}: "), F.coalesce(F.col(unit), F.lit("none"))))))


def packed(series: DataFrame, scale: float, *by: str) -> DataFrame:
    """Values of each group in time order as base64 of little-endian 16-bit integers (halves to even), and how many were clipped. A group holds a period's hours, so it is bounded by the calendar."""
    code = F.when(F.col("v").isNull() | F.isnan("v"), F.lit(-32768)).otherwise(F.greatest(F.lit(-32767), F.least(F.lit(32767), F.rint(F.col("v") / scale))))
    four = F.lpad(F.hex(F.pmod(code.cast("bigint"), F.lit(65536))), 4, "0")
    swapped = F.concat(F.substring(four, 3, 2), F.substring(four, 1, 2))
    ordered = F.array_sort(F.collect_list(F.struct("t", swapped.alias("h"))))
    return series.groupBy(*by).agg(F.count("*").alias("n"), F.count_if(F.abs(F.rint(F.col("v") / scale)) > 32767).alias("clipped"), F.base64(F.unhex(F.array_join(F.transform(ordered, lambda x: x["h"]), ""))).alias("data"))


def unpacked(rows: DataFrame, scale: float, *by: str) -> DataFrame:
    """(by, i, v) from ``data`` of packed."""
    text = F.hex(F.unbase64("data"))
    at = F.sequence(F.lit(0), F.col("n").cast("int") - 1)
    high, low = (lambda i: F.substr(text, i * 4 + 3, F.lit(2))), (lambda i: F.substr(text, i * 4 + 1, F.lit(2)))
    raw = F.transform(at, lambda i: F.conv(F.concat(high(i), low(i)), 16, 10).cast("int"))
    signed = F.transform(raw, lambda c: F.when(c >= 32768, c - 65536).otherwise(c))
    return rows.filter("n > 0").select(*by, F.posexplode(signed).alias("i", "c")).select(*by, "i", F.when(F.col("c") != -32768, F.col("c") * scale).alias("v"))
