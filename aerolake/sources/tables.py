"""Scans of long and wide series with explicit schemas."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

LONG = "t_utc_end timestamp, station int, param string, value double, unit string, validated tinyint"
WIDE = "t_utc_end timestamp, u10 double, wd10 double, blh double, t2 double, cc double, sw double"
#: Times of the files, as "2025-03-30T01:00Z", seconds allowed.
STAMP = "yyyy-MM-dd'T'HH:mm[:ss]XXX"
DAILY = "date_local date, station int, param string, value double, unit string, validated tinyint"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def long_csv(spark: SparkSession, path: str) -> DataFrame:
    """Long measurements; sentinels (-900 and less) become NULL, NaN too."""
    raw = spark.read.schema(LONG).option("header", True).option("timestampFormat", STAMP).csv(path)
    return raw.withColumn("value", F.when((F.col("value") > -900) & ~F.isnan("value"), F.col("value")))


def wide_csv(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(WIDE).option("header", True).option("timestampFormat", STAMP).option("nullValue", "").csv(path)


def station_json(spark: SparkSession, path: str) -> DataFrame:
    """Export-service rows (t, v, unit) of both shapes: flat, or below ``Podatak``."""
    fields = "vrijednost string, mjernaJedinica string, vrijeme string"
    raw = spark.read.schema(f"{fields}, Podatak struct<{fields.replace(' string', ':string')}>").option("multiLine", True).json(path)
    get = lambda n: F.coalesce(F.col(n), F.col(f"Podatak.{n}"))
    at = get("vrijeme")
    t = F.when(at.rlike("^[0-9]+$"), F.timestamp_millis(F.expr("try_cast(coalesce(vrijeme, Podatak.vrijeme) as bigint)"))).otherwise(F.try_to_timestamp(at))
    v = F.expr("try_cast(replace(coalesce(vrijednost, Podatak.vrijednost), ',', '.') as double)")
    return raw.select(t.alias("t"), F.when(v > -900, v).alias("v"), get("mjernaJedinica").alias("unit"))


def hourly_json(spark: SparkSession, path: str, variables: list[str]) -> DataFrame:
    """Weather documents: parallel arrays under ``hourly`` become rows."""
    inner = ", ".join(["time:array<string>", *(f"{v}:array<double>" for v in variables)])
    raw = spark.read.schema(f"hourly struct<{inner}>").option("multiLine", True).json(path)
    return raw.select(F.inline(F.arrays_zip(*(F.col(f"hourly.{v}") for v in ["time", *variables])))).withColumn("time", F.to_timestamp("time", "yyyy-MM-dd'T'HH:mm"))


def missing(spark: SparkSession, path: str) -> bool:
    """Whether nothing is at a path, by Hadoop's file system, so that any store works."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return not at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)


def daily_csv(spark: SparkSession, path: str) -> DataFrame:
    """Daily reference measurements; a missing file has no rows."""
    if missing(spark, path):
        return spark.createDataFrame([], DAILY)
    return spark.read.schema(DAILY).option("header", True).csv(path)


def between(rows: DataFrame, since: str, until: str) -> DataFrame:
    """Rows of ``t_utc_end`` from since to until, both included; the bounds reach the scan."""
    return rows.filter(F.col("t_utc_end").between(F.to_timestamp(F.lit(since)), F.to_timestamp(F.lit(until))))


def array_json(spark: SparkSession, path: str) -> DataFrame:
    """(t, v) of a document with parallel arrays ``t_ms`` and ``v``; sentinels and nulls are left out."""
    raw = spark.read.schema("t_ms array<bigint>, v array<double>").option("multiLine", True).json(path)
    rows = raw.select(F.inline(F.arrays_zip("t_ms", "v"))).filter(F.col("v") > -900)
    return rows.select(F.timestamp_millis("t_ms").alias("t"), "v")


def stations(rows: DataFrame, names: dict[int, str]) -> DataFrame:
    """(key, t, v, validated) of long rows of the known stations, key being name and parameter; other stations are skipped."""
    dimension = rows.sparkSession.createDataFrame(sorted(names.items()), "station int, name string")
    met = rows.join(F.broadcast(dimension), "station")  # a row a station
    return met.select(F.concat_ws(".", "name", "param").alias("key"), F.col("t_utc_end").cast("timestamp_ntz").alias("t"), F.col("value").alias("v"), "validated")
