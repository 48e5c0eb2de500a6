"""Sinks: written only on change, guarded against loss, and documents of results."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def changed(new: DataFrame, old: DataFrame, *ignored: str) -> bool:
    """Whether the rows differ, order and ``ignored`` columns aside: counts by row content, so repeated rows count."""
    if sorted(new.columns) != sorted(old.columns):
        return True
    names = sorted(set(new.columns) - set(ignored))
    both = new.select(*names, F.lit(1).alias("_s")).unionByName(old.select(*names, F.lit(-1).alias("_s")))
    return not both.groupBy(*names).agg(F.sum("_s").alias("_s")).filter("_s <> 0").isEmpty()


def write_if_changed(spark: SparkSession, new: DataFrame, folder: str, *ignored: str) -> bool:
    """Write Parquet unless the folder holds the same rows already; a new version stands beside the old until it is whole.

    Versions are ``folder/v=N``; readers take the largest N with a _SUCCESS file, so a lost job leaves the last result.
    """
    number = current(spark, folder)
    if number is not None and not changed(new, spark.read.parquet(f"{folder}/v={number}"), *ignored):
        return False
    new.write.mode("overwrite").parquet(f"{folder}/v={0 if number is None else number + 1}")
    return True


def current(spark: SparkSession, folder: str) -> int | None:
    """Number of the last whole version, by Hadoop's file system, so that any store works."""
    jvm = spark._jvm
    path = jvm.org.apache.hadoop.fs.Path(f"{folder}/v=*/_SUCCESS")
    found = path.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(path) or []
    return max((int(f.getPath().getParent().getName().removeprefix("v=")) for f in found), default=None)


def shrinking(new: DataFrame, old: DataFrame, most: int = 48) -> DataFrame:
    """(key, year, source, before, after) of series-years that lose more than ``most`` hours with an unchanged source."""
    count = lambda df, name: df.groupBy("key", "year", "source").agg(F.count("v").alias(name))
    both = count(old, "before").join(count(new, "after"), ["key", "year", "source"], "left").fillna(0, ["after"])
    other = new.select("key", "year", F.col("source").alias("_now")).distinct()
    same = both.join(other, ["key", "year"], "left").filter(F.col("_now").isNull() | (F.col("_now") == F.col("source"))).drop("_now")
    return same.filter(F.col("after") < F.col("before") - most)


def sorted_csv(rows: DataFrame, folder: str, parameters: list[str]) -> None:
    """Gzipped CSV in the order (t, station, place of the parameter; unknown ones last): files in name order are the sorted table."""
    place = F.coalesce(*(F.when(F.col("param") == p, F.lit(i)) for i, p in enumerate(parameters)), F.lit(99))
    rows.orderBy("t", "station", place, "param").write.mode("overwrite").option("header", True).option("compression", "gzip").csv(folder)


def completeness(series: DataFrame, expected: DataFrame) -> DataFrame:
    """(key, year, n, expected, percent), expected: (year, expected) hours."""
    years = series.groupBy("key", "year").agg(F.count("v").alias("n"))
    return years.join(F.broadcast(expected), "year").select("key", "year", "n", "expected", (100 * F.col("n") / F.col("expected")).alias("percent"))  # a row a year


def documents(rows: DataFrame, *by: str) -> DataFrame:
    """One JSON text a group, rows in order; for results that are small by their nature."""
    rest = [c for c in rows.columns if c not in by]
    return rows.groupBy(*by).agg(F.to_json(F.array_sort(F.collect_list(F.struct(*rest)))).alias("json"))
