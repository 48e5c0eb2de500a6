"""Operators on long series (key, t, v), t being the end of the hour in UTC: v is the mean from an hour before t up to t.

Calendar columns (hour, day type, day, month, year) are those of the hour's start in local time. One pass of partial aggregation each.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from aerolake.functions.calendar import day_type, hours_in_local_year, local_start
from aerolake.functions.dimensions import MIN_DAY_HOURS, MIN_YEAR_SHARE


def hourly(raw: DataFrame, key: str, t: str, v: str) -> DataFrame:
    """(key, t, v): mean of each key and hour; a reading on the hour opens the next one."""
    hour = (F.date_trunc("HOUR", F.col(t)) + F.expr("INTERVAL 1 HOUR")).cast("timestamp_ntz")
    return raw.groupBy(F.col(key).alias("key"), hour.alias("t")).agg(F.avg(v).alias("v"))


def paired_increment(series: DataFrame, a: str, b: str) -> DataFrame:
    """(t, inc, u): a - b where both have the hour, by one conditional aggregate instead of a self-join."""
    both = series.filter(F.col("key").isin(a, b)).groupBy("t").agg(F.max(F.when(F.col("key") == a, F.col("v"))).alias("u"), F.max(F.when(F.col("key") == b, F.col("v"))).alias("w"))
    return both.dropna(subset=["u", "w"]).select("t", (F.col("u") - F.col("w")).alias("inc"), "u")


def gap_fill(series: DataFrame) -> DataFrame:
    """Every hour of the common range for every key; missing values are NULL. Each key makes its own hours."""
    span = series.agg(F.min("t").alias("a"), F.max("t").alias("b"))
    keys = series.select("key").distinct().join(F.broadcast(span), F.lit(True))  # one row
    grid = keys.select("key", F.explode(F.sequence("a", "b", F.expr("INTERVAL 1 HOUR"))).alias("t"))
    return grid.join(series, ["key", "t"], "left")


def hour_ending_pair(series: DataFrame) -> DataFrame:
    """Mean of an hour and the hour before; hours without the one before have no row."""
    order = Window.partitionBy("key").orderBy("t")
    before, at = F.lag("v").over(order), F.lag("t").over(order)
    return series.withColumn("p", before).withColumn("at", at).filter(F.col("at") == F.col("t") - F.expr("INTERVAL 1 HOUR")).select("key", "t", ((F.col("p") + F.col("v")) / 2).alias("v"))


def trailing_mean(series: DataFrame, hours: int, least: int) -> DataFrame:
    """Mean of the last hours up to each row, where at least ``least`` are present."""
    seconds = F.unix_timestamp(F.col("t").cast("timestamp"))
    frame = Window.partitionBy("key").orderBy("s").rangeBetween(-(hours - 1) * 3600, 0)
    out = series.withColumn("s", seconds)
    return out.select("key", "t", F.avg("v").over(frame).alias("v"), F.count("v").over(frame).alias("n")).filter(F.col("n") >= least)


def _step(series: DataFrame) -> Column:
    seconds = F.unix_timestamp(F.col("t").cast("timestamp"))
    return (seconds - F.lag(seconds).over(Window.partitionBy("key").orderBy("t"))) / 3600


def gap_breaks(series: DataFrame, hours: int) -> DataFrame:
    """Rows after a step longer than ``hours``, with the step."""
    return series.select("key", "t", _step(series).cast("bigint").alias("hours")).filter(F.col("hours") > hours)


def with_breaks(series: DataFrame, hours: int) -> DataFrame:
    """The series with an empty row half the allowed step after the last value before each longer step, so that lines break there."""
    stepped = series.withColumn("_step", _step(series))
    breaks = stepped.filter(F.col("_step") > hours)
    before = F.timestamp_seconds(F.unix_timestamp(F.col("t").cast("timestamp")) - F.col("_step") * 3600 + hours * 1800).cast("timestamp_ntz")
    return series.unionByName(breaks.select("key", before.alias("t"), F.lit(None).cast("double").alias("v")))


def profile(series: DataFrame, *by: Column) -> DataFrame:
    """Mean and count by key and calendar columns."""
    return series.groupBy("key", *by).agg(F.avg("v").alias("v"), F.count("v").alias("n"))


def local_columns(series: DataFrame, holidays: bool = False) -> DataFrame:
    """The series with ``year``, ``month``, ``hour``, ``day`` and ``daytype`` (holidays as sundays if asked) of the local start of each hour."""
    from aerolake.functions.calendar import day_type_with_holidays

    start = local_start(F.col("t"))
    kind = day_type_with_holidays(F.to_date(start)) if holidays else day_type(start)
    return series.withColumns({"year": F.year(start), "month": F.month(start), "hour": F.hour(start), "day": F.to_date(start), "daytype": kind})


def diurnal(series: DataFrame) -> DataFrame:
    """Mean by day type and hour of the local start."""
    return profile(local_columns(series), F.col("daytype"), F.col("hour"))


def monthly(series: DataFrame) -> DataFrame:
    """Mean by month of the local start, years pooled."""
    return profile(local_columns(series), F.col("month"))


def daily_valid(series: DataFrame, least: int = MIN_DAY_HOURS) -> DataFrame:
    """Means of local days with at least ``least`` hours."""
    return profile(local_columns(series), F.col("day")).filter(F.col("n") >= least)


def paired_daily(series: DataFrame, a: str, b: str, least: int = MIN_DAY_HOURS) -> DataFrame:
    """(day, n, a, b): local-day means of both series over the hours that both have, for days with ``least`` such hours."""
    pairs = paired_increment(series, a, b).select("t", F.col("u").alias("a"), (F.col("u") - F.col("inc")).alias("b"))
    days = local_columns(pairs).groupBy("day").agg(F.count("*").alias("n"), F.avg("a").alias("a"), F.avg("b").alias("b"))
    return days.filter(F.col("n") >= least)


def latest(series: DataFrame) -> DataFrame:
    return series.groupBy("key").agg(F.max("t").alias("t"), F.max_by("v", "t").alias("v"))


def validated_over_raw(rows: DataFrame, *period: str) -> DataFrame:
    """All rows of the chosen source of each (key, period): validated (1) if it has half of the raw rows at least, else raw (0).

    The choice is made from counts, a row a period, which go back to the rows.
    """
    by = ["key", *period]
    n1, n0 = F.count_if(F.col("validated") == 1), F.count_if(F.col("validated") == 0)
    chosen = rows.groupBy(*by).agg(F.when((n1 > 0) & (n1 >= 0.5 * n0), 1).otherwise(0).alias("validated"))
    return rows.join(chosen, [*by, "validated"], "left_semi")


def chang_hanna(pairs: DataFrame, floor: float, *by: str) -> DataFrame:
    """Scores of (o, p): bias, errors and correlation from raw values; ratios and logs from values clipped at ``floor``."""
    o, p = F.col("o"), F.col("p")
    co, cp = F.greatest(o, F.lit(floor)), F.greatest(p, F.lit(floor))
    sums = pairs.dropna(subset=["o", "p"]).groupBy(*by).agg(
        F.count("*").alias("n"), F.avg("o").alias("mo"), F.avg("p").alias("mp"), F.avg((o - p) * (o - p)).alias("mse"), F.avg(F.abs(o - p)).alias("mae"),
        F.avg(F.when((cp / co >= 0.5) & (cp / co <= 2), 1.0).otherwise(0.0)).alias("fac2"), F.avg(F.ln(co) - F.ln(cp)).alias("l"),
        F.avg(F.pow(F.ln(co) - F.ln(cp), F.lit(2.0))).alias("l2"), F.covar_pop("o", "p").alias("c"), F.stddev_pop("o").alias("so"), F.stddev_pop("p").alias("sp"),
    )
    ratio = lambda a, b: a / F.nullif(b, F.lit(0.0))
    return sums.select(
        *by, "n", ratio(2 * (F.col("mo") - F.col("mp")), F.col("mo") + F.col("mp")).alias("fb"), ratio(F.col("mse"), F.col("mo") * F.col("mp")).alias("nmse"), F.sqrt("mse").alias("rmse"),
        "fac2", F.exp("l").alias("mg"), F.exp("l2").alias("vg"), ratio(F.col("mae"), F.col("mo") + F.col("mp")).alias("nad"), ratio(F.col("c"), F.col("so") * F.col("sp")).alias("r"),
    )


def annual(series: DataFrame, last_year: int | Column, least: float = MIN_YEAR_SHARE) -> DataFrame:
    """(key, year, n, coverage, v) by the local year of the hour's start; v only for years up to last_year with coverage ``least``."""
    years = series.groupBy("key", F.year(local_start(F.col("t"))).alias("year")).agg(F.count("v").alias("n"), F.avg("v").alias("m"))
    share = F.col("n") / hours_in_local_year(F.col("year"))
    return years.select("key", "year", "n", (100 * share).alias("coverage"), F.when((F.col("year") <= F.lit(last_year)) & (share >= least), F.col("m")).alias("v"))


def now(series: DataFrame, stale_after: int = 6, hours: int = 24, least: int = 18) -> DataFrame:
    """(key, t, v, mean, stale): last value, mean of the hours up to it if enough, and whether it is older than the newest of all keys by more than stale_after hours."""
    known = series.dropna(subset=["v"])
    last = known.groupBy("key").agg(F.max("t").alias("last"), F.max_by("v", "t").alias("lv"))
    newest = last.agg(F.max("last").alias("newest"))
    recent = known.join(last, "key").filter(F.col("t") > F.col("last") - F.expr(f"INTERVAL {hours} HOURS"))
    means = recent.groupBy("key", "last", "lv").agg(F.avg("v").alias("m"), F.count("*").alias("n")).join(F.broadcast(newest), F.lit(True))  # one row
    return means.select("key", F.col("last").alias("t"), F.col("lv").alias("v"), F.when(F.col("n") >= least, F.col("m")).alias("mean"), (F.col("last") < F.col("newest") - F.expr(f"INTERVAL {stale_after} HOURS")).alias("stale"))
