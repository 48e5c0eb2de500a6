"""Statistics of hourly series (key, t, v) over a whole archive, on the local calendar of the hours' starts.

``document`` joins all sections into one long table (section, key, part, n, v): part names the year, hour, month or sector.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from aerolake.functions import weather
from aerolake.functions.calendar import local_midnight, local_start
from aerolake.functions.dimensions import EXCEEDANCES
from aerolake.operators import series as ops
from aerolake.sources.intermediate import materialise

Rule = tuple[str, str, str, float]


def increments(series: DataFrame, first: str, second: str, parameters: Iterable[str]) -> DataFrame:
    """Series ``inc.<parameter>``: first station less second where both have the hour."""
    names = F.split_part(F.col("key"), F.lit("."), F.lit(1)), F.split_part(F.col("key"), F.lit("."), F.lit(2))
    rows = series.select(names[0].alias("station"), names[1].alias("p"), "t", "v").filter(F.col("station").isin(first, second) & F.col("p").isin(*parameters))
    both = rows.groupBy("p", "t").agg(F.max(F.when(F.col("station") == first, F.col("v"))).alias("a"), F.max(F.when(F.col("station") == second, F.col("v"))).alias("b"))
    return both.dropna(subset=["a", "b"]).select(F.concat(F.lit("inc."), "p").alias("key"), "t", (F.col("a") - F.col("b")).alias("v"))


def rose(series: DataFrame, wind: DataFrame) -> DataFrame:
    """(key, sector, n, v): mean by sector of the wind (t, direction, u); -1 for calms and hours without direction; hours without speed are in none."""
    met = series.join(wind, "t").withColumn("sector", weather.rose_sector(F.col("direction"), F.col("u")))
    return ops.profile(met.filter(F.col("sector").isNotNull()), F.col("sector"))


def exceedances(series: DataFrame, rules: Iterable[Rule] = EXCEEDANCES, days: DataFrame | None = None) -> DataFrame:
    """(rule, year, n, valid): hours or valid local days strictly above each rule's limit, by local year; years without any stay.

    ``series`` has the pollutant as key; ``days`` (key, day, v) replaces its own daily means, for a reference method.
    """
    rules = list(rules)

    def against(rows: DataFrame, basis: str, year: Column) -> DataFrame:
        of = F.array_compact(F.array(*(F.when(F.col("key") == p, F.struct(F.lit(name).alias("rule"), F.lit(limit).alias("limit"))) for name, p, b, limit in rules if b == basis)))
        each = rows.filter(F.col("v").isNotNull()).select("v", year.alias("year"), F.explode(of).alias("r"))
        return each.groupBy("r.rule", "year").agg(F.count_if(F.col("v") > F.col("r.limit")).alias("n"), F.count("*").alias("valid"))

    parts = []
    if any(b == "1h" for *_, b, _ in rules) and days is None:
        parts.append(against(series, "1h", F.year(local_start(F.col("t")))))
    if any(b == "24h" for *_, b, _ in rules):
        parts.append(against(ops.daily_valid(series) if days is None else days, "24h", F.year("day")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def last_hour(series: DataFrame) -> DataFrame:
    """One row: ``last``, the latest time of any series, and ``today``, its local day."""
    return series.agg(F.max("t").alias("last")).withColumn("today", F.to_date(local_start(F.col("last"))))


def _hours(since: Column, until: Column) -> Column:
    return F.floor((F.unix_timestamp(until.cast("timestamp")) - F.unix_timestamp(since)) / 3600)


def coverage(series: DataFrame, period_start: str) -> DataFrame:
    """(key, n, percent) of the hours after local midnight of ``period_start`` up to the last hour of any series."""
    lo = local_midnight(F.lit(period_start).cast("date"))
    last = last_hour(series).select("last", F.greatest(F.lit(1), _hours(lo, F.col("last"))).alias("hours"))
    inside = series.filter(F.col("v").isNotNull() & (F.col("t").cast("timestamp") > lo)).groupBy("key").agg(F.count("*").alias("n"))
    every = series.select("key").distinct().join(inside, "key", "left").join(F.broadcast(last), F.lit(True))  # one row
    return every.select("key", F.coalesce("n", F.lit(0)).alias("n"), (100.0 * F.coalesce("n", F.lit(0)) / F.col("hours")).alias("percent"))


def year_to_date(series: DataFrame) -> DataFrame:
    """(key, year, n, v, percent): mean and coverage of the running local year, up to the last hour of any series."""
    last = last_hour(series).select(F.year("today").alias("year"), F.col("last"))
    last = last.withColumn("hours", _hours(local_midnight(F.make_date("year", F.lit(1), F.lit(1))), F.col("last")))
    rows = series.join(F.broadcast(last), F.lit(True)).filter(F.col("v").isNotNull() & (F.year(local_start(F.col("t"))) == F.col("year")))  # one row
    out = rows.groupBy("key", "year", "hours").agg(F.count("*").alias("n"), F.avg("v").alias("v"))
    return out.select("key", "year", "n", "v", F.when(F.col("hours") > 0, 100.0 * F.col("n") / F.col("hours")).otherwise(0.0).alias("percent"))


def annual(series: DataFrame) -> DataFrame:
    """``series.annual`` with the last ended local year of the table as the last full one."""
    last = last_hour(series).select((F.year("today") - 1).alias("_full"))
    rows = ops.annual(series, 9999).join(F.broadcast(last), F.lit(True))  # one row
    return rows.select("key", "year", "n", "coverage", F.when(F.col("year") <= F.col("_full"), F.col("v")).alias("v"))


def latest_increment(yearly: DataFrame, leading: str) -> DataFrame:
    """(key, year, v): the annual increments of the latest year in which the ``leading`` one is valid."""
    year = yearly.filter((F.col("key") == leading) & F.col("v").isNotNull()).agg(F.max("year").alias("year"))
    return yearly.join(F.broadcast(year), "year").filter(F.col("key").startswith("inc.") & F.col("v").isNotNull()).select("key", "year", "v")  # one row


def document(series: DataFrame, wind: DataFrame, period_start: str, first: str, second: str, parameters: Iterable[str]) -> DataFrame:
    """All statistics of an archive as (section, key, part, n, v). The archive is read once; its hourly table, increments added, serves all sections."""
    series = materialise(series, "series")
    own = materialise(series.unionByName(increments(series, first, second, parameters)), "archive")
    wind = materialise(wind, "wind")
    station = series.filter(F.col("key").startswith(f"{first}.")).select(F.split_part(F.col("key"), F.lit("."), F.lit(2)).alias("key"), "t", "v")
    yearly, to_date = materialise(annual(own), "yearly"), materialise(year_to_date(own), "to-date")
    part = lambda *c: F.concat_ws(" ", *(F.col(x).cast("string") if isinstance(x, str) else x for x in c))
    row = lambda df, section, p, n="n", v="v": df.select(F.lit(section).alias("section"), F.col("key"), p.alias("part"), F.col(n).cast("bigint").alias("n"), F.col(v).cast("double").alias("v"))
    over = exceedances(station).withColumnRenamed("rule", "key")
    sections = [
        row(yearly.filter("v is not null"), "annual", part("year")),
        row(yearly, "coverage by year", part("year"), v="coverage"),
        row(ops.diurnal(own), "diurnal", part("daytype", "hour")),
        row(ops.monthly(own), "monthly", part("month")),
        row(rose(own, wind), "rose", part("sector")),
        row(over.withColumn("v", F.col("n").cast("double")), "exceedances", part("year"), n="valid"),
        row(coverage(own, period_start), "coverage", F.lit("period"), v="percent"),
        row(to_date, "year to date", part("year")),
        row(to_date, "coverage to date", part("year"), v="percent"),
        row(latest_increment(yearly, "inc.nox").withColumn("n", F.lit(1)), "increment", part("year")),
        row(ops.latest(own).withColumn("n", F.lit(1)), "latest", F.date_format("t", "yyyy-MM-dd HH:mm")),
    ]
    out = sections[0]
    for s in sections[1:]:
        out = out.unionByName(s)
    return out
