"""Hourly tables for the archive queries, made of the driver's orders and line items, and the SQL that makes the same.

``ledger``: several years of hourly series (key, t, v) of two stations, "road" and "park"; ``weather``: (t, u, direction, sw, cc, t2).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from aerolake.functions.calendar import HOLIDAYS
from aerolake.sources.tables import table

SPREAD, WEATHER_SPREAD = 12, 3
ROAD, PARK = "road", "park"
#: key: SQL of an order's value, and which orders count.
PARTS = {
    "road.nox": ("p / 2000", "true"),
    "road.no2": ("p / 4000 + c % 7", "true"),
    "road.pm10": ("p / 5000 + c % 11", "true"),
    "road.so2": ("p / 1000", "true"),
    "park.nox": ("p / 5000", "c % 2 = 1"),
    "park.no2": ("p / 9000 + c % 5", "c % 2 = 1"),
    "park.o3": ("20 + c % 60", "c % 2 = 1"),
}
SERIES = f"""oo AS (SELECT CAST(o_orderdate AS TIMESTAMP) + to_hours(CAST(o_orderkey % 24 + i + 1 AS BIGINT)) AS t, CAST(o_totalprice AS DOUBLE) AS p, CAST(o_custkey AS BIGINT) AS c FROM orders, range({SPREAD}) r(i)),
s AS (SELECT key, t, avg(v) AS v FROM ({' UNION ALL '.join(f"SELECT '{k}' AS key, t, CAST({v} AS DOUBLE) AS v FROM oo WHERE {w}" for k, (v, w) in PARTS.items())}) GROUP BY 1, 2)"""
WEATHER = f"""ll AS (SELECT CAST(l_shipdate AS TIMESTAMP) + to_hours(CAST(l_orderkey % 24 + i + 1 AS BIGINT)) AS t, CAST(l_quantity AS DOUBLE) AS q, CAST((l_partkey * 37) % 360 AS DOUBLE) AS d, CAST(l_discount AS DOUBLE) AS x, CAST(l_tax AS DOUBLE) AS y, CAST(l_suppkey % 30 AS DOUBLE) AS k FROM lineitem, range({WEATHER_SPREAD}) r(i)),
w AS (SELECT t, avg(q) / 10 AS u, avg(d) AS direction, avg(x) * 8000 AS sw, avg(y) * 1200 AS cc, avg(k) AS t2 FROM ll GROUP BY 1)"""
#: Local start of the hour that ends at t.
LOCAL = "(({0}) - INTERVAL 1 HOUR) AT TIME ZONE 'UTC' AT TIME ZONE 'Europe/Zagreb'"
MIDNIGHT = "(CAST({0} AS TIMESTAMP) AT TIME ZONE 'Europe/Zagreb') AT TIME ZONE 'UTC'"
HOURS_OF_YEAR = f"(epoch({MIDNIGHT.format('make_date(CAST({0} AS INTEGER) + 1, 1, 1)')}) - epoch({MIDNIGHT.format('make_date(CAST({0} AS INTEGER), 1, 1)')})) / 3600"
#: Holidays of 1990 to 2030 as a table ``hol``.
HOLIDAY_TABLE = f"""ya AS (SELECT CAST(y AS INTEGER) AS y, CAST(y // 100 AS INTEGER) AS k FROM range(1990, 2031) r(y)),
yb AS (SELECT *, (15 + k - k // 4 - (8 * k + 13) // 25 + 30) % 30 AS m, (4 + k - k // 4) % 7 AS n FROM ya), yc AS (SELECT *, (19 * (y % 19) + m) % 30 AS a FROM yb),
yd AS (SELECT *, (2 * (y % 4) + 4 * (y % 7) + 6 * a + n) % 7 AS b FROM yc),
ye AS (SELECT y, make_date(y, 3, 22) + CAST(a + b - CASE WHEN (a = 29 AND b = 6) OR (a = 28 AND b = 6 AND y % 19 > 10) THEN 7 ELSE 0 END AS INTEGER) AS easter FROM yd),
hol AS (SELECT CAST(easter + 1 AS DATE) AS d FROM ye UNION SELECT CAST(easter + 60 AS DATE) FROM ye UNION SELECT make_date(y, m, d) FROM ye, (VALUES {', '.join(f'({m}, {d})' for m, d in HOLIDAYS)}) v(m, d))"""
DAYTYPE = "CASE isodow({0}) WHEN 7 THEN 'sunday' WHEN 6 THEN 'saturday' ELSE 'weekday' END"
DAYTYPE_H = "CASE WHEN isodow({0}) = 7 OR CAST({0} AS DATE) IN (SELECT d FROM hol) THEN 'sunday' WHEN isodow({0}) = 6 THEN 'saturday' ELSE 'weekday' END"
SECTOR = "CAST(coalesce(CAST(floor((({0}) % 360 + 11.25) / 22.5) AS BIGINT) % 16, 0) AS INTEGER)"


def _spread(first: Column, hours: int) -> Column:
    """The ends of the ``hours`` hours after ``first``."""
    return F.explode(F.transform(F.sequence(F.lit(1), F.lit(hours)), lambda i: first + F.make_dt_interval(F.lit(0), i)))


def _base(day: str, order: str) -> Column:
    return F.expr(f"CAST({day} AS TIMESTAMP_NTZ) + make_dt_interval(0, CAST({order} % 24 AS INT))")


def ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders are summed by the hour that they start at before they are spread over the hours that follow, so an order is one row and the spread ones are hours."""
    rows = table(spark, sf_dir, "orders").select(_base("o_orderdate", "o_orderkey").alias("b"), F.col("o_totalprice").cast("double").alias("p"), F.col("o_custkey").cast("long").alias("c"))
    value = {k: F.when(F.expr(w), F.expr(v).cast("double")) for k, (v, w) in PARTS.items()}
    counts = {k: F.count_if(F.expr(w)) for k, (_, w) in PARTS.items()}
    sums = rows.groupBy("b").agg(*(f.alias(f"{k}|{n}") for k in PARTS for n, f in (("s", F.sum(value[k])), ("n", F.count(value[k])), ("w", counts[k]))))
    each = F.array(*(F.struct(F.lit(k).alias("key"), *(F.col(f"`{k}|{n}`").alias(n) for n in "snw")) for k in PARTS))
    spread = sums.select(_spread(F.col("b"), SPREAD).alias("t"), F.explode(each).alias("x")).filter("x.w > 0")
    return spread.groupBy("x.key", "t").agg((F.sum("x.s") / F.nullif(F.sum("x.n"), F.lit(0))).alias("v"))


def weather(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items are summed by hour before they are spread, as the ledger's orders are."""
    of = {"q": F.col("l_quantity"), "d": (F.col("l_partkey") * 37) % 360, "x": F.col("l_discount"), "y": F.col("l_tax"), "k": F.col("l_suppkey") % 30}
    rows = table(spark, sf_dir, "lineitem").select(_base("l_shipdate", "l_orderkey").alias("b"), *(c.cast("double").alias(n) for n, c in of.items()))
    sums = rows.groupBy("b").agg(*(f(n).alias(f"{n}_{p}") for n in of for p, f in (("s", F.sum), ("n", F.count))))
    spread = sums.select(_spread(F.col("b"), WEATHER_SPREAD).alias("t"), *(f"{n}_{p}" for n in of for p in "sn")).groupBy("t")
    mean = {n: F.sum(f"{n}_s") / F.nullif(F.sum(f"{n}_n"), F.lit(0)) for n in of}
    return spread.agg((mean["q"] / 10).alias("u"), mean["d"].alias("direction"), (mean["x"] * 8000).alias("sw"), (mean["y"] * 1200).alias("cc"), mean["k"].alias("t2"))
