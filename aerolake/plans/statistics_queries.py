"""Queries over an archive of several years on the local calendar, with SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from aerolake.functions import calendar
from aerolake.functions.calendar import rounded
from aerolake.functions.dimensions import EXCEEDANCES
from aerolake.operators import cleaning, series, statistics, summaries
from aerolake.plans.ledger import DAYTYPE, HOURS_OF_YEAR, LOCAL, MIDNIGHT, PARK, ROAD, SECTOR, SERIES, WEATHER, ledger, weather

QUERIES: dict = {}
ORACLES: dict[str, str] = {}
PERIOD = "1994-05-01"
INCREMENTS = ("nox", "no2")


def query(sql: str):
    def register(f):
        QUERIES[f.__name__] = f
        ORACLES[f.__name__] = sql
        return f

    return register


ST = LOCAL.format("t")
INC = f"""i AS (SELECT 'inc.' || p AS key, t, a - b AS v FROM (SELECT split_part(key, '.', 2) AS p, t, max(v) FILTER (key LIKE '{ROAD}.%') AS a, max(v) FILTER (key LIKE '{PARK}.%') AS b FROM s
WHERE split_part(key, '.', 2) IN ({', '.join(f"'{p}'" for p in INCREMENTS)}) GROUP BY 1, 2) WHERE a IS NOT NULL AND b IS NOT NULL), o AS (SELECT * FROM s UNION ALL SELECT * FROM i),
lc AS (SELECT key, t, v, {ST} AS ls FROM o), z AS (SELECT max(t) AS last, CAST(max({ST}) AS DATE) AS today FROM o)"""
ANNUAL = f"""ya AS (SELECT key, CAST(year(ls) AS INTEGER) AS year, count(v) AS n, avg(v) AS m FROM lc GROUP BY 1, 2), yb AS (SELECT *, n / ({HOURS_OF_YEAR.format('year')}) AS share FROM ya),
yr AS (SELECT key, year, n, 100 * share AS coverage, CASE WHEN year < (SELECT year(today) FROM z) AND share >= 0.75 THEN m END AS v FROM yb)"""
SINCE = MIDNIGHT.format(f"DATE '{PERIOD}'")
COVER = f"""cv AS (SELECT key, CAST(count(v) FILTER (t > {SINCE}) AS BIGINT) AS n, 100.0::DOUBLE * count(v) FILTER (t > {SINCE}) / greatest(1, floor((epoch((SELECT last FROM z)) - epoch({SINCE})) / 3600)) AS percent FROM o GROUP BY 1)"""
YTD = f"""yd AS (SELECT key, CAST(year(today) AS INTEGER) AS year, count(*) AS n, avg(v) AS v, 100.0::DOUBLE * count(*) / floor((epoch(any_value(last)) - epoch({MIDNIGHT.format('make_date(CAST(year(any_value(today)) AS INTEGER), 1, 1)')})) / 3600) AS percent
FROM lc, z WHERE year(ls) = year(today) GROUP BY 1, 2)"""
ROSE = f"""rs AS (SELECT key, CASE WHEN u < 0.5 OR direction IS NULL THEN -1 ELSE {SECTOR.format('direction')} END AS sector, count(v) AS n, avg(v) AS v FROM o JOIN w USING (t) WHERE u IS NOT NULL GROUP BY 1, 2)"""
RULES = ", ".join(f"('{n}', '{p}', '{b}', {limit}::DOUBLE)" for n, p, b, limit in EXCEEDANCES)
OVER = f"""ru(rule, p, basis, lim) AS (VALUES {RULES}), dm AS (SELECT key, CAST(ls AS DATE) AS day, avg(v) AS v, count(v) AS n FROM lc GROUP BY 1, 2 HAVING count(v) >= 18),
ov AS (SELECT rule, CAST(year(ls) AS INTEGER) AS year, CAST(count(*) FILTER (v > lim) AS BIGINT) AS n, count(*) AS valid FROM lc JOIN ru ON key = '{ROAD}.' || p AND basis = '1h' GROUP BY 1, 2
UNION ALL SELECT rule, CAST(year(day) AS INTEGER), CAST(count(*) FILTER (v > lim) AS BIGINT), count(*) FROM dm JOIN ru ON key = '{ROAD}.' || p AND basis = '24h' GROUP BY 1, 2)"""


def _own(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = ledger(spark, sf_dir)
    return s.unionByName(statistics.increments(s, ROAD, PARK, INCREMENTS))


@query(f"WITH {SERIES}, {INC}, {ANNUAL} SELECT key, year, n, round(coverage + 1e-9, 4) AS coverage, round(v + 1e-9, 6) AS v FROM yr")
def archive_annual(spark: SparkSession, sf_dir: str) -> DataFrame:
    return statistics.annual(_own(spark, sf_dir)).select("key", "year", "n", rounded(F.col("coverage"), 4).alias("coverage"), rounded(F.col("v")).alias("v"))


@query(f"WITH {SERIES}, {INC}, {OVER} SELECT * FROM ov")
def archive_exceedances(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = ledger(spark, sf_dir).filter(F.col("key").startswith(f"{ROAD}."))
    return statistics.exceedances(s.withColumn("key", F.split_part("key", F.lit("."), F.lit(2))))


@query("""WITH d AS (SELECT CAST(o_orderdate AS DATE) AS day, avg(o_totalprice) / 3000 AS v FROM orders WHERE o_orderstatus = 'F' GROUP BY 1)
SELECT r AS rule, CAST(year(day) AS INTEGER) AS year, CAST(count(*) FILTER (v > l) AS BIGINT) AS n, count(*) AS valid FROM d, (VALUES ('pm10_24h_50', 50.0::DOUBLE), ('pm10_24h_45', 45.0)) x(r, l) GROUP BY 1, 2""")
def reference_exceedances(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Limits counted on the days of a reference method."""
    days = table_days(spark, sf_dir)
    return statistics.exceedances(days, [r for r in EXCEEDANCES if r[1] == "pm10"], days)


def table_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    from aerolake.sources.tables import table

    orders = table(spark, sf_dir, "orders").filter("o_orderstatus = 'F'")
    return orders.groupBy(F.to_date("o_orderdate").alias("day")).agg((F.avg("o_totalprice") / 3000).alias("v")).withColumn("key", F.lit("pm10"))


@query(f"WITH {SERIES}, {INC}, {COVER} SELECT key, n, round(percent + 1e-9, 6) AS percent FROM cv")
def period_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return statistics.coverage(_own(spark, sf_dir), PERIOD).select("key", "n", rounded(F.col("percent")).alias("percent"))


@query(f"WITH {SERIES}, {INC}, {YTD} SELECT key, year, n, round(v + 1e-9, 6) AS v, round(percent + 1e-9, 6) AS percent FROM yd")
def year_to_date(spark: SparkSession, sf_dir: str) -> DataFrame:
    return statistics.year_to_date(_own(spark, sf_dir)).select("key", "year", "n", rounded(F.col("v")).alias("v"), rounded(F.col("percent")).alias("percent"))


@query(f"WITH {SERIES}, {INC}, {ANNUAL} SELECT key, year, round(v + 1e-9, 6) AS v FROM yr WHERE key LIKE 'inc.%' AND v IS NOT NULL AND year = (SELECT max(year) FROM yr WHERE key = 'inc.nox' AND v IS NOT NULL)")
def latest_increment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return statistics.latest_increment(statistics.annual(_own(spark, sf_dir)), "inc.nox").withColumn("v", rounded(F.col("v")))


@query(f"WITH {SERIES}, {INC}, {WEATHER}, {ROSE} SELECT key, sector, n, round(v + 1e-9, 6) AS v FROM rs")
def archive_rose(spark: SparkSession, sf_dir: str) -> DataFrame:
    return statistics.rose(_own(spark, sf_dir), weather(spark, sf_dir)).select("key", "sector", "n", rounded(F.col("v")).alias("v"))


@query(f"""WITH {SERIES}, {INC}, {WEATHER}, {ANNUAL}, {COVER}, {YTD}, {ROSE}, {OVER},
doc AS (SELECT 'annual' AS section, key, CAST(year AS VARCHAR) AS part, n, v FROM yr WHERE v IS NOT NULL
UNION ALL SELECT 'coverage by year', key, CAST(year AS VARCHAR), n, coverage FROM yr
UNION ALL SELECT 'diurnal', key, {DAYTYPE.format('ls')} || ' ' || hour(ls), count(v), avg(v) FROM lc GROUP BY 1, 2, 3
UNION ALL SELECT 'monthly', key, CAST(month(ls) AS VARCHAR), count(v), avg(v) FROM lc GROUP BY 1, 2, 3
UNION ALL SELECT 'rose', key, CAST(sector AS VARCHAR), n, v FROM rs
UNION ALL SELECT 'exceedances', rule, CAST(year AS VARCHAR), valid, n FROM ov
UNION ALL SELECT 'coverage', key, 'period', n, percent FROM cv
UNION ALL SELECT 'year to date', key, CAST(year AS VARCHAR), n, v FROM yd
UNION ALL SELECT 'coverage to date', key, CAST(year AS VARCHAR), n, percent FROM yd
UNION ALL SELECT 'increment', key, CAST(year AS VARCHAR), 1, v FROM yr WHERE key LIKE 'inc.%' AND v IS NOT NULL AND year = (SELECT max(year) FROM yr WHERE key = 'inc.nox' AND v IS NOT NULL)
UNION ALL SELECT 'latest', key, strftime(max(t), '%Y-%m-%d %H:%M'), 1, arg_max(v, t) FROM o GROUP BY 1, 2)
SELECT section, key, part, CAST(n AS BIGINT) AS n, round(v + 1e-9, 4) AS v FROM doc""")
def statistics_document(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every statistic of an archive in one call."""
    doc = statistics.document(ledger(spark, sf_dir), weather(spark, sf_dir), PERIOD, ROAD, PARK, INCREMENTS)
    return doc.withColumn("v", rounded(F.col("v"), 4))


@query(f"""WITH {SERIES}, p AS (SELECT {ST} AS ls, max(v) FILTER (key = 'road.no2') AS a, max(v) FILTER (key = 'park.no2') AS b FROM s GROUP BY t, 1)
SELECT CAST(ls AS DATE) AS day, count(*) AS n, round(avg(a) + 1e-9, 6) AS a, round(avg(b) + 1e-9, 6) AS b FROM p WHERE a IS NOT NULL AND b IS NOT NULL GROUP BY 1 HAVING count(*) >= 18""")
def paired_daily_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = series.paired_daily(ledger(spark, sf_dir), "road.no2", "park.no2")
    return out.select("day", "n", rounded(F.col("a")).alias("a"), rounded(F.col("b")).alias("b"))


@query(f"""WITH {SERIES} SELECT split_part(key, '.', 1) AS station, round(quantile_cont(v, 0.05) + 1e-9, 6) AS q0, round(quantile_cont(v, 0.5) + 1e-9, 6) AS q1, round(quantile_cont(v, 0.997) + 1e-9, 6) AS q2, count(*) AS n FROM s GROUP BY 1""")
def archive_quantiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = ledger(spark, sf_dir).withColumn("station", F.split_part("key", F.lit("."), F.lit(1)))
    out = summaries.quantiles(s, "v", [0.05, 0.5, 0.997], "station")
    return out.select("station", "n", *(rounded(F.col(f"q{i}")).alias(f"q{i}") for i in range(3)))


@query(f"""WITH {SERIES}, d AS (SELECT key, t, v, lag(t) OVER (PARTITION BY key ORDER BY t) AS b FROM s)
SELECT key, t, round(v + 1e-9, 6) AS v FROM d UNION ALL SELECT key, b + INTERVAL 90 MINUTE, NULL FROM d WHERE epoch(t) - epoch(b) > 3 * 3600""")
def series_with_breaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return series.with_breaks(ledger(spark, sf_dir), 3).withColumn("v", rounded(F.col("v")))


@query("""WITH d AS (SELECT DISTINCT CAST(o_orderdate AS DATE) AS day FROM orders), m AS (SELECT day, (CAST(day AS TIMESTAMP) AT TIME ZONE 'Europe/Zagreb') AT TIME ZONE 'UTC' AS midnight, (CAST(day + 1 AS TIMESTAMP) AT TIME ZONE 'Europe/Zagreb') AT TIME ZONE 'UTC' AS next FROM d)
SELECT day, CAST(midnight AS TIMESTAMP) AS midnight, CAST((epoch(next) - epoch(midnight)) / 3600 AS INTEGER) AS hours, CAST(date_trunc('month', make_date(CAST(year(day) AS INTEGER), 11, 1) - 1) AS DATE) + (30 - CAST(isodow(make_date(CAST(year(day) AS INTEGER), 10, 31)) % 7 AS INTEGER)) AS winter,
CAST(year(midnight - INTERVAL 1 HOUR) * 100 + month(midnight - INTERVAL 1 HOUR) AS INTEGER) AS utc_month FROM m""")
def local_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Start of local days in UTC, their hours, the end of summer time and the UTC month."""
    from aerolake.sources.tables import table

    days = table(spark, sf_dir, "orders").select(F.to_date("o_orderdate").alias("day")).distinct()
    midnight = calendar.local_midnight(F.col("day"))
    return days.select("day", midnight.cast("timestamp_ntz").alias("midnight"), calendar.hours_in_local_day(F.col("day")).alias("hours"), calendar.last_sunday(F.year("day"), 10).alias("winter"), calendar.utc_month(midnight).alias("utc_month"))


@query("""SELECT CASE event_type WHEN 'view' THEN 'z1.ws' WHEN 'click' THEN 'z4.rh' WHEN 'purchase' THEN 'z1.no2' ELSE 'ifs.ws' END AS key, event_id, value AS v FROM events
WHERE value IS NOT NULL AND CASE event_type WHEN 'view' THEN value BETWEEN 0 AND 40 WHEN 'click' THEN value BETWEEN 0 AND 100.5 ELSE true END""")
def plausible_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    from aerolake.sources.tables import table

    e = F.col("event_type")
    key = F.when(e == "view", "z1.ws").when(e == "click", "z4.rh").when(e == "purchase", "z1.no2").otherwise("ifs.ws")
    rows = table(spark, sf_dir, "events").select(key.alias("key"), "event_id", F.col("value").alias("v"))
    return cleaning.plausible(cleaning.without_sentinels(rows))


@query("SELECT event_type AS key, CAST(count(*) FILTER (value * 2 - 950 <= -900) AS BIGINT) AS sentinels, count(*) AS n FROM events GROUP BY 1")
def sentinel_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from aerolake.sources.tables import table

    return cleaning.sentinels(table(spark, sf_dir, "events").select(F.col("event_type").alias("key"), (F.col("value") * 2 - 950).alias("v")))
