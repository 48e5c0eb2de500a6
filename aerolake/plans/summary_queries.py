"""Queries of the summaries on the driver's tables and their SQL equivalents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from aerolake.functions import emissions, weather
from aerolake.functions.calendar import rounded
from aerolake.operators import series, summaries
from aerolake.plans.emission_queries import TRAFFIC
from aerolake.plans.ledger import HOLIDAY_TABLE, LOCAL
from aerolake.plans.queries import PAIRS, H, _hours, _pairs
from aerolake.sources.tables import table

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str):
    def register(f):
        QUERIES[f.__name__] = f
        ORACLES[f.__name__] = sql
        return f

    return register


@query(f"{PAIRS} SELECT l_returnflag, l_linestatus, round(CASE WHEN count(*) >= 48 AND sum(p) > 0 THEN sum(o) / sum(p) ELSE 1 END + 1e-9, 6) AS ratio, count(*) AS n FROM x GROUP BY 1, 2")
def bias_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    return summaries.bias_ratio(_pairs(spark, sf_dir), 48, 1.0, "l_returnflag", "l_linestatus").withColumn("ratio", rounded(F.col("ratio")))


@query(f"""{PAIRS}, l AS (SELECT l_returnflag, regr_slope(o, p) AS b, regr_intercept(o, p) AS a FROM x GROUP BY 1)
SELECT l_returnflag, round(a + 1e-9, 5) AS a, round(b + 1e-9, 6) AS b, round(avg(abs(o - a - b * p)) + 1e-9, 6) AS mae FROM x JOIN l USING (l_returnflag) GROUP BY l_returnflag, a, b""")
def fit_line(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = summaries.fit_line(_pairs(spark, sf_dir), "l_returnflag")
    return out.select("l_returnflag", rounded(F.col("a"), 5).alias("a"), rounded(F.col("b")).alias("b"), rounded(F.col("mae")).alias("mae"))


@query("""WITH x AS (SELECT l_returnflag, CAST(l_orderkey % 5 AS INTEGER) AS fold, l_extendedprice / 1000 AS o, l_quantity * 1.4 * (1 + l_tax) AS p FROM lineitem),
f AS (SELECT a.l_returnflag, a.fold, b.beta FROM (SELECT DISTINCT l_returnflag, fold FROM x) a,
      LATERAL (SELECT sum(o) / sum(p) AS beta FROM x WHERE x.l_returnflag = a.l_returnflag AND x.fold <> a.fold) b)
SELECT l_returnflag, fold, count(*) AS n, round(beta + 1e-9, 6) AS beta, round(sqrt(avg((o - beta * p) * (o - beta * p))) + 1e-9, 4) AS rmse FROM x JOIN f USING (l_returnflag, fold) GROUP BY l_returnflag, fold, beta""")
def kfold_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").select("l_returnflag", "l_orderkey", (F.col("l_extendedprice") / 1000).alias("o"), (F.col("l_quantity") * 1.4 * (1 + F.col("l_tax"))).alias("p"))
    out = summaries.kfold_scores(rows, (F.col("l_orderkey") % 5).cast("int"), "l_returnflag")
    return out.select("l_returnflag", "fold", "n", rounded(F.col("beta")).alias("beta"), rounded(F.col("rmse"), 4).alias("rmse"))


@query("SELECT event_type AS key, round(quantile_cont(value, 0.05) + 1e-9, 6) AS q0, round(quantile_cont(value, 0.5) + 1e-9, 6) AS q1, round(quantile_cont(value, 0.997) + 1e-9, 6) AS q2 FROM events GROUP BY 1")
def quantiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = summaries.quantiles(table(spark, sf_dir, "events").withColumnRenamed("event_type", "key"), "value", [0.05, 0.5, 0.997], "key")
    return out.select("key", *(rounded(F.col(q)).alias(q) for q in ("q0", "q1", "q2")))


@query(f"""{H}, m AS (SELECT key, date_trunc('month', t - INTERVAL 1 HOUR) AS m FROM h GROUP BY 1, 2 HAVING count(v) >= 0.75 * 24 * day(last_day(min(t - INTERVAL 1 HOUR))))
SELECT h.key, h.t, round(h.v + 1e-9, 6) AS v FROM h SEMI JOIN m ON h.key = m.key AND date_trunc('month', h.t - INTERVAL 1 HOUR) = m.m""")
def monthly_capture(spark: SparkSession, sf_dir: str) -> DataFrame:
    return summaries.monthly_capture(_hours(spark, sf_dir), 0.75).select("key", "t", rounded(F.col("v")).alias("v"))


@query("""SELECT event_type AS key, CAST(day(ts) AS INTEGER) AS day, count(*) AS n, count(DISTINCT date_trunc('hour', ts)) AS hours, CAST(count(*) FILTER (value > 480) AS BIGINT) AS masked,
CAST(count(*) FILTER (event_id % 3 = 0) AS BIGINT) AS val_rows FROM events GROUP BY 1, 2""")
def merge_bookkeeping(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").select(F.col("event_type").alias("key"), F.dayofmonth("ts").alias("day"), F.date_trunc("HOUR", "ts").alias("t"), F.when(F.col("value") <= 480, F.col("value")).alias("v"), F.when(F.col("event_id") % 3 == 0, 1).otherwise(0).alias("validated"))
    return summaries.bookkeeping(rows, "key", "day")


@query(f"""{H}, w AS (SELECT key, CAST(hour(t) AS INTEGER) AS hour, sum(v) AS w FROM h GROUP BY 1, 2)
SELECT key, hour, round(sum(w) OVER (PARTITION BY key ORDER BY hour) / sum(w) OVER (PARTITION BY key) + 1e-9, 6) AS share FROM w""")
def cumulative_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = _hours(spark, sf_dir).groupBy("key", F.hour("t").alias("hour")).agg(F.sum("v").alias("w"))
    return summaries.cumulative_share(w, "hour", "key").select("key", "hour", rounded(F.col("share")).alias("share"))


LUT = [1 + i * (16 - i) / 10 for i in range(16)]


@query("""WITH k AS (SELECT event_id, i, CASE WHEN value / 100 < 0.5 THEN 1 ELSE exp(-0.5 * power(abs((i * 22.5 - (value * 7.3) % 360 + 180 + 360) % 360 - 180) / least(60, 22.5 * greatest(1, 2 / greatest(value / 100, 1e-9))), 2)) END AS w
FROM events CROSS JOIN range(16) r(i)) SELECT event_id, round(sum(w * (1 + i * (16 - i) / 10)) / sum(w) + 1e-9, 6) AS gamma FROM k GROUP BY 1""")
def lut_weighted(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = weather.direction_weights(weather.wrap360(F.col("value") * 7.3), F.col("value") / 100)
    return table(spark, sf_dir, "events").select("event_id", rounded(summaries.lookup(w, LUT)).alias("gamma"))


@query(f"""WITH {HOLIDAY_TABLE}, x AS (SELECT event_id, {LOCAL.format('ts')} AS l FROM events) SELECT event_id, round({TRAFFIC.format(l='l')} + 1e-9, 6) AS factor FROM x""")
def traffic_factor(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", rounded(emissions.traffic_factor(F.col("ts"))).alias("factor"))


@query("SELECT event_id, CAST(greatest(-32767, least(32767, round_even((value - 200) / 0.01, 0))) AS INTEGER) AS code, round(greatest(-32767, least(32767, round_even((value - 200) / 0.01, 0))) * 0.01 + 1e-9, 4) AS back FROM events")
def int16_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    code = summaries.packed_int16(F.col("value") - 200, 0.01)
    return table(spark, sf_dir, "events").select("event_id", code.alias("code"), rounded(summaries.unpacked_int16(code, 0.01), 4).alias("back"))


@query(f"""{H}, p AS (SELECT {LOCAL.format('a.t')} AS l, a.v AS a, b.v AS b FROM h a JOIN h b ON a.t = b.t AND a.key = 'purchase' AND b.key = 'view')
SELECT CAST(l AS DATE) AS day, round(avg(a) - avg(b) + 1e-9, 6) AS off FROM p GROUP BY 1 HAVING count(*) >= 12""")
def paired_daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily increment of local days with enough hours that both have."""
    return series.paired_daily(_hours(spark, sf_dir), "purchase", "view", 12).select("day", rounded(F.col("a") - F.col("b")).alias("off"))
