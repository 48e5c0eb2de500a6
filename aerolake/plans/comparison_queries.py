"""Queries that hold measured against modelled hours, with SQL: bias ratios, hindcast, forecast, sector means."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from aerolake.functions.calendar import rounded
from aerolake.operators import calibration as cal
from aerolake.operators import comparison
from aerolake.plans import calibration_queries as cq
from aerolake.plans import receptor_queries as rq
from aerolake.plans.ledger import SERIES, ledger
from aerolake.sources.intermediate import materialise

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str):
    def register(f):
        QUERIES[f.__name__] = f
        ORACLES[f.__name__] = sql
        return f

    return register


BETA, U0 = 1.3, 1.4
#: The model's hours: every seventh is missing, and its bias goes with the hour.
MODEL = f"""{SERIES}, ob AS (SELECT t, max(v) FILTER (key = 'park.no2') AS no2, max(v) FILTER (key = 'park.nox') AS nox, max(v) FILTER (key = 'park.o3') AS o3, max(v) FILTER (key = 'road.pm10') AS pm10 FROM s GROUP BY 1),
mo AS (SELECT t, no2 * (0.5 + hour(t) % 5 / 10) AS no2, o3 * 1.2 AS o3, pm10 * (0.7 + hour(t) % 3 / 10) AS pm10 FROM ob WHERE hour(t) % 7 > 0)"""
RATIOS = """ra AS (SELECT unnest(['no2', 'o3', 'pm10', 'pm25', 'nox_no2']) AS pollutant, unnest([CASE WHEN n1 >= 48 AND m1 > 0 THEN o1 / m1 ELSE 1.77 END, CASE WHEN n2 >= 48 AND m2 > 0 THEN o2 / m2 ELSE 0.86 END, CASE WHEN n3 >= 48 AND m3 > 0 THEN o3 / m3 ELSE 1.2 END, 0.85, CASE WHEN n5 >= 48 AND m5 > 0 THEN o5 / m5 ELSE 23.96 / 16.32::DOUBLE END]) AS ratio,
unnest([n1, n2, n3, 0, n5]) AS n, unnest([CASE WHEN n1 >= 48 AND m1 > 0 THEN 'live' ELSE 'default' END, CASE WHEN n2 >= 48 AND m2 > 0 THEN 'live' ELSE 'default' END, CASE WHEN n3 >= 48 AND m3 > 0 THEN 'live' ELSE 'default' END, 'default', CASE WHEN n5 >= 48 AND m5 > 0 THEN 'live' ELSE 'default' END]) AS source
FROM (SELECT count(*) FILTER (mo.no2 > 0) AS n1, sum(ob.no2) FILTER (mo.no2 > 0) AS o1, sum(mo.no2) FILTER (mo.no2 > 0 AND ob.no2 IS NOT NULL) AS m1, count(*) FILTER (mo.o3 > 0) AS n2, sum(ob.o3) FILTER (mo.o3 > 0) AS o2, sum(mo.o3) FILTER (mo.o3 > 0) AS m2,
count(*) FILTER (mo.pm10 > 0) AS n3, sum(ob.pm10) FILTER (mo.pm10 > 0) AS o3, sum(mo.pm10) FILTER (mo.pm10 > 0) AS m3, count(*) FILTER (ob.nox IS NOT NULL AND ob.no2 IS NOT NULL) AS n5, sum(ob.nox) FILTER (ob.no2 IS NOT NULL) AS o5, sum(ob.no2) FILTER (ob.nox IS NOT NULL) AS m5
FROM ob LEFT JOIN mo USING (t) WHERE ob.t > {until} - INTERVAL 14 DAY AND ob.t <= {until}))"""


def _both(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    keys = ("park.no2", "park.nox", "park.o3", "road.pm10")
    observed = cal.wide(ledger(spark, sf_dir), keys).select("t", F.col("park_no2").alias("no2"), F.col("park_nox").alias("nox"), F.col("park_o3").alias("o3"), F.col("road_pm10").alias("pm10"), F.lit(None).cast("double").alias("pm25"))
    observed = materialise(observed, "observed")
    h = F.hour("t")
    model = observed.filter(h % 7 > 0).select("t", (F.col("no2") * (0.5 + h % 5 / 10)).alias("no2"), (F.col("o3") * 1.2).alias("o3"), (F.col("pm10") * (0.7 + h % 3 / 10)).alias("pm10"), F.col("pm25"))
    return observed, model


def _latest(rows: DataFrame) -> Column:
    return F.lit(rows.agg(F.max("t")).first()[0]).cast("timestamp_ntz")


@query(f"WITH {MODEL}, {RATIOS.format(until='(SELECT max(t) FROM ob)')} SELECT pollutant, round(ratio + 1e-9, 6) AS ratio, n, source FROM ra")
def model_bias(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bias ratios of the last fourteen days."""
    observed, model = _both(spark, sf_dir)
    return comparison.bias_ratios(observed, model, _latest(observed)).withColumn("ratio", rounded(F.col("ratio")))


@query(f"""WITH {cq.HOURS}, e AS (SELECT max(t) AS e FROM hr), g AS (SELECT e - to_hours(CAST(i AS BIGINT)) AS t FROM e, range(72) r(i) WHERE e IS NOT NULL)
SELECT g.t, round(CASE WHEN day(g.t) % 2 = 0 THEN s.v END + 1e-9, 6) AS raw, round(CASE WHEN day(g.t) % 2 = 1 THEN s.v END + 1e-9, 6) AS validated, round(park_nox + x + 1e-9, 6) AS model, round(park_nox + 1e-9, 6) AS background, round((park_nox + x) / 2 + 1e-9, 6) AS low, round((park_nox + x) * 2 + 1e-9, 6) AS high
FROM g LEFT JOIN s ON s.t = g.t AND key = 'road.nox' LEFT JOIN (SELECT t, park_nox, 1e6::DOUBLE * {BETA}::DOUBLE * s / sqrt(u * u + {U0 * U0!r}::DOUBLE) AS x FROM hr) m ON m.t = g.t""")
def hindcast(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last 72 hours as measured and as modelled."""
    hours = cq._hours(spark, sf_dir)
    measured = ledger(spark, sf_dir).filter("key = 'road.nox'").select("t", "v", (F.dayofmonth("t") % 2).alias("validated"))
    modelled = hours.select("t", (F.col("park_nox") + cal.modelled(BETA, U0)).alias("total"), F.col("park_nox").alias("background"))
    if hours.isEmpty():
        return comparison.hindcast(measured, modelled, F.lit("2000-01-01").cast("timestamp_ntz")).filter(F.lit(False))
    out = comparison.hindcast(measured, modelled, _latest(hours))
    return out.select("t", *(rounded(F.col(c)).alias(c) for c in ("raw", "validated", "model", "background", "low", "high")))


@query(f"""WITH {cq.HOURS}, {MODEL.replace(SERIES + ', ', '')}, nw AS (SELECT max(t) - INTERVAL 72 HOUR AS now FROM hr), {RATIOS.format(until='(SELECT now FROM nw)')}, {cq.TABLE_SQL}, {rq.LK}, {rq.TB}, {rq._concentration_sql(rq.NONE, 'cc')}, {rq._concentration_sql(rq.SOME, 'ss')},
bg AS (SELECT cc.t, coalesce(mo.pm10 * (SELECT ratio FROM ra WHERE pollutant = 'pm10'), 25.6) AS b FROM cc LEFT JOIN mo ON mo.t = cc.t)
SELECT bg.t, round(b + 1e-9, 5) AS background, round(b + cc.pm10 - 25.6 + 1e-9, 5) AS today, round(b + ss.pm10 - 25.6 + 1e-9, 5) AS scenario FROM bg JOIN cc ON cc.t = bg.t JOIN ss ON ss.t = bg.t WHERE bg.t > (SELECT now FROM nw)""")
def forecast(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Particles of the 72 hours after now, today and under measures, on the model's background by its ratios."""
    ready = materialise(rq._ready(spark, sf_dir), "ready")
    observed, model = _both(spark, sf_dir)
    now = _latest(ready) - F.expr("INTERVAL 72 HOURS")
    background = comparison.corrected(model, comparison.bias_ratios(observed, model, now))
    out = comparison.forecast(ready, background, now, "pm10", rq.BETA, rq.U0, rq.measures())
    return out.select("t", *(rounded(F.col(c), 5).alias(c) for c in ("background", "today", "scenario")))


@query(f"WITH {cq.HOURS} SELECT {cq.SECTOR.format('direction')} AS sector, count(*) AS n, round(avg(1e6::DOUBLE * {BETA}::DOUBLE * s / sqrt(u * u + {U0 * U0!r}::DOUBLE)) + 1e-9, 5) AS model, round(avg(obs) + 1e-9, 5) AS measured FROM hr GROUP BY 1")
def rose_comparison(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Modelled and measured increments by sector over the archive."""
    out = comparison.rose_comparison(cq._hours(spark, sf_dir), cal.modelled(BETA, U0), F.col("obs"))
    return out.select("sector", "n", rounded(F.col("model"), 5).alias("model"), rounded(F.col("measured"), 5).alias("measured"))
