"""Queries of the refreshed archive on the driver's events, with SQL that rebuilds it whole."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from aerolake.functions.calendar import rounded
from aerolake.sources.intermediate import shared_root
from aerolake.sources.tables import table
from aerolake.streaming import archive

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str):
    def register(f):
        QUERIES[f.__name__] = f
        ORACLES[f.__name__] = sql
        return f

    return register


READINGS = "r AS (SELECT event_type AS key, CAST(date_trunc('hour', ts) + INTERVAL 1 HOUR AS TIMESTAMP) AS t, CASE WHEN event_id % 50 = 0 THEN -999 ELSE value END AS v, CAST(event_id % 7 < length(event_type) % 4 AS INTEGER) AS validated, event_id AS seen FROM events)"


def _readings(spark: SparkSession, sf_dir: str) -> DataFrame:
    i, kind = F.col("event_id"), F.col("event_type")
    t = (F.date_trunc("HOUR", "ts") + F.expr("INTERVAL 1 HOUR")).cast("timestamp_ntz")
    fetched = F.timestamp_seconds(1700000000 + i).cast("timestamp_ntz")
    return table(spark, sf_dir, "events").select(kind.alias("key"), t.alias("t"), F.when(i % 50 == 0, -999.0).otherwise(F.col("value").cast("double")).alias("v"), (i % 7 < F.length(kind) % 4).cast("int").alias("validated"), fetched.alias("fetched"), i.alias("seen"))


@query(f"""WITH {READINGS}, n AS (SELECT key, t, validated, arg_max(v, seen) AS v, CAST(year((t - INTERVAL 1 HOUR) AT TIME ZONE 'UTC' AT TIME ZONE 'Europe/Zagreb') AS INTEGER) AS year FROM r GROUP BY key, t, validated),
c AS (SELECT *, count(*) FILTER (validated = 1) OVER w AS n1, count(*) FILTER (validated = 0) OVER w AS n0 FROM n WINDOW w AS (PARTITION BY key, year))
SELECT key, year, t, round(v + 1e-9, 6) AS v, CASE validated WHEN 1 THEN 'validated' ELSE 'raw' END AS source FROM c WHERE validated = CASE WHEN n1 > 0 AND n1 >= 0.5 * n0 THEN 1 ELSE 0 END AND v > -900""")
def refreshed_archive(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An archive after three batches out of order, one of them twice."""
    rows = _readings(spark, sf_dir)
    held = archive.Archive(spark, f"{shared_root(spark)}/archive-{uuid.uuid4().hex}")
    for k in (2, 0, 1, 0):
        held.merge(rows.filter(F.pmod(F.col("seen"), F.lit(3)) == k), most=1 << 40)
    return held.series().select("key", "year", "t", rounded(F.col("v")).alias("v"), "source")


# A chunk is known unless its first day divides by 4; it was fetched 30 to 89 days after its last day, or, where that is later, two hours before now.
@query("""WITH s AS (SELECT o_orderpriority AS key, CAST(min(o_orderdate) AS DATE) AS a, CAST(max(o_orderdate) AS DATE) AS b FROM orders GROUP BY 1), m AS (SELECT key, a, b, CAST(unnest(generate_series(date_trunc('month', a), CAST(b AS TIMESTAMP), INTERVAL 1 MONTH)) AS DATE) AS m FROM s),
p AS (SELECT key, greatest(a, m) AS a, least(b, last_day(m)) AS b FROM m), q AS (SELECT *, CAST(ceil((b - a + 1) / ceil((b - a + 1) / 12)) AS INTEGER) AS size FROM p),
c AS (SELECT key, b, size, a + CAST(unnest(range(0, b - a + 1, size)) AS INTEGER) AS first FROM q), d AS (SELECT key, first, least(first + size - 1, b) AS last FROM c), now AS (SELECT CAST(max(o_orderdate) AS TIMESTAMP) AS now FROM orders),
f AS (SELECT key, first, last, now, CASE WHEN day(first) % 4 <> 0 THEN least(CAST(last AS TIMESTAMP) + to_days(CAST(30 + (day(first) * 7 + month(first) * 5) % 60 AS INTEGER)), now - INTERVAL 2 HOUR) END AS fetched FROM d, now)
SELECT key, first, last FROM f WHERE fetched IS NULL OR (NOT last < CAST(fetched AT TIME ZONE 'UTC' AT TIME ZONE 'Europe/Zagreb' AS DATE) - 60 AND epoch(now - fetched) / 3600 >= 6)""")
def chunks_due(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks of twelve days at most that are unknown, or were fetched too early to be final and some time ago."""
    orders = table(spark, sf_dir, "orders")
    spans = orders.groupBy(F.col("o_orderpriority").alias("key")).agg(F.to_date(F.min("o_orderdate")).alias("first"), F.to_date(F.max("o_orderdate")).alias("last"))
    now = F.lit(orders.agg(F.max("o_orderdate").cast("timestamp_ntz")).first()[0]).cast("timestamp_ntz")
    chunks = archive.plan_chunks(spans, 12)
    later = F.col("last").cast("timestamp_ntz") + F.make_dt_interval(30 + (F.dayofmonth("first") * 7 + F.month("first") * 5) % 60)
    known = chunks.filter(F.dayofmonth("first") % 4 != 0).withColumns({"rows": F.lit(1).cast("long"), "fetched": F.least(later, now - F.expr("INTERVAL 2 HOURS"))})
    return archive.raw_due(chunks, known, now)
