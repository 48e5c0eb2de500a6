"""Queries on the driver's tables and their SQL equivalents.

``events`` plays the hourly measurements (event_type = station and parameter, value = level), ``orders`` and ``lineitem`` play
observed and modelled pairs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from aerolake.functions import chemistry, weather
from aerolake.functions.calendar import local_start, rounded
from aerolake.functions.dimensions import INDEX_LIMITS, MIN_DAY_HOURS, PPB
from aerolake.operators import calibration, fitting, series, spatial, statistics
from aerolake.plans.ledger import DAYTYPE_H, HOLIDAY_TABLE
from aerolake.sources.tables import table
from aerolake.streaming.refresh import hourly_stream

QUERIES: dict = {}
ORACLES: dict[str, str] = {}

#: Hourly series in SQL.
H = "WITH h AS (SELECT event_type AS key, CAST(date_trunc('hour', ts) + INTERVAL 1 HOUR AS TIMESTAMP) AS t, avg(value) AS v FROM events GROUP BY 1, 2)"


def query(sql: str | None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return register


def _hours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return series.hourly(table(spark, sf_dir, "events"), "event_type", "ts", "value")


@query(f"{H} SELECT key, t, round(v + 1e-9, 6) AS v FROM h")
def hourly_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _hours(spark, sf_dir).withColumn("v", rounded(F.col("v")))


@query(f"{H} SELECT a.t, round(a.v - b.v + 1e-9, 6) AS inc FROM h a JOIN h b ON a.t = b.t WHERE a.key = 'purchase' AND b.key = 'view'")
def paired_increment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return series.paired_increment(_hours(spark, sf_dir), "purchase", "view").select("t", rounded(F.col("inc")).alias("inc"))


@query(f"""{H}, g AS (SELECT unnest(generate_series((SELECT min(t) FROM h), (SELECT max(t) FROM h), INTERVAL 1 HOUR)) AS t)
SELECT k.key, CAST(g.t AS TIMESTAMP) AS t, round(h.v + 1e-9, 6) AS v FROM (SELECT DISTINCT key FROM h) k CROSS JOIN g LEFT JOIN h ON h.key = k.key AND h.t = g.t""")
def gap_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    return series.gap_fill(_hours(spark, sf_dir)).withColumn("v", rounded(F.col("v")))


@query(f"{H} SELECT a.key, a.t, round((a.v + b.v) / 2 + 1e-9, 6) AS v FROM h a JOIN h b ON a.key = b.key AND b.t = a.t - INTERVAL 1 HOUR")
def hour_ending_pair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return series.hour_ending_pair(_hours(spark, sf_dir)).withColumn("v", rounded(F.col("v")))


DT = "CASE isodow({}) WHEN 7 THEN 'sunday' WHEN 6 THEN 'saturday' ELSE 'weekday' END"


LT = "(t - INTERVAL 1 HOUR) AT TIME ZONE 'UTC' AT TIME ZONE 'Europe/Zagreb'"


@query(f"{H}, l AS (SELECT key, {LT} AS l, v FROM h) SELECT key, {DT.format('l')} AS daytype, CAST(hour(l) AS INTEGER) AS hour, round(avg(v) + 1e-9, 6) AS v, count(v) AS n FROM l GROUP BY 1, 2, 3")
def diurnal_by_daytype(spark: SparkSession, sf_dir: str) -> DataFrame:
    return series.diurnal(_hours(spark, sf_dir)).withColumn("v", rounded(F.col("v")))


@query(f"WITH o AS (SELECT o_orderstatus AS key, CAST(o_orderdate AS TIMESTAMP) AS t, o_totalprice AS v FROM orders) SELECT key, CAST(month({LT}) AS INTEGER) AS month, round(avg(v) + 1e-9, 4) AS v, count(v) AS n FROM o GROUP BY 1, 2")
def monthly_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "orders").select(F.col("o_orderstatus").alias("key"), F.col("o_orderdate").alias("t"), F.col("o_totalprice").alias("v"))
    return series.monthly(rows).withColumn("v", rounded(F.col("v"), 4))


@query("""SELECT o_orderstatus AS key, CAST(year(o_orderdate) AS INTEGER) AS year, count(DISTINCT CAST(o_orderdate AS DATE)) AS days,
round(avg(o_totalprice) + 1e-9, 4) AS v FROM orders GROUP BY 1, 2 HAVING count(DISTINCT CAST(o_orderdate AS DATE)) >= 0.75 * 365""")
def annual_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "orders").groupBy(F.col("o_orderstatus").alias("key"), F.year("o_orderdate").alias("year"))
    out = rows.agg(F.countDistinct(F.to_date("o_orderdate")).alias("days"), rounded(F.avg("o_totalprice"), 4).alias("v"))
    return out.filter(F.col("days") >= 0.75 * 365)


SECTOR = "CAST(CAST(floor((({0} * 7.3) % 360 + 11.25) / 22.5) AS BIGINT) % 16 AS INTEGER)"


@query(f"""{H}, w AS (SELECT t, max(v * 7.3) FILTER (key = 'view') AS direction, max(v / 40) FILTER (key = 'click') AS u FROM h GROUP BY 1)
SELECT key, CASE WHEN u < 0.5 OR direction IS NULL THEN -1 ELSE CAST(CAST(floor((direction % 360 + 11.25) / 22.5) AS BIGINT) % 16 AS INTEGER) END AS sector, count(v) AS n, round(avg(v) + 1e-9, 6) AS v FROM h JOIN w USING (t) WHERE u IS NOT NULL GROUP BY 1, 2""")
def rose_sectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hours without speed are in no sector; two series play bearing and speed."""
    of = lambda k, x: F.max(F.when(F.col("key") == k, x))
    h = _hours(spark, sf_dir)
    wind = h.groupBy("t").agg(of("view", F.col("v") * 7.3).alias("direction"), of("click", F.col("v") / 40).alias("u"))
    return statistics.rose(h, wind).withColumn("v", rounded(F.col("v")))


@query(f"{H} SELECT key, CAST({LT} AS DATE) AS day, round(avg(v) + 1e-9, 6) AS v, count(v) AS n FROM h GROUP BY 1, 2 HAVING count(v) >= 18")
def daily_valid_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    return series.daily_valid(_hours(spark, sf_dir), MIN_DAY_HOURS).withColumn("v", rounded(F.col("v")))


@query(f"""{H}, l AS (SELECT key, {LT} AS l, v FROM h), d AS (SELECT key, CAST(l AS DATE) AS d, avg(v) AS v FROM l GROUP BY 1, 2 HAVING count(v) >= 18)
SELECT key || ' 1h ' || CAST(x AS VARCHAR) AS rule, CAST(year(l) AS INTEGER) AS year, CAST(count(*) FILTER (v > x) AS BIGINT) AS n, count(*) AS valid FROM l, (VALUES (50), (100), (200)) y(x) GROUP BY 1, 2
UNION ALL SELECT key || ' 24h 60', CAST(year(d) AS INTEGER), CAST(count(*) FILTER (v > 60) AS BIGINT), count(*) FROM d GROUP BY 1, 2""")
def exceedance_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """By local year, hours and valid days; years without any stay."""
    keys = ("click", "purchase", "view", "add_to_cart", "search", "signup", "error", "scroll")
    h = _hours(spark, sf_dir)
    rules = [(f"{k} 1h {x}", k, "1h", float(x)) for k in keys for x in (50, 100, 200)] + [(f"{k} 24h 60", k, "24h", 60.0) for k in keys]
    return statistics.exceedances(h, rules)


@query(f"{H} SELECT key, max(t) AS t, round(arg_max(v, t) + 1e-9, 6) AS v FROM h GROUP BY 1")
def latest_value(spark: SparkSession, sf_dir: str) -> DataFrame:
    return series.latest(_hours(spark, sf_dir)).withColumn("v", rounded(F.col("v")))


@query("""WITH d AS (SELECT event_type AS key, value AS u, radians(value * 7.3) AS a FROM events),
m AS (SELECT key, avg(-u * sin(a)) AS e, avg(-u * cos(a)) AS n, avg(u) AS s FROM d GROUP BY 1)
SELECT key, round(sqrt(e * e + n * n) + 1e-9, 6) AS speed, round((degrees(atan2(-e, -n)) + 360) % 360 + 1e-9, 6) AS direction, round(s + 1e-9, 6) AS scalar FROM m""")
def vector_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    u, a = F.col("value"), F.radians(F.col("value") * 7.3)
    m = table(spark, sf_dir, "events").groupBy(F.col("event_type").alias("key")).agg(F.avg(-u * F.sin(a)).alias("e"), F.avg(-u * F.cos(a)).alias("n"), F.avg(u).alias("s"))
    return m.select("key", rounded(F.sqrt(F.col("e") * F.col("e") + F.col("n") * F.col("n"))).alias("speed"), rounded(weather.wrap360(F.degrees(F.atan2(-F.col("e"), -F.col("n"))))).alias("direction"), rounded(F.col("s")).alias("scalar"))


@query(f"""{H}, {HOLIDAY_TABLE}, x AS (SELECT key, v, (v - 20) * sqrt(v / 40 * (v / 40) + 1.44) AS x, {DAYTYPE_H.format('l')} AS daytype, CAST(hour(l) AS INTEGER) AS hour FROM (SELECT key, v, {LT} AS l FROM h)),
p AS (SELECT key, daytype, hour, median(x) AS m FROM x GROUP BY 1, 2, 3),
r AS (SELECT x.key, {SECTOR.format('x.v')} AS sector, x.x / p.m AS q FROM x JOIN p ON x.key = p.key AND x.daytype = p.daytype AND x.hour = p.hour WHERE p.m > 0)
SELECT key, sector, round(median(q) + 1e-9, 6) AS ratio, count(*) AS n FROM r GROUP BY 1, 2""")
def median_baseline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The baseline's two medians: values times effective wind by day type and hour, then by sector against those that are positive."""
    h = series.local_columns(_hours(spark, sf_dir), holidays=True).withColumns({"obs": F.col("v") - 20, "u": F.col("v") / 40, "direction": F.col("v") * 7.3})
    _, q = calibration.baseline(h, "key")
    return q.select("key", "sector", rounded(F.col("q")).alias("ratio"), "n")


def _pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select("l_returnflag", "l_linestatus", (F.col("l_extendedprice") / 1000).alias("o"), (F.col("l_quantity") * 1.4 * (1 + F.col("l_tax"))).alias("p"))


PAIRS = "WITH x AS (SELECT l_returnflag, l_linestatus, l_extendedprice / 1000 AS o, l_quantity * 1.4 * (1 + l_tax) AS p FROM lineitem)"


@query(f"""{PAIRS}, m AS (SELECT l_returnflag, count(*) AS n, avg(o) AS mo, avg(p) AS mp, avg((o - p) * (o - p)) AS mse, avg(abs(o - p)) AS mae,
avg(CASE WHEN greatest(p, 1) / greatest(o, 1) BETWEEN 0.5 AND 2 THEN 1.0::DOUBLE ELSE 0 END) AS fac2, avg(ln(greatest(o, 1)) - ln(greatest(p, 1))) AS l,
avg(power(ln(greatest(o, 1)) - ln(greatest(p, 1)), 2)) AS l2, covar_pop(o, p) AS c, stddev_pop(o) AS so, stddev_pop(p) AS sp FROM x GROUP BY 1)
SELECT l_returnflag, n, round(2 * (mo - mp) / (mo + mp) + 1e-9, 6) AS fb, round(mse / (mo * mp) + 1e-9, 6) AS nmse, round(sqrt(mse) + 1e-9, 6) AS rmse, round(fac2 + 1e-9, 6) AS fac2,
round(exp(l) + 1e-9, 6) AS mg, round(exp(l2) + 1e-9, 6) AS vg, round(mae / (mo + mp) + 1e-9, 6) AS nad, round(c / (so * sp) + 1e-9, 6) AS r FROM m""")
def chang_hanna(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = series.chang_hanna(_pairs(spark, sf_dir), 1.0, "l_returnflag")
    return out.select("l_returnflag", "n", *(rounded(F.col(c)).alias(c) for c in ("fb", "nmse", "rmse", "fac2", "mg", "vg", "nad", "r")))


MQI = "round(sqrt(avg((o - p) * (o - p))) / (2 * sqrt(avg({0} * {0} * ((1 - {2} * {2}) * o * o + {2} * {2} * {1} * {1})))) + 1e-9, 6)"


@query(f"""{PAIRS} SELECT l_returnflag, {MQI.format('0.24::DOUBLE', '200::DOUBLE', '0.20::DOUBLE')} AS no2, {MQI.format('0.18::DOUBLE', '120::DOUBLE', '0.79::DOUBLE')} AS o3,
{MQI.format('0.28::DOUBLE', '50::DOUBLE', '0.25::DOUBLE')} AS pm10, {MQI.format('0.36::DOUBLE', '25::DOUBLE', '0.50::DOUBLE')} AS pm25 FROM x GROUP BY 1""")
def mqi(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of four pollutants, each with its own uncertainty."""
    of = lambda k: rounded(chemistry.quality_indicator(F.col("o"), F.col("p"), k)).alias(k)
    return _pairs(spark, sf_dir).groupBy("l_returnflag").agg(of("no2"), of("o3"), of("pm10"), of("pm25"))


@query(f"""{PAIRS} SELECT l_returnflag, l_linestatus, CASE WHEN count(*) >= 30 AND sum(p) > 0 THEN round(sum(o) / sum(p) + 1e-9, 6) END AS ratio, count(*) AS n FROM x
GROUP BY GROUPING SETS ((l_returnflag), (l_linestatus), (l_returnflag, l_linestatus), ())""")
def ratio_diagnostics(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = F.col("l_returnflag"), F.col("l_linestatus")
    ratio = F.when((F.count("*") >= 30) & (F.sum("p") > 0), rounded(F.sum("o") / F.nullif(F.sum("p"), F.lit(0.0))))
    return _pairs(spark, sf_dir).groupingSets([[a], [b], [a, b], []], a, b).agg(ratio.alias("ratio"), F.count("*").alias("n"))


@query("""WITH r AS (SELECT event_type AS key, CAST(date_trunc('hour', ts) AS TIMESTAMP) AS t, value AS v, CAST(event_id % 3 = 0 AS INTEGER) AS validated, CAST(day(ts) AS INTEGER) AS day FROM events),
c AS (SELECT *, count(*) FILTER (validated = 1) OVER w AS n1, count(*) FILTER (validated = 0) OVER w AS n0 FROM r WINDOW w AS (PARTITION BY key, day))
SELECT key, day, validated, count(*) AS n, round(sum(v) + 1e-9, 4) AS v FROM c WHERE validated = CASE WHEN n1 > 0 AND n1 >= 0.5 * n0 THEN 1 ELSE 0 END GROUP BY 1, 2, 3""")
def validated_over_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").select(F.col("event_type").alias("key"), F.col("value").alias("v"), F.when(F.col("event_id") % 3 == 0, 1).otherwise(0).alias("validated"), F.dayofmonth("ts").alias("day"))
    return series.validated_over_raw(rows, "day").groupBy("key", "day", "validated").agg(F.count("*").alias("n"), rounded(F.sum("v"), 4).alias("v"))


@query(f"""{H}, g AS (SELECT DISTINCT t FROM h) SELECT g.t, round(coalesce(a.v, b.v, c.v, 40) + 1e-9, 6) AS v, CASE WHEN a.v IS NOT NULL THEN 'live' WHEN b.v IS NOT NULL THEN 'archive' WHEN c.v IS NOT NULL THEN 'model' ELSE 'constant' END AS src
FROM g LEFT JOIN h a ON a.t = g.t AND a.key = 'purchase' LEFT JOIN h b ON b.t = g.t AND b.key = 'view' LEFT JOIN h c ON c.t = g.t AND c.key = 'click'""")
def coalesce_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    of = lambda k: F.max(F.when(F.col("key") == k, F.col("v")))
    a = _hours(spark, sf_dir).groupBy("t").agg(of("purchase").alias("a"), of("view").alias("b"), of("click").alias("c"))
    src = F.when(F.col("a").isNotNull(), "live").when(F.col("b").isNotNull(), "archive").when(F.col("c").isNotNull(), "model").otherwise("constant")
    return a.select("t", rounded(F.coalesce("a", "b", "c", F.lit(40.0))).alias("v"), src.alias("src"))


@query("SELECT c_custkey, c_mktsegment FROM customer c WHERE NOT EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey AND o.o_orderstatus = 'F' AND o.o_totalprice > 150000)")
def anti_removed(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").filter("o_orderstatus = 'F' AND o_totalprice > 150000")
    customer = table(spark, sf_dir, "customer")
    return customer.join(orders, customer.c_custkey == orders.o_custkey, "left_anti").select("c_custkey", "c_mktsegment")


@query(f"""{H}, d AS (SELECT key, CAST({LT} AS DATE) AS day FROM h GROUP BY 1, 2 HAVING count(*) >= 18) SELECT h.key, h.t, round(h.v + 1e-9, 6) AS v FROM h SEMI JOIN d ON h.key = d.key AND CAST((h.t - INTERVAL 1 HOUR) AT TIME ZONE 'UTC' AT TIME ZONE 'Europe/Zagreb' AS DATE) = d.day""")
def semi_capture(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = series.local_columns(_hours(spark, sf_dir))
    kept = h.groupBy("key", "day").count().filter(f"count >= {MIN_DAY_HOURS}")
    return h.join(kept, ["key", "day"], "left_semi").select("key", "t", rounded(F.col("v")).alias("v"))


@query(f"""{H}, w AS (SELECT key, t, avg(v) OVER x AS v, count(v) OVER x AS n FROM h WINDOW x AS (PARTITION BY key ORDER BY t RANGE BETWEEN INTERVAL 23 HOUR PRECEDING AND CURRENT ROW))
SELECT key, t, round(v + 1e-9, 6) AS v, n FROM w WHERE n >= 18""")
def trailing_24h(spark: SparkSession, sf_dir: str) -> DataFrame:
    return series.trailing_mean(_hours(spark, sf_dir), 24, 18).withColumn("v", rounded(F.col("v")))


@query(f"{H}, g AS (SELECT key, t, CAST((epoch(t) - epoch(lag(t) OVER (PARTITION BY key ORDER BY t))) / 3600 AS BIGINT) AS hours FROM h) SELECT * FROM g WHERE hours > 1")
def gap_breaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return series.gap_breaks(_hours(spark, sf_dir), 1)


@query("""WITH x AS (SELECT event_id, value * 3 - 200 AS s, value / 60 AS u, value % 100 AS c FROM events)
SELECT event_id, CASE WHEN s > 0 THEN substr(CASE WHEN s >= 925 THEN 'AABCC' WHEN s >= 675 THEN 'ABBCD' WHEN s >= 175 THEN 'BCCDD' ELSE 'DDDDD' END,
CASE WHEN u < 2 THEN 1 WHEN u < 3 THEN 2 WHEN u < 5 THEN 3 WHEN u < 6 THEN 4 ELSE 5 END, 1) WHEN c >= 95 THEN 'D'
WHEN c > 40 THEN CASE WHEN u < 1.9 THEN 'F' WHEN u < 3.4 THEN 'E' ELSE 'D' END ELSE CASE WHEN u < 3.4 THEN 'F' WHEN u < 5.5 THEN 'E' ELSE 'D' END END AS cls FROM x""")
def stability_class(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = F.col("value")
    return table(spark, sf_dir, "events").select("event_id", weather.stability(v / 60, v * 3 - 200, v % 100).alias("cls"))


def _level_sql(scheme: str, op: str) -> str:
    whens = " ".join(f"WHEN '{p}' THEN 1 + " + " + ".join(f"(v {op} {x})::INT" for x in limits) for p, limits in INDEX_LIMITS[scheme].items())
    return f"CAST(CASE p {whens} ELSE 0 END AS INTEGER)"


@query(f"""WITH x AS (SELECT event_id, ['pm25', 'pm10', 'no2', 'o3', 'so2', 'co'][event_id % 6 + 1] AS p, value * 2 AS v FROM events),
y AS (SELECT event_id, p, {_level_sql('european', '>')} AS level, {_level_sql('national', '>')} AS national, {_level_sql('european', '>=')} AS band FROM x)
SELECT *, CASE WHEN level = 0 THEN '#6F6F6F' ELSE ['#50F0E6', '#50CCAA', '#F0E641', '#FF5050', '#960032', '#7D2181'][level] END AS colour FROM y""")
def eaqi_level(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Levels of five pollutants by two schemes, colours and display bands."""
    p = F.get(F.array(*map(F.lit, ("pm25", "pm10", "no2", "o3", "so2", "co"))), (F.col("event_id") % 6).cast("int"))
    rows = table(spark, sf_dir, "events").select("event_id", p.alias("p"), (F.col("value") * 2).alias("v"))
    band = F.lit(0)
    for name, limits in INDEX_LIMITS["european"].items():
        band = F.when(F.col("p") == name, chemistry.band(F.col("v"), limits)).otherwise(band)
    level = chemistry.index_level(F.col("p"), F.col("v"))
    return rows.select("event_id", "p", level.alias("level"), chemistry.index_level(F.col("p"), F.col("v"), "national").alias("national"), band.alias("band"), chemistry.index_colour(level).alias("colour"))


@query("""WITH k AS (SELECT event_id, i, CASE WHEN value / 100 < 0.5 OR event_id % 7 = 0 OR event_id % 11 = 0 THEN 1 ELSE exp(-0.5 * power(abs((i * 22.5 - (value * 7.3) % 360 + 180 + 360) % 360 - 180) / least(60, 22.5 * greatest(1, 2 / greatest(value / 100, 1e-9))), 2)) END AS w
FROM events CROSS JOIN range(16) r(i)) SELECT event_id, CAST(i AS INTEGER) AS sector, round(w / sum(w) OVER (PARTITION BY event_id) + 1e-9, 6) AS w FROM k""")
def direction_kernel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Also for hours without bearing or speed."""
    known = lambda m, c: F.when(F.col("event_id") % m != 0, c)
    w = weather.direction_weights(known(7, weather.wrap360(F.col("value") * 7.3)), known(11, F.col("value") / 100))
    return table(spark, sf_dir, "events").select("event_id", F.posexplode(w).alias("sector", "w")).withColumn("w", rounded(F.col("w")))


def scheme_sql(source: str, keep: str, added: str, no2: str, nox: str, o3: str, tau: str, j: str, k: str) -> str:
    """CTEs ending in ``sch`` (keep, no2, no, o3, nox, ox): the NO2 scheme over rows of ``source``, f = 0.1."""
    return f"""sa AS (SELECT {keep}, greatest(0, coalesce({added}, 0)) / {PPB['no2']} AS dn, greatest(0, coalesce({no2}, 0)) / {PPB['no2']} AS xb, greatest(0, coalesce({nox}, 0)) / {PPB['no2']} AS nb, greatest(0, coalesce({o3}, 0)) / {PPB['o3']} AS ob, {tau} AS tau, greatest(0, coalesce({j}, 0)) AS j, {k} AS k FROM {source}),
sb AS (SELECT *, nb + dn AS n, ob + xb + 0.1::DOUBLE * dn AS x, xb + 0.1::DOUBLE * dn AS y0 FROM sa), sc AS (SELECT *, n + x + j / k AS b FROM sb), sd AS (SELECT *, sqrt(greatest(1e-12, b * b - 4 * n * x)) AS r FROM sc),
se AS (SELECT *, (b - r) / 2 AS lo, (b + r) / 2 AS hi FROM sd), sf AS (SELECT *, (y0 - lo) / CASE WHEN abs(y0 - hi) >= 1e-12 THEN y0 - hi END * exp(-least(k * r * tau, 700)) AS c FROM se),
sg AS (SELECT *, greatest(0, least(CASE WHEN tau <= 0 OR k <= 0 THEN y0 ELSE coalesce((lo - hi * c) / nullif(1 - c, 0), lo) END, n, x)) AS y FROM sf),
sch AS (SELECT {keep}, y * {PPB['no2']} AS no2, (n - y) * {PPB['no']} AS no, (x - y) * {PPB['o3']} AS o3, n * {PPB['no2']} AS nox, x AS ox FROM sg)"""


@query(f"""WITH xx AS (SELECT event_id, value / 2 - 5 AS a, value / 4 AS b, value / 3 AS c, CASE WHEN event_id % 9 > 0 THEN 80 - value / 5 END AS d, CAST(event_id % 4 * 30 AS DOUBLE) AS tau FROM events),
{scheme_sql('xx', 'event_id', 'a', 'b', 'c', 'd', 'tau', '0.005::DOUBLE', '0.0004::DOUBLE')}
SELECT event_id, round(no2 + 1e-9, 6) AS no2, round(no + 1e-9, 6) AS no, round(o3 + 1e-9, 6) AS o3, round(nox + 1e-9, 6) AS nox, round(ox + 1e-9, 6) AS ox FROM sch""")
def no2_chemistry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole scheme, with a missing ozone, negative increments and no time to react among the rows."""
    v, i = F.col("value"), F.col("event_id")
    out = chemistry.with_no2(table(spark, sf_dir, "events"), "made", v / 2 - 5, v / 4, v / 3, F.when(i % 9 > 0, 80 - v / 5), (i % 4 * 30).cast("double"), F.lit(0.005), F.lit(0.0004))
    return out.select("event_id", *(rounded(F.col(f"made.{k}")).alias(k) for k in ("no2", "no", "o3", "nox", "ox")))


@query("""WITH g AS (SELECT l_returnflag, g.u0, ln(l_extendedprice / 1000 + 1) - ln(l_quantity / sqrt(l_tax * 100 * l_tax * 100 + g.u0 * g.u0)) AS x FROM lineitem CROSS JOIN (SELECT (i + 1) * 0.25::DOUBLE AS u0 FROM range(16) r(i)) g WHERE l_quantity > 0),
s AS (SELECT l_returnflag, u0, avg(x) AS m, round(var_pop(x) + 1e-9, 9) AS loss FROM g GROUP BY 1, 2)
SELECT l_returnflag, u0, round(exp(m) + 1e-9, 6) AS beta, round(loss, 6) AS loss FROM s QUALIFY row_number() OVER (PARTITION BY l_returnflag ORDER BY loss, u0) = 1""")
def grid_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").select("l_returnflag", (F.col("l_extendedprice") / 1000).alias("o"), F.col("l_quantity").alias("s"), (F.col("l_tax") * 100).alias("u"))
    out = fitting.grid_fit(rows, [0.25 * (i + 1) for i in range(16)], 1.0, "l_returnflag")
    return out.select("l_returnflag", "u0", rounded(F.col("beta")).alias("beta"), F.round("loss", 6).alias("loss"))


@query("""WITH p AS (SELECT p_partkey AS id, (p_partkey * 37) % 1000 / 1.0::DOUBLE AS x, (p_partkey * 91) % 997 / 1.0::DOUBLE AS z FROM part)
SELECT a.id AS a_id, b.id AS b_id, round(sqrt(power(a.x - b.x, 2) + power(a.z - b.z, 2)) + 1e-9, 6) AS d FROM p a JOIN p b ON sqrt(power(a.x - b.x, 2) + power(a.z - b.z, 2)) <= 20 AND a.id < b.id""")
def bucketed_proximity(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), ((F.col("p_partkey") * 37) % 1000).cast("double").alias("x"), ((F.col("p_partkey") * 91) % 997).cast("double").alias("z"))
    return spatial.close_pairs(p, 20.0).withColumn("d", rounded(F.col("d")))


RING = [(100.0, 100.0), (800.0, 200.0), (500.0, 500.0), (900.0, 900.0), (150.0, 700.0)]


@query(f"""WITH p AS (SELECT p_partkey AS id, (p_partkey * 37) % 1000 / 1.0::DOUBLE AS x, (p_partkey * 91) % 997 / 1.0::DOUBLE AS z FROM part),
e(x1, z1, x2, z2) AS (VALUES {', '.join(f'({a[0]}::DOUBLE, {a[1]}::DOUBLE, {b[0]}::DOUBLE, {b[1]}::DOUBLE)' for a, b in zip(RING, RING[1:] + RING[:1], strict=True))})
SELECT id FROM p CROSS JOIN e WHERE (z1 > z) <> (z2 > z) AND x < (x2 - x1) * (z - z1) / (z2 - z1) + x1 GROUP BY id HAVING count(*) % 2 = 1""")
def point_in_polygon(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), ((F.col("p_partkey") * 37) % 1000).cast("double").alias("x"), ((F.col("p_partkey") * 91) % 997).cast("double").alias("z"))
    return p.filter(spatial.inside(F.col("x"), F.col("z"), RING)).select("id")


@query("""WITH l AS (SELECT event_id, (ts - INTERVAL 1 HOUR) AT TIME ZONE 'UTC' AT TIME ZONE 'Europe/Zagreb' AS t FROM events)
SELECT event_id, CAST(year(t) AS INTEGER) AS year, CAST(month(t) AS INTEGER) AS month, CAST(day(t) AS INTEGER) AS day, CAST(hour(t) AS INTEGER) AS hour, CAST(isodow(t) - 1 AS INTEGER) AS dow FROM l""")
def local_calendar(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = local_start(F.col("ts"))
    return table(spark, sf_dir, "events").select("event_id", F.year(t).alias("year"), F.month(t).alias("month"), F.dayofmonth(t).alias("day"), F.hour(t).alias("hour"), F.weekday(t).alias("dow"))


@query(f"{PAIRS} SELECT l_returnflag, l_linestatus, round(abs(o - p) + 1e-9, 6) AS off FROM x ORDER BY abs(o - p) DESC, l_returnflag, l_linestatus LIMIT 3")
def topk_worst(spark: SparkSession, sf_dir: str) -> DataFrame:
    off = F.abs(F.col("o") - F.col("p"))
    return _pairs(spark, sf_dir).orderBy(off.desc(), "l_returnflag", "l_linestatus").limit(3).select("l_returnflag", "l_linestatus", rounded(off).alias("off"))


@query("SELECT event_type AS key, CAST(date_trunc('hour', ts) + INTERVAL 1 HOUR AS TIMESTAMP) AS t, round(avg(value) + 1e-9, 6) AS v, count(value) AS n FROM events GROUP BY 1, 2")
def hourly_stream_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = hourly_stream(table(spark, sf_dir, "events"), "event_type", "ts", "value")
    return out.select("key", F.col("t").cast("timestamp_ntz").alias("t"), rounded(F.col("v")).alias("v"), "n")
