"""Queries of meteorology, dispersion, holidays, cleaning and geometry on the driver's tables, with SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from aerolake.functions import calendar, chemistry, weather
from aerolake.functions.calendar import rounded
from aerolake.functions.dimensions import NO2_BREAKS
from aerolake.operators import cleaning, series, spatial
from aerolake.plans.queries import H, _hours
from aerolake.sources import sinks
from aerolake.sources.tables import table

QUERIES: dict = {}
ORACLES: dict[str, str] = {}
SITE = (45.8, 16.0)


def query(sql: str):
    def register(f):
        QUERIES[f.__name__] = f
        ORACLES[f.__name__] = sql
        return f

    return register


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events")


SUN = f"""WITH a AS (SELECT event_id, value % 100 AS cloud, hour(ts) + minute(ts) / 60 + second(ts) / 3600 AS h, dayofyear(ts) AS d, dayofyear(make_date(year(ts), 12, 31)) AS n FROM events),
b AS (SELECT *, 2 * pi() / n * (d - 1 + (h - 12) / 24) AS g FROM a),
c AS (SELECT *, 229.18::DOUBLE * (0.000075::DOUBLE + 0.001868 * cos(g) - 0.032077 * sin(g) - 0.014615 * cos(2 * g) - 0.040849 * sin(2 * g)) AS eq,
0.006918::DOUBLE - 0.399912 * cos(g) + 0.070257 * sin(g) - 0.006758 * cos(2 * g) + 0.000907 * sin(2 * g) - 0.002697 * cos(3 * g) + 0.00148 * sin(3 * g) AS tilt FROM b),
s AS (SELECT event_id, cloud, 90 - degrees(acos(greatest(-1, least(1, sin(radians({SITE[0]})) * sin(tilt) + cos(radians({SITE[0]})) * cos(tilt) * cos(radians((h * 60 + eq + 4 * {SITE[1]}) / 4 - 180)))))) AS e FROM c)"""


@query(f"""{SUN} SELECT event_id, round(e + 1e-9, 6) AS elevation, round(CASE WHEN e > 0 THEN greatest(0, (990 * sin(radians(e)) - 30) * (1 - 0.75 * power(cloud / 100, 3.4))) ELSE 0 END + 1e-9, 5) AS sun FROM s""")
def sun_and_irradiance(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _events(spark, sf_dir).select("event_id", weather.solar_elevation(F.col("ts"), *SITE).alias("e"), (F.col("value") % 100).alias("cloud"))
    return rows.select("event_id", rounded(F.col("e")).alias("elevation"), rounded(weather.irradiance(F.col("e"), F.col("cloud")), 5).alias("sun"))


@query("""WITH x AS (SELECT event_id, value % 40 AS u, value, ['A', 'B', 'C', 'D', 'E', 'F', 'AC', 'EF'][event_id % 8 + 1] AS c FROM events)
SELECT event_id, CAST((u >= 0.3)::INT + (u >= 1.6)::INT + (u >= 3.4)::INT + (u >= 5.5)::INT + (u >= 8.0)::INT + (u >= 10.8)::INT + (u >= 13.9)::INT + (u >= 17.2)::INT + (u >= 20.8)::INT + (u >= 24.5)::INT + (u >= 28.5)::INT + (u >= 32.7)::INT AS INTEGER) AS force,
CASE WHEN c IN ('A', 'B', 'C', 'AC') THEN 'AC' WHEN c = 'D' THEN 'D' ELSE 'EF' END AS grp,
round(CASE c WHEN 'A' THEN -0.096 + 0.029 * log10(0.5) WHEN 'B' THEN -0.037 + 0.029 * log10(0.5) WHEN 'AC' THEN -0.037 + 0.029 * log10(0.5) WHEN 'C' THEN -0.002 + 0.018 * log10(0.5) WHEN 'D' THEN 0 WHEN 'E' THEN 0.004 - 0.018 * log10(0.5) ELSE 0.035 - 0.036 * log10(0.5) END + 1e-9, 6) AS inverse_l,
round(greatest(CASE WHEN value > 100 THEN value * 5 ELSE CASE c WHEN 'A' THEN 1178 WHEN 'B' THEN 520 WHEN 'AC' THEN 520 WHEN 'C' THEN 1060 WHEN 'D' THEN 135 WHEN 'E' THEN 278 ELSE 30 END END, 100) + 1e-9, 4) AS mixing,
round(CASE WHEN (value * 7.3 - 90 + 3600) % 360 > 180 THEN (value * 7.3 - 90 + 3600) % 360 - 360 ELSE (value * 7.3 - 90 + 3600) % 360 END + 1e-9, 5) AS apart FROM x""")
def boundary_layer(spark: SparkSession, sf_dir: str) -> DataFrame:
    v, c = F.col("value"), F.col("c")
    rows = _events(spark, sf_dir).withColumn("c", F.get(F.array(*map(F.lit, (*"ABCDEF", "AC", "EF"))), (F.col("event_id") % 8).cast("int")))
    return rows.select(
        "event_id", weather.beaufort(v % 40).alias("force"), weather.stability_group(c).alias("grp"), rounded(weather.inverse_obukhov(c, 0.8)).alias("inverse_l"),
        rounded(weather.mixing_height(c, F.when(v > 100, v * 5), 100.0), 4).alias("mixing"), rounded(weather.angle_between(v * 7.3, F.lit(90.0)), 5).alias("apart"),
    )


@query("""SELECT event_id, round(greatest(0, 1.05 * (1.47e-5 * value * 2 - 4.84e-9 * value * 2 * value * 2)) * 1e4 + 1e-9, 6) AS j,
round(3.0e-12 * exp(-1500 / (value % 30 + 273.15)) * (7.2429e18 * 1013.25 / (value % 30 + 273.15)) * 1e-9 * 1e4 + 1e-9, 6) AS k FROM events""")
def rate_constants(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = F.col("value")
    return _events(spark, sf_dir).select("event_id", rounded(chemistry.photolysis(v * 2) * 1e4).alias("j"), rounded(chemistry.titration(v % 30) * 1e4).alias("k"))


@query("""WITH x AS (SELECT event_id, value * 4 AS x, substr('ABCDEF', CAST(event_id % 6 AS INTEGER) + 1, 1) AS c FROM events)
SELECT event_id, round(CASE c WHEN 'A' THEN 0.32 WHEN 'B' THEN 0.32 WHEN 'C' THEN 0.22 WHEN 'D' THEN 0.16 ELSE 0.11 END * x / sqrt(1 + 0.0004 * x) + 1e-9, 6) AS sy,
round(CASE c WHEN 'A' THEN 0.24 * x * sqrt(1 + 0.001 * x) WHEN 'B' THEN 0.24 * x * sqrt(1 + 0.001 * x) WHEN 'C' THEN 0.2 * x WHEN 'D' THEN 0.14 * x / sqrt(1 + 0.0003 * x) ELSE 0.08 * x / sqrt(1 + 0.0015 * x) END + 1e-9, 6) AS sz FROM x""")
def plume_spread(spark: SparkSession, sf_dir: str) -> DataFrame:
    across, up = chemistry.briggs(F.substr(F.lit("ABCDEF"), (F.col("event_id") % 6 + 1).cast("int"), F.lit(1)), F.col("value") * 4)
    return _events(spark, sf_dir).select("event_id", rounded(across).alias("sy"), rounded(up).alias("sz"))


@query("""WITH x AS (SELECT event_id, value AS v, sqrt(power(value / 60, 2) + 1.44) AS u FROM events), y AS (SELECT *, 1 * v + 2 * v / 2 + 4 * 1.0 AS g, 1 * 30 * v + 2 * 50.0 + 4 * 90.0 AS a FROM x)
SELECT event_id, round(1e6 * 2e-6 * g / u + 1e-9, 5) AS total, round(1e6 * 2e-6 * 1 * v / u + 1e-9, 5) AS first, round(CASE WHEN g > 0 THEN a / (u * u) / (g / u) ELSE 60 END + 1e-9, 5) AS tau FROM y""")
def group_increment(spark: SparkSession, sf_dir: str) -> DataFrame:
    v, lit = F.col("value"), F.lit
    total, parts, tau = chemistry.increment(F.array(v, v / 2, lit(1.0)), F.array(30 * v, lit(50.0), lit(90.0)), F.array(lit(1.0), lit(2.0), lit(4.0)), weather.u_eff(v / 60, lit(1.2)), 2e-6)
    return _events(spark, sf_dir).select("event_id", rounded(total, 5).alias("total"), rounded(parts[0], 5).alias("first"), rounded(tau, 5).alias("tau"))


EASTER = """k AS (SELECT *, year(d) AS y, year(d) // 100 AS k FROM x), m AS (SELECT *, (15 + k - k // 4 - (8 * k + 13) // 25 + 30) % 30 AS m, (4 + k - k // 4) % 7 AS n FROM k),
p AS (SELECT *, (19 * (y % 19) + m) % 30 AS a FROM m), q AS (SELECT *, (2 * (y % 4) + 4 * (y % 7) + 6 * a + n) % 7 AS b FROM p),
e AS (SELECT *, make_date(y, 3, 22) + CAST(a + b - CASE WHEN (a = 29 AND b = 6) OR (a = 28 AND b = 6 AND y % 19 > 10) THEN 7 ELSE 0 END AS INTEGER) AS easter FROM q)"""


@query(f"""WITH x AS (SELECT o_orderkey, CAST(o_orderdate AS DATE) AS d FROM orders), {EASTER}
SELECT o_orderkey, CASE WHEN isodow(d) = 7 OR month(d) * 100 + day(d) IN (101, 106, 501, 530, 622, 805, 815, 1101, 1118, 1225, 1226) OR d - easter IN (1, 60) THEN 'sunday' WHEN isodow(d) = 6 THEN 'saturday' ELSE 'weekday' END AS daytype FROM e""")
def holiday_day_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select("o_orderkey", calendar.day_type_with_holidays(F.to_date("o_orderdate")).alias("daytype"))


LOCAL = "(({}) - INTERVAL 1 HOUR) AT TIME ZONE 'UTC' AT TIME ZONE 'Europe/Zagreb'"


@query(f"WITH l AS (SELECT event_id, {LOCAL.format('ts')} AS t FROM events) SELECT event_id, strftime(t, '%d.%m.%Y ') || lpad(CAST(hour(t) + 1 AS VARCHAR), 2, '0') || ':00' AS label FROM l")
def hour_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _events(spark, sf_dir).select("event_id", calendar.hour_label(F.col("ts")).alias("label"))


HOURS_IN = "(CAST(epoch(CAST((make_timestamp({y} + 1, 1, 1, 0, 0, 0) AT TIME ZONE 'Europe/Zagreb') AS TIMESTAMPTZ)) - epoch(CAST((make_timestamp({y}, 1, 1, 0, 0, 0) AT TIME ZONE 'Europe/Zagreb') AS TIMESTAMPTZ)) AS BIGINT) / 3600)"


@query(f"""{H}, y AS (SELECT key, year({LOCAL.format('t')}) AS y, count(v) AS n, avg(v) AS m FROM h GROUP BY 1, 2), c AS (SELECT *, n / {HOURS_IN.format(y='y')} AS share FROM y)
SELECT key, CAST(y AS INTEGER) AS year, n, round(100 * share + 1e-9, 4) AS coverage, round(CASE WHEN y <= 2025 AND share >= 0.75 THEN m END + 1e-9, 6) AS v FROM c""")
def annual_local(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = series.annual(_hours(spark, sf_dir), 2025)
    return out.select("key", "year", "n", rounded(F.col("coverage"), 4).alias("coverage"), rounded(F.col("v")).alias("v"))


@query(f"""{H}, l AS (SELECT key, max(t) AS last, arg_max(v, t) AS lv FROM h GROUP BY 1), m AS (SELECT h.key, last, lv, avg(v) AS m, count(*) AS n FROM h JOIN l ON h.key = l.key AND t > last - INTERVAL 24 HOUR GROUP BY 1, 2, 3)
SELECT key, last AS t, round(lv + 1e-9, 6) AS v, round(CASE WHEN n >= 18 THEN m END + 1e-9, 6) AS mean, last < (SELECT max(last) FROM l) - INTERVAL 6 HOUR AS stale, CAST(1 + (lv > 10)::INT + (lv > 25)::INT + (lv > 60)::INT + (lv > 100)::INT + (lv > 150)::INT AS INTEGER) AS level FROM m""")
def now_chips(spark: SparkSession, sf_dir: str) -> DataFrame:
    level = chemistry.level(F.col("v"), NO2_BREAKS)
    return series.now(_hours(spark, sf_dir)).select("key", "t", rounded(F.col("v")).alias("v"), rounded(F.col("mean")).alias("mean"), "stale", level.alias("level"))


@query("""WITH x AS (SELECT CASE event_type WHEN 'view' THEN 'z1.ws' WHEN 'click' THEN 'z4.rh' WHEN 'purchase' THEN 'z1.no2' ELSE 'ifs.ws' END AS key, value AS v FROM events),
y AS (SELECT key, CASE key WHEN 'z1.ws' THEN v BETWEEN 0 AND 40 WHEN 'z4.rh' THEN v BETWEEN 0 AND 100.5 ELSE true END AS good FROM x)
SELECT key, CAST(count(*) FILTER (good) AS BIGINT) AS kept, CAST(count(*) FILTER (NOT good) AS BIGINT) AS dropped FROM y GROUP BY 1""")
def plausibility(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = F.col("event_type")
    key = F.when(e == "view", "z1.ws").when(e == "click", "z4.rh").when(e == "purchase", "z1.no2").otherwise("ifs.ws")
    return cleaning.dropped(_events(spark, sf_dir).select(key.alias("key"), F.col("value").alias("v")))


@query("SELECT event_type AS key, CAST(date_trunc('hour', ts) AS TIMESTAMP) AS t, arg_min(value, event_id) AS v, min(event_id) AS event_id FROM events GROUP BY 1, 2")
def first_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _events(spark, sf_dir).select(F.col("event_type").alias("key"), F.date_trunc("HOUR", "ts").cast("timestamp_ntz").alias("t"), F.col("value").alias("v"), "event_id")
    return cleaning.first_wins(rows, "event_id", "key", "t")


@query(f"{H}, e AS (SELECT key, t, CASE WHEN t <= (SELECT max(t) - INTERVAL 48 HOUR FROM h) THEN v END AS v FROM h) SELECT key, t, round(v + 1e-9, 6) AS v FROM e WHERE t <= (SELECT max(t) FROM e WHERE v IS NOT NULL)")
def trim_tail(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = _hours(spark, sf_dir)
    end = h.agg((F.max("t") - F.expr("INTERVAL 48 HOURS")).alias("end"))
    cut = h.join(F.broadcast(end), F.lit(True)).select("key", "t", F.when(F.col("t") <= F.col("end"), F.col("v")).alias("v"))  # one row
    return cleaning.trim_tail(cut, "v").withColumn("v", rounded(F.col("v")))


@query(f"{H}, n AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY t) AS n FROM h) SELECT key, t, round(v + 1e-9, 6) AS v FROM n WHERE n % 7 = 1")
def every_seventh(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cleaning.every_kth(_hours(spark, sf_dir), 7).withColumn("v", rounded(F.col("v")))


CODE = "CAST(greatest(-32767, least(32767, round_even(v / 0.1, 0))) AS INTEGER)"


@query(f"""{H}, q AS (SELECT key, CAST(t AS DATE) AS day, t, lpad(format('{{:X}}', ({CODE} + 65536) % 65536), 4, '0') AS x FROM h)
SELECT key, day, count(*) AS n, 0::BIGINT AS clipped, to_base64(unhex(string_agg(substr(x, 3, 2) || substr(x, 1, 2), '' ORDER BY t))) AS data FROM q GROUP BY 1, 2""")
def packed_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cleaning.packed(_hours(spark, sf_dir).withColumn("day", F.to_date("t")), 0.1, "key", "day")


@query(f"{H} SELECT key, CAST(t AS DATE) AS day, CAST(row_number() OVER (PARTITION BY key, CAST(t AS DATE) ORDER BY t) - 1 AS INTEGER) AS i, round({CODE} * 0.1 + 1e-9, 6) AS v FROM h")
def unpacked_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = cleaning.unpacked(packed_days(spark, sf_dir), 0.1, "key", "day")
    return out.withColumn("v", rounded(F.col("v")))


@query("""WITH r AS (SELECT event_type AS key, CAST(year(ts) AS INTEGER) AS year, CAST(day(ts) AS INTEGER) AS d, value AS v FROM events)
SELECT key, year, 'raw' AS source, count(v) AS before, CAST(count(v) FILTER (d > 5 OR key <> 'view') AS BIGINT) AS after FROM r GROUP BY 1, 2 HAVING count(v) FILTER (d > 5 OR key <> 'view') < count(v) - 20""")
def shrink_guard(spark: SparkSession, sf_dir: str) -> DataFrame:
    old = _events(spark, sf_dir).select(F.col("event_type").alias("key"), F.year("ts").alias("year"), F.lit("raw").alias("source"), F.dayofmonth("ts").alias("d"), F.col("value").alias("v"))
    return sinks.shrinking(old.filter("d > 5 or key <> 'view'"), old, 20)


@query("SELECT o_orderstatus AS key, CAST(year(o_orderdate) AS INTEGER) AS year, count(o_totalprice) AS n, x.expected, round(100.0::DOUBLE * count(o_totalprice) / x.expected + 1e-9, 6) AS percent FROM orders JOIN (SELECT y AS year, CASE WHEN y % 4 = 0 THEN 8784 ELSE 8760 END AS expected FROM range(1992, 1999) r(y)) x ON x.year = year(o_orderdate) GROUP BY 1, 2, 4")
def completeness(spark: SparkSession, sf_dir: str) -> DataFrame:
    years = spark.range(1992, 1999).select(F.col("id").cast("int").alias("year")).withColumn("expected", calendar.hours_in_local_year(F.col("year")))
    rows = table(spark, sf_dir, "orders").select(F.col("o_orderstatus").alias("key"), F.year("o_orderdate").alias("year"), F.col("o_totalprice").alias("v"))
    return sinks.completeness(rows, years).withColumn("percent", rounded(F.col("percent")))


@query("WITH r AS (SELECT o_orderstatus AS key, CAST(year(o_orderdate) AS INTEGER) AS year, count(o_totalprice) AS n FROM orders GROUP BY 1, 2), x AS (SELECT *, CASE WHEN year % 4 = 0 AND (year % 100 <> 0 OR year % 400 = 0) THEN 8784 ELSE 8760 END AS expected FROM r) SELECT key, year, n, expected, round(100.0::DOUBLE * n / expected + 1e-9, 6) AS percent FROM x WHERE year IS NOT NULL")
def completeness_all_years(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "orders").select(F.col("o_orderstatus").alias("key"), F.year("o_orderdate").alias("year"), F.col("o_totalprice").alias("v"))
    years = rows.select("year").distinct().withColumn("expected", calendar.hours_in_local_year(F.col("year")))
    return sinks.completeness(rows, years).withColumn("percent", rounded(F.col("percent")))


POINTS = "p AS (SELECT p_partkey AS id, ((p_partkey * 37) % 1000)::DOUBLE AS x, ((p_partkey * 91) % 997)::DOUBLE AS z FROM part)"


def _points(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey")
    return table(spark, sf_dir, "part").select(k.alias("id"), ((k * 37) % 1000).cast("double").alias("x"), ((k * 91) % 997).cast("double").alias("z"))


@query(f"""WITH {POINTS}, q AS (SELECT s_suppkey AS id, ((s_suppkey * 53) % 1000)::DOUBLE AS x, ((s_suppkey * 71) % 997)::DOUBLE AS z FROM supplier),
d AS (SELECT p.id AS a_id, q.id AS b_id, sqrt(power(p.x - q.x, 2) + power(p.z - q.z, 2)) AS d FROM p, q)
SELECT a_id, arg_min(b_id, (d, b_id)) AS b_id, round(min(d) + 1e-9, 6) AS d FROM d WHERE d <= 100 GROUP BY 1""")
def nearest_within(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("s_suppkey")
    b = table(spark, sf_dir, "supplier").select(k.alias("id"), ((k * 53) % 1000).cast("double").alias("x"), ((k * 71) % 997).cast("double").alias("z"))
    return spatial.nearest(_points(spark, sf_dir), b, 100.0).withColumn("d", rounded(F.col("d")))


@query(f"""WITH {POINTS}, s AS (SELECT id, x AS x1, z AS z1, x + 30 - id % 61 AS x2, z + 25 - id % 47 AS z2 FROM p),
j AS (SELECT a.id AS a_id, b.id AS b_id, a.x1, a.z1, a.x2 - a.x1 AS ax, a.z2 - a.z1 AS az, b.x2 - b.x1 AS bx, b.z2 - b.z1 AS bz, b.x1 - a.x1 AS gx, b.z1 - a.z1 AS gz FROM s a JOIN s b ON a.id < b.id),
k AS (SELECT *, (gx * bz - gz * bx) / (ax * bz - az * bx) AS t, (gx * az - gz * ax) / (ax * bz - az * bx) AS u FROM j WHERE ax * bz - az * bx <> 0)
SELECT a_id, b_id, round(x1 + t * ax + 1e-9, 6) AS x, round(z1 + t * az + 1e-9, 6) AS z FROM k WHERE t BETWEEN 0 AND 1 AND u BETWEEN 0 AND 1""")
def street_crossings(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = _points(spark, sf_dir).select("id", F.col("x").alias("x1"), F.col("z").alias("z1"), (F.col("x") + 30 - F.col("id") % 61).alias("x2"), (F.col("z") + 25 - F.col("id") % 47).alias("z2"))
    return spatial.crossings(s, 32.0).select("a_id", "b_id", *(calendar.half_even(F.col(c) + 1e-9, 6).alias(c) for c in "xz"))  # as rounded() but for ties that the offset moves; decimals cost more than the crossing


@query("""WITH r AS (SELECT (s_suppkey - 1) // 4 AS row, (s_suppkey - 1) % 4 AS col, s_acctbal AS v FROM supplier), p AS (SELECT p_partkey AS id, ((p_partkey * 37) % 300) / 100 AS x, ((p_partkey * 91) % 200) / 100 AS z FROM part),
c AS (SELECT id, floor(z) + q AS row, floor(x) + p AS col, (CASE p WHEN 1 THEN x - floor(x) ELSE 1 - (x - floor(x)) END) * (CASE q WHEN 1 THEN z - floor(z) ELSE 1 - (z - floor(z)) END) AS w FROM p CROSS JOIN (VALUES (0, 0), (0, 1), (1, 0), (1, 1)) o(p, q))
SELECT id, round(sum(w * v) / sum(w) + 1e-9, 5) AS v FROM c JOIN r ON c.row = r.row AND c.col = r.col WHERE w > 0 GROUP BY 1""")
def terrain_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("s_suppkey") - 1
    raster = table(spark, sf_dir, "supplier").select(F.floor(k / 4).alias("row"), (k % 4).alias("col"), F.col("s_acctbal").alias("v"))
    part = F.col("p_partkey")
    points = table(spark, sf_dir, "part").select(part.alias("id"), ((part * 37) % 300 / 100).alias("x"), ((part * 91) % 200 / 100).alias("z"))
    return spatial.bilinear(points, raster).withColumn("v", rounded(F.col("v"), 5))


@query("SELECT p_partkey AS id, round(((p_size + 1) * (p_size + 2) + p_partkey % 7 * (p_size + 2)) / 2.0::DOUBLE + 1e-9, 6) AS area FROM part")
def ring_areas(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Triangle (0, 0), (size + 1 + key % 7, 0), (3, size + 2)."""
    a, b, zero = (F.col("p_size") + 1 + F.col("p_partkey") % 7).cast("double"), (F.col("p_size") + 2).cast("double"), F.lit(0.0)
    point = lambda x, z: F.struct(x.alias("x"), z.alias("z"))
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), rounded(spatial.ring_area(F.array(point(zero, zero), point(a, zero), point(F.lit(3.0), b)))).alias("area"))


@query("""WITH v AS (SELECT l_orderkey AS id, l_linenumber * 100000000 + l_partkey * 100 + CAST(l_quantity AS BIGINT) AS n, l_quantity * 2 AS x, ((l_partkey * 7) % 90)::DOUBLE AS z FROM lineitem),
g AS (SELECT *, lag(x) OVER w AS px, lag(z) OVER w AS pz FROM v WINDOW w AS (PARTITION BY id ORDER BY n)), l AS (SELECT *, coalesce(sqrt(power(x - px, 2) + power(z - pz, 2)), 0) AS len FROM g),
t AS (SELECT *, round(sum(len) OVER (PARTITION BY id ORDER BY n ROWS UNBOUNDED PRECEDING), 9) AS e, round(coalesce(sum(len) OVER (PARTITION BY id ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0), 9) AS b FROM l),
m AS (SELECT *, unnest(range(CAST(ceil(b / 10) AS BIGINT), CAST(ceil(e / 10) AS BIGINT))) AS k FROM t WHERE len > 0)
SELECT id, k * 10.0::DOUBLE AS s, round(px + (k * 10 - b) / len * (x - px) + 1e-9, 4) AS x, round(pz + (k * 10 - b) / len * (z - pz) + 1e-9, 4) AS z FROM m""")
def points_along(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("id"), (F.col("l_linenumber").cast("bigint") * 100000000 + F.col("l_partkey") * 100 + F.col("l_quantity").cast("bigint")).alias("n"), (F.col("l_quantity") * 2).cast("double").alias("x"), ((F.col("l_partkey") * 7) % 90).cast("double").alias("z"))
    return spatial.along(v, 10.0).select("id", "s", rounded(F.col("x"), 4).alias("x"), rounded(F.col("z"), 4).alias("z"))


@query("""WITH u AS (SELECT o_custkey AS line, greatest(o_totalprice - lag(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderkey), 0) AS up, lag(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS b FROM orders)
SELECT line, round(coalesce(sum(CASE WHEN b IS NOT NULL THEN up END), 0) + 1e-9, 2) AS frontal FROM u GROUP BY 1""")
def frontal_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("line"), F.col("o_orderkey").alias("place"), F.col("o_totalprice").alias("h"))
    return spatial.frontal(rows, "line").withColumn("frontal", rounded(F.col("frontal"), 2))
