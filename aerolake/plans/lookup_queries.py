"""Queries of cascades, climatologies, windows, rankings and rules on map features, with SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from aerolake.functions import places
from aerolake.functions.calendar import rounded
from aerolake.operators import lookups, spatial
from aerolake.plans.ledger import DAYTYPE_H, HOLIDAY_TABLE, LOCAL, SERIES, WEATHER, ledger, weather
from aerolake.sources.intermediate import materialise
from aerolake.sources.tables import table

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str):
    def register(f):
        QUERIES[f.__name__] = f
        ORACLES[f.__name__] = sql
        return f

    return register


@query(f"""WITH {WEATHER}, c AS (SELECT t, u, t2, 0 AS p, 'pinned' AS source FROM w WHERE hour(t) = 6 UNION ALL SELECT t, u + 1, t2, 1, 'archive' FROM w WHERE day(t) % 2 = 0 UNION ALL SELECT t, u + 2, t2, 2, 'live' FROM w WHERE hour(t) > 3)
SELECT t, round(u + 1e-9, 6) AS u, round(t2 + 1e-9, 6) AS t2, source FROM c QUALIFY row_number() OVER (PARTITION BY t ORDER BY p) = 1""")
def weather_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole weather rows from the first of three sources."""
    w = weather(spark, sf_dir).select("t", "u", "t2")
    sources = [("pinned", w.filter(F.hour("t") == 6)), ("archive", w.filter(F.dayofmonth("t") % 2 == 0).withColumn("u", F.col("u") + 1)), ("live", w.filter(F.hour("t") > 3).withColumn("u", F.col("u") + 2))]
    return lookups.cascade(sources, "t").select("t", rounded(F.col("u")).alias("u"), rounded(F.col("t2")).alias("t2"), "source")


@query(f"""WITH {SERIES}, {HOLIDAY_TABLE}, l AS (SELECT key, t, v, {LOCAL.format('t')} AS l FROM s), a AS MATERIALIZED (SELECT key, t, v, {DAYTYPE_H.format('l')} AS d, hour(l) AS h FROM l), n AS MATERIALIZED (SELECT key, d, h, avg(v) AS n FROM a WHERE day(t) <> 15 GROUP BY 1, 2, 3)
SELECT key, t, round(coalesce(CASE WHEN day(t) <> 15 THEN v END, n) + 1e-9, 6) AS v, CASE WHEN day(t) <> 15 THEN 'value' WHEN n IS NOT NULL THEN 'climatology' ELSE 'none' END AS source FROM a LEFT JOIN n USING (key, d, h)""")
def filled_by_climatology(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hours that are missing get the mean of their day type and local hour."""
    s = materialise(ledger(spark, sf_dir), "ledger")
    known = s.filter(F.dayofmonth("t") != 15)
    return lookups.filled(s.select("key", "t"), known, lookups.climatology(known)).withColumn("v", rounded(F.col("v")))


LINES = [("limit", 40.0, None, 1995), ("limit", 20.0, 1996, None), ("guideline", 10.0, None, None), ("target", 25.0, 1994, 1996)]


@query("WITH l(kind, v, since, until) AS (VALUES ('limit', 40.0::DOUBLE, NULL, 1995), ('limit', 20.0, 1996, NULL), ('guideline', 10.0, NULL, NULL), ('target', 25.0, 1994, 1996)), y AS (SELECT DISTINCT CAST(year(o_orderdate) AS INTEGER) AS year FROM orders)\nSELECT year, kind, v, CAST(row_number() OVER (PARTITION BY year ORDER BY v, kind) AS INTEGER) AS place FROM y JOIN l ON (since IS NULL OR year >= since) AND (until IS NULL OR year <= until) WHERE kind IN ('limit', 'target')")
def threshold_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    years = table(spark, sf_dir, "orders").select(F.year("o_orderdate").alias("year")).distinct()
    lines = spark.createDataFrame(LINES, "kind string, v double, since int, until int")
    return lookups.valid_lines(lines, years, "limit", "target").select("year", "kind", "v", "place")


@query(f"WITH {SERIES} SELECT key, t, round(v + 1e-9, 6) AS v FROM s WHERE t > (SELECT max(t) FROM s) - INTERVAL 72 HOUR")
def last_three_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lookups.last_hours(ledger(spark, sf_dir), 72).withColumn("v", rounded(F.col("v")))


@query(f"WITH {SERIES}, l AS (SELECT key, t, {LOCAL.format('t')} AS l FROM s) SELECT key, max(t) AS t FROM l WHERE month(l) = 1 AND isodow(l) = 2 AND hour(l) = 8 GROUP BY 1")
def preset_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The latest January Tuesday, 8 to 9 local."""
    return lookups.preset(ledger(spark, sf_dir), 1, 1, 8)


@query("""WITH v AS (SELECT l_partkey % 50 AS name, l_orderkey AS id, l_linenumber AS n, l_quantity * 2 AS x, ((l_partkey * 7) % 90)::DOUBLE AS z FROM lineitem),
d AS (SELECT name, id, round(sum(d), 6) AS length FROM (SELECT name, id, sqrt(power(x - lag(x) OVER o, 2) + power(z - lag(z) OVER o, 2)) AS d FROM v WINDOW o AS (PARTITION BY name, id ORDER BY n, x, z)) GROUP BY 1, 2)
SELECT name, id, length FROM d WHERE length IS NOT NULL QUALIFY row_number() OVER (PARTITION BY name ORDER BY length DESC, id) = 1""")
def longest_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = table(spark, sf_dir, "lineitem").select((F.col("l_partkey") % 50).alias("name"), F.col("l_orderkey").alias("id"), F.col("l_linenumber").alias("n"), (F.col("l_quantity") * 2).alias("x"), ((F.col("l_partkey") * 7) % 90).cast("double").alias("z"))
    return lookups.longest(v).filter("length is not null")


POINTS = "po AS (SELECT p_partkey AS id, ((p_partkey * 37) % 1000)::DOUBLE AS x, ((p_partkey * 91) % 997)::DOUBLE AS z, ['shop', 'school', 'stop'][p_partkey % 3 + 1] AS kind FROM part)"


def _points(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey")
    return table(spark, sf_dir, "part").select(k.alias("id"), ((k * 37) % 1000).cast("double").alias("x"), ((k * 91) % 997).cast("double").alias("z"), F.get(F.array(*map(F.lit, ("shop", "school", "stop"))), (k % 3).cast("int")).alias("kind"))


@query(f"WITH {POINTS} SELECT id, kind, round(-x * sin(radians(230)) + z * cos(radians(230)) + 1e-9, 6) AS along, CAST(row_number() OVER (PARTITION BY kind ORDER BY -x * sin(radians(230)) + z * cos(radians(230)), id) AS INTEGER) AS place FROM po")
def sorted_along_wind(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lookups.along_wind(_points(spark, sf_dir), 230.0, "kind").select("id", "kind", rounded(F.col("along")).alias("along"), "place")


@query("""WITH s AS (SELECT l_returnflag, l_suppkey % 7 AS source, sum(l_extendedprice) AS w FROM lineitem GROUP BY 1, 2)
SELECT l_returnflag, source, round(w / sum(w) OVER (PARTITION BY l_returnflag) + 1e-9, 6) AS share FROM s QUALIFY row_number() OVER (PARTITION BY l_returnflag ORDER BY w DESC, source) = 1""")
def dominant_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").select("l_returnflag", (F.col("l_suppkey") % 7).alias("source"), "l_extendedprice")
    return lookups.dominant(rows, "l_extendedprice", "source", "l_returnflag").withColumn("share", rounded(F.col("share")))


@query("WITH t AS (SELECT p_partkey AS id, 10 + (p_partkey % 90)::DOUBLE AS area, ((p_partkey * 13) % 500)::DOUBLE AS living FROM part) SELECT id, round(least(3, living / area / (SELECT sum(living) / sum(area) FROM t)) + 1e-9, 6) AS w FROM t")
def tile_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey")
    tiles = table(spark, sf_dir, "part").select(k.alias("id"), (10 + k % 90).cast("double").alias("area"), ((k * 13) % 500).cast("double").alias("living"))
    return lookups.tile_weights(tiles).select("id", rounded(F.col("w")).alias("w"))


@query(f"WITH {POINTS} SELECT kind, min(id) AS id FROM po GROUP BY kind, floor(x / 20), floor(z / 20)")
def one_point_a_cell(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lookups.one_a_cell(_points(spark, sf_dir), 20.0, "kind").select("kind", "id")


@query("""WITH b AS (SELECT l_orderkey AS id, l_partkey % 40 AS i, l_suppkey % 40 AS j FROM lineitem), c AS (SELECT DISTINCT p_partkey % 40 AS i, (p_partkey * 7) % 40 AS j FROM part WHERE p_partkey % 3 > 0)
SELECT id, round(avg((c.i IS NOT NULL)::INT) + 1e-9, 6) AS covered FROM b LEFT JOIN c USING (i, j) GROUP BY 1 HAVING avg((c.i IS NOT NULL)::INT) < 0.5""")
def buildings_not_covered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Buildings of a second survey that the first covers by less than half."""
    b = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("id"), (F.col("l_partkey") % 40).alias("i"), (F.col("l_suppkey") % 40).alias("j"))
    c = table(spark, sf_dir, "part").filter("p_partkey % 3 > 0").select((F.col("p_partkey") % 40).alias("i"), ((F.col("p_partkey") * 7) % 40).alias("j"))
    return lookups.covered_less(b, c).withColumn("covered", rounded(F.col("covered")))


@query(f"""WITH {POINTS}, n AS (SELECT s_suppkey AS id, ((s_suppkey * 53) % 1000)::DOUBLE AS x, ((s_suppkey * 29) % 997)::DOUBLE AS z FROM supplier),
d AS (SELECT po.id, min(sqrt(power(po.x - n.x, 2) + power(po.z - n.z, 2))) AS d FROM po JOIN n ON sqrt(power(po.x - n.x, 2) + power(po.z - n.z, 2)) <= 30 GROUP BY 1)
SELECT po.id, round(d + 1e-9, 6) AS d, CASE WHEN d < 10 THEN 'remove' WHEN d < 25 THEN 'prune' ELSE 'keep' END AS fate FROM po LEFT JOIN d USING (id)""")
def trees_by_distance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trees near new buildings go, or are pruned."""
    trees, s = _points(spark, sf_dir), F.col("s_suppkey")
    new = table(spark, sf_dir, "supplier").select(s.alias("id"), ((s * 53) % 1000).cast("double").alias("x"), ((s * 29) % 997).cast("double").alias("z"))
    return lookups.by_distance(trees, spatial.nearest(trees, new, 30.0), 10.0, 25.0).withColumn("d", rounded(F.col("d")))


@query("""WITH x AS (SELECT p_partkey AS id, [NULL, '12', '12,5 m', '9;14', 'tall', '7.5m', ' 3 '][p_partkey % 7 + 1] AS text FROM part)
SELECT id, CASE text WHEN '12' THEN 12 WHEN '12,5 m' THEN 12.5 WHEN '9;14' THEN 9 WHEN '7.5m' THEN 7.5 WHEN ' 3 ' THEN 3 END::DOUBLE AS v FROM x""")
def lenient_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.get(F.array(*map(F.lit, (None, "12", "12,5 m", "9;14", "tall", "7.5m", " 3 "))), (F.col("p_partkey") % 7).cast("int"))
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), places.number(text).alias("v"))


@query("""WITH x AS (SELECT p_partkey AS id, (p_partkey % 8) / 10 AS p, (p_partkey % 5) / 10 AS f, (p_partkey % 20)::DOUBLE AS h FROM part), d AS (SELECT *, 1 + power(4.43::DOUBLE, -p) * (p - 1) AS low FROM x)
SELECT id, round(CASE WHEN h > 0 AND p > 0 THEN low * h ELSE 0 END + 1e-9, 6) AS d, round(CASE WHEN h > 0 AND p > 0 AND f > 0 THEN (1 - low) * exp(-1 / sqrt(3.75 * (1 - low) * f)) * h ELSE 0 END + 1e-9, 6) AS z0 FROM d""")
def roughness(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey")
    d, z0 = places.macdonald(k % 8 / 10, k % 5 / 10, (k % 20).cast("double"))
    return table(spark, sf_dir, "part").select(k.alias("id"), rounded(d).alias("d"), rounded(z0).alias("z0"))


@query("""WITH x AS (SELECT event_id, value * 7 AS x1, value * 3 AS z1, 500 - value * 4 AS x2, 300 - value AS z2 FROM events),
s AS (SELECT event_id, greatest(0, CASE WHEN x2 > x1 THEN (100 - x1) / (x2 - x1) WHEN x2 < x1 THEN (400 - x1) / (x2 - x1) ELSE 0 END, CASE WHEN z2 > z1 THEN (50 - z1) / (z2 - z1) WHEN z2 < z1 THEN (250 - z1) / (z2 - z1) ELSE 0 END) AS a,
least(1, CASE WHEN x2 > x1 THEN (400 - x1) / (x2 - x1) WHEN x2 < x1 THEN (100 - x1) / (x2 - x1) ELSE 1 END, CASE WHEN z2 > z1 THEN (250 - z1) / (z2 - z1) WHEN z2 < z1 THEN (50 - z1) / (z2 - z1) ELSE 1 END) AS b FROM x)
SELECT event_id, round(a + 1e-9, 6) AS a, round(b + 1e-9, 6) AS b FROM s WHERE a <= b""")
def clipped_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = F.col("value")
    part = places.clipped(v * 7, v * 3, 500 - v * 4, 300 - v, (100.0, 400.0, 50.0, 250.0))
    return table(spark, sf_dir, "events").select("event_id", part["start"].alias("s"), part["end"].alias("e")).filter("s <= e").select("event_id", rounded(F.col("s")).alias("a"), rounded(F.col("e")).alias("b"))
