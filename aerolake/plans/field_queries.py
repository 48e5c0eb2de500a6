"""Queries on rasters, fields and projections made of the driver's parts, suppliers, customers and line items, with SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from aerolake.functions import projection
from aerolake.functions.calendar import rounded
from aerolake.operators import fields
from aerolake.plans.geometry_queries import LINES, _lines
from aerolake.sources.tables import table

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str):
    def register(f):
        QUERIES[f.__name__] = f
        ORACLES[f.__name__] = sql
        return f

    return register


TRI = """tr AS (SELECT p_partkey AS id, ((p_partkey * 37) % 1000)::DOUBLE AS ax, (3 + p_size % 20)::DOUBLE AS ay, ((p_partkey * 91) % 997)::DOUBLE AS az, ((p_partkey * 37) % 1000 + 4 + p_partkey % 19)::DOUBLE AS bx, (1 + p_size % 7)::DOUBLE AS b_y, ((p_partkey * 91) % 997 + p_partkey % 5)::DOUBLE AS bz,
((p_partkey * 37) % 1000 + p_partkey % 3)::DOUBLE AS cx, (5 + p_partkey % 11)::DOUBLE AS cy, ((p_partkey * 91) % 997 + 6 + p_partkey % 23)::DOUBLE AS cz FROM part)"""


@query(f"""WITH {TRI}, d AS (SELECT *, (bx - ax) * (cz - az) - (cx - ax) * (bz - az) AS det FROM tr), b AS (SELECT *, unnest(range(CAST(floor(least(ax, bx, cx) / 4) AS BIGINT) - 1, CAST(floor(greatest(ax, bx, cx) / 4) AS BIGINT) + 2)) AS i FROM d WHERE abs(det) >= 1e-9),
c AS (SELECT *, unnest(range(CAST(floor(least(az, bz, cz) / 4) AS BIGINT) - 1, CAST(floor(greatest(az, bz, cz) / 4) AS BIGINT) + 2)) AS j FROM b), e AS (SELECT *, ((4 * i + 2 - ax) * (cz - az) - (cx - ax) * (4 * j + 2 - az)) / det AS u, ((bx - ax) * (4 * j + 2 - az) - (4 * i + 2 - ax) * (bz - az)) / det AS v FROM c)
SELECT i, j, round(max(ay + u * (b_y - ay) + v * (cy - ay)) + 1e-9, 6) AS h FROM e WHERE u >= -1e-9 AND v >= -1e-9 AND u + v <= 1 + 1e-9 AND ay + u * (b_y - ay) + v * (cy - ay) > 0 GROUP BY 1, 2""")
def roof_heights(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Greatest height of a triangle a part over each cell's centre."""
    k, s = F.col("p_partkey"), F.col("p_size")
    x, z = (k * 37) % 1000, (k * 91) % 997
    of = {"ax": x, "ay": 3 + s % 20, "az": z, "bx": x + 4 + k % 19, "by": 1 + s % 7, "bz": z + k % 5, "cx": x + k % 3, "cy": 5 + k % 11, "cz": z + 6 + k % 23}
    return fields.painted(table(spark, sf_dir, "part").select(*(c.cast("double").alias(n) for n, c in of.items())), 4.0).withColumn("h", rounded(F.col("h")))


MASK = "mk AS (SELECT DISTINCT (p_partkey * 7) % 50 AS i, (p_partkey * 3) % 45 AS j FROM part WHERE p_size % 3 = 0)"


@query(f"""WITH {LINES}, {MASK}, g AS (SELECT id, x AS x1, z AS z1, lead(x) OVER w AS x2, lead(z) OVER w AS z2 FROM v WINDOW w AS (PARTITION BY id ORDER BY n)), l AS (SELECT *, sqrt(power(x2 - x1, 2) + power(z2 - z1, 2)) AS len FROM g WHERE x2 IS NOT NULL),
s AS (SELECT *, greatest(1, CAST(floor(len) AS BIGINT)) AS parts, unnest(range(greatest(1, CAST(floor(len) AS BIGINT)))) AS k FROM l),
c AS (SELECT id, len / parts AS w, CAST(floor((x1 + (k + 0.5::DOUBLE) / parts * (x2 - x1)) / 2) AS BIGINT) AS i, CAST(floor((z1 + (k + 0.5::DOUBLE) / parts * (z2 - z1)) / 2) AS BIGINT) AS j FROM s)
SELECT id, round(sum(w) + 1e-9, 5) AS length, round(coalesce(sum(w) FILTER (mk.i IS NOT NULL), 0) + 1e-9, 5) AS inside FROM c LEFT JOIN mk ON c.i = mk.i AND c.j = mk.j GROUP BY 1""")
def lines_over_mask(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Metres of each order's polyline, and those over a mask of cells."""
    k = F.col("p_partkey")
    mask = table(spark, sf_dir, "part").filter(F.col("p_size") % 3 == 0).select(((k * 7) % 50).alias("i"), ((k * 3) % 45).alias("j"))
    return fields.over_mask(_lines(spark, sf_dir), mask, 2.0).select("id", rounded(F.col("length"), 5).alias("length"), rounded(F.col("inside"), 5).alias("inside"))


# The field: 20 by 10 by 10 cells, each the mean of the parts that fall there; every seventh of them is solid.
FIELD = """fl AS (SELECT p_partkey % 20 AS i, (p_partkey // 20) % 10 AS j, (p_partkey // 200) % 10 AS k, avg(p_retailprice) AS v0, avg(CAST(p_size AS DOUBLE)) AS v1 FROM part WHERE p_partkey % 7 > 0 GROUP BY 1, 2, 3),
pt AS (SELECT event_id AS id, ((event_id * 37) % 1910)::DOUBLE / 100 AS x, ((event_id * 91) % 907)::DOUBLE / 100 AS y, least(greatest(value / 50, 0), 8.999) AS z FROM events)"""
SHAPE = (20, 10, 10)


def _field(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    k = F.col("p_partkey")
    field = table(spark, sf_dir, "part").filter(k % 7 > 0).groupBy((k % 20).alias("i"), (F.floor(k / 20) % 10).alias("j"), (F.floor(k / 200) % 10).alias("k"))
    field = field.agg(F.lit(True).alias("fluid"), F.array(F.avg("p_retailprice"), F.avg(F.col("p_size").cast("double"))).alias("v"))
    i = F.col("event_id")
    points = table(spark, sf_dir, "events").select(i.alias("id"), ((i * 37 % 1910).cast("double") / 100).alias("x"), ((i * 91 % 907).cast("double") / 100).alias("y"), (F.col("value").cast("double") / 50).alias("z"))
    return points, field


@query(f"""WITH {FIELD}, c AS (SELECT id, x, y, z, CAST(floor(x) + p AS BIGINT) AS i, CAST(floor(y) + q AS BIGINT) AS j, CAST(least(9, floor(z) + r) AS BIGINT) AS k,
(CASE p WHEN 1 THEN x - floor(x) ELSE 1 - (x - floor(x)) END) * (CASE q WHEN 1 THEN y - floor(y) ELSE 1 - (y - floor(y)) END) * (CASE r WHEN 1 THEN z - floor(z) ELSE 1 - (z - floor(z)) END) AS w FROM pt, range(2) a(p), range(2) b(q), range(2) d(r) WHERE x BETWEEN 0 AND 18.999 AND y BETWEEN 0 AND 8.999),
s AS (SELECT id, sum(w) FILTER (v0 IS NOT NULL) AS ws, sum(w * v0) AS a, sum(w * v1) AS b FROM c LEFT JOIN fl USING (i, j, k) GROUP BY 1)
SELECT id, round(CASE WHEN ws > 1e-4 THEN a / ws ELSE coalesce(a, 0) END + 1e-9, 5) AS v0, round(CASE WHEN ws > 1e-4 THEN b / ws ELSE coalesce(b, 0) END + 1e-9, 5) AS v1 FROM s""")
def field_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A field of parts sampled at events, from the fluid cells around each."""
    points, field = _field(spark, sf_dir)
    out = fields.sampled_field(points, field, SHAPE, 2)
    return out.select("id", *(rounded(F.col("v")[g], 5).alias(f"v{g}") for g in range(2)))


# Two masks of the same parts, the second moved by (2, -1) and with holes.
@query("""WITH a AS (SELECT DISTINCT (p_partkey * 37) % 97 AS i, (p_partkey * 11) % 61 AS j FROM part), b AS (SELECT DISTINCT (p_partkey * 37) % 97 + 2 AS i, (p_partkey * 11) % 61 - 1 AS j FROM part WHERE p_size % 5 > 0),
s AS (SELECT CAST(si AS INTEGER) AS si, CAST(sj AS INTEGER) AS sj FROM range(-6, 7) x(si), range(-6, 7) y(sj)), n AS (SELECT si, sj, count(a.i) AS inter FROM s JOIN b ON true LEFT JOIN a ON a.i = b.i + si AND a.j = b.j + sj GROUP BY 1, 2)
SELECT si, sj, inter, round(inter / ((SELECT count(*) FROM a) + (SELECT count(*) FROM b) - inter) + 1e-9, 6) AS iou FROM n""")
def footprint_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How two masks of cells overlap under all shifts."""
    k = F.col("p_partkey")
    i, j = (k * 37) % 97, (k * 11) % 61
    part = table(spark, sf_dir, "part")
    a, b = part.select(i.alias("i"), j.alias("j")), part.filter(F.col("p_size") % 5 > 0).select((i + 2).alias("i"), (j - 1).alias("j"))
    return fields.shifted_overlap(fields.mask_runs(a), fields.mask_runs(b), 6).withColumn("iou", rounded(F.col("iou")))


def _tm_sql(p: projection.Plane) -> str:
    """CTEs ending in ``pl`` (id, east, north) of ``ge`` (id, lat, lon)."""
    x = " + ".join(f"{a!r}::DOUBLE * sin({2 * j} * x0) * cosh({2 * j} * y0)" for j, a in enumerate(projection.terms(projection.ALPHA), 1))
    y = " + ".join(f"{a!r}::DOUBLE * cos({2 * j} * x0) * sinh({2 * j} * y0)" for j, a in enumerate(projection.terms(projection.ALPHA), 1))
    e, k = projection.ECCENTRICITY, p.scale * projection.RADIUS
    return f"""ta AS (SELECT *, tan(radians(lat)) AS t, radians(lon - {p.meridian!r}::DOUBLE) AS l FROM ge), tb AS (SELECT *, sinh({e!r}::DOUBLE * atanh({e!r}::DOUBLE * t / sqrt(1 + t * t))) AS s FROM ta), tc AS (SELECT *, t * sqrt(1 + s * s) - s * sqrt(1 + t * t) AS u FROM tb),
td AS (SELECT *, atan2(u, cos(l)) AS x0, asinh(sin(l) / sqrt(u * u + cos(l) * cos(l))) AS y0 FROM tc), pl AS (SELECT id, {p.east!r}::DOUBLE + {k!r}::DOUBLE * (y0 + {y}) AS east, {p.north!r}::DOUBLE + {k!r}::DOUBLE * (x0 + {x}) AS north FROM td)"""


@query(f"""WITH ge AS (SELECT c_custkey AS id, 42 + (c_custkey * 37 % 4507)::DOUBLE / 1000 AS lat, 13 + (c_custkey * 53 % 6007)::DOUBLE / 1000 AS lon FROM customer), {_tm_sql(projection.HTRS96)}
SELECT id, round(east + 1e-9, 4) AS east, round(north + 1e-9, 4) AS north, round(lat + 1e-9, 8) AS lat, round(lon + 1e-9, 8) AS lon FROM pl JOIN ge USING (id)""")
def plane_coordinates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers' places on the plane, and back to degrees."""
    k = F.col("c_custkey")
    places = table(spark, sf_dir, "customer").select(k.alias("id"), (42 + (k * 37 % 4507).cast("double") / 1000).alias("lat"), (13 + (k * 53 % 6007).cast("double") / 1000).alias("lon"))
    there = projection.to_plane(places, projection.HTRS96).drop("lat", "lon")
    back = projection.from_plane(there, projection.HTRS96)
    return back.select("id", *(rounded(F.col(c), 4).alias(c) for c in ("east", "north")), *(rounded(F.col(c), 8).alias(c) for c in ("lat", "lon")))
