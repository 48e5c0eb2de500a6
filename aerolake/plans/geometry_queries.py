"""Queries on polygon tables, segments and polylines made of the driver's parts, suppliers, customers and line items, with SQL.

Every supplier has a polygon: a star around its place, with a hole in every third; one in fifty reaches over most of the others. Every customer
has a small triangle, every supplier a wall, every order a polyline through its line items.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from aerolake.functions.calendar import rounded
from aerolake.operators import polygons, polylines, segments, spatial
from aerolake.sources.tables import table

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return register


SPOKES = ((3, 0), (2, 2), (0, 3), (-2, 2), (-3, 0), (-2, -2), (0, -3), (2, -2))
P = "p AS (SELECT p_partkey AS id, ((p_partkey * 37) % 1000)::DOUBLE AS x, ((p_partkey * 91) % 997)::DOUBLE AS z FROM part)"
RINGS = f"""sp(k, dx, dz) AS (VALUES {', '.join(f'({k}, {x}, {z})' for k, (x, z) in enumerate(SPOKES))}),
rv AS (SELECT s_suppkey AS id, ring, k AS n, ((s_suppkey * 53) % 1000 + dx * (CASE WHEN ring = 1 THEN 1 WHEN s_suppkey % 50 = 7 THEN 120 + k ELSE 2 + (s_suppkey * 7 + k * 5) % 11 END))::DOUBLE AS x,
((s_suppkey * 71) % 997 + dz * (CASE WHEN ring = 1 THEN 1 WHEN s_suppkey % 50 = 7 THEN 120 + k ELSE 2 + (s_suppkey * 7 + k * 5) % 11 END))::DOUBLE AS z FROM supplier, sp, range(2) r(ring) WHERE ring = 0 OR s_suppkey % 3 = 0),
re AS (SELECT id, ring, x AS x1, z AS z1, coalesce(lead(x) OVER w, first(x) OVER w) AS x2, coalesce(lead(z) OVER w, first(z) OVER w) AS z2 FROM rv WINDOW w AS (PARTITION BY id, ring ORDER BY n))"""
CROSSES = "(z1 > {z}) <> (z2 > {z}) AND {x} < (x2 - x1) * ({z} - z1) / (z2 - z1) + x1"
WALLS = "ws AS (SELECT s_suppkey AS id, ((s_suppkey * 53) % 1000)::DOUBLE AS x1, ((s_suppkey * 71) % 997)::DOUBLE AS z1, ((s_suppkey * 53) % 1000 + s_suppkey % 41 - 20)::DOUBLE AS x2, ((s_suppkey * 71) % 997 + s_suppkey % 37 - 18)::DOUBLE AS z2 FROM supplier)"
LINES = "v AS (SELECT l_orderkey AS id, l_linenumber * 100000000 + l_partkey * 100 + CAST(l_quantity AS BIGINT) AS n, (l_quantity * 2)::DOUBLE AS x, ((l_partkey * 7) % 90)::DOUBLE AS z FROM lineitem)"


def _points(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey")
    return table(spark, sf_dir, "part").select(k.alias("id"), ((k * 37) % 1000).cast("double").alias("x"), ((k * 91) % 997).cast("double").alias("z"))


def _rings(spark: SparkSession, sf_dir: str) -> DataFrame:
    s, k, ring = F.col("s_suppkey"), F.col("k"), F.col("ring")
    spokes = F.array(*(F.struct(F.lit(x).alias("dx"), F.lit(z).alias("dz")) for x, z in SPOKES))
    rows = table(spark, sf_dir, "supplier").select("s_suppkey", F.explode(F.when(s % 3 == 0, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("ring"))
    rows = rows.select("s_suppkey", "ring", F.posexplode(spokes).alias("k", "d"))
    reach = F.when(ring == 1, 1).when(s % 50 == 7, 120 + k).otherwise(2 + (s * 7 + k * 5) % 11)
    return rows.select(s.alias("id"), "ring", k.alias("n"), ((s * 53) % 1000 + F.col("d.dx") * reach).cast("double").alias("x"), ((s * 71) % 997 + F.col("d.dz") * reach).cast("double").alias("z"))


def _walls(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = F.col("s_suppkey")
    x, z = (s * 53) % 1000, (s * 71) % 997
    return table(spark, sf_dir, "supplier").select(s.alias("id"), *(c.cast("double").alias(n) for n, c in (("x1", x), ("z1", z), ("x2", x + s % 41 - 20), ("z2", z + s % 37 - 18))))


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("l_linenumber").cast("bigint") * 100000000 + F.col("l_partkey") * 100 + F.col("l_quantity").cast("bigint")
    return table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("id"), n.alias("n"), (F.col("l_quantity") * 2).cast("double").alias("x"), ((F.col("l_partkey") * 7) % 90).cast("double").alias("z"))


@query(f"WITH {P}, {RINGS} SELECT p.id AS point, re.id FROM p JOIN re ON {CROSSES.format(x='p.x', z='p.z')} GROUP BY 1, 2 HAVING count(*) % 2 = 1")
def polygon_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Points in polygons with holes."""
    return polygons.contained(_points(spark, sf_dir), _rings(spark, sf_dir), 25.0)


TRIANGLES = "tv AS (SELECT c_custkey AS id, n, ((c_custkey * 29) % 1000 + [0, 4, 1][n + 1])::DOUBLE AS x, ((c_custkey * 61) % 997 + [0, 1, 5][n + 1])::DOUBLE AS z FROM customer, range(3) r(n))"


@query(f"""WITH {RINGS}, {TRIANGLES}, te AS (SELECT id, x AS x1, z AS z1, coalesce(lead(x) OVER w, first(x) OVER w) AS x2, coalesce(lead(z) OVER w, first(z) OVER w) AS z2 FROM tv WINDOW w AS (PARTITION BY id ORDER BY n)),
ct AS (SELECT id, sum((x1 + x2) * (x1 * z2 - x2 * z1)) / (3 * sum(x1 * z2 - x2 * z1)) AS x, sum((z1 + z2) * (x1 * z2 - x2 * z1)) / (3 * sum(x1 * z2 - x2 * z1)) AS z FROM te GROUP BY 1),
ar AS (SELECT id, abs(sum(x1 * z2 - x2 * z1)) / 2 AS area FROM re WHERE ring = 0 GROUP BY 1),
hit AS (SELECT ct.id AS hole, re.id FROM ct JOIN re ON ring = 0 AND {CROSSES.format(x='ct.x', z='ct.z')} GROUP BY 1, 2 HAVING count(*) % 2 = 1),
best AS (SELECT hole, arg_min(id, (area, id)) AS id FROM hit JOIN ar USING (id) GROUP BY 1)
SELECT ct.id AS hole, best.id FROM ct LEFT JOIN best ON hole = ct.id""")
def hole_rings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The smallest outer ring around each customer's triangle."""
    c, n = F.col("c_custkey"), F.col("n")
    of = lambda a: F.get(F.array(*map(F.lit, a)), n)
    holes = table(spark, sf_dir, "customer").select("c_custkey", F.explode(F.array(*map(F.lit, range(3)))).alias("n")).select(c.alias("id"), "n", ((c * 29) % 1000 + of((0, 4, 1))).cast("double").alias("x"), ((c * 61) % 997 + of((0, 1, 5))).cast("double").alias("z"))
    return polygons.holes_assigned(_rings(spark, sf_dir).filter("ring = 0").drop("ring"), holes, 25.0)


@query(f"""WITH {P}, {WALLS}, q AS (SELECT p.id AS point, x - x1 AS gx, z - z1 AS gz, x2 - x1 AS dx, z2 - z1 AS dz FROM p, ws),
d AS (SELECT *, greatest(0, least(1, (gx * dx + gz * dz) / coalesce(nullif(dx * dx + dz * dz, 0), 1e-12))) AS s FROM q)
SELECT point, round(min(sqrt(power(gx - dx * s, 2) + power(gz - dz * s, 2))) + 1e-9, 6) AS d FROM d GROUP BY 1""")
def nearest_wall(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distance of each part's place to the nearest wall, however far."""
    return segments.nearest_segments(_points(spark, sf_dir), _walls(spark, sf_dir), 20.0).select("point", rounded(F.col("d")).alias("d"))


@query(f"""WITH {P}, {WALLS}, ra AS (SELECT id, x, z, (id % 7 - 3)::DOUBLE AS dx, (id % 5 - 2)::DOUBLE AS dz FROM p),
h AS (SELECT ra.id AS ray, ws.id, ((x1 - x) * (z2 - z1) - (z1 - z) * (x2 - x1)) / nullif(dx * (z2 - z1) - dz * (x2 - x1), 0) AS t, ((x1 - x) * dz - (z1 - z) * dx) / nullif(dx * (z2 - z1) - dz * (x2 - x1), 0) AS u FROM ra, ws)
SELECT ray, arg_min(id, (t, id)) AS id, round(min(t) + 1e-9, 6) AS t FROM h WHERE t > 1e-9 AND u BETWEEN 0 AND 1 GROUP BY 1""")
def ray_walls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first wall that a ray from each part's place hits."""
    k = F.col("id")
    rays = _points(spark, sf_dir).withColumns({"dx": (k % 7 - 3).cast("double"), "dz": (k % 5 - 2).cast("double")})
    return segments.first_hits(rays, _walls(spark, sf_dir), 20.0).withColumn("t", rounded(F.col("t")))


BOX = (300.0, 700.0, 200.0, 650.0)


def _vertices_as_array(rings: DataFrame) -> DataFrame:
    """(id, ring): rings of a few vertices as arrays."""
    ordered = F.array_sort(F.collect_list(F.struct("n", "x", "z")))
    return rings.filter("ring = 0").groupBy("id").agg(F.transform(ordered, lambda v: F.struct(v["x"].alias("x"), v["z"].alias("z"))).alias("ring"))


# Areas by trapezoids under the clipped edges: the part of a ring in a box is the sum, over its edges, of what they bound between the box's sides.
@query(f"""WITH {RINGS}, o AS (SELECT id, x1, z1, x2, z2, list_sort(list_distinct([0.0::DOUBLE, 1.0::DOUBLE] || [t for t in [({BOX[0]} - x1) / nullif(x2 - x1, 0), ({BOX[1]} - x1) / nullif(x2 - x1, 0), ({BOX[2]} - z1) / nullif(z2 - z1, 0), ({BOX[3]} - z1) / nullif(z2 - z1, 0)] if t > 0 AND t < 1])) AS ts FROM re WHERE ring = 0),
q AS (SELECT id, x1, z1, x2, z2, ts[i] AS a, ts[i + 1] AS b FROM o, range(1, 6) r(i) WHERE i < len(ts)),
c AS (SELECT id, least({BOX[1]}, greatest({BOX[0]}, x1 + (x2 - x1) * a)) AS xa, least({BOX[1]}, greatest({BOX[0]}, x1 + (x2 - x1) * b)) AS xb, least({BOX[3]}, greatest({BOX[2]}, z1 + (z2 - z1) * a)) AS za, least({BOX[3]}, greatest({BOX[2]}, z1 + (z2 - z1) * b)) AS zb FROM q)
SELECT id, round(sum((xa + xb) / 2 * (zb - za)) + 1e-9, 4) AS area FROM c GROUP BY 1""")
def clipped_areas(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Area of each polygon's outer ring within a box."""
    inside = polylines.clipped_ring(F.col("ring"), BOX)
    area = F.when(F.size("inside") > 0, spatial.ring_area(F.col("inside"))).otherwise(0.0)
    return _vertices_as_array(_rings(spark, sf_dir)).select("id", inside.alias("inside")).select("id", rounded(area, 4).alias("area"))


LINE_BOX = (20.0, 75.0, 15.0, 60.0)
LEGS = f"""{LINES}, g AS (SELECT id, n, x AS x1, z AS z1, lead(x) OVER w - x AS dx, lead(z) OVER w - z AS dz FROM v WINDOW w AS (PARTITION BY id ORDER BY n)),
cl AS (SELECT *, greatest(0, CASE WHEN dx > 0 THEN ({LINE_BOX[0]} - x1) / dx WHEN dx < 0 THEN ({LINE_BOX[1]} - x1) / dx ELSE 0 END, CASE WHEN dz > 0 THEN ({LINE_BOX[2]} - z1) / dz WHEN dz < 0 THEN ({LINE_BOX[3]} - z1) / dz ELSE 0 END) AS a,
least(1, CASE WHEN dx > 0 THEN ({LINE_BOX[1]} - x1) / dx WHEN dx < 0 THEN ({LINE_BOX[0]} - x1) / dx WHEN x1 BETWEEN {LINE_BOX[0]} AND {LINE_BOX[1]} THEN 1 ELSE -1 END, CASE WHEN dz > 0 THEN ({LINE_BOX[3]} - z1) / dz WHEN dz < 0 THEN ({LINE_BOX[2]} - z1) / dz WHEN z1 BETWEEN {LINE_BOX[2]} AND {LINE_BOX[3]} THEN 1 ELSE -1 END) AS b FROM g WHERE dx IS NOT NULL)"""


@query(f"""WITH {LEGS}, k AS (SELECT *, a < b AS kept, lag(a < b AND b = 1) OVER (PARTITION BY id ORDER BY n) AS on_ FROM cl),
m AS (SELECT *, sum(CASE WHEN kept AND NOT (a = 0 AND coalesce(on_, false)) THEN 1 ELSE 0 END) OVER (PARTITION BY id ORDER BY n ROWS UNBOUNDED PRECEDING) AS run FROM k),
l AS (SELECT id, run, sum((b - a) * sqrt(dx * dx + dz * dz)) AS length FROM m WHERE kept GROUP BY 1, 2 HAVING sum((b - a) * sqrt(dx * dx + dz * dz)) > 0.5)
SELECT id, CAST(row_number() OVER (PARTITION BY id ORDER BY run) - 1 AS INTEGER) AS piece, round(length + 1e-9, 4) AS length FROM l""")
def clipped_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces of each order's polyline within a box, with their lengths."""
    pieces = polylines.clipped_polylines(_lines(spark, sf_dir), LINE_BOX)
    run = polylines.legs(pieces, "id", "piece")  # dealt by id as the pieces are
    length = F.sqrt(F.pow(F.col("x2") - F.col("x1"), F.lit(2.0)) + F.pow(F.col("z2") - F.col("z1"), F.lit(2.0)))
    return run.groupBy("id", "piece").agg(rounded(F.sum(length), 4).alias("length"))


@query(f"""WITH RECURSIVE {LINES}, st(id, a, b) AS (SELECT id, min(n), max(n) FROM v GROUP BY id UNION ALL
SELECT id, unnest([a, f]), unnest([f, b]) FROM (SELECT st.id, st.a, st.b, arg_max(m.n, (abs((q.z - p.z) * (m.x - p.x) - (q.x - p.x) * (m.z - p.z)) / greatest(sqrt(power(q.x - p.x, 2) + power(q.z - p.z, 2)), 1e-12), -m.n)) AS f,
max(abs((q.z - p.z) * (m.x - p.x) - (q.x - p.x) * (m.z - p.z)) / greatest(sqrt(power(q.x - p.x, 2) + power(q.z - p.z, 2)), 1e-12)) AS d FROM st JOIN v p ON p.id = st.id AND p.n = st.a JOIN v q ON q.id = st.id AND q.n = st.b JOIN v m ON m.id = st.id AND m.n > st.a AND m.n < st.b GROUP BY 1, 2, 3) WHERE d > 20)
SELECT DISTINCT v.id, v.n, x, z FROM v JOIN st ON v.id = st.id AND (v.n = st.a OR v.n = st.b)""")
def simplified_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each order's polyline within 20 of what it was."""
    return polylines.simplified(_lines(spark, sf_dir), 20.0)


CENTRE = (50.0, 45.0)
# A queue counts on group A and B only; the roads' groups, lanes and ways follow the order's key.
SOURCES = f"""{LINES}, lg AS (SELECT id, n, x AS x1, z AS z1, lead(x) OVER w AS x2, lead(z) OVER w AS z2 FROM v WINDOW w AS (PARTITION BY id ORDER BY n)),
rd AS (SELECT o_orderkey AS id, ['A', 'B', 'C'][o_orderkey % 3 + 1] AS grp, (o_custkey % 40) * 500 AS daily, o_orderkey % 3 - 1 AS way FROM orders WHERE o_custkey % 40 > 0),
le AS (SELECT lg.*, grp, daily, way, sqrt(power(x2 - x1, 2) + power(z2 - z1, 2)) AS len FROM lg JOIN rd ON rd.id = lg.id WHERE x2 IS NOT NULL),
pt AS (SELECT *, greatest(1, CAST(ceil(len / 4) AS BIGINT)) AS parts, unnest(range(greatest(1, CAST(ceil(len / 4) AS BIGINT)))) AS k FROM le WHERE len > 0),
so AS (SELECT id, grp, daily, way, x1, z1, x2, z2, x1 + (x2 - x1) * ((k + 0.5::DOUBLE) / parts) AS x, z1 + (z2 - z1) * ((k + 0.5::DOUBLE) / parts) AS z, daily / 1000.0::DOUBLE * len / parts AS w FROM pt)"""


def _sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    roads = table(spark, sf_dir, "orders").filter(F.col("o_custkey") % 40 > 0).select(k.alias("id"), F.get(F.array(*map(F.lit, "ABC")), (k % 3).cast("int")).alias("grp"), ((F.col("o_custkey") % 40) * 500).alias("daily"), F.lit(0.0).alias("width"), F.lit(2).alias("lanes"), (k % 3 - 1).cast("int").alias("oneway"))
    return polylines.road_sources(_lines(spark, sf_dir), roads, centre=CENTRE)


@query(f"""WITH {SOURCES}, d AS (SELECT *, sqrt(power({CENTRE[0]} - x, 2) + power({CENTRE[1]} - z, 2)) AS d FROM so)
SELECT id, grp, count(*) AS n, round(sum(w) + 1e-9, 4) AS w, round(sum(w * CASE WHEN grp IN ('A', 'B') AND d BETWEEN 15 AND 75 THEN CASE WHEN way = 0 THEN 0.5 WHEN way * ((x2 - x1) * ({CENTRE[0]} - x) + (z2 - z1) * ({CENTRE[1]} - z)) > 0 THEN 1 ELSE 0 END ELSE 0 END) + 1e-9, 4) AS queue FROM d GROUP BY 1, 2""")
def road_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sources of each order's road: how many, what they sum to, and how much of it queues."""
    out = _sources(spark, sf_dir).groupBy("id", "grp")
    return out.agg(F.count("*").alias("n"), rounded(F.sum("w"), 4).alias("w"), rounded(F.sum(F.col("w") * F.col("queue")), 4).alias("queue"))


@query(f"""WITH {RINGS}, b AS (SELECT id, CAST(floor(min(x1) / 10) AS BIGINT) AS i0, CAST(floor(max(x1) / 10) AS BIGINT) AS i1, CAST(floor(min(z1) / 10) AS BIGINT) AS j0, CAST(floor(max(z1) / 10) AS BIGINT) AS j1 FROM re GROUP BY 1),
c AS (SELECT id, i, unnest(range(j0, j1 + 1)) AS j FROM (SELECT *, unnest(range(i0, i1 + 1)) AS i FROM b)),
f AS (SELECT c.id, i, j FROM c JOIN re ON re.id = c.id AND {CROSSES.format(x='(i * 10 + 5)', z='(j * 10 + 5)')} GROUP BY 1, 2, 3 HAVING count(*) % 2 = 1)
SELECT s_suppkey AS id, count(i) AS n, round(sum(CASE WHEN i IS NULL THEN 0 ELSE coalesce(CASE WHEN s_suppkey % 4 > 0 THEN s_suppkey % 4 END, 1) * 100.0::DOUBLE END) + 1e-9, 4) AS w FROM f JOIN supplier ON s_suppkey = f.id GROUP BY 1""")
def area_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cells of each supplier's polygon as sources; every fourth polygon has no weight of its own."""
    s = F.col("s_suppkey")
    weights = table(spark, sf_dir, "supplier").select(s.alias("id"), F.when(s % 4 > 0, s % 4).cast("double").alias("weight"))
    return polylines.area_sources(_rings(spark, sf_dir), weights).groupBy("id").agg(F.count("*").alias("n"), rounded(F.sum("w"), 4).alias("w"))


@query(None)
def thinned_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts' places in order of their keys, each dropped that lies within 30 of one taken before."""
    return polylines.thinned(_points(spark, sf_dir), 30.0)

