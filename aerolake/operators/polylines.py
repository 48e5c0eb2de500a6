"""Polylines and rings: clipping, simplification, discretisation to point sources, thinning in order.

Polylines are rows of vertices (id, n, x, z) in order of n; rings as array columns hold structs (x, z) and close by themselves.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from aerolake.operators import polygons, spatial
from aerolake.operators.spatial import close_pairs
from aerolake.sources.intermediate import dealt, discard, in_parts, materialise

# Spacing of road sources, cell of area sources, release heights of both, m; lane width, m; queue distances, m; vehicles of a traffic unit.
ROAD_SPACING, AREA_CELL, ROAD_HEIGHT, AREA_HEIGHT = 4.0, 10.0, 0.5, 8.0
LANE, QUEUE, TRAFFIC_UNIT = 3.25, (15.0, 75.0), 1000.0
#: Shortest piece that a clipped polyline may leave, m.
LEAST_PIECE = 0.5
#: Points of a cell that a turn of thinning looks at.
HEADS = 16


def _bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is computed once however often it stands in there."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _half_plane(ring: Column, axis: str, limit: float, above: bool) -> Column:
    def step(b: Column, i: Column, vertices: Column) -> Column:
        a = F.element_at(vertices, F.when(i == 0, -1).otherwise(i).cast("int"))
        kept = lambda p: p[axis] >= limit if above else p[axis] <= limit
        share = (limit - a[axis]) / F.nullif(b[axis] - a[axis], F.lit(0.0))
        met = F.struct(*((F.lit(limit) if c == axis else a[c] + share * (b[c] - a[c])).alias(c) for c in "xz"))
        at = F.struct(b["x"].alias("x"), b["z"].alias("z"))
        none = F.array().cast("array<struct<x:double,z:double>>")
        return F.when(kept(b) & ~kept(a), F.array(met, at)).when(kept(b), F.array(at)).when(kept(a), F.array(met)).otherwise(none)

    return _bound(ring, lambda vertices: F.flatten(F.transform(vertices, lambda b, i: step(b, i, vertices))))


def clipped_ring(ring: Column, box: tuple[float, float, float, float]) -> Column:
    """The part of a ring in a box (x0, x1, z0, z1): four half-planes in turn, each walking the vertices with their forerunners.

    Concave rings may get edges of no width along the box; areas and the even-odd rule still hold. A ring outside gives an empty array.
    """
    x0, x1, z0, z1 = map(float, box)
    for axis, limit, above in (("x", x0, True), ("x", x1, False), ("z", z0, True), ("z", z1, False)):
        ring = _half_plane(ring, axis, limit, above)
    return ring


def legs(vertices: DataFrame, *by: str) -> DataFrame:
    """(id, n, x1, z1, x2, z2): the segments of polylines, n being that of their first vertex. ``by``: columns that name a line, where it is not id alone."""
    by = by or ("id",)
    order = Window.partitionBy(*by).orderBy("n")
    out = vertices.select(*by, "n", F.col("x").alias("x1"), F.col("z").alias("z1"), F.lead("x").over(order).alias("x2"), F.lead("z").over(order).alias("z2"))
    return out.dropna(subset=["x2", "z2"])


def _length(x1: str | Column, z1: str | Column, x2: str | Column, z2: str | Column) -> Column:
    a, b, c, d = (F.col(v) if isinstance(v, str) else v for v in (x1, z1, x2, z2))
    return F.sqrt((c - a) * (c - a) + (d - b) * (d - b))


def clipped_polylines(vertices: DataFrame, box: tuple[float, float, float, float], inside: bool = True, least: float = LEAST_PIECE) -> DataFrame:
    """(id, piece, n, x, z): the pieces of polylines inside (or outside) a box (x0, x1, z0, z1), longer than ``least``, numbered from 0 along the line.

    Each segment is cut where it meets the box's sides; parts are kept by their middle, and kept parts that follow each other are one piece.
    """
    x0, x1, z0, z1 = map(float, box)
    dx, dz = F.col("x2") - F.col("x1"), F.col("z2") - F.col("z1")
    cut = lambda p, q: F.when(F.abs(p) > 1e-12, q / F.nullif(p, F.lit(0.0)))
    places = F.array(F.lit(0.0), cut(-dx, F.col("x1") - x0), cut(dx, x1 - F.col("x1")), cut(-dz, F.col("z1") - z0), cut(dz, z1 - F.col("z1")), F.lit(1.0))
    inner = F.array_sort(F.array_distinct(F.filter(places, lambda t: t.between(0, 1))))
    parts = legs(in_parts(vertices, "id")).select("id", "n", "x1", "z1", dx.alias("dx"), dz.alias("dz"), inner.alias("t")).select("*", F.posexplode(F.slice("t", 1, F.size("t") - 1)).alias("k", "ta"))
    parts = parts.withColumn("tb", F.element_at("t", F.col("k") + 2))
    at = lambda t, p, d: F.col(p) + F.col(d) * F.col(t)
    parts = parts.select("id", "n", "k", at("ta", "x1", "dx").alias("ax"), at("ta", "z1", "dz").alias("az"), at("tb", "x1", "dx").alias("bx"), at("tb", "z1", "dz").alias("bz"))
    mx, mz = (F.col("ax") + F.col("bx")) / 2, (F.col("az") + F.col("bz")) / 2
    order = Window.partitionBy("id").orderBy("n", "k")
    kept = parts.withColumn("kept", (mx.between(x0, x1) & mz.between(z0, z1)) == inside)
    before = lambda c: F.lag(c).over(order)
    joined = F.coalesce(before("kept"), F.lit(False)) & (_length(before("bx"), before("bz"), "ax", "az") <= 1e-9)
    kept = kept.withColumn("new", F.when(F.col("kept") & ~joined, 1).otherwise(0)).withColumn("run", F.sum("new").over(order.rowsBetween(Window.unboundedPreceding, 0))).filter("kept")
    run = Window.partitionBy("id", "run")
    kept = kept.withColumn("length", F.sum(_length("ax", "az", "bx", "bz")).over(run)).filter(F.col("length") > least)
    ends = F.when(F.col("new") == 1, F.array(F.struct(F.col("ax").alias("x"), F.col("az").alias("z")), F.struct(F.col("bx").alias("x"), F.col("bz").alias("z")))).otherwise(F.array(F.struct(F.col("bx").alias("x"), F.col("bz").alias("z"))))
    points = kept.select("id", "run", "n", "k", F.posexplode(ends).alias("e", "p"))
    number = F.dense_rank().over(Window.partitionBy("id").orderBy("run")) - 1
    place = F.row_number().over(Window.partitionBy("id", "run").orderBy("n", "k", "e")) - 1
    return points.select("id", number.alias("piece"), place.alias("n"), "p.x", "p.z")


def simplified(vertices: DataFrame, tolerance: float) -> DataFrame:
    """(id, n, x, z): the vertices that stay when every stretch between two of them is within ``tolerance`` of the line through both.

    A stretch splits at its farthest vertex (the first of equals) while that is farther than the tolerance. All stretches of all
    polylines split in one job a round; vertices of finished stretches leave the rounds.
    """
    whole = Window.partitionBy("id").orderBy("n").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    first, last = F.first(F.struct("n", "x", "z")).over(whole), F.last(F.struct("n", "x", "z")).over(whole)
    rows = vertices.select("id", "n", "x", "z").withColumns({"a": first, "b": last})
    ends = materialise(rows, "polyline")
    kept = ends.filter((F.col("n") == F.col("a.n")) | (F.col("n") == F.col("b.n"))).select("id", "n", "x", "z")
    inner = materialise(ends.filter((F.col("n") > F.col("a.n")) & (F.col("n") < F.col("b.n"))), "stretch")
    dx, dz = F.col("b.x") - F.col("a.x"), F.col("b.z") - F.col("a.z")
    length = F.sqrt(dx * dx + dz * dz)
    off = F.abs(dz * (F.col("x") - F.col("a.x")) - dx * (F.col("z") - F.col("a.z"))) / F.when(length == 0, 1e-12).otherwise(length)
    while inner.limit(1).count():
        far = inner.withColumn("d", off).groupBy("id", F.col("a.n").alias("from")).agg(F.max(F.struct("d", (-F.col("n")).alias("m"), "n", "x", "z")).alias("f")).filter(F.col("f.d") > tolerance)
        far = materialise(far.select("id", "from", F.struct("f.n", "f.x", "f.z").alias("f")), "split")
        kept = kept.union(far.select("id", "f.n", "f.x", "f.z"))
        parted = inner.withColumn("from", F.col("a.n")).join(far, ["id", "from"]).filter(F.col("n") != F.col("f.n"))
        before = F.col("n") < F.col("f.n")
        parted = materialise(parted.select("id", "n", "x", "z", F.when(before, F.col("a")).otherwise(F.col("f")).alias("a"), F.when(before, F.col("f")).otherwise(F.col("b")).alias("b")), "stretch")
        discard(inner)
        inner = parted
    return kept.distinct()


def simplified_rings(rings: DataFrame, tolerance: float) -> DataFrame:
    """(id, n, x, z): rings simplified as two polylines, from the first vertex to the one farthest from it and back.

    A last vertex equal to the first is dropped before; triangles stay as they are, and what has fewer than three vertices, before or after, is no ring.
    """
    whole = Window.partitionBy("id").orderBy("n").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    rows = rings.select("id", "n", "x", "z").withColumns({"first": F.first(F.struct("n", "x", "z")).over(whole), "last": F.last("n").over(whole)})
    closing = (F.col("n") == F.col("last")) & (F.col("n") != F.col("first.n")) & (F.col("x") == F.col("first.x")) & (F.col("z") == F.col("first.z"))
    rows = rows.filter(~closing).withColumn("count", F.count("*").over(Window.partitionBy("id")))
    apart = _length("first.x", "first.z", "x", "z")
    rows = materialise(rows.withColumn("far", F.max(F.struct(apart.alias("d"), (-F.col("n")).alias("m"))).over(Window.partitionBy("id"))).withColumn("far", -F.col("far.m")), "rings")
    big = rows.filter("count > 3")
    out_, back = big.filter(F.col("n") <= F.col("far")), big.filter(F.col("n") >= F.col("far"))
    closed = big.filter(F.col("n") == F.col("first.n")).select("id", (F.col("last") + 1).alias("n"), "x", "z")
    halves = out_.select(F.struct("id", F.lit(0).alias("h")).alias("id"), "n", "x", "z").union(back.select("id", "n", "x", "z").union(closed).select(F.struct("id", F.lit(1).alias("h")).alias("id"), "n", "x", "z"))
    kept = simplified(halves, tolerance).select("id.id", "n", "x", "z").distinct()
    kept = kept.join(closed.select("id", "n"), ["id", "n"], "left_anti").withColumn("count", F.count("*").over(Window.partitionBy("id"))).filter("count >= 3")
    return kept.drop("count").union(rows.filter("count = 3").select("id", "n", "x", "z"))


def road_sources(vertices: DataFrame, roads: DataFrame, spacing: float = ROAD_SPACING, centre: tuple[float, float] | None = None, queue: tuple[float, float] = QUEUE) -> DataFrame:
    """(id, x, z, w, hs, sy0, grp, queue): point sources in the middles of equal parts, at most ``spacing`` long, of each segment.

    roads: (id, grp, daily, width, lanes, oneway). ``w`` is thousands of vehicles a day times metres, so that a road's sources sum to its length
    times its traffic. ``queue`` is the share of traffic that queues towards ``centre``: half on two-way roads of groups A and B between the queue
    distances, all or nothing on one-way roads by direction.
    """
    met = legs(vertices).join(roads.filter((F.col("daily") > 0) & F.col("grp").isin("A", "B", "C")), "id").withColumn("length", _length("x1", "z1", "x2", "z2")).filter("length > 0")
    met = met.withColumn("parts", F.greatest(F.lit(1), F.ceil(F.col("length") / spacing))).withColumn("k", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)))
    s = (F.col("k") + 0.5) / F.col("parts")
    x, z = F.col("x1") + (F.col("x2") - F.col("x1")) * s, F.col("z1") + (F.col("z2") - F.col("z1")) * s
    across = F.when(F.col("width") > 0, F.col("width")).otherwise(LANE * F.when(F.col("lanes") > 0, F.col("lanes")).otherwise(2)) / 2
    waiting = F.lit(0.0)
    if centre:
        cx, cz = centre[0] - x, centre[1] - z
        way = F.coalesce(F.col("oneway"), F.lit(0))
        ahead = way * (F.col("x2") - F.col("x1")) * cx + way * (F.col("z2") - F.col("z1")) * cz > 0
        near = F.sqrt(cx * cx + cz * cz).between(*queue) & F.col("grp").isin("A", "B")
        waiting = F.when(near, F.when(way == 0, 0.5).when(ahead, 1.0).otherwise(0.0)).otherwise(0.0)
    return met.select("id", x.alias("x"), z.alias("z"), (F.col("daily") / TRAFFIC_UNIT * F.col("length") / F.col("parts")).alias("w"), F.lit(ROAD_HEIGHT).alias("hs"), across.cast("double").alias("sy0"), "grp", waiting.alias("queue"))


def area_sources(rings: DataFrame, weights: DataFrame, cell: float = AREA_CELL) -> DataFrame:
    """(id, x, z, w, hs, sy0, grp, queue): a point source in every cell whose centre an area (id, ring, n, x, z) holds; weights: (id, weight), NULL and missing count as 1."""
    cells = polygons.filled(rings, cell).join(weights, "id", "left")
    weight = F.coalesce(F.col("weight"), F.lit(1.0)) * cell * cell
    return cells.select("id", "x", "z", weight.alias("w"), F.lit(AREA_HEIGHT).alias("hs"), F.lit(cell / 2).alias("sy0"), F.lit("D").alias("grp"), F.lit(0.0).alias("queue"))


def thinned(points: DataFrame, distance: float) -> DataFrame:
    """(id, x, z): what remains when points (id, x, z) are taken in order of id and each is dropped that lies nearer than ``distance`` to one taken before.

    A turn looks at the HEADS first points of each cell. One whose id comes before the first point that a cell around leaves out has all its earlier
    neighbours among them, so rounds over the heads' links settle it: a point with no earlier neighbour left is taken, its later
    neighbours are dropped. Then all points near those taken leave, and the next turn looks again; the least id is always settled. Points
    without coordinates stay.
    """
    finite = spatial.finite("x", "z")
    i, j = spatial.cells(F.col("x"), F.col("z"), distance)
    active = materialise(points.filter(finite).select("id", "x", "z", i.alias("i"), j.alias("j")), "active")
    kept = points.filter(~F.coalesce(finite, F.lit(False))).select("id", "x", "z")
    around = F.array(*(F.struct((F.col("i") + p).alias("i"), (F.col("j") + q).alias("j")) for p in (-1, 0, 1) for q in (-1, 0, 1)))
    while active.limit(1).count():
        rank = F.row_number().over(Window.partitionBy("i", "j").orderBy("id"))
        first = materialise(active.withColumn("rank", rank).filter(F.col("rank") <= HEADS + 1), "first")
        bound = first.filter(F.col("rank") == HEADS + 1).select(F.col("id").alias("bound"), F.inline(around)).groupBy("i", "j").agg(F.min("bound").alias("bound"))
        sure = F.coalesce(F.col("id") < F.col("bound"), F.lit(True))
        heads = materialise(first.filter(F.col("rank") <= HEADS).join(bound, ["i", "j"], "left").select("id", "x", "z", sure.alias("sure")), "heads")
        links = materialise(close_pairs(heads, distance).filter(F.col("d") < distance).select("a_id", "b_id"), "links")
        taken, open_heads = None, heads.filter("sure").select("id")
        while True:
            now = materialise(open_heads.join(links.select(F.col("b_id").alias("id")), "id", "left_anti"), "taken")
            if not now.limit(1).count():
                break
            taken = now if taken is None else taken.union(now)
            gone = materialise(links.join(now.withColumnRenamed("id", "a_id"), "a_id", "left_semi").select(F.col("b_id").alias("id")).distinct(), "gone")
            settled = now.union(gone)
            open_heads = materialise(open_heads.join(settled, "id", "left_anti"), "open")
            links = materialise(links.join(settled.withColumnRenamed("id", "a_id"), "a_id", "left_anti").join(gone.withColumnRenamed("id", "b_id"), "b_id", "left_anti"), "links")
        chosen = materialise(heads.join(taken, "id", "left_semi").select("id", "x", "z"), "chosen")
        kept = kept.union(chosen)
        near = chosen.select(F.col("x").alias("tx"), F.col("z").alias("tz"), *(c.alias(n) for n, c in zip("ij", spatial.cells(F.col("x"), F.col("z"), distance), strict=True))).select("tx", "tz", F.inline(around))
        apart = F.sqrt(F.pow(F.col("x") - F.col("tx"), F.lit(2.0)) + F.pow(F.col("z") - F.col("tz"), F.lit(2.0)))
        left, right = dealt(active, "i", "j").alias("p"), dealt(near, "i", "j").alias("t")
        further = materialise(left.join(right, (F.col("p.i") == F.col("t.i")) & (F.col("p.j") == F.col("t.j")) & (apart < distance), "left_anti"), "active")
        discard(active)
        active = further
    return kept
