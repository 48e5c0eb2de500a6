"""Polygons as tables: rings are rows of vertices (id, ring, n, x, z), in order of n, closed by themselves; all rings of an id together are
a polygon by the even-odd rule, so a ring inside another is a hole.

Space is cut into square cells. A polygon's edges are dealt to the bands (rows of cells) that they cross; within a band, cells that edges
touch form runs, and the gaps between runs lie wholly inside or wholly outside. Points of inside cells need no test; points of a run
are tested against the edges of that run only, on top of the parity of what lies to its right, which is the same for the whole run.
Work is keyed by cells, so a polygon over everything is spread over all of its cells. A cell's points are dealt to a few parts and meet its
polygons in a stream of rows sorted by cell, so that no pair of a point and a polygon is written before the result.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from aerolake.operators.cellwise import pieces, starts
from aerolake.sources.intermediate import ROWS, dealt

#: Parts that the places of one cell are dealt to, so that no cell is one task.
SALTS = 4
#: Rows of cells that a vertex makes in all parts, roughly.
SPREAD = 16
#: Pairs of an edge and a place that are tested at a time; rows of the result that are made at a time.
BLOCK, OUT = 1 << 17, 1 << 18


def edges(rings: DataFrame) -> DataFrame:
    """(id, ring, x1, z1, x2, z2) of closed rings; edges without length are left out."""
    order = Window.partitionBy("id", "ring").orderBy("n")
    whole = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    follow = lambda c: F.coalesce(F.lead(c).over(order), F.first(c).over(whole))
    out = rings.dropna(subset=["x", "z"]).select("id", "ring", F.col("x").alias("x1"), F.col("z").alias("z1"), follow("x").alias("x2"), follow("z").alias("z2"))
    return out.filter((F.col("x1") != F.col("x2")) | (F.col("z1") != F.col("z2")))


def crossing(z: Column) -> Column:
    """Where an edge (x1, z1, x2, z2) meets the level z."""
    return (F.col("x2") - F.col("x1")) * (z - F.col("z1")) / (F.col("z2") - F.col("z1")) + F.col("x1")


def spans(z: Column) -> Column:
    """Whether an edge spans the level z: an end on it counts as below."""
    return (F.col("z1") > z) != (F.col("z2") > z)


def banded(sides: DataFrame, size: float) -> DataFrame:
    """Edges in each band j that they touch, with the cells i0 to i1 of that band that they may touch: a hair too many rather than too few."""
    low, high = F.least("z1", "z2"), F.greatest("z1", "z2")
    hair = 1e-9 * (F.abs(F.col("x1")) + F.abs(F.col("x2")) + size)
    out = sides.withColumn("j", F.explode(F.sequence(F.floor(low / size), F.floor(high / size))))
    left, right = F.least("x1", "x2"), F.greatest("x1", "x2")
    ends = [F.when(F.col("z1") != F.col("z2"), crossing(F.greatest(low, F.least(high, F.col("j") * size + F.lit(size * k))))) for k in (0.0, 1.0)]
    a, b = F.greatest(left, F.coalesce(F.least(*ends), left)), F.least(right, F.coalesce(F.greatest(*ends), right))
    return out.withColumns({"i0": F.floor((a - hair) / size), "i1": F.floor((b + hair) / size)})


def runs(bands: DataFrame, size: float) -> tuple[DataFrame, DataFrame]:
    """Edges with the run of cells ``r`` that they lie in, and the runs (id, j, r, i0, i1, odd, gap): ``odd``, whether what lies right of
    the run is inside, and ``gap``, the last cell before the next run."""
    order = Window.partitionBy("id", "j").orderBy("i0", "i1")
    before = F.max("i1").over(order.rowsBetween(Window.unboundedPreceding, -1))
    opened = bands.withColumn("_new", F.when(before.isNull() | (F.col("i0") > before), 1).otherwise(0))
    lying = opened.withColumn("r", F.sum("_new").over(order.rowsBetween(Window.unboundedPreceding, 0))).drop("_new")
    level = F.col("j") * size + F.lit(size / 2)  # nothing changes right of a run within a band, so any level tells
    counted = lying.groupBy("id", "j", "r").agg(F.min("i0").alias("i0"), F.max("i1").alias("i1"), F.count_if(spans(level)).alias("n"))
    by_run = Window.partitionBy("id", "j").orderBy("r")
    beyond = F.coalesce(F.sum("n").over(by_run.rowsBetween(1, Window.unboundedFollowing)), F.lit(0))
    return lying, counted.select("id", "j", "r", "i0", "i1", (beyond % 2 == 1).alias("odd"), (F.lead("i0").over(by_run) - 1).alias("gap"))


def _by_cell(points: DataFrame, rings: DataFrame, size: float, salts: int, rows: int, areas: DataFrame | None = None) -> DataFrame:
    """Points (side 0), then edges of polygons that touch a cell (side 1), sorted by cell, part and polygon, or by cell, part, area and polygon.

    An edge is in all cells of its run up to its own last one, since farther right it hits nothing. A polygon around a whole cell has an edge there
    that spans nothing. ``odd`` tells what lies right of the run.
    """
    tasks = max(int(points.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-rows // ROWS))
    lying, each = runs(banded(edges(rings.repartition(tasks, "id", "ring")), size).repartition(tasks, "id", "j"), size)
    each = each.withColumn("area", F.lit(None).cast("double")) if areas is None else dealt(each, "id").join(dealt(areas, "id"), "id")
    run = each.select("id", "j", "r", "area", "odd", F.col("i0").alias("from"), F.col("i1").alias("to"))
    near = dealt(lying, "id", "j", "r").join(dealt(run, "id", "j", "r"), ["id", "j", "r"])
    ends, zero = ("x1", "z1", "x2", "z2"), F.lit(0.0)
    outer = near.select("id", "area", "j", F.explode(F.sequence("from", F.least("i1", "to"))).alias("i"), "odd", *ends)
    inner = each.filter(F.col("odd") & F.col("gap").isNotNull() & (F.col("gap") > F.col("i1"))).select("id", "area", "j", F.explode(F.sequence(F.col("i1") + 1, "gap")).alias("i"), "odd", *(zero.alias(c) for c in ends))
    key = points.schema["id"].dataType
    sides = outer.union(inner).select("i", "j", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("part"), F.lit(1).alias("side"), F.lit(None).cast(key).alias("point"), "area", "id", "odd", *ends)
    x, z, none = F.col("x"), F.col("z"), F.lit(None)
    part = F.pmod(F.xxhash64("x", "z"), F.lit(salts)).cast("int")
    placed = points.dropna(subset=["x", "z"]).select(F.floor(x / size).alias("i"), F.floor(z / size).alias("j"), part.alias("part"), F.lit(0).alias("side"), F.col("id").alias("point"), none.cast("double").alias("area"), none.cast(rings.schema["id"].dataType).alias("id"), F.lit(False).alias("odd"), x.alias("x1"), z.alias("z1"), zero.alias("x2"), zero.alias("z2"))
    return placed.union(sides).repartition(tasks, "i", "j", "part").sortWithinPartitions("i", "j", "part", "side", *([] if areas is None else ["area"]), "id")


class _Places:
    """The places of a cell's points, each once, with the points at them."""

    def __init__(self, points: list[pa.RecordBatch]):
        rows = pa.concat_batches(points)
        x, z = rows.column("x1").to_numpy(), rows.column("z1").to_numpy()
        order = np.lexsort((z, x))
        x, z = x[order], z[order]
        new = np.flatnonzero(np.concatenate([[True], (x[1:] != x[:-1]) | (z[1:] != z[:-1])]))
        self.x, self.z, self.points, self.first = x[new], z[new], rows.column("point").take(pa.array(order)), new
        self.n = np.diff(np.append(new, len(x)))
        self.open = np.arange(len(new))  # places that still ask

    def rows(self, at: np.ndarray, ids: pa.Array, which: np.ndarray) -> Iterator[pa.RecordBatch]:
        """(point, id) of all points at the places ``at`` with the ids at ``which``."""
        total = np.cumsum(self.n[at])
        a = 0
        while a < len(at):
            b = max(a + 1, int(np.searchsorted(total, (total[a - 1] if a else 0) + OUT, "right")))
            n = self.n[at[a:b]]
            ends = np.cumsum(n)
            flat = np.arange(ends[-1]) + np.repeat(self.first[at[a:b]] - (ends - n), n)
            yield pa.RecordBatch.from_arrays([self.points.take(pa.array(flat)), ids.take(pa.array(np.repeat(which[a:b], n)))], names=["point", "id"])
            a = b


def _tested(places: _Places, sides: pa.RecordBatch, at: np.ndarray, first: bool) -> Iterator[pa.RecordBatch]:
    """Points of the places in the polygons whose edges begin ``at``; with ``first`` a place takes the first polygon only and asks no more."""
    x1, z1, x2, z2 = (sides.column(c).to_numpy() for c in ("x1", "z1", "x2", "z2"))
    odd, ids, ends = sides.column("odd").to_numpy(zero_copy_only=False)[at], sides.column("id"), np.append(at, len(sides))
    p = 0
    while p < len(at) and len(places.open):
        to = max(p + 1, int(np.searchsorted(ends, ends[p] + max(1, BLOCK // len(places.open)), "right")) - 1)
        e = slice(ends[p], ends[to])
        ax, az, bx, bz = (c[e, None] for c in (x1, z1, x2, z2))
        asking, step = places.open, max(1, BLOCK // (e.stop - e.start))
        met = []
        for k in range(0, len(asking), step):
            q = asking[k : k + step]
            x, z = places.x[q], places.z[q]
            with np.errstate(divide="ignore", invalid="ignore", over="ignore"):  # a level edge spans nothing
                hits = ((az > z) != (bz > z)) & (x < (bx - ax) * (z - az) / (bz - az) + ax)
            inside = np.logical_xor.reduceat(hits, at[p:to] - e.start, axis=0) != odd[p:to, None]
            if first:
                some = inside.any(axis=0)
                yield from places.rows(q[some], ids, at[p:to][inside.argmax(axis=0)[some]])
                met.append(some)
            else:
                which, of = np.nonzero(inside)
                yield from places.rows(q[of], ids, at[p:to][which])
        if first:
            places.open = asking[~np.concatenate(met)]
        p = to


def _held(batches: Iterable[pa.RecordBatch], first: bool) -> Iterator[pa.RecordBatch]:
    """(point, id) from rows as ``_by_cell`` sorts them. A cell's points are held; its polygons pass by."""
    points, places, rest = [], None, None
    for new, piece in pieces(batches, ("i", "j", "part")):
        if new:
            if rest is not None:
                yield from _tested(places, rest, np.array([0]), first)
            points, places, rest = [], None, None
        n = int(np.searchsorted(piece.column("side").to_numpy(), 1))
        if n:
            points.append(piece.slice(0, n))
        if n == len(piece) or not points:
            continue
        places = places or _Places(points)
        sides = piece.slice(n) if rest is None else pa.concat_batches([rest, piece.slice(n)])
        at = np.flatnonzero(starts(sides, ["id"]))
        rest = sides.slice(at[-1])  # the last polygon may go on in the next batch
        if len(at) > 1:
            yield from _tested(places, sides.slice(0, at[-1]), at[:-1], first)
    if rest is not None:
        yield from _tested(places, rest, np.array([0]), first)


def _kinds(points: DataFrame, rings: DataFrame) -> str:
    return f"point {points.schema['id'].dataType.simpleString()}, id {rings.schema['id'].dataType.simpleString()}"


def contained(points: DataFrame, rings: DataFrame, size: float, salts: int = SALTS) -> DataFrame:
    """(point, id): every point (id, x, z) and every polygon that holds it, by the even-odd rule of ``spans`` and ``crossing``.

    Points without coordinates are in nothing. Point ids must be distinct; ``size`` should leave few edges of a polygon in a cell. What is
    shuffled and sorted grows as points and cells of edges do; pairs come out of the last step only.
    """
    met = _by_cell(points, rings, size, salts, points.count() + SPREAD * rings.count())
    return met.mapInArrow(lambda batches: _held(batches, False), _kinds(points, rings))


def measures(rings: DataFrame) -> DataFrame:
    """(id, ring, area, cx, cz): signed area, counter-clockwise positive, and centroid; of a ring without area the mean of its vertices."""
    product = F.col("x1") * F.col("z2") - F.col("x2") * F.col("z1")
    sums = edges(rings).groupBy("id", "ring").agg(
        F.sum(product).alias("a"), F.sum((F.col("x1") + F.col("x2")) * product).alias("mx"), F.sum((F.col("z1") + F.col("z2")) * product).alias("mz"), F.avg("x1").alias("ax"), F.avg("z1").alias("az")
    )
    flat = F.abs("a") < 1e-9
    part = lambda m, mean: F.when(flat, F.col(mean)).otherwise(F.col(m) / F.nullif(3 * F.col("a"), F.lit(0.0)))
    return sums.select("id", "ring", (F.col("a") / 2).alias("area"), part("mx", "ax").alias("cx"), part("mz", "az").alias("cz"))


def holes_assigned(outers: DataFrame, holes: DataFrame, size: float) -> DataFrame:
    """(hole, id): for each hole (id, n, x, z) the smallest outer ring (id, n, x, z) that holds its centroid, ties to the smaller id; NULL where none does."""
    one = F.lit(0).alias("ring")
    outer, hole = outers.select("id", one, "n", "x", "z"), holes.select("id", one, "n", "x", "z")
    middles = measures(hole).select("id", F.col("cx").alias("x"), F.col("cz").alias("z"))
    areas = measures(outer).select("id", F.abs("area").alias("area"))
    # Outer rings pass by in the order of their areas, so a centroid asks no more once one holds it.
    met = _by_cell(middles, outer, size, SALTS, holes.count() + SPREAD * outers.count(), areas)
    best = met.mapInArrow(lambda batches: _held(batches, True), _kinds(middles, outer)).withColumnRenamed("point", "hole")
    return dealt(middles.select(F.col("id").alias("hole")), "hole").join(dealt(best, "hole"), "hole", "left")


def filled(rings: DataFrame, size: float) -> DataFrame:
    """(id, i, j, x, z): the cells whose centres lie in a polygon.

    Each level of centres meets the polygon's edges at places that pair up, left to right; the cells between the two of a pair are inside.
    """
    centre = (F.col("j") + 0.5) * size
    low, high = F.least("z1", "z2"), F.greatest("z1", "z2")
    met = edges(rings).withColumn("j", F.explode(F.sequence(F.floor(low / size) - 1, F.floor(high / size) + 1))).filter(spans(centre)).select("id", "j", crossing(centre).alias("at"))
    order = Window.partitionBy("id", "j").orderBy("at")
    pairs = met.withColumns({"end": F.lead("at").over(order), "k": F.row_number().over(order)}).filter((F.col("k") % 2 == 1) & (F.col("end") > F.col("at")))
    x = (F.col("i") + 0.5) * size
    cells = pairs.withColumn("i", F.explode(F.sequence(F.floor(F.col("at") / size) - 1, F.floor(F.col("end") / size) + 1)))
    return cells.filter((x >= F.col("at")) & (x < F.col("end"))).select("id", "i", "j", x.alias("x"), centre.alias("z"))
