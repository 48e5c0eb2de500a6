"""Rasters and fields as tables of cells: triangles painted, roads over a mask, samples and bands of a field, overlap of shifted masks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from aerolake.operators.polylines import legs
from aerolake.sources.intermediate import in_parts

#: Cells of a triangle's box from which its rows are dealt to other tasks before their cells are made.
LARGE = 4096
#: Cells of a mask up to which every task holds it whole.
BROADCAST = 1 << 18
#: Share of a sample's weight that must be known for it to be scaled up; reach of a band, cells.
LEAST_WEIGHT, REACH = 1e-4, 1.5
_HAIR = 1e-9


def painted(triangles: DataFrame, cell: float, origin: float = 0.0) -> DataFrame:
    """(i, j, h): the greatest height above 0 of triangles (ax, ay, az, bx, by, bz, cx, cy, cz; y up) over each cell's centre.

    A triangle makes the rows of its box, a row the cells between the triangle's sides; rows of large triangles are dealt out first. Triangles
    without area in the plane paint nothing.
    """
    at = {c: F.col(c) for c in ("ax", "ay", "az", "bx", "by", "bz", "cx", "cy", "cz")}
    det = (at["bx"] - at["ax"]) * (at["cz"] - at["az"]) - (at["cx"] - at["ax"]) * (at["bz"] - at["az"])
    low = lambda *v: F.floor((F.least(*v) - origin) / cell - 0.5)
    high = lambda *v: F.ceil((F.greatest(*v) - origin) / cell - 0.5)
    xs, zs = (at["ax"], at["bx"], at["cx"]), (at["az"], at["bz"], at["cz"])
    boxed = triangles.dropna(subset=list(at)).withColumns({"det": det, "i0": low(*xs), "i1": high(*xs), "j0": low(*zs), "j1": high(*zs)}).filter(F.abs("det") >= _HAIR)
    rows = boxed.withColumn("j", F.explode(F.sequence("j0", "j1")))
    big = (F.col("i1") - F.col("i0") + 1) * (F.col("j1") - F.col("j0") + 1) > LARGE
    rows = rows.filter(~big).unionByName(rows.filter(big).repartition("j", "ax", "az"))
    x, z = origin + (F.col("i") + 0.5) * cell, origin + (F.col("j") + 0.5) * cell
    u = ((x - at["ax"]) * (at["cz"] - at["az"]) - (at["cx"] - at["ax"]) * (z - at["az"])) / F.col("det")
    v = ((at["bx"] - at["ax"]) * (z - at["az"]) - (x - at["ax"]) * (at["bz"] - at["az"])) / F.col("det")
    cells = rows.withColumn("i", F.explode(F.sequence("i0", "i1"))).withColumns({"u": u, "v": v}).filter((F.col("u") >= -_HAIR) & (F.col("v") >= -_HAIR) & (F.col("u") + F.col("v") <= 1 + _HAIR))
    h = at["ay"] + F.col("u") * (at["by"] - at["ay"]) + F.col("v") * (at["cy"] - at["ay"])
    return cells.select("i", "j", h.alias("h")).filter("h > 0").groupBy("i", "j").agg(F.max("h").alias("h"))


def over_mask(vertices: DataFrame, mask: DataFrame, cell: float, origin: float = 0.0) -> DataFrame:
    """(id, length, inside): metres of each polyline (id, n, x, z), sampled about every metre, and how many of them over cells (i, j) of a mask.

    Marks meet a mask of up to BROADCAST cells where the line lies, and no mark is shuffled; with a larger mask a row a line and cell is."""
    length = F.sqrt(F.pow(F.col("x2") - F.col("x1"), F.lit(2.0)) + F.pow(F.col("z2") - F.col("z1"), F.lit(2.0)))
    parts = legs(in_parts(vertices, "id")).withColumn("length", length).withColumn("parts", F.greatest(F.lit(1), F.floor("length")))
    marks = parts.withColumn("s", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1))).withColumn("s", (F.col("s") + 0.5) / F.col("parts"))
    place = lambda p, q: F.floor((F.col(p) + F.col("s") * (F.col(q) - F.col(p)) - origin) / cell)
    w = F.col("length") / F.col("parts")
    cells = mask.select("i", "j", F.lit(True).alias("on")).distinct()
    few = cells.limit(BROADCAST + 1).count() <= BROADCAST
    met = marks.select("id", place("x1", "x2").alias("i"), place("z1", "z2").alias("j"), w.alias("w"))
    if not few:
        met = met.groupBy("id", "i", "j").agg(F.sum("w").alias("w"))  # a row a cell that a line passes
    met = met.join(F.broadcast(cells) if few else cells, ["i", "j"], "left")
    return met.groupBy("id").agg(F.sum("w").alias("length"), F.coalesce(F.sum(F.when(F.col("on"), F.col("w"))), F.lit(0.0)).alias("inside"))


def _key(i: Column, j: Column, k: Column, shape: tuple[int, int, int]) -> Column:
    return (k * shape[1] + j) * shape[0] + i


def sampled_field(points: DataFrame, field: DataFrame, shape: tuple[int, int, int], n: int) -> DataFrame:
    """(id, v): the field (i, j, k, fluid, v array of n) at points (id, x, y, z) in cell units: the mean of the up to eight fluid cells around, weighted
    by nearness and scaled up for the others. Heights beyond the field count as its border; points beyond its sides have no row; points without a
    fluid cell around have zeros. Points and cells meet by the cell's number."""
    nx, ny, nz = shape
    inside = points.filter(F.col("x").between(0, nx - 1.001) & F.col("y").between(0, ny - 1.001) & F.col("z").isNotNull()).withColumn("z", F.greatest(F.lit(0.0), F.least("z", F.lit(nz - 1.001))))
    base = {c: F.floor(c) for c in "xyz"}
    corners = [(p, q, r) for r in (0, 1) for q in (0, 1) for p in (0, 1)]
    side = lambda c, one: F.col(c) - base[c] if one else 1 - (F.col(c) - base[c])
    around = F.array(*(F.struct(_key(base["x"] + p, base["y"] + q, F.least(F.lit(nz - 1), base["z"] + r), shape).alias("q"), (side("x", p) * side("y", q) * side("z", r)).alias("w")) for p, q, r in corners))
    known = field.filter("fluid").select(_key(F.col("i"), F.col("j"), F.col("k"), shape).alias("q"), "v")
    met = inside.select("id", F.inline(around)).join(known, "q")
    sums = met.groupBy("id").agg(F.sum("w").alias("ws"), *(F.sum(F.col("w") * F.col("v")[g]).alias(f"v{g}") for g in range(n)))
    scaled = F.array(*(F.when(F.col("ws") > LEAST_WEIGHT, F.col(f"v{g}") / F.nullif(F.col("ws"), F.lit(0.0))).otherwise(F.coalesce(f"v{g}", F.lit(0.0))) for g in range(n)))
    return inside.select("id").join(sums, "id", "left").select("id", scaled.alias("v"))


def field_band(points: DataFrame, field: DataFrame, shape: tuple[int, int, int], n: int) -> DataFrame:
    """(id, v, low, high): samples with the least and the greatest value, theirs included, of the fluid cells within REACH cells to each side and in the two layers around."""
    nx, ny, nz = shape
    values = sampled_field(points, field, shape, n)
    placed = points.join(values, "id").withColumn("z", F.floor(F.greatest(F.lit(0.0), F.least("z", F.lit(nz - 1.001)))))
    span = lambda c, most: F.sequence(F.greatest(F.lit(0).cast("long"), F.ceil(F.col(c) - REACH - 1e-6)), F.least(F.lit(most - 1).cast("long"), F.floor(F.col(c) + REACH + 1e-6)))
    around = placed.withColumn("i", F.explode(span("x", nx))).withColumn("j", F.explode(span("y", ny))).withColumn("r", F.explode(F.array(F.lit(0), F.lit(1))))
    keys = around.select("id", _key(F.col("i"), F.col("j"), F.least(F.lit(nz - 1), F.col("z") + F.col("r")), shape).alias("q")).distinct()
    known = field.filter("fluid").select(_key(F.col("i"), F.col("j"), F.col("k"), shape).alias("q"), F.col("v").alias("c"))
    ends = keys.join(known, "q").groupBy("id").agg(*(f(F.col("c")[g]).alias(f"{name}{g}") for g in range(n) for name, f in (("lo", F.min), ("hi", F.max))))
    out = values.join(ends, "id", "left")
    return out.select("id", "v", F.array(*(F.least(F.col("v")[g], f"lo{g}") for g in range(n))).alias("low"), F.array(*(F.greatest(F.col("v")[g], f"hi{g}") for g in range(n))).alias("high"))


def mask_runs(cells: DataFrame) -> DataFrame:
    """(j, i0, i1): runs of neighbouring cells of each row of a mask (i, j)."""
    order = Window.partitionBy("j").orderBy("i")
    runs = cells.select("i", "j").distinct().withColumn("run", F.col("i") - F.row_number().over(order))
    return runs.groupBy("j", "run").agg(F.min("i").alias("i0"), F.max("i").alias("i1")).drop("run")


def shifted_overlap(a: DataFrame, b: DataFrame, most: int) -> DataFrame:
    """(si, sj, inter, iou): for every shift of mask b by up to ``most`` cells each way, the cells it then shares with mask a, and their share of both.

    Masks are runs (j, i0, i1). How much two runs share, by shift, rises by one a cell, stays, and falls: four bends tell it all. Runs of rows
    at most ``most`` apart meet once and leave their bends in a histogram, which sums up to all shifts at once; cells never meet cells.
    """
    length = lambda p: F.col(f"{p}1") - F.col(f"{p}0") + 1
    right = b.select(F.col("j").alias("jb"), F.col("i0").alias("b0"), F.col("i1").alias("b1")).withColumn("sj", F.explode(F.sequence(F.lit(-most), F.lit(most)))).withColumn("j", F.col("jb") + F.col("sj"))
    left = a.select("j", F.col("i0").alias("a0"), F.col("i1").alias("a1"))
    met = left.join(right, "j").withColumn("s", F.col("a0") - F.col("b1")).filter((F.col("s") <= most) & (F.col("a1") - F.col("b0") >= -most))
    la, lb = length("a"), length("b")
    bends = F.array(*(F.struct((F.col("s") + d).alias("u"), F.lit(e).alias("e")) for d, e in ((F.lit(0), 1), (la, -1), (lb, -1), (la + lb, 1))))
    histogram = met.select("sj", F.inline(bends)).filter(F.col("u") <= most).groupBy("sj", "u").agg(F.sum("e").alias("e"))
    first = F.greatest(F.col("u"), F.lit(-most)).cast("int")
    shared = histogram.filter("e <> 0").select("sj", "u", "e", F.explode(F.sequence(first, F.lit(most))).alias("si")).groupBy("si", "sj").agg(F.sum(F.col("e") * (F.col("si") - F.col("u") + 1)).alias("inter"))
    size = lambda df, n: df.agg(F.coalesce(F.sum(F.col("i1") - F.col("i0") + 1), F.lit(0)).alias(n))
    every = a.sparkSession.range(-most, most + 1).select(F.col("id").cast("int").alias("si"), F.explode(F.sequence(F.lit(-most), F.lit(most))).alias("sj"))
    out = every.join(shared, ["si", "sj"], "left").withColumn("inter", F.coalesce("inter", F.lit(0)))
    out = out.join(F.broadcast(size(a, "na")), F.lit(True)).join(F.broadcast(size(b, "nb")), F.lit(True))  # one row each
    return out.select("si", "sj", F.col("inter").cast("long").alias("inter"), (F.col("inter") / F.nullif(F.col("na") + F.col("nb") - F.col("inter"), F.lit(0))).alias("iou"))
