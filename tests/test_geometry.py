"""Polygon tables, walks through cells, nearest segments and ray hits against plain loops."""

from __future__ import annotations

import math
import random

import pytest
from pyspark.sql import functions as F

from aerolake.operators import polygons, segments


def inside(x, z, rings) -> bool:
    odd = False
    for ring in rings:
        for (x1, z1), (x2, z2) in zip(ring, ring[1:] + ring[:1], strict=True):
            if (z1 > z) != (z2 > z) and x < (x2 - x1) * (z - z1) / (z2 - z1) + x1:
                odd = not odd
    return odd


def star(r: random.Random, x: float, z: float, size: float, n: int) -> list[tuple[float, float]]:
    return [(x + (d := size * r.uniform(0.3, 1)) * math.cos(2 * math.pi * i / n), z + d * math.sin(2 * math.pi * i / n)) for i in range(n)]


def table(spark, polys: dict[int, list]):
    rows = [(i, k, n, float(x), float(z)) for i, rings in polys.items() for k, ring in enumerate(rings) for n, (x, z) in enumerate(ring)]
    return spark.createDataFrame(rows, "id long, ring int, n int, x double, z double")


@pytest.fixture(scope="module")
def shapes():
    r = random.Random(4)
    polys = {i: [star(r, r.uniform(-50, 50), r.uniform(-50, 50), r.uniform(2, 40), r.randrange(3, 30))] for i in range(12)}
    polys[20] = [[(-80, -80), (80, -80), (80, 80), (-80, 80)], [(-20, -20), (20, -20), (20, 20), (-20, 20), (-20, -20)], [(-5, -5), (5, -5), (0, 5)]]  # a hole, and an island in it
    polys[21] = [[(0, 0), (30, 0), (30, 10), (10, 10), (10, 20), (30, 20), (30, 30), (0, 30)]]  # whole numbers, on borders of cells
    polys[22] = [[(0, 0), (40, 40), (40, 0), (0, 40)]]  # crosses itself
    polys[23] = [[(1, 1), (2, 2)]]  # no area
    polys[24] = [[(5, 5)]]
    polys[25] = [[(x, 20 + (x % 3) * 0.5) for x in range(-60, 61)] + [(60, 19), (-60, 19)]]  # a long border in one band
    return polys


@pytest.mark.parametrize("size", [3.0, 10.0, 37.0, 500.0])
def test_contained(spark, shapes, size):
    r = random.Random(7)
    points = [(n, r.uniform(-90, 90), r.uniform(-90, 90)) for n in range(300)] + [(1000 + n, float(r.randrange(-8, 9) * 5), float(r.randrange(-8, 9) * 5)) for n in range(200)]
    points += [(2000 + n, 7.0, 19.5) for n in range(100)]  # a third in one cell
    df = spark.createDataFrame([*points, (5000, None, 1.0), (5001, 1.0, None)], "id long, x double, z double")
    got = sorted(map(tuple, polygons.contained(df, table(spark, shapes), size).collect()))
    assert got == sorted((n, i) for n, x, z in points for i, rings in shapes.items() if inside(x, z, rings))


def test_a_polygon_over_everything_is_spread(spark):
    """Its cells are keys of their own; no key holds more than a band's run of edges."""
    ring = {1: [[(0, 0), (1000, 0), (1000, 1000), (0, 1000)]]}
    lying, each = polygons.runs(polygons.banded(polygons.edges(table(spark, ring)), 10.0), 10.0)
    assert each.count() == 2 * 99 + 2
    assert lying.groupBy("id", "j", "r").count().agg(F.max("count")).first()[0] <= 3


def test_measures_and_holes(spark, shapes):
    got = {(m.id, m.ring): m for m in polygons.measures(table(spark, shapes)).collect()}
    assert got[(21, 0)].area == 700 and abs(got[(20, 2)].cx) < 1e-9 and got[(20, 0)].area == 25600
    assert got[(23, 0)].area == 0 and (got[(23, 0)].cx, got[(23, 0)].cz) == (1.5, 1.5)
    outers = {1: [(0, 0), (100, 0), (100, 100), (0, 100)], 2: [(10, 10), (40, 10), (40, 40), (10, 40)], 3: [(10, 10), (10, 40), (40, 40), (40, 10)], 4: [(200, 0), (210, 0), (205, 9)]}
    holes = {7: [(20, 20), (22, 20), (21, 22)], 8: [(60, 60), (70, 60), (65, 70)], 9: [(300, 300), (310, 300), (305, 310)], 10: [(202, 1), (208, 1), (205, 6)]}
    as_rows = lambda d: spark.createDataFrame([(i, n, float(x), float(z)) for i, ring in d.items() for n, (x, z) in enumerate(ring)], "id long, n int, x double, z double")
    assert dict(map(tuple, polygons.holes_assigned(as_rows(outers), as_rows(holes), 16.0).collect())) == {7: 2, 8: 1, 9: None, 10: 4}


@pytest.mark.parametrize("size", [4.0, 25.0])
def test_filled(spark, shapes, size):
    got = {(c.id, c.i, c.j) for c in polygons.filled(table(spark, shapes), size).collect()}
    k = int(200 / size)
    want = {(p, i, j) for p, rings in shapes.items() for i in range(-k, k) for j in range(-k, k) if inside((i + 0.5) * size, (j + 0.5) * size, rings)}
    assert got == want


def sides(r: random.Random, n: int) -> list[tuple]:
    out = [(i, (x := r.uniform(-200, 200)), (z := r.uniform(-200, 200)), x + r.uniform(-30, 30), z + r.uniform(-30, 30)) for i in range(n)]
    out += [(n, 10.0, -300.0, 10.0, 300.0), (n + 1, -300.0, 20.0, 300.0, 20.0), (n + 2, 5.0, 5.0, 5.0, 5.0), (n + 3, 10.0, -300.0, 10.0, 300.0), (n + 4, -250.0, -250.0, 250.0, 249.0), (n + 5, 40.0, -80.0, 40.0 + 1e-12, 80.0)]
    return out


def test_walked_covers_segments(spark):
    """Every point of a segment lies in a cell of its walk, and cells far from it do not appear."""
    r = random.Random(1)
    rows = sides(r, 60)
    for size in (7.0, 50.0):
        got = {}
        for c in segments.in_cells(spark.createDataFrame(rows, "id long, x1 double, z1 double, x2 double, z2 double"), size).collect():
            got.setdefault(c.id, set()).add((c.i, c.j))
        for i, x1, z1, x2, z2 in rows:
            need = {(math.floor((x1 + (x2 - x1) * k / 997) / size), math.floor((z1 + (z2 - z1) * k / 997) / size)) for k in range(998)}
            assert need <= got[i]
            assert len(got[i]) <= len(need) + 3 + 0.2 * len(need) or size == 7.0 and len(got[i]) <= 2 * len(need) + 4


def distance(px, pz, ax, az, bx, bz):
    dx, dz = bx - ax, bz - az
    s = max(0.0, min(1.0, ((px - ax) * dx + (pz - az) * dz) / ((dx * dx + dz * dz) or 1e-12)))
    return math.hypot(ax + s * dx - px, az + s * dz - pz)


@pytest.mark.parametrize("size", [5.0, 60.0])
def test_nearest_segments(spark, size):
    r = random.Random(2)
    rows = sides(r, 40)
    points = [(i, r.uniform(-250, 250), r.uniform(-250, 250)) for i in range(120)] + [(900, 5000.0, -7000.0), (901, -9000.0, 3.0), (902, 10.0, 20.0), (903, 5.0, 5.0)]
    df = spark.createDataFrame([*points, (999, None, 0.0)], "id long, x double, z double")
    got = {p.point: (p.id, p.d) for p in segments.nearest_segments(df, spark.createDataFrame(rows, "id long, x1 double, z1 double, x2 double, z2 double"), size).collect()}
    assert set(got) == {i for i, _, _ in points}
    for i, x, z in points:
        d, best = min((distance(x, z, *s[1:]), s[0]) for s in rows)
        assert got[i][1] == pytest.approx(d, abs=1e-9)
        assert distance(x, z, *next(s[1:] for s in rows if s[0] == got[i][0])) == pytest.approx(d, abs=1e-9)
    assert got[902][0] in (40, 41, 43)
    none = spark.createDataFrame([], "id long, x1 double, z1 double, x2 double, z2 double")
    assert segments.nearest_segments(df, none, size).count() == 0


def hit(ox, oz, dx, dz, ax, az, bx, bz):
    ex, ez = bx - ax, bz - az
    den = dx * ez - dz * ex
    if abs(den) < 1e-12:
        return math.inf
    t, u = ((ax - ox) * ez - (az - oz) * ex) / den, ((ax - ox) * dz - (az - oz) * dx) / den
    return t if t > 1e-9 and 0 <= u <= 1 else math.inf


@pytest.mark.parametrize("size", [6.0, 80.0])
def test_first_hits(spark, size):
    r = random.Random(3)
    rows = sides(r, 30)
    rays = [(i, r.uniform(-400, 400), r.uniform(-400, 400), r.uniform(-2, 2), r.uniform(-2, 2)) for i in range(150)]
    rays += [(500, 0.0, 0.0, 0.0, 0.0), (501, 10.0, -400.0, 0.0, 1.0), (502, -1e5, 19.0, 3.0, 0.0), (503, 1e4, 1e4, 1.0, 1.0), (504, 0.0, 20.0, 0.0, -0.001)]
    df = spark.createDataFrame([*rays, (600, None, 1.0, 1.0, 1.0)], "id long, x double, z double, dx double, dz double")
    got = {h.ray: (h.id, h.t) for h in segments.first_hits(df, spark.createDataFrame(rows, "id long, x1 double, z1 double, x2 double, z2 double"), size).collect()}
    want = {i: min((hit(*ray, *s[1:]), s[0]) for s in rows) for i, *ray in rays}
    assert set(got) == {i for i, (t, _) in want.items() if t < math.inf}
    for i, (_, t) in got.items():
        assert t == pytest.approx(want[i][0], rel=1e-12)
