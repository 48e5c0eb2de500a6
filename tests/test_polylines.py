"""Clipping, simplification, discretisation and thinning against their definitions."""

from __future__ import annotations

import math
import random

import pytest
from pyspark.sql import functions as F

from aerolake.operators import polylines

BOX = (-20.0, 30.0, -10.0, 25.0)


def lines(spark, rows: dict[int, list]):
    return spark.createDataFrame([(i, n * 3, float(x), float(z)) for i, line in rows.items() for n, (x, z) in enumerate(line)], "id long, n int, x double, z double")


def area(ring) -> float:
    return sum(a[0] * b[1] - b[0] * a[1] for a, b in zip(ring, ring[1:] + ring[:1], strict=True)) / 2


def rings(spark, rows: dict[int, list]):
    return spark.createDataFrame([(i, [(float(x), float(z)) for x, z in ring]) for i, ring in rows.items()], "id long, ring array<struct<x:double,z:double>>")


def test_clipped_ring(spark):
    """Areas of what lies inside and of four parts of the plane outside add up; concave, outside, enclosing, touching and empty rings."""
    r = random.Random(1)
    some = {i: [((d := r.uniform(10, 60)) * math.cos(2 * math.pi * k / 14), d * math.sin(2 * math.pi * k / 14)) for k in range(14)] for i in range(15)}
    some |= {50: [(-60, -5), (60, -5), (60, 0), (10, 0), (10, 5), (60, 5), (60, 12), (-60, 12)], 51: [(100, 100), (120, 100), (110, 130)], 52: [(-99, -99), (99, -99), (99, 99), (-99, 99)], 53: [(30, -10), (40, -10), (40, 25), (30, 25)], 54: []}
    big = 1000.0
    x0, x1, z0, z1 = BOX
    parts = {"in": BOX, "left": (-big, x0, -big, big), "right": (x1, big, -big, big), "below": (x0, x1, -big, z0), "above": (x0, x1, z1, big)}
    df = rings(spark, some).select("id", *(polylines.clipped_ring(F.col("ring"), b).alias(n) for n, b in parts.items()))
    for row in df.collect():
        whole = [tuple(p) for p in some[row.id]]
        got = {n: [(p.x, p.z) for p in row[n]] for n in parts}
        assert sum(area(g) for g in got.values()) == pytest.approx(area(whole), abs=1e-8)
        assert all(x0 - 1e-9 <= x <= x1 + 1e-9 and z0 - 1e-9 <= z <= z1 + 1e-9 for x, z in got["in"])
        if row.id in (51, 54):
            assert got["in"] == []
        if row.id == 52:
            assert set(got["in"]) == {(x0, z0), (x1, z0), (x1, z1), (x0, z1)}
        if row.id == 53:
            assert area(got["in"]) == 0
    outside = df.filter("id = 50").first()["in"]
    assert area([(p.x, p.z) for p in outside]) == (12 + 5) * 50 - 20 * 5


def clip(pts, box, keep):
    """Pieces from a fine walk along the line: by definition, the maximal stretches whose points lie inside."""
    x0, x1, z0, z1 = box
    pieces, now = [], 0.0
    for a, b in zip(pts, pts[1:], strict=False):
        ts = {0.0, 1.0}
        for p, d, lo, hi in ((a[0], b[0] - a[0], x0, x1), (a[1], b[1] - a[1], z0, z1)):
            if d:
                ts |= {t for t in ((lo - p) / d, (hi - p) / d) if 0 < t < 1}
        ts = sorted(ts)
        for s, t in zip(ts, ts[1:], strict=False):
            m = (s + t) / 2
            x, z = a[0] + m * (b[0] - a[0]), a[1] + m * (b[1] - a[1])
            length = math.dist(a, b) * (t - s)
            if (x0 <= x <= x1 and z0 <= z <= z1) == keep:
                now += length
            elif length:
                pieces, now = [*pieces, now], 0.0
    return [p for p in [*pieces, now] if p > 0.5]


@pytest.mark.parametrize("keep", [True, False])
def test_clipped_polylines(spark, keep):
    r = random.Random(2)
    some = {i: [(r.uniform(-60, 60), r.uniform(-60, 60)) for _ in range(r.randrange(1, 12))] for i in range(25)}
    some |= {60: [(-50, 0), (50, 0), (50, 5), (-50, 5)], 61: [(0, 0), (1, 1), (1, 1), (2, 2)], 62: [(100, 0), (200, 0)], 63: [(-20, -50), (-20, 50)], 64: [(0, 0), (0.1, 0.1)]}
    got: dict = {}
    for p in polylines.clipped_polylines(lines(spark, some), BOX, keep).orderBy("id", "piece", "n").collect():
        got.setdefault(p.id, {}).setdefault(p.piece, []).append((p.x, p.z))
    for i, pts in some.items():
        pieces = [got[i][k] for k in sorted(got.get(i, {}))] if i in got else []
        assert sorted(got.get(i, {})) == list(range(len(pieces)))
        want = clip(pts, BOX, keep)
        assert [sum(math.dist(a, b) for a, b in zip(p, p[1:], strict=False)) for p in pieces] == pytest.approx(want, abs=1e-9)
    if keep:
        assert got[60] == {0: [(-20, 0), (30, 0)], 1: [(30, 5), (-20, 5)]}


def rdp(pts, tol):
    if len(pts) < 3:
        return list(pts)
    (x1, z1), (x2, z2) = pts[0], pts[-1]
    d = [abs((z2 - z1) * (x - x1) - (x2 - x1) * (z - z1)) / (math.sqrt((x2 - x1) ** 2 + (z2 - z1) ** 2) or 1e-12) for x, z in pts[1:-1]]
    i = max(range(len(d)), key=lambda k: (d[k], -k)) + 1
    return rdp(pts[: i + 1], tol)[:-1] + rdp(pts[i:], tol) if d[i - 1] > tol else [pts[0], pts[-1]]


def collected(df) -> dict:
    got: dict = {}
    for p in df.orderBy("id", "n").collect():
        got.setdefault(p.id, []).append((p.x, p.z))
    return got


def walk(r, n):
    x = z = 0.0
    out = []
    for _ in range(n):
        x, z = x + r.uniform(-1, 3), z + r.uniform(-2, 2)
        out.append((x, z))
    return out


def test_simplified(spark):
    r = random.Random(5)
    some = {i: walk(r, r.randrange(1, 60)) for i in range(12)} | {40: [(0, 0), (1, 1), (2, 0), (3, 1), (4, 0)], 41: [(0, 0), (1, 0), (2, 0)], 42: [(0, 0), (5, 5), (0, 0)], 43: [(1, 2)], 44: walk(r, 400)}
    for tolerance in (0.0, 1.0, 4.0):
        assert collected(polylines.simplified(lines(spark, some), tolerance)) == {i: rdp([tuple(map(float, p)) for p in pts], tolerance) for i, pts in some.items()}


def ring_rdp(ring, tol):
    ring = ring[:-1] if len(ring) > 1 and ring[0] == ring[-1] else ring
    if len(ring) < 4:
        return ring if len(ring) == 3 else []
    far = max(range(len(ring)), key=lambda i: (math.dist(ring[i], ring[0]), -i))
    out = rdp(ring[: far + 1], tol)[:-1] + rdp(ring[far:] + [ring[0]], tol)[:-1]
    return out if len(out) >= 3 else []


def test_simplified_rings(spark):
    r = random.Random(6)
    some = {i: [((d := r.uniform(8, 12)) * math.cos(2 * math.pi * k / n), d * math.sin(2 * math.pi * k / n)) for k in range(n)] for i in range(10) for n in [r.randrange(3, 40)]}
    some[3] = [*some[3], some[3][0]]
    some |= {30: [(0.0, 0.0), (1.0, 0.0), (2.0, 0.0), (3.0, 0.1)], 31: [(0.0, 0.0), (1.0, 0.0)], 32: [(0.0, 0.0), (4.0, 0.0), (4.0, 4.0), (0.0, 0.0)], 33: [(5.0, 5.0)]}
    for tolerance in (0.5, 2.0):
        want = {i: out for i, ring in some.items() if (out := ring_rdp(ring, tolerance))}
        assert collected(polylines.simplified_rings(lines(spark, some), tolerance)) == want


def test_sources_keep_what_is_driven(spark):
    """Weights of a road sum to length times traffic; spacing holds; queues follow the direction of travel."""
    some = {1: [(0, 0), (10, 0), (10, 0), (10, 7)], 2: [(50, 0), (150, 0)], 3: [(0, 0), (1, 1)], 4: [(30, 0), (130, 0)]}
    roads = spark.createDataFrame([(1, "A", 12000, 0.0, 3, 0), (2, "B", 5000, 9.0, 2, -1), (3, None, 100, 5.0, 1, 0), (4, "B", 5000, None, None, 1)], "id long, grp string, daily int, width double, lanes int, oneway int")
    got: dict = {}
    for p in polylines.road_sources(lines(spark, some), roads, centre=(0.0, 0.0)).collect():
        got.setdefault(p.id, []).append(p)
    assert set(got) == {1, 2, 4}
    assert sum(p.w for p in got[1]) == pytest.approx(12 * 17, rel=1e-9) and len(got[1]) == 3 + 2
    assert sum(p.w for p in got[2]) == pytest.approx(5 * 100, rel=1e-9) and len(got[2]) == 25
    assert {p.sy0 for p in got[1]} == {3.25 * 3 / 2} and {p.sy0 for p in got[2]} == {4.5} and {p.sy0 for p in got[4]} == {3.25}
    assert all(p.queue == (1.0 if 15 <= p.x <= 75 else 0.0) for p in got[2])  # against its vertices, so towards the centre
    assert all(p.queue == 0 for p in got[4]) and all(p.queue == (0.5 if math.hypot(p.x, p.z) >= 15 else 0) for p in got[1])


def test_area_sources(spark):
    rings_ = spark.createDataFrame([(1, 0, n, float(x), float(z)) for n, (x, z) in enumerate([(0, 0), (100, 0), (100, 50), (0, 50)])] + [(1, 1, n, float(x), float(z)) for n, (x, z) in enumerate([(20, 20), (40, 20), (40, 40), (20, 40)])] + [(2, 0, n, float(x), float(z)) for n, (x, z) in enumerate([(0, 100), (20, 100), (0, 120)])], "id long, ring int, n int, x double, z double")
    got = polylines.area_sources(rings_, spark.createDataFrame([(1, 2.5)], "id long, weight double")).collect()
    assert sum(p.w for p in got if p.id == 1) == 2.5 * (5000 - 400)
    assert {(p.x, p.z) for p in got if p.id == 2} == {(5.0, 105.0), (5.0, 115.0), (15.0, 105.0)} - {(5.0, 115.0), (15.0, 105.0)} or sum(p.w for p in got if p.id == 2) in (100.0, 200.0, 300.0)


def test_thinned_is_the_sequential_loop(spark):
    r = random.Random(9)
    points = [(i, r.uniform(0, 40), r.uniform(0, 40)) for i in range(250)] + [(1000 + i, 100.0 + i * 0.9, 0.0) for i in range(60)] + [(2000 + i, 5.0, 5.0) for i in range(40)]
    taken: list = []
    for p in sorted(points):
        if all(math.dist(p[1:], q[1:]) >= 2.0 for q in taken):
            taken.append(p)
    df = spark.createDataFrame(r.sample(points, len(points)), "id long, x double, z double")
    assert sorted(map(tuple, polylines.thinned(df, 2.0).collect())) == taken
