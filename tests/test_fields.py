"""Painting, masks, samples, overlaps and projections against loops and known values."""

from __future__ import annotations

import itertools
import math
import random

import pytest

from aerolake.functions import projection
from aerolake.operators import fields


def test_painted(spark):
    r = random.Random(1)
    tris = [tuple(r.uniform(-20, 60) if k % 3 != 1 else r.uniform(-3, 30) for k in range(9)) for _ in range(25)]
    tris += [(0, 5, 0, 10, 5, 0, 20, 5, 0), (0.0, 9.0, 0.0, 400.0, 9.0, 0.0, 0.0, 9.0, 300.0), (1, 2, 1, 9, 2, 1, 9, 2, 9)]
    want: dict = {}
    for ax, ay, az, bx, by, bz, cx, cy, cz in tris:
        det = (bx - ax) * (cz - az) - (cx - ax) * (bz - az)
        if abs(det) < 1e-9:
            continue
        for i, j in itertools.product(range(-11, 202), range(-11, 152)):
            x, z = 2 * i + 1, 2 * j + 1
            u, v = ((x - ax) * (cz - az) - (cx - ax) * (z - az)) / det, ((bx - ax) * (z - az) - (x - ax) * (bz - az)) / det
            h = ay + u * (by - ay) + v * (cy - ay)
            if u >= -1e-9 and v >= -1e-9 and u + v <= 1 + 1e-9 and h > 0:
                want[(i, j)] = max(want.get((i, j), 0), h)
    df = spark.createDataFrame([tuple(map(float, t)) for t in tris], "ax double, ay double, az double, bx double, by double, bz double, cx double, cy double, cz double")
    got = {(c.i, c.j): c.h for c in fields.painted(df, 2.0).collect()}
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k], abs=1e-12) for k in want)


def test_over_mask(spark):
    lines = {1: [(0.0, 0.5), (40.0, 0.5)], 2: [(0.0, 0.0), (0.4, 0.3)], 3: [(5.5, -9.0), (5.5, 9.0), (5.5, -9.0)], 4: [(1.0, 1.0)]}
    vertices = spark.createDataFrame([(i, n, x, z) for i, p in lines.items() for n, (x, z) in enumerate(p)], "id long, n int, x double, z double")
    mask = spark.createDataFrame([(i, j) for i in range(5, 10) for j in range(-3, 3)] + [(5, 0)], "i long, j long")
    got = {o.id: (o.length, o.inside) for o in fields.over_mask(vertices, mask, 1.0).collect()}
    assert got == {1: (40.0, 5.0), 2: (0.5, 0.0), 3: (36.0, 12.0)}


def block(r, nx, ny, nz, n):
    return {(i, j, k): (r.random() < 0.7, [r.uniform(0, 9) for _ in range(n)]) for i in range(nx) for j in range(ny) for k in range(nz)}


def test_samples_and_bands(spark):
    r = random.Random(4)
    nx, ny, nz, n = 7, 6, 4, 2
    cells = block(r, nx, ny, nz, n)
    for c in itertools.product((0, 1), (0, 1), (0, 1)):
        cells[c] = (False, [5.0, 5.0])
    field = spark.createDataFrame([(*c, f, v) for c, (f, v) in cells.items()], "i int, j int, k int, fluid boolean, v array<double>")
    points = [(i, r.uniform(-0.5, nx - 0.5), r.uniform(-0.5, ny - 0.5), r.uniform(-1, nz + 1)) for i in range(200)] + [(900, 0.5, 0.5, 0.5), (901, 3.0, 2.0, 1.0), (902, 2.5, 2.5, 3.0)]
    df = spark.createDataFrame([*points, (950, None, 1.0, 1.0)], "id long, x double, y double, z double")
    got = {p.id: p for p in fields.field_band(df, field, (nx, ny, nz), n).collect()}
    inside = [p for p in points if 0 <= p[1] <= nx - 1.001 and 0 <= p[2] <= ny - 1.001]
    assert set(got) == {p[0] for p in inside}
    for i, x, y, z in inside:
        z = max(0.0, min(z, nz - 1.001))
        a, b, c = math.floor(x), math.floor(y), math.floor(z)
        w, ws = [0.0] * n, 0.0
        for p, q, s in itertools.product((0, 1), repeat=3):
            fluid, v = cells[(a + p, b + q, min(nz - 1, c + s))]
            if fluid:
                g = (x - a if p else 1 - x + a) * (y - b if q else 1 - y + b) * (z - c if s else 1 - z + c)
                ws += g
                w = [o + g * t for o, t in zip(w, v, strict=True)]
        want = [o / ws for o in w] if ws > 1e-4 else w
        assert list(got[i].v) == pytest.approx(want, abs=1e-9)
        near = [cells[(e, f, min(nz - 1, c + s))] for e in range(nx) for f in range(ny) for s in (0, 1) if abs(e - x) <= 1.5 + 1e-6 and abs(f - y) <= 1.5 + 1e-6]
        for g in range(n):
            some = [v[g] for fluid, v in near if fluid] + [want[g]]
            assert (got[i].low[g], got[i].high[g]) == pytest.approx((min(some), max(some)), abs=1e-9)
    assert list(got[900].v) == [0.0, 0.0]


def test_shifted_overlap(spark):
    r = random.Random(6)
    a = {(i, j) for i in range(30) for j in range(20) if r.random() < 0.6} | {(100, 3)}
    b = {(i + 2, j - 1) for i, j in a if r.random() < 0.9} | {(-40, 0), (0, 60)}
    as_runs = lambda s: fields.mask_runs(spark.createDataFrame([*s, next(iter(s))], "i long, j long"))
    got = {(o.si, o.sj): (o.inter, o.iou) for o in fields.shifted_overlap(as_runs(a), as_runs(b), 4).collect()}
    assert set(got) == set(itertools.product(range(-4, 5), repeat=2))
    for (si, sj), (inter, iou) in got.items():
        want = len(a & {(i + si, j + sj) for i, j in b})
        assert inter == want and iou == pytest.approx(want / (len(a) + len(b) - want))
    assert max(got, key=lambda s: got[s][1]) == (-2, 1)
    none = fields.shifted_overlap(as_runs(a), as_runs(b).filter("false"), 1).collect()
    assert len(none) == 9 and all(o.inter == 0 and o.iou == 0 for o in none)


def test_projection(spark):
    """The meridian maps to its own east, metres along it are the arc's, and there and back is the same to a micrometre."""
    r = random.Random(2)
    points = [(i, r.uniform(41, 48), r.uniform(12, 20)) for i in range(200)] + [(900, 0.0, 16.5), (901, 45.8, 16.5), (902, -33.0, 18.0), (903, 84.0, 10.0)]
    df = spark.createDataFrame(points, "id int, lat double, lon double")
    for plane in (projection.HTRS96, projection.UTM33):
        there = projection.to_plane(df, plane)
        back = {p.id: p for p in projection.from_plane(there.withColumnsRenamed({"lat": "lat0", "lon": "lon0"}), plane).collect()}
        assert all(abs(p.lat - p.lat0) * 111e3 < 1e-6 and abs(p.lon - p.lon0) * 111e3 < 1e-6 for p in back.values())
    got = {p.id: p for p in projection.to_plane(df, projection.HTRS96).collect()}
    assert got[900].north == pytest.approx(0, abs=1e-9) and got[901].east == pytest.approx(500000, abs=1e-9)
    e2 = projection.FLATTENING * (2 - projection.FLATTENING)
    step = math.radians(45.8) / 20000
    arc = sum(projection.AXIS * (1 - e2) / (1 - e2 * math.sin((k + 0.5) * step) ** 2) ** 1.5 * step for k in range(20000))
    assert got[901].north == pytest.approx(0.9999 * arc, abs=1e-3)
