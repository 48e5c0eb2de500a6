"""Cases of the third round's findings: work that must not grow with the square of the input, and ties with the SQL."""

import math

import numpy as np
import pytest

from aerolake.operators import calibration, fields, lookups, polygons, polylines, receptor, segments, spatial
from aerolake.plans import ledger
from aerolake.sources import intermediate


def test_plume_sums_leave_no_pairs(spark):
    """Sources of one cell are dealt to several groups and meet receptors in arrays; the only join is the one that leaves out empty cells."""
    sources = spark.range(400).selectExpr("id", "CAST(id % 20 AS DOUBLE) * 40 AS x", "CAST(id DIV 20 AS DOUBLE) * 30 AS z", "1.0D + id % 3 AS w", "IF(id % 2 = 0, 8.0D, 0.5D) AS hs", "1.0D + id % 2 AS sy0", "IF(id % 2 = 0, 'D', 'A') AS grp")
    receptors = spark.createDataFrame([(1, 400.0, 3.0, 300.0), (2, 10.0, 3.0, 20.0), (3, None, 3.0, 1.0)], "id long, x double, y double, z double")
    out = receptor.plume(sources, receptors, 230.0, "D", 100.0)
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "FlatMapCoGroupsInPandas" in plan and "Join Inner" not in plan
    got = {(r.receptor, r.grp): (r.gamma, r.age) for r in out.collect()}
    bx, bz = -math.sin(math.radians(230.0)), math.cos(math.radians(230.0))
    want: dict = {}
    for s in sources.collect():
        for i, rx, ry, rz in ((1, 400.0, 3.0, 300.0), (2, 10.0, 3.0, 20.0)):
            dx, dz = rx - s.x, rz - s.z
            a, y = dx * bx + dz * bz, -dx * bz + dz * bx
            if math.hypot(dx, dz) > 800 or a <= 0.5:
                continue
            sy, sz = math.hypot(s.sy0, 0.16 * a / math.sqrt(1 + 0.0004 * a)), math.hypot(2, 0.14 * a / math.sqrt(1 + 0.0003 * a))
            if abs(y) > 6 * sy:
                continue
            es = [(h + 200 * n) ** 2 / (2 * sz * sz) for n in (range(-3, 4) if sz > 25 else (0,)) for h in (ry - s.hs, ry + s.hs)]
            g = s.w / (2 * math.pi * sy * sz) * math.exp(-y * y / (2 * sy * sy)) * sum(math.exp(-e) for e in es if e < 40)
            old = want.get((i, s.grp), (0.0, 0.0))
            want[i, s.grp] = (old[0] + g, old[1] + g * a)
    assert got.keys() == want.keys()
    for k, v in want.items():
        assert got[k] == pytest.approx(v, rel=1e-12)


def test_nearest_takes_the_finest_cells(spark):
    """2,000 places and their copies ask cells of a few neighbours, ties going to the smaller id at exactly the border's distance."""
    a = spark.range(4000).selectExpr("id", "CAST(id % 100 AS DOUBLE) AS x", "CAST(id DIV 100 % 20 AS DOUBLE) AS z")
    b = spark.range(900).selectExpr("id", "CAST(id * 7 % 100 AS DOUBLE) + 0.5D AS x", "CAST(id * 3 % 19 AS DOUBLE) AS z")
    got = {r.a_id: (r.d, r.b_id) for r in spatial.nearest(a, b, 100.0).collect()}
    places = [(r.x, r.z, r.id) for r in b.collect()]
    want = {r.id: min((math.sqrt((r.x - x) ** 2 + (r.z - z) ** 2), i) for x, z, i in places) for r in a.collect()}
    assert got == want
    assert segments.fine_step(900, 0.0, 100.0 * 18, 100.0) < 5


def test_close_pairs_meet_once_without_broadcast(spark):
    p = spark.range(300).selectExpr("id", "CAST(id * 37 % 50 AS DOUBLE) AS x", "CAST(id * 91 % 47 AS DOUBLE) AS z")
    out = spatial.close_pairs(p, 5.0)
    assert "BroadcastHashJoin" not in out._jdf.queryExecution().executedPlan().toString()
    rows = p.collect()
    want = sorted((a.id, b.id) for a in rows for b in rows if a.id < b.id and math.hypot(a.x - b.x, a.z - b.z) <= 5)
    assert sorted((r.a_id, r.b_id) for r in out.collect()) == want


def test_archive_sums_orders_before_it_spreads_them(spark):
    """An order is one row until hours are made of sums: the aggregate stands below the explode."""
    plan = ledger.ledger(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.rindex("Aggregate") > plan.rindex("Generate")


def test_mask_marks_are_not_shuffled(spark):
    """Only the vertices and the mask's own cells are exchanged; the marks meet the mask where the line lies. A large mask gives the same."""
    lines = spark.range(40).selectExpr("id DIV 4 AS id", "id % 4 AS n", "CAST(id * 7 % 50 AS DOUBLE) AS x", "CAST(id * 3 % 40 AS DOUBLE) AS z")
    mask = spark.range(200).selectExpr("id % 20 AS i", "id * 3 % 17 AS j")
    out = fields.over_mask(lines, mask, 2.0)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and plan.count("hashpartitioning(id") == 1
    small, fields.BROADCAST = fields.BROADCAST, 0
    try:
        large = fields.over_mask(lines, mask, 2.0)
        assert sorted((r.id, round(r.length, 9), round(r.inside, 9)) for r in large.collect()) == sorted((r.id, round(r.length, 9), round(r.inside, 9)) for r in out.collect())
    finally:
        fields.BROADCAST = small


def test_windows_have_as_many_tasks_as_rows_need(spark, monkeypatch):
    monkeypatch.setattr(intermediate, "ROWS", 10)
    lines = spark.range(400).selectExpr("id % 5 AS name", "id DIV 4 AS id", "id % 4 AS n", "CAST(id AS DOUBLE) AS x", "0.0D AS z")
    assert intermediate.in_parts(lines, "id").rdd.getNumPartitions() == 40
    for out in (lookups.longest(lines), polylines.clipped_polylines(lines, (0.0, 1.0, 0.0, 1.0))):
        assert "REPARTITION_BY_NUM" in out._jdf.queryExecution().executedPlan().toString()


def test_polygon_joins_are_never_broadcast(spark):
    """Rows of cells come of few runs, which the planner takes for small."""
    points = spark.range(100).selectExpr("id", "CAST(id % 10 AS DOUBLE) AS x", "CAST(id DIV 10 AS DOUBLE) AS z")
    rings = spark.range(4).selectExpr("1L AS id", "0 AS ring", "id AS n", "IF(id IN (1, 2), 8.5D, 0.5D) AS x", "IF(id > 1, 8.5D, 0.5D) AS z")
    out = polygons.contained(points, rings, 3.0)
    assert "BroadcastHashJoin" not in out._jdf.queryExecution().executedPlan().toString()
    assert out.count() == 64


def test_thinning_makes_no_link_of_all_pairs(spark, monkeypatch):
    """3,000 points in four cells: links are made of few heads at a time, and the result is that of the loop."""
    seen = []
    pairs = polylines.close_pairs
    monkeypatch.setattr(polylines, "close_pairs", lambda p, d: seen.append(p.count()) or pairs(p, d))
    points = spark.range(3000).selectExpr("id", "CAST(id * 37 % 60 AS DOUBLE) AS x", "CAST(id * 91 % 59 AS DOUBLE) AS z")
    got = sorted(r.id for r in polylines.thinned(points, 30.0).collect())
    want: list = []
    for r in points.collect():
        if all(math.hypot(r.x - x, r.z - z) >= 30 for _, x, z in want):
            want.append((r.id, r.x, r.z))
    assert got == [i for i, *_ in want]
    assert max(seen) <= 4 * polylines.HEADS


def test_zooms_end_on_the_grid_of_the_search():
    """The half-years' fits take the best of ever finer grids, as their SQL does, and not the minimum between its steps."""
    series = np.array([[[0.5 + 0.3337**2, -2 * 0.3337, 0.5]]])  # (x - 0.3337)^2
    at, _ = calibration._zoomed(series, np.array([[-1.0]]), np.array([[1.0]]), 7)
    low, high, f = -1.0, 1.0, lambda x: (x - 0.3337) ** 2
    for _ in range(7):
        i = min(range(13), key=lambda k: f(low + (high - low) * k / 12))
        best, low, high = low + (high - low) * i / 12, low + (high - low) * max(i - 1, 0) / 12, low + (high - low) * min(i + 1, 12) / 12
    assert at[0, 0] == pytest.approx(best, abs=1e-9)
