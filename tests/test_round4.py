"""Cases of the fourth round's findings: nothing that is written between steps grows with the square of the input."""

import numpy as np
import pandas as pd
import pytest

from aerolake.operators import polygons, receptor, spatial


def test_crossings_pass_few_cells_however_dense(spark, monkeypatch):
    """8,000 streets of 10 in a square of 10: cells stay of the streets' size, and pairs leave their cell as crossings only."""
    seen = []
    walked = spatial.walked
    monkeypatch.setattr(spatial, "walked", lambda *a: seen.append(a[-1]) or walked(*a))
    monkeypatch.setattr(spatial, "BLOCK", 7)
    streets = spark.range(8000).selectExpr("id", "CAST(id * 37 % 10 AS DOUBLE) AS x1", "CAST(id * 91 % 11 AS DOUBLE) AS z1", "CAST(id * 37 % 10 AS DOUBLE) + 10 AS x2", "CAST(id * 91 % 11 AS DOUBLE) AS z2")
    out = spatial.crossings(streets, 32.0)
    assert seen[-1] >= 2.0
    assert "Join" not in out._jdf.queryExecution().optimizedPlan().toString()
    few = [(1, 0.0, 0.0, 9.0, 9.0), (2, 0.0, 9.0, 9.0, 0.0), (3, 4.0, 0.0, 4.0, 9.0), (4, 4.0, 1.0, 4.0, 5.0), (5, 40.0, 0.0, 40.0, 9.0), (6, 9.0, 9.0, 9.0, 0.0), (7, 3.0, 3.0, 3.0, 3.0), (8, None, 0.0, 1.0, 1.0)]
    got = sorted(map(tuple, spatial.crossings(spark.createDataFrame(few, "id long, x1 double, z1 double, x2 double, z2 double"), 4.0).collect()))
    assert got == [(1, 2, 4.5, 4.5), (1, 3, 4.0, 4.0), (1, 4, 4.0, 4.0), (1, 6, 9.0, 9.0), (2, 3, 4.0, 5.0), (2, 4, 4.0, 5.0), (2, 6, 9.0, 0.0)]


def _stars(spark, n=60):
    """Squares around places of a grid, every other one over nearly all."""
    return spark.range(4 * n).selectExpr("id DIV 4 AS id", "0 AS ring", "id % 4 AS n", "CAST(id DIV 4 * 7 % 50 + IF(id % 4 IN (1, 2), 1, -1) * IF(id DIV 4 % 2 = 0, 40, 3) AS DOUBLE) + 0.25D AS x", "CAST(id DIV 4 * 3 % 50 + IF(id % 4 > 1, 1, -1) * IF(id DIV 4 % 2 = 0, 40, 3) AS DOUBLE) + 0.25D AS z")


def _shuffled_after_pairs(out):
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    return plan.index("MapInArrow") > min((plan.index(k) for k in ("Aggregate", "Join Inner", "RepartitionByExpression", "Repartition ") if k in plan), default=len(plan))


def test_points_leave_their_cell_in_polygons_only(spark, monkeypatch):
    """Copies of places, pieces of few rows and blocks of few pairs: the last step makes the pairs, and they are those of a plain loop."""
    monkeypatch.setattr(polygons, "BLOCK", 50)
    points = spark.range(900).selectExpr("id", "CAST(id % 300 % 25 * 2 AS DOUBLE) AS x", "CAST(id % 300 DIV 25 * 4 AS DOUBLE) AS z")
    rings = _stars(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        out = polygons.contained(points, rings, 5.0)
        assert not _shuffled_after_pairs(out)
        got = sorted(map(tuple, out.collect()))
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    boxes = {}
    for r in rings.collect():
        boxes.setdefault(r.id, []).append((r.x, r.z))
    want = sorted((p.id, i) for p in points.collect() for i, b in boxes.items() if min(b)[0] <= p.x < max(b)[0] and min(z for _, z in b) <= p.z < max(z for _, z in b))
    assert got == want


def test_holes_take_the_first_ring_by_area(spark):
    """Each hole leaves its cell once, with the smallest ring around it, ties to the smaller id; the others have none."""
    outers = _stars(spark).drop("ring")
    holes = spark.range(600).selectExpr("id DIV 3 AS id", "id % 3 AS n", "CAST(id DIV 3 * 11 % 120 + IF(id % 3 = 1, 3, 0) AS DOUBLE) AS x", "CAST(id DIV 3 * 5 % 60 + IF(id % 3 = 2, 3, 0) AS DOUBLE) AS z")
    out = polygons.holes_assigned(outers, holes, 5.0)
    assert "Aggregate [point" not in out._jdf.queryExecution().optimizedPlan().toString()
    boxes = {}
    for r in outers.collect():
        boxes.setdefault(r.id, []).append((r.x, r.z))
    want = {}
    for k in range(200):
        x, z = k * 11 % 120 + 1, k * 5 % 60 + 1
        around = [((max(b)[0] - min(b)[0]) ** 2, i) for i, b in boxes.items() if min(b)[0] <= x < max(b)[0] and min(v for _, v in b) <= z < max(v for _, v in b)]
        want[k] = min(around)[1] if around else None
    assert dict(map(tuple, out.collect())) == want


def test_plume_sums_on_a_lattice_take_no_pairs(monkeypatch):
    """Dense places on a lattice: as the plain sums, by work that grows with the lattice; elsewhere pairs are worked out as before."""
    made = np.random.default_rng(4)
    n, m = 3000, 2000
    grp = made.choice(["A", "B", None], n)
    sources = pd.DataFrame({"x": made.integers(0, 40, n) * 2.5, "z": made.integers(0, 50, n) * 1.0, "w": made.integers(1, 5, n) * 1.0, "hs": made.choice([0.5, 8.0], n), "sy0": made.choice([1.0, 2.0], n), "grp": grp})
    receptors = pd.DataFrame({"a_id": np.arange(m), "rx": 60 + made.integers(0, 40, m) * 2.5, "ry": made.choice([3.0, 1.5], m), "rz": made.integers(0, 45, m) * 1.0 - 10})
    monkeypatch.setattr(receptor, "PER_CELL", float("inf"))
    plain = receptor._plume_sums(receptors, sources, 230.0, "D", 100.0, 90.0)
    seen = []
    strength = receptor._strength
    monkeypatch.setattr(receptor, "_strength", lambda a, *rest: seen.append(len(a)) or strength(a, *rest))
    monkeypatch.setattr(receptor, "PER_CELL", 1)
    folded = receptor._plume_sums(receptors, sources, 230.0, "D", 100.0, 90.0)
    assert sum(seen) < n * m / 20
    key = lambda t: t.assign(grp=t["grp"].fillna("-")).sort_values(["receptor", "grp"]).reset_index(drop=True)
    plain, folded = key(plain), key(folded)
    assert plain[["receptor", "grp"]].equals(folded[["receptor", "grp"]]) and len(plain) > 2000
    assert folded["gamma"].to_numpy() == pytest.approx(plain["gamma"].to_numpy(), rel=1e-9, abs=1e-12)
    assert folded["age"].to_numpy() == pytest.approx(plain["age"].to_numpy(), rel=1e-9, abs=1e-10)
    off = receptors.assign(rx=receptors["rx"] + 0.1 * (receptors["a_id"] % 2))  # no lattice whose differences are exact
    assert receptor._lattice_sums(off, sources, np.zeros(n, dtype=int), 1, 230.0, "D", 100.0, 90.0) is None
