"""Fits, held-out predictions, totals and verdicts against direct computations."""

from __future__ import annotations

import math
import statistics

import numpy as np
import pytest
from pyspark.sql import functions as F

from aerolake.operators import calibration as cal


def made(spark, noise: float, beta: float = 2.98, u0: float = 1.95, months=(202401, 202402, 202403, 202408, 202409), per: int = 150):
    r = np.random.default_rng(5)
    rows = []
    for month in months:
        for _ in range(per):
            s, u, d, hour = r.uniform(1e-6, 4e-5), r.uniform(0, 7), r.uniform(0, 360), int(r.integers(0, 24))
            obs = 1e6 * beta * s / math.sqrt(u * u + u0 * u0) * math.exp(noise * r.normal())
            rows.append((month, float(s), float(u), float(d), hour, ("weekday", "saturday", "sunday")[int(r.integers(0, 3))], float(obs)))
    return rows, spark.createDataFrame(rows, "month int, s double, u double, direction double, hour int, daytype string, obs double")


def direct(rows):
    """beta and u0 by brute force: for every u0 a fine search in ln(beta)."""
    s, u, o = (np.array([r[i] for r in rows]) for i in (1, 2, 6))
    ok = o > -10
    s, u, lo = s[ok], u[ok], np.log(o[ok] + 10)
    best = (math.inf, 0, 0)
    for u0 in cal.U0_GRID:
        m = 1e6 * s / np.sqrt(u * u + u0 * u0)
        loss = lambda x: float(((lo - np.log(math.exp(x) * m + 10)) ** 2).sum())  # noqa: B023, E731
        x = min(np.linspace(*cal.LN_BETA, 200), key=loss)
        step = (cal.LN_BETA[1] - cal.LN_BETA[0]) / 199
        while step > 1e-8:
            x = min((max(cal.LN_BETA[0], min(cal.LN_BETA[1], x + k * step / 4)) for k in range(-4, 5)), key=loss)
            step /= 3
        if loss(x) < best[0] - 1e-10:
            best = (loss(x), math.exp(x), u0)
    return best


def test_fit_recovers_known_parameters(spark):
    _, hours = made(spark, 0.0)
    f = cal.fit(hours).first()
    assert (f.u0, f.n, f.n_dropped, f.at_bound) == (1.95, 750, 0, False)
    assert f.beta == pytest.approx(2.98, rel=1e-6) and f.loss < 1e-9


@pytest.mark.parametrize("extreme", [False, True])
def test_left_out_equals_direct_refits(spark, extreme):
    rows, _ = made(spark, 0.6)
    rows += [(202403, 2e-5, 3.0, 10.0, 5, "weekday", -10.0), (202403, 2e-5, 3.0, 10.0, 5, "weekday", -50.0)]
    if extreme:  # one month so far off that the folds' minima lie far apart, some at a bound
        rows = [(m, s, u, d, h, t, o * (1 if m != 202408 else 400)) for m, s, u, d, h, t, o in rows if m != 202409] + [(202410, 1e-5, 2.0, 1.0, 3, "sunday", -20.0)]
    hours = spark.createDataFrame(rows, "month int, s double, u double, direction double, hour int, daytype string, obs double")
    got = {r.part: r for r in cal.fit_parts(hours, F.col("month"), leave_out=True).collect()}
    assert set(got) == {r[0] for r in rows}
    for month, f in got.items():
        train = [r for r in rows if r[0] != month]
        loss, beta, u0 = direct(train)
        assert f.u0 == u0 and f.beta == pytest.approx(beta, rel=1e-6) and f.loss == pytest.approx(loss, rel=1e-9)
        assert (f.n, f.n_dropped) == (len(train), sum(r[6] <= -10 for r in train))
    alone = {r.part: r for r in cal.fit_parts(hours, F.col("month"), leave_out=False).collect()}
    loss, beta, u0 = direct([r for r in rows if r[0] == 202401])
    assert alone[202401].u0 == u0 and alone[202401].beta == pytest.approx(beta, rel=1e-6)
    assert (202410 in alone) is False  # no hour with a logarithm


def test_no_hours(spark):
    _, hours = made(spark, 0.1)
    assert cal.fit(hours.filter("false")).count() == 0
    one = hours.filter("month = 202401")
    assert cal.fit_parts(one, F.col("month"), leave_out=True).count() == 0  # nothing to train on
    assert cal.months_left_out(one).count() == 0


def sector(d):
    return math.floor(((d + 11.25) % 360) / 22.5) % 16


@pytest.mark.parametrize("months", [False, True])
def test_held_out(spark, months):
    rows, hours = made(spark, 0.4)
    got = (cal.months_left_out if months else cal.half_years)(hours).collect()
    part = (lambda r: r[0]) if months else (lambda r: r[0] % 100 <= 6)
    assert len(got) == len(rows)
    for p in {part(r) for r in rows}:
        train = [r for r in rows if part(r) != p]
        _, beta, u0 = direct(train)
        x = [(r[5], r[4], sector(r[3]), r[6] * math.sqrt(r[2] ** 2 + 1.44)) for r in train]
        groups: dict = {}
        for day, hour, _, v in x:
            groups.setdefault((day, hour), []).append(v)
        med = {k: statistics.median(v) for k, v in groups.items()}
        ratios: dict = {}
        for day, hour, sec, v in x:
            if med[(day, hour)] > 0:
                ratios.setdefault(sec, []).append(v / med[(day, hour)])
        q = {k: statistics.median(v) for k, v in ratios.items()}
        for g in (g for g in got if part((g.month,)) == p):
            assert g.u0 == u0 and g.mod == pytest.approx(1e6 * beta * g.s / math.sqrt(g.u**2 + u0**2), rel=1e-6)
            want = med.get((g.daytype, g.hour)), q.get(sector(g.direction))
            assert g.base is None if None in want else g.base == pytest.approx(want[0] * want[1] / math.sqrt(g.u**2 + 1.44), rel=1e-9)


def test_congestion_share(spark):
    rows = [("weekday", 7, 1.0, 4.0, 0.0, 0.0), ("weekday", 17, 2.0, 2.0, 0.0, 0.0), ("weekday", 9, 9.0, 9.0, 9.0, 9.0), ("sunday", 7, 9.0, 9.0, 9.0, 9.0)]
    hours = spark.createDataFrame(rows, "daytype string, hour int, queue_A double, gamma_A double, queue_B double, gamma_B double")
    assert dict(map(tuple, cal.congestion_share(hours).collect())) == {"A": 0.5, "B": 0.37}
    assert dict(map(tuple, cal.congestion_share(hours.filter("false")).collect())) == {"A": 0.21, "B": 0.37}


def test_verdict(spark):
    scored = spark.createDataFrame([("model", 0.66, 5.0, 0.31, 0.6, 0.5, 1.0, 3.0), ("baseline", -0.7, 6.0, 0.30, 0.4, 0.4, 1.0, 2.0)], "kind string, fb double, nmse double, fac2 double, nad double, r double, mg double, vg double")
    got = {(v.kind, v.score): (v.accepted, v.better) for v in cal.verdict(scored).collect()}
    assert [got[("model", k)][0] for k in ("fb", "nmse", "fac2", "nad", "r")] == [True, True, True, False, None]
    assert [got[("baseline", k)][0] for k in ("fb", "nmse", "fac2", "nad")] == [False, False, False, True]
    assert [got[("model", k)][1] for k in ("r", "nmse", "vg", "fb")] == [True, True, False, None]


def test_totals_use_each_fold_s_wind(spark):
    """An hour without a positive response has the usual age; hours that lack the background take no part, those that lack measured NOx only NOx."""
    schema = "mod double, u0 double, u double, sw double, t2 double, no2 double, nox double, b2 double, bx double, b3 double, way double, share double"
    rows = [(40.0, 1.0, 2.0, 300.0, 15.0, 50.0, 90.0, 20.0, 30.0, 60.0, 100.0, 1.0), (40.0, 3.0, 2.0, 300.0, 15.0, 45.0, None, 20.0, 30.0, 60.0, 100.0, 1.0), (40.0, 3.0, 2.0, None, None, 45.0, 80.0, 20.0, 30.0, 60.0, 5.0, 0.0), (40.0, 3.0, 2.0, 1.0, 1.0, 45.0, 80.0, None, 30.0, 60.0, 5.0, 0.0)]
    keys = {"no2": "no2", "nox": "nox", "bg_no2": "b2", "bg_nox": "bx", "bg_o3": "b3"}
    got = {t.pollutant: t for t in cal.totals(spark.createDataFrame(rows, schema), F.col("way"), F.col("share"), keys).collect()}
    assert (got["no2"].n, got["nox"].n) == (3, 2) and got["no2"].mqi > 0 and got["nox"].mqi is None
    assert got["nox"].rmse == pytest.approx(math.sqrt((20**2 + 10**2) / 2), rel=1e-6)  # NOx is increment and background, whatever the age


def test_one_call(spark):
    _, hours = made(spark, 0.4)
    out = cal.calibrate(hours.withColumn("cls", F.lit("D")))
    assert out["fit"].count() == 1 and out["months"].count() == 750 and out["lomo_params"].count() == 5 and out["verdict"].count() == 14
    assert {r.kind for r in out["test"].collect()} == {"model", "baseline"} and out["diagnostics"].count() > 20


def test_missing_irradiance_is_estimated(spark):
    """Noon in June has light, midnight has none; a given value is kept; without a site missing counts as dark."""
    from aerolake.operators import receptor

    schema = "t timestamp_ntz, u double, sw double, cc double, t2 double, gamma array<double>, age array<double>"
    rows = [(f"2024-06-21 {h}:00:00", 2.0, sw, 0.0, 20.0, [1.0] * 4, [60.0] * 4) for h, sw in (("12", None), ("00", None), ("12", 0.0), ("12", float("nan")))]
    hours = spark.createDataFrame([(t, *rest) for t, *rest in rows], schema.replace("timestamp_ntz", "string")).withColumn("t", F.col("t").cast("timestamp_ntz")).withColumn("i", F.monotonically_increasing_id())
    no2 = lambda **k: [r.no2 for r in receptor.concentrations(hours, 1.0, 1.4, **k).orderBy("i").collect()]
    with_site, without = no2(site=(45.8, 16.0)), no2()
    assert with_site[0] < without[0] and with_site[0] == with_site[3]  # light splits NO2
    assert with_site[2] == without[2] == without[0] and with_site[1] == without[1]
    by_source = receptor.concentrations(hours.withColumn("b", F.lit(2.0)), F.col("b"), F.lit(1.4)).first()
    assert by_source.inc_nox == pytest.approx(2 * receptor.concentrations(hours, 1.0, 1.4).first().inc_nox)
