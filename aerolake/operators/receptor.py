"""Concentrations at a receptor: responses by a cascade of sources, calibration, background, increments and chemistry.

Responses are arrays over the source groups A to D. All tables that are joined here hold rows for sixteen directions and a few
stability groups, so they are broadcast; hours are never shuffled.
"""

from __future__ import annotations

import math
from collections.abc import Iterable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from aerolake.functions import chemistry, emissions, weather
from aerolake.operators.spatial import cells

# Background where none is given, ug/m3 (carbon monoxide: mg/m3), and NOx where only NO2 is; prior parameters.
BACKGROUND = {"nox": 24.0, "no2": 16.3, "o3": 54.0, "pm10": 25.6, "pm25": 15.7, "co": 0.19, "c6h6": 0.35}
NOX_PER_NO2 = 24.0 / 16.3
PRIOR_BETA, PRIOR_U0 = 1.0, 1.4
#: Share of the largest group's response under which a change is carried over as a difference, not as a ratio.
DELTA_SHARE = 0.05
# The plume's start: vertical spread, nearest distance, crosswind cut in spreads, images, largest exponent; lateral growth.
START_Z, NEAREST, CUT, IMAGES, FAR = 2.0, 0.5, 6.0, 3, 40.0
#: Vertical growth c * x * (1 + d * x) ** power, as ``chemistry.briggs`` has it.
VERTICAL = {"A": (0.24, 0.001, 0.5), "B": (0.24, 0.001, 0.5), "C": (0.2, 0.0, 0.0), "D": (0.14, 0.0003, -0.5), "E": (0.08, 0.0015, -0.5), "F": (0.08, 0.0015, -0.5)}
#: Parts that a cell's receptors are dealt to by id, and its sources by kind; receptors taken at a time in a part.
PARTS, KINDS, STRIP = 2, 3, 64
#: Pairs that cost what a cell of a lattice does; cells of a lattice at most.
PER_CELL, LATTICE = 40, 1 << 22
LATERAL = {"A": 0.32, "B": 0.32, "C": 0.22, "D": 0.16, "E": 0.11, "F": 0.11}


def _sum(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda x, y: x + F.coalesce(y, F.lit(0.0)))


def background(given: dict[str, Column]) -> dict[str, Column]:
    """Given values where known; NOx from NO2 where that is; else the defaults."""
    out = {k: F.coalesce(given.get(k, F.lit(None).cast("double")), F.lit(v)) for k, v in BACKGROUND.items()}
    some = lambda k: given.get(k, F.lit(None).cast("double"))
    return out | {"nox": F.coalesce(some("nox"), some("no2") * NOX_PER_NO2, F.lit(BACKGROUND["nox"]))}


def carried_over(table: Column, scenario: Column, today: Column) -> Column:
    """A scenario's response on another grid, carried onto the table's by what it changes there: by ratio where today's response is a real share, else by difference."""
    zero = F.lit(0.0)
    scale = F.when(_sum(today) > 0, _sum(table) / _sum(today)).otherwise(1.0)
    three = F.zip_with(F.zip_with(table, scenario, lambda a, b: F.struct(F.coalesce(a, zero).alias("l"), F.coalesce(b, zero).alias("s"))), today, lambda p, t: F.struct(p["l"].alias("l"), p["s"].alias("s"), F.coalesce(t, zero).alias("t")))
    given = F.struct(three.alias("x"), scale.alias("scale"), F.greatest(F.array_max(today), zero).alias("big"))
    return chemistry.once(given, lambda g: F.transform(g["x"], lambda x: F.when((x["t"] > 0) & (x["t"] >= DELTA_SHARE * g["big"]), x["l"] * x["s"] / x["t"]).otherwise(F.greatest(F.lit(0.0), x["l"] + (x["s"] - x["t"]) * g["scale"]))))


def responses(directions: DataFrame, fields: DataFrame, table: DataFrame, fallback: DataFrame, scenario: str, grid: str) -> DataFrame:
    """(direction, grp, gamma, source) for every row of ``directions`` (direction, grp): the first of

    the scenario's own field on the table's grid (or where the table has no row); its change against today's field of the same
    grid, on the table; the field itself; today's field on the table's grid; the table; the fallback. ``fields``: (scenario,
    grid, direction, grp, gamma).
    """
    by = ["direction", "grp"]
    own = fields.filter(F.col("scenario") == scenario).select(*by, F.col("gamma").alias("_own"), F.col("grid").alias("_grid"))
    now = fields.filter("scenario = 'today'").select(*by, F.col("gamma").alias("_now"), F.col("grid").alias("_now_grid"))
    lut = table.select(*by, F.col("gamma").alias("_lut"))
    last = fallback.select(*by, F.col("gamma").alias("_last"))
    rows = directions
    for side in (own, now, lut, last):
        rows = rows.join(F.broadcast(side), by, "left")  # sixteen directions, a few groups
    fits = lambda own_, at: F.col(own_).isNotNull() & ((F.col(at) == grid) | F.col(at).isNull() | F.col("_lut").isNull())
    foreign = F.col("_own").isNotNull() & F.lit(scenario != "today")
    steps = [
        (fits("_own", "_grid"), F.col("_own"), "field"),
        (foreign & F.col("_now").isNotNull() & (F.col("_now_grid") == F.col("_grid")), carried_over(F.col("_lut"), F.col("_own"), F.col("_now")), "field"),
        (foreign, F.col("_own"), "field"),
        (F.lit(scenario != "today") & fits("_now", "_now_grid"), F.col("_now"), "field"),
        (F.col("_lut").isNotNull(), F.col("_lut"), "table"),
        (F.col("_last").isNotNull(), F.col("_last"), "fallback"),
    ]
    gamma, source = None, None
    for when, value, name in steps:
        gamma = F.when(when, value) if gamma is None else gamma.when(when, value)
        source = F.when(when, name) if source is None else source.when(when, name)
    return rows.select(*by, gamma.alias("gamma"), source.alias("source"))


def calibration(source: Column, fitted: dict[str, tuple[float, float]], calibrated: bool = True, fitted_grid: str | None = None, grid: str | None = None) -> tuple[Column, Column, Column]:
    """beta, u0 and status by source: fitted values ("fallback": those of the plume model, else those of the flow model, fitted on the same grid only), else the priors."""
    use = dict(fitted) if calibrated else {}
    if fitted_grid and grid and fitted_grid != grid:
        use.pop("flow", None)
    kind = F.when(source == "fallback", "plume").otherwise("flow")
    pick = lambda i, prior: F.coalesce(*(F.when(kind == k, F.lit(v[i])) for k, v in use.items()), F.lit(prior))
    status = F.when(kind.isin(*use), "calibrated").otherwise("uncalibrated" if calibrated else "raw") if use else F.lit("uncalibrated" if calibrated else "raw")
    return pick(0, PRIOR_BETA), pick(1, PRIOR_U0), status


def concentrations(hours: DataFrame, beta: float | Column, u0: float | Column, measures: dict[str, Column] | None = None, heating: str | bool = "auto", share: float = 0.10, site: tuple[float, float] | None = None) -> DataFrame:
    """hours (t, u, sw, t2, gamma, age, bg_<pollutant>...) with all pollutants, increments ``inc_*``, parts ``by_*`` by group and ``tau``.

    beta and u0 may be columns, as ``calibration`` gives them for each hour's source. Where a ``site`` (latitude, longitude) is given, missing
    irradiance is estimated from the sun half an hour before t and the cloud ``cc`` (missing: 50 %).
    """
    beta, u0 = (v if isinstance(v, Column) else F.lit(v) for v in (beta, u0))
    sun = F.col("sw")
    if site is not None:
        cloud = F.col("cc") if "cc" in hours.columns else F.lit(None).cast("double")
        sun = F.coalesce(F.when(~F.isnan(sun), sun), weather.irradiance(weather.solar_elevation(F.col("t") - F.expr("INTERVAL 30 MINUTES"), *site), cloud))
    calendar = emissions.local_calendar(F.col("t"))
    hours = hours.withColumns({"_sun": sun} | {f"_{k}": c for k, c in calendar.items()})
    calendar = {k: F.col(f"_{k}") for k in calendar}
    hours = hours.withColumn("_traffic", emissions.traffic_factor(F.col("t"), calendar=calendar))
    calendar["traffic"] = F.col("_traffic")
    wind = weather.u_eff(F.coalesce(F.col("u"), F.lit(0.0)), u0)
    given = {k: F.col(f"bg_{k}") if f"bg_{k}" in hours.columns else F.lit(None).cast("double") for k in BACKGROUND}
    out = hours.withColumns({f"_bg_{k}": c for k, c in background(given).items()} | {"_wind": wind})
    for p in emissions.POLLUTANTS:
        q = emissions.group_strengths(p, F.col("t"), measures, heating, calendar=calendar)
        out = out.withColumn(f"_q_{p}", F.array(*(q[g] for g in "ABCD")))
    for p in emissions.POLLUTANTS:
        scale = 1e3 if p == "co" else 1e6  # carbon monoxide in mg/m3
        out = out.withColumn(f"by_{p}", F.zip_with(f"_q_{p}", "gamma", lambda a, g: scale * beta * a * F.coalesce(g, F.lit(0.0)) / F.col("_wind")))
        out = out.withColumn(f"inc_{p}", _sum(F.col(f"by_{p}")))
    weight = lambda c: _sum(F.zip_with("_q_nox", c, lambda a, g: a * F.coalesce(g, F.lit(0.0))))
    out = out.withColumn("tau", F.when(weight("gamma") > 0, weight("age") / (F.col("_wind") * weight("gamma"))).otherwise(60.0))
    out = chemistry.with_no2(out, "_scheme", F.col("inc_nox"), F.col("_bg_no2"), F.col("_bg_nox"), F.col("_bg_o3"), F.col("tau"), chemistry.photolysis(F.col("_sun")), chemistry.titration(F.col("t2")), share)
    out = out.withColumns({k: F.col(f"_scheme.{k}") for k in ("nox", "no2", "no", "o3")})
    out = out.withColumns({p: F.col(f"_bg_{p}") + F.col(f"inc_{p}") for p in ("pm10", "pm25", "co", "c6h6")} | {"inc_no2": F.col("no2") - F.col("_bg_no2")})
    return out.drop("_wind", "_sun", "_scheme", *(f"_{k}" for k in calendar), *(f"_q_{p}" for p in emissions.POLLUTANTS), *(f"_bg_{k}" for k in BACKGROUND))


def _images(sz: np.ndarray, ry: np.ndarray, hs: np.ndarray, lid: float, numbers: Iterable[int]) -> np.ndarray:
    out = np.zeros_like(sz)
    for n in numbers:
        for h in (ry - hs, ry + hs):
            e = (h + 2 * n * lid) ** 2 / (2 * sz * sz)
            out += np.where(e < FAR, np.exp(-e), 0.0)
    return out


def _near(dx: np.ndarray, dz: np.ndarray, sy0: np.ndarray | float, direction: float, cls: str, radius: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ways downwind and aside, and whether a source there may count."""
    bx, bz = -math.sin(math.radians(direction)), math.cos(math.radians(direction))
    along, aside = dx * bx + dz * bz, dz * bx - dx * bz
    return along, aside, (np.sqrt(dx * dx + dz * dz) <= radius) & (along > NEAREST) & (np.abs(aside) <= CUT * (sy0 + LATERAL[cls] * along))


def _strength(a: np.ndarray, y: np.ndarray, sy0: np.ndarray, hs: np.ndarray, ry: np.ndarray, w: np.ndarray, cls: str, lid: float) -> tuple[np.ndarray, np.ndarray]:
    """Which of those that may count do, and what each of these adds."""
    lateral, (c, d, power) = LATERAL[cls], VERTICAL[cls]
    across, up = lateral * a / np.sqrt(1 + 0.0004 * a), c * a * (1 + d * a) ** power
    sy = np.sqrt(sy0 * sy0 + across * across)
    near = np.abs(y) <= CUT * sy
    y, sy, ry, hs = y[near], sy[near], ry[near], hs[near]
    sz = np.sqrt(START_Z * START_Z + up[near] * up[near])
    vertical = _images(sz, ry, hs, lid, (0,))
    high = sz > lid / 4
    vertical[high] += _images(sz[high], ry[high], hs[high], lid, (i for i in range(-IMAGES, IMAGES + 1) if i))
    return near, w[near] / (2 * math.pi * sy * sz) * np.exp(-y * y / (2 * sy * sy)) * vertical


def _steps(a: np.ndarray, b: np.ndarray) -> tuple[float, np.ndarray, np.ndarray] | None:
    """The step of the lattice that holds all of two arrays, and their places on it, or None; only lattices whose differences are exact."""
    u = np.unique(np.concatenate([a, b]))
    step = float(np.diff(u).min()) if len(u) > 1 else 1.0
    fine = np.array([u[0], u[-1], step]) * 2.0**20
    if not (np.all(np.abs(fine) < 2.0**50) and np.all(fine == np.rint(fine))):
        return None
    p, q = (np.rint((v - u[0]) / step) for v in (a, b))
    if not (np.all(u[0] + p * step == a) and np.all(u[0] + q * step == b)):
        return None
    return step, p.astype(int), q.astype(int)


def _alike(rows: pd.DataFrame, by: list[str]) -> list[np.ndarray]:
    """Places of rows that are alike, group by group in the order of their keys."""
    codes = rows.groupby(by, dropna=False).ngroup().to_numpy()
    order = np.argsort(codes, kind="stable")
    return np.split(order, np.flatnonzero(np.diff(codes[order])) + 1)


def _smooth(n: int) -> int:
    """The next number that has no prime factor above 5, for the transform's sake."""
    while True:
        m = n
        for f in (2, 3, 5):
            while m % f == 0:
                m //= f
        if m == 1:
            return n
        n += 1


def _lattice_sums(receptors: pd.DataFrame, sources: pd.DataFrame, of: np.ndarray, n: int, direction: float, cls: str, lid: float, radius: float) -> tuple[np.ndarray, np.ndarray, np.ndarray] | None:
    """(gamma, age, met) by receptor and group where all places lie on a lattice so dense that sums by convolution cost less than by pairs; else None.

    What a source adds depends on its kind and the way between only, so a kind's sources are one raster, folded with what every way adds.
    """
    if len(receptors) * len(sources) <= PER_CELL * min(len(receptors), len(sources)):
        return None
    kinds, levels = _alike(sources, ["hs", "sy0", "grp"]), _alike(receptors, ["ry"])
    x, z, w, hs, sy0 = (sources[k].to_numpy(dtype=float) for k in ("x", "z", "w", "hs", "sy0"))
    rx, ry, rz = (receptors[k].to_numpy(dtype=float) for k in ("rx", "ry", "rz"))
    if not np.all(np.isfinite(w)) or (on_x := _steps(x, rx)) is None or (on_z := _steps(z, rz)) is None:
        return None
    (step_x, xi, ri), (step_z, zi, rj) = on_x, on_z
    xi, zi, low_x, low_z, ri, rj = xi - xi.min(), zi - zi.min(), ri.min() - xi.max(), rj.min() - zi.max(), ri - ri.min(), rj - rj.min()
    sx, sz, px, pz = int(xi.max()) + 1, int(zi.max()) + 1, int(ri.max()) + 1, int(rj.max()) + 1
    shape = _smooth(sx + px - 1), _smooth(sz + pz - 1)
    if shape[0] * shape[1] > LATTICE or len(receptors) * len(sources) <= PER_CELL * len(kinds) * len(levels) * shape[0] * shape[1]:
        return None
    dx, dz = (low_x + np.arange(sx + px - 1))[:, None] * step_x, (low_z + np.arange(sz + pz - 1)) * step_z
    gamma, age, met = (np.zeros((len(rx), n)) for _ in range(3))
    for rows in levels:
        folded: dict = {}
        for at in kinds:
            k, kind = at[0], (hs[at[0]], sy0[at[0]])
            if kind not in folded:
                along, aside, may = _near(dx, dz, sy0[k], direction, cls, radius)
                r, q = np.nonzero(may)
                a, one = along[r, q], np.ones(len(r))
                near, g = _strength(a, aside[r, q], one * sy0[k], one * hs[k], one * ry[rows[0]], one, cls, lid)
                ways = []
                for v in (g, g * a[near], 1.0):
                    raster = np.zeros(shape)
                    raster[r[near], q[near]] = v
                    ways.append(np.fft.rfft2(raster))
                folded = {kind: ways}  # of the last kind only, so that memory does not grow with their number
            weights, counts = (np.zeros(shape) for _ in range(2))
            np.add.at(weights, (xi[at], zi[at]), w[at])
            np.add.at(counts, (xi[at], zi[at]), 1.0)
            weights, counts = np.fft.rfft2(weights), np.fft.rfft2(counts)
            for total, given, way in zip((gamma, age, met), (weights, weights, counts), folded[kind], strict=True):
                total[rows, of[k]] += np.fft.irfft2(given * way, shape)[ri[rows] + sx - 1, rj[rows] + sz - 1]
    met = np.rint(met)
    return np.where(met > 0, gamma, 0.0), np.where(met > 0, age, 0.0), met


def _plume_sums(receptors: pd.DataFrame, sources: pd.DataFrame, direction: float, cls: str, lid: float, radius: float) -> pd.DataFrame:
    """Partial sums of one cell's sources at the receptors that ask for it: by convolution where that is less work, else a few receptors at a time so that memory does not grow with either."""
    of, names = pd.factorize(sources["grp"], use_na_sentinel=False)
    x, z, w, hs, sy0 = (sources[k].to_numpy(dtype=float) for k in ("x", "z", "w", "hs", "sy0"))
    ids, rx, ry, rz = receptors["a_id"].to_numpy(), *(receptors[k].to_numpy(dtype=float) for k in ("rx", "ry", "rz"))
    n = len(names)
    sums = _lattice_sums(receptors, sources, of, n, direction, cls, lid, radius) if n and len(ids) else None
    gamma, age, met = sums or (np.zeros((len(ids), n)) for _ in range(3))
    for k in range(0, len(ids) if n and not sums else 0, STRIP):
        for m in range(0, len(x), STRIP * 64):
            rows, to = slice(k, k + STRIP), slice(m, m + STRIP * 64)
            dx, dz = rx[rows, None] - x[to], rz[rows, None] - z[to]
            along, aside, may = _near(dx, dz, sy0[to], direction, cls, radius)
            r, q = np.nonzero(may)
            a, y, q = along[r, q], aside[r, q], q + m
            near, g = _strength(a, y, sy0[q], hs[q], ry[r + k], w[q], cls, lid)
            a, r, q = a[near], r[near], q[near]
            at = r * n + of[q]
            for total, v in ((gamma, g), (age, g * a), (met, None)):
                total[rows] += np.bincount(at, v, len(dx) * n).reshape(-1, n)
    at, grp = np.nonzero(met)
    return pd.DataFrame({"receptor": ids[at], "grp": names[grp], "gamma": gamma[at, grp], "age": age[at, grp]})


def plume(sources: DataFrame, receptors: DataFrame, direction: float, cls: str, lid: float, radius: float = 800.0, cell: float = 250.0) -> DataFrame:
    """(receptor, grp, gamma, age): Gaussian sums with images over the sources (id, x, z, w, hs, sy0, grp) upwind of each receptor (id, x, z, y) within ``radius``.

    A receptor asks the cells around it that can hold a source upwind and near enough. Sources of one kind at one place are one source of their
    weights together. Receptors of a cell and sources of another meet in arrays, dealt to PARTS by KINDS groups; sums leave the groups, no pair
    does. Where places lie on a lattice, work grows with its cells and not with pairs; elsewhere every pair is worked out, in bounded memory.
    x is the way downwind, age weighs it. Sources without a weight take no part.
    """
    bx, bz = -math.sin(math.radians(direction)), math.cos(math.radians(direction))
    reach = range(-math.ceil(radius / cell) - 1, math.ceil(radius / cell) + 2)
    farthest = lambda p, q: max((-p + e) * cell * bx + (-q + f) * cell * bz for e in (-1, 1) for f in (-1, 1))
    nearest = lambda p, q: math.hypot(max(0, abs(p) - 1) * cell, max(0, abs(q) - 1) * cell)
    asked = [(p, q) for p in reach for q in reach if farthest(p, q) > NEAREST and nearest(p, q) <= radius]
    i, j = cells(F.col("x"), F.col("z"), cell)
    around = F.expr("array(" + ", ".join(f"struct({p}L AS p, {q}L AS q)" for p, q in asked) + ")")
    back = F.expr("array(" + ", ".join(f"struct({-p}L AS p, {-q}L AS q)" for p, q in asked) + ")")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    tiles = [i.alias("k"), j.alias("l")]
    wanted = receptors.dropna(subset=["x", "z"]).select(F.col("id").alias("a_id"), F.col("x").alias("rx"), F.col("y").alias("ry"), F.col("z").alias("rz"), *tiles, F.pmod(F.xxhash64("id"), F.lit(PARTS)).cast("int").alias("a"), F.inline(around))
    asking = receptors.dropna(subset=["x", "z"]).select(*tiles).distinct()
    wanted = wanted.select("a_id", "rx", "ry", "rz", (F.col("k") + F.col("p")).alias("i"), (F.col("l") + F.col("q")).alias("j"), "k", "l", "a", every(KINDS).alias("b"))
    alike = ["x", "z", "hs", "sy0", "grp"]
    given = sources.dropna(subset=["x", "z", "w", "sy0"]).groupBy(*alike).agg(F.sum(F.col("w").cast("double")).alias("w"))
    given = given.select("w", *alike, i.alias("i"), j.alias("j"), F.pmod(F.xxhash64("hs", "sy0", "grp"), F.lit(KINDS)).cast("int").alias("b"))
    wanted = wanted.join(given.select("i", "j", "b").distinct(), ["i", "j", "b"], "left_semi")  # cells without sources make no group
    given = given.select("*", F.inline(back)).select("w", *alike, "i", "j", "b", (F.col("i") + F.col("p")).alias("k"), (F.col("j") + F.col("q")).alias("l")).join(asking, ["k", "l"], "left_semi")
    given = given.select("*", every(PARTS).alias("a"))
    keys = ["i", "j", "k", "l", "a", "b"]
    kind = receptors.schema["id"].dataType.simpleString()
    # Few bytes are much work here, so the groups are dealt to a given number of tasks, which adaptive execution does not merge.
    tasks = int(receptors.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    wanted, given = wanted.repartition(tasks, *keys), given.repartition(tasks, *keys)
    sums = wanted.groupBy(*keys).cogroup(given.groupBy(*keys)).applyInPandas(lambda r, s: _plume_sums(r, s, direction, cls, lid, radius), f"receptor {kind}, grp string, gamma double, age double")
    return sums.groupBy("receptor", "grp").agg(F.sum("gamma").alias("gamma"), F.sum("age").alias("age"))
