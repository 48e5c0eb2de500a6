"""Calibration of modelled increments against measured ones: paired hours, grid fit, baseline, held-out scores, diagnostics.

The model of an hour is 1e6 * beta * s / sqrt(u^2 + u0^2), s being the strength that sources send and u the wind.
"""

from __future__ import annotations

import math
from collections.abc import Iterable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from aerolake.functions import chemistry, emissions, weather
from aerolake.functions.calendar import utc_month
from aerolake.operators.series import chang_hanna, local_columns
from aerolake.sources.intermediate import materialise

# Offset in the logarithms, ug/m3; grids of u0 (m/s) and ln(beta); the baseline's u0; capture; least hours of a ratio; speed bins.
OFFSET = 10.0
U0_GRID = tuple(round(0.5 + 0.05 * i, 2) for i in range(51))
LN_BETA, STEPS = (math.log(0.05), math.log(50.0)), 40
BASELINE_U0 = 1.2
#: Finer grids of the half-years' fits: steps in ln(beta) under 1e-6.
ZOOMS = 7
CAPTURE = 0.75
LEAST_HOURS, SECTOR_WIND = 30, 1.5
SPEED_BINS = ((0.0, 0.5), (0.5, 1.0), (1.0, 2.0), (2.0, 3.0), (3.0, 5.0), (5.0, 99.0))
# Limits of Hanna and Chang's urban criteria.
CRITERIA = {"fb": 0.67, "nmse": 6.0, "fac2": 0.30, "nad": 0.50}


def wide(series: DataFrame, keys: Iterable[str]) -> DataFrame:
    """A row an hour with a column a key (dots as underscores)."""
    rows = series.filter(F.col("key").isin(*keys)).groupBy("t")
    return rows.agg(*(F.max(F.when(F.col("key") == k, F.col("v"))).alias(k.replace(".", "_")) for k in keys))


def paired_hours(series: DataFrame, met: DataFrame, first: str, second: str, others: Iterable[str] = (), capture: float = CAPTURE, years: tuple[int, int] | None = None) -> DataFrame:
    """Hours in which both series and the wind (met: t, u, direction, ...) are known, in months of ``years`` that have ``capture`` of their hours.

    Adds ``obs``, the difference, the UTC month of the hour's start and the local hour and day type (holidays as sundays).
    """
    a, b = (F.col(k.replace(".", "_")) for k in (first, second))
    both = wide(series, [first, second, *others]).join(met, "t").filter(a.isNotNull() & b.isNotNull() & F.col("u").isNotNull() & F.col("direction").isNotNull())
    hours = local_columns(both, holidays=True).drop("year", "day").withColumn("month", utc_month(F.col("t"))).withColumn("obs", a - b)
    days = F.dayofmonth(F.last_day(F.make_date(F.floor(F.col("month") / 100).cast("int"), F.col("month") % 100, F.lit(1))))
    kept = hours.groupBy("month").agg(F.count("*").alias("n")).filter(F.col("n") / (24 * days) >= capture)
    if years:
        kept = kept.filter(F.floor(F.col("month") / 100).between(*years))
    return hours.join(F.broadcast(kept.select("month")), "month", "left_semi")  # a row a month


def _u_eff(u0: Column | float) -> Column:
    u0 = u0 if isinstance(u0, Column) else F.lit(u0)
    return F.sqrt(F.col("u") * F.col("u") + u0 * u0)


def modelled(beta: Column | float, u0: Column | float) -> Column:
    return 1e6 * (beta if isinstance(beta, Column) else F.lit(beta)) * F.col("s") / _u_eff(u0)


def _losses(logs: DataFrame, betas: np.ndarray) -> pd.DataFrame:
    """(part, iu, ib, j): sums over each part's hours of the squared gap at every u0 and every beta; betas: a row for each u0.

    A row an hour and pair leaves the scan and is summed at once where it is; a row a part, u0 and beta reaches the driver.
    """
    n = betas.shape[1]
    u0 = (F.col("iu") * 5 + 50) / F.lit(100.0)
    rows = logs.withColumn("iu", F.explode(F.sequence(F.lit(0), F.lit(len(U0_GRID) - 1)))).select("part", "iu", "l", (1e6 * F.col("s") / _u_eff(u0)).alias("m"))
    table = F.expr(f"array({', '.join(f'{x!r}D' for x in betas.ravel().tolist())})")
    gap = F.col("l") - F.ln(F.get(table, F.col("iu") * n + F.col("ib")) * F.col("m") + OFFSET)
    pairs = rows.withColumn("ib", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    return pairs.groupBy("part", "iu", "ib").agg(F.sum(gap * gap).alias("j")).toPandas()


def _array(sums: pd.DataFrame, parts: list, n: int) -> np.ndarray:
    out = np.zeros((len(parts), len(U0_GRID), n))
    out[sums["part"].map({p: i for i, p in enumerate(parts)}).to_numpy(), sums["iu"].to_numpy(), sums["ib"].to_numpy()] = sums["j"].to_numpy()
    return out


def _lowest(series: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where Chebyshev series (coefficients last) are lowest in [low, high] of [-1, 1], by golden sections, and how low."""
    value = lambda x: np.polynomial.chebyshev.chebval(x, np.moveaxis(series, -1, 0), tensor=False)
    g = (math.sqrt(5) - 1) / 2
    a, b = low.copy(), high.copy()
    for _ in range(60):
        c, d = b - g * (b - a), a + g * (b - a)
        left = value(c) < value(d)
        a, b = np.where(left, a, c), np.where(left, d, b)
    x = (a + b) / 2
    return x, value(x)


def _zoomed(series: np.ndarray, low: np.ndarray, high: np.ndarray, zooms: int) -> tuple[np.ndarray, np.ndarray]:
    """The lowest of twelve steps in [low, high], then in the two steps around it, and so on."""
    steps = np.arange(13)
    for _ in range(zooms):
        x = low[..., None] + (high - low)[..., None] * steps / 12
        j = np.polynomial.chebyshev.chebval(x, np.moveaxis(series, -1, 0)[..., None], tensor=False)
        i = j.argmin(axis=-1)
        at, loss = (np.take_along_axis(v, i[..., None], -1)[..., 0] for v in (x, j))
        low, high = low + (high - low) * np.maximum(i - 1, 0) / 12, low + (high - low) * np.minimum(i + 1, 12) / 12
    return at, loss


def fit_parts(hours: DataFrame, part: Column, leave_out: bool, zooms: int = 0) -> DataFrame:
    """(part, u0, beta, loss, n, n_dropped, at_bound): beta and u0 that minimise the sum of (ln(obs + c) - ln(model + c))^2 over each part
    of the hours, or over all parts but that one.

    The loss of a sum of parts is the sum of their losses, so every hour is read twice whatever the number of fits: once for the losses of
    each part on the whole grid, which place each fit's best beta between two neighbours for every u0, and once at Chebyshev nodes of
    the interval that holds these places. Between its nodes a loss is its Chebyshev series to 1e-12 (it is analytic up to pi from the
    real line in ln beta), so each fit's own minimum is found exactly, with no hour read again. ``zooms``: instead the best of that many ever finer
    grids of twelve steps, as a search without the series finds it. Hours with obs <= -c have no logarithm
    and are counted; a part without training hours has no row.
    """
    spark = hours.sparkSession
    kind = hours.select(part.alias("part")).schema["part"].dataType.simpleString()
    schema = f"part {kind}, u0 double, beta double, loss double, n long, n_dropped long, at_bound boolean"
    rows = hours.select(part.alias("part"), "s", "u", F.when(F.col("obs") > -OFFSET, F.ln(F.col("obs") + OFFSET)).alias("l")).filter("part IS NOT NULL")
    counts = rows.groupBy("part").agg(F.count("*").alias("n"), F.count_if(F.col("l").isNull()).alias("dropped")).orderBy("part").toPandas()
    parts = counts["part"].tolist()
    logs = rows.dropna(subset=["l"])
    grid = np.linspace(*LN_BETA, STEPS + 1)
    over = lambda x: x.sum(axis=0, keepdims=True) - x if leave_out else x
    n, dropped = over(counts[["n", "dropped"]].to_numpy()).T if parts else (np.zeros(0), np.zeros(0))
    live = np.flatnonzero(n - dropped > 0)
    if not len(live):
        return spark.createDataFrame([], schema)
    coarse = over(_array(_losses(logs, np.tile(np.exp(grid), (len(U0_GRID), 1))), parts, STEPS + 1))[live]
    best = coarse.argmin(axis=2)
    first, last = np.maximum(best - 1, 0), np.minimum(best + 1, STEPS)
    low, high = grid[first.min(axis=0)], grid[last.max(axis=0)]
    middle, half = (low + high) / 2, (high - low) / 2
    reach = math.pi / half.max()
    nodes = math.ceil(27.7 / math.log(reach + math.hypot(reach, 1))) + 2  # 27.7: twelve digits
    x = np.cos(math.pi * (np.arange(nodes) + 0.5) / nodes)
    fine = over(_array(_losses(logs, np.exp(middle[:, None] + half[:, None] * x[None, :])), parts, nodes))[live]
    weight = np.cos(math.pi * np.arange(nodes)[:, None] * (np.arange(nodes) + 0.5)[None, :] / nodes) * (2 / nodes)
    weight[0] /= 2
    search = (lambda *a: _zoomed(*a, zooms)) if zooms else _lowest
    at, loss = search(fine @ weight.T, (grid[first] - middle) / half, (grid[last] - middle) / half)
    u = (np.round(loss, 9) if zooms else loss).argmin(axis=1)
    k = np.arange(len(live))
    beta = np.exp(middle[u] + half[u] * at[k, u])
    found = [(parts[p], U0_GRID[u[i]], float(beta[i]), float(loss[i, u[i]]), int(n[p]), int(dropped[p]), bool(u[i] in (0, len(U0_GRID) - 1))) for i, p in enumerate(live)]
    return spark.createDataFrame(found, schema)


def fit(hours: DataFrame) -> DataFrame:
    """(u0, beta, loss, n, n_dropped, at_bound) over all hours; without hours there is no row."""
    return fit_parts(hours, F.lit(0), leave_out=False).drop("part")


def baseline(hours: DataFrame, *by: str) -> tuple[DataFrame, DataFrame]:
    """Median of obs * u_eff by day type and hour (p), and, where that is positive, of its ratio to p by sector (q, n). Groups are bounded by the calendar."""
    lifted = hours.withColumn("_x", F.col("obs") * _u_eff(BASELINE_U0))
    p = lifted.groupBy(*by, "daytype", "hour").agg(F.median("_x").alias("p"))
    ratio = lifted.join(p, [*by, "daytype", "hour"]).filter("p > 0").select(*by, weather.sector(F.col("direction")).alias("sector"), (F.col("_x") / F.col("p")).alias("_r"))
    return p, ratio.groupBy(*by, "sector").agg(F.median("_r").alias("q"), F.count("_r").alias("n"))


def baseline_prediction(hours: DataFrame, p: DataFrame, q: DataFrame, *by: str) -> DataFrame:
    """hours with ``base``, p * q / u_eff; NULL where the training hours had none of the kind."""
    out = hours.withColumn("sector", weather.sector(F.col("direction"))).join(p, [*by, "daytype", "hour"], "left").join(q.drop("n"), [*by, "sector"], "left")
    return out.withColumn("base", F.col("p") * F.col("q") / _u_eff(BASELINE_U0)).drop("p", "q", "sector")


def held_out(hours: DataFrame, part: Column, zooms: int = 0) -> DataFrame:
    """hours with ``part``, ``u0``, ``mod`` and ``base``: each part predicted by parameters and medians of all the others.

    Fits come from losses by subtraction. Medians do not subtract, so they read an hour once for each other part, as six narrow columns.
    """
    split = hours.withColumn("part", part)
    params = fit_parts(split, F.col("part"), leave_out=True, zooms=zooms)
    every = [r.part for r in params.select("part").collect()]  # a row a part
    others = F.array_remove(F.array(*map(F.lit, every)), F.col("part")) if every else F.array().cast("array<string>")
    training = split.select(F.explode(others).alias("part"), "obs", "u", "direction", "daytype", "hour")
    p, q = baseline(training, "part")
    p, q = materialise(p, "medians"), materialise(q, "medians")
    out = split.join(params.select("part", "beta", "u0"), "part")
    return baseline_prediction(out.withColumn("mod", modelled(F.col("beta"), F.col("u0"))), p, q, "part").drop("beta")


def half_years(hours: DataFrame) -> DataFrame:
    """Held out by half-years: what January to June say about July to December, and the other way round."""
    return held_out(hours, F.when(F.col("month") % 100 <= 6, "first").otherwise("second"), ZOOMS)


def months_left_out(hours: DataFrame) -> DataFrame:
    """Held out month by month."""
    return held_out(hours, F.col("month"))


def totals(predicted: DataFrame, way: Column, share: Column, keys: dict[str, str]) -> DataFrame:
    """(pollutant, n, fb, ..., mqi): NO2 and NOx in full, from each hour's predicted increment and its background, against what was measured.

    The plume's age is way / (u_eff * share), with the u0 of the fit that predicted the hour; 60 s where share is not positive. keys: columns
    of the measured ``no2`` and ``nox`` and of the background ``bg_no2``, ``bg_nox``, ``bg_o3``; hours that lack any of them but measured NOx take no part.
    """
    needed = [keys[k] for k in ("no2", "bg_no2", "bg_nox", "bg_o3")]
    rows = predicted.dropna(subset=["mod", *needed])
    tau = F.when(share > 0, way / (_u_eff(F.col("u0")) * share)).otherwise(60.0)
    of = {k: F.col(v) for k, v in keys.items()}
    rows = chemistry.with_no2(rows, "_made", F.col("mod"), of["bg_no2"], of["bg_nox"], of["bg_o3"], tau, chemistry.photolysis(F.col("sw")), chemistry.titration(F.col("t2")))
    pairs = F.array(*(F.struct(F.lit(k).alias("pollutant"), of[k].alias("o"), F.col(f"_made.{k}").alias("p")) for k in ("no2", "nox")))
    rows = rows.select(F.inline(pairs)).dropna(subset=["o", "p"])
    quality = rows.filter("pollutant = 'no2'").groupBy("pollutant").agg(chemistry.quality_indicator(F.col("o"), F.col("p"), "no2").alias("mqi"))
    return chang_hanna(rows, 1.0, "pollutant").join(quality, "pollutant", "left")


def congestion_share(hours: DataFrame) -> DataFrame:
    """(grp, share): queueing share of the response to group A and B over weekday rush hours (columns queue_A, gamma_A, ...); the usual share where there is no response."""
    rush = hours.filter((F.col("daytype") == "weekday") & F.col("hour").isin(*emissions.QUEUE_HOURS))
    each = F.array(*(F.struct(F.lit(g).alias("grp"), F.lit(usual).alias("usual"), F.col(f"queue_{g}").alias("q"), F.col(f"gamma_{g}").alias("a")) for g, usual in emissions.QUEUE_SHARE.items()))
    sums = rush.select(F.inline(each)).groupBy("grp", "usual").agg(F.sum("q").alias("q"), F.sum("a").alias("a"))
    both = hours.sparkSession.createDataFrame(list(emissions.QUEUE_SHARE.items()), "grp string, usual double")
    out = both.join(sums.drop("usual"), "grp", "left")
    return out.select("grp", F.when(F.col("a") > 0, F.col("q") / F.col("a")).otherwise(F.col("usual")).alias("share"))


def verdict(scored: DataFrame, *by: str) -> DataFrame:
    """(kind, score, value, limit, accepted) of the urban criteria, and for the model whether each of r, nmse and vg is ``better`` than the baseline's.

    scored: rows of kind ``model`` and ``baseline`` as ``scores`` gives them. Scores without a criterion have NULL for ``accepted``.
    """
    names = ("fb", "nmse", "fac2", "nad", "r", "mg", "vg")
    each = F.array(*(F.struct(F.lit(k).alias("score"), F.col(k).alias("value")) for k in names))
    rows = scored.select(*by, "kind", F.inline(each))
    v, score = F.col("value"), F.col("score")
    accepted = F.when(score == "fb", F.abs(v) < CRITERIA["fb"]).when(score == "nmse", v < CRITERIA["nmse"]).when(score == "fac2", v > CRITERIA["fac2"]).when(score == "nad", v < CRITERIA["nad"])
    other = rows.filter("kind = 'baseline'").select(*by, "score", F.col("value").alias("base"))
    compared = rows.join(other, [*by, "score"], "left")
    better = F.when(score == "r", v > F.col("base")).when(score.isin("nmse", "vg"), v < F.col("base"))
    return compared.select(*by, "kind", "score", "value", accepted.alias("accepted"), F.when(F.col("kind") == "model", better).alias("better"))


def calibrate(hours: DataFrame) -> dict[str, DataFrame]:
    """The calibration in one call, over paired hours that are materialised once: the fit, held-out predictions by half-years and by months, their
    scores with those of the baseline, the fits of the months, diagnostics, and the verdict on the half-years."""
    hours = materialise(hours, "paired-hours")
    halves = materialise(half_years(hours), "half-years")
    months = materialise(months_left_out(hours), "months")
    scored = scores(halves)
    return {"fit": fit(hours), "half_years": halves, "months": months, "test": scored, "lomo": scores(months), "lomo_params": fit_parts(hours, F.col("month"), leave_out=True), "diagnostics": diagnostics(halves), "verdict": verdict(scored)}


def scores(predicted: DataFrame, *by: str) -> DataFrame:
    """Scores of model and baseline: ``chang_hanna`` with a column ``kind``; values under 1 count as 1 in ratios."""
    kinds = F.array(F.struct(F.lit("model").alias("kind"), F.col("mod").alias("p")), F.struct(F.lit("baseline").alias("kind"), F.col("base").alias("p")))
    rows = predicted.select(*by, F.col("obs").alias("o"), F.explode(kinds).alias("k")).select(*by, "o", "k.kind", "k.p")
    return chang_hanna(rows, 1.0, "kind", *by)


def diagnostics(predicted: DataFrame) -> DataFrame:
    """(kind, key, n, ratio): sum of obs over sum of mod by sector (in wind), hour, class, speed, month and day type; NULL from too few hours."""
    speed = None
    for low, high in SPEED_BINS:
        name, inside = F.lit(f"{low:g}-{high:g}"), (F.col("u") >= low) & (F.col("u") < high)
        speed = F.when(inside, name) if speed is None else speed.when(inside, name)
    kinds = {"sector": F.when(F.col("u") > SECTOR_WIND, weather.sector(F.col("direction"))), "hour": F.col("hour"), "class": F.col("cls"), "speed": speed, "month": F.col("month"), "daytype": F.col("daytype")}
    each = F.array(*(F.struct(F.lit(k).alias("kind"), c.cast("string").alias("key")) for k, c in kinds.items()))
    rows = predicted.filter(F.col("obs").isNotNull() & F.col("mod").isNotNull()).select("obs", "mod", F.explode(each).alias("k")).filter("k.key is not null")
    ratio = F.when((F.count("*") >= LEAST_HOURS) & (F.sum("mod") > 0), F.sum("obs") / F.nullif(F.sum("mod"), F.lit(0.0)))
    return rows.groupBy("k.kind", "k.key").agg(F.count("*").alias("n"), ratio.alias("ratio"))


def smoothed(hours: DataFrame, table: DataFrame) -> DataFrame:
    """hours with ``gamma``: the table's rows (grp, direction, g array by source group) of the hour's stability group, weighted over the sectors by the wind."""
    rows = table.groupBy("grp").agg(F.array_sort(F.collect_list(F.struct("direction", "g"))).alias("_rows"))  # sixteen a stability group
    weights = weather.direction_weights(F.col("direction"), F.col("u"))
    with_rows = hours.withColumn("grp", weather.stability_group(F.col("cls"))).join(F.broadcast(rows), "grp", "left")
    pairs = F.zip_with(weights, F.col("_rows"), lambda w, r: F.transform(r["g"], lambda x: w * x))
    total = F.aggregate(F.slice(pairs, 2, 16), F.get(pairs, F.lit(0)), lambda a, x: F.zip_with(a, x, lambda y, z: y + z))
    return with_rows.withColumn("gamma", total).drop("_rows")
