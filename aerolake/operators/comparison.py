"""Measured against modelled: bias ratios of a forecast model, hindcast, forecast and sector means over an archive."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from aerolake.functions import weather
from aerolake.operators import receptor

# Pairs that a ratio needs; ratios where there are fewer, and NOx against NO2 then; hours of a hindcast or forecast; days of the ratios.
LEAST_PAIRS = 48
RATIOS = {"no2": 1.77, "o3": 0.86, "pm10": 1.20, "pm25": 0.85}
NOX_PER_NO2 = 23.96 / 16.32
HOURS, RATIO_DAYS = 72, 14


def bias_ratios(observed: DataFrame, model: DataFrame, until: Column, days: int = RATIO_DAYS, least: int = LEAST_PAIRS, usual: dict[str, float] | None = None, usual_nox: float = NOX_PER_NO2) -> DataFrame:
    """(pollutant, ratio, n, source) over the ``days`` up to ``until``: sum of the observed over sum of the model in hours with both, where the model is
    positive; and ``nox_no2``, observed NOx against NO2. With fewer than ``least`` pairs the usual ratio, source ``default``.

    observed: (t, no2, nox, o3, pm10, pm25); model: (t, no2, o3, pm10, pm25). One pass, a row a task is shuffled.
    """
    usual = usual or RATIOS
    recent = lambda df: df.filter((F.col("t") > until - F.expr(f"INTERVAL {days} DAYS")) & (F.col("t") <= until))
    named = recent(model).select("t", *(F.col(p).alias(f"_m_{p}") for p in usual))
    rows = recent(observed).join(named, "t", "left")
    known = lambda c: F.col(c).isNotNull() & ~F.isnan(c)
    pairs = [(p, F.col(p), F.col(f"_m_{p}"), known(p) & known(f"_m_{p}") & (F.col(f"_m_{p}") > 0), usual[p]) for p in usual]
    pairs.append(("nox_no2", F.col("nox"), F.col("no2"), known("nox") & known("no2"), usual_nox))
    sums = rows.agg(*(f.alias(f"{k}_{p}") for p, o, m, ok, _ in pairs for k, f in (("o", F.sum(F.when(ok, o))), ("m", F.sum(F.when(ok, m))), ("n", F.count_if(ok)))))
    live = lambda p: (F.col(f"n_{p}") >= least) & (F.col(f"m_{p}") > 0)
    each = F.array(*(F.struct(F.lit(p).alias("pollutant"), F.when(live(p), F.col(f"o_{p}") / F.nullif(F.col(f"m_{p}"), F.lit(0.0))).otherwise(u).alias("ratio"), F.col(f"n_{p}").alias("n"), F.when(live(p), "live").otherwise("default").alias("source")) for p, _, _, _, u in pairs))
    return sums.select(F.inline(each))


def corrected(model: DataFrame, ratios: DataFrame) -> DataFrame:
    """(t, bg_no2, bg_nox, bg_o3, bg_pm10, bg_pm25): the model's background by its ratios; NOx from NO2."""
    of = ratios.groupBy().pivot("pollutant", [*RATIOS, "nox_no2"]).agg(F.first("ratio"))
    rows = model.join(F.broadcast(of.withColumnsRenamed({p: f"_r_{p}" for p in (*RATIOS, "nox_no2")})), F.lit(True))  # one row
    out = {f"bg_{p}": F.col(p) * F.col(f"_r_{p}") for p in RATIOS}
    return rows.select("t", *(c.alias(n) for n, c in out.items()), (out["bg_no2"] * F.col("_r_nox_no2")).alias("bg_nox"))


def hindcast(measured: DataFrame, modelled: DataFrame, end: Column, hours: int = HOURS) -> DataFrame:
    """(t, raw, validated, model, background, low, high) for each of the ``hours`` up to ``end``: measured values by kind, the model with a factor of two about it.

    measured: (t, v, validated); modelled: (t, total, background). Hours without any of them have NULLs.
    """
    spark = measured.sparkSession
    grid = spark.range(1).select(F.explode(F.sequence(end - F.expr(f"INTERVAL {hours - 1} HOURS"), end, F.expr("INTERVAL 1 HOUR"))).alias("t"))
    first = end - F.expr(f"INTERVAL {hours - 1} HOURS")
    inside = lambda df: df.filter(F.col("t").between(first, end))
    kind = lambda k: F.max(F.when(F.col("validated") == k, F.col("v")))
    seen = inside(measured).groupBy("t").agg(kind(0).alias("raw"), kind(1).alias("validated"))
    rows = grid.join(seen, "t", "left").join(inside(modelled).select("t", F.col("total").alias("model"), "background"), "t", "left")
    return rows.select("t", "raw", "validated", "model", "background", (F.col("model") / 2).alias("low"), (F.col("model") * 2).alias("high"))


def forecast(hours: DataFrame, background: DataFrame, now: Column, pollutant: str, beta: float | Column, u0: float | Column, measures: dict[str, Column], ahead: int = HOURS, site: tuple[float, float] | None = None) -> DataFrame:
    """(t, background, today, scenario) of one pollutant for the ``ahead`` hours after ``now``: both by the same weather and the same background.

    hours: weather rows with responses, as ``receptor.concentrations`` needs them; hours beyond the background's reach have its defaults.
    """
    some = hours.filter((F.col("t") > now) & (F.col("t") <= now + F.expr(f"INTERVAL {ahead} HOURS")))
    given = [c for c in background.columns if c != "t"]
    ready = some.drop(*given).join(background, "t", "left")
    kept = ready.columns
    today = receptor.concentrations(ready, beta, u0, site=site).select(*kept, F.col(pollutant).alias("today"), (F.col(pollutant) - F.col(f"inc_{pollutant}")).alias("background"))
    return receptor.concentrations(today, beta, u0, measures, site=site).select("t", "background", "today", F.col(pollutant).alias("scenario"))


def rose_comparison(hours: DataFrame, modelled: Column, measured: Column) -> DataFrame:
    """(sector, n, model, measured): means by the sector of ``direction`` over hours that have both and the wind; calms count by their bearing."""
    rows = hours.select(weather.sector(F.col("direction")).alias("sector"), "u", "direction", modelled.alias("m"), measured.alias("o")).dropna(subset=["u", "direction", "m", "o"])
    return rows.groupBy("sector").agg(F.count("*").alias("n"), F.avg("m").alias("model"), F.avg("o").alias("measured"))
