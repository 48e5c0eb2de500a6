"""Queries of concentrations at receptors, with SQL."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from aerolake.functions import emissions
from aerolake.functions.calendar import rounded
from aerolake.operators import calibration, receptor
from aerolake.plans import calibration_queries as cq
from aerolake.plans.emission_queries import strength_parts
from aerolake.plans.queries import scheme_sql
from aerolake.sources.tables import table

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str):
    def register(f):
        QUERIES[f.__name__] = f
        ORACLES[f.__name__] = sql
        return f

    return register


BETA, U0 = 1.3, 1.4
#: Response and age of the table, by rule.
SCALE, AGE = 1e-4, 120.0
NONE = "false AS zone, 0.0::DOUBLE AS electric, false AS buses, false AS free_b, 100.0::DOUBLE AS traffic, false AS queues, false AS dust"
SOME = "true AS zone, 20.0::DOUBLE AS electric, true AS buses, true AS free_b, 90.0::DOUBLE AS traffic, false AS queues, true AS dust"


def _concentration_sql(measures: str, name: str) -> str:
    """CTEs ending in ``name`` (t, nox, no2, no, o3, pm10, pm25, co, c6h6, inc_nox, tau)."""
    n = name
    parts = {p: strength_parts(p) for p in emissions.POLLUTANTS}
    qs = ", ".join(f"{x} AS q_{p}_{g}" for p in emissions.POLLUTANTS for g, x in parts[p].items())
    dot = lambda p, c: "(" + " + ".join(f"q_{p}_{g} * {c}{k}" for k, g in enumerate("abcd")) + ")"
    incs = ", ".join(f"{1e3 if p == 'co' else 1e6}::DOUBLE * {BETA}::DOUBLE * {dot(p, 'g')} / ue AS inc_{p}" for p in emissions.POLLUTANTS)
    sch = scheme_sql(f"{n}b", "t", "inc_nox", "bg_no2", "bg_nox", "bg_o3", "tau", cq.JK, cq.KK)
    for c in ("sa", "sb", "sc", "sd", "se", "sf", "sg", "sch"):
        sch = sch.replace(f"{c} AS (", f"{n}{c} AS (").replace(f"FROM {c})", f"FROM {n}{c})")
    return f"""{n}m AS (SELECT hr.*, {', '.join(f'g{k} * {SCALE}::DOUBLE AS g{k}, g{k} * {SCALE}::DOUBLE * {AGE}::DOUBLE AS a{k}' for k in range(4))}, {cq.TRAFFIC.format(l='l')} AS f, sqrt(u * u + {U0 * U0!r}::DOUBLE) AS ue, {measures},
coalesce(park_no2, 16.3::DOUBLE) AS bg_no2, coalesce(park_nox, park_no2 * {24.0 / 16.3!r}::DOUBLE, 24) AS bg_nox, coalesce(park_o3, 54) AS bg_o3 FROM hr JOIN tb USING (t)),
{n}q AS (SELECT *, {qs} FROM {n}m), {n}b AS (SELECT *, {incs}, CASE WHEN {dot('nox', 'g')} > 0 THEN {dot('nox', 'a')} / (ue * {dot('nox', 'g')}) ELSE 60 END AS tau FROM {n}q), {sch},
{n} AS (SELECT b.t, s.nox, s.no2, s.no, s.o3, 25.6::DOUBLE + inc_pm10 AS pm10, 15.7::DOUBLE + inc_pm25 AS pm25, 0.19::DOUBLE + inc_co AS co, 0.35::DOUBLE + inc_c6h6 AS c6h6, inc_nox, tau FROM {n}b b JOIN {n}sch s USING (t))"""


TB = f"tb AS (SELECT t, {', '.join(f'sum(w * g[{k + 1}]) / sum(w) AS g{k}' for k in range(4))} FROM lk GROUP BY 1)"
LK = f"""lk AS (SELECT h.t, d.g, CASE WHEN h.u < 0.5 THEN 1 ELSE exp(-power({cq.APART}, 2) / (2 * power(least(60, 22.5 * greatest(1, 2 / greatest(h.u, 1e-9))), 2))) END AS w
FROM hr h JOIN lu d ON d.grp = CASE WHEN cls IN ('A', 'B', 'C') THEN 'AC' WHEN cls IN ('E', 'F') THEN 'EF' ELSE 'D' END)"""
POLLUTANTS = ("nox", "no2", "no", "o3", "pm10", "pm25", "co", "c6h6", "inc_nox", "tau")
ROUNDED = ", ".join(f"round({p} + 1e-9, 5) AS {p}" for p in POLLUTANTS)


def _ready(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.createDataFrame(cq.TABLE, "grp string, direction double, g array<double>")
    hours = calibration.smoothed(cq._hours(spark, sf_dir), rows)
    gamma = F.transform("gamma", lambda g: g * SCALE)
    return hours.withColumns({"gamma": gamma, "age": F.transform("gamma", lambda g: g * SCALE * AGE), "bg_no2": F.col("park_no2"), "bg_nox": F.col("park_nox"), "bg_o3": F.col("park_o3")})


def measures() -> dict[str, Column]:
    """What SOME says, as columns."""
    return {"zone": F.lit(True), "electric": F.lit(20.0), "electric_buses": F.lit(True), "car_free_b": F.lit(True), "traffic": F.lit(90.0), "dust": F.lit(True)}


@query(f"WITH {cq.HOURS}, {cq.TABLE_SQL}, {LK}, {TB}, {_concentration_sql(NONE, 'cc')} SELECT t, {ROUNDED} FROM cc")
def receptor_concentrations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pollutants at the receptor, hour by hour."""
    out = receptor.concentrations(_ready(spark, sf_dir), BETA, U0)
    return out.select("t", *(rounded(F.col(p), 5).alias(p) for p in POLLUTANTS))


@query(f"""WITH {cq.HOURS}, {cq.TABLE_SQL}, {LK}, {TB}, {_concentration_sql(NONE, 'cc')}, {_concentration_sql(SOME, 'ss')}
SELECT daytype, count(*) AS n, {', '.join(f'round(avg(cc.{p}) + 1e-9, 5) AS {p}_today, round(avg(ss.{p}) + 1e-9, 5) AS {p}_scenario, round(100 * (avg(ss.{p}) - avg(cc.{p})) / avg(cc.{p}) + 1e-9, 4) AS {p}_percent' for p in ('nox', 'no2', 'pm10', 'co'))}
FROM cc JOIN ss USING (t) JOIN hr USING (t) GROUP BY 1""")
def scenario_comparison(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Today against measures, means by day type."""
    ready = _ready(spark, sf_dir)
    some = ("nox", "no2", "pm10", "co")
    kept = ready.columns
    now = receptor.concentrations(ready, BETA, U0).select(*kept, *(F.col(p).alias(f"{p}_a") for p in some))
    both = receptor.concentrations(now, BETA, U0, measures()).withColumnsRenamed({p: f"{p}_b" for p in some}).groupBy("daytype")
    out = []
    for p in some:
        a, b = F.avg(f"{p}_a"), F.avg(f"{p}_b")
        out += [rounded(a, 5).alias(f"{p}_today"), rounded(b, 5).alias(f"{p}_scenario"), rounded(100 * (b - a) / a, 4).alias(f"{p}_percent")]
    return both.agg(F.count("*").alias("n"), *out)


DIRECTION, LID = 230.0, 100.0
BX, BZ = -math.sin(math.radians(DIRECTION)), math.cos(math.radians(DIRECTION))
PLUME = f"""so AS (SELECT p_partkey AS id, ((p_partkey * 37) % 1000)::DOUBLE AS x, ((p_partkey * 91) % 997)::DOUBLE AS z, 1 + (p_partkey % 5)::DOUBLE AS w, CASE WHEN p_partkey % 4 = 3 THEN 8.0::DOUBLE ELSE 0.5::DOUBLE END AS hs, 1 + (p_partkey % 3)::DOUBLE AS sy0, ['A', 'B', 'C', 'D'][p_partkey % 4 + 1] AS grp FROM part),
re AS (SELECT s_suppkey AS id, ((s_suppkey * 53) % 1000)::DOUBLE AS rx, 3.0::DOUBLE AS ry, ((s_suppkey * 29) % 997)::DOUBLE AS rz FROM supplier),
pa AS (SELECT re.id AS receptor, grp, w, hs, ry, sy0, (rx - x) * ({BX!r}::DOUBLE) + (rz - z) * ({BZ!r}::DOUBLE) AS a, -(rx - x) * ({BZ!r}::DOUBLE) + (rz - z) * ({BX!r}::DOUBLE) AS c FROM so JOIN re ON sqrt((rx - x) * (rx - x) + (rz - z) * (rz - z)) <= 800),
pb AS (SELECT *, sqrt(sy0 * sy0 + power(0.16::DOUBLE * a / sqrt(1 + 0.0004::DOUBLE * a), 2)) AS sy, sqrt(4 + power(0.14::DOUBLE * a / sqrt(1 + 0.0003::DOUBLE * a), 2)) AS sz FROM pa WHERE a > 0.5 AND abs(c) <= 6 * (sy0 + 0.16::DOUBLE * a)),
pc AS (SELECT *, list_sum([CASE WHEN power(ry - hs + 200 * n, 2) / (2 * sz * sz) < 40 THEN exp(-power(ry - hs + 200 * n, 2) / (2 * sz * sz)) ELSE 0 END + CASE WHEN power(ry + hs + 200 * n, 2) / (2 * sz * sz) < 40 THEN exp(-power(ry + hs + 200 * n, 2) / (2 * sz * sz)) ELSE 0 END for n in CASE WHEN sz > 25 THEN [-3, -2, -1, 0, 1, 2, 3] ELSE [0] END]) AS v FROM pb WHERE abs(c) <= 6 * sy),
pd AS (SELECT *, w / (2 * pi() * sy * sz) * exp(-c * c / (2 * sy * sy)) * v AS g FROM pc)"""


@query(f"WITH {PLUME} SELECT receptor, grp, round(1e3 * sum(g) + 1e-9, 5) AS gamma, round(sum(g * a) + 1e-9, 5) AS age FROM pd GROUP BY 1, 2")
def plume_response(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Gaussian sums with images over all sources upwind of each receptor."""
    k = F.col("p_partkey")
    group = F.get(F.array(*map(F.lit, "ABCD")), (k % 4).cast("int"))
    sources = table(spark, sf_dir, "part").select(k.alias("id"), ((k * 37) % 1000).cast("double").alias("x"), ((k * 91) % 997).cast("double").alias("z"), (1 + k % 5).cast("double").alias("w"), F.when(k % 4 == 3, 8.0).otherwise(0.5).alias("hs"), (1 + k % 3).cast("double").alias("sy0"), group.alias("grp"))
    s = F.col("s_suppkey")
    receptors = table(spark, sf_dir, "supplier").select(s.alias("id"), ((s * 53) % 1000).cast("double").alias("x"), F.lit(3.0).alias("y"), ((s * 29) % 997).cast("double").alias("z"))
    out = receptor.plume(sources, receptors, DIRECTION, "D", LID)
    return out.select("receptor", "grp", rounded(1e3 * F.col("gamma"), 5).alias("gamma"), rounded(F.col("age"), 5).alias("age"))
