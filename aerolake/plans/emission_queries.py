"""Queries of emissions, profiles and dispersion on the driver's tables, with SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from aerolake.functions import emissions, similarity, weather
from aerolake.functions.calendar import rounded
from aerolake.plans.ledger import DAYTYPE_H, HOLIDAY_TABLE, LOCAL
from aerolake.sources.tables import table

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str):
    def register(f):
        QUERIES[f.__name__] = f
        ORACLES[f.__name__] = sql
        return f

    return register


def _list(values) -> str:
    return "[" + ", ".join(f"{x!r}::DOUBLE" for x in values) + "]"


#: Traffic of the hour whose local start is {l}; needs the table ``hol``.
TRAFFIC = (
    f"24 * (CASE {DAYTYPE_H.format('{l}')} WHEN 'weekday' THEN {_list(emissions.HOUR_SHARES['weekday'])} WHEN 'saturday' THEN {_list(emissions.HOUR_SHARES['saturday'])} ELSE {_list(emissions.HOUR_SHARES['sunday'])} END)[hour({{l}}) + 1]"
    f" * (CASE WHEN {DAYTYPE_H.format('{l}')} = 'sunday' THEN {emissions.DAY_FACTORS[6]!r}::DOUBLE ELSE {_list(emissions.DAY_FACTORS)}[isodow({{l}})] END) * {_list(emissions.MONTH_FACTORS)}[month({{l}})]"
)
MEASURES = "event_id % 2 = 0 AS zone, CAST(event_id % 120 AS DOUBLE) AS electric, event_id % 3 = 0 AS buses, event_id % 5 = 0 AS free_b, CASE WHEN event_id % 7 > 0 THEN CAST(event_id % 130 AS DOUBLE) END AS traffic, event_id % 4 < 3 AS queues, event_id % 6 = 0 AS dust"


def _measures() -> dict:
    i = F.col("event_id")
    return {"zone": i % 2 == 0, "electric": (i % 120).cast("double"), "electric_buses": i % 3 == 0, "car_free_b": i % 5 == 0, "traffic": F.when(i % 7 > 0, (i % 130).cast("double")), "queues": i % 4 < 3, "dust": i % 6 == 0}


EV = "least(greatest(electric / 100, 0), 1)"


def strength_parts(p: str) -> dict[str, str]:
    """SQL of the strengths of groups A to D, from columns l (local start), f (traffic) and the measures."""
    e = emissions.FACTORS
    exhaust, wear, dust = e.get(f"{p}_exhaust", e.get(p)), e.get(f"{p}_wear", 0.0), e.get(f"{p}_dust", 0.0)
    left = f"(1 - {EV}) * CASE WHEN zone THEN {emissions.ZONE_LEAVES[p]}::DOUBLE ELSE 1 END * CASE WHEN buses THEN {1 - emissions.BUSES[p]!r}::DOUBLE ELSE 1 END"
    worn = f"(1 - {EV} * {emissions.BRAKES.get(p, 0.0)!r}::DOUBLE * 0.7)"
    rush = f"(queues AND {DAYTYPE_H.format('l')} = 'weekday' AND hour(l) IN (7, 8, 15, 16, 17))"
    of = lambda g, part: f"1e4::DOUBLE * f / 24 * ({exhaust!r}::DOUBLE * {left} * {f'CASE WHEN {rush} THEN {1 + 1.5 * emissions.QUEUE_SHARE[g]!r}::DOUBLE ELSE 1 END' if g != 'C' else '1'} + {wear!r}::DOUBLE * {worn} + CASE WHEN dust THEN {dust!r}::DOUBLE ELSE 0 END) / 3.6e6 * {part}"
    every = "coalesce(greatest(traffic, 0) / 100, 1)"
    heat = f"CASE WHEN month(l) IN (10, 11, 12, 1, 2, 3) THEN {emissions.HEAT_RATES[p] * 1e-6!r}::DOUBLE * {_list(emissions.HEAT_HOURS)}[hour(l) + 1] ELSE 0 END"
    return {"a": of("A", every), "b": of("B", f"CASE WHEN free_b THEN 0 ELSE {every} END"), "c": of("C", every), "d": heat}


@query(f"""WITH {HOLIDAY_TABLE}, x AS (SELECT event_id, {LOCAL.format('ts')} AS l, {MEASURES} FROM events), y AS (SELECT *, {TRAFFIC.format(l='l')} AS f FROM x)
SELECT event_id, {', '.join(f'round(1e6 * ({x}) + 1e-9, 6) AS {p}_{g}' for p in emissions.POLLUTANTS for g, x in strength_parts(p).items())} FROM y""")
def group_strengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Strengths of all groups and pollutants under measures that differ from row to row, in millionths."""
    out = []
    for p in emissions.POLLUTANTS:
        out += [rounded(1e6 * c).alias(f"{p}_{g.lower()}") for g, c in emissions.group_strengths(p, F.col("ts"), _measures(), "auto").items()]
    return table(spark, sf_dir, "events").select("event_id", *out)


def _psi(z: str) -> str:
    x = f"power(1 - 16 * least({z}, 0), 0.25::DOUBLE)"
    return f"(CASE WHEN {z} < 0 THEN 2 * ln((1 + {x}) / 2) + ln((1 + {x} * {x}) / 2) - 2 * atan({x}) + pi() / 2 ELSE -5 * least({z}, 1) END)"


@query(f"""WITH c AS (SELECT event_id, value / 2 AS z, [-0.096::DOUBLE + 0.029::DOUBLE * log10(0.5::DOUBLE), -0.002::DOUBLE + 0.018::DOUBLE * log10(0.5::DOUBLE), 0.0, 0.035::DOUBLE - 0.036::DOUBLE * log10(0.5::DOUBLE)][event_id % 4 + 1] AS i FROM events),
a AS (SELECT *, 0.4::DOUBLE / (ln(10 / 0.3::DOUBLE) - {_psi('10 * i')} + {_psi('0.3::DOUBLE * i')}) AS r FROM c),
b AS (SELECT *, r / 0.4::DOUBLE * (ln(80 / 0.3::DOUBLE) - {_psi('80 * i')} + {_psi('0.3::DOUBLE * i')}) AS ub FROM a),
s AS (SELECT *, 0.4::DOUBLE * ub / (ln(73 / 1.5::DOUBLE) - {_psi('73 * i')} + {_psi('1.5::DOUBLE * i')}) AS us, greatest(z, 14) - 7 AS h FROM b)
SELECT event_id, round(us + 1e-9, 6) AS u_star, round(us / 0.4::DOUBLE * (ln(h / 1.5::DOUBLE) - {_psi('h * i')} + {_psi('1.5::DOUBLE * i')}) + 1e-9, 6) AS wind,
round(CASE WHEN h + 7 >= 100 THEN 0 ELSE 0.4::DOUBLE * us * h / (CASE WHEN i < 0 THEN 1 / sqrt(1 - 16 * h * i) ELSE 1 + 5 * least(h * i, 1) END) * power(1 - (h + 7) / 100, 2) END + 1e-9, 6) AS k FROM s""")
def similarity_profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Friction velocity, wind and diffusivity at a height in four stability classes."""
    cls = F.get(F.array(*map(F.lit, "ACDF")), (F.col("event_id") % 4).cast("int"))
    i, z = weather.inverse_obukhov(cls, similarity.Z0), F.col("value") / 2
    us = similarity.friction_velocity(i)
    return table(spark, sf_dir, "events").select("event_id", rounded(us).alias("u_star"), rounded(similarity.wind_at(z, us, i)).alias("wind"), rounded(similarity.diffusivity_at(z, us, i, F.lit(100.0))).alias("k"))
