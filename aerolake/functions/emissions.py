"""Emissions of road and heating groups as column expressions: profiles, measures, strengths."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from aerolake.functions.calendar import day_type_with_holidays, local_start

# Share of the day's traffic by hour, unscaled; factors by day of the week and month, unscaled; days of the months.
HOURS = {
    "weekday": (0.9, 0.6, 0.4, 0.4, 0.6, 1.5, 4.0, 6.8, 7.2, 6.0, 5.3, 5.4, 5.6, 5.7, 6.0, 6.6, 7.2, 7.3, 6.6, 5.2, 3.9, 3.0, 2.3, 1.5),
    "saturday": (2.72, 2.08, 1.49, 1.21, 1.07, 1.52, 2.98, 4.83, 5.35, 4.96, 4.56, 4.50, 4.71, 4.44, 3.81, 3.94, 5.33, 6.96, 7.40, 6.61, 5.44, 5.13, 5.04, 3.93),
    "sunday": (4.10, 3.34, 2.32, 1.90, 1.55, 1.55, 1.93, 2.56, 3.15, 3.49, 3.43, 3.45, 3.79, 3.99, 4.01, 4.83, 6.69, 8.65, 9.27, 7.71, 5.86, 4.60, 3.76, 4.10),
}
DAYS = (1.00, 1.00, 1.00, 1.00, 1.02, 0.90, 0.70)
MONTHS = (0.95, 0.98, 1.02, 1.02, 1.02, 1.02, 0.93, 0.85, 1.03, 1.03, 1.03, 1.00)
MONTH_DAYS = (31, 28, 31, 30, 31, 30, 31, 31, 30, 31, 30, 31)
# Emission factors, g per vehicle and km.
FACTORS = {"nox": 0.50, "pm10_exhaust": 0.017, "pm10_wear": 0.029, "pm10_dust": 0.056, "pm25": 0.032, "co": 0.49, "c6h6": 0.0036, "pm25_exhaust": 0.017, "pm25_wear": 0.015, "pm25_dust": 0.056 * 0.15 / 0.62}
# Share of brakes in wear and what electric cars leave of it; share of buses; what a low-emission zone leaves.
BRAKES = {"pm10": 0.0122 * 0.98 / (0.0184 + 0.0075), "pm25": 0.0122 * 0.39 / (0.0093 + 0.0041)}
ELECTRIC_BRAKES = 0.3
BUSES = {"nox": 0.005 * 3.713 / 0.50, "pm10": 0.005 * 0.0636 / 0.017, "pm25": 0.005 * 0.0636 / 0.017, "co": 0.005 * 1.47 / 0.49, "c6h6": 0.0}
ZONE_LEAVES = {"nox": 0.60, "pm10": 0.25, "pm25": 0.25, "co": 0.60, "c6h6": 0.60}
# Queues raise factors by this in rush hours, for these shares of the road groups; vehicles a day a strength is for.
QUEUE_FACTOR, QUEUE_HOURS, QUEUE_SHARE = 2.5, (7, 8, 15, 16, 17), {"A": 0.21, "B": 0.37}
UNIT_TRAFFIC = 10_000.0
# Heating season; rates, ug per m2 and s; share of the rate by hour; fuel mix and factors by fuel, g/GJ.
HEAT_MONTHS = (10, 11, 12, 1, 2, 3)
HEAT_HOURS = (0.15, 0.15, 0.15, 0.15, 0.15, 0.15, 0.30, 0.60, 0.80, 0.80, 0.60, 0.30, 0.30, 0.30, 0.30, 0.30, 0.40, 0.60, 0.80, 1.00, 1.00, 1.00, 0.60, 0.30)
HEAT_MIX = {"gas": 0.47, "oil": 0.08, "wood": 0.07}
HEAT_FACTORS = {"gas": {"nox": 51, "co": 26, "pm10": 1.2, "pm25": 1.2}, "oil": {"nox": 51, "co": 57, "pm10": 1.9, "pm25": 1.9}, "wood": {"nox": 50, "co": 4000, "pm10": 760, "pm25": 740}}
POLLUTANTS = ("nox", "pm10", "pm25", "co", "c6h6")


def _mixed(pollutant: str) -> float:
    return sum(share * HEAT_FACTORS[fuel][pollutant] for fuel, share in HEAT_MIX.items())


HEAT_RATES = {"nox": 1.0, "pm10": 2.0, "pm25": 2.0 * _mixed("pm25") / _mixed("pm10"), "co": _mixed("co") / _mixed("nox"), "c6h6": 0.0}
#: Profiles scaled to a sum of 1 a day and means of 1 a week and a year.
HOUR_SHARES = {k: tuple(x / sum(v) for x in v) for k, v in HOURS.items()}
DAY_FACTORS = tuple(7 * x / sum(DAYS) for x in DAYS)
MONTH_FACTORS = tuple(365 * x / sum(a * d for a, d in zip(MONTHS, MONTH_DAYS, strict=True)) for x in MONTHS)


def _pick(values: tuple[float, ...], index: Column) -> Column:
    return F.get(F.array(*map(F.lit, values)), index)


def local_calendar(t: Column) -> dict[str, Column]:
    """Hour, month, day of the week (0: Monday) and day type, holidays as sundays, of the local start of the hour that ends at t."""
    start = local_start(t)
    return {"hour": F.hour(start), "month": F.month(start), "dow": F.weekday(start), "daytype": day_type_with_holidays(F.to_date(start))}


def traffic_factor(t: Column, by_month: bool = True, calendar: dict[str, Column] | None = None) -> Column:
    """Traffic of an hour against the mean hour of the year. ``calendar``: what ``local_calendar`` gives, where rows have it already."""
    c = calendar or local_calendar(t)
    shares = F.when(c["daytype"] == "sunday", _pick(HOUR_SHARES["sunday"], c["hour"])).when(c["daytype"] == "saturday", _pick(HOUR_SHARES["saturday"], c["hour"])).otherwise(_pick(HOUR_SHARES["weekday"], c["hour"]))
    day = F.when(c["daytype"] == "sunday", F.lit(DAY_FACTORS[6])).otherwise(_pick(DAY_FACTORS, c["dow"]))
    return 24 * shares * day * (_pick(MONTH_FACTORS, c["month"] - 1) if by_month else F.lit(1.0))


def heating_on(setting: Column | bool | str, month: Column) -> Column:
    """``true``, ``false`` or ``auto`` (in season) as a string, or a boolean."""
    s = setting if isinstance(setting, Column) else F.lit(str(setting).lower())
    return F.coalesce((s == "true") | (s == "auto") & month.isin(*HEAT_MONTHS), F.lit(False))


def _share(percent: Column) -> Column:
    """Percent as a share; missing: all."""
    return F.coalesce(F.greatest(percent, F.lit(0.0)) / 100, F.lit(1.0))


#: Names of measures and what they are without any.
TODAY = {"zone": False, "electric": 0.0, "electric_buses": False, "car_free_b": False, "traffic": 100.0, "traffic_a": 100.0, "traffic_b": 100.0, "queues": False, "dust": False}


def measure_factors(pollutant: str, measures: dict[str, Column] | None = None) -> dict[str, Column]:
    """What the measures leave of exhaust and wear, and of the traffic of the groups A, B and C; ``queues`` and ``dust`` as given."""
    m = {k: F.lit(v) for k, v in TODAY.items()} | (measures or {})
    electric = F.least(F.greatest(F.coalesce(m["electric"], F.lit(0.0)) / 100, F.lit(0.0)), F.lit(1.0))
    exhaust = (1 - electric) * F.when(m["zone"], ZONE_LEAVES[pollutant]).otherwise(1.0) * F.when(m["electric_buses"], 1 - BUSES[pollutant]).otherwise(1.0)
    wear = 1 - electric * BRAKES.get(pollutant, 0.0) * (1 - ELECTRIC_BRAKES)
    every = _share(m["traffic"])
    return {"exhaust": exhaust, "wear": wear, "A": every * _share(m["traffic_a"]), "B": F.when(m["car_free_b"], 0.0).otherwise(every * _share(m["traffic_b"])), "C": every, "queues": m["queues"], "dust": m["dust"]}


def group_strengths(pollutant: str, t: Column, measures: dict[str, Column] | None = None, heating: Column | bool | str = False, factors: dict[str, float] | None = None, heating_scale: float = 1.0, queue_share: dict[str, float | Column] | None = None, calendar: dict[str, Column] | None = None) -> dict[str, Column]:
    """Strengths of the groups A to C, g per m and s for UNIT_TRAFFIC vehicles a day, and D, g per m2 and s. Pollutants without factors: 0.

    ``calendar``: what ``local_calendar`` gives, and ``traffic``, what ``traffic_factor`` does, as columns that rows have already.
    """
    p = "nox" if pollutant in ("no2", "no") else pollutant
    if p not in POLLUTANTS:
        return dict.fromkeys("ABCD", F.lit(0.0))
    e, m, c = FACTORS | (factors or {}), measure_factors(p, measures), calendar or local_calendar(t)
    exhaust, wear = e.get(f"{p}_exhaust", e[p] if p in e else 0.0), e.get(f"{p}_wear", 0.0)
    dust = F.when(m["dust"], e.get(f"{p}_dust", 0.0)).otherwise(0.0)
    rush = m["queues"] & (c["daytype"] == "weekday") & c["hour"].isin(*QUEUE_HOURS)
    vehicles = UNIT_TRAFFIC * c.get("traffic", traffic_factor(t, calendar=c)) / 24
    share = queue_share or QUEUE_SHARE
    out = {}
    for g in "ABC":
        queue = F.when(rush, 1 + (QUEUE_FACTOR - 1) * share.get(g, 0.0)).otherwise(1.0) if g != "C" else F.lit(1.0)
        out[g] = vehicles * (exhaust * m["exhaust"] * queue + wear * m["wear"] + dust) / 3.6e6 * m[g]
    out["D"] = F.when(heating_on(heating, c["month"]), HEAT_RATES[p] * 1e-6 * heating_scale * _pick(HEAT_HOURS, c["hour"])).otherwise(0.0)
    return out
