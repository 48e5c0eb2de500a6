"""Meteorology as column expressions; missing is NULL throughout."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from aerolake.functions.dimensions import CALM, N_SECTORS


def wrap360(a: Column) -> Column:
    return F.pmod(a, F.lit(360.0))


def sector(direction: Column) -> Column:
    """Sector of a bearing; edges go to the next sector; a missing bearing counts as north."""
    width = 360.0 / N_SECTORS
    return F.coalesce(F.pmod(F.floor((wrap360(direction) + width / 2) / width), F.lit(N_SECTORS)).cast("int"), F.lit(0))


def rose_sector(direction: Column, speed: Column) -> Column:
    """Sector, or -1 for calms and hours without direction; NULL without speed: such hours are in no rose."""
    return F.when(speed.isNull(), F.lit(None).cast("int")).when((speed < CALM) | direction.isNull(), F.lit(-1)).otherwise(sector(direction))


def u_eff(u: Column, u0: Column) -> Column:
    return F.sqrt(F.pow(F.greatest(F.lit(0.0), u), F.lit(2.0)) + F.pow(u0, F.lit(2.0)))


def direction_weights(direction: Column, u: Column) -> Column:
    """Weights of the 16 sectors: a Gaussian kernel around the bearing, wider in weak wind; uniform in calms and where wind is missing.

    Terms are plain expressions, and their sum, a term of its own, is computed once a row.
    """
    sigma = F.least(F.lit(60.0), F.lit(22.5) * F.greatest(F.lit(1.0), F.lit(2.0) / F.greatest(u, F.lit(1e-9))))
    apart = [F.abs(F.pmod(i * 360.0 / N_SECTORS - direction + 180.0, F.lit(360.0)) - 180.0) for i in range(N_SECTORS)]
    kernel = F.array(*(F.exp(-(a * a) / (2 * sigma * sigma)) for a in apart))
    with_sum = F.struct(kernel.alias("k"), F.aggregate(kernel, F.lit(0.0), lambda x, y: x + y).alias("n"))
    shares = F.get(F.transform(F.array(with_sum), lambda p: F.transform(p["k"], lambda w: w / p["n"])), F.lit(0))
    return F.when((u >= CALM) & direction.isNotNull(), shares).otherwise(F.array(*[F.lit(1.0 / N_SECTORS)] * N_SECTORS))


# Classes by irradiance (rows, from strong to weak) and wind (columns); floors of the rows; limits of the columns.
DAY_CLASSES = ("AABCC", "ABBCD", "BCCDD", "DDDDD")
DAY_SUN = (925, 675, 175)
DAY_WIND = (2, 3, 5, 6)
# Slope and offset of 1/L against log10 of roughness; median mixing height of each class in metres.
INVERSE_L = {"A": (-0.096, 0.029), "B": (-0.037, 0.029), "C": (-0.002, 0.018), "D": (0.0, 0.0), "E": (0.004, -0.018), "F": (0.035, -0.036)}
MIXING = {"A": 1178.0, "B": 520.0, "C": 1060.0, "D": 135.0, "E": 278.0, "F": 30.0}
# Upper limits of Beaufort forces 0 to 11, m/s.
BEAUFORT = (0.3, 1.6, 3.4, 5.5, 8.0, 10.8, 13.9, 17.2, 20.8, 24.5, 28.5, 32.7)


def choose(key: Column, values: dict) -> Column:
    """Value of a small dictionary; NULL for other keys."""
    return F.coalesce(*(F.when(key == k, F.lit(v)) for k, v in values.items()))


def stability(u: Column, sun: Column, cloud: Column, t: Column | None = None, site: tuple[float, float] | None = None) -> Column:
    """Class A to F: by day from irradiance (W/m2) and wind; at night (no irradiance) from cloud (percent, missing: 50) and wind. Missing wind: D.

    Where ``t`` and ``site`` are given, missing irradiance is estimated from the sun half an hour before t and cloud; else it counts as night.
    """
    if t is not None and site is not None:
        sun = F.coalesce(sun, irradiance(solar_elevation(t - F.expr("INTERVAL 30 MINUTES"), *site), cloud))
    row = F.when(sun >= DAY_SUN[0], DAY_CLASSES[0]).when(sun >= DAY_SUN[1], DAY_CLASSES[1]).when(sun >= DAY_SUN[2], DAY_CLASSES[2]).otherwise(DAY_CLASSES[3])
    column = F.lit(1)
    for limit in DAY_WIND:
        column = column + (u >= limit).cast("int")
    covered = F.coalesce(cloud, F.lit(50.0))
    calm = F.when(covered > 40, F.lit(1.9)).otherwise(F.lit(3.4))
    fresh = F.when(covered > 40, F.lit(3.4)).otherwise(F.lit(5.5))
    night = F.when(covered >= 95, "D").when(u < calm, "F").when(u < fresh, "E").otherwise("D")
    return F.when(u.isNull(), "D").when(F.coalesce(sun, F.lit(0.0)) > 0, F.substr(row, column, F.lit(1))).otherwise(night)


#: The class that stands for a group.
OF_GROUP = {"AC": "B", "D": "D", "EF": "F"}


def representative(cls: Column) -> Column:
    """A class as it is, a group's class for a group, D for anything else."""
    return F.coalesce(choose(cls, OF_GROUP), F.when(cls.isin("A", "B", "C", "D", "E", "F"), cls), F.lit("D"))


def stability_group(cls: Column) -> Column:
    """Group of a class; a group is its own."""
    return F.when(cls.isin("A", "B", "C", "AC"), "AC").when(cls.isin("E", "F", "EF"), "EF").otherwise("D")


def inverse_obukhov(cls: Column, z0: float) -> Column:
    """1/L of a class or group: zero in neutral air, so no infinities arise; roughness counts up to 0.5 m."""
    rough = math.log10(min(z0, 0.5))
    return choose(representative(cls), {c: a + b * rough for c, (a, b) in INVERSE_L.items()})


#: Floors of the mixing height by mode; any other mode: the site's own.
MIXING_FLOORS = {"nwp": 10.0, "315": 315.0, "100": 100.0}


def mixing_height(cls: Column, blh: Column, floor: float = 100.0, mode: str = "auto") -> Column:
    """Given height, else the median of the class (of a group, its representative's), at least the mode's floor (else ``floor``)."""
    return F.greatest(F.coalesce(blh, choose(representative(cls), MIXING)), F.lit(MIXING_FLOORS.get(mode, floor)))


def obukhov(cls: Column, z0: float) -> Column:
    """Obukhov length in metres; infinite in neutral air."""
    i = inverse_obukhov(cls, z0)
    return F.when(F.abs(i) < 1e-12, F.lit(float("inf"))).otherwise(1 / i)


def vector_mean(u: Column, direction: Column) -> tuple[Column, Column, Column, Column]:
    """Aggregates over hours with both: speed and bearing of the mean vector, mean speed, hours."""
    both = u.isNotNull() & direction.isNotNull()
    a = F.radians(direction)
    e, n = F.avg(F.when(both, -u * F.sin(a))), F.avg(F.when(both, -u * F.cos(a)))
    return F.sqrt(e * e + n * n), wrap360(F.degrees(F.atan2(-e, -n))), F.avg(F.when(both, u)), F.count_if(both)


def beaufort(u: Column) -> Column:
    force = F.lit(0)
    for limit in BEAUFORT:
        force = force + (u >= limit).cast("int")
    return force


def angle_between(a: Column, b: Column) -> Column:
    """Signed difference in (-180, 180]."""
    d = wrap360(a - b)
    return F.when(d > 180, d - 360).otherwise(d)


# Series of the equation of time, minutes, and of the declination, radians (Spencer 1971): constant, cosines and sines.
EQUATION_OF_TIME = (0.000075, (0.001868, -0.014615), (-0.032077, -0.040849))
DECLINATION = (0.006918, (-0.399912, -0.006758, -0.002697), (0.070257, 0.000907, 0.00148))


def _fourier(g: Column, series: tuple) -> Column:
    constant, cosines, sines = series
    out = F.lit(constant)
    for k, (c, s) in enumerate(zip(cosines, sines, strict=True), 1):
        out = out + c * F.cos(k * g) + s * F.sin(k * g)
    return out


def solar_elevation(t: Column, lat: float, lon: float) -> Column:
    """Degrees above the horizon by the short Fourier series of Spencer (1971), without refraction; t in UTC."""
    hour = F.hour(t) + F.minute(t) / 60 + F.second(t) / 3600
    year = F.dayofyear(F.make_date(F.year(t), F.lit(12), F.lit(31)))
    g = 2 * math.pi / year * (F.dayofyear(t) - 1 + (hour - 12) / 24)
    minutes, tilt = 229.18 * _fourier(g, EQUATION_OF_TIME), _fourier(g, DECLINATION)
    angle = F.radians((hour * 60 + minutes + 4 * lon) / 4 - 180)
    up = math.sin(math.radians(lat)) * F.sin(tilt) + math.cos(math.radians(lat)) * F.cos(tilt) * F.cos(angle)
    return 90 - F.degrees(F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), up))))


def irradiance(elevation: Column, cloud: Column) -> Column:
    """Clear-sky irradiance less cloud (percent, missing: 50), W/m2; none below the horizon."""
    share = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(cloud, F.lit(50.0)) / 100))
    clear = (990 * F.sin(F.radians(elevation)) - 30) * (1 - 0.75 * F.pow(share, F.lit(3.4)))
    return F.when(elevation > 0, F.greatest(F.lit(0.0), clear)).otherwise(0.0)
