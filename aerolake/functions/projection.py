"""Transverse Mercator, forward and inverse, by Krueger's series to the sixth power of the third flattening (Karney 2011)."""

from __future__ import annotations

import math
from dataclasses import dataclass
from fractions import Fraction as Q

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The ellipsoid GRS80; coefficients of n, n^2, ... n^6 in the j-th term of the series from conformal to rectifying latitude, back, and from conformal to geodetic latitude.
AXIS, FLATTENING = 6378137.0, 1 / 298.257222101
ALPHA = (
    (Q(1, 2), Q(-2, 3), Q(5, 16), Q(41, 180), Q(-127, 288), Q(7891, 37800)),
    (0, Q(13, 48), Q(-3, 5), Q(557, 1440), Q(281, 630), Q(-1983433, 1935360)),
    (0, 0, Q(61, 240), Q(-103, 140), Q(15061, 26880), Q(167603, 181440)),
    (0, 0, 0, Q(49561, 161280), Q(-179, 168), Q(6601661, 7257600)),
    (0, 0, 0, 0, Q(34729, 80640), Q(-3418889, 1995840)),
    (0, 0, 0, 0, 0, Q(212378941, 319334400)),
)
BETA = (
    (Q(1, 2), Q(-2, 3), Q(37, 96), Q(-1, 360), Q(-81, 512), Q(96199, 604800)),
    (0, Q(1, 48), Q(1, 15), Q(-437, 1440), Q(46, 105), Q(-1118711, 3870720)),
    (0, 0, Q(17, 480), Q(-37, 840), Q(-209, 4480), Q(5569, 90720)),
    (0, 0, 0, Q(4397, 161280), Q(-11, 504), Q(-830251, 7257600)),
    (0, 0, 0, 0, Q(4583, 161280), Q(-108847, 3991680)),
    (0, 0, 0, 0, 0, Q(20648693, 638668800)),
)
DELTA = (
    (Q(2), Q(-2, 3), Q(-2), Q(116, 45), Q(26, 45), Q(-2854, 675)),
    (0, Q(7, 3), Q(-8, 5), Q(-227, 45), Q(2704, 315), Q(2323, 945)),
    (0, 0, Q(56, 15), Q(-136, 35), Q(-1262, 105), Q(73814, 2835)),
    (0, 0, 0, Q(4279, 630), Q(-332, 35), Q(-399572, 14175)),
    (0, 0, 0, 0, Q(4174, 315), Q(-144838, 6237)),
    (0, 0, 0, 0, 0, Q(601676, 22275)),
)
N = FLATTENING / (2 - FLATTENING)
ECCENTRICITY = math.sqrt(FLATTENING * (2 - FLATTENING))
RADIUS = AXIS / (1 + N) * (1 + N**2 / 4 + N**4 / 64 + N**6 / 256)


def terms(series: tuple) -> list[float]:
    """The series' six terms for the ellipsoid."""
    return [sum(float(c) * N ** (p + 1) for p, c in enumerate(row)) for row in series]


@dataclass(frozen=True)
class Plane:
    """A projection: central meridian (degrees), scale on it, and false east and north (m)."""

    meridian: float
    scale: float
    east: float = 500000.0
    north: float = 0.0


#: EPSG 3765 and 3045.
HTRS96, UTM33 = Plane(16.5, 0.9999), Plane(15.0, 0.9996)


def _staged(rows: DataFrame, steps: list[dict[str, Column]], results: dict[str, Column]) -> DataFrame:
    """rows with ``results``; each step's columns are computed once and dropped at the end."""
    out = rows
    for step in steps:
        out = out.withColumns(step)
    return out.withColumns(results).select(*(c for c in rows.columns if c not in results), *results)


def to_plane(rows: DataFrame, plane: Plane, lat: str = "lat", lon: str = "lon") -> DataFrame:
    """rows with ``east`` and ``north`` of geodetic degrees."""
    c = lambda n: F.col(f"_tm_{n}")
    e = ECCENTRICITY
    steps = [
        {"_tm_t": F.tan(F.radians(lat)), "_tm_l": F.radians(F.col(lon) - plane.meridian)},
        {"_tm_r": F.sqrt(1 + c("t") * c("t"))},
        {"_tm_s": F.sinh(e * F.atanh(e * c("t") / c("r")))},
        {"_tm_u": c("t") * F.sqrt(1 + c("s") * c("s")) - c("s") * c("r")},
        {"_tm_x": F.atan2(c("u"), F.cos(c("l"))), "_tm_y": F.asinh(F.sin(c("l")) / F.sqrt(c("u") * c("u") + F.cos(c("l")) * F.cos(c("l"))))},
    ]
    x, y = c("x"), c("y")
    for j, a in enumerate(terms(ALPHA), 1):
        x, y = x + a * F.sin(2 * j * c("x")) * F.cosh(2 * j * c("y")), y + a * F.cos(2 * j * c("x")) * F.sinh(2 * j * c("y"))
    k = plane.scale * RADIUS
    return _staged(rows, steps, {"east": plane.east + k * y, "north": plane.north + k * x})


def from_plane(rows: DataFrame, plane: Plane, east: str = "east", north: str = "north") -> DataFrame:
    """rows with geodetic ``lat`` and ``lon`` in degrees."""
    c = lambda n: F.col(f"_tm_{n}")
    k = plane.scale * RADIUS
    x, y = c("a"), c("b")
    for j, a in enumerate(terms(BETA), 1):
        x, y = x - a * F.sin(2 * j * c("a")) * F.cosh(2 * j * c("b")), y - a * F.cos(2 * j * c("a")) * F.sinh(2 * j * c("b"))
    steps = [{"_tm_a": (F.col(north) - plane.north) / k, "_tm_b": (F.col(east) - plane.east) / k}, {"_tm_x": x, "_tm_y": y}, {"_tm_c": F.asin(F.sin(c("x")) / F.cosh(c("y")))}]
    lat = c("c")
    for j, a in enumerate(terms(DELTA), 1):
        lat = lat + a * F.sin(2 * j * c("c"))
    return _staged(rows, steps, {"lat": F.degrees(lat), "lon": plane.meridian + F.degrees(F.atan2(F.sinh(c("y")), F.cos(c("x"))))})
