"""Rules on tagged map features and small geometry as column expressions. ``tags`` is a map<string,string> column."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# Heights by building type, m; of untagged small and other buildings; metres a storey and of roof; limits of small footprints and bases.
TYPE_HEIGHT = {"house": 7.0, "detached": 7.0, "semidetached_house": 7.0, "bungalow": 5.0, "terrace": 7.0, "apartments": 14.3, "residential": 14.3, "dormitory": 14.3, "hotel": 14.3, "garage": 3.0, "garages": 3.0, "shed": 3.0, "carport": 3.0, "kiosk": 3.0, "hut": 3.0, "cabin": 3.0, "toilets": 3.0, "container": 3.0, "service": 3.0, "transformer_tower": 3.0, "roof": 5.0, "commercial": 10.0, "retail": 10.0, "office": 14.3, "industrial": 9.0, "warehouse": 9.0, "school": 12.0, "university": 14.0, "college": 14.0, "church": 18.0, "hospital": 18.0, "public": 14.3, "civic": 14.3, "government": 14.3, "train_station": 12.0, "greenhouse": 4.0}
SMALL_HEIGHT, ANY_HEIGHT, STOREY, ROOF, SMALL_AREA, LEAST_BASE = 3.0, 14.3, 3.0, 5.5, 60.0, 1.0
# Road classes, lanes of both ways by class, vehicles a day by kind, shares of slip roads and of one carriageway.
ROAD_CLASS = {"motorway": 0, "trunk": 0, "primary": 0, "motorway_link": 0, "trunk_link": 0, "primary_link": 0, "secondary": 1, "secondary_link": 1, "tertiary": 2, "tertiary_link": 2, "residential": 3, "unclassified": 3, "living_street": 3, "road": 3, "service": 4, "busway": 4, "footway": 5, "cycleway": 5, "pedestrian": 5, "path": 5, "steps": 5, "track": 5, "bridleway": 5}
LANES = {0: 4, 1: 4, 2: 2, 3: 2, 4: 1}
TRAFFIC = {"trunk": 60000, "primary": 45000, "secondary": 25000, "tertiary": 12000, "unclassified": 3000, "residential": 1000, "living_street": 1000, "road": 1000, "service": 150, "busway": 150}
SLIP_SHARE, ONE_WAY_SHARE = 0.25, 0.5
# Constants of Macdonald, Griffiths and Hall (1998).
MACDONALD_A, MACDONALD_BETA, DRAG, KAPPA = 4.43, 1.0, 1.2, 0.4


def clamp(x: Column, low: float, high: float) -> Column:
    return F.greatest(F.lit(low), F.least(x, F.lit(high)))


def lerp(a: Column, b: Column, share: Column) -> Column:
    return a + (b - a) * share


def smoothstep(low: float, high: float, x: Column) -> Column:
    s = clamp((x - low) / (high - low), 0.0, 1.0)
    return s * s * (3 - 2 * s)


def number(text: Column) -> Column:
    """The first number of "12", "12,5 m" or "12;14"; NULL for anything else."""
    first = F.regexp_replace(F.split_part(F.trim(F.split_part(F.replace(text, F.lit(","), F.lit(".")), F.lit(";"), F.lit(1))), F.lit(" "), F.lit(1)), "m+$", "")
    return F.when(first.rlike(r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"), first.try_cast("double"))


def _of(key: Column, values: dict) -> Column:
    return F.create_map(*(F.lit(x) for kv in values.items() for x in kv))[key]


def building(tags: Column, area: Column) -> dict[str, Column]:
    """Height, base and the rule that gave the height: its tag, a small footprint, storeys, or the type."""
    kind = F.coalesce(tags["building"], F.lit("yes"))
    height, storeys = number(tags["height"]), number(tags["building:levels"])
    tagged, roof, small, counted = height > 0, kind == "roof", area < SMALL_AREA, storeys > 0
    tall = F.when(tagged, height).when(roof, TYPE_HEIGHT["roof"]).when(small, SMALL_HEIGHT * F.greatest(F.lit(1.0), F.coalesce(F.nullif(storeys, F.lit(0.0)), F.lit(1.0)))).when(counted, STOREY * storeys + ROOF).otherwise(F.coalesce(_of(kind, TYPE_HEIGHT), F.lit(ANY_HEIGHT)))
    rule = F.when(tagged, "height").when(roof, "type").when(small, "small").when(counted, "levels").otherwise("type")
    base = F.coalesce(number(tags["min_height"]), STOREY * number(tags["building:min_level"]), F.lit(0.0))
    base = F.when(F.coalesce(tags["building"] == "roof", F.lit(False)) & (base == 0), F.greatest(F.lit(0.0), tall - 1)).otherwise(base)
    return {"height": tall, "base": F.when(base >= LEAST_BASE, base).otherwise(0.0), "rule": rule}


def road(tags: Column, names_a: tuple[str, ...] = (), names_b: tuple[str, ...] = (), links: dict[str, int] | None = None) -> dict[str, Column]:
    """Class (NULL: no road), direction (1 along, -1 against, 0 both), lanes, group A, B or C (NULL: no motors) and vehicles a day."""
    kind, name = tags["highway"], F.coalesce(tags["name"], F.lit(""))
    cls = F.when(F.coalesce(tags["area"] == "yes", F.lit(False)), F.lit(None).cast("int")).otherwise(_of(kind, ROAD_CLASS))
    way = F.lower(F.coalesce(tags["oneway"], F.lit("")))
    round_ = F.coalesce(tags["junction"].isin("roundabout", "circular"), F.lit(False))
    one = F.when(way.isin("yes", "true", "1"), 1).when(way.isin("-1", "reverse"), -1).when(round_ & (way != "no"), 1).otherwise(0)
    given = F.array_max(F.transform(F.filter(F.split(F.replace(F.coalesce(tags["lanes"], F.lit("")), F.lit(","), F.lit(";")), ";"), lambda x: F.trim(x).rlike("^[0-9]+$")), lambda x: F.trim(x).cast("int")))
    usual = F.coalesce(_of(cls, LANES), F.lit(1))
    lanes = F.when(cls == 5, 0).when(given.isNotNull(), F.greatest(F.lit(1), given)).otherwise(F.when(one != 0, F.greatest(F.lit(1), F.floor(usual / 2).cast("int"))).otherwise(usual))
    group = F.when(cls == 5, F.lit(None).cast("string")).when(name.isin(*names_a) if names_a else F.lit(False), "A").when(name.isin(*names_b) if names_b else F.lit(False), "B").when(cls.isNotNull(), "C")
    each = F.coalesce(_of(name, links) if links else F.lit(None).cast("int"), _of(kind, TRAFFIC), F.lit(TRAFFIC["service"]))
    slip = F.rint(SLIP_SHARE * F.coalesce(_of(F.regexp_replace(kind, "_link$", ""), TRAFFIC), F.lit(TRAFFIC["service"])))
    daily = F.when(cls == 5, 0).when(kind.endswith("_link"), slip).otherwise(F.rint(each * F.when(one != 0, ONE_WAY_SHARE).otherwise(1.0))).cast("int")
    return {"cls": cls, "oneway": one, "lanes": lanes.cast("int"), "grp": group, "daily": F.when(cls.isNotNull(), daily)}


def macdonald(plan: Column, front: Column, height: Column) -> tuple[Column, Column]:
    """Displacement and roughness length from plan and frontal density and mean height; zero without buildings."""
    low = 1 + F.pow(F.lit(MACDONALD_A), -plan) * (plan - 1)
    arg = 0.5 * MACDONALD_BETA * DRAG / KAPPA**2 * (1 - low) * front
    rough = F.when(arg > 0, (1 - low) * F.exp(-1 / F.sqrt(arg))).otherwise(0.0)
    some = (height > 0) & (plan > 0)
    return F.when(some, low * height).otherwise(0.0), F.when(some, rough * height).otherwise(0.0)


def segment_distance(x: Column, z: Column, ax: Column, az: Column, bx: Column, bz: Column) -> Column:
    """Distance of a point from a segment."""
    dx, dz = bx - ax, bz - az
    along = clamp(((x - ax) * dx + (z - az) * dz) / F.coalesce(F.nullif(dx * dx + dz * dz, F.lit(0.0)), F.lit(1e-12)), 0.0, 1.0)
    return F.sqrt(F.pow(x - ax - dx * along, F.lit(2.0)) + F.pow(z - az - dz * along, F.lit(2.0)))


def clipped(x1: Column, z1: Column, x2: Column, z2: Column, box: tuple[float, float, float, float]) -> dict[str, Column]:
    """The part of a segment inside a box (x0, x1, z0, z1), by parameters from and to; no part: from > to."""
    left, right, low, high = box
    start, end = F.lit(0.0), F.lit(1.0)
    for p, q in ((-(x2 - x1), x1 - left), (x2 - x1, right - x1), (-(z2 - z1), z1 - low), (z2 - z1, high - z1)):
        t = q / F.nullif(p, F.lit(0.0))
        start = F.greatest(start, F.when(p < 0, t).when((p == 0) & (q < 0), 2.0).otherwise(0.0))
        end = F.least(end, F.when(p > 0, t).otherwise(1.0))
    return {"start": start, "end": end}


def month_temperature(month: Column) -> Column:
    """Climatological temperature of a month, degrees."""
    return 10.2 + 10.5 * F.cos(2 * math.pi * (month - 7) / 12)


def heating_month(month: Column) -> Column:
    return (month >= 10) | (month <= 3)


def leaf_month(month: Column) -> Column:
    return month.between(5, 10)
