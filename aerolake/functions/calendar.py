"""Local calendar of hour-ending instants: the local hour, day and year are those of the hour's start."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from aerolake.functions.dimensions import ZONE


def local_start(t: Column, zone: str = ZONE) -> Column:
    """Local wall clock at the start of the hour that ends at t (UTC)."""
    return F.from_utc_timestamp(t.cast("timestamp") - F.expr("INTERVAL 1 HOUR"), zone)


def day_type(t: Column) -> Column:
    """weekday, saturday or sunday, without holidays."""
    d = F.weekday(t)
    return F.when(d == 6, "sunday").when(d == 5, "saturday").otherwise("weekday")


def rounded(x: Column, digits: int = 6) -> Column:
    """Round with an offset of 1e-9, far below the digits kept, so that ties break alike in other engines."""
    return F.round(x + F.lit(1e-9), digits)


def half_even(x: Column, digits: int) -> Column:
    """Round to digits after the point, halves to the even neighbour."""
    return F.rint(x * 10.0**digits) / 10.0**digits


def local_midnight(day: Column, zone: str = ZONE) -> Column:
    """UTC instant of the start of a local day."""
    return F.to_utc_timestamp(day.cast("timestamp"), zone)


def hours_in_local_day(day: Column, zone: str = ZONE) -> Column:
    """23, 24 or 25."""
    seconds = lambda d: F.unix_timestamp(local_midnight(d, zone))
    return ((seconds(F.date_add(day, 1)) - seconds(day)) / 3600).cast("int")


def last_sunday(year: Column, month: int) -> Column:
    end = F.last_day(F.make_date(year, F.lit(month), F.lit(1)))
    return F.date_sub(end, (F.weekday(end) + 1) % 7)


def from_local(day: Column, hour: Column, zone: str = ZONE) -> Column:
    """UTC instant at which a local wall-clock hour 1 to 24 ends; an hour that the spring switch leaves out gives NULL."""
    wall = F.timestamp_seconds(F.unix_timestamp(day.cast("timestamp")) + hour * 3600)
    out = F.to_utc_timestamp(wall, zone)
    return F.when(F.from_utc_timestamp(out, zone) == wall, out)


def utc_month(t: Column) -> Column:
    """yyyymm of the hour's start in UTC."""
    start = t.cast("timestamp") - F.expr("INTERVAL 1 HOUR")
    return F.year(start) * 100 + F.month(start)


# Holidays (month, day) of every year; days after Easter Sunday.
HOLIDAYS = ((1, 1), (1, 6), (5, 1), (5, 30), (6, 22), (8, 5), (8, 15), (11, 1), (11, 18), (12, 25), (12, 26))
AFTER_EASTER = (1, 60)


def easter(year: Column) -> Column:
    """Date of Easter Sunday in the Gregorian calendar (Gauss's rule with the lunar corrections of the century)."""
    over = lambda a, b: F.floor(a / b)
    century = over(year, 100)
    lunar = F.pmod(15 + century - over(century, 4) - over(8 * century + 13, 25), F.lit(30))
    solar = F.pmod(4 + century - over(century, 4), F.lit(7))
    golden = year % 19
    moon = (19 * golden + lunar) % 30
    sunday = (2 * (year % 4) + 4 * (year % 7) + 6 * moon + solar) % 7
    late = ((moon == 29) & (sunday == 6)) | ((moon == 28) & (sunday == 6) & (golden > 10))
    return F.date_add(F.make_date(year, F.lit(3), F.lit(22)), (moon + sunday - F.when(late, 7).otherwise(0)).cast("int"))


def is_holiday(day: Column) -> Column:
    fixed = (F.month(day) * 100 + F.dayofmonth(day)).isin(*(m * 100 + d for m, d in HOLIDAYS))
    moved = F.datediff(day, easter(F.year(day))).isin(*AFTER_EASTER)
    return fixed | moved


def day_type_with_holidays(day: Column) -> Column:
    """As day_type, holidays counting as sundays."""
    return F.when(is_holiday(day), "sunday").otherwise(day_type(day))


def hours_in_local_year(year: Column, zone: str = ZONE) -> Column:
    start = lambda y: F.unix_timestamp(F.to_utc_timestamp(F.make_timestamp(y, F.lit(1), F.lit(1), F.lit(0), F.lit(0), F.lit(0)), zone))
    return ((start(year + 1) - start(year)) / 3600).cast("int")


def hour_label(t: Column, zone: str = ZONE) -> Column:
    """Local date and end of the hour, 01:00 to 24:00."""
    start = local_start(t, zone)
    return F.concat(F.date_format(start, "dd.MM.yyyy "), F.lpad((F.hour(start) + 1).cast("string"), 2, "0"), F.lit(":00"))
