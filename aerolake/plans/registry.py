"""All queries of the library and their SQL equivalents."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from aerolake.functions import weather
from aerolake.functions.calendar import day_type, rounded
from aerolake.operators import series
from aerolake.plans import archive_queries as kept
from aerolake.plans import calibration_queries as fitted
from aerolake.plans import comparison_queries as compared
from aerolake.plans import emission_queries as emitted
from aerolake.plans import field_queries as gridded
from aerolake.plans import geometry_queries as shaped
from aerolake.plans import lookup_queries as looked_up
from aerolake.plans import physics_queries as physics
from aerolake.plans import queries as own
from aerolake.plans import receptor_queries as received
from aerolake.plans import statistics_queries as archive
from aerolake.plans import summary_queries as more
from aerolake.sources.tables import table


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Increment of one series over another by wind sector and day type."""
    hours = series.hourly(table(spark, sf_dir, "events"), "event_type", "ts", "value")
    pairs = series.paired_increment(hours, "purchase", "view")
    rows = pairs.select("inc", weather.rose_sector(F.col("u") * 7.3, F.col("u")).alias("sector"), day_type(F.col("t")).alias("daytype"))
    return rows.groupBy("sector", "daytype").agg(F.count("*").alias("n"), rounded(F.avg("inc"), 3).alias("mean_inc"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return own.QUERIES | more.QUERIES | physics.QUERIES | archive.QUERIES | emitted.QUERIES | fitted.QUERIES | received.QUERIES | looked_up.QUERIES | shaped.QUERIES | kept.QUERIES | gridded.QUERIES | compared.QUERIES


def oracle_sql() -> dict[str, str]:
    return own.ORACLES | more.ORACLES | physics.ORACLES | archive.ORACLES | emitted.ORACLES | fitted.ORACLES | received.ORACLES | looked_up.ORACLES | shaped.ORACLES | kept.ORACLES | gridded.ORACLES | compared.ORACLES
