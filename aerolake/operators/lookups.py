"""Cascades, climatologies, windows and rankings over hourly tables and map features."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from aerolake.operators.series import local_columns
from aerolake.sources.intermediate import in_parts, materialise


def cascade(sources: list[tuple[str, DataFrame]], *on: str) -> DataFrame:
    """Whole rows of the first source that has the key, with the source's name: one aggregate instead of a join a source."""
    every = None
    for place, (name, rows) in enumerate(sources):
        one = rows.withColumns({"_place": F.lit(place), "source": F.lit(name)})
        every = one if every is None else every.unionByName(one)
    best = every.groupBy(*on).agg(F.min_by(F.struct(*(c for c in every.columns if c not in on and c != "_place")), "_place").alias("_b"))
    return best.select(*on, "_b.*")


def climatology(series: DataFrame, holidays: bool = True) -> DataFrame:
    """(key, daytype, hour, v): means by day type and local hour."""
    return local_columns(series, holidays).groupBy("key", "daytype", "hour").agg(F.avg("v").alias("v"))


def filled(grid: DataFrame, series: DataFrame, normal: DataFrame) -> DataFrame:
    """(key, t, v, source) for every row of ``grid`` (key, t): the value, else its climatology's, else none."""
    known = grid.join(series, ["key", "t"], "left")
    rows = local_columns(known, holidays=True).join(normal.withColumnRenamed("v", "_n"), ["key", "daytype", "hour"], "left")
    source = F.when(F.col("v").isNotNull(), "value").when(F.col("_n").isNotNull(), "climatology").otherwise("none")
    return rows.select("key", "t", F.coalesce("v", "_n").alias("v"), source.alias("source"))


def valid_lines(lines: DataFrame, years: DataFrame, *kinds: str) -> DataFrame:
    """Threshold lines (kind, v, since, until) valid in each of ``years`` (year), numbered by value."""
    some = lines.filter(F.col("kind").isin(*kinds)) if kinds else lines
    valid = (F.col("since").isNull() | (F.col("year") >= F.col("since"))) & (F.col("until").isNull() | (F.col("year") <= F.col("until")))
    met = years.join(F.broadcast(some), valid)  # a handful of lines
    return met.withColumn("place", F.row_number().over(Window.partitionBy("year").orderBy("v", "kind")))


def hour_index(t: Column, first: Column, n: int) -> Column:
    """Place of a time in an hourly series of n from ``first``; -1 outside."""
    at = F.round((F.unix_timestamp(t.cast("timestamp")) - F.unix_timestamp(first.cast("timestamp"))) / 3600).cast("int")
    return F.when((at >= 0) & (at < n), at).otherwise(-1)


def last_hours(series: DataFrame, hours: int) -> DataFrame:
    """Known values of each key in the ``hours`` up to the newest hour of any key."""
    end = series.agg(F.max("t").alias("_end"))
    inside = series.join(F.broadcast(end), F.lit(True)).filter(F.col("v").isNotNull() & (F.col("t") > F.col("_end") - F.expr(f"INTERVAL {hours} HOURS")))  # one row
    return inside.drop("_end")


def preset(series: DataFrame, month: int, weekday: int, hour: int) -> DataFrame:
    """(key, t): end of the local hour that starts at ``hour`` on the latest day of the month and weekday (0: Monday) in the archive."""
    rows = local_columns(series).filter((F.col("month") == month) & (F.weekday("day") == weekday) & (F.col("hour") == hour))
    return rows.groupBy("key").agg(F.max("t").alias("t"))


def longest(vertices: DataFrame) -> DataFrame:
    """(name, id, length): the longest polyline of each name, vertices (name, id, n, x, z); ties to the smaller id."""
    order = Window.partitionBy("name", "id").orderBy("n", "x", "z")
    step = F.sqrt(F.pow(F.col("x") - F.lag("x").over(order), F.lit(2.0)) + F.pow(F.col("z") - F.lag("z").over(order), F.lit(2.0)))
    lengths = in_parts(vertices, "name", "id").withColumn("_d", step).groupBy("name", "id").agg(F.round(F.sum("_d"), 6).alias("length"))
    best = lengths.groupBy("name").agg(F.max(F.struct("length", (-F.col("id")).alias("id"))).alias("b"))
    return best.select("name", (-F.col("b.id")).alias("id"), F.col("b.length").alias("length"))


def ranked(rows: DataFrame, name: str, order: list[str], *by: str) -> DataFrame:
    """rows with their place, from 1, within each group: rows are sorted over all tasks, and a task's places start where those of the tasks before end, so that a large group is ordered by many."""
    spread = materialise(rows.repartitionByRange(*by, *order).withColumn("_part", F.spark_partition_id()), "ranked")
    counts = spread.groupBy(*by, "_part").agg(F.count("*").alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.partitionBy(*by).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = counts.withColumn("_start", before).drop("_n")  # a row a group and task
    inside = F.row_number().over(Window.partitionBy("_part", *by).orderBy(*order))
    met = spread.withColumn("_i", inside).join(starts, ["_part", *by])
    return met.select(*rows.columns, (F.col("_start") + F.col("_i")).cast("int").alias(name))


def along_wind(points: DataFrame, direction: float, *by: str) -> DataFrame:
    """Points (id, x, z) with ``along``, the way downwind, and ``place`` in that order within each group."""
    a = math.radians(direction)
    way = F.col("x") * -math.sin(a) + F.col("z") * math.cos(a)
    return ranked(points.withColumn("along", way), "place", ["along", "id"], *by)


def dominant(rows: DataFrame, weight: str, name: str, *by: str) -> DataFrame:
    """The name of the largest total weight in each group, its share, ties to the smaller name."""
    sums = rows.groupBy(*by, name).agg(F.sum(weight).alias("_w"))
    best = sums.groupBy(*by).agg(F.min(F.struct((-F.round("_w", 9)).alias("w"), F.col(name).alias("n"))).alias("b"), F.sum("_w").alias("_all"))
    return best.select(*by, F.col("b.n").alias(name), (-F.col("b.w") / F.nullif(F.col("_all"), F.lit(0.0))).alias("share"))


def tile_weights(tiles: DataFrame, most: float = 3.0) -> DataFrame:
    """Tiles (id, area, living) with ``w``: living space per area against the mean of all, at most ``most``."""
    mean = tiles.agg((F.sum("living") / F.sum("area")).alias("_mean"))
    return tiles.join(F.broadcast(mean), F.lit(True)).withColumn("w", F.least(F.lit(most), F.col("living") / F.col("area") / F.col("_mean"))).drop("_mean")  # one row


def one_a_cell(points: DataFrame, size: float, *by: str) -> DataFrame:
    """The point of least id of each kind and cell."""
    cell = [F.floor(F.col("x") / size).alias("_i"), F.floor(F.col("z") / size).alias("_j")]
    best = points.groupBy(*by, *cell).agg(F.min_by(F.struct(*(c for c in points.columns if c not in by)), "id").alias("_b"))
    return best.select(*by, "_b.*")


def covered_less(buildings: DataFrame, cover: DataFrame, share: float = 0.5) -> DataFrame:
    """(id, covered) of the buildings, given by their cells (id, i, j), of which less than ``share`` are in ``cover`` (i, j)."""
    met = buildings.join(cover.select("i", "j").distinct().withColumn("_c", F.lit(1)), ["i", "j"], "left")
    return met.groupBy("id").agg(F.avg(F.coalesce("_c", F.lit(0))).alias("covered")).filter(F.col("covered") < share)


def by_distance(trees: DataFrame, near: DataFrame, remove: float, prune: float) -> DataFrame:
    """(id, d, fate) of trees: removed, pruned or kept by the least distance in ``near`` (a_id, d) of pairs with new buildings."""
    least = near.groupBy(F.col("a_id").alias("id")).agg(F.min("d").alias("d"))
    fate = F.when(F.col("d") < remove, "remove").when(F.col("d") < prune, "prune").otherwise("keep")
    return trees.select("id").join(least, "id", "left").select("id", "d", fate.alias("fate"))
