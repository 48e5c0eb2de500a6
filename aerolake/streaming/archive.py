"""An archive that is refreshed chunk by chunk: what to fetch, how batches merge, which series is published, what is refused.

A reading is (key, t, v, validated, fetched): t the end of the hour in UTC, validated 0 or 1, fetched when it was downloaded. Of readings of the
same (key, t, validated) the one fetched last counts, so what the archive holds depends on the set of readings that ever came in, not on
batches, their order or their repetition: a replay changes nothing, and a run after late and revised rows equals a rebuild.

Below one folder: ``readings`` and ``series``, partitioned by the local year of the hour's start, and ``chunks``, the manifest. A batch
rewrites only the years it touches. Each write is a job of its own that replaces whole partitions; a run that is lost between two
of them leaves readings that the next run of the same batch merges again.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from aerolake.functions.calendar import local_midnight, local_start
from aerolake.functions.dimensions import ZONE
from aerolake.sources import sinks
from aerolake.sources.intermediate import discard, materialise
from aerolake.sources.tables import missing

# Days of a chunk; days after which a chunk is final; hours before an unfinished chunk is fetched again; validated share of raw rows; years that validated data may take; largest sentinel.
CHUNK_DAYS, SETTLE_DAYS, MIN_AGE_H, VALIDATED_SHARE, LOOKBACK_YEARS, SENTINEL = 40, 60, 6.0, 0.5, 2, -900.0
READING = "key string, t timestamp_ntz, v double, validated int, fetched timestamp_ntz"


def year_of(t: str = "t") -> Column:
    """Local year of the start of the hour that ends at t."""
    return F.year(local_start(F.col(t)))


def plan_chunks(spans: DataFrame, max_days: int = CHUNK_DAYS) -> DataFrame:
    """(key, first, last): the calendar months of each span (key, first, last), both days included, clipped to it; a piece of more than
    ``max_days`` is cut into equal parts. Months keep chunks the same from run to run."""
    if max_days < 1:
        raise ValueError("max_days must be at least 1")
    months = spans.filter(F.col("first") <= F.col("last")).select("key", "first", "last", F.explode(F.sequence(F.trunc("first", "month"), F.col("last"), F.expr("INTERVAL 1 MONTH"))).alias("m"))
    pieces = months.select("key", F.greatest("first", F.col("m").cast("date")).alias("a"), F.least("last", F.last_day("m")).alias("b"))
    days = F.datediff("b", "a") + 1
    size = F.ceil(days / F.ceil(days / max_days)).cast("int")
    starts = pieces.withColumn("size", size).withColumn("k", F.explode(F.sequence(F.lit(0), F.floor((days - 1) / size).cast("int"))))
    first = F.date_add("a", F.col("k") * F.col("size"))
    return starts.select("key", first.alias("first"), F.least(F.date_add(first, F.col("size") - 1), F.col("b")).alias("last"))


def expected_hours(now: Column) -> Column:
    """Hours of the local days first to last that have ended by ``now`` (UTC)."""
    at = lambda day: F.unix_timestamp(local_midnight(day))
    end = F.least(at(F.date_add("last", 1)), F.floor(F.unix_timestamp(now.cast("timestamp")) / 3600) * 3600)
    return F.greatest(F.lit(0), F.floor((end - at(F.col("first"))) / 3600)).cast("long")


def _local_day(t: Column) -> Column:
    return F.to_date(F.from_utc_timestamp(t.cast("timestamp"), ZONE))


def final(fetched: Column, settle_days: int = SETTLE_DAYS) -> Column:
    """Whether a chunk was fetched at least ``settle_days`` after its last local day."""
    return F.col("last") < F.date_sub(_local_day(fetched), settle_days)


def _age(now: Column) -> Column:
    return (F.unix_timestamp(now.cast("timestamp")) - F.unix_timestamp(F.col("fetched").cast("timestamp"))) / 3600


def raw_due(chunks: DataFrame, manifest: DataFrame, now: Column, settle_days: int = SETTLE_DAYS, min_age_h: float = MIN_AGE_H) -> DataFrame:
    """The chunks (key, first, last) to fetch: those that the manifest (key, first, last, rows, fetched) does not have, and unfinished ones of some age."""
    met = chunks.join(manifest, ["key", "first", "last"], "left")
    stale = ~final(F.col("fetched"), settle_days) & (_age(now) >= min_age_h)
    return met.filter(F.col("fetched").isNull() | stale).select("key", "first", "last")


def validated_due(chunks: DataFrame, manifest: DataFrame, now: Column, lookback: int = LOOKBACK_YEARS, min_age_h: float = MIN_AGE_H, share: float = VALIDATED_SHARE) -> DataFrame:
    """The chunks of validated data to fetch, year by year; only years that have ended have any.

    A year whose chunks are all known, with ``share`` of the expected hours, is complete: nothing. Otherwise an old year needs its unknown
    chunks, and a recent one is probed by its last chunk: fetched while unknown, or short and of some age; once that holds
    ``share`` of its hours the year is published, and all other chunks that are unknown or empty are due.
    """
    met = chunks.join(manifest, ["key", "first", "last"], "left").withColumns({"year": F.year("first"), "expected": expected_hours(now), "known": F.col("fetched").isNotNull(), "age": _age(now)})
    today = F.year(_local_day(now))
    met = met.filter(F.col("year") < today)
    probe = F.max_by(F.struct("first", "known", F.coalesce("rows", F.lit(0)).alias("rows"), "expected", "age"), "first")
    years = met.groupBy("key", "year").agg(F.min("known").alias("all"), F.sum(F.coalesce("rows", F.lit(0))).alias("got"), F.sum("expected").alias("want"), probe.alias("probe"))
    judged = met.join(years, ["key", "year"]).filter(~(F.col("all") & (F.col("got") >= share * F.col("want"))))
    recent = F.col("year") >= today - lookback
    is_probe, need = F.col("first") == F.col("probe.first"), share * F.col("probe.expected")
    published = F.col("probe.known") & (F.col("probe.rows") >= need)
    asked = ~F.col("probe.known") | ((F.col("probe.rows") < need) & (F.col("probe.age") >= min_age_h))
    empty = ~F.col("known") | (F.coalesce("rows", F.lit(0)) == 0)
    due = F.when(~recent, ~F.col("known")).when(is_probe, asked).otherwise(published & empty)
    return judged.filter(due).select("key", "first", "last")


def newest(readings: DataFrame) -> DataFrame:
    """One reading of each (key, t, validated): the one fetched last, of equals the larger value."""
    best = readings.groupBy("key", "t", "validated").agg(F.max(F.struct("fetched", "v")).alias("b"))
    return best.select("key", "t", "b.v", "validated", "b.fetched")


def published(readings: DataFrame) -> DataFrame:
    """(key, year, t, v, source): in each local year the validated readings, if there are ``VALIDATED_SHARE`` as many as raw ones, sentinels
    counted; else the raw ones. Sentinels of the chosen kind are left out, never replaced."""
    rows = readings.withColumn("year", year_of())
    n1, n0 = F.count_if(F.col("validated") == 1), F.count_if(F.col("validated") == 0)
    chosen = rows.groupBy("key", "year").agg(F.when((n1 > 0) & (n1 >= VALIDATED_SHARE * n0), 1).otherwise(0).alias("validated"))
    kept = rows.join(chosen, ["key", "year", "validated"], "left_semi").filter(F.col("v") > SENTINEL)
    return kept.select("key", "year", "t", "v", F.when(F.col("validated") == 1, "validated").otherwise("raw").alias("source"))


class ShrinkError(ValueError):
    """Raised when a batch would publish far fewer hours of a series-year from an unchanged source."""


class Archive:
    """The archive below ``folder``."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def _read(self, name: str, schema: str) -> DataFrame:
        path = f"{self.folder}/{name}"
        return self.spark.createDataFrame([], schema) if missing(self.spark, path) else self.spark.read.schema(schema).parquet(path)

    def readings(self) -> DataFrame:
        return self._read("readings", f"{READING}, year int")

    def series(self) -> DataFrame:
        return self._read("series", "key string, t timestamp_ntz, v double, source string, year int")

    def manifest(self) -> DataFrame:
        """(key, first, last, rows, fetched) of what was fetched last of each chunk."""
        rows = self._read("chunks", "key string, first date, last date, rows long, fetched timestamp_ntz, year int")
        return rows.groupBy("key", "first", "last").agg(F.max(F.struct("fetched", "rows")).alias("b")).select("key", "first", "last", "b.rows", "b.fetched")

    def _replace(self, rows: DataFrame, name: str) -> None:
        rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("year").parquet(f"{self.folder}/{name}")

    def merge(self, batch: DataFrame, most: int = 48) -> None:
        """Merge readings. A series-year that would lose more than ``most`` hours from an unchanged source raises ShrinkError before anything is written."""
        names = [f.split()[0] for f in READING.split(", ")]
        new = materialise(newest(batch.select(*names)).withColumn("year", year_of()), "batch")
        years = [r.year for r in new.select("year").distinct().collect()]  # a row a year
        if not years:
            return
        held = self.readings().filter(F.col("year").isin(*years)).select(*names)
        merged = materialise(newest(held.union(new.select(*names))).withColumn("year", year_of()), "merged")
        out = materialise(published(merged.select(*names)).select("key", "t", "v", "source", "year"), "published")
        lost = sinks.shrinking(out, self.series().filter(F.col("year").isin(*years)), most).limit(5).collect()
        if lost:
            raise ShrinkError(", ".join(f"{r.key} {r.year}: {r.before} to {r.after} hours" for r in lost))
        self._replace(merged, "readings")
        self._replace(out, "series")
        for df in (new, merged, out):
            discard(df)

    def record(self, chunks: DataFrame) -> None:
        """Note chunks (key, first, last, rows, fetched) as fetched; earlier notes of a chunk stay until a newer one of its year is written."""
        new = chunks.select("key", "first", "last", F.col("rows").cast("long").alias("rows"), "fetched", F.year("first").alias("year"))
        years = [r.year for r in new.select("year").distinct().collect()]
        if years:
            held = self._read("chunks", "key string, first date, last date, rows long, fetched timestamp_ntz, year int").filter(F.col("year").isin(*years))
            every = held.unionByName(new).groupBy("key", "first", "last", "year").agg(F.max(F.struct("fetched", "rows")).alias("b"))
            both = materialise(every.select("key", "first", "last", "b.rows", "b.fetched", "year"), "chunks")
            self._replace(both, "chunks")
            discard(both)

    def stream(self, readings: DataFrame, checkpoint: str, **trigger):  # noqa: ANN201
        """Merge a stream of readings batch by batch; a batch that is run again changes nothing."""
        return readings.writeStream.foreachBatch(lambda batch, _: self.merge(batch)).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def series_plan(stations: DataFrame, parameters: DataFrame, wanted: list[str] | None = None) -> DataFrame:
    """(station, param, code, station_place, param_place): which series a run fetches, every station with the parameters that name its prefix, in configured order.

    stations: (station, prefix, place); parameters: (param, code, place, prefixes array). ``wanted`` restricts the parameters.
    """
    some = parameters if wanted is None else parameters.filter(F.col("param").isin(*wanted))
    each = some.select("param", "code", F.col("place").alias("param_place"), F.explode("prefixes").alias("prefix"))
    return stations.withColumnRenamed("place", "station_place").join(each, "prefix").select("station", "param", "code", "station_place", "param_place")


def offered(series: DataFrame, capabilities: DataFrame | None) -> DataFrame:
    """The rows of (station, code, type, ...) that a station offers by ``capabilities`` (station, code, type); all of them where those are unknown."""
    return series if capabilities is None else series.join(capabilities.select("station", "code", "type").distinct(), ["station", "code", "type"], "left_semi")


def daily_rows(readings: DataFrame) -> DataFrame:
    """(day, station, param, v, validated): daily readings under the local date of their stamp, which is the start of the day; sentinels left out; of a day read twice the last fetched."""
    rows = readings.filter(F.col("v").isNotNull() & (F.col("v") > SENTINEL)).withColumn("day", _local_day(F.col("t")))
    return rows.groupBy("day", "station", "param", "validated").agg(F.max_by("v", "fetched").alias("v")).select("day", "station", "param", "v", "validated")


def daily_reference(previous: DataFrame, fetched: DataFrame, today: Column, complete: float) -> DataFrame:
    """(day, station, param, v, validated): for each series and year what was held before, if the year has ended and ``complete`` of its days were validated then;
    else the validated days fetched, or where there are none, the raw ones. Series and years that nothing was fetched of keep what they had."""
    by = ["station", "param", "year"]
    old = previous.withColumn("year", F.year("day"))
    days = F.dayofyear(F.make_date(F.col("year"), F.lit(12), F.lit(31)))
    final_years = old.groupBy(*by).agg(F.sum("validated").alias("n")).filter((F.col("year") < F.year(today)) & (F.col("n") >= complete * days)).select(*by)
    new = fetched.withColumn("year", F.year("day")).join(final_years, by, "left_anti")
    kind = new.groupBy(*by).agg(F.max("validated").alias("validated"))
    kept = old.join(kind.select(*by), by, "left_anti")
    return kept.unionByName(new.join(kind, [*by, "validated"], "left_semi")).select("day", "station", "param", "v", "validated")
