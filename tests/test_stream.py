"""The hourly stream with late rows: within the watermark they count, behind it they no longer change a result."""

from __future__ import annotations

import datetime as dt

from aerolake.streaming.refresh import hourly_stream, upsert_partitions


def test_late_rows(spark, tmp_path):
    source = str(tmp_path / "in")
    at = lambda h, m=0: dt.datetime(2025, 1, 1) + dt.timedelta(hours=h, minutes=m)
    batches = [[("a", at(0, 10), 1.0), ("a", at(0, 20), 3.0)], [("a", at(9), 5.0)], [("a", at(8, 30), 7.0), ("a", at(0, 30), 100.0)], [("a", at(40), 0.0)], [("a", at(41), 0.0)]]
    schema = "key string, ts timestamp, v double"
    spark.createDataFrame([], schema).write.parquet(source)
    stream = spark.readStream.schema(schema).parquet(source)
    hours = hourly_stream(stream, "key", "ts", "v", "2 hours")
    assert stream.isStreaming
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(source)
        query = hours.writeStream.format("parquet").outputMode("append").option("checkpointLocation", str(tmp_path / "state")).option("path", str(tmp_path / "out")).trigger(availableNow=True).start()
        query.awaitTermination(120)
    got = {r.t: (r.v, r.n) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert got[at(1)] == (2.0, 2)  # the row of 0:30 came behind the watermark
    assert got[at(9)] == (7.0, 1) and got[at(10)] == (5.0, 1)  # 8:30 came late, but within it


def test_replayed_batch_changes_nothing(spark, tmp_path):
    write = upsert_partitions(str(tmp_path / "table"), "day")
    old = spark.createDataFrame([(1, 1.0), (2, 2.0)], "day int, v double")
    new = spark.createDataFrame([(2, 5.0), (2, 6.0)], "day int, v double")
    for _ in range(2):
        write(old, 0)
        write(new, 1)
        write(new, 1)
    assert sorted((r.day, r.v) for r in spark.read.parquet(str(tmp_path / "table")).collect()) == [(1, 1.0), (2, 5.0), (2, 6.0)]
