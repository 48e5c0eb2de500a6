"""Scans of small files in the shapes of the original payloads."""

from __future__ import annotations

import datetime as dt
import gzip
import json

from aerolake.sources import tables


def test_long_and_wide_csv(spark, tmp_path):
    with gzip.open(tmp_path / "long.csv.gz", "wt") as f:
        f.write("t_utc_end,station,param,value,unit,validated\n2025-03-30T00:00Z,1,no2,12.5,ug/m3,1\n2025-03-30T01:00Z,1,no2,-999,ug/m3,0\n2025-03-30T02:00Z,2,no2,NaN,ug/m3,0\n2025-03-31T02:00Z,9,no2,1,ug/m3,0\n")
    rows = tables.long_csv(spark, str(tmp_path / "long.csv.gz"))
    assert [r.value for r in rows.orderBy("t_utc_end").collect()] == [12.5, None, None, 1.0]
    assert rows.orderBy("t_utc_end").first().t_utc_end == dt.datetime(2025, 3, 30)
    inside = tables.between(rows, "2025-03-30T01:00:00Z", "2025-03-30T02:00:00Z").collect()
    assert len(inside) == 2
    known = tables.stations(rows, {1: "road", 2: "park"}).collect()
    assert sorted({r.key for r in known}) == ["park.no2", "road.no2"] and len(known) == 3
    with gzip.open(tmp_path / "wide.csv.gz", "wt") as f:
        f.write("t_utc_end,u10,wd10,blh,t2,cc,sw\n2025-01-01T00:00Z,1.5,270,,3.0,50,0\n")
    row = tables.wide_csv(spark, str(tmp_path / "wide.csv.gz")).first()
    assert (row.t_utc_end, row.u10, row.blh) == (dt.datetime(2025, 1, 1), 1.5, None)


def test_daily_csv_and_missing_file(spark, tmp_path):
    assert tables.daily_csv(spark, str(tmp_path / "none.csv")).count() == 0
    (tmp_path / "d.csv").write_text("date_local,station,param,value,unit,validated\n2025-01-01,1,pm10,51.2,ug/m3,1\n")
    row = tables.daily_csv(spark, str(tmp_path / "d.csv")).first()
    assert (row.date_local, row.value) == (dt.date(2025, 1, 1), 51.2)


def test_json_shapes(spark, tmp_path):
    flat = [{"vrijednost": "12,5", "mjernaJedinica": "µg/m3", "vrijeme": "1735693200000"}, {"vrijednost": "-999", "mjernaJedinica": "µg/m3", "vrijeme": "1735696800000"}]
    (tmp_path / "flat.json").write_text(json.dumps(flat))
    (tmp_path / "old.json").write_text(json.dumps([{"Podatak": flat[0]}]))
    got = tables.station_json(spark, str(tmp_path / "flat.json")).orderBy("t").collect()
    assert [r.v for r in got] == [12.5, None] and got[0].t == dt.datetime(2025, 1, 1, 1)
    assert tables.station_json(spark, str(tmp_path / "old.json")).first().v == 12.5
    (tmp_path / "h.json").write_text(json.dumps({"hourly": {"time": ["2025-01-01T00:00", "2025-01-01T01:00"], "wind_speed_10m": [1.0, None]}}))
    rows = tables.hourly_json(spark, str(tmp_path / "h.json"), ["wind_speed_10m"]).orderBy("time").collect()
    assert [(r.time.hour, r.wind_speed_10m) for r in rows] == [(0, 1.0), (1, None)]
    (tmp_path / "a.json").write_text(json.dumps({"t_ms": [0, 3600000, 7200000], "v": [1.5, -999.0, None]}))
    assert [r.v for r in tables.array_json(spark, str(tmp_path / "a.json")).collect()] == [1.5]
