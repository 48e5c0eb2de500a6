"""completeness_all_years covers every year of its table."""

import datetime as dt

from aerolake.plans import registry


def test_years_outside_the_nineties(spark, tmp_path):
    rows = [("O", dt.date(1991, 5, 1), 1.0), ("O", dt.date(1992, 5, 1), 1.0), ("F", dt.date(2024, 5, 1), 1.0), ("F", dt.date(2024, 6, 1), None)]
    spark.createDataFrame(rows, "o_orderstatus string, o_orderdate date, o_totalprice double").write.parquet(f"{tmp_path}/orders.parquet")
    got = registry.queries()["completeness_all_years"](spark, str(tmp_path)).collect()
    assert sorted((r.key, r.year, r.n, r.expected) for r in got) == [("F", 2024, 1, 8784), ("O", 1991, 1, 8760), ("O", 1992, 1, 8784)]
