"""Near-duplicate stage where doc_ids cannot tell components apart."""

from __future__ import annotations

import corpus_pipeline
from conftest import prose


def test_null_and_repeated_ids(spark):
    """Unrelated texts stay, whatever their ids; copies of them go."""
    rows = [(None, prose(80, s)) for s in range(5)] + [(None, prose(80, 0))]
    rows += [(7, prose(80, 20)), (7, prose(80, 21)), (9, prose(80, 21)), (None, prose(80, 21))]
    got = dict(corpus_pipeline.STAGES)["SimHash near-dedup"](spark, spark.createDataFrame(rows, "doc_id long, text string"), "").collect()
    assert sorted(((r.doc_id or 0, r.text) for r in got)) == sorted([*((0, prose(80, s)) for s in range(5)), (7, prose(80, 20)), (7, prose(80, 21))])
