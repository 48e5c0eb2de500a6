"""The pipeline's stages on small tables: each against a plain version of what it must keep and change."""

from __future__ import annotations

from collections import Counter

import brute
import corpus_pipeline
import pytest

from aerolake.llm.quality import quality

STAGES = dict(corpus_pipeline.STAGES)


@pytest.fixture(params=["small", "sf"])
def docs(request, spark, small):
    return spark.read.parquet(f"{small if request.param == 'small' else '/root/testdata/sf0.001'}/documents.parquet")


def rows(df) -> Counter:
    return Counter(map(tuple, df.collect()))


def test_stage_names():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality rules", "SimHash near-dedup", "PII", "mixing sources to target weights", "byte-level BPE"]


def test_quality_stage(spark, docs):
    got = STAGES["quality rules"](spark, docs, "")
    assert got.columns == docs.columns
    kept = rows(got)
    assert not kept - rows(docs)
    assert sum(kept.values()) == quality(docs).filter("kept").count()
    assert all(not brute.quality(r.text or "")[-1] for r in got.collect())


def test_dedup_stage(spark, docs):
    got = STAGES["SimHash near-dedup"](spark, docs, "")
    assert got.columns == docs.columns and not rows(got) - rows(docs)
    table = [(r.doc_id, r.text or "") for r in docs.collect()]
    comps = brute.component_ids([i for i, _ in table], [brute.fingerprint(t) for _, t in table])
    assert Counter(r.doc_id for r in got.collect()) == Counter(set(comps))


def test_pii_stage(spark, docs):
    got = STAGES["PII"](spark, docs, "")
    assert got.columns == docs.columns
    assert Counter(r.doc_id for r in got.collect()) == Counter(r.doc_id for r in docs.collect())
    for r in got.collect():
        assert not [s for s in brute.base_spans(r.text or "") if s[0] == "email"]
        assert r.text is None or r.n_chars == len(r.text)


def test_mix_stage(spark, docs):
    got = STAGES["mixing sources to target weights"](spark, docs, "")
    assert got.columns == docs.columns
    most = rows(docs)
    assert all(n <= 2 * most[r] for r, n in rows(got).items())


def test_run(spark, tmp_path, small, empty):
    got = corpus_pipeline.run(spark, small)
    assert got.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
    assert 0 < got.count()
    assert corpus_pipeline.run(spark, empty).count() == 0
