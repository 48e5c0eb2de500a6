"""Repeated query ids, ranked as the SQL ranks them, and bounds at large scores."""

from __future__ import annotations

from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from aerolake.llm import topk


def test_repeated_query_ids(spark):
    r = np.random.default_rng(8)
    ids = [20, 20, 20, 40, *range(1, 17), 1, 2]
    x = r.normal(0, 1, (len(ids), 8)).astype(np.float32)
    x[2] = x[1]
    v = np.floor(64 * x.astype(np.float64)).astype(int)
    want = []
    for q in (20, 40):
        scores = sorted((-int(v[i] @ v[j]), ids[j]) for i in range(len(ids)) for j in range(len(ids)) if ids[i] == q != ids[j])
        want += [(q, n, i, -s) for n, (s, i) in enumerate(scores[:20], 1)]
    table = spark.createDataFrame([(i, a.tolist()) for i, a in zip(ids, x, strict=True)], "vec_id long, embedding array<float>")
    got = topk.top_k(table, F.pmod("vec_id", F.lit(20)) == 0, block=8, chunk=2).collect()
    assert Counter(map(tuple, got)) == Counter(want)


def test_close_large_scores():
    """Scores near 2**23 that differ by little."""
    r = np.random.default_rng(1)
    v = 700 + r.integers(0, 3, (400, 16))
    q = 690 + r.integers(0, 3, (30, 16))
    ids, query_ids = np.arange(400), np.arange(1000, 1030)
    qi, vi, score, _ = topk.Index(ids, v).search(query_ids, q, 5, few=0.5)
    for i in range(30):
        best = sorted((-int(s), int(j)) for j, s in enumerate(v @ q[i]))[:5]
        assert sorted(zip((-score[qi == i]).tolist(), vi[qi == i].tolist(), strict=True)) == best


def test_floors_and_sparse_segments():
    """A floor from elsewhere loses no vector that reaches it; rare impacts lie in lists; the stop comes before the last segment."""
    r = np.random.default_rng(2)
    v = np.floor(64 * (x := r.normal(size=(3000, 64))) / np.linalg.norm(x, axis=1)[:, None]).astype(np.int64)
    q, ids, query_ids = v[:40], np.arange(3000), np.arange(40)
    product = q @ v.T
    product[np.arange(40), np.arange(40)] = -(1 << 40)
    kth = np.sort(product, axis=1)[:, -20]
    index = topk.Index(ids, v)
    assert any(lists is not None for lists, _, _ in index.segments)
    qi, vi, score, read = index.search(query_ids, q, 20, kth)
    assert read < len(index.segments)
    for i in range(40):
        want = sorted(((-product[i, j], j) for j in range(3000)))[:20]
        assert [(-s, j) for s, j in zip(score[qi == i], vi[qi == i])] == want
    qi, vi, score, _ = index.search(query_ids, q, 20)
    assert all((np.sort(score[qi == i]) == np.sort(product[i])[-20:]).all() for i in range(40))
