"""Nearest neighbours: recall against brute force, exact scores, defined cases, groups of copies, and the test that abandons candidates."""

from __future__ import annotations

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from aerolake.llm import ann
from tests.llm.conftest import embedding_rows


def product(a, b) -> float:
    total = 0.0
    for i in range(max(len(a), len(b))):
        total += (a[i] if i < len(a) else 0.0) * (b[i] if i < len(b) else 0.0)
    return total


def brute(ids, vectors, k=20, every=20):
    ok = [(i, v) for i, v in zip(ids, vectors, strict=True) if i is not None and v and all(x is not None and math.isfinite(x) for x in v) and any(v)]
    for q, a in ok:
        if q % every == 0:
            yield q, sorted((-product(a, b), i) for i, b in ok if i != q)[:k]


def table(spark, ids, vectors):
    return spark.createDataFrame([(i, None if v is None else [None if x is None else float(x) for x in v]) for i, v in zip(ids, vectors, strict=True)], "vec_id long, embedding array<float>")


def search(spark, ids, vectors, **args):
    got: dict = {}
    rows = ann.nearest(table(spark, ids, vectors), F.pmod("vec_id", F.lit(20)) == 0, **args).collect()
    for r in sorted(rows, key=lambda r: (r.query_id, r["rank"])):
        got.setdefault(r.query_id, []).append((r["rank"], -r.score, r.vec_id))
    return got


def test_defined_cases(spark, small):
    rows = embedding_rows()
    f32 = [None if v is None else [None if x is None else float(np.float32(x)) for x in v] for v in rows["embedding"]]
    want = dict(brute(rows["vec_id"], f32))
    got: dict = {}
    for r in ann.op11_ann(spark, small).collect():
        got.setdefault(r.query_id, []).append((r["rank"], -r.score, r.vec_id))
    assert set(got) == set(want)
    scores = {q: {i: s for s, i in sorted((-product(a, b), i) for i, b in zip(rows["vec_id"], f32) if i is not None and b and all(x is not None and math.isfinite(x) for x in b))} for q, a in zip(rows["vec_id"], f32) if q in want}
    hits = 0
    for q, found in got.items():
        found.sort()
        assert [r for r, _, _ in found] == list(range(1, 21))
        assert [x[1:] for x in found] == sorted(x[1:] for x in found)  # nearest first, ties to smaller ids
        assert all(scores[q][i] == s for _, s, i in found)  # exactly the double-precision measure
        hits += len({i for _, _, i in found} & {i for _, i in want[q]})
    assert hits >= 0.9 * 20 * len(want)


def test_recall_and_bounded_blocks(spark):
    """Vectors of several norms in groups; lists of many blocks; a third of all rows are copies."""
    r = np.random.default_rng(3)
    middle = r.normal(size=(12, 24))
    x = (middle[r.integers(0, 12, 3000)] + r.normal(size=(3000, 24)) * 0.6) * r.uniform(0.3, 2, 3000)[:, None]
    x[1000:2000] = x[999]
    x = x.astype(np.float32)
    ids = r.permutation(6000)[:3000].tolist()
    got = search(spark, ids, x.tolist(), block_values=24 * 256, chunk=40)
    hit = n = 0
    for q, best in brute(ids, x.astype(float).tolist()):
        n += 20
        assert len(got[q]) == 20
        hit += sum(s <= best[-1][0] for _, s, _ in got[q])  # as near as the 20th, whichever copy
        exact = [(s, i) for _, s, i in got[q] if s == best[0][0]]
        assert exact[:1] in ([], [best[0]])
    assert hit / n >= 0.9


def test_few_candidates(spark):
    """Fewer candidates than k, all of them found; lone lists; padded, repeated and zero vectors; a huge norm."""
    ids = [0, 20, 20, 3, 4, 5, 6, None, 40]
    vectors = [[1, 0], [0, 1], [0, 2, 1], [1e6, 1e6], [-1], [0.5, 0.25, -3], [0, 0, 0], [1, 1, 1], [0, 0]]
    got = search(spark, ids, vectors)
    ok = [(i, v) for i, v in zip(ids, vectors, strict=True) if i is not None and any(v)]
    for q in (0, 20):
        want = sorted((-product(a, b), i) for j, a in ok if j == q for i, b in ok if i != q)
        assert [(s, i) for _, s, i in got[q]] == want[:20]
    assert 40 not in got


def test_empty(spark, empty):
    got = ann.op11_ann(spark, empty)
    assert got.columns == ["query_id", "rank", "vec_id", "score"] and got.count() == 0
    assert dict(got.dtypes) == {"query_id": "bigint", "rank": "int", "vec_id": "bigint", "score": "double"}
    assert search(spark, [1, 2], [[1.0], [2.0]]) == {}


@pytest.mark.parametrize("columns", [3, 16, 17, 65])
def test_limits_follow_the_beta_law(columns):
    """A candidate on the bound is abandoned in about RISK of all rotations at each test, and never at the last."""
    limits = ann.beta_limits(columns)
    assert limits[-1] == 1.0 and len(limits) == math.ceil(columns / ann.STEP)
    x = np.random.default_rng(1).normal(size=(40000, columns))
    share = np.cumsum(x**2, axis=1) / (x**2).sum(axis=1)[:, None]
    for j, limit in enumerate(limits[:-1]):
        assert (share[:, (j + 1) * ann.STEP - 1] > limit).mean() < 2 * ann.RISK


def test_scan_reads_less_and_loses_little():
    """With a floor most candidates go before all columns are read, and those above the floor stay."""
    r = np.random.default_rng(5)
    x = r.normal(size=(40, 64))[r.integers(0, 40, 4000)] + r.normal(size=(4000, 64)) * 0.4
    x /= np.linalg.norm(x, axis=1)[:, None]
    q = x[:50]
    score = q @ x.T
    score[np.arange(50), np.arange(50)] = -9
    floor = np.sort(score, axis=1)[:, -20]
    block = ann.Block(np.arange(4000), x, np.zeros(4000, int), 1.0)
    qi, vi, got = block.search(np.arange(50), q, [{0}] * 50, 20, floor)
    assert block.tested < 0.5 * block.whole
    assert len(qi) >= 0.97 * 50 * 20 and (got >= floor[qi]).all()
    qi, vi, got = block.search(np.arange(50), q, [{0}] * 50, 20, np.full(50, -np.inf))
    assert all((np.sort(got[qi == i])[0] >= floor[i] - 1e-12) for i in range(50)) and len(qi) == 1000
