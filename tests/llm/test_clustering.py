"""Centroid clustering against a plain version in Python integers, and its SQL."""

from __future__ import annotations

import hashlib
import math

import duckdb
import numpy as np
import pytest

from aerolake.llm import clustering


def brute(ids, vectors, dimensions=64, scale=1024, k=8, rounds=10, seed=3):
    rows = [(i, [math.floor(scale * x) for x in v]) for i, v in zip(ids, vectors, strict=True) if v is not None and len(v) == dimensions and all(x is not None and math.isfinite(x) for x in v)]
    rank = lambda r: (r[0] is None, hashlib.sha256(f"{seed}:{r[0]}".encode()).hexdigest() if r[0] is not None else "", r[1])
    centroids = [v for _, v in sorted(rows, key=rank)[:k]]

    def assign():
        return [min((sum((a - b) ** 2 for a, b in zip(v, c, strict=True)), n) for n, c in enumerate(centroids)) for _, v in rows]

    for _ in range(rounds):
        at = [c for _, c in assign()]
        for n in range(len(centroids)):
            own = [v for (_, v), c in zip(rows, at, strict=True) if c == n]
            if own:
                centroids[n] = [sum(x) // len(own) for x in zip(*own, strict=True)]
    last = assign()
    total = sum(d for d, _ in last)
    digest = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    return sorted(((str(i), c, d, sum(e for e, o in last if o == c), total, digest[c]) for (i, _), (d, c) in zip(rows, last, strict=True)))


@pytest.fixture(scope="module")
def awkward():
    r = np.random.default_rng(4)
    x = (r.normal(size=(5, 64))[r.integers(0, 5, 120)] + r.normal(size=(120, 64)) * 0.5).astype(np.float32).astype(float).tolist()
    x[3] = None
    x[4] = x[4][:63]
    x[5] = x[5] + [1.0]
    x[6] = [None, *x[6][1:]]
    x[7] = [float("nan"), *x[7][1:]]
    x[8] = [*x[8][:-1], float("-inf")]
    x[9] = []
    for i in range(40, 80):
        x[i] = x[40]  # a third are copies
    ids: list = [*range(117), 50, 50, None]
    return ids, x


def test_rows(spark, awkward):
    ids, x = awkward
    table = spark.createDataFrame([(i, v, "a", "b") for i, v in zip(ids, x, strict=True)], "vec_id long, embedding array<float>, cluster string, distance string")
    got = clustering.digest(*clustering.clusters(table.repartition(5)))
    assert dict(got.dtypes) == {"vec_id": "bigint", "cluster": "int", "distance": "bigint", "cluster_inertia": "bigint", "inertia": "bigint", "centroid_sha256": "string"}
    assert sorted((str(r[0]), *r[1:]) for r in got.collect()) == brute(ids, x)


def test_ties_and_empty_clusters(spark):
    """Equal seeds: the larger numbers stay empty; equal distances go to the smaller number; negative sums are floored."""
    x = [[1.0, -1.0], [1.0, -1.0], [1.0, -1.0], [-1.0, 1.0], [0.0, 0.0], [-0.3, -0.7]]
    table = spark.createDataFrame(list(enumerate(x)), "vec_id long, embedding array<float>")
    f32 = np.array(x, np.float32).astype(float).tolist()
    for k, rounds in ((2, 0), (3, 1), (6, 4), (9, 10)):
        got = clustering.digest(*clustering.clusters(table, dimensions=2, k=k, rounds=rounds)).collect()
        assert sorted((str(r[0]), *r[1:]) for r in got) == brute(range(6), f32, 2, k=k, rounds=rounds)


def test_sql(spark, awkward, tmp_path):
    ids, x = awkward
    spark.createDataFrame(list(zip(ids, x, strict=True)), "vec_id long, embedding array<float>").coalesce(1).write.parquet(f"{tmp_path}/embeddings.parquet")
    con = duckdb.connect()
    con.sql(f"CREATE VIEW embeddings AS SELECT * FROM '{tmp_path}/embeddings.parquet/*.parquet'")
    rows = con.sql(clustering.ORACLES["op12_clustering"]).fetchall()
    assert sorted((str(r[0]), *r[1:]) for r in rows) == brute(ids, x)


def test_empty(spark, empty):
    got = clustering.op12_clustering(spark, empty)
    assert got.count() == 0 and len(got.columns) == 6
