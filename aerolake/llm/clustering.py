"""Centroid clustering by integer arithmetic in the JVM.

Components become integers floor(scale * x). Distances to the centroids, which stand in the plan as literal arrays, are
``aggregate(zip_with(...))`` expressions, the nearest centroid is ``array_min`` of structs (distance, number), and a round is one
aggregate: a row of counts and column sums for each centroid and task is all that is shuffled, and one for each centroid all that
reaches the driver. Sums are exact, so any partitioning gives the same centroids.

Defined cases: vectors that are null, of another length, or hold a null or non-finite component are not kept; repeated rows count
as often as they occur; rows of equal vec_id rank by their components when centroids are chosen, null vec_ids last; fewer kept vectors
than centroids give fewer centroids; equal centroids leave the larger number empty; an empty table gives an empty table; further columns
play no part. Components must stay below 2**17 in size: beyond, an arithmetic error is raised, never a wrapped distance given.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from aerolake.llm.common import materialise, read_table

DIMENSIONS, SCALE, CLUSTERS, ROUNDS, SEED = 64, 1024, 8, 10, 3


def quantised(vectors: DataFrame, dimensions: int = DIMENSIONS, scale: int = SCALE) -> DataFrame:
    """(vec_id, v array<long>) of the kept vectors."""
    x = F.col("embedding")
    finite = F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c.cast("double")) < F.lit(float("inf"))))
    return vectors.filter(x.isNotNull() & (F.size(x) == dimensions) & finite).select("vec_id", F.transform(x, lambda c: F.floor(c.cast("double") * scale)).alias("v"))


def _literal(values: list[int]) -> Column:
    return F.expr(f"array({', '.join(f'{x}L' for x in values)})")


def nearest(centroids: list[list[int]]) -> Column:
    """(distance, cluster) of the nearest centroid to ``v``, ties to the smaller number."""
    far = lambda c: F.aggregate(F.zip_with("v", _literal(c), lambda a, b: (a - b) * (a - b)), F.lit(0).cast("long"), lambda s, x: s + x)
    return F.array_min(F.array(*(F.struct(far(c).alias("distance"), F.lit(i).alias("cluster")) for i, c in enumerate(centroids))))


def seeds(rows: DataFrame, clusters: int = CLUSTERS, seed: int = SEED) -> list[list[int]]:
    """Components of the vectors of smallest sha256 of ``seed:vec_id``."""
    h = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")).cast("binary"), 256)
    return [list(r.v) for r in rows.select("v", h.alias("h")).orderBy(F.asc_nulls_last("h"), "v").limit(clusters).collect()]


def moved(rows: DataFrame, centroids: list[list[int]]) -> list[list[int]]:
    """Centroids after a round: floor of the mean of their vectors; empty ones stay."""
    sums = rows.select(nearest(centroids).getField("cluster").alias("c"), "v").groupBy("c").agg(F.count("*").alias("n"), *(F.sum(F.col("v")[i]).alias(f"s{i}") for i in range(len(centroids[0]))))
    out = list(centroids)
    for c, n, *s in sums.collect():
        out[c] = [x // n for x in s]
    return out


def clusters(vectors: DataFrame, dimensions: int = DIMENSIONS, scale: int = SCALE, k: int = CLUSTERS, rounds: int = ROUNDS, seed: int = SEED) -> tuple[DataFrame, list[list[int]]]:
    """(vec_id, cluster, distance) of each kept vector, and the centroids."""
    rows = materialise(quantised(vectors, dimensions, scale), "cluster-vectors")
    centroids = seeds(rows, k, seed)
    if not centroids:
        return rows.select("vec_id", F.lit(0).alias("cluster"), F.lit(0).cast("long").alias("distance")).filter(F.lit(False)), []
    for _ in range(rounds):
        was, centroids = centroids, moved(rows, centroids)
        if centroids == was:  # further rounds would change nothing
            break
    return rows.select("vec_id", nearest(centroids).alias("a")).select("vec_id", "a.cluster", "a.distance"), centroids


def digest(assigned: DataFrame, centroids: list[list[int]]) -> DataFrame:
    """With each vector's sums of distances and the digest of its centroid."""
    inertia = dict(assigned.groupBy("cluster").agg(F.sum("distance")).collect())
    at = F.col("cluster") + 1
    sums = _literal([inertia.get(i, 0) for i in range(max(1, len(centroids)))])
    digests = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids] or [""]
    return assigned.select("vec_id", "cluster", "distance", F.element_at(sums, at).alias("cluster_inertia"), F.lit(sum(inertia.values())).cast("long").alias("inertia"), F.element_at(F.array(*map(F.lit, digests)), at).alias("centroid_sha256"))


def op12_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest(*clusters(read_table(spark, sf_dir, "embeddings").select("vec_id", "embedding")))


def _sql() -> str:
    rounds = "".join(
        f"""
d{r} AS MATERIALIZED (SELECT rid, CAST(min(d * {CLUSTERS} + c) % {CLUSTERS} AS INTEGER) c, CAST(min(d * {CLUSTERS} + c) // {CLUSTERS} AS BIGINT) d FROM (SELECT rid, c, CAST(sum((x.v - m) * (x.v - m)) AS BIGINT) d FROM x JOIN c{r} USING (i) GROUP BY 1, 2) GROUP BY 1),
s{r} AS MATERIALIZED (SELECT c, i, CAST(sum(v) AS BIGINT) s, count(*) n FROM x JOIN d{r} USING (rid) GROUP BY 1, 2),
c{r + 1} AS MATERIALIZED (SELECT c{r}.c, c{r}.i, coalesce((s - ((s % n) + n) % n) // n, m) m FROM c{r} LEFT JOIN s{r} ON c{r}.c = s{r}.c AND c{r}.i = s{r}.i),"""
        for r in range(ROUNDS)
    )
    return f"""
WITH kept AS MATERIALIZED (SELECT vec_id, row_number() OVER () rid, [CAST(floor({SCALE} * CAST(x AS DOUBLE)) AS BIGINT) for x in embedding] v FROM embeddings
  WHERE len(embedding) = {DIMENSIONS} AND len([x for x in embedding if x IS NULL OR NOT isfinite(x)]) = 0),
x AS MATERIALIZED (SELECT rid, unnest(v) v, generate_subscripts(v, 1) i FROM kept),
c0 AS MATERIALIZED (SELECT c, unnest(v) m, generate_subscripts(v, 1) i FROM (SELECT row_number() OVER (ORDER BY sha256('{SEED}:' || vec_id) NULLS LAST, v) - 1 c, v FROM kept) WHERE c < {CLUSTERS}),{rounds}
f AS MATERIALIZED (SELECT rid, CAST(min(d * {CLUSTERS} + c) % {CLUSTERS} AS INTEGER) c, CAST(min(d * {CLUSTERS} + c) // {CLUSTERS} AS BIGINT) d FROM (SELECT rid, c, CAST(sum((x.v - m) * (x.v - m)) AS BIGINT) d FROM x JOIN c{ROUNDS} USING (i) GROUP BY 1, 2) GROUP BY 1),
h AS (SELECT c, sha256(string_agg(CAST(m AS VARCHAR), ',' ORDER BY i)) h FROM c{ROUNDS} GROUP BY 1)
SELECT vec_id, c AS cluster, d AS distance, CAST(sum(d) OVER (PARTITION BY c) AS BIGINT) AS cluster_inertia, CAST(sum(d) OVER () AS BIGINT) AS inertia, h AS centroid_sha256
FROM f JOIN kept USING (rid) JOIN h USING (c)
"""


ORACLES = {"op12_clustering": _sql()}
QUERIES = {"op12_clustering": op12_clustering}
