"""Exact top-k inner products from an impact-ordered index, score at a time.

Index. Components become integers floor(scale * x). A vector's postings are its components; a posting's impact is the size of its
component, quantised to ``LEAST`` times powers of ``BASE``. An index block holds a bounded number of vectors as segments of postings in
descending impact, with the norm of what each vector still lacks after each segment. It is built once and then answers all
queries that are streamed past it. A segment's postings lie dimension by dimension: as lists of (vector, component) where few
vectors have one, as a slab where most do, as embeddings have.

Search. Segments are processed from the highest impact down and add their products to the scores. After each segment a vector is
out for a query if its score plus |query| * |what it lacks| cannot reach the query's floor; processing stops only when that
proof leaves few possible members, and those are rescored exactly. The floor is the k-th best score of the query within the first
block, which is searched before all others, so most vectors are out early. Bounds are widened by more than float rounding, and ties
are never cut.

A task holds one block and a bounded chunk of queries, one slice of it at a time; each block gives the vectors that reach the floor, k at
most a query, and a last aggregate keeps the best k.

Defined cases: vectors that are null, empty or hold a null or non-finite component take no part; shorter vectors count as padded
with zeros; ties go to the smaller vec_id; a query finds every row but its own (rows with its vec_id); repeated vec_ids are
repeated candidates, and the products of all rows of a repeated query id are ranked together; a null vec_id takes no part; an
empty table gives an empty table; further columns play no part. Products must fit a long.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from aerolake.llm.common import materialise, read_table

SCALE = 64
K = 20
QUERY_EVERY = 20
#: Vectors of an index block, queries that pass it in one task (in the first block's search, and in the others'), and at a time.
BLOCK, FIRST_CHUNK, CHUNK, SLICE = 16384, 4096, 65536, 256
#: Impact levels begin at LEAST * BASE**i; smaller components are the last level.
LEAST, BASE = 2, 4
#: Share of (query, vector) pairs still possible below which rescoring is cheaper than the next segment.
FEW = 0.02
#: Share of vectors with a posting in a dimension below which a segment keeps lists.
SPARSE = 1 / 32


def quantised(vectors: DataFrame, scale: int = SCALE) -> DataFrame:
    """(vec_id, v array<long>) of the vectors that take part."""
    x = F.col("embedding")
    finite = F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c.cast("double")) < F.lit(float("inf"))))
    rows = vectors.filter(F.col("vec_id").isNotNull() & x.isNotNull() & (F.size(x) > 0) & finite)
    return rows.select("vec_id", F.transform(x, lambda c: F.floor(c.cast("double") * scale)).alias("v"))


class Index:
    """A block of vectors as segments of postings in descending impact."""

    def __init__(self, ids: np.ndarray, v: np.ndarray):
        self.ids, self.v = ids, v
        self.largest = int(np.abs(v).max(initial=0))
        size = np.abs(v).astype(np.float64)
        level = np.where(size > 0, np.floor(np.log(np.maximum(size / LEAST, 0.5)) / math.log(BASE) + 1e-9), -2).astype(np.int8)
        self.segments: list[tuple[list, np.ndarray]] = []  # (dimension and its postings, or all dimensions and a slab), norm of the rest
        self.types: dict[type, list] = {}
        rest = v.astype(np.float64)
        for x in sorted(set(np.unique(level).tolist()) - {-2}, reverse=True):
            inside = level == x
            part = np.where(inside, v, 0)
            rest = rest - part
            lists = [(d, at, part[at, d]) for d in range(v.shape[1]) if len(at := np.flatnonzero(inside[:, d]))] if inside.mean() < SPARSE else None
            self.segments.append((lists, None if lists is not None else part, np.linalg.norm(rest, axis=1)))

    def _typed(self, kind: type) -> list:
        """Segments as numbers of one kind, made once."""
        if kind not in self.types:
            self.types = {kind: [([(d, at, x.astype(kind)) for d, at, x in lists] if lists is not None else None, None if slab is None else np.ascontiguousarray(slab.astype(kind).T), norm) for lists, slab, norm in self.segments]}
        return self.types[kind]

    def search(self, query_ids: np.ndarray, q: np.ndarray, k: int, floor: np.ndarray | None = None, few: float = FEW) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
        """The k best of the block for each query that reach its floor: (query index, vector index, score), exact, ties by smaller id; and the segments read."""
        ids, v = self.ids, self.v
        bound = self.largest * int(np.abs(q).max(initial=0)) * v.shape[1]
        kind = np.float32 if bound < 1 << 24 else np.float64 if bound < 1 << 53 else np.int64  # products and sums stay exact integers
        wide = 1e-3 + bound * (2.0**-20 if kind == np.float32 else 2.0**-50)  # rounding of scores with slack, many times over
        qs, scores = q.astype(kind), np.zeros((len(q), len(v)), kind)
        q_norm = (np.linalg.norm(q.astype(np.float64), axis=1) * (1 + 1e-6)).astype(np.float32)
        own = query_ids[:, None] == ids[None, :]
        few_rows = len(v) <= k + 1
        possible, read = None, 0
        segments = self._typed(kind)
        for lists, slab, norm in segments:
            if lists is None:
                scores += qs @ slab
            else:
                for d, at, x in lists:
                    scores[:, at] += qs[:, d : d + 1] * x
            read += 1
            if read == len(segments) or few_rows and floor is None:
                continue
            slack = q_norm[:, None] * norm.astype(np.float32)[None, :]
            if floor is None:  # k candidates reach it for sure
                low = np.where(own, -np.inf, scores - slack)
                least = np.partition(low, len(v) - k, axis=1)[:, len(v) - k] - 2 * wide
            else:
                least = floor - wide
            possible = (scores + slack >= least[:, None]) & ~own
            if possible.mean() <= few:
                break
            possible = None
        if possible is None:  # every segment is in: scores are exact
            if floor is not None:
                possible = (scores >= floor[:, None]) & ~own
            elif few_rows:
                possible = ~own
            else:
                top = np.where(own, -np.inf, scores) if kind != np.int64 else np.where(own, np.iinfo(np.int64).min, scores)
                possible = (scores >= np.partition(top, len(v) - k, axis=1)[:, len(v) - k][:, None]) & ~own
        qi, vi = np.nonzero(possible)
        exact = np.empty(len(qi), np.int64)
        for i in range(0, len(qi), 1 << 16):
            part = slice(i, i + (1 << 16))
            exact[part] = np.einsum("ij,ij->i", q[qi[part]], v[vi[part]])
        order = np.lexsort((ids[vi], -exact, qi))
        qi, vi, exact = qi[order], vi[order], exact[order]
        first = np.concatenate([[True], qi[1:] != qi[:-1]]) if len(qi) else np.empty(0, bool)
        rank = np.arange(len(qi)) - np.maximum.accumulate(np.where(first, np.arange(len(qi)), 0)) if len(qi) else np.empty(0, int)
        best = rank < k
        return qi[best], vi[best], exact[best], read


def _matrix(column: pa.ListArray) -> np.ndarray:
    """Vectors as rows, padded with zeros."""
    values, ends = column.flatten().to_numpy(), np.diff(column.offsets.to_numpy())
    out = np.zeros((len(ends), int(ends.max(initial=0))), np.int64)
    out[np.arange(out.shape[1])[None, :] < ends[:, None]] = values
    return out


def _padded(v: np.ndarray, width: int) -> np.ndarray:
    return np.pad(v, ((0, 0), (0, max(0, width - v.shape[1]))))


FOUND = "r long, query_id long, vec_id long, score long"


def _meet(index: DataFrame, queries: DataFrame, k: int, parts: int) -> DataFrame:
    """FOUND for every group ``g`` of index rows (g, vec_id, v), a block each, and query rows (g, r, vec_id, v, floor) that pass it."""
    none = F.lit(None).cast("long")
    rows = index.select("g", F.lit(0).alias("is_query"), none.alias("r"), "vec_id", "v", none.alias("floor")).union(queries.select("g", F.lit(1), "r", "vec_id", "v", "floor"))
    rows = rows.repartition(parts, "g").sortWithinPartitions("g", "is_query")  # a block's vectors come before its queries

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, held, built = None, [], None
        for batch in batches:
            g, is_query = (batch.column(i).to_numpy() for i in (0, 1))
            cuts = np.flatnonzero(np.diff(g) | np.diff(is_query)) + 1
            for a, b in zip([0, *cuts], [*cuts, len(g)], strict=True):
                if a == b:
                    continue
                if g[a] != group:
                    group, held, built = g[a], [], None
                part = batch.slice(a, b - a)
                if not is_query[a]:
                    held.append(part.select(["vec_id", "v"]))
                    continue
                if built is None:
                    if not held:
                        continue
                    table = pa.Table.from_batches(held).combine_chunks().sort_by("vec_id")
                    built = Index(table.column("vec_id").to_numpy(), _matrix(table.column("v").combine_chunks()))
                    held = []
                for i in range(0, part.num_rows, SLICE):
                    some = part.slice(i, SLICE)
                    r, ids, floor = (some.column(n) for n in (2, 3, 5))
                    q = _matrix(some.column(4))
                    width = max(q.shape[1], built.v.shape[1])
                    if width > built.v.shape[1]:
                        built = Index(built.ids, _padded(built.v, width))
                    # One slice has floors or has none: those come from the first block alike for all queries that find k vectors there.
                    known = np.array([x is not None for x in floor.to_pylist()])
                    for which in (known, ~known):
                        at = np.flatnonzero(which)
                        if len(at):
                            floors = floor.take(pa.array(at)).to_numpy() if which is known else None
                            qi, vi, score, _ = built.search(ids.to_numpy()[at], _padded(q, width)[at], k, floors)
                            yield pa.RecordBatch.from_arrays([r.take(pa.array(at[qi])), ids.take(pa.array(at[qi])), pa.array(built.ids[vi]), pa.array(score)], names=["r", "query_id", "vec_id", "score"])

    return rows.mapInArrow(run, FOUND)


def top_k(vectors: DataFrame, is_query: Column, k: int = K, scale: int = SCALE, block: int = BLOCK, chunk: int = CHUNK) -> DataFrame:
    """(query_id, rank, vec_id, score) of each query's k best vectors."""
    rows = materialise(quantised(vectors, scale).withColumn("_q", is_query).withColumn("r", F.monotonically_increasing_id()), "topk-vectors")
    n, n_queries = rows.agg(F.count("*"), F.count(F.when(F.col("_q"), 1))).first()
    blocks = max(1, math.ceil(n / block))
    chunks, first_chunks = max(1, math.ceil(n_queries / chunk)), max(1, math.ceil(n_queries / min(chunk, FIRST_CHUNK)))
    h = F.xxhash64("r")
    each = lambda low, high: F.explode(F.sequence(F.lit(low), F.lit(high - 1))) if high > low else F.explode(F.array().cast("array<int>"))
    index = rows.select("vec_id", "v", F.pmod(h, F.lit(blocks)).cast("int").alias("b"))
    queries = rows.filter("_q").select("r", "vec_id", "v", h.alias("h"))
    # The first block gives every query its floor.
    seeds = index.filter("b = 0").select("vec_id", "v", each(0, first_chunks).alias("g"))
    asked = queries.select("r", "vec_id", "v", F.pmod("h", F.lit(first_chunks)).cast("int").alias("g"), F.lit(None).cast("long").alias("floor"))
    found = _meet(seeds, asked, k, first_chunks)
    if blocks > 1:
        found = materialise(found, "topk-first")
        floors = found.groupBy("r").agg(F.min("score").alias("floor"), F.count("*").alias("n")).filter(F.col("n") == k).drop("n")
        asked = queries.join(floors, "r", "left").withColumn("c", F.pmod("h", F.lit(chunks)).cast("int"))
        asked = asked.withColumn("b", each(1, blocks)).withColumn("g", F.col("b") * chunks + F.col("c"))
        others = index.filter("b > 0").withColumn("c", each(0, chunks)).withColumn("g", F.col("b") * chunks + F.col("c"))
        found = found.union(_meet(others, asked, k, (blocks - 1) * chunks))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op9_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(read_table(spark, sf_dir, "embeddings").select("vec_id", "embedding"), F.pmod("vec_id", F.lit(QUERY_EVERY)) == 0)


ORACLES = {
    "op9_topk": """
WITH v AS (SELECT vec_id, [CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT) for x in embedding] q FROM embeddings
           WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
             AND len([x for x in embedding if x IS NULL OR NOT isfinite(x)]) = 0),
p AS (SELECT a.vec_id query_id, b.vec_id, CAST(list_sum([z[1] * z[2] for z in list_zip(a.q, b.q)]) AS BIGINT) score
      FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE a.vec_id % 20 = 0)
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score
FROM p QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) <= 20
"""
}
QUERIES = {"op9_topk": op9_topk}
