"""Approximate nearest neighbours by inner product: inverted lists read by an adaptive dimension scan.

Index. A vector x gets one more component, sqrt(M**2 - |x|**2), M being the largest norm of the table, and a query a zero: the nearest
by distance are then those of largest inner product. Centroids are fitted by k-means on a sample of SAMPLE_VALUES components at most
(a documented bound; every row is indexed), and each vector lies in the list of its nearest centroid. How many lists a query probes is
fitted on the same sample: as few as give recall TARGET there. Neighbours in a sample are farther off than those in the table, so
the count errs towards more lists. Lists are packed into blocks of bounded size, and a list that is larger is dealt over several.

Scan. Vectors and queries are rotated by one random orthogonal matrix and lie in blocks of STEP columns. After each block of columns
the partial distance is tested: if the whole distance were within the query's bound r, the part of d of D rotated columns would be
r times a Beta(d/2, (D-d)/2) variable, so a candidate is abandoned when its part exceeds the 1 - RISK quantile of that. The last
test, over all columns, is exact. Survivors get their score from the original vectors, summed in order of components in double precision.

The bound comes from the query's nearest list, which is read whole first; a query whose nearest list has fewer than k candidates probes
every list without a bound, so it misses none.

Defined cases: vectors that are null, empty, zero or hold a null or non-finite component take no part, nor does a null vec_id; shorter
vectors count as padded with zeros; ties go to the smaller vec_id; a query finds every row but its own (rows with its vec_id); repeated
vec_ids are repeated candidates, and the products of all rows of a repeated query id are ranked together; an empty table, or one
without queries, gives an empty table; further columns play no part.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from aerolake.llm.common import map_batches, materialise, read_table

K = 20
QUERY_EVERY = 20
#: Components of the sample that lists and probes are fitted on, queries of it, lists at most, and recall wanted there.
SAMPLE_VALUES, SAMPLE_QUERIES, MOST_LISTS, TARGET = 1 << 20, 512, 1024, 0.96
#: Components of an index block, queries that pass it in one task, and at a time.
BLOCK_VALUES, CHUNK, SLICE = 1 << 20, 65536, 256
#: Columns between two tests, and the chance of one test to abandon a candidate that lies on the bound.
STEP, RISK = 16, 0.004
#: Share of pairs still in question below which they are followed one by one.
FEW = 0.15


def usable(vectors: DataFrame) -> DataFrame:
    """(vec_id, v array<double>) of the vectors that take part."""
    x = F.col("embedding")
    finite = F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c.cast("double")) < F.lit(float("inf"))))
    rows = vectors.filter(F.col("vec_id").isNotNull() & x.isNotNull() & finite & F.exists(x, lambda c: c != 0))
    return rows.select("vec_id", F.col("embedding").cast("array<double>").alias("v"))


def beta_limits(columns: int, step: int = STEP, risk: float = RISK) -> list[float]:
    """After each block of columns, the share of the squared bound beyond which a candidate is abandoned; 1 after the last."""
    out = []
    for d in range(step, columns, step):
        x = (np.arange(20000) + 0.5) / 20000
        log = (d / 2 - 1) * np.log(x) + ((columns - d) / 2 - 1) * np.log1p(-x)
        mass = np.cumsum(np.exp(log - log.max()))
        out.append(float(min(1.0, x[min(len(x) - 1, np.searchsorted(mass, (1 - risk) * mass[-1]))] + 1e-4)))
    return [*out, 1.0]


def rotation(columns: int) -> np.ndarray:
    """One orthogonal matrix for all tasks."""
    q, r = np.linalg.qr(np.random.default_rng(11).normal(size=(columns, columns)))
    return q * np.sign(np.diag(r))


def extended(v: np.ndarray, longest: float) -> np.ndarray:
    """Vectors with the component that makes all norms equal to ``longest``."""
    return np.concatenate([v, np.sqrt(np.maximum(0, longest**2 - np.einsum("ij,ij->i", v, v)))[:, None]], axis=1)


def _matrix(column: pa.ListArray, width: int) -> np.ndarray:
    """Vectors as rows, padded with zeros."""
    values, sizes = column.flatten().to_numpy(), np.diff(column.offsets.to_numpy())
    out = np.zeros((len(sizes), width))
    out[np.arange(width)[None, :] < sizes[:, None]] = values
    return out


class Lists:
    """Centroids of the lists and the number of lists that a query probes."""

    def __init__(self, sample: np.ndarray, longest: float, lists: int, k: int, target: float = TARGET, rounds: int = 10):
        self.width, self.longest = sample.shape[1], longest
        x = extended(sample, longest)
        r = np.random.default_rng(7)
        first = r.permutation(len(x))[: max(1, min(lists, len(x)))]
        centroids = x[first]
        for _ in range(rounds):
            at = np.argmin(self._far(x, centroids), axis=1)
            n, total = np.bincount(at, minlength=len(centroids)), np.zeros_like(centroids)
            np.add.at(total, at, x)
            centroids = np.where(n[:, None] > 0, total / np.maximum(n, 1)[:, None], centroids)
        self.centroids = centroids
        at = np.argmin(self._far(x, centroids), axis=1)
        asked = r.permutation(len(x))[:SAMPLE_QUERIES]
        score = sample[asked] @ sample.T
        score[np.arange(len(asked)), asked] = -np.inf
        best = np.argsort(-score, axis=1, kind="stable")[:, : max(1, min(k, len(x) - 1))]
        order = self.order(sample[asked])
        place = np.empty_like(order)
        np.put_along_axis(place, order, np.broadcast_to(np.arange(order.shape[1]), order.shape), axis=1)
        hits = np.bincount(np.take_along_axis(place, at[best], axis=1).ravel(), minlength=len(centroids))
        self.probes = 1 + int(np.searchsorted(np.cumsum(hits) / max(1, hits.sum()), target))
        self.probes = min(self.probes, len(centroids))

    @staticmethod
    def _far(x: np.ndarray, centroids: np.ndarray) -> np.ndarray:
        """Squared distances less the vector's own norm."""
        return np.einsum("ij,ij->i", centroids, centroids)[None, :] - 2 * x @ centroids.T

    def nearest(self, v: np.ndarray) -> np.ndarray:
        return np.argmin(self._far(extended(v, self.longest), self.centroids), axis=1)

    def order(self, q: np.ndarray) -> np.ndarray:
        """Lists by distance from each query."""
        return np.argsort(self._far(np.pad(q, ((0, 0), (0, 1))), self.centroids), axis=1, kind="stable")


class Block:
    """The vectors of some lists, rotated, in blocks of columns."""

    def __init__(self, ids: np.ndarray, v: np.ndarray, lists: np.ndarray, longest: float):
        order = np.lexsort((ids, lists))
        self.ids, self.v, self.longest = ids[order], v[order], longest
        self.turn = rotation(v.shape[1] + 1)
        turned = extended(self.v, longest) @ self.turn
        edges = list(range(0, turned.shape[1], STEP)) + [turned.shape[1]]
        self.spans = list(zip(edges[:-1], edges[1:], strict=True))
        self.columns = [np.ascontiguousarray(turned[:, a:b]) for a, b in self.spans]
        self.squares = [np.einsum("ij,ij->i", c, c) for c in self.columns]
        self.limits = beta_limits(turned.shape[1])
        names, starts = np.unique(lists[order], return_index=True)
        self.lists = list(zip(names.tolist(), starts.tolist(), [*starts[1:].tolist(), len(order)], strict=True))
        self.tested = self.whole = 0  # column values read, and what reading all would be

    def _follow(self, qi: np.ndarray, vi: np.ndarray, part: np.ndarray, turned: np.ndarray, bound: np.ndarray, j: int) -> tuple[np.ndarray, np.ndarray]:
        """The pairs that survive the tests from column block j on."""
        for (a, b), column, limit in list(zip(self.spans, self.columns, self.limits, strict=True))[j:]:
            if not len(qi):
                break
            self.tested += len(qi) * (b - a)
            for i in range(0, len(qi), 1 << 16):
                some = slice(i, i + (1 << 16))
                gap = turned[qi[some], a:b] - column[vi[some]]
                part[some] += np.einsum("ij,ij->i", gap, gap)
            ok = part <= limit * bound[qi]
            qi, vi, part = qi[ok], vi[ok], part[ok]
        return qi, vi

    def search(self, query_ids: np.ndarray, q: np.ndarray, probed: list[set], k: int, floor: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query index, vector index, score) of the k best survivors of each query in the lists it probes; floor: scores below it are of no use."""
        norm = np.einsum("ij,ij->i", q, q)
        slack = 1e-9 * (norm + self.longest**2)
        bound = np.where(np.isneginf(floor), np.inf, norm + self.longest**2 - 2 * np.where(np.isneginf(floor), 0, floor) + slack)
        turned = np.pad(q, ((0, 0), (0, 1))) @ self.turn
        q_squares = [np.einsum("ij,ij->i", turned[:, a:b], turned[:, a:b]) for a, b in self.spans]
        pairs = []
        for name, a, b in self.lists:
            at = np.array([i for i, p in enumerate(probed) if name in p], dtype=np.int64)
            if not len(at):
                continue
            self.whole += len(at) * (b - a) * turned.shape[1]
            part, own, limits = np.zeros((len(at), b - a)), query_ids[at][:, None] == self.ids[None, a:b], bound[at][:, None]
            for j, ((lo, hi), column, square, limit) in enumerate(zip(self.spans, self.columns, self.squares, self.limits, strict=True)):
                part += q_squares[j][at][:, None] + square[None, a:b] - 2 * turned[at, lo:hi] @ column[a:b].T
                self.tested += part.size * (hi - lo)
                inside = (part <= limit * limits) & ~own
                if j + 1 < len(self.spans) and inside.mean() < FEW:
                    qi, vi = np.nonzero(inside)
                    pairs.append(self._follow(at[qi], a + vi, part[qi, vi], turned, bound, j + 1))
                    break
            else:  # all columns are in: of a query's candidates here only the k nearest count, and what rounding may confuse with them
                if b - a > k:
                    far = np.where(inside, part, np.inf)
                    inside &= part <= np.partition(far, k - 1, axis=1)[:, k - 1 : k] + 4 * slack[at][:, None]
                qi, vi = np.nonzero(inside)
                pairs.append((at[qi], a + vi))
        qi, vi = (np.concatenate([p[i] for p in pairs]) if pairs else np.empty(0, np.int64) for i in (0, 1))
        score = scores(q, self.v, qi, vi)
        order = np.lexsort((self.ids[vi], -score, qi))
        qi, vi, score = qi[order], vi[order], score[order]
        n = np.arange(len(qi))
        rank = n - np.maximum.accumulate(np.where(np.concatenate([[True], qi[1:] != qi[:-1]]), n, 0)) if len(qi) else n
        best = (rank < k) & (score >= floor[qi])
        return qi[best], vi[best], score[best]


def scores(q: np.ndarray, v: np.ndarray, qi: np.ndarray, vi: np.ndarray) -> np.ndarray:
    """Inner products of pairs of rows, components added in order."""
    out = np.zeros(len(qi))
    for i in range(0, len(qi), 1 << 16):
        a, b, some = q[qi[i : i + (1 << 16)]], v[vi[i : i + (1 << 16)]], out[i : i + (1 << 16)]
        for d in range(v.shape[1]):
            some += a[:, d] * b[:, d]
    return out


FOUND = "r long, query_id long, vec_id long, score double"


def _scan(index: DataFrame, queries: DataFrame, k: int, width: int, longest: float, parts: int) -> DataFrame:
    """FOUND for every group ``g`` of index rows (g, vec_id, v, list), a block each, and query rows (g, r, vec_id, v, probes, floor) that pass it."""
    null = lambda kind: F.lit(None).cast(kind)
    rows = index.select("g", F.lit(0).alias("is_query"), null("long").alias("r"), "vec_id", "v", "list", null("array<int>").alias("probes"), null("double").alias("floor"))
    rows = rows.union(queries.select("g", F.lit(1), "r", "vec_id", "v", null("int"), "probes", "floor")).repartition(parts, "g").sortWithinPartitions("g", "is_query")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, held, block = None, [], None
        for batch in batches:
            g, is_query = (batch.column(i).to_numpy() for i in (0, 1))
            cuts = np.flatnonzero(np.diff(g) | np.diff(is_query)) + 1
            for a, b in zip([0, *cuts], [*cuts, len(g)], strict=True):
                if a == b:
                    continue
                if g[a] != group:
                    group, held, block = g[a], [], None
                part = batch.slice(a, b - a)
                if not is_query[a]:
                    held.append(part.select(["vec_id", "v", "list"]))
                    continue
                if block is None:
                    if not held:
                        continue
                    table = pa.Table.from_batches(held).combine_chunks()
                    block, held = Block(table.column("vec_id").to_numpy(), _matrix(table.column("v").combine_chunks(), width), table.column("list").to_numpy(), longest), []
                for i in range(0, part.num_rows, SLICE):
                    some = part.slice(i, SLICE)
                    ids = some.column("vec_id")
                    floor = some.column("floor").fill_null(-math.inf).to_numpy()
                    qi, vi, score = block.search(ids.to_numpy(), _matrix(some.column("v"), width), [set(p) for p in some.column("probes").to_pylist()], k, floor)
                    at = pa.array(qi)
                    yield pa.RecordBatch.from_arrays([some.column("r").take(at), ids.take(at), pa.array(block.ids[vi]), pa.array(score)], names=["r", "query_id", "vec_id", "score"])

    return rows.mapInArrow(run, FOUND)


def _best(found: DataFrame, by: str, k: int) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy(by).orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).filter(F.col("rank") <= k)


def nearest(vectors: DataFrame, is_query: Column, k: int = K, target: float = TARGET, block_values: int = BLOCK_VALUES, chunk: int = CHUNK) -> DataFrame:
    """(query_id, rank, vec_id, score) of each query's k nearest found."""
    rows = usable(vectors).withColumn("_q", is_query)
    norm = F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x)
    n, n_queries, width, longest = rows.agg(F.count("*"), F.count(F.when(F.col("_q"), 1)), F.max(F.size("v")), F.max(F.sqrt(norm))).first()
    if not n_queries:
        return rows.select(F.col("vec_id").alias("query_id"), F.lit(0).alias("rank"), "vec_id", F.lit(0.0).alias("score")).filter(F.lit(False))
    wanted = max(256, SAMPLE_VALUES // width)
    drawn = F.pmod(F.xxhash64("vec_id", F.monotonically_increasing_id()), F.lit(1 << 30)) < int((1 << 30) * min(1.0, wanted / n))
    sample = np.zeros((0, width))
    for batch in rows.select("v", drawn.alias("_d")).filter("_d").select("v").toArrow().to_batches():
        sample = np.concatenate([sample, _matrix(batch.column(0), width)])
    if not len(sample):  # few rows, none of them drawn
        sample = _matrix(rows.select("v").limit(wanted).toArrow().column(0).combine_chunks(), width)
    lists = Lists(sample, longest, min(MOST_LISTS, max(1, round(math.sqrt(n) / 2))), k, target)

    def place():
        def call(batch: pa.RecordBatch) -> dict:
            v = _matrix(batch.column(batch.schema.get_field_index("v")), width)
            ask = np.flatnonzero(batch.column(batch.schema.get_field_index("_q")).fill_null(False).to_numpy(zero_copy_only=False))
            probes: list = [None] * len(v)
            for i, order in zip(ask, lists.order(v[ask]), strict=True):
                probes[i] = order[: lists.probes].tolist()
            return {"list": lists.nearest(v), "probes": probes}

        return call

    placed = map_batches(rows, place, [T.StructField("list", T.IntegerType()), T.StructField("probes", T.ArrayType(T.IntegerType()))])
    placed = materialise(placed.withColumn("r", F.monotonically_increasing_id()), "ann-lists")

    # Lists go into bundles of at most a block's rows; a longer list is a bundle of its own, dealt over several blocks.
    most, sizes = max(1, block_values // width), dict(placed.groupBy("list").count().collect())
    bundle, held = [], []
    for i in range(len(lists.centroids)):
        if not held or held[-1] + sizes.get(i, 0) > most:
            held.append(0)
        bundle.append(len(held) - 1)
        held[-1] += sizes.get(i, 0)
    parts = [max(1, math.ceil(s / most)) for s in held]
    first = [sum(parts[:i]) for i in range(len(parts))]
    of = lambda values, i: F.element_at(F.lit(values), i + 1)
    chunks, blocks = max(1, math.ceil(n_queries / chunk)), sum(parts)
    b = of(bundle, F.col("list"))
    block = of(first, b) + F.pmod(F.xxhash64("r"), of(parts, b).cast("long")).cast("int")
    index = placed.select("vec_id", "v", "list", block.alias("block")).withColumn("g", F.explode(F.sequence(F.lit(0), F.lit(chunks - 1)))).withColumn("g", F.col("block") * chunks + F.col("g"))
    probing = lambda p: F.flatten(F.transform(F.array_distinct(F.transform(p, lambda i: of(bundle, i))), lambda x: F.sequence(of(first, x), of(first, x) + of(parts, x) - 1)))
    asked = placed.filter("_q").select("r", "vec_id", "v", "probes", F.pmod(F.xxhash64("r", F.lit(1)), F.lit(chunks)).cast("int").alias("c"))
    dealt = lambda df: df.withColumn("g", F.explode(probing(F.col("probes")))).withColumn("g", F.col("g") * chunks + F.col("c"))
    seeds = dealt(asked.withColumn("probes", F.slice("probes", 1, 1)).withColumn("floor", F.lit(None).cast("double")))
    found = _scan(index, seeds, k, width, longest, blocks * chunks)
    if len(lists.centroids) > 1:
        found = materialise(_best(found, "r", k).drop("rank"), "ann-first")
        floors = found.groupBy("r").agg(F.min("score").alias("floor"), F.count("*").alias("n")).filter(F.col("n") == k).drop("n")
        others = F.array_except(F.when(F.col("floor").isNotNull(), F.col("probes")).otherwise(F.sequence(F.lit(0), F.lit(len(lists.centroids) - 1))), F.slice("probes", 1, 1))
        found = found.union(_scan(index, dealt(asked.join(floors, "r", "left").withColumn("probes", others)), k, width, longest, blocks * chunks))
    return _best(found, "query_id", k).select("query_id", "rank", "vec_id", "score")


def op11_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(read_table(spark, sf_dir, "embeddings").select("vec_id", "embedding"), F.pmod("vec_id", F.lit(QUERY_EVERY)) == 0)


QUERIES = {"op11_ann": op11_ann}
