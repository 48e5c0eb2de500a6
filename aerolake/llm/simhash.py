"""SimHash near-duplicates by a binary-trie self-join under a Hamming error budget.

Fingerprints. Each 64-bit fingerprint takes the majority of the bits of its shingles' XXH64 hashes (seed 42).

Join. Distinct fingerprints are the leaves of a binary trie. Node pairs are traversed together from the top; a pair carries the
number of bits in which its prefixes differ and is dropped once that exceeds the budget. The traversal runs on ``rotations``
of the bits: two fingerprints that differ in ``distance`` bits differ in at most distance // rotations bits of one of as many blocks,
so in the rotation that puts that block first the budget down to its end is only that much, and few pairs live. Spark deals
out the node pairs at a depth that grows with the number of fingerprints; node pairs with far more leaves than others are
followed ``DEEPER`` bits down at most before they are dealt out. The tasks go on from there, on sorted arrays, with a bounded number
of node pairs at a time.

A task reports what links its fingerprints as a forest, not as all pairs: node pairs whose fingerprints are in one component
already are not followed. ``components`` joins the forests.

Defined cases: null and empty texts have fingerprint zero and link like any other; equal texts share one fingerprint and
cost one leaf; very long texts are read whole; a null doc_id belongs to its component but never names one unless all its ids are null; an empty table gives
an empty table; further columns play no part.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from aerolake.llm.common import free_name, identity, map_batches, materialise, read_table, text_or_empty, worker_state
from aerolake.llm.components import components

SHINGLE = 4
DISTANCE = 4
ROTATIONS = 3
#: Fingerprints below a node at which Spark deals node pairs out, about.
LEAVES = 4096
#: A node pair with so many times LEAVES fingerprints is split before it is dealt out, by so many bits at most.
HOT, DEEPER = 8, 10
#: Node pairs a task follows at a time.
FRONTIER = 1 << 19
_UPPER = bytes(range(65, 91)), bytes(range(97, 123))
_LOWER = bytes.maketrans(*_UPPER)


def fingerprint(text: str, width: int = SHINGLE) -> int:
    """SimHash of one text as a signed 64-bit integer."""
    import xxhash

    words = text.encode("utf-8", "replace").translate(_LOWER).split()  # bytes split at \x20 and \x09-\x0d only
    if not words:
        return 0
    n = max(1, len(words) - width + 1)
    digest, join = xxhash.xxh64_intdigest, b" ".join
    hashes = np.fromiter((digest(join(words[i : i + width]), 42) for i in range(n)), np.uint64, n)
    ones = np.zeros(64, np.int64)
    for i in range(0, n, 1 << 14):
        part = hashes[i : i + (1 << 14)].astype(">u8").view(np.uint8)
        ones += np.unpackbits(part.reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > n).view(">i8")[0])


def with_fingerprint(docs: DataFrame, text_col: str = "text", width: int = SHINGLE) -> DataFrame:
    """Append ``fp``, the fingerprint as a long; the text is dropped."""

    def task():
        worker_state(("simhash",), object)  # nothing to keep: caches of the operator before are let go

        def call(batch: pa.RecordBatch) -> dict:
            column = batch.column(batch.schema.get_field_index(text_col))
            return {"fp": pa.array([fingerprint(t.as_py() or "", width) for t in column], pa.int64())}

        return call

    return map_batches(docs, task, [T.StructField("fp", T.LongType())], (text_col,))


def rotate(x: np.ndarray, by: int) -> np.ndarray:
    by &= 63
    return x if not by else (x << np.uint64(by)) | (x >> np.uint64(64 - by))


class Forest:
    """Union-find over positions, with the links that joined two sets."""

    def __init__(self, n: int):
        self.parent = np.arange(n)
        self.links: list[tuple[np.ndarray, np.ndarray]] = []

    def roots(self) -> np.ndarray:
        while True:
            up = self.parent[self.parent]
            if np.array_equal(up, self.parent):
                return self.parent
            self.parent = up

    def add(self, a: np.ndarray, b: np.ndarray) -> None:
        """Join a[i] with b[i]; keep links that matter. Rounds of hooking larger roots under smaller ones."""
        while len(a):
            root = self.roots()
            ra, rb = root[a], root[b]
            apart = ra != rb
            a, b, ra, rb = a[apart], b[apart], ra[apart], rb[apart]
            if not len(a):
                break
            high, low = np.maximum(ra, rb), np.minimum(ra, rb)
            _, first = np.unique(high, return_index=True)
            self.parent[high[first]] = low[first]
            self.links.append((a[first], b[first]))


def trie_pairs(left: np.ndarray, right: np.ndarray | None, depth: int, errors: int, distance: int, block: int, within: int, frontier: int = FRONTIER) -> tuple[np.ndarray, np.ndarray]:
    """Links of a forest that connects all fingerprints at most ``distance`` bits apart, as two arrays of fingerprints.

    ``left`` and ``right`` (None: left with itself) are sorted, distinct and share a prefix of ``depth`` bits each, the
    prefixes differing in ``errors`` bits; down to bit ``block`` at most ``within`` errors are allowed.
    """
    keys = left if right is None else np.concatenate([left, right])
    n, split = len(keys), len(left)
    forest = Forest(n)
    if right is None:
        first = np.array([[0, n, 0, n, errors]])
    else:
        first = np.array([[0, split, split, n, errors]])
    # Near budgets first: what few bits join needs no following later.
    for budget in sorted({min(1, distance), distance}):
        stack = [(depth, first)]
        while stack:
            level, pairs = stack.pop()
            root = forest.roots()
            changes = np.concatenate([[0], np.cumsum(root[1:] != root[:-1])])
            a0, a1, b0, b1, e = pairs.T
            one = (changes[a1 - 1] == changes[a0]) & (changes[b1 - 1] == changes[b0]) & (root[a0] == root[b0])
            pairs = pairs[~one]
            small = (pairs[:, 1] - pairs[:, 0]) * (pairs[:, 3] - pairs[:, 2]) <= 8
            done = pairs[small] if level < 64 else pairs
            pairs = pairs[~small] if level < 64 else pairs[:0]
            if len(done):
                _leaves(keys, done, level, block, within, budget, forest)
            if not len(pairs):
                continue
            pairs = _children(keys, pairs, level)
            limit = np.minimum(budget, within) if level + 1 <= block else budget
            pairs = pairs[pairs[:, 4] <= limit]
            for i in range(0, len(pairs), frontier):
                stack.append((level + 1, pairs[i : i + frontier]))
    if not forest.links:
        return keys[:0], keys[:0]
    a, b = (np.concatenate(x) for x in zip(*forest.links, strict=True))
    return keys[a], keys[b]


def _children(keys: np.ndarray, pairs: np.ndarray, level: int) -> np.ndarray:
    """Pairs of children of node pairs; a node is the interval of the keys below it."""
    bit = np.uint64(63 - level)

    def cut(lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        prefix = (keys[lo] >> bit | np.uint64(1)) << bit
        lo, hi = lo.copy(), hi.copy()
        while True:  # all intervals by bisection at once
            open_ = lo < hi
            if not open_.any():
                return lo
            mid = (lo + hi) >> 1
            below = open_ & (keys[np.minimum(mid, len(keys) - 1)] < prefix)
            lo = np.where(below, mid + 1, lo)
            hi = np.where(open_ & ~below, mid, hi)

    a0, a1, b0, b1, e = pairs.T
    am, bm = cut(a0, a1), cut(b0, b1)
    same = (a0 == b0) & (a1 == b1)
    out = [np.stack([a0, am, b0, bm, e], 1), np.stack([am, a1, bm, b1, e], 1), np.stack([a0, am, bm, b1, e + 1], 1), np.stack([am, a1, b0, bm, e + 1], 1)[~same]]
    out = np.concatenate(out)
    return out[(out[:, 0] < out[:, 1]) & (out[:, 2] < out[:, 3])]


def _leaves(keys: np.ndarray, pairs: np.ndarray, level: int, block: int, within: int, budget: int, forest: Forest) -> None:
    """Compare all keys below node pairs that hold few."""
    wa, wb = pairs[:, 1] - pairs[:, 0], pairs[:, 3] - pairs[:, 2]
    count = wa * wb
    which = np.repeat(np.arange(len(pairs)), count)
    k = np.arange(len(which)) - np.repeat(np.cumsum(count) - count, count)
    a, b = pairs[which, 0] + k // wb[which], pairs[which, 2] + k % wb[which]
    x = keys[a] ^ keys[b]
    near = (np.bitwise_count(x) <= budget) & (a != b)
    forest.add(a[near], b[near])


def blocks(rotations: int) -> list[tuple[int, int]]:
    """(first bit, number of bits) of equal blocks of 64 bits."""
    edges = [round(i * 64 / rotations) for i in range(rotations + 1)]
    return [(a, b - a) for a, b in zip(edges, edges[1:], strict=False)]


def links(fps: DataFrame, distance: int = DISTANCE, rotations: int = ROTATIONS, leaves: int = LEAVES) -> DataFrame:
    """(a, b): forests over the distinct fingerprints ``fp`` that connect all at most ``distance`` bits apart."""
    n = fps.count()
    within = distance // rotations
    parts = blocks(rotations)
    depth = max(0, min(math.ceil(math.log2(max(1, n / leaves))), min(size for _, size in parts)))
    sides = None
    for turn, (first, _) in enumerate(parts):
        turned = F.col("fp") if not first else F.shiftleft("fp", first).bitwiseOR(F.shiftrightunsigned("fp", 64 - first))
        node = F.shiftrightunsigned(turned, 64 - depth) if depth else F.lit(0).cast("long")
        masks = [sum(1 << b for b in bits) for bits in _subsets(depth, within)]
        rows = fps.select(turned.alias("key"), node.alias("node"), F.explode(F.array(*(F.lit(m).cast("long") for m in masks))).alias("mask"))
        rows = rows.select(F.lit(turn).alias("turn"), F.least("node", F.col("node").bitwiseXOR(F.col("mask"))).alias("low"), "mask", "node", "key")
        sides = rows if sides is None else sides.union(rows)
    pair_of = ["turn", "low", "mask"]
    hot = materialise(sides.groupBy(*pair_of).agg(F.count("*").alias("n")).filter(F.col("n") > HOT * leaves), "simhash-hot")
    most = hot.agg(F.max("n")).first()[0]
    plain = sides.select(*pair_of, F.lit(0).alias("deep"), F.lit(0).cast("long").alias("sub"), F.lit(0).cast("long").alias("sub_mask"), (F.col("node") != F.col("low")).alias("right"), "key")
    if most:
        deep = min(DEEPER, math.ceil(math.log2(most / leaves)), 64 - depth)
        cold = plain.join(hot, pair_of, "left_anti")
        plain = cold.union(_deeper(sides.join(hot.select(*pair_of), pair_of, "left_semi"), parts, depth, deep, distance, within))

    def pair(group: pd.DataFrame) -> pd.DataFrame:
        turn, errors = int(group["turn"].iat[0]), int(group["mask"].iat[0]).bit_count() + int(group["sub_mask"].iat[0]).bit_count()
        keys, right = group["key"].to_numpy().astype(np.int64).view(np.uint64), group["right"].to_numpy().astype(bool)
        left, other = np.sort(keys[~right]), np.sort(keys[right]) if errors else None
        if not len(left) or other is not None and not len(other):
            return pd.DataFrame({"a": pd.Series(dtype="int64"), "b": pd.Series(dtype="int64")})
        first, size = parts[turn]
        a, b = trie_pairs(left, other, depth + int(group["deep"].iat[0]), errors, distance, size, within)
        back = lambda x: rotate(x, 64 - first).view(np.int64)
        return pd.DataFrame({"a": back(a), "b": back(b)})

    found = plain.groupBy(*pair_of, "deep", "sub", "sub_mask").applyInPandas(pair, "a long, b long")
    return found.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def _deeper(rows: DataFrame, parts: list[tuple[int, int]], depth: int, deep: int, distance: int, within: int) -> DataFrame:
    """Node pairs ``deep`` bits further down: each fingerprint goes to its child's pairs with all children its errors allow."""
    sub = F.shiftrightunsigned("key", 64 - depth - deep).bitwiseAND(F.lit((1 << deep) - 1).cast("long"))
    out = None
    for turn, (_, size) in enumerate(parts):
        inside = max(0, min(deep, size - depth))  # of these bits, the first lie in the block
        for errors in range(within + 1):
            some = [m for m in (sum(1 << b for b in bits) for bits in _subsets(deep, distance - errors)) if errors + (m >> (deep - inside)).bit_count() <= within]
            of = rows.filter((F.col("turn") == turn) & (F.bit_count("mask") == errors))
            of = of.select("turn", "low", "mask", "node", "key", sub.alias("s"), F.explode(F.array(*(F.lit(m).cast("long") for m in some))).alias("sub_mask"))
            other = F.col("s").bitwiseXOR(F.col("sub_mask"))
            if errors:  # two nodes: children of the lower one are the left side
                right, name = F.col("node") != F.col("low"), F.when(F.col("node") == F.col("low"), F.col("s")).otherwise(other)
            else:
                right, name = F.col("s") > other, F.least("s", other)
            of = of.select("turn", "low", "mask", F.lit(deep).alias("deep"), name.alias("sub"), "sub_mask", right.alias("right"), "key")
            out = of if out is None else out.union(of)
    return out


def _subsets(bits: int, most: int) -> list[tuple[int, ...]]:
    from itertools import combinations

    return [c for k in range(most + 1) for c in combinations(range(bits), k)]


def _rooted(docs: DataFrame, distance: int, width: int, rotations: int, leaves: int) -> tuple[DataFrame, DataFrame]:
    """docs with ``fp`` for the text, and (fp, least, root): the least doc_id of a fingerprint and the least fingerprint of its component."""
    rows = materialise(with_fingerprint(docs.withColumn("text", text_or_empty()), width=width), "simhash-rows")
    fps = materialise(rows.groupBy("fp").agg(F.min("doc_id").alias("least")), "simhash-fingerprints")
    roots = components(links(fps.select("fp"), distance, rotations, leaves))
    named = fps.join(roots, fps.fp == roots.node, "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    return rows, materialise(named, "simhash-roots")


def near_duplicates(docs: DataFrame, distance: int = DISTANCE, width: int = SHINGLE, rotations: int = ROTATIONS, leaves: int = LEAVES) -> DataFrame:
    """Append ``fp`` and ``component_id``, the smallest doc_id reachable over links, to docs; the text is dropped."""
    rows, named = _rooted(docs, distance, width, rotations, leaves)
    ids = named.groupBy("root").agg(F.min("least").alias("component_id"))
    of_fp = named.join(ids, "root").select("fp", "component_id")
    return rows.join(of_fp, "fp")


def keep_one(docs: DataFrame, distance: int = DISTANCE, width: int = SHINGLE, rotations: int = ROTATIONS, leaves: int = LEAVES) -> DataFrame:
    """One document of each component, that of the smallest doc_id, with all its columns.

    Components are told apart by their root: ids may be null or repeated, so that components share their smallest.
    """
    key = identity("doc_id", "text")
    rows, named_fps = _rooted(docs.select("doc_id", key.alias("_key"), "text"), distance, width, rotations, leaves)
    near = rows.join(named_fps.select("fp", "root"), "fp")
    first = near.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "_key")).alias("_first"))
    keys = materialise(first.select(F.col("_first._key").alias("_key")), "simhash-kept")
    named, place = free_name(docs, "_key"), free_name(docs, "_i")
    out = docs.withColumn(named, key).join(keys.withColumnRenamed("_key", named), named, "left_semi")
    repeated = materialise(near.groupBy("doc_id", "_key").count().filter("count > 1").select(F.col("_key").alias(named)), "simhash-repeated")
    if repeated.isEmpty():
        return out.select(*docs.columns)
    # The same id and text: one of them, the first by all columns; others take no part in that.
    many = out.join(repeated, named, "left_semi").groupBy(named).agg(F.min_by(F.struct(*docs.columns), F.xxhash64(*docs.columns)).alias(place)).select(f"{place}.*")
    return out.join(repeated, named, "left_anti").select(*docs.columns).union(many)


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = near_duplicates(read_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return docs.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


QUERIES = {"op10_simhash": op10_simhash}
