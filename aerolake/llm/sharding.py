"""Sharding by a consistent-hash ring with virtual nodes and bounded loads, in DataFrame operations.

Every shard owns ``vnodes`` places on a ring of 64-bit hashes; a key belongs to the next place clockwise. With bounded loads
a shard takes no more than its capacity and keys beyond it continue clockwise to the next shard with room, so balance is
guaranteed and few keys move when a shard is added. Under the ``rows`` law capacities are floor(n / shards) or one more and
sum to n: counts end at most one apart. Under the ``key`` law there is no bound: doc_id and the shard count alone decide,
and one more shard takes rows only into itself.

Only counts by ring cell reach the driver: cells are the ring's arcs cut by a grid that grows with the rows, from 2**12 to 2**18
arcs, so there are at most 2**18 + shards * vnodes cells. The driver pours cells into shards; each row then finds its shard and
slot from its rank inside its cell. Equal rows are counted first and ranked as one interval, which is cut where a shard ends
and dealt out in parts, so that no task holds all rows of a hot key.

Defined cases: null text has size 8 and the checksum of the empty text; a null doc_id takes its place by the text's checksum;
very long texts count with all their bytes; equal rows are placed one by one; an empty table gives an empty table; further columns
play no part.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left
from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from aerolake.llm.common import materialise, read_table, text_or_empty

SHARDS = 24
VNODES = 64
#: Least and most bits of the grid, and rows that an arc holds, about, in between.
GRID_BITS, ARC_ROWS = (12, 18), 1 << 17
#: Copies of a row that one task makes at a time.
PART = 65536

Cell = tuple[int, int]  # grid cell, number of ring places below within it


def ring_places(shards: int, vnodes: int) -> list[tuple[int, int]]:
    """(place as a signed 64-bit integer, shard), sorted."""
    digest = lambda s, v: hashlib.blake2b(f"shard {s} node {v}".encode(), digest_size=8).digest()
    return sorted((int.from_bytes(digest(s, v), "big", signed=True), s) for s in range(shards) for v in range(vnodes))


def preferences(places: list[tuple[int, int]], at: int) -> Iterable[int]:
    """Distinct shards clockwise from the place with index ``at``."""
    seen = set()
    for i in range(len(places)):
        shard = places[(at + i) % len(places)][1]
        if shard not in seen:
            seen.add(shard)
            yield shard


def pour(counts: dict[Cell, int], places: list[tuple[int, int]], index_of: dict[Cell, int], capacity: list[int]) -> list[tuple[int, int, int, int, int, int]]:
    """(grid, below, first rank, last rank, shard, slot of rank 0) of each run of rows of a cell that goes to one shard.

    In round r every row not yet placed asks the r-th shard clockwise of it; cells ask in ring order.
    """
    free, used, out = list(capacity), [0] * len(capacity), []
    waiting = [(cell, iter(preferences(places, index_of[cell])), 0) for cell in sorted(counts)]
    while waiting:
        left = []
        for cell, asks, done in waiting:
            shard = next(asks)
            n = min(counts[cell] - done, free[shard])
            if n:
                out.append((*cell, done, done + n - 1, shard, used[shard] - done))
                used[shard] += n
                free[shard] -= n
            if done + n < counts[cell]:
                left.append((cell, asks, done + n))
        waiting = left
    return out


def with_cell(rows: DataFrame, places: list[tuple[int, int]], grid_bits: int) -> DataFrame:
    """Add ``_grid`` and ``_below``: the grid cell of ``_hash`` and the number of ring places in that cell below it."""
    grid = lambda x: (x >> (64 - grid_bits)) + (1 << grid_bits - 1)
    inside: dict[int, list[int]] = {}
    for place, _ in places:
        inside.setdefault(grid(place), []).append(place)
    table = rows.sparkSession.createDataFrame(sorted(inside.items()), "_grid long, _places array<long>")
    rows = rows.withColumn("_grid", F.shiftright("_hash", 64 - grid_bits) + F.lit(1 << grid_bits - 1))
    rows = rows.join(F.broadcast(table), "_grid", "left")  # at most 2**grid_bits rows
    below = F.size(F.filter("_places", lambda p: p < F.col("_hash")))
    return rows.withColumn("_below", F.when(F.col("_places").isNull(), 0).otherwise(below).cast("int")).drop("_places")


def first_place(places: list[tuple[int, int]], grid_bits: int, cell: Cell) -> int:
    """Index of the first ring place at or above the hashes of a cell."""
    start = (cell[0] - (1 << grid_bits - 1)) << (64 - grid_bits)
    return (bisect_left(places, (start, -1)) + cell[1]) % len(places)


def ring_shards(rows: DataFrame, law: str = "rows", shards: int = SHARDS, vnodes: int = VNODES, grid_bits: int | None = None) -> DataFrame:
    """Add ``shard``, ``slot`` (gapless from 0 in each shard) and ``grown_shard`` (``key`` law: the shard with one more shard).

    ``rows`` must hold ``_hash``, a 64-bit hash of the key; rows of one hash are ordered by their other columns.
    """
    if law not in ("rows", "key"):
        raise ValueError(law)
    places, own = ring_places(shards, vnodes), [c for c in rows.columns if c != "_hash"]
    distinct = materialise(rows.groupBy(*rows.columns).agg(F.count("*").alias("_n")), "ring-rows")
    n = distinct.agg(F.sum("_n")).first()[0] or 0
    if grid_bits is None:
        grid_bits = min(max(GRID_BITS[0], (n // ARC_ROWS).bit_length()), GRID_BITS[1])
    celled = with_cell(distinct, places, grid_bits)
    counts = {(r._grid, r._below): r["_n"] for r in celled.groupBy("_grid", "_below").agg(F.sum("_n").alias("_n")).collect()}  # bounded by the grid
    capacity = [n // shards + (s < n % shards) for s in range(shards)] if law == "rows" else [n] * shards
    runs = pour(counts, places, {c: first_place(places, grid_bits, c) for c in counts}, capacity)
    table = rows.sparkSession.createDataFrame(runs, "_grid long, _below int, _first long, _last long, shard int, _base long")
    before = Window.partitionBy("_grid", "_below").orderBy("_hash", *own).rowsBetween(Window.unboundedPreceding, -1)
    ranked = celled.withColumn("_from", F.coalesce(F.sum("_n").over(before), F.lit(0))).withColumn("_to", F.col("_from") + F.col("_n") - 1)
    met = (ranked._grid == table._grid) & (ranked._below == table._below) & (table._first <= ranked._to) & (table._last >= ranked._from)
    cut = ranked.join(F.broadcast(table), met).drop(table._grid).drop(table._below)  # a run a cell and shard at most
    cut = cut.select("_hash", *own, "shard", "_base", F.greatest("_from", "_first").alias("_from"), F.least("_to", "_last").alias("_to"))
    few = F.col("_to") - F.col("_from") < PART
    parts = cut.filter(~few).withColumn("_from", F.explode(F.sequence("_from", "_to", F.lit(PART).cast("long"))))
    parts = parts.withColumn("_to", F.least("_to", F.col("_from") + PART - 1)).repartition("_from", "shard")
    out = cut.filter(few).unionByName(parts).withColumn("_rank", F.explode(F.sequence("_from", "_to")))
    out = out.select("_hash", *own, "shard", (F.col("_rank") + F.col("_base")).alias("slot"))
    if law == "key":
        more = ring_places(shards + 1, vnodes)
        owners = [(*c, more[first_place(more, grid_bits, c)][1]) for c in all_cells(more, grid_bits)]
        owners = rows.sparkSession.createDataFrame(owners, "_grid long, _below int, grown_shard int")
        out = with_cell(out, more, grid_bits).join(F.broadcast(owners), ["_grid", "_below"])
    else:
        out = out.withColumn("grown_shard", F.lit(None).cast("int"))
    return out.select(*own, "shard", "slot", "grown_shard")


def all_cells(places: list[tuple[int, int]], grid_bits: int) -> list[Cell]:
    inside: dict[int, int] = {}
    for place, _ in places:
        g = (place >> (64 - grid_bits)) + (1 << grid_bits - 1)
        inside[g] = inside.get(g, 0) + 1
    return [(g, b) for g in range(1 << grid_bits) for b in range(inside.get(g, 0) + 1)]


def shard_documents(docs: DataFrame, law: str = "rows", shards: int = SHARDS) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard of every document."""
    text = text_or_empty()
    rows = docs.select(
        "doc_id",
        F.octet_length(text).cast("long").alias("_bytes"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
    ).withColumn("size", F.col("_bytes") + 8)
    key = F.when(F.col("doc_id").isNull(), F.xxhash64("doc_id", "text_crc32")).otherwise(F.xxhash64("doc_id"))
    rows = rows.select("doc_id", "size", "text_crc32", key.alias("_hash"))
    out = ring_shards(rows, law, shards)
    return out.select("doc_id", "size", "text_crc32", F.lit(law).alias("law"), "shard", "slot", "grown_shard")


def op4_ring_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_documents(read_table(spark, sf_dir, "documents"))


QUERIES = {"op4_ring_shards": op4_ring_shards}
