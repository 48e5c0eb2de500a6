"""Mixing sources to target weights by entropy balancing, in DataFrame operations only.

Targets. Sources in code-point order (null last) weigh 5, 2, 1, repeating, and share ``total`` times all words; a target
stops at ``most`` times its source's words and the excess is shared anew by weight until none is above.

Rates. Among document rates between 0 and ``most`` the mix takes those nearest to uniform in (binary) relative entropy that
meet the token constraint of each source, sum(rate * size) = target. The dual has one multiplier a source; its solution
tilts rates exponentially with size: rate = most / (1 + (most - 1) exp(-lambda * size / mean size)). Newton steps on the dual, kept
in a bracket, are aggregates over (source, size, count); all sources step in the same job. Sums are taken in decimals, so they do not
depend on the order of rows and reruns agree to the last bit; a source whose constraint is not met to ``TOLERANCE`` of its target
after ``NEWTON_STEPS`` raises an error.

Copies. Rates become whole copies by systematic rounding along size within a source, so their error never adds up: a
document's copies are the integers its interval of the running rate covers. Of ``phases`` starting points the one with the
nearest total is taken, again from counts alone. A source with a third of all rows is never one group: documents rank only
within (source, size, bucket), with buckets of about ``bucket_rows`` rows.

Defined cases: null text has size 0; such documents keep a rate but take no words; very long texts are counted whole; a null source
is a source; rows of one id, source and text are rounded one by one, in the order of a hash of all their columns; sources
without words have target 0; an empty table gives an empty table; further columns of the input are kept by ``apply_mix`` and play
no other part.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from aerolake.llm.common import free_name, identity, materialise, read_table, text_or_empty

WEIGHTS = (5, 2, 1)
TOTAL = 1.5
MOST = 2
WORD = r"[^\x20\x09-\x0D]+"
NEWTON_STEPS = 40
PHASES = 64
BUCKET_ROWS = 65536
#: Share of its target by which a source may miss it before rounding.
TOLERANCE = 1e-9


def n_words(text: Column) -> Column:
    """Number of words of a text."""
    return F.regexp_count(text, F.lit(WORD)).cast("long")


def source_targets(sources: DataFrame, total: float = TOTAL, most: float = MOST, weights: tuple[int, ...] = WEIGHTS) -> DataFrame:
    """Add ``target`` to (source, source_size, ...), one row a source."""
    rank = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1  # one row a source
    weight = F.element_at(F.array(*(F.lit(float(w)) for w in weights)), (rank % len(weights) + 1).cast("int"))
    table = materialise(sources.withColumn("_weight", weight), "mix-sources")
    all_words = table.agg(F.sum("source_size")).first()[0] or 0
    share, capped = 0.0, None
    while True:  # each round caps at least one source more
        over = F.col("_weight") * share > F.col("source_size") * most
        a = table.agg(F.sum(F.when(over, F.col("source_size") * float(most))), F.sum(F.when(~over, F.col("_weight"))), F.count(F.when(over, 1))).first()
        if capped is not None and a[2] == capped or not a[1]:
            break
        capped, share = a[2], (total * all_words - (a[0] or 0.0)) / a[1]
    return table.withColumn("target", F.least(F.col("_weight") * share, F.col("source_size") * float(most))).drop("_weight")


def _rate(lam: Column, x: Column, most: float) -> Column:
    return F.lit(float(most)) / (F.exp(-F.greatest(F.least(lam * x, F.lit(500.0)), F.lit(-500.0))) * (most - 1) + 1)


def _sum(x: Column) -> Column:
    """A sum that is the same whatever the order of rows: of decimals with 12 places, for terms under 10**16."""
    return F.sum(x.cast("decimal(28,12)")).cast("double")


def solve_multipliers(sizes: DataFrame, sources: DataFrame, most: float = MOST, steps: int = NEWTON_STEPS) -> DataFrame:
    """(source, source_size, target, mean, lam): the dual's solution. ``sizes``: (source, size, n); ``sources``: (source, source_size, n_docs, target).

    lam is null where the target is all a source can give, and every rate is ``most``.
    """
    full = F.col("target") >= F.col("source_size") * float(most) * (1 - 1e-12)
    state = sources.select("source", "source_size", "target", (F.col("source_size") / F.col("n_docs")).alias("mean"), F.when(~full & (F.col("source_size") > 0), 0.0).alias("lam"), F.lit(-1e4).alias("lo"), F.lit(1e4).alias("hi"), F.lit(False).alias("done"))
    state = materialise(state, "mix-state")
    for _ in range(steps):
        x = F.col("size") / F.col("mean")
        rate = _rate(F.col("lam"), x, most)
        words = F.col("n") * F.col("size")
        open_ = state.filter("lam is not null and not done").select(F.col("source").alias("_s"), "lam", "mean")
        sums = sizes.join(open_, sizes.source.eqNullSafe(open_._s)).groupBy("_s").agg(_sum(words * rate).alias("_f"), _sum(words * x * rate * (1 - rate / most)).alias("_d"))
        gap = F.col("_f") - F.col("target")
        lo, hi = F.when(gap < 0, F.col("lam")).otherwise(F.col("lo")), F.when(gap > 0, F.col("lam")).otherwise(F.col("hi"))
        newton = F.col("lam") - gap / F.nullif(F.col("_d"), F.lit(0.0))
        step = F.when(newton.isNotNull() & (newton > lo) & (newton < hi), newton).otherwise(F.greatest(F.lit(-1e4), (lo + hi) / 2))
        near = F.abs(gap) <= F.col("target") * TOLERANCE + 1e-9  # what decimals of sums can hold
        moved = state.join(sums, state.source.eqNullSafe(sums._s), "left").select("source", "source_size", "target", "mean", F.when(F.col("_f").isNull() | near, F.col("lam")).otherwise(step).alias("lam"), F.when(F.col("_f").isNull(), F.col("lo")).otherwise(lo).alias("lo"), F.when(F.col("_f").isNull(), F.col("hi")).otherwise(hi).alias("hi"), (F.col("_f").isNull() | near).alias("done"))
        state = materialise(moved, "mix-state")
        if state.filter("not done").isEmpty():
            break
    else:
        raise ArithmeticError(f"no multiplier meets the constraint after {steps} steps: {state.filter('not done').select('source', 'target').limit(5).collect()}")
    return state.select("source", "source_size", "target", "mean", "lam")


def mix(docs: DataFrame, total: float = TOTAL, most: float = MOST, seed: int = 7, phases: int = PHASES, bucket_rows: int = BUCKET_ROWS, key: Column | None = None) -> DataFrame:
    """doc_id, source, size, source_size, target, rate, copies and taken of every document; ``_key`` is what ``key`` gives."""
    base = docs.select((F.lit(None).cast("binary") if key is None else key).alias("_key"), "doc_id", "source", F.coalesce(n_words(text_or_empty()), F.lit(0)).alias("size"), F.xxhash64(F.lit(seed), "doc_id", text_or_empty()).alias("_h"))
    base = materialise(base, "mix-rows")
    sizes = materialise(base.groupBy("source", "size").agg(F.count("*").alias("n")), "mix-sizes")
    sources = sizes.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("source_size"), F.sum("n").alias("n_docs"))
    sources = source_targets(sources, total, most)
    solved = solve_multipliers(sizes, sources, most)

    # What follows is a function of (source, size): rates, and buckets where a size has many rows.
    rated = sizes.join(solved.withColumnRenamed("source", "_s"), F.col("source").eqNullSafe(F.col("_s"))).drop("_s")
    rate = F.when(F.col("source_size") == 0, 1.0).when(F.col("lam").isNull(), float(most)).otherwise(_rate(F.col("lam"), F.col("size") / F.col("mean"), most))
    rated = rated.select("source", "size", "source_size", "target", rate.alias("rate"), F.ceil(F.col("n") / bucket_rows).alias("_buckets"))
    rated = materialise(rated, "mix-rates")
    r = rated.select(F.col("source").alias("_s"), F.col("size").alias("_z"), "source_size", "target", "rate", "_buckets")
    rows = base.join(r, base.source.eqNullSafe(r._s) & (base["size"] == r._z)).drop("_s", "_z")
    rows = materialise(rows.withColumn("_bucket", F.pmod("_h", "_buckets")).drop("_buckets"), "mix-rated")
    cells = rows.groupBy("source", "size", "_bucket").agg(F.count("*").alias("n"), F.first("rate").alias("rate"), F.first("target").alias("target"))
    run = Window.partitionBy("source").orderBy("size", "_bucket").rowsBetween(Window.unboundedPreceding, -1)
    cells = materialise(cells.withColumn("_from", F.coalesce(F.sum(F.col("n") * F.col("rate")).over(run), F.lit(0.0))), "mix-cells")  # counts, not documents
    offered = cells.select("*", F.posexplode(F.array(*(F.lit((p + 0.5) / phases) for p in range(phases)))).alias("_p", "phase"))
    cell_words = F.col("size") * (F.floor(F.col("_from") + F.col("n") * F.col("rate") + F.col("phase")) - F.floor(F.col("_from") + F.col("phase")))
    tried = offered.groupBy("source", "phase").agg(F.abs(F.sum(cell_words) - F.first("target")).alias("_off"))
    best = tried.groupBy("source").agg(F.min(F.struct("_off", "phase")).getField("phase").alias("phase"))
    cells = cells.join(best.withColumnRenamed("source", "_s"), F.col("source").eqNullSafe(F.col("_s"))).select(F.col("source").alias("_s"), F.col("size").alias("_z"), F.col("_bucket").alias("_b"), "_from", "phase")
    rank = F.row_number().over(Window.partitionBy("source", "size", "_bucket").orderBy("_h", "doc_id"))
    ranked = rows.withColumn("_rank", rank).join(cells, rows.source.eqNullSafe(F.col("_s")) & (F.col("size") == F.col("_z")) & (F.col("_bucket") == F.col("_b")))
    start = F.col("_from") + F.col("phase")
    copies = F.floor(start + F.col("_rank") * F.col("rate")) - F.floor(start + (F.col("_rank") - 1) * F.col("rate"))
    copies = F.least(F.lit(most), copies).cast("int")
    return ranked.select("doc_id", "source", "size", "source_size", "target", "rate", copies.alias("copies"), (copies * F.col("size")).cast("long").alias("taken"), "_h", "_key")


def apply_mix(docs: DataFrame, **options) -> DataFrame:
    """The mixed corpus: every document as often as the mix takes it, with its own columns."""
    key = identity("doc_id", "source", "text")
    taken = mix(docs.select("doc_id", "source", "text"), key=key, **options).select("_key", "copies")
    taken = materialise(taken, "mix-taken")
    repeated = materialise(taken.groupBy("_key").count().filter("count > 1").select("_key"), "mix-repeated")
    own, place, times, copy = (free_name(docs, c) for c in ("_key", "_i", "_copies", "_copy"))
    keyed = docs.withColumn(own, key)
    taken = taken.select(F.col("_key").alias(own), F.col("copies").alias(times))
    once = taken.filter(F.col(times) > 0)
    if repeated.isEmpty():
        out = keyed.join(once, own)
    else:  # rows of one id, source and text share a key: the i-th by all columns gets the i-th number of copies
        repeated = repeated.withColumnRenamed("_key", own)
        by = Window.partitionBy(own)
        counts = taken.join(repeated, own, "left_semi").withColumn(place, F.row_number().over(by.orderBy(F.desc(times))))
        same = keyed.join(repeated, own, "left_semi").withColumn(place, F.row_number().over(by.orderBy(F.xxhash64(*docs.columns)))).join(counts, [own, place]).drop(place)
        single = keyed.join(once.join(repeated, own, "left_anti"), own)
        out = single.unionByName(same.filter(F.col(times) > 0))
    return out.withColumn(copy, F.explode(F.sequence(F.lit(1), times))).select(*docs.columns)


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    return mix(docs).select("doc_id", "size", "source_size", "target", "taken", "copies", "rate")


QUERIES = {"op3_mixing": op3_mixing}
