"""Summaries of pairs and series from sufficient statistics: one partial aggregate each, then work on one row a group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from aerolake.sources.intermediate import materialise


def bias_ratio(pairs: DataFrame, least: int, default: float, *by: str) -> DataFrame:
    """sum(o) / sum(p) with ``least`` pairs or more and a positive sum of p, else ``default``."""
    ratio = F.when((F.count("*") >= least) & (F.sum("p") > 0), F.sum("o") / F.nullif(F.sum("p"), F.lit(0.0))).otherwise(F.lit(default))
    return pairs.dropna(subset=["o", "p"]).groupBy(*by).agg(ratio.alias("ratio"), F.count("*").alias("n"))


def fit_line(pairs: DataFrame, *by: str) -> DataFrame:
    """Least-squares line o = a + b p and its mean absolute error; the lines, one row a group, go back to the pairs."""
    good = pairs.dropna(subset=["o", "p"])
    lines = good.groupBy(*by).agg(F.regr_slope("o", "p").alias("b"), F.regr_intercept("o", "p").alias("a"))
    return good.join(lines, list(by)).groupBy(*by, "a", "b").agg(F.avg(F.abs(F.col("o") - F.col("a") - F.col("b") * F.col("p"))).alias("mae"))


def kfold_scores(pairs: DataFrame, fold: Column, *by: str) -> DataFrame:
    """Held-out error of p scaled by the other folds' ratio of sums, for each fold: five sums a fold hold all that is needed."""
    sums = pairs.dropna(subset=["o", "p"]).groupBy(*by, fold.alias("fold")).agg(
        F.count("*").alias("n"), F.sum("o").alias("so"), F.sum("p").alias("sp"), F.sum(F.col("o") * F.col("o")).alias("soo"), F.sum(F.col("o") * F.col("p")).alias("sop"), F.sum(F.col("p") * F.col("p")).alias("spp")
    )
    every = Window.partitionBy(*by)  # a row a fold
    beta = (F.sum("so").over(every) - F.col("so")) / F.nullif(F.sum("sp").over(every) - F.col("sp"), F.lit(0.0))
    held = sums.withColumn("beta", beta)
    mse = (F.col("soo") - 2 * F.col("beta") * F.col("sop") + F.col("beta") * F.col("beta") * F.col("spp")) / F.col("n")
    return held.select(*by, "fold", "n", "beta", F.sqrt(F.greatest(mse, F.lit(0.0))).alias("rmse"))


#: Bins that a round of ``quantiles`` divides a rank's range into.
BINS = 1024


def quantiles(rows: DataFrame, column: str, shares: list[float], *by: str) -> DataFrame:
    """Exact quantiles with linear interpolation, as columns q0, q1, ..., and ``n``; NULL values take no part.

    Values are counted by distinct value. Each rank asked for has a range that holds it, at first its group's; a round counts the values in
    the range by bins and goes on with the least and the largest value of the bin that holds the rank, until both are the same. Outliers
    cost a round, and no task orders or holds a group or a bin.
    """
    group = list(by)
    counted = materialise(rows.filter(F.col(column).isNotNull()).groupBy(*by, F.col(column).cast("double").alias("_v")).agg(F.count("*").alias("_c")), "counted")
    ranges = counted.groupBy(*by).agg(F.sum("_c").alias("n"), F.min("_v").alias("_lo"), F.max("_v").alias("_hi")).filter("n > 0")
    at = [F.lit(s) * (F.col("n") - 1) for s in shares]
    ranks = F.array(*(F.struct(F.lit(2 * i + k).alias("_k"), r.cast("long").alias("_r")) for i, x in enumerate(at) for k, r in enumerate((F.floor(x), F.ceil(x)))))
    asked = materialise(ranges.select(*by, "n", "_lo", "_hi", F.lit(0).cast("long").alias("_before"), F.inline(ranks)), "ranks")
    found = None
    while True:
        done = asked.filter("_lo = _hi").select(*by, "n", "_k", F.col("_lo").alias("_q"))
        found = done if found is None else found.union(done)
        wide = asked.filter("_lo < _hi")
        if wide.isEmpty():
            break
        met = counted.join(wide, group) if by else counted.join(F.broadcast(wide), F.lit(True))  # two ranks a share
        share = (F.col("_v") - F.col("_lo")) / (F.col("_hi") - F.col("_lo"))
        share = F.coalesce(F.when(~F.isnan(share), share), F.lit(0.0))
        # The largest value has a bin of its own, so every round parts a range, whatever its size.
        place = F.when(F.col("_v") == F.col("_hi"), F.lit(BINS - 1).cast("long")).otherwise(F.least(F.floor(share * BINS), F.lit(BINS - 2)))
        bins = met.filter(F.col("_v").between(F.col("_lo"), F.col("_hi"))).groupBy(*by, "n", "_k", "_r", "_before", place.alias("_bin")).agg(F.sum("_c").alias("_c"), F.min("_v").alias("_lo"), F.max("_v").alias("_hi"))
        upto = F.col("_before") + F.sum("_c").over(Window.partitionBy(*by, "_k").orderBy("_bin"))
        held = bins.withColumn("_upto", upto).filter((F.col("_r") < F.col("_upto")) & (F.col("_r") >= F.col("_upto") - F.col("_c")))
        asked = materialise(held.select(*by, "n", "_lo", "_hi", (F.col("_upto") - F.col("_c")).alias("_before"), "_k", "_r"), "ranks")
    got = found.groupBy(*by, "n").agg(*(F.max(F.when(F.col("_k") == k, F.col("_q"))).alias(f"_q{k}") for k in range(2 * len(shares))))
    between = [F.col(f"_q{2 * i}") + (F.col(f"_q{2 * i + 1}") - F.col(f"_q{2 * i}")) * (x - F.floor(x)) for i, x in enumerate(at)]
    return got.select(*by, "n", *(x.alias(f"q{i}") for i, x in enumerate(between)))


def monthly_capture(series: DataFrame, least: float) -> DataFrame:
    """Rows of the (key, month) whose hours cover ``least`` of the month."""
    month = series.withColumn("month", F.trunc(F.to_date(F.col("t") - F.expr("INTERVAL 1 HOUR")), "month"))  # of the hour's start, in UTC
    kept = month.groupBy("key", "month").agg(F.count("v").alias("n")).filter(F.col("n") >= least * 24 * F.dayofmonth(F.last_day("month")))
    return month.join(kept, ["key", "month"], "left_semi")


def bookkeeping(rows: DataFrame, *by: str) -> DataFrame:
    """Rows, distinct hours, missing values and validated rows of each group."""
    return rows.groupBy(*by).agg(F.count("*").alias("n"), F.countDistinct("t").alias("hours"), F.count_if(F.col("v").isNull()).alias("masked"), F.count_if(F.col("validated") == 1).alias("val_rows"))


def sampled(shares: DataFrame, draws: DataFrame, order: str) -> DataFrame:
    """(draw columns, order): for each draw ``r`` in [0, 1) the first row whose running ``share`` exceeds it. ``shares`` is a small table."""
    below = Window.orderBy("share")
    steps = shares.withColumn("_from", F.coalesce(F.lag("share").over(below), F.lit(0.0)))
    return draws.join(F.broadcast(steps), (F.col("r") >= F.col("_from")) & (F.col("r") < F.col("share"))).select(*draws.columns, order)


def cumulative_share(weights: DataFrame, order: str, *by: str) -> DataFrame:
    """Running share of the weight ``w`` along ``order``, for sampling by the inverse distribution."""
    group = Window.partitionBy(*by)
    run = group.orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return weights.withColumn("share", F.sum("w").over(run) / F.nullif(F.sum("w").over(group), F.lit(0.0)))


def lookup(weights: Column, table: list[float]) -> Column:
    """Weighted mean of a small table's entries: weights and table have the same order."""
    products = F.zip_with(weights, F.array(*map(F.lit, table)), lambda w, x: w * x)
    return F.aggregate(products, F.lit(0.0), lambda a, x: a + x)


def packed_int16(value: Column, scale: float, missing: int = -32768) -> Column:
    """A value as a scaled 16-bit integer, halves to even, clipped; missing and not-a-number become ``missing``."""
    clipped = F.greatest(F.lit(-32767.0), F.least(F.lit(32767.0), F.rint(value / scale)))
    return F.when(value.isNull() | F.isnan(value), F.lit(missing)).otherwise(clipped.cast("int")).cast("int")


def unpacked_int16(code: Column, scale: float, missing: int = -32768) -> Column:
    return F.when(code == missing, F.lit(None).cast("double")).otherwise(code * scale)
