"""Two-parameter fit p = beta * s / sqrt(u^2 + u0^2) by grids: one aggregate for all grid points and folds at once."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def grid_fit(rows: DataFrame, u0s: list[float], c0: float = 1.0, *by: str) -> DataFrame:
    """(by, u0, beta, loss): least mean square of ln(o + c0) - ln(p + c0) with c0 = 0 in p; for each u0 the best beta is closed-form.

    ``rows``: (o, s, u). All points of the grid are sums of one aggregate, so a row is read once and never multiplied.
    """
    good = rows.filter((F.col("o") > -c0) & (F.col("s") > 0))
    logs = good.select(*by, (F.ln(F.col("o") + c0) - F.ln("s")).alias("d"), (F.col("u") * F.col("u")).alias("u2"))
    gaps = logs.select(*by, *((F.col("d") + F.ln(F.col("u2") + u0 * u0) / 2).alias(f"g{i}") for i, u0 in enumerate(u0s)))
    sums = gaps.groupBy(*by).agg(*(F.struct(F.round(F.var_pop(f"g{i}") + 1e-9, 9).alias("loss"), F.lit(float(u0)).alias("u0"), F.avg(f"g{i}").alias("m")).alias(f"b{i}") for i, u0 in enumerate(u0s)))
    best = sums.select(*by, F.array_min(F.array(*(F.col(f"b{i}") for i in range(len(u0s))))).alias("b"))
    return best.select(*by, F.col("b.u0").alias("u0"), F.exp("b.m").alias("beta"), F.col("b.loss").alias("loss"))
