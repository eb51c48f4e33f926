"""Augmented Dickey-Fuller test with a constant, lag chosen by AIC."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelweave.operators.regression import coefficients, moments
from panelweave.operators.windows import by_series

# Asymptotic critical values of MacKinnon for the case with a constant.
CRITICAL = (("1%", -3.43), ("5%", -2.86), ("10%", -2.57))


def unit_root_test(panel: DataFrame, max_lag: int = 12) -> DataFrame:
    """Regress the change on the level and past changes, per series.

    All lag lengths share one sample, so they are nested fits of one matrix.
    """
    w = by_series()
    level = lambda k: F.lag("value", k).over(w)
    rows = panel.select(
        "series_id", "ts", (F.col("value") - level(1)).alias("y"), level(1).alias("x1"),
        *[(level(k) - level(k + 1)).alias(f"x{k + 1}") for k in range(1, max_lag + 1)],
    ).where(F.col("y").isNotNull() if max_lag == 0 else F.col(f"x{max_lag + 1}").isNotNull())
    xs = [f"x{k}" for k in range(1, max_lag + 2)]
    models = [list(range(k + 2)) for k in range(max_lag + 1)]
    fits = coefficients(moments(rows, ["series_id"], xs), ["series_id"], models, [str(k) for k in range(max_lag + 1)], len(xs) + 1, name="lag")
    lag = F.col("lag").cast("int")
    scored = fits.where((F.col("sse") > 0) & (F.col("se")[1] > 0)).select(
        "series_id", lag.alias("lag"), (F.col("coef")[1] / F.col("se")[1]).alias("adf"),
        (F.col("n") * F.log(F.col("sse") / F.col("n")) + 2 * (lag + 2)).alias("aic"),
    )
    best = scored.groupBy("series_id").agg(F.min(F.struct("aic", "lag", "adf")).alias("b")).select(
        "series_id", F.col("b.lag").alias("lag"), F.col("b.adf").alias("adf"))
    mark = F.lit("")
    for name, bound in reversed(CRITICAL):
        mark = F.when(F.col("adf") < bound, F.lit(name)).otherwise(mark)
    return best.withColumn("rejected", mark)
