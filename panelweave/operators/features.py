"""Feature building on forecast pools and lag matrices."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from panelweave.config import IN_SAMPLE, Split
from panelweave.functions.scalars import clip


def clip_forecasts(forecasts: DataFrame, actuals: DataFrame, multiple: float = 5.0) -> DataFrame:
    """Bound forecasts by a multiple of the series' std over the past only."""
    before = W.partitionBy("series_id").orderBy("ts").rowsBetween(W.unboundedPreceding, -1)
    scale = actuals.select("series_id", "ts", F.stddev_pop("value").over(before).alias("sd")).where(F.col("sd") > 0)
    bound = multiple * F.col("sd")
    return (
        forecasts.join(scale, ["series_id", "ts"])
        .select("series_id", "model", "ts", clip("yhat", -bound, bound).alias("yhat"))
    )


def spread_pool(forecasts: DataFrame, panel: DataFrame, models: Sequence[str]) -> DataFrame:
    """Every (series, date) of the panel with every model of a fixed list.

    Missing forecasts are NULL. The model list is a literal array that a
    generator repeats per row, so no product of tables is formed.
    """
    rows = panel.select("series_id", "ts", F.explode(F.array(*[F.lit(m) for m in models])).alias("model"))
    return (
        rows.join(forecasts, ["series_id", "ts", "model"], "left")
        .select("series_id", "model", "ts", "yhat")
    )


def impute_pool(pool: DataFrame, share: float = 0.9, fit: Split = IN_SAMPLE) -> DataFrame:
    """Drop models below a share of valid rows in the fit period, fill the rest with their mean over that period.

    Nothing after the fit period enters; a model without a valid row in it is dropped.
    """
    w = W.partitionBy("series_id", "model")
    inside = (F.col("ts") >= F.lit(fit.start)) & (F.col("ts") < F.lit(fit.end))
    known = F.when(inside, F.col("yhat"))
    return (
        pool.withColumn("valid", F.count(known).over(w)).withColumn("rows", F.count(F.when(inside, 1)).over(w))
        .withColumn("mean", F.avg(known).over(w))
        .where((F.col("valid") > 0) & (F.col("valid") >= share * F.col("rows")))
        .select("series_id", "model", "ts", F.coalesce("yhat", "mean").alias("yhat"))
    )


def standardise(pool: DataFrame, fit: Split, value: str = "yhat") -> DataFrame:
    """Zero mean and unit population std, both taken from the fit period only."""
    inside = (F.col("ts") >= F.lit(fit.start)) & (F.col("ts") < F.lit(fit.end))
    w = W.partitionBy("series_id", "model")
    x = F.when(inside, F.col(value))
    out = pool.withColumn("m", F.avg(x).over(w)).withColumn("s", F.stddev_pop(x).over(w)).where(F.col("s") > 0)
    return out.select("series_id", "model", "ts", ((F.col(value) - F.col("m")) / F.col("s")).alias("z"))


def standardise_columns(df: DataFrame, columns: Sequence[str], fit: Split) -> DataFrame:
    """The same for columns of a lag matrix, per series."""
    inside = (F.col("ts") >= F.lit(fit.start)) & (F.col("ts") < F.lit(fit.end))
    w = W.partitionBy("series_id")
    moments = {}
    for c in columns:
        x = F.when(inside, F.col(c))
        moments[f"{c}__m"] = F.avg(x).over(w)
        moments[f"{c}__s"] = F.stddev_pop(x).over(w)
    out = df.withColumns(moments)
    scaled = {c: (F.col(c) - F.col(f"{c}__m")) / F.when(F.col(f"{c}__s") > 0, F.col(f"{c}__s")) for c in columns}
    return out.withColumns(scaled).drop(*moments)


def cross_products(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Add all squares and products of two columns."""
    return df.withColumns({
        f"{a}_{b}": F.col(a) * F.col(b) for i, a in enumerate(columns) for b in columns[i:]
    })


def radial(df: DataFrame, columns: Sequence[str], centres: Sequence[Sequence[float]], sigma: float) -> DataFrame:
    """Gaussian bumps ``phi1..`` around given centres.

    The centres are a handful of numbers and become literals of the projection.
    """
    new = {}
    for k, centre in enumerate(centres, start=1):
        dist = sum(((F.col(c) - F.lit(float(m))) * (F.col(c) - F.lit(float(m))) for c, m in zip(columns, centre)), F.lit(0.0))
        new[f"phi{k}"] = F.exp(-dist / (2 * sigma * sigma))
    return df.withColumns(new)


def strategy_grid(dates: DataFrame, forecasts: Sequence[str], dependences: Sequence[str], betas: Sequence[float],
                  panels: Sequence[str]) -> DataFrame:
    """Every combination of the four fixed lists for each date, with its label."""
    combos = [
        F.struct(F.lit(f).alias("forecast"), F.lit(d).alias("dependence"), F.lit(b).alias("beta"), F.lit(p).alias("panel"),
                 F.lit(f"{f}-{d}-SKT-{round(b * 100)}-{p}").alias("label"))
        for f in forecasts for d in dependences for b in betas for p in panels
    ]
    return dates.select(F.inline(F.array(*combos)), "ts")


def parse_label(df: DataFrame, label: str) -> DataFrame:
    """Split ``{forecast}-{dependence}-SKT``; the forecast may hold dashes itself."""
    parts = F.split(label, "-")
    n = F.size(parts)
    return df.withColumns({
        "forecast": F.array_join(F.slice(parts, 1, n - 2), "-"),
        "dependence": F.element_at(parts, -2),
    })
