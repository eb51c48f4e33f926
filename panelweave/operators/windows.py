"""Window operators. All columns of one call share a single sort per series."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

def by_series():
    return W.partitionBy("series_id").orderBy("ts")


def past(n: int):
    """The ``n`` rows before the current one."""
    return by_series().rowsBetween(-n, -1)


def melt(df: DataFrame, columns: dict[str, str], keys: Sequence[str], name: str, value: str) -> DataFrame:
    """Turn columns into rows, labelling each with the given text."""
    cells = ", ".join(f"'{label}', `{c}`" for c, label in columns.items())
    return df.selectExpr(*keys, f"stack({len(columns)}, {cells}) AS ({name}, {value})")


def as_rows(panel: DataFrame, wide: DataFrame) -> DataFrame:
    """``Forecast`` rows from the columns that a panel got, each named as its model."""
    labels = [c for c in wide.columns if c not in panel.columns]
    return melt(wide, dict(zip(labels, labels)), ["series_id", "ts"], "model", "yhat")


def walk_column(panel: DataFrame) -> DataFrame:
    """The panel with the value before each row as column ``RW``."""
    return panel.withColumn("RW", F.lag("value").over(by_series()))


def random_walk(panel: DataFrame) -> DataFrame:
    return panel.select("series_id", F.lit("RW").alias("model"), "ts", F.lag("value").over(by_series()).alias("yhat"))


def trailing_mean(q: int) -> Column:
    """Mean of the last q values before each row, NULL until there are q.

    Each mean is taken over its own frame, so a NaN or a huge value leaves the
    means of later frames alone; all frames share one sort. A NULL inside a
    frame makes its mean NULL.
    """
    return F.when(F.count("value").over(past(q)) == q, F.avg("value").over(past(q)))


def trailing_means(panel: DataFrame, spans: Sequence[int]) -> DataFrame:
    """``q{n}`` columns: the trailing means of n values, and the value before as ``q0``."""
    return panel.select("series_id", "ts", F.lag("value").over(by_series()).alias("q0"), *[trailing_mean(q).alias(f"q{q}") for q in spans])


def sma_columns(panel: DataFrame, spans: Sequence[int] = range(3, 31)) -> DataFrame:
    """The panel with a column ``SMA(q)`` for each of the spans."""
    return panel.withColumns({f"SMA({q})": trailing_mean(q) for q in spans})


def sma_bank(panel: DataFrame, spans: Sequence[int] = range(3, 31)) -> DataFrame:
    wide = trailing_means(panel, spans)
    return melt(wide, {f"q{q}": f"SMA({q})" for q in spans}, ["series_id", "ts"], "model", "yhat")


def simple_pool(panel: DataFrame, spans: Sequence[int] = (3, 6, 12)) -> DataFrame:
    """Random walk and a few moving averages in one pass: ``Forecast`` rows."""
    labels = {"q0": "RW", **{f"q{q}": f"SMA({q})" for q in spans}}
    wide = trailing_means(panel, spans)
    return melt(wide, labels, ["series_id", "ts"], "model", "yhat").where(F.col("yhat").isNotNull())


def lag_matrix(panel: DataFrame, lags: int, complete: bool = True) -> DataFrame:
    """``y`` with its ``lags`` previous values ``x1..``; incomplete rows dropped."""
    out = panel.select(
        "series_id", "ts", F.col("value").alias("y"),
        *[F.lag("value", k).over(by_series()).alias(f"x{k}") for k in range(1, lags + 1)],
    )
    return out.where(F.col(f"x{lags}").isNotNull()) if complete else out


def rolling_std(panel: DataFrame, window: int, minimum: int = 2) -> DataFrame:
    w = past(window)
    sigma = F.when(F.count("value").over(w) >= minimum, F.stddev_samp("value").over(w))
    return panel.select("series_id", "ts", sigma.alias("sigma"))


def rolling_windows(panel: DataFrame, window: int) -> DataFrame:
    """One row per series and date holding the ``window`` values before it."""
    out = panel.select("series_id", "ts", F.collect_list("value").over(past(window)).alias("window"))
    return out.where(F.size("window") == window)


def running_product(c: Column, window) -> Column:
    """Product of the window's values, also through zero and below it."""
    size = F.exp(F.sum(F.when(c != 0, F.log(F.abs(c)))).over(window))
    sign = F.when(F.count_if(c < 0).over(window) % 2 == 1, -1.0).otherwise(1.0)
    return F.when(F.count_if(c == 0).over(window) > 0, F.lit(0.0)).otherwise(F.coalesce(size, F.lit(1.0)) * sign)


def growth_index(panel: DataFrame, base: float = 100.0, log: bool = False) -> DataFrame:
    """Value of ``base`` invested before the first date, from simple or log returns."""
    w = by_series().rowsBetween(W.unboundedPreceding, 0)
    growth = F.exp(F.sum("value").over(w)) if log else running_product(1 + F.col("value"), w)
    return panel.select("series_id", "ts", (base * growth).alias("index_value"))


def average_rank(c: str, keys: Sequence[str]) -> Column:
    """Rank with ties given their mean position."""
    w = W.partitionBy(*keys)
    ties = F.count("*").over(W.partitionBy(*keys, c))
    return F.rank().over(w.orderBy(c)) + (ties - 1) / 2


def empirical_pit(panel: DataFrame, bound: float = 1e-6) -> DataFrame:
    """``rank / (n + 1)`` per series, kept inside ``[bound, 1 - bound]``."""
    n = F.count("*").over(W.partitionBy("series_id"))
    u = average_rank("value", ["series_id"]) / (n + 1)
    return panel.select("series_id", "ts", F.least(F.greatest(u, F.lit(bound)), F.lit(1 - bound)).alias("u"))
