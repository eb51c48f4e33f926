"""Performance of portfolio return series: risk, ratios and report tables.

Returns are rows ``(*keys, ts, r)``; ``keys`` name a strategy. One strategy
has one row per period, so arrays per strategy are bounded by the calendar.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from panelweave.config import PERIODS_PER_YEAR
from panelweave.functions.scalars import ratio


def array_mean(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda s, x: s + x) / F.when(F.size(a) > 0, F.size(a))


def lower_tail(returns: DataFrame, keys: Sequence[str], q: float, value: str = "r") -> DataFrame:
    """Linear ``quantile`` per key and the mean ``below`` it, itself included.

    The quantile is joined back to the rows, whose tail is then one average:
    no key's values meet in an array.
    """
    names = [f"__{k}" for k in keys]
    quantiles = returns.groupBy(*[F.col(k).alias(n) for k, n in zip(keys, names)]).agg(F.percentile(value, q).alias("quantile"))
    same = [F.col(k).eqNullSafe(F.col(n)) for k, n in zip(keys, names)]
    inside = F.when(F.col(value) <= F.col("quantile"), F.col(value))
    return returns.join(quantiles, same).groupBy(*keys).agg(F.first("quantile").alias("quantile"), F.avg(inside).alias("below"))


def var_cvar(returns: DataFrame, keys: Sequence[str], q: float = 0.05, value: str = "r") -> DataFrame:
    """Empirical VaR and CVaR: linear quantile and the mean of what lies below."""
    return lower_tail(returns, keys, q, value).select(*keys, (-F.col("quantile")).alias("value_at_risk"), (-F.col("below")).alias("cvar"))


def tail_count(n: Column, beta: float) -> Column:
    """``ceil((1 - beta) * n)`` without the rounding noise of ``1 - beta``."""
    return F.greatest(F.ceil(F.round((1 - beta) * n, 9)).cast("int"), F.lit(1))


def tail_count_cvar(returns: DataFrame, keys: Sequence[str], beta: float, value: str = "r") -> DataFrame:
    """Mean of the largest ``ceil((1 - beta) * n)`` losses; a key's rows are sorted, and spilled if need be, not held in an array."""
    per_key = W.partitionBy(*keys)
    ranked = returns.where(F.col(value).isNotNull()).select(
        *keys, F.col(value).alias("__r"), tail_count(F.count(value).over(per_key), beta).alias("__k"), F.row_number().over(per_key.orderBy(value)).alias("__i"))
    return ranked.where("__i <= __k").groupBy(*keys).agg(F.first("__k").cast("long").alias("n_tail"), (-F.avg("__r")).alias("cvar"))


def ratio_columns(value: str = "r", rf: float = 0.0, freq: int = PERIODS_PER_YEAR) -> list[Column]:
    """Annualised return and std, Sharpe and Sortino as aggregates."""
    r = F.col(value)
    x = r - rf / freq
    down = F.stddev_samp(F.when(x < 0, x))
    root = math.sqrt(freq)
    return [
        F.count(r).alias("n_obs"),
        (F.avg(r) * freq * 100).alias("ann_return_pct"),
        (F.stddev_samp(r) * root).alias("ann_std"),
        ratio(F.avg(x) * freq, F.stddev_samp(x) * root).alias("sharpe"),
        ratio(F.avg(x) * freq, down * root).alias("sortino"),
    ]


def ratios(returns: DataFrame, keys: Sequence[str], rf: float = 0.0, freq: int = PERIODS_PER_YEAR,
           value: str = "r") -> DataFrame:
    """Ratios per strategy in one aggregation.

    Sharpe is NULL for a constant series, Sortino when the negative returns
    are fewer than two or constant.
    """
    return returns.groupBy(*keys).agg(*ratio_columns(value, rf, freq))


def drawdown(path: Column, log: bool = False) -> Column:
    """Largest fall in percent from a running peak over ``(ts, value)`` pairs in date order.

    The peak starts at the first value reached, not at the money put in.
    """
    start = F.struct(F.lit(1.0).alias("level"), F.lit(None).cast("double").alias("peak"), F.lit(0.0).alias("low"))

    def step(state: Column, point: Column) -> Column:
        level = state["level"] * (F.exp(point["value"]) if log else 1 + point["value"])
        peak = F.greatest(state["peak"], level)
        return F.struct(level.alias("level"), peak.alias("peak"), F.least(state["low"], ratio(level - peak, peak)).alias("low"))

    return F.aggregate(path, start, step, lambda state: -state["low"] * 100)


def dated(value: str) -> Column:
    """A strategy's values as an array of ``(ts, value)`` in date order."""
    return F.sort_array(F.collect_list(F.struct("ts", F.col(value).alias("value"))))


def max_drawdown(returns: DataFrame, keys: Sequence[str], value: str = "r", log: bool = False) -> DataFrame:
    return returns.groupBy(*keys).agg(dated(value).alias("path")).select(
        *keys, drawdown(F.col("path"), log).alias("mdd_pct"))


def return_over_cvar(returns: DataFrame, keys: Sequence[str], q: float = 0.05, freq: int = PERIODS_PER_YEAR,
                     value: str = "r", positive_only: bool = False) -> DataFrame:
    """Annual mean return over empirical CVaR, NULL for a zero (or negative) CVaR."""
    annual = returns.groupBy(*keys).agg((F.avg(value) * freq).alias("ann"))
    loss = lower_tail(returns, keys, q, value).select(*keys, (-F.col("below")).alias("loss"))
    usable = F.col("loss") > 0 if positive_only else F.col("loss") != 0
    return annual.join(loss, list(keys)).select(*keys, (F.col("ann") / F.when(usable, F.col("loss"))).alias("return_cvar"))


def return_over_ex_ante_cvar(returns: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Mean return over mean ex-ante CVaR (not annualised), rows with both only."""
    known = returns.where(F.col("cvar").isNotNull() & F.col("r").isNotNull())
    mean_cvar = F.avg("cvar")
    return known.groupBy(*keys).agg(
        (F.avg("r") / F.when(mean_cvar > 1e-10, mean_cvar)).alias("return_cvar"))


def diversification_benefit(returns: DataFrame, weights: DataFrame, assets: DataFrame, keys: Sequence[str],
                            q: float = 0.01, positive_only: bool = True) -> DataFrame:
    """Conditional diversification benefit of each strategy.

    ``(C_bar - C_p) / (C_bar - VaR_p)`` with C_bar the mean-weighted sum of the
    single-asset CVaRs over the strategy's own dates. A denominator of zero
    (or, by default, below) gives NULL.
    """
    held = (
        returns.select(*keys, "ts").join(weights, [*keys, "ts"])
        .join(assets.select("series_id", "ts", F.col("value").alias("x")), ["series_id", "ts"])
    )
    each = [*keys, "series_id"]
    single = (
        held.groupBy(*each).agg(F.avg("w").alias("w")).join(lower_tail(held, each, q, "x"), each)
        .groupBy(*keys).agg(F.sum(F.col("w") * -F.col("below")).alias("cvar_bar"))
    )
    own = var_cvar(returns, keys, q)
    gap = F.col("cvar_bar") - F.col("value_at_risk")
    usable = gap > 0 if positive_only else gap != 0
    return single.join(own, list(keys)).select(
        *keys, ((F.col("cvar_bar") - F.col("cvar")) / F.when(usable, gap)).alias("cdb"))


def bundle(returns: DataFrame, keys: Sequence[str], weights: DataFrame | None = None,
           assets: DataFrame | None = None, q: float = 0.05, log_drawdown: bool = False) -> DataFrame:
    """All performance metrics of each strategy from a single aggregation.

    With weights and asset returns the diversification benefit is joined in.
    """
    packed = returns.groupBy(*keys).agg(
        *ratio_columns(), F.percentile("r", q).alias("quantile"), dated("r").alias("path"))
    values = F.transform("path", lambda p: p["value"])  # the path is there for the drawdown
    loss = -array_mean(F.filter(values, lambda x: x <= F.col("quantile")))
    out = packed.select(
        *keys, "n_obs", "ann_return_pct", "ann_std", "sharpe", "sortino",
        drawdown(F.col("path"), log_drawdown).alias("mdd_pct"),
        ratio(F.col("ann_return_pct") / 100, loss).alias("return_cvar"))
    if weights is not None and assets is not None:
        out = out.join(diversification_benefit(returns, weights, assets, keys), list(keys), "left")
    return out


def mean_weights(weights: DataFrame, keys: Sequence[str]) -> DataFrame:
    return weights.groupBy(*keys, "series_id").agg(F.avg("w").alias("w"))


def group_averages(metrics: DataFrame, forecast: str, dependence: str, columns: Sequence[str]) -> DataFrame:
    """Strategy rows with averages per forecast, per dependence and overall.

    Averages are of the metrics, not of the returns. One grouping-sets
    aggregation produces every level.
    """
    f, d = F.col(forecast), F.col(dependence)
    out = metrics.groupingSets([[f, d], [f], [d], []], f, d).agg(
        F.grouping_id().cast("int").alias("g"), *[F.avg(c).alias(c) for c in columns])
    level = (
        F.when(F.col("g") == 0, F.lit("strategy")).when(F.col("g") == 1, F.lit("forecast average"))
        .when(F.col("g") == 2, F.lit("dependence average")).otherwise(F.lit("total average"))
    )
    return out.select(level.alias("level"), f, d, *columns)


def best_strategy(returns: DataFrame, groups: Sequence[str], keys: Sequence[str]) -> DataFrame:
    """Strategy with the highest mean return over mean ex-ante CVaR per group."""
    scored = return_over_ex_ante_cvar(returns, [*groups, *keys]).where(F.col("return_cvar").isNotNull())
    best = F.max_by(F.struct(*keys), F.struct("return_cvar", *keys))
    return (
        scored.groupBy(*groups).agg(best.alias("best"), F.max("return_cvar").alias("return_cvar"))
        .select(*groups, *[F.col("best")[k].alias(k) for k in keys], "return_cvar")
    )
