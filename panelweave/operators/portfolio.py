"""Portfolio weights and the returns they earn."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelweave.operators import tangent as T
from panelweave.operators.dependence import correlation_matrix, covariance, repair
from panelweave.operators.panel import spread, wide


def equal_weights(members: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``1 / n`` for every member of a strategy on a date.

    The counts are a partial aggregation joined back, not a window, so a
    strategy with very many members never sits in one task.
    """
    on = [*keys, "ts"]
    counts = members.groupBy(*on).agg((1.0 / F.count("*")).alias("w"))
    return members.select(*on, "series_id").join(counts, on).select(*on, "series_id", "w")


def portfolio_returns(weights: DataFrame, returns: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``sum(w * r)`` per strategy and date; dates with a missing return are dropped."""
    r = returns.select("series_id", "ts", F.col("value").alias("r"))
    out = (
        weights.join(r, ["series_id", "ts"], "left").groupBy(*keys, "ts")
        .agg(F.sum(F.col("w") * F.col("r")).alias("r"), F.count_if(F.col("r").isNull()).alias("missing"))
    )
    return out.where(F.col("missing") == 0).drop("missing")


LONG_ONLY, LEVERAGED = "long_only", "130_30"
#: The total short position that a panel allows.
SHORT = {LONG_ONLY: 0.0, LEVERAGED: 0.3}


def weight_rows(df: DataFrame, assets: Sequence[str], keys: Sequence[str], column: str = "weights") -> DataFrame:
    """A weights array as rows ``(keys, series_id, w)``."""
    names = F.array(*[F.lit(a) for a in assets])
    return df.where(F.col(column).isNotNull()).select(*keys, F.posexplode(column).alias("i", "w")).select(
        *keys, names[F.col("i")].alias("series_id"), "w")


# --- backtests -----------------------------------------------------------------------------

def forecast_vectors(forecasts: DataFrame, assets: Sequence[str]) -> DataFrame:
    """Forecasts of a date as vectors ``(forecast, ts, mu)``, complete ones only."""
    cells = F.array(*[F.max(F.when(F.col("series_id") == a, F.col("yhat"))) for a in assets])
    out = forecasts.groupBy(F.col("model").alias("forecast"), "ts").agg(cells.alias("mu"))
    return out.where(~F.exists("mu", lambda x: x.isNull()))


def volatility_vectors(vol: DataFrame, assets: Sequence[str]) -> DataFrame:
    """Volatilities of a date as vectors ``(ts, s)``, all positive."""
    return wide(vol.select("series_id", "ts", F.col("sigma").alias("value")), assets, "s").where(
        F.forall("s", lambda x: x > 0))


def mean_variance_inputs(forecasts: DataFrame, corr: DataFrame, vol: DataFrame, assets: Sequence[str]) -> DataFrame:
    """``(forecast, dependence, ts, mu, cov)`` wherever all three inputs exist.

    Every forecast meets every dependence model of a date through the join on
    the date; dates with a missing input drop out.
    """
    matrix = correlation_matrix(corr, assets).select(F.col("model").alias("dependence"), "ts", repair("matrix").alias("matrix"))
    inputs = forecast_vectors(forecasts, assets).join(matrix, "ts").join(volatility_vectors(vol, assets), "ts")
    return inputs.select("forecast", "dependence", "ts", "mu", covariance("matrix", "s").alias("cov"))


def mean_variance(inputs: DataFrame, assets: Sequence[str], panels: Sequence[str] = (LONG_ONLY, LEVERAGED), steps: dict[str, int] | None = None) -> DataFrame:
    """Weights ``(forecast, dependence, panel, ts, series_id, w)`` of all strategies.

    The largest ratio is found exactly; with ``steps`` per panel it is that of a grid of weights.
    """
    return weight_rows(mean_variance_choices(inputs, assets, panels, steps), assets, ["forecast", "dependence", "panel", "ts"]).select(
        "forecast", "dependence", "panel", "ts", "series_id", "w")


def mean_variance_choices(inputs: DataFrame, assets: Sequence[str] = (), panels: Sequence[str] = (LONG_ONLY, LEVERAGED), steps: dict[str, int] | None = None) -> DataFrame:
    """``(forecast, dependence, ts, panel, weights, ratio)``, and without ``steps`` the ``gap`` that is left.

    Inputs with a column ``rest`` hold factors in ``cov``: of very many assets no matrix over pairs is formed.
    """
    keys, n, rest = ["forecast", "dependence", "ts"], len(assets), "rest" if "rest" in inputs.columns else None
    rows = spread(inputs, *keys)
    if steps:
        parts = [T.lattice_sharpe(rows, keys, n, steps[p], SHORT[p]).withColumn("panel", F.lit(p)) for p in panels]
        return reduce(DataFrame.unionByName, parts)
    found = F.array(*[F.struct(F.lit(p).alias("panel"), T.sharpe_weights("mu", "cov", SHORT[p], rest).alias("best")) for p in panels])
    return rows.select(*keys, F.inline(found)).select(*keys, "panel", "best.*").where(F.col("weights").isNotNull())


def scenario_sets(windows: DataFrame, vol: DataFrame, keys: Sequence[str] = ("ts",)) -> DataFrame:
    """``(keys, vectors, times)``: residual vectors on the volatility of the date ahead, all counting alike unless ``times`` is given."""
    times = F.col("times") if "times" in windows.columns else F.transform("window", lambda _: F.lit(1))
    scaled = F.transform("window", lambda z: F.zip_with(z, F.col("s"), lambda a, b: a * b))
    return windows.join(vol, "ts").select(*keys, scaled.alias("vectors"), times.alias("times"))


def mean_cvar_inputs(forecasts: DataFrame, sets: DataFrame, assets: Sequence[str]) -> DataFrame:
    """Scenario sets around zero, one row each, with all forecast vectors of their date."""
    vectors = forecast_vectors(forecasts, assets).groupBy("ts").agg(F.sort_array(F.collect_list(F.struct("forecast", "mu"))).alias("forecasts"))
    return sets.join(vectors, "ts")


def mean_cvar(inputs: DataFrame, assets: Sequence[str], on: Sequence[str], draws: int, betas: Sequence[float] = (0.95, 0.99),
              panels: Sequence[str] = (LONG_ONLY, LEVERAGED), steps: dict[str, int] | None = None) -> DataFrame:
    """``(forecast, on, beta, panel, weights, ratio, cvar)`` for every forecast, level and panel.

    A row of the inputs is a scenario set of ``draws`` scenarios, named by the columns ``on``. Portfolios are searched; with
    ``steps`` per panel they are the best of a grid of weights.
    """
    rows, parts = spread(inputs, *on), []
    for p in panels:
        if steps:
            found = T.lattice_cvar(rows, on, len(assets), draws, betas, steps[p], SHORT[p])
        else:
            mus = rows.withColumn("mus", F.col("forecasts.mu"))
            each = mus.select(*on, "forecasts", F.inline(T.cvar_weights("mus", "vectors", "times", draws, betas, SHORT[p])))
            found = each.select(*on, F.col("forecasts")[F.col("at")]["forecast"].alias("forecast"), "beta", "weights", "ratio", "cvar")
        parts.append(found.select("forecast", *on, "beta", F.lit(p).alias("panel"), "weights", "ratio", "cvar"))
    return reduce(DataFrame.unionByName, parts)


def mean_cvar_backtest(choices: DataFrame, returns: DataFrame, assets: Sequence[str], keys: Sequence[str]) -> DataFrame:
    """Realised return next to the ex-ante CVaR: ``(keys, beta, panel, ts, r, cvar)``.

    The realised vector of a date is joined once and the return is computed
    inside the row; dates without a complete vector are dropped.
    """
    realised = wide(returns, assets, "x")
    r = F.aggregate(F.zip_with("weights", "x", lambda w, x: w * x), F.lit(0.0), lambda s, v: s + v)
    names = [k for k in keys if k != "ts"]
    return choices.join(realised, "ts").select(*names, "beta", "panel", "ts", r.alias("r"), "cvar")
