"""From the whole pool to portfolios: reduction, combination, evaluation and backtests in one chain."""

from __future__ import annotations

from pyspark.sql import functions as F

from panelweave.config import ASSETS, OOS
from panelweave.functions import scalars as S
from panelweave.operators import bootstrap as B
from panelweave.operators import combine as C
from panelweave.operators import evaluate as E
from panelweave.operators import features as X
from panelweave.operators import forecast as M
from panelweave.operators import panel as P
from panelweave.operators import performance as R
from panelweave.operators import portfolio as O
from panelweave.operators import scenario as Z
from panelweave.operators import volatility as V
from panelweave.operators import windows as N
from panelweave.plans.dependence import all_correlations, order_simple
from panelweave.plans.panels import order_panel, supplier_panel
from panelweave.plans.portfolios import STEPS, TAIL_STEPS, dependent_sets
from panelweave.plans.registry import query
from panelweave.session import scratch_path
from panelweave.sources.stores import read_table, staged, write_table

COMPONENTS = 10
STRATEGIES = ("RW", "SMA(6)", "Ridge", "Net", "DMA")


def whole_pool(returns):
    """Linear and non-linear models of every series: averages, autoregressions, neighbours, regimes, products and bumps."""
    centres = M.radial_centres(returns)
    return staged(M.bank(returns, [
        N.random_walk, N.sma_bank, M.ema_bank, lambda p: M.ar_forecasts(p, 6), lambda p: M.arma_forecasts(p, 3, 3, 6),
        M.knn_forecasts, M.star_forecasts, M.higher_order_forecasts, lambda p: M.radial_forecasts(p, centres)]))


def combinations(spark, returns):
    """Ridge, elastic net and averaged forecasts over ten components, within five past deviations, next to two plain models.

    The fitted axes are stored and read back.
    """
    pool = whole_pool(returns)
    axes = read_table(spark, write_table(C.loadings(pool), scratch_path(spark, "fitted-axes")))
    rows = staged(C.component_rows(pool, returns, axes, COMPONENTS))
    xs = [f"c{i}" for i in range(1, COMPONENTS + 1)]
    plain = pool.where(F.col("model").isin("RW", "SMA(6)"))
    combined = M.bank(returns, [lambda _: C.ridge_combination(rows, xs), lambda _: C.net_combination(rows, xs), lambda _: C.dynamic_average(rows, xs)])
    return staged(plain.unionByName(X.clip_forecasts(combined, returns)))


@query("pca_properties", "SELECT DISTINCT series_id, 0.0::DOUBLE AS off_orthonormal, 0.0::DOUBLE AS off_variance FROM smr",
       off_orthonormal=6, off_variance=6)
def pca_properties(spark, sf):
    """Axes of a bank of 57 models: how far from orthonormal, and how far the scores' variances from the shares explained."""
    returns = supplier_panel(spark, sf)
    pool = staged(M.bank(returns, [N.random_walk, N.sma_bank, M.ema_bank]))
    axes = staged(C.loadings(pool))
    a, b = (axes.select("series_id", "model", F.col("k").alias(f"k{s}"), F.col("weight").alias(f"w{s}")) for s in "ab")
    dots = a.join(b, ["series_id", "model"]).where("ka <= kb").groupBy("series_id", "ka", "kb").agg(F.sum(F.col("wa") * F.col("wb")).alias("dot"))
    off = F.abs(F.col("dot") - F.when(F.col("ka") == F.col("kb"), 1.0).otherwise(0.0))
    scores = C.project(P.period_filter(pool, C.IN_SAMPLE), axes).groupBy("series_id", "k").agg(F.var_pop("score").alias("v"))
    shares = axes.groupBy("series_id", "k").agg(F.first("explained").alias("explained"))
    total = scores.join(shares, ["series_id", "k"])
    # The first axis sets the scale: variances and shares of all others are in proportion to it.
    first = total.where("k = 1").select("series_id", (F.col("v") / F.col("explained")).alias("scale"))
    gap = total.join(first, "series_id").groupBy("series_id").agg(F.max(F.abs(F.col("v") / F.col("scale") - F.col("explained"))).alias("off_variance"))
    return dots.groupBy("series_id").agg(F.max(off).alias("off_orthonormal")).join(gap, "series_id")


@query("combined_evaluation")
def combined_evaluation(spark, sf):
    """Errors of the combinations out of sample, with the loss tests over 10,000 replicates."""
    returns = order_panel(spark, sf)
    loss = staged(E.losses(P.period_filter(combinations(spark, returns), OOS), returns))
    tests = B.superior_ability(loss, STRATEGIES)
    return E.error_metrics(loss).join(tests, ["series_id", "model"], "left")


def simple_forecasts(spark, sf):
    """Combined log-return forecasts out of sample as simple returns."""
    pool = combinations(spark, order_panel(spark, sf))
    return staged(P.period_filter(pool.withColumn("yhat", S.log_to_simple("yhat")), OOS))


@query("mean_variance_combined")
def mean_variance_combined(spark, sf):
    """Five forecasts, three dependence models and two panels, with their performance."""
    simple = order_simple(spark, sf)
    inputs = O.mean_variance_inputs(simple_forecasts(spark, sf), all_correlations(simple), V.garch_volatility(simple), ASSETS)
    keys = ["forecast", "dependence", "panel"]
    weights = staged(O.mean_variance(inputs, ASSETS))
    return R.bundle(O.portfolio_returns(weights, simple, keys), keys, weights, simple)


@query("mean_cvar_combined")
def mean_cvar_combined(spark, sf):
    """The same five forecasts and three dependence models with mean-CVaR portfolios at both levels, on deep scenario sets."""
    simple = order_simple(spark, sf)
    inputs = O.mean_cvar_inputs(simple_forecasts(spark, sf), dependent_sets(simple), ASSETS)
    returns = staged(O.mean_cvar_backtest(O.mean_cvar(inputs, ASSETS, ["dependence", "ts"], Z.DRAWS), simple, ASSETS, ["forecast", "dependence", "ts"]))
    on = ["forecast", "dependence", "beta", "panel"]
    return R.bundle(returns, on).drop("return_cvar").join(R.return_over_ex_ante_cvar(returns, on), on)


_NAMES = ", ".join(f"'{m}'" for m in STRATEGIES)


@query("combined_reached", f"""SELECT kind, forecast, dependence, panel, beta, n AS dates, n AS reached FROM (SELECT count(*) AS n FROM (SELECT ts FROM omr
 WHERE ts >= DATE '2000-01-01' AND ts < DATE '2002-01-01' GROUP BY ts HAVING count(DISTINCT series_id) = {len(ASSETS)}) AS d) AS c,
 (VALUES ('variance', 0.0::DOUBLE), ('tail', 0.95::DOUBLE), ('tail', 0.99::DOUBLE)) AS k(kind, beta), (SELECT unnest([{_NAMES}]) AS forecast) AS f,
 (SELECT unnest(['DCC', 'ADCC', 'GAS']) AS dependence) AS e, (SELECT unnest(['long_only', '130_30']) AS panel) AS p""")
def combined_reached(spark, sf):
    """The whole chain, from the pool over fitted components and five combined forecasts to portfolios of both kinds.

    For every strategy, the dates out of sample, and on how many of them the search reaches the best weights of a grid.
    """
    simple, made = order_simple(spark, sf), simple_forecasts(spark, sf)
    variance = staged(O.mean_variance_inputs(made, all_correlations(simple), V.garch_volatility(simple), ASSETS))
    tails = staged(O.mean_cvar_inputs(made, dependent_sets(simple), ASSETS))
    on, each = ["forecast", "dependence", "ts", "panel"], ["dependence", "ts"]
    both = [
        (O.mean_variance_choices(variance, ASSETS), O.mean_variance_choices(variance, ASSETS, steps=STEPS), on, "variance"),
        (O.mean_cvar(tails, ASSETS, each, Z.DRAWS), O.mean_cvar(tails, ASSETS, each, Z.DRAWS, steps=TAIL_STEPS), [*on, "beta"], "tail")]
    parts = []
    for found, grid, keys, kind in both:
        pairs = grid.select(*keys, F.col("ratio").alias("best")).join(found.select(*keys, "ratio"), keys, "full_outer")
        beta = F.col("beta") if "beta" in keys else F.lit(0.0)
        parts.append(pairs.select("forecast", "dependence", "panel", beta.alias("beta"), (F.col("ratio") >= F.col("best") - 1e-9).alias("ok"), F.lit(kind).alias("kind")))
    return parts[0].unionByName(parts[1]).groupBy("kind", "forecast", "dependence", "panel", "beta").agg(
        F.count(F.lit(1)).alias("dates"), F.count_if("ok").alias("reached"))
