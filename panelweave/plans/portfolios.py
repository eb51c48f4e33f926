"""Queries that build, backtest and report portfolios."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import functions as F

from panelweave.config import ASSETS, OOS, WINDOW
from panelweave.functions import scalars as S
from panelweave.operators import dependence as D
from panelweave.operators import panel as P
from panelweave.operators import performance as R
from panelweave.operators import portfolio as O
from panelweave.operators import scenario as Z
from panelweave.operators import tangent as T
from panelweave.operators import volatility as V
from panelweave.operators import windows as N
from panelweave.plans.dependence import all_correlations, deep_windows, order_simple, residual_windows
from panelweave.plans.panels import supplier_panel
from panelweave.plans.performance import _cvar_sql
from panelweave.plans.registry import fragment, query
from panelweave.session import scratch_path
from panelweave.sources.stores import read_strategy, staged, write_table

N_ASSETS = len(ASSETS)
IDX = range(1, N_ASSETS + 1)
MODELS = ("RW", "SMA(6)", "SMA(12)")
#: Grids of the checked queries: steps of weight per panel, by standard deviation and by tails.
STEPS, TAIL_STEPS = {O.LONG_ONLY: 20, O.LEVERAGED: 10}, {O.LONG_ONLY: 10, O.LEVERAGED: 10}


def _pivot(value: str, prefix: str) -> str:
    return ", ".join(f"max(CASE WHEN series_id = '{a}' THEN {value} END) AS {prefix}{i}" for i, a in zip(IDX, ASSETS))


fragment("pf", f"""SELECT * FROM (SELECT model AS forecast, ts, {_pivot('exp(yhat) - 1', 'm')} FROM pool_o WHERE ts >= DATE '2000-01-01'
 AND model IN ('RW', 'SMA(6)', 'SMA(12)') GROUP BY 1, 2) AS q WHERE {' AND '.join(f'm{i} IS NOT NULL' for i in IDX)}""")
fragment("vw", f"SELECT ts, {_pivot('sigma', 's')} FROM og GROUP BY 1 HAVING count(*) = {N_ASSETS}")
fragment("cw", "SELECT model AS dependence, ts, " + ", ".join(
    f"max(CASE WHEN s1 = '{ASSETS[i - 1]}' AND s2 = '{ASSETS[j - 1]}' THEN greatest(least(rho, 1 - 1e-6), 1e-6 - 1) END) AS r{i}{j}"
    for i, j in combinations(IDX, 2)) + " FROM corr_o GROUP BY 1, 2")
fragment("mvin", "SELECT f.*, c.dependence, " + ", ".join(f"v.s{i} * v.s{i} AS c{i}{i}" for i in IDX) + ", "
         + ", ".join(f"c.r{i}{j} * v.s{i} * v.s{j} AS c{i}{j}" for i, j in combinations(IDX, 2))
         + " FROM pf f JOIN cw c ON f.ts = c.ts JOIN vw v ON f.ts = v.ts")


def _lattice_sql(steps: int, short: int) -> str:
    low, high = -short, steps + short
    ks = ", ".join(f"generate_series({low}, {high}) AS g{i}(k{i})" for i in range(1, N_ASSETS))
    last = f"{steps} - k1 - k2 - k3 - k4"
    debt = " + ".join(f"greatest(-k{i}, 0)" for i in range(1, N_ASSETS)) + f" + greatest(-({last}), 0)"
    ws = ", ".join(f"k{i} / {steps}.0::DOUBLE AS w{i}" for i in range(1, N_ASSETS)) + f", ({last}) / {steps}.0::DOUBLE AS w5"
    return f"SELECT {ws} FROM {ks} WHERE {debt} <= {short}"


fragment("lat_lo20", _lattice_sql(20, 0))
fragment("lat_lo10", _lattice_sql(10, 0))
fragment("lat_lev10", _lattice_sql(10, 3))
_MU = " + ".join(f"l.w{i} * p.m{i}" for i in IDX)
_VAR = " + ".join([f"l.w{i} * l.w{i} * p.c{i}{i}" for i in IDX] + [f"2 * l.w{i} * l.w{j} * p.c{i}{j}" for i, j in combinations(IDX, 2)])
_W = "[" + ", ".join(f"l.w{i}" for i in IDX) + "]"


def _tangent_sql(lat: str, panel: str) -> str:
    return f"""SELECT forecast, dependence, '{panel}' AS panel, ts, arg_max(w, ratio) AS w, max(ratio) AS ratio FROM (SELECT p.forecast, p.dependence,
 p.ts, {_W} AS w, ({_MU}) / sqrt({_VAR}) AS ratio FROM mvin p, {lat} l) AS q GROUP BY 1, 2, 4"""


fragment("mv_lo", _tangent_sql("lat_lo20", "long_only"))
fragment("mv_lev", _tangent_sql("lat_lev10", "130_30"))
_NAMES = "[" + ", ".join(f"'{a}'" for a in ASSETS) + "]"
fragment("mv_w", f"""SELECT forecast, dependence, panel, ts, {_NAMES}[i] AS series_id, w[i] AS w FROM (SELECT * FROM mv_lo UNION ALL SELECT * FROM mv_lev)
 AS q, generate_series(1, {N_ASSETS}) AS g(i)""")
fragment("mv_r", """SELECT w.forecast, w.dependence, w.panel, w.ts, sum(w.w * o.value) AS r FROM mv_w w JOIN oms o ON w.ts = o.ts
 AND w.series_id = o.series_id GROUP BY 1, 2, 3, 4""")


def forecasts(simple):
    """Pool of log-return forecasts, brought to simple returns."""
    pool = N.simple_pool(simple.withColumn("value", S.simple_to_log("value"))).where(F.col("model").isin(*MODELS))
    return P.period_filter(pool.withColumn("yhat", S.log_to_simple("yhat")), OOS)


def mv_inputs(simple):
    vol = V.garch_volatility(simple)
    return O.mean_variance_inputs(forecasts(simple), all_correlations(simple), vol, ASSETS)


def mv_weights(simple):
    return O.mean_variance(mv_inputs(simple), ASSETS, steps=STEPS)


KEYS = ["forecast", "dependence", "panel"]


@query("tangent_long_only", "SELECT forecast, dependence, ts, series_id, w FROM mv_w WHERE panel = 'long_only'", w=6)
def tangent_long_only(spark, sf):
    return O.mean_variance(mv_inputs(order_simple(spark, sf)), ASSETS, [O.LONG_ONLY], STEPS).drop("panel")


@query("tangent_130_30", "SELECT forecast, dependence, ts, series_id, w FROM mv_w WHERE panel = '130_30'", w=6)
def tangent_130_30(spark, sf):
    return O.mean_variance(mv_inputs(order_simple(spark, sf)), ASSETS, [O.LEVERAGED], STEPS).drop("panel")


@query("tangent_polished", "SELECT forecast, dependence, panel, ts, ratio AS lattice_ratio, true AS reached, true AS settled FROM "
       "(SELECT * FROM mv_lo UNION ALL SELECT * FROM mv_lev) AS q", lattice_ratio=6)
def tangent_polished(spark, sf):
    """The exact search against the grid: it reaches the best grid ratio everywhere, and moving weight adds nothing more."""
    inputs = staged(mv_inputs(order_simple(spark, sf)))
    keys = ["forecast", "dependence", "panel", "ts"]
    exact = O.mean_variance_choices(inputs, ASSETS).select(*keys, F.col("ratio").alias("exact"), "gap")
    grid = O.mean_variance_choices(inputs, ASSETS, steps=STEPS)
    return grid.join(exact, keys).select(*keys, F.col("ratio").alias("lattice_ratio"), (F.col("exact") >= F.col("ratio") - 1e-12).alias("reached"),
                                         (F.col("gap") < 1e-7).alias("settled"))


fragment("tsd", "SELECT ts, row_number() OVER (ORDER BY ts) AS i FROM (SELECT ts FROM smr GROUP BY ts HAVING count(*) = (SELECT count(DISTINCT series_id) FROM smr)) AS q")


@query("tangent_suppliers", f"""SELECT ts, panel, (SELECT count(DISTINCT series_id) FROM smr) AS assets, true AS feasible, true AS settled
 FROM tsd, (SELECT unnest(['long_only', '130_30']) AS panel) AS p WHERE i > {WINDOW} AND ts >= DATE '2000-01-01'""")
def tangent_suppliers(spark, sf):
    """All suppliers as assets: portfolios of the largest ratio by the mean and shrunken covariance of the window before each date."""
    windows = D.date_windows(supplier_panel(spark, sf).select("series_id", "ts", "value"))
    inputs = P.period_filter(windows, OOS).select(F.lit("mean").alias("forecast"), F.lit("sample").alias("dependence"), "ts", D.window_factors("window").alias("m")).select(
        "forecast", "dependence", "ts", "m.*")
    found = O.mean_variance_choices(inputs)
    total = F.aggregate("weights", F.lit(0.0), lambda s, w: s + w)
    debt = F.aggregate("weights", F.lit(0.0), lambda s, w: s + F.greatest(-w, F.lit(0.0)))
    limit = F.when(F.col("panel") == O.LEVERAGED, O.SHORT[O.LEVERAGED]).otherwise(0.0)
    return found.select("ts", "panel", F.size("weights").cast("long").alias("assets"), ((F.abs(total - 1) < 1e-9) & (debt <= limit + 1e-9)).alias("feasible"),
                        (F.col("gap") < 1e-4).alias("settled"))


@query("mean_variance_backtest", "SELECT * FROM mv_r", r=6)
def mean_variance_backtest(spark, sf):
    simple = order_simple(spark, sf)
    return O.portfolio_returns(mv_weights(simple), simple, KEYS)


# --- reports on the mean-variance strategies ---

def _metric_sql(src: str, keys: str) -> str:
    ks = [k.strip() for k in keys.split(",")]
    on = lambda a, b: " AND ".join(f"{a}.{k} = {b}.{k}" for k in ks)
    return f"""SELECT {', '.join('a.' + k for k in ks)}, a.ann_return_pct, a.sharpe, a.sortino, d.mdd_pct FROM (SELECT {keys}, avg(r) * 1200
 AS ann_return_pct, avg(r) * 12 / nullif(stddev_samp(r) * sqrt(12), 0) AS sharpe, avg(r) * 12 / nullif(stddev_samp(CASE WHEN r < 0 THEN r END)
 * sqrt(12), 0) AS sortino FROM {src} GROUP BY {keys}) AS a JOIN (SELECT {keys}, -min(level / peak - 1) * 100 AS mdd_pct FROM (SELECT *,
 max(level) OVER (PARTITION BY {keys} ORDER BY ts) AS peak FROM (SELECT {keys}, ts, product(1 + r) OVER (PARTITION BY {keys}
 ORDER BY ts) AS level FROM {src}) AS x) AS y GROUP BY {keys}) AS d ON {on('a', 'd')}"""


_K3 = "forecast, dependence, panel"
fragment("mv_assets", """SELECT w.forecast, w.dependence, w.panel, w.series_id, w.ts, w.w, o.value AS x FROM mv_w w JOIN oms o
 ON w.ts = o.ts AND w.series_id = o.series_id""")
fragment("mv_single", _cvar_sql("mv_assets", 0.01, _K3 + ", series_id", "x"))
fragment("mv_own", _cvar_sql("mv_r", 0.01, _K3, "r"))
fragment("mv_cdb", """SELECT b.forecast, b.dependence, b.panel, (b.cvar_bar - c.cvar) / CASE WHEN b.cvar_bar - c.value_at_risk > 0 THEN b.cvar_bar -
 c.value_at_risk END AS cdb FROM (SELECT s.forecast, s.dependence, s.panel, sum(w.w * s.cvar) AS cvar_bar FROM mv_single s JOIN
 (SELECT forecast, dependence, panel, series_id, avg(w) AS w FROM mv_w GROUP BY 1, 2, 3, 4) AS w ON s.forecast = w.forecast AND
 s.dependence = w.dependence AND s.panel = w.panel AND s.series_id = w.series_id GROUP BY 1, 2, 3) AS b JOIN mv_own c
 ON b.forecast = c.forecast AND b.dependence = c.dependence AND b.panel = c.panel""")
fragment("mv_metrics", f"""SELECT m.*, c.cdb FROM ({_metric_sql('mv_r', _K3)}) AS m JOIN mv_cdb c ON m.forecast = c.forecast AND
 m.dependence = c.dependence AND m.panel = c.panel""")
METRICS = ["ann_return_pct", "sharpe", "sortino", "mdd_pct", "cdb"]


def mv_metrics(simple):
    weights = staged(mv_weights(simple))
    returns = O.portfolio_returns(weights, simple, KEYS)
    return R.bundle(returns, KEYS, weights, simple).select(*KEYS, *METRICS)


@query("strategy_metrics", "SELECT * FROM mv_metrics", ann_return_pct=5, sharpe=5, sortino=5, mdd_pct=5, cdb=5)
def strategy_metrics(spark, sf):
    return mv_metrics(order_simple(spark, sf))


_AVG = ", ".join(f"avg({m}) AS {m}" for m in METRICS)
fragment("mv_groups", f"""SELECT panel, CASE grouping(forecast, dependence) WHEN 0 THEN 'strategy' WHEN 1 THEN 'forecast average' WHEN 2 THEN
 'dependence average' ELSE 'total average' END AS level, forecast, dependence, {_AVG} FROM mv_metrics GROUP BY GROUPING SETS
 ((panel, forecast, dependence), (panel, forecast), (panel, dependence), (panel))""")


def group_rows(metrics):
    parts = [
        R.group_averages(metrics.where(F.col("panel") == p), "forecast", "dependence", METRICS).withColumn("panel", F.lit(p))
        for p in (O.LONG_ONLY, O.LEVERAGED)]
    return parts[0].unionByName(parts[1])


@query("report_group_averages", "SELECT * FROM mv_groups", ann_return_pct=5, sharpe=5, sortino=5, mdd_pct=5, cdb=5)
def report_group_averages(spark, sf):
    return group_rows(staged(mv_metrics(order_simple(spark, sf))))


fragment("one_n", f"""SELECT series_id AS strategy, ts, value AS r FROM oms WHERE ts >= DATE '2000-01-01' UNION ALL
 SELECT '1/N', ts, avg(value) FROM oms WHERE ts >= DATE '2000-01-01' GROUP BY ts""")
_R3 = ", ".join(f"round({m}, 3) + 0.0::DOUBLE AS {m}" for m in METRICS[:4])


@query("report_tables", f"""SELECT 'A' AS panel, strategy AS label, {_R3} FROM ({_metric_sql('one_n', 'strategy')}) AS a UNION ALL
 SELECT CASE panel WHEN 'long_only' THEN 'B' ELSE 'C' END, coalesce(CASE WHEN level = 'strategy' THEN forecast || '-' || dependence END,
 level || coalesce(' ' || forecast, '') || coalesce(' ' || dependence, '')), {_R3} FROM mv_groups""")
def report_tables(spark, sf):
    """Single assets and 1/N, then both panels with their averages, rounded."""
    simple = order_simple(spark, sf)
    oos = P.period_filter(simple, OOS)
    equal = oos.groupBy("ts").agg(F.avg("value").alias("r")).select(F.lit("1/N").alias("strategy"), "ts", "r")
    single = oos.select(F.col("series_id").alias("strategy"), "ts", F.col("value").alias("r")).unionByName(equal)
    panel_a = R.bundle(single, ["strategy"]).select(F.lit("A").alias("panel"), F.col("strategy").alias("label"), *METRICS[:4])
    label = F.when(F.col("level") == "strategy", S.strategy_label("forecast", "dependence")).otherwise(
        F.concat_ws(" ", "level", "forecast", "dependence"))
    rest = group_rows(staged(mv_metrics(simple))).select(
        F.when(F.col("panel") == O.LONG_ONLY, "B").otherwise("C").alias("panel"), label.alias("label"), *METRICS[:4])
    return panel_a.unionByName(rest).withColumns({m: F.round(m, 3) for m in METRICS[:4]})


@query("strategy_store", """SELECT forecast, dependence, panel, ts, series_id, w FROM mv_w WHERE forecast = 'RW' AND dependence = 'GAS'
 AND panel = 'long_only'""", w=6)
def strategy_store(spark, sf):
    """All weights as one table partitioned by strategy; one strategy read back."""
    path = write_table(mv_weights(order_simple(spark, sf)), scratch_path(spark, "strategies"), KEYS)
    return read_strategy(spark, path, forecast="RW", dependence="GAS", panel="long_only").select(
        "forecast", "dependence", "panel", "ts", "series_id", "w")


# --- mean-CVaR ---

fragment("scw", f"SELECT ts, scen_id, {_pivot('r', 'x')} FROM scen GROUP BY 1, 2")


def _cvar_search_sql(lat: str, panel: str) -> str:
    loss = "-(" + " + ".join(f"l.w{i} * (s.x{i} + p.m{i})" for i in IDX) + ")"
    mean = " + ".join(f"any_value(l.w{i} * p.m{i})" for i in IDX)
    parts = []
    for beta, k in ((0.95, 2), (0.99, 1)):
        parts.append(f"""SELECT forecast, ts, {beta}::DOUBLE AS beta, '{panel}' AS panel, arg_max(w, mu / cvar) AS w, max(mu / cvar) AS ratio,
 arg_max(cvar, mu / cvar) AS cvar FROM (SELECT forecast, ts, w, mu, list_sum(worst[1:{k}]) / {k} AS cvar FROM {panel_fragment(panel)}) AS q
 WHERE cvar > 0 GROUP BY 1, 2""")
    fragment(panel_fragment(panel), f"""SELECT p.forecast, p.ts, {_W} AS w, {mean} AS mu, max({loss}, 2) AS worst FROM pf p JOIN scw s ON p.ts = s.ts,
 {lat} l GROUP BY 1, 2, 3""")
    return " UNION ALL ".join(parts)


def panel_fragment(panel: str) -> str:
    return "cvs_lo" if panel == "long_only" else "cvs_lev"


fragment("mc_lo", _cvar_search_sql("lat_lo10", "long_only"))
fragment("mc_lev", _cvar_search_sql("lat_lev10", "130_30"))
fragment("mc_all", "SELECT * FROM mc_lo UNION ALL SELECT * FROM mc_lev")
fragment("ow", f"SELECT ts, [{', '.join(f'x{i}' for i in IDX)}] AS x FROM (SELECT ts, {_pivot('value', 'x')} FROM oms GROUP BY 1) AS q")
fragment("mc_r", """SELECT m.forecast, m.beta, m.panel, m.ts, list_sum(list_transform(m.w, lambda w, i: w * o.x[i])) AS r, m.cvar FROM mc_all m
 JOIN ow o ON m.ts = o.ts""")


def window_sets(simple):
    """The residual vectors of each date's window as scenarios around zero."""
    return O.scenario_sets(residual_windows(simple), O.volatility_vectors(V.garch_volatility(simple), ASSETS))


def mc_choices(simple, panels=(O.LONG_ONLY, O.LEVERAGED)):
    inputs = O.mean_cvar_inputs(forecasts(simple), window_sets(simple), ASSETS)
    return O.mean_cvar(inputs, ASSETS, ["ts"], WINDOW, panels=panels, steps=TAIL_STEPS)


def _choice_rows(df):
    return O.weight_rows(df, ASSETS, ["forecast", "ts", "beta", "ratio", "cvar"])


_CHOICE = f"SELECT forecast, ts, beta, ratio, cvar, {_NAMES}[i] AS series_id, w[i] AS w FROM {{}}, generate_series(1, {N_ASSETS}) AS g(i)"


@query("cvar_tangent_long_only", _CHOICE.format("mc_lo"), ratio=1, cvar=6, w=6)
def cvar_tangent_long_only(spark, sf):
    return _choice_rows(mc_choices(order_simple(spark, sf), [O.LONG_ONLY]))


@query("cvar_tangent_130_30", _CHOICE.format("mc_lev"), ratio=1, cvar=6, w=6)
def cvar_tangent_130_30(spark, sf):
    return _choice_rows(mc_choices(order_simple(spark, sf), [O.LEVERAGED]))


@query("mean_cvar_backtest", "SELECT * FROM mc_r", r=6, cvar=6)
def mean_cvar_backtest(spark, sf):
    simple = order_simple(spark, sf)
    return O.mean_cvar_backtest(mc_choices(simple), simple, ASSETS, ["forecast", "ts"])


@query("best_tangent", """SELECT beta, panel, forecast, return_cvar FROM (SELECT *, row_number() OVER (PARTITION BY beta, panel ORDER BY return_cvar DESC,
 forecast DESC) AS rn FROM (SELECT beta, panel, forecast, avg(r) / avg(cvar) AS return_cvar FROM mc_r GROUP BY 1, 2, 3 HAVING avg(cvar) > 1e-10)
 AS a) AS b WHERE rn = 1""", return_cvar=5)
def best_tangent(spark, sf):
    simple = order_simple(spark, sf)
    returns = O.mean_cvar_backtest(mc_choices(simple), simple, ASSETS, ["forecast", "ts"])
    return R.best_strategy(returns, ["beta", "panel"], ["forecast"])


_KC = "beta, panel, forecast"
fragment("mc_cvar", " UNION ALL ".join(_cvar_sql(f"(SELECT * FROM mc_r WHERE beta = {b})", round(1 - b, 2), _KC, "r") for b in (0.95, 0.99)))
fragment("mc_metrics", f"""SELECT a.*, m.mdd_pct, a.ann_return_pct / 100 / CASE WHEN c.cvar > 0 THEN c.cvar END AS return_cvar FROM (SELECT {_KC},
 avg(r) * 1200 AS ann_return_pct, avg(r) * 12 / nullif(stddev_samp(CASE WHEN r < 0 THEN r END) * sqrt(12), 0) AS sortino FROM mc_r
 GROUP BY 1, 2, 3) AS a JOIN (SELECT {_KC}, -min(level / peak - 1) * 100 AS mdd_pct FROM (SELECT *, max(level) OVER (PARTITION BY {_KC}
 ORDER BY ts) AS peak FROM (SELECT {_KC}, ts, exp(sum(r) OVER (PARTITION BY {_KC} ORDER BY ts)) AS level FROM mc_r) AS x) AS y GROUP BY
 1, 2, 3) AS m ON a.beta = m.beta AND a.panel = m.panel AND a.forecast = m.forecast JOIN mc_cvar c ON a.beta = c.beta AND
 a.panel = c.panel AND a.forecast = c.forecast""")
_CVAR_METRICS = ["ann_return_pct", "return_cvar", "sortino", "mdd_pct"]


@query("cvar_report", f"""SELECT beta, panel, coalesce(forecast, 'total average') AS label,
 {', '.join(f'round(avg({m}), 3) + 0.0::DOUBLE AS {m}' for m in _CVAR_METRICS)} FROM mc_metrics GROUP BY GROUPING SETS
 ((beta, panel, forecast), (beta, panel))""")
def cvar_report(spark, sf):
    """Mean-CVaR strategies with their averages, log drawdowns, per level."""
    keys = ["beta", "panel", "forecast"]
    simple = order_simple(spark, sf)
    returns = staged(O.mean_cvar_backtest(mc_choices(simple), simple, ASSETS, ["forecast", "ts"]))
    parts = []
    for beta in (0.95, 0.99):
        of_level = returns.where(F.col("beta") == beta)
        parts.append(R.bundle(of_level, keys, log_drawdown=True).drop("return_cvar").join(
            R.return_over_cvar(of_level, keys, round(1 - beta, 2), positive_only=True), keys))
    both = parts[0].unionByName(parts[1])
    b, p, f = F.col("beta"), F.col("panel"), F.col("forecast")
    out = both.groupingSets([[b, p, f], [b, p]], b, p, f).agg(*[F.round(F.avg(m), 3).alias(m) for m in _CVAR_METRICS])
    return out.select("beta", "panel", F.coalesce(f, F.lit("total average")).alias("label"), *_CVAR_METRICS)


# --- deep scenario sets: weighted tails of 250 and 50 of 5,000 scenarios ---

fragment("dsw", f"SELECT ts, i, any_value(times) AS times, {_pivot('r', 'x')} FROM dsr GROUP BY 1, 2")


def _deep_sql(lat: str, panel: str) -> str:
    loss = "-(" + " + ".join(f"l.w{i} * s.x{i}" for i in IDX) + ")"
    m = " + ".join(f"c.w[{i}] * p.m{i}" for i in IDX)
    name = "dsl_lo" if panel == "long_only" else "dsl_lev"
    levels = [(b, T.tail_size(Z.DRAWS, b)) for b in (0.95, 0.99)]
    fragment(f"{name}_s", f"""SELECT ts, {_W} AS w, {loss} AS loss, times, sum(times) OVER (PARTITION BY s.ts, {', '.join(f'l.w{i}' for i in IDX)} ORDER BY {loss} DESC, i
 ROWS UNBOUNDED PRECEDING) - times AS before FROM dsw s, {lat} l""")
    fragment(name, f"SELECT ts, w, " + ", ".join(f"sum(loss * greatest(0, least(times, {k} - before))) / {k} AS c{k}" for _, k in levels) + f" FROM {name}_s GROUP BY 1, 2")
    return " UNION ALL ".join(f"""SELECT forecast, ts, {b}::DOUBLE AS beta, '{panel}' AS panel, max(m / (c{k} - m)) AS ratio FROM
 (SELECT p.forecast, c.ts, {m} AS m, c.c{k} FROM {name} c JOIN pf p ON p.ts = c.ts) AS q WHERE c{k} > m GROUP BY 1, 2""" for b, k in levels)


fragment("deep_grid", _deep_sql("lat_lo10", "long_only") + " UNION ALL " + _deep_sql("lat_lev10", "130_30"))


def deep_sets(simple):
    return O.scenario_sets(deep_windows(simple), O.volatility_vectors(V.garch_volatility(simple), ASSETS))


@query("cvar_tangent_deep", "SELECT forecast, ts, beta, panel, ratio / (1 + ratio) AS lattice_share, true AS reached FROM deep_grid", lattice_share=8)
def cvar_tangent_deep(spark, sf):
    """Tails of 250 and 50 scenarios: the search reaches the best ratio of the grid for every forecast, date, level and panel.

    The grid's ratio is stated as the mean's share of the tail loss around it, which stays bounded where CVaR is next to nothing.
    """
    simple = order_simple(spark, sf)
    inputs = staged(O.mean_cvar_inputs(forecasts(simple), deep_sets(simple), ASSETS))
    keys = ["forecast", "ts", "beta", "panel"]
    found = O.mean_cvar(inputs, ASSETS, ["ts"], Z.DRAWS).select(*keys, F.col("ratio").alias("found"))
    grid = O.mean_cvar(inputs, ASSETS, ["ts"], Z.DRAWS, steps=TAIL_STEPS)
    return grid.join(found, keys).select(*keys, (F.col("ratio") / (1 + F.col("ratio"))).alias("lattice_share"), (F.col("found") >= F.col("ratio") - 1e-9).alias("reached"))


@query("mean_cvar_full")
def mean_cvar_full(spark, sf):
    """Every forecast, dependence model, level and panel, with performance.

    Scenario sets are deep ones of all residual vectors before a date. They are given
    the model's correlation before they are scaled, so that the models differ in their scenarios.
    """
    simple = order_simple(spark, sf)
    sets = dependent_sets(simple)
    inputs = O.mean_cvar_inputs(forecasts(simple), sets, ASSETS)
    returns = staged(O.mean_cvar_backtest(O.mean_cvar(inputs, ASSETS, ["dependence", "ts"], Z.DRAWS), simple, ASSETS, ["forecast", "dependence", "ts"]))
    on = ["forecast", "dependence", "beta", "panel"]
    return R.bundle(returns, on).drop("return_cvar").join(R.return_over_ex_ante_cvar(returns, on), on)


def dependent_sets(simple):
    """Deep scenario sets of every dependence model: the residuals before a date are given its correlation."""
    matrix = D.correlation_matrix(all_correlations(simple), ASSETS).select(F.col("model").alias("dependence"), "ts", D.repair("matrix").alias("matrix"))
    windows = P.spread(deep_windows(simple).join(matrix, "ts"), "dependence", "ts").select("dependence", "ts", Z.recorrelate("window", "matrix").alias("window"), "times")
    return staged(O.scenario_sets(windows, O.volatility_vectors(V.garch_volatility(simple), ASSETS), ["dependence", "ts"]))
