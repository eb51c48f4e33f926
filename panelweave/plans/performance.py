"""Queries over portfolio return series.

Strategies here are the equal-weight portfolios of the suppliers of each
nation, and every supplier as a portfolio of its own.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from panelweave.functions import scalars as S
from panelweave.operators import performance as R
from panelweave.operators import portfolio as O
from panelweave.plans.panels import supplier_returns
from panelweave.plans.registry import fragment, query
from panelweave.sources import tables as T
from panelweave.sources.stores import staged

fragment("sms", "SELECT series_id, ts, exp(value) - 1 AS value FROM smr")
fragment("ew_w", """SELECT n_name AS strategy, s.ts, s.series_id, 1.0::DOUBLE / count(*) OVER (PARTITION BY n_name, s.ts) AS w
 FROM sms s JOIN supplier ON s.series_id = CAST(s_suppkey AS VARCHAR) JOIN nation ON s_nationkey = n_nationkey""")
fragment("ew_r", """SELECT w.strategy, w.ts, sum(w.w * s.value) AS r FROM ew_w w JOIN sms s ON w.series_id = s.series_id
 AND w.ts = s.ts GROUP BY 1, 2""")
# Single suppliers and the national portfolios as one list of strategies.
fragment("strat_r", "SELECT strategy, ts, r FROM ew_r UNION ALL SELECT 'S' || series_id, ts, value FROM sms")


def simple(spark, sf):
    return staged(supplier_returns(spark, sf).withColumn("value", S.log_to_simple("value")))


def nation_weights(spark, sf, returns):
    members = T.table(spark, sf, "supplier").join(
        T.table(spark, sf, "nation"), F.col("s_nationkey") == F.col("n_nationkey")
    ).select(F.col("s_suppkey").cast("string").alias("series_id"), F.col("n_name").alias("strategy"))
    return O.equal_weights(returns.join(members, "series_id"), ["strategy"])


def nation_returns(spark, sf, returns):
    return O.portfolio_returns(nation_weights(spark, sf, returns), returns, ["strategy"])


def strategy_returns(spark, sf):
    returns = simple(spark, sf)
    single = returns.select(F.concat(F.lit("S"), "series_id").alias("strategy"), "ts", F.col("value").alias("r"))
    return nation_returns(spark, sf, returns).unionByName(single)


@query("equal_weights", "SELECT * FROM ew_w", w=8)
def equal_weights(spark, sf):
    return nation_weights(spark, sf, simple(spark, sf))


@query("portfolio_returns", "SELECT * FROM ew_r", r=8)
def portfolio_returns(spark, sf):
    return nation_returns(spark, sf, simple(spark, sf))


def _cvar_sql(src: str, q: float, keys: str, value: str) -> str:
    on = " AND ".join(f"a.{k.strip()} = v.{k.strip()}" for k in keys.split(","))
    names = ", ".join(f"a.{k.strip()}" for k in keys.split(","))
    return (f"SELECT {names}, -max(v.quantile) AS value_at_risk, -avg(CASE WHEN a.{value} <= v.quantile THEN a.{value} END) AS cvar "
            f"FROM {src} a JOIN (SELECT {keys}, quantile_cont({value}, {q}::DOUBLE) AS quantile FROM {src} GROUP BY {keys}) AS v ON {on} "
            f"GROUP BY {names}")


fragment("cvar_95", _cvar_sql("strat_r", 0.05, "strategy", "r"))
fragment("cvar_99", _cvar_sql("strat_r", 0.01, "strategy", "r"))


@query("value_at_risk", "SELECT * FROM cvar_95", value_at_risk=8, cvar=8)
def value_at_risk(spark, sf):
    return R.var_cvar(strategy_returns(spark, sf), ["strategy"], 0.05)


@query("tail_count_cvar", """SELECT strategy, k AS n_tail, -avg(r) AS cvar FROM (SELECT strategy, r, row_number() OVER
 (PARTITION BY strategy ORDER BY r) AS rn, CAST(ceil(count(*) OVER (PARTITION BY strategy) * 0.05) AS BIGINT) AS k
 FROM strat_r) AS q WHERE rn <= k GROUP BY 1, 2""", cvar=8)
def tail_count_cvar(spark, sf):
    return R.tail_count_cvar(strategy_returns(spark, sf), ["strategy"], 0.95)


fragment("ratios_s", """SELECT strategy, count(r) AS n_obs, avg(r) * 12 * 100 AS ann_return_pct,
 stddev_samp(r) * sqrt(12) AS ann_std, avg(r) * 12 / nullif(stddev_samp(r) * sqrt(12), 0) AS sharpe,
 avg(r) * 12 / nullif(stddev_samp(CASE WHEN r < 0 THEN r END) * sqrt(12), 0) AS sortino FROM strat_r GROUP BY 1""")


@query("annual_ratios", "SELECT * FROM ratios_s", ann_return_pct=6, ann_std=8, sharpe=8, sortino=8)
def annual_ratios(spark, sf):
    return R.ratios(strategy_returns(spark, sf), ["strategy"])


@query("annual_ratios_excess", """SELECT strategy, avg(r - 0.02 / 12) * 12 / nullif(stddev_samp(r - 0.02 / 12) * sqrt(12), 0)
 AS sharpe, avg(r - 0.02 / 12) * 12 / nullif(stddev_samp(CASE WHEN r - 0.02 / 12 < 0 THEN r - 0.02 / 12 END) * sqrt(12), 0)
 AS sortino FROM strat_r GROUP BY 1""", sharpe=6, sortino=6)
def annual_ratios_excess(spark, sf):
    return R.ratios(strategy_returns(spark, sf), ["strategy"], rf=0.02).select("strategy", "sharpe", "sortino")


@query("return_over_cvar", """SELECT r.strategy, r.ann_return_pct / 100 / nullif(c.cvar, 0) AS return_cvar FROM ratios_s r
 JOIN cvar_95 c ON r.strategy = c.strategy""", return_cvar=6)
def return_over_cvar(spark, sf):
    return R.return_over_cvar(strategy_returns(spark, sf), ["strategy"], 0.05)


# The ex-ante figure of a month is the mean of the two worst of the 24 months before.
EX_ANTE = """WITH x AS (SELECT a.strategy, a.ts, a.r, list_sort(list(b.r)) AS w FROM (SELECT *, row_number() OVER
 (PARTITION BY strategy ORDER BY ts) AS i FROM strat_r) AS a JOIN (SELECT *, row_number() OVER (PARTITION BY strategy
 ORDER BY ts) AS i FROM strat_r) AS b ON a.strategy = b.strategy AND b.i BETWEEN a.i - 24 AND a.i - 1 GROUP BY 1, 2, 3)
 SELECT strategy, ts, r, -(w[1] + w[2]) / 2 AS cvar FROM x WHERE len(w) = 24"""
fragment("ex_ante", EX_ANTE)


def ex_ante_returns(spark, sf):
    r = strategy_returns(spark, sf)
    from pyspark.sql import Window as W
    w = W.partitionBy("strategy").orderBy("ts").rowsBetween(-24, -1)
    window = r.withColumn("w", F.sort_array(F.collect_list("r").over(w))).where(F.size("w") == 24)
    return window.select("strategy", "ts", "r", (-R.array_mean(F.slice("w", 1, 2))).alias("cvar"))


@query("return_over_ex_ante_cvar", """SELECT strategy, CASE WHEN avg(cvar) > 1e-10 THEN avg(r) / avg(cvar) END AS return_cvar
 FROM ex_ante GROUP BY 1""", return_cvar=6)
def return_over_ex_ante_cvar(spark, sf):
    return R.return_over_ex_ante_cvar(ex_ante_returns(spark, sf), ["strategy"])


@query("best_strategy", """SELECT kind, strategy, return_cvar FROM (SELECT *, row_number() OVER (PARTITION BY kind ORDER BY
 return_cvar DESC, strategy DESC) AS rn FROM (SELECT CASE WHEN regexp_matches(strategy, '^S[0-9]+$') THEN 'single' ELSE 'nation' END AS kind,
 strategy, avg(r) / avg(cvar) AS return_cvar FROM ex_ante GROUP BY 1, 2 HAVING avg(cvar) > 1e-10) AS q) AS z WHERE rn = 1""",
       return_cvar=6)
def best_strategy(spark, sf):
    kind = F.when(F.col("strategy").rlike("^S[0-9]+$"), F.lit("single")).otherwise(F.lit("nation"))
    return R.best_strategy(ex_ante_returns(spark, sf).withColumn("kind", kind), ["kind"], ["strategy"])


fragment("mdd_s", """SELECT strategy, -min(level / peak - 1) * 100 AS mdd_pct FROM (SELECT strategy, ts, level, max(level) OVER
 (PARTITION BY strategy ORDER BY ts) AS peak FROM (SELECT strategy, ts, product(1 + r) OVER (PARTITION BY strategy
 ORDER BY ts) AS level FROM strat_r) AS a) AS b GROUP BY 1""")


@query("max_drawdown", "SELECT * FROM mdd_s", mdd_pct=6)
def max_drawdown(spark, sf):
    return R.max_drawdown(strategy_returns(spark, sf), ["strategy"], "r")


@query("max_drawdown_log", """SELECT series_id, -min(level / peak - 1) * 100 AS mdd_pct FROM (SELECT series_id, ts, level,
 max(level) OVER (PARTITION BY series_id ORDER BY ts) AS peak FROM (SELECT series_id, ts, exp(sum(value) OVER
 (PARTITION BY series_id ORDER BY ts)) AS level FROM smr) AS a) AS b GROUP BY 1""", mdd_pct=6)
def max_drawdown_log(spark, sf):
    return R.max_drawdown(supplier_returns(spark, sf), ["series_id"], "value", log=True)


fragment("ew_assets", """SELECT w.strategy, w.series_id, w.ts, w.w, s.value AS x FROM ew_w w JOIN sms s
 ON w.series_id = s.series_id AND w.ts = s.ts""")
fragment("ew_single", _cvar_sql("ew_assets", 0.01, "strategy, series_id", "x"))
fragment("ew_cvar", _cvar_sql("ew_r", 0.01, "strategy", "r"))
fragment("cdb_s", """SELECT b.strategy, (b.cvar_bar - c.cvar) / CASE WHEN b.cvar_bar - c.value_at_risk > 0 THEN b.cvar_bar -
 c.value_at_risk END AS cdb FROM (SELECT s.strategy, sum(w.w * s.cvar) AS cvar_bar FROM ew_single s JOIN (SELECT strategy,
 series_id, avg(w) AS w FROM ew_w GROUP BY 1, 2) AS w ON s.strategy = w.strategy AND s.series_id = w.series_id GROUP BY 1) AS b
 JOIN ew_cvar c ON b.strategy = c.strategy""")


@query("diversification_benefit", "SELECT * FROM cdb_s", cdb=6)
def diversification_benefit(spark, sf):
    assets = simple(spark, sf)
    weights = nation_weights(spark, sf, assets)
    return R.diversification_benefit(O.portfolio_returns(weights, assets, ["strategy"]), weights, assets, ["strategy"])


@query("performance_bundle", """SELECT r.*, m.mdd_pct, r.ann_return_pct / 100 / nullif(c.cvar, 0) AS return_cvar, d.cdb
 FROM ratios_s r JOIN ew_cvar e ON r.strategy = e.strategy JOIN mdd_s m ON r.strategy = m.strategy
 JOIN cvar_95 c ON r.strategy = c.strategy LEFT JOIN cdb_s d ON r.strategy = d.strategy""",
       ann_return_pct=6, ann_std=8, sharpe=6, sortino=6, mdd_pct=6, return_cvar=6, cdb=6)
def performance_bundle(spark, sf):
    assets = simple(spark, sf)
    weights = staged(nation_weights(spark, sf, assets))
    return R.bundle(staged(O.portfolio_returns(weights, assets, ["strategy"])), ["strategy"], weights, assets)


@query("single_series_panel", """SELECT r.*, m.mdd_pct, r.ann_return_pct / 100 / nullif(c.cvar, 0) AS return_cvar FROM ratios_s r
 JOIN mdd_s m ON r.strategy = m.strategy JOIN cvar_95 c ON r.strategy = c.strategy""",
       ann_return_pct=6, ann_std=8, sharpe=6, sortino=6, mdd_pct=6, return_cvar=6)
def single_series_panel(spark, sf):
    return R.bundle(strategy_returns(spark, sf), ["strategy"])


@query("mean_weights", "SELECT strategy, series_id, avg(w) AS w FROM ew_w GROUP BY 1, 2", w=8)
def mean_weights(spark, sf):
    return R.mean_weights(nation_weights(spark, sf, simple(spark, sf)), ["strategy"])
