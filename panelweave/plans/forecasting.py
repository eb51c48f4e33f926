"""Queries that produce individual forecasts."""

from __future__ import annotations

from pyspark.sql import functions as F

from panelweave.operators import forecast as M
from panelweave.operators import windows as N
from panelweave.plans import fragments as Q
from panelweave.plans.panels import supplier_panel, supplier_returns
from panelweave.plans.registry import fragment, query
from panelweave.plans.solve_sql import lags_sql, scaled_lags_sql, solve_fragments, value_sql
from panelweave.operators import panel as P
from panelweave.sources import tables as T
from panelweave.sources.stores import staged

IN_TRAIN = "ts < DATE '1998-01-01'"

# --- moving averages ---

fragment("smr_i", "SELECT series_id, ts, value, row_number() OVER (PARTITION BY series_id ORDER BY ts) AS i FROM smr")
fragment("ema_r", """SELECT series_id, i, CAST(q AS INT) AS q, value AS ema FROM smr_i, generate_series(3, 30) AS g(q) WHERE i = 1
 UNION ALL SELECT r.series_id, s.i, r.q, r.ema + 2.0::DOUBLE / (1 + r.q) * (s.value - r.ema) FROM ema_r r JOIN smr_i s
 ON r.series_id = s.series_id AND s.i = r.i + 1""")
fragment("ema_s", """SELECT s.series_id, 'EMA(' || r.q || ')' AS model, s.ts, r.ema AS yhat FROM ema_r r JOIN smr_i s
 ON r.series_id = s.series_id AND s.i = r.i + 1""")


@query("ema_bank", "SELECT * FROM ema_s", yhat=8)
def ema_bank(spark, sf):
    return M.ema_bank(supplier_returns(spark, sf), range(3, 31))


# --- autoregressions ---

fragment("lag4", lags_sql("smr", 4))
fragment("lag4_train", f"SELECT * FROM lag4 WHERE {IN_TRAIN}")
for _p in range(1, 5):
    solve_fragments(f"ar{_p}", "lag4_train", "series_id", M.lag_names(_p))
fragment("ar_s", " UNION ALL ".join(
    f"SELECT l.series_id, 'AR({p})' AS model, l.ts, {value_sql('c.coef', M.lag_names(p))} AS yhat FROM lag4 l JOIN ar{p} c "
    f"ON l.series_id = c.series_id WHERE c.n > {p + 1}" for p in range(1, 5)))


@query("ar_forecasts", "SELECT * FROM ar_s", yhat=6)
def ar_forecasts(spark, sf):
    return M.ar_forecasts(supplier_panel(spark, sf), 4)


@query("ar_one_by_slope", f"""SELECT l.series_id, l.ts, c.a + c.b * l.x1 AS yhat FROM ({lags_sql('smr', 1)}) AS l JOIN
 (SELECT series_id, regr_intercept(y, x1) AS a, regr_slope(y, x1) AS b FROM ({lags_sql('smr', 1)}) AS t WHERE {IN_TRAIN}
 GROUP BY 1) AS c ON l.series_id = c.series_id""", yhat=6)
def ar_one_by_slope(spark, sf):
    return M.ar_forecasts(supplier_panel(spark, sf), 1).drop("model")


fragment("shock4", f"""SELECT l.series_id, l.ts, l.y, l.x1, l.x2, l.y - ({value_sql('c.coef', M.lag_names(4))}) AS shock
 FROM lag4 l JOIN ar4 c ON l.series_id = c.series_id""")
fragment("hr", """SELECT * FROM (SELECT series_id, ts, y, x1, x2, lag(shock, 1) OVER w AS e1, lag(shock, 2) OVER w AS e2
 FROM shock4 WINDOW w AS (PARTITION BY series_id ORDER BY ts)) AS q WHERE e2 IS NOT NULL""")
fragment("hr_train", f"SELECT * FROM hr WHERE {IN_TRAIN}")
for _p in (1, 2):
    for _q in (1, 2):
        solve_fragments(f"arma{_p}{_q}", "hr_train", "series_id", [*M.lag_names(_p), *M.lag_names(_q, "e")])
fragment("arma_s", " UNION ALL ".join(
    f"SELECT l.series_id, 'ARMA({p},{q})' AS model, l.ts, "
    f"{value_sql('c.coef', [*M.lag_names(p), *M.lag_names(q, 'e')])} AS yhat FROM hr l JOIN arma{p}{q} c "
    f"ON l.series_id = c.series_id" for p in (1, 2) for q in (1, 2)))


@query("arma_forecasts", "SELECT * FROM arma_s", yhat=6)
def arma_forecasts(spark, sf):
    return M.arma_forecasts(supplier_panel(spark, sf), 2, 2, 4)


@query("linear_bank", " UNION ALL ".join(
    [f"SELECT * FROM (SELECT series_id, 'SMA({q})' AS model, ts, {Q.sma_sql(q)} AS yhat FROM smr) AS s WHERE yhat IS NOT NULL"
     for q in range(3, 31)]) + " UNION ALL SELECT * FROM ema_s UNION ALL SELECT * FROM ar_s UNION ALL SELECT * FROM arma_s", yhat=6)
def linear_bank(spark, sf):
    return M.linear_bank(supplier_panel(spark, sf), range(3, 31), 4, (2, 2), 4)


# --- the whole bank on the daily series ---

fragment("day", "SELECT l_returnflag AS series_id, CAST(l_shipdate AS DATE) AS ts, sum(l_extendedprice) AS value FROM lineitem GROUP BY 1, 2")
fragment("dayr", Q.returns_sql("day"))
fragment("dlag", lags_sql("dayr", 24))
fragment("dlag_train", f"SELECT * FROM dlag WHERE {IN_TRAIN}")
for _p in range(1, 25):
    solve_fragments(f"dar{_p}", "dlag_train", "series_id", M.lag_names(_p))
fragment("dar_s", " UNION ALL ".join(
    f"SELECT l.series_id, 'AR({p})' AS model, l.ts, {value_sql('c.coef', M.lag_names(p))} AS yhat FROM dlag l JOIN dar{p} c "
    f"ON l.series_id = c.series_id" for p in range(1, 25)))
fragment("dshock", f"SELECT l.*, l.y - ({value_sql('c.coef', M.lag_names(24))}) AS shock FROM dlag l JOIN dar24 c ON l.series_id = c.series_id")
fragment("dhr", "SELECT * FROM (SELECT *, " + ", ".join(f"lag(shock, {k}) OVER w AS e{k}" for k in range(1, 15)) + """ FROM dshock
 WINDOW w AS (PARTITION BY series_id ORDER BY ts)) AS q WHERE e14 IS NOT NULL""")
fragment("dhr_train", f"SELECT * FROM dhr WHERE {IN_TRAIN}")
# Of the 210 pairs of orders the smallest, two between and the largest: the SQL of all would be megabytes long.
CHECKED = ((1, 1), (2, 5), (9, 3), (15, 14))
for _p, _q in CHECKED:
    solve_fragments(f"darma{_p}_{_q}", "dhr_train", "series_id", [*M.lag_names(_p), *M.lag_names(_q, "e")])
fragment("darma_s", " UNION ALL ".join(
    f"SELECT l.series_id, 'ARMA({p},{q})' AS model, l.ts, {value_sql('c.coef', [*M.lag_names(p), *M.lag_names(q, 'e')])} AS yhat "
    f"FROM dhr l JOIN darma{p}_{q} c ON l.series_id = c.series_id" for p, q in CHECKED))


@query("ar_forecasts_daily", "SELECT * FROM dar_s", yhat=6)
def ar_forecasts_daily(spark, sf):
    """All 24 autoregressions on the daily series."""
    return M.ar_forecasts(daily_returns(spark, sf))


def daily_returns(spark, sf):
    return staged(P.log_returns(T.lineitem_daily(spark, sf)))


@query("linear_bank_daily")
def linear_bank_daily(spark, sf):
    """The full bank of 290 models on the daily series."""
    return M.linear_bank(daily_returns(spark, sf))


@query("linear_bank_daily_checked", "SELECT * FROM dar_s WHERE model IN ('AR(1)', 'AR(12)', 'AR(24)') UNION ALL SELECT * FROM darma_s UNION ALL "
       + " UNION ALL ".join(f"SELECT * FROM (SELECT series_id, 'SMA({q})' AS model, ts, {Q.sma_sql(q)} AS yhat FROM dayr) AS s WHERE yhat IS NOT NULL"
                            for q in (3, 30)), yhat=6)
def linear_bank_daily_checked(spark, sf):
    """Models of every kind and of the smallest and largest orders, out of the full bank of 290."""
    names = ["AR(1)", "AR(12)", "AR(24)", "SMA(3)", "SMA(30)", *[f"ARMA({p},{q})" for p, q in CHECKED]]
    return M.linear_bank(daily_returns(spark, sf)).where(F.col("model").isin(names))


# --- neighbours ---

fragment("lag6", lags_sql("smr", 6))
fragment("slag6", scaled_lags_sql("lag6", 6))
_DIST = " + ".join(f"(a.x{k} - b.x{k}) ** 2" for k in range(1, 7))


def _knn_fragment(name: str, extra: str = "") -> None:
    fragment(name, f"""SELECT * FROM (SELECT a.series_id, a.ts, b.ts AS neighbour_ts, b.y, sqrt({_DIST}) AS distance,
 row_number() OVER (PARTITION BY a.series_id, a.ts ORDER BY sqrt({_DIST}), b.ts) AS rank FROM slag6 a JOIN slag6 b
 ON a.series_id = b.series_id AND b.ts < DATE '1998-01-01' {extra}) AS q WHERE rank <= 5""")


_knn_fragment("knn_s")
_knn_fragment("knn_x", "AND a.ts <> b.ts")


@query("nearest_neighbours", "SELECT series_id, ts, CAST(rank AS INT) AS rank, neighbour_ts, distance FROM knn_s", distance=6)
def nearest_neighbours(spark, sf):
    return M.nearest_neighbours(supplier_returns(spark, sf))


@query("knn_forecasts", "SELECT series_id, 'kNN(5)' AS model, ts, avg(y) AS yhat FROM knn_s GROUP BY 1, 3", yhat=8)
def knn_forecasts(spark, sf):
    return M.knn_forecasts(supplier_returns(spark, sf))


@query("knn_forecasts_exclude_self", "SELECT series_id, 'kNN(5)' AS model, ts, avg(y) AS yhat FROM knn_x GROUP BY 1, 3", yhat=8)
def knn_forecasts_exclude_self(spark, sf):
    return M.knn_forecasts(supplier_returns(spark, sf), exclude_self=True)


# --- smooth transition ---

GAMMAS, CENTRES, STAR_ORDERS = (1.0, 2.0, 5.0, 10.0), (-1.0, -0.5, 0.0, 0.5, 1.0), range(1, 6)
fragment("lag2", lags_sql("smr", 2))
fragment("slag2", scaled_lags_sql("lag2", 2))
fragment("lag5", lags_sql("smr", 5))
fragment("slag5", scaled_lags_sql("lag5", 5))


def _values(xs):
    return ", ".join(f"({x}::DOUBLE)" for x in xs)


fragment("star_x", f"""SELECT s.*, kind, gamma, centre, CASE WHEN kind = 'LSTAR' THEN 1 / (1 + exp(-gamma * (x1 - centre)))
 ELSE 1 - exp(-gamma * (x1 - centre) ** 2) END AS g0 FROM slag5 s, (VALUES ('LSTAR'), ('ESTAR')) AS k(kind),
 (VALUES {_values(GAMMAS)}) AS g(gamma), (VALUES {_values(CENTRES)}) AS c(centre)""")
fragment("star_f", "SELECT *, " + ", ".join(f"g0 * x{k} AS g{k}" for k in STAR_ORDERS) + " FROM star_x")
fragment("star_train", f"SELECT * FROM star_f WHERE {IN_TRAIN}")
for _p in STAR_ORDERS:
    solve_fragments(f"star{_p}", "star_train", "series_id, kind, gamma, centre", [*M.lag_names(_p), "g0", *M.lag_names(_p, "g")], ridge=0.01)
    _v = value_sql("c.coef", [f"f.{x}" for x in [*M.lag_names(_p), "g0", *M.lag_names(_p, "g")]])
    _on = "f.series_id = c.series_id AND f.kind = c.kind AND f.gamma = c.gamma AND f.centre = c.centre"
    fragment(f"star_best{_p}", f"""SELECT * FROM (SELECT q.*, row_number() OVER (PARTITION BY series_id, kind ORDER BY sse, gamma,
 centre) AS rn FROM (SELECT c.series_id, c.kind, c.gamma, c.centre, any_value(c.coef) AS coef, sum((f.y - ({_v})) ** 2) AS sse
 FROM star_train f JOIN star{_p} c ON {_on} GROUP BY 1, 2, 3, 4) AS q) AS z WHERE rn = 1""")
    fragment(f"star_v{_p}", f"SELECT f.series_id, f.kind, {_p} AS p, f.ts, f.y, {_v} AS yhat FROM star_f f JOIN star_best{_p} c ON {_on}")
fragment("star_v", " UNION ALL ".join(f"SELECT * FROM star_v{p}" for p in STAR_ORDERS))
fragment("star_pick", """SELECT * FROM (SELECT series_id, kind, p, row_number() OVER (PARTITION BY series_id, kind ORDER BY
 avg((y - yhat) ** 2), p) AS rn FROM star_v WHERE ts >= DATE '1998-01-01' AND ts < DATE '2000-01-01' GROUP BY 1, 2, 3) AS q WHERE rn = 1""")


@query("star_forecasts", """SELECT v.series_id, v.kind || '(' || v.p || ')' AS model, v.ts, v.yhat FROM star_v v JOIN star_pick k
 ON v.series_id = k.series_id AND v.kind = k.kind AND v.p = k.p""", yhat=6)
def star_forecasts(spark, sf):
    return M.star_forecasts(supplier_panel(spark, sf), max(STAR_ORDERS), GAMMAS, CENTRES)


# --- feature regressions ---

_PRODUCTS = [f"x{a}_x{b}" for a in range(1, 7) for b in range(a, 7)]
fragment("honn_x", "SELECT *, " + ", ".join(f"x{a} * x{b} AS x{a}_x{b}" for a in range(1, 7) for b in range(a, 7)) + " FROM slag6")
fragment("honn_train", f"SELECT * FROM honn_x WHERE {IN_TRAIN}")
solve_fragments("honn", "honn_train", "series_id", [*M.lag_names(6), *_PRODUCTS], ridge=1.0)


@query("higher_order_forecasts", f"""SELECT x.series_id, 'HONN' AS model, x.ts,
 {value_sql('c.coef', ['x.' + n for n in [*M.lag_names(6), *_PRODUCTS]])} AS yhat FROM honn_x x JOIN honn c
 ON x.series_id = c.series_id""", yhat=6)
def higher_order_forecasts(spark, sf):
    return M.higher_order_forecasts(supplier_panel(spark, sf))


RBF_CENTRES = ((-1.0, 1.0), (0.0, 0.0), (1.0, -1.0), (1.0, 1.0))
fragment("rbf_x", "SELECT *, " + ", ".join(
    f"exp(-((x1 - ({a})) ** 2 + (x2 - ({b})) ** 2) / 8) AS phi{i + 1}" for i, (a, b) in enumerate(RBF_CENTRES)) + " FROM slag2")
fragment("rbf_train", f"SELECT * FROM rbf_x WHERE {IN_TRAIN}")
solve_fragments("rbf", "rbf_train", "series_id", M.lag_names(4, "phi"), ridge=1.0)


@query("radial_forecasts_fixed", f"""SELECT x.series_id, 'RBF' AS model, x.ts, {value_sql('c.coef', ['x.' + n for n in M.lag_names(4, 'phi')])}
 AS yhat FROM rbf_x x JOIN rbf c ON x.series_id = c.series_id""", yhat=6)
def radial_forecasts_fixed(spark, sf):
    return M.radial_forecasts(supplier_panel(spark, sf), RBF_CENTRES)


@query("radial_forecasts")
def radial_forecasts(spark, sf):
    """Centres learned by k-means over the lag vectors of all series."""
    r = supplier_panel(spark, sf)
    return M.radial_forecasts(r, M.radial_centres(r, 8, 6))


# --- unit roots and orders ---

ADF_LAGS = 12
fragment("adf_x", "SELECT * FROM (SELECT series_id, ts, value - lag(value, 1) OVER w AS y, lag(value, 1) OVER w AS x1, " + ", ".join(
    f"lag(value, {k}) OVER w - lag(value, {k + 1}) OVER w AS x{k + 1}" for k in range(1, ADF_LAGS + 1))
    + f" FROM smr WINDOW w AS (PARTITION BY series_id ORDER BY ts)) AS q WHERE x{ADF_LAGS + 1} IS NOT NULL")
for _k in range(ADF_LAGS + 1):
    solve_fragments(f"adf{_k}", "adf_x", "series_id", M.lag_names(_k + 1), inverse=True)
fragment("adf_all", " UNION ALL ".join(
    f"""SELECT series_id, {k} AS lag, n, coef[2] AS b, inv[2][2] AS v, (yy - list_sum(list_transform(coef, lambda c, i: c * b[i])))
 AS sse, {k + 2} AS width FROM adf{k}""" for k in range(ADF_LAGS + 1)))


@query("unit_root_test", """SELECT series_id, CAST(lag AS INT) AS lag, b / sqrt(sse / (n - width) * v) AS adf,
 CASE WHEN b / sqrt(sse / (n - width) * v) < -3.43 THEN '1%' WHEN b / sqrt(sse / (n - width) * v) < -2.86 THEN '5%'
 WHEN b / sqrt(sse / (n - width) * v) < -2.57 THEN '10%' ELSE '' END AS rejected FROM (SELECT *, row_number() OVER
 (PARTITION BY series_id ORDER BY n * ln(sse / n) + 2 * width, lag) AS rn FROM adf_all) AS q WHERE rn = 1""", adf=5)
def unit_root_test(spark, sf):
    from panelweave.operators.unit_root import unit_root_test as test
    return test(supplier_returns(spark, sf), ADF_LAGS)
