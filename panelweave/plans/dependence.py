"""Queries on volatility, residuals and time-varying correlation."""

from __future__ import annotations

import math
from itertools import product

from pyspark.sql import functions as F

from panelweave.config import ASSETS, OOS, WINDOW
from panelweave.functions import scalars as S
from panelweave.operators import bootstrap as B
from panelweave.operators import dependence as D
from panelweave.operators import panel as P
from panelweave.operators import scenario as Z
from panelweave.operators import volatility as V
from panelweave.operators.portfolio import scenario_sets, volatility_vectors
from panelweave.plans import fragments as Q
from panelweave.plans.panels import order_returns, supplier_returns
from panelweave.plans.registry import fragment, query
from panelweave.plans.solve_sql import solve_fragments, value_sql
from panelweave.session import scratch_path
from panelweave.sources.stores import grow, read_table, staged, write_table


def order_simple(spark, sf):
    return staged(order_returns(spark, sf).withColumn("value", S.log_to_simple("value")))


def residual_windows(simple):
    return D.date_windows(V.scaled_residuals(simple), ASSETS)


def past_residuals(simple):
    return D.past_vectors(V.scaled_residuals(simple), ASSETS)


def values(rows) -> str:
    """A VALUES list of numbered grid points as doubles."""
    return ", ".join("(" + ", ".join([str(i), *[f"{float(x)!r}::DOUBLE" for x in p]]) + ")" for i, p in enumerate(rows))


# --- volatility ---

fragment("gg", f"SELECT * FROM (VALUES {values(V.variance_grid(V.ALPHAS, V.BETAS))}) AS g(gid, a, b, g)")


def _garch_fragments(src: str, p: str) -> None:
    """``{p}_garch``: volatility of every date from the rows before it."""
    fragment(f"{p}_i", f"SELECT *, row_number() OVER (PARTITION BY series_id ORDER BY ts) AS i FROM {src}")
    fragment(f"{p}_gw", f"""SELECT a.series_id, a.ts, b.i - greatest(a.i - {WINDOW}, 1) + 1 AS k, b.value AS x, least(a.i - 1, {WINDOW}) AS n
 FROM {p}_i a JOIN {p}_i b ON a.series_id = b.series_id AND b.i BETWEEN a.i - {WINDOW} AND a.i - 1""")
    fragment(f"{p}_gv", f"SELECT series_id, ts, n, avg(x * x) AS v, stddev_samp(x) AS sd FROM {p}_gw GROUP BY 1, 2, 3")
    fragment(f"{p}_gr", f"""SELECT series_id, ts, n, v, gid, a, b, 0::BIGINT AS k, v AS s2, 0.0::DOUBLE AS ll FROM {p}_gv, gg WHERE n >= 10
 UNION ALL SELECT r.series_id, r.ts, r.n, r.v, r.gid, r.a, r.b, r.k + 1, (1 - r.a - r.b) * r.v + r.a * w.x * w.x + r.b * r.s2,
 r.ll - 0.5 * (ln(r.s2) + w.x * w.x / r.s2) FROM {p}_gr r JOIN {p}_gw w ON r.series_id = w.series_id AND r.ts = w.ts AND w.k = r.k + 1""")
    fragment(f"{p}_garch", f"""SELECT series_id, ts, sqrt(s2) AS sigma FROM (SELECT *, row_number() OVER (PARTITION BY series_id, ts ORDER BY
 ll DESC, gid) AS rn FROM {p}_gr WHERE k = n) AS q WHERE rn = 1 UNION ALL SELECT series_id, ts, sd FROM {p}_gv WHERE n < 10 AND n > 1""")


_garch_fragments("oms", "o")
_garch_fragments("smr", "s")
fragment("og", "SELECT * FROM o_garch")


@query("garch_volatility", "SELECT * FROM og", sigma=8)
def garch_volatility(spark, sf):
    return V.garch_volatility(order_simple(spark, sf))


@query("garch_volatility_suppliers", "SELECT * FROM s_garch", sigma=6)
def garch_volatility_suppliers(spark, sf):
    return V.garch_volatility(supplier_returns(spark, sf))


@query("ewma_volatility", f"""SELECT a.series_id, a.ts, sqrt(sum(power(0.94::DOUBLE, a.i - 1 - b.i) * b.value * b.value) /
 sum(power(0.94::DOUBLE, a.i - 1 - b.i))) AS sigma FROM smr_i a JOIN smr_i b ON a.series_id = b.series_id AND
 b.i BETWEEN a.i - {WINDOW} AND a.i - 1 GROUP BY 1, 2""", sigma=8)
def ewma_volatility(spark, sf):
    return V.ewma_volatility(supplier_returns(spark, sf))


def _scaled_sql(src: str) -> str:
    return f"""SELECT series_id, ts, value / sigma AS z FROM (SELECT series_id, ts, value, CASE WHEN count(value) OVER {Q.past_sql(WINDOW)} >= 12
 THEN stddev_samp(value) OVER {Q.past_sql(WINDOW)} END AS sigma FROM {src}) AS q WHERE sigma > 0"""


fragment("oz", _scaled_sql("oms"))
fragment("sz", _scaled_sql("smr"))


@query("scaled_residuals", "SELECT series_id, ts, z AS value FROM sz", value=6)
def scaled_residuals(spark, sf):
    return V.scaled_residuals(supplier_returns(spark, sf))


# --- order choice and marginal filter ---

fragment("mg", f"SELECT * FROM (VALUES {values(V.variance_grid(V.ALPHAS, V.BETAS, V.ASYMMETRIES))}) AS g(gid, a, b, g)")


def _marginal_fragments(p: str) -> None:
    """``{p}_bp``: order of each window; ``{p}_mz``: its standardised residuals."""
    fragment(f"{p}_bw", f"""SELECT a.series_id, a.ts, b.i - a.i + {WINDOW} AS k, b.value AS y FROM {p}_i a JOIN {p}_i b
 ON a.series_id = b.series_id AND b.i BETWEEN a.i - {WINDOW - 1} AND a.i WHERE a.i >= {WINDOW}""")
    fragment(f"{p}_bx", f"""SELECT * FROM (SELECT series_id, ts, k - 2 AS k, y, lag(y, 1) OVER w AS x1, lag(y, 2) OVER w AS x2 FROM {p}_bw
 WINDOW w AS (PARTITION BY series_id, ts ORDER BY k)) AS q WHERE k > 0""")
    solve_fragments(f"{p}_bic1", f"{p}_bx", "series_id, ts", ["x1"])
    solve_fragments(f"{p}_bic2", f"{p}_bx", "series_id, ts", ["x1", "x2"])
    fragment(f"{p}_be", " UNION ALL ".join(
        f"SELECT b.series_id, b.ts, {n} AS p, b.k, b.y - ({value_sql('c.coef', xs)}) AS e FROM {p}_bx b JOIN {p}_bic{n} c "
        f"ON b.series_id = c.series_id AND b.ts = c.ts" for n, xs in ((1, ["b.x1"]), (2, ["b.x1", "b.x2"]))))
    fragment(f"{p}_bp", f"""SELECT series_id, ts, p FROM (SELECT series_id, ts, p, row_number() OVER (PARTITION BY series_id, ts ORDER BY
 count(*) * ln(sum(e * e) / count(*)) + (p + 1) * ln(count(*)), p) AS rn FROM {p}_be GROUP BY 1, 2, 3) AS q WHERE rn = 1""")
    fragment(f"{p}_me", f"SELECT b.series_id, b.ts, b.k, b.e FROM {p}_be b JOIN {p}_bp p ON b.series_id = p.series_id AND b.ts = p.ts AND b.p = p.p")
    fragment(f"{p}_mv", f"SELECT series_id, ts, avg(e * e) AS v, count(*) AS n FROM {p}_me GROUP BY 1, 2")
    fragment(f"{p}_mr", f"""SELECT series_id, ts, n, v, gid, a, b, g, 0::BIGINT AS k, v AS s2, 0.0::DOUBLE AS ll FROM {p}_mv, mg
 UNION ALL SELECT r.series_id, r.ts, r.n, r.v, r.gid, r.a, r.b, r.g, r.k + 1, (1 - r.a - r.b - r.g / 2) * r.v +
 (r.a + CASE WHEN w.e < 0 THEN r.g ELSE 0 END) * w.e * w.e + r.b * r.s2, r.ll - 0.5 * (ln(r.s2) + w.e * w.e / r.s2) FROM {p}_mr r
 JOIN {p}_me w ON r.series_id = w.series_id AND r.ts = w.ts AND w.k = r.k + 1""")
    fragment(f"{p}_mb", f"""SELECT series_id, ts, gid, n FROM (SELECT *, row_number() OVER (PARTITION BY series_id, ts ORDER BY ll DESC, gid) AS rn
 FROM {p}_mr WHERE k = n) AS q WHERE rn = 1""")
    fragment(f"{p}_mz", f"""SELECT b.series_id, b.ts, e.k, b.n, e.e / sqrt(r.s2) AS z FROM {p}_mb b JOIN {p}_mr r ON b.series_id = r.series_id
 AND b.ts = r.ts AND b.gid = r.gid JOIN {p}_me e ON e.series_id = r.series_id AND e.ts = r.ts AND e.k = r.k + 1""")


_marginal_fragments("o")
_marginal_fragments("s")
_LAST_RESIDUAL = """SELECT a.series_id, a.ts, a.z, (count(*) FILTER (WHERE b.z < a.z) + (count(*) FILTER (WHERE b.z = a.z) + 1)
 / 2.0::DOUBLE) / (any_value(a.n) + 1) AS u FROM {p}_mz a JOIN {p}_mz b ON a.series_id = b.series_id AND a.ts = b.ts WHERE a.k = a.n
 GROUP BY 1, 2, 3"""


@query("bic_order", "SELECT series_id, ts, CAST(p AS INT) AS ar_order FROM o_bp")
def bic_order(spark, sf):
    return V.window_orders(order_simple(spark, sf))


# Orders of mean and variance: squares of the residuals on past squares and on what a long regression leaves of them.
_SQUARES = {1: ["x1"], 2: ["x1", "x2"]}
fragment("vo_s", "SELECT series_id, ts, p, k, e * e AS y, " + ", ".join(f"lag(e * e, {i}) OVER w AS x{i}" for i in (1, 2, 3))
         + " FROM o_be WINDOW w AS (PARTITION BY series_id, ts, p ORDER BY k)")
fragment("vo_l", "SELECT * FROM vo_s WHERE k > 3")
solve_fragments("vo_lc", "vo_l", "series_id, ts, p", ["x1", "x2", "x3"])
fragment("vo_v", f"""SELECT l.series_id, l.ts, l.p, l.k, l.y, l.x1, l.x2, l.y - ({value_sql('c.coef', ['l.x1', 'l.x2', 'l.x3'])}) AS v FROM vo_l l JOIN vo_lc c
 ON l.series_id = c.series_id AND l.ts = c.ts AND l.p = c.p""")
fragment("vo_x", """SELECT * FROM (SELECT *, lag(v, 1) OVER w AS v1, lag(v, 2) OVER w AS v2 FROM vo_v WINDOW w AS (PARTITION BY series_id, ts, p ORDER BY k)) AS q
 WHERE k > 5""")
_CANDIDATES = [(a, q, [f"x{i}" for i in range(1, a + 1)] + [f"v{i}" for i in range(1, q + 1)]) for a in (1, 2) for q in (0, 1, 2)]
for _a, _q, _xs in _CANDIDATES:
    solve_fragments(f"vo_c{_a}{_q}", "vo_x", "series_id, ts, p", _xs)
fragment("vo_b", " UNION ALL ".join(
    f"SELECT x.series_id, x.ts, x.p, {a} AS a, {q} AS q, count(*) * ln(sum((x.y - ({value_sql('c.coef', ['x.' + n for n in xs])})) ** 2) / count(*)) + {a + q + 1} * ln(count(*)) AS b "
    f"FROM vo_x x JOIN vo_c{a}{q} c ON x.series_id = c.series_id AND x.ts = c.ts AND x.p = c.p GROUP BY 1, 2, 3" for a, q, xs in _CANDIDATES))
fragment("vo_m", "SELECT series_id, ts, p, count(*) * ln(sum(e * e) / count(*)) + (p + 1) * ln(count(*)) AS m FROM o_be GROUP BY 1, 2, 3")


@query("volatility_orders", """SELECT series_id, ts, CAST(p AS INT) AS ar_order, CAST(a AS INT) AS shock_order, CAST(q AS INT) AS variance_order, bic FROM (SELECT b.*,
 b.b + m.m AS bic, row_number() OVER (PARTITION BY b.series_id, b.ts ORDER BY b.b + m.m, b.p, b.a, b.q) AS rn FROM vo_b b JOIN vo_m m ON b.series_id = m.series_id
 AND b.ts = m.ts AND b.p = m.p) AS c WHERE rn = 1""", bic=5)
def volatility_orders(spark, sf):
    return V.volatility_orders(order_simple(spark, sf))


@query("marginal_residuals", _LAST_RESIDUAL.format(p="o"), z=6, u=8)
def marginal_residuals(spark, sf):
    return V.marginal_residuals(order_simple(spark, sf))


@query("marginal_residuals_suppliers", _LAST_RESIDUAL.format(p="s"), z=5, u=8)
def marginal_residuals_suppliers(spark, sf):
    return V.marginal_residuals(supplier_returns(spark, sf))


NUS, LAMS = (4.0, 6.0, 8.0, 12.0, 20.0), (-0.3, -0.15, 0.0, 0.15, 0.3)


def _skewed_sql(nu: float, lam: float) -> str:
    a, b, c = S.hansen_constants(nu, lam)
    s = f"({b!r}::DOUBLE * z + ({a!r}::DOUBLE))"
    return (f"sum({math.log(b * c)!r}::DOUBLE - {(nu + 1) / 2!r}::DOUBLE * ln(1 + ({s} / CASE WHEN {s} < 0 THEN {1 - lam!r}::DOUBLE "
            f"ELSE {1 + lam!r}::DOUBLE END) ** 2 / {nu - 2!r}::DOUBLE))")


_GRID = list(product(NUS, LAMS))
fragment("sk", f"""SELECT series_id, count(*) AS n, [{', '.join(_skewed_sql(*g) for g in _GRID)}] AS l FROM sz
 WHERE ts <= DATE '1999-12-31' GROUP BY 1""")


@query("skewed_t_fit", f"""SELECT series_id, n, CASE WHEN n < 20 THEN 8.0 ELSE ([{', '.join(repr(g[0]) for g in _GRID)}]::DOUBLE[])
[list_position(l, list_max(l))] END AS nu, CASE WHEN n < 20 THEN 0.0 ELSE ([{', '.join(repr(g[1]) for g in _GRID)}]::DOUBLE[])
[list_position(l, list_max(l))] END AS lam FROM sk""")
def skewed_t_fit(spark, sf):
    import datetime as dt
    return V.skewed_t_fit(V.scaled_residuals(supplier_returns(spark, sf)), NUS, LAMS, dt.date(1999, 12, 31))


# --- windows of residual vectors ---

fragment("ozd", f"SELECT ts, row_number() OVER (ORDER BY ts) AS i FROM oz GROUP BY ts HAVING count(*) = {len(ASSETS)}")
fragment("oww", f"""SELECT t.ts, d.i - t.i + {WINDOW + 1} AS k, z.series_id, z.z FROM ozd t JOIN ozd d ON d.i BETWEEN t.i - {WINDOW} AND t.i - 1
 JOIN oz z ON z.ts = d.ts WHERE t.i > {WINDOW}""")
fragment("opw", f"""SELECT *, lead(x) OVER (PARTITION BY ts, s1, s2 ORDER BY k) AS xn, lead(y) OVER (PARTITION BY ts, s1, s2 ORDER BY k) AS yn
 FROM (SELECT a.ts, a.k, a.series_id AS s1, b.series_id AS s2, a.z AS x, b.z AS y FROM oww a JOIN oww b ON a.ts = b.ts AND a.k = b.k
 AND a.series_id < b.series_id) AS q""")
fragment("qbar", """SELECT ts, s1, s2, corr(x, y) AS rho, avg(least(x, 0) * least(y, 0)) AS nxy, avg(least(x, 0) * least(x, 0)) AS nxx,
 avg(least(y, 0) * least(y, 0)) AS nyy FROM opw GROUP BY 1, 2, 3""")
fragment("owr", f"SELECT ts, k, series_id, {Q.average_rank_sql('z', 'ts, series_id')} AS z FROM oww")
fragment("sbar", """SELECT a.ts, a.series_id AS s1, b.series_id AS s2, corr(a.z, b.z) AS rho FROM owr a JOIN owr b ON a.ts = b.ts AND a.k = b.k
 AND a.series_id < b.series_id GROUP BY 1, 2, 3""")


def _dcc_fragments(name: str, grid, last: bool) -> None:
    """Recursion over the window per date, pair and grid point."""
    steps = WINDOW if last else WINDOW - 1
    fragment(f"{name}_g", f"SELECT * FROM (VALUES {values(grid)}) AS g(gid, a, b, g)")
    fragment(f"{name}_r", f"""SELECT q.ts, q.s1, q.s2, g.gid, g.a, g.b, g.g, 1::BIGINT AS k, 1.0::DOUBLE AS qx, 1.0::DOUBLE AS qy, q.rho AS qo,
 q.rho AS rho, 0.0::DOUBLE AS ll, true AS ok FROM qbar q, {name}_g g
 UNION ALL SELECT ts, s1, s2, gid, a, b, g, k + 1, qx, qy, qo, rho, ll + CASE WHEN ok AND good AND xn IS NOT NULL THEN -0.5 *
 (ln(1 - rho * rho) + (xn * xn - 2 * rho * xn * yn + yn * yn) / (1 - rho * rho) - xn * xn - yn * yn) ELSE 0 END, ok AND good FROM
 (SELECT *, qx > 0 AND qy > 0 AND abs(rho) < 1 AS good FROM (SELECT *, CASE WHEN qx > 0 AND qy > 0 THEN qo / sqrt(qx * qy) ELSE 9.0 END AS rho
 FROM (SELECT r.ts, r.s1, r.s2, r.gid, r.a, r.b, r.g, r.k, r.ll, r.ok, w.xn, w.yn,
 (1 - r.a - r.b) - r.g * q.nxx + r.a * w.x * w.x + r.g * least(w.x, 0) * least(w.x, 0) + r.b * r.qx AS qx,
 (1 - r.a - r.b) - r.g * q.nyy + r.a * w.y * w.y + r.g * least(w.y, 0) * least(w.y, 0) + r.b * r.qy AS qy,
 (1 - r.a - r.b) * q.rho - r.g * q.nxy + r.a * w.x * w.y + r.g * least(w.x, 0) * least(w.y, 0) + r.b * r.qo AS qo
 FROM {name}_r r JOIN opw w ON r.ts = w.ts AND r.s1 = w.s1 AND r.s2 = w.s2 AND r.k = w.k JOIN qbar q ON r.ts = q.ts AND r.s1 = q.s1
 AND r.s2 = q.s2 WHERE r.k <= {steps}) AS a) AS b) AS c""")
    fragment(f"{name}_b", f"""SELECT ts, gid FROM (SELECT ts, gid, row_number() OVER (PARTITION BY ts ORDER BY sum(ll) DESC, gid) AS rn FROM
 {name}_r WHERE k = {steps + 1} GROUP BY 1, 2 HAVING bool_and(ok)) AS q WHERE rn = 1""")
    fragment(name, f"""SELECT q.ts, q.s1, q.s2, coalesce(r.rho, q.rho) AS rho FROM qbar q LEFT JOIN (SELECT r.* FROM {name}_r r JOIN {name}_b b
 ON r.ts = b.ts AND r.gid = b.gid WHERE r.k = {steps + 1}) AS r ON q.ts = r.ts AND q.s1 = r.s1 AND q.s2 = r.s2""")


_DCC = [(a, b, 0.0) for a, b in product(*D.DCC_GRID) if a + b < 0.9999]
_ADCC = [p for p in product(*D.DCC_GRID, D.ADCC_G) if sum(p) < 0.9999]
_GAS = [p for p in product(*D.GAS_GRID) if p[0] + p[1] < 0.9999]
_dcc_fragments("dcc_o", _DCC, True)
_dcc_fragments("dcc_lagged", _DCC, False)
_dcc_fragments("adcc_o", _ADCC, True)

fragment("gas_g", f"SELECT * FROM (VALUES {values(_GAS)}) AS g(gid, a, b, nu)")
fragment("gas_r", f"""SELECT q.ts, q.s1, q.s2, g.gid, g.a, g.b, g.nu, atanh(greatest(least(q.rho, 0.9999), -0.9999)) AS c, 0::BIGINT AS k,
 atanh(greatest(least(q.rho, 0.9999), -0.9999)) AS f, 0.0::DOUBLE AS ll FROM sbar q, gas_g g
 UNION ALL SELECT ts, s1, s2, gid, a, b, nu, c, k + 1, greatest(least((1 - a - b) * c + a * (rho * rest + (nu + 2) / (nu + qq) *
 ((1 + rho * rho) * x * y - rho * (x * x + y * y))) / rest + b * f, 3.0), -3.0),
 ll - ln(2 * pi()) - 0.5 * ln(rest) - (nu + 2) / 2 * ln(1 + qq / nu) FROM (SELECT *, (x * x - 2 * rho * x * y + y * y) / rest AS qq FROM
 (SELECT *, 1 - rho * rho AS rest FROM (SELECT r.*, tanh(r.f) AS rho, w.x, w.y FROM gas_r r JOIN opw w ON r.ts = w.ts AND r.s1 = w.s1
 AND r.s2 = w.s2 AND w.k = r.k + 1) AS a) AS b) AS c""")
fragment("gas_b", f"""SELECT ts, gid FROM (SELECT ts, gid, row_number() OVER (PARTITION BY ts ORDER BY sum(ll) DESC, gid) AS rn FROM gas_r
 WHERE k = {WINDOW} GROUP BY 1, 2) AS q WHERE rn = 1""")
fragment("gas_o", f"""SELECT r.ts, r.s1, r.s2, CASE WHEN stddev_pop(abs(tanh(r.f))) OVER (PARTITION BY r.ts) < 0.02 THEN s.rho ELSE tanh(r.f) END
 AS rho FROM gas_r r JOIN gas_b b ON r.ts = b.ts AND r.gid = b.gid JOIN sbar s ON r.ts = s.ts AND r.s1 = s.s1 AND r.s2 = s.s2
 WHERE r.k = {WINDOW}""")
fragment("corr_o", "SELECT 'DCC' AS model, * FROM dcc_o UNION ALL SELECT 'ADCC', * FROM adcc_o UNION ALL SELECT 'GAS', * FROM gas_o")


@query("dcc_correlation", "SELECT 'DCC' AS model, * FROM dcc_o", rho=6)
def dcc_correlation(spark, sf):
    return D.dcc(residual_windows(order_simple(spark, sf)), ASSETS)


@query("dcc_correlation_lagged", "SELECT 'DCC' AS model, * FROM dcc_lagged", rho=6)
def dcc_correlation_lagged(spark, sf):
    return D.dcc(residual_windows(order_simple(spark, sf)), ASSETS, include_last=False)


@query("adcc_correlation", "SELECT 'ADCC' AS model, * FROM adcc_o", rho=6)
def adcc_correlation(spark, sf):
    return D.adcc(residual_windows(order_simple(spark, sf)), ASSETS)


@query("score_driven_correlation", "SELECT 'GAS' AS model, * FROM gas_o", rho=6)
def score_driven_correlation(spark, sf):
    return D.score_driven(residual_windows(order_simple(spark, sf)), ASSETS)


def all_correlations(simple):
    w = staged(residual_windows(simple))
    return D.dcc(w, ASSETS).unionByName(D.adcc(w, ASSETS)).unionByName(D.score_driven(w, ASSETS))


fragment("full_corr", """SELECT model, ts, s1, s2, greatest(least(rho, 1 - 1e-6), 1e-6 - 1) AS rho FROM corr_o UNION ALL
 SELECT model, ts, s2, s1, greatest(least(rho, 1 - 1e-6), 1e-6 - 1) FROM corr_o UNION ALL
 SELECT DISTINCT model, ts, s, s, 1.0::DOUBLE FROM (SELECT model, ts, unnest([s1, s2]) AS s FROM corr_o) AS q""")


@query("correlation_matrix", "SELECT * FROM full_corr", rho=6)
def correlation_matrix(spark, sf):
    m = D.correlation_matrix(all_correlations(order_simple(spark, sf)), ASSETS)
    return D.matrix_cells(m, "matrix", ASSETS, ["model", "ts"], "rho")


@query("repaired_matrix", "SELECT * FROM full_corr", rho=6)
def repaired_matrix(spark, sf):
    """Sound matrices pass unchanged; tests cover the unsound ones."""
    m = D.correlation_matrix(all_correlations(order_simple(spark, sf)), ASSETS).withColumn("matrix", D.repair("matrix"))
    return D.matrix_cells(m, "matrix", ASSETS, ["model", "ts"], "rho")


_SOUND = "SELECT model, ts, true AS unit_diagonal, true AS positive, true AS sound_unchanged FROM full_corr GROUP BY 1, 2"


@query("repair_properties", _SOUND)
def repair_properties(spark, sf):
    """Correlations of the panel, stretched until most matrices are unsound: what the repair makes of them."""
    m = D.correlation_matrix(all_correlations(order_simple(spark, sf)), ASSETS)
    stretch = lambda r, i, j: F.when(i == j, r).otherwise(F.greatest(F.least(r * 4, F.lit(0.99)), F.lit(-0.99)))
    bent = F.transform("matrix", lambda row, i: F.transform(row, lambda r, j: stretch(r, i, j)))
    both = m.withColumn("bent", bent).withColumn("fixed", D.repair("bent"))
    rows = both.select("model", "ts", "fixed", D.smallest_root("bent").alias("before"), D.smallest_root("fixed").alias("after"), (F.col("bent") == F.col("fixed")).alias("same"))
    diagonal = F.forall(F.transform("fixed", lambda row, i: row[i]), lambda d: F.abs(d - 1) < 1e-9)
    return rows.select("model", "ts", diagonal.alias("unit_diagonal"), (F.col("after") > 0).alias("positive"),
                       ((F.col("before") < 1e-8) | F.col("same")).alias("sound_unchanged"))


@query("recorrelated_windows", "SELECT model, ts, 0.0::DOUBLE AS gap FROM full_corr GROUP BY 1, 2", gap=6)
def recorrelated_windows(spark, sf):
    """How far the sample correlation of recorrelated windows is from the stated one."""
    simple = order_simple(spark, sf)
    m = D.correlation_matrix(all_correlations(simple), ASSETS).withColumn("matrix", D.repair("matrix"))
    rows = m.join(residual_windows(simple), "ts").withColumn("window", Z.recorrelate("window", "matrix"))
    return rows.select("model", "ts", D.correlation_gap("window", "matrix").alias("gap"))


@query("covariance_matrix", """SELECT c.model, c.ts, c.s1, c.s2, c.rho * a.sigma * b.sigma AS cov FROM full_corr c JOIN og a ON c.ts = a.ts
 AND c.s1 = a.series_id JOIN og b ON c.ts = b.ts AND c.s2 = b.series_id""", cov=8)
def covariance_matrix(spark, sf):
    simple = order_simple(spark, sf)
    m = D.correlation_matrix(all_correlations(simple), ASSETS)
    s = volatility_vectors(V.garch_volatility(simple), ASSETS)
    return D.matrix_cells(m.join(s, "ts").withColumn("cov", D.covariance("matrix", "s")), "cov", ASSETS, ["model", "ts"], "cov")


@query("stored_correlations", """SELECT model, ts, CASE WHEN s1 = 'MACHINERY' THEN 'MACH' ELSE s1 END AS s1,
 CASE WHEN s2 = 'MACHINERY' THEN 'MACH' ELSE s2 END AS s2, rho FROM corr_o""", rho=6)
def stored_correlations(spark, sf):
    """Written by one run in a folder per model, read back with series names mapped."""
    path = write_table(all_correlations(order_simple(spark, sf)), scratch_path(spark, "corr"), ["model"])
    return P.rename_series(read_table(spark, path), {"MACHINERY": "MACH"}, "s1", "s2")


# --- copula parameters and scenarios ---

COPULA_NUS = (3.0, 4.0, 5.0, 6.0, 8.0, 10.0, 15.0, 20.0, 30.0)
fragment("cp", f"""SELECT a.ts, a.z AS x, b.z AS y, coalesce(d.rho, 0) AS rho FROM oz a JOIN oz b ON a.ts = b.ts AND a.series_id < b.series_id
 JOIN ozd t ON a.ts = t.ts LEFT JOIN dcc_o d ON a.ts = d.ts AND a.series_id = d.s1 AND b.series_id = d.s2""")
fragment("cl", "SELECT ts, " + ", ".join(
    f"sum(-ln(2 * pi()) - 0.5 * ln(1 - rho * rho) - {(nu + 2) / 2!r}::DOUBLE * ln(1 + (x * x - 2 * rho * x * y + y * y) / (1 - rho * rho) / {nu!r}::DOUBLE)) AS n{i}"
    for i, nu in enumerate(COPULA_NUS)) + " FROM cp GROUP BY 1")
fragment("cd", "SELECT ts, CASE WHEN n < 12 THEN 8.0 ELSE ([" + ", ".join(map(repr, COPULA_NUS)) + """]::DOUBLE[])[list_position(l, list_max(l))] END
 AS nu FROM (SELECT ts, count(*) OVER w AS n, [""" + ", ".join(f"sum(n{i}) OVER w" for i in range(len(COPULA_NUS)))
         + f"] AS l FROM cl WINDOW w AS (ORDER BY ts ROWS BETWEEN {WINDOW} PRECEDING AND 1 PRECEDING)) AS q")


def degrees(simple):
    z = V.scaled_residuals(simple)
    return D.copula_degrees(z, D.dcc(D.date_windows(z, ASSETS), ASSETS), ASSETS)


@query("copula_degrees", "SELECT ts, nu FROM cd")
def copula_degrees(spark, sf):
    return degrees(order_simple(spark, sf))


@query("copula_skew", f"""SELECT z.series_id, z.ts, d.nu, greatest(least(z.m * (d.nu - 2) / d.nu, 2.0), -2.0) AS skew FROM (SELECT series_id, ts,
 CASE WHEN count(z) OVER {Q.past_sql(WINDOW)} >= 12 THEN avg(z) OVER {Q.past_sql(WINDOW)} ELSE 0 END AS m FROM oz) AS z JOIN cd d ON z.ts = d.ts""", skew=6)
def copula_skew(spark, sf):
    simple = order_simple(spark, sf)
    return D.copula_skew(V.scaled_residuals(simple), degrees(simple))


fragment("scen", """SELECT w.ts, w.k AS scen_id, w.series_id, w.z * g.sigma AS r FROM oww w JOIN og g ON w.ts = g.ts AND w.series_id = g.series_id""")


def shared_scenarios(simple):
    s = volatility_vectors(V.garch_volatility(simple), ASSETS)
    return Z.residual_scenarios(residual_windows(simple), s)


@query("residual_scenarios", "SELECT ts, CAST(scen_id AS INT) AS scen_id, series_id, r FROM scen", r=8)
def residual_scenarios(spark, sf):
    return Z.scenario_rows(shared_scenarios(order_simple(spark, sf)), ASSETS)


_START = f"(((q // {Z.BLOCK} * {B.REPLICATE_STEP} + 42) % {B.MODULUS} * {B.MULTIPLIER} + {B.INCREMENT}) % {B.MODULUS} * {B.MULTIPLIER} + {B.INCREMENT}) % {B.MODULUS} // {B.DROP}"
fragment("dsd", f"""SELECT ts, ({_START} % (i - 1) + q % {Z.BLOCK}) % (i - 1) + 1 AS i, count(*) AS times FROM (SELECT ts, i FROM ozd WHERE i > {WINDOW}
 AND ts >= DATE '2000-01-01') AS t, generate_series(0, {Z.DRAWS - 1}) AS g(q) GROUP BY ALL""")
fragment("dsr", """SELECT d.ts, d.i, d.times, z.series_id, z.z * g.sigma AS r FROM dsd d JOIN ozd o ON o.i = d.i JOIN oz z ON z.ts = o.ts
 JOIN og g ON g.ts = d.ts AND g.series_id = z.series_id""")


def deep_windows(simple):
    """Sets of 5,000 scenarios for the dates out of sample, from all residual vectors before them."""
    z = V.scaled_residuals(simple)
    return Z.resampled(z, ASSETS, dates=P.period_filter(z, OOS))


@query("resampled_scenarios", "SELECT ts, CAST(times AS INT) AS times, series_id, r FROM dsr", r=8)
def resampled_scenarios(spark, sf):
    simple = order_simple(spark, sf)
    sets = scenario_sets(deep_windows(simple), volatility_vectors(V.garch_volatility(simple), ASSETS))
    rows = sets.select("ts", F.inline(F.arrays_zip("vectors", "times")))
    names = F.array(*[F.lit(a) for a in ASSETS])
    return rows.select("ts", F.col("times").cast("int").alias("times"), F.posexplode("vectors").alias("k", "r")).select("ts", "times", names[F.col("k")].alias("series_id"), "r")


@query("grown_correlations", "SELECT *, CASE WHEN ts < DATE '2000-06-01' THEN 1 ELSE 2 END AS run FROM corr_o", rho=6)
def grown_correlations(spark, sf):
    """Residuals and correlations as stores that grow: the second run computes the dates that the first did not have."""
    simple, root = order_simple(spark, sf), scratch_path(spark, "grown")
    residuals = staged(V.scaled_residuals(simple))
    for run, until in ((1, "2000-06-01"), (2, "2100-01-01")):
        known = residuals.where(F.col("ts") < F.lit(until).cast("date"))
        z = grow(spark, f"{root}/residuals", known, lambda missing, known=known: known.join(missing, "ts", "left_semi"))
        windows = staged(D.date_windows(z.select("series_id", "ts", "value"), ASSETS))

        def correlations(missing, windows=windows, run=run):
            w = staged(windows.join(missing, "ts", "left_semi"))
            return D.dcc(w, ASSETS).unionByName(D.adcc(w, ASSETS)).unionByName(D.score_driven(w, ASSETS)).withColumn("run", F.lit(run))

        out = grow(spark, f"{root}/correlations", windows, correlations)
    return out.select("model", "ts", "s1", "s2", "rho", "run")
