"""Queries that reduce, combine and jointly test forecasts."""

from __future__ import annotations

from pyspark.sql import functions as F

from panelweave.config import IN_SAMPLE, OOS, WINDOW
from panelweave.functions import scalars as S
from panelweave.operators import bootstrap as B
from panelweave.operators import combine as C
from panelweave.operators import forecast as M
from panelweave.operators import evaluate as E
from panelweave.operators import features as X
from panelweave.operators import panel as P
from panelweave.operators import windows as N
from panelweave.operators.regression import linear_value
from panelweave.plans import fragments as Q
from panelweave.plans.evaluation import MODELS, best_in, supplier_losses
from panelweave.plans.panels import order_panel, supplier_panel
from panelweave.plans.registry import fragment, query
from panelweave.plans.solve_sql import solve_fragments, value_sql
from panelweave.session import scratch_path
from panelweave.sources.stores import read_table, staged, write_table

# --- model weights ---

fragment("mw_sigma", f"""SELECT series_id, ts, CASE WHEN count(value) OVER {Q.past_sql(WINDOW)} >= 12 THEN
 stddev_samp(value) OVER {Q.past_sql(WINDOW)} END AS sigma FROM smr""")
fragment("mw_ll", """SELECT p.series_id, p.model, p.ts, -0.5 * (ln(2 * pi() * greatest(s.sigma * s.sigma, 1e-10)) +
 (r.value - p.yhat) ** 2 / greatest(s.sigma * s.sigma, 1e-10)) AS ll FROM pool_s p JOIN smr r ON p.series_id = r.series_id
 AND p.ts = r.ts JOIN mw_sigma s ON p.series_id = s.series_id AND p.ts = s.ts WHERE s.sigma IS NOT NULL""")
fragment("mw_lw", """SELECT a.series_id, a.model, a.ts, coalesce(sum(power(0.99::DOUBLE, a.t - b.t) * b.ll), 0) AS lw FROM (SELECT *, row_number() OVER
 (PARTITION BY series_id, model ORDER BY ts) AS t FROM mw_ll) AS a LEFT JOIN (SELECT *, row_number() OVER (PARTITION BY
 series_id, model ORDER BY ts) AS t FROM mw_ll) AS b ON a.series_id = b.series_id AND a.model = b.model AND b.t < a.t GROUP BY 1, 2, 3""")


def scored_pool(spark, sf):
    r = supplier_panel(spark, sf)
    sigma = N.rolling_std(r, WINDOW, 12).where(F.col("sigma").isNotNull())
    loss = E.losses(N.simple_pool(r), r).join(sigma, ["series_id", "ts"])
    ll = S.normal_log_density(F.col("y"), F.col("yhat"), F.col("sigma") * F.col("sigma"))
    return loss.select("series_id", "model", "ts", ll.alias("ll"))


@query("model_weights", """SELECT series_id, model, ts, exp(lw - max(lw) OVER (PARTITION BY series_id, ts)) / sum(exp(lw)) OVER
 (PARTITION BY series_id, ts) * exp(max(lw) OVER (PARTITION BY series_id, ts)) AS w FROM mw_lw""", w=6)
def model_weights(spark, sf):
    return C.model_weights(scored_pool(spark, sf))


# --- dynamic averaging over two components ---

fragment("dma_x", """SELECT *, row_number() OVER (PARTITION BY series_id ORDER BY ts) AS i, count(*) OVER (PARTITION BY series_id) AS n
 FROM (SELECT r.series_id, r.ts, r.value AS y, a.yhat AS x1, b.yhat AS x2 FROM smr r JOIN pool_s a ON r.series_id = a.series_id
 AND r.ts = a.ts AND a.model = 'SMA(3)' JOIN pool_s b ON r.series_id = b.series_id AND r.ts = b.ts AND b.model = 'SMA(12)') AS q""")
fragment("dma_0", """SELECT series_id, var_pop(y) AS r0 FROM dma_x WHERE i <= greatest(10, n // 10) GROUP BY 1""")
fragment("dma_r", """SELECT d.series_id, m.m1, m.m2, 0 AS i, 0.0::DOUBLE AS z1, 0.0::DOUBLE AS z2, 1.0::DOUBLE AS c11, 0.0::DOUBLE AS c12,
 1.0::DOUBLE AS c22, d.r0 AS r, 0.0::DOUBLE AS lw, 0.0::DOUBLE AS ll, 0.0::DOUBLE AS mu, 0.0::DOUBLE AS used FROM dma_0 d,
 (VALUES (0, 0), (1, 0), (0, 1), (1, 1)) AS m(m1, m2)
 UNION ALL SELECT series_id, m1, m2, i, z1 + k1 * e, z2 + k2 * e, c11 / 0.99::DOUBLE - v * k1 * k1, c12 / 0.99::DOUBLE - v * k1 * k2,
 c22 / 0.99::DOUBLE - v * k2 * k2, CASE WHEN m1 + m2 > 0 THEN greatest(0.99::DOUBLE * r + 0.01::DOUBLE * e * e, 1e-6) ELSE r END,
 0.99::DOUBLE * (lw + ll), lnew, munew, lw FROM (SELECT *, g1 / 0.99::DOUBLE / v AS k1, g2 / 0.99::DOUBLE / v AS k2,
 -0.5 * (ln(2 * pi() * greatest(qf + r, 1e-10)) + e * e / greatest(qf + r, 1e-10)) AS lnew FROM (SELECT *, y - munew AS e,
 f1 * g1 + f2 * g2 AS qf, (f1 * g1 + f2 * g2) / 0.99::DOUBLE + r AS v FROM (SELECT *, f1 * z1 + f2 * z2 AS munew, c11 * f1 + c12 * f2 AS g1,
 c12 * f1 + c22 * f2 AS g2 FROM (SELECT s.series_id, s.m1, s.m2, x.i, s.z1, s.z2, s.c11, s.c12, s.c22, s.r, s.lw, s.ll, x.y,
 s.m1 * x.x1 AS f1, s.m2 * x.x2 AS f2 FROM dma_r s JOIN dma_x x ON s.series_id = x.series_id AND x.i = s.i + 1) AS a) AS b) AS c) AS d""")
fragment("dma_w", """SELECT series_id, i, mu, lw - max(lw) OVER (PARTITION BY series_id, i) AS l FROM (SELECT series_id, i, mu, lw
 FROM dma_r WHERE i > 0) AS q""")


@query("dma_forecasts", """SELECT x.series_id, 'DMA' AS model, x.ts, sum(exp(w.l) * w.mu) / sum(exp(w.l)) AS yhat FROM dma_w w JOIN dma_x x
 ON w.series_id = x.series_id AND w.i = x.i WHERE x.i > greatest(10, x.n // 10) GROUP BY 1, 3""", yhat=6)
def dma_forecasts(spark, sf):
    r = supplier_panel(spark, sf)
    loss = E.losses(N.simple_pool(r, (3, 12)), r)
    pick = lambda m: F.max(F.when(F.col("model") == m, F.col("yhat")))
    rows = loss.groupBy("series_id", "ts").agg(F.first("y").alias("y"), pick("SMA(3)").alias("x1"), pick("SMA(12)").alias("x2"))
    return C.dynamic_average(rows.where("x1 IS NOT NULL AND x2 IS NOT NULL"), ["x1", "x2"], masks_per_task=2)


# --- principal components ---

PCA_SPANS = (3, 4, 5)
PCA_MODELS = ("RW", "SMA(3)", "SMA(4)", "SMA(5)")
fragment("pc_pool", Q.pool_sql("smr", PCA_SPANS))
fragment("pc_n", "SELECT series_id, count(*) AS dates FROM pc_pool WHERE model = 'RW' AND ts < DATE '2000-01-01' GROUP BY 1")
fragment("pc_stat", """SELECT p.series_id, p.model, avg(p.yhat) AS mean, sqrt(var_pop(p.yhat) * count(*) / any_value(n.dates)) AS scale
 FROM pc_pool p JOIN pc_n n ON p.series_id = n.series_id WHERE p.ts < DATE '2000-01-01' GROUP BY 1, 2
 HAVING count(*) >= 0.9 * any_value(n.dates)""")
fragment("pc_z", "SELECT series_id, ts, " + ", ".join(
    f"coalesce(max(CASE WHEN model = '{m}' THEN z END), 0) AS z{i}" for i, m in enumerate(PCA_MODELS, 1))
    + """ FROM (SELECT p.series_id, p.ts, p.model, (p.yhat - s.mean) / s.scale AS z FROM pc_pool p JOIN pc_stat s ON
 p.series_id = s.series_id AND p.model = s.model WHERE p.ts < DATE '2000-01-01') AS q GROUP BY 1, 2""")
fragment("pc_a", "SELECT series_id, [" + ", ".join("[" + ", ".join(f"avg(z{i} * z{j})" for j in range(1, 5)) + "]" for i in range(1, 5))
         + "] AS a FROM pc_z GROUP BY 1")
_SQUARE = ("list_transform(m, lambda r: list_transform([1, 2, 3, 4], lambda j: list_sum(list_transform([1, 2, 3, 4], "
           "lambda l: r[l] * m[l][j])) / (m[1][1] + m[2][2] + m[3][3] + m[4][4]) ** 2))")


# Enough that two axes of almost equal variance are told apart.
SQUARINGS = 18


def _axis_fragments(k: int) -> None:
    """Axis ``k`` from the matrix left after the earlier ones: ``pc_e{k}`` and the rest ``pc_a{k + 1}``.

    The columns of a high power are multiples of the leading axis; the one
    with the largest diagonal is taken and scaled.
    """
    fragment(f"pc_p{k}", f"SELECT series_id, a AS m, 0 AS k FROM pc_a{k} UNION ALL SELECT series_id, {_SQUARE}, k + 1 FROM pc_p{k} WHERE k < {SQUARINGS}")
    fragment(f"pc_v{k}", f"""SELECT p.series_id, a.a, m[list_position([m[1][1], m[2][2], m[3][3], m[4][4]], greatest(m[1][1], m[2][2], m[3][3],
 m[4][4]))] AS u FROM pc_p{k} p JOIN pc_a{k} a ON p.series_id = a.series_id WHERE k = {SQUARINGS}""")
    fragment(f"pc_n{k}", f"""SELECT series_id, a, list_transform(u, lambda x: x / sqrt(list_sum(list_transform(u, lambda y: y * y))) * sign(u[list_position(
 list_transform(u, lambda y: abs(y)), list_max(list_transform(u, lambda y: abs(y))))])) AS v FROM pc_v{k}""")
    fragment(f"pc_e{k}", f"""SELECT series_id, a, v, list_sum(list_transform(a, lambda r, i: v[i] * list_sum(list_transform(r, lambda x, j: x * v[j])))) / 4
 AS explained FROM pc_n{k}""")
    fragment(f"pc_a{k + 1}", f"""SELECT series_id, list_transform(a, lambda r, i: list_transform(r, lambda x, j: x - 4 * explained * v[i] * v[j])) AS a
 FROM pc_e{k}""")


fragment("pc_a1", "SELECT * FROM pc_a")
for _k in (1, 2, 3, 4):
    _axis_fragments(_k)
fragment("pc_every", " UNION ALL ".join(f"SELECT series_id, {k} AS k, v, explained FROM pc_e{k}" for k in (1, 2, 3, 4)))
# An axis is kept while the ones before it explain no more than the share asked for.
fragment("pc_kept", """SELECT * FROM (SELECT *, coalesce(sum(explained) OVER (PARTITION BY series_id ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND
 1 PRECEDING), 0) AS before FROM pc_every) AS q WHERE before <= 0.95""")
fragment("pc_models", "SELECT * FROM (VALUES " + ", ".join(f"('{m}', {i})" for i, m in enumerate(PCA_MODELS, 1)) + ") AS m(model, i)")


def pca_pool(spark, sf):
    return staged(N.simple_pool(supplier_panel(spark, sf), PCA_SPANS))


@query("pca_axes", """SELECT e.series_id, CAST(e.k AS INT) AS k, m.model, e.v[m.i] AS weight, e.explained, s.mean, s.scale FROM pc_kept e, pc_models m
 JOIN pc_stat s ON m.model = s.model WHERE e.series_id = s.series_id""", weight=5, explained=6, mean=8, scale=8)
def pca_axes(spark, sf):
    return C.loadings(pca_pool(spark, sf))


@query("pca_first_axis", """SELECT e.series_id, m.model, e.v[m.i] AS weight, e.explained, s.mean, s.scale FROM pc_e1 e, pc_models m
 JOIN pc_stat s ON m.model = s.model WHERE e.series_id = s.series_id""", weight=6, explained=6, mean=8, scale=8)
def pca_first_axis(spark, sf):
    return C.loadings(pca_pool(spark, sf)).where("k = 1").drop("k")


@query("pca_components", """SELECT p.series_id, p.ts, CAST(e.k AS INT) AS k, sum((p.yhat - s.mean) / s.scale * e.v[m.i]) AS score FROM pc_pool p
 JOIN pc_stat s ON p.series_id = s.series_id AND p.model = s.model JOIN pc_models m ON p.model = m.model JOIN pc_kept e
 ON p.series_id = e.series_id GROUP BY 1, 2, 3""", score=5)
def pca_components(spark, sf):
    """Scores of the kept axes on all dates, in sample and out."""
    pool = pca_pool(spark, sf)
    return C.project(pool, C.loadings(pool))


@query("pca_full")
def pca_full(spark, sf):
    """All axes up to 95% of the variance of a wider bank."""
    bank = N.sma_bank(supplier_panel(spark, sf), range(3, 9)).where("yhat IS NOT NULL")
    return C.loadings(staged(bank))


@query("project_on_stored_axes", """SELECT p.series_id, p.ts, k.k, sum((p.yhat - s.mean) / s.scale * k.weight) AS score FROM pc_pool p
 JOIN pc_stat s ON p.series_id = s.series_id AND p.model = s.model JOIN (VALUES (1, 'RW', 0.5::DOUBLE), (1, 'SMA(3)', 0.5::DOUBLE),
 (1, 'SMA(4)', 0.5::DOUBLE), (1, 'SMA(5)', 0.5::DOUBLE), (2, 'RW', 0.5::DOUBLE), (2, 'SMA(3)', 0.5::DOUBLE), (2, 'SMA(4)', -0.5::DOUBLE),
 (2, 'SMA(5)', -0.5::DOUBLE)) AS k(k, model, weight) ON p.model = k.model WHERE p.ts >= DATE '2000-01-01' GROUP BY 1, 2, 3""", score=6)
def project_on_stored_axes(spark, sf):
    """Axes written as a table by one run and read back by the next."""
    pool = pca_pool(spark, sf)
    sign = F.when((F.col("k") == 2) & F.col("model").isin("SMA(4)", "SMA(5)"), -0.5).otherwise(0.5)
    axes = C.pool_moments(pool).withColumn("k", F.explode(F.array(F.lit(1), F.lit(2)))).withColumn("weight", sign)
    path = write_table(axes, scratch_path(spark, "axes"))
    return C.project(P.period_filter(pool, OOS), read_table(spark, path))


@query("component_representatives", """WITH b AS (SELECT series_id, model FROM best_s), l AS (SELECT e.series_id, e.k, list_position(
 list_transform(e.v, lambda y: abs(y)), list_max(list_transform(e.v, lambda y: abs(y)))) AS i FROM pc_kept e),
 r AS (SELECT l.series_id, m.model, min(l.k) AS k FROM l JOIN pc_models m ON l.i = m.i GROUP BY 1, 2),
 u AS (SELECT coalesce(r.series_id, b.series_id) AS series_id, coalesce(r.model, b.model) AS m, r.k, b.model IS NOT NULL AS best
 FROM r FULL JOIN b ON r.series_id = b.series_id AND r.model = b.model)
 SELECT series_id, CAST(row_number() OVER (PARTITION BY series_id ORDER BY coalesce(k, 0)) AS INT) AS rank,
 m || CASE WHEN best THEN ' [BEST]' ELSE '' END AS model, CAST(k AS INT) AS component FROM u""")
def component_representatives(spark, sf):
    r = supplier_panel(spark, sf)
    pool = staged(N.simple_pool(r, PCA_SPANS))
    return C.representatives(C.loadings(pool), best_in(r))


@query("selection_report", """SELECT k.series_id, 4::BIGINT AS n_models, 4::BIGINT AS n_kept, count(*) AS n_components, sum(k.explained) AS variance,
 any_value(b.model) AS best_model, any_value(b.rmse) AS best_rmse FROM pc_kept k JOIN best_s b ON k.series_id = b.series_id GROUP BY 1""",
       variance=6, best_rmse=8)
def selection_report(spark, sf):
    r = supplier_panel(spark, sf)
    pool = staged(N.simple_pool(r, PCA_SPANS))
    return C.selection_report(pool, staged(C.loadings(pool)), best_in(r))


# --- ridge combination ---

fragment("rc_x", """SELECT r.series_id, r.ts, r.value AS y, a.yhat AS x1, b.yhat AS x2, c.yhat AS x3 FROM smr r JOIN pool_s a
 ON r.series_id = a.series_id AND r.ts = a.ts AND a.model = 'RW' JOIN pool_s b ON r.series_id = b.series_id AND r.ts = b.ts
 AND b.model = 'SMA(6)' JOIN pool_s c ON r.series_id = c.series_id AND r.ts = c.ts AND c.model = 'SMA(12)'""")
fragment("rc_train", "SELECT * FROM rc_x WHERE ts < DATE '1998-01-01'")
fragment("rc_fit", "SELECT * FROM rc_x WHERE ts < DATE '2000-01-01'")
PENALTIES = (0.1, 1.0, 10.0)
for _i, _p in enumerate(PENALTIES):
    solve_fragments(f"rca{_i}", "rc_train", "series_id", ["x1", "x2", "x3"], ridge=_p)
    solve_fragments(f"rcb{_i}", "rc_fit", "series_id", ["x1", "x2", "x3"], ridge=_p)
fragment("rc_a", " UNION ALL ".join(f"SELECT series_id, {i} AS pen, coef FROM rca{i}" for i in range(3)))
fragment("rc_b", " UNION ALL ".join(f"SELECT series_id, {i} AS pen, coef FROM rcb{i}" for i in range(3)))
_RCV = value_sql("c.coef", ["x.x1", "x.x2", "x.x3"])
fragment("rc_pick", f"""SELECT * FROM (SELECT x.series_id, c.pen, row_number() OVER (PARTITION BY x.series_id ORDER BY
 avg((x.y - ({_RCV})) ** 2), c.pen) AS rn FROM rc_x x JOIN rc_a c ON x.series_id = c.series_id WHERE x.ts >= DATE '1998-01-01'
 AND x.ts < DATE '2000-01-01' GROUP BY 1, 2) AS q WHERE rn = 1""")


@query("ridge_combination", f"""SELECT x.series_id, 'Ridge' AS model, x.ts, {_RCV} AS yhat FROM rc_x x JOIN rc_b c ON x.series_id = c.series_id
 JOIN rc_pick k ON c.series_id = k.series_id AND c.pen = k.pen WHERE x.ts >= DATE '2000-01-01'""", yhat=6)
def ridge_combination(spark, sf):
    r = supplier_panel(spark, sf)
    loss = E.losses(N.simple_pool(r), r)
    pick = lambda m: F.max(F.when(F.col("model") == m, F.col("yhat")))
    rows = loss.groupBy("series_id", "ts").agg(
        F.first("y").alias("y"), pick("RW").alias("x1"), pick("SMA(6)").alias("x2"), pick("SMA(12)").alias("x3"))
    return C.ridge_combination(staged(rows.where("x1 IS NOT NULL AND x2 IS NOT NULL AND x3 IS NOT NULL")), ["x1", "x2", "x3"], PENALTIES)


@query("net_conditions", "SELECT DISTINCT series_id, true AS optimal, true AS centred FROM smr")
def net_conditions(spark, sf):
    """Elastic net on ten fitted components of 57 models: the conditions of the optimum, from the rows themselves.

    The slope of the error in a column in use is that of its penalty; in a column left out it is not steeper.
    """
    r = supplier_panel(spark, sf)
    # 57 rows for one of the panel: made anew wherever they are read, in the task that holds their series, and never stored or shuffled.
    pool = M.bank(r, [N.random_walk, N.sma_bank, M.ema_bank])
    rows = staged(C.component_rows(pool, r, C.loadings(pool), 10))
    xs = [f"c{i}" for i in range(1, 11)]
    fitted = P.period_filter(rows, IN_SAMPLE).join(C.elastic_net(rows, xs), "series_id").withColumn("e", F.col("y") - linear_value("coef", xs))
    sums = fitted.groupBy("series_id").agg(
        F.avg("e").alias("e"), F.stddev_pop("y").alias("sy"), *[F.first(c).alias(c) for c in ("mix", "penalty", "coef")],
        F.array(*[F.struct(F.covar_pop(x, "e").alias("slope"), F.stddev_pop(x).alias("sx")) for x in xs]).alias("own"))

    def holds(s, i):
        used = F.col("coef")[i + 1]
        beta, scale = used * s["sx"] / F.col("sy"), F.when(s["sx"] > 1e-9, s["sx"]).otherwise(1.0)
        slope = s["slope"] / scale / F.col("sy") - F.col("penalty") * (1 - F.col("mix")) * beta
        limit = F.col("penalty") * F.col("mix")
        return F.when(used != 0, F.abs(slope - limit * F.signum(used)) < 1e-7).otherwise((F.abs(slope) <= limit + 1e-7) | (s["sx"] <= 1e-9))

    return sums.select("series_id", F.forall(F.transform("own", holds), lambda x: x).alias("optimal"), (F.abs("e") < 1e-9 * F.col("sy")).alias("centred"))


# --- superior ability and confidence set ---

REPS, FULL_REPS, BLOCK = 200, 10000, 15


def _bootstrap_fragments(p: str, loss: str, replicates: int) -> None:
    """``{p}_m``: mean losses; ``{p}_c``: resampled means per replicate."""
    fragment(f"{p}_l", f"""SELECT *, row_number() OVER (PARTITION BY series_id, model ORDER BY ts) - 1 AS pos, count(*) OVER (PARTITION BY
 series_id, model) AS n, l - avg(l) OVER (PARTITION BY series_id, model) AS c FROM (SELECT series_id, model, ts, abs(e) AS l FROM {loss}) AS q""")
    fragment(f"{p}_m", f"SELECT series_id, model, avg(l) AS lbar FROM {p}_l GROUP BY 1, 2")
    fragment(f"{p}_s", f"""SELECT series_id, n, b, j, ((((b * {B.REPLICATE_STEP} + j * {B.BLOCK_STEP} + 42) % {B.MODULUS} * {B.MULTIPLIER} + {B.INCREMENT})
 % {B.MODULUS} * {B.MULTIPLIER} + {B.INCREMENT}) % {B.MODULUS}) // {B.DROP} % n AS start FROM (SELECT DISTINCT series_id, n FROM {p}_l) AS s,
 generate_series(0, {replicates - 1}) AS b(b), generate_series(0, 20) AS j(j) WHERE j < ceil(n / {BLOCK}.0)""")
    fragment(f"{p}_c", f"""SELECT s.series_id, s.b, l.model, sum(l.c) / any_value(s.n) AS c FROM (SELECT *, unnest(generate_series(0,
 least({BLOCK}, n - j * {BLOCK}) - 1)) AS k FROM {p}_s) AS s JOIN {p}_l l ON s.series_id = l.series_id AND l.pos = (s.start + s.k) % s.n
 GROUP BY 1, 2, 3""")
    fragment(f"{p}_spa", f"""SELECT o.series_id, o.model, o.statistic, avg(CASE WHEN w.m >= o.statistic THEN 1.0::DOUBLE ELSE 0.0 END) AS p FROM
 (SELECT a.series_id, a.model, max(a.lbar - b.lbar) AS statistic FROM {p}_m a JOIN {p}_m b ON a.series_id = b.series_id AND a.model <> b.model
 GROUP BY 1, 2) AS o JOIN (SELECT a.series_id, a.model, a.b, max(a.c - b.c) AS m FROM {p}_c a JOIN {p}_c b ON a.series_id = b.series_id
 AND a.b = b.b AND a.model <> b.model GROUP BY 1, 2, 3) AS w ON o.series_id = w.series_id AND o.model = w.model GROUP BY 1, 2, 3""")
    # One round per model but the last: survivors, their statistics, the one to drop.
    fragment(f"{p}_s1", f"SELECT series_id, model FROM {p}_m")
    for k in (1, 2, 3):
        fragment(f"{p}_b{k}", f"""SELECT c.series_id, c.b, c.model, c.c - avg(c.c) OVER (PARTITION BY c.series_id, c.b) AS x FROM {p}_c c
 JOIN {p}_s{k} s ON c.series_id = s.series_id AND c.model = s.model""")
        fragment(f"{p}_t{k}", f"""SELECT m.series_id, m.model, (m.lbar - avg(m.lbar) OVER (PARTITION BY m.series_id)) / sqrt(v.v) AS t, sqrt(v.v) AS sd
 FROM {p}_m m JOIN (SELECT series_id, model, greatest(var_pop(x), 1e-10) AS v FROM {p}_b{k} GROUP BY 1, 2) AS v
 ON m.series_id = v.series_id AND m.model = v.model""")
        fragment(f"{p}_w{k}", f"""SELECT w.series_id, w.worst, avg(CASE WHEN d.m >= w.t THEN 1.0::DOUBLE ELSE 0.0 END) AS p FROM (SELECT series_id,
 arg_max(model, t) AS worst, max(t) AS t FROM {p}_t{k} GROUP BY 1) AS w JOIN (SELECT b.series_id, b.b, max(b.x / t.sd) AS m FROM {p}_b{k} b
 JOIN {p}_t{k} t ON b.series_id = t.series_id AND b.model = t.model GROUP BY 1, 2) AS d ON w.series_id = d.series_id GROUP BY 1, 2""")
        fragment(f"{p}_e{k}", f"SELECT series_id, worst AS model, p FROM {p}_w{k} WHERE p < 0.05")
        fragment(f"{p}_s{k + 1}", f"""SELECT s.series_id, s.model FROM {p}_s{k} s JOIN {p}_e{k} e ON s.series_id = e.series_id
 WHERE s.model <> e.model""")
    fragment(f"{p}_mcs", f"""SELECT m.series_id, m.model, coalesce(e.p, 1.0) AS p, e.p IS NULL AS in_set FROM {p}_m m LEFT JOIN (SELECT * FROM {p}_e1
 UNION ALL SELECT * FROM {p}_e2 UNION ALL SELECT * FROM {p}_e3) AS e ON m.series_id = e.series_id AND m.model = e.model""")


_bootstrap_fragments("bs", "loss_s", REPS)
_bootstrap_fragments("bo", "loss_o", FULL_REPS)


@query("superior_ability", "SELECT * FROM bs_spa", statistic=8, p=6)
def superior_ability(spark, sf):
    return B.superior_ability(supplier_losses(spark, sf), MODELS, replicates=REPS, replicates_per_task=50)


@query("confidence_set", "SELECT * FROM bs_mcs", p=6)
def confidence_set(spark, sf):
    return B.confidence_set(supplier_losses(spark, sf), MODELS, replicates=REPS)


_LOSS_TESTS = "SELECT series_id, statistic, " + ", ".join(f"max(CASE WHEN model = '{m}' THEN p END) AS \"{m}\"" for m in MODELS)


@query("loss_test_table", _LOSS_TESTS + """ FROM (SELECT series_id, model, 's-SPA' AS statistic, p FROM bo_spa UNION ALL
 SELECT series_id, model, 'MCS', p FROM bo_mcs) AS q GROUP BY 1, 2""")
def loss_test_table(spark, sf):
    """Both loss tests with the full number of replicates."""
    r = order_panel(spark, sf)
    loss = E.losses(P.period_filter(N.simple_pool(r), OOS), r)
    return B.loss_test_table(staged(loss), MODELS, replicates=FULL_REPS)


@query("combined_forecasts")
def combined_forecasts(spark, sf):
    """Pool, components, ridge and averaging end to end, scored out of sample."""
    r = supplier_panel(spark, sf)
    pool = M.bank(r, [N.random_walk, lambda p: N.sma_bank(p, range(3, 13)), lambda p: M.ema_bank(p, range(3, 13))])
    pool = staged(pool)
    rows = staged(C.component_rows(pool, r, C.loadings(pool), 6))
    xs = [f"c{i}" for i in range(1, 7)]
    combined = X.clip_forecasts(M.bank(r, [N.random_walk, lambda _: C.ridge_combination(rows, xs), lambda _: C.dynamic_average(rows, xs)]), r)
    return E.error_metrics(E.losses(P.period_filter(combined, OOS), r))
