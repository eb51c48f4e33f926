"""Queries that score forecasts."""

from __future__ import annotations

from pyspark.sql import functions as F

from panelweave.config import OOS, TEST
from panelweave.operators import evaluate as E
from panelweave.operators import panel as P
from panelweave.operators import windows as N
from panelweave.plans import fragments as Q
from panelweave.plans.panels import order_panel, supplier_panel
from panelweave.plans.registry import fragment, query
from panelweave.sources.stores import staged

MODELS = ["RW", "SMA(3)", "SMA(6)", "SMA(12)"]
REFERENCE = "SMA(12)"

fragment("err_s", """SELECT series_id, model, count(*) AS n, avg(abs(e)) AS mae, sqrt(avg(e * e)) AS rmse,
 avg(abs(e / nullif(y, 0))) * 100 AS mape, avg(CASE WHEN abs(y) > 1e-8 THEN abs(e / y) END) * 100 AS mape_masked,
 sqrt(avg(e * e)) / (sqrt(avg(yhat * yhat)) + sqrt(avg(y * y))) AS theil_u1 FROM loss_s GROUP BY 1, 2""")
fragment("metrics_s", """SELECT e.*, e.rmse / nullif(b.rmse, 0) AS theil_ratio FROM err_s e JOIN err_s b
 ON e.series_id = b.series_id AND b.model = 'RW'""")


def _pt_sql(variance: str, agreement: str, minimum: int) -> str:
    hit = "sign(y) = sign(yhat)" if agreement == "sign" else "(y > 0) = (yhat > 0)"
    op = "-" if variance == "minus" else "+"
    return f"""SELECT series_id, model, n, hit_rate, CASE WHEN v > 1e-15 AND n >= {minimum} THEN (hit_rate - ps) / sqrt(v) END AS pt
 FROM (SELECT *, ps * (1 - ps) / n {op} ((2 * py - 1) ** 2 * pf * (1 - pf) + (2 * pf - 1) ** 2 * py * (1 - py)) / n AS v
 FROM (SELECT *, py * pf + (1 - py) * (1 - pf) AS ps FROM (SELECT series_id, model, count(*) AS n,
 avg(CASE WHEN {hit} THEN 1.0::DOUBLE ELSE 0.0 END) AS hit_rate, avg(CASE WHEN y > 0 THEN 1.0::DOUBLE ELSE 0.0 END) AS py,
 avg(CASE WHEN yhat > 0 THEN 1.0::DOUBLE ELSE 0.0 END) AS pf FROM loss_s GROUP BY 1, 2) AS a) AS b) AS c"""


def _dm_sql(loss: str, sign: int, floor: str | None) -> str:
    v = "var / n" if floor is None else f"greatest(var / n, {floor})"
    return f"""SELECT series_id, model, n, mean_diff, CASE WHEN n >= 2 AND {v} > 0 THEN mean_diff / sqrt({v}) END AS dm FROM
 (SELECT a.series_id, a.model, count(*) AS n, avg({sign} * ({loss.format(e='a.e')} - {loss.format(e='b.e')})) AS mean_diff,
 var_samp({loss.format(e='a.e')} - {loss.format(e='b.e')}) AS var FROM loss_s a JOIN loss_s b ON a.series_id = b.series_id
 AND a.ts = b.ts AND b.model = '{REFERENCE}' AND a.model <> '{REFERENCE}' GROUP BY 1, 2) AS q"""


fragment("pt_s", _pt_sql("minus", "sign", 1))
fragment("dm_s", _dm_sql("{e} * {e}", 1, None))
fragment("bundle_s", f"""SELECT m.*, p.pt, {Q.p_value_sql('p.pt')} AS pt_p, d.dm, {Q.p_value_sql('d.dm')} AS dm_p
 FROM metrics_s m JOIN pt_s p ON m.series_id = p.series_id AND m.model = p.model
 LEFT JOIN dm_s d ON m.series_id = d.series_id AND m.model = d.model""")


def losses_in(r, period=OOS):
    return E.losses(P.period_filter(N.simple_pool(r), period), P.period_filter(r, period))


def best_in(r):
    return E.best_model(losses_in(r, TEST), P.period_filter(r, TEST))


def supplier_losses(spark, sf):
    return losses_in(supplier_panel(spark, sf))


@query("loss_table", "SELECT * FROM loss_s", y=8, yhat=8, e=8)
def loss_table(spark, sf):
    return supplier_losses(spark, sf)


@query("forecast_errors", "SELECT * FROM metrics_s", mae=8, rmse=8, mape=4, mape_masked=4, theil_u1=8, theil_ratio=8)
def forecast_errors(spark, sf):
    return E.error_metrics(supplier_losses(spark, sf))


@query("direction_test", f"SELECT *, {Q.p_value_sql('pt')} AS pt_p FROM pt_s", hit_rate=8, pt=6, pt_p=6)
def direction_test(spark, sf):
    return E.direction_test(supplier_losses(spark, sf))


@query("direction_test_plus", f"SELECT *, {Q.p_value_sql('pt')} AS pt_p FROM ({_pt_sql('plus', 'positive', 10)}) AS q",
       hit_rate=8, pt=6, pt_p=6)
def direction_test_plus(spark, sf):
    return E.direction_test(supplier_losses(spark, sf), "plus", "positive", 10)


@query("equal_accuracy_test", f"SELECT *, {Q.p_value_sql('dm')} AS dm_p FROM dm_s", mean_diff=8, dm=6, dm_p=6)
def equal_accuracy_test(spark, sf):
    return E.accuracy_test(supplier_losses(spark, sf), REFERENCE)


@query("equal_accuracy_test_abs", f"SELECT *, {Q.p_value_sql('dm')} AS dm_p FROM ({_dm_sql('abs({e})', -1, '1e-10')}) AS q",
       mean_diff=8, dm=6, dm_p=6)
def equal_accuracy_test_abs(spark, sf):
    return E.accuracy_test(supplier_losses(spark, sf), REFERENCE, "mae", 1e-10, True)


@query("metric_bundle", "SELECT * FROM bundle_s", mae=8, rmse=8, mape=4, mape_masked=4, theil_u1=8, theil_ratio=8,
       pt=6, pt_p=6, dm=6, dm_p=6)
def metric_bundle(spark, sf):
    return E.metric_bundle(staged(supplier_losses(spark, sf)), "RW", REFERENCE)


def _pivot_sql(rows: str, value: str) -> str:
    cols = ", ".join(f"max(CASE WHEN model = '{m}' THEN {value} END) AS \"{m}\"" for m in MODELS)
    return f"SELECT series_id, statistic, {cols} FROM ({rows}) AS q GROUP BY 1, 2"


STATS = ("mae", "mape", "rmse", "theil_u1", "theil_ratio")


@query("forecast_table", "SELECT series_id, statistic, " + ", ".join(f'round("{m}", 4) + 0.0::DOUBLE AS "{m}"' for m in MODELS)
       + " FROM (" + _pivot_sql(" UNION ALL ".join(
           f"SELECT series_id, model, '{s}' AS statistic, {s} AS v FROM metrics_s" for s in STATS), "v") + ") AS t")
def forecast_table(spark, sf):
    out = E.forecast_table(E.error_metrics(supplier_losses(spark, sf)), MODELS, STATS)
    return out.withColumns({m: F.round(F.col(f"`{m}`"), 4) for m in MODELS})


def _stars_sql(p: str) -> str:
    return f"CASE WHEN {p} < .01 THEN '***' WHEN {p} < .05 THEN '**' WHEN {p} < .1 THEN '*' ELSE '' END"


@query("test_table", _pivot_sql(f"""SELECT series_id, model, 'PT' AS statistic, CASE WHEN pt IS NULL THEN '' ELSE
 printf('(%.2f)', pt) || {_stars_sql('pt_p')} END AS v FROM bundle_s UNION ALL SELECT series_id, model, 'DM',
 CASE WHEN model = '{REFERENCE}' THEN '-' WHEN dm IS NULL THEN '' ELSE printf('%.2f', dm) || {_stars_sql('dm_p')} END
 FROM bundle_s""", "v"))
def test_table(spark, sf):
    return E.test_table(E.metric_bundle(staged(supplier_losses(spark, sf)), "RW", REFERENCE), MODELS, REFERENCE)


fragment("best_s", f"""WITH n AS (SELECT series_id, count(*) AS nd FROM smr f WHERE {Q.IS_TEST} GROUP BY 1),
 m AS (SELECT series_id, model, count(*) AS c, sqrt(avg(e * e)) AS rmse FROM loss_s_test GROUP BY 1, 2)
 SELECT series_id, model, rmse FROM (SELECT m.series_id, m.model, m.rmse, row_number() OVER (PARTITION BY m.series_id
 ORDER BY m.rmse, m.model) AS rn FROM m JOIN n ON m.series_id = n.series_id WHERE m.c >= 0.9 * n.nd) AS q WHERE rn = 1""")


@query("best_model", "SELECT * FROM best_s", rmse=8)
def best_model(spark, sf):
    return best_in(supplier_panel(spark, sf))


@query("best_forecast_lookup", f"""SELECT r.series_id, 'Best' AS model, r.ts, coalesce(p.yhat, 0.0) AS yhat FROM smr r
 LEFT JOIN (SELECT p.* FROM pool_s p JOIN best_s b ON p.series_id = b.series_id AND p.model = b.model) AS p
 ON r.series_id = p.series_id AND r.ts = p.ts WHERE r.ts >= DATE '2000-01-01'""", yhat=8)
def best_forecast_lookup(spark, sf):
    r = supplier_panel(spark, sf)
    return E.best_forecast(N.simple_pool(r), best_in(r), P.period_filter(r, OOS))


@query("best_parameter", f"""SELECT series_id, span, rmse FROM (SELECT series_id, span, rmse, row_number() OVER (PARTITION BY
 series_id ORDER BY rmse, span) AS rn FROM (SELECT f.series_id, f.span, sqrt(avg((r.value - f.yhat) ** 2)) AS rmse FROM ("""
       + " UNION ALL ".join(f"SELECT series_id, {q}::INT AS span, ts, {Q.sma_sql(q)} AS yhat FROM smr" for q in range(3, 13))
       + f""") AS f JOIN smr r ON f.series_id = r.series_id AND f.ts = r.ts WHERE {Q.IS_TEST} AND f.yhat IS NOT NULL GROUP BY 1, 2)
 AS g) AS h WHERE rn = 1""", rmse=8)
def best_parameter(spark, sf):
    r = supplier_panel(spark, sf)
    spans = P.period_filter(N.sma_bank(r, range(3, 13)), TEST)
    loss = E.losses(spans, r).withColumn("span", F.regexp_extract("model", r"(\d+)", 1).cast("int"))
    return E.best_parameter(loss, ["span"])


@query("evaluation_run", f"""WITH a AS (SELECT series_id, model, ts, yhat FROM pool_o f WHERE {Q.IS_OOS}),
 l AS (SELECT a.series_id, a.model, r.value - a.yhat AS e FROM a JOIN omr r ON a.series_id = r.series_id AND a.ts = r.ts)
 SELECT coalesce(series_id, 'ALL') AS series_id, model, avg(abs(e)) AS mae, sqrt(avg(e * e)) AS rmse, count(*) AS n
 FROM l GROUP BY GROUPING SETS ((series_id, model), (model))""", mae=8, rmse=8)
def evaluation_run(spark, sf):
    r = order_panel(spark, sf)
    loss = E.losses(P.period_filter(N.simple_pool(r), OOS), r)
    e, s, m = F.col("e"), F.col("series_id"), F.col("model")
    return loss.groupingSets([[s, m], [m]], s, m).agg(
        F.avg(F.abs(e)).alias("mae"), F.sqrt(F.avg(e * e)).alias("rmse"), F.count("*").alias("n"),
    ).withColumn("series_id", F.coalesce("series_id", F.lit("ALL")))
