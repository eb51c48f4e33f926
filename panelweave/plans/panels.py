"""Queries over cleaned panels: projections, filters, joins, windows, sets."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from panelweave.config import ASSETS, OOS, SPLITS, TEST, TOTAL, TRAIN, WINDOW
from panelweave.functions import scalars as S
from panelweave.operators import describe as D
from panelweave.operators import features as X
from panelweave.operators import panel as P
from panelweave.operators import windows as N
from panelweave.plans import fragments as Q
from panelweave.plans.registry import query
from panelweave.sources import tables as T
from panelweave.sources.stores import staged


def order_returns(spark, sf):
    return P.log_returns(T.orders_monthly(spark, sf))


def supplier_returns(spark, sf):
    return P.log_returns(T.supplier_monthly(spark, sf))


def order_panel(spark, sf):
    """The same returns computed once, for queries that read them several times."""
    return staged(order_returns(spark, sf))


#: Rows of the raw table for each task of a shuffle.
RAW_ROWS = 200_000


def supplier_panel(spark, sf):
    """The supplier returns computed once.

    There are as many suppliers as the table makes of them: the session shuffles to at least as many tasks as keep what
    one of them holds, here and in what follows, from growing with the table. Adaptive execution joins small ones again.
    """
    tasks = -(-T.table(spark, sf, "lineitem").count() // RAW_ROWS)
    if tasks > int(spark.conf.get("spark.sql.shuffle.partitions")):
        spark.conf.set("spark.sql.shuffle.partitions", str(tasks))
    return staged(supplier_returns(spark, sf))


# --- projections and filters -------------------------------------------------

@query("period_filtered_panel", """SELECT series_id, ts, value FROM sm
 WHERE ts >= DATE '1998-01-01' AND ts < DATE '2000-01-01'""", value=4)
def period_filtered_panel(spark, sf):
    return P.period_filter(T.supplier_monthly(spark, sf), TEST)


@query("log_returns", "SELECT series_id, ts, value FROM smr", value=8)
def log_returns(spark, sf):
    return supplier_returns(spark, sf)


@query("percent_to_log", """SELECT series_id, ts, ln(1 + pct / 100) AS value FROM
 (SELECT series_id, ts, 100 * (exp(value) - 1) AS pct FROM smr) AS q""", value=8)
def percent_to_log(spark, sf):
    pct = supplier_returns(spark, sf).withColumn("pct", 100 * S.log_to_simple("value"))
    return pct.select("series_id", "ts", S.percent_to_log("pct").alias("value"))


@query("simple_returns", "SELECT series_id, ts, exp(value) - 1 AS value FROM smr", value=8)
def simple_returns(spark, sf):
    return supplier_returns(spark, sf).withColumn("value", S.log_to_simple("value"))


@query("split_problems", """WITH s AS (SELECT * FROM (VALUES ('TRAIN', DATE '1995-01-01', DATE '1998-01-01'),
 ('TEST', DATE '1998-01-01', DATE '1999-12-01'), ('OOS', DATE '2000-01-01', (SELECT max(ts) FROM sm)))
 AS v(name, a, b)), t AS (SELECT min(ts) AS a, max(ts) AS b FROM sm),
 g AS (SELECT name, a, b, lag(b) OVER (ORDER BY a) AS prev FROM s)
 SELECT name, 'outside' AS problem FROM g, t WHERE g.a < t.a OR g.b > t.b
 UNION ALL SELECT name, 'overlap' FROM g WHERE a < prev UNION ALL SELECT name, 'gap' FROM g WHERE a > prev""")
def split_problems(spark, sf):
    # The panel's own bounds as TOTAL, and splits with a one-month hole.
    bounds = T.supplier_monthly(spark, sf).agg(F.min("ts").alias("a"), F.max("ts").alias("b"))
    row = lambda name, a, b: F.struct(F.lit(name).alias("name"), a.alias("start"), b.alias("end"))
    day = lambda text: F.lit(text).cast("date")
    splits = bounds.select(F.inline(F.array(
        row("TOTAL", F.col("a"), F.col("b")), row("TRAIN", day("1995-01-01"), day("1998-01-01")),
        row("TEST", day("1998-01-01"), day("1999-12-01")), row("OOS", day("2000-01-01"), F.col("b")))))
    return P.split_problems(splits)


@query("split_counts", f"""WITH d AS (SELECT DISTINCT ts FROM smr) SELECT dataset, min(ts) AS start_date,
 max(ts) AS end_date, count(*) AS periods FROM (SELECT 'TOTAL' AS dataset, ts FROM d UNION ALL
 SELECT {Q.split_sql()} AS dataset, ts FROM d) AS q GROUP BY dataset""")
def split_counts(spark, sf):
    return P.split_counts(supplier_returns(spark, sf), (TOTAL, *SPLITS))


@query("split_labels", f"SELECT series_id, ts, {Q.split_sql()} AS split FROM smr")
def split_labels(spark, sf):
    return supplier_returns(spark, sf).select("series_id", "ts", P.split_of().alias("split"))


@query("month_end_alignment", """SELECT l_returnflag AS series_id, last_day(l_shipdate) AS ts,
 sum(l_extendedprice) AS value FROM lineitem GROUP BY 1, 2""", value=2)
def month_end_alignment(spark, sf):
    starts = T.lineitem_daily(spark, sf).withColumn("ts", F.trunc("ts", "month").cast("date"))
    return P.month_end(starts).groupBy("series_id", "ts").agg(F.sum("value").alias("value"))


@query("p_value_stars", f"""WITH t AS (SELECT series_id, avg(value) / (stddev_samp(value) / sqrt(count(*))) AS stat
 FROM smr GROUP BY 1), p AS (SELECT series_id, stat, {Q.p_value_sql('stat')} AS p FROM t)
 SELECT series_id, stat, p, CASE WHEN p < .01 THEN '***' WHEN p < .05 THEN '**' WHEN p < .1 THEN '*' ELSE '' END AS stars
 FROM p""", stat=8, p=8)
def p_value_stars(spark, sf):
    stat = supplier_returns(spark, sf).groupBy("series_id").agg(
        (F.avg("value") / (F.stddev_samp("value") / F.sqrt(F.count("*")))).alias("stat"))
    return stat.withColumn("p", S.two_sided_p("stat")).withColumn("stars", S.stars("p"))


@query("metric_text", """SELECT series_id, ts, coalesce(printf('%.3f', round(r, 3)), '-') AS text FROM
 (SELECT series_id, ts, value / nullif(lag(value, 3) OVER (PARTITION BY series_id ORDER BY ts), 0) AS r FROM sm) AS q""")
def metric_text(spark, sf):
    r = F.col("value") / F.lag("value", 3).over(N.by_series())
    return T.supplier_monthly(spark, sf).select("series_id", "ts", S.number_text(r).alias("text"))


@query("clipped_forecasts", """WITH w AS (SELECT p.series_id, p.model, p.ts, p.yhat, s.sd FROM pool_s p JOIN
 (SELECT series_id, ts, stddev_pop(value) OVER (PARTITION BY series_id ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING
 AND 1 PRECEDING) AS sd FROM smr) AS s ON p.series_id = s.series_id AND p.ts = s.ts)
 SELECT series_id, model, ts, greatest(least(yhat, sd), -sd) AS yhat FROM w WHERE sd > 0""", yhat=8)
def clipped_forecasts(spark, sf):
    r = supplier_panel(spark, sf)
    return X.clip_forecasts(N.simple_pool(r), r, multiple=1.0)


@query("negative_shocks", "SELECT series_id, ts, least(value, 0.0) AS value FROM smr", value=8)
def negative_shocks(spark, sf):
    return supplier_returns(spark, sf).withColumn("value", S.negative_part("value"))


@query("fisher_z", """WITH c AS (SELECT a.series_id AS s1, b.series_id AS s2, corr(a.value, b.value) AS rho FROM omc a
 JOIN omc b ON a.ts = b.ts AND a.series_id < b.series_id GROUP BY 1, 2)
 SELECT s1, s2, rho, atanh(rho) AS z, tanh(greatest(least(atanh(rho) * 20, 3.0), -3.0)) AS back FROM c""",
       rho=8, z=8, back=8)
def fisher_z(spark, sf):
    rho = D.pearson_matrix(order_returns(spark, sf), ASSETS)
    return rho.withColumn("z", S.fisher_z("rho")).withColumn("back", S.inverse_fisher_z(F.col("z") * 20))


@query("pool_impute", """WITH g AS (SELECT m.series_id, m.model, r.ts, p.yhat FROM (SELECT DISTINCT series_id, model
 FROM pool_s) AS m JOIN smr r ON m.series_id = r.series_id LEFT JOIN pool_s p ON p.series_id = r.series_id
 AND p.ts = r.ts AND p.model = m.model), v AS (SELECT series_id, model FROM g GROUP BY 1, 2
 HAVING count(yhat) FILTER (WHERE ts < DATE '2000-01-01') > 0 AND count(yhat) FILTER (WHERE ts < DATE '2000-01-01') >= 0.9 *
 count(*) FILTER (WHERE ts < DATE '2000-01-01')) SELECT g.series_id, g.model, g.ts, coalesce(g.yhat, avg(g.yhat) FILTER
 (WHERE g.ts < DATE '2000-01-01') OVER (PARTITION BY g.series_id, g.model)) AS yhat FROM g JOIN v
 ON g.series_id = v.series_id AND g.model = v.model""", yhat=8)
def pool_impute(spark, sf):
    r = supplier_panel(spark, sf)
    return X.impute_pool(X.spread_pool(N.simple_pool(r), r, ["RW", "SMA(3)", "SMA(6)", "SMA(12)"]))


@query("pool_reindex", """SELECT r.series_id, m.model, r.ts, coalesce(p.yhat, 0.0) AS yhat FROM smr r JOIN
 (VALUES ('RW'), ('SMA(12)'), ('STAR')) AS m(model) ON true LEFT JOIN pool_s p ON p.series_id = r.series_id
 AND p.ts = r.ts AND p.model = m.model""", yhat=8)
def pool_reindex(spark, sf):
    r = supplier_panel(spark, sf)
    return X.spread_pool(N.simple_pool(r), r, ["RW", "SMA(12)", "STAR"]).fillna(0.0, ["yhat"])


@query("standardised_pool", """SELECT p.series_id, p.model, p.ts, (p.yhat - t.m) / t.s AS z FROM pool_s p JOIN
 (SELECT series_id, model, avg(yhat) AS m, stddev_pop(yhat) AS s FROM pool_s WHERE ts < DATE '1998-01-01' GROUP BY 1, 2)
 AS t ON p.series_id = t.series_id AND p.model = t.model WHERE t.s > 0""", z=6)
def standardised_pool(spark, sf):
    return X.standardise(N.simple_pool(supplier_returns(spark, sf)), TRAIN)


@query("cross_product_features", """WITH l AS (SELECT series_id, ts, lag(value, 1) OVER w AS x1, lag(value, 2) OVER w AS x2,
 lag(value, 3) OVER w AS x3 FROM smr WINDOW w AS (PARTITION BY series_id ORDER BY ts))
 SELECT series_id, ts, x1, x2, x3, x1*x1 AS x1_x1, x1*x2 AS x1_x2, x1*x3 AS x1_x3, x2*x2 AS x2_x2, x2*x3 AS x2_x3,
 x3*x3 AS x3_x3 FROM l WHERE x3 IS NOT NULL""", x1=8, x2=8, x3=8, x1_x1=8, x1_x2=8, x1_x3=8, x2_x2=8, x2_x3=8, x3_x3=8)
def cross_product_features(spark, sf):
    lags = N.lag_matrix(supplier_returns(spark, sf), 3)
    return X.cross_products(lags, ["x1", "x2", "x3"]).drop("y")


@query("normal_log_density", f"""SELECT r.series_id, r.ts, -0.5 * (ln(2 * pi() * greatest(s.sigma * s.sigma, 1e-10))
 + r.value * r.value / greatest(s.sigma * s.sigma, 1e-10)) AS ll FROM smr r JOIN (SELECT series_id, ts,
 CASE WHEN count(value) OVER {Q.past_sql(WINDOW)} >= 2 THEN stddev_samp(value) OVER {Q.past_sql(WINDOW)} END AS sigma
 FROM smr) AS s ON r.series_id = s.series_id AND r.ts = s.ts WHERE s.sigma IS NOT NULL""", ll=6)
def normal_log_density(spark, sf):
    r = supplier_panel(spark, sf)
    vol = N.rolling_std(r, WINDOW).where(F.col("sigma").isNotNull())
    ll = S.normal_log_density(F.col("value"), F.lit(0.0), F.col("sigma") * F.col("sigma"))
    return r.join(vol, ["series_id", "ts"]).select("series_id", "ts", ll.alias("ll"))


RBF_CENTRES = ((-0.5, 0.5), (0.0, 0.0), (0.5, -0.5))


@query("radial_features", "WITH l AS (SELECT series_id, ts, lag(value, 1) OVER w AS x1, lag(value, 2) OVER w AS x2 FROM smr "
       "WINDOW w AS (PARTITION BY series_id ORDER BY ts)) SELECT series_id, ts, "
       + ", ".join(f"exp(-((x1 - ({a})) ** 2 + (x2 - ({b})) ** 2) / 2) AS phi{i + 1}" for i, (a, b) in enumerate(RBF_CENTRES))
       + " FROM l WHERE x2 IS NOT NULL", phi1=8, phi2=8, phi3=8)
def radial_features(spark, sf):
    lags = N.lag_matrix(supplier_returns(spark, sf), 2)
    return X.radial(lags, ["x1", "x2"], RBF_CENTRES, 1.0).select("series_id", "ts", "phi1", "phi2", "phi3")


def _skt_sql(z: str, nu: float, lam: float) -> str:
    import math
    a, b, c = S.hansen_constants(nu, lam)
    s = f"({b!r}::DOUBLE * {z} + ({a!r}::DOUBLE))"
    return (f"({math.log(b * c)!r}::DOUBLE - {(nu + 1) / 2!r}::DOUBLE * ln(1 + ({s} / (CASE WHEN {s} < 0 THEN {1 - lam!r} "
            f"ELSE {1 + lam!r} END)) ** 2 / {nu - 2!r}::DOUBLE))")


@query("skewed_t_density", f"""SELECT series_id, ts, exp({_skt_sql('value', 6.0, -0.2)}) AS density FROM smr""", density=8)
def skewed_t_density(spark, sf):
    return supplier_returns(spark, sf).select(
        "series_id", "ts", F.exp(S.skewed_t_log_density("value", 6.0, -0.2)).alias("density"))


# --- joins and sets ------------------------------------------------------------

@query("momentum_join", """SELECT o.series_id, o.ts, o.value, m.value AS momentum FROM omr o JOIN
 (SELECT ts, ln(value) - ln(lag(value) OVER (ORDER BY ts)) AS value FROM (SELECT last_day(l_shipdate) AS ts,
 sum(l_quantity) AS value FROM lineitem GROUP BY 1) AS q) AS m ON o.ts = m.ts WHERE m.value IS NOT NULL""",
       value=8, momentum=8)
def momentum_join(spark, sf):
    extra = (
        T.table(spark, sf, "lineitem").groupBy(F.last_day("l_shipdate").alias("ts"))
        .agg(F.sum("l_quantity").alias("value")).withColumn("series_id", F.lit("MOM"))
    )
    momentum = P.log_returns(extra).select("ts", F.col("value").alias("momentum"))
    return order_returns(spark, sf).join(momentum, "ts").select("series_id", "ts", "value", "momentum")


@query("calendar_fill", """WITH b AS (SELECT series_id, min(ts) AS a, max(ts) AS b FROM sm GROUP BY 1),
 c AS (SELECT series_id, last_day(unnest(generate_series(date_trunc('month', a), date_trunc('month', b),
 INTERVAL 1 MONTH))) AS ts FROM b) SELECT c.series_id, c.ts, s.value FROM c LEFT JOIN sm s
 ON c.series_id = s.series_id AND c.ts = s.ts""", value=2)
def calendar_fill(spark, sf):
    return P.on_calendar(T.supplier_monthly(spark, sf))


@query("calendar_reindex", """WITH c AS (SELECT last_day(unnest(generate_series(date_trunc('month', min(ts)),
 date_trunc('month', max(ts)), INTERVAL 1 MONTH))) AS ts FROM sm), f AS (SELECT ts, avg(yhat) AS yhat FROM pool_o
 GROUP BY 1) SELECT c.ts, f.yhat FROM c LEFT JOIN f ON c.ts = f.ts""", yhat=8)
def calendar_reindex(spark, sf):
    """The mean forecast of each date on the longer calendar of the supplier panel."""
    mean = N.simple_pool(order_returns(spark, sf)).groupBy("ts").agg(F.avg("yhat").alias("yhat"))
    return P.reindex(mean, P.calendar(T.supplier_monthly(spark, sf)))


@query("common_dates", """SELECT ts FROM sm INTERSECT SELECT ts FROM om""")
def common_dates(spark, sf):
    return P.common_dates(T.supplier_monthly(spark, sf), T.orders_monthly(spark, sf))


@query("complete_dates", """SELECT s.series_id, s.ts, s.value FROM sm s WHERE s.ts IN (SELECT ts FROM sm GROUP BY ts
 HAVING count(DISTINCT series_id) = (SELECT count(DISTINCT series_id) FROM sm))""", value=2)
def complete_dates(spark, sf):
    return P.complete_dates(staged(T.supplier_monthly(spark, sf)))


@query("risk_free_excess", """SELECT o.series_id, o.ts, o.value, coalesce(r.rf, 0.0) AS rf, o.value - coalesce(r.rf, 0.0) AS
 excess, ln(1 + coalesce(r.rf, 0.0)) AS rf_log FROM oms o LEFT JOIN rf_rate AS r
 ON o.ts = r.ts""", value=8, rf=8, excess=8, rf_log=8)
def risk_free_excess(spark, sf):
    # Months without a rate count as zero.
    rf = T.discount_rate_monthly(spark, sf)
    simple = order_returns(spark, sf).withColumn("value", S.log_to_simple("value"))
    return (
        simple.join(rf, "ts", "left").withColumn("rf", F.coalesce("rf", F.lit(0.0)))
        .select("series_id", "ts", "value", "rf", (F.col("value") - F.col("rf")).alias("excess"), S.simple_to_log("rf").alias("rf_log"))
    )


@query("stacked_pools", """SELECT series_id, model, ts, yhat FROM pool_o UNION ALL
 SELECT series_id, 'STD' AS model, ts, sigma AS yhat FROM vol_std WHERE sigma IS NOT NULL""", yhat=8)
def stacked_pools(spark, sf):
    r = order_panel(spark, sf)
    std = N.rolling_std(r, WINDOW).where(F.col("sigma").isNotNull())
    return N.simple_pool(r).unionByName(
        std.select("series_id", F.lit("STD").alias("model"), "ts", F.col("sigma").alias("yhat")))


@query("forecast_actual_join", """SELECT f.series_id, f.model, f.ts, r.value AS y, f.yhat FROM pool_s f JOIN smr r
 ON f.series_id = r.series_id AND f.ts = r.ts""", y=8, yhat=8)
def forecast_actual_join(spark, sf):
    from panelweave.operators.evaluate import losses
    r = supplier_panel(spark, sf)
    return losses(N.simple_pool(r), r).drop("e")


@query("strategy_grid", """SELECT f.forecast, d.dependence, b.beta, p.panel, f.forecast || '-' || d.dependence || '-SKT-' ||
 CAST(CAST(b.beta * 100 AS INT) AS VARCHAR) || '-' || p.panel AS label, t.ts FROM full_dates t,
 (VALUES ('RW'), ('SMA(6)'), ('SMA(12)')) AS f(forecast), (VALUES ('DCC'), ('ADCC'), ('GAS')) AS d(dependence),
 (VALUES (0.95::DOUBLE), (0.99::DOUBLE)) AS b(beta), (VALUES ('long_only'), ('130_30')) AS p(panel)
 WHERE t.ts >= DATE '2000-01-01'""")
def strategy_grid(spark, sf):
    dates = P.period_filter(P.wide(order_returns(spark, sf), ASSETS), OOS).select("ts")
    return X.strategy_grid(dates, ["RW", "SMA(6)", "SMA(12)"], ["DCC", "ADCC", "GAS"], [0.95, 0.99], ["long_only", "130_30"])


@query("strategy_labels", """SELECT model || '-DCC-SKT' AS label, model AS forecast, 'DCC' AS dependence, count(*) AS n
 FROM pool_s GROUP BY model""")
def strategy_labels(spark, sf):
    pool = N.simple_pool(supplier_returns(spark, sf)).withColumn("label", S.strategy_label("model", F.lit("DCC"), F.lit("SKT")))
    return X.parse_label(pool, "label").groupBy("label", "forecast", "dependence").agg(F.count("*").alias("n"))


@query("unfinished_dates", """SELECT series_id, ts, value FROM sm WHERE ts NOT IN (SELECT ts FROM om)""", value=2)
def unfinished_dates(spark, sf):
    return P.unfinished(T.supplier_monthly(spark, sf), T.orders_monthly(spark, sf))


@query("first_per_date", """SELECT series_id, ts, value FROM (SELECT *, row_number() OVER (PARTITION BY ts ORDER BY value,
 series_id) AS rn FROM (SELECT l_returnflag AS series_id, CAST(l_shipdate AS DATE) AS ts, sum(l_extendedprice) AS value
 FROM lineitem GROUP BY 1, 2) AS d) AS q WHERE rn = 1""", value=2)
def first_per_date(spark, sf):
    return P.first_per_key(T.lineitem_daily(spark, sf), ["ts"], ["value", "series_id"])


@query("chronological_panel", "SELECT series_id, ts, value, row_number() OVER (PARTITION BY series_id ORDER BY ts) AS position FROM ld",
       value=2)
def chronological_panel(spark, sf):
    return T.lineitem_daily(spark, sf).withColumn("position", F.row_number().over(N.by_series()).cast("long")).orderBy("ts", "series_id")


# --- windows --------------------------------------------------------------------

@query("random_walk", """SELECT series_id, 'RW' AS model, ts, lag(value) OVER (PARTITION BY series_id ORDER BY ts) AS yhat
 FROM smr""", yhat=8)
def random_walk(spark, sf):
    return N.random_walk(supplier_returns(spark, sf))


@query("sma_bank", " UNION ALL ".join(
    f"SELECT series_id, ts, 'SMA({q})' AS model, {Q.sma_sql(q)} AS yhat FROM smr" for q in range(3, 31)), yhat=8)
def sma_bank(spark, sf):
    return N.sma_bank(supplier_returns(spark, sf), range(3, 31))


@query("lag_matrix", """SELECT * FROM (SELECT series_id, ts, value AS y, lag(value, 1) OVER w AS x1, lag(value, 2) OVER w AS x2,
 lag(value, 3) OVER w AS x3, lag(value, 4) OVER w AS x4, lag(value, 5) OVER w AS x5, lag(value, 6) OVER w AS x6 FROM smr
 WINDOW w AS (PARTITION BY series_id ORDER BY ts)) AS q WHERE x6 IS NOT NULL""", y=8, x1=8, x2=8, x3=8, x4=8, x5=8, x6=8)
def lag_matrix(spark, sf):
    return N.lag_matrix(supplier_returns(spark, sf), 6)


@query("feature_frames", f"""SELECT {Q.split_sql()} AS split, count(*) AS n, avg(y) AS y, avg(x1) AS x1, avg(x6) AS x6 FROM
 (SELECT series_id, ts, value AS y, lag(value, 1) OVER w AS x1, lag(value, 6) OVER w AS x6 FROM smr
 WINDOW w AS (PARTITION BY series_id ORDER BY ts)) AS q WHERE x6 IS NOT NULL GROUP BY 1""", y=8, x1=8, x6=8)
def feature_frames(spark, sf):
    frames = N.lag_matrix(supplier_returns(spark, sf), 6).withColumn("split", P.split_of())
    return frames.groupBy("split").agg(F.count("*").alias("n"), *[F.avg(c).alias(c) for c in ("y", "x1", "x6")])


@query("growth_index", """SELECT series_id, ts, 100 * exp(sum(ln(1 + value)) OVER (PARTITION BY series_id ORDER BY ts)) AS
 index_value FROM oms""", index_value=6)
def growth_index(spark, sf):
    return N.growth_index(order_returns(spark, sf).withColumn("value", S.log_to_simple("value")))


@query("rolling_windows", f"""SELECT a.series_id, a.ts, count(*) AS n, sum(b.value) AS total, min(b.value) AS low, max(b.value) AS high
 FROM (SELECT *, row_number() OVER (PARTITION BY series_id ORDER BY ts) AS i FROM smr) AS a JOIN
 (SELECT *, row_number() OVER (PARTITION BY series_id ORDER BY ts) AS i FROM smr) AS b ON a.series_id = b.series_id
 AND b.i BETWEEN a.i - {WINDOW} AND a.i - 1 GROUP BY 1, 2 HAVING count(*) = {WINDOW}""", total=8, low=8, high=8)
def rolling_windows(spark, sf):
    w = N.rolling_windows(supplier_returns(spark, sf), WINDOW)
    total = F.aggregate("window", F.lit(0.0), lambda s, x: s + x)
    return w.select("series_id", "ts", F.size("window").cast("long").alias("n"), total.alias("total"),
                    F.array_min("window").alias("low"), F.array_max("window").alias("high"))


@query("rolling_std", f"""SELECT series_id, ts, CASE WHEN count(value) OVER {Q.past_sql(WINDOW)} >= 2 THEN
 stddev_samp(value) OVER {Q.past_sql(WINDOW)} END AS sigma FROM smr""", sigma=8)
def rolling_std(spark, sf):
    return N.rolling_std(supplier_returns(spark, sf), WINDOW)


@query("empirical_pit", f"""SELECT series_id, ts, {Q.average_rank_sql('value', 'series_id')} /
 (count(*) OVER (PARTITION BY series_id) + 1) AS u FROM smr""", u=8)
def empirical_pit(spark, sf):
    return N.empirical_pit(supplier_returns(spark, sf))


# --- descriptive statistics -------------------------------------------------------

@query("describe_series", """WITH m AS (SELECT series_id, count(*) AS n, avg(value) AS mean, median(value) AS median,
 stddev_samp(value) AS std, skewness(value) AS skewness, kurtosis_pop(value) + 3 AS kurtosis FROM smr GROUP BY 1)
 SELECT *, n / 6.0::DOUBLE * ((skewness * (n - 2) / sqrt(n * (n - 1))) ** 2 + (kurtosis - 3) ** 2 / 4) AS jarque_bera,
 exp(-n / 12.0::DOUBLE * ((skewness * (n - 2) / sqrt(n * (n - 1))) ** 2 + (kurtosis - 3) ** 2 / 4)) AS jb_p FROM m""",
       mean=8, median=8, std=8, skewness=6, kurtosis=6, jarque_bera=6, jb_p=6)
def describe_series(spark, sf):
    return D.describe(supplier_returns(spark, sf))


def _pairs_sql(src: str, value: str) -> str:
    return (f"SELECT a.series_id AS s1, b.series_id AS s2, {value} AS rho FROM {src} a JOIN {src} b "
            "ON a.ts = b.ts AND a.series_id < b.series_id GROUP BY 1, 2")


@query("pearson_matrix", _pairs_sql("omc", "corr(a.value, b.value)"), rho=8)
def pearson_matrix(spark, sf):
    return D.pearson_matrix(order_returns(spark, sf), ASSETS)


@query("spearman_matrix", _pairs_sql("omc_rank", "corr(a.value, b.value)"), rho=8)
def spearman_matrix(spark, sf):
    return D.spearman_matrix(order_returns(spark, sf), ASSETS)


@query("correlation_target", _pairs_sql("omc", "covar_samp(a.value, b.value) / (stddev_samp(a.value) * stddev_samp(b.value))"), rho=8)
def correlation_target(spark, sf):
    return D.correlation_target(order_returns(spark, sf), ASSETS)


@query("negative_moment", _pairs_sql("omc", "avg(least(a.value, 0.0) * least(b.value, 0.0))"), rho=8)
def negative_moment(spark, sf):
    return D.negative_moment(order_returns(spark, sf), ASSETS)


@query("pair_products", "SELECT a.ts, a.series_id AS s1, b.series_id AS s2, a.value * b.value AS rho FROM omc a JOIN omc b "
       "ON a.ts = b.ts AND a.series_id < b.series_id", rho=8)
def pair_products(spark, sf):
    return D.pair_products(order_returns(spark, sf), ASSETS)


@query("coverage", """WITH d AS (SELECT ts, count(value) AS n FROM sm GROUP BY 1) SELECT count(*) FILTER (WHERE n =
 (SELECT count(DISTINCT series_id) FROM sm)) AS complete, count(*) AS periods, count(*) FILTER (WHERE n =
 (SELECT count(DISTINCT series_id) FROM sm)) / count(*)::DOUBLE AS share FROM d""", share=8)
def coverage(spark, sf):
    return D.coverage(staged(T.supplier_monthly(spark, sf)))


@query("strongest_partners", """SELECT series_id, CAST(rank AS INT) AS rank, partner, rho, n FROM (SELECT *, row_number() OVER (PARTITION BY series_id ORDER BY
 abs(rho) DESC, partner) AS rank FROM (SELECT a.series_id, b.series_id AS partner, corr(a.value, b.value) AS rho, count(*) AS n FROM smr a JOIN smr b
 ON a.ts = b.ts AND a.series_id <> b.series_id GROUP BY 1, 2 HAVING count(*) >= 3) AS p WHERE rho IS NOT NULL AND NOT isnan(rho)) AS q WHERE rank <= 5""", rho=8)
def strongest_partners(spark, sf):
    """Of all suppliers the five that move most like each, from all pairs."""
    return D.strongest_partners(supplier_returns(spark, sf))
