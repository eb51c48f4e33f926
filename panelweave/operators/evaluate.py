"""Forecast errors, direction and equal-accuracy tests, report tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from panelweave.functions.scalars import ratio, stars, two_sided_p

KEYS = ("series_id", "model")


def losses(forecasts: DataFrame, actuals: DataFrame) -> DataFrame:
    """Forecasts matched to actual values by series and date, never by position."""
    y = actuals.select("series_id", "ts", F.col("value").alias("y"))
    return (
        forecasts.where(F.col("yhat").isNotNull()).join(y, ["series_id", "ts"])
        .select("series_id", "model", "ts", "y", "yhat", (F.col("y") - F.col("yhat")).alias("e"))
    )


def error_metrics(loss: DataFrame, benchmark: str = "RW") -> DataFrame:
    """MAE, RMSE, MAPE (plain and masked), Theil U1 and the ratio to a benchmark."""
    e, y, f = F.col("e"), F.col("y"), F.col("yhat")
    relative = F.abs(ratio(e, y))
    base = loss.groupBy(*KEYS).agg(
        F.count("*").alias("n"),
        F.avg(F.abs(e)).alias("mae"),
        F.sqrt(F.avg(e * e)).alias("rmse"),
        (F.avg(relative) * 100).alias("mape"),
        (F.avg(F.when(F.abs(y) > 1e-8, relative)) * 100).alias("mape_masked"),
        F.sqrt(F.avg(f * f)).alias("rms_forecast"),
        F.sqrt(F.avg(y * y)).alias("rms_actual"),
    )
    # One row per model of a series: the window holds only those few rows.
    bench = F.max(F.when(F.col("model") == benchmark, F.col("rmse"))).over(W.partitionBy("series_id"))
    return base.select(
        *KEYS, "n", "mae", "rmse", "mape", "mape_masked",
        ratio(F.col("rmse"), F.col("rms_forecast") + F.col("rms_actual")).alias("theil_u1"),
        F.when(bench >= 1e-10, F.col("rmse") / F.when(bench >= 1e-10, bench)).alias("theil_ratio"),
    )


def direction_test(loss: DataFrame, variance: str = "minus", agreement: str = "sign", minimum: int = 1) -> DataFrame:
    """Pesaran-Timmermann test of directional accuracy.

    ``variance`` is ``minus`` (the published statistic) or ``plus``; ``agreement``
    compares signs (zero is its own sign) or the events ``> 0``.
    """
    y, f = F.col("y"), F.col("yhat")
    hit = F.signum(y) == F.signum(f) if agreement == "sign" else (y > 0) == (f > 0)
    base = loss.groupBy(*KEYS).agg(
        F.count("*").alias("n"), F.avg(hit.cast("double")).alias("hit_rate"),
        F.avg((y > 0).cast("double")).alias("py"), F.avg((f > 0).cast("double")).alias("pf"),
    )
    n, py, pf = F.col("n"), F.col("py"), F.col("pf")
    expected = py * pf + (1 - py) * (1 - pf)
    v1 = expected * (1 - expected) / n
    v2 = ((2 * py - 1) * (2 * py - 1) * pf * (1 - pf) + (2 * pf - 1) * (2 * pf - 1) * py * (1 - py)) / n
    total = v1 - v2 if variance == "minus" else v1 + v2
    # Values this close to zero are rounding noise of an exact zero.
    usable = (total > 1e-15) & (n >= minimum)
    stat = F.when(usable, (F.col("hit_rate") - expected) / F.sqrt(F.when(total > 1e-15, total)))
    return base.select(*KEYS, "n", "hit_rate", stat.alias("pt")).withColumn("pt_p", two_sided_p("pt"))


def point_loss(kind: str) -> Column:
    e = F.col("e")
    return F.abs(e) if kind == "mae" else e * e


def accuracy_test(loss: DataFrame, reference: str, kind: str = "mse", floor: float | None = None,
                  reference_first: bool = False, minimum: int = 2) -> DataFrame:
    """Diebold-Mariano test of each model against a reference model.

    The difference is L(model) - L(reference), so a negative statistic means
    the model is better; ``reference_first`` flips the sign. ``floor`` bounds
    the variance of the mean from below, otherwise a zero variance gives NULL.
    """
    ref = F.max(F.when(F.col("model") == reference, point_loss(kind))).over(W.partitionBy("series_id", "ts"))
    d = point_loss(kind) - F.col("ref")
    diff = (
        loss.withColumn("ref", ref).where(F.col("model") != reference)
        .withColumn("d", -d if reference_first else d).where(F.col("d").isNotNull())
    )
    base = diff.groupBy(*KEYS).agg(
        F.count("d").alias("n"), F.avg("d").alias("mean_diff"), F.var_samp("d").alias("var"))
    v = F.col("var") / F.col("n")
    v = F.greatest(v, F.lit(floor)) if floor is not None else F.when(v > 0, v)
    stat = F.when(F.col("n") >= minimum, F.col("mean_diff") / F.sqrt(v))
    return base.select(*KEYS, "n", "mean_diff", stat.alias("dm")).withColumn("dm_p", two_sided_p("dm"))


def metric_bundle(loss: DataFrame, benchmark: str, reference: str) -> DataFrame:
    errors = error_metrics(loss, benchmark)
    pt = direction_test(loss).select(*KEYS, "pt", "pt_p")
    dm = accuracy_test(loss, reference).select(*KEYS, "dm", "dm_p")
    return errors.join(pt, list(KEYS)).join(dm, list(KEYS), "left")


def pivot_models(long: DataFrame, models: Sequence[str], value: str) -> DataFrame:
    """Rows (series, statistic) by model columns; the model list is given."""
    return long.groupBy("series_id", "statistic").pivot("model", list(models)).agg(F.first(value))


def forecast_table(metrics: DataFrame, models: Sequence[str],
                   statistics: Sequence[str] = ("mae", "mape", "rmse", "theil_u1", "theil_ratio")) -> DataFrame:
    cells = F.array(*[F.struct(F.lit(s).alias("statistic"), F.col(s).alias("v")) for s in statistics])
    return pivot_models(metrics.select("series_id", "model", F.inline(cells)), models, "v")


def test_table(bundle: DataFrame, models: Sequence[str], reference: str) -> DataFrame:
    """PT in parentheses and DM with significance marks; ``-`` for the reference."""
    pt = F.coalesce(F.concat(F.format_string("(%.2f)", "pt"), stars("pt_p")), F.lit(""))
    dm = F.when(F.col("model") == reference, F.lit("-")).otherwise(
        F.coalesce(F.concat(F.format_string("%.2f", "dm"), stars("dm_p")), F.lit("")))
    pt = F.when(F.col("pt").isNull(), F.lit("")).otherwise(pt)
    dm = F.when((F.col("model") != reference) & F.col("dm").isNull(), F.lit("")).otherwise(dm)
    cells = F.array(F.struct(F.lit("PT").alias("statistic"), pt.alias("v")),
                    F.struct(F.lit("DM").alias("statistic"), dm.alias("v")))
    return pivot_models(bundle.select("series_id", "model", F.inline(cells)), models, "v")


def best_model(loss: DataFrame, expected: DataFrame | None = None, share: float = 0.9) -> DataFrame:
    """Model with the smallest RMSE per series among those with enough forecasts.

    ``expected`` gives the dates each series should have, as a panel.
    """
    scored = loss.groupBy(*KEYS).agg(F.count("e").alias("n"), F.sqrt(F.avg(F.col("e") * F.col("e"))).alias("rmse"))
    if expected is not None:
        dates = expected.groupBy("series_id").agg(F.count("*").alias("n_dates"))
        scored = scored.join(dates, "series_id").where(F.col("n") >= share * F.col("n_dates"))
    return (
        scored.groupBy("series_id").agg(F.min(F.struct("rmse", "model")).alias("best"))
        .select("series_id", F.col("best.model").alias("model"), F.col("best.rmse").alias("rmse"))
    )


def best_forecast(forecasts: DataFrame, winners: DataFrame, dates: DataFrame) -> DataFrame:
    """Forecast of each series' winning model on the given (series, ts) rows, 0 where absent."""
    chosen = forecasts.join(winners.select("series_id", "model"), ["series_id", "model"], "left_semi")
    return (
        dates.select("series_id", "ts").join(chosen.select("series_id", "ts", "yhat"), ["series_id", "ts"], "left")
        .select("series_id", F.lit("Best").alias("model"), "ts", F.coalesce("yhat", F.lit(0.0)).alias("yhat"))
    )


def best_parameter(loss: DataFrame, parameters: Sequence[str]) -> DataFrame:
    """Grid point with the smallest RMSE per series."""
    return (
        loss.groupBy("series_id", *parameters).agg(F.sqrt(F.avg(F.col("e") * F.col("e"))).alias("rmse"))
        .groupBy("series_id").agg(F.min(F.struct("rmse", *parameters)).alias("best"))
        .select("series_id", *[F.col("best")[p].alias(p) for p in parameters], F.col("best.rmse").alias("rmse"))
    )
