"""Reduction and combination of forecast pools."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from panelweave.config import IN_SAMPLE, OOS, TEST, TRAIN, Split
from panelweave.operators.forecast import in_period, per_series
from panelweave.operators.panel import series_arrays, spread
from panelweave.operators.regression import _unpack, coefficients, linear_value, moments


# --- principal components -----------------------------------------------------------

def pool_moments(pool: DataFrame, fit: Split = IN_SAMPLE, share: float = 0.9) -> DataFrame:
    """Mean and std of each model over the fit period, thin models dropped.

    The std counts missing rows as equal to the mean, which is what filling
    them with the mean would give. A series' dates are those of its fullest model.
    """
    stats = pool.where(in_period(fit)).groupBy("series_id", "model").agg(
        F.count("yhat").alias("n"), F.avg("yhat").alias("mean"),
        (F.var_pop("yhat") * F.count("yhat")).alias("ss"))
    dates = F.max("n").over(W.partitionBy("series_id"))
    return (
        stats.withColumn("dates", dates).where((F.col("n") >= share * F.col("dates")) & (F.col("ss") > 0))
        .select("series_id", "model", "mean", F.sqrt(F.col("ss") / F.col("dates")).alias("scale"))
    )


def _grid(own: pa.Table, models: list[str]) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """Dates of one series, and by date and model the summed forecasts and how many there are; other models are left out."""
    place = pc.index_in(own.column("model"), pa.array(models, pa.string())).combine_chunks()
    own = own.select(["ts", "yhat"]).filter(place.is_valid())
    model = place.drop_null().to_numpy()
    dates = pc.dictionary_encode(own.column("ts"), null_encoding="encode").combine_chunks()
    n, at = len(dates.dictionary), dates.indices.to_numpy() * len(models) + model
    grid = lambda weights: np.bincount(at, weights, n * len(models)).reshape(n, len(models))
    return dates.dictionary, grid(own.column("yhat").to_numpy()), grid(None)


def _by_series(pool: DataFrame, other: DataFrame, fn: Callable[[pa.Table, pa.Table], pa.Table], schema: str) -> DataFrame:
    """The known forecasts of every series next to its rows of another table: as many rows as models and dates, whatever the panel."""
    known = pool.where("yhat is not null and series_id is not null").select("series_id", "model", "ts", F.col("yhat").cast("double").alias("yhat"))
    # Both sides may come from one table: columns of their own keep them apart.
    other = other.where("series_id is not null").select(*[F.col(c).alias(f"{c}_") for c in other.columns])
    return known.groupBy("series_id").cogroup(other.groupBy("series_id_")).applyInArrow(
        lambda a, b: fn(a, b.rename_columns([c[:-1] for c in b.column_names])), schema)


def loadings(pool: DataFrame, fit: Split = IN_SAMPLE, share: float = 0.95) -> DataFrame:
    """Principal axes of each series' pool up to a share of its variance.

    Rows ``(series_id, k, model, weight, explained, mean, scale)``; the largest
    weight of an axis is made positive. A series' forecasts of the fit period
    meet once, as a matrix of dates by models, whose cross products are solved.
    """
    schema = "series_id string, k int, model string, weight double, explained double, mean double, scale double"
    names = ["series_id", "k", "model", "weight", "explained", "mean", "scale"]
    kinds = [pa.string(), pa.int32(), pa.string(), *[pa.float64()] * 4]

    def one(own: pa.Table, kept: pa.Table) -> pa.Table:
        kept = kept.sort_by("model")
        models, size = kept.column("model").to_pylist(), len(kept)
        mean, scale = (kept.column(c).to_numpy() for c in ("mean", "scale"))
        _, total, count = _grid(own, models)
        if not count.size:
            return pa.table([pa.array([], k) for k in kinds], names=names)
        if count.max() > 1:
            raise ValueError("a model has several forecasts for one date of a series")
        z = np.where(count > 0, (total - mean) / scale, 0.0)  # a missing forecast equals the mean
        n = len(z)
        centred = z.T @ z - np.outer(z.sum(axis=0), z.sum(axis=0)) / n
        roots, vectors = np.linalg.eigh(centred)
        roots, axes = np.maximum(roots[::-1], 0), vectors[:, ::-1].T
        explained = (roots / roots.sum())[:min(size, max(n - 1, 1))]
        keep = min(int(np.searchsorted(explained.cumsum(), share, side="right")) + 1, len(explained))
        axes = axes[:keep]
        largest = np.abs(axes).argmax(axis=1)
        axes = axes * np.sign(axes[np.arange(keep), largest])[:, None]
        columns = [np.repeat(own.column("series_id")[0].as_py(), keep * size), np.repeat(np.arange(1, keep + 1), size), models * keep, axes.reshape(-1),
                   np.repeat(explained[:keep], size), np.tile(mean, keep), np.tile(scale, keep)]
        return pa.table([pa.array(c, k) for c, k in zip(columns, kinds)], names=names)

    return _by_series(pool.where(in_period(fit)), pool_moments(pool, fit), one, schema)


def project(pool: DataFrame, axes: DataFrame) -> DataFrame:
    """Component scores ``(series_id, ts, k, score)`` on stored axes.

    A missing forecast counts as the fit-period mean and so adds nothing. The
    forecasts of a series meet its axes once, as matrices.
    """
    def one(own: pa.Table, kept: pa.Table) -> pa.Table:
        models = pc.unique(kept.column("model").drop_null()).to_pylist()
        ks = pc.unique(kept.column("k")).to_pylist()
        place = {m: i for i, m in enumerate(models)}
        mean, scale = np.zeros(len(models)), np.ones(len(models))
        weight, on = np.zeros((len(models), len(ks))), np.zeros((len(models), len(ks)))
        for k, m, *values in zip(*(kept.column(c).to_pylist() for c in ("k", "model", "mean", "scale", "weight"))):
            if m is not None:
                i, j = place[m], ks.index(k)
                mean[i], scale[i] = values[:2]
                weight[i, j] += values[2]
                on[i, j] = 1
        dates, total, count = _grid(own, models)
        score = (np.where(count > 0, total - count * mean, 0.0) / scale) @ weight
        at, k = np.nonzero(count @ on)
        return pa.table({"series_id": pa.array(np.repeat(own.column("series_id")[0].as_py(), len(at)) if len(at) else [], pa.string()), "ts": dates.take(pa.array(at)),
                         "k": pa.array(ks, pa.int32()).take(pa.array(k)), "score": pa.array(score[at, k])})

    return _by_series(pool, axes.select("series_id", F.col("k").cast("int").alias("k"), "model", "weight", "mean", "scale"), one,
                      "series_id string, ts date, k int, score double")


def components_wide(scores: DataFrame, v: int) -> DataFrame:
    """The first ``v`` components as columns ``c1..cv``; absent ones are 0."""
    cols = [F.coalesce(F.max(F.when(F.col("k") == i, F.col("score"))), F.lit(0.0)).alias(f"c{i}") for i in range(1, v + 1)]
    return scores.groupBy("series_id", "ts").agg(*cols)


def representatives(axes: DataFrame, best: DataFrame) -> DataFrame:
    """Model with the largest absolute loading of each axis, without repeats.

    The best single model leads the list when no axis picked it.
    """
    picked = (
        axes.groupBy("series_id", "k").agg(F.max_by("model", F.struct(F.abs("weight"), "model")).alias("model"))
        .groupBy("series_id", "model").agg(F.min("k").alias("k"))
    )
    named = best.select("series_id", "model", F.lit(True).alias("best"))
    both = picked.join(named, ["series_id", "model"], "full_outer")
    order = W.partitionBy("series_id").orderBy(F.coalesce("k", F.lit(0)))
    mark = F.when(F.col("best"), F.lit(" [BEST]")).otherwise(F.lit(""))
    return both.select(
        "series_id", F.row_number().over(order).alias("rank"), F.concat("model", mark).alias("model"), F.col("k").alias("component"))


def selection_report(pool: DataFrame, axes: DataFrame, best: DataFrame, fit: Split = IN_SAMPLE) -> DataFrame:
    """Per series: models tried and kept, components, their variance, best model."""
    tried = pool.where(in_period(fit)).groupBy("series_id").agg(F.count_distinct("model").alias("n_models"))
    kept = (
        axes.groupBy("series_id", "k").agg(F.first("explained").alias("explained"), F.count("*").alias("n_kept"))
        .groupBy("series_id").agg(F.max("n_kept").alias("n_kept"), F.count("*").alias("n_components"),
                                  F.sum("explained").alias("variance"))
    )
    return tried.join(kept, "series_id").join(
        best.select("series_id", F.col("model").alias("best_model"), F.col("rmse").alias("best_rmse")), "series_id")


# --- supervised combination -----------------------------------------------------------

def ridge_combination(rows: DataFrame, xs: Sequence[str], penalties: Sequence[float] = (0.1, 1.0, 10.0, 100.0),
                      train: Split = TRAIN, test: Split = TEST, oos: Split = OOS, label: str = "Ridge") -> DataFrame:
    """Penalised regression on components, penalty chosen on later data.

    Fitted on ``train``, scored on ``test``, refitted on both with the chosen
    penalty and applied to ``oos``. ``rows`` hold ``series_id, ts, y`` and ``xs``.
    """
    width = len(xs) + 1
    models = [range(width)] * len(penalties)
    labels = [str(i) for i in range(len(penalties))]
    first = coefficients(moments(rows, ["series_id"], xs, where=in_period(train)), ["series_id"], models, labels, width, penalties, "penalty")
    error = F.col("y") - linear_value("coef", xs)
    chosen = (
        rows.where(in_period(test)).join(first.select("series_id", "penalty", "coef"), "series_id")
        .groupBy("series_id", "penalty").agg(F.avg(error * error).alias("mse"))
        .groupBy("series_id").agg(F.min(F.struct("mse", "penalty")).alias("b"))
        .select("series_id", F.col("b.penalty").alias("penalty"))
    )
    both = Split("FIT", train.start, test.end)
    final = coefficients(moments(rows, ["series_id"], xs, where=in_period(both)), ["series_id"], models, labels, width, penalties, "penalty")
    return (
        rows.where(in_period(oos)).join(final.join(chosen, ["series_id", "penalty"]).select("series_id", "coef"), "series_id")
        .select("series_id", F.lit(label).alias("model"), "ts", linear_value("coef", xs).alias("yhat"))
    )


def soft(x: np.ndarray, by: np.ndarray) -> np.ndarray:
    return np.sign(x) * np.maximum(np.abs(x) - by, 0.0)


def descend(corr: np.ndarray, target: np.ndarray, l1: np.ndarray, l2: np.ndarray, beta: np.ndarray, sweeps: int = 2000, tolerance: float = 1e-11) -> np.ndarray:
    """Coordinate descent on problems ``beta' R beta / 2 - r' beta + l1 |beta| + l2 |beta|^2 / 2``, shaped (series, problem, column).

    Only products of columns are used, whatever the number of rows behind them. Columns without variance keep 0. The
    problems of all series advance together; those of a series rest when none of its columns moves any more.
    """
    r, t, out = np.ascontiguousarray(np.moveaxis(corr, (2, 3), (0, 1))), np.ascontiguousarray(np.moveaxis(target, 2, 0)), np.array(beta)
    b, left = np.ascontiguousarray(np.moveaxis(beta, 2, 0)), np.arange(len(beta))
    own = np.einsum("jjsb->jsb", r)
    inverse = np.where(own > 0, 1 / np.where(own > 0, own + l2, 1.0), 0.0)
    for _ in range(sweeps):
        before = b.copy()
        for j in range(len(b)):
            rest = t[j] - np.einsum("ksb,ksb->sb", r[j], b) + own[j] * b[j]
            b[j] = soft(rest, l1) * inverse[j]
        moving = ~(np.abs(b - before).max(axis=(0, 2), initial=0.0) < tolerance)
        if not moving.all():
            out[left[~moving]] = np.moveaxis(b[:, ~moving], 0, 2)
            left, r, t, b, l1, own, inverse = left[moving], r[:, :, moving], t[:, moving], b[:, moving], l1[moving], own[:, moving], inverse[:, moving]
        if not len(left):
            break
    out[left] = np.moveaxis(b, 0, 2)
    return out


def scaled_products(matrix: np.ndarray) -> tuple[np.ndarray, ...]:
    """Correlations between columns and with the outcome, and the means and scales, of stacked cross products of ``(1, x, y)``."""
    n = np.maximum(matrix[:, 0, 0], 1.0)
    mean = matrix[:, 0, 1:] / n[:, None]
    cov = matrix[:, 1:, 1:] / n[:, None, None] - mean[:, :, None] * mean[:, None, :]
    var = np.einsum("bii->bi", cov)
    scale = np.sqrt(np.where(var > 1e-14 * np.maximum(mean ** 2, 1e-300), var, 0.0))
    safe = np.where(scale > 0, scale, np.inf)
    corr = cov / safe[:, :, None] / safe[:, None, :]
    return corr[:, :-1, :-1], corr[:, :-1, -1], mean, scale


#: Series whose penalties one task solves together.
NETS = 128


def net_paths(folds: np.ndarray, mixes: Sequence[float], steps: int, smallest: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Mix, penalty and coefficients (constant first) of the elastic net that forecasts best in time, for a stack of series.

    ``folds`` are, by series, the cross products of consecutive stretches of time. Each stretch is forecast by the fit of
    all before it; the error comes from the stretch's own cross products. Penalties fall from the one that leaves no
    column, and every fit starts from that of the penalty before.
    """
    n, f, p = folds.shape[:3]
    corr, target, mean, scale = (x.reshape(n, f, *x.shape[1:]) for x in scaled_products(np.cumsum(folds, axis=1).reshape(-1, p, p)))
    top = np.maximum(np.abs(target[:, -1]).max(axis=1, initial=0.0), 1e-12)
    points = top[:, None, None] / np.maximum(mixes, 1e-3)[:, None] * smallest ** (np.arange(steps) / (steps - 1))
    m, mix = len(mixes), np.repeat(np.asarray(mixes, dtype=float), f)
    r, t, beta = np.tile(corr, (1, m, 1, 1)), np.tile(target, (1, m, 1)), np.zeros((n, m * f, p - 2))
    error, fits = np.zeros((n, m, steps)), np.zeros((n, m, steps, p - 1))
    for k in range(steps):
        penalty = np.repeat(points[:, :, k], f, axis=1)
        beta = descend(r, t, penalty * mix, penalty * (1 - mix), beta)
        slopes = beta.reshape(n, m, f, -1) * (scale[:, None, :, -1:] / np.where(scale > 0, scale, np.inf)[:, None, :, :-1])
        coef = np.concatenate([(mean[:, None, :, -1] - (slopes * mean[:, None, :, :-1]).sum(axis=3))[..., None], slopes], axis=3)
        for i in range(1, f):
            c = np.concatenate([coef[:, :, i - 1], -np.ones((n, m, 1))], axis=2)
            error[:, :, k] += ((c @ folds[:, i]) * c).sum(axis=2)
        fits[:, :, k] = coef[:, :, -1]
    own, best = np.arange(n), np.where(np.isfinite(error), error, np.inf).reshape(n, -1).argmin(axis=1)
    i, k = np.unravel_index(best, (m, steps))
    return np.asarray(mixes, dtype=float)[i], points[own, i, k], fits[own, i, k]


def elastic_net(rows: DataFrame, xs: Sequence[str], mixes: Sequence[float] = (0.5, 0.9, 1.0), steps: int = 20, smallest: float = 1e-3, folds: int = 5,
                period: Split = IN_SAMPLE) -> DataFrame:
    """``(series_id, mix, penalty, coef)`` of an elastic net per series, chosen over folds that follow each other in time.

    One aggregation sums the cross products of every fold; penalties, folds and refits all come from these sums, so the
    rows are read once. The penalty is ``penalty * (mix |b| + (1 - mix) b^2 / 2)`` on columns of unit variance, next to the
    mean squared error over 2. Series with fewer complete rows than two per fold have no fit.
    """
    order = W.partitionBy("series_id").orderBy("ts")
    cut = rows.where(in_period(period)).withColumn("fold", F.ntile(folds).over(order))
    sums = moments(cut, ["series_id", "fold"], xs).groupBy("series_id").agg(F.sort_array(F.collect_list(F.struct("fold", "moments"))).alias("m"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            names, found = [], []
            for name, parts in zip(batch["series_id"], batch["moments"]):
                matrices = _unpack(pd.Series(list(parts)), len(xs) + 2)
                if len(matrices) == folds and matrices[:, 0, 0].min() >= 2:
                    names.append(name)
                    found.append(matrices)
            for lo in range(0, len(found), NETS):
                mix, penalty, coef = net_paths(np.stack(found[lo:lo + NETS]), mixes, steps, smallest)
                yield pd.DataFrame({"series_id": names[lo:lo + NETS], "mix": mix, "penalty": penalty, "coef": list(coef)})

    return spread(sums.select("series_id", "m.moments"), "series_id").mapInPandas(run, "series_id string, mix double, penalty double, coef array<double>")


def net_combination(rows: DataFrame, xs: Sequence[str], train: Split = TRAIN, test: Split = TEST, oos: Split = OOS, label: str = "Net", **options) -> DataFrame:
    """Elastic net on components: chosen and fitted over the train and test periods, applied to ``oos``."""
    fits = elastic_net(rows, xs, period=Split("FIT", train.start, test.end), **options)
    return rows.where(in_period(oos)).join(fits.select("series_id", "coef"), "series_id").select(
        "series_id", F.lit(label).alias("model"), "ts", linear_value("coef", xs).alias("yhat"))


# --- dynamic model averaging ------------------------------------------------------------

def model_weights(scores: DataFrame, forget: float = 0.99) -> DataFrame:
    """Weights of models from their past log densities, with forgetting.

    ``scores`` are rows (series_id, model, ts, ll) on dates common to all models.
    The log weight at t is ``sum over s < t of forget^(t-s) * ll_s``, kept as the
    recursion ``lw = forget * (lw + ll)`` along a model's dates, which neither
    grows nor vanishes however long the series; weights sum to one per date.
    """
    packed = (
        spread(scores.select("series_id", "model", "ts", "ll"), "series_id", "model").groupBy("series_id", "model")
        .agg(F.sort_array(F.collect_list(F.struct("ts", "ll"))).alias("s"))
        .select("series_id", "model", F.col("s.ts").alias("ts"), F.col("s.ll").alias("ll"))
    )

    def one(row) -> pd.DataFrame:
        weight, out = 0.0, []
        for ll in row.ll:
            out.append(weight)
            weight = forget * (weight + ll)
        return pd.DataFrame({"series_id": row.series_id, "model": row.model, "ts": row.ts, "lw": out})

    per_date = W.partitionBy("series_id", "ts")
    return (
        per_series(packed, one, "series_id string, model string, ts date, lw double")
        .withColumn("e", F.exp(F.col("lw") - F.max("lw").over(per_date)))
        .select("series_id", "model", "ts", (F.col("e") / F.sum("e").over(per_date)).alias("w"))
    )


def _surely_sound(cov: np.ndarray) -> bool:
    """Whether all matrices are positive definite with roots that sum to 1e6 at most, without their roots."""
    if not np.einsum("nii->n", cov).max(initial=0.0) <= 1e6:
        return False
    try:
        return bool(np.isfinite(np.linalg.cholesky(cov)).all())
    except np.linalg.LinAlgError:
        return False


def filter_paths(y: np.ndarray, x: np.ndarray, masks: np.ndarray, forget_state: float, warmup: int) -> tuple[np.ndarray, np.ndarray]:
    """Forecasts and log densities of the regressions given by 0/1 masks.

    Each mask is a linear model with drifting coefficients whose covariance is
    inflated by ``1 / forget_state`` per step. All masks advance together. A
    masked regressor keeps a unit variance that never enters a forecast.
    """
    n, v = len(masks), x.shape[1]
    eye = np.eye(v)
    active = masks.any(axis=1)
    inside = masks[:, :, None] * masks[:, None, :]
    idle = eye[None] * (1 - masks)[:, :, None]
    beta, cov = np.zeros((n, v)), np.tile(eye, (n, 1, 1))
    noise = np.full(n, np.var(y[:warmup]))
    mean, density = np.empty((len(y), n)), np.empty((len(y), n))
    keep = inside / forget_state
    for t in range(len(y)):
        mu = beta @ x[t]  # a masked coefficient stays 0
        cf = (cov @ x[t]) * masks
        spread_ = cf @ x[t]
        var = np.maximum(spread_ + noise, 1e-10)
        error = y[t] - mu
        mean[t], density[t] = mu, -0.5 * (np.log(2 * math.pi * var) + error ** 2 / var)
        total = spread_ / forget_state + noise
        gain = cf / forget_state / total[:, None]
        beta = beta + gain * error[:, None]
        cov = cov * keep - (gain * total[:, None])[:, :, None] * gain[:, None, :] + idle
        if not _surely_sound(cov):
            sound = np.isfinite(cov).all(axis=(1, 2))
            roots = np.linalg.eigvalsh(np.where(sound[:, None, None], cov, eye))
            cov[~sound | (roots[:, 0] < 0) | (roots[:, -1] > 1e6)] = eye
        noise = np.where(active, np.maximum(forget_state * noise + (1 - forget_state) * error ** 2, 1e-6), noise)
    return mean, density


def dynamic_average(rows: DataFrame, xs: Sequence[str], forget_state: float = 0.99, forget_model: float = 0.99,
                    masks_per_task: int = 64, label: str = "DMA") -> DataFrame:
    """Average over all ``2^v`` subsets of the components, weights by past density.

    The filters of different subsets are independent: each row of the job is a
    series with one block of subsets, so a single series already fills many
    tasks. A block returns its weighted sum on a common log scale and only
    those sums, one per date and block, are shuffled. Warm-up dates, whose
    outcomes set the starting noise, get no forecast.
    """
    v = len(xs)
    blocks = math.ceil(2 ** v / masks_per_task)
    packed = series_arrays(rows.withColumn("x", F.array(*xs)), "y", "x")
    tasks = spread(packed.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))), "series_id", "block")

    def one(row) -> pd.DataFrame:
        y, x = np.asarray(row.y, dtype=float), np.stack(row.x).astype(float)
        warmup = max(10, len(y) // 10)
        numbers = np.arange(row.block * masks_per_task, min((row.block + 1) * masks_per_task, 2 ** v))
        masks = (numbers[:, None] >> np.arange(v)[None, :] & 1).astype(float)
        mean, density = filter_paths(y, x, masks, forget_state, warmup)
        log_weight = np.zeros_like(density)
        for t in range(1, len(y)):
            log_weight[t] = forget_model * (log_weight[t - 1] + density[t - 1])
        top = log_weight.max(axis=1)
        e = np.exp(log_weight - top[:, None])
        return pd.DataFrame({
            "series_id": row.series_id, "ts": row.ts, "top": top, "total": e.sum(axis=1), "part": (e * mean).sum(axis=1),
        })[warmup:]

    sums = per_series(tasks, one, "series_id string, ts date, top double, total double, part double")
    top = F.array_max(F.transform("b", lambda b: b["top"]))
    scaled = lambda field: F.aggregate("b", F.lit(0.0), lambda s, b: s + b[field] * F.exp(b["top"] - F.col("m")))
    return (
        sums.groupBy("series_id", "ts").agg(F.collect_list(F.struct("top", "total", "part")).alias("b"))
        .withColumn("m", top)
        .select("series_id", F.lit(label).alias("model"), "ts", (scaled("part") / scaled("total")).alias("yhat"))
    )


def component_rows(pool: DataFrame, actuals: DataFrame, axes: DataFrame, v: int) -> DataFrame:
    """``series_id, ts, y, c1..cv`` for the combination methods, joined by date."""
    scores = components_wide(project(pool, axes.where(F.col("k") <= v)), v)
    y = actuals.select("series_id", "ts", F.col("value").alias("y"))
    return scores.join(y, ["series_id", "ts"])


