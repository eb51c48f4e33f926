"""Rolling volatility, standardised residuals and marginal fits."""

from __future__ import annotations

import math
from collections.abc import Sequence
from itertools import product

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelweave.config import WINDOW
from panelweave.functions.scalars import skewed_t_log_density
from panelweave.operators.forecast import known, per_series
from panelweave.operators.panel import series_arrays
from panelweave.operators.windows import past

ALPHAS = (0.02, 0.05, 0.1, 0.15, 0.2, 0.3)
BETAS = (0.5, 0.6, 0.7, 0.8, 0.85, 0.9, 0.95)
ASYMMETRIES = (0.0, 0.05, 0.1, 0.2)


def variance_grid(alphas: Sequence[float], betas: Sequence[float], asymmetries: Sequence[float] = (0.0,)) -> np.ndarray:
    """Stationary (alpha, beta, asymmetry) points in natural order."""
    points = [p for p in product(alphas, betas, asymmetries) if p[0] + p[1] + p[2] / 2 < 0.999]
    return np.array(points)


def past_windows(x: np.ndarray, window: int) -> np.ndarray:
    """Row t holds the ``window`` values before t, NaN where there are none."""
    padded = np.concatenate([np.full(window, np.nan), x])
    return np.lib.stride_tricks.sliding_window_view(padded, window)[: len(x)]


def variance_paths(windows: np.ndarray, grid: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Log likelihood, last in-window and next variance per window and grid point.

    The long-run variance is the window's mean square, so each grid point has
    no free level; the recursion starts there.
    """
    alpha, beta, asymmetry = grid.T
    square = windows ** 2
    target = np.nanmean(square, axis=1)[:, None]
    base = target * (1 - alpha - beta - asymmetry / 2)
    now = np.repeat(target, len(grid), axis=1)
    last, ll = now, np.zeros_like(now)
    with np.errstate(divide="ignore", invalid="ignore"):
        for k in range(windows.shape[1]):
            sq, known = square[:, k, None], ~np.isnan(windows[:, k, None])
            ll = np.where(known, ll - 0.5 * (np.log(now) + sq / now), ll)
            step = base + (alpha + asymmetry * (windows[:, k, None] < 0)) * sq + beta * now
            last, now = now, np.where(known, step, now)
    return ll, last, now


def garch_volatility(panel: DataFrame, window: int = WINDOW, alphas: Sequence[float] = ALPHAS, betas: Sequence[float] = BETAS,
                     asymmetries: Sequence[float] = (0.0,), minimum: int = 10) -> DataFrame:
    """One-step volatility from the rows before each date.

    Zero mean, variance targeting, (alpha, beta) by likelihood over a fixed
    grid. Windows shorter than ``minimum`` fall back to their sample std.
    All windows of a series advance together; windows never leave the task.
    """
    grid = variance_grid(alphas, betas, asymmetries)

    def one(row) -> pd.DataFrame:
        x = np.asarray(row.value, dtype=float)
        windows = past_windows(x, window)[1:]
        count = (~np.isnan(windows)).sum(axis=1)
        ll, _, nxt = variance_paths(windows, grid)
        best = np.where(np.isnan(ll), -np.inf, ll).argmax(axis=1)
        sigma = np.sqrt(nxt[np.arange(len(best)), best])
        few = (count < minimum) | ~(sigma > 0)
        mean = np.nanmean(windows, axis=1)
        std = np.sqrt(np.nansum((windows - mean[:, None]) ** 2, axis=1) / np.where(count > 1, count - 1, np.nan))
        return pd.DataFrame({"series_id": row.series_id, "ts": row.ts[1:], "sigma": np.where(few, std, sigma)})

    out = per_series(series_arrays(panel, "value"), one, "series_id string, ts date, sigma double")
    return out.where(known("sigma"))


def ewma_volatility(panel: DataFrame, window: int = WINDOW, decay: float = 0.94) -> DataFrame:
    """Exponentially weighted root mean square of the rows before each date."""
    start = F.struct(F.lit(0.0).alias("total"), F.lit(0.0).alias("weight"))
    step = lambda s, x: F.struct(
        (decay * s["total"] + x * x).alias("total"), (decay * s["weight"] + 1).alias("weight"))
    rows = panel.select("series_id", "ts", F.collect_list("value").over(past(window)).alias("w")).where(F.size("w") > 0)
    sums = F.aggregate("w", start, step, lambda s: F.sqrt(s["total"] / s["weight"]))
    return rows.select("series_id", "ts", sums.alias("sigma"))


def scaled_residuals(panel: DataFrame, window: int = WINDOW, minimum: int = 12) -> DataFrame:
    """Returns over the rolling std of the rows before them."""
    w = past(window)
    sigma = F.when(F.count("value").over(w) >= minimum, F.stddev_samp("value").over(w))
    return (
        panel.withColumn("sigma", sigma).where(F.col("sigma") > 0)
        .select("series_id", "ts", (F.col("value") / F.col("sigma")).alias("value"))
    )


def autoregressive_residuals(windows: np.ndarray, orders: Sequence[int]) -> tuple[np.ndarray, np.ndarray]:
    """Order by BIC and its residuals for each full window.

    All orders are fitted on the same rows of the window, after the longest lag.
    """
    longest = max(orders)
    y = windows[:, longest:]
    n = y.shape[1]
    bic, residual = [], []
    for p in orders:
        x = np.stack([np.ones_like(y), *[windows[:, longest - i: windows.shape[1] - i] for i in range(1, p + 1)]], axis=2)
        gram = np.einsum("wti,wtj->wij", x, x)
        right = np.einsum("wti,wt->wi", x, y)
        coef = np.einsum("wij,wj->wi", np.linalg.pinv(gram, hermitian=True), right)
        e = y - np.einsum("wti,wi->wt", x, coef)
        residual.append(e)
        bic.append(n * np.log(np.maximum((e ** 2).sum(axis=1) / n, 1e-300)) + (p + 1) * math.log(n))
    best = np.stack(bic).argmin(axis=0)
    return np.asarray(orders)[best], np.stack(residual)[best, np.arange(len(best))]


def _full_windows(row, window: int) -> np.ndarray:
    x = np.asarray(row.value, dtype=float)
    if len(x) < window:
        return np.empty((0, window))
    return np.lib.stride_tricks.sliding_window_view(x, window)


def window_orders(panel: DataFrame, window: int = WINDOW, orders: Sequence[int] = (1, 2)) -> DataFrame:
    """Autoregressive order of the window ending at each date, by BIC."""

    def one(row) -> pd.DataFrame:
        w = _full_windows(row, window)
        if not len(w):
            return pd.DataFrame()
        best = autoregressive_residuals(w, orders)[0]
        return pd.DataFrame({"series_id": row.series_id, "ts": row.ts[window - 1:], "ar_order": best})

    return per_series(series_arrays(panel, "value"), one, "series_id string, ts date, ar_order int")


def _least_squares(y: np.ndarray, xs: Sequence[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Residuals and their sums of squares of one regression with a constant per row of ``y``."""
    x = np.stack([np.ones_like(y), *xs], axis=2)
    coef = np.einsum("wij,wj->wi", np.linalg.pinv(np.einsum("wti,wtj->wij", x, x), hermitian=True), np.einsum("wti,wt->wi", x, y))
    e = y - np.einsum("wti,wi->wt", x, coef)
    return e, (e ** 2).sum(axis=1)


def _bic(rss: np.ndarray, rows: int, terms: int) -> np.ndarray:
    return rows * np.log(np.maximum(rss / rows, 1e-300)) + terms * math.log(rows)


def order_candidates(windows: np.ndarray, means: Sequence[int], shocks: Sequence[int], variances: Sequence[int], long_order: int = 3) -> list[tuple[int, int, int, np.ndarray]]:
    """``(p, p', q, BIC)`` of every window for autoregressions of order p with variances of p' past shocks and q past variances.

    The variance of a residual follows its square: squares are regressed on p' past squares and on q past innovations,
    which are what a long regression of squares leaves. All orders of a part are fitted on the same rows, and the two
    parts' criteria add up.
    """
    longest, late = max(means), max(max(variances), 1)
    y, n, out = windows[:, longest:], windows.shape[1], []
    for p in means:
        e, rss = _least_squares(y, [windows[:, longest - i:n - i] for i in range(1, p + 1)])
        mean = _bic(rss, y.shape[1], p + 1)
        square, t = e ** 2, e.shape[1]
        innovation, _ = _least_squares(square[:, long_order:], [square[:, long_order - i:t - i] for i in range(1, long_order + 1)])
        first = long_order + late
        for a in shocks:
            for q in variances:
                past = [square[:, first - i:t - i] for i in range(1, a + 1)] + [innovation[:, late - i:innovation.shape[1] - i] for i in range(1, q + 1)]
                _, rest = _least_squares(square[:, first:], past)
                out.append((p, a, q, mean + _bic(rest, t - first, a + q + 1)))
    return out


def volatility_orders(panel: DataFrame, window: int = WINDOW, means: Sequence[int] = (1, 2), shocks: Sequence[int] = (1, 2),
                      variances: Sequence[int] = (0, 1, 2)) -> DataFrame:
    """Orders ``(p, p', q)`` of the window ending at each date, the candidates as rows and the smallest BIC picked; smaller orders win ties."""

    def one(row) -> pd.DataFrame:
        w = _full_windows(row, window)
        if not len(w):
            return pd.DataFrame()
        ts = row.ts[window - 1:]
        return pd.concat([pd.DataFrame({"series_id": row.series_id, "ts": ts, "ar_order": p, "shock_order": a, "variance_order": q, "bic": bic})
                          for p, a, q, bic in order_candidates(w, means, shocks, variances)])

    orders = F.struct("ar_order", "shock_order", "variance_order")
    rows = per_series(series_arrays(panel, "value"), one, "series_id string, ts date, ar_order int, shock_order int, variance_order int, bic double")
    best = rows.where(known("bic")).groupBy("series_id", "ts").agg(F.min(F.struct("bic", orders.alias("o"))).alias("b"))
    return best.select("series_id", "ts", "b.o.*", F.col("b.bic").alias("bic"))


def marginal_residuals(panel: DataFrame, window: int = WINDOW, orders: Sequence[int] = (1, 2), alphas: Sequence[float] = ALPHAS,
                       betas: Sequence[float] = BETAS, asymmetries: Sequence[float] = ASYMMETRIES) -> DataFrame:
    """Last standardised residual and its uniform from the window ending at each date.

    Mean by an autoregression, variance with a leverage term over a grid. The
    uniform is the rank of the last residual in its window over ``n + 1``.
    """
    grid = variance_grid(alphas, betas, asymmetries)

    def one(row) -> pd.DataFrame:
        w = _full_windows(row, window)
        if not len(w):
            return pd.DataFrame()
        e = autoregressive_residuals(w, orders)[1]
        ll, _, _ = variance_paths(e, grid)
        a, b, g = grid[np.where(np.isnan(ll), -np.inf, ll).argmax(axis=1)].T
        target = (e ** 2).mean(axis=1)
        now, z = target, np.empty_like(e)
        for k in range(e.shape[1]):
            z[:, k] = e[:, k] / np.sqrt(now)
            now = target * (1 - a - b - g / 2) + (a + g * (e[:, k] < 0)) * e[:, k] ** 2 + b * now
        last = z[:, -1:]
        rank = (z < last).sum(axis=1) + ((z == last).sum(axis=1) + 1) / 2
        return pd.DataFrame({
            "series_id": row.series_id, "ts": row.ts[window - 1:], "z": z[:, -1],
            "u": np.clip(rank / (e.shape[1] + 1), 1e-6, 1 - 1e-6)})

    return per_series(series_arrays(panel, "value"), one, "series_id string, ts date, z double, u double")


def skewed_t_fit(residuals: DataFrame, nus: Sequence[float] = (3.0, 4.0, 5.0, 6.0, 8.0, 12.0, 20.0, 30.0),
                 lams: Sequence[float] = (-0.3, -0.15, 0.0, 0.15, 0.3), asof=None, minimum: int = 20) -> DataFrame:
    """Degrees of freedom and skewness by likelihood over a fixed grid.

    Every grid point is one sum of a single aggregation. ``asof`` keeps later
    rows out; series with few rows get (8, 0).
    """
    rows = residuals if asof is None else residuals.where(F.col("ts") <= F.lit(asof))
    points = [(nu, lam) for nu in nus for lam in lams]
    sums = [F.struct(F.sum(skewed_t_log_density("value", nu, lam)).alias("ll"), F.lit(-i).alias("i"),
                     F.lit(nu).alias("nu"), F.lit(lam).alias("lam")) for i, (nu, lam) in enumerate(points)]
    fitted = rows.groupBy("series_id").agg(F.count("value").alias("n"), F.array(*sums).alias("grid"))
    best = fitted.withColumn("b", F.array_max("grid"))
    few = F.col("n") < minimum
    return best.select(
        "series_id", "n", F.when(few, 8.0).otherwise(F.col("b.nu")).alias("nu"),
        F.when(few, 0.0).otherwise(F.col("b.lam")).alias("lam"))
