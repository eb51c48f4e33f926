"""Time-varying correlation of a short asset list.

A row of work is one date with the residuals of the window before it, so the
dates of a long history spread over all tasks. Parameters come from a fixed
grid by composite likelihood, the sum of the bivariate likelihoods over pairs.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Sequence
from itertools import combinations, product

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from panelweave.config import WINDOW
from panelweave.operators.panel import onto_later, spread, whole, wide
from panelweave.sources.stores import staged

CORR = "model string, ts date, s1 string, s2 string, rho double"
DCC_GRID = ((0.01, 0.03, 0.05, 0.08, 0.12), (0.6, 0.75, 0.85, 0.92, 0.96))
ADCC_G = (0.0, 0.02, 0.05, 0.1)
GAS_GRID = ((0.002, 0.005, 0.01), (0.5, 0.8, 0.95), (5.0, 8.0, 15.0))
# Cells (windows x grid x pairs) a task holds in memory at once.
CELLS = 2_000_000


def date_windows(residuals: DataFrame, assets: Sequence[str] | None = None, window: int = WINDOW) -> DataFrame:
    """``ts`` and the ``window`` residual vectors before it, full windows only; of all series where no assets are named.

    A date's vector goes to each of the dates after it that need it; a date
    with its window is then a group of its own.
    """
    later = onto_later(whole(residuals) if assets is None else wide(residuals, assets), window)
    out = later.groupBy("target").agg(F.sort_array(F.collect_list(F.struct("ts", "v"))).alias("w")).where(F.size("w") == window)
    return out.select(F.col("target").alias("ts"), F.col("w.v").alias("window"))


def past_vectors(residuals: DataFrame, assets: Sequence[str], least: int = WINDOW) -> DataFrame:
    """``ts`` and all residual vectors before it, oldest first, where there are at least so many.

    The rows grow with the square of the dates.
    """
    out = onto_later(wide(residuals, assets), None).groupBy("target").agg(F.sort_array(F.collect_list(F.struct("ts", "v"))).alias("w"))
    return out.where(F.size("w") >= least).select(F.col("target").alias("ts"), F.col("w.v").alias("window"))


def window_moments(window: str, shrink: float = 0.5) -> Column:
    """Mean vector and sample covariance of a window; of the covariance between assets ``shrink`` goes to zero.

    With as many assets as dates or more the sample alone has no inverse.
    """

    @F.pandas_udf("mu array<double>, cov array<array<double>>")
    def run(windows: pd.Series) -> pd.DataFrame:
        out = []
        for w in windows:
            x = np.stack(w).astype(float)
            cov = np.cov(x, rowvar=False)
            out.append((x.mean(axis=0), list(cov * (1 - shrink) + np.diag(np.diag(cov)) * shrink)))
        return pd.DataFrame(out, columns=["mu", "cov"])

    return run(window)


def window_factors(window: str, shrink: float = 0.5) -> Column:
    """The same as ``window_moments`` for very many assets: ``cov`` has a row for each date of the window.

    The covariance is the product of ``cov`` with itself over those dates, and ``rest`` on its diagonal.
    """

    @F.pandas_udf("mu array<double>, cov array<array<double>>, rest array<double>")
    def run(windows: pd.Series) -> pd.DataFrame:
        out = []
        for w in windows:
            x = np.stack(w).astype(float)
            mean = x.mean(axis=0)
            x = (x - mean) / np.sqrt(len(x) - 1)
            out.append((mean, list(x * np.sqrt(1 - shrink)), shrink * (x * x).sum(axis=0)))
        return pd.DataFrame(out, columns=["mu", "cov", "rest"])

    return run(window)


def _by_date(windows: DataFrame, assets: Sequence[str], model: str, grid_size: int, fn: Callable[[np.ndarray], np.ndarray]) -> DataFrame:
    pairs = list(combinations(range(len(assets)), 2))
    first, second = [assets[i] for i, _ in pairs], [assets[j] for _, j in pairs]
    chunk = max(1, CELLS // (grid_size * len(pairs)))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for start in range(0, len(batch), chunk):
                part = batch.iloc[start:start + chunk]
                z = np.stack([np.stack(w) for w in part["window"]]).astype(float)
                rho = fn(z)
                yield pd.DataFrame({
                    "model": model, "ts": np.repeat(part["ts"].to_numpy(), len(pairs)), "s1": first * len(part),
                    "s2": second * len(part), "rho": rho.reshape(-1),
                })

    return spread(windows, "ts").mapInPandas(run, CORR)


def sample_correlation(z: np.ndarray) -> np.ndarray:
    centred = z - z.mean(axis=1, keepdims=True)
    cov = np.einsum("wti,wtj->wij", centred, centred)
    scale = np.sqrt(np.einsum("wii->wi", cov))
    return cov / scale[:, :, None] / scale[:, None, :]


def pair_log_density(rho: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Bivariate normal log density relative to independence."""
    rest = 1 - rho ** 2
    return -0.5 * (np.log(rest) + (x * x - 2 * rho * x * y + y * y) / rest - x * x - y * y)


def conditional_correlation(z: np.ndarray, grid: np.ndarray, include_last: bool) -> np.ndarray:
    """Correlations after each window for the best grid point (a, b, g)."""
    i, j = np.array(list(combinations(range(z.shape[2]), 2))).T
    a, b, g = (p[None, :, None] for p in grid.T)
    n = np.minimum(z, 0.0)
    target = sample_correlation(z)[:, i, j][:, None, :]
    nbar = np.einsum("wti,wtj->wij", n, n) / z.shape[1]
    own_n, pair_n = np.einsum("wii->wi", nbar)[:, None, :], nbar[:, i, j][:, None, :]
    own = np.ones((len(z), len(grid), z.shape[2]))
    both = np.repeat(target, len(grid), axis=1)
    ll, valid = np.zeros(own.shape[:2]), np.ones(own.shape[:2], dtype=bool)
    rho = both
    with np.errstate(all="ignore"):
        for t in range(1, z.shape[1] + (1 if include_last else 0)):
            p, m = z[:, t - 1][:, None, :], n[:, t - 1][:, None, :]
            own = (1 - a - b) - g * own_n + a * p * p + g * m * m + b * own
            both = (1 - a - b) * target - g * pair_n + a * p[..., i] * p[..., j] + g * m[..., i] * m[..., j] + b * both
            rho = both / np.sqrt(own[..., i] * own[..., j])
            valid &= (own > 0).all(axis=2) & (np.abs(rho) < 1).all(axis=2)
            if t < z.shape[1]:
                x, y = z[:, t, i][:, None, :], z[:, t, j][:, None, :]
                ll = ll + pair_log_density(rho, x, y).sum(axis=2)
    best = np.where(valid & ~np.isnan(ll), ll, -np.inf).argmax(axis=1)
    rows = np.arange(len(z))
    out = rho[rows, best]
    return np.where(valid[rows, best][:, None], out, target[:, 0, :])


def dcc(windows: DataFrame, assets: Sequence[str], alphas: Sequence[float] = DCC_GRID[0], betas: Sequence[float] = DCC_GRID[1],
        include_last: bool = True) -> DataFrame:
    """Dynamic conditional correlation known at each date.

    ``include_last=False`` leaves the newest shock of the window unused.
    """
    grid = np.array([(a, b, 0.0) for a, b in product(alphas, betas) if a + b < 0.9999])
    return _by_date(windows, assets, "DCC", len(grid), lambda z: conditional_correlation(z, grid, include_last))


def adcc(windows: DataFrame, assets: Sequence[str], alphas: Sequence[float] = DCC_GRID[0], betas: Sequence[float] = DCC_GRID[1],
         asymmetries: Sequence[float] = ADCC_G, include_last: bool = True) -> DataFrame:
    """The same with a term for joint negative shocks; g = 0 gives the plain form."""
    grid = np.array([p for p in product(alphas, betas, asymmetries) if sum(p) < 0.9999])
    return _by_date(windows, assets, "ADCC", len(grid), lambda z: conditional_correlation(z, grid, include_last))


def rank_correlation(z: np.ndarray) -> np.ndarray:
    """Spearman correlation of each window, ties at their mean rank."""
    below = (z[:, None, :, :] < z[:, :, None, :]).sum(axis=2)
    same = (z[:, None, :, :] == z[:, :, None, :]).sum(axis=2)
    return sample_correlation(below + (same + 1) / 2)


def score_driven_correlation(z: np.ndarray, grid: np.ndarray, include_last: bool, flat: float) -> np.ndarray:
    """Correlations after each window for the best grid point (alpha, beta, nu).

    The state moves on Fisher's scale by the Student-t score towards the rank
    correlation. Nearly equal magnitudes over all pairs fall back to the target.
    """
    i, j = np.array(list(combinations(range(z.shape[2]), 2))).T
    alpha, beta, nu = (p[None, :, None] for p in grid.T)
    target = rank_correlation(z)[:, i, j][:, None, :]
    centre = np.arctanh(np.clip(target, -0.9999, 0.9999))
    f = np.repeat(centre, len(grid), axis=1)
    ll = np.zeros(f.shape[:2])
    steps = z.shape[1]
    for t in range(steps):
        rho = np.tanh(f)
        rest = 1 - rho ** 2
        x, y = z[:, t, i][:, None, :], z[:, t, j][:, None, :]
        q = (x * x - 2 * rho * x * y + y * y) / rest
        ll = ll + (-math.log(2 * math.pi) - 0.5 * np.log(rest) - (nu + 2) / 2 * np.log1p(q / nu)).sum(axis=2)
        if t == steps - 1 and not include_last:
            break
        weight = (nu + 2) / (nu + q)
        score = (rho * rest + weight * ((1 + rho ** 2) * x * y - rho * (x * x + y * y))) / rest
        f = np.clip((1 - alpha - beta) * centre + alpha * score + beta * f, -3.0, 3.0)
    best = ll.argmax(axis=1)
    out = np.tanh(f)[np.arange(len(z)), best]
    degenerate = np.abs(out).std(axis=1) < flat
    return np.where(degenerate[:, None], target[:, 0, :], out)


def score_driven(windows: DataFrame, assets: Sequence[str], alphas: Sequence[float] = GAS_GRID[0], betas: Sequence[float] = GAS_GRID[1],
                 nus: Sequence[float] = GAS_GRID[2], include_last: bool = True, flat: float = 0.02) -> DataFrame:
    """Score-driven correlation known at each date."""
    grid = np.array([p for p in product(alphas, betas, nus) if p[0] + p[1] < 0.9999])
    return _by_date(windows, assets, "GAS", len(grid), lambda z: score_driven_correlation(z, grid, include_last, flat))


# --- matrices ---------------------------------------------------------------------------

def correlation_matrix(corr: DataFrame, assets: Sequence[str], keys: Sequence[str] = ("model", "ts"), bound: float = 1e-6) -> DataFrame:
    """Pair rows of a date as a matrix; pairs not present count as uncorrelated."""
    def cell(i: int, j: int) -> Column:
        a, b = sorted((assets[i], assets[j]))
        rho = F.coalesce(F.max(F.when((F.col("s1") == a) & (F.col("s2") == b), F.col("rho"))), F.lit(0.0))
        return F.lit(1.0) if i == j else F.least(F.greatest(rho, F.lit(bound - 1)), F.lit(1 - bound))

    n = range(len(assets))
    matrix = F.array(*[F.array(*[cell(i, j) for j in n]) for i in n])
    return corr.groupBy(*keys).agg(matrix.alias("matrix"))


def matrix_cells(df: DataFrame, column: str, assets: Sequence[str], keys: Sequence[str], value: str) -> DataFrame:
    """A matrix column as rows ``(s1, s2, value)``."""
    names = F.array(*[F.lit(a) for a in assets])
    rows = df.select(*keys, F.posexplode(column).alias("i", "row"))
    return rows.select(*keys, "i", F.posexplode("row").alias("j", value)).select(
        *keys, names[F.col("i")].alias("s1"), names[F.col("j")].alias("s2"), value)


def shift_to_positive(m: np.ndarray, floor: float, unit_diagonal: bool) -> np.ndarray:
    """Add to the diagonal what the smallest eigenvalue lacks."""
    low = np.linalg.eigvalsh(m)[:, 0]
    out = m + np.where(low < floor, floor - low, 0.0)[:, None, None] * np.eye(m.shape[1])
    if unit_diagonal:
        d = np.sqrt(np.einsum("kii->ki", out))
        out = out / d[:, :, None] / d[:, None, :]
    return out


def floor_eigenvalues(m: np.ndarray, floor: float) -> np.ndarray:
    """Raise small eigenvalues to the floor and rescale to unit diagonal."""
    values, vectors = np.linalg.eigh(m)
    out = np.einsum("kij,kj,klj->kil", vectors, np.maximum(values, floor), vectors)
    d = np.sqrt(np.einsum("kii->ki", out))
    out = out / d[:, :, None] / d[:, None, :]
    return np.where((values[:, 0] < floor)[:, None, None], out, m)


def repair(matrix: Column | str, floor: float = 1e-8, unit_diagonal: bool = True, method: str = "shift") -> Column:
    """Make each matrix of a column positive definite; sound ones are unchanged."""

    @F.pandas_udf("array<array<double>>")
    def run(column: pd.Series) -> pd.Series:
        if column.empty:
            return pd.Series([], dtype=object)
        m = np.stack([np.stack(x) for x in column]).astype(float)
        out = shift_to_positive(m, floor, unit_diagonal) if method == "shift" else floor_eigenvalues(m, floor)
        return pd.Series([list(x) for x in out])

    return run(matrix)


def smallest_root(matrix: Column | str) -> Column:
    """The smallest eigenvalue of each matrix."""

    @F.pandas_udf("double")
    def run(column: pd.Series) -> pd.Series:
        return pd.Series([float(np.linalg.eigvalsh(np.stack(m).astype(float))[0]) for m in column], dtype=float)

    return run(matrix)


def correlation_gap(window: Column | str, matrix: Column | str) -> Column:
    """The largest difference between a window's sample correlations and the stated ones."""

    @F.pandas_udf("double")
    def run(windows: pd.Series, targets: pd.Series) -> pd.Series:
        return pd.Series([float(np.abs(sample_correlation(np.stack(w).astype(float)[None])[0] - np.stack(m).astype(float)).max())
                          for w, m in zip(windows, targets)], dtype=float)

    return run(window, matrix)


def covariance(matrix: Column | str, sigma: Column | str) -> Column:
    """``rho_ij * sigma_i * sigma_j`` over a correlation matrix and a std array."""
    sigma = F.col(sigma) if isinstance(sigma, str) else sigma
    return F.transform(matrix, lambda row, i: F.zip_with(row, sigma, lambda r, s: r * s * sigma[i]))


# --- copula parameters -------------------------------------------------------------------

def copula_degrees(residuals: DataFrame, corr: DataFrame, assets: Sequence[str], window: int = WINDOW,
                   nus: Sequence[float] = (3.0, 4.0, 5.0, 6.0, 8.0, 10.0, 15.0, 20.0, 30.0), minimum: int = 12) -> DataFrame:
    """Degrees of freedom of the bivariate t over the window before each date.

    The density of a date does not depend on the window it is seen from, so
    each grid point is one running sum over dates. Dates without a correlation
    count as uncorrelated; short windows give 8.
    """
    v = F.col("v")
    pairs = list(combinations(range(len(assets)), 2))
    cells = F.array(*[F.struct(F.lit(min(assets[i], assets[j])).alias("s1"), F.lit(max(assets[i], assets[j])).alias("s2"),
                               v[i].alias("x"), v[j].alias("y")) for i, j in pairs])
    rows = wide(residuals, assets).select("ts", F.inline(cells)).join(
        corr.select("ts", "s1", "s2", "rho"), ["ts", "s1", "s2"], "left").withColumn("rho", F.coalesce("rho", F.lit(0.0)))
    rest = 1 - F.col("rho") * F.col("rho")
    q = (F.col("x") * F.col("x") - 2 * F.col("rho") * F.col("x") * F.col("y") + F.col("y") * F.col("y")) / rest
    density = lambda nu: F.sum(-math.log(2 * math.pi) - 0.5 * F.log(rest) - (nu + 2) / 2 * F.log1p(q / nu))
    per_date = rows.groupBy("ts").agg(*[density(nu).alias(f"n{i}") for i, nu in enumerate(nus)])
    per_date = staged(per_date)
    grid = F.array(*[F.struct(F.sum(f"n{i}").alias("ll"), F.lit(-i).alias("i"), F.lit(nu).alias("nu")) for i, nu in enumerate(nus)])
    seen = onto_later(per_date, window).groupBy(F.col("target").alias("ts")).agg(F.count("*").alias("n"), grid.alias("grid"))
    out = per_date.select("ts").join(seen, "ts", "left")
    return out.select("ts", F.when(F.col("n") >= minimum, F.array_max("grid")["nu"]).otherwise(8.0).alias("nu"))


def copula_skew(residuals: DataFrame, degrees: DataFrame, window: int = WINDOW, minimum: int = 12, bound: float = 2.0) -> DataFrame:
    """Skewness per series by moments, ``mean * (nu - 2) / nu``, bounded."""
    w = W.partitionBy("series_id").orderBy("ts").rowsBetween(-window, -1)
    mean = F.when(F.count("value").over(w) >= minimum, F.avg("value").over(w)).otherwise(0.0)
    skew = F.col("mean") * (F.col("nu") - 2) / F.col("nu")
    return (
        residuals.select("series_id", "ts", mean.alias("mean")).join(degrees, "ts")
        .select("series_id", "ts", "nu", F.least(F.greatest(skew, F.lit(-bound)), F.lit(bound)).alias("skew"))
    )
