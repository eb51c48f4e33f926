"""Descriptive statistics, correlation matrices and coverage of panels."""

from __future__ import annotations

from collections.abc import Sequence
from itertools import combinations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from panelweave.functions.scalars import ratio
from panelweave.operators.panel import wide
from panelweave.operators.windows import average_rank
from panelweave.sources.stores import staged


def describe(panel: DataFrame) -> DataFrame:
    """Moments and the Jarque-Bera test per series, in one aggregation."""
    v, n = F.col("value"), F.col("n")
    base = panel.groupBy("series_id").agg(
        F.count(v).alias("n"),
        F.avg(v).alias("mean"),
        F.percentile(v, 0.5).alias("median"),
        F.stddev_samp(v).alias("std"),
        F.skewness(v).alias("g1"),
        (F.kurtosis(v) + 3).alias("kurtosis"),
    )
    jb = n / 6 * (F.col("g1") * F.col("g1") + (F.col("kurtosis") - 3) * (F.col("kurtosis") - 3) / 4)
    corrected = F.when(n > 2, F.col("g1") * F.sqrt(n * (n - 1)) / F.when(n > 2, n - 2))
    return base.select(
        "series_id", "n", "mean", "median", "std", corrected.alias("skewness"), "kurtosis",
        jb.alias("jarque_bera"), F.exp(-jb / 2).alias("jb_p"),
    )


def pair_table(assets: Sequence[str], cell) -> Column:
    """An array of ``(s1, s2, rho)`` with one entry per unordered pair."""
    return F.array(*[
        F.struct(F.lit(a).alias("s1"), F.lit(b).alias("s2"), cell(i, j).alias("rho"))
        for (i, a), (j, b) in combinations(enumerate(assets), 2)
    ])


def pearson_matrix(panel: DataFrame, assets: Sequence[str]) -> DataFrame:
    """Correlation of every pair of a fixed asset list.

    The assets become columns of one row per date, so all pairs are ordinary
    aggregates of a single pass with map-side combine; no self-join.
    """
    v = F.col("v")
    return (
        wide(panel, assets)
        .agg(pair_table(assets, lambda i, j: F.corr(v[i], v[j])).alias("pairs"))
        .select(F.inline("pairs"))
    )


def spearman_matrix(panel: DataFrame, assets: Sequence[str]) -> DataFrame:
    v = F.col("v")
    cells = F.array(*[F.struct(F.lit(a).alias("series_id"), v[i].alias("value")) for i, a in enumerate(assets)])
    # Back to rows so that each asset is ranked in its own window partition.
    complete = wide(panel, assets).select("ts", F.inline(cells))
    ranked = complete.select("series_id", "ts", average_rank("value", ["series_id"]).alias("value"))
    return pearson_matrix(ranked, assets)


def correlation_target(panel: DataFrame, assets: Sequence[str]) -> DataFrame:
    """Sample covariance of every pair scaled to unit diagonal."""
    v = F.col("v")

    def cell(i: int, j: int) -> Column:
        return F.covar_samp(v[i], v[j]) / F.sqrt(F.var_samp(v[i]) * F.var_samp(v[j]))

    return wide(panel, assets).agg(pair_table(assets, cell).alias("pairs")).select(F.inline("pairs"))


def negative_moment(panel: DataFrame, assets: Sequence[str]) -> DataFrame:
    """Uncentred second moment of the negative parts, divided by all rows."""
    v = F.col("v")

    def cell(i: int, j: int) -> Column:
        return F.avg(F.least(v[i], F.lit(0.0)) * F.least(v[j], F.lit(0.0)))

    return wide(panel, assets).agg(pair_table(assets, cell).alias("pairs")).select(F.inline("pairs"))


def pair_products(panel: DataFrame, assets: Sequence[str]) -> DataFrame:
    """``x_i * x_j`` per date for the pairs of a fixed asset list."""
    v = F.col("v")
    return wide(panel, assets).select("ts", F.inline(pair_table(assets, lambda i, j: v[i] * v[j])))


#: Series on either side of a tile, and dates in one of its parts.
TILE_SERIES, TILE_DATES = 512, 512
#: Blocks that meet in pairs, and bytes of values that a block may hold: of more there are more blocks.
BLOCKS, BLOCK_BYTES = 24, 64_000_000


def _matrices(panel: DataFrame, blocks: int, chunks: int) -> DataFrame:
    """The values of a block of series over a part of the dates as one row: names, dates, and the matrix as bytes."""
    def pack(rows: pa.Table) -> pa.Table:
        names, dates = pc.unique(rows.column("series_id")).sort(), pc.unique(rows.column("ts")).sort()
        grid = np.full((len(names), len(dates)), np.nan)
        grid[pc.index_in(rows.column("series_id"), names).to_numpy(), pc.index_in(rows.column("ts"), dates).to_numpy()] = rows.column("value").to_numpy()
        return pa.table({"block": rows.column("block").slice(0, 1), "chunk": rows.column("chunk").slice(0, 1), "names": pa.array([names.to_pylist()], pa.list_(pa.string())),
                         "dates": pa.array([dates.cast(pa.int32()).to_pylist()], pa.list_(pa.int32())), "grid": pa.array([grid.tobytes()], pa.binary())})

    placed = panel.select("series_id", "ts", "value", F.pmod(F.xxhash64("series_id"), F.lit(blocks)).cast("int").alias("block"),
                          F.pmod(F.xxhash64("ts"), F.lit(chunks)).cast("int").alias("chunk"))
    return placed.groupBy("block", "chunk").applyInArrow(pack, "block int, chunk int, names array<string>, dates array<int>, grid binary")


def _whole(rows: pa.Table, dates: np.ndarray) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Names of a block in order, its values by series and date, NaN for none, and the rows' places among the names: complete series come first."""
    parts = [(n, d, np.frombuffer(g).reshape(len(n), len(d))) for n, d, g in zip(*(rows.column(k).to_pylist() for k in range(3, 6)))]
    names = sorted({n for own, _, _ in parts for n in own})
    place, grid = {n: i for i, n in enumerate(names)}, np.full((len(names), len(dates)), np.nan)
    for own, days, values in parts:
        grid[np.ix_([place[n] for n in own], np.searchsorted(dates, days))] = values
    order = np.argsort(np.isnan(grid).any(axis=1), kind="stable")
    return names, grid[order], order


def _tile(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each pair of rows its correlation and common dates."""
    if not (np.isnan(x).any() or np.isnan(y).any()):
        n, sx, sy, sxx, syy = float(x.shape[1]), x.sum(axis=1)[:, None], y.sum(axis=1)[None], (x * x).sum(axis=1)[:, None], (y * y).sum(axis=1)[None]
        sxy = x @ y.T
    else:
        p, q = (~np.isnan(x)).astype(float), (~np.isnan(y)).astype(float)
        x, y = np.nan_to_num(x), np.nan_to_num(y)
        n, sx, sy, sxx, syy, sxy = p @ q.T, x @ q.T, p @ y.T, (x * x) @ q.T, p @ (y * y).T, x @ y.T
    vx, vy = n * sxx - sx * sx, n * syy - sy * sy
    sound = (n >= 3) & (vx > 1e-12 * np.maximum(n * sxx, 1e-300)) & (vy > 1e-12 * np.maximum(n * syy, 1e-300))
    return np.where(sound, (n * sxy - sx * sy) / np.sqrt(np.where(sound, vx * vy, 1.0)), np.nan), np.broadcast_to(n, sxy.shape)


class Strongest:
    """The ``k`` partners of each series with the largest absolute correlation so far; equal ones go by the partner's place."""

    def __init__(self, series: int, k: int):
        self.k, self.size, self.place, self.rho, self.n = k, np.full((series, k), -1.0), np.zeros((series, k), int), np.zeros((series, k)), np.zeros((series, k), int)

    def meet(self, lo: int, rho: np.ndarray, n: np.ndarray, places: np.ndarray) -> None:
        """Correlations of the series from ``lo`` on with partners at the given places; NaN for none."""
        size, k = np.where(np.isnan(rho), -1.0, np.abs(rho)), self.k
        own = slice(lo, lo + len(rho))
        least = self.size[own, -1]
        if least.min(initial=0.0) < 0 and size.shape[1] > k:
            least = np.maximum(least, np.partition(size, -k, axis=1)[:, -k])
        i, j = np.nonzero((size >= least[:, None]) & (size >= 0))
        if not len(i):
            return
        row = np.unique(i)
        old_row, old = np.nonzero(self.size[lo + row] >= 0)
        old_at = lo + row[old_row]
        at = np.concatenate([old_at, lo + i])
        columns = [np.concatenate([a[old_at, old], b]) for a, b in ((self.size, size[i, j]), (self.place, places[j]), (self.rho, rho[i, j]), (self.n, n[i, j]))]
        order = np.lexsort((columns[1], -columns[0], at))
        at = at[order]
        rank = np.arange(len(at)) - np.searchsorted(at, at)
        kept = rank < k
        for held, column in zip((self.size, self.place, self.rho, self.n), columns):
            held[at[kept], rank[kept]] = column[order][kept]


def strongest_partners(panel: DataFrame, k: int = 5, tile_series: int = TILE_SERIES, tile_dates: int = TILE_DATES) -> DataFrame:
    """The ``k`` partners of every series with the largest absolute correlation over common dates: ``(series_id, rank, partner, rho, n)``.

    For very many series: all pairs are formed, but in tiles. A block of series is a matrix, and two blocks meet in a task
    of their own. There are a fixed number of blocks as long as they fit, so that what is sent grows with the series and not
    with their pairs; a task goes through its pairs tile by tile, where products of matrices give all their sums, and
    only the ``k`` strongest of a series leave it. Pairs with fewer than three common dates, or a constant side, have no
    correlation. Equal ones go by name.
    """
    means = panel.groupBy("series_id").agg(F.avg("value").alias("mean"))  # keeps sums of squares small
    centred = panel.where(F.col("value").isNotNull()).join(means, "series_id").select("series_id", "ts", (F.col("value") - F.col("mean")).alias("value"))
    size = panel.agg(F.count_distinct("series_id").alias("series"), F.count_distinct("ts").alias("dates")).first()
    blocks = max(1, min(BLOCKS, -(-size.series // tile_series)), -(-size.series * size.dates * 8 // BLOCK_BYTES))
    chunks = max(1, -(-size.dates // tile_dates))
    packed = staged(_matrices(centred, blocks, chunks))
    every = lambda lo, hi: F.explode(F.sequence(lo, hi))
    left = packed.withColumn("i", F.col("block")).withColumn("j", every(F.col("block"), F.lit(blocks - 1)))
    right = packed.withColumn("j", F.col("block")).withColumn("i", every(F.lit(0), F.col("block")))

    def best(a: pa.Table, b: pa.Table) -> pa.Table:
        out = [[], [], [], []]
        if len(a) and len(b):
            dates = np.unique([d for side in (a, b) for days in side.column(4).to_pylist() for d in days])
            same = a.column(0)[0] == a.column(1)[0]
            one = _whole(a, dates)
            two = one if same else _whole(b, dates)
            (_, x, at_x), (_, y, at_y) = one, two
            found = Strongest(len(x), k)
            others = found if same else Strongest(len(y), k)
            for lo in range(0, len(x), tile_series):
                for low in range(lo if same else 0, len(y), tile_series):
                    rho, n = _tile(x[lo:lo + tile_series], y[low:low + tile_series])
                    if same and lo == low:
                        np.fill_diagonal(rho, np.nan)
                    found.meet(lo, rho, n, at_y[low:low + tile_series])
                    if not (same and lo == low):
                        others.meet(low, rho.T, n.T, at_x[lo:lo + tile_series])
            for (names, _, place), (partners, _, _), held in ((one, two, found), *([] if same else [(two, one, others)])):
                row, rank = np.nonzero(held.size >= 0)
                names, partners = np.array(names, object), np.array(partners, object)
                for column, values in zip(out, (names[place[row]], partners[held.place[row, rank]], held.rho[row, rank], held.n[row, rank])):
                    column.extend(values.tolist())
        return pa.table([pa.array(c, t) for c, t in zip(out, (pa.string(), pa.string(), pa.float64(), pa.int64()))], names=["series_id", "partner", "rho", "n"])

    columns = ("chunk", "names", "dates", "grid")
    right = right.select(F.col("i").alias("i2"), F.col("j").alias("j2"), *[F.col(c).alias(f"{c}2") for c in columns])
    tiles = left.select("i", "j", *columns).groupBy("i", "j").cogroup(right.groupBy("i2", "j2"))
    found = tiles.applyInArrow(best, "series_id string, partner string, rho double, n bigint")
    order = W.partitionBy("series_id").orderBy(F.desc(F.abs("rho")), "partner")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("series_id", "rank", "partner", "rho", "n")


def coverage(panel: DataFrame) -> DataFrame:
    """How many periods have all the panel's series, and how many periods there are."""
    n_series = panel.agg(F.count_distinct("series_id").alias("n"))
    per_date = panel.groupBy("ts").agg(F.count("value").alias("n"))
    whole = F.count_if(F.col("n") == n_series.scalar())
    return per_date.agg(whole.alias("complete"), F.count("*").alias("periods"), ratio(whole, F.count("*")).alias("share"))
