"""Bootstrap tests of several models: superior ability and confidence sets.

Blocks are circular. Their starts come from integer arithmetic on the
replicate and block numbers, so every engine draws the same ones.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelweave.operators.evaluate import pivot_models, point_loss
from panelweave.operators.forecast import per_series
from panelweave.operators.panel import series_arrays, spread
from panelweave.operators.regression import vector_moments
from panelweave.sources.stores import staged

# The mixing constants of the draws.
REPLICATE_STEP, BLOCK_STEP, RIVAL_STEP = 7919, 104729, 1299709
MULTIPLIER, INCREMENT, MODULUS, DROP = 1103515245, 12345, 2 ** 31, 65536


def block_starts(replicates: np.ndarray, blocks: int, n: int, seed: int) -> np.ndarray:
    """Start positions in ``[0, n)``, one row per replicate."""
    x = (replicates[:, None].astype(np.int64) * REPLICATE_STEP + np.arange(blocks) * BLOCK_STEP + seed) % MODULUS
    for _ in range(2):
        x = (x * MULTIPLIER + INCREMENT) % MODULUS
    return x // DROP % n


def resampled_means(d: np.ndarray, replicates: np.ndarray, block: int, seed: int) -> np.ndarray:
    """Mean of each column of ``d`` in each replicate, from running sums.

    ``d`` is dates by models; blocks cover exactly as many rows as there are dates.
    """
    n = len(d)
    blocks = math.ceil(n / block)
    lengths = np.full(blocks, block)
    lengths[-1] = n - block * (blocks - 1)
    running = np.vstack([np.zeros(d.shape[1]), np.cumsum(np.vstack([d, d]), axis=0)])
    starts = block_starts(replicates, blocks, n, seed)
    return (running[starts + lengths] - running[starts]).sum(axis=1) / n


def loss_arrays(loss: DataFrame, models: Sequence[str], kind: str = "mae") -> DataFrame:
    """Per series the losses of a fixed model list on the dates common to all."""
    cells = [F.max(F.when(F.col("model") == m, point_loss(kind))) for m in models]
    rows = loss.groupBy("series_id", "ts").agg(F.array(*cells).alias("losses"))
    return series_arrays(rows.where(~F.exists("losses", lambda x: x.isNull())), "losses")


def superior_ability(loss: DataFrame, models: Sequence[str], block: int = 15, replicates: int = 10000, seed: int = 42,
                     kind: str = "mae", shared_draws: bool = True, replicates_per_task: int = 500) -> DataFrame:
    """P-value that a benchmark is not worse than the best of its rivals.

    The statistic is the largest mean loss difference; its distribution comes
    from centred block resamples. Replicates are cut into blocks of rows, so
    few series still use many tasks, and only counts are shuffled.
    """
    names = list(models)
    tasks = math.ceil(replicates / replicates_per_task)
    work = spread(loss_arrays(loss, names, kind).withColumn(
        "task", F.explode(F.sequence(F.lit(0), F.lit(tasks - 1)))), "series_id", "task")

    def one(row) -> pd.DataFrame:
        x = np.stack(row.losses).astype(float)
        numbers = np.arange(row.task * replicates_per_task, min((row.task + 1) * replicates_per_task, replicates))
        mean = x.mean(axis=0)
        draws = [resampled_means(x - mean, numbers, block, seed + (0 if shared_draws else RIVAL_STEP * j))
                 for j in (range(1) if shared_draws else range(len(names)))]
        out = []
        for i, name in enumerate(names):
            rivals = [j for j in range(len(names)) if j != i]
            observed = max(mean[i] - mean[j] for j in rivals)
            # Without shared draws each rival's difference has its own resample.
            worst = np.max([(d := draws[0 if shared_draws else j])[:, i] - d[:, j] for j in rivals], axis=0)
            out.append((row.series_id, name, observed, int((worst >= observed).sum()), len(numbers)))
        return pd.DataFrame(out, columns=["series_id", "model", "statistic", "hits", "draws"])

    counts = per_series(work, one, "series_id string, model string, statistic double, hits long, draws long")
    return counts.groupBy("series_id", "model").agg(
        F.first("statistic").alias("statistic"), (F.sum("hits") / F.sum("draws")).alias("p"))


def resampled_blocks(loss: DataFrame, models: Sequence[str], block: int, replicates: int, seed: int, kind: str, replicates_per_task: int = 500) -> DataFrame:
    """``(series_id, part, mean, draws)``: the centred resampled means of a block of replicates, and the mean losses."""
    tasks = math.ceil(replicates / replicates_per_task)
    work = spread(loss_arrays(loss, models, kind).withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(tasks - 1)))), "series_id", "part")

    def one(row) -> pd.DataFrame:
        x = np.stack(row.losses).astype(float)
        numbers = np.arange(row.part * replicates_per_task, min((row.part + 1) * replicates_per_task, replicates))
        mean = x.mean(axis=0)
        return pd.DataFrame([(row.series_id, row.part, mean, list(resampled_means(x - mean, numbers, block, seed)))], columns=["series_id", "part", "mean", "draws"])

    return per_series(work, one, "series_id string, part int, mean array<double>, draws array<array<double>>")


def standing(products: str, mean: str, left: str):
    """Of the models left: the number of the one with the largest t statistic, that statistic, and the scale of each.

    ``products`` are the cross products of ``(1, draws)``. A model's difference to the average of those left is linear in
    the draws, so its variance comes from their covariances, whichever models are left.
    """

    @F.pandas_udf("worst int, t double, scale array<double>")
    def run(packed: pd.Series, means: pd.Series, lefts: pd.Series) -> pd.DataFrame:
        out = []
        for tri, mu, own in zip(packed, means, lefts):
            size, mu, own = len(mu) + 1, np.asarray(mu, dtype=float), np.asarray(own, dtype=int)
            full = np.zeros((size, size))
            full[np.triu_indices(size)] = np.asarray(tri, dtype=float)
            n, first, second = full[0, 0], full[0, 1:], np.triu(full[1:, 1:]) + np.triu(full[1:, 1:], 1).T
            cov = (second / n - np.outer(first / n, first / n))[np.ix_(own, own)]
            scale = np.sqrt(np.maximum(np.diag(cov) - 2 * cov.mean(axis=1) + cov.mean(), 1e-10))
            t = (mu[own] - mu[own].mean()) / scale
            out.append((int(own[t.argmax()]), float(t.max()), scale))
        return pd.DataFrame(out, columns=["worst", "t", "scale"])

    return run(products, mean, left)


def reached(draws: str, left: str, scale: str, t: str):
    """How many replicates of a block have a largest scaled difference of at least ``t``."""

    @F.pandas_udf("long")
    def run(blocks: pd.Series, lefts: pd.Series, scales: pd.Series, ts: pd.Series) -> pd.Series:
        out = []
        for d, own, s, value in zip(blocks, lefts, scales, ts):
            x = np.stack(d).astype(float)[:, np.asarray(own, dtype=int)]
            out.append(int((((x - x.mean(axis=1, keepdims=True)) / np.asarray(s, dtype=float)).max(axis=1) >= value).sum()))
        return pd.Series(out, dtype="int64")

    return run(draws, left, scale, t)


def confidence_set(loss: DataFrame, models: Sequence[str], block: int = 15, replicates: int = 10000, seed: int = 42,
                   level: float = 0.05, kind: str = "mae", replicates_per_task: int = 500) -> DataFrame:
    """Model confidence set by the largest t statistic, with p-values of the models that were dropped; survivors have 1.

    The resampled means are stored in blocks of replicates; no row holds all of a series. Every round sums counts over the
    blocks of the series that still drop models; between rounds a series is a row of a few numbers.
    """
    names = list(models)
    table = staged(resampled_blocks(loss, names, block, replicates, seed, kind, replicates_per_task))
    vectors = table.select("series_id", F.explode("draws").alias("d")).select("series_id", F.concat(F.array(F.lit(1.0)), "d").alias("v"))
    every = F.array(*[F.lit(i) for i in range(len(names))])
    state = table.groupBy("series_id").agg(F.first("mean").alias("mean")).join(vector_moments(vectors, ["series_id"]), "series_id").select(
        "series_id", "mean", "moments", every.alias("left"), F.array(*[F.lit(1.0)] * len(names)).alias("p"), F.lit(True).alias("open"))
    for _ in range(len(names) - 1):
        state = staged(state)
        going = state.where("open").withColumn("s", standing("moments", "mean", "left")).select("series_id", "left", "s.*")
        counts = table.join(going, "series_id").select("series_id", reached("draws", "left", "scale", "t").alias("hits"), F.size("draws").alias("n"))
        values = counts.groupBy("series_id").agg((F.sum("hits") / F.sum("n")).alias("value")).join(going.select("series_id", "worst"), "series_id")
        drops = F.col("value") < level
        state = state.join(values, "series_id", "left").select(
            "series_id", "mean", "moments", F.when(drops, F.array_remove("left", F.col("worst"))).otherwise(F.col("left")).alias("left"),
            F.when(drops, F.transform("p", lambda x, i: F.when(i == F.col("worst"), F.col("value")).otherwise(x))).otherwise(F.col("p")).alias("p"),
            (F.coalesce(drops, F.lit(False)) & (F.size("left") > 2)).alias("open"))
    labels = F.array(*[F.lit(m) for m in names])
    return state.select("series_id", F.posexplode("p").alias("i", "p")).select("series_id", labels[F.col("i")].alias("model"), "p", (F.col("p") == 1.0).alias("in_set"))


def loss_test_table(loss: DataFrame, models: Sequence[str], **options) -> DataFrame:
    """Both tests as rows, models as columns."""
    spa = superior_ability(loss, models, **options).select("series_id", "model", F.lit("s-SPA").alias("statistic"), "p")
    mcs = confidence_set(loss, models, **options).select("series_id", "model", F.lit("MCS").alias("statistic"), "p")
    return pivot_models(spa.unionByName(mcs), models, "p")
