"""Return scenarios from past standardised residuals.

All assets of a past date enter a scenario together, which keeps their joint
behaviour; only scale and mean are those of the date ahead. The residual part
does not depend on the forecast and is shared by all forecasts of a date.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelweave.config import WINDOW
from panelweave.operators import bootstrap as B
from panelweave.operators.dependence import sample_correlation
from panelweave.operators.panel import dates_of, wide

#: Scenarios of a deep set, and consecutive dates that are drawn together.
DRAWS, BLOCK = 5000, 5


def resampled(residuals: DataFrame, assets: Sequence[str], draws: int = DRAWS, block: int = BLOCK, seed: int = 42, least: int = WINDOW,
              dates: DataFrame | None = None) -> DataFrame:
    """``ts, window, times``: a deep set of scenarios for each date, drawn in circular blocks from all residual vectors before it.

    A vector that is drawn often is one row of the window with its number of draws in ``times``: a set has at most ``draws``
    vectors however long the past, and work grows with the dates, not with their square. Dates with fewer than ``least``
    vectors before them have no set; ``dates`` limits the sets to those dates. Starts come from integer arithmetic on the
    numbers of the blocks.
    """
    vectors = wide(residuals, assets)
    every = dates_of(vectors)
    numbered = vectors.select("ts", "v", (F.array_position(every, F.col("ts")) - 1).cast("int").alias("at"))
    targets = numbered.select("ts", F.col("at").alias("n")).where(F.col("n") >= least)
    if dates is not None:
        targets = targets.join(dates.select("ts").distinct(), "ts", "left_semi")
    x = ((F.floor(F.col("q") / block).cast("long") * B.REPLICATE_STEP + seed) % B.MODULUS)
    for _ in range(2):
        x = (x * B.MULTIPLIER + B.INCREMENT) % B.MODULUS
    at = (F.floor(x / B.DROP) % F.col("n") + F.col("q") % block) % F.col("n")
    drawn = targets.withColumn("q", F.explode(F.sequence(F.lit(0), F.lit(draws - 1)))).select("ts", at.cast("int").alias("at")).groupBy("ts", "at").agg(F.count(F.lit(1)).alias("times"))
    rows = drawn.join(numbered.select("at", "v"), "at").groupBy("ts").agg(F.sort_array(F.collect_list(F.struct("at", "v", "times"))).alias("set"))
    return rows.select("ts", F.col("set.v").alias("window"), F.col("set.times").alias("times"))


def residual_scenarios(windows: DataFrame, sigma: DataFrame) -> DataFrame:
    """``ts, scenarios``: window residuals times the volatility vector ``s`` of the date."""
    scaled = F.transform("window", lambda z: F.zip_with(z, F.col("s"), lambda a, b: a * b))
    return windows.join(sigma, "ts").select("ts", scaled.alias("scenarios"))


def shift(scenarios: Column | str, mu: Column | str) -> Column:
    """Add a forecast vector to every scenario."""
    mu = F.col(mu) if isinstance(mu, str) else mu
    return F.transform(scenarios, lambda r: F.zip_with(r, mu, lambda a, b: a + b))


def scenario_rows(df: DataFrame, assets: Sequence[str], keys: Sequence[str] = ("ts",)) -> DataFrame:
    """Long form ``(keys, scen_id, series_id, r)``."""
    names = F.array(*[F.lit(a) for a in assets])
    rows = df.select(*keys, F.posexplode("scenarios").alias("scen", "row"))
    return rows.select(*keys, (F.col("scen") + 1).alias("scen_id"), F.posexplode("row").alias("i", "r")).select(
        *keys, "scen_id", names[F.col("i")].alias("series_id"), "r")


def with_correlation(z: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Windows rotated so that their sample correlation becomes the target.

    Each asset keeps its scale: whitening works on values over their std.
    """
    out = z.copy()
    for k, (w, r) in enumerate(zip(z, target)):
        try:
            own = np.linalg.cholesky(sample_correlation(w[None])[0])
            new = np.linalg.cholesky(r)
        except np.linalg.LinAlgError:
            continue  # too few rows for a full-rank sample: keep the history as it is
        scale = w.std(axis=0, ddof=1)
        out[k] = np.linalg.solve(own, (w / scale).T).T @ new.T * scale
    return out


def recorrelate(window: Column | str, matrix: Column | str) -> Column:
    """Give the residuals of each window a stated correlation matrix."""

    @F.pandas_udf("array<array<double>>")
    def run(windows: pd.Series, targets: pd.Series) -> pd.Series:
        out = [with_correlation(np.stack(w).astype(float)[None], np.stack(m).astype(float)[None])[0]
               for w, m in zip(windows, targets)]
        return pd.Series([list(w) for w in out], dtype=object)

    return run(window, matrix)
