"""Least squares for very many groups from one distributed aggregation.

Spark sums the cross products of the columns per group (partial aggregation on
the map side, so a hot group costs one row per task). The small symmetric
matrix of each group is then solved in an Arrow batch. Because every model
whose regressors are a subset of the columns is a sub-block of that matrix,
one pass over the data fits a whole bank of nested models.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Layout of a fit: [n, sse, coefficients (0 when unused), standard errors].
HEAD = 2


# Designs with more columns than this sum their products in Arrow batches: a
# few hundred separate aggregates cost more to plan and compile than to run.
JVM_COLUMNS = 12


#: Groups whose matrices a task holds at once, however many rows a batch has.
GROUPS_AT_ONCE = 512


def moments(rows: DataFrame, keys: Sequence[str], xs: Sequence[str], y: str = "y", where: Column | None = None) -> DataFrame:
    """Upper triangle of the cross-product matrix of ``(1, xs..., y)`` per group.

    A row with a NULL in any of the columns counts for none of the sums. How
    many columns there are decides only where the sums are formed.
    """
    cols = ["1D", *[f"`{c}`" for c in (*xs, y)]]
    if where is not None:
        rows = rows.where(where)
    rows = rows.where(" AND ".join(f"{c} IS NOT NULL" for c in cols[1:]))
    if len(cols) > JVM_COLUMNS:
        return vector_moments(rows.select(*keys, F.expr(f"array({', '.join(cols)})").alias("v")), list(keys))
    sums = ", ".join(f"sum({a} * {b})" for i, a in enumerate(cols) for b in cols[i:])
    return rows.groupBy(*keys).agg(F.expr(f"array({sums})").alias("moments"))


def vector_moments(vectors: DataFrame, keys: list[str]) -> DataFrame:
    """The same from vectors ``v`` without NULLs: one matrix product per group and batch, then summed.

    Vectors of one group have one length. Only the partial matrices are
    shuffled, one per group and Arrow batch.
    """
    schema = T.StructType([*[vectors.schema[k] for k in keys], T.StructField("moments", T.ArrayType(T.DoubleType()))])

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            groups = batch.select(keys).to_pandas().groupby(keys, sort=False).indices.values()
            if not groups:
                continue
            sums = []
            for rows in groups:
                x = batch.column(len(keys)).take(pa.array(rows)).flatten().to_numpy(zero_copy_only=False).reshape(len(rows), -1)
                sums.append((x.T @ x)[np.triu_indices(x.shape[1])])
            first = pa.array([rows[0] for rows in groups])
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(i).take(first) for i in range(len(keys))], pa.array(sums, pa.list_(pa.float64()))],
                names=[*keys, "moments"])

    sums = vectors.select(*keys, "v").mapInArrow(partial, schema)
    zero = F.transform(F.element_at("parts", 1), lambda x: F.lit(0.0))
    total = F.aggregate("parts", zero, lambda s, m: F.zip_with(s, m, lambda a, b: a + b))
    return sums.groupBy(*keys).agg(F.collect_list("moments").alias("parts")).select(*keys, total.alias("moments"))


def _unpack(packed: pd.Series, size: int) -> np.ndarray:
    tri = np.stack(packed.to_numpy()).astype(float)
    full = np.zeros((len(tri), size, size))
    rows, cols = np.triu_indices(size)
    full[:, rows, cols] = tri
    full[:, cols, rows] = tri
    return full


def _invert(a: np.ndarray) -> np.ndarray:
    """Inverse of each positive definite matrix, NaN where there is none."""
    out = np.full_like(a, np.nan)
    try:
        np.linalg.cholesky(a)
        return np.linalg.inv(a)
    except np.linalg.LinAlgError:
        for i, m in enumerate(a):
            try:
                np.linalg.cholesky(m)
                out[i] = np.linalg.inv(m)
            except np.linalg.LinAlgError:
                continue
    return out


def solve_models(matrix: np.ndarray, models: Sequence[Sequence[int]], ridge: Sequence[float]) -> np.ndarray:
    """Fits of each model (columns used, penalty) for a stack of matrices."""
    width = matrix.shape[1] - 1
    out = np.full((len(matrix), len(models), HEAD + 2 * width), np.nan)
    n, yy = matrix[:, 0, 0], matrix[:, -1, -1]
    for k, (used, penalty) in enumerate(zip(models, ridge)):
        idx = np.array(used)
        a = matrix[:, idx[:, None], idx[None, :]]
        b = matrix[:, idx, -1]
        shrink = np.diag([0.0 if i == 0 else penalty for i in idx])
        enough = n > (0 if penalty > 0 else len(idx))
        inverse = _invert(np.where(enough[:, None, None], a + shrink, np.nan * a) if not enough.all() else a + shrink)
        coef = np.einsum("gij,gj->gi", inverse, b)
        sse = yy - 2 * np.einsum("gi,gi->g", coef, b) + np.einsum("gi,gij,gj->g", coef, a, coef)
        free = np.where(n > len(idx), n - len(idx), np.nan)
        se = np.sqrt(np.maximum(sse / free, 0)[:, None] * np.maximum(np.einsum("gii->gi", inverse), 0))
        out[:, k, 0], out[:, k, 1] = n, sse
        out[:, k, HEAD:] = 0.0
        out[:, k, HEAD + idx] = coef
        out[:, k, HEAD + width + idx] = se
    return out


def fit(models: Sequence[Sequence[int]], width: int, ridge: float | Sequence[float] = 0.0):
    """Pandas UDF from a moments array to one fit per model.

    ``models`` list the regressor columns used, 0 being the constant; ``width``
    counts the regressors with the constant. Models that cannot be fitted get
    NaN coefficients.
    """
    penalties = list(ridge) if not isinstance(ridge, (int, float)) else [float(ridge)] * len(models)
    chosen = [tuple(m) for m in models]

    @F.pandas_udf("array<array<double>>")
    def run(packed: pd.Series) -> pd.Series:
        if packed.empty:
            return pd.Series([], dtype=object)
        parts = (solve_models(_unpack(packed[lo:lo + GROUPS_AT_ONCE], width + 1), chosen, penalties) for lo in range(0, len(packed), GROUPS_AT_ONCE))
        return pd.Series([list(g) for part in parts for g in part])

    return run


def coefficients(stats: DataFrame, keys: Sequence[str], models: Sequence[Sequence[int]], labels: Sequence[str], width: int,
                 ridge: float | Sequence[float] = 0.0, name: str = "model") -> DataFrame:
    """One row per group and model: ``n, sse, coef, se``."""
    fitted = stats.select(*keys, fit(models, width, ridge)("moments").alias("fits"))
    names = F.split(F.lit("|".join(labels)), r"\|")
    one = fitted.select(*keys, F.posexplode("fits").alias("i", "f")).withColumn(name, names[F.col("i")])
    first = F.col("f")[HEAD]
    return one.where(first.isNotNull() & ~F.isnan(first)).select(
        *keys, name, F.col("f")[0].alias("n"), F.col("f")[1].alias("sse"),
        F.slice("f", HEAD + 1, width).alias("coef"), F.slice("f", HEAD + width + 1, width).alias("se"),
    )


def linear_value(coef: str, xs: Sequence[str]) -> Column:
    """``coef[0] + sum(coef[i] * x_i)`` as one generated expression.

    Rows are expected to be complete. Saying so with a default keeps a later
    test for NULL from being evaluated, term by term, inside the join.
    """
    terms = [f"{coef}[0]", *[f"{coef}[{i}] * `{c}`" for i, c in enumerate(xs, start=1)]]
    return F.expr(f"coalesce({' + '.join(terms)}, double('NaN'))")
