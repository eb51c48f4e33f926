"""One-step forecasts for every series of a panel.

A forecaster maps a return panel to ``Forecast`` rows (series_id, model, ts,
yhat); parameters come from the fit period only and are applied to all dates.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from panelweave.config import TEST, TRAIN, Split
from panelweave.operators import features as X
from panelweave.operators.panel import period_filter, series_arrays
from panelweave.operators.regression import coefficients, linear_value, moments
from panelweave.operators.windows import as_rows, by_series, lag_matrix, random_walk, sma_bank, sma_columns, walk_column
from panelweave.sources.stores import staged

FORECAST = "series_id string, model string, ts date, yhat double"


def in_period(period: Split) -> Column:
    return (F.col("ts") >= F.lit(period.start)) & (F.col("ts") < F.lit(period.end))


def known(c: str) -> Column:
    """True where a number came back from numpy: neither NULL nor NaN."""
    return F.col(c).isNotNull() & ~F.isnan(c)


#: Series whose results a task holds at once, however many rows a batch has.
SERIES_AT_ONCE = 64


def per_series(df: DataFrame, fn: Callable[..., pd.DataFrame], schema: str) -> DataFrame:
    """Apply a numpy helper to each row of a series-array table, a few rows at a time."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for lo in range(0, len(batch), SERIES_AT_ONCE):
                parts = [part for row in batch[lo:lo + SERIES_AT_ONCE].itertuples(index=False) if len(part := fn(row))]
                if parts:
                    yield pd.concat(parts, ignore_index=True)

    return df.mapInPandas(run, schema)


# --- moving averages --------------------------------------------------------------

def ema_paths(values: np.ndarray, spans: Sequence[int]) -> np.ndarray:
    """Recursive EMA of one series for all spans at once, started at its first value."""
    alpha = 2.0 / (1.0 + np.asarray(spans, dtype=float))
    out = np.empty((len(values), len(alpha)))
    state = np.full(len(alpha), values[0])
    for t, x in enumerate(values):
        state = state + alpha * (x - state) if t else state
        out[t] = state
    return out


def ema_bank(panel: DataFrame, spans: Sequence[int] = range(3, 31)) -> DataFrame:
    """EMA(q) of all values before each date, q over the spans.

    Python sees only the value arrays; dates and labels are put to the paths
    inside the JVM.
    """
    spans = list(spans)

    @F.arrow_udf("array<array<double>>")
    def paths(values: pa.Array) -> pa.Array:
        ends = np.concatenate([[0], np.cumsum(pc.list_value_length(values).to_numpy())])
        flat = values.flatten().to_numpy(zero_copy_only=False)
        parts = [ema_paths(flat[a:b], spans)[:-1].T.reshape(-1) for a, b in zip(ends, ends[1:])]
        lengths = np.repeat(np.diff(ends) - 1, len(spans))
        inner = pa.ListArray.from_arrays(
            pa.array(np.concatenate([[0], np.cumsum(lengths)]), pa.int32()), pa.array(np.concatenate([np.empty(0), *parts])))
        return pa.ListArray.from_arrays(pa.array(np.arange(len(values) + 1) * len(spans), pa.int32()), inner)

    labels = F.array(*[F.lit(f"EMA({q})") for q in spans])
    later = F.slice("ts", F.lit(2), F.greatest(F.size("ts") - 1, F.lit(0)))
    bank = series_arrays(panel, "value").select("series_id", later.alias("dates"), paths("value").alias("paths"))
    one = bank.select("series_id", "dates", F.posexplode("paths").alias("i", "path"))
    return one.select("series_id", labels[F.col("i")].alias("model"), F.inline(F.arrays_zip("dates", "path"))).select(
        "series_id", "model", F.col("dates").alias("ts"), F.col("path").alias("yhat"))


#: Steps of a recursion whose states are copied together: a step copies those of its own run only.
RUN = 32


def ema_columns(panel: DataFrame, spans: Sequence[int] = range(3, 31)) -> DataFrame:
    """The panel with a column ``EMA(q)`` of all values before each date for each of the spans, NULL on the first date.

    The recursion is that of ``ema_paths`` but runs inside the JVM, and rows stay in the task that holds their series. A NULL
    counts as NaN.
    """
    spans, kept = list(spans), [c for c in panel.columns if c not in ("series_id", "ts", "value")]
    alphas = F.array(*[F.lit(2.0 / (1.0 + q)) for q in spans])
    numbers = F.transform("value", lambda x: F.coalesce(x.cast("double"), F.lit(float("nan"))))
    runs = F.transform(F.sequence(F.lit(2), F.size("x") - 1, F.lit(RUN)), lambda i: F.slice("x", i, F.least(F.lit(RUN), F.size("x") - i)))
    last = lambda states: F.element_at(states, -1)
    step = lambda states, x: F.array_append(states, F.zip_with(last(states), alphas, lambda state, alpha: state + alpha * (x - state)))
    run = lambda done, own: F.array_append(done, F.slice(F.aggregate(own, F.array(last(last(done))), step), 2, F.size(own)))
    first, none = F.array(F.transform(alphas, lambda _: F.col("x")[0])), F.array(F.lit(None).cast("array<double>"))
    before = F.when(F.size("x") > 2, F.concat(none, F.flatten(F.aggregate(runs, F.array(first), run)))).when(F.size("x") == 2, F.concat(none, first)).otherwise(none)
    columns = ["ts", "value", *kept]
    arrays = series_arrays(panel, "value", *kept).withColumn("x", numbers).select("series_id", *columns, before.alias("state"))
    rows = arrays.select("series_id", F.inline(F.arrays_zip(*columns, "state")))
    return rows.select("series_id", *columns, *[F.col("state")[i].alias(f"EMA({q})") for i, q in enumerate(spans)])


# --- autoregressions ----------------------------------------------------------------

def lag_names(n: int, prefix: str = "x") -> list[str]:
    return [f"{prefix}{k}" for k in range(1, n + 1)]


def predict(rows: DataFrame, coefs: DataFrame, xs: Sequence[str], on: Sequence[str] = ("series_id",)) -> DataFrame:
    return (
        rows.join(coefs.select(*on, "model", "coef"), list(on))
        .select("series_id", "model", "ts", linear_value("coef", xs).alias("yhat"))
    )


def ar_coefficients(lags: DataFrame, order: int, train: Split) -> DataFrame:
    """AR(1)..AR(order) fitted on one common sample per series."""
    models = [list(range(p + 1)) for p in range(1, order + 1)]
    stats = moments(lags, ["series_id"], lag_names(order), where=in_period(train))
    return coefficients(stats, ["series_id"], models, [f"AR({p})" for p in range(1, order + 1)], order + 1)


def ar_forecasts(panel: DataFrame, order: int = 24, train: Split = TRAIN, lags: DataFrame | None = None) -> DataFrame:
    """AR(p) for p up to ``order``, conditional least squares on the fit period.

    ``lags``, where given, are the panel's rows with so many lags, made before.
    """
    lags = lag_matrix(panel, order) if lags is None else lags
    return predict(lags, ar_coefficients(lags, order, train), lag_names(order))


def arma_forecasts(panel: DataFrame, ar: int = 15, ma: int = 14, long_order: int = 24, train: Split = TRAIN,
                   lags: DataFrame | None = None) -> DataFrame:
    """ARMA(p, q) by the two-step regression of Hannan and Rissanen.

    Residuals of a long autoregression stand for the unseen shocks; all orders
    p and q are sub-blocks of one matrix, so one pass fits every pair. Rows with
    their shocks are stored once for the fit and the forecasts.
    """
    order = max(long_order, ar)
    lags = staged(lag_matrix(panel, order)) if lags is None else lags
    long_fit = ar_coefficients(lags, order, train).where(F.col("model") == f"AR({long_order})")
    shocks = lags.join(long_fit.select("series_id", "coef"), "series_id").withColumn(
        "shock", F.col("y") - linear_value("coef", lag_names(order)))
    es = lag_names(ma, "e")
    rows = shocks.select(
        "series_id", "ts", "y", *lag_names(ar),
        *[F.lag("shock", k).over(by_series()).alias(f"e{k}") for k in range(1, ma + 1)],
    ).where(F.col(f"e{ma}").isNotNull())
    rows = staged(rows)
    xs = [*lag_names(ar), *es]
    pairs = [(p, q) for p in range(1, ar + 1) for q in range(1, ma + 1)]
    models = [[0, *range(1, p + 1), *range(ar + 1, ar + q + 1)] for p, q in pairs]
    stats = moments(rows, ["series_id"], xs, where=in_period(train))
    coefs = coefficients(stats, ["series_id"], models, [f"ARMA({p},{q})" for p, q in pairs], len(xs) + 1)
    return predict(rows, coefs, xs)


# --- neighbours, regimes and features -------------------------------------------------

def scaled_lags(panel: DataFrame, lags: int, train: Split) -> DataFrame:
    """Complete rows of lags on the scale of the fit period; constant series drop out."""
    scaled = X.standardise_columns(lag_matrix(panel, lags), lag_names(lags), train)
    return scaled.where(" AND ".join(f"{x} IS NOT NULL" for x in lag_names(lags)))


#: Fit rows that a cell of neighbours holds on average, and distances that a task forms at once.
CELL_ROWS, DISTANCES = 1024, 2_000_000


def distances(x: np.ndarray, to: np.ndarray) -> np.ndarray:
    """Euclidean distances between all rows of two small matrices."""
    out = np.zeros((len(x), len(to)))
    for column in range(x.shape[1]):
        out += (x[:, column, None] - to[None, :, column]) ** 2
    return np.sqrt(out)


def _stacked(column: pa.ListArray | pa.ChunkedArray, rows: int) -> np.ndarray:
    flat = (column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column).flatten()
    return flat.to_numpy(zero_copy_only=False).reshape(rows, -1) if rows else np.empty((0, 1))


def _per_series_batches(rows: DataFrame, schema: str, fn: Callable[[pa.RecordBatch], pa.RecordBatch]) -> DataFrame:
    """Apply a function to every stretch of a batch that belongs to one series."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names = batch.column("series_id").to_pylist()
            edges = [i for i in range(len(names)) if i == 0 or names[i] != names[i - 1]] + [len(names)]
            for lo, hi in zip(edges, edges[1:]):
                yield fn(batch.slice(lo, hi - lo))

    return rows.mapInArrow(run, schema)


def cells(rows: DataFrame, width: int, per_cell: int = CELL_ROWS) -> tuple[DataFrame, DataFrame]:
    """The fit rows of every series dealt to pivots, and per series its cells.

    Pivots are fit rows picked by hash, one for some ``per_cell`` of them; every fit row belongs to the nearest pivot. Rows
    come back with ``cell`` and ``sub``: a cell of many more rows, be they equal, is split by hash. A series' cells are arrays:
    ``pivots`` (one after the other), ``radius``, ``n`` and ``subs``.
    """
    fit = rows.where("fit")
    order = W.partitionBy("series_id").orderBy(F.xxhash64("series_id", "ts"), "ts")
    wanted = fit.groupBy("series_id").agg(F.ceil(F.count(F.lit(1)) / per_cell).alias("wanted"))
    picked = fit.withColumn("pick", F.row_number().over(order)).join(wanted, "series_id").where("pick <= wanted")
    pivots = picked.groupBy("series_id").agg(F.sort_array(F.collect_list(F.struct("pick", "x"))).alias("p")).select("series_id", F.flatten("p.x").alias("pivots"))

    def nearest(batch: pa.RecordBatch) -> pa.RecordBatch:
        apart = distances(_stacked(batch.column("x"), len(batch)), _stacked(batch.column("pivots").slice(0, 1), 1).reshape(-1, width))
        cell = apart.argmin(axis=1)
        return pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("series_id", "ts", "y", "x")), pa.array(cell, pa.int32()), pa.array(apart[np.arange(len(cell)), cell])],
                                          names=["series_id", "ts", "y", "x", "cell", "off"])

    schema = "series_id string, ts date, y double, x array<double>, cell int, off double"
    dealt = staged(_per_series_batches(fit.join(pivots, "series_id").select("series_id", "ts", "y", "x", "pivots"), schema, nearest))
    sizes = dealt.groupBy("series_id", "cell").agg(F.max("off").alias("radius"), F.count(F.lit(1)).alias("n"))
    by_cell = sizes.groupBy("series_id").agg(F.map_from_entries(F.collect_list(F.struct("cell", F.struct("radius", "n")))).alias("m"))
    every = F.sequence(F.lit(0), (F.size("pivots") / width).cast("int") - 1)
    n = lambda c: F.coalesce(F.try_element_at("m", c)["n"], F.lit(0).cast("long"))
    known_cells = staged(pivots.join(by_cell, "series_id").select(
        "series_id", "pivots", F.transform(every, lambda c: F.coalesce(F.try_element_at("m", c)["radius"], F.lit(0.0))).alias("radius"), F.transform(every, n).alias("n"),
        F.transform(every, lambda c: F.greatest(F.lit(1), F.ceil(n(c) / (4 * per_cell)).cast("int"))).alias("subs")))
    sub = F.pmod(F.xxhash64("ts", F.lit("sub")), F.col("subs")[F.col("cell")]).cast("int")
    return dealt.join(known_cells.select("series_id", "subs"), "series_id").select("series_id", "ts", "y", "x", "cell", sub.alias("sub")), known_cells


def _visits(queries: DataFrame, width: int, which: Callable[[np.ndarray, np.ndarray, np.ndarray, pa.RecordBatch], list[np.ndarray]]) -> DataFrame:
    """Queries once for every part of the cells that ``which`` names for them."""
    def go(batch: pa.RecordBatch) -> pa.RecordBatch:
        x, first = _stacked(batch.column("x"), len(batch)), batch.slice(0, 1)
        apart = distances(x, _stacked(first.column("pivots"), 1).reshape(-1, width))
        found = which(apart, _stacked(first.column("radius"), 1)[0], _stacked(first.column("n"), 1)[0], batch)
        subs = _stacked(first.column("subs"), 1)[0].astype(int)
        out = [(i, c, s) for i, own in enumerate(found) for c in own.tolist() for s in range(subs[c])]
        at, cell, sub = (pa.array([o[k] for o in out], pa.int32()) for k in range(3))
        return pa.RecordBatch.from_arrays([*(batch.column(c).take(at) for c in ("series_id", "ts", "x")), cell, sub], names=["series_id", "ts", "x", "cell", "sub"])

    return _per_series_batches(queries, "series_id string, ts date, x array<double>, cell int, sub int", go)


NEAR = "near array<struct<distance:double,neighbour_ts:date,y:double>>"


def _searched(visits: DataFrame, dealt: DataFrame, k: int, exclude_self: bool) -> DataFrame:
    """The ``k`` nearest rows of each part for each query that visits it."""
    def run(asked: pa.Table, own: pa.Table) -> pa.Table:
        own = own.sort_by("ts")
        x, known_rows = _stacked(asked.column("x"), len(asked)), _stacked(own.column("x"), len(own))
        ts, y, dates = own.column("ts").to_pylist(), own.column("y").to_pylist(), asked.column("ts").to_pylist()
        place = {t: i for i, t in enumerate(ts)}
        near, step = [], max(1, DISTANCES // max(1, len(own)))
        for lo in range(0, len(x) if len(own) else 0, step):
            apart = distances(x[lo:lo + step], known_rows)
            if exclude_self:
                for i, t in enumerate(dates[lo:lo + step]):
                    if t in place:
                        apart[i, place[t]] = np.inf
            for row, at in zip(apart, np.argsort(apart, axis=1, kind="stable")[:, :k]):
                near.append([{"distance": float(row[j]), "neighbour_ts": ts[j], "y": y[j]} for j in at.tolist() if np.isfinite(row[j])])
        if not len(own):
            asked = asked.slice(0, 0)
        kind = pa.list_(pa.struct([("distance", pa.float64()), ("neighbour_ts", pa.date32()), ("y", pa.float64())]))
        return asked.select(["series_id", "ts"]).append_column("near", pa.array(near, kind))

    keys = ("series_id", "cell", "sub")
    return visits.groupBy(*keys).cogroup(dealt.groupBy(*keys)).applyInArrow(run, f"series_id string, ts date, {NEAR}")


def _nearest(panel: DataFrame, k: int, lags: int, train: Split, exclude_self: bool, per_cell: int) -> DataFrame:
    """``(series_id, ts, near)``: the up to ``k`` nearest fit-period rows of every row, by distance and then date.

    Each row first looks in the cells around it that hold ``k`` rows; the distance of its k-th finding then rules out, by
    the triangle inequality, all cells that lie further off than it and their radius.
    """
    rows = staged(scaled_lags(panel, lags, train).select("series_id", "ts", "y", F.array(*lag_names(lags)).alias("x"), in_period(train).alias("fit")))
    dealt, known_cells = cells(rows, lags, per_cell)
    dealt, least = staged(dealt), k + (1 if exclude_self else 0)

    def around(apart: np.ndarray, radius: np.ndarray, n: np.ndarray, batch: pa.RecordBatch) -> list[np.ndarray]:
        order = np.argsort(apart, axis=1, kind="stable")
        enough = (np.cumsum(n[order], axis=1) < least).sum(axis=1) + 1
        return [own[:e] for own, e in zip(order, enough)]

    def within(apart: np.ndarray, radius: np.ndarray, n: np.ndarray, batch: pa.RecordBatch) -> list[np.ndarray]:
        reach = np.array([np.inf if r is None else r for r in batch.column("reach").to_pylist()])
        seen = [set(own.tolist()) for own in around(apart, radius, n, batch)]
        near = (apart - radius) * (1 - 1e-12) <= reach[:, None] + 1e-12
        return [np.array([c for c in np.flatnonzero(row) if c not in own], dtype=int) for row, own in zip(near, seen)]

    first = _searched(_visits(rows.select("series_id", "ts", "x").join(known_cells, "series_id"), lags, around), dealt, k, exclude_self)
    best = lambda df: df.groupBy("series_id", "ts").agg(F.slice(F.sort_array(F.flatten(F.collect_list("near"))), 1, k).alias("near"))
    first = staged(best(first))
    reach = F.when(F.size("near") == k, F.element_at("near", -1)["distance"]).alias("reach")
    again = rows.select("series_id", "ts", "x").join(first.select("series_id", "ts", reach), ["series_id", "ts"], "left").join(
        known_cells.where(F.size("n") > 1), "series_id")
    return best(first.unionByName(_searched(_visits(again, lags, within), dealt, k, exclude_self)))


def nearest_neighbours(panel: DataFrame, k: int = 5, lags: int = 6, train: Split = TRAIN, exclude_self: bool = False, per_cell: int = CELL_ROWS) -> DataFrame:
    """The ``k`` fit-period rows closest to each row of its own series."""
    near = _nearest(panel, k, lags, train, exclude_self, per_cell)
    return near.select("series_id", "ts", F.posexplode("near").alias("i", "n")).select(
        "series_id", "ts", (F.col("i") + 1).alias("rank"), F.col("n.neighbour_ts").alias("neighbour_ts"), F.col("n.distance").alias("distance"))


def knn_forecasts(panel: DataFrame, k: int = 5, lags: int = 6, train: Split = TRAIN, exclude_self: bool = False, per_cell: int = CELL_ROWS) -> DataFrame:
    """Mean outcome of the ``k`` nearest fit-period rows on standardised lags."""
    near = _nearest(panel, k, lags, train, exclude_self, per_cell).where(F.size("near") == k)
    mean = F.aggregate("near", F.lit(0.0), lambda s, n: s + n["y"]) / k
    return near.select("series_id", F.lit(f"kNN({k})").alias("model"), "ts", mean.alias("yhat")).where(known("yhat"))


def transition(kind: Column, gamma: Column, c: Column, s: Column) -> Column:
    logistic = 1 / (1 + F.exp(-gamma * (s - c)))
    exponential = 1 - F.exp(-F.abs(gamma) * (s - c) * (s - c))
    return F.when(kind == "LSTAR", logistic).otherwise(exponential)


def regime_moments(rows: DataFrame, xs: Sequence[str], grid: Sequence[tuple[str, float, float]]) -> DataFrame:
    """Cross products of ``(1, lags, regime, regime times lags, y)`` per series and grid point, from one array per series."""
    # Flat arrays: a row of lags for each date would be an object of its own in Python.
    packed = series_arrays(rows.where(F.col("y").isNotNull()), "y", *xs).drop("ts")
    kinds, gammas, centres = (np.array(v) for v in zip(*grid))

    def one(row) -> pd.DataFrame:
        y, x = np.asarray(row.y, dtype=float), np.stack([getattr(row, c) for c in xs], axis=1).astype(float)
        off = x[None, :, 0] - centres.astype(float)[:, None]
        gamma = gammas.astype(float)[:, None]
        with np.errstate(over="ignore"):
            regime = np.where((kinds == "LSTAR")[:, None], 1 / (1 + np.exp(-gamma * off)), 1 - np.exp(-np.abs(gamma) * off * off))[:, :, None]
        both = np.broadcast_to(x, (len(grid), *x.shape))
        ones, outcome = np.ones_like(regime), np.broadcast_to(y[None, :, None], regime.shape)
        design = np.concatenate([ones, both, regime, regime * both, outcome], axis=2)
        sums = np.matmul(design.transpose(0, 2, 1), design)
        upper = np.triu_indices(sums.shape[1])
        return pd.DataFrame({"series_id": row.series_id, "kind": kinds, "gamma": gammas, "centre": centres, "moments": list(sums[:, upper[0], upper[1]])})

    return per_series(packed, one, "series_id string, kind string, gamma double, centre double, moments array<double>")


def star_forecasts(panel: DataFrame, order: int = 5, gammas: Sequence[float] = (1.0, 2.0, 5.0, 10.0),
                   centres: Sequence[float] = (-1.0, -0.5, 0.0, 0.5, 1.0), ridge: float = 0.01,
                   train: Split = TRAIN, test: Split = TEST) -> DataFrame:
    """Smooth-transition autoregressions, best order per kind and series.

    For a given slope and centre the model is linear, so a fixed grid of them
    is fitted by least squares; the designs of the whole grid are formed per series.
    The smallest squared error picks slope and centre, the smallest RMSE on
    the test period picks the order. A small penalty keeps thin regimes stable.
    """
    xs = lag_names(order)
    rows = scaled_lags(panel, order, train)
    grid = [(kind, g, c) for kind in ("LSTAR", "ESTAR") for g in gammas for c in centres]
    gs = [f"g{i}" for i in range(order + 1)]

    def with_regime(df: DataFrame) -> DataFrame:
        df = df.withColumn("g0", transition(F.col("kind"), F.col("gamma"), F.col("centre"), F.col("x1")))
        return df.withColumns({f"g{i}": F.col("g0") * F.col(f"x{i}") for i in range(1, order + 1)})

    keys = ["series_id", "kind", "gamma", "centre"]
    models = [[0, *range(1, p + 1), order + 1, *range(order + 2, order + 2 + p)] for p in range(1, order + 1)]
    stats = regime_moments(rows.where(in_period(train)), xs, grid)
    fits = coefficients(stats, keys, models, [str(p) for p in range(1, order + 1)], 2 * order + 2, ridge, "p")
    best = (
        fits.groupBy("series_id", "kind", "p")
        .agg(F.min_by(F.struct("gamma", "centre", "coef"), F.struct("sse", "gamma", "centre")).alias("b"))
        .select("series_id", "kind", "p", "b.*")
    )
    value = with_regime(rows.join(best, "series_id")).select(
        "series_id", "kind", "p", "ts", "y", linear_value("coef", [*xs, *gs]).alias("yhat"))
    error = (F.col("y") - F.col("yhat")) * (F.col("y") - F.col("yhat"))
    chosen = (
        value.where(in_period(test)).groupBy("series_id", "kind", "p").agg(F.avg(error).alias("mse"))
        .groupBy("series_id", "kind").agg(F.min(F.struct("mse", "p")).alias("b"))
        .select("series_id", "kind", F.col("b.p").alias("p"))
    )
    return value.join(chosen, ["series_id", "kind", "p"], "left_semi").select(
        "series_id", F.concat("kind", F.lit("("), "p", F.lit(")")).alias("model"), "ts", "yhat")


def ridge_on(rows: DataFrame, xs: Sequence[str], label: str, ridge: float, train: Split) -> DataFrame:
    """One ridge regression per series on the given feature columns."""
    stats = moments(rows, ["series_id"], xs, where=in_period(train))
    coefs = coefficients(stats, ["series_id"], [range(len(xs) + 1)], [label], len(xs) + 1, ridge)
    return predict(rows, coefs, xs)


def higher_order_forecasts(panel: DataFrame, lags: int = 6, ridge: float = 1.0, train: Split = TRAIN) -> DataFrame:
    """Regression on the lags and all their squares and products."""
    names = lag_names(lags)
    rows = X.cross_products(scaled_lags(panel, lags, train), names)
    xs = [c for c in rows.columns if c not in ("series_id", "ts", "y")]
    return ridge_on(rows, xs, "HONN", ridge, train)


def radial_centres(panel: DataFrame, k: int = 8, lags: int = 6, train: Split = TRAIN, seed: int = 42) -> list[list[float]]:
    """Centres of the pooled fit-period lag vectors by distributed k-means."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    rows = scaled_lags(period_filter(panel, train), lags, train).select(
        array_to_vector(F.array(*lag_names(lags))).alias("features"))
    model = KMeans(k=k, seed=seed, maxIter=20).fit(rows)
    return [list(map(float, c)) for c in model.clusterCenters()]


def radial_forecasts(panel: DataFrame, centres: Sequence[Sequence[float]], sigma: float = 2.0, ridge: float = 1.0,
                     train: Split = TRAIN) -> DataFrame:
    """Regression on Gaussian bumps around centres shared by all series."""
    lags = len(centres[0])
    rows = X.radial(scaled_lags(panel, lags, train), lag_names(lags), centres, sigma)
    return ridge_on(rows, lag_names(len(centres), "phi"), "RBF", ridge, train)


# --- banks and the registry -------------------------------------------------------------

Forecaster = Callable[[DataFrame], DataFrame]


def linear_bank(panel: DataFrame, spans: Sequence[int] = range(3, 31), ar: int = 24, arma: tuple[int, int] = (15, 14),
                long_order: int = 24, train: Split = TRAIN) -> DataFrame:
    """All moving averages, AR and ARMA models of every series as one table.

    AR and ARMA models of the same number of lags share the stored lag rows.
    """
    order = max(long_order, arma[0])
    lags = staged(lag_matrix(panel, order))
    return bank(panel, [
        lambda p: sma_bank(p, spans), lambda p: ema_bank(p, spans), lambda p: ar_forecasts(p, ar, train, lags if order == ar else None),
        lambda p: arma_forecasts(p, *arma, long_order, train, lags),
    ])


#: Forecasters whose forecasts can stand next to each other as columns of one panel, in the order they are put there.
BESIDE: dict[Forecaster, Forecaster] = {ema_bank: ema_columns, random_walk: walk_column, sma_bank: sma_columns}


def bank(panel: DataFrame, forecasters: Sequence[Forecaster]) -> DataFrame:
    """Union of the forecasts of a list of forecasters, NULL forecasts dropped.

    Those of ``BESIDE`` are made in one pass, in which all forecasts of a series stay in the task that holds its panel: where
    they are all there is, what then groups them by series neither shuffles nor stores them.
    """
    beside = [f for f in BESIDE if list(forecasters).count(f) == 1]
    parts = [f(panel) for f in forecasters if len(beside) < 2 or f not in beside]
    if len(beside) > 1:
        wide = panel = panel.select("series_id", "ts", "value")
        for f in beside:
            wide = BESIDE[f](wide)
        parts.insert(0, as_rows(panel, wide))
    out = None
    for part in parts:
        part = part.select("series_id", "model", "ts", "yhat").where(F.col("yhat").isNotNull())
        out = part if out is None else out.unionByName(part)
    if out is None:
        raise ValueError("no forecasters given")
    return out


REGISTRY: dict[str, Forecaster] = {
    "random_walk": random_walk, "sma": sma_bank, "ema": ema_bank, "ar": ar_forecasts, "arma": arma_forecasts,
    "knn": knn_forecasts, "star": star_forecasts, "higher_order": higher_order_forecasts,
}


def register(name: str, forecaster: Forecaster) -> None:
    """Add a forecaster to the bank by name."""
    REGISTRY[name] = forecaster
