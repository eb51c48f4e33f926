"""Incremental panels and running averages on Structured Streaming.

Every stream runs on what has arrived and stops; the checkpoint lets the next
run continue after the last finished batch.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from panelweave.operators.forecast import ema_paths, per_series
from panelweave.sources.stores import staged

EMA_ROWS = "series_id string, ts date, span int, ema double, late boolean"


def read_stream(spark: SparkSession, path: str, schema, files_per_batch: int | None = None) -> DataFrame:
    reader = spark.readStream.schema(schema)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.parquet(path)


def period_totals(stream: DataFrame, key: str, value: str = "value", period: str = "1 day", delay: str = "2 days") -> DataFrame:
    """Sum per key and period with bounded state; rows later than ``delay`` are dropped with their state.

    ``run_totals`` keeps late rows.
    """
    timed = stream.withColumn("ts", F.col("ts").cast("timestamp"))
    return (
        timed.withWatermark("ts", delay).groupBy(F.window("ts", period).alias("w"), F.col(key).alias("series_id"))
        .agg(F.sum(value).alias("value"))
        .select("series_id", F.to_date("w.start").alias("ts"), "value")
    )


def run_versions(stream: DataFrame, path: str, checkpoint: str) -> None:
    """Write each batch's changed rows as a version of its own.

    The folder is named by the batch and overwritten when a batch is repeated,
    so a lost executor or a restart leaves no duplicate.
    """
    def save(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/version={number}")

    stream.writeStream.outputMode("update").foreachBatch(save).option("checkpointLocation", checkpoint).trigger(
        availableNow=True).start().awaitTermination()


def run_totals(stream: DataFrame, path: str, checkpoint: str, key: str, value: str = "value", unit: str = "day", delay: int = 2) -> None:
    """Sums per key and period from whatever arrives, however late.

    Every batch writes what it adds to its periods as a version of its own, so a late row repairs its period like any
    other row, and no state is held between batches. A second table, ``{path}/batches``, says per batch how many rows
    came more than ``delay`` days after the latest row of the batches before, and how many periods they touch. A version
    is overwritten when its batch is repeated.
    """
    def save(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        before = [v for v in versions(spark, f"{path}/batches") if v < number]
        last = read_versions(spark, f"{path}/batches", before).agg(F.max("last")).first()[0] if before else None
        rows = batch.select(F.col(key).alias("series_id"), F.col("ts").cast("timestamp").alias("at"), F.to_date(F.date_trunc(unit, "ts")).alias("ts"), F.col(value).alias("value"))
        late = F.col("at") < F.lit(last) - F.expr(f"interval {delay} days") if last is not None else F.lit(False)
        sums = staged(rows.groupBy("series_id", "ts").agg(
            F.sum("value").alias("value"), F.count(F.lit(1)).alias("n"), F.count_if(late).alias("n_late"), F.max("at").alias("last")))
        sums.select("series_id", "ts", "value", "n").write.mode("overwrite").parquet(f"{path}/version={number}")
        sums.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.coalesce(F.sum("n_late"), F.lit(0)).alias("n_late"), F.count_if(F.col("n_late") > 0).alias("periods_late"),
                 F.greatest(F.max("last"), F.lit(last).cast("timestamp")).alias("last")).write.mode("overwrite").parquet(f"{path}/batches/version={number}")

    stream.writeStream.outputMode("append").foreachBatch(save).option("checkpointLocation", checkpoint).trigger(
        availableNow=True).start().awaitTermination()


# --- versions, snapshots and what is current ---------------------------------------------

def _numbers(spark: SparkSession, path: str, prefix: str) -> list[int]:
    """Numbers of the finished folders ``{prefix}{number}``, in order."""
    root = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = root.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(root):
        return []
    found = []
    for status in fs.listStatus(root):
        name = status.getPath().getName()
        done = spark._jvm.org.apache.hadoop.fs.Path(status.getPath(), "_SUCCESS")
        if name.startswith(prefix) and name.removeprefix(prefix).isdigit() and fs.exists(done):
            found.append(int(name.removeprefix(prefix)))
    return sorted(found)


def versions(spark: SparkSession, path: str) -> list[int]:
    return _numbers(spark, path, "version=")


def read_versions(spark: SparkSession, path: str, numbers: Sequence[int]) -> DataFrame:
    return spark.read.option("basePath", path).parquet(*[f"{path}/version={n}" for n in numbers])


def snapshot(spark: SparkSession, path: str) -> int | None:
    """The version up to which the newest snapshot holds everything."""
    return max(_numbers(spark, path, "snapshot="), default=None)


def current(spark: SparkSession, path: str, fold: str = "newest") -> DataFrame:
    """One row per (series, period) from the newest snapshot and the versions after it.

    ``fold`` says what versions of a period mean: the ``newest`` stands, or their values ``add`` up.
    """
    return _folded(spark, path, versions(spark, path), snapshot(spark, path), fold)


def _folded(spark: SparkSession, path: str, numbers: Sequence[int], at: int | None, fold: str) -> DataFrame:
    rows = None
    if at is not None:
        rows = spark.read.parquet(f"{path}/snapshot={at}").select("series_id", "ts", "value", F.lit(at).cast("long").alias("version"))
    if later := [v for v in numbers if at is None or v > at]:
        new = read_versions(spark, path, later).select("series_id", "ts", "value", F.col("version").cast("long").alias("version"))
        rows = new if rows is None else rows.unionByName(new)
    if rows is None:
        raise ValueError(f"nothing was written to {path} yet")
    total = F.sum("value") if fold == "add" else F.max_by("value", "version")
    return rows.groupBy("series_id", "ts").agg(total.alias("value"))


def compact(spark: SparkSession, path: str, fold: str = "newest") -> int | None:
    """Fold the newest snapshot and the versions after it into a new snapshot, and say up to which version.

    The snapshot is written aside and renamed when it is whole, so readers see the old one or the new one. A stream may
    go on writing: versions that it adds meanwhile are later than the snapshot.
    """
    numbers, at = versions(spark, path), snapshot(spark, path)
    if not numbers or numbers[-1] == at:
        return at
    aside, upto = f"{path}/_writing-{uuid.uuid4().hex}", numbers[-1]
    _folded(spark, path, numbers, at, fold).write.parquet(aside)
    jvm = spark._jvm.org.apache.hadoop.fs
    fs = jvm.Path(path).getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.rename(jvm.Path(aside), jvm.Path(f"{path}/snapshot={upto}")):
        raise RuntimeError(f"could not publish the snapshot of {path}")
    return upto


def latest(spark: SparkSession, path: str) -> DataFrame:
    """The newest version of every (series, date), from the newest snapshot on."""
    return current(spark, path)


def running_ema(stream: DataFrame, spans: Sequence[int]) -> DataFrame:
    """EMA of each series kept as state between batches.

    Rows of a batch are taken in date order. A row not after the last one seen
    comes too late, since the average has moved past it: it is handed on with
    ``late`` set and its value, for ``repaired_ema`` to put right.
    """
    spans = list(spans)
    alpha = 2.0 / (1.0 + np.asarray(spans, dtype=float))

    def advance(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        rows = pd.concat(list(parts)).sort_values("ts")
        last, ema = state.get if state.exists else (None, None)
        ema = None if ema is None else np.asarray(ema, dtype=float)
        dates, paths, late = [], [], []
        for ts, x in zip(rows["ts"], rows["value"]):
            day = ts.toordinal()
            if last is not None and day <= last:
                late.append((key[0], ts, 0, float(x), True))
                continue
            ema = np.full(len(spans), float(x)) if ema is None else ema + alpha * (x - ema)
            last = day
            dates.append(ts)
            paths.append(ema)
        if last is not None:
            state.update((last, [float(v) for v in ema]))
        if dates:
            yield pd.DataFrame({
                "series_id": key[0], "ts": np.repeat(np.asarray(dates, dtype=object), len(spans)), "span": spans * len(dates),
                "ema": np.concatenate(paths), "late": False})
        if late:
            yield pd.DataFrame(late, columns=["series_id", "ts", "span", "ema", "late"])

    return stream.groupBy("series_id").applyInPandasWithState(
        advance, EMA_ROWS, "last long, ema array<double>", "append", GroupStateTimeout.NoTimeout)


def repaired_ema(out: DataFrame, history: DataFrame, spans: Sequence[int]) -> DataFrame:
    """The stream's averages, with series that had late rows averaged anew over their whole history."""
    spans = list(spans)
    affected = out.where("late").select("series_id").distinct()
    packed = history.join(affected, "series_id", "left_semi").groupBy("series_id").agg(
        F.sort_array(F.collect_list(F.struct("ts", "value"))).alias("s")).select("series_id", F.col("s.ts").alias("ts"), F.col("s.value").alias("value"))

    def one(row) -> pd.DataFrame:
        paths = ema_paths(np.asarray(row.value, dtype=float), spans)
        return pd.DataFrame({"series_id": row.series_id, "ts": np.repeat(np.asarray(row.ts, dtype=object), len(spans)),
                             "span": spans * len(paths), "ema": paths.reshape(-1)})

    anew = per_series(packed, one, "series_id string, ts date, span int, ema double")
    kept = out.where("NOT late").join(affected, "series_id", "left_anti").select("series_id", "ts", "span", "ema")
    return kept.unionByName(anew)


def run_append(stream: DataFrame, path: str, checkpoint: str) -> None:
    """Append new rows to a Parquet folder exactly once."""
    stream.writeStream.outputMode("append").format("parquet").option("path", path).option(
        "checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
