"""Cleaning, alignment and set operations on long panels."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from panelweave.config import SPLITS, TOTAL, Split


def dates_of(df: DataFrame) -> Column:
    """The table's dates as one sorted array, a scalar as long as the calendar."""
    return df.agg(F.sort_array(F.collect_set("ts"))).scalar()


def onto_later(rows: DataFrame, window: int | None) -> DataFrame:
    """Hand every row to the ``window`` dates after its own, or to all of them without a window, as column ``target``.

    Grouping by the target gives what a window over all dates would, with each
    date in a task of its own.
    """
    dates = dates_of(rows)
    later = F.slice(dates, F.array_position(dates, F.col("ts")).cast("int") + 1, F.size(dates) if window is None else F.lit(window))
    return rows.withColumn("target", F.explode(later))


def period_filter(df: DataFrame, period: Split) -> DataFrame:
    """Rows with ``start <= ts < end``; the bounds reach the Parquet scan."""
    return df.where((F.col("ts") >= F.lit(period.start)) & (F.col("ts") < F.lit(period.end)))


def split_of(ts: Column | str = "ts", splits: Sequence[Split] = SPLITS) -> Column:
    """Name of the split a date falls in. The splits are constants: no join."""
    ts = F.col(ts) if isinstance(ts, str) else ts
    out = F.lit(None).cast("string")
    for s in reversed(splits):
        out = F.when((ts >= F.lit(s.start)) & (ts < F.lit(s.end)), F.lit(s.name)).otherwise(out)
    return out


def split_counts(df: DataFrame, splits: Sequence[Split] = (TOTAL, *SPLITS)) -> DataFrame:
    """Number of distinct periods per split, with its first and last date."""
    member = F.array_compact(
        F.array(*[
            F.when((F.col("ts") >= F.lit(s.start)) & (F.col("ts") < F.lit(s.end)), F.lit(s.name)) for s in splits
        ])
    )
    return (
        df.select("ts").distinct()
        .select(F.explode(member).alias("dataset"), "ts")
        .groupBy("dataset")
        .agg(F.min("ts").alias("start_date"), F.max("ts").alias("end_date"), F.count("*").alias("periods"))
    )


def split_problems(df: DataFrame) -> DataFrame:
    """Findings in a table ``Splits(name, start, end)``; empty when it is sound.

    Reports a split outside TOTAL, a split that overlaps the one before it and
    a gap between neighbours (days that belong to no split).
    """
    # A splits table holds one row per split, so one window over it is enough.
    every = W.partitionBy(F.lit(0))
    of_total = F.col("name") == TOTAL.name
    parts = (
        df.withColumn("total_start", F.max(F.when(of_total, F.col("start"))).over(every))
        .withColumn("total_end", F.max(F.when(of_total, F.col("end"))).over(every))
        .where(~of_total)
    )
    order = W.partitionBy("total_start", "total_end").orderBy("start")
    checked = parts.withColumn("previous_end", F.lag("end").over(order)).select(
        "name",
        F.explode(F.array_compact(F.array(
            F.when(F.col("start") >= F.col("end"), F.lit("empty")),
            F.when((F.col("start") < F.col("total_start")) | (F.col("end") > F.col("total_end")), F.lit("outside")),
            F.when(F.col("start") < F.col("previous_end"), F.lit("overlap")),
            F.when(F.col("start") > F.col("previous_end"), F.lit("gap")),
        ))).alias("problem"),
    )
    return checked


def check_splits(splits: Sequence[Split], total: Split = TOTAL) -> None:
    """Raise when a split leaves TOTAL, overlaps its neighbour or leaves a gap."""
    ordered = sorted(splits, key=lambda s: s.start)
    for s in ordered:
        if not (total.start <= s.start < s.end <= total.end):
            raise ValueError(f"split {s.name} is not inside {total.name}")
    for before, after in zip(ordered, ordered[1:]):
        if before.end != after.start:
            raise ValueError(f"splits {before.name} and {after.name} overlap or leave a gap")


def month_end(df: DataFrame) -> DataFrame:
    return df.withColumn("ts", F.last_day("ts"))


def log_returns(panel: DataFrame) -> DataFrame:
    """``ln(value / previous value)``, first row and levels that are NaN, infinite or not positive dropped."""
    order = W.partitionBy("series_id").orderBy("ts")
    level = F.when((F.col("value") > 0) & (F.col("value") < float("inf")), F.col("value"))
    return (
        panel.withColumn("level", level)
        .withColumn("r", F.log(F.col("level")) - F.log(F.lag("level").over(order)))
        .where(F.col("r").isNotNull())
        .select("series_id", "ts", F.col("r").alias("value"))
    )


def complete_dates(panel: DataFrame) -> DataFrame:
    """Rows of the dates on which every series of the panel has a value."""
    n_series = panel.agg(F.count_distinct("series_id")).scalar()
    full = (
        panel.where(F.col("value").isNotNull())
        .groupBy("ts").agg(F.count_distinct("series_id").alias("n"))
        .where(F.col("n") == n_series).select("ts")
    )
    return panel.join(full, "ts", "left_semi")


def calendar(panel: DataFrame) -> DataFrame:
    """Every month end from the first to the last date of the panel."""
    bounds = panel.agg(F.min("ts").alias("first"), F.max("ts").alias("last"))
    months = F.sequence(F.trunc("first", "month"), F.trunc("last", "month"), F.expr("interval 1 month"))
    return bounds.select(F.explode(months).alias("m")).select(F.last_day("m").alias("ts"))


def on_calendar(panel: DataFrame) -> DataFrame:
    """One row per series and month between its first and last date.

    The months come from each series' own bounds through a generator, so the
    fill needs no product of series and calendar.
    """
    months = F.sequence(F.trunc("first", "month"), F.trunc("last", "month"), F.expr("interval 1 month"))
    grid = (
        panel.groupBy("series_id").agg(F.min("ts").alias("first"), F.max("ts").alias("last"))
        .select("series_id", F.explode(months).alias("m"))
        .select("series_id", F.last_day("m").alias("ts"))
    )
    return grid.join(panel, ["series_id", "ts"], "left")


def reindex(df: DataFrame, dates: DataFrame) -> DataFrame:
    """Left join of values by date onto a given list of dates."""
    return dates.select("ts").join(df, "ts", "left")


def first_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Drop duplicates of ``keys``, keeping the first row by ``order``."""
    rest = [c for c in df.columns if c not in keys]
    ordered = [*order, *[c for c in rest if c not in order]]
    return (
        df.groupBy(*keys).agg(F.min(F.struct(*ordered)).alias("row"))
        .select(*keys, *[F.col("row")[c].alias(c) for c in rest])
        .select(*df.columns)
    )


def common_dates(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.select("ts").intersect(b.select("ts"))


def unfinished(todo: DataFrame, done: DataFrame, keys: Sequence[str] = ("ts",)) -> DataFrame:
    """Rows whose keys are not in the output yet (resume of a batch run)."""
    return todo.join(done.select(*keys).distinct(), list(keys), "left_anti")


def rename_series(df: DataFrame, names: dict[str, str], *columns: str) -> DataFrame:
    """Map series names by a fixed dictionary, leaving unknown names alone."""
    if not names:
        return df
    table = F.create_map(*[F.lit(x) for pair in names.items() for x in pair])
    for c in columns:
        df = df.withColumn(c, F.coalesce(F.try_element_at(table, F.col(c)), F.col(c)))
    return df


def wide(panel: DataFrame, assets: Sequence[str], name: str = "v") -> DataFrame:
    """One row per date with the values of a short fixed asset list as an array.

    Dates on which an asset is missing are dropped. The list is given, so the
    pivot needs no extra job and the row width is fixed by the caller.
    """
    cols = [F.max(F.when(F.col("series_id") == a, F.col("value"))) for a in assets]
    return (
        panel.where(F.col("series_id").isin(*assets)).groupBy("ts").agg(F.array(*cols).alias(name))
        .where(~F.exists(name, lambda x: x.isNull()))
    )


def whole(panel: DataFrame, name: str = "v") -> DataFrame:
    """One row per date with the values of all series of the panel as an array, in the order of their names.

    Dates on which a series is missing are dropped, so all of them where one has no name. The row is as wide as the panel
    has series; nothing but their number is looked up beforehand.
    """
    n = panel.agg(F.count_distinct("series_id") + F.max(F.col("series_id").isNull().cast("int"))).scalar()
    known = panel.where("series_id is not null and value is not null")
    packed = F.sort_array(F.collect_list(F.struct("series_id", "value")))["value"]
    return known.groupBy("ts").agg(packed.alias(name)).where(F.size(name) == n)


def series_arrays(panel: DataFrame, *columns: str) -> DataFrame:
    """One row per series holding its dates and values as sorted arrays.

    A panel has one row per (series, period), so the length of the arrays is
    bounded by the calendar, not by the data volume.
    """
    fields = ("ts", *columns)
    packed = F.sort_array(F.collect_list(F.struct(*fields)))
    return (
        spread(panel.select("series_id", *fields), "series_id").groupBy("series_id").agg(packed.alias("s"))
        .select("series_id", *[F.col("s")[c].alias(c) for c in fields])
    )


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Hash-partition by the keys into as many tasks as the session shuffles to.

    For stages that spend much CPU on few bytes: adaptive execution merges
    small partitions by size and would leave most cores idle. Later windows and
    aggregations on the same keys reuse this partitioning.
    """
    spark = df.sparkSession
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    return df.repartition(tasks, *keys)
