"""Stage tables: Parquet written by one job and read by the next."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelweave.operators.panel import first_per_key, unfinished
from panelweave.session import scratch_path


def write_table(df: DataFrame, path: str, partition_by: Sequence[str] = (), mode: str = "error") -> str:
    """Write a stage table; partition columns become folders that readers can prune."""
    writer = df.write.mode(mode)
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)
    return path


def staged(df: DataFrame) -> DataFrame:
    """Compute a table once and go on from the stored copy.

    For an intermediate that several branches of a plan read: without it each
    branch would scan the raw data again. The copy is a reliable checkpoint in
    the shared folder, survives lost executors and keeps its partitioning.
    """
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(scratch_path(df.sparkSession, "staged"))
    return df.checkpoint()


def read_table(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def write_report(df: DataFrame, path: str, mode: str = "error") -> str:
    """Write a final report table as one CSV file with a header.

    For report tables only: their rows are strategies and averages.
    """
    df.coalesce(1).write.mode(mode).option("header", True).csv(path)
    return path


def exists(spark: SparkSession, path: str) -> bool:
    root = spark._jvm.org.apache.hadoop.fs.Path(path)
    return root.getFileSystem(spark._jsc.hadoopConfiguration()).exists(root)


def grow(spark: SparkSession, path: str, todo: DataFrame, compute: Callable[[DataFrame], DataFrame], keys: Sequence[str] = ("ts",)) -> DataFrame:
    """A store that computes only what it does not hold yet: ``compute`` gets the keys of ``todo`` that are not there.

    Keys are partition folders. A run overwrites just the folders that it computes, so one that was broken off, or is
    repeated, leaves neither gaps nor doubles. Returns the whole store as read back.
    """
    missing = todo.select(*keys).distinct()
    if exists(spark, path):
        missing = unfinished(missing, read_table(spark, path), keys)
    new = compute(staged(missing))
    new.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*keys).parquet(path)
    return read_table(spark, path)


def read_forecasts(spark: SparkSession, path: str, simple: bool = False) -> DataFrame:
    """A forecast pool without empty rows, optionally as simple returns."""
    pool = read_table(spark, path).where(F.col("yhat").isNotNull())
    return pool.withColumn("yhat", F.expm1("yhat")) if simple else pool


def read_strategy(spark: SparkSession, path: str, **names: object) -> DataFrame:
    """Rows of one strategy; equality on partition columns prunes the folders."""
    df = read_table(spark, path)
    for column, value in names.items():
        df = df.where(F.col(column) == F.lit(value))
    return df


def merge_parts(spark: SparkSession, paths: Sequence[str], schema: str, keys: Sequence[str] = ("ts",)) -> DataFrame:
    """Union partial CSV results, keeping the first file's row where they overlap."""
    parts = spark.read.option("header", True).schema(schema).csv(list(paths)).withColumn("part", F.input_file_name())
    return first_per_key(parts, list(keys), ["part"]).drop("part").orderBy(*keys)
