"""Panels ``(series_id STRING, ts DATE, value DOUBLE)`` over the given tables.

Every panel is one aggregation to (series, period), so its rows per series are
bounded by the calendar whatever the size or skew of the raw table: partial
aggregation folds a hot series to one row per period before the shuffle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def orders_monthly(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order value per market segment and month, without a last month that the table covers only in part.

    The last month counts if the table reaches its last day.
    Orders are summed per customer and month before the join, so a customer
    holding a large share of all rows brings at most one row per month to it.
    """
    orders = table(spark, sf_dir, "orders")
    end = orders.agg(F.trunc(F.date_add(F.max("o_orderdate"), 1), "month").cast("timestamp")).scalar()
    orders = (
        orders.where(F.col("o_orderdate") < end)
        .groupBy("o_custkey", F.last_day("o_orderdate").alias("ts"))
        .agg(F.sum("o_totalprice").alias("value"))
    )
    customer = table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment")
    return (
        orders.join(customer, F.col("o_custkey") == F.col("c_custkey"))
        .groupBy(F.col("c_mktsegment").alias("series_id"), "ts")
        .agg(F.sum("value").alias("value"))
    )


def supplier_monthly(spark: SparkSession, sf_dir: str) -> DataFrame:
    return (
        table(spark, sf_dir, "lineitem")
        .groupBy(F.col("l_suppkey").cast("string").alias("series_id"), F.last_day("l_shipdate").alias("ts"))
        .agg(F.sum("l_extendedprice").alias("value"))
    )


def lineitem_daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    return (
        table(spark, sf_dir, "lineitem")
        .groupBy(F.col("l_returnflag").alias("series_id"), F.to_date("l_shipdate").alias("ts"))
        .agg(F.sum("l_extendedprice").alias("value"))
    )


def events_daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    return (
        table(spark, sf_dir, "events")
        .groupBy(F.col("event_type").alias("series_id"), F.to_date("ts").alias("ts"))
        .agg(F.sum("value").alias("value"))
    )


def discount_rate_monthly(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A market-wide monthly rate ``(ts, rf)``: the mean line discount over twelve."""
    return (
        table(spark, sf_dir, "lineitem")
        .groupBy(F.last_day("l_shipdate").alias("ts"))
        .agg((F.avg("l_discount") / 12).alias("rf"))
    )
