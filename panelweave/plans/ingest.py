"""Queries on file cleaning, stage tables and streams."""

from __future__ import annotations

from pyspark.sql import functions as F

from panelweave.config import ASSETS, OOS, TEST, TRAIN, Split
from panelweave.functions import scalars as S
from panelweave.operators import panel as P
from panelweave.operators import windows as N
from panelweave.plans.panels import order_returns, supplier_returns
from panelweave.plans.registry import fragment, query
from panelweave.session import scratch_path
from panelweave.sources import factor_files as X
from panelweave.sources import stores
from panelweave.sources import tables as T
from panelweave.streaming import incremental as I

COLUMNS = [*ASSETS, "RF"]
IN_SAMPLE = Split("IN", TRAIN.start, TEST.end)


def raw_lines(spark, sf):
    """The orders panel as the lines of a factor file, with its usual noise.

    Each month becomes ``YYYYMM,percent...,rate``; title, header, annual rows,
    a line with a missing number and a blank one surround them.
    """
    pct = F.round(100 * S.log_to_simple("value"), 4)
    wide = P.wide(order_returns(spark, sf).withColumn("value", pct), ASSETS)
    months = wide.select(F.concat_ws(
        ", ", F.date_format("ts", "yyyyMM"), F.array_join(F.transform("v", lambda x: x.cast("string")), ", "), F.lit("0.25")).alias("value"))
    years = wide.groupBy(F.year("ts").alias("y")).agg(F.count("*").alias("n")).select(
        F.concat_ws(",", "y", F.lit("1,2,3,4,5"), F.col("n").cast("string")).alias("value"))
    noise = months.agg(F.count("*").alias("n")).select(F.explode(F.array(
        F.lit("This file holds monthly returns"), F.lit(""), F.lit(",Mkt,SMB"), F.lit("199501, 1.0,, 2.0, 3.0, 4.0, 0.2"),
        F.lit("199513, 1, 2, 3, 4, 5, 6"), F.lit("Annual figures"))).alias("value"))
    return noise.unionByName(months).unionByName(years)


def factor_file(spark, sf):
    """The lines written as a text file and read back as one."""
    path = scratch_path(spark, "factors")
    raw_lines(spark, sf).write.text(path)
    return X.read_factor_file(spark, path, COLUMNS)


fragment("raw_pct", """SELECT o.series_id, o.ts, round(100 * (exp(o.value) - 1), 4) AS value FROM omc o""")


@query("factor_file_rows", "SELECT * FROM raw_pct", value=4)
def factor_file_rows(spark, sf):
    return factor_file(spark, sf)


@query("factor_file_period_log", """SELECT series_id, ts, ln(1 + value / 100) AS value FROM raw_pct WHERE ts >= DATE '2000-01-01'
 AND ts < DATE '2002-01-01'""", value=8)
def factor_file_period_log(spark, sf):
    return X.period_returns(factor_file(spark, sf), OOS, log=True)


@query("factor_file_samples", """SELECT series_id, ts, value / 100 AS value, CASE WHEN ts < DATE '2000-01-01' THEN 'in' ELSE 'out' END AS sample
 FROM raw_pct""", value=8)
def factor_file_samples(spark, sf):
    return X.decimal_samples(factor_file(spark, sf), IN_SAMPLE, OOS)


@query("momentum_file_rows", """SELECT 'MOM' AS series_id, last_day(l_shipdate) AS ts, round(avg(l_discount), 6) / 100 AS value FROM lineitem
 GROUP BY 2""", value=8)
def momentum_file_rows(spark, sf):
    rate = T.table(spark, sf, "lineitem").groupBy(F.last_day("l_shipdate").alias("ts")).agg(F.round(F.avg("l_discount"), 6).alias("d"))
    lines = rate.select(F.concat(F.lit("  "), F.date_format("ts", "yyyyMM"), F.lit(" ,  "), F.col("d").cast("string"), F.lit(" ")).alias("value"))
    path = scratch_path(spark, "momentum")
    lines.write.text(path)
    return X.parse_single(spark.read.text(path), "MOM")


@query("panel_projection", "SELECT series_id, ts, value FROM omr", value=8)
def panel_projection(spark, sf):
    """The five assets out of a stored panel that holds other series too, by folder."""
    others = P.month_end(T.lineitem_daily(spark, sf)).groupBy("series_id", "ts").agg(F.sum("value").alias("value"))
    panel = order_returns(spark, sf).unionByName(P.log_returns(others))
    path = stores.write_table(panel, scratch_path(spark, "panel"), ["series_id"])
    return stores.read_table(spark, path).where(F.col("series_id").isin(*ASSETS)).select("series_id", "ts", "value")


@query("stored_forecasts", "SELECT series_id, model, ts, exp(yhat) - 1 AS yhat FROM pool_s", yhat=8)
def stored_forecasts(spark, sf):
    r = supplier_returns(spark, sf)
    pool = N.random_walk(r).unionByName(N.sma_bank(r, (3, 6, 12)).select("series_id", "model", "ts", "yhat"))
    path = stores.write_table(pool, scratch_path(spark, "pool"))
    return stores.read_forecasts(spark, path, simple=True)


@query("merged_parts", "SELECT series_id, ts, value FROM ed", value=4)
def merged_parts(spark, sf):
    """Two overlapping partial results; the first one wins where both have a row."""
    daily = T.events_daily(spark, sf)
    root = scratch_path(spark, "parts")
    first = daily.where("day(ts) <= 20")
    second = daily.where("day(ts) > 10").withColumn("value", F.when(F.dayofmonth("ts") > 20, F.col("value")).otherwise(F.lit(-1.0)))
    for name, part in (("chunk_0", first), ("chunk_1", second)):
        part.write.option("header", True).csv(f"{root}/{name}")
    return stores.merge_parts(spark, [f"{root}/chunk_0", f"{root}/chunk_1"], "series_id string, ts date, value double", ("series_id", "ts"))


@query("stream_daily_totals", "SELECT series_id, ts, value FROM ed", value=4)
def stream_daily_totals(spark, sf):
    """Raw events as a stream into the daily panel."""
    schema = T.table(spark, sf, "events").schema
    root = scratch_path(spark, "totals")
    # As a pattern the path may name one file or a folder of files.
    stream = I.read_stream(spark, f"{sf}/events*.parquet", schema)
    I.run_totals(stream, f"{root}/out", f"{root}/state", "event_type")
    return I.current(spark, f"{root}/out", "add")


EMA_SPANS = (3, 10, 30)
fragment("ld_i", "SELECT *, row_number() OVER (PARTITION BY series_id ORDER BY ts) AS i FROM ld")
fragment("ld_ema", """SELECT series_id, i, CAST(q AS INT) AS span, value AS ema FROM ld_i, (VALUES (3), (10), (30)) AS g(q) WHERE i = 1 UNION ALL
 SELECT r.series_id, s.i, r.span, r.ema + 2.0::DOUBLE / (1 + r.span) * (s.value - r.ema) FROM ld_ema r JOIN ld_i s
 ON r.series_id = s.series_id AND s.i = r.i + 1""")


@query("stream_running_ema", """SELECT r.series_id, s.ts, r.span, r.ema FROM ld_ema r JOIN ld_i s ON r.series_id = s.series_id AND r.i = s.i""", ema=2)
def stream_running_ema(spark, sf):
    """Two deliveries over one checkpoint: the second also brings days of one series that the average has passed."""
    daily = stores.staged(T.lineitem_daily(spark, sf))
    root = scratch_path(spark, "ema")
    held_back = "(series_id = 'A' AND day(ts) = 7)"
    for part in (daily.where(f"ts < DATE '1999-01-01' AND NOT {held_back}"), daily.where(f"ts >= DATE '1999-01-01' OR {held_back}")):
        part.write.mode("append").parquet(f"{root}/in")
        stream = I.read_stream(spark, f"{root}/in", daily.schema)
        I.run_append(I.running_ema(stream, EMA_SPANS), f"{root}/out", f"{root}/state")
    return I.repaired_ema(spark.read.parquet(f"{root}/out"), spark.read.parquet(f"{root}/in"), EMA_SPANS)


@query("stream_resume", "SELECT series_id, ts, value FROM ed", value=4)
def stream_resume(spark, sf):
    """Events arriving in two deliveries; finished work is not repeated."""
    events = T.table(spark, sf, "events")
    root = scratch_path(spark, "resume")
    for part in (events.where("ts < TIMESTAMP '2024-01-15 12:00:00'"), events.where("ts >= TIMESTAMP '2024-01-15 12:00:00'")):
        part.write.mode("append").parquet(f"{root}/in")
        stream = I.read_stream(spark, f"{root}/in", events.schema)
        I.run_totals(stream, f"{root}/out", f"{root}/state", "event_type")
    return I.current(spark, f"{root}/out", "add")


@query("stream_late_totals", "SELECT series_id, ts, value, true AS late_counted FROM ed", value=4)
def stream_late_totals(spark, sf):
    """Three deliveries, the second with rows of twelve days before: their periods are repaired, and the rows are counted.

    Totals are folded into a snapshot between the deliveries.
    """
    events = T.table(spark, sf, "events")
    root = scratch_path(spark, "late")
    old = F.pmod(F.xxhash64("event_id"), F.lit(10)) == 0
    first, rest = F.col("ts") < F.lit("2024-01-13").cast("timestamp"), F.col("ts") >= F.lit("2024-01-22").cast("timestamp")
    for part in (events.where(first & ~old), events.where((first & old) | (~first & ~rest)), events.where(rest)):
        part.write.mode("append").parquet(f"{root}/in")
        I.run_totals(I.read_stream(spark, f"{root}/in", events.schema), f"{root}/out", f"{root}/state", "event_type")
        I.compact(spark, f"{root}/out", "add")
    counted = I.read_versions(spark, f"{root}/out/batches", I.versions(spark, f"{root}/out/batches")).agg(F.sum("n_late").alias("n")).scalar()
    # The latest row of the first delivery is of the 12th: rows of before the 10th, at that hour, come late.
    last = events.where(first & ~old).agg(F.max("ts")).scalar()
    late = events.where(first & old & (F.col("ts") < last - F.expr("interval 2 days"))).agg(F.count(F.lit(1))).scalar()
    return I.current(spark, f"{root}/out", "add").select("series_id", "ts", "value", (counted == late).alias("late_counted"))
