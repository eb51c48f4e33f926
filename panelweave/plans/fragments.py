"""Shared SQL of the check queries: panels, forecasts and losses."""

from __future__ import annotations

import math

from panelweave.config import ASSETS, WINDOW
from panelweave.functions.scalars import ERF_COEFFICIENTS, ERF_P
from panelweave.plans.registry import fragment


def split_sql(ts: str = "ts") -> str:
    return (f"CASE WHEN {ts} < DATE '1998-01-01' THEN 'TRAIN' WHEN {ts} < DATE '2000-01-01' THEN 'TEST' "
            f"WHEN {ts} < DATE '2002-01-01' THEN 'OOS' END")


def p_value_sql(x: str) -> str:
    t = f"(1.0::DOUBLE / (1.0::DOUBLE + {ERF_P}::DOUBLE * abs({x}) / {math.sqrt(2.0)!r}::DOUBLE))"
    poly = "0.0::DOUBLE"
    for a in reversed(ERF_COEFFICIENTS):
        poly = f"(({poly} + {a}::DOUBLE) * {t})"
    return f"({poly} * exp(-({x}) * ({x}) / 2))"


def returns_sql(src: str) -> str:
    return (f"SELECT series_id, ts, r AS value FROM (SELECT series_id, ts, ln(value) - ln(lag(value) OVER "
            f"(PARTITION BY series_id ORDER BY ts)) AS r FROM {src}) AS q WHERE r IS NOT NULL")


def past_sql(n: int) -> str:
    return f"(PARTITION BY series_id ORDER BY ts ROWS BETWEEN {n} PRECEDING AND 1 PRECEDING)"


def sma_sql(q: int) -> str:
    return f"CASE WHEN count(value) OVER {past_sql(q)} = {q} THEN avg(value) OVER {past_sql(q)} END"


def pool_sql(src: str, spans=(3, 6, 12)) -> str:
    parts = [f"SELECT series_id, 'RW' AS model, ts, lag(value) OVER (PARTITION BY series_id ORDER BY ts) AS yhat FROM {src}"]
    parts += [f"SELECT series_id, 'SMA({q})' AS model, ts, {sma_sql(q)} AS yhat FROM {src}" for q in spans]
    return "SELECT * FROM (" + " UNION ALL ".join(parts) + ") AS p WHERE yhat IS NOT NULL"


def loss_sql(pool: str, src: str, where: str) -> str:
    return (f"SELECT f.series_id, f.model, f.ts, r.value AS y, f.yhat, r.value - f.yhat AS e FROM {pool} f "
            f"JOIN {src} r ON f.series_id = r.series_id AND f.ts = r.ts WHERE {where}")


def average_rank_sql(value: str, keys: str) -> str:
    return (f"(rank() OVER (PARTITION BY {keys} ORDER BY {value}) + "
            f"(count(*) OVER (PARTITION BY {keys}, {value}) - 1) / 2.0::DOUBLE)")


IS_OOS = "f.ts >= DATE '2000-01-01'"
IS_TEST = "f.ts >= DATE '1998-01-01' AND f.ts < DATE '2000-01-01'"

fragment("om", """SELECT c_mktsegment AS series_id, last_day(o_orderdate) AS ts, sum(o_totalprice) AS value
 FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_orderdate < (SELECT date_trunc('month', CAST(max(o_orderdate) AS DATE) + 1) FROM orders) GROUP BY 1, 2""")
fragment("omr", returns_sql("om"))
fragment("sm", """SELECT CAST(l_suppkey AS VARCHAR) AS series_id, last_day(l_shipdate) AS ts,
 sum(l_extendedprice) AS value FROM lineitem GROUP BY 1, 2""")
fragment("smr", returns_sql("sm"))
fragment("ld", """SELECT l_returnflag AS series_id, CAST(l_shipdate AS DATE) AS ts, sum(l_extendedprice) AS value
 FROM lineitem GROUP BY 1, 2""")
fragment("ldr", returns_sql("ld"))
fragment("ed", "SELECT event_type AS series_id, CAST(ts AS DATE) AS ts, sum(value) AS value FROM events GROUP BY 1, 2")
fragment("rf_rate", "SELECT last_day(l_shipdate) AS ts, avg(l_discount) / 12 AS rf FROM lineitem GROUP BY 1")

# Forecast pools and out-of-sample losses: suppliers (many series) and segments (the assets).
fragment("pool_s", pool_sql("smr"))
fragment("loss_s", loss_sql("pool_s", "smr", IS_OOS))
fragment("loss_s_test", loss_sql("pool_s", "smr", IS_TEST))
fragment("pool_o", pool_sql("omr"))
fragment("loss_o", loss_sql("pool_o", "omr", IS_OOS))

# Complete dates of the five assets.
fragment("full_dates", f"SELECT ts FROM omr GROUP BY ts HAVING count(DISTINCT series_id) = {len(ASSETS)}")
fragment("omc", "SELECT o.series_id, o.ts, o.value FROM omr o JOIN full_dates d ON o.ts = d.ts")
fragment("omc_rank", f"SELECT series_id, ts, {average_rank_sql('value', 'series_id')} AS value FROM omc")

# Simple returns and volatility of the assets.
fragment("oms", "SELECT series_id, ts, exp(value) - 1 AS value FROM omr")
fragment("vol_std", f"""SELECT series_id, ts, CASE WHEN count(value) OVER {past_sql(WINDOW)} >= 2
 THEN stddev_samp(value) OVER {past_sql(WINDOW)} END AS sigma FROM omr""")
