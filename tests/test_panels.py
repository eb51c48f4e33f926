"""Cleaning, splits, windows, files and streams on hand-made cases."""

import datetime as dt

import numpy as np
import pandas as pd
import pytest
from conftest import months
from pyspark.sql import functions as F

from panelweave.config import SPLITS, TEST, TRAIN, Split
from panelweave.functions import scalars as S
from panelweave.operators import describe as D
from panelweave.operators import features as X
from panelweave.operators import panel as P
from panelweave.operators import windows as N
from panelweave.sources import factor_files, stores
from panelweave.streaming import incremental as I


def values(df, column, *order):
    return [r[column] for r in df.orderBy(*(order or ("series_id", "ts"))).collect()]


def test_splits_cover_every_day_once():
    P.check_splits(SPLITS)
    with pytest.raises(ValueError, match="gap"):
        P.check_splits([TRAIN, Split("TEST", dt.date(1998, 1, 2), TEST.end)])
    with pytest.raises(ValueError, match="inside"):
        P.check_splits([Split("X", dt.date(1990, 1, 1), dt.date(1996, 1, 1))])


def test_border_dates(spark):
    days = [dt.date(1997, 12, 31), dt.date(1998, 1, 1), dt.date(1999, 12, 31), dt.date(2000, 1, 1)]
    df = spark.createDataFrame([(d,) for d in days], "ts date").withColumn("s", P.split_of())
    assert values(df, "s", "ts") == ["TRAIN", "TEST", "TEST", "OOS"]


def test_returns_skip_bad_levels(make_panel):
    r = P.log_returns(make_panel(a=[1, 2, 0, 4, 8, -1], b=[5]))
    assert values(r, "value") == pytest.approx([np.log(2), np.log(2)])


def test_clip_and_negative_part_keep_null(spark):
    df = spark.createDataFrame([(None,), (3.0,), (-3.0,)], "x double").select(
        S.clip("x", -1, 1).alias("c"), S.negative_part("x").alias("n"))
    assert [tuple(r) for r in df.collect()] == [(None, None), (1.0, 0.0), (-1.0, -3.0)]


def test_p_value_close_to_normal(spark):
    df = spark.createDataFrame([(0.0,), (1.959964,), (-2.575829,)], "x double").select(S.two_sided_p("x").alias("p"))
    assert [r.p for r in df.collect()] == pytest.approx([1, 0.05, 0.01], abs=2e-7)


def test_skewed_t_density_is_a_density(spark):
    grid = spark.range(-40000, 40001).select((F.col("id") / 1000).alias("z"))
    d = F.exp(S.skewed_t_log_density("z", 6.0, -0.3))
    total, mean, var = grid.agg(F.sum(d) / 1000, F.sum(d * F.col("z")) / 1000, F.sum(d * F.col("z") * F.col("z")) / 1000).first()
    assert (total, mean, var) == pytest.approx((1, 0, 1), abs=2e-3)


def test_moving_averages_with_gap(make_panel):
    panel = make_panel(a=[1, 2, 3, None, 5, 6, 7], c=[4] * 7)
    out = N.sma_bank(panel, [2, 3]).where("model = 'SMA(2)'")
    got = values(out, "yhat")
    assert got[:7] == [None, None, 1.5, 2.5, None, None, 5.5]
    assert got[7:] == [None, None] + [4.0] * 5


def test_average_rank_ties(make_panel):
    df = make_panel(a=[1, 2, 2, 3]).withColumn("k", N.average_rank("value", ["series_id"]))
    assert values(df, "k") == [1.0, 2.5, 2.5, 4.0]


def test_constant_series_is_described(make_panel):
    row = D.describe(make_panel(a=[2, 2, 2, 2])).first()
    assert row["std"] == 0 and row["n"] == 4


def test_standardise_uses_fit_period_only(make_panel):
    pool = make_panel(a=list(range(60))).select("series_id", F.lit("m").alias("model"), "ts", F.col("value").alias("yhat"))
    z = np.array(values(X.standardise(pool, TRAIN), "z"))
    fit = np.arange(36)
    assert z == pytest.approx((np.arange(60) - fit.mean()) / fit.std())


def test_growth_through_total_loss(make_panel):
    g = N.growth_index(make_panel(a=[0.1, -1.5, 0.2, -1.0, 0.5]))
    assert values(g, "index_value") == pytest.approx([110, -55, -66, 0, 0])


def test_calendar_fill_and_set_operations(spark, make_panel):
    panel = make_panel(a=[1, 2, 3, 4])
    holes = panel.where("value <> 2")
    assert values(P.on_calendar(holes), "value") == [1, None, 3, 4]
    assert [r.ts for r in P.unfinished(panel, holes).collect()] == [months(2)[1]]
    assert P.common_dates(panel, holes).count() == 3
    both = panel.unionByName(panel.withColumn("value", F.col("value") + 1))
    assert values(P.first_per_key(both, ["series_id", "ts"], ["value"]), "value") == [1, 2, 3, 4]


def test_factor_file_and_report(spark, tmp_path):
    lines = ["title", "", "more", ",Mkt-RF,SMB,RF", "196501,  1.0, 2.0, 0.3", "196502, 3.0,-99.99x, 0.3", "196513, 1, 1, 1",
             "196503,-1.0, 0.5, 0.3", "1965, 9, 9, 9", "footer"]
    (tmp_path / "f.csv").write_text("\n".join(lines))
    panel = factor_files.read_factor_file(spark, str(tmp_path / "f.csv"), ["MKT", "SMB", "RF"])
    assert sorted(map(tuple, panel.collect())) == [
        ("MKT", dt.date(1965, 1, 31), 1.0), ("MKT", dt.date(1965, 3, 31), -1.0),
        ("SMB", dt.date(1965, 1, 31), 2.0), ("SMB", dt.date(1965, 3, 31), 0.5)]
    path = stores.write_report(panel, str(tmp_path / "out"))
    assert len(list((tmp_path / "out").glob("*.csv"))) == 1 and spark.read.option("header", True).csv(path).count() == 4


def test_merge_keeps_first_part(spark, tmp_path):
    for name, rows in (("a", ["1995-01-31,1", "1995-02-28,2"]), ("b", ["1995-02-28,9", "1995-03-31,3"])):
        (tmp_path / f"{name}.csv").write_text("\n".join(["ts,value", *rows]))
    out = stores.merge_parts(spark, [str(tmp_path / "a.csv"), str(tmp_path / "b.csv")], "ts date, value double")
    assert [r.value for r in out.collect()] == [1, 2, 3]


def test_partition_pruning(spark, tmp_path, make_panel):
    path = stores.write_table(make_panel(a=[1], b=[2]), str(tmp_path / "t"), ["series_id"])
    df = stores.read_strategy(spark, path, series_id="b")
    assert df.count() == 1 and "PartitionFilters: [isnotnull(series_id" in df._jdf.queryExecution().executedPlan().toString()


def test_running_average_equals_batch_and_hands_on_late_rows(spark, tmp_path, make_panel):
    xs = np.random.default_rng(0).normal(size=40)
    panel = make_panel(a=xs, b=xs[::-1])
    cut = months(25)[-1]
    late = panel.where(F.col("ts") == F.lit(months(3)[-1])).withColumn("value", F.lit(99.0))
    for part in (panel.where(F.col("ts") <= F.lit(cut)), panel.where(F.col("ts") > F.lit(cut)).unionByName(late)):
        part.write.mode("append").parquet(str(tmp_path / "in"))
        stream = I.read_stream(spark, str(tmp_path / "in"), panel.schema)
        I.run_append(I.running_ema(stream, [3, 10]), str(tmp_path / "out"), str(tmp_path / "state"))
    out = spark.read.parquet(str(tmp_path / "out"))
    assert [(r.ts, r.ema) for r in out.where("late AND series_id = 'a'").collect()] == [(months(3)[-1], 99.0)]
    got = out.where("NOT late").toPandas().sort_values(["series_id", "span", "ts"])
    assert len(got) == 160
    for key, series in (("a", xs), ("b", xs[::-1])):
        for span in (3, 10):
            want = pd.Series(series).ewm(span=span, adjust=False).mean()
            assert got[(got.series_id == key) & (got.span == span)].ema.to_numpy() == pytest.approx(want.to_numpy(), abs=1e-12)


def test_series_with_late_rows_are_averaged_anew(spark, make_panel):
    history = make_panel(a=[1.0, 2.0, 3.0], b=[4.0, 5.0])
    out = spark.createDataFrame([("a", months(1)[0], 3, 1.0, False), ("a", months(2)[1], 0, 2.0, True), ("b", months(1)[0], 3, 4.0, False)],
                                "series_id string, ts date, span int, ema double, late boolean")
    got = [(r.series_id, r.span, r.ema) for r in I.repaired_ema(out, history, [3]).orderBy("series_id", "ts").collect()]
    assert got == [("a", 3, 1.0), ("a", 3, 1.5), ("a", 3, 2.25), ("b", 3, 4.0)]


def test_versions_are_idempotent(spark, tmp_path):
    rows = [(dt.datetime(2024, 1, d, 12), "x", 1.0) for d in (1, 1, 2, 3)]
    df = spark.createDataFrame(rows, "ts timestamp, event_type string, value double")
    for _ in range(2):  # the second run finds nothing new
        if not (tmp_path / "in").exists():
            df.write.parquet(str(tmp_path / "in"))
        stream = I.read_stream(spark, str(tmp_path / "in"), df.schema)
        I.run_versions(I.period_totals(stream, "event_type"), str(tmp_path / "out"), str(tmp_path / "state"))
    assert values(I.latest(spark, str(tmp_path / "out")), "value") == [2, 1, 1]


def test_returns_skip_levels_that_are_no_numbers(make_panel):
    panel = make_panel(a=[1.0, 2.0, float("nan"), 4.0, 8.0, float("inf"), 1.0])
    got = [(r.ts, r.value) for r in P.log_returns(panel).orderBy("ts").collect()]
    assert [t for t, _ in got] == [months(7)[1], months(7)[4]] and [v for _, v in got] == pytest.approx([0.6931471805599453] * 2)


def test_orders_end_with_the_last_whole_month(spark, tmp_path):
    from panelweave.sources import tables as T
    spark.createDataFrame([(1, "A")], "c_custkey long, c_mktsegment string").write.parquet(str(tmp_path / "customer.parquet"))
    for name, last, kept in (("open", "2003-03-04 10:00:00", 2), ("whole", "2003-02-28 23:00:00", 2)):
        rows = [(1, 5.0, "2003-01-31 00:00:00"), (1, 7.0, "2003-02-02 00:00:00"), (1, 1.0, last)]
        folder = tmp_path / name
        spark.createDataFrame(rows, "o_custkey long, o_totalprice double, d string").selectExpr("o_custkey", "o_totalprice", "to_timestamp(d) AS o_orderdate").write.parquet(str(folder / "orders.parquet"))
        spark.read.parquet(str(tmp_path / "customer.parquet")).write.parquet(str(folder / "customer.parquet"))
        assert T.orders_monthly(spark, str(folder)).count() == kept


@pytest.mark.parametrize("series,dates", [(128, 512), (3, 7)])
def test_partners_equal_all_pairs(spark, series, dates):
    rnd = np.random.default_rng(31)
    days = months(40)
    x = {f"s{k}": rnd.normal(size=40) + (k % 3) * np.linspace(0, 4, 40) for k in range(11)}
    x["flat"] = np.ones(40)
    rows = [(s, t, float(v) if (i + len(s)) % 7 else None) for s, own in x.items() for i, (t, v) in enumerate(zip(days, own)) if not (s == "s4" and i < 20)]
    rows += [("short", days[0], 1.0), ("short", days[1], 2.0)]
    df = spark.createDataFrame(rows, "series_id string, ts date, value double")
    own = {}
    for s, t, v in rows:
        if v is not None:
            own.setdefault(s, {})[t] = v
    want = {}
    for a in own:
        pairs = []
        for b in own:
            common = sorted(own[a].keys() & own[b].keys())
            u, v = ([own[k][t] for t in common] for k in (a, b))
            if a != b and len(common) >= 3 and np.std(u) > 0 and np.std(v) > 0:
                pairs.append((-abs(np.corrcoef(u, v)[0, 1]), b, np.corrcoef(u, v)[0, 1], len(common)))
        want[a] = [(r + 1, b, rho, n) for r, (_, b, rho, n) in enumerate(sorted(pairs)[:3])]
    got = {}
    for r in D.strongest_partners(df, 3, series, dates).orderBy("series_id", "rank").collect():
        got.setdefault(r.series_id, []).append((r["rank"], r.partner, r.rho, r.n))
    assert set(got) == {a for a in want if want[a]}
    for a, found in got.items():
        assert [f[:2] + f[3:] for f in found] == [w[:2] + w[3:] for w in want[a]] and [f[2] for f in found] == pytest.approx([w[2] for w in want[a]])


def test_a_store_computes_only_what_it_lacks(spark, tmp_path):
    asked = []

    def compute(missing):
        asked.append(sorted(r.ts for r in missing.collect()))
        return missing.withColumn("value", F.dayofmonth("ts") * 1.0)

    days, path = months(5), str(tmp_path / "grown")
    for n in (2, 2, 5):
        out = stores.grow(spark, path, spark.createDataFrame([(d,) for d in days[:n]], "ts date"), compute)
        assert sorted((r.ts, r.value) for r in out.select("ts", "value").collect()) == [(d, float(d.day)) for d in days[:n]]
    assert asked == [days[:2], [], days[2:]]


def test_late_rows_repair_their_periods_across_snapshots(spark, tmp_path):
    root, schema = str(tmp_path / "late"), "k string, ts timestamp, value double"
    at = lambda d, h=0: dt.datetime(2024, 1, d, h)
    parts = [[("a", at(1), 1.0), ("a", at(9), 2.0), ("b", at(9, 5), 3.0)], [("a", at(1, 3), 4.0), ("a", at(8, 1), 1.0), ("c", at(10), 8.0)], [("b", at(2), 0.5)]]
    for k, rows in enumerate(parts):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{root}/in")
        I.run_totals(I.read_stream(spark, f"{root}/in", spark.createDataFrame([], schema).schema), f"{root}/out", f"{root}/state", "k")
        if k < 2:
            assert I.compact(spark, f"{root}/out", "add") == k == I.compact(spark, f"{root}/out", "add")
        got = {(r.series_id, r.ts.day): r.value for r in I.current(spark, f"{root}/out", "add").collect()}
        want = {}
        for s, t, v in (r for p in parts[:k + 1] for r in p):
            want[s, t.day] = want.get((s, t.day), 0) + v
        assert got == want
    late = {r.version: (r.n, r.n_late, r.periods_late) for r in I.read_versions(spark, f"{root}/out/batches", [0, 1, 2]).collect()}
    assert late == {0: (3, 0, 0), 1: (3, 1, 1), 2: (1, 1, 1)}
    assert I.snapshot(spark, f"{root}/out") == 1


@pytest.mark.parametrize("many", [40, 400])
def test_blocks_of_partners_do_not_grow_in_number(spark, monkeypatch, many):
    seen, own = [], D._matrices
    monkeypatch.setattr(D, "_matrices", lambda panel, blocks, chunks: seen.append(blocks) or own(panel, blocks, chunks))
    monkeypatch.setattr(D, "BLOCKS", 3)
    x = np.random.default_rng(9).normal(size=(many, 24))
    x[5:9, 7] = np.nan
    rows = [(f"s{i:03d}", t, float(v)) for i, own_row in enumerate(x) for t, v in zip(months(24), own_row) if not np.isnan(v)]
    df = spark.createDataFrame(rows, "series_id string, ts date, value double")
    got = {}
    for r in D.strongest_partners(df, 2, 16).collect():
        got.setdefault(r.series_id, []).append((r["rank"], r.partner))
    assert seen == [3] and len(got) == many
    rho = np.abs(pd.DataFrame(x.T).corr().to_numpy())
    np.fill_diagonal(rho, -1)
    for i in range(many):
        assert [p for _, p in sorted(got[f"s{i:03d}"])] == [f"s{j:03d}" for j in np.argsort(-rho[i])[:2]]


def test_shuffles_have_as_many_tasks_as_the_table_asks_for(spark, tmp_path, monkeypatch):
    from panelweave.plans import panels

    days = [dt.datetime(1995, m, 3) for m in range(1, 13)]
    rows = [(s, d, 10.0 + s + d.month * (s % 3 + 1)) for s in range(10) for d in days]
    spark.createDataFrame(rows, "l_suppkey long, l_shipdate timestamp, l_extendedprice double").write.parquet(f"{tmp_path}/lineitem.parquet")
    key = "spark.sql.shuffle.partitions"
    own, want = spark.conf.get(key), panels.supplier_returns(spark, str(tmp_path)).toPandas()
    try:
        assert len(panels.supplier_panel(spark, str(tmp_path)).collect()) == len(want) and spark.conf.get(key) == own  # few rows: as set
        monkeypatch.setattr(panels, "RAW_ROWS", 10)
        got = panels.supplier_panel(spark, str(tmp_path)).toPandas()
        assert spark.conf.get(key) == "12"
    finally:
        spark.conf.set(key, own)
    order = ["series_id", "ts"]
    assert got.sort_values(order).reset_index(drop=True).equals(want.sort_values(order).reset_index(drop=True))
