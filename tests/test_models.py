"""Forecasts, combinations, volatility, correlation and portfolios against loops."""

import datetime as dt
import math
from itertools import combinations, product

import numpy as np
import pandas as pd
import pytest
from conftest import months
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from panelweave.config import TRAIN
from panelweave.operators import bootstrap as B
from panelweave.operators import combine as C
from panelweave.operators import dependence as D
from panelweave.operators import evaluate as E
from panelweave.operators import forecast as M
from panelweave.operators import performance as R
from panelweave.operators import portfolio as O
from panelweave.operators import regression as G
from panelweave.operators import scenario as Z
from panelweave.operators import tangent as T
from panelweave.operators import volatility as V
from panelweave.operators import windows as N

RNG = np.random.default_rng(7)
X1, X2 = RNG.normal(size=80), RNG.normal(size=80)


def series(df, key="a", model=None):
    df = df.where(F.col("series_id") == key)
    if model:
        df = df.where(F.col("model") == model)
    rows = df.orderBy("ts").collect()
    return {r.ts: r.yhat for r in rows}


# --- forecasts ---

def test_ema_matches_pandas_and_handles_one_row(make_panel):
    out = M.ema_bank(make_panel(a=X1, b=[1.0]), [3, 30])
    got = series(out, "a", "EMA(30)")
    want = pd.Series(X1).ewm(span=30, adjust=False).mean()
    assert list(got.values()) == pytest.approx(want[:-1].tolist(), abs=1e-12)
    assert series(out, "b") == {}


@given(st.floats(-100, 100), st.integers(1, 40))
@settings(max_examples=25, deadline=None)
def test_ema_of_constant_is_constant(c, n):
    assert M.ema_paths(np.full(n, c), [3, 7]) == pytest.approx(np.full((n, 2), c))


@pytest.mark.parametrize("order", [3, 14])
def test_ar_matches_least_squares(make_panel, order):
    # Order 14 takes the Arrow path for the cross products.
    x = np.concatenate([X1, X2])
    ts = months(len(x))
    got = series(M.ar_forecasts(make_panel(a=x, b=x[::-1]), order), "a", "AR(2)")
    rows = [t for t in range(order, len(x)) if TRAIN.start <= ts[t] < TRAIN.end]
    design = lambda t: [1, x[t - 1], x[t - 2]]
    coef = np.linalg.lstsq(np.array([design(t) for t in rows]), x[rows], rcond=None)[0]
    want = {ts[t]: float(np.dot(coef, design(t))) for t in range(order, len(x))}
    assert list(got) == list(want) and list(got.values()) == pytest.approx(list(want.values()), abs=1e-8)


def test_two_step_arma_matches_loop(make_panel):
    ar, ma, longest = 8, 6, 10
    x = np.concatenate([X1, X2])
    ts = months(len(x))
    got = series(M.arma_forecasts(make_panel(a=x), ar, ma, longest), "a", "ARMA(2,3)")
    train = lambda t: TRAIN.start <= ts[t] < TRAIN.end
    fit = lambda rows, f: np.linalg.lstsq(np.array([f(t) for t in rows]), x[rows], rcond=None)[0]
    past = lambda t: [1, *x[t - longest:t][::-1]]
    first = fit([t for t in range(longest, len(x)) if train(t)], past)
    shock = {t: x[t] - np.dot(first, past(t)) for t in range(longest, len(x))}
    both = lambda t: [1, x[t - 1], x[t - 2], *[shock[t - k] for k in (1, 2, 3)]]
    rows = [t for t in range(longest + ma, len(x))]
    second = fit([t for t in rows if train(t)], both)
    want = {ts[t]: float(np.dot(second, both(t))) for t in rows}
    assert list(got) == list(want) and list(got.values()) == pytest.approx(list(want.values()), abs=1e-7)


def test_moments_agree_on_both_paths(spark, monkeypatch):
    pdf = pd.DataFrame(RNG.normal(size=(500, 4)), columns=["x1", "x2", "x3", "y"]).assign(k=np.where(np.arange(500) < 350, "hot", "cold"))
    df = spark.createDataFrame(pdf)
    jvm = {r.k: r.moments for r in G.moments(df, ["k"], ["x1", "x2", "x3"]).collect()}
    monkeypatch.setattr(G, "JVM_COLUMNS", 2)
    arrow = {r.k: r.moments for r in G.moments(df, ["k"], ["x1", "x2", "x3"]).collect()}
    assert all(jvm[k] == pytest.approx(arrow[k]) for k in ("hot", "cold"))


@pytest.mark.parametrize("columns", [2, 12])
def test_rows_with_a_null_count_for_no_sum(spark, monkeypatch, columns):
    monkeypatch.setattr(G, "JVM_COLUMNS", columns)
    df = spark.createDataFrame([("a", 1.0, 2.0), ("a", None, 3.0), ("a", 4.0, None), ("a", 2.0, 1.0)], "k string, x double, y double")
    assert G.moments(df, ["k"], ["x"]).first().moments == pytest.approx([2, 3, 3, 5, 4, 5])


def test_singular_model_is_left_out(spark):
    df = spark.createDataFrame([("a", float(i), 2.0 * i, float(i)) for i in range(10)], "series_id string, x1 double, x2 double, y double")
    out = G.coefficients(G.moments(df, ["series_id"], ["x1", "x2"]), ["series_id"], [[0, 1], [0, 1, 2]], ["one", "two"], 3)
    rows = {r.model: r for r in out.collect()}
    assert rows["one"].coef[1] == pytest.approx(1) and rows["one"].sse == pytest.approx(0, abs=1e-9)


def test_no_forecast_looks_ahead(make_panel):
    changed = X1.copy()
    changed[70:] += 5
    ts = months(80)
    # kNN and the regressions fit on TRAIN, which ends before the change.
    for f in (lambda p: N.sma_bank(p, [3]), lambda p: M.ema_bank(p, [5]), lambda p: M.ar_forecasts(p, 2).where("model = 'AR(2)'"), M.knn_forecasts,
              lambda p: V.garch_volatility(p).withColumnRenamed("sigma", "yhat"),
              lambda p: V.ewma_volatility(p).withColumnRenamed("sigma", "yhat")):
        before, after = series(f(make_panel(a=X1))), series(f(make_panel(a=changed)))
        same = [t for t in before if t <= ts[70]]
        assert [before[t] for t in same] == pytest.approx([after[t] for t in same], nan_ok=True)


def test_neighbours_of_fit_rows(make_panel):
    panel = make_panel(a=X1)
    own = M.nearest_neighbours(panel, 1, 2).where("ts < DATE '1998-01-01'").collect()
    assert own and all(r.ts == r.neighbour_ts and r.distance == 0 for r in own)
    others = M.nearest_neighbours(panel, 1, 2, exclude_self=True).where("ts < DATE '1998-01-01'").collect()
    assert all(r.ts != r.neighbour_ts for r in others)


def test_radial_centres_and_registry(make_panel):
    panel = make_panel(a=X1, b=X2)
    centres = M.radial_centres(panel, 3, 2)
    assert len(centres) == 3 and M.radial_forecasts(panel, centres).count() > 0
    M.register("twice", lambda p: M.random_walk(p).withColumn("yhat", F.col("yhat") * 2))
    out = M.bank(panel, [M.REGISTRY["random_walk"], M.REGISTRY["twice"]])
    assert out.count() == 4 * 79


# --- evaluation ---

def test_theil_bounds_and_reference_row(make_panel):
    panel = make_panel(a=X1, b=X2)
    m = E.error_metrics(E.losses(N.simple_pool(panel), panel)).collect()
    assert all(0 <= r.theil_u1 <= 1 for r in m)
    assert all(r.theil_ratio == pytest.approx(1) for r in m if r.model == "RW")


def test_tests_are_null_without_variance(make_panel):
    panel = make_panel(a=[1.0] * 30)
    loss = E.losses(N.simple_pool(panel), panel)
    assert {r.pt for r in E.direction_test(loss).collect()} == {None}
    assert {r.dm for r in E.accuracy_test(loss, "RW").collect()} == {None}


def loop_starts(b, j, n, seed):
    x = (b * 7919 + j * 104729 + seed) % 2 ** 31
    for _ in range(2):
        x = (x * 1103515245 + 12345) % 2 ** 31
    return x // 65536 % n


def test_resampling_and_spa_against_loops(spark):
    n, reps = 37, 60
    e = {"A": RNG.normal(size=n), "B": RNG.normal(size=n) * 1.5, "C": RNG.normal(size=n)}
    rows = [("s", m, t, 0.0, 0.0, float(v)) for m, xs in e.items() for t, v in zip(months(n), xs)]
    loss = spark.createDataFrame(rows, "series_id string, model string, ts date, y double, yhat double, e double")
    got = {r.model: r.p for r in B.superior_ability(loss, list(e), replicates=reps, replicates_per_task=25).collect()}
    for m in e:
        diffs = [np.abs(e[m]) - np.abs(e[o]) for o in e if o != m]
        observed = max(d.mean() for d in diffs)
        hits = 0
        for b in range(reps):
            idx = [(loop_starts(b, j, n, 42) + k) % n for j in range(math.ceil(n / 15)) for k in range(15)][:n]
            hits += max((d - d.mean())[idx].mean() for d in diffs) >= observed
        assert got[m] == pytest.approx(hits / reps)
    apart = B.superior_ability(loss, list(e), replicates=reps, shared_draws=False)
    assert all(0 <= r.p <= 1 for r in apart.collect())


def eliminate(mean, draws, level):
    """P-values of the elimination of one series, with all draws in memory."""
    p = np.ones(len(mean))
    left = list(range(len(mean)))
    while len(left) > 1:
        gap = mean[left] - mean[left].mean()
        noise = draws[:, left] - draws[:, left].mean(axis=1, keepdims=True)
        scale = np.sqrt(np.maximum(noise.var(axis=0), 1e-10))
        t = gap / scale
        worst = int(t.argmax())
        value = float(((noise / scale).max(axis=1) >= t[worst]).mean())
        if value >= level:
            break
        p[left[worst]] = value
        del left[worst]
    return p


def test_confidence_set_drops_a_bad_model():
    x = np.abs(RNG.normal(size=(60, 3))) + np.array([0, 0, 5])
    draws = B.resampled_means(x - x.mean(axis=0), np.arange(500), 15, 42)
    p = eliminate(x.mean(axis=0), draws, 0.05)
    assert p[2] < 0.05 and p.max() == 1


def test_confidence_set_in_rounds_equals_one_in_memory(spark):
    rnd, days, names = np.random.default_rng(21), months(50), ["a", "b", "c", "d"]
    worse = {"s1": [0, 0, 3, 0], "s2": [0, 2, 3, 4], "s3": [0, 0, 0, 0], "s4": [0, 5, 0, 0.1]}
    x = {s: np.abs(rnd.normal(size=(50, 4)) + np.array(w)) for s, w in worse.items()}
    rows = [(s, m, t, float(x[s][i, j])) for s in x for j, m in enumerate(names) for i, t in enumerate(days)]
    loss = spark.createDataFrame(rows, "series_id string, model string, ts date, e double")
    got = {(r.series_id, r.model): r for r in B.confidence_set(loss, names, replicates=300, replicates_per_task=70).collect()}
    for s in x:
        draws = B.resampled_means(x[s] - x[s].mean(axis=0), np.arange(300), 15, 42)
        want = eliminate(x[s].mean(axis=0), draws, 0.05)
        assert [got[s, m].p for m in names] == pytest.approx(want) and [got[s, m].in_set for m in names] == list(want == 1)


@pytest.mark.parametrize("per_cell", [8, 1024])
def test_neighbours_equal_a_full_search(spark, per_cell):
    rnd = np.random.default_rng(22)
    x = {"a": rnd.normal(size=150), "b": np.repeat([0.5, -0.5], 75), "c": rnd.normal(size=12), "d": rnd.normal(size=90).round(1)}
    days = [dt.date(1996, 1, 1) + dt.timedelta(days=7 * k) for k in range(150)]
    rows = [(s, t, float(v)) for s, own in x.items() for t, v in zip(days, own)]
    panel = spark.createDataFrame(rows, "series_id string, ts date, value double")
    lagged = {s: [(r.ts, r.x, r.fit) for r in M.scaled_lags(panel.where(F.col("series_id") == s), 3, TRAIN).select(
        "ts", F.array("x1", "x2", "x3").alias("x"), M.in_period(TRAIN).alias("fit")).orderBy("ts").collect()] for s in x}
    for exclude in (False, True):
        got = {}
        for r in M.nearest_neighbours(panel, 4, 3, exclude_self=exclude, per_cell=per_cell).collect():
            got.setdefault((r.series_id, r.ts), []).append((r["rank"], r.neighbour_ts, r.distance))
        for s, own in lagged.items():
            for t, v, _ in own:
                near = sorted((math.dist(v, u), d) for d, u, fit in own if fit and not (exclude and d == t))[:4]
                found = sorted(got.get((s, t), []))
                assert [f[2] for f in found] == pytest.approx([n[0] for n in near], abs=1e-12) and len(found) == len(near)
                if len({round(n[0], 9) for n in near}) == len(near) and len(near) == 4:
                    assert [f[1] for f in found[:3]] == [n[1] for n in near[:3]]


def test_elastic_net_is_optimal_and_chosen_in_time(spark):
    rnd, days = np.random.default_rng(23), months(60)
    rows = []
    for s in ("a", "b", "flat"):
        x = rnd.normal(size=(60, 4)) * np.array([1, 5, 0.1, 0])
        y = 2 * x[:, 0] - 0.3 * x[:, 1] + rnd.normal(size=60) * (0.2 if s == "a" else 3)
        rows += [(s, t, float(v), *map(float, own)) for t, v, own in zip(days, y if s != "flat" else y * 0 + 1, x)]
    df = spark.createDataFrame(rows, "series_id string, ts date, y double, c1 double, c2 double, c3 double, c4 double")
    xs, period = ["c1", "c2", "c3", "c4"], TRAIN._replace(end=dt.date(2000, 1, 1))
    got = {r.series_id: r for r in C.elastic_net(df, xs, folds=4, steps=8, period=period).collect()}
    assert set(got) == {"a", "b", "flat"} and got["flat"].coef[1:] == [0, 0, 0, 0] and got["flat"].coef[0] == pytest.approx(1)
    for s in ("a", "b"):
        data = np.array([r[2:] for r in rows if r[0] == s])
        y, x = data[:, 0], data[:, 1:]
        fit = lambda n, mix, pen: loop_net(x[:n], y[:n], mix, pen)
        coef = np.array(got[s].coef)
        assert coef == pytest.approx(fit(60, got[s].mix, got[s].penalty), abs=1e-7)
        sx, sy = x.std(axis=0), y.std()
        top = max(abs(np.cov(x[:, j], y, bias=True)[0, 1] / sx[j] / sy) for j in range(3))
        errors = {}
        for mix in (0.5, 0.9, 1.0):
            for k in range(8):
                pen = top / mix * 1e-3 ** (k / 7)
                errors[mix, pen] = sum(((y[n:n + 15] - (c := fit(n, mix, pen))[0] - x[n:n + 15] @ c[1:]) ** 2).sum() for n in (15, 30, 45))
        assert errors[min(errors, key=lambda m: abs(m[0] - got[s].mix) + abs(m[1] - got[s].penalty))] == pytest.approx(min(errors.values()))
    out = C.net_combination(df, xs, folds=4, steps=8)
    assert out.where("ts < DATE '2000-01-01'").count() == 0


def loop_net(x, y, mix, penalty):
    """Elastic net on columns of unit variance, one coordinate after the other over the rows."""
    sx, sy = x.std(axis=0), y.std()
    z, v = (x - x.mean(axis=0)) / np.where(sx > 0, sx, 1), (y - y.mean()) / sy
    b = np.zeros(x.shape[1])
    for _ in range(3000):
        for j in np.flatnonzero(sx > 0):
            r = (z[:, j] * (v - z @ b + z[:, j] * b[j])).mean()
            b[j] = np.sign(r) * max(abs(r) - penalty * mix, 0) / (1 + penalty * (1 - mix))
    coef = b * sy / np.where(sx > 0, sx, np.inf)
    return np.concatenate([[y.mean() - coef @ x.mean(axis=0)], coef])


# --- combination ---

def loop_dma(y, x, lam, delta):
    """All subsets one by one, scalar by scalar."""
    n, v = x.shape
    warm = max(10, n // 10)
    mean, ll = [], []
    for mask in range(2 ** v):
        cols = [i for i in range(v) if mask >> i & 1]
        b, c, r = np.zeros(len(cols)), np.eye(len(cols)), np.var(y[:warm])
        mu, l = [], []
        for t in range(n):
            f = x[t, cols]
            m = float(f @ b)
            var = max(float(f @ c @ f) + r, 1e-10)
            mu.append(m), l.append(-0.5 * (np.log(2 * np.pi * var) + (y[t] - m) ** 2 / var))
            if cols:
                cp = c / lam
                k = cp @ f / (f @ cp @ f + r)
                e = y[t] - m
                b = b + k * e
                a = np.eye(len(cols)) - np.outer(k, f)
                c = a @ cp @ a.T + r * np.outer(k, k)
                r = max(lam * r + (1 - lam) * e * e, 1e-6)
        mean.append(mu), ll.append(l)
    mean, ll = np.array(mean), np.array(ll)
    w, out = np.zeros(2 ** v), []
    for t in range(n):
        p = np.exp(w - w.max())
        out.append(p @ mean[:, t] / p.sum())
        w = delta * (w + ll[:, t])
    return np.array(out), warm


def test_dynamic_average_matches_loop(spark):
    x = RNG.normal(size=(50, 3))
    y = x[:, 0] * 0.5 + RNG.normal(size=50) * 0.3
    rows = [("a", t, float(v), *map(float, r)) for t, v, r in zip(months(50), y, x)]
    df = spark.createDataFrame(rows, "series_id string, ts date, y double, c1 double, c2 double, c3 double")
    got = list(series(C.dynamic_average(df, ["c1", "c2", "c3"], masks_per_task=3)).values())
    want, warm = loop_dma(y, x, 0.99, 0.99)
    assert got == pytest.approx(want[warm:].tolist(), abs=1e-9)


def test_filters_reset_on_a_negative_root():
    masks = np.ones((1, 2))
    y, x = RNG.normal(size=40), RNG.normal(size=(40, 2)) * np.array([1e5, 1e-5])
    mean, density = C.filter_paths(y, x, masks, 0.5, 10)
    assert np.isfinite(mean).all() and np.isfinite(density).all()


def test_means_recover_from_huge_and_missing_values(make_panel):
    panel = make_panel(a=[1e17, 1.0, 2.0, 3.0, 4.0, float("nan"), 1.0, 2.0, 3.0, 4.0, 5.0])
    got = [r.q3 for r in N.trailing_means(panel, [3]).orderBy("ts").collect()]
    assert got[4] == 2.0 and got[5] == 3.0 and all(math.isnan(v) for v in got[6:9]) and got[9:] == [2.0, 3.0]


def test_model_weights_of_long_series(spark):
    days = [dt.date(2000, 1, 1) + dt.timedelta(days=k) for k in range(5000)]
    ll = RNG.normal(size=(2, 5000))
    df = spark.createDataFrame([("a", m, t, float(v)) for m, row in zip("pq", ll) for t, v in zip(days, row)], "series_id string, model string, ts date, ll double")
    w = C.model_weights(df, 0.7).toPandas().pivot(index="ts", columns="model", values="w").to_numpy()
    state, want = np.zeros(2), []
    for t in range(5000):
        e = np.exp(state - state.max())
        want.append(e / e.sum())
        state = 0.7 * (state + ll[:, t])
    assert w == pytest.approx(np.array(want))


def test_model_weights_sum_to_one_and_forget_nothing(spark):
    rows = [("a", m, t, float(v)) for m in "pq" for t, v in zip(months(20), RNG.normal(size=20))]
    df = spark.createDataFrame(rows, "series_id string, model string, ts date, ll double")
    w = C.model_weights(df, 1.0).toPandas().pivot(index="ts", columns="model", values="w")
    assert w.sum(axis=1).to_numpy() == pytest.approx(np.ones(20))
    ll = pd.DataFrame(rows, columns=["s", "model", "ts", "ll"]).pivot(index="ts", columns="model", values="ll").cumsum().shift(fill_value=0)
    bayes = np.exp(ll["p"]) / np.exp(ll).sum(axis=1)
    assert w["p"].to_numpy() == pytest.approx(bayes.to_numpy())


def test_principal_axes_match_svd(spark):
    base = RNG.normal(size=(60, 2))
    x = base @ RNG.normal(size=(2, 5)) + RNG.normal(size=(60, 5)) * 0.05
    rows = [("a", f"m{j}", t, float(x[i, j])) for j in range(5) for i, t in enumerate(months(60))]
    pool = spark.createDataFrame(rows, "series_id string, model string, ts date, yhat double")
    axes = C.loadings(pool)
    z = (x - x.mean(axis=0)) / x.std(axis=0)
    _, s, vt = np.linalg.svd(z, full_matrices=False)
    share = s ** 2 / (s ** 2).sum()
    got = axes.toPandas().pivot(index="k", columns="model", values="weight").to_numpy()
    assert len(got) == int((share.cumsum() < 0.95).sum()) + 1
    assert np.abs(got) == pytest.approx(np.abs(vt[: len(got)]), abs=1e-9)
    assert all(row[np.abs(row).argmax()] > 0 for row in got)
    scores = C.components_wide(C.project(pool, axes), len(got)).orderBy("ts").toPandas()
    assert scores["c1"].to_numpy() == pytest.approx(z @ got[0], abs=1e-9)
    best = spark.createDataFrame([("a", "zz", 0.1)], "series_id string, model string, rmse double")
    reps = C.representatives(axes, best).orderBy("rank").collect()
    assert reps[0].model == "zz [BEST]" and len({r.model for r in reps}) == len(reps)


# --- volatility ---

def loop_garch(w, grid):
    best = (-np.inf, None)
    v = (w ** 2).mean()
    for a, b, g in grid:
        s, ll = v, 0.0
        for x in w:
            ll -= 0.5 * (np.log(s) + x * x / s)
            s = (1 - a - b - g / 2) * v + (a + g * (x < 0)) * x * x + b * s
        if ll > best[0]:
            best = (ll, s)
    return math.sqrt(best[1])


def test_garch_matches_loop_and_short_windows(make_panel):
    grid = V.variance_grid(V.ALPHAS, V.BETAS, (0.0, 0.1))
    out = V.garch_volatility(make_panel(a=X1, c=[0.0] * 20), 24, asymmetries=(0.0, 0.1)).withColumnRenamed("sigma", "yhat")
    got, ts = series(out), months(80)
    assert got[ts[5]] == pytest.approx(X1[:5].std(ddof=1))
    for t in (12, 30, 79):
        assert got[ts[t]] == pytest.approx(loop_garch(X1[max(0, t - 24):t], grid), rel=1e-9)
    assert all(v == 0 for v in series(out, "c").values())


def test_marginal_residual_ranges(make_panel):
    out = V.marginal_residuals(make_panel(a=X1, short=X1[:5])).collect()
    assert len(out) == 80 - 24 + 1 and all(0 < r.u < 1 and np.isfinite(r.z) for r in out)


def test_skewed_t_short_series(make_panel):
    row = V.skewed_t_fit(make_panel(a=X1[:10])).first()
    assert (row.nu, row.lam) == (8.0, 0.0)


# --- correlation ---

W3 = RNG.normal(size=(4, 24, 3)) @ np.linalg.cholesky(np.array([[1, .6, .2], [.6, 1, -.3], [.2, -.3, 1]])).T


def loop_dcc(z, a, b, g, last):
    n = np.minimum(z, 0)
    target, nbar = np.corrcoef(z.T), n.T @ n / len(z)
    q, ll = target.copy(), 0.0
    for t in range(1, len(z) + (1 if last else 0)):
        q = (1 - a - b) * target - g * nbar + a * np.outer(z[t - 1], z[t - 1]) + g * np.outer(n[t - 1], n[t - 1]) + b * q
        d = np.sqrt(np.diag(q))
        r = q / np.outer(d, d)
        if t < len(z):
            for i, j in combinations(range(3), 2):
                x, y, p = z[t, i], z[t, j], r[i, j]
                ll -= 0.5 * (np.log(1 - p * p) + (x * x - 2 * p * x * y + y * y) / (1 - p * p) - x * x - y * y)
    return ll, np.array([r[i, j] for i, j in combinations(range(3), 2)])


@pytest.mark.parametrize("last", [True, False])
@pytest.mark.parametrize("gs", [(0.0,), (0.0, 0.05)])
def test_conditional_correlation_matches_loop(last, gs):
    grid = np.array(list(product((0.02, 0.1), (0.6, 0.85), gs)))
    got = D.conditional_correlation(W3, grid, last)
    for z, rho in zip(W3, got):
        assert rho == pytest.approx(max((loop_dcc(z, *p, last) for p in grid), key=lambda r: r[0])[1], abs=1e-10)
    assert (np.abs(got) < 1).all()


def test_score_is_the_derivative():
    """The update's direction against a numerical derivative of the density."""
    nu, x, y, p = 6.0, 0.7, -1.2, 0.35
    ll = lambda r: -0.5 * np.log(1 - r * r) - (nu + 2) / 2 * np.log1p((x * x - 2 * r * x * y + y * y) / (1 - r * r) / nu)
    numeric = (ll(p + 1e-6) - ll(p - 1e-6)) / 2e-6 * (1 - p * p)
    q = (x * x - 2 * p * x * y + y * y) / (1 - p * p)
    w = (nu + 2) / (nu + q)
    assert (p * (1 - p * p) + w * ((1 + p * p) * x * y - p * (x * x + y * y))) / (1 - p * p) == pytest.approx(numeric, rel=1e-6)


def test_flat_correlations_fall_back_to_rank_target():
    grid = np.array([(0.01, 0.5, 8.0)])
    assert D.score_driven_correlation(W3, grid, True, flat=10.0) == pytest.approx(
        D.rank_correlation(W3)[:, [0, 0, 1], [1, 2, 2]], abs=1e-12)


def test_windows_and_degrees_need_no_common_key(make_panel):
    panel = make_panel(a=[float(k) for k in range(8)], b=[1.0, 2.0, None, 4.0, 5.0, 6.0, 7.0, 8.0])
    got = {r.ts: [list(v) for v in r.window] for r in D.date_windows(panel, ["a", "b"], 3).collect()}
    dates = [m for k, m in enumerate(months(8)) if k != 2]
    values = [[float(k), float(k + 1)] for k in range(8) if k != 2]
    assert got == {dates[k]: values[k - 3:k] for k in range(3, 7)}
    plan = D.date_windows(panel, ["a", "b"], 3)._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan


def test_scenarios_are_all_past_vectors(make_panel):
    rows = make_panel(A=range(60), B=range(100, 160))
    got = {r.ts: r.window for r in D.past_vectors(rows, ("A", "B"), 24).collect()}
    days = months(60)
    assert got == {days[k]: [[float(i), 100.0 + i] for i in range(k)] for k in range(24, 60)}


def test_resampled_scenarios_equal_a_loop(make_panel):
    rows = make_panel(A=range(40), B=range(100, 140), C=[None] * 40)
    got = {r.ts: ([list(v) for v in r.window], list(r.times)) for r in Z.resampled(rows, ("A", "B"), draws=137, block=5, least=30).collect()}
    days = months(40)
    assert sorted(got) == days[30:]
    for n in range(30, 40):
        starts = B.block_starts(np.arange(28), 1, n, 42)[:, 0]
        drawn = [int((starts[q // 5] + q % 5) % n) for q in range(137)]
        at = sorted(set(drawn))
        assert got[days[n]] == ([[float(i), 100.0 + i] for i in at], [drawn.count(i) for i in at])
    some = make_panel(A=range(40)).where(F.col("ts") == days[35])
    assert [r.ts for r in Z.resampled(rows, ("A", "B"), least=30, dates=some).collect()] == [days[35]]


def test_matrix_repair(spark):
    bad = [[1.0, 0.9, -0.9], [0.9, 1.0, 0.9], [-0.9, 0.9, 1.0]]
    good = [[1.0, 0.1, 0.0], [0.1, 1.0, 0.2], [0.0, 0.2, 1.0]]
    df = spark.createDataFrame([(0, bad), (1, good)], "i int, m array<array<double>>")
    for method in ("shift", "floor"):
        out = {r.i: np.array(r.m) for r in df.select("i", D.repair("m", method=method).alias("m")).collect()}
        assert np.linalg.eigvalsh(out[0])[0] > -1e-9 and np.diag(out[0]) == pytest.approx(np.ones(3))
        assert out[1] == pytest.approx(np.array(good))


def test_missing_pair_counts_as_uncorrelated(spark):
    corr = spark.createDataFrame([("m", months(1)[0], "a", "b", 1.0)], D.CORR)
    m = np.array(D.correlation_matrix(corr, ["a", "b", "c"]).first().matrix)
    assert m[0, 2] == 0 and m[0, 1] == pytest.approx(1 - 1e-6) and (m == m.T).all()


def test_recorrelated_windows_have_the_target():
    target = np.array([[1, .3, .1], [.3, 1, .5], [.1, .5, 1]])
    out = Z.with_correlation(W3, np.repeat(target[None], 4, axis=0))
    assert D.sample_correlation(out) == pytest.approx(np.repeat(target[None], 4, axis=0), abs=1e-9)
    thin = W3[:, :2]
    assert Z.with_correlation(thin, np.repeat(target[None], 4, axis=0)) == pytest.approx(thin)


# --- portfolios ---

MU = np.array([0.01, 0.02, -0.01, 0.005])
ROOT = RNG.normal(size=(4, 4))
COV = ROOT @ ROOT.T / 100 + np.eye(4) * 0.01


def grid(n, steps, short=0.0):
    """All weight vectors on a grid, by loops."""
    limit = round(short * steps)
    out = [(*k, steps - sum(k)) for k in product(range(-limit, steps + limit + 1), repeat=n - 1)]
    return np.array([k for k in out if sum(max(-x, 0) for x in k) <= limit]) / steps


def sharpe(w, mu, cov):
    return w @ mu / np.sqrt(np.einsum("pi,ij,pj->p", w, cov, w))


def tail_loss(w, scenarios, k):
    return np.sort(-(w @ scenarios.T), axis=1)[:, -k:].mean(axis=1)


@pytest.mark.parametrize("n,steps,short", [(3, 7, 0.0), (4, 10, 0.3), (2, 4, 0.5)])
def test_lattice_rows_are_all_weights_once(spark, n, steps, short):
    rows = T.with_lattice(spark.createDataFrame([(1,), (2,)], "i int"), n, steps, round(short * steps)).collect()
    got = sorted(tuple(round(x * steps) for x in r.w) for r in rows if r.i == 1)
    assert got == sorted(tuple(np.round(w * steps).astype(int)) for w in grid(n, steps, short)) and len(rows) == 2 * len(got)


@pytest.mark.parametrize("panel,short", [(O.LONG_ONLY, 0.0), (O.LEVERAGED, 0.3)])
def test_tangent_is_best_feasible(spark, panel, short):
    df = spark.createDataFrame([(MU.tolist(), COV.tolist())], "mu array<double>, cov array<array<double>>")
    out = df.select(T.sharpe_weights("mu", "cov", O.SHORT[panel]).alias("t")).first().t
    w = np.array(out.weights)
    assert w.sum() == pytest.approx(1) and np.maximum(-w, 0).sum() <= short + 1e-9
    assert out.ratio == pytest.approx(sharpe(w[None], MU, COV)[0]) and out.gap < 1e-9
    assert out.ratio >= sharpe(grid(4, 40, short), MU, COV).max()


@pytest.mark.parametrize("short", [0.0, 0.3])
def test_tangents_of_many_shapes_are_optimal(spark, short):
    rnd = np.random.default_rng(11)
    rows = []
    for k in range(24):
        n = 5
        root = rnd.normal(size=(n, 2 + k % 5)) * rnd.uniform(0.2, 3, size=(n, 1))
        rows.append((k, (rnd.normal(size=n) * 0.02 - (0.05 if k % 4 == 0 else 0)).tolist(), (root @ root.T / 100 + np.eye(n) * 1e-3).tolist()))
    rows.append((99, [0.1] * 5, np.zeros((5, 5)).tolist()))
    df = spark.createDataFrame(rows, "k int, mu array<double>, cov array<array<double>>")
    out = {r.k: r.t for r in df.select("k", T.sharpe_weights("mu", "cov", short).alias("t")).collect()}
    assert out.pop(99).weights is None
    points = grid(5, 10, short)
    for k, mu, cov in rows[:-1]:
        best = sharpe(points, np.array(mu), np.array(cov)).max()
        w = np.array(out[k].weights)
        assert out[k].ratio >= best - 1e-9 and np.maximum(-w, 0).sum() <= short + 1e-9 and (out[k].gap < 1e-6 or max(mu) <= 0)


def test_tangent_of_a_hundred_assets(spark):
    rnd = np.random.default_rng(12)
    root = rnd.normal(size=(100, 10))
    mu, cov = rnd.normal(size=100) * 0.02 + 0.01, root @ root.T / 500 + np.diag(rnd.uniform(0.005, 0.02, 100))
    df = spark.createDataFrame([(mu.tolist(), cov.tolist())], "mu array<double>, cov array<array<double>>")
    for short in (0.0, 0.3):
        out = df.select(T.sharpe_weights("mu", "cov", short).alias("t")).first().t
        w = np.array(out.weights)
        assert out.gap < 1e-6 and w.sum() == pytest.approx(1) and np.maximum(-w, 0).sum() <= short + 1e-9


@pytest.mark.parametrize("n", [4, 50])
@pytest.mark.parametrize("shift", [0.0, -0.2])
def test_searches_start_at_the_best_corner(n, shift):
    rnd = np.random.default_rng(n)
    root, mu = rnd.normal(size=(n, n)), rnd.normal(size=n) * 0.02 + shift
    cov, vectors, times = root @ root.T / 100, rnd.normal(size=(30, n)) * 0.05, rnd.integers(1, 4, 30)
    points = np.array([T.corner(n, i, j, 0.3) for i in range(n) for j in range(n)])
    assert sharpe(T.best_corner(mu, cov, 0.3)[None], mu, cov)[0] == pytest.approx(sharpe(points, mu, cov).max())
    tails = [T.tail_size(int(times.sum()), b) for b in (0.9, 0.95)]
    risk, _ = T.tail_risk(points, vectors, times, tails)
    for k, own in enumerate(T.starts(mu, vectors, times, tails, 0.3)):
        best = (points @ mu / (risk[k] - points @ mu))[risk[k] > points @ mu].max()
        found = own[0] @ mu / (T.tail_risk(own[:1], vectors, times, tails)[0][k, 0] - own[0] @ mu)
        # Of very many assets with a positive mean among them, any corner of positive mean will do.
        assert found == pytest.approx(best) if n == 4 or shift else found > 0


def test_tail_means_count_vectors_as_often_as_they_were_drawn(spark):
    rnd = np.random.default_rng(13)
    vectors, times, w = rnd.normal(size=(30, 3)), rnd.integers(1, 6, 30), np.array([0.5, 0.2, 0.3])
    every = np.repeat(vectors, times, axis=0)
    tails = [T.tail_size(len(every), b) for b in (0.8, 0.95, 0.999)]
    df = spark.createDataFrame([(w.tolist(), vectors.tolist(), times.tolist())], "w array<double>, v array<array<double>>, n array<int>")
    got = df.select(T.tail_means(F.col("w"), F.col("v"), F.col("n"), tails).alias("t")).first().t
    want = [tail_loss(w[None], every, k)[0] for k in tails]
    risk, slope = T.tail_risk(w[None], vectors, times, tails)
    assert got == pytest.approx(want) and risk[:, 0] == pytest.approx(want) and (slope[:, 0] @ w) == pytest.approx(want)


@pytest.mark.parametrize("short", [0.0, 0.3])
@pytest.mark.parametrize("n,draws", [(3, 40), (5, 24), (5, 400)])
def test_cvar_weights_beat_a_fine_lattice(spark, n, draws, short):
    rnd = np.random.default_rng(n * draws)
    scen, mu = rnd.normal(size=(draws, n)) * 0.05, [rnd.normal(size=n) * 0.01 + 0.005, np.full(n, -0.01)]
    df = spark.createDataFrame([([m.tolist() for m in mu], scen.tolist(), [1] * draws)], "mu array<array<double>>, s array<array<double>>, n array<int>")
    found = df.select(T.cvar_weights("mu", "s", "n", draws, (0.9, 0.95), short).alias("t")).first().t
    assert [(r["at"], r.beta) for r in found] == [(0, 0.9), (0, 0.95), (1, 0.9), (1, 0.95)]
    points = grid(n, 20 if n == 3 else 10, short)
    for r in found:
        w, k = np.array(r.weights), T.tail_size(draws, r.beta)
        cvar = tail_loss(points, scen, k) - points @ mu[r["at"]]
        best = (points @ mu[r["at"]] / cvar)[cvar > 0].max()
        assert r.ratio >= best - 1e-9 and w.sum() == pytest.approx(1) and np.maximum(-w, 0).sum() <= short + 1e-9
        assert r.cvar == pytest.approx(tail_loss(w[None], scen, k)[0] - w @ mu[r["at"]]) and r.ratio == pytest.approx(w @ mu[r["at"]] / r.cvar)


def test_cvar_of_a_hundred_assets(spark):
    rnd = np.random.default_rng(14)
    scen, mu = rnd.normal(size=(60, 100)) * 0.05 + rnd.normal(size=(60, 1)) * 0.03, rnd.normal(size=100) * 0.01 + 0.004
    df = spark.createDataFrame([([mu.tolist()], scen.tolist(), [3] * 60)], "mu array<array<double>>, s array<array<double>>, n array<int>")
    r, = df.select(T.cvar_weights("mu", "s", "n", 180, (0.9,)).alias("t")).first().t
    single = (mu / (tail_loss(np.eye(100), np.repeat(scen, 3, axis=0), 18) - mu)).max()
    assert r.ratio > single and sum(r.weights) == pytest.approx(1)


@given(st.lists(st.floats(-0.5, 0.5), min_size=5, max_size=60))
@settings(max_examples=25, deadline=None)
def test_tail_mean_is_not_below_quantile_loss(xs):
    r = np.array(xs)[:, None]
    risk, _ = T.tail_risk(np.ones((1, 1)), r, np.ones(len(r), dtype=np.int64), [T.tail_size(len(r), 0.95)])
    assert risk[0, 0] >= -np.quantile(r, 0.05) - 1e-12


def test_performance_edge_cases(spark):
    rows = [(k, t, v) for k, xs in {
        "up": [0.01, 0.02, 0.03], "zero": [0.0] * 3, "wipe": [0.1, -1.2, 0.5], "one": [0.05], "mix": [0.1, -0.1, -0.2]}.items()
        for t, v in zip(months(3), xs)]
    df = spark.createDataFrame(rows, "strategy string, ts date, r double")
    out = {r.strategy: r for r in R.bundle(df, ["strategy"]).collect()}
    assert out["up"].sortino is None and out["zero"].sharpe is None and out["one"].ann_std is None
    assert out["mix"].mdd_pct == pytest.approx(28.0) and out["up"].mdd_pct == 0
    level = np.cumprod([1.1, -0.2, 1.5])
    peak = np.maximum.accumulate(level)
    assert out["wipe"].mdd_pct == pytest.approx(-((level - peak) / peak).min() * 100)


def test_equal_weight_strategy(spark, make_panel):
    panel = make_panel(a=[0.1, 0.2], b=[0.3, None]).withColumn("strategy", F.lit("x"))
    weights = O.equal_weights(panel, ["strategy"])
    out = O.portfolio_returns(weights, panel.drop("strategy"), ["strategy"]).collect()
    assert len(out) == 1 and out[0].r == pytest.approx(0.2)


def test_nets_of_many_series_are_solved_together(monkeypatch):
    rnd = np.random.default_rng(5)
    data = [np.c_[np.ones(40), x := rnd.normal(size=(40, 3)) * (1, s, 0.2), x[:, 0] + rnd.normal(size=40)] for s in range(5)]
    folds = np.stack([[p.T @ p for p in np.array_split(d, 4)] for d in data])
    calls, own = [], C.descend
    monkeypatch.setattr(C, "descend", lambda *a: calls.append(1) or own(*a))
    mix, penalty, coef = C.net_paths(folds, (0.5, 1.0), 6, 1e-3)
    assert len(calls) == 6  # once for each penalty, however many the series
    for s in range(5):
        alone = C.net_paths(folds[s:s + 1], (0.5, 1.0), 6, 1e-3)
        assert (mix[s], penalty[s]) == (alone[0][0], pytest.approx(alone[1][0])) and coef[s] == pytest.approx(alone[2][0], abs=1e-12)


def test_axes_meet_the_forecasts_of_a_series_as_a_matrix(make_panel):
    pool = N.simple_pool(make_panel(a=X1, b=X2[:70]))
    axes = C.loadings(pool)
    scores = C.project(pool, axes)
    for df in (axes, scores):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "FlatMapCoGroupsInArrow" in plan and "Generate explode" not in plan  # no row for each forecast and axis
    rows, weights = pool.toPandas(), axes.toPandas()
    both = rows.merge(weights, on=["series_id", "model"])
    want = ((both.yhat - both["mean"]) / both.scale * both.weight).groupby([both.series_id, both.ts, both.k]).sum()
    got = scores.toPandas().set_index(["series_id", "ts", "k"])["score"]
    assert len(got) == len(want) and got.reindex(want.index).to_numpy() == pytest.approx(want.to_numpy(), abs=1e-12)


def test_forecasts_of_a_series_stay_in_the_task_of_its_panel(spark, make_panel):
    rows = [*make_panel(a=X1, b=X2[:70], c=[1.0], d=[1.0, 2.0], e=[1.0, None, *X1[:40]]).collect(), (None, dt.date(1995, 1, 31), 1.0), (None, dt.date(1995, 2, 28), 2.0)]
    panel = spark.createDataFrame(rows, "series_id string, ts date, value double").localCheckpoint()
    makers = [N.random_walk, N.sma_bank, M.ema_bank]
    pool = M.bank(panel, makers)
    key = lambda r: (r.series_id or "", r.model, r.ts, repr(r.yhat))
    alone = [r for f in makers for r in f(panel).select(*pool.columns).where("yhat is not null").collect()]
    assert sorted(map(key, pool.collect())) == sorted(map(key, alone)) and {r.series_id for r in alone} == {"a", "b", "d", "e", None}
    twice = M.bank(panel, [N.random_walk, N.random_walk, M.ema_bank])
    assert twice.where("model = 'RW'").count() == 2 * pool.where("model = 'RW'").count()
    pool = M.bank(make_panel(a=X1, b=X2[:70]).localCheckpoint(), makers)
    axes = C.loadings(pool)
    plan = axes._jdf.queryExecution().executedPlan().toString().splitlines()
    # Only the panel is shuffled, once for the moments and once for the axes: below an exchange there is no forecast yet.
    moved = [below for own, below in zip(plan, plan[1:]) if "Exchange" in own]
    assert len(moved) == 2 and all("Scan" in x or "Filter" in x for x in moved) and not any("Union" in x for x in plan)
    weights = lambda df: {(r.series_id, r.k, r.model): r.weight for r in df.collect()}
    got, want = weights(axes), weights(C.loadings(pool.localCheckpoint()))  # the models of a series meet in one matrix
    assert got == pytest.approx(want, abs=1e-9) and {m for s, k, m in got if (s, k) == ("a", 1)} == {"RW", *[f"SMA({q})" for q in range(3, 7)], *[f"EMA({q})" for q in range(3, 31)]}


@pytest.mark.parametrize("short", [0.0, 0.3])
@pytest.mark.parametrize("n, shift", [(6, 0.0), (50, 0.0), (50, -0.1), (20, -3.0), (3000, 0.0)])
def test_tangent_from_factors_is_that_of_the_matrix(n, shift, short):
    x = np.random.default_rng(n).normal(size=(24, n)) * 0.3 + shift
    mu, c = x.mean(axis=0), (x - x.mean(axis=0)) / np.sqrt(23)
    many = T.Factors(c * np.sqrt(0.5), 0.5 * (c * c).sum(axis=0))
    w, ratio, gap = T.sharpe_search(mu, many, short)
    assert w.sum() == pytest.approx(1) and np.maximum(-w, 0).sum() <= short + 1e-9
    if n <= 50:
        cov = c.T @ c / 2 + np.diag(many.rest)
        want = T.sharpe_search(mu, cov, short)
        assert ratio == pytest.approx(want[1], abs=1e-9) and w == pytest.approx(want[0], abs=1e-6)
        assert T.best_corner_of_many(mu, many, short).tolist() == T.best_corner(mu, cov, short).tolist()
    if mu.max() > 0:
        assert gap < 1e-9


def test_windows_of_all_series_need_no_column_for_each(make_panel, monkeypatch):
    panel = make_panel(a=X1[:40], b=X2[:40], c=[None, *X1[1:40]])
    named = {r.ts: r.window for r in D.date_windows(panel, ["a", "b", "c"], 3).collect()}
    monkeypatch.setattr(D, "wide", None)
    every = D.date_windows(panel, window=3)
    assert {r.ts: r.window for r in every.collect()} == named and len(named) == 36
    row = every.select("window", D.window_moments("window").alias("m"), D.window_factors("window").alias("f")).first()
    factors = np.array([list(v) for v in row.f.cov])
    assert factors.T @ factors + np.diag(row.f.rest) == pytest.approx(np.array([list(v) for v in row.m.cov]))
    assert list(row.f.mu) == pytest.approx(list(row.m.mu))


def test_results_of_many_series_leave_a_task_in_parts(spark, monkeypatch):
    sizes, own = [], pd.concat
    monkeypatch.setattr(M.pd, "concat", lambda parts, **kw: sizes.append(len(parts)) or own(parts, **kw))
    taken = {}
    frame = type("F", (), {"mapInPandas": lambda self, run, schema: taken.setdefault("run", run)})()
    M.per_series(frame, lambda row: pd.DataFrame({"a": [row.a]}), "a int")
    out = list(taken["run"](iter([pd.DataFrame({"a": range(1000)})])))
    assert max(sizes) <= 64 and own(out).a.tolist() == list(range(1000))


def test_filters_of_sound_covariances_need_no_roots(monkeypatch):
    rnd = np.random.default_rng(3)
    x, y = rnd.normal(size=(60, 3)), rnd.normal(size=60)
    masks = np.array(list(product([0.0, 1.0], repeat=3)))
    with monkeypatch.context() as m:
        m.setattr(np.linalg, "eigvalsh", None)
        got = C.filter_paths(y, x, masks, 0.99, 10)
    monkeypatch.setattr(C, "_surely_sound", lambda cov: False)
    want = C.filter_paths(y, x, masks, 0.99, 10)
    assert got[0] == pytest.approx(want[0]) and got[1] == pytest.approx(want[1])
