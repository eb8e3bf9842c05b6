"""Fits against numpy, plain pooling and grid searches over the same rows."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.operators import fitting as T
from tidemark.operators import metrics as M


def plain_pools(rows):
    """Pooling of adjacent violators over all distinct values."""
    cells: dict = {}
    for p, y in rows:
        n, s = cells.get(p, (0, 0))
        cells[p] = (n + 1, s + y)
    pools: list = []
    for p in sorted(cells):
        pools.append([p, p, *cells[p]])
        while len(pools) > 1 and pools[-2][3] / pools[-2][2] >= pools[-1][3] / pools[-1][2]:
            _, hi, n, s = pools.pop()
            pools[-1][1:] = [hi, pools[-1][2] + n, pools[-1][3] + s]
    return [(lo, hi, n, s / n) for lo, hi, n, s in pools]


def isotonic_value(pools, p):
    """Linear between pools, constant within and beyond."""
    xs = [x for lo, hi, _, r in pools for x in ((lo, r), (hi, r))]
    return float(np.interp(p, [x for x, _ in xs], [r for _, r in xs]))


@pytest.mark.parametrize("shape", ["noise", "falling", "rising", "steps"])
def test_isotonic_equals_plain_pooling(spark, shape):
    rng = random.Random(3)
    rate = {"noise": lambda p: 0.3, "falling": lambda p: 1 - p, "rising": lambda p: p, "steps": lambda p: 0.2 + 0.6 * (p > 0.5)}[shape]
    rows = [(p, float(rng.random() < rate(p))) for p in (round(rng.random(), 3) for _ in range(1500))]
    df = spark.createDataFrame([*rows, (None, 1.0), (0.5, None), (float("nan"), 1.0)], "p double, y double").repartition(7)
    pools = T.isotonic_pools(df)
    got = sorted((r.lo, r.hi, r.n, r.rate) for r in pools.collect())
    want = plain_pools(rows)
    assert [(a, b, n) for a, b, n, _ in got] == [(a, b, n) for a, b, n, _ in want]
    assert np.allclose([r[3] for r in got], [r[3] for r in want])
    asked = [-1.0, 0.0, 0.25, 0.5004, 0.77777, 1.0, 3.0]
    at = T.isotonic_apply(spark.createDataFrame([(v,) for v in [*asked, None]], "p double"), pools)
    found = {r.p: r.c for r in at.collect()}
    assert found.pop(None) is None
    assert all(math.isclose(found[v], isotonic_value(want, v), abs_tol=1e-9) for v in asked)


def test_isotonic_of_nothing(spark):
    assert T.isotonic_pools(spark.createDataFrame([], "p double, y double")).collect() == []


def test_prior_shift_moves_the_logit(spark):
    (r,) = spark.range(1).select(T.prior_shift(F.lit(0.3), 0.2, 0.4).alias("p")).collect()
    logit = lambda v: math.log(v / (1 - v))
    assert math.isclose(r.p, 1 / (1 + math.exp(-(logit(0.3) + logit(0.4) - logit(0.2)))), rel_tol=1e-12)


def _calibration_rows(n=3000, seed=5):
    rng = np.random.default_rng(seed)
    p = rng.uniform(0.05, 0.6, n)
    z, t = rng.normal(0.2, 0.5, n), rng.normal(-0.1, 0.3, n)
    m = 1 / (1 + np.exp(-(0.1 + 1.3 * np.log(p / (1 - p)) + 0.4 * (z - 0.2) - 0.7 * (t + 0.1))))
    y = (rng.random(n) < m).astype(float)
    return p, z, t, y


def _brier(theta, p, z, t, y, zc=0.2, tc=-0.1):
    x = theta[0] + theta[1] * np.log(p / (1 - p)) + theta[2] * (z - zc) + theta[3] * (t - tc)
    return np.mean((1 / (1 + np.exp(-x)) - y) ** 2)


def test_recalibration_beats_a_grid_search(spark):
    p, z, t, y = _calibration_rows()
    df = spark.createDataFrame([tuple(map(float, r)) for r in zip(p, z, t, y)], "p double, z double, t double, y double")
    got = T.recalibrate([(df, 0.2, -0.1)])
    best = np.array([got[k] for k in "abcd"])
    assert math.isclose(got["brier"], _brier(best, p, z, t, y), abs_tol=1e-12)
    step, centre, least = np.array([0.2, 0.4, 0.4, 0.6]), np.array([0.0, 1.0, 0.0, 0.0]), np.inf
    low, high = np.array([b[0] for b in T.BOUNDS]), np.array([b[1] for b in T.BOUNDS])
    for _ in range(14):  # a grid that shrinks around its best point
        cells = [np.clip(centre + step * np.array(d), low, high) for d in np.ndindex(3, 3, 3, 3) for d in [np.array(d) - 1]]
        values = [_brier(c, p, z, t, y) for c in cells]
        if min(values) < least:
            least, centre = min(values), cells[int(np.argmin(values))]
        else:
            step = step / 2
    assert got["brier"] <= least + 1e-6


def test_recalibration_keeps_its_bounds_and_pools_batches(spark):
    p, z, t, y = _calibration_rows()
    rows = [tuple(map(float, r)) for r in zip(p, z, t, 1 - y)]  # the labels turned around: the slope would fall below its bound
    rows[0] = (rows[0][0], None, float("nan"), rows[0][3])
    df = spark.createDataFrame(rows, "p double, z double, t double, y double")
    got = T.recalibrate([(df, 0.2, -0.1)])
    assert got["b"] == 0.2 and all(lo - 1e-12 <= got[k] <= hi + 1e-12 for k, (lo, hi) in zip("abcd", T.BOUNDS))
    whole = T.recalibrate([(df, 0.2, -0.1)])
    halves = T.recalibrate([(df.filter("p < 0.3"), 0.2, -0.1), (df.filter("p >= 0.3"), 0.2, -0.1)])
    assert all(math.isclose(whole[k], halves[k], abs_tol=1e-6) for k in "abcd")
    out = df.select(T.recalibrated(whole, F.col("p"), F.col("z"), F.col("t")).alias("c")).collect()
    assert all(0 < r.c < 1 for r in out)


def test_one_hot_member_equals_numpy(spark):
    rng = np.random.default_rng(2)
    a, b = rng.integers(0, 4, 1200), rng.integers(0, 3, 1200)
    y = (rng.random(1200) < 1 / (1 + np.exp(-(0.5 * a - 0.8 * b - 0.3)))).astype(float)
    df = spark.createDataFrame([(f"a{i}" if i else None, int(j), float(k)) for i, j, k in zip(a, b, y)], "a string, b long, y double")
    got = {(r.column, r.value): r.weight for r in T.one_hot_member(df, ["a", "b"]).collect()}
    x = np.column_stack([np.ones(1200), *(a == i for i in range(4)), *(b == i for i in range(3))]).astype(float)
    pen = np.r_[0.0, np.ones(7)]
    w = np.zeros(8)
    for _ in range(200):
        m = 1 / (1 + np.exp(-x @ w))
        j = x * (m * (1 - m))[:, None]
        w = w - np.linalg.solve(j.T @ j + np.diag(pen) + 1e-9 * np.eye(8), j.T @ (m - y) + pen * w)
    want = {(None, None): w[0], ("a", None): w[1], **{("a", f"a{i}"): w[1 + i] for i in (1, 2, 3)}, **{("b", str(i)): w[5 + i] for i in range(3)}}
    assert set(got) == set(want) and all(abs(got[k] - want[k]) < 1e-5 for k in want)


def test_stacking_equals_numpy_and_looks_at_no_later_season(spark):
    rng = np.random.default_rng(9)
    n = 900
    s, m = rng.integers(1, 4, n), rng.integers(0, 3, n)
    x = rng.normal(size=(n, 3))
    y = (rng.random(n) < 1 / (1 + np.exp(-(x[:, 0] - 0.5 * x[:, 1])))).astype(float)
    rows = [(int(a), int(b), *map(float, v), float(c)) for a, b, v, c in zip(s, m, x, y)]
    schema = "season int, month int, u double, v double, w double, y double"
    members = {"first": ["u", "v"], "second": ["w"]}
    out, _ = T.stack_by_blocks(spark.createDataFrame(rows, schema), members, "y", "season", "month", [1.0, 100.0])
    got = {(r.fit, r.lam): r for r in out.collect()}
    cols = {"first": [0, 1], "second": [2]}
    fit = lambda xs, ys, lam: np.linalg.solve(xs.T @ xs + lam * np.eye(xs.shape[1]), xs.T @ ys)
    one = lambda xs: np.column_stack([xs, np.ones(len(xs))])
    for season in (1, 2):
        oof = np.zeros((n, 2))
        for b in range(3):
            for k, on in enumerate(cols.values()):
                tr, held = (s == season) & (m != b), (s == season) & (m == b)
                oof[held, k] = one(x[held][:, on]) @ fit(one(x[tr][:, on]), y[tr], 1.0)
        a, t = s == season, s == season + 1
        served = np.column_stack([one(x[t][:, on]) @ fit(one(x[a][:, on]), y[a], 1.0) for on in cols.values()])
        for lam in (1.0, 100.0):
            w = fit(one(oof[a]), y[a], lam)
            r = got[season, lam]
            assert np.allclose(r.weights, w) and math.isclose(r.brier, np.mean((one(served) @ w - y[t]) ** 2)) and math.isclose(r.fixed, np.mean((served.mean(axis=1) - y[t]) ** 2))
    assert set(got) == {(f, lam) for f in (1, 2) for lam in (1.0, 100.0)}
    # Labels of the target season turned around: no weights change.
    turned, _ = T.stack_by_blocks(spark.createDataFrame([(*r[:5], 1 - r[5] if r[0] == 3 else r[5]) for r in rows], schema), members, "y", "season", "month", [1.0])
    assert {r.fit: r.weights for r in turned.collect()}[2] == got[2, 1.0].weights


def test_canonical_correlations_equal_numpy(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(400, 5)) @ rng.normal(size=(5, 5)) + 2
    df = spark.createDataFrame([tuple(map(float, r)) for r in x], "a double, b double, c double, d double, e double")
    q = [np.linalg.qr(v)[0] for v in ((x - x.mean(0))[:, :2], (x - x.mean(0))[:, 2:])]
    assert np.allclose(T.canonical_correlations(df, ["a", "b"], ["c", "d", "e"]), np.linalg.svd(q[0].T @ q[1], compute_uv=False))
    q = [np.linalg.qr(v)[0] for v in (x[:, :2], x[:, 2:])]
    assert np.allclose(T.subspace_angles(df, ["a", "b"], ["c", "d", "e"]), np.arccos(np.clip(np.linalg.svd(q[0].T @ q[1], compute_uv=False), 0, 1)), atol=1e-6)


def test_partition_correlation_by_one_hot_columns(spark):
    rng = np.random.default_rng(6)
    a = rng.integers(0, 4, 500)
    b = np.where(rng.random(500) < 0.5, a, rng.integers(0, 3, 500)) % 3
    df = spark.createDataFrame([(int(i) if i else None, f"x{j}") for i, j in zip(a, b)], "a long, b string")
    ca, cb = np.eye(4)[a] - np.eye(4)[a].mean(0), np.eye(3)[b] - np.eye(3)[b].mean(0)
    q = [np.linalg.svd(v, full_matrices=False) for v in (ca, cb)]
    u = [v[0][:, v[1] > 1e-9] for v in q]
    assert math.isclose(T.partition_correlation(df, "a", "b"), np.linalg.svd(u[0].T @ u[1], compute_uv=False)[0], rel_tol=1e-9)


def test_gain_and_geometry_of_models(spark):
    rng = np.random.default_rng(8)
    n = 600
    z = rng.normal(size=(n, 2))
    y = (rng.random(n) < 0.4).astype(float)
    a = 0.4 + 0.05 * rng.normal(size=n) + 0.1 * (y - 0.4)
    b = 0.4 + 0.05 * rng.normal(size=n) + 0.05 * (y - 0.4)
    df = spark.createDataFrame([(*map(float, r),) for r in zip(z[:, 0], z[:, 1], y, a, b)], "u double, v double, y double, a double, b double")
    e = a - y
    k = 1e5 / (y.mean() * (1 - y.mean()))
    proj = z @ np.linalg.lstsq(z, e, rcond=None)[0]
    assert math.isclose(T.joint_gain(df, "y", "a", ["u", "v"]), k * np.mean(proj**2), rel_tol=1e-9)
    fit = lambda *c: (x := np.column_stack([np.ones(n), *c])) @ np.linalg.lstsq(x, y, rcond=None)[0]
    score = lambda p: 1e5 - k * np.mean((p - y) ** 2)
    g = T.model_geometry(df, "y", "a", "b")
    d = fit(b) - fit(a)
    assert math.isclose(g["score_a"], score(fit(a)), rel_tol=1e-9) and math.isclose(g["distance"], np.mean(d * d) ** 0.5, rel_tol=1e-9)
    assert math.isclose(g["refit_gain"], score(fit(a, b)) - score(fit(a)), rel_tol=1e-6)
    assert g["gain"] <= g["refit_gain"] + 1e-6
    rest = d - np.column_stack([np.ones(n), fit(a)]) @ np.linalg.lstsq(np.column_stack([np.ones(n), fit(a)]), d, rcond=None)[0]
    assert math.isclose(g["apart"], (np.mean(d * d) - np.mean((fit(a) - fit(a).mean()) * d) ** 2 / np.var(fit(a))) ** 0.5, rel_tol=1e-6) and np.mean(rest**2) ** 0.5 <= g["apart"] + 1e-9


def plain_em(x, steps=200):
    mu = np.quantile(x, [0.25, 0.75])
    w, v, last = np.full(2, 0.5), np.full(2, x.var()), -np.inf
    for _ in range(steps):
        f = w / np.sqrt(2 * np.pi * v) * np.exp(-((x[:, None] - mu) ** 2) / (2 * v))
        r = f / f.sum(1, keepdims=True)
        ll = np.log(f.sum(1)).mean()
        n = r.sum(0)
        w, mu = n / len(x), (r * x[:, None]).sum(0) / n
        v = (r * x[:, None] ** 2).sum(0) / n - mu**2
        if abs(ll - last) < 1e-9:
            break
        last = ll
    return w, mu, np.sqrt(v)


def test_mixture_equals_plain_python(spark):
    rng = np.random.default_rng(4)
    x = np.round(np.r_[rng.normal(0.5, 0.2, 300), rng.normal(2.0, 0.4, 200)], 2)
    df = spark.createDataFrame([(float(v),) for v in x] + [(None,), (float("nan"),)], "v double")
    m = T.normal_mixture(df, "v")
    w, mu, sd = plain_em(x)
    assert np.allclose([m["w0"], m["w1"]], w, atol=1e-6) and np.allclose([m["mu0"], m["mu1"]], mu, atol=1e-6) and np.allclose([m["sd0"], m["sd1"]], sd, atol=1e-6)
    (t,) = T.mixture_threshold(df, "v").collect()
    assert t.bimodal and 0.9 < t.threshold < 1.6


def test_mixture_falls_back_to_a_quantile(spark):
    few = spark.createDataFrame([(float(v),) for v in range(9)], "v double")
    assert T.mixture_threshold(few, "v").collect()[0] == (2.0, False)
    flat = spark.createDataFrame([(1.0,)] * 80, "v double")
    assert T.mixture_threshold(flat, "v").collect()[0] == (1.0, False)
    assert T.mixture_threshold(flat.limit(0), "v").collect()[0] == (None, False)


def test_pair_blend_is_best_at_its_weight_and_even_at_twice_it(spark):
    rng = np.random.default_rng(12)
    y = (rng.random(500) < 0.4).astype(float)
    a, b = 0.4 + 0.1 * rng.normal(size=500), 0.4 + 0.1 * rng.normal(size=500) + 0.02 * (y - 0.4)
    df = spark.createDataFrame([(*map(float, r),) for r in zip(y, a, b)], "y double, a double, b double")
    g = T.pair_blend(df, "y", "a", "b")
    score = lambda w: 1e5 * (1 - np.mean(((1 - w) * a + w * b - y) ** 2) / (y.mean() * (1 - y.mean())))
    assert math.isclose(score(g["weight"]) - score(0), g["gain"], rel_tol=1e-6) and math.isclose(score(g["break_even"]), score(0), rel_tol=1e-6)
    assert all(score(g["weight"]) >= score(g["weight"] + d) for d in (-0.01, 0.01))
    same = T.pair_blend(df, "y", "a", "a")
    assert same["gain"] == 0 and same["weight"] == 0


def _models(n=400):
    rng = np.random.default_rng(21)
    y = (rng.random(n) < 0.35).astype(float)
    x = np.column_stack([0.35 + 0.2 * rng.normal(size=n) + c * (y - 0.35) for c in (0.1, 0.3, 0.2)])
    return x, y


def test_ridge_equals_numpy(spark):
    x, y = _models()
    df = spark.createDataFrame([(*map(float, r), float(v)) for r, v in zip(x, y)], "a double, b double, c double, y double")
    sd = x.std(axis=0)
    d = np.column_stack([x / sd, np.ones(len(y))])
    w = np.linalg.solve(d.T @ d + 10 * np.eye(4), d.T @ y)
    got = M.ridge(df, ["a", "b", "c"], "y", 10.0)
    assert np.allclose([got[k] for k in ("a", "b", "c", "intercept")], [*(w[:3] / sd), w[3]])


def test_greedy_selection_equals_plain_python(spark):
    x, y = _models()
    df = spark.createDataFrame([(*map(float, r), float(v)) for r, v in zip(x, y)], "a double, b double, c double, y double")
    total, want = np.zeros(len(y)), []
    for r in range(1, 6):
        loss, best = min((np.mean(((total + x[:, i]) / r - y) ** 2), i) for i in range(3))
        total = total + x[:, best]
        want.append((r, "abc"[best], loss))
    got = [(r["round"], r.model, r.brier) for r in M.greedy_selection(df, ["a", "b", "c"], 5).orderBy("round").collect()]
    assert [g[:2] for g in got] == [w[:2] for w in want] and np.allclose([g[2] for g in got], [w[2] for w in want])
