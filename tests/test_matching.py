"""The auction against an exact solver, the re-ranking loop against the same loop in plain Python, agreement by hand."""

import random
from statistics import median

import numpy as np
import pytest
from plain import least_assignment
from pyspark.sql import functions as F

from tidemark.operators import matching as X


def solve(cost: np.ndarray) -> float:
    c = cost if cost.shape[0] <= cost.shape[1] else cost.T
    return float(c[np.arange(len(c)), least_assignment(c)].sum())


def grid(spark, blocks):
    rows = [(k, int(i), int(j) + 1000, float(c[i, j])) for k, c in blocks.items() for i in range(c.shape[0]) for j in range(c.shape[1])]
    return spark.createDataFrame(rows, "k string, a long, b long, cost double")


def test_auction_is_within_its_bound_of_the_exact_solver(spark):
    rng = np.random.default_rng(4)
    x = rng.random((300, 4))
    near = np.abs(x[:, None] - (x + 0.05 * rng.standard_normal((300, 4)))[None]).sum(2)
    blocks = {"large": near, "wide": rng.random((5, 9)), "tall": rng.random((9, 4)), "equal": np.ones((3, 3)), "one": np.array([[2.0]])}
    got: dict = {}
    for r in X.auction(grid(spark, blocks), ["k"], 0.02).collect():
        got.setdefault(r.k, []).append(r)
    for k, c in blocks.items():
        rows = got[k]
        assert len(rows) == len({r.a for r in rows}) == len({r.b for r in rows}) == min(c.shape)
        assert all(r.cost == c[r.a, r.b - 1000] for r in rows)
        total = sum(r.cost for r in rows)
        assert solve(c) - 1e-9 <= total <= solve(c) + 0.02 * (c.max() - c.min()) + 1e-9


def test_auction_of_candidate_lists_leaves_ids_alone_only_where_it_must(spark):
    rows = [("k", 1, 11, 1.0), ("k", 2, 11, 1.5), ("k", 3, 11, 1.2), ("k", 3, 12, 1.1), (None, 1, 11, 5.0), (None, None, 12, 1.0)]
    got = {(r.k, r.a, r.b) for r in X.auction(spark.createDataFrame(rows, "k string, a long, b long, cost double"), ["k"], 0.01).collect()}
    assert got == {("k", 1, 11), ("k", 3, 12), (None, 1, 11)}
    assert X.auction(spark.createDataFrame([], "k string, a long, b long, cost double"), ["k"]).count() == 0


def test_rounds_in_one_task_equal_rounds_of_joins(spark):
    rng = np.random.default_rng(9)
    blocks = {"ties": np.round(rng.random((12, 12)) * 3), "wide": rng.random((6, 15)), "tall": rng.random((13, 7)), "equal": np.ones((4, 4))}
    pairs = grid(spark, blocks)
    some = pairs.filter("k = 'wide' OR (a + b) % 3 > 0").union(pairs.filter("a = 1").withColumn("cost", F.col("cost") + 1))
    for d in (pairs, some):
        one, joined, mixed = (sorted(map(tuple, X.auction(d, ["k"], 0.05, whole=w).collect())) for w in (8_000_000, 0, 95))
        assert one == joined == mixed


AXES = {"n": 1.0, "mean": 1.2}
W = X.Weights(AXES, sets=0.5, least_anchors=3)


def population(seed, n=14, noise=0.4):
    """Rows (entity, season, block, side, n, mean): b follows a, with noise and its own scale."""
    rng = random.Random(seed)
    a, b = [], []
    for e in range(n):
        base, rate = rng.uniform(0, 30), rng.uniform(0, 10)
        for s in (1, 2, 3):
            if rng.random() < 0.85:
                a.append((e, s, "x", e % 2, base + rng.gauss(0, noise), rate + rng.gauss(0, noise)))
            if rng.random() < 0.85:
                b.append((100 + e, s, "x", e % 2, 3 * base + rng.gauss(0, noise), rate / 2 + rng.gauss(0, noise)))
    sets = [(e, 100 + f, s, rng.random()) for e in range(n) for f in range(n) for s in (1, 2, 3) if rng.random() < 0.5]
    return a, b, sets


def ranks(rows, sure):
    out = {}
    for cell in {(r[1], r[3]) for r in rows}:
        own = [r for r in rows if (r[1], r[3]) == cell]
        ref = own if sure is None else [r for r in own if r[0] in sure]
        ref = ref if len(ref) >= W.least_anchors else own
        for r in own:
            out[r[0], r[1]] = [sum((x[i] < r[i]) + (x[i] <= r[i]) for x in ref) / (2 * len(ref)) for i in (4, 5)]
    return out


def costs(ra, rb, sets, seasons, factors=None):
    f = factors or {}
    score = {(a, b, s): v for a, b, s, v in sets}
    sa, sb = ({e: {s for x, s in r if x == e and s in seasons} for e, _ in r} for r in (ra, rb))
    out = {}
    for a in sa:
        for b in sb:
            both = sa[a] & sb[b]
            if both:
                c = sum(AXES[m] * f.get(m, 1) * abs(ra[a, s][i] - rb[b, s][i]) for s in both for i, m in enumerate(AXES))
                c += sum(W.sets * f.get("set", 1) * (1 - score[a, b, s] if (a, b, s) in score else W.unknown_set) for s in both)
                out[a, b] = c + W.only_a * len(sa[a] - both) + W.only_b * len(sb[b] - both)
    return out


def matched(cost):
    ids_a, ids_b = sorted({a for a, _ in cost}), sorted({b for _, b in cost})
    m = np.array([[cost.get((a, b), 1e6) for b in ids_b] for a in ids_a])
    flip = m.shape[0] > m.shape[1]
    col = least_assignment(m.T if flip else m)
    return {(ids_a[j], ids_b[i]) if flip else (ids_a[i], ids_b[j]) for i, j in enumerate(col)}


def plain_loop(a, b, sets, rounds):
    sure_a = sure_b = None
    for _ in range(rounds):
        ra, rb = ranks(a, sure_a), ranks(b, sure_b)
        cost = costs(ra, rb, sets, {1, 2, 3})
        pairs = matched(cost)
        margin = {(x, y): min((c for (p, q), c in cost.items() if p == x and q != y), default=float("inf")) - cost[x, y] for x, y in pairs}
        middle = median(v for v in margin.values() if v != float("inf"))
        sure = {p for p, v in margin.items() if v >= middle}
        sure_a, sure_b = {x for x, _ in sure}, {y for _, y in sure}
    return ra, rb, cost, pairs, margin, sure


COLUMNS = "entity long, season int, block string, side long, n double, mean double"


def frames(spark, a, b, sets):
    return spark.createDataFrame(a, COLUMNS), spark.createDataFrame(b, COLUMNS), spark.createDataFrame(sets, "a long, b long, season int, score double")


@pytest.mark.parametrize("seed", [1])
def test_loop_equals_plain_python(spark, seed):
    a, b, sets = population(seed)
    da, db, ds = frames(spark, a, b, sets)
    dist, out = X.rematch(da, db, W, ["block"], ["season", "side"], [1, 2, 3], ds, rounds=3, tolerance=1e-3)
    ra, rb, cost, pairs, margin, sure = plain_loop(a, b, sets, 3)
    got = {(r.a, r.b): r for r in out.collect()}
    assert set(got) == pairs
    assert {p for p, r in got.items() if r.anchor} == sure
    for p, r in got.items():
        assert abs(r.cost - cost[p]) < 1e-9 and abs(r.margin_row - margin[p]) < 1e-9 and r.round == 2
    # A round against everybody gives other ranks than one against anchors.
    assert ranks(a, None) != ra

    arms = X.jitters(list(AXES), 3, seed=7) + [X.Arm("s2", "season", [2]), X.Arm("late", "era", [2, 3])]
    votes = X.arm_matches(dist, da, db, W, ["block"], arms, [1, 2, 3], tolerance=1e-3).collect()
    for arm in arms:
        want = matched(costs(ra, rb, sets, set(arm.seasons or [1, 2, 3]), arm.factors))
        mine = {(r.a, r.b) for r in votes if r.arm == arm.name}
        all_costs = costs(ra, rb, sets, set(arm.seasons or [1, 2, 3]), arm.factors)
        assert mine == want or abs(sum(all_costs[p] for p in mine) - sum(all_costs.get(p, 1e6) for p in want)) < 2e-2


def test_agreement_by_hand(spark):
    base = spark.createDataFrame([(1, 11), (2, 12), (3, 13)], "a long, b long")
    v = [(f"j{i}", "jitter", 1, 11) for i in range(4)] + [("j0", "jitter", 2, 12), ("j1", "jitter", 2, 19), ("j2", "jitter", 2, 12), ("j3", "jitter", 2, 12)]
    v += [("s1", "season", 1, 11), ("s2", "season", 1, 15), ("s3", "season", 1, 15), ("s1", "season", 2, 12), ("s2", "season", 2, 17)]
    v += [("early", "era", 1, 11), ("late", "era", 1, 11), ("early", "era", 2, 12), ("late", "era", 2, 19), ("early", "era", 3, 13), ("u1", "cutoff", 1, 11), ("u1", "cutoff", 2, 19)]
    votes = spark.createDataFrame(v, "arm string, kind string, a long, b long")
    agreed = X.agreement(base, votes)
    got = {r.a: (r.stability, r.season_mode, r.n_seasons, r.agree, r.eras, r.same_era) for r in agreed.collect()}
    assert got == {1: (1.0, 15, 3, False, 2, True), 2: (0.75, 12, 2, True, 2, False), 3: (0.0, None, 0, True, 1, True)}
    p = {(r.a, r.b): round(r.p, 6) for r in X.posterior(base, votes, 2).collect()}
    assert p == {(1, 11): round(7 / 9, 6), (1, 15): round(2 / 9, 6), (2, 12): 0.75, (2, 17): 0.125, (3, 13): 1.0}
    pairs = base.withColumns({"co": F.when(F.col("a") == 3, 0).otherwise(2), "margin_row": F.lit(1.0)})
    assert {r.a: r.tier for r in X.sure_tiers(pairs, agreed.withColumn("agree", F.lit(True)), 0.5).collect()} == {1: 1, 2: 2, 3: 3}
    assert [(r.arm, r.common, r.same, r.agreement) for r in X.asof_agreement(votes, base).collect()] == [("u1", 2, 1, 0.5)]


def test_polarity_prefers_the_true_mapping(spark):
    a, b, _ = population(3, noise=0.05)
    da, db, _ = frames(spark, a, b, [(0, 0, 0, 0.0)])
    w = X.Weights(AXES, sets=0.0)
    shifted = da.withColumn("n", F.col("n") + 20 * F.col("side")), db.withColumn("n", F.col("n") + 60 * F.col("side"))
    got = {r.polarity: r for r in X.polarity(*shifted, w, ["block"], "side", {"own": {0: 0, 1: 1}, "exchanged": {0: 1, 1: 0}}, [1, 2, 3], 1e-2).collect()}
    assert got["own"].ratio == 1 and got["exchanged"].ratio > 1.2
