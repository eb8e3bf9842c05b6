"""One-to-one pairs from lists of cheapest partners: as from all pairs, also where prices outgrow the lists; and that pairs aren't written."""

import importlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.operators import matching as X
from tidemark.operators import resolve as E

AXES = {"n": 1.0, "mean": 1.2}
W = X.Weights(AXES, sets=0.5, least_anchors=3)


def sides(spark, seed, sizes, whole=False):
    """Rows (entity, season, block, n, mean) of both sides; with ``whole`` measures are small integers, so that many costs tie."""
    rng = random.Random(seed)
    out = []
    for far in (0, 1000):
        rows = []
        for k, (n_a, n_b) in enumerate(sizes):
            for e in range(n_b if far else n_a):
                for s in (1, 2, 3):
                    if rng.random() < 0.8:
                        rows.append((far + 100 * k + e, s, f"x{k}", *(float(rng.randrange(4)) if whole else rng.random() for _ in AXES)))
        out.append(spark.createDataFrame([*rows, (None, 1, "x0", 0.0, 0.0), (far + 999, 1, None, 0.0, 0.0)], "entity long, season int, block string, n double, mean double"))
    return out


def all_costs(a, b, weights, seasons):
    a, b = ([r for r in d.collect() if None not in (r.entity, r.block)] for d in (a, b))
    own = [{e: {r.season for r in d if r.entity == e and r.season in seasons} for e in {r.entity for r in d}} for d in (a, b)]
    of_b, cost = {}, {}
    for r in b:
        of_b.setdefault((r.block, r.season), []).append(r)
    for r in a:
        for o in of_b.get((r.block, r.season), []):
            if r.season in seasons:
                k = r.block, r.entity, o.entity
                c, co = cost.get(k, (0.0, 0))
                cost[k] = c + sum(w * abs(r[m] - o[m]) for m, w in zip(AXES, weights, strict=True)), co + 1
    return {k: (c + W.only_a * (len(own[0][k[1]]) - co) + W.only_b * (len(own[1][k[2]]) - co), co) for k, (c, co) in cost.items()}


@pytest.mark.parametrize(("whole", "listed", "tile"), [(False, 2, 5), (False, 3, 2048), (False, 32, 7), (True, 4, 6), (True, 32, 2048)])
def test_lists_find_the_pairs_that_all_pairs_do(spark, whole, listed, tile):
    from tidemark.operators import bidding

    a, b = sides(spark, 5, [(14, 14), (6, 19), (17, 8), (1, 1)], whole)
    arms = [X.Arm("base", "base"), X.Arm("other", "jitter", None, {"n": 2.0}), X.Arm("late", "era", [2, 3])]
    p = X._pricing(W, arms, [1, 2, 3], None)
    wide = [bidding.wide(d, ["block"], "season", "entity", list(AXES)) for d in (a, b)]
    for held in (8_000_000, 0):
        got = bidding.matched(*wide, ["block"], p, 0.05, edges=True, listed=listed, tile=tile, held=held).collect()
        for i, arm in enumerate(arms[:2]):
            costs = all_costs(a, b, p.weights[i].tolist(), arm.seasons or [1, 2, 3])
            pairs = spark.createDataFrame([(*k, c) for k, (c, _) in costs.items()], "block string, a long, b long, cost double")
            mine = {(r.block, r.a, r.b): r for r in got if r.arm == i}
            want = {(r.block, r.a, r.b) for r in X.auction(pairs, ["block"], 0.05).collect()}
            if whole:  # sums in another order may decide a tie
                assert abs(sum(r.cost for r in mine.values()) - sum(costs[k][0] for k in want)) < 0.05 * 4 * max(c for c, _ in costs.values())
            else:
                assert set(mine) == want
            assert all(abs(r.cost - costs[k][0]) < 1e-9 and r.co == costs[k][1] for k, r in mine.items())
            if i == 0:
                for k, r in mine.items():
                    for axis, margin in ((1, r.margin_row), (2, r.margin_col)):
                        others = [c for q, (c, _) in costs.items() if q != k and q[axis] == k[axis]]
                        assert (margin is None) == (not others) and (margin is None or abs(margin - (min(others) - costs[k][0])) < 1e-9)
        late = [r for r in got if r.arm == 2]
        assert len({r.a for r in late}) == len({r.b for r in late}) == len(late)


def test_sets_in_tiles_equal_their_scores_pair_by_pair(spark):
    a, b = sides(spark, 8, [(9, 9)])
    rng = random.Random(2)
    months = []
    for d, n in ((a, 30), (b, 31)):
        rows = [(r.entity, r.season, m, rng.randrange(1, n)) for r in d.collect() if None not in (r.entity, r.block) for m in range(1, 5) if rng.random() < 0.6 and (r.entity + r.season) % 7]
        months.append(spark.createDataFrame(rows, "entity long, season int, key int, size long"))
    near = a.dropna().select(F.col("entity").alias("a")).distinct().crossJoin(b.dropna().select(F.col("entity").alias("b")).distinct())
    scores = E.set_score(near, *months, ["season"], "entity", "key", "size", "key")
    ways = []
    for sets in (X.Sets(*months, range(1, 5)), scores):
        _, out = X.rematch(a, b, W, ["block"], ["season"], [1, 2, 3], sets, rounds=2, tolerance=1e-3)
        ways.append({(r.a, r.b): (r.anchor, round(r.cost, 9), round(r.margin_row, 9), round(r.margin_col, 9)) for r in out.collect()})
    assert ways[0] == ways[1] and len(ways[0]) == 9


def spied(monkeypatch):
    """Rows of every table that operators write."""
    sizes = []
    for name in ("bidding", "matching", "resolve", "joins"):
        try:
            module = importlib.import_module(f"tidemark.operators.{name}")
        except ImportError:
            continue
        if hasattr(module, "materialised"):
            made = module.materialised

            def counted(df, made=made):
                out = made(df)
                sizes.append(out.count())
                return out

            monkeypatch.setattr(module, "materialised", counted)
    return sizes


def test_rounds_write_ids_and_not_pairs(spark, monkeypatch):
    """er10, er8, er12 and er14: 40 x 40 ids have 1,600 pairs and more rows of distances by season."""
    a, b = sides(spark, 3, [(40, 40)])
    scores = spark.createDataFrame([], "a long, b long, season int, score double")
    sizes = spied(monkeypatch)
    last, out = X.rematch(a, b, W, ["block"], ["season"], [1, 2, 3], scores, rounds=2)
    votes = X.arm_matches(last, a, b, W, ["block"], X.jitters(list(AXES), 3), [1, 2, 3])
    assert out.count() == 40 and votes.count() == 120
    assert max(sizes) <= 120


def test_assignments_of_sides_write_ids_and_not_pairs(spark, monkeypatch):
    """er6."""
    a, b = (d.withColumn("side", F.lit(0)) for d in sides(spark, 4, [(40, 40)]))
    sizes = spied(monkeypatch)
    got = X.polarity(a, b, X.Weights(AXES, sets=0.0), ["block"], "side", {"own": {0: 0}, "again": {0: 0}}, [1, 2, 3]).collect()
    assert got[0].pairs == got[1].pairs > 30 and got[0].total == got[1].total
    # Rows an id and season, and ids of both mappings.
    assert max(sizes) <= 250


def test_assignment_by_signatures_writes_ids_and_not_pairs(spark, monkeypatch, tmp_path):
    """er4, against the auction over all pairs."""
    rng = np.random.default_rng(6)
    rows = [(far + e, s, "x", float(rng.random()), [h, 1 - h]) for far in (0, 1000) for e in range(40) for s in (1, 2) for h in [float(rng.random())] if rng.random() < 0.9]
    d = spark.createDataFrame(rows, "entity long, season int, nation string, pct double, hist array<double>")
    a, b = d.filter("entity < 1000"), d.filter("entity >= 1000")
    want = {(r.a, r.b, round(r.cost, 9)) for r in X.auction(E.signature_cost(a, b, ["nation"], "season"), ["nation"]).collect()}
    sizes = spied(monkeypatch)
    got = E.assigned(a, b, ["nation"], "season").collect()
    assert {(r.a, r.b, round(r.cost, 9)) for r in got} == want
    assert max(sizes) <= 80
