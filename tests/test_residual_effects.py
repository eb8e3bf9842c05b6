"""Backfitting over entity and composite keys with nulls, against plain Python; and that rows are joined once for each set of keys."""

import random
from collections import defaultdict

from tidemark.operators import shrinkage as D

SPEC = [("e", ["a"], 10.0), ("g", ["b", "c"], 4.0)]


def plain(rows, passes=3):
    left, off = [r[3] for r in rows], [0.0] * len(rows)
    for _ in range(passes):
        for key, shrink in ((lambda r: r[0], 10.0), (lambda r: r[1:3], 4.0)):
            s, w = defaultdict(float), defaultdict(float)
            for r, x in zip(rows, left, strict=True):
                s[key(r)] += r[4] * x
                w[key(r)] += r[4]
            for i, r in enumerate(rows):
                e = s[key(r)] / (w[key(r)] + shrink)
                left[i] -= e
                off[i] += e
    return {r[:3]: x for r, x in zip(rows, off, strict=True)}


def test_effects_and_joins(spark):
    rng = random.Random(2)
    rows = [(rng.choice([1, 2, 3, None]), rng.choice([1, 2, None]), rng.choice(["x", None]), rng.random() - 0.5, float(rng.randrange(1, 5))) for _ in range(200)]
    d = spark.createDataFrame(rows, "a long, b long, c string, r double, w double").repartition(3)
    fx = D.residual_effects(d, SPEC, "r", "w", 3)
    assert [n for n, _, _ in fx] == ["e1", "g1", "e2", "g2", "e3", "g3"]
    done = D.apply_effects(d.select("a", "b", "c").distinct(), fx)
    want = plain(rows)
    got = {(r.a, r.b, r.c): r.correction for r in done.collect()}
    assert set(got) == set(want) and all(abs(got[k] - want[k]) < 1e-12 for k in want)
    assert done._jdf.queryExecution().optimizedPlan().toString().count("Join LeftOuter") == 2
