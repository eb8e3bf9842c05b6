"""The forest against brute force: recall at each size, exact scores, copies, ties and odd vectors."""

import math
import random

import numpy as np
import pytest
from compare import SMALL
from pyspark.sql import functions as F

from tidemark.llm import forest, queries


def cosines(rows):
    x = np.array([v for _, v in rows], float)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    return x @ x.T


def brute(rows, step=50, top=5):
    """{query: ids of the nearest}, ties to the smaller id."""
    s = cosines(rows)
    ids = [i for i, _ in rows]
    return {ids[q]: sorted((-round(s[q, k], 12), ids[k]) for k in range(len(ids)) if ids[k] != ids[q])[:top] for q in range(len(ids)) if ids[q] % step == 0}


def run(spark, rows, step=50, **more):
    d = spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(5)
    got: dict = {}
    for r in sorted(forest.nearest(d, F.col("vec_id") % step == 0, **more).collect(), key=lambda r: (r.query_id, r.rank)):
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
        assert r.rank == len(got[r.query_id])
    return got


def recall(got, want):
    return np.mean([len({i for i, _ in got[q]} & {i for _, i in w}) / len(w) for q, w in want.items()])


def isotropic(n, seed=1):
    return [(i, [float(v) for v in row]) for i, row in enumerate(np.random.default_rng(seed).standard_normal((n, 64)).astype(np.float32))]


@pytest.mark.parametrize("n", [60, 800, 6000])
def test_recall_without_any_structure(spark, n):
    rows = isotropic(n)
    got, want = run(spark, rows), brute(rows)
    assert set(got) == set(want) and recall(got, want) >= 0.9
    s = cosines(rows)
    assert all(math.isclose(score, s[q, i], rel_tol=1e-12) for q, found in got.items() for i, score in found)


def test_recall_in_clusters_and_hot_prefixes(spark, monkeypatch):
    """A third of the vectors lies close together, so arrays are dealt to parts."""
    monkeypatch.setattr(forest, "ARRAY", 200)
    monkeypatch.setattr(forest, "BLOCK", 256)
    rng = np.random.default_rng(3)
    x = rng.standard_normal((3000, 16))
    x[::3] = np.ones(16) * 3 + 0.05 * rng.standard_normal((1000, 16))
    rows = [(i, [float(v) for v in row]) for i, row in enumerate(x.astype(np.float32))]
    got, want = run(spark, rows), brute(rows)
    assert recall(got, want) >= 0.9 and all(len(v) == 5 for v in got.values())


def test_the_query_of_the_small_table(spark):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{SMALL}/embeddings.parquet").collect()]
    got: dict = {}
    for r in queries.op12_nearest_neighbours(spark, SMALL).collect():
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
    want = brute(rows)
    assert set(got) == set(want) and recall(got, want) >= 0.9 and all(len(v) == 5 for v in got.values())


def test_copies_are_exact(spark):
    """A hot vector with many copies, queries among them: its least ids are the nearest, in order."""
    rows = [(i, [1.0, 2.0, 0.5]) for i in range(0, 900, 3)] + [(i, [float(i % 7), 1.0, float(i % 5)]) for i in range(1, 900, 3)]
    random.Random(2).shuffle(rows)
    got = run(spark, rows)
    want = {q: [i for _, i in w] for q, w in brute(rows).items()}
    assert {q: [i for i, _ in v] for q, v in got.items()} == want
    assert got[0][0][0] == 3 and got[150][0][0] == 0 and abs(got[0][0][1] - 1) < 1e-12


def test_queries_with_few_candidates_meet_every_vector(spark, monkeypatch):
    monkeypatch.setattr(forest, "budget", lambda n, top: 10**9)
    monkeypatch.setattr(forest, "BLOCK", 64)
    rows = isotropic(300)
    assert recall(run(spark, rows), brute(rows)) == 1.0


def test_odd_vectors_ids_and_columns(spark):
    rows = [(0, [1.0, 0.0]), (0, [1.0, 0.0]), (1, None), (2, [0.0, -0.0]), (3, [float("nan"), 1.0]), (4, [float("inf"), 1.0]), (5, [None, 1.0]), (6, []), (7, [1.0, 1.0, 1.0]), (8, [1.0, 1.0]), (None, [1.0, 1.0]), (9, [-1.0, 0.0]), (10, [1e-38, 0.0])]
    d = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumns({c: F.lit("own") for c in ("id", "vec", "asked", "cid", "part", "query", "rank", "score")})
    got = forest.nearest(d, F.col("vec_id") == 0).orderBy("rank").collect()
    assert [(r.query_id, r.vec_id) for r in got] == [(0, 10), (0, 8), (0, None), (0, 9)]
    assert got[0].score == 1 and got[3].score == -1
    assert forest.nearest(d.limit(0), F.col("vec_id") == 0).collect() == []
    assert forest.nearest(d.filter("vec_id = 2"), F.col("vec_id") == 2).collect() == []
    assert forest.nearest(d.filter("vec_id = 0"), F.col("vec_id") == 0).collect() == []
