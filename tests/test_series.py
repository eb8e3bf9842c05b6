"""Special functions against known values, geometry by simulation of its definition, halving and provenance by plain Python."""

import json
import math
from statistics import NormalDist

import pytest
from pyspark.sql import functions as F

from tidemark.functions import scalars as C
from tidemark.operators import metrics as M
from tidemark.operators import shrinkage as D
from tidemark.plans import scoring as S


def test_normal_distribution_to_1e_8(spark):
    xs = [-12.0, -7.5, -6.01, -3.0, -0.5, 0.0, 0.1, 1.0, 2.5, 5.9, 6.5, 8.0]
    for r in spark.createDataFrame([(x,) for x in xs], "x double").select("x", C.normal_cdf_series(F.col("x")).alias("p")).collect():
        assert math.isclose(r.p, 0.5 * math.erfc(-r.x / 2**0.5), rel_tol=1e-8, abs_tol=1e-300)
    ps = [1e-9, 0.001, 0.05, 0.5, 0.8, 0.999999]
    for r in spark.createDataFrame([(p,) for p in [*ps, 0.0, 1.0, None]], "p double").select("p", C.normal_quantile(F.col("p")).alias("x")).collect():
        assert r.x is None if r.p in (0.0, 1.0, None) else abs(r.x - NormalDist().inv_cdf(r.p)) < 1e-8


def q1(a, b, n=4000):
    """Marcum Q by integration of the Rice density."""
    bessel = lambda x: sum((x / 2) ** (2 * k) / math.factorial(k) ** 2 for k in range(60))
    h = b / n
    f = lambda r: r * math.exp(-(r * r + a * a) / 2) * bessel(a * r)
    return 1 - h / 3 * (f(0) + f(b) + 4 * sum(f((2 * i + 1) * h) for i in range(n // 2)) + 2 * sum(f(2 * i * h) for i in range(1, n // 2)))


def test_marcum_q_equals_the_integral(spark):
    pairs = [(0.0, 1.0), (1.0, 2.0), (2.0, 0.5), (3.0, 4.0)]
    for r in spark.createDataFrame(pairs, "a double, b double").select("a", "b", C.marcum_q1(F.col("a"), F.col("b")).alias("q")).collect():
        assert abs(r.q - q1(r.a, r.b)) < 1e-8
    (r,) = spark.range(1).select(C.marcum_q1(F.lit(0.0), F.lit(1.5)).alias("q"), C.marcum_q1(F.lit(6.0), F.lit(0.0)).alias("one")).collect()
    assert abs(r.q - math.exp(-1.125)) < 1e-12 and abs(r.one - 1) < 1e-12


def test_geometry_gives_the_league_back_and_the_grid_follows_it(spark):
    g = D.Geometry(middle=0.3, outside=0.15, reversed=0.05)
    (r,) = spark.range(1).select(*(c.alias(n) for n, c in g.parts(F.lit(1.0), F.lit(0.0)).items())).collect()
    assert abs(r.p_mid - 0.3) < 1e-9 and abs(r.p_out - 0.15) < 1e-9 and abs(r.p_rev - 0.05) < 1e-9
    grid = D.geometry_grid(spark, g)
    assert grid.count() == 48 * 64
    rows = spark.createDataFrame([(0.45, 0.0), (0.9, 0.7), (1.3, -1.1), (2.2, 2.4), (9.0, 9.0)], "s double, a double")
    got = D.grid_lookup(rows, grid, "s", "a").withColumn("exact", g.parts(F.least("s", F.lit(2.2)), F.least(F.abs("a"), F.lit(2.4)))["p_success"]).collect()
    assert all(abs(r.p - max(0.0, r.exact)) < 2e-3 for r in got)


def test_halving_keeps_the_best_of_the_latest_fold_and_the_anchor(spark):
    loss = {("a", 1): 0.9, ("a", 2): 0.1, ("b", 1): 0.1, ("b", 2): 0.2, ("c", 1): 0.0, ("c", 2): 0.9, ("d", 1): 0.0, ("d", 2): 0.8}
    asked = []

    def score(arms, folds):
        names = [r.arm for r in arms.select("arm").collect()]
        asked.append((sorted(names), folds))
        return spark.createDataFrame([(n, f, loss[n, f]) for n in names for f in folds], "arm string, fold int, loss double")

    out = M.successive_halving(score, spark.createDataFrame([(n,) for n in "abcd"], "arm string"), [1, 2], "c", keep=0.5)
    got = {r.arm: (round(r.loss, 9), r.folds, r.beats) for r in out.collect()}
    assert got == {"a": (0.5, 2, False), "b": (0.15, 2, True), "c": (0.45, 2, False)}
    assert asked == [(["a", "b", "c", "d"], [2]), (["a", "b", "c"], [1, 2])]


def walk(path, x):
    if isinstance(x, dict):
        return [r for k, v in x.items() for r in walk(f"{path}.{k}" if path else k, v)]
    if isinstance(x, list):
        return [r for i, v in enumerate(x) for r in walk(f"{path}[{i}]", v)]
    return [(path, "" if x is None else json.dumps(x) if not isinstance(x, str) else x)]


def test_json_is_flattened_to_any_depth(spark):
    docs = {"a": {"k": 1, "deep": [{"x": [1, [2, {"y": "z"}]]}, None, True]}, "b": 7, "c": [], "d": {"t": "text", "f": 2.5}}
    df = spark.createDataFrame([*((n, json.dumps(v)) for n, v in docs.items()), ("broken", "{"), ("none", None)], "name string, body string")
    got = sorted((r.name, r.path, r.value) for r in S.flatten_json(df, "body", "name").collect())
    assert got == sorted((n, p, v) for n, d in docs.items() for p, v in walk("", d))


@pytest.mark.parametrize(("leaf", "verdict"), [(("w", "42.0"), "BLOCK"), (("w", "42.1"), "CLEAN"), (("note", "hand made"), "BLOCK"), (("note", "this is not hand made"), "CLEAN"), (("source", "from public score"), "REVIEW"), (("other", "from public score"), "CLEAN"), (("source", "without any public score"), "CLEAN")])
def test_provenance_rules(spark, leaf, verdict):
    df = spark.createDataFrame([("n", *leaf)], "name string, path string, value string")
    assert [r.verdict for r in S.provenance(df, [42.0], "hand made", "public score", "source$").collect()] == [verdict]
