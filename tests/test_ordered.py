"""Orders, ranks and permutations over range partitions, against numpy and pandas."""

import numpy as np
import pandas as pd
import pytest

from tidemark.operators import metrics as M
from tidemark.operators import resolve as E
from tidemark.operators import sessions as S
from tidemark.operators.ordered import numbered, quantiles


@pytest.fixture(scope="module")
def table(spark):
    rng = np.random.default_rng(6)
    pdf = pd.DataFrame({"id": np.arange(500), "g": rng.integers(0, 3, 500), "v": rng.integers(0, 40, 500).astype(float)})
    pdf.loc[pdf["id"] % 17 == 0, "v"] = np.nan
    return pdf, spark.createDataFrame(pdf.astype(object).where(pdf.notna(), None).values.tolist(), "id long, g long, v double").repartition(7)


def test_quantiles(spark, table):
    pdf, df = table
    q = [0.0, 0.1, 0.25, 0.333, 0.5, 0.9, 1.0]
    assert np.allclose(quantiles(df, "v", q), np.nanquantile(pdf["v"], q))
    assert quantiles(df.filter("false"), "v", [0.5]) == [None]
    assert quantiles(df.limit(1).selectExpr("3.0D AS v"), "v", [0.0, 0.4]) == [3.0, 3.0]


def test_numbers_run_through_all_partitions(table):
    pdf, df = table
    got = {r.id: r.n for r in numbered(df, ["g", "id"], "n").collect()}
    assert [got[i] for i in pdf.sort_values(["g", "id"])["id"]] == list(range(1, 501))


def test_average_rank(table):
    pdf, df = table
    want = pdf.groupby("g")["v"].rank(pct=True, method="average")
    got = {r.id: r.pct for r in S.average_rank(df, "v", ["g"]).collect()}
    assert all((got[i] is None) == pd.isna(w) and (pd.isna(w) or abs(got[i] - w) < 1e-12) for i, w in zip(pdf["id"], want, strict=True))


@pytest.mark.parametrize("by", [[], ["g"]])
def test_placebo_swap_is_a_permutation_within_groups(spark, by):
    profile = spark.createDataFrame([(i, i % 4, i % 3, float(i)) for i in range(60)], "entity long, season long, g long, x double")
    got = M.placebo_swap(profile, "entity", by=by).collect()
    assert sorted(r.entity for r in got) == list(range(60))
    assert sum(r.entity != int(r.x) for r in got) > 40
    if by:
        assert all(r.entity % 3 == r.g for r in got)


def test_permutation_test_keeps_blocks(spark):
    """A trait that only depends on the block agrees as often in every permutation within blocks."""
    rows = [(i, i % 5, i % 5, i % 7) for i in range(200)]
    df = spark.createDataFrame(rows, "k long, block long, a long, b long")
    r = E.permutation_test(df.withColumn("b", df["block"]), "a", "b", "k", 20, block=["block"]).first()
    assert (r.agreement, r["mean"], r.sd) == (1.0, 1.0, 0.0)
    r = E.permutation_test(df.withColumn("b", df["a"]), "a", "b", "k", 50).first()
    assert r.agreement == 1.0 and abs(r["mean"] - 0.2) < 0.02 and r.z > 20


def test_dispersion_by_hand(spark):
    rows = [(float(i), i // 50, i / 200) for i in range(100)]
    r = M.dispersion(spark.createDataFrame(rows, "level double, y int, p double"), "level", parts=2, least=10).first()
    assert (r.true_spread, round(r.predicted_spread, 6), round(r.ratio, 6)) == (1.0, 0.25, 0.25)
    assert M.dispersion(spark.createDataFrame(rows, "level double, y int, p double"), "level").first().ratio is None
