"""Hand fixtures: the cases that decide an operator's meaning."""

import zipfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.functions import scalars as X
from tidemark.operators import aggregates as A
from tidemark.operators import history as H
from tidemark.operators import joins as J
from tidemark.operators import metrics as M
from tidemark.operators import resolve as E
from tidemark.operators import rowwise as R
from tidemark.operators import sessions as S
from tidemark.operators import shrinkage as D
from tidemark.plans import scoring
from tidemark.sources import files


def test_within_season_counts_start_at_zero(spark):
    df = spark.createDataFrame([(1, 7, 1), (2, 7, 0), (3, 7, 1)], "row_id long, entity long, y int")
    got = H.beta_state(df, "entity").orderBy("row_id").collect()
    assert [(r.past_n, r.past_k) for r in got] == [(0, 0), (1, 1), (2, 1)]


def test_cold_start_and_season_gap(spark):
    ends = spark.createDataFrame([(1, 2020, 10, 4), (1, 2021, 30, 9)], "entity long, season int, n_end long, k_end long")
    rows = spark.createDataFrame([(1, 2020), (1, 2021), (1, 2024), (2, 2022)], "entity long, season int")
    got = {(r.entity, r.season): (r.base_n_end, r.base_k_end) for r in H.as_of_season(rows, ends).collect()}
    assert got == {(1, 2020): (0, 0), (1, 2021): (10, 4), (1, 2024): (30, 9), (2, 2022): (0, 0)}


def test_counter_reset_takes_the_season_total(spark):
    ends = spark.createDataFrame([(1, 2020, 100, 40), (1, 2021, 30, 9)], "entity long, season int, n_end long, k_end long")
    got = [(r.season, r.dn, r.dk) for r in H.season_increment(ends).orderBy("season").collect()]
    assert got == [(2020, 100, 40), (2021, 30, 9)]


def test_ties_on_the_greatest_counter_go_to_the_least_id(spark):
    log = spark.createDataFrame([(5, 1, 2020, 9, 3, 1), (4, 1, 2020, 9, 3, 0)], "row_id long, entity long, season int, n long, k long, y int")
    assert [tuple(r) for r in H.season_end(log).collect()] == [(1, 2020, 10, 3)]


def test_interleaved_entities_have_their_own_sessions(spark):
    df = spark.createDataFrame([(1, 1, "a"), (2, 2, "a"), (3, 1, "a"), (4, 2, "b"), (5, 1, "b")], "row_id long, entity long, day string")
    got = {r.row_id: r.session for r in S.sessions(df, changed=["day"]).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 4: 2, 5: 2}


def test_null_to_value_opens_a_session(spark):
    df = spark.createDataFrame([(1, 1, None), (2, 1, 3.0), (3, 1, 3.0)], "row_id long, entity long, v double")
    got = {r.row_id: r.session for r in S.sessions(df, jumps={"v": 1.0}).collect()}
    assert got == {1: 1, 2: 2, 3: 2}


def test_unknown_category_and_empty_mix(spark):
    df = spark.createDataFrame([("x", None, None), ("a", 0.5, 0.5)], "c string, p double, q double")
    got = R.mix_shape(df.withColumn("code", X.category_code(F.col("c"), {"a": 1})), ["p", "q"]).orderBy("c").collect()
    assert (got[0].code, round(got[0].mix_entropy, 4)) == (1, 0.6931)
    assert (got[1].code, got[1].mix_entropy) == (-1, None)


def test_artifact_of_another_season_raises(spark):
    artifact = spark.createDataFrame([(1, 2024, 0.5)], "entity long, target_season int, prior double")
    ok = D.apply_artifact(spark.createDataFrame([(1, 2024)], "entity long, season int"), artifact).collect()
    assert ok[0].prior == 0.5
    with pytest.raises(Exception, match="no artifact for season 2025"):
        D.apply_artifact(spark.createDataFrame([(1, 2025)], "entity long, season int"), artifact).collect()


def test_realign_raises_on_a_missing_score(spark):
    sample = spark.createDataFrame([(1,), (2,)], "row_id long")
    with pytest.raises(Exception, match="no score for 2"):
        J.ordered_realign(sample, spark.createDataFrame([(1, 0.5)], "row_id long, p double"), "row_id", "p").collect()


def test_smallest_denominator(spark):
    assert spark.range(1).select(X.smallest_denominator(F.lit(0.52381))).first()[0] == 21


def test_normal_cdf(spark):
    got = spark.createDataFrame([(0.0,), (1.96,), (-1.0,)], "x double").select(X.normal_cdf(F.col("x"))).collect()
    assert [round(r[0], 5) for r in got] == [0.5, 0.975, 0.15866]


def test_scorer_is_row_local_and_the_audit_sees_when_not(spark):
    rows = spark.createDataFrame([(1, 1, 0.3), (2, 9, 0.5)], "row_id long, entity long, value double")
    lookup = spark.createDataFrame([(1, 0.4)], "entity long, base double")
    s = scoring.score_rows(rows, lookup, "entity", {"a": {"base": 1.0}, "b": {"value": 1.0}}, {"a": 1.0, "b": 1.0})
    scoring.check_row_local(s)
    got = {r.row_id: round(r.score, 4) for r in s.collect()}
    assert got == {1: 0.35, 2: 0.5}
    with pytest.raises(ValueError, match="row-local"):
        scoring.check_row_local(s.groupBy("entity").count())


def test_ranks_by_range_equal_ranks_by_lookup(spark):
    ref = spark.createDataFrame([(float(i % 7),) for i in range(40)], "v double")
    rows = spark.createDataFrame([(float(i),) for i in range(7)], "v double")
    a = {r.v: round(r.pct, 9) for r in S.anchored_rank(rows, ref, "v").collect()}
    b = {r.v: round(r.pct, 9) for r in S.ranked_by_range(ref.groupBy("v").agg(F.count("*").alias("c")), "v", "c").collect()}
    assert a == b


def test_placebo_keeps_the_histories_whole(spark):
    p = spark.createDataFrame([(e, s, 100 * e + s) for e in range(20) for s in range(3)], "entity long, season int, v long")
    got = M.placebo_swap(p, "entity").collect()
    assert len(got) == 60
    source = {}
    for r in got:
        source.setdefault(r.entity, set()).add(r.v // 100)
    assert all(len(s) == 1 for s in source.values()) and len({next(iter(s)) for s in source.values()}) == 20


def test_csv_with_byte_order_mark(spark, tmp_path):
    (tmp_path / "a.csv").write_bytes("﻿id,x,c\n1,0.5,a\n2,,\n".encode())
    from pyspark.sql.types import StructType

    df = files.read_csv(spark, str(tmp_path / "a.csv"), StructType.fromDDL("id long, x double, c string"), shrink=True)
    assert dict(df.dtypes) == {"id": "int", "x": "float", "c": "string"}
    assert [tuple(r) for r in df.orderBy("id").collect()] == [(1, 0.5, "a"), (2, None, None)]


def test_zip_members_nested(spark, tmp_path):
    with zipfile.ZipFile(tmp_path / "in.zip", "w") as z:
        z.writestr("deep.txt", "x")
    with zipfile.ZipFile(tmp_path / "out.zip", "w") as z:
        z.write(tmp_path / "in.zip", "in.zip")
        z.writestr("a.txt", "abc")
    (tmp_path / "in.zip").unlink()
    got = {r.member: r.size for r in files.zip_members(spark, str(tmp_path)).collect()}
    assert set(got) == {"a.txt", "in.zip", "in.zip!deep.txt"} and got["a.txt"] == 3


def test_submission_keeps_the_order_of_the_sample(spark, tmp_path):
    sample = spark.createDataFrame([(3, 0), (1, 1), (2, 2)], "row_id long, pos int")
    scores = spark.createDataFrame([(1, 0.1), (2, 0.2), (3, 0.3)], "row_id long, p double")
    files.write_submission(scores, sample, str(tmp_path / "s"))
    rows = [r for f in sorted((tmp_path / "s").glob("part-*.csv")) for r in f.read_text().splitlines()[1:]]
    assert rows == ["3,0.3", "1,0.1", "2,0.2"]


def test_run_history_and_seals(spark, tmp_path):
    files.append_run({"run": "a", "score": 1.5}, spark, str(tmp_path / "runs"))
    files.append_run({"run": "b", "score": 2.5}, spark, str(tmp_path / "runs"))
    assert {(r.run, r.value) for r in files.run_history(spark, str(tmp_path / "runs")).collect()} == {("a", 1.5), ("b", 2.5)}
    manifest = spark.createDataFrame(files.package(spark.range(10).toDF("x"), str(tmp_path / "p")).collect())
    assert files.broken_seals(manifest, str(tmp_path / "p/data")).count() == 0
    next((tmp_path / "p/data").glob("*.parquet")).unlink()
    for crc in (tmp_path / "p/data").glob(".*.crc"):
        crc.unlink()
    assert files.broken_seals(manifest, str(tmp_path / "p/data")).count() == 1


def test_stream_counter_continues_over_batches(spark, tmp_path):
    from tidemark.streaming import twins

    src = str(tmp_path / "src")
    for part in ([(1, 1, 1), (2, 1, 0)], [(3, 1, 1), (4, 2, 1)]):
        spark.createDataFrame(part, "row_id long, entity long, y int").coalesce(1).write.mode("append").parquet(src)
        stream = spark.readStream.schema("row_id long, entity long, y int").parquet(src)
        out = twins.drain(twins.running_counter(stream, "entity", "row_id", "y"), str(tmp_path / "out"), str(tmp_path / "state"))
    assert {r.row_id: (r.n, r.k) for r in out.collect()} == {1: (0, 0), 2: (1, 1), 3: (2, 1), 4: (0, 0)}


def test_in_season_split_clips_and_shrinks_the_career(spark):
    """k since the base is kept within 0 and n; the career rate is shrunk with 500."""
    rows = spark.createDataFrame([(12, 9, 10, 4), (8, 3, 10, 4), (10, 4, 10, 6)], "n long, k long, base_n_end long, base_k_end long")
    got = H.in_season_split(rows, 100.0).collect()
    assert [(r.is_n, r.is_k) for r in got] == [(2, 2), (0, 0), (0, 0)]
    assert abs(got[0].is_delta - ((2 + 50) / 102 - (9 + 250) / 512)) < 1e-12
    assert abs(got[0].is_logn - np.log(3)) < 1e-12 and abs(got[0].is_share - 2 / 12) < 1e-12


def test_in_season_block_has_level_and_departure_of_each_counter(spark):
    rows = spark.createDataFrame([(30, 20, 10, 5, 1)], "n long, k_a long, base_n_end long, base_k_a long, x int")
    r = H.in_season_block(rows, ["a"], 10.0, "p").first()
    assert abs(r.p_a_sm - (15 + 5) / 30) < 1e-12 and abs(r.p_a_d - ((15 + 5) / 30 - (20 + 5) / 40)) < 1e-12 and abs(r.p_share - 20 / 30) < 1e-12


def test_innovation_uses_clipped_counts(spark):
    rows = spark.createDataFrame([(2, 2, 10, 4), (3, 1, 0, 0)], "is_n long, is_k long, base_n_end long, base_k_end long")
    got = D.innovation(rows, 10.0, 0.25).collect()
    assert abs(got[0].innovation - ((2 + 4) / 12 - 0.4)) < 1e-12 and abs(got[0].log_dn - np.log(3)) < 1e-12
    assert got[1].q_prior == 0.25


def test_credibility_by_hand(spark):
    """Three groups; process variance over the sum of n - 1."""
    g = spark.createDataFrame([(10, 5), (20, 4), (30, 21)], "n long, k long")
    r = A.credibility(g, []).first()
    n, k = np.array([10, 20, 30.0]), np.array([5, 4, 21.0])
    p, m = k / n, 30 / 60
    epv = (n * p * (1 - p)).sum() / (60 - 3)
    vhm = ((n * (p - m) ** 2).sum() - 2 * epv) / (60 - (n**2).sum() / 60)
    assert np.allclose([r.mean, r.epv, r.vhm, r.kappa], [m, epv, vhm, epv / vhm])


def test_credibility_without_variance_shrinks_wholly(spark):
    assert A.credibility(spark.createDataFrame([(10, 5), (10, 5)], "n long, k long"), []).first().kappa == 1e9


def test_prefix_counts_leave_out_the_season_itself(spark):
    cells = spark.createDataFrame([(1, 2020, 10, 4), (1, 2022, 5, 5), (2, 2021, 7, 0)], "entity long, season int, n long, k long")
    got = {(r.entity, r.season): (r.n, r.k) for r in A.prefix_counts(cells).collect()}
    assert got == {(1, 2021): (10, 4), (1, 2022): (10, 4), (2, 2022): (7, 0), (1, 2023): (15, 9), (2, 2023): (7, 0)}


def test_season_prior_by_hand(spark):
    inc = spark.createDataFrame([(1, 2020, 100, 40), (1, 2021, 50, 30), (2, 2020, 10, 0)], "entity long, season int, dn long, dk long")
    target = spark.createDataFrame([(1, 2022), (3, 2022), (1, 2020)], "entity long, season int")
    got = {(r.entity, r.target_season): r for r in D.season_prior(inc, target, 0.5, 20.0, 0.3).collect()}
    league = 70 / 160
    m = np.array([(40 + 20 * league) / 120, (30 + 20 * league) / 70])
    w = np.array([0.5, 1.0]) * np.sqrt(np.array([100 / 120, 50 / 70]))
    w /= w.sum()
    mean = (w * m).sum()
    var = (w * (m - mean) ** 2).sum() + (w * m * (1 - m) / np.array([121, 71])).sum()
    r = got[1, 2022]
    assert np.allclose([r.prior, r.variance, r.strength, r.trend], [mean, var, min(max(mean * (1 - mean) / var - 1, 25), 800), m[1] - m[0]])
    assert (got[3, 2022].prior, got[3, 2022].strength, got[3, 2022].trend) == (league, 25.0, 0.0)
    assert got[1, 2020].prior == 0.3 and abs(got[1, 2020].variance - 0.3 * 0.7 / 26) < 1e-12


def test_later_passes_of_residual_effects_add_to_the_former(spark):
    rows = [(1, 1, 0.5, 1.0), (1, 2, -0.5, 2.0), (2, 1, 0.25, 1.0), (2, 2, 1.0, 3.0)]
    df = spark.createDataFrame(rows, "e long, p long, r double, w double")
    spec = [("e", ["e"], 2.0), ("ep", ["e", "p"], 1.0)]
    got = D.residual_effects(df, spec, "r", "w")
    assert [name for name, _, _ in got] == ["e1", "ep1", "e2", "ep2"]
    left, total = {(e, p): r for e, p, r, _ in rows}, {(e, p): 0.0 for e, p, _, _ in rows}
    weight = {(e, p): w for e, p, _, w in rows}
    for _ in range(2):
        for width, shrink in ((1, 2.0), (2, 1.0)):
            effect = {}
            for key in {k[:width] for k in left}:
                mine = [k for k in left if k[:width] == key]
                effect[key] = sum(weight[k] * left[k] for k in mine) / (sum(weight[k] for k in mine) + shrink)
            for k in left:
                left[k] -= effect[k[:width]]
                total[k] += effect[k[:width]]
    out = {(r.e, r.p): r.correction for r in D.apply_effects(df, got).collect()}
    assert all(abs(out[k] - total[k]) < 1e-12 for k in total)


def test_margin_is_that_of_the_assigned_pair_and_may_be_negative(spark):
    pairs = spark.createDataFrame([(1, 11, 3.0), (1, 12, 1.0), (2, 11, 2.0), (2, 12, 0.5)], "a long, b long, cost double")
    assigned = spark.createDataFrame([(1, 11), (2, 12)], "a long, b long")
    got = {(r.a, r.b): (r.margin_row, r.margin_col) for r in J.margins(pairs, assigned).collect()}
    assert got == {(1, 11): (-2.0, -1.0), (2, 12): (1.5, 0.5)}


def _set_score(left, right, scale=10.0):
    used, total = set(), 0.0
    for key, n in right:
        best, at = 0.0, None
        for i, (k, m) in enumerate(left):
            q = max(0.0, 1 - abs(m - n) / scale)
            if k == key and i not in used and q > best:
                best, at = q, i
        if at is not None:
            used.add(at)
            total += best
    return total / len(right)


def test_set_score_equals_a_plain_greedy_match(spark):
    rng = np.random.default_rng(3)
    make = lambda ids: [(int(e), int(s), int(o), str(rng.choice(list("xy"))), int(rng.integers(1, 25))) for e in ids for s in (1, 2) for o in range(rng.integers(1, 7))]
    a, b = make(range(4)), make(range(10, 14))
    schema = "entity long, season int, o long, key string, n long"
    pairs = [(i, 10 + j) for i in range(4) for j in range(4)]
    got = E.set_score(spark.createDataFrame(pairs, "a long, b long"), spark.createDataFrame(a, schema), spark.createDataFrame(b, schema), ["season"], "entity", "key", "n", "o")
    mine = lambda rows, e, s: [(k, n) for x, y, _, k, n in rows if (x, y) == (e, s)]
    want = {(i, j, s): _set_score(mine(a, i, s), mine(b, j, s)) for i, j in pairs for s in (1, 2)}
    assert got.count() == len(want)
    assert all(abs(r.score - want[r.a, r.b, r.season]) < 1e-12 for r in got.collect())
