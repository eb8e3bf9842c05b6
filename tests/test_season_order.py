"""Fixtures in which the order of seasons decides, worked by hand, and keys that are null."""

import math

import pytest
from pyspark.sql import functions as F

from tidemark.operators import aggregates as A
from tidemark.operators import history as H
from tidemark.operators import metrics as M
from tidemark.operators import profiles as P
from tidemark.operators import sessions as S
from tidemark.operators import shrinkage as D


def rows(spark, data, schema):
    return spark.createDataFrame(data, schema)


SCHEMA = "entity long, season int, grp string, cond int, speed double, spin double, move double, y int"


def log(turned: float = 1.0):
    """Two entities over three seasons; the last season's values are bent by ``turned``."""
    out = []
    for e in (1, 2):
        for s in (1, 2, 3):
            for g in ("m", "o"):
                for i in range(6):
                    f = turned * i**3 * e if s == 3 else 0.0
                    out.append((e, s, g, i % 2, 10.0 * e + i + s + f, i * i - e + f, 3.0 * i + e - f, i % 2))
    return out


@pytest.mark.parametrize("name", ["prefix", "delta", "tilt", "dispersion"])
def test_profiles_of_a_season_do_not_see_it_or_later_ones(spark, name):
    def run(turned):
        d = rows(spark, log(turned) if name != "tilt" else [r for r in log() if turned == 1 or r[1] < 3 or r[2] == "m" or r[3]], SCHEMA)
        cells = P.measured_cells(d, "entity", "season", "grp", ["speed", "spin", "move"], "y")
        out = {
            "prefix": lambda: P.career_prefix(cells, "entity", "season", "grp", "m", "o", "speed", "spin", ["spin", "move"], least=10, least_group=5, ahead=1),
            "delta": lambda: P.conditional_delta(d, "entity", "season", "grp", "cond", "speed", 4.0, 5, ahead=1),
            "tilt": lambda: P.posterior_tilt(d, "entity", "season", "cond", "grp", 4.0, 5, ahead=1),
            "dispersion": lambda: P.prefix_dispersion(cells, "entity", "season", "grp", "speed", ["spin", "move"], 4, ahead=1),
        }[name]()
        return {tuple(round(v, 9) if isinstance(v, float) else v for v in r) for r in out.collect()}

    own, other = run(1.0), run(-7.0)
    upto = lambda found: {r for r in found if r[1] <= 3}
    assert upto(own) == upto(other) and own != other
    assert {r[1] for r in own} >= {2, 3, 4}


def z_of(data, i, season, group):
    own = [r[i] for r in data if r[1] == season and r[2] == group]
    m = sum(own) / len(own)
    sd = math.sqrt(sum((v - m) ** 2 for v in own) / (len(own) - 1))
    return lambda v: (v - m) / sd


def test_prefix_pools_within_cells(spark):
    data = log()
    cells = P.measured_cells(rows(spark, data, SCHEMA), "entity", "season", "grp", ["speed", "spin", "move"], "y")
    out = P.career_prefix(cells, "entity", "season", "grp", "m", "o", "speed", "spin", ["spin", "move"], least=10, least_group=5)
    got = {(r.entity, r.season): r for r in out.collect()}
    ss = dof = 0
    for s in (1, 2):
        for g in ("m", "o"):
            z = z_of(data, 4, s, g)
            v = [z(r[4]) for r in data if r[:3] == (1, s, g)]
            m = sum(v) / len(v)
            ss, dof = ss + sum((x - m) ** 2 for x in v), dof + len(v) - 1
    mean = lambda g: sum(z_of(data, 4, s, g)(r[4]) for s in (1, 2) for r in data if r[:3] == (1, s, g)) / 12
    r = got[1, 3]
    assert math.isclose(r.sd_speed, math.sqrt(ss / dof)) and math.isclose(r.speed_main, mean("m")) and math.isclose(r.separation, mean("m") - mean("o"), abs_tol=1e-12) and r.share == 0.5
    assert got[1, 1].sd_speed is None  # nothing before


def test_delta_and_tilt_by_hand(spark):
    data = [(1, 1, "m", 0, 0.0), (1, 1, "m", 0, 2.0), (1, 1, "m", 1, 4.0), (1, 2, "m", 1, 9.0), (2, 1, "m", 0, 2.0), (2, 2, "m", 0, 1.0)]
    d = rows(spark, data, "entity long, season int, grp string, cond int, v double")
    z = lambda v: (v - 2.0) / math.sqrt(8 / 3)
    got = {tuple(r[:4]): (r.n, r.delta) for r in P.conditional_delta(d, "entity", "season", "grp", "cond", "v", 30.0, 3).collect()}
    base = (z(0) + z(2) + z(4)) / 3
    assert got[1, 2, "m", 0][0] == 2 and math.isclose(got[1, 2, "m", 0][1], ((z(0) + z(2)) / 2 - base) * 2 / 32)
    assert math.isclose(got[1, 2, "m", 1][1], (z(4) - base) / 31)
    assert got[2, 2, "m", 0] == (1, 0.0)  # a base of one row
    t = rows(spark, [(1, 1, 0, "a"), (1, 1, 0, "a"), (1, 1, 1, "b"), (1, 2, 0, "c")], "entity long, season int, cond int, kind string")
    tilt = {tuple(r[:4]): r.tilt for r in P.posterior_tilt(t, "entity", "season", "cond", "kind", 3.0, 3).collect()}
    assert set(tilt) == {(1, 2, c, k) for c in (0, 1) for k in "ab"}
    assert math.isclose(tilt[1, 2, 0, "a"], (2 + 3 * 2 / 3) / (2 + 3) / (2 / 3)) and math.isclose(tilt[1, 2, 1, "a"], (3 * 2 / 3) / (1 + 3) / (2 / 3))


def test_bands_stay_within_the_season(spark):
    c = rows(spark, [(1, 1, i, 10 + i, i) for i in range(1, 7)] + [(1, 2, 7, 5, 1), (1, 2, 8, 5, 5)], "entity long, season int, session long, n long, k long")
    got = {r.session: r for r in S.bands(c).collect()}
    r = got[6]
    assert math.isclose(r.band1, (5 + 10) / (15 + 20)) and math.isclose(r.band23, (4 + 3 + 20) / (14 + 13 + 40)) and math.isclose(r.band45, (2 + 1 + 20) / (12 + 11 + 40))
    assert math.isclose(r.log23, math.log1p(27)) and math.isclose(r.trend, r.band1 - r.band45) and math.isclose(r.workload, 15 - (15 + 27 + 23) / 5)
    assert got[7].band1 is None and math.isclose(got[8].band1, (1 + 10) / (5 + 20)) and got[8].band23 is None


def test_completed_seasons_count_from_the_second(spark):
    ends = rows(spark, [(1, 1, 100, 40), (1, 2, 160, 70), (1, 4, 240, 90), (1, 5, 240, 90)], "entity long, season int, n_end long, k_end long")
    table = H.completed_seasons(ends)
    got = {r.season: r for r in table.collect()}
    assert got[1].ps_sm is None and math.isclose(got[2].ps_sm, (30 + 100) / 260) and got[2].ps_trend is None
    assert math.isclose(got[4].ps_trend, (20 + 100) / 280 - (30 + 100) / 260) and math.isclose(got[4].ps_vol, abs(0.5 - 0.25) / math.sqrt(2)) and got[5].ps_sm is None
    at = H.latest_before(rows(spark, [(1, 1), (1, 3), (1, 5), (2, 3)], "entity long, season int"), table, ["ps_sm"])
    assert {(r.entity, r.season): r.ps_sm for r in at.collect()} == {(1, 1): None, (1, 3): got[2].ps_sm, (1, 5): got[4].ps_sm, (2, 3): None}


def test_trend_and_steps(spark):
    d = rows(spark, [("two", 1, 0.1), ("two", 2, 0.5), ("flat", 1, 0.1), ("flat", 1, 0.2), ("flat", 1, 0.3), ("up", 1, 0.0), ("up", 2, 0.5), ("up", 3, 1.0)], "e string, x int, y double")
    assert {r.e: r.t for r in d.groupBy("e").agg(A.trend(F.col("y"), F.col("x")).alias("t")).collect()} == {"two": None, "flat": 0.0, "up": 0.5}
    steps = rows(spark, [(1, 1, 1, 1, "a"), (1, 1, 1, 2, "b"), (1, 1, 2, 3, "a"), (1, 1, 2, 4, "b"), (1, 1, 2, 5, "b")], "entity long, season int, game int, i int, kind string")
    got = {(r.prev, r.cur): (r.n, r.share) for r in A.transition_shares(steps, ["entity", "season"], ["entity", "game"], "i", "kind").collect()}
    assert got == {("a", "b"): (2, 2 / 3), ("b", "b"): (1, 1 / 3)}


def test_mix_is_pulled_to_the_own_base(spark):
    d = rows(spark, [(4, 3, 1, 10, 2, 8), (4, 3, 1, 0, 0, 0)], "dn long, d_a long, d_b long, base_n long, base_a long, base_b long")
    own, new = D.log_ratio_mix(d, ["a", "b"], {"a": 0.5, "b": 0.5}, 6.0).collect()
    a, b = (3 + 6 * 0.2) / 10, (1 + 6 * 0.8) / 10
    assert math.isclose(own.lr_b, math.log(b / a)) and math.isclose(own.innovation, a - 0.2) and own.reliability == 0.4
    assert math.isclose(new.lr_b, math.log((1 + 3) / (3 + 3)))


def test_forecast_needs_the_seasons_directly_before(spark):
    d = rows(spark, [("whole", 1, 0.4), ("whole", 2, 0.45), ("whole", 3, 0.5), ("gap", 0, 0.3), ("gap", 1, 0.35), ("gap", 3, 0.6), ("late", 4, 0.9), ("late", 2, 0.4)], "g string, season int, r double")
    got = {r.g: r.forecast for r in D.extrapolate(d, ["g"], "season", "r", 4).collect()}
    assert math.isclose(got["whole"], 0.55) and got["gap"] == 0.6 and got["late"] == 0.4
    seg = {r.g: r.forecast for r in D.segment_forecasts(d, "g", "whole", "season", "r", 4).collect()}
    assert math.isclose(seg["gap"], 0.55 + 0.5 * 0.1) and math.isclose(seg["late"], 0.55)


def test_null_keys_are_kept(spark):
    d = rows(spark, [(None, 1.0, "x"), (None, 3.0, "x"), ("a", 2.0, None), ("a", 6.0, None)], "k string, v double, b string")
    assert sorted(round(r.z, 6) for r in S.z_in_group(d, "v", ["k"]).collect()) == [-0.707107, -0.707107, 0.707107, 0.707107]
    assert sorted(r.centred for r in S.double_centred(d, "v", "k", "b").collect()) == sorted([1.0 - 2 - 2 + 3, 2.0 - 4 - 4 + 3, 3.0 - 2 - 2 + 3, 6.0 - 4 - 4 + 3])
    effects = D.residual_effects(d, [("first", ["k"], 0.0), ("second", ["b"], 0.0)], "v", passes=1)
    tables = {n: {r[0]: r.effect for r in t.collect()} for n, _, t in effects}
    assert tables["first1"] == {None: 2.0, "a": 4.0} and all(abs(v) < 1e-12 for v in tables["second1"].values()) and len(tables["second1"]) == 2
    assert sorted(r.correction for r in D.apply_effects(d, effects).collect()) == [2.0, 2.0, 4.0, 4.0]
    assert M.placebo_swap(d, "k", by=["b"]).count() == 4
    g = S.prefix_profile(rows(spark, [(None, 1, 5), (None, 2, 7)], "k string, season int, n long"), ["k"], ["n"], ahead=1)
    assert sorted((r.season, r.n) for r in g.collect()) == [(1, 0), (2, 5), (3, 12)]


def test_window_audit_by_hand(spark):
    measured = rows(spark, [(1, 1, 1, 21, 11 / 21), (1, 2, 1, 4, 0.5), (1, 3, 1, 8, 0.25), (1, 4, 2, 5, 0.2), (1, 5, 2, 5, 0.4)], "entity long, session long, season int, n long, rate double")
    # Session 2 states 1 rightly; 3 states 2 with half its rows; 4 is in another season; 5 states nothing.
    stated = rows(spark, [(1, 2, 0.52381, 0.238095), (1, 3, 0.5, 0.5), (1, 4, 0.9, 0.9), (1, 5, None, 0.5)], "entity long, session long, rate double, other double")
    (r,) = S.window_audit(measured, stated).collect()
    assert (r.compared, r.agree, r.recovered_from, r.exact, r.divisor, r.unknown) == (2, 2, 2, 1, 2, 0)
