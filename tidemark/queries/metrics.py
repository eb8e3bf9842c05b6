"""Queries of scores, calibration, ensembles and validation."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import aggregates as A
from ..operators import fitting as T
from ..operators import history as H
from ..operators import metrics as M
from ..sources.tables import counted_log, line_log
from .registry import LI, LOG, query, r6

#: Three predictors of the label and the log they stand in.
PRED = LOG + """, f AS (SELECT *, (k + 10.0) / (n + 50.0) AS p, 0.15 + value / 1000 AS q, 0.2 + (partner % 7) / 100.0 AS r FROM log)"""


def predictions(spark, d):
    log = counted_log(spark, d)
    return log.withColumns({"p": (F.col("k") + 10.0) / (F.col("n") + 50.0), "q": 0.15 + F.col("value") / 1000, "r": 0.2 + F.col("partner") % 7 / 100.0})


def _score_sql(group: str) -> str:
    return f"""SELECT {group}, count(*) AS n, round(avg(y), 6) AS rate, round(avg(power(y - p, 2)), 6) AS brier, round(-avg(y * ln(p) + (1 - y) * ln(1 - p)), 6) AS logloss, round(avg(p) - avg(y), 6) AS shift,
  round(1e5 * (1 - avg(power(y - p, 2)) / (avg(y) * (1 - avg(y)))), 3) AS score, round(1e5 * (1 - avg(power(y - p, 2)) / (avg(y) * (1 - avg(y)))) + 1e5 * power(avg(p) - avg(y), 2) / (avg(y) * (1 - avg(y))), 3) AS refinement FROM f"""


def _score_rows(df, *keys):
    return df.select(*keys, "n", *(r6(c).alias(c) for c in ("rate", "brier", "logloss", "shift")), F.round("score", 3).alias("score"), F.round("refinement", 3).alias("refinement"))


@query("met1_score_by_season", f"WITH {PRED} {_score_sql('season')} GROUP BY season")
def met1(spark, d):
    return _score_rows(M.score(predictions(spark, d), ["season"]), "season")


@query("met3_segment_scores", f"WITH {PRED} {_score_sql('partner % 5 AS segment')} GROUP BY partner % 5 HAVING count(*) > 100 AND avg(y) > 0 AND avg(y) < 1")
def met3(spark, d):
    f = predictions(spark, d).withColumn("segment", F.col("partner") % 5)
    return _score_rows(M.score(f, ["segment"], least=100), "segment")


@query("met3_auc", f"WITH {PRED}, c AS (SELECT season, p, sum(y) AS pos, sum(1 - y) AS neg FROM f GROUP BY ALL), w AS (SELECT *, coalesce(sum(neg) OVER (PARTITION BY season ORDER BY p ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below FROM c) SELECT season, round(sum(pos * (below + neg / 2)) / (sum(pos) * sum(neg)), 6) AS auc FROM w GROUP BY season")
def met3_auc(spark, d):
    return M.auc(predictions(spark, d), ["season"]).select("season", r6("auc").alias("auc"))


@query("met4_paired_error", f"WITH {PRED} SELECT round(1e5 * avg(power(y - p, 2) - power(y - q, 2)) / (avg(y) * (1 - avg(y))), 2) AS gain, round(1e5 * stddev_samp(power(y - p, 2) - power(y - q, 2)) / sqrt(count(*)) / (avg(y) * (1 - avg(y))), 2) AS se FROM f")
def met4(spark, d):
    e = M.paired_error(predictions(spark, d), "y", "p", "q")
    return e.select(F.round("gain", 2).alias("gain"), F.round("se", 2).alias("se"))


@query("met5_reliability", f"WITH {PRED} SELECT CAST(least(floor(q * 15), 14) AS INTEGER) AS bin, count(*) AS n, round(avg(q), 6) AS mean_p, round(avg(y), 6) AS rate FROM f GROUP BY ALL")
def met5(spark, d):
    return M.reliability(predictions(spark, d), p="q").select("bin", "n", r6("mean_p").alias("mean_p"), r6("rate").alias("rate"))


@query("met6_brier_parts", f"""WITH {PRED}, e AS (SELECT quantile_cont(p, [0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9]) AS e FROM f), b AS (SELECT y, p, len(list_filter(e, lambda x: x < p)) AS b FROM f, e),
g AS (SELECT b, count(*) AS n, avg(p) AS mp, avg(y) AS my FROM b GROUP BY b), t AS (SELECT sum(n) AS N_, sum(n * my) / sum(n) AS r FROM g)
SELECT round(sum(n / N_ * power(mp - my, 2)), 6) AS rel, round(sum(n / N_ * power(my - r, 2)), 6) AS res, round(max(r * (1 - r)), 6) AS unc FROM g, t""")
def met6(spark, d):
    return M.brier_parts(predictions(spark, d)).select(*(r6(c).alias(c) for c in ("rel", "res", "unc")))


@query("met7_dispersion", f"""WITH {PRED}, e AS (SELECT quantile_cont(q, [0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9]) AS e FROM f), b AS (SELECT y, p, len(list_filter(e, lambda x: x < q)) AS b FROM f, e),
g AS (SELECT avg(y) AS y, avg(p) AS p FROM b GROUP BY b) SELECT round(max(y) - min(y), 6) AS true_spread, round(max(p) - min(p), 6) AS predicted_spread, round((max(p) - min(p)) / (max(y) - min(y)), 5) AS ratio FROM g""")
def met7(spark, d):
    """How far predictions spread over tenths of a level, against outcomes."""
    t = M.dispersion(predictions(spark, d), "q", least=1)
    return t.select(r6("true_spread").alias("true_spread"), r6("predicted_spread").alias("predicted_spread"), F.round("ratio", 5).alias("ratio"))


#: The blends scored row by row, as the algebra must give them.
_BLENDS = {"pq": {"p": 1.0, "q": 1.0}, "pqr": {"p": 0.5, "q": 0.3, "r": 0.2}}


@query("met9_blend_algebra", f"WITH {PRED}, lv AS (SELECT avg(y) AS lv FROM f) " + " UNION ALL ".join(f"SELECT '{n}' AS blend, round(1e5 * (1 - avg(power(y - ({' + '.join(f'{v / sum(w.values())} * {m}' for m, v in w.items())}), 2)) / any_value(lv * (1 - lv))), 3) AS score FROM f, lv" for n, w in _BLENDS.items()))
def met9(spark, d):
    return M.blend_scores(predictions(spark, d), _BLENDS).select("blend", F.round("score", 3).alias("score"))


@query("ens7_unknown_member", f"WITH {PRED}, r AS (SELECT avg(y) AS r FROM f) SELECT 'r' AS member, round(1e5 * (1 - avg(power(y - f.r, 2)) / any_value(r.r * (1 - r.r))), 2) AS score FROM f, r")
def ens7(spark, d):
    """A member's score from that of a blend it is in, the others' scores and the distances; the SQL scores it directly."""
    f = predictions(spark, d)
    alone = {x["blend"]: x["score"] for x in M.blend_scores(f, {"p": {"p": 1.0}, "q": {"q": 1.0}, "all": _BLENDS["pqr"]}).collect()}
    gaps = {(x["a"], x["b"]): x["rms"] ** 2 for x in M.model_distances(f, ["p", "q", "r"]).collect()}
    level = f.agg(F.avg("y")).first()[0]
    s = M.unknown_member_score(alone["all"], {"p": (0.5, alone["p"]), "q": (0.3, alone["q"])}, gaps, "r", level)
    return spark.createDataFrame([("r", round(s, 2))], "member string, score double")


@query("cal6_piecewise", f"""WITH {PRED}, x AS (SELECT y::DOUBLE AS y, q, greatest(q - 0.2, 0) AS k FROM f), m AS (SELECT avg(y) AS my, avg(q) AS mq, avg(k) AS mk, covar_pop(q, q) AS qq, covar_pop(k, k) AS kk, covar_pop(q, k) AS qk, covar_pop(q, y) AS qy, covar_pop(k, y) AS ky FROM x),
w AS (SELECT *, (qy * kk - ky * qk) / (qq * kk - qk * qk) AS b, (ky * qq - qy * qk) / (qq * kk - qk * qk) AS c FROM m)
SELECT row_id, round(greatest(1e-6, least(1 - 1e-6, my - b * mq - c * mk + b * q + c * greatest(q - 0.2, 0))), 5) AS p, b > 0 AND b + c > 0 AS monotone FROM f, w""")
def cal6(spark, d):
    f = predictions(spark, d)
    weights, monotone = M.fit_pieces(f, [0.2], p="q")
    return f.select("row_id", F.round(M.apply_pieces(weights, [0.2], F.col("q")), 5).alias("p"), F.lit(monotone).alias("monotone"))


@query("met8_model_distances", f"WITH {PRED} " + " UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, round(sqrt(avg(power({a} - {b}, 2))), 6) AS rms, round(corr({a}, {b}), 5) AS corr FROM f" for a, b in (("p", "q"), ("p", "r"), ("q", "r"))))
def met8(spark, d):
    return M.model_distances(predictions(spark, d), ["p", "q", "r"]).select("a", "b", r6("rms").alias("rms"), F.round("corr", 5).alias("corr"))


@query("cal2_affine", f"WITH {PRED} SELECT season, round(regr_slope(y, q), 5) AS slope, round(regr_intercept(y, q), 5) AS intercept FROM f GROUP BY season")
def cal2(spark, d):
    return M.affine(predictions(spark, d), ["season"], p="q").select("season", F.round("slope", 5).alias("slope"), F.round("intercept", 5).alias("intercept"))


@query("cal1_affine_clip", f"WITH {PRED} SELECT row_id, round(greatest(0.0, least(1.0, 0.5 + 1.5 * (q - 0.5) + 0.04)), 6) AS c FROM f")
def cal1(spark, d):
    return predictions(spark, d).select("row_id", r6(M.affine_clip(F.col("q"), 1.5, 0.04)).alias("c"))


@query("cal3_affine_grid", f"WITH {PRED} SELECT s.v AS slope, c.v AS shift, round(avg(power(y - (0.5 + s.v * (q - 0.5) + c.v), 2)), 6) AS brier FROM f, (VALUES (0.8::DOUBLE), (1.0), (1.2)) s(v), (VALUES (-0.02::DOUBLE), (0.0), (0.02)) c(v) GROUP BY ALL")
def cal3(spark, d):
    return M.affine_grid(predictions(spark, d), [0.8, 1.0, 1.2], [-0.02, 0.0, 0.02], p="q").select("slope", "shift", r6("brier").alias("brier"))


def _level(f):
    """Entity and level terms of the recalibration: the entity's rate so far as a logit, and the day's distance from the middle."""
    z = F.ln((F.col("k") + 2.0) / (F.col("n") - F.col("k") + 8.0))
    return f.withColumns({"z": z, "t": (F.dayofmonth("ts") - 15) / 30.0})


@query("cal4_recalibration")
def cal4(spark, d):
    """Four bounded parameters fitted on one season, and on all before the last, pooled, each with its own centres."""
    f = _level(predictions(spark, d))
    centres = {r["season"]: (r["z"], r["t"]) for r in f.groupBy("season").agg(F.avg("z").alias("z"), F.avg("t").alias("t")).collect()}
    one = T.recalibrate([(f.filter("season = 3"), *centres[3])])
    pooled = T.recalibrate([(f.filter(F.col("season") == s), *centres[s]) for s in (1, 2, 3)])
    rows = [(name, *(round(w[k], 4) for k in "abcd"), round(w["brier"], 6)) for name, w in (("season", one), ("pooled", pooled))]
    return spark.createDataFrame(rows, "fit string, a double, b double, c double, d double, brier double")


@query("cal5_isotonic")
def cal5(spark, d):
    pools = T.isotonic_pools(predictions(spark, d), p="q")
    return pools.select("lo", "hi", "n", r6("rate").alias("rate"))


@query("cal5b_isotonic_scores")
def cal5b(spark, d):
    """The map of one season applied to the next, with and without the shift between their base rates (of the seasons before)."""
    f = predictions(spark, d)
    rates = {r["season"]: r["r"] for r in f.groupBy("season").agg(F.avg("y").alias("r")).collect()}
    fit = f.filter("season = 2")
    at = T.isotonic_apply(f.filter("season = 3").select("row_id", "q"), T.isotonic_pools(fit, p="q"), "q")
    return at.select("row_id", r6("c").alias("c"), r6(T.prior_shift(F.col("c"), rates[1], rates[2])).alias("shifted"))


@query("cal7_segment_offset", f"WITH {PRED}, s AS (SELECT avg((kind = 'click')::INT) AS m FROM f) SELECT row_id, round(p + 0.05 * ((kind = 'click')::INT - m), 6) AS c FROM f, s")
def cal7(spark, d):
    f = predictions(spark, d).withColumn("i", (F.col("kind") == "click").cast("int"))
    m = F.broadcast(f.agg(F.avg("i").alias("m")))
    return f.crossJoin(m).select("row_id", r6(F.col("p") + 0.05 * (F.col("i") - F.col("m"))).alias("c"))


@query("cal8_moment_matching", f"WITH {PRED}, m AS (SELECT avg(p) AS mp, stddev_pop(p) AS sp, avg(q) AS mq, stddev_pop(q) AS sq FROM f) SELECT row_id, round(mp + (q - mq) * sp / sq, 6) AS c, round(0.3 * (power(p - 0.5, 2) - 0.01), 6) AS curve FROM f, m")
def cal8(spark, d):
    f = predictions(spark, d)
    m = F.broadcast(f.agg(F.avg("p").alias("mp"), F.stddev_pop("p").alias("sp"), F.avg("q").alias("mq"), F.stddev_pop("q").alias("sq")))
    return f.crossJoin(m).select("row_id", r6(F.col("mp") + (F.col("q") - F.col("mq")) * F.col("sp") / F.col("sq")).alias("c"), r6(0.3 * (F.pow(F.col("p") - 0.5, 2) - 0.01)).alias("curve"))


@query("lin1_gram", f"WITH {PRED} " + " UNION ALL ".join(f"SELECT '{a}{b}' AS pair, round(sum({a} * {b}), 4) AS s FROM f" for a, b in (("p", "p"), ("p", "q"), ("q", "q"), ("p", "y"), ("q", "y"))))
def lin1_gram(spark, d):
    g = M.gram(predictions(spark, d), ["p", "q", "y"])
    at = {"p": 0, "q": 1, "y": 2}
    return spark.createDataFrame([(a + b, round(float(g[at[a], at[b]]), 4)) for a, b in ("pp", "pq", "qq", "py", "qy")], "pair string, s double")


@query("lin1_ridge")
def lin1_ridge(spark, d):
    w = M.ridge(predictions(spark, d), ["p", "q", "r"], "y", 10.0)
    return spark.createDataFrame([(k, round(v, 5)) for k, v in w.items()], "name string, weight double")


@query("lin2_orthogonal_block", f"WITH {PRED}, s AS (SELECT regr_slope(q, p) AS b, regr_intercept(q, p) AS a FROM f WHERE season < 3) SELECT row_id, round(q - a - b * p, 5) AS q FROM f, s")
def lin2(spark, d):
    return M.orthogonalise(predictions(spark, d), ["q"], ["p"], F.col("season") < 3).select("row_id", F.round("q", 5).alias("q"))


@query("ens1_blend", f"WITH {PRED} SELECT row_id, round((CASE WHEN n >= 5 THEN 2 * p ELSE 0 END + q + r) / (CASE WHEN n >= 5 THEN 2 ELSE 0 END + 2) + 1e-9, 6) AS b FROM f")
def ens1(spark, d):
    f = predictions(spark, d).withColumn("p", F.when(F.col("n") >= 5, F.col("p")))
    return f.select("row_id", r6(M.blend({"p": 2.0, "q": 1.0, "r": 1.0}) + 1e-9).alias("b"))


@query("ens4_bounded_correction", f"WITH {PRED} SELECT row_id, round(p + 0.05 * tanh((q - p) / 0.05), 6) AS c FROM f")
def ens4(spark, d):
    from ..functions.scalars import tanh_cap

    return predictions(spark, d).select("row_id", r6(F.col("p") + tanh_cap(F.col("q") - F.col("p"), 0.05)).alias("c"))


_SUBSETS = {"p": "p", "q": "q", "r": "r", "p,q": "(p + q) / 2", "p,r": "(p + r) / 2", "q,r": "(q + r) / 2", "p,q,r": "(p + q + r) / 3"}


@query("ens5_subset_blends", f"WITH {PRED} " + " UNION ALL ".join(f"SELECT '{k}' AS models, CAST({k.count(',') + 1} AS INTEGER) AS size, round(avg(power({v} - y, 2)), 6) AS brier FROM f" for k, v in _SUBSETS.items()))
def ens5(spark, d):
    return M.subset_blends(predictions(spark, d), ["p", "q", "r"], 3).select("models", "size", r6("brier").alias("brier"))


@query("ens2_greedy_selection")
def ens2(spark, d):
    return M.greedy_selection(predictions(spark, d), ["p", "q", "r"], 5)


@query("val1_folds", f"WITH {PRED}, t(fold, role, season) AS (VALUES (0, 'fit', 0), (0, 'cal', 1), (0, 'val', 2), (1, 'fit', 0), (1, 'fit', 1), (1, 'cal', 2), (1, 'val', 3), (2, 'fit', 0), (2, 'fit', 1), (2, 'fit', 2), (2, 'cal', 3), (2, 'val', 4)) SELECT CAST(fold AS INTEGER) AS fold, role, count(*) AS n, round(avg(power(y - p, 2)), 6) AS brier FROM f JOIN t USING (season) GROUP BY ALL")
def val1(spark, d):
    f = M.with_roles(predictions(spark, d), M.folds([0, 1, 2, 3, 4]))
    return f.groupBy("fold", "role").agg(F.count("*").alias("n"), r6(F.avg(F.pow(F.col("y") - F.col("p"), 2))).alias("brier"))


@query("val2_group_folds", f"WITH {LI} SELECT CAST(entity * 2654435761 % 4294967296 % 5 AS BIGINT) AS fold, count(*) AS n, round(avg(y), 6) AS rate FROM li GROUP BY ALL")
def val2(spark, d):
    fold = F.pmod(F.col("entity") * F.lit(2654435761), F.lit(4294967296)) % 5
    return line_log(spark, d).groupBy(fold.alias("fold")).agg(F.count("*").alias("n"), r6(F.avg("y")).alias("rate"))


@query("val3_placebo_gate")
def val3(spark, d):
    """The in-season feature against its placebo: histories swapped among entities, coverage kept."""
    log = counted_log(spark, d)
    ends = H.season_end(log)
    arms = []
    for arm, e in (("own", ends), ("placebo", M.placebo_swap(ends, "entity"))):
        s = H.in_season_split(H.as_of_season(log, e))
        s = s.withColumn("hat", 0.2 + 0.5 * F.col("is_delta"))
        arms.append(s.groupBy("season").agg((F.avg(F.pow(F.col("y") - 0.2, 2)) - F.avg(F.pow(F.col("y") - F.col("hat"), 2))).alias("delta")).withColumn("arm", F.lit(arm)))
    return A.gate(arms[0].unionByName(arms[1]), "arm", "delta")


@query("val6_leaderboard", f"WITH {PRED}, u AS (SELECT season, unnest(['p', 'q', 'r']) AS model, unnest([p, q, r]) AS v, y FROM f), s AS (SELECT model, season, avg(power(y - v, 2)) AS brier FROM u GROUP BY ALL) SELECT model, " + ", ".join(f"round(max(brier) FILTER (season = {i}), 6) AS s{i}" for i in range(5)) + ", round(avg(brier), 6) AS mean FROM s GROUP BY model")
def val6(spark, d):
    f = predictions(spark, d)
    u = f.unpivot(["season", "y"], ["p", "q", "r"], "model", "v")
    s = u.groupBy("model", "season").agg(F.avg(F.pow(F.col("y") - F.col("v"), 2)).alias("brier"))
    return s.groupBy("model").agg(*(r6(F.max(F.when(F.col("season") == i, F.col("brier")))).alias(f"s{i}") for i in range(5)), r6(F.avg("brier")).alias("mean"))


#: Prediction q against p: each after its own affine fit, then both together.
GEOMETRY = PRED + """, m AS (SELECT avg(y) AS r, 1e5 / (avg(y) * (1 - avg(y))) AS k, regr_slope(y, p) AS sp, regr_intercept(y, p) AS ip, regr_slope(y, q) AS sq, regr_intercept(y, q) AS iq,
  var_pop(p) AS vp, var_pop(q) AS vq, covar_pop(p, q) AS cpq, covar_pop(p, y) AS cpy, covar_pop(q, y) AS cqy FROM f),
x AS (SELECT m.*, y, ip + sp * p AS a, iq + sq * q AS b FROM f, m),
s AS (SELECT any_value(k) AS k, 1e5 - any_value(k) * avg(power(a - y, 2)) AS score_a, 1e5 - any_value(k) * avg(power(b - y, 2)) AS score_b, avg(power(b - a, 2)) AS d2,
  covar_pop(a, b - a) AS h, var_pop(a) AS va, any_value(k) * ((any_value(cpy) * (any_value(cpy) * any_value(vq) - any_value(cqy) * any_value(cpq)) + any_value(cqy) * (any_value(cqy) * any_value(vp) - any_value(cpy) * any_value(cpq)))
    / (any_value(vp) * any_value(vq) - power(any_value(cpq), 2)) - power(any_value(cpy), 2) / any_value(vp)) AS refit_gain FROM x),
g AS (SELECT *, greatest(0.0, least(1.0, 0.5 + (score_b - score_a) / (2 * k * d2))) AS w FROM s)"""


@query("lin5_geometry", f"WITH {GEOMETRY} SELECT round(score_a, 3) AS score_a, round(score_b, 3) AS score_b, round(sqrt(d2), 6) AS distance, round(sqrt(d2 - h * h / va), 6) AS apart, round(w, 5) AS weight, round(w * (score_b - score_a) + k * w * (1 - w) * d2, 3) AS gain, round(refit_gain, 3) AS refit_gain FROM g")
def lin5_geometry(spark, d):
    """How far two models stand apart, and what mixing or refitting both would add."""
    g = T.model_geometry(predictions(spark, d), "y", "p", "q")
    digits = {"score_a": 3, "score_b": 3, "distance": 6, "apart": 6, "weight": 5, "gain": 3, "refit_gain": 3}
    return spark.createDataFrame([tuple(round(g[k], n) for k, n in digits.items())], ", ".join(f"{k} double" for k in digits))


@query("lin5b_joint_gain", f"WITH {PRED} SELECT round(1e5 / (avg(y) * (1 - avg(y))) * power(avg((q - 0.2) * (p - y)), 2) / avg(power(q - 0.2, 2)), 3) AS gain FROM f")
def lin5b(spark, d):
    f = predictions(spark, d).withColumn("z", F.col("q") - 0.2)
    return spark.createDataFrame([(round(T.joint_gain(f, "y", "p", ["z"]), 3),)], "gain double")


@query("lin5c_canonical")
def lin5c(spark, d):
    """Canonical correlations of two blocks of measures, angles between their spans, and the correlation of two partitions."""
    f = predictions(spark, d).withColumns({"u": F.col("value") / 100, "v": F.col("partner") / 100.0, "m": F.log1p("n")})
    rows = [("canonical", i, round(v, 5)) for i, v in enumerate(T.canonical_correlations(f, ["p", "m"], ["u", "v", "y"]))]
    rows += [("angle", i, round(v, 5)) for i, v in enumerate(T.subspace_angles(f, ["p", "m"], ["u", "v"]))]
    rows.append(("partition", 0, round(T.partition_correlation(f, "kind", "season"), 5)))
    return spark.createDataFrame(rows, "measure string, i int, v double")


@query("ens3_stacking")
def ens3(spark, d):
    """Stacks of three ridge members, fitted on predictions from out of each pair of months, applied to the next year."""
    li = line_log(spark, d).select("season", F.floor((F.col("month") - 1) / 2).cast("int").alias("block"), (F.col("quantity") / 50).alias("quantity"), (F.col("price") / 1e5).alias("price"), (F.col("discount") * 10).alias("discount"), (F.col("partner") % 13 / 13).alias("part"), "y")
    out, _ = T.stack_by_blocks(li, {"size": ["quantity", "price"], "rebate": ["discount"], "part": ["part", "quantity"]}, "y", "season", "block", [1.0, 100.0, 10000.0])
    return out.select("fit", "target", "lam", "n", *(r6(c).alias(c) for c in ("brier", "fixed", "gain")), F.transform("weights", lambda w: F.round(w, 4)).alias("weights"))


@query("ml4_one_hot_member")
def ml4(spark, d):
    w = T.one_hot_member(predictions(spark, d).withColumn("month_third", F.floor(F.dayofmonth("ts") / 10)), ["kind", "season", "month_third"])
    return w.select("column", "value", F.round("weight", 4).alias("weight"))


@query("val5_successive_halving", f"""WITH {LOG}, a AS (SELECT * FROM (VALUES ('k05', 5.0::DOUBLE), ('k10', 10.0), ('k20', 20.0), ('k50', 50.0), ('k100', 100.0), ('k200', 200.0), ('k500', 500.0)) t(arm, w)),
s AS (SELECT arm, season, -avg(y * ln((k + w * 0.2) / (n + w)) + (1 - y) * ln(1 - (k + w * 0.2) / (n + w))) AS loss FROM log, a GROUP BY ALL),
alive AS (SELECT arm FROM (SELECT *, row_number() OVER (ORDER BY loss, arm) AS r FROM s WHERE season = 4) WHERE r <= 5 OR arm = 'k05'), f AS (SELECT arm, avg(loss) AS loss, count(*) AS folds FROM s JOIN alive USING (arm) WHERE season >= 1 GROUP BY arm)
SELECT arm, round(loss, 7) AS loss, folds, round(loss - (SELECT loss FROM f WHERE arm = 'k05'), 7) + 0.0 AS delta, loss - (SELECT loss FROM f WHERE arm = 'k05') < -1e-4 AS beats FROM f""")
def val5(spark, d):
    """Seven weights of the shrinkage, halved on the latest week, then held against the lightest on all."""
    log = counted_log(spark, d)
    arms = spark.createDataFrame([("k05", 5.0), ("k10", 10.0), ("k20", 20.0), ("k50", 50.0), ("k100", 100.0), ("k200", 200.0), ("k500", 500.0)], "arm string, w double")

    def score(few, folds):
        p = (F.col("k") + F.col("w") * 0.2) / (F.col("n") + F.col("w"))
        rows = log.filter(F.col("season").isin(folds)).crossJoin(F.broadcast(few))
        return rows.groupBy("arm", F.col("season").alias("fold")).agg((-F.avg(F.col("y") * F.ln(p) + (1 - F.col("y")) * F.ln(1 - p))).alias("loss"))

    out = M.successive_halving(score, arms, [1, 2, 3, 4], "k05")
    return out.select("arm", F.round("loss", 7).alias("loss"), "folds", (F.round("delta", 7) + F.lit(0.0)).alias("delta"), "beats")


@query("met9b_pair_blend", f"""WITH {PRED}, c AS (SELECT 1e5 / (avg(y) * (1 - avg(y))) AS scale FROM f), e AS (SELECT any_value(scale) AS k, 1e5 - any_value(scale) * avg(power(p - y, 2)) AS sa, 1e5 - any_value(scale) * avg(power(r - y, 2)) AS sb, avg(power(p - r, 2)) AS d2 FROM f, c),
w AS (SELECT *, 0.5 + (sb - sa) / (2 * k * d2) AS t, greatest(0.0, least(1.0, 0.5 + (sb - sa) / (2 * k * d2))) AS w FROM e)
SELECT round(sa, 3) AS score_a, round(sb, 3) AS score_b, round(d2, 8) AS distance2, round(w, 5) AS weight, round(w * (sb - sa) + k * w * (1 - w) * d2, 3) AS gain, round(greatest(0.0, 2 * t), 5) AS break_even FROM w""")
def met9b(spark, d):
    """The best weight of two models as they are, what it gains, and the weight beyond which it loses."""
    g = T.pair_blend(predictions(spark, d), "y", "p", "r")
    digits = {"score_a": 3, "score_b": 3, "distance2": 8, "weight": 5, "gain": 3, "break_even": 5}
    return spark.createDataFrame([tuple(round(g[k], n) for k, n in digits.items())], ", ".join(f"{k} double" for k in digits))
