"""Queries of shrinkage features."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import history as H
from ..operators import shrinkage as D
from ..sources.tables import counted_log, event_log, line_log
from .registry import BASED, ENDS, EV, LI, query, r6


def _split(spark, d, K=100.0):
    log = counted_log(spark, d)
    return H.in_season_split(H.as_of_season(log, H.season_end(log)), K)


IS = BASED + ", s AS (SELECT *, greatest(0, n - base_n) AS is_n, greatest(0, least(k - base_k, n - base_n)) AS is_k FROM based)"


@query("dom4_innovation", f"""WITH {IS}, q AS (SELECT *, CASE WHEN base_n > 0 THEN base_k / base_n ELSE 0.2 END AS q0 FROM s)
SELECT row_id, round(q0, 6) AS q_prior, round((is_k + 30.0 * q0) / (is_n + 30.0), 6) AS q_post, round((is_k + 30.0 * q0) / (is_n + 30.0) - q0, 6) + 0.0 AS innovation, round(is_n / (is_n + 30.0), 6) AS reliability, round(ln(1 + is_n), 6) AS log_dn FROM q""")
def dom4(spark, d):
    return D.innovation(_split(spark, d), 30.0, 0.2).select("row_id", (r6("innovation") + F.lit(0.0)).alias("innovation"), *(r6(c).alias(c) for c in ("q_prior", "q_post", "reliability", "log_dn")))


@query("dom5_mix_log_ratio", f"""WITH {EV}, b AS (SELECT row_id, """ + ", ".join(f"count(*) FILTER (kind = '{v}') OVER s AS d_{k}, count(*) FILTER (kind = '{v}') OVER e - count(*) FILTER (kind = '{v}') OVER s AS base_{k}" for k, v in {"a": "click", "b": "view", "c": "purchase"}.items()) + f""", kind IN ('click', 'view', 'purchase') AS met FROM ev
  WINDOW e AS (PARTITION BY entity ORDER BY row_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), s AS (PARTITION BY entity, season ORDER BY row_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
n AS (SELECT *, d_a + d_b + d_c AS dn, base_a + base_b + base_c AS base_n FROM b), l AS (SELECT """ + ", ".join(f"avg((kind = '{v}')::INT) AS l_{k}" for k, v in {"a": "click", "b": "view", "c": "purchase"}.items()) + """ FROM ev WHERE kind IN ('click', 'view', 'purchase')),
q AS (SELECT *, """ + ", ".join(f"CASE WHEN base_n > 0 THEN base_{k} / base_n ELSE l_{k} END AS p_{k}" for k in "abc") + """ FROM n, l), t AS (SELECT *, """ + ", ".join(f"(d_{k} + 10.0 * p_{k}) / (dn + 10.0) AS q_{k}" for k in "abc") + """ FROM q)
SELECT row_id, """ + ", ".join(f"round(ln(least(1.0, greatest(1e-4, q_{k})) / least(1.0, greatest(1e-4, q_a))), 6) + 0.0 AS lr_{k}" for k in "bc") + """, round(dn / (dn + 10.0), 6) AS reliability, round(q_a - p_a, 6) + 0.0 AS innovation FROM t""")
def dom5(spark, d):
    kinds = {"a": "click", "b": "view", "c": "purchase"}
    e = event_log(spark, d)
    hit = lambda v: (F.col("kind") == v).cast("int")
    whole, own = H.before("entity"), H.before(["entity", "season"])
    add = {f"d_{k}": F.coalesce(F.sum(hit(v)).over(own), F.lit(0)) for k, v in kinds.items()}
    add |= {f"base_{k}": F.coalesce(F.sum(hit(v)).over(whole), F.lit(0)) - F.coalesce(F.sum(hit(v)).over(own), F.lit(0)) for k, v in kinds.items()}
    total = lambda p: F.col(f"{p}_a") + F.col(f"{p}_b") + F.col(f"{p}_c")
    rows = e.withColumns(add).withColumns({"dn": total("d"), "base_n": total("base")})
    of = e.filter(F.col("kind").isin(*kinds.values())).agg(*(F.avg(hit(v)).alias(k) for k, v in kinds.items())).first()
    m = D.log_ratio_mix(rows, list(kinds), {k: float(of[k] or 0.0) for k in kinds}, 10.0)
    return m.select("row_id", *((r6(c) + F.lit(0.0)).alias(c) for c in ("lr_b", "lr_c")), r6("reliability").alias("reliability"), (r6("innovation") + F.lit(0.0)).alias("innovation"))


#: From the formulas: season increments, the league's rate over all seasons before, weights normalised first, then moments by list.
PRIOR = ENDS + """, i0 AS (SELECT *, coalesce(lag(n_end) OVER w, 0) AS pn, coalesce(lag(k_end) OVER w, 0) AS pk FROM ends WINDOW w AS (PARTITION BY entity ORDER BY season)),
i1 AS (SELECT entity, season, CASE WHEN n_end < pn THEN n_end ELSE n_end - pn END AS dn, CASE WHEN n_end < pn THEN k_end ELSE k_end - pk END AS dk0 FROM i0),
inc AS (SELECT entity, season, dn, greatest(0, least(dk0, dn)) AS dk FROM i1 WHERE dn > 0),
t AS (SELECT DISTINCT entity, season AS target_season FROM log),
lr AS (SELECT s.season, (SELECT sum(dk) / sum(dn) FROM inc WHERE inc.season < s.season) AS r FROM (SELECT DISTINCT season FROM log) s),
lg AS (SELECT season AS target_season, CASE WHEN r IS NULL THEN 0.2 WHEN r < 1e-4 THEN 1e-4 WHEN r > 1 - 1e-4 THEN 1 - 1e-4 ELSE r END AS league FROM lr),
h AS (SELECT t.entity, t.target_season, league, i.season, (i.dk + 20 * league) / (i.dn + 20) AS m, power(0.7, t.target_season - 1 - i.season) * sqrt(i.dn / (i.dn + 20)) AS w, i.dn + 21 AS v
  FROM t JOIN lg USING (target_season) JOIN inc i ON i.entity = t.entity AND i.season < t.target_season),
hn AS (SELECT *, w / sum(w) OVER g AS u, row_number() OVER (PARTITION BY entity, target_season ORDER BY season DESC) AS back FROM h WINDOW g AS (PARTITION BY entity, target_season)),
mean AS (SELECT entity, target_season, sum(u * m) AS prior FROM hn GROUP BY ALL),
mom AS (SELECT entity, target_season, prior, count(*) AS seasons, greatest(1e-5, sum(u * power(m - prior, 2)) + sum(u * m * (1 - m) / v)) AS variance,
  any_value(league) AS league, sum(m) FILTER (back = 1) AS last, sum(u * m) FILTER (back > 1) / sum(u) FILTER (back > 1) AS earlier FROM hn JOIN mean USING (entity, target_season) GROUP BY ALL),
p AS (SELECT t.entity, t.target_season, lg.league, coalesce(prior, lg.league) AS prior, coalesce(variance, lg.league * (1 - lg.league) / 26) AS variance,
  CASE WHEN prior IS NULL THEN 25.0 ELSE greatest(25.0, least(800.0, prior * (1 - prior) / variance - 1)) END AS strength, CASE WHEN prior IS NULL THEN 0.0 ELSE last - coalesce(earlier, mom.league) END AS trend, coalesce(seasons, 0) AS seasons
  FROM t JOIN lg USING (target_season) LEFT JOIN mom USING (entity, target_season))"""


def _prior(spark, d):
    log = counted_log(spark, d)
    return D.season_prior(H.season_increment(H.season_end(log)), log.select("entity", "season").distinct(), 0.7, 20.0, 0.2)


@query("agg7_season_prior", f"WITH {PRIOR} SELECT entity, target_season, seasons, round(prior, 6) AS prior, round(variance, 6) AS variance, round(strength, 3) AS strength, round(trend, 6) AS trend, round(league, 6) AS league FROM p")
def agg7(spark, d):
    p = _prior(spark, d)
    return p.select("entity", "target_season", "seasons", F.round("strength", 3).alias("strength"), *(r6(c).alias(c) for c in ("prior", "variance", "trend", "league")))


@query("dom6_state_transform", f"""WITH {PRIOR}, b AS (SELECT l.*, coalesce(e.n_end, 0) AS bn, coalesce(e.k_end, 0) AS bk FROM log l ASOF LEFT JOIN ends e ON l.entity = e.entity AND l.season > e.season),
x AS (SELECT row_id, prior, strength, greatest(0, n - bn) AS dn, greatest(0, least(k - bk, n - bn)) AS dk FROM b JOIN p ON p.entity = b.entity AND p.target_season = b.season),
q AS (SELECT *, (prior * strength + dk) / (strength + dn) AS post FROM x)
SELECT row_id, round(post, 6) AS post, round(post - prior, 6) + 0.0 AS innov, round(post * (1 - post) / (strength + dn + 1), 6) AS post_var, round(dn / (strength + dn), 6) AS rel, round(ln(1 + dn), 6) AS logdn FROM q""")
def dom6(spark, d):
    s = D.transform_state(D.apply_artifact(_split(spark, d), _prior(spark, d)))
    return s.select("row_id", (r6("innov") + F.lit(0.0)).alias("innov"), *(r6(c).alias(c) for c in ("post", "post_var", "rel", "logdn")))


@query("dom8_interactions", f"""WITH {IS}, q AS (SELECT *, (is_k + 30.0 * 0.2) / (is_n + 30.0) - 0.2 AS inn FROM s) SELECT row_id, """ + ", ".join(f"round(CASE WHEN partner % 3 = {i} THEN inn ELSE 0 END, 6) AS x_{i}" for i in range(3)) + ", round(inn * (value - 50) / 50, 6) AS x_value FROM q")
def dom8(spark, d):
    inn = (F.col("is_k") + 30 * 0.2) / (F.col("is_n") + 30) - 0.2
    s = _split(spark, d).withColumn("inn", inn)
    return s.select("row_id", *(r6(F.when(F.col("partner") % 3 == i, F.col("inn")).otherwise(0.0)).alias(f"x_{i}") for i in range(3)), r6(F.col("inn") * (F.col("value") - 50) / 50).alias("x_value"))


def _backfit_sql() -> str:
    """Row by row: each step's effects come off every row's residual, and the row's correction is what came off in all."""
    steps = [("e1", "entity"), ("g1", "partner, grp"), ("e2", "entity"), ("g2", "partner, grp")]
    shrink = {"e": 100, "g": 40}
    sql, last = [f"{LI}, r0 AS (SELECT *, y - (SELECT avg(y) FROM li) AS r, quantity AS w FROM li)"], "r0"
    for name, keys in steps:
        sql.append(f"{name} AS (SELECT {keys}, sum(w * r) / (sum(w) + {shrink[name[0]]}) AS e FROM {last} GROUP BY ALL), r_{name} AS (SELECT l.* REPLACE (l.r - e AS r) FROM {last} l JOIN {name} USING ({keys}))")
        last = f"r_{name}"
    return f"WITH {', '.join(sql)} SELECT entity, partner, grp, count(*) AS n, round(avg(y - (SELECT avg(y) FROM li) - r), 6) + 0.0 AS correction FROM {last} GROUP BY ALL"


@query("dom9_residual_effects", _backfit_sql())
def dom9(spark, d):
    """Two passes over an entity and a composite key, weighted, and the sum of their effects for each combination of keys."""
    li = line_log(spark, d)
    mean = F.broadcast(li.agg(F.avg("y").alias("m")))
    spec = [("e", ["entity"], 100.0), ("g", ["partner", "grp"], 40.0)]
    fx = D.residual_effects(li.crossJoin(mean).withColumn("r", F.col("y") - F.col("m")), spec, "r", "quantity")
    cells = li.groupBy("entity", "partner", "grp").agg(F.count("*").alias("n"))
    return D.apply_effects(cells, fx).select("entity", "partner", "grp", "n", (r6("correction") + F.lit(0.0)).alias("correction"))


@query("dom12_grid_inversion", f"""WITH {LI}, v AS (SELECT entity, avg(quantity) AS q, avg(discount) AS c FROM li GROUP BY entity), g AS (SELECT i * 20 + j AS point, 24 + i * 0.15 AS q, 0.04 + j * 0.001 AS c FROM range(20) a(i), range(20) b(j))
SELECT entity, point, round(dist, 6) AS distance FROM (SELECT v.entity, g.point, power((v.q - g.q) / 2, 2) + power((v.c - g.c) / 0.01, 2) AS dist, row_number() OVER (PARTITION BY v.entity ORDER BY power((v.q - g.q) / 2, 2) + power((v.c - g.c) / 0.01, 2), g.point) AS r FROM v, g) WHERE r = 1""")
def dom12(spark, d):
    v = line_log(spark, d).groupBy("entity").agg(F.avg("quantity").alias("q"), F.avg("discount").alias("c"))
    # Points are decimals, rounded once: sums of doubles are off by a digit at every fifth, which decides between points equally far.
    grid = spark.range(400).select(F.col("id").alias("point"), F.expr("CAST(24 + (id div 20) * 0.15BD AS DOUBLE)").alias("q"), F.expr("CAST(0.04BD + id % 20 * 0.001BD AS DOUBLE)").alias("c"))
    return D.nearest_grid_point(v, grid, "entity", {"q": 2.0, "c": 0.01}, "point").select("entity", "point", r6("distance").alias("distance"))


@query("dom13_extrapolation", f"""WITH {LI}, m AS (SELECT partner % 7 AS seg, season, avg(y) AS r FROM li WHERE NOT (partner % 7 = 3 AND season = 1999) GROUP BY ALL)
SELECT seg, round(greatest(0.3, least(0.7, CASE WHEN count(r) FILTER (season >= 1998) = 3 THEN regr_intercept(r, season) FILTER (season >= 1998) + regr_slope(r, season) FILTER (season >= 1998) * 2001 ELSE max_by(r, season) END)), 5) AS forecast FROM m WHERE season < 2001 GROUP BY seg""")
def dom13(spark, d):
    """One segment lacks a season before the target, so its last level stands."""
    li = line_log(spark, d).withColumn("seg", F.col("partner") % 7).filter("NOT (seg = 3 AND season = 1999)")
    m = li.groupBy("seg", "season").agg(F.avg("y").alias("r"))
    return D.extrapolate(m, ["seg"], "season", "r", 2001).select("seg", F.round("forecast", 5).alias("forecast"))


@query("dom13b_segment_forecasts", f"""WITH {LI}, m AS (SELECT partner % 7 AS seg, season, avg(y) AS r FROM li GROUP BY ALL), b AS (SELECT greatest(0.3, least(0.7, regr_intercept(r, season) + regr_slope(r, season) * 2001)) AS f FROM m WHERE seg = 0 AND season BETWEEN 1998 AND 2000),
l AS (SELECT seg, max(r) FILTER (season = 2000) AS last FROM m GROUP BY seg)
SELECT seg, round(CASE WHEN seg = 0 OR last IS NULL THEN f ELSE greatest(0.3, least(0.7, f + 0.5 * (last - (SELECT last FROM l WHERE seg = 0)))) END, 5) AS forecast FROM l, b""")
def dom13b(spark, d):
    m = line_log(spark, d).groupBy((F.col("partner") % 7).alias("seg"), "season").agg(F.avg("y").alias("r"))
    return D.segment_forecasts(m, "seg", 0, "season", "r", 2001).select("seg", F.round("forecast", 5).alias("forecast"))


@query("dom14_log5", f"""WITH {LI}, e AS (SELECT entity, (sum(y) + 30 * 0.333) / (count(*) + 30) AS p FROM li GROUP BY entity), b AS (SELECT partner, (sum(y) + 30 * 0.333) / (count(*) + 30) AS q FROM li GROUP BY partner), x AS (SELECT DISTINCT entity, partner FROM li)
SELECT entity, partner, round((p * q / 0.333) / (p * q / 0.333 + (1 - p) * (1 - q) / 0.667), 6) AS chance FROM x JOIN e USING (entity) JOIN b USING (partner)""")
def dom14(spark, d):
    li = line_log(spark, d)
    rate = lambda k, n: li.groupBy(k).agg(H.shrunk(F.sum("y"), F.count("*"), 30.0, 0.333).alias(n))
    x = li.select("entity", "partner").distinct().join(rate("entity", "p"), "entity").join(rate("partner", "q"), "partner")
    return x.select("entity", "partner", r6(D.log5(F.col("p"), F.col("q"), F.lit(0.333))).alias("chance"))


@query("shr1_shrunk_logit", f"WITH {LI}, c AS (SELECT entity, season, count(*) AS n, sum(y) AS k FROM li GROUP BY ALL), p AS (SELECT *, (k + 80 * 0.333) / (n + 80) AS p FROM c) SELECT entity, season, round(0.8 * ln(p / (1 - p)) + 0.2 * ln(0.333 / 0.667), 6) AS z FROM p")
def shr1(spark, d):
    c = line_log(spark, d).groupBy("entity", "season").agg(F.count("*").alias("n"), F.sum("y").alias("k"))
    return c.select("entity", "season", r6(D.shrunk_logit(c, 80.0, 0.8, 0.333)).alias("z"))


@query("shr2_grid_scan", f"""WITH {LI}, c AS (SELECT entity, season, count(*) AS n, sum(y) AS k FROM li GROUP BY ALL), b AS (SELECT a.n AS an, a.k AS ak, c.n, c.k FROM c a JOIN c ON a.entity = c.entity AND c.season = a.season + 1)
SELECT g.w AS weight, round(sum(k * power(1 - (ak + w * 0.333) / (an + w), 2) + (n - k) * power((ak + w * 0.333) / (an + w), 2)) / sum(n), 6) AS brier FROM b, (VALUES (10.0::DOUBLE), (50.0), (250.0), (1000.0)) g(w) GROUP BY g.w""")
def shr2(spark, d):
    from ..operators.joins import season_offset

    c = line_log(spark, d).groupBy("entity", "season").agg(F.count("*").alias("n"), F.sum("y").alias("k"))
    b = season_offset(c, c, ["n", "k"]).filter("prev1_n IS NOT NULL")
    weights = F.explode(F.array(*(F.lit(w) for w in (10.0, 50.0, 250.0, 1000.0)))).alias("weight")
    p = (F.col("prev1_k") + F.col("weight") * 0.333) / (F.col("prev1_n") + F.col("weight"))
    loss = F.col("k") * F.pow(1 - p, 2) + (F.col("n") - F.col("k")) * F.pow(p, 2)
    return b.select("*", weights).groupBy("weight").agg(r6(F.sum(loss) / F.sum("n")).alias("brier"))


#: Tail of the two-dimensional aim, and of the normal distribution, by their series.
_Q = "list_sum(list_transform(range(0, 200), lambda k: exp(-u + k * ln(u) - lgamma(k + 1)) * list_sum(list_transform(range(0, k + 1), lambda i: exp(-v + i * ln(v) - lgamma(i + 1))))))"


@query("shr3_geometry", f"""WITH {LI}, m AS (SELECT entity, grp, 0.6 + stddev_samp(quantity) / 40 AS sigma, abs(avg(quantity) - 25.5) / 4 + 0.01 AS a FROM li GROUP BY ALL),
c AS (SELECT *, sqrt(-2 * ln(0.7)) AS r0, sqrt(-2 * ln(0.15)) AS r1, 1.6448536269514722 / sigma AS z FROM m),
p AS (SELECT *, a * a / sigma / sigma / 2 AS u, r0 * r0 / sigma / sigma / 2 AS v0, r1 * r1 / sigma / sigma / 2 AS v1 FROM c),
q AS (SELECT *, 1 - {_Q.replace('v', 'v0')} AS mid, {_Q.replace('v', 'v1')} AS outside,
  0.5 - exp(-z * z / 2) / sqrt(2 * pi()) * list_sum(list_transform(range(0, 120), lambda k: exp((2 * k + 1) * ln(z) + k * ln(2) + lgamma(k + 1) - lgamma(2 * k + 2)))) AS turned FROM p)
SELECT entity, grp, round(mid, 6) AS p_mid, round(outside, 6) AS p_out, round(turned, 6) AS p_rev, round(1 - mid - outside - turned, 6) AS p_success FROM q""")
def shr3(spark, d):
    """Chances of an aim's outcomes by its spread and offset."""
    g = D.Geometry(middle=0.3, outside=0.15, reversed=0.05)
    m = line_log(spark, d).groupBy("entity", "grp").agg((0.6 + F.stddev_samp("quantity") / 40).alias("sigma"), (F.abs(F.avg("quantity") - 25.5) / 4 + 0.01).alias("a"))
    return m.select("entity", "grp", *(r6(c).alias(n) for n, c in g.parts(F.col("sigma"), F.col("a")).items()))


@query("shr3b_grid_lookup")
def shr3b(spark, d):
    """The same chance of success from a table of 48 x 64 points."""
    g = D.Geometry(middle=0.3, outside=0.15, reversed=0.05)
    m = line_log(spark, d).groupBy("entity", "grp").agg((0.6 + F.stddev_samp("quantity") / 40).alias("sigma"), (F.abs(F.avg("quantity") - 25.5) / 4 + 0.01).alias("a"))
    return D.grid_lookup(m, D.geometry_grid(spark, g), "sigma", "a").select("entity", "grp", r6("p").alias("p"))
