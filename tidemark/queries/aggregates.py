"""Queries of aggregations."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import aggregates as A
from ..sources.tables import event_log, line_log, table
from .history import SESSION, sessions_of
from .registry import EV, LI, query, r6


@query("agg1_season_means", f"WITH {LI} SELECT season, grp, round(avg(y), 6) AS rate FROM li GROUP BY ALL")
def agg1(spark, d):
    return line_log(spark, d).groupBy("season", "grp").agg(r6(F.avg("y")).alias("rate"))


#: Bühlmann-Straub from rows: process variance over the sum of n - 1, moment estimate of the variance between groups.
_STRAUB = """SELECT {by} count(*) AS groups, any_value(m) AS mean, sum(n * p * (1 - p)) / greatest(sum(n - 1), 1) AS epv,
  (sum(n * power(p - m, 2)) - (count(*) - 1) * (sum(n * p * (1 - p)) / greatest(sum(n - 1), 1))) / greatest(sum(n) - sum(n * n) / sum(n), 1) AS vhm FROM g {group}"""
_ROUNDED = "groups, round(mean, 6) AS mean, round(epv, 6) AS epv, round(vhm, 8) AS vhm, round(CASE WHEN vhm > 1e-10 THEN epv / vhm ELSE 1e9 END, 1) AS K"
_GROUPS = LI + ", c AS (SELECT entity, count(*)::DOUBLE AS n, sum(y) AS k FROM li GROUP BY entity), g AS (SELECT *, k / n AS p, sum(k) OVER () / sum(n) OVER () AS m FROM c), v AS (" + _STRAUB.format(by="", group="") + ")"
_PREFIX = LI + """, t AS (SELECT DISTINCT season AS s FROM li UNION SELECT max(season) + 1 FROM li), c AS (SELECT s AS season, entity, count(*)::DOUBLE AS n, sum(y) AS k FROM li JOIN t ON li.season < s GROUP BY ALL),
g AS (SELECT *, k / n AS p, sum(k) OVER (PARTITION BY season) / sum(n) OVER (PARTITION BY season) AS m FROM c), v AS (""" + _STRAUB.format(by="season,", group="GROUP BY season") + ")"
_LOGIT = "greatest(0.001, least(0.999, m + n / (n + CASE WHEN vhm > 1e-10 THEN epv / vhm ELSE 1e9 END) * (p - m)))"


def _constants(c, *more):
    return c.select(*more, "groups", r6("mean").alias("mean"), r6("epv").alias("epv"), F.round("vhm", 8).alias("vhm"), F.round("kappa", 1).alias("K"))


def _entities(spark, d):
    return line_log(spark, d).groupBy("entity").agg(F.count("*").alias("n"), F.sum("y").alias("k"))


def _prefixes(spark, d):
    return A.prefix_counts(line_log(spark, d).groupBy("entity", "season").agg(F.count("*").alias("n"), F.sum("y").alias("k")))


@query("agg3_buhlmann_straub", f"WITH {_GROUPS} SELECT {_ROUNDED} FROM v")
def agg3(spark, d):
    return _constants(A.credibility(_entities(spark, d), []))


@query("agg3b_shrunk_logits", f"WITH {_GROUPS} SELECT entity, round(ln({_LOGIT} / (1 - {_LOGIT})), 5) AS z FROM g, v")
def agg3b(spark, d):
    g = _entities(spark, d)
    return g.crossJoin(F.broadcast(A.credibility(g, []))).select("entity", F.round(A.credible_logit(), 5).alias("z"))


@query("agg4_prefix_variance", f"WITH {_PREFIX} SELECT season, {_ROUNDED} FROM v")
def agg4(spark, d):
    """The constants that each season could know: over all seasons strictly before."""
    return _constants(A.credibility(_prefixes(spark, d), ["season"]), "season")


@query("agg4b_prefix_logits", f"WITH {_PREFIX} SELECT entity, season, round(ln({_LOGIT} / (1 - {_LOGIT})), 5) AS z FROM g JOIN v USING (season)")
def agg4b(spark, d):
    g = _prefixes(spark, d)
    constants = A.credibility(g, ["season"])  # one row a season
    return g.join(F.broadcast(constants), "season").select("entity", "season", F.round(A.credible_logit(), 5).alias("z"))


@query("agg6_league_rate", f"WITH {LI} SELECT season, round(greatest(0.01, least(0.99, sum(y) / count(*))), 6) AS rate FROM li GROUP BY season")
def agg6(spark, d):
    rate = F.greatest(F.lit(0.01), F.least(F.lit(0.99), F.sum("y") / F.count("*")))
    return line_log(spark, d).groupBy("season").agg(r6(rate).alias("rate"))


@query("agg8_histogram", f"WITH {EV} SELECT entity, " + ", ".join(f"round(avg((kind = '{k}')::INT), 6) AS share_{k}" for k in ("click", "view", "purchase")) + " FROM ev GROUP BY entity")
def agg8(spark, d):
    s = A.shares(event_log(spark, d), ["entity"], "kind", ["click", "view", "purchase"])
    return s.select("entity", *(r6(f"share_{k}").alias(f"share_{k}") for k in ("click", "view", "purchase")))


@query("agg9_session_profile", f"""WITH {SESSION}, c AS (SELECT entity, session, count(*) AS n FROM s GROUP BY ALL)
SELECT entity, count(*) AS n_sessions, """ + ", ".join(f"round(quantile_cont(n, {q / 100}), 6) AS q{q}" for q in (10, 25, 50, 75, 90)) + ", round(avg(n), 6) AS mean_len, round(avg((n >= 3)::INT), 6) AS share_long FROM c GROUP BY entity")
def agg9(spark, d):
    p = A.session_profile(sessions_of(spark, d), ["entity"], "session")
    return p.select("entity", "n_sessions", *(r6(c).alias(c) for c in p.columns[2:]))


@query("agg10_mode", f"WITH {EV}, c AS (SELECT entity, kind, count(*) AS n FROM ev GROUP BY ALL) SELECT entity, kind AS mode FROM (SELECT *, row_number() OVER (PARTITION BY entity ORDER BY n DESC, kind) AS r FROM c) WHERE r = 1")
def agg10(spark, d):
    return A.mode_of(event_log(spark, d), ["entity"], "kind")


MOMENTS = f"""WITH {LI}, st AS (SELECT season, grp, avg(quantity) AS m, stddev_samp(quantity) AS s FROM li GROUP BY ALL), z AS (SELECT li.*, (quantity - m) / s AS z FROM li JOIN st USING (season, grp)),
c AS (SELECT entity, season, grp, count(z) AS n, sum(z) AS s, sum(z * z) AS q FROM z GROUP BY ALL)"""


def _moments(spark, d):
    from ..operators.sessions import z_in_group

    return A.cell_moments(z_in_group(line_log(spark, d), "quantity", ["season", "grp"]), ["entity", "season", "grp"], "z")


@query("agg12_cell_moments", f"{MOMENTS} SELECT entity, season, grp, n, round(s, 6) AS s, round(q, 6) AS q FROM c")
def agg12(spark, d):
    return _moments(spark, d).select("entity", "season", "grp", "n", r6("s").alias("s"), r6("q").alias("q"))


@query("agg13_pooled_variance", f"{MOMENTS} SELECT entity, round(sum(q - s * s / n) / sum(n - 1), 6) AS pooled FROM c WHERE n >= 2 GROUP BY entity")
def agg13(spark, d):
    return A.pooled_variance(_moments(spark, d), ["entity"]).select("entity", r6("pooled").alias("pooled"))


@query("agg14_supported_mean", f"{MOMENTS} SELECT entity, grp, round(CASE WHEN sum(n) >= 300 THEN sum(s) / sum(n) END, 6) AS level FROM c GROUP BY ALL")
def agg14(spark, d):
    return A.supported_mean(_moments(spark, d), ["entity", "grp"], 300).select("entity", "grp", r6("level").alias("level"))


@query("agg15_distinct", f"WITH {LI} SELECT season, count(DISTINCT entity) AS entities, count(DISTINCT partner) AS partners FROM li GROUP BY season")
def agg15(spark, d):
    return line_log(spark, d).groupBy("season").agg(F.count_distinct("entity").alias("entities"), F.count_distinct("partner").alias("partners"))


@query("agg16_crosstab_purity", f"WITH {EV}, c AS (SELECT entity, kind, count(*) AS n FROM ev GROUP BY ALL) SELECT entity, CAST(sum(n) AS BIGINT) AS n, round(max(n) / sum(n), 6) AS purity FROM c GROUP BY entity")
def agg16(spark, d):
    return A.purity(event_log(spark, d), "entity", "kind").select("entity", "n", r6("purity").alias("purity"))


@query("agg16b_crosstab", "SELECT o_orderpriority, " + ", ".join(f"count(*) FILTER (o_orderstatus = '{s}') AS n_{s}" for s in "FOP") + " FROM orders GROUP BY o_orderpriority")
def agg16b(spark, d):
    p = table(spark, d, "orders").groupBy("o_orderpriority").pivot("o_orderstatus", ["F", "O", "P"]).count()
    return p.select("o_orderpriority", *(F.coalesce(s, F.lit(0)).alias(f"n_{s}") for s in "FOP"))


@query("agg17_value_share", f"WITH {EV} SELECT kind, count(*) AS n, round(count(*) / sum(count(*)) OVER (), 6) AS share FROM ev GROUP BY kind")
def agg17(spark, d):
    counts = event_log(spark, d).groupBy("kind").agg(F.count("*").alias("n"))
    total = F.broadcast(counts.agg(F.sum("n").alias("all")))
    return counts.crossJoin(total).select("kind", "n", r6(F.col("n") / F.col("all")).alias("share"))


@query("agg18_regression_slope", f"WITH {LI} SELECT entity, grp, round(CASE WHEN count(*) >= 5 THEN regr_slope(price, quantity) END, 4) AS slope FROM li WHERE discount > 0.02 GROUP BY ALL")
def agg18(spark, d):
    return line_log(spark, d).filter("discount > 0.02").groupBy("entity", "grp").agg(F.round(A.slope(F.col("price"), F.col("quantity"), 5), 4).alias("slope"))


@query("agg19_trend_slope", f"WITH {LI}, s AS (SELECT entity, grp, season, avg(y) AS rate FROM li GROUP BY ALL) SELECT entity, grp, round(CASE WHEN count(*) >= 3 THEN regr_slope(rate, season) END, 6) AS trend FROM s GROUP BY entity, grp")
def agg19(spark, d):
    s = line_log(spark, d).groupBy("entity", "grp", "season").agg(F.avg("y").alias("rate"))
    return s.groupBy("entity", "grp").agg(r6(A.trend(F.col("rate"), F.col("season"))).alias("trend"))


@query("agg20_transition_shares", f"""WITH {EV}, t AS (SELECT entity, season, lag(kind) OVER (PARTITION BY entity, CAST(ts AS DATE) ORDER BY row_id) AS prev, kind AS cur FROM ev),
c AS (SELECT entity, season, prev, cur, count(*) AS n FROM t WHERE prev IS NOT NULL GROUP BY ALL)
SELECT entity, season, prev, cur, n, round(n / sum(n) OVER (PARTITION BY entity, season), 6) AS share FROM c""")
def agg20(spark, d):
    e = event_log(spark, d).withColumn("day", F.to_date("ts"))
    return A.transition_shares(e, ["entity", "season"], ["entity", "day"], "row_id", "kind").select("entity", "season", "prev", "cur", "n", r6("share").alias("share"))


@query("agg21_share_entropy", f"WITH {EV}, c AS (SELECT entity, kind, count(*) AS n FROM ev GROUP BY ALL), p AS (SELECT entity, n / sum(n) OVER (PARTITION BY entity) AS p FROM c) SELECT entity, round(-sum(p * ln(p)), 6) AS entropy FROM p GROUP BY entity")
def agg21(spark, d):
    c = event_log(spark, d).groupBy("entity", "kind").agg(F.count("*").alias("n"))
    # -sum p ln p = ln N - sum n ln n / N: one more aggregation, no window.
    return c.groupBy("entity").agg(r6(F.ln(F.sum("n")) - F.sum(F.col("n") * F.ln("n")) / F.sum("n")).alias("entropy"))


@query("agg22_gate", f"""WITH {LI}, f AS (SELECT grp AS arm, season, avg(y) - 0.333 AS delta FROM li GROUP BY ALL)
SELECT arm, round(avg(delta), 6) AS mean, round(stddev_samp(delta), 6) AS sd, round(min(delta), 6) AS worst, count(*) FILTER (delta > 0) AS positive, count(*) AS n, avg(delta) > 0 AND avg(delta) > stddev_samp(delta) AS passed FROM f GROUP BY arm""")
def agg22(spark, d):
    f = line_log(spark, d).groupBy(F.col("grp").alias("arm"), "season").agg((F.avg("y") - 0.333).alias("delta"))
    return A.gate(f, "arm", "delta").select("arm", r6("mean").alias("mean"), r6("sd").alias("sd"), r6("worst").alias("worst"), "positive", "n", "passed")


@query("agg23_pivot_report", f"WITH {EV} SELECT kind, " + ", ".join(f"round(avg(value) FILTER (season = {s}) + 1e-9, 4) AS s{s}" for s in range(5)) + " FROM ev GROUP BY kind")
def agg23(spark, d):
    p = event_log(spark, d).groupBy("kind").pivot("season", [0, 1, 2, 3, 4]).agg(F.round(F.avg("value") + 1e-9, 4))
    return p.select("kind", *(F.col(str(s)).alias(f"s{s}") for s in range(5)))


@query("agg24_shrunk_mean", f"WITH {LI} SELECT entity, n, round(n / (n + 200.0) * (p - (SELECT avg(y) FROM li)), 6) AS effect FROM (SELECT entity, count(*) AS n, avg(y) AS p FROM li GROUP BY entity)")
def agg24(spark, d):
    return A.shrunk_means(line_log(spark, d), ["entity"], 200.0).select("entity", "n", r6("effect").alias("effect"))


@query("agg25_rate_by_bucket", f"WITH {EV} SELECT CAST(floor(value / 10) AS BIGINT) AS bucket, count(*) AS n, round(avg(y), 6) AS rate FROM ev GROUP BY ALL")
def agg25(spark, d):
    return event_log(spark, d).groupBy(F.floor(F.col("value") / 10).alias("bucket")).agg(F.count("*").alias("n"), r6(F.avg("y")).alias("rate"))


@query("agg26_top_votes", f"""WITH {LI}, c AS (SELECT entity, partner, count(*) AS votes FROM li GROUP BY ALL)
SELECT entity, partner, votes, round(share, 6) AS share FROM (SELECT *, votes / sum(votes) OVER (PARTITION BY entity) AS share, row_number() OVER (PARTITION BY entity ORDER BY votes DESC, partner) AS r FROM c) WHERE r <= 5""")
def agg26(spark, d):
    return A.top_votes(line_log(spark, d), "entity", "partner").select("entity", "partner", "votes", r6("share").alias("share"))


@query("agg27_partition_oracle", f"WITH {LI}, g AS (SELECT season, grp, count(*) AS n, avg(y) - avg(0.3 + discount) AS bias FROM li GROUP BY ALL) SELECT count(*) AS parts, round(1e5 * sum(n * bias * bias) / sum(n), 3) AS gain FROM g")
def agg27(spark, d):
    li = line_log(spark, d).withColumn("p", 0.3 + F.col("discount"))
    return A.partition_gain(li, ["season", "grp"], "y", "p").select("parts", F.round("gain", 3).alias("gain"))


@query("agg28_argmax", f"WITH {EV} SELECT entity, row_id, value FROM (SELECT *, row_number() OVER (PARTITION BY entity ORDER BY value DESC, row_id) AS r FROM ev) WHERE r = 1")
def agg28(spark, d):
    best = F.min_by(F.struct("row_id", "value"), F.struct(-F.col("value"), F.col("row_id"))).alias("b")
    return event_log(spark, d).groupBy("entity").agg(best).select("entity", "b.row_id", "b.value")


@query("agg29_session_tuples", f"WITH {SESSION} SELECT entity, session, season, CAST(min_by(month(ts), row_id) AS INTEGER) AS month, count(*) AS n FROM s GROUP BY ALL")
def agg29(spark, d):
    return sessions_of(spark, d).groupBy("entity", "session", "season").agg(F.min_by(F.month("ts"), "row_id").alias("month"), F.count("*").alias("n"))


@query("agg30_entity_table", f"WITH {LI}, c AS (SELECT entity, season, count(*) AS n, min(grp) AS g FROM li GROUP BY ALL) SELECT entity, season AS best_season, n, g FROM (SELECT *, row_number() OVER (PARTITION BY entity ORDER BY n DESC, season) AS r FROM c) WHERE r = 1")
def agg30(spark, d):
    c = line_log(spark, d).groupBy("entity", "season").agg(F.count("*").alias("n"), F.min("grp").alias("g"))
    best = F.min_by(F.struct("season", "n", "g"), F.struct(-F.col("n"), F.col("season"))).alias("b")
    return c.groupBy("entity").agg(best).select("entity", F.col("b.season").alias("best_season"), "b.n", "b.g")


@query("agg31_centred_target", f"WITH {LI}, m AS (SELECT season, avg(y) AS r FROM li GROUP BY season), f AS (SELECT regr_intercept(r, season) + regr_slope(r, season) * 2002 AS next FROM m) SELECT season, round(r, 6) AS r, round(r - (SELECT avg(r) FROM m), 6) AS centred, round(next, 5) AS forecast FROM m, f")
def agg31(spark, d):
    m = line_log(spark, d).groupBy("season").agg(F.avg("y").alias("r"))
    f = F.broadcast(m.agg((F.regr_intercept("r", "season") + F.regr_slope("r", "season") * 2002).alias("next"), F.avg("r").alias("level")))
    return m.crossJoin(f).select("season", r6("r").alias("r"), r6(F.col("r") - F.col("level")).alias("centred"), F.round("next", 5).alias("forecast"))


@query("agg32_share_stability", f"""WITH {EV}, c AS (SELECT kind, avg((season <= 1)::INT) AS x, count(*) FILTER (season <= 1) AS a, count(*) FILTER (season > 1) AS b FROM ev GROUP BY kind), s AS (SELECT kind, a / sum(a) OVER () AS a, b / sum(b) OVER () AS b FROM c) SELECT round(max(abs(a - b)), 6) AS worst FROM s""")
def agg32(spark, d):
    early = F.col("season") <= 1
    c = event_log(spark, d).groupBy("kind").agg(F.count_if(early).alias("a"), F.count_if(~early).alias("b"))
    t = F.broadcast(c.agg(F.sum("a").alias("sa"), F.sum("b").alias("sb")))
    return c.crossJoin(t).agg(r6(F.max(F.abs(F.col("a") / F.col("sa") - F.col("b") / F.col("sb")))).alias("worst"))
