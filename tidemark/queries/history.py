"""Queries of as-of history and windows."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import history as H
from ..operators import sessions as S
from ..operators.ordered import quantiles
from ..sources.tables import counted_log, event_log, line_log
from .registry import BASED, ENDS, EV, LI, LOG, query, r6

PRE = "ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING"


@query("agg2_season_end", f"WITH {ENDS} SELECT * FROM ends")
def agg2(spark, d):
    return H.season_end(counted_log(spark, d))


@query("jn1_asof_season", f"WITH {BASED} SELECT row_id, entity, season, base_n AS base_n_end, base_k AS base_k_end FROM based")
def jn1(spark, d):
    log = counted_log(spark, d)
    return H.as_of_season(log, H.season_end(log)).select("row_id", "entity", "season", "base_n_end", "base_k_end")


def _split_sql(K: float, entity: str = "entity") -> str:
    """From the formulas: counts since the base, k clipped to n, shrunk rate, difference to the career rate with weight 500."""
    based = BASED if entity == "entity" else BASED.replace("PARTITION BY entity", f"PARTITION BY {entity}").replace("ends AS (SELECT entity", f"ends AS (SELECT {entity}").replace("l.entity = e.entity", f"l.{entity} = e.{entity}")
    return f"""WITH {based}, c AS (SELECT row_id, n, k, CASE WHEN n < base_n THEN 0 ELSE n - base_n END AS m, k - base_k AS j FROM based),
s AS (SELECT row_id, n, k, m AS is_n, CASE WHEN j < 0 THEN 0 WHEN j > m THEN m ELSE j END AS is_k FROM c)
SELECT row_id, is_n, is_k, round(ln(1 + is_n), 6) AS is_logn, round((is_k + {K / 2}) / (is_n + {K}), 6) AS is_rate,
  round((is_k + {K / 2}) / (is_n + {K}) - (k + 250.0) / (n + 500.0), 6) AS is_delta, round(is_n / CASE WHEN n = 0 THEN 1 ELSE n END, 6) AS is_share FROM s"""


def _split_columns(s):
    return s.select("row_id", "is_n", "is_k", *(r6(c).alias(c) for c in ("is_logn", "is_rate", "is_delta", "is_share")))


@query("dom1_inseason_split", _split_sql(100.0))
def dom1(spark, d):
    log = counted_log(spark, d)
    return _split_columns(H.in_season_split(H.as_of_season(log, H.season_end(log)), 100.0))


@query("dom3_partner_inseason", _split_sql(40.0, "partner"))
def dom3(spark, d):
    log = counted_log(spark, d, "partner")
    return _split_columns(H.in_season_split(H.as_of_season(log, H.season_end(log, "partner"), "partner"), 40.0))


KINDS = ("click", "view", "purchase")


def _block_sql(K: float) -> str:
    counts = ", ".join(f"coalesce(sum((kind = '{c}')::INT) OVER w, 0) AS k_{c}" for c in KINDS)
    ends = ", ".join(f"k_{c} + (kind = '{c}')::INT AS e_{c}" for c in KINDS)
    out = []
    for c in KINDS:
        k = f"greatest(0, least(k_{c} - b_{c}, m))"
        out += [f"round(({k} + {K / 2}) / (m + {K}), 6) AS isp_{c}_sm", f"round(({k} + {K / 2}) / (m + {K}) - (k_{c} + {K / 2}) / (n + {K}), 6) AS isp_{c}_d"]
    return f"""WITH {EV}, l AS (SELECT row_id, entity, season, kind, count(*) OVER w AS n, {counts} FROM ev WINDOW w AS (PARTITION BY entity ORDER BY row_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
e AS (SELECT entity, season, n + 1 AS n_end, {ends} FROM l QUALIFY row_number() OVER (PARTITION BY entity, season ORDER BY n DESC, row_id) = 1),
j AS (SELECT l.*, coalesce(n_end, 0) AS b, {", ".join(f"coalesce(e_{c}, 0) AS b_{c}" for c in KINDS)} FROM l ASOF LEFT JOIN e ON l.entity = e.entity AND l.season > e.season),
x AS (SELECT *, greatest(0, n - b) AS m FROM j)
SELECT row_id, round(ln(1 + m), 6) AS isp_logn, round(m / greatest(n, 1), 6) AS isp_share, {", ".join(out)} FROM x"""


@query("dom2_inseason_block", _block_sql(100.0))
def dom2(spark, d):
    """The split of several counters over one entity: level and departure of each."""
    hit = {c: (F.col("kind") == c).cast("int") for c in KINDS}
    w = Window.partitionBy("entity").orderBy("row_id").rowsBetween(Window.unboundedPreceding, -1)
    log = event_log(spark, d).withColumns({"n": F.count("*").over(w)} | {f"k_{c}": F.coalesce(F.sum(h).over(w), F.lit(0)) for c, h in hit.items()})
    top = Window.partitionBy("entity", "season").orderBy(F.desc("n"), "row_id")
    ends = log.withColumn("r", F.row_number().over(top)).filter("r = 1").select("entity", "season", (F.col("n") + 1).alias("n_end"), *((F.col(f"k_{c}") + h).alias(f"k_{c}_end") for c, h in hit.items()))
    rows = H.as_of_season(log, ends.withColumnsRenamed({f"k_{c}_end": f"e_{c}" for c in KINDS}), values=("n_end", *(f"e_{c}" for c in KINDS)))
    rows = rows.withColumnsRenamed({f"base_e_{c}": f"base_k_{c}" for c in KINDS})
    s = H.in_season_block(rows, list(KINDS), 100.0, "isp")
    return s.select("row_id", *(r6(c).alias(c) for c in ("isp_logn", "isp_share", *(f"isp_{k}_{x}" for k in KINDS for x in ("sm", "d")))))


@query(
    "dom1k_split_weight_grid",
    f"""WITH {BASED}, s AS (SELECT greatest(0, n - base_n) AS is_n, greatest(0, least(k - base_k, n - base_n)) AS is_k, y FROM based)
SELECT weight, round(avg(power(y - (is_k + weight / 2) / (is_n + weight), 2)), 6) AS brier FROM s, (VALUES (25.0::DOUBLE), (50.0), (100.0), (200.0)) g(weight) GROUP BY weight""",
)
def dom1k(spark, d):
    log = counted_log(spark, d)
    s = H.in_season_split(H.as_of_season(log, H.season_end(log)))
    error = lambda w: F.pow(F.col("y") - (F.col("is_k") + w / 2) / (F.col("is_n") + w), 2)
    grid = [25.0, 50.0, 100.0, 200.0]
    one = s.agg(*(F.avg(error(w)).alias(f"w{i}") for i, w in enumerate(grid)))
    pairs = F.explode(F.array(*(F.struct(F.lit(w).alias("weight"), r6(f"w{i}").alias("brier")) for i, w in enumerate(grid))))
    return one.select(pairs.alias("g")).select("g.*")


@query("agg5_season_increment", f"""WITH {ENDS}, p AS (SELECT *, coalesce(lag(n_end) OVER w, 0) AS pn, coalesce(lag(k_end) OVER w, 0) AS pk FROM ends WINDOW w AS (PARTITION BY entity ORDER BY season))
SELECT entity, season, CASE WHEN n_end < pn THEN n_end ELSE n_end - pn END AS dn,
  greatest(0, least(CASE WHEN n_end < pn THEN k_end ELSE k_end - pk END, CASE WHEN n_end < pn THEN n_end ELSE n_end - pn END)) AS dk FROM p""")
def agg5(spark, d):
    return H.season_increment(H.season_end(counted_log(spark, d)))


@query("win1_asof_rate", f"WITH {EV} SELECT row_id, round((coalesce(sum(y) OVER w, 0) + 50 * 0.2) / (count(*) OVER w + 50), 6) AS rate FROM ev WINDOW w AS (PARTITION BY entity ORDER BY row_id {PRE})")
def win1(spark, d):
    return H.as_of_rate(event_log(spark, d), "rate", "entity").select("row_id", r6("rate").alias("rate"))


@query("win2_asof_last_n", f"WITH {EV} SELECT row_id, round((coalesce(sum(y) OVER w, 0) + 5 * 0.2) / (count(*) OVER w + 5), 6) AS rate FROM ev WINDOW w AS (PARTITION BY entity ORDER BY row_id ROWS BETWEEN 10 PRECEDING AND 1 PRECEDING)")
def win2(spark, d):
    return H.as_of_rate(event_log(spark, d), "rate", "entity", k=5.0, rows=10).select("row_id", r6("rate").alias("rate"))


@query("win3_beta_state", f"""WITH {LOG} SELECT row_id, n AS past_n, k AS past_k,
  round((1.0 + k) * (4.0 + n - k) / (power(5.0 + n, 2) * (6.0 + n)), 6) AS beta_var FROM log""")
def win3(spark, d):
    return H.beta_state(event_log(spark, d), "entity").select("row_id", "past_n", "past_k", r6("beta_var").alias("beta_var"))


@query("win4_asof_by_group", f"WITH {EV} SELECT row_id, round((coalesce(sum(y) OVER w, 0) + 10 * 0.2) / (count(*) OVER w + 10), 6) AS rate FROM ev WINDOW w AS (PARTITION BY entity, partner ORDER BY row_id {PRE})")
def win4(spark, d):
    return H.as_of_rate(event_log(spark, d), "rate", ["entity", "partner"], k=10.0).select("row_id", r6("rate").alias("rate"))


@query("win5_masked_asof", f"""WITH {EV} SELECT row_id,
  round((coalesce(sum(y) FILTER (value > 50) OVER w, 0) + 20 * 0.2) / (count(*) FILTER (value > 50) OVER w + 20) - (coalesce(sum(y) FILTER (value <= 50) OVER w, 0) + 20 * 0.2) / (count(*) FILTER (value <= 50) OVER w + 20), 6) AS delta
  FROM ev WINDOW w AS (PARTITION BY entity ORDER BY row_id {PRE})""")
def win5(spark, d):
    e = H.as_of_rate(event_log(spark, d), "high", "entity", k=20.0, mask=F.col("value") > 50)
    e = H.as_of_rate(e, "low", "entity", k=20.0, mask=F.col("value") <= 50)
    return e.select("row_id", r6(F.col("high") - F.col("low")).alias("delta"))


@query("win6_asof_std", f"""WITH {EV}, m AS (SELECT median(value) AS med FROM ev)
SELECT row_id, round(CASE WHEN count(*) OVER w >= 3 THEN stddev_samp(value) OVER w ELSE med END, 4) AS sd FROM ev, m WINDOW w AS (PARTITION BY entity ORDER BY row_id ROWS BETWEEN 30 PRECEDING AND 1 PRECEDING)""")
def win6(spark, d):
    e, w = event_log(spark, d), H.before("entity", rows=30)
    med = F.lit(quantiles(e, "value", [0.5])[0])
    return e.select("row_id", F.round(F.when(F.count("*").over(w) >= 3, F.stddev_samp("value").over(w)).otherwise(med), 4).alias("sd"))


@query("win7_freeze_at_cutoff", f"WITH {EV} SELECT row_id, round((coalesce(sum(y) FILTER (season < 2) OVER w, 0) + 50 * 0.2) / (count(*) FILTER (season < 2) OVER w + 50), 6) AS frozen_rate FROM ev WINDOW w AS (PARTITION BY entity)")
def win7(spark, d):
    return H.freeze_at(event_log(spark, d), 2).select("row_id", r6("frozen_rate").alias("frozen_rate"))


@query("win8_within_season_segment", f"WITH {EV} SELECT row_id, count(*) OVER w AS n_past, CAST(coalesce(sum(y) OVER w, 0) AS BIGINT) AS k_past FROM ev WINDOW w AS (PARTITION BY entity, season, kind ORDER BY row_id {PRE})")
def win8(spark, d):
    w = H.before(["entity", "season", "kind"])
    return event_log(spark, d).select("row_id", F.count("*").over(w).alias("n_past"), F.coalesce(F.sum("y").over(w), F.lit(0)).alias("k_past"))


@query("win9_earlier_seasons", f"""WITH {LI}, c AS (SELECT entity, grp, season, count(*) AS n, sum(y) AS k FROM li GROUP BY ALL)
SELECT entity, grp, season, CAST(coalesce(sum(n) OVER w, 0) AS BIGINT) AS prior_n, CAST(coalesce(sum(k) OVER w, 0) AS BIGINT) AS prior_k FROM c WINDOW w AS (PARTITION BY entity, grp ORDER BY season {PRE})""")
def win9(spark, d):
    return H.earlier_seasons(line_log(spark, d), ["entity", "grp"]).select("entity", "grp", "season", "prior_n", "prior_k").distinct()


@query("win10_leave_one_out", f"WITH {EV} SELECT row_id, round((sum(y) OVER w - y + 20 * 0.2) / (count(*) OVER w - 1 + 20), 6) AS loo_rate FROM ev WINDOW w AS (PARTITION BY partner, kind)")
def win10(spark, d):
    return H.leave_one_out(event_log(spark, d), ["partner", "kind"]).select("row_id", r6("loo_rate").alias("loo_rate"))


SESSION = EV + """, f AS (SELECT *, CASE WHEN lag(row_id) OVER w IS NULL OR season <> lag(season) OVER w OR CAST(ts AS DATE) <> CAST(lag(ts) OVER w AS DATE) OR abs(value - lag(value) OVER w) > 60
  OR (value IS NOT NULL AND lag(value) OVER w IS NULL) OR partner < lag(partner) OVER w - 80 THEN 1 ELSE 0 END AS b FROM ev WINDOW w AS (PARTITION BY entity ORDER BY row_id)),
s AS (SELECT *, CAST(sum(b) OVER (PARTITION BY entity ORDER BY row_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS session FROM f)"""


def sessions_of(spark, d):
    e = event_log(spark, d).withColumn("day", F.col("ts").cast("date"))
    return S.sessions(e, changed=["season", "day"], jumps={"value": 60.0}, drops={"partner": 80.0})


@query("win11_sessions", f"WITH {SESSION} SELECT row_id, session FROM s")
def win11(spark, d):
    return sessions_of(spark, d).select("row_id", "session")


@query("win12_running_index", f"WITH {EV} SELECT row_id, row_number() OVER (PARTITION BY season, entity ORDER BY row_id) - 1 AS idx FROM ev")
def win12(spark, d):
    return event_log(spark, d).select("row_id", (F.row_number().over(Window.partitionBy("season", "entity").orderBy("row_id")) - 1).cast("long").alias("idx"))


@query("win13_lag_and_recent", f"WITH {EV} SELECT row_id, lag(y) OVER (PARTITION BY entity ORDER BY row_id) AS prev_y, round(avg(1 - y) OVER (PARTITION BY entity ORDER BY row_id ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING), 6) AS fail5 FROM ev")
def win13(spark, d):
    w = Window.partitionBy("entity").orderBy("row_id")
    return event_log(spark, d).select("row_id", F.lag("y").over(w).alias("prev_y"), r6(F.avg(1 - F.col("y")).over(H.before("entity", rows=5))).alias("fail5"))


@query("win14_experience", f"WITH {EV} SELECT row_id, season - min(season) OVER (PARTITION BY entity) AS experience, min(season) OVER (PARTITION BY entity) = (SELECT min(season) FROM ev) AS censored FROM ev")
def win14(spark, d):
    e = event_log(spark, d)
    first = F.min("season").over(Window.partitionBy("entity"))
    start = F.broadcast(e.agg(F.min("season").alias("start")))
    return e.crossJoin(start).select("row_id", (F.col("season") - first).alias("experience"), (first == F.col("start")).alias("censored"))


@query("win15_gap_to_other_kind", f"""WITH {EV}, m AS (SELECT *, CASE WHEN kind IS DISTINCT FROM lag(kind) OVER (PARTITION BY entity ORDER BY row_id) THEN row_id END AS opens FROM ev),
f AS (SELECT *, last_value(opens IGNORE NULLS) OVER (PARTITION BY entity ORDER BY row_id ROWS UNBOUNDED PRECEDING) AS run FROM m)
SELECT row_id, row_id - max(before_id) OVER (PARTITION BY entity, run) AS gap FROM (SELECT *, CASE WHEN opens IS NOT NULL THEN lag(row_id) OVER (PARTITION BY entity ORDER BY row_id) END AS before_id FROM f)""")
def win15(spark, d):
    return S.gap_to_previous_other(event_log(spark, d), "kind").select("row_id", "gap")


@query("win16_session_drift", f"""WITH {SESSION} SELECT row_id, round(avg(value) OVER (PARTITION BY entity, session ORDER BY row_id ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING) - avg(value) OVER (PARTITION BY entity, session ORDER BY row_id {PRE}) + 1e-9, 6) AS drift,
  round(avg(value) OVER (PARTITION BY entity, session ORDER BY row_id {PRE}) - avg(value) OVER (PARTITION BY entity ORDER BY row_id {PRE}) + 1e-9, 6) AS vs_career FROM s""")
def win16(spark, d):
    own, near, career = H.before(["entity", "session"]), H.before(["entity", "session"], rows=3), H.before("entity")
    v = lambda w: F.avg("value").over(w)
    # Means of few two-digit values fall on rounding edges; the small number moves them off.
    return sessions_of(spark, d).select("row_id", r6(v(near) - v(own) + 1e-9).alias("drift"), r6(v(own) - v(career) + 1e-9).alias("vs_career"))


@query("win17_dense_progress", f"WITH {EV} SELECT row_id, round(r / max(r) OVER (PARTITION BY season), 6) AS progress FROM (SELECT row_id, season, dense_rank() OVER (PARTITION BY season ORDER BY CAST(ts AS DATE)) AS r FROM ev)")
def win17(spark, d):
    # Days are few: they are ranked on their own, and rows join them.
    e = event_log(spark, d).withColumn("day", F.col("ts").cast("date"))
    days = e.select("season", "day").distinct()
    days = days.withColumn("r", F.row_number().over(Window.partitionBy("season").orderBy("day"))).withColumn("progress", r6(F.col("r") / F.max("r").over(Window.partitionBy("season"))))
    return e.join(days, ["season", "day"]).select("row_id", "progress")


@query("win18_average_rank", f"""WITH {LI}, v AS (SELECT entity, season, round(avg(quantity), 2) AS m FROM li GROUP BY ALL)
SELECT entity, season, round((rank() OVER (PARTITION BY season ORDER BY m) + (count(*) OVER (PARTITION BY season, m) - 1) / 2) / count(*) OVER (PARTITION BY season), 6) AS pct FROM v""")
def win18(spark, d):
    v = line_log(spark, d).groupBy("entity", "season").agg(F.round(F.avg("quantity"), 2).alias("m"))
    return S.average_rank(v, "m", ["season"]).select("entity", "season", r6("pct").alias("pct"))


@query("win19_anchored_rank", f"""WITH {LI}, v AS (SELECT entity, season, round(avg(quantity), 2) AS m FROM li GROUP BY ALL), ref AS (SELECT m FROM v WHERE season = 1996)
SELECT entity, season, round(((SELECT count(*) FROM ref WHERE ref.m < v.m) + (SELECT count(*) FROM ref WHERE ref.m <= v.m)) / (2 * (SELECT count(*) FROM ref)), 6) AS pct FROM v""")
def win19(spark, d):
    v = line_log(spark, d).groupBy("entity", "season").agg(F.round(F.avg("quantity"), 2).alias("m"))
    return S.anchored_rank(v, v.filter("season = 1996"), "m").select("entity", "season", r6("pct").alias("pct"))


@query("win20_event_recovery", f"WITH {LOG} SELECT row_id, CASE WHEN lead(n) OVER w - n = 1 THEN lead(k) OVER w - k END AS recovered FROM log WINDOW w AS (PARTITION BY entity ORDER BY row_id)")
def win20(spark, d):
    return H.recover_events(counted_log(spark, d)).select("row_id", "recovered")


@query("win21_session_bands", f"""WITH {SESSION}, c AS (SELECT entity, season, session, count(*) AS n, sum(y) AS k FROM s GROUP BY ALL),
l AS (SELECT *, lag(n, 1) OVER w AS n1, lag(k, 1) OVER w AS k1, lag(n, 2) OVER w + lag(n, 3) OVER w AS n23, lag(k, 2) OVER w + lag(k, 3) OVER w AS k23,
  lag(n, 4) OVER w + lag(n, 5) OVER w AS n45, lag(k, 4) OVER w + lag(k, 5) OVER w AS k45 FROM c WINDOW w AS (PARTITION BY entity, season ORDER BY session))
SELECT entity, season, session, round(ln(1 + n1), 6) AS log1, round(ln(1 + n23), 6) AS log23, round(ln(1 + n45), 6) AS log45, round((k1 + 10.0) / (n1 + 20.0), 6) AS band1, round((k23 + 20.0) / (n23 + 40.0), 6) AS band23,
  round((k45 + 20.0) / (n45 + 40.0), 6) AS band45, round((k1 + 10.0) / (n1 + 20.0) - (k45 + 20.0) / (n45 + 40.0), 6) + 0.0 AS trend, round(n1 - (n1 + n23 + n45) / 5.0, 6) + 0.0 AS workload FROM l""")
def win21(spark, d):
    c = sessions_of(spark, d).groupBy("entity", "season", "session").agg(F.count("*").alias("n"), F.sum("y").alias("k"))
    b = S.bands(c)
    return b.select("entity", "season", "session", *(r6(c).alias(c) for c in ("log1", "log23", "log45", "band1", "band23", "band45")), *((r6(c) + F.lit(0.0)).alias(c) for c in ("trend", "workload")))


#: Seasons of five rows or more count for the volatility here, since the event log's are short; the operator's default is 50.
@query("win22_completed_seasons", f"""WITH {ENDS}, i AS (SELECT *, lag(n_end) OVER w AS pn, lag(k_end) OVER w AS pk FROM ends WINDOW w AS (PARTITION BY entity ORDER BY season)),
r AS (SELECT *, CASE WHEN n_end - pn >= 1 THEN n_end - pn END AS dn, k_end - pk AS dk, CASE WHEN n_end - pn >= 5 THEN (k_end - pk) / (n_end - pn) END AS own FROM i),
t AS (SELECT *, (dk + 100.0) / (dn + 200.0) AS sm FROM r),
s AS (SELECT entity, season, max(season) OVER w AS last_season, sm, dn, own, lag(sm) OVER w AS sm0 FROM t WINDOW w AS (PARTITION BY entity ORDER BY season)),
lg AS (SELECT l.row_id, l.entity, l.season, l.n, l.k, e.sm, e.dn, e.sm - e.sm0 AS trend, (SELECT CASE WHEN count(own) >= 2 THEN stddev_samp(own) END FROM s x WHERE x.entity = l.entity AND x.season < l.season) AS vol
  FROM log l ASOF LEFT JOIN s e ON l.entity = e.entity AND l.season > e.season)
SELECT row_id, round(ln(1 + dn), 6) AS ps_logn, round(sm, 6) AS ps_sm, round(sm - (k + 250.0) / (n + 500.0), 6) + 0.0 AS ps_delta, round(trend, 6) + 0.0 AS ps_trend, round(vol, 6) AS ps_vol FROM lg""")
def win22(spark, d):
    log = counted_log(spark, d)
    c = H.completed_seasons(H.season_end(log), least=5)
    out = H.latest_before(log, c, ["ps_logn", "ps_sm", "ps_trend", "ps_vol"])
    out = out.withColumn("ps_delta", F.col("ps_sm") - (F.col("k") + 250.0) / (F.col("n") + 500.0))
    return out.select("row_id", *((r6(c) + F.lit(0.0)).alias(c) for c in ("ps_logn", "ps_sm", "ps_delta", "ps_trend", "ps_vol")))


@query("win23_prefix_profile", f"""WITH {LI}, c AS (SELECT entity, grp, season, count(*) AS n, sum(quantity) AS s FROM li GROUP BY ALL),
g AS (SELECT entity, grp, season FROM (SELECT DISTINCT entity, grp FROM c), (SELECT DISTINCT season FROM c UNION SELECT max(season) + 1 FROM c))
SELECT g.entity, g.grp, g.season, CAST(coalesce(sum(n) OVER w, 0) AS BIGINT) AS n, round(coalesce(sum(s) OVER w, 0), 4) AS s FROM g LEFT JOIN c USING (entity, grp, season) WINDOW w AS (PARTITION BY g.entity, g.grp ORDER BY g.season {PRE})""")
def win23(spark, d):
    c = line_log(spark, d).groupBy("entity", "grp", "season").agg(F.count("*").alias("n"), F.sum("quantity").alias("s"))
    return S.prefix_profile(c, ["entity", "grp"], ["n", "s"], ahead=1).select("entity", "grp", "season", "n", F.round("s", 4).alias("s"))


@query("win24_z_in_group", f"WITH {EV} SELECT row_id, round((value - avg(value) OVER w) / stddev_samp(value) OVER w, 6) AS z FROM ev WINDOW w AS (PARTITION BY season, kind)")
def win24(spark, d):
    return S.z_in_group(event_log(spark, d), "value", ["season", "kind"]).select("row_id", r6("z").alias("z"))


@query("win25_sequence", f"""WITH {EV}, q AS (SELECT row_id, list(partner) OVER (PARTITION BY entity ORDER BY row_id ROWS BETWEEN 4 PRECEDING AND 1 PRECEDING) AS l FROM ev)
SELECT row_id, array_to_string(list_concat([0 FOR i IN range(4 - coalesce(len(l), 0))], coalesce(l, [])), ',') AS seq FROM q""")
def win25(spark, d):
    return S.last_k(event_log(spark, d), ["partner"], 4, {"partner": 0}).select("row_id", F.array_join(F.transform("seq", lambda s: s["partner"].cast("string")), ",").alias("seq"))


@query("win26_clock_audit", f"WITH {LOG} SELECT count(*) AS steps, round(avg(CASE WHEN d <> 1 THEN 1 ELSE 0 END), 6) AS bad_share FROM (SELECT n - lag(n) OVER (PARTITION BY entity ORDER BY row_id) AS d FROM log) WHERE d IS NOT NULL")
def win26(spark, d):
    return H.clock_audit(counted_log(spark, d))


@query("win27_double_centring", f"WITH {EV} SELECT row_id, round(value - avg(value) OVER (PARTITION BY entity) - avg(value) OVER (PARTITION BY kind) + (SELECT avg(value) FROM ev), 4) AS centred FROM ev")
def win27(spark, d):
    return S.double_centred(event_log(spark, d), "value", "entity", "kind").select("row_id", F.round("centred", 4).alias("centred"))


@query("dom11_window_audit", f"""WITH {SESSION}, m AS (SELECT entity, session, min(season) AS season, min(CAST(ts AS DATE)) AS day, count(*) AS n, avg(y) AS rate FROM s GROUP BY ALL),
d AS (SELECT entity, CAST(ts AS DATE) AS day, round(avg(y), 6) AS rate, round(avg((kind = 'click')::INT), 6) AS other FROM ev GROUP BY ALL), p AS (SELECT entity, day, lag(rate) OVER w AS rate, lag(other) OVER w AS other FROM d WINDOW w AS (PARTITION BY entity ORDER BY day)),
x AS (SELECT entity, n, rate AS own, lead(session) OVER w AS session, lead(season) OVER w = season AS same, lead(day) OVER w AS day FROM m WINDOW w AS (PARTITION BY entity ORDER BY session)),
j AS (SELECT x.n, own, p.rate, p.other, list_filter(range(1, 161), lambda c: abs(p.rate * c - round_even(p.rate * c, 0)) <= 5e-6 * c AND abs(p.other * c - round_even(p.other * c, 0)) <= 5e-6 * c)[1] AS hat FROM x JOIN p USING (entity, day) WHERE same AND p.rate IS NOT NULL)
SELECT count(*) AS compared, count(*) FILTER (abs(rate - own) < 1e-5) AS agree, count(other) AS recovered_from, count(*) FILTER (hat = n) AS exact, count(*) FILTER (n % hat = 0) AS divisor, count(*) FILTER (other IS NOT NULL AND hat IS NULL) AS unknown FROM j""")
def dom11(spark, d):
    """Sessions state the rates of the day before; they are held against the session before, whose rows are counted from the two rates."""
    s = sessions_of(spark, d).withColumn("day", F.to_date("ts"))
    m = s.groupBy("entity", "session").agg(F.min("season").alias("season"), F.min("day").alias("day"), F.count("*").alias("n"), F.avg("y").alias("rate"))
    days = s.groupBy("entity", "day").agg(r6(F.avg("y")).alias("r"), r6(F.avg((F.col("kind") == "click").cast("int"))).alias("o"))
    w = Window.partitionBy("entity").orderBy("day")
    before = days.select("entity", "day", F.lag("r").over(w).alias("rate"), F.lag("o").over(w).alias("other"))
    stated = m.select("entity", "session", "day").join(before, ["entity", "day"]).drop("day")
    return S.window_audit(m.drop("day"), stated)
