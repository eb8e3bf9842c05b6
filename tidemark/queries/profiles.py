"""Queries of measurement profiles."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import aggregates as A
from ..operators import profiles as P
from ..sources.tables import event_log, line_log
from .registry import EV, LI, query, r6

CELLS = LI + ", c AS (SELECT entity, season, grp, count(*) AS n, sum(quantity) AS s, sum(quantity * quantity) AS q FROM li GROUP BY ALL)"


#: z of three measures within (season, group), and their cells.
Z = LI + """, z AS (SELECT *, """ + ", ".join(f"(CAST({c} AS DOUBLE) - avg({c}) OVER w) / nullif(stddev_samp({c}) OVER w, 0) AS z_{c}" for c in ("quantity", "price", "discount")) + """ FROM li WINDOW w AS (PARTITION BY season, grp)),
zc AS (SELECT entity, season, grp, """ + ", ".join(f"count(z_{c}) AS n_{c}, sum(z_{c}) AS s_{c}, CASE WHEN count(z_{c}) >= 2 THEN sum(z_{c} * z_{c}) - sum(z_{c}) * sum(z_{c}) / count(z_{c}) ELSE 0 END AS ss_{c}, CASE WHEN count(z_{c}) >= 2 THEN count(z_{c}) - 1 ELSE 0 END AS df_{c}" for c in ("quantity", "price", "discount")) + """, count(*) AS rows, sum(y) AS flagged FROM z GROUP BY ALL),
seasons AS (SELECT DISTINCT season FROM li UNION SELECT max(season) + 1 FROM li)"""


def _cells(spark, d):
    return P.measured_cells(line_log(spark, d), "entity", "season", "grp", ["quantity", "price", "discount"], "y")


@query("ph1_career_prefix", f"""WITH {Z}, p AS (SELECT e.entity, q.season, sum(ss_quantity) AS ss, sum(df_quantity) AS df, sum(ss_price + ss_discount) AS ms, sum(df_price + df_discount) AS md, sum(n_quantity) FILTER (grp = 'F') AS vn, sum(s_quantity) FILTER (grp = 'F') AS vs,
  sum(n_price) FILTER (grp = 'F') AS pn, sum(s_price) FILTER (grp = 'F') AS ps, sum(n_quantity) FILTER (grp = 'O') AS o_n, sum(s_quantity) FILTER (grp = 'O') AS o_s, sum(n_quantity) AS tn, sum(rows) AS rn, sum(flagged) AS rf
  FROM (SELECT DISTINCT entity FROM li) e CROSS JOIN seasons q LEFT JOIN zc ON zc.entity = e.entity AND zc.season < q.season GROUP BY ALL)
SELECT entity, season, """ + ", ".join(f"round(CASE WHEN tn >= 100 THEN {v} END, 6) AS {k}" for k, v in {
    "sd_speed": "sqrt(greatest(0.0, ss / nullif(df, 0)))", "sd_move": "sqrt(greatest(0.0, ms / nullif(md, 0)))", "speed_main": "CASE WHEN vn >= 30 THEN vs / vn END", "spin_main": "CASE WHEN pn >= 30 THEN ps / pn END",
    "separation": "CASE WHEN vn >= 30 THEN vs / vn END - CASE WHEN o_n >= 30 THEN o_s / o_n END", "share": "rf / nullif(rn, 0)"}.items()) + " FROM p")
def ph1(spark, d):
    p = P.career_prefix(_cells(spark, d), "entity", "season", "grp", "F", "O", "quantity", "price", ["price", "discount"], ahead=1)
    return p.select("entity", "season", *(r6(c).alias(c) for c in p.columns[2:]))


@query("ph2_season_profile", f"""WITH {CELLS}, p AS (SELECT entity, season, sum(n) AS n, sum((q - s * s / n)) FILTER (n >= 2) / sum(n - 1) FILTER (n >= 2) AS v, sum(s) FILTER (grp = 'F') / sum(n) FILTER (grp = 'F') AS m, sum(n) FILTER (grp = 'F') AS nf, coalesce(sum(n) FILTER (grp = 'O'), 0) / sum(n) AS o FROM c GROUP BY ALL),
r AS (SELECT entity, season, sqrt(v) AS sd, CASE WHEN nf >= 20 THEN m END AS level, o AS share FROM p WHERE n >= 40)
SELECT entity, season, round(sd, 6) AS sd, round(level, 6) AS level, round(share, 6) AS share, """ + ", ".join(f"round(CASE WHEN {c} IS NOT NULL THEN (rank() OVER (PARTITION BY season ORDER BY {c} NULLS LAST) + (count(*) OVER (PARTITION BY season, {c}) - 1) / 2) / count({c}) OVER (PARTITION BY season) END, 6) AS rank_{c}" for c in ("sd", "level", "share")) + " FROM r")
def ph2(spark, d):
    """Raw season profiles and their ranks within the season."""
    cells = A.cell_moments(line_log(spark, d), ["entity", "season", "grp"], "quantity")
    p = P.season_profile(cells, "entity", "season", "grp", "F", "O", least=40, least_level=20)
    return p.select("entity", "season", *(r6(c).alias(c) for c in ("sd", "level", "share", "rank_sd", "rank_level", "rank_share")))


@query("ph3_group_mix", f"""WITH {LI}, v AS (SELECT entity, grp, avg(quantity) AS v FROM li WHERE season = 1996 GROUP BY ALL), m AS (SELECT entity, season, avg((grp = 'F')::INT) AS mf, avg((grp = 'O')::INT) AS mo FROM li GROUP BY ALL),
w AS (SELECT entity, max(v) FILTER (grp = 'F') AS vf, max(v) FILTER (grp = 'O') AS vo FROM v GROUP BY entity)
SELECT entity, season, round((mf * coalesce(vf, 0) + mo * coalesce(vo, 0)) / nullif(CASE WHEN vf IS NULL THEN 0 ELSE mf END + CASE WHEN vo IS NULL THEN 0 ELSE mo END, 0), 6) AS mixed FROM m LEFT JOIN w USING (entity)""")
def ph3(spark, d):
    li = line_log(spark, d)
    profile = li.filter("season = 1996").groupBy("entity", "grp").agg(F.avg("quantity").alias("value"))
    mix = A.shares(li, ["entity", "season"], "grp", ["F", "O"])
    return P.group_mix(mix, profile, "entity", {"F": "share_F", "O": "share_O"}).select("entity", "season", r6("mixed").alias("mixed"))


@query("ph4_conditional_delta", f"""WITH {Z}, c AS (SELECT entity, season, grp, month, count(z_quantity) AS n, coalesce(sum(z_quantity), 0) AS s FROM z GROUP BY ALL),
k AS (SELECT entity, grp, month, q.season, sum(n) AS n, sum(s) AS s FROM seasons q JOIN c ON c.season < q.season GROUP BY ALL HAVING sum(n) > 0), b AS (SELECT entity, grp, q.season, sum(n) AS bn, sum(s) AS bs FROM seasons q JOIN c ON c.season < q.season GROUP BY ALL)
SELECT entity, season, grp, month, CAST(n AS BIGINT) AS n, round(CASE WHEN bn >= 30 THEN (s / n - bs / bn) * n / (n + 30.0) ELSE 0 END, 6) + 0.0 AS delta FROM k JOIN b USING (entity, grp, season)""")
def ph4(spark, d):
    return P.conditional_delta(line_log(spark, d), "entity", "season", "grp", "month", "quantity", ahead=1).select("entity", "season", "grp", "month", "n", (r6("delta") + F.lit(0.0)).alias("delta"))


@query("ph5_posterior_tilt", f"""WITH {EV}, w AS (SELECT DISTINCT season FROM ev UNION SELECT max(season) + 1 FROM ev), c AS (SELECT entity, q.season, partner % 4 AS cond, kind, count(*) AS n FROM w q JOIN ev ON ev.season < q.season GROUP BY ALL),
o AS (SELECT entity, season, kind, sum(n) AS own, sum(sum(n)) OVER (PARTITION BY entity, season) AS total FROM c GROUP BY entity, season, kind), m AS (SELECT entity, season, cond, sum(n) AS m FROM c GROUP BY ALL)
SELECT entity, season, cond, kind, round((coalesce(n, 0) + 30 * own / total) / (m + 30) / (own / total) + 1e-9, 6) AS tilt FROM o JOIN m USING (entity, season) LEFT JOIN c USING (entity, season, cond, kind) WHERE total >= 30""")
def ph5(spark, d):
    e = event_log(spark, d).withColumn("cond", F.col("partner") % 4)
    t = P.posterior_tilt(e, "entity", "season", "cond", "kind", ahead=1)
    return t.select("entity", "season", "cond", "kind", r6(F.col("tilt") + 1e-9).alias("tilt"))


@query("ph5b_prefix_dispersion", f"""WITH {Z} SELECT entity, q.season, grp, round(sqrt(greatest(0.0, sum(ss_quantity) / sum(df_quantity))), 6) AS sd_speed, round(sqrt(greatest(0.0, sum(ss_price + ss_discount) / nullif(sum(df_price + df_discount), 0))), 6) AS sd_move
FROM seasons q JOIN zc ON zc.season < q.season GROUP BY ALL HAVING sum(df_quantity) >= 29""")
def ph5b(spark, d):
    p = P.prefix_dispersion(_cells(spark, d), "entity", "season", "grp", "quantity", ["price", "discount"], ahead=1)
    return p.select("entity", "season", "grp", r6("sd_speed").alias("sd_speed"), r6("sd_move").alias("sd_move"))


@query("ph6_snapshot", f"""WITH {LI}, l AS (SELECT entity, season, avg(quantity) AS q, avg(y) AS r FROM li WHERE season < 2000 GROUP BY ALL), x AS (SELECT *, q - lag(q) OVER w AS d_q, r - lag(r) OVER w AS d_r, row_number() OVER (PARTITION BY entity ORDER BY season DESC) AS i FROM l WINDOW w AS (PARTITION BY entity ORDER BY season))
SELECT entity, CAST(2000 - season AS INTEGER) AS age, round(q, 6) AS q, round(r, 6) AS r, round(d_q, 6) AS d_q, round(d_r, 6) AS d_r FROM x WHERE i = 1""")
def ph6(spark, d):
    levels = line_log(spark, d).groupBy("entity", "season").agg(F.avg("quantity").alias("q"), F.avg("y").alias("r"))
    s = P.snapshot(levels, "entity", "season", ["q", "r"], 2000)
    return s.select("entity", "age", *(r6(c).alias(c) for c in ("q", "r", "d_q", "d_r")))
