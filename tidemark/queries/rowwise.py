"""Queries of projections, filters, sorts, sets and scalar functions."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import scalars as X
from ..operators import rowwise as R
from ..sources.tables import counted_log, event_log, line_log, table
from .registry import EV, LI, LOG, query, r6

#: Category numbers of the fixtures.
KINDS = {"click": 0, "view": 1, "purchase": 2}


def _state(log):
    return log.withColumns({"good": (F.pmod("partner", F.lit(3))).cast("int"), "bad": (F.pmod("row_id", F.lit(4))).cast("int")})


@query("prj1_category_map", f"WITH {EV} SELECT row_id, CAST(CASE kind WHEN 'click' THEN 0 WHEN 'view' THEN 1 WHEN 'purchase' THEN 2 ELSE -1 END AS INTEGER) AS code FROM ev")
def prj1(spark, d):
    return event_log(spark, d).select("row_id", X.category_code(F.col("kind"), KINDS).alias("code"))


@query("prj2_count_structure", f"""WITH {EV}, c AS (SELECT row_id, CAST(partner % 3 AS INTEGER) AS s, CAST(row_id % 4 AS INTEGER) AS b FROM ev)
SELECT row_id, b * 3 + s AS cell, s - b AS diff, (s > b)::INT AS ahead, (b > s)::INT AS behind, (s = 2)::INT AS two_good, (b = 3)::INT AS three_bad, (b = 3 AND s = 2)::INT AS "full", (b = 0 AND s = 0)::INT AS "first",
  CASE WHEN s > b THEN 0 WHEN s = b THEN 1 ELSE 2 END AS state FROM c""")
def prj2(spark, d):
    c = R.count_structure(_state(event_log(spark, d)), "good", "bad")
    return c.select("row_id", "cell", "diff", "ahead", "behind", "two_good", "three_bad", "full", "first", "state")


@query("prj3_situation", f"WITH {EV} SELECT row_id, (entity % 2 = partner % 2)::INT AS same_side, round(ln(1 + value), 6) AS log_value, (value > 75)::INT AS high, round(abs(value - 50), 6) AS off_middle, (abs(value - 50) <= 10)::INT AS close, (hour(ts) >= 18)::INT AS late FROM ev")
def prj3(spark, d):
    v = F.col("value")
    return event_log(spark, d).select("row_id", X.flag(F.col("entity") % 2 == F.col("partner") % 2).alias("same_side"), r6(F.log1p(v)).alias("log_value"), X.flag(v > 75).alias("high"), r6(F.abs(v - 50)).alias("off_middle"), X.flag(F.abs(v - 50) <= 10).alias("close"), X.flag(F.hour("ts") >= 18).alias("late"))


@query("prj4_history_recombination", f"WITH {LOG} SELECT row_id, round(ln(1 + n), 6) AS log_n, (n < 20)::INT AS cold, (n < 5)::INT AS rookie, round((n - k + 0.001) / (n + 0.002), 6) AS fail_share FROM log")
def prj4(spark, d):
    n, k = F.col("n"), F.col("k")
    return counted_log(spark, d).select("row_id", r6(F.log1p(n)).alias("log_n"), X.flag(n < 20).alias("cold"), X.flag(n < 5).alias("rookie"), r6((n - k + 1e-3) / (n + 2e-3)).alias("fail_share"))


FORM = LOG + """, form AS (SELECT *, avg(y) OVER (PARTITION BY entity ORDER BY row_id ROWS BETWEEN 1 PRECEDING AND 1 PRECEDING) AS f1, avg(y) OVER (PARTITION BY entity ORDER BY row_id ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING) AS f3,
  avg(y) OVER (PARTITION BY entity ORDER BY row_id ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING) AS f5, CASE WHEN n > 0 THEN k / n END AS career FROM log)"""


def _form(spark, d):
    w = Window.partitionBy("entity").orderBy("row_id")
    log = counted_log(spark, d)
    return log.withColumns({f"f{i}": F.avg("y").over(w.rowsBetween(-i, -1)) for i in (1, 3, 5)} | {"career": F.when(F.col("n") > 0, F.col("k") / F.col("n"))})


@query("prj5_form_deltas", f"WITH {FORM} SELECT row_id, round(f1 - career, 6) AS d1, round(f3 - career, 6) AS d3, round(f5 - career, 6) AS d5, round(f1 - f5, 6) AS trend FROM form")
def prj5(spark, d):
    return _form(spark, d).select("row_id", *(r6(F.col(f"f{i}") - F.col("career")).alias(f"d{i}") for i in (1, 3, 5)), r6(F.col("f1") - F.col("f5")).alias("trend"))


@query("prj6_mix_entropy", f"""WITH {LI}, s AS (SELECT entity, season, avg(CASE WHEN discount < 0.03 THEN 1 ELSE 0 END) AS a, avg(CASE WHEN discount >= 0.03 AND discount < 0.07 THEN 1 ELSE 0 END) AS b, avg(CASE WHEN discount >= 0.07 THEN 1 ELSE 0 END) AS c FROM li GROUP BY ALL)
SELECT entity, season, round(-(a * ln(a + 1e-9) + b * ln(b + 1e-9) + c * ln(c + 1e-9)), 6) AS mix_entropy, round(greatest(a, b, c), 6) AS mix_max FROM s""")
def prj6(spark, d):
    x = F.col("discount")
    bands = {"a": x < 0.03, "b": (x >= 0.03) & (x < 0.07), "c": x >= 0.07}
    s = line_log(spark, d).groupBy("entity", "season").agg(*(F.avg(c.cast("int")).alias(n) for n, c in bands.items()))
    return R.mix_shape(s, list(bands)).select("entity", "season", r6("mix_entropy").alias("mix_entropy"), r6("mix_max").alias("mix_max"))


@query("prj8_credibility_chain", f"WITH {FORM} SELECT row_id, (season >= 2)::INT AS era, round((coalesce(career, 0.5) * n + 0.5 * 500) / (n + 500), 6) AS p_sm, round(coalesce(f5, career, 0.5), 6) AS level FROM form")
def prj8(spark, d):
    n = F.col("n")
    return _form(spark, d).select("row_id", X.flag(F.col("season") >= 2).alias("era"), r6(R.credibility(F.coalesce("career", F.lit(0.5)), n)).alias("p_sm"), r6(F.coalesce("f5", "career", F.lit(0.5))).alias("level"))


@query("prj14_product_basis", f"WITH {EV}, c AS (SELECT row_id, value, CAST(partner % 3 AS INTEGER) AS s FROM ev) SELECT row_id, " + ", ".join(f"CASE WHEN s = {i} THEN 1 ELSE 0 END AS g_{i}, round(CASE WHEN s = {i} THEN value - 50 ELSE 0 END, 6) AS x_{i}" for i in range(3)) + " FROM c")
def prj14(spark, d):
    s = _state(event_log(spark, d))
    hot = R.one_hot(F.col("good"), [0, 1, 2], "g")
    return s.select("row_id", *(c.alias(n) for n, c in hot.items()), *(r6(F.when(F.col("good") == i, F.col("value") - 50).otherwise(0.0)).alias(f"x_{i}") for i in range(3)))


@query("prj20_standardise", f"""WITH {LOG}, f AS (SELECT *, CASE WHEN n >= 5 THEN value END AS v FROM log), m AS (SELECT median(v) AS med FROM f WHERE season < 3), t AS (SELECT avg(coalesce(v, med)) AS mu, stddev_pop(coalesce(v, med)) AS sd FROM f, m WHERE season < 3)
SELECT row_id, round((coalesce(v, med) - mu) / sd, 6) AS z_v, (v IS NULL)::INT AS miss_v FROM f, m, t""")
def prj20(spark, d):
    f = counted_log(spark, d).withColumn("v", F.when(F.col("n") >= 5, F.col("value")))
    return R.standardise(f, R.fit_standard(f.filter("season < 3"), ["v"])).select("row_id", r6("z_v").alias("z_v"), "miss_v")


@query("prj21_piecewise_linear", f"""WITH {EV}, q AS (SELECT quantile_cont(value, [0, 0.25, 0.5, 0.75, 1.0]) AS e FROM ev WHERE season < 3)
SELECT row_id, """ + ", ".join(f"round(greatest(0.0, least(1.0, (value - e[{i}]) / (e[{i + 1}] - e[{i}]))), 6) AS b{i}" for i in range(1, 5)) + " FROM ev, q")
def prj21(spark, d):
    e = event_log(spark, d)
    edges = R.fit_edges(e.filter("season < 3"), "value", 4)
    return R.encode_piecewise(e, "value", edges, "enc").select("row_id", *(r6(F.get("enc", F.lit(i))).alias(f"b{i + 1}") for i in range(4)))


@query("prj22_bit_flags", f"WITH {EV} SELECT row_id, CAST(partner & 1 AS BIGINT) AS on_first, ((partner & 1) > 0 AND (partner & 6) = 0)::INT AS steal, season * CAST(partner & 3 AS BIGINT) AS era_cross FROM ev")
def prj22(spark, d):
    p = F.col("partner")
    return event_log(spark, d).select("row_id", p.bitwiseAND(F.lit(1)).alias("on_first"), X.flag((p.bitwiseAND(F.lit(1)) > 0) & (p.bitwiseAND(F.lit(6)) == 0)).alias("steal"), (F.col("season") * p.bitwiseAND(F.lit(3))).alias("era_cross"))


@query("prj23_hashed_prior", f"WITH {EV} SELECT DISTINCT entity, round((entity * 2654435761 % 4294967296) / 4294967296.0::DOUBLE, 6) AS u, round(1 / (1 + exp(-(2.0 * (entity * 2654435761 % 4294967296) / 4294967296.0::DOUBLE - 1))), 6) AS skill FROM ev")
def prj23(spark, d):
    u = X.hashed_unit(F.col("entity"))
    return event_log(spark, d).select("entity").distinct().select("entity", r6(u).alias("u"), r6(X.sigmoid(2 * u - 1)).alias("skill"))


@query("flt1_season_folds", f"WITH {EV} SELECT row_id FROM ev WHERE season IN (1, 3) AND season <> 2 AND season <= 3")
def flt1(spark, d):
    return event_log(spark, d).filter(F.col("season").isin(1, 3) & (F.col("season") != 2) & (F.col("season") <= 3)).select("row_id")


@query("flt2_channel", "SELECT o_orderkey, CASE WHEN o_orderpriority LIKE '1-%' OR o_orderpriority IN ('2-HIGH') THEN 'F' ELSE 'R' END AS channel FROM orders WHERE o_orderstatus <> 'P'")
def flt2(spark, d):
    p = F.col("o_orderpriority")
    channel = F.when(F.col("o_orderstatus") == "P", None).when(p.startswith("1-") | p.isin("2-HIGH"), "F").otherwise("R")
    return table(spark, d, "orders").select("o_orderkey", channel.alias("channel")).filter("channel IS NOT NULL")


@query("flt4_min_support", f"WITH {LI} SELECT entity, season, CASE WHEN count(*) >= 90 THEN round(avg(quantity), 4) END AS level FROM li GROUP BY ALL")
def flt4(spark, d):
    return line_log(spark, d).groupBy("entity", "season").agg(F.when(F.count("*") >= 90, F.round(F.avg("quantity"), 4)).alias("level"))


@query("flt6_head_of_season", f"WITH {EV} SELECT row_id, value FROM ev WHERE season = 2 ORDER BY row_id LIMIT 100")
def flt6(spark, d):
    return event_log(spark, d).filter("season = 2").orderBy("row_id").limit(100).select("row_id", "value")


@query("flt7_stratified_sample")
def flt7(spark, d):
    return R.stratified_sample(event_log(spark, d), ["season"], 50).select("row_id", "season")


@query("flt8_segment_terms", f"WITH {EV} SELECT row_id, round(CASE WHEN kind IN ('click', 'view') THEN 0.1 ELSE 0 END + CASE WHEN kind = 'purchase' AND season = 2 THEN 0.2 ELSE 0 END + CASE WHEN value >= 80 THEN 0.05 ELSE 0 END, 6)::DOUBLE AS offset_ FROM ev")
def flt8(spark, d):
    terms = [(F.col("kind").isin("click", "view"), 0.1), ((F.col("kind") == "purchase") & (F.col("season") == 2), 0.2), (F.col("value") >= 80, 0.05)]
    return event_log(spark, d).select("row_id", r6(sum((F.when(c, v).otherwise(0.0) for c, v in terms), F.lit(0.0))).alias("offset_"))


@query("srt2_last_per_group", f"WITH {EV} SELECT row_id, entity, season FROM (SELECT *, row_number() OVER (PARTITION BY entity, season ORDER BY row_id DESC) AS r FROM ev) WHERE r = 1")
def srt2(spark, d):
    return event_log(spark, d).groupBy("entity", "season").agg(F.max("row_id").alias("row_id")).select("row_id", "entity", "season")


@query("srt3_first_k_and_forced", f"WITH {LI}, c AS (SELECT entity, partner, sum(price) AS cost FROM li GROUP BY ALL) SELECT entity, partner FROM (SELECT *, row_number() OVER (PARTITION BY entity ORDER BY cost, partner) AS r FROM c) WHERE r <= 5 OR partner = entity")
def srt3(spark, d):
    c = line_log(spark, d).groupBy("entity", "partner").agg(F.sum("price").alias("cost"))
    r = F.row_number().over(Window.partitionBy("entity").orderBy("cost", "partner"))
    return c.withColumn("r", r).filter("r <= 5 OR partner = entity").select("entity", "partner")


@query("srt4_leaderboard", f"WITH {LI} SELECT entity, round(avg(y), 6) AS score FROM li WHERE grp = 'F' GROUP BY entity ORDER BY score DESC, entity LIMIT 10")
def srt4(spark, d):
    return line_log(spark, d).filter("grp = 'F'").groupBy("entity").agg(r6(F.avg("y")).alias("score")).orderBy(F.desc("score"), "entity").limit(10)


@query("set1_union_blocks", f"WITH {EV} SELECT row_id, 'a' AS block FROM ev WHERE season = 0 UNION ALL SELECT row_id, 'b' FROM ev WHERE season >= 3")
def set1(spark, d):
    e = event_log(spark, d)
    return e.filter("season = 0").select("row_id", F.lit("a").alias("block")).unionByName(e.filter("season >= 3").select(F.lit("b").alias("block"), "row_id"))


@query("set2_horizontal_concat", f"WITH {LOG} SELECT row_id, n, kind FROM log")
def set2(spark, d):
    return counted_log(spark, d).select("row_id", "n").join(event_log(spark, d).select("row_id", "kind"), "row_id")


@query("set3_season_intersection", f"WITH {EV} SELECT season FROM ev WHERE kind = 'click' INTERSECT SELECT season FROM ev WHERE kind = 'purchase'")
def set3(spark, d):
    e = event_log(spark, d)
    return e.filter("kind = 'click'").select("season").intersect(e.filter("kind = 'purchase'").select("season"))


@query("set4_key_difference", f"WITH {LI} SELECT DISTINCT partner FROM li WHERE season = 1997 AND partner NOT IN (SELECT partner FROM li WHERE season = 1996)")
def set4(spark, d):
    li = line_log(spark, d)
    return li.filter("season = 1997").select("partner").distinct().join(li.filter("season = 1996").select("partner"), "partner", "left_anti")


@query("set5_dedupe_first", "SELECT l_orderkey, l_linenumber, l_partkey FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_partkey, l_suppkey, l_quantity, l_extendedprice) AS r FROM lineitem) WHERE r = 1")
def set5(spark, d):
    w = Window.partitionBy("l_orderkey", "l_linenumber").orderBy("l_partkey", "l_suppkey", "l_quantity", "l_extendedprice")
    return table(spark, d, "lineitem").withColumn("r", F.row_number().over(w)).filter("r = 1").select("l_orderkey", "l_linenumber", "l_partkey")


@query("fn_string", "SELECT c_custkey, upper(substr(c_name, 1, 1)) AS initial, regexp_extract(c_name, '([0-9]+)', 1) AS digits, regexp_replace(c_name, '[0-9]', 'x', 'g') AS masked, concat_ws('|', c_mktsegment, CAST(c_nationkey AS VARCHAR)) AS key, split_part(c_name, '#', -1) AS last, starts_with(c_mktsegment, 'B') AS b FROM customer")
def fn_string(spark, d):
    n = F.col("c_name")
    return table(spark, d, "customer").select("c_custkey", F.upper(n.substr(1, 1)).alias("initial"), F.regexp_extract(n, "([0-9]+)", 1).alias("digits"), F.regexp_replace(n, "[0-9]", "x").alias("masked"), F.concat_ws("|", "c_mktsegment", F.col("c_nationkey").cast("string")).alias("key"), F.element_at(F.split(n, "#"), -1).alias("last"), F.col("c_mktsegment").startswith("B").alias("b"))


@query("fn_math", f"WITH {EV} SELECT row_id, round(ln(1 + value), 6) AS l, round(exp(-value / 100), 6) AS e, round(sqrt(value), 6) AS s, round(tanh(value / 50 - 1), 6) AS t, round_even(value, 0) AS r, greatest(10.0, least(90.0, value)) AS c, round(ln((value + 1) / 102 / (1 - (value + 1) / 102)), 6) AS lg FROM ev WHERE value BETWEEN 0 AND 100")
def fn_math(spark, d):
    v = F.col("value")
    return event_log(spark, d).filter(v.between(0, 100)).select("row_id", r6(F.log1p(v)).alias("l"), r6(F.exp(-v / 100)).alias("e"), r6(F.sqrt(v)).alias("s"), r6(F.tanh(v / 50 - 1)).alias("t"), F.rint(v).alias("r"), F.greatest(F.lit(10.0), F.least(F.lit(90.0), v)).alias("c"), r6(X.logit((v + 1) / 102)).alias("lg"))


@query("fn_date_blocks", "SELECT o_orderkey, date_diff('day', DATE '1995-01-01', CAST(o_orderdate AS DATE)) AS ordinal, CAST(least(month(o_orderdate), 10) AS INTEGER) AS month10, CASE WHEN month(o_orderdate) <= 4 THEN 'early' WHEN month(o_orderdate) <= 8 THEN 'mid' ELSE 'late' END AS block FROM orders")
def fn_date(spark, d):
    m = F.month("o_orderdate")
    return table(spark, d, "orders").select("o_orderkey", F.datediff(F.col("o_orderdate").cast("date"), F.lit("1995-01-01").cast("date")).cast("long").alias("ordinal"), F.least(m, F.lit(10)).alias("month10"), F.when(m <= 4, "early").when(m <= 8, "mid").otherwise("late").alias("block"))


@query("fn_smallest_denominator", f"""WITH {LI}, c AS (SELECT entity, season, month, round(avg(y), 6) AS rate FROM li GROUP BY ALL)
SELECT entity, season, month, (SELECT CAST(min(i) AS INTEGER) FROM range(1, 161) t(i) WHERE abs(rate * i - round_even(rate * i, 0)) <= 5e-6 * i) AS n FROM c""")
def fn_denominator(spark, d):
    c = line_log(spark, d).groupBy("entity", "season", "month").agg(r6(F.avg("y")).alias("rate"))
    return c.select("entity", "season", "month", X.smallest_denominator(F.col("rate")).alias("n"))


@query("fn_hash", "SELECT c_custkey, md5(c_name) AS m, sha256(c_name) AS s FROM customer")
def fn_hash(spark, d):
    return table(spark, d, "customer").select("c_custkey", F.md5(F.col("c_name").cast("binary")).alias("m"), F.sha2(F.col("c_name").cast("binary"), 256).alias("s"))


@query("fn_map_default", f"WITH {EV} SELECT row_id, CAST(CASE kind WHEN 'click' THEN 1.5 WHEN 'purchase' THEN 2.5 ELSE 0.5 END AS DOUBLE) AS w FROM ev")
def fn_map(spark, d):
    weights = F.create_map(F.lit("click"), F.lit(1.5), F.lit("purchase"), F.lit(2.5))
    return event_log(spark, d).select("row_id", F.coalesce(F.try_element_at(weights, F.col("kind")), F.lit(0.5)).alias("w"))
