"""Queries of joins and lookups, and of entity resolution built on them."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import fitting as T
from ..operators import joins as J
from ..operators import matching as X
from ..operators import resolve as E
from ..operators import sessions as S
from ..sources.files import materialised
from ..sources.tables import event_log, line_log, table
from .history import SESSION, sessions_of
from .registry import EV, LI, query, r6

CELLS = LI + ", c AS (SELECT entity, season, count(*) AS n, avg(y) AS rate FROM li GROUP BY ALL)"


def _cells(spark, d):
    return line_log(spark, d).groupBy("entity", "season").agg(F.count("*").alias("n"), F.avg("y").alias("rate"))


@query("jn2_season_offset", f"WITH {CELLS} SELECT c.entity, c.season, round(p.rate, 6) AS prev1_rate, round(p.rate - q.rate, 6) AS delta FROM c LEFT JOIN c p ON p.entity = c.entity AND p.season = c.season - 1 LEFT JOIN c q ON q.entity = c.entity AND q.season = c.season - 2")
def jn2(spark, d):
    c = _cells(spark, d)
    j = J.season_offset(J.season_offset(c, c, ["rate"]), c, ["rate"], 2)
    return j.select("entity", "season", r6("prev1_rate").alias("prev1_rate"), r6(F.col("prev1_rate") - F.col("prev2_rate")).alias("delta"))


@query("jn3_composite_lookup", f"WITH {CELLS}, l AS (SELECT * FROM c WHERE n >= 90), e AS (SELECT l_suppkey AS entity, CAST(year(l_shipdate) AS INTEGER) AS season, l_orderkey FROM lineitem) SELECT l_orderkey, e.entity, e.season, round(sum(coalesce(l.rate, 0.333)), 6) AS rate FROM e LEFT JOIN l USING (entity, season) GROUP BY ALL")
def jn3(spark, d):
    rows = table(spark, d, "lineitem").select(F.col("l_suppkey").alias("entity"), F.year("l_shipdate").alias("season"), "l_orderkey")
    n_rows = rows.count()
    j = J.fallback_lookup(rows, _cells(spark, d).filter("n >= 90").drop("n"), ["entity", "season"], {"rate": 0.333}, n_rows)
    # An order's rows are few, so its key deals them evenly.
    return J.dealt_by_size(j, n_rows, "l_orderkey").groupBy("l_orderkey", "entity", "season").agg(r6(F.sum("rate")).alias("rate"))


@query("jn4_dimension", "SELECT c_custkey, n_name, r_name FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey")
def jn4(spark, d):
    # nation and region have a fixed number of rows.
    places = table(spark, d, "nation").join(F.broadcast(table(spark, d, "region")), F.col("n_regionkey") == F.col("r_regionkey"))
    return table(spark, d, "customer").join(F.broadcast(places), F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", "n_name", "r_name")


@query("jn5_two_key_merge", f"WITH {CELLS}, e AS (SELECT l_partkey % 100 AS entity, CAST(year(l_shipdate) AS INTEGER) AS season, count(*) AS m FROM lineitem GROUP BY ALL) SELECT entity, season, n, m FROM c JOIN e USING (entity, season)")
def jn5(spark, d):
    e = line_log(spark, d).groupBy((F.col("partner") % 100).alias("entity"), "season").agg(F.count("*").alias("m"))
    return _cells(spark, d).join(e, ["entity", "season"]).select("entity", "season", "n", "m")


@query("jn6_merge_filled", f"WITH {EV}, p AS (SELECT row_id, 0.25 AS q FROM ev WHERE kind IN ('click', 'view')) SELECT row_id, round(coalesce(q, value / 1000), 6) AS p FROM ev LEFT JOIN p USING (row_id)")
def jn6(spark, d):
    e = event_log(spark, d)
    one = lambda kinds: e.filter(F.col("kind").isin(*kinds)).select("row_id", F.lit(0.25).alias("q"))
    given = one(["click", "view"]).unionByName(one(["click"]))
    return e.join(given.dropDuplicates(["row_id"]), "row_id", "left").select("row_id", r6(F.coalesce("q", F.col("value") / 1000)).alias("p"))


@query("jn7_next_session", f"WITH {SESSION}, c AS (SELECT entity, session, count(*) AS n, sum(y) AS k FROM s GROUP BY ALL) SELECT entity, session, lead(n) OVER w AS next_n, CAST(lead(k) OVER w AS BIGINT) AS next_k FROM c WINDOW w AS (PARTITION BY entity ORDER BY session)")
def jn7(spark, d):
    c = sessions_of(spark, d).groupBy("entity", "session").agg(F.count("*").alias("n"), F.sum("y").alias("k"))
    return J.next_of(c, "entity", "session", ["n", "k"]).select("entity", "session", "next_n", "next_k")


@query("jn8_outer_channels", f"WITH {LI}, f AS (SELECT entity, season, count(*) AS n_f FROM li WHERE grp = 'F' AND discount > 0.09 GROUP BY ALL), o AS (SELECT entity, season, count(*) AS n_o FROM li WHERE grp = 'O' AND discount > 0.09 GROUP BY ALL) SELECT entity, season, n_f, n_o FROM f FULL JOIN o USING (entity, season)")
def jn8(spark, d):
    # One conditional aggregation instead of a full outer join of two.
    li = line_log(spark, d).filter("discount > 0.09")
    g = li.groupBy("entity", "season").agg(*(F.count_if(F.col("grp") == v).alias(f"n_{v.lower()}") for v in ("F", "O")))
    return g.select("entity", "season", *(F.nullif(F.col(c), F.lit(0)).alias(c) for c in ("n_f", "n_o"))).filter("n_f IS NOT NULL OR n_o IS NOT NULL")


TUPLES = SESSION + """, a AS (SELECT entity, session, season, CAST(min(ts) AS DATE) AS day, count(*) AS n FROM s GROUP BY ALL),
b AS (SELECT entity + 1000 AS other, session AS b_session, season, CAST(min(ts) AS DATE) AS day, count(*) AS n FROM s WHERE season <> 1 GROUP BY ALL)"""


@query("jn9_unique_tuples", f"""WITH {TUPLES}, ua AS (SELECT season, day, n, min(entity) AS entity, min(session) AS session FROM a GROUP BY ALL HAVING count(*) = 1), ub AS (SELECT season, day, n, min(other) AS other FROM b GROUP BY ALL HAVING count(*) = 1)
SELECT season, day, n, entity, session, other FROM ua JOIN ub USING (season, day, n)""")
def jn9(spark, d):
    s = sessions_of(spark, d)
    a = s.groupBy("entity", "session", "season").agg(F.min("day").alias("day"), F.count("*").alias("n")).withColumn("a", F.struct("entity", "session"))
    b = s.filter("season <> 1").groupBy((F.col("entity") + 1000).alias("other"), "session", "season").agg(F.min("day").alias("day"), F.count("*").alias("n"))
    return J.unique_tuple_match(a, b, ["season", "day", "n"], "a", "other").select("season", "day", "n", "a.entity", "a.session", "other")


@query("jn10_semi", f"WITH {EV} SELECT row_id FROM ev WHERE entity IN (SELECT c_custkey FROM customer WHERE c_acctbal > 5000)")
def jn10(spark, d):
    rich = table(spark, d, "customer").filter("c_acctbal > 5000").select(F.col("c_custkey").alias("entity"))
    return event_log(spark, d).join(rich, "entity", "left_semi").select("row_id")


@query("jn11_unmatched", f"WITH {EV} SELECT DISTINCT entity FROM ev WHERE entity NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal > 0)")
def jn11(spark, d):
    known = table(spark, d, "customer").filter("c_acctbal > 0").select(F.col("c_custkey").alias("entity"))
    return event_log(spark, d).select("entity").distinct().join(known, "entity", "left_anti")


#: Two id spaces: suppliers in one channel, and re-keyed suppliers in the other.
COST = LI + """, lin AS (SELECT li.*, s_nationkey AS nation FROM li JOIN supplier ON s_suppkey = entity), va AS (SELECT entity, nation, season, avg(quantity) AS q, avg(discount) * 100 AS c FROM lin WHERE grp = 'F' GROUP BY ALL), vb AS (SELECT entity + 1000000 AS entity, nation, season, avg(quantity) AS q, avg(discount) * 100 AS c FROM lin WHERE grp = 'O' GROUP BY ALL),
p AS (SELECT a.entity AS a, b.entity AS b, sum(1.0 * abs(a.q - b.q) + 2.0 * abs(a.c - b.c)) AS cost FROM va a JOIN vb b USING (season, nation) GROUP BY ALL)"""


def _nations(spark, d):
    """Block of each entity: only those of one nation are held against each other."""
    return table(spark, d, "supplier").select(F.col("s_suppkey").alias("entity"), F.col("s_nationkey").alias("nation"))


def _pairs(spark, d, nearest=None, keep=None):
    """Pairs of both id spaces with their cost: all, or with ``nearest`` those that some id's i cheapest (a) or j cheapest (b) can be among."""
    v = line_log(spark, d).groupBy("entity", "season", "grp").agg(F.avg("quantity").alias("q"), (F.avg("discount") * 100).alias("c")).join(_nations(spark, d), "entity")
    v = materialised(v)  # both sides read it
    other = v.filter("grp = 'O'").withColumn("entity", F.col("entity") + 1_000_000)
    return J.pair_cost(v.filter("grp = 'F'"), other, ["nation"], "season", "entity", "entity", {"q": 1.0, "c": 2.0}, nearest, keep)


@query("jn12_pair_cost", f"WITH {COST} SELECT a, b, round(cost, 6) AS cost FROM p")
def jn12(spark, d):
    return _pairs(spark, d).select("a", "b", r6("cost").alias("cost"))


@query("jn14_mutual_nearest", f"""WITH {COST}, ra AS (SELECT *, row_number() OVER (PARTITION BY a ORDER BY cost, b) AS r FROM p), rb AS (SELECT *, row_number() OVER (PARTITION BY b ORDER BY cost, a) AS r FROM p)
SELECT ra.a, ra.b, round(ra.cost, 6) AS cost FROM ra JOIN rb ON ra.a = rb.a AND ra.b = rb.b WHERE ra.r = 1 AND rb.r = 1""")
def jn14(spark, d):
    return J.mutual_nearest(_pairs(spark, d, (1, 1))).select("a", "b", r6("cost").alias("cost"))


@query("srt7_margins", f"""WITH {COST} SELECT a, b, round((SELECT min(cost) FROM p x WHERE x.a = p.a AND x.b <> p.b) - cost, 6) AS margin_row,
  round((SELECT min(cost) FROM p x WHERE x.b = p.b AND x.a <> p.a) - cost, 6) AS margin_col FROM p WHERE b = a + 1000000""")
def srt7(spark, d):
    """Margins of the pairs that belong together; they aren't always the cheapest."""
    return J.margins(*_assigned(spark, d)).select("a", "b", r6("margin_row").alias("margin_row"), r6("margin_col").alias("margin_col"))


def _assigned(spark, d):
    """Each id's two cheapest pairs, which hold the least cost of any other partner, with the pairs that belong together."""
    ids = table(spark, d, "supplier").select(F.col("s_suppkey").alias("a"), (F.col("s_suppkey") + 1_000_000).alias("b"))
    pairs = materialised(_pairs(spark, d, (2, 2), ids))
    return pairs, pairs.filter("b = a + 1000000").select("a", "b")


@query("jn15_ordered_realign", f"WITH {EV} SELECT row_id, round(value / 100, 6) AS p FROM ev WHERE season = 3")
def jn15(spark, d):
    e = event_log(spark, d)
    return J.ordered_realign(e.filter("season = 3").select("row_id"), e.select("row_id", r6(F.col("value") / 100).alias("p")), "row_id", "p")


@query("jn16_group_mean_back", f"WITH {EV}, g AS (SELECT partner, avg(y) AS m FROM ev WHERE season < 2 GROUP BY partner) SELECT row_id, round(coalesce(m, (SELECT avg(y) FROM ev WHERE season < 2)), 6) AS m FROM ev LEFT JOIN g USING (partner)")
def jn16(spark, d):
    e = event_log(spark, d)
    fit = e.filter("season < 2")
    level = F.broadcast(fit.agg(F.avg("y").alias("level")))
    return e.join(fit.groupBy("partner").agg(F.avg("y").alias("m")), "partner", "left").crossJoin(level).select("row_id", r6(F.coalesce("m", "level")).alias("m"))


@query("jn17_blended_keys", f"""WITH {EV}, a AS (SELECT entity, min_by(value, row_id) AS v FROM ev WHERE season = 3 GROUP BY entity), b AS (SELECT entity, max_by(value, row_id) AS v FROM ev WHERE season = 2 GROUP BY entity)
SELECT entity, coalesce(a.v, b.v) AS v, a.v IS NOT NULL AS fresh FROM a FULL JOIN b USING (entity)""")
def jn17(spark, d):
    e = event_log(spark, d)
    g = e.filter("season IN (2, 3)").groupBy("entity").agg(F.min_by(F.when(F.col("season") == 3, F.col("value")), F.when(F.col("season") == 3, F.col("row_id"))).alias("a"), F.max_by(F.when(F.col("season") == 2, F.col("value")), F.when(F.col("season") == 2, F.col("row_id"))).alias("b"))
    return g.select("entity", F.coalesce("a", "b").alias("v"), F.col("a").isNotNull().alias("fresh"))


@query("srt5_knn", """WITH q AS (SELECT vec_id AS query, embedding AS e, label AS l FROM embeddings WHERE vec_id % 20 = 0),
d AS (SELECT query, vec_id AS neighbour, list_sum(list_transform(list_zip(embedding, e), lambda z: (z[1]::DOUBLE - z[2]::DOUBLE) * (z[1]::DOUBLE - z[2]::DOUBLE))) AS dist FROM embeddings, q WHERE label <> l)
SELECT query, neighbour, round(dist, 6) AS distance, r AS rank FROM (SELECT *, CAST(row_number() OVER (PARTITION BY query ORDER BY dist, neighbour) AS INTEGER) AS r FROM d) WHERE r <= 5""")
def srt5(spark, d):
    e = table(spark, d, "embeddings")
    return J.nearest_rows(e.filter("vec_id % 20 = 0"), e, 5, "vec_id", "embedding", exclude="label").select("query", "neighbour", r6("distance").alias("distance"), "rank")


SIGNATURE = LI + """, m AS (SELECT entity + CASE WHEN grp = 'O' THEN 1000000 ELSE 0 END AS entity, season, grp, avg(quantity) AS q, avg((discount < 0.05)::INT) AS h FROM li GROUP BY ALL),
r AS (SELECT *, (rank() OVER (PARTITION BY season, grp ORDER BY q) + (count(*) OVER (PARTITION BY season, grp, q) - 1) / 2) / count(*) OVER (PARTITION BY season, grp) AS pct FROM m JOIN (SELECT s_suppkey, s_nationkey AS nation FROM supplier) ON s_suppkey = entity % 1000000)"""


@query("er3_rank_cost", f"""WITH {SIGNATURE} SELECT a.entity AS a, b.entity AS b, round(sum(abs(a.pct - b.pct) + 0.5 * sqrt(greatest(0.0, 1 - (sqrt(a.h * b.h) + sqrt((1 - a.h) * (1 - b.h)))))), 6) AS cost, count(*) AS blocks
FROM r a JOIN r b USING (season, nation) WHERE a.grp = 'F' AND b.grp = 'O' GROUP BY ALL""")
def er3(spark, d):
    return E.signature_cost(*_signatures(spark, d), ["nation"], "season").select("a", "b", r6("cost").alias("cost"), "blocks")


def _signatures(spark, d):
    key = F.col("entity") + F.when(F.col("grp") == "O", 1_000_000).otherwise(0)
    m = line_log(spark, d).groupBy(key.alias("entity"), "season", "grp").agg(F.avg("quantity").alias("q"), F.avg((F.col("discount") < 0.05).cast("int")).alias("h"))
    r = S.average_rank(m, "q", ["season", "grp"]).withColumn("hist", F.array(F.col("h"), 1 - F.col("h")))
    r = r.join(_nations(spark, d).withColumnRenamed("entity", "_own"), F.col("entity") % 1_000_000 == F.col("_own")).drop("_own")
    r = materialised(r)  # both sides read it
    return r.filter("grp = 'F'"), r.filter("grp = 'O'")


@query("er4_assignment")
def er4(spark, d):
    """One-to-one pairs of least total cost between the two id spaces, nation by nation."""
    return E.assigned(*_signatures(spark, d), ["nation"], "season").select("nation", "a", "b", r6("cost").alias("cost"))


#: Seasons of the line log, and what a difference of each ranked measure costs.
YEARS = range(1995, 2002)
WEIGHTS = X.Weights({"n": 1.0, "mean": 1.2, "discount": 0.8, "q10": 0.4, "q25": 0.4, "q50": 0.5, "q75": 0.4, "q90": 0.4})


def _measured(spark, d, with_sets=True):
    """Both id spaces with (entity, season, nation, region, measures), quantile axes among them, and their numbers of rows by month."""
    own = table(spark, d, "supplier").join(table(spark, d, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    own = own.select(F.col("s_suppkey").alias("entity"), F.col("s_nationkey").alias("nation"), F.col("n_regionkey").alias("region"))
    q = F.percentile("quantity", F.array(*(F.lit(x) for x in (0.1, 0.25, 0.5, 0.75, 0.9))))
    li = line_log(spark, d)
    m = li.groupBy("entity", "season", "grp").agg(F.count("*").cast("double").alias("n"), F.avg("quantity").alias("mean"), F.avg("discount").alias("discount"), q.alias("q"))
    m = m.join(own, "entity").select("entity", "season", "nation", "region", "grp", "n", "mean", "discount", *(F.col("q")[i].alias(f"q{v}") for i, v in enumerate((10, 25, 50, 75, 90))))
    far = F.col("entity") + 1_000_000
    m = materialised(m)  # both sides read it, in every round
    a, b = m.filter("grp = 'F'").drop("grp"), m.filter("grp = 'O'").withColumn("entity", far).drop("grp")
    if not with_sets:
        return a, b, None
    months = materialised(li.groupBy("entity", "season", "month", "grp").agg(F.count("*").alias("n")))
    of = lambda g, e: months.filter(F.col("grp") == g).select(e.alias("entity"), "season", "month", "n").withColumnsRenamed({"month": "key", "n": "size"})
    sets = X.Sets(of("F", F.col("entity")), of("O", far), range(1, 13))
    return a, b, sets


@query("er10_rematch")
def er10(spark, d):
    """Three rounds: match, rank both sides anew against the sure pairs, match again."""
    a, b, sets = _measured(spark, d)
    _, pairs = X.rematch(a, b, WEIGHTS, ["nation"], ["season", "region"], YEARS, sets)
    return pairs.select("nation", "a", "b", r6("cost").alias("cost"), "co", r6("margin_row").alias("margin_row"), "anchor", "round")


def _voted(spark, d):
    """The base pairs, and those of 20 jitters, of each season, of two eras and of two cutoffs."""
    a, b, sets = _measured(spark, d)
    dist, base = X.rematch(a, b, WEIGHTS, ["nation"], ["season", "region"], YEARS, sets, rounds=2)
    arms = X.jitters(list(WEIGHTS.axes)) + [X.Arm(f"season{s}", "season", [s]) for s in YEARS] + [X.Arm("early", "era", [1995, 1996, 1997, 1998]), X.Arm("late", "era", [1999, 2000, 2001])]
    arms += [X.Arm(f"upto{s}", "cutoff", range(1995, s + 1)) for s in (1997, 1999)]
    return base, X.arm_matches(dist, a, b, WEIGHTS, ["nation"], arms, YEARS)


@query("er8_agreement")
def er8(spark, d):
    """Each pair's stability under jitters, the partner its seasons choose, whether eras agree, and the tier that follows."""
    base, votes = _voted(spark, d)
    agreed = X.agreement(base, votes)
    return agreed.join(X.sure_tiers(base, agreed, 0.2), ["a", "b"]).select("a", "b", r6("stability").alias("stability"), "season_mode", "n_seasons", "agree", "eras", "same_era", "tier")


@query("er12_posterior")
def er12(spark, d):
    return X.posterior(*_voted(spark, d)).select("a", "b", r6("p").alias("p"))


@query("er14_asof_agreement")
def er14(spark, d):
    """Matching again with the seasons up to a cutoff: how many ids keep their partner."""
    base, votes = _voted(spark, d)
    return X.asof_agreement(votes, base).select("arm", "common", "same", r6("agreement").alias("agreement"))


@query("er6_polarity")
def er6(spark, d):
    """Regions as they are, and two of them exchanged on one side."""
    a, b, _ = _measured(spark, d, with_sets=False)
    w = X.Weights({"n": 1.0, "mean": 1.2, "discount": 0.8}, sets=0.0)
    return X.polarity(a, b, w, [], "region", {"own": {i: i for i in range(5)}, "exchanged": {0: 1, 1: 0, 2: 2, 3: 3, 4: 4}}, YEARS).select("polarity", "pairs", r6("total").alias("total"), r6("ratio").alias("ratio"))


@query("er5_tiers", f"""WITH {COST}, ra AS (SELECT *, row_number() OVER (PARTITION BY a ORDER BY cost, b) AS r, lead(cost) OVER (PARTITION BY a ORDER BY cost, b) AS nxt FROM p), rb AS (SELECT a, b, row_number() OVER (PARTITION BY b ORDER BY cost, a) AS r FROM p),
m AS (SELECT ra.a, ra.b, nxt - ra.cost AS margin, rb.r = 1 AS agree FROM ra JOIN rb ON ra.a = rb.a AND ra.b = rb.b WHERE ra.r = 1)
SELECT a, b, round(margin, 6) AS margin, CASE WHEN agree AND margin >= 1.0 THEN 1 WHEN agree OR margin >= 1.0 THEN 2 ELSE 3 END AS tier FROM m""")
def er5(spark, d):
    return E.tiers(_pairs(spark, d, (2, 1)), 1.0).select("a", "b", r6("margin").alias("margin"), "tier")


@query("er7_permutation_test")
def er7(spark, d):
    """How far agreement on a held-out trait stands above that of pairs permuted within their nation."""
    r = line_log(spark, d).groupBy("entity").agg(F.round(F.avg("discount"), 3).alias("x"), F.avg("quantity").alias("q"))
    pairs = r.select(F.col("entity").alias("a"), (F.col("x") * 1000).cast("int").alias("ta"), ((F.col("x") * 1000).cast("int") + F.when(F.col("q") > 25.5, 1).otherwise(0)).alias("tb"))
    pairs = pairs.join(_nations(spark, d).withColumnRenamed("entity", "a"), "a")
    return E.permutation_test(pairs, "ta", "tb", "a", 200, block=["nation"])


@query("er11_soft_profile", f"""WITH {COST}, k AS (SELECT *, row_number() OVER (PARTITION BY a ORDER BY cost, b) AS r FROM p), w AS (SELECT *, exp(-(cost - min(cost) OVER (PARTITION BY a)) / 5.0) AS e FROM k WHERE r <= 5), s AS (SELECT *, e / sum(e) OVER (PARTITION BY a) AS w FROM w)
SELECT a, round(sum(w * b), 4) AS mean_b, round(-sum(w * ln(w)), 6) AS entropy, round(max(w), 6) AS top FROM s GROUP BY a""")
def er11(spark, d):
    w = E.soft_top_k(_pairs(spark, d, (5, 0)), 5, 5.0)
    return w.groupBy("a").agg(F.round(F.sum(F.col("w") * F.col("b")), 4).alias("mean_b"), r6(-F.sum(F.col("w") * F.ln("w"))).alias("entropy"), r6(F.max("w")).alias("top"))


@query("er9_antimode_threshold")
def er9(spark, d):
    """The least dense place between two groups of margins: by a kernel estimate and by a mixture of two normal components."""
    margins = materialised(J.margins(*_assigned(spark, d)))
    kernel = E.antimode(margins, "margin_row", 50).withColumn("method", F.lit("kernel"))
    mixture = T.mixture_threshold(margins, "margin_row").withColumn("method", F.lit("mixture"))
    return kernel.unionByName(mixture).select("method", r6("threshold").alias("threshold"), "bimodal")


@query("jn13_greedy_match")
def jn13(spark, d):
    """How much of an entity's sessions each of two candidates of the other id space has: its own, and a neighbour."""
    s = sessions_of(spark, d).groupBy("entity", "session", "season").agg(F.count("*").alias("n"), F.min("kind").alias("kind"))
    other = s.filter("session % 2 = 0").select((F.col("entity") + 1_000_000).alias("entity"), "session", "season", (F.col("n") + F.col("session") % 3).alias("n"), "kind")
    ids = s.select(F.col("entity").alias("a")).distinct()
    pairs = ids.select("a", (F.col("a") + 1_000_000).alias("b")).union(ids.select("a", (F.col("a") + 1_000_001).alias("b")))
    return E.set_score(pairs, s, other, ["season"], "entity", "kind", "n", "session").select("a", "b", "season", r6("score").alias("score"))
