"""Aggregations: group means, shrinkage constants, mergeable moments, shares and trends."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def credibility(groups: DataFrame, by: list[str]) -> DataFrame:
    """Bühlmann-Straub constants of groups with counts n and k: (by, groups, mean, epv, vhm, kappa).

    The process variance is divided by the sum of n - 1; kappa = EPV / VHM is 1e9 where the means don't vary more than chance.
    """
    n, k = F.col("n").cast("double"), F.col("k").cast("double")
    s = groups.groupBy(*by).agg(F.count("*").alias("groups"), F.sum(n).alias("N"), F.sum(k).alias("k"), F.sum(n * n).alias("nn"), F.sum(k - k * k / n).alias("within"), F.sum(k * k / n).alias("kk"))
    mean = F.col("k") / F.col("N")
    s = s.withColumns({"mean": mean, "epv": F.col("within") / F.greatest(F.lit(1.0), F.col("N") - F.col("groups"))})
    between = (F.col("kk") - F.col("k") * F.col("mean") - (F.col("groups") - 1) * F.col("epv")) / F.greatest(F.lit(1.0), F.col("N") - F.col("nn") / F.col("N"))
    s = s.withColumn("vhm", between)
    return s.select(*by, "groups", "mean", "epv", "vhm", F.when(F.col("vhm") > 1e-10, F.col("epv") / F.col("vhm")).otherwise(1e9).alias("kappa"))


def credible_logit() -> Column:
    """Logit of the group's rate (n, k) shrunk to ``mean`` with weight kappa, kept within 0.001 and 0.999."""
    p = F.col("mean") + F.col("n") / (F.col("n") + F.col("kappa")) * (F.col("k") / F.col("n") - F.col("mean"))
    p = F.greatest(F.lit(1e-3), F.least(F.lit(1 - 1e-3), p))
    return F.ln(p / (1 - p))


def prefix_counts(cells: DataFrame, entity: str = "entity", season: str = "season") -> DataFrame:
    """(entity, season, n, k): counts over all seasons strictly before, for every season with an earlier one and the one after the last.

    Seasons are few; an entity counts in all later ones, whether it has rows in them or not.
    """
    met = cells.select(season).distinct()
    targets = met.union(met.agg((F.max(season) + 1).alias(season))).withColumnRenamed(season, "_t")
    j = cells.join(F.broadcast(targets), F.col(season) < F.col("_t"))
    return j.groupBy(entity, F.col("_t").alias(season)).agg(F.sum("n").alias("n"), F.sum("k").alias("k"))


def shrunk_means(df: DataFrame, keys: list[str], k: float, y: str = "y") -> DataFrame:
    """(keys, n, effect): the group's deviation from the overall mean times n / (n + k)."""
    mean = F.broadcast(df.agg(F.avg(y).alias("_m")))
    g = df.groupBy(*keys).agg(F.count("*").alias("n"), F.avg(y).alias("_p")).crossJoin(mean)
    return g.select(*keys, "n", (F.col("n") / (F.col("n") + k) * (F.col("_p") - F.col("_m"))).alias("effect"))


def shares(df: DataFrame, keys: list[str], category: str, domain: list) -> DataFrame:
    """A column per category of a fixed domain with its share of the group's rows; a category that doesn't occur has 0."""
    return df.groupBy(*keys).agg(*(F.avg((F.col(category) == F.lit(v)).cast("int")).alias(f"share_{v}") for v in domain))


def mode_of(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """The most frequent value of each group, of several the smallest: counted first, so a large group isn't gathered."""
    counts = df.groupBy(*keys, value).agg(F.count("*").alias("_n"))
    return counts.groupBy(*keys).agg(F.min_by(value, F.struct(-F.col("_n"), F.col(value))).alias("mode"))


def session_profile(df: DataFrame, entity: list[str], session: str) -> DataFrame:
    """Number of sessions and quantiles of their lengths per entity: two levels of aggregation."""
    s = df.groupBy(*entity, session).agg(F.count("*").alias("n"))
    q = F.percentile("n", [0.1, 0.25, 0.5, 0.75, 0.9])
    d = s.groupBy(*entity).agg(F.count("*").alias("n_sessions"), q.alias("q"), F.avg("n").alias("mean_len"), F.avg((F.col("n") >= 3).cast("int")).alias("share_long"))
    return d.select(*entity, "n_sessions", *(F.get("q", F.lit(i)).alias(f"q{p}") for i, p in enumerate((10, 25, 50, 75, 90))), "mean_len", "share_long")


def cell_moments(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Mergeable cells: n, sum and sum of squares."""
    v = F.col(value)
    return df.groupBy(*keys).agg(F.count(value).alias("n"), F.sum(v).alias("s"), F.sum(v * v).alias("q"))


def pooled_variance(cells: DataFrame, keys: list[str]) -> DataFrame:
    """Variance within cells, pooled over the cells of each key with at least two rows."""
    d = cells.filter("n >= 2")
    return d.groupBy(*keys).agg((F.sum(F.col("q") - F.col("s") * F.col("s") / F.col("n")) / F.sum(F.col("n") - 1)).alias("pooled"))


def supported_mean(cells: DataFrame, keys: list[str], least: int = 30) -> DataFrame:
    return cells.groupBy(*keys).agg(F.when(F.sum("n") >= least, F.sum("s") / F.sum("n")).alias("level"))


def slope(y: Column, x: Column, least: int = 3) -> Column:
    """Slope of y over x where at least ``least`` points have both and x varies; NULL otherwise."""
    both = y.isNotNull() & x.isNotNull()
    n = F.count(F.when(both, F.lit(1)))
    return F.when((n >= least) & (F.var_pop(F.when(both, x)) > 1e-12), F.regr_slope(F.when(both, y), F.when(both, x)))


def trend(y: Column, x: Column, least: int = 3) -> Column:
    """Slope of y over x: NULL for fewer than ``least`` points that have both, 0 where x doesn't vary."""
    both = y.isNotNull() & x.isNotNull()
    return F.when(F.count(F.when(both, F.lit(1))) >= least, F.coalesce(slope(y, x, least), F.lit(0.0)))


def transition_shares(df: DataFrame, by: list[str], within: list[str], order: str, category: str) -> DataFrame:
    """Share of each (previous, current) pair of categories among the steps of each ``by``; a step stays ``within`` its keys (an entity's game, say)."""
    w = Window.partitionBy(*within).orderBy(order)
    steps = df.select(*by, F.lag(category).over(w).alias("prev"), F.col(category).alias("cur")).filter("prev IS NOT NULL")
    cells = steps.groupBy(*by, "prev", "cur").agg(F.count("*").alias("n"))
    return cells.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy(*by)))


def gate(df: DataFrame, arm: str, delta: str) -> DataFrame:
    """Per arm: mean, sample deviation, least, number of positive folds, n, and whether the mean is positive and beyond the deviation."""
    g = df.groupBy(arm).agg(F.avg(delta).alias("mean"), F.stddev_samp(delta).alias("sd"), F.min(delta).alias("worst"), F.count_if(F.col(delta) > 0).alias("positive"), F.count(delta).alias("n"))
    return g.withColumn("passed", F.coalesce((F.col("mean") > 0) & (F.col("mean") > F.col("sd")), F.lit(False)))


def partition_gain(df: DataFrame, by: list[str], y: str, p: str, scale: float = 1e5) -> DataFrame:
    """What recalibrating each part to its own mean could gain at most: scale * sum(share * bias ** 2)."""
    g = df.groupBy(*by).agg(F.count("*").alias("n"), (F.avg(y) - F.avg(p)).alias("bias"))
    return g.agg(F.count("*").alias("parts"), (scale * F.sum(F.col("n") * F.col("bias") * F.col("bias")) / F.sum("n")).alias("gain"))


def top_votes(df: DataFrame, entity: str, candidate: str, k: int = 5) -> DataFrame:
    """The k candidates of each entity with most votes, as shares of all its votes."""
    votes = df.groupBy(entity, candidate).agg(F.count("*").alias("votes"))
    total = Window.partitionBy(entity)
    ranked = votes.withColumns({"share": F.col("votes") / F.sum("votes").over(total), "r": F.row_number().over(total.orderBy(F.desc("votes"), candidate))})
    return ranked.filter(F.col("r") <= k)


def purity(df: DataFrame, a: str, b: str) -> DataFrame:
    """Per value of ``a`` the largest share that one value of ``b`` has."""
    cells = df.groupBy(a, b).agg(F.count("*").alias("n"))
    return cells.groupBy(a).agg(F.sum("n").alias("n"), (F.max("n") / F.sum("n")).alias("purity"))
