"""Domain features of shrinkage: innovations, priors over seasons, interactions and two-pass effects."""

from __future__ import annotations

import math
from dataclasses import dataclass
from statistics import NormalDist

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.scalars import logit, marcum_q1, normal_cdf_series
from ..sources.files import materialised
from .joins import on_keys


def innovation(rows: DataFrame, kappa: float, league: float) -> DataFrame:
    """Of in-season counters (is_n, is_k within 0 and is_n) and a base: prior rate, posterior rate, their difference, its reliability, log(1 + is_n)."""
    prior = F.when(F.col("base_n_end") > 0, F.col("base_k_end") / F.col("base_n_end")).otherwise(league)
    d = rows.withColumn("q_prior", prior)
    d = d.withColumn("q_post", (F.col("is_k") + kappa * F.col("q_prior")) / (F.col("is_n") + kappa))
    return d.withColumns({"innovation": F.col("q_post") - F.col("q_prior"), "reliability": F.col("is_n") / (F.col("is_n") + kappa), "log_dn": F.log1p("is_n")})


def log_ratio_mix(df: DataFrame, counts: list[str], league: dict[str, float], kappa: float, floor: float = 1e-4) -> DataFrame:
    """A season's mix so far as a Dirichlet posterior around the entity's own base mix, as log ratios to the first category.

    Rows have what the season has added (dn, d_<count>) and the base before it (base_n, base_<count>). Without a base the prior is
    the league's mix. Adds lr_<count> for all but the first, ``reliability`` dn / (dn + kappa) and ``innovation``, the first one's departure from its prior.
    """
    prior = {c: F.when(F.col("base_n") > 0, F.col(f"base_{c}") / F.col("base_n")).otherwise(F.lit(league[c])) for c in counts}
    post = {c: (F.least("dn", F.greatest(F.lit(0), F.col(f"d_{c}"))) + kappa * prior[c]) / (F.col("dn") + kappa) for c in counts}
    at = {c: F.least(F.lit(1.0), F.greatest(F.lit(floor), post[c])) for c in counts}
    first = counts[0]
    return df.withColumns({f"lr_{c}": F.ln(at[c] / at[first]) for c in counts[1:]} | {"reliability": F.col("dn") / (F.col("dn") + kappa), "innovation": post[first] - prior[first]})


def season_prior(increments: DataFrame, target: DataFrame, rho: float, K: float, default: float, least: float = 25.0, most: float = 800.0, entity: str = "entity", season: str = "season") -> DataFrame:
    """A prior for each (entity, target season) from the seasons before it: ``prior``, ``variance``, ``strength``, ``trend``, ``seasons``, ``league``.

    A season's rate is shrunk with K rows of the league's rate over all seasons before the target (``default`` if there are
    none). Season s weighs rho ** (target - 1 - s) * sqrt(n / (n + K)). The variance is that of the season rates plus
    that of observing them; ``strength`` is the Beta's that has this mean and variance, within ``least`` and ``most``;
    ``trend`` is the last season's rate less the mean of those before, or less the league's. An entity without a
    season has the league's rate with the least strength.

    Scale: an entity's seasons are few, so the join fans out by at most their number.
    """
    seen = increments.filter("dn > 0")
    levels = seen.groupBy(F.col(season).alias("_s")).agg(F.sum("dn").alias("_n"), F.sum("dk").alias("_k"))
    targets = target.select(F.col(season).alias("target_season")).distinct()
    league = targets.join(levels, F.col("_s") < F.col("target_season"), "left").groupBy("target_season").agg(F.sum("_n").alias("_n"), F.sum("_k").alias("_k"))
    level = F.when(F.col("_n") > 0, F.greatest(F.lit(1e-4), F.least(F.lit(1 - 1e-4), F.col("_k") / F.col("_n")))).otherwise(default)
    league = league.select("target_season", level.alias("league"))

    t = target.select(F.col(entity).alias("_e"), F.col(season).alias("target_season")).join(F.broadcast(league), "target_season")  # one row a season
    j = t.join(seen, (F.col("_e") == F.col(entity)) & (F.col(season) < F.col("target_season")), "left")
    n = F.col("dn")
    j = j.withColumns({"_m": (F.col("dk") + K * F.col("league")) / (n + K), "_w": F.pow(F.lit(rho), F.greatest(F.lit(0), F.col("target_season") - 1 - F.col(season))) * F.sqrt(n / (n + K))})
    m, w = F.col("_m"), F.col("_w")
    g = j.groupBy("_e", "target_season", "league").agg(
        F.count("dn").alias("seasons"), F.sum(w).alias("W"), F.sum(w * m).alias("Wm"), F.sum(w * m * m).alias("Wmm"), F.sum(w * m * (1 - m) / (n + K + 1)).alias("Wo"), F.max_by(F.struct("_w", "_m"), season).alias("last")
    )
    mean, lone = F.col("Wm") / F.col("W"), F.col("seasons") == 0
    variance = F.greatest(F.lit(1e-5), F.greatest(F.lit(0.0), F.col("Wmm") / F.col("W") - mean * mean) + F.col("Wo") / F.col("W"))
    g = g.withColumns({"prior": F.when(lone, F.col("league")).otherwise(mean), "variance": F.when(lone, F.col("league") * (1 - F.col("league")) / (least + 1)).otherwise(variance)})
    implied = F.col("prior") * (1 - F.col("prior")) / F.col("variance") - 1
    earlier = F.when(F.col("seasons") > 1, (F.col("Wm") - F.col("last._w") * F.col("last._m")) / (F.col("W") - F.col("last._w"))).otherwise(F.col("league"))
    return g.select(
        F.col("_e").alias(entity),
        "target_season",
        "prior",
        "variance",
        F.when(lone, F.lit(least)).otherwise(F.greatest(F.lit(least), F.least(F.lit(most), implied))).alias("strength"),
        F.when(lone, F.lit(0.0)).otherwise(F.col("last._m") - earlier).alias("trend"),
        "seasons",
        "league",
    )


def transform_state(rows: DataFrame) -> DataFrame:
    """Of rows with an artifact's columns and in-season counters (is_n, is_k): posterior rate, its innovation, variance and reliability."""
    total = F.col("strength") + F.col("is_n")
    d = rows.withColumn("post", (F.col("prior") * F.col("strength") + F.col("is_k")) / total)
    return d.withColumns({"innov": F.col("post") - F.col("prior"), "post_var": F.col("post") * (1 - F.col("post")) / (total + 1), "rel": F.col("is_n") / total, "logdn": F.log1p("is_n")})


def apply_artifact(rows: DataFrame, artifact: DataFrame, season: str = "season", entity: str = "entity") -> DataFrame:
    """Rows with the prior of their own season; a row of a season the artifact wasn't made for raises when computed."""
    targets = F.broadcast(artifact.select(F.col("target_season").alias("_t")).distinct())  # one row a season
    checked = rows.join(targets, F.col(season) == F.col("_t"), "left")
    known = F.when(F.col("_t").isNotNull(), F.col(season)).otherwise(F.raise_error(F.concat(F.lit("no artifact for season "), F.col(season).cast("string"))).cast("int"))
    checked = checked.withColumn(season, known).drop("_t")
    return checked.join(artifact.withColumnRenamed("target_season", season), [entity, season], "left")


def residual_effects(rows: DataFrame, spec: list[tuple[str, list[str], float]], residual: str, weight: str | None = None, passes: int = 2) -> list[tuple[str, list[str], DataFrame]]:
    """Effects of (composite) keys by backfitting: of each component (name, keys, shrink), in each pass, what is left is learnt and taken off.

    effect = sum(w * r) / (sum(w) + shrink); a null key is a key like others. A later pass adds to the former ones: there are as many tables as
    components times passes, (name + pass, keys, table of keys and effect), and their effects are summed.

    Rows are aggregated once, to the distinct combinations of all keys, which are written and stay as they are. A step takes the other components' effects so
    far off them as it reads them, and its own off the sums by key; what it writes is its table alone.
    """
    w = F.lit(1.0) if weight is None else F.col(weight)
    every = sorted({k for _, keys, _ in spec for k in keys})
    cells = materialised(rows.groupBy(*every).agg(F.sum(w * F.col(residual)).alias("_s"), F.sum(w).alias("_w")))
    less = lambda d, table, keys: on_keys(d, table, keys).withColumn("_s", F.col("_s") - F.col("_w") * F.col("_total"))
    out, so_far = [], {}
    for number in range(1, passes + 1):
        for i, (name, keys, shrink) in enumerate(spec):
            d = cells
            for j, table in so_far.items():
                if j != i:
                    d = less(d, table, spec[j][1]).drop("_total")
            g = d.groupBy(*keys).agg(F.sum("_s").alias("_s"), F.sum("_w").alias("_w"))
            g = less(g, so_far[i], keys) if i in so_far else g.withColumn("_total", F.lit(0.0))
            effect = F.col("_s") / (F.col("_w") + shrink)
            table = materialised(g.select(*keys, effect.alias("effect"), (F.col("_total") + effect).alias("_total")))
            out.append((f"{name}{number}", keys, table.select(*keys, "effect")))
            so_far[i] = table.select(*keys, "_total")
    return out


def apply_effects(rows: DataFrame, components: list[tuple[str, list[str], DataFrame]]) -> DataFrame:
    """Rows with ``correction``: the sum of all components' effects; a key that wasn't met has none. Tables of the same keys are added first, so rows are joined once for each set of keys."""
    d = rows.withColumn("correction", F.lit(0.0))
    by: dict[tuple[str, ...], DataFrame] = {}
    for _, keys, table in components:
        one = table.select(*keys, "effect")
        by[tuple(keys)] = by[tuple(keys)].unionByName(one) if tuple(keys) in by else one
    for keys, tables in by.items():
        table = materialised(tables.groupBy(*keys).agg(F.sum("effect").alias("effect")))
        d = on_keys(d, table, list(keys), "left").withColumn("correction", F.col("correction") + F.coalesce("effect", F.lit(0.0))).drop("effect")
    return d


def log5(p: Column, b: Column, g: Column) -> Column:
    """Chance of success of p against b in a league of g."""
    win, lose = p * b / g, (1 - p) * (1 - b) / (1 - g)
    return win / (win + lose)


def shrunk_logit(df: DataFrame, K: float, rho: float, league: float) -> Column:
    """Logit of the credibility mean of (n, k), pulled to the league's logit by rho."""
    n, k = F.col("n"), F.col("k")
    p = (k + K * league) / (n + K)
    return rho * logit(p) + (1 - rho) * logit(F.lit(league))


def extrapolate(levels: DataFrame, by: list[str], season: str, rate: str, target: int, last: int = 3, lo: float = 0.30, hi: float = 0.70) -> DataFrame:
    """(by, forecast): each group's rate in ``target`` by the line through the ``last`` seasons directly before it, clipped.

    Where one of these is missing, the last level that is known (before the target).
    """
    d = levels.filter((F.col(season) < target) & F.col(rate).isNotNull())
    near = F.col(season) >= target - last
    x, y = F.when(near, F.col(season)), F.when(near, F.col(rate))
    g = d.groupBy(*by).agg(F.count(x).alias("m"), F.max_by(rate, season).alias("level"), F.regr_slope(y, x).alias("b"), F.regr_intercept(y, x).alias("a"))
    f = F.when(F.col("m") == last, F.col("a") + F.col("b") * target).otherwise(F.col("level"))
    return g.select(*by, F.greatest(F.lit(lo), F.least(F.lit(hi), f)).alias("forecast"))


def segment_forecasts(levels: DataFrame, segment: str, base: str, season: str, rate: str, target: int, weight: float = 0.5, last: int = 3, lo: float = 0.30, hi: float = 0.70) -> DataFrame:
    """(segment, forecast): the base segment by its line, each other by the base's forecast plus ``weight`` times how far it stood from the base in the season before.

    A segment without that season, or whose base lacks it, has the base's forecast.
    """
    own = F.broadcast(extrapolate(levels.filter(F.col(segment) == base), [], season, rate, target, last, lo, hi))
    before = F.when(F.col(season) == target - 1, F.col(rate))
    at = levels.groupBy(segment).agg(F.max(before).alias("_last"))
    ref = F.broadcast(levels.filter(F.col(segment) == base).agg(F.max(before).alias("_ref")))
    moved = F.greatest(F.lit(lo), F.least(F.lit(hi), F.col("forecast") + weight * (F.col("_last") - F.col("_ref"))))
    d = at.crossJoin(own).crossJoin(ref)
    return d.select(segment, F.when((F.col(segment) == base) | F.col("_last").isNull() | F.col("_ref").isNull(), F.col("forecast")).otherwise(moved).alias("forecast"))


def nearest_grid_point(rows: DataFrame, grid: DataFrame, id_col: str, measures: dict[str, float], point: str) -> DataFrame:
    """(id, point): the grid point nearest to each row in scaled measures. The grid is small and broadcast (at most 10,000 points, checked)."""
    if grid.limit(10_001).count() > 10_000:
        raise ValueError("the grid has more than 10,000 points")
    g = grid.select(F.col(point), *(F.col(m).alias(f"g_{m}") for m in measures))
    cost = sum((F.pow((F.col(m) - F.col(f"g_{m}")) / s, 2) for m, s in measures.items()), F.lit(0.0))
    pairs = rows.crossJoin(F.broadcast(g)).select(id_col, point, cost.alias("_d"))
    return pairs.groupBy(id_col).agg(F.min_by(point, F.struct("_d", point)).alias(point), F.min("_d").alias("distance"))


@dataclass(frozen=True)
class Geometry:
    """Radii at which a league's aim (deviation 1, offset 0) is in the middle, outside, or reversed, from the shares of each."""

    middle: float
    outside: float
    reversed: float

    def parts(self, sigma: Column, a: Column) -> dict[str, Column]:
        """Chances of middle, outside, reversed and success for an aim of deviation ``sigma`` and offset ``a``."""
        r0, r1 = (-2 * math.log(1 - self.middle)) ** 0.5, (-2 * math.log(self.outside)) ** 0.5
        limit = NormalDist().inv_cdf(self.reversed)
        offset = F.abs(a) / sigma
        middle, outside, turned = 1 - marcum_q1(offset, F.lit(r0) / sigma), marcum_q1(offset, F.lit(r1) / sigma), normal_cdf_series(F.lit(limit) / sigma)
        return {"p_mid": middle, "p_out": outside, "p_rev": turned, "p_success": 1 - middle - outside - turned}


def geometry_grid(spark: SparkSession, g: Geometry, n_sigma: int = 48, n_a: int = 64, low: float = 0.45, high: float = 2.2, most: float = 2.4) -> DataFrame:
    """(i, j, sigma, a, p): chance of success at deviations in equal steps of their logarithm and offsets in equal steps, clipped to [0, 1]."""
    i, j = F.floor(F.col("id") / n_a), F.col("id") % n_a
    d = spark.range(n_sigma * n_a).select(i.cast("int").alias("i"), j.cast("int").alias("j"))
    step = (math.log(high) - math.log(low)) / (n_sigma - 1)
    d = d.withColumns({"sigma": F.exp(F.lit(math.log(low)) + F.col("i") * step), "a": F.col("j") * (most / (n_a - 1))})
    return d.withColumn("p", F.greatest(F.lit(0.0), F.least(F.lit(1.0), g.parts(F.col("sigma"), F.col("a"))["p_success"])))


def grid_lookup(rows: DataFrame, grid: DataFrame, sigma: str, a: str, n_sigma: int = 48, n_a: int = 64, low: float = 0.45, high: float = 2.2, most: float = 2.4) -> DataFrame:
    """Adds ``p`` between the four grid points around (log sigma, a), at the grid's edge for what lies beyond. The grid is a fixed few thousand rows."""
    table = F.broadcast(grid.groupBy().agg(F.transform(F.sort_array(F.collect_list(F.struct("i", "j", "p"))), lambda x: x["p"]).alias("_g")))
    x = (F.ln(F.greatest(F.lit(low), F.least(F.lit(high), F.col(sigma)))) - math.log(low)) / (math.log(high) - math.log(low)) * (n_sigma - 1)
    y = F.greatest(F.lit(0.0), F.least(F.lit(most), F.abs(F.col(a)))) / most * (n_a - 1)
    d = rows.crossJoin(table).withColumns({"_x": x, "_y": y})
    i, j = F.least(F.floor("_x"), F.lit(n_sigma - 2)), F.least(F.floor("_y"), F.lit(n_a - 2))
    d = d.withColumns({"_i": i.cast("int"), "_j": j.cast("int")})
    fx, fy = F.col("_x") - F.col("_i"), F.col("_y") - F.col("_j")
    at = lambda k, m: F.get("_g", (F.col("_i") + k) * n_a + F.col("_j") + m)
    p = (1 - fx) * ((1 - fy) * at(0, 0) + fy * at(0, 1)) + fx * ((1 - fy) * at(1, 0) + fy * at(1, 1))
    return d.withColumn("p", p).drop("_g", "_x", "_y", "_i", "_j")
