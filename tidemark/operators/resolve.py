"""Entity resolution between two id spaces: costs of signatures, one-to-one assignment, tiers and checks."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.files import discard
from .bidding import Pricing, matched, wide
from .joins import block_pairs, mutual_nearest
from .ordered import numbered, quantiles


def _signature(hist: str, bins: int, rank: str, weight: float) -> tuple[list, Callable]:
    """Measures of a signature, and the cost of two: rank difference plus weight * sqrt(1 - overlap of the histograms)."""

    def cost(x: np.ndarray, y: np.ndarray) -> np.ndarray:
        overlap = np.sqrt(x[1] * y[1])
        for i in range(2, bins + 1):
            overlap = overlap + np.sqrt(x[i] * y[i])
        return np.abs(x[0] - y[0]) + weight * np.sqrt(np.maximum(0.0, 1 - overlap))

    return [F.col(rank), *(F.col(hist)[i] for i in range(bins))], cost


def signature_cost(a: DataFrame, b: DataFrame, within: list[str], period: str, entity: str = "entity", rank: str = "pct", hist: str = "hist", bins: int = 2, weight: float = 0.5) -> DataFrame:
    """(within, a, b, cost, blocks): over common periods, rank difference plus weight * sqrt(1 - overlap of histograms of ``bins`` bins); see ``block_pairs``."""
    measures, cost = _signature(hist, bins, rank, weight)
    names = [f"_h{i}" for i in range(len(measures))]
    flat = lambda d: d.select(*within, period, entity, *(m.alias(c) for m, c in zip(measures, names, strict=True)))
    return block_pairs(flat(a), flat(b), within, period, entity, entity, names, cost)


def assigned(a: DataFrame, b: DataFrame, within: list[str], period: str, entity: str = "entity", rank: str = "pct", hist: str = "hist", bins: int = 2, weight: float = 0.5, tolerance: float = 0.25) -> DataFrame:
    """(within, a, b, cost): one-to-one pairs by ``signature_cost``, within ``tolerance`` of the least total; pairs aren't written (see ``bidding.matched``)."""
    measures, cost = _signature(hist, bins, rank, weight)
    p = Pricing(lambda x, y: [cost(x, y)], np.ones((1, 1)), [None])
    sides = [wide(d, within, period, entity, measures) for d in (a, b)]
    found = matched(*sides, within, p, tolerance)
    discard(*sides)
    return found.select(*within, "a", "b", "cost")


def tiers(pairs: DataFrame, margin: float) -> DataFrame:
    """Each a's cheapest b with its margin, and a tier: 1 if b agrees and the margin is wide, 2 if either, 3 otherwise."""
    w = Window.partitionBy("a").orderBy("cost", "b")
    best = pairs.withColumns({"r": F.row_number().over(w), "margin": F.lead("cost").over(w) - F.col("cost")}).filter("r = 1")
    agree = mutual_nearest(pairs).select("a", "b", F.lit(True).alias("agree"))
    d = best.join(agree, ["a", "b"], "left").withColumn("agree", F.coalesce("agree", F.lit(False)))
    wide = F.coalesce(F.col("margin") >= margin, F.lit(False))
    return d.withColumn("tier", F.when(F.col("agree") & wide, 1).when(F.col("agree") | wide, 2).otherwise(3))


def soft_top_k(pairs: DataFrame, k: int, tau: float) -> DataFrame:
    """The k cheapest candidates of each a with weights w in proportion to exp(-cost / tau)."""
    w = Window.partitionBy("a")
    d = pairs.withColumn("r", F.row_number().over(w.orderBy("cost", "b"))).filter(F.col("r") <= k)
    d = d.withColumn("e", F.exp(-(F.col("cost") - F.min("cost").over(w)) / tau))
    return d.withColumn("w", F.col("e") / F.sum("e").over(w)).drop("e")


def permutation_test(pairs: DataFrame, trait_a: str, trait_b: str, key: str, replicates: int, seed: int = 11, block: list[str] = ()) -> DataFrame:
    """Agreement of two traits over pairs, against agreement when the second is permuted within blocks; one row with z.

    A replicate's permutation is the order of a seeded hash: no state, the same at any partitioning. Pairs are
    numbered over range partitions, in their own order and in each replicate's, and the two joined by number, so
    that no task holds all pairs; blocks are consecutive in both orders.
    """
    base = numbered(pairs.select(*block, key, trait_a, trait_b), [*block, key], "_i").select("_i", *block, F.col(key).alias("_key"), F.col(trait_a).alias("_a"), F.col(trait_b).alias("_b"))
    n = base.count()
    reps = F.explode(F.sequence(F.lit(0), F.lit(replicates - 1))).alias("rep")
    many = base.select("_key", *block, "_b", reps)
    shuffled = numbered(many, ["rep", *block, F.xxhash64("_key", "rep", F.lit(seed)), "_key"], "_j").select("rep", (F.col("_j") - F.col("rep").cast("long") * n).alias("_i"), F.col("_b").alias("_other"))
    rates = shuffled.join(base.select("_i", "_a"), "_i").groupBy("rep").agg(F.avg((F.col("_a") == F.col("_other")).cast("int")).alias("rate"))
    null = rates.agg(F.avg("rate").alias("mean"), F.stddev_samp("rate").alias("sd"))
    own = pairs.agg(F.avg((F.col(trait_a) == F.col(trait_b)).cast("int")).alias("agreement"))
    return own.crossJoin(null).select("agreement", "mean", "sd", F.try_divide(F.col("agreement") - F.col("mean"), "sd").alias("z"))


def antimode(df: DataFrame, value: str, points: int) -> DataFrame:
    """One row: the least dense of ``points`` grid values between the two densest parts of a Gaussian kernel estimate, else the lower quartile.

    Values are binned to the grid first, so the kernel runs over the grid (points squared), not over rows.
    """
    s = df.agg(F.min(value).alias("lo"), F.max(value).alias("hi"), F.stddev_pop(value).alias("sd"), F.count(value).alias("n")).first().asDict()
    s["q"] = quantiles(df, value, [0.25])[0]
    spark = df.sparkSession
    if not s["n"] or not s["sd"]:
        return spark.createDataFrame([(s["q"], False)], "threshold double, bimodal boolean")
    step = (s["hi"] - s["lo"]) / (points - 1)
    counts = {r["c"]: r["n"] for r in df.groupBy(F.rint((F.col(value) - s["lo"]) / step).cast("int").alias("c")).agg(F.count("*").alias("n")).filter("c IS NOT NULL").collect()}
    width = 1.06 * s["sd"] * s["n"] ** -0.2
    grid = s["lo"] + step * np.arange(points)
    mass = np.array([counts.get(i, 0) for i in range(points)], float)
    density = np.exp(-0.5 * ((grid[:, None] - grid[None, :]) / width) ** 2) @ mass
    peaks = [i for i in range(points) if density[i] == density[max(0, i - 1) : i + 2].max() and density[i] > 0.05 * density.max()]
    if len(peaks) < 2:
        return spark.createDataFrame([(s["q"], False)], "threshold double, bimodal boolean")
    a, b = sorted(sorted(peaks, key=lambda i: -density[i])[:2])
    return spark.createDataFrame([(float(grid[a + int(np.argmin(density[a : b + 1]))]), True)], "threshold double, bimodal boolean")


def set_score(pairs: DataFrame, a: DataFrame, b: DataFrame, block: list[str], entity: str, key: str, size: str, order: str, scale: float = 10.0) -> DataFrame:
    """(a, b, block, score): how much of b's sessions in a block is found among a's.

    In order, each session of b takes the nearest unused one of a with the same ``key``, if sizes differ by less than ``scale``; a
    match counts 1 - difference / scale, and the score is their sum over the number of b's sessions. Pairs are candidates
    (a, b); a block without sessions of either has no row. An entity's sessions in a block are one array, so the
    matching is an expression over two arrays and no group is gathered beyond them.
    """

    def sets(d: DataFrame, s: str) -> DataFrame:
        rows = F.sort_array(F.collect_list(F.struct(F.col(order).alias("o"), F.col(key).alias("key"), F.col(size).cast("double").alias("n"))))
        return d.groupBy(F.col(entity).alias(s), *block).agg(rows.alias(f"set_{s}"))

    def take(acc: Column, y: Column) -> Column:
        gain = F.transform(acc["free"], lambda x: F.when(x["key"] == y["key"], F.greatest(F.lit(0.0), 1 - F.abs(x["n"] - y["n"]) / scale)).otherwise(0.0))
        best = F.coalesce(F.array_max(gain), F.lit(0.0))
        at = F.array_position(gain, best).cast("int")
        left = F.filter(acc["free"], lambda x, i: i != at - 1)
        return F.struct(F.when(best > 0, left).otherwise(acc["free"]).alias("free"), (acc["total"] + best).alias("total"))

    j = pairs.select("a", "b").join(sets(a, "a"), "a").join(sets(b, "b"), ["b", *block])
    start = F.struct(F.col("set_a").alias("free"), F.lit(0.0).alias("total"))
    return j.select("a", "b", *block, (F.aggregate("set_b", start, take)["total"] / F.size("set_b")).alias("score"))
