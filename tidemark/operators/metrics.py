"""Scores, reliability, calibration, linear fits and ensemble algebra, as one-pass aggregates."""

from __future__ import annotations

from collections.abc import Callable
from itertools import combinations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.files import materialised
from .joins import on_keys
from .ordered import numbered, quantiles

SCALE = 1e5


def score_columns(y: str, p: str) -> dict[str, Column]:
    """Aggregates: n, base rate r, Brier, log loss, mean shift d, score and refinement; NULL where all outcomes are the same."""
    yy, pp = F.col(y), F.col(p)
    r, brier, d = F.avg(yy), F.avg((yy - pp) * (yy - pp)), F.avg(pp) - F.avg(yy)
    q = F.greatest(F.lit(1e-12), F.least(F.lit(1 - 1e-12), pp))
    spread = r * (1 - r)
    score = F.when(spread > 0, SCALE * (1 - brier / spread))
    return {
        "n": F.count(yy),
        "rate": r,
        "brier": brier,
        "logloss": -F.avg(yy * F.ln(q) + (1 - yy) * F.ln(1 - q)),
        "shift": d,
        "score": score,
        "refinement": F.when(spread > 0, score + SCALE * d * d / spread),
    }


def score(df: DataFrame, by: list[str] = (), y: str = "y", p: str = "p", least: int = 0) -> DataFrame:
    """The score row of each group with more than ``least`` rows and both outcomes."""
    g = df.groupBy(*by).agg(*(c.alias(n) for n, c in score_columns(y, p).items()))
    return g.filter((F.col("n") > least) & (F.col("rate") > 0) & (F.col("rate") < 1)) if least else g


def auc(df: DataFrame, by: list[str] = (), y: str = "y", p: str = "p") -> DataFrame:
    """Area under the curve by rank sums over distinct predictions: counted first, then a running sum per group.

    Predictions are counted per value before the window, so rows aren't sorted; ungrouped data has one group.
    """
    g = [*by] or [F.lit(0).alias("_g")]
    cells = df.groupBy(*g, p).agg(F.sum(y).alias("pos"), F.sum(1 - F.col(y)).alias("neg"))
    keys = [*by] or ["_g"]
    w = Window.partitionBy(*keys).orderBy(p).rowsBetween(Window.unboundedPreceding, -1)
    c = cells.withColumn("below", F.coalesce(F.sum("neg").over(w), F.lit(0)))
    a = c.groupBy(*keys).agg((F.sum(F.col("pos") * (F.col("below") + F.col("neg") / 2)) / (F.sum("pos") * F.sum("neg"))).alias("auc"))
    return a if by else a.drop("_g")


def paired_error(df: DataFrame, y: str, p: str, q: str) -> DataFrame:
    """Mean gain of q over p in score points, and its paired standard error."""
    gain = F.pow(F.col(y) - F.col(p), 2) - F.pow(F.col(y) - F.col(q), 2)
    r = F.avg(y)
    return df.agg((SCALE * F.avg(gain) / (r * (1 - r))).alias("gain"), (SCALE * F.stddev_samp(gain) / F.sqrt(F.count("*")) / (r * (1 - r))).alias("se"))


def reliability(df: DataFrame, bins: int = 15, y: str = "y", p: str = "p") -> DataFrame:
    """Non-empty equal-width bins of the prediction with count, mean prediction and rate."""
    b = F.least(F.floor(F.col(p) * bins), F.lit(bins - 1)).cast("int")
    return df.groupBy(b.alias("bin")).agg(F.count("*").alias("n"), F.avg(p).alias("mean_p"), F.avg(y).alias("rate"))


def _below(value: str, edges: list[float]) -> Column:
    """How many of the edges are less than the value."""
    return sum(((F.lit(e) < F.col(value)).cast("int") for e in edges if e is not None), F.lit(0))


def dispersion(df: DataFrame, level: str, y: str = "y", p: str = "p", parts: int = 10, least: int = 1000) -> DataFrame:
    """One row: the spread of outcomes and of predictions over quantile groups of ``level``, and their ratio.

    Less than 1 means that predictions are shrunk too far. Rows without a level don't count; NULL where fewer than ``least`` are left.
    """
    known = df.filter(F.col(level).isNotNull())
    edges = quantiles(known, level, [i / parts for i in range(1, parts)])
    g = known.groupBy(_below(level, edges).alias("_b")).agg(F.count("*").alias("n"), F.avg(y).alias("y"), F.avg(p).alias("p"))
    t = g.agg(F.sum("n").alias("n"), (F.max("y") - F.min("y")).alias("ts"), (F.max("p") - F.min("p")).alias("ps"))
    enough = lambda c: F.when(F.col("n") >= least, c)
    return t.select(enough(F.col("ts")).alias("true_spread"), enough(F.col("ps")).alias("predicted_spread"), enough(F.try_divide("ps", "ts")).alias("ratio"))


def blend_scores(df: DataFrame, weights: dict[str, dict[str, float]], y: str = "y", level: float | None = None) -> DataFrame:
    """(blend, score, base, gain) of weighted means of models, from the models' scores and their distances alone.

    A blend's score is the weighted mean of its members' (``base``) plus the gain of disagreement: 1e5 / (2 r (1 - r)) times
    the sum over pairs of both weights and their mean squared difference. r is the mean of y, or ``level``. One pass over rows.
    """
    models = sorted({m for w in weights.values() for m in w})
    pairs = [(a, b) for i, a in enumerate(models) for b in models[i + 1 :]]
    row = df.agg(F.avg(y).alias("r"), *(F.avg(F.pow(F.col(y) - F.col(m), 2)).alias(f"b_{m}") for m in models), *(F.avg(F.pow(F.col(a) - F.col(b), 2)).alias(f"d_{a}_{b}") for a, b in pairs)).first()
    r = row["r"] if level is None else level
    out = []
    for name, w in weights.items():
        total = sum(w.values())
        base = sum(v / total * SCALE * (1 - row[f"b_{m}"] / (r * (1 - r))) for m, v in w.items())
        gain = SCALE / (r * (1 - r)) * sum(w.get(a, 0) * w.get(b, 0) / total**2 * row[f"d_{a}_{b}"] for a, b in pairs)
        out.append((name, base + gain, base, gain))
    return df.sparkSession.createDataFrame(out, "blend string, score double, base double, gain double")


def unknown_member_score(blend_score: float, known: dict[str, tuple[float, float]], distances: dict[tuple[str, str], float], name: str, r: float) -> float:
    """The score of the one member that wasn't measured: what it must be for the blend to have its score.

    ``known`` has weight and score of each other member (the rest of the weight is the unknown one's); ``distances`` the mean
    squared difference of every pair.
    """
    w = {m: v for m, (v, _) in known.items()}
    w[name] = 1 - sum(w.values())
    if w[name] <= 0:
        raise ValueError("no weight is left for the unknown member")
    gain = SCALE / (r * (1 - r)) * sum(w[a] * w[b] * distances.get((a, b), distances.get((b, a), 0.0)) for i, a in enumerate(w) for b in list(w)[i + 1 :])
    return (blend_score - gain - sum(v * s for v, s in known.values())) / w[name]


def fit_pieces(df: DataFrame, knots: list[float], y: str = "y", p: str = "p") -> tuple[dict[str, float], bool]:
    """Least-squares weights of 1, p and max(p - knot, 0) for each knot, and whether every slope is positive. One pass over rows."""
    basis = {"one": F.lit(1.0), "p": F.col(p), **{f"k{i}": F.greatest(F.col(p) - k, F.lit(0.0)) for i, k in enumerate(knots)}}
    g = gram(df.select(*(c.alias(n) for n, c in basis.items()), F.col(y).cast("double").alias("y")), [*basis, "y"])
    weights = np.linalg.lstsq(g[:-1, :-1], g[:-1, -1], rcond=None)[0]
    return dict(zip(basis, map(float, weights), strict=True)), bool((np.cumsum(weights[1:]) > 0).all())


def apply_pieces(weights: dict[str, float], knots: list[float], p: Column) -> Column:
    out = F.lit(weights["one"]) + weights["p"] * p
    for i, k in enumerate(knots):
        out = out + weights[f"k{i}"] * F.greatest(p - k, F.lit(0.0))
    return F.greatest(F.lit(1e-6), F.least(F.lit(1 - 1e-6), out))


def brier_parts(df: DataFrame, bins: int = 10, y: str = "y", p: str = "p") -> DataFrame:
    """Reliability, resolution and uncertainty over quantile bins."""
    edges = quantiles(df, p, [i / bins for i in range(1, bins)])
    b = df.withColumn("_b", _below(p, edges))
    g = b.groupBy("_b").agg(F.count("*").alias("n"), F.avg(p).alias("mp"), F.avg(y).alias("my"))
    t = g.agg(F.sum("n").alias("all_n"), (F.sum(F.col("n") * F.col("my")) / F.sum("n")).alias("r"))
    j = g.crossJoin(F.broadcast(t))
    w = F.col("n") / F.col("all_n")
    return j.agg(F.sum(w * F.pow(F.col("mp") - F.col("my"), 2)).alias("rel"), F.sum(w * F.pow(F.col("my") - F.col("r"), 2)).alias("res"), F.max(F.col("r") * (1 - F.col("r"))).alias("unc"))


def affine(df: DataFrame, by: list[str] = (), y: str = "y", p: str = "p") -> DataFrame:
    """Least-squares slope and intercept of y over p."""
    return df.groupBy(*by).agg(F.regr_slope(y, p).alias("slope"), F.regr_intercept(y, p).alias("intercept"))


def affine_clip(p: Column, slope: float, shift: float, centre: float = 0.5) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), centre + slope * (p - centre) + shift))


def affine_grid(df: DataFrame, slopes: list[float], shifts: list[float], y: str = "y", p: str = "p", centre: float = 0.5) -> DataFrame:
    """Brier of every (slope, shift) on a grid, from sufficient statistics of one pass (unclipped)."""
    a = F.col(p) - centre
    s = df.agg(F.count("*").alias("n"), F.sum(a).alias("a"), F.sum(a * a).alias("aa"), F.sum(F.col(y) - centre).alias("b"), F.sum(F.pow(F.col(y) - centre, 2)).alias("bb"), F.sum(a * (F.col(y) - centre)).alias("ab"))
    grid = F.explode(F.array(*(F.struct(F.lit(float(m)).alias("slope"), F.lit(float(c)).alias("shift")) for m in slopes for c in shifts)))
    g = s.select("*", grid.alias("g")).select("*", "g.slope", "g.shift")
    m, c, n = F.col("slope"), F.col("shift"), F.col("n")
    total = F.col("bb") + m * m * F.col("aa") + n * c * c - 2 * m * F.col("ab") - 2 * c * F.col("b") + 2 * m * c * F.col("a")
    return g.select("slope", "shift", (total / n).alias("brier"))


def gram(df: DataFrame, columns: list[str]) -> np.ndarray:
    """Sums of products of all pairs of columns, in one aggregation; the matrix is as large as the number of columns squared."""
    pairs = [(i, j) for i in range(len(columns)) for j in range(i, len(columns))]
    row = df.agg(*(F.sum(F.col(columns[i]) * F.col(columns[j])).alias(f"g{i}_{j}") for i, j in pairs)).first()
    g = np.zeros((len(columns), len(columns)))
    for (i, j), v in zip(pairs, row, strict=True):
        g[i, j] = g[j, i] = v or 0.0
    return g


def ridge(df: DataFrame, x: list[str], y: str, lam: float) -> dict[str, float]:
    """Ridge weights from the Gram matrix of columns scaled by their deviation; the appended intercept is penalised too."""
    d = df.withColumn("_one", F.lit(1.0))
    sd = d.agg(*(F.stddev_pop(c).alias(c) for c in x)).first()
    scaled = d.select(*((F.col(c) / (sd[c] or 1.0)).alias(c) for c in x), "_one", F.col(y).cast("double").alias("_y"))
    g = gram(scaled, [*x, "_one", "_y"])
    k = len(x) + 1
    w = np.linalg.solve(g[:k, :k] + lam * np.eye(k), g[:k, k])
    return {c: float(w[i] / (sd[c] or 1.0)) for i, c in enumerate(x)} | {"intercept": float(w[-1])}


def linear(weights: dict[str, float]) -> Column:
    return sum((F.col(c) * v for c, v in weights.items() if c != "intercept"), F.lit(weights.get("intercept", 0.0)))


def orthogonalise(df: DataFrame, block: list[str], on: list[str], fit: Column) -> DataFrame:
    """The block's columns less what ``on`` explains of them on the fit rows."""
    rows = df.filter(fit).withColumn("_one", F.lit(1.0))
    base = [*on, "_one"]
    g = gram(rows, [*base, *block])
    k = len(base)
    w = np.linalg.lstsq(g[:k, :k], g[:k, k:], rcond=None)[0]
    less = {c: F.col(c) - sum((F.col(b) * float(w[i, j]) for i, b in enumerate(on)), F.lit(float(w[k - 1, j]))) for j, c in enumerate(block)}
    return df.withColumns(less)


def model_distances(df: DataFrame, models: list[str]) -> DataFrame:
    """Root mean squared difference and correlation of every pair of prediction columns, in one pass."""
    pairs = list(combinations(models, 2))
    aggs = [F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.sqrt(F.avg(F.pow(F.col(a) - F.col(b), 2))).alias("rms"), F.corr(a, b).alias("corr")) for a, b in pairs]
    return df.agg(F.array(*aggs).alias("m")).select(F.explode("m").alias("m")).select("m.*")


def blend(weights: dict[str, float]) -> Column:
    """Weighted mean of the predictions that are there; NULL if none is."""
    top = sum((F.when(F.col(c).isNotNull(), F.col(c) * w).otherwise(0.0) for c, w in weights.items()), F.lit(0.0))
    bottom = sum((F.when(F.col(c).isNotNull(), F.lit(float(w))).otherwise(0.0) for c, w in weights.items()), F.lit(0.0))
    return F.when(bottom > 0, top / bottom)


def subset_blends(df: DataFrame, models: list[str], most: int, y: str = "y") -> DataFrame:
    """Brier of every equal-weight blend of up to ``most`` models, from the Gram matrix of errors: rows are read once."""
    errors = df.select(*((F.col(m) - F.col(y)).alias(m) for m in models))
    g, n = gram(errors, models), df.count()
    rows = []
    for k in range(1, most + 1):
        for s in combinations(range(len(models)), k):
            w = np.zeros(len(models))
            w[list(s)] = 1 / k
            rows.append((",".join(models[i] for i in s), k, float(w @ g @ w / n)))
    return df.sparkSession.createDataFrame(rows, "models string, size int, brier double")


def greedy_selection(df: DataFrame, models: list[str], rounds: int, y: str = "y") -> DataFrame:
    """Forward selection with replacement: each round adds the model that lowers the blend's Brier most."""
    errors = df.select(*((F.col(m) - F.col(y)).alias(m) for m in models))
    g, n = gram(errors, models), df.count()
    total, out = np.zeros(len(models)), []
    for r in range(1, rounds + 1):
        tries = [((total + e) @ g @ (total + e) / (r * r * n), i) for i, e in enumerate(np.eye(len(models)))]
        best, i = min(tries)
        total[i] += 1
        out.append((r, models[i], float(best)))
    return df.sparkSession.createDataFrame(out, "round int, model string, brier double")


def folds(seasons: list[int], gap: int = 0) -> list[dict[str, list[int]]]:
    """Forward folds: fit on older seasons, calibrate on the last before, score on the next."""
    out = []
    for i in range(2, len(seasons)):
        fit = seasons[: i - 1 - gap]
        if fit:
            out.append({"fit": fit, "cal": [seasons[i - 1]], "val": [seasons[i]]})
    return out


def with_roles(df: DataFrame, fold_list: list[dict[str, list[int]]], season: str = "season") -> DataFrame:
    """Rows with (fold, role): one copy for each fold that uses their season. The fold table is a few rows."""
    rows = [(i, role, s) for i, f in enumerate(fold_list) for role, ss in f.items() for s in ss]
    table = df.sparkSession.createDataFrame(rows, f"fold int, role string, {season} int")
    return df.join(F.broadcast(table), season)


def placebo_swap(profile: DataFrame, entity: str, seed: int = 5, by: list[str] = ()) -> DataFrame:
    """The profile with entities permuted (within ``by``): each entity gets the whole history of one other, so coverage stays.

    The permutation pairs entities in id order with entities in hash order; both are over distinct entities.
    """
    e = profile.select(*by, entity).distinct()
    key = F.xxhash64(entity, F.lit(seed))
    # Groups are consecutive in both orders, so numbers over the whole table pair entities of one group.
    a = numbered(e, [*by, entity], "_r")
    b = numbered(e, [*by, key, entity], "_r").select("_r", F.col(entity).alias("_to"))
    swap = a.join(b, "_r").drop("_r")
    return on_keys(profile, swap, [*by, entity]).drop(entity).withColumnRenamed("_to", entity)


def successive_halving(score: Callable[[DataFrame, list[int]], DataFrame], arms: DataFrame, fold_list: list[int], anchor: str, keep: float = 0.6) -> DataFrame:
    """(arm, loss, folds, delta, beats): the latest fold screens all arms, the best ``keep`` of them and the anchor are scored on all folds.

    ``score(arms, folds)`` gives (arm, fold, loss). Arms (arm, ...) are few; ties go to the smaller name. ``delta`` is an arm's mean loss less the
    anchor's, and it ``beats`` the anchor where that is below -1e-4.
    """
    first = score(arms, fold_list[-1:])
    order = Window.orderBy("loss", "arm")  # a row for each arm
    alive = materialised(first.withColumns({"_r": F.row_number().over(order), "_n": F.count("*").over(Window.partitionBy())}).filter((F.col("_r") <= F.ceil(F.lit(keep) * F.col("_n"))) | (F.col("arm") == anchor)).select("arm"))
    final = score(arms.join(F.broadcast(alive), "arm"), fold_list).groupBy("arm").agg(F.avg("loss").alias("loss"), F.count("*").alias("folds"))
    at = final.filter(F.col("arm") == anchor).select(F.col("loss").alias("_anchor"))
    d = final.crossJoin(F.broadcast(at)).withColumn("delta", F.col("loss") - F.col("_anchor"))
    return d.select("arm", "loss", "folds", "delta", (F.col("delta") < -1e-4).alias("beats"))
