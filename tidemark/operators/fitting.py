"""Fits over aggregated statistics: isotonic maps, bounded recalibration, stacking, canonical correlations, mixtures, one-hot members."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import logit, sigmoid
from ..sources.files import discard, materialised
from .metrics import gram
from .ordered import numbered, quantiles

EPS = 1e-6

# ---------------------------------------------------------------- isotonic


def _pool(cells: pd.DataFrame, open_pools: list[list[float]]) -> None:
    """Adds ordered cells (lo, hi, n, s) to the pools, and merges as long as a pool's rate isn't above that of the one before."""
    for lo, hi, n, s in zip(cells["lo"], cells["hi"], cells["n"], cells["s"], strict=True):
        at = [lo, hi, n, s]
        while open_pools and open_pools[-1][3] * at[2] >= at[3] * open_pools[-1][2]:
            before = open_pools.pop()
            at = [before[0], at[1], before[2] + at[2], before[3] + at[3]]
        open_pools.append(at)


def isotonic_pools(df: DataFrame, y: str = "y", p: str = "p") -> DataFrame:
    """(lo, hi, n, rate): the least-squares non-decreasing step map of y over p, exact over all distinct values.

    Values are counted and pooled within range partitions, each in order of its rows. Partitions whose neighbouring pools still
    violate the order are pooled together, again and again until none does. Rows with a null are left out; NaN counts as null.

    Scale: a task holds the pools of its partition, later those of a chain of violating neighbours, which are few because
    pooling has merged what falls.
    """
    v, label = F.col(p).cast("double"), F.col(y).cast("double")
    cells = df.filter(v.isNotNull() & label.isNotNull() & ~F.isnan(v) & ~F.isnan(label)).groupBy(v.alias("lo")).agg(F.count("*").alias("n"), F.sum(label).alias("s"))

    def within(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        pools: list[list[float]] = []
        for batch in batches:
            _pool(batch, pools)
        out = pd.DataFrame(pools, columns=["lo", "hi", "n", "s"])
        out.insert(0, "part", TaskContext.get().partitionId())
        yield out

    def together(chain: pd.DataFrame) -> pd.DataFrame:
        pools: list[list[float]] = []
        _pool(chain.sort_values("lo"), pools)
        out = pd.DataFrame(pools, columns=["lo", "hi", "n", "s"])
        out.insert(0, "part", int(chain["part"].min()))
        return out

    schema = "part long, lo double, hi double, n double, s double"
    ordered = cells.repartitionByRange("lo").sortWithinPartitions("lo").select("lo", F.col("lo").alias("hi"), F.col("n").cast("double").alias("n"), "s")
    pools = materialised(ordered.mapInPandas(within, schema))
    while True:
        rate = F.col("s") / F.col("n")
        ends = pools.groupBy("part").agg(F.min_by(rate, "lo").alias("first"), F.max_by(rate, "lo").alias("last"))
        w = Window.orderBy("part")  # a row for each partition
        falls = F.coalesce(F.lag("last").over(w) >= F.col("first"), F.lit(False))
        ends = materialised(ends.withColumn("falls", falls).withColumn("chain", F.sum((~F.col("falls")).cast("int")).over(w)).select("part", "falls", "chain"))
        if ends.filter("falls").isEmpty():
            discard(ends)
            return pools.select("lo", "hi", F.col("n").cast("long").alias("n"), rate.alias("rate"))
        chained = pools.join(ends, "part")
        long = ends.groupBy("chain").count().filter("count > 1").select("chain")
        merged = chained.join(long, "chain", "left_semi").groupBy("chain").applyInPandas(lambda g: together(g), schema)
        now = materialised(merged.unionByName(chained.join(long, "chain", "left_anti").select("part", "lo", "hi", "n", "s")))
        discard(pools, ends)
        pools = now


def isotonic_apply(df: DataFrame, pools: DataFrame, p: str = "p", out: str = "c", buckets: int = 1024) -> DataFrame:
    """Adds the isotonic map's value at ``p``: a pool's rate within it, on the line between two pools, at the ends their rates.

    Pieces of the map and rows are joined by equal slices of [0, 1] that they are in, so a map of any number of pools does; values
    outside count as the nearest end. A null value gives a null.
    """
    at = numbered(pools.select("lo", "hi", "rate"), ["lo"], "i")
    after = at.select((F.col("i") - 1).alias("i"), F.col("lo").alias("next_lo"), F.col("rate").alias("next"))
    piece = at.join(after, "i", "left")
    inf = F.lit(float("inf"))
    lo = F.when(F.col("i") == 1, -inf).otherwise(F.col("lo"))
    pieces = piece.select(lo.alias("from"), F.coalesce("next_lo", inf).alias("to"), "hi", "rate", "next_lo", "next")
    slice_of = lambda c: F.floor(F.greatest(F.lit(0.0), F.least(F.lit(1.0), c)) * buckets).cast("int")
    pieces = pieces.withColumn("_slice", F.explode(F.sequence(slice_of(F.col("from")), slice_of(F.col("to")))))
    v = F.col(p)
    rows = df.withColumn("_slice", slice_of(v))
    j = rows.join(pieces, (rows["_slice"] == pieces["_slice"]) & (v >= F.col("from")) & (v < F.col("to")), "left")
    line = F.col("rate") + (F.col("next") - F.col("rate")) * (v - F.col("hi")) / (F.col("next_lo") - F.col("hi"))
    return j.select(*(rows[c] for c in df.columns), F.when((v <= F.col("hi")) | F.col("next").isNull(), F.col("rate")).otherwise(line).alias(out))


def prior_shift(p: Column, fit_rate: float, now_rate: float) -> Column:
    """A probability moved by the difference of two base rates' logits."""
    clip = lambda x: min(max(x, EPS), 1 - EPS)
    off = np.log(clip(now_rate) / (1 - clip(now_rate))) - np.log(clip(fit_rate) / (1 - clip(fit_rate)))
    return sigmoid(logit(F.greatest(F.lit(EPS), F.least(F.lit(1 - EPS), p))) + F.lit(float(off)))


# ---------------------------------------------------------------- squared error of a sigmoid


def bounded_sigmoid_fit(df: DataFrame, x: Sequence[str], y: str, start: Sequence[float], bounds: Sequence[tuple[float, float]], ridge: float = 0.0, steps: int = 60, tolerance: float = 1e-12) -> tuple[np.ndarray, float]:
    """Weights w within bounds for the least mean of (y - sigmoid(x w))^2 + ridge |w|^2 / rows, and that mean.

    Projected, damped Gauss-Newton: one aggregation a step gives the loss, the gradient and the Gauss-Newton matrix at a trial
    point; weights at a bound that the gradient pushes against are held. No row is rounded or binned.
    """
    k = len(x)
    low, high = np.array([b[0] for b in bounds], float), np.array([b[1] for b in bounds], float)
    pairs = [(i, j) for i in range(k) for j in range(i, k)]
    label = F.col(y).cast("double")

    def at(w: np.ndarray) -> tuple[float, np.ndarray, np.ndarray, int]:
        s = sigmoid(sum((F.lit(float(v)) * F.col(c) for c, v in zip(x, w, strict=True)), F.lit(0.0)))
        d = df.select(*x, (s - label).alias("_r"), (s * (1 - s)).alias("_j"))
        j2 = F.col("_j") * F.col("_j")
        sums = [F.count("*"), F.sum(F.col("_r") * F.col("_r")), *(F.sum(F.col("_r") * F.col("_j") * F.col(c)) for c in x), *(F.sum(j2 * F.col(x[i]) * F.col(x[j])) for i, j in pairs)]
        row = d.agg(*(c.alias(f"s{i}") for i, c in enumerate(sums))).first()
        n = row[0]
        if not n:
            return 0.0, np.zeros(k), np.eye(k), 0
        h = np.zeros((k, k))
        for (i, j), v in zip(pairs, row[2 + k :], strict=True):
            h[i, j] = h[j, i] = v / n
        return row[1] / n + ridge * float(w @ w) / n, np.array(row[2 : 2 + k]) / n + ridge * w / n, h + ridge * np.eye(k) / n, n

    w, damping = np.clip(np.array(start, float), low, high), 1e-6
    loss, g, h, n = at(w)
    for _ in range(steps if n else 0):
        free = ~(((w <= low) & (g > 0)) | ((w >= high) & (g < 0)))
        if not free.any() or np.abs(g[free]).max() < 1e-12:
            break
        step = np.zeros(k)
        hf = h[np.ix_(free, free)]
        step[free] = np.linalg.solve(hf + damping * (np.trace(hf) / free.sum() + 1e-12) * np.eye(free.sum()), -g[free])
        trial = np.clip(w + step, low, high)
        found = at(trial)
        if found[0] < loss:
            small = loss - found[0] < tolerance
            w, (loss, g, h, n), damping = trial, found, max(damping / 10, 1e-9)
            if small:
                break
        elif damping > 1e6:
            break
        else:
            damping *= 10
    return w, float(loss)


#: Bounds of intercept, slope, entity term and level term: the model's own logit keeps a fifth of its weight at least.
BOUNDS = ((-0.5, 0.5), (0.2, 3.0), (-2.0, 2.0), (-3.0, 3.0))


def recalibration_design(df: DataFrame, z_centre: float, t_centre: float, p: str = "p", z: str = "z", t: str = "t", y: str = "y") -> DataFrame:
    """(one, x0, xz, xt, y): the logit of p, and z and t less their centres; a null or NaN is at the centre."""
    centred = lambda c, m: F.coalesce(F.nanvl(F.col(c).cast("double"), F.lit(None).cast("double")), F.lit(m)) - F.lit(m)
    clipped = F.greatest(F.lit(EPS), F.least(F.lit(1 - EPS), F.col(p)))
    return df.select(F.lit(1.0).alias("one"), logit(clipped).alias("x0"), centred(z, z_centre).alias("xz"), centred(t, t_centre).alias("xt"), F.col(y).cast("double").alias("y"))


def recalibrate(batches: Sequence[tuple[DataFrame, float, float]], bounds: Sequence[tuple[float, float]] = BOUNDS) -> dict[str, float]:
    """a, b, c, d of sigmoid(a + b logit(p) + c (z - z_centre) + d (t - t_centre)) with the least Brier, and that Brier.

    Each batch (rows, z_centre, t_centre) is centred by its own constants; several are pooled, and the last one's centres are those to apply.
    """
    designs = [recalibration_design(*b) for b in batches]
    pooled = designs[0]
    for d in designs[1:]:
        pooled = pooled.unionByName(d)
    kept = materialised(pooled)
    w, loss = bounded_sigmoid_fit(kept, ["one", "x0", "xz", "xt"], "y", [0.0, 1.0, 0.0, 0.0], bounds)
    discard(kept)
    return dict(zip("abcd", map(float, w), strict=True)) | {"z_centre": batches[-1][1], "t_centre": batches[-1][2], "brier": loss}


def recalibrated(params: dict[str, float], p: Column, z: Column, t: Column, level: float = 0.0) -> Column:
    centred = lambda c, m: F.coalesce(F.nanvl(c.cast("double"), F.lit(None).cast("double")), F.lit(m)) - F.lit(m)
    clipped = F.greatest(F.lit(EPS), F.least(F.lit(1 - EPS), p))
    return sigmoid(params["a"] + params["b"] * logit(clipped) + params["c"] * centred(z, params["z_centre"]) + params["d"] * centred(t, params["t_centre"]) + level)


def one_hot_member(df: DataFrame, categories: Sequence[str], y: str = "y", ridge: float = 1.0, steps: int = 12, most: int = 5000) -> DataFrame:
    """(column, value, weight): a sigmoid over one-hot columns and an intercept (``column`` null), least squared error, ridge on all but the intercept.

    Equal rows are one cell with counts, so each step reads cells. The Gauss-Newton matrix is sparse: a cell adds to the pairs of its own
    values only, summed before they come to the driver. Values are levels of a model and at most ``most`` of them, checked.
    """
    spark = df.sparkSession
    cells = df.groupBy(*categories).agg(F.count("*").cast("double").alias("n"), F.sum(F.col(y).cast("double")).alias("s"))
    long = cells.select(F.explode(F.array(*(F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("value")) for c in categories))).alias("x")).select("x.*").distinct()
    levels = sorted(((r["column"], r["value"]) for r in long.limit(most + 1).collect()), key=str)
    if len(levels) > most:
        raise ValueError(f"more than {most} levels")
    place = {lv: i + 1 for i, lv in enumerate(levels)}
    codes = spark.createDataFrame([(c, v, i) for (c, v), i in place.items()], "column string, value string, i int")
    d = cells
    for c in categories:
        d = d.join(F.broadcast(codes.filter(F.col("column") == c).select(F.col("value").alias(f"_v_{c}"), F.col("i").alias(f"_i_{c}"))), F.col(c).cast("string").eqNullSafe(F.col(f"_v_{c}")))
    kept = materialised(d.select(F.array(F.lit(0), *(F.col(f"_i_{c}") for c in categories)).alias("on"), "n", "s"))
    total = kept.agg(F.sum("n"), F.sum("s")).first()
    k = len(levels) + 1
    w = np.zeros(k)
    rate = min(max((total[1] or 0) / (total[0] or 1), EPS), 1 - EPS)
    w[0] = np.log(rate / (1 - rate))
    penalty = np.full(k, ridge)
    penalty[0] = 0.0

    def at(w: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
        table = F.lit([float(v) for v in w])
        z = F.aggregate("on", F.lit(0.0), lambda acc, i: acc + F.get(table, i))
        d = kept.withColumn("m", sigmoid(z)).withColumn("j", F.col("m") * (1 - F.col("m")))
        # A cell of n rows with s ones adds n m^2 - 2 s m + s to the squared error.
        loss = d.agg(F.sum(F.col("n") * F.col("m") * F.col("m") - 2 * F.col("s") * F.col("m") + F.col("s"))).first()[0] or 0.0
        pair = d.select((F.col("n") * F.col("j") * F.col("j")).alias("h"), ((F.col("n") * F.col("m") - F.col("s")) * F.col("j")).alias("g"), "on", F.explode("on").alias("a"))
        pair = pair.select("h", "g", "a", F.explode("on").alias("b")).filter("a <= b").groupBy("a", "b").agg(F.sum("h").alias("h"), F.sum("g").alias("g"))
        hess, grad = np.zeros((k, k)), np.zeros(k)
        for r in pair.collect():
            hess[r["a"], r["b"]] = hess[r["b"], r["a"]] = r["h"]
            if r["a"] == r["b"]:
                grad[r["a"]] = r["g"]
        return loss + float(penalty @ (w * w)), grad + penalty * w, hess + np.diag(penalty)

    loss, g, h = at(w)
    damping = 1e-6
    for _ in range(steps):
        trial = w - np.linalg.solve(h + damping * np.eye(k), g)
        found = at(trial)
        if found[0] < loss:
            done = loss - found[0] < 1e-12 * max(1.0, loss)
            w, (loss, g, h), damping = trial, found, max(damping / 10, 1e-9)
            if done:
                break
        else:
            damping *= 100
    discard(kept)
    rows = [(None, None, float(w[0]))] + [(c, v, float(w[i])) for (c, v), i in place.items()]
    return spark.createDataFrame(rows, "column string, value string, weight double")


# ---------------------------------------------------------------- linear algebra on Gram matrices


def grams_by(df: DataFrame, by: Sequence[str], columns: Sequence[str]) -> dict[tuple, np.ndarray]:
    """The Gram matrix of the columns for each group, from one aggregation; the groups are few."""
    pairs = [(i, j) for i in range(len(columns)) for j in range(i, len(columns))]
    out = {}
    for row in df.groupBy(*by).agg(*(F.sum(F.col(columns[i]) * F.col(columns[j])).alias(f"g{i}_{j}") for i, j in pairs)).collect():
        g = np.zeros((len(columns), len(columns)))
        for (i, j), v in zip(pairs, row[len(by) :], strict=True):
            g[i, j] = g[j, i] = v or 0.0
        out[tuple(row[: len(by)])] = g
    return out


def _solve(g: np.ndarray, on: list[int], y: int, lam: float) -> np.ndarray:
    return np.linalg.solve(g[np.ix_(on, on)] + lam * np.eye(len(on)), g[on, y])


def stack_by_blocks(df: DataFrame, members: dict[str, list[str]], y: str, season: str, block: str, lams: Sequence[float], member_lam: float = 1.0) -> tuple[DataFrame, dict[tuple, dict[str, np.ndarray]]]:
    """(fit, target, lam, n, brier, fixed, gain, weights): stacking of ridge members by predictions from out of each block, season by season.

    A member is a ridge over its columns and an intercept. Its out-of-block weights for a block of a season come from the season's Gram matrix
    less the block's own, so one pass gives all of them. Ridge weights of the members' out-of-block predictions are fitted on the
    season and applied to the next season, where members are those of the whole season: nothing of the target season is used. ``fixed`` is
    the Brier of equal weights, ``gain`` its excess over the stack's. Also returns the members' weights for (season, block).
    """
    spark = df.sparkSession
    columns = sorted({c for cs in members.values() for c in cs})
    base = df.select(season, block, *columns, F.lit(1.0).alias("_one"), F.col(y).cast("double").alias("_y"))
    names = [*columns, "_one", "_y"]
    by_block = grams_by(base, [season, block], names)
    seasons = sorted({s for s, _ in by_block})
    total = {s: sum(g for (t, _), g in by_block.items() if t == s) for s in seasons}
    on = {m: [names.index(c) for c in cs] + [len(columns)] for m, cs in members.items()}
    last = len(names) - 1
    out_of = {key: {m: _solve(total[key[0]] - g, on[m], last, member_lam) for m in members} for key, g in by_block.items()}
    whole = {s: {m: _solve(total[s], on[m], last, member_lam) for m in members} for s in seasons}

    def rows_of(table: dict[tuple, dict[str, np.ndarray]], keys: list[str]) -> DataFrame:
        """A row of full-length weights for each key and member."""
        rows = []
        for key, by_member in table.items():
            full = []
            for m in members:
                w = np.zeros(len(columns) + 1)
                w[on[m]] = by_member[m]
                full.append([float(v) for v in w])
            rows.append((*key, full))
        types = dict(df.dtypes)
        return F.broadcast(spark.createDataFrame(rows, ", ".join(f"{k} {types[k]}" for k in keys) + ", _w array<array<double>>"))

    def predicted(d: DataFrame) -> DataFrame:
        x = F.array(*(F.col(c).cast("double") for c in columns), F.lit(1.0))
        dot = lambda i: F.aggregate(F.zip_with(x, F.col("_w")[i], lambda a, b: a * b), F.lit(0.0), lambda s, v: s + v)
        return d.select(season, *(dot(i).alias(m) for i, m in enumerate(members)), "_one", "_y")

    own = list(members)
    meta = grams_by(predicted(base.join(rows_of(out_of, [season, block]), [season, block])), [season], [*own, "_one", "_y"])
    ahead = {(t,): whole[s] for s, t in zip(seasons, seasons[1:], strict=False) if t == s + 1}
    target = grams_by(predicted(base.join(rows_of(ahead, [season]), season)), [season], [*own, "_one", "_y"])
    found = []
    k = len(own) + 1
    for s in seasons:
        if (s + 1,) not in target:
            continue
        g = target[(s + 1,)]
        n = g[k - 1, k - 1]
        brier = lambda w: float((g[k, k] - 2 * w @ g[:k, k] + w @ g[:k, :k] @ w) / n)
        fixed = brier(np.array([1 / len(own)] * len(own) + [0.0]))
        for lam in lams:
            w = _solve(meta[(s,)], list(range(k)), k, lam)
            found.append((s, s + 1, float(lam), int(round(n)), brier(w), fixed, fixed - brier(w), [float(v) for v in w]))
    kind = dict(df.dtypes)[season]
    return spark.createDataFrame(found, f"fit {kind}, target {kind}, lam double, n long, brier double, fixed double, gain double, weights array<double>"), out_of


def _inverse_root(a: np.ndarray, least: float = 1e-12) -> np.ndarray:
    values, vectors = np.linalg.eigh(a)
    some = values > least
    root = np.zeros_like(values)
    root[some] = values[some] ** -0.5
    return vectors @ np.diag(root) @ vectors.T


def _whitened(caa: np.ndarray, cab: np.ndarray, cbb: np.ndarray) -> np.ndarray:
    return np.clip(np.linalg.svd(_inverse_root(caa) @ cab @ _inverse_root(cbb), compute_uv=False), 0.0, 1.0)


def canonical_correlations(df: DataFrame, a: Sequence[str], b: Sequence[str], centred: bool = True) -> list[float]:
    """Correlations of the best matching combinations of two blocks of columns, largest first; uncentred, the cosines of the angles between their spans."""
    g = gram(df.withColumn("_one", F.lit(1.0)), [*a, *b, "_one"])
    n = g[-1, -1] or 1.0
    c = g[:-1, :-1] / n
    if centred:
        m = g[:-1, -1] / n
        c = c - np.outer(m, m)
    k = len(a)
    return [float(v) for v in _whitened(c[:k, :k], c[:k, k:], c[k:, k:])]


def subspace_angles(df: DataFrame, a: Sequence[str], b: Sequence[str]) -> list[float]:
    """Angles between the spans of two blocks of columns, in radians, smallest first."""
    return [float(np.arccos(v)) for v in canonical_correlations(df, a, b, centred=False)]


def partition_correlation(df: DataFrame, a: str, b: str) -> float:
    """The first canonical correlation of two partitions, from their contingency table; a null is a value like others."""
    rows = df.groupBy(a, b).agg(F.count("*").alias("n")).collect()  # a row for each pair of values
    ia, ib = ({v: i for i, v in enumerate(dict.fromkeys(r[c] for r in rows))} for c in (a, b))
    t = np.zeros((len(ia), len(ib)))
    for r in rows:
        t[ia[r[a]], ib[r[b]]] += r["n"]
    if not t.sum():
        return 0.0
    t /= t.sum()
    ra, rb = t.sum(axis=1), t.sum(axis=0)
    found = _whitened(np.diag(ra) - np.outer(ra, ra), t - np.outer(ra, rb), np.diag(rb) - np.outer(rb, rb))
    return float(found[0]) if len(found) else 0.0


def joint_gain(df: DataFrame, y: str, q: str, z: Sequence[str]) -> float:
    """Rise of the score when the best linear combination of the z columns is added to prediction q."""
    d = df.select(*z, (F.col(q) - F.col(y)).alias("_e"), F.col(y).cast("double").alias("_y"), F.lit(1.0).alias("_one"))
    g = gram(d, [*z, "_e", "_y", "_one"])
    k, n = len(z), g[-1, -1]
    rate = g[-1, -2] / n
    c = g[:k, k] / n
    return float(1e5 / (rate * (1 - rate)) * (c @ np.linalg.pinv(g[:k, :k] / n) @ c))


def model_geometry(df: DataFrame, y: str, a: str, b: str) -> dict[str, float]:
    """Two predictions after their own affine fits: scores, distance, the part of it that a can't explain, best weight and gain before and after refitting."""
    g = gram(df.select(F.col(a).cast("double").alias("a"), F.col(b).cast("double").alias("b"), F.col(y).cast("double").alias("y"), F.lit(1.0).alias("one")), ["one", "a", "b", "y"])
    n = g[0, 0]
    rate = g[0, 3] / n
    k = 1e5 / (rate * (1 - rate))
    mse = lambda w: float((g[3, 3] - 2 * w @ g[:3, 3] + w @ g[:3, :3] @ w) / n)
    score = lambda w: 1e5 - k * mse(w)

    def fit(on: list[int]) -> np.ndarray:
        w = np.zeros(3)
        w[on] = np.linalg.lstsq(g[np.ix_(on, on)], g[on, 3], rcond=None)[0]
        return w

    wa, wb, both = fit([0, 1]), fit([0, 2]), fit([0, 1, 2])
    d = wb - wa
    square = float(d @ g[:3, :3] @ d / n)
    xa = wa - np.array([wa @ g[:3, 0] / n, 0, 0])
    h, va = float(xa @ g[:3, :3] @ d / n), float(xa @ g[:3, :3] @ xa / n)
    apart = square - h * h / va
    weight = float(np.clip(0.5 + (score(wb) - score(wa)) / (2 * k * square), 0, 1))
    found = {"score_a": score(wa), "score_b": score(wb), "distance": square**0.5, "apart": max(0.0, apart) ** 0.5, "weight": weight, "gain": score(wa + weight * d) - score(wa), "refit_gain": score(both) - score(wa)}
    return {name: float(v) for name, v in found.items()}


def pair_blend(df: DataFrame, y: str, a: str, b: str) -> dict[str, float]:
    """What a blend (1 - w) a + w b of two predictions scores as they are: both scores, the mean squared distance, the best weight within [0, 1]
    and its gain over a, and the weight at which the blend is back at a's score (``break_even``; 0 where any b makes it worse).

    All from one Gram matrix of errors; equal predictions have weight, gain and break-even 0.
    """
    d = df.select((F.col(a) - F.col(y)).alias("ea"), (F.col(b) - F.col(y)).alias("eb"), F.col(y).cast("double").alias("y"), F.lit(1.0).alias("one"))
    g = gram(d, ["ea", "eb", "y", "one"])
    n = g[3, 3]
    rate = g[2, 3] / n
    k = 1e5 / (rate * (1 - rate))
    score_a, score_b = 1e5 - k * g[0, 0] / n, 1e5 - k * g[1, 1] / n
    square = (g[0, 0] + g[1, 1] - 2 * g[0, 1]) / n
    top = 0.5 + (score_b - score_a) / (2 * k * square) if square > 0 else 0.0
    weight = min(1.0, max(0.0, top))
    gain = weight * (score_b - score_a) + k * weight * (1 - weight) * square
    return {name: float(v) for name, v in {"score_a": score_a, "score_b": score_b, "distance2": square, "weight": weight, "gain": gain, "break_even": max(0.0, 2 * top)}.items()}


# ---------------------------------------------------------------- mixtures


def normal_mixture(df: DataFrame, value: str, steps: int = 200, tolerance: float = 1e-9) -> dict[str, float] | None:
    """Weights, means and deviations of two normal components, by expectation and maximisation over counted values.

    A step is one aggregation of responsibilities; it begins at the quartiles and ends when the mean log-likelihood stands still. None without spread.
    """
    counts = materialised(df.select(F.col(value).cast("double").alias("v")).filter(F.col("v").isNotNull() & ~F.isnan("v") & (F.abs("v") < float("inf"))).groupBy("v").agg(F.count("*").alias("n")))
    s = counts.agg(F.sum("n"), F.sum(F.col("n") * F.col("v")), F.sum(F.col("n") * F.col("v") * F.col("v"))).first()
    n = s[0] or 0
    var = (s[2] / n - (s[1] / n) ** 2) if n else 0.0
    if n < 2 or var <= 0:
        discard(counts)
        return None
    floor = 1e-6 * var
    mu = np.array(quantiles(df.filter(~F.isnan(F.col(value).cast("double"))), value, [0.25, 0.75]), float)
    if mu[0] == mu[1]:
        mu = np.array([s[1] / n - var**0.5, s[1] / n + var**0.5])
    w, v2, last = np.array([0.5, 0.5]), np.array([var, var]), -np.inf
    for _ in range(steps):
        f = [F.lit(float(w[i] / (2 * np.pi * v2[i]) ** 0.5)) * F.exp(-F.pow(F.col("v") - float(mu[i]), 2) / float(2 * v2[i])) for i in (0, 1)]
        d = counts.select("v", "n", (f[0] + f[1]).alias("f"), f[0].alias("f0")).withColumn("r", F.when(F.col("f") > 0, F.col("f0") / F.col("f")).otherwise(F.lit(0.5)))
        d = d.withColumn("k", F.col("n") * F.col("r"))
        row = d.agg(F.sum("k"), F.sum(F.col("k") * F.col("v")), F.sum(F.col("k") * F.col("v") * F.col("v")), F.sum(F.col("n") * F.ln(F.greatest("f", F.lit(1e-300))))).first()
        r0 = np.array(row[:3], float)
        r1 = np.array([n, s[1], s[2]]) - r0
        if min(r0[0], r1[0]) <= 1e-9 * n:
            break
        w = np.array([r0[0], r1[0]]) / n
        mu = np.array([r0[1] / r0[0], r1[1] / r1[0]])
        v2 = np.maximum(np.array([r0[2] / r0[0], r1[2] / r1[0]]) - mu * mu, floor)
        if abs(row[3] / n - last) < tolerance:
            break
        last = row[3] / n
    discard(counts)
    order = np.argsort(mu)
    return {f"{k}{i}": float(x[order[i]]) for i in (0, 1) for k, x in (("w", w), ("mu", mu), ("sd", v2**0.5))} | {"n": float(n)}


def mixture_threshold(df: DataFrame, value: str, points: int = 400, fallback: float = 0.25, least: int = 50) -> DataFrame:
    """One row (threshold, bimodal): where the two components' density is least between their means, else the fallback quantile.

    The quantile is taken for fewer than ``least`` values, and where the means stand less than the root of the mean variance apart.
    """
    m = normal_mixture(df, value)
    if m is not None and m["n"] >= least and m["mu1"] - m["mu0"] >= ((m["sd0"] ** 2 + m["sd1"] ** 2) / 2) ** 0.5:
        grid = np.linspace(m["mu0"], m["mu1"], points)
        density = sum(m[f"w{i}"] / m[f"sd{i}"] * np.exp(-0.5 * ((grid - m[f"mu{i}"]) / m[f"sd{i}"]) ** 2) for i in (0, 1))
        found = (float(grid[int(np.argmin(density))]), True)
    else:
        found = (quantiles(df, value, [fallback])[0], False)
    return df.sparkSession.createDataFrame([found], "threshold double, bimodal boolean")

