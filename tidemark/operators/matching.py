"""Matching of two id spaces as rounds of joins: an auction, re-ranking against anchors, and agreement over many arms."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.files import discard, materialised
from .bidding import Pricing, matched, wide
from .ordered import quantiles


def auction(pairs: DataFrame, by: Sequence[str], tolerance: float = 0.25, whole: int = 8_000_000) -> DataFrame:
    """One-to-one pairs (by, a, b, cost) of each group: their total cost exceeds the least by ``tolerance`` times the group's spread of costs at most.

    The smaller side bids. In a round every id without a partner bids for the partner of least cost plus price, by as much
    as the next best costs more and an increment of tolerance * spread / bidders; the highest bid for a partner sets its price and
    takes it from whom it had. Prices start at 0, so what nobody wants stays free, which the bound needs where the
    sides differ in size. An id may also stay alone for three times the spread above the least cost: it does only where
    candidate lists leave it no partner. Rows with a null id are left out; ties go to the smaller id.

    Scale: groups run side by side. One of up to ``whole`` pairs (24 bytes each) holds its rounds in one task; in a larger one, of any size, a
    round is three joins of written tables, over the rows of ids that are still open. Both give the same pairs.
    """
    given = materialised(pairs.filter("a IS NOT NULL AND b IS NOT NULL").select(F.struct(*by).alias("k"), "a", "b", "cost"))
    fits = materialised(given.groupBy("k").agg((F.count("*") <= whole).alias("fits")))
    some = {r["fits"] for r in fits.select("fits").distinct().collect()}
    part = lambda ok: given.join(fits.filter("fits" if ok else "NOT fits").select("k"), "k", "left_semi")
    found = []
    if some != {False}:  # also where there is no group
        found.append(_small_auctions(part(True), tolerance))
    if False in some:
        found.append(_large_auctions(part(False), tolerance))
    out = found[0] if len(found) == 1 else found[0].unionByName(found[1])
    out = materialised(out.select("k.*", "a", "b", "cost"))
    discard(given, fits)
    return out


def _small_auctions(given: DataFrame, tolerance: float) -> DataFrame:
    """The rounds of ``_large_auctions``, bid for bid, with each group's pairs in one task as arrays in order of bidder and partner."""

    def solve(t: pa.Table) -> pa.Table:
        names = [t[c].combine_chunks() for c in ("a", "b")]
        (ids_a, a), (ids_b, b) = (np.unique(c.to_numpy(zero_copy_only=False), return_index=True, return_inverse=True)[1:] for c in names)
        cost = t["cost"].to_numpy()
        forward = len(ids_a) <= len(ids_b)
        x, y = (a, b) if forward else (b, a)
        order = np.lexsort((cost, y, x))
        x, y = x[order], y[order]
        first = np.r_[True, (x[1:] != x[:-1]) | (y[1:] != y[:-1])]
        order, x, y = order[first], x[first], y[first]
        c = cost[order]
        lo, spread, n_x = c.min(), c.max() - c.min(), int(x[-1]) + 1
        eps = tolerance * spread / min(len(ids_a), len(ids_b)) if spread > 0 else 1.0
        stay = lo + 3 * spread + 1e-9
        begin = np.searchsorted(x, np.arange(n_x + 1))
        n_y = int(y.max()) + 1
        price, holder, at_y = np.zeros(n_y), np.full(n_y, -1), np.full(n_y, -1)
        waiting = np.arange(n_x)
        while len(waiting):
            size = begin[waiting + 1] - begin[waiting]
            starts = np.r_[0, np.cumsum(size)[:-1]]
            rows = np.repeat(begin[waiting] - starts, size) + np.arange(size.sum())
            total = c[rows] + price[y[rows]]
            t1 = np.minimum.reduceat(total, starts)
            least = np.flatnonzero(total == np.repeat(t1, size))
            best = least[np.searchsorted(least, starts)]
            total[best] = np.inf
            second = np.minimum(np.minimum.reduceat(total, starts), stay)
            want, goes = y[rows[best]], t1 >= stay
            bid = price[want] + second - t1 + eps
            who, want, bid, row = waiting[~goes], want[~goes], bid[~goes], rows[best][~goes]
            # The highest bid for a partner, of equal ones that of the larger id.
            by_bid = np.lexsort((who, bid, want))
            last = by_bid[np.r_[want[by_bid][1:] != want[by_bid][:-1], True]] if len(by_bid) else by_bid
            ousted = holder[want[last]]
            lost = np.ones(len(who), bool)
            lost[last] = False
            holder[want[last]], price[want[last]], at_y[want[last]] = who[last], bid[last], row[last]
            waiting = np.sort(np.r_[who[lost], ousted[ousted >= 0]])
        return t.take(pa.array(order[at_y[at_y >= 0]]))

    return given.filter("cost IS NOT NULL").groupBy("k").applyInArrow(solve, given.schema)


def _large_auctions(given: DataFrame, tolerance: float) -> DataFrame:
    raw = materialised(given.groupBy("k", "a", "b").agg(F.min("cost").alias("cost")))
    size = raw.groupBy("k").agg(F.min("cost").alias("lo"), F.max("cost").alias("hi"))
    for side in ("a", "b"):
        size = size.join(raw.select("k", side).distinct().groupBy("k").agg(F.count("*").alias(f"n_{side}")), "k")
    spread = F.col("hi") - F.col("lo")
    size = size.select("k", (F.col("n_a") <= F.col("n_b")).alias("forward"), F.when(spread > 0, tolerance * spread / F.least("n_a", "n_b")).otherwise(1.0).alias("eps"), (F.col("lo") + 3 * spread + 1e-9).alias("stay"))
    x, y = F.when(F.col("forward"), F.col("a")).otherwise(F.col("b")), F.when(F.col("forward"), F.col("b")).otherwise(F.col("a"))
    offers = materialised(raw.join(size, "k").select("k", x.alias("x"), y.alias("y"), "cost", "eps", "stay", "forward"))
    spark, ids, keys = offers.sparkSession, dict(offers.dtypes)["x"], dict(offers.dtypes)["k"]
    bidders = materialised(offers.select("k", "x").distinct())
    n_bidders, n_settled = bidders.count(), 0
    # Who has whom at what price; a null partner is an id that stays alone.
    state, old = spark.createDataFrame([], f"k {keys}, x {ids}, y {ids}, price double"), []
    best = Window.partitionBy("k", "x").orderBy("total", "y")
    at = lambda r, c: F.max(F.when(F.col("r") == r, F.col(c)))
    while n_settled < n_bidders:
        waiting = bidders.join(state, ["k", "x"], "left_anti")
        asked = offers.join(waiting, ["k", "x"], "left_semi").join(state.select("k", "y", "price"), ["k", "y"], "left").withColumn("price", F.coalesce("price", F.lit(0.0)))
        two = asked.withColumn("total", F.col("cost") + F.col("price")).withColumn("r", F.row_number().over(best)).filter(F.col("r") <= 2)
        bids = two.groupBy("k", "x").agg(at(1, "y").alias("y"), at(1, "total").alias("t1"), at(2, "total").alias("t2"), at(1, "price").alias("price"), F.max("eps").alias("eps"), F.max("stay").alias("stay"))
        second = F.least(F.coalesce("t2", "stay"), "stay")
        leaves = F.col("t1") >= F.col("stay")
        bids = bids.select("k", "x", F.when(~leaves, F.col("y")).alias("y"), (F.col("price") + second - F.col("t1") + F.col("eps")).alias("price"))
        # A bid is above the partner's price, so the highest of what it has and what is bid is who gets it.
        highest = F.max_by("x", F.struct("price", F.struct("x")))
        every = state.unionByName(bids).withColumn("stays", F.when(F.col("y").isNull(), F.col("x")))
        now = materialised(every.groupBy("k", "y", "stays").agg(highest.alias("x"), F.max("price").alias("price")).select("k", "x", "y", "price"))
        n_settled = now.count()
        discard(*old)
        state, old = now, [now]
    found = offers.join(state.select("k", "x", "y"), ["k", "x", "y"])
    a, b = F.when(F.col("forward"), F.col("x")).otherwise(F.col("y")), F.when(F.col("forward"), F.col("y")).otherwise(F.col("x"))
    out = materialised(found.select("k", a.alias("a"), b.alias("b"), "cost"))
    discard(raw, offers, bidders, *old)
    return out


@dataclass(frozen=True)
class Weights:
    """What a difference costs: a weight for each ranked axis and for sets, and penalties of seasons that only one side has."""

    axes: dict[str, float]
    sets: float = 1.2
    #: Distance of two sets that can't be compared, a little worse than neutral.
    unknown_set: float = 0.6
    only_a: float = 1.0
    only_b: float = 3.0
    #: Cells with fewer anchors are ranked against everybody.
    least_anchors: int = 5


def anchored(d: DataFrame, axes: Sequence[str], cell: Sequence[str], anchors: DataFrame | None, least: int = 5) -> DataFrame:
    """``d`` with each axis replaced by its place among the anchors of its cell: the share below, ties counting half.

    ``anchors`` are (entity); without them, or with fewer than ``least`` in a cell, everybody there is one. A null value counts as 0.
    """
    if anchors is None:
        ref = d.withColumn("_in", F.lit(True))
    else:
        ref = d.join(anchors.select("entity").distinct().withColumn("_in", F.lit(True)), "entity", "left").withColumn("_in", F.coalesce("_in", F.lit(False)))
    rest = [c for c in d.columns if c not in axes]
    ref = ref.select(*rest, *(F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(c) for c in axes), "_in")

    def places(t: pa.Table) -> pa.Table:
        sure = t["_in"].to_numpy()
        if sure.sum() < least:
            sure = np.ones(len(t), bool)
        out = {c: t[c] for c in rest}
        for c in axes:
            v = t[c].to_numpy()
            of = np.sort(v[sure])
            out[c] = pa.array((np.searchsorted(of, v) + np.searchsorted(of, v, side="right")) / (2.0 * len(of)))
        return pa.table(out)

    return ref.groupBy(*cell).applyInArrow(places, ref.drop("_in").schema)


@dataclass(frozen=True)
class Sets:
    """What sets of sessions are compared by: (entity, season, key, size) of both sides, at most one row a key; two sizes of a key agree by 1 - difference / scale.

    Their distance is 1 less the sum of that over b's sessions, divided by their number: what ``resolve.set_score`` gives where keys don't recur.
    """

    a: DataFrame
    b: DataFrame
    keys: Sequence
    scale: float = 10.0


@dataclass(frozen=True)
class Ranked:
    """Both sides of a round as ``bidding.wide`` tables, with how their sets are compared."""

    a: DataFrame
    b: DataFrame
    sets: Sets | DataFrame | None


def _ranked(a: DataFrame, b: DataFrame, w: Weights, block: Sequence[str], sets: Sets | DataFrame | None) -> Ranked:
    scores, out = sets if isinstance(sets, DataFrame) else None, []
    for d, side in ((a, "a"), (b, "b")):
        columns = list(w.axes)
        if isinstance(sets, Sets):
            size = lambda k: F.when(F.col("key") == k, F.col("size"))
            once = lambda k, c: F.when(F.count(size(k)) > 1, F.raise_error(F.lit("a set has two sessions of a key"))).otherwise(F.max(size(k))).alias(c)
            more = [f"_set{i}" for i in range(len(sets.keys))]
            own = getattr(sets, side).groupBy("entity", "season").agg(*(once(k, c) for k, c in zip(sets.keys, more, strict=True)))
            d, columns = d.join(own, ["entity", "season"], "left"), columns + more
        out.append(wide(d, block, "season", "entity", columns, scores if side == "a" else None))
    return Ranked(*out, sets)


@dataclass(frozen=True)
class Arm:
    """A way to count the same distances: over some seasons only, with weights multiplied."""

    name: str
    kind: str
    seasons: Sequence[int] | None = None
    factors: dict[str, float] = field(default_factory=dict)


def jitters(axes: Sequence[str], n: int = 20, sd: float = 0.25, seed: int = 0) -> list[Arm]:
    """``n`` arms whose weights are multiplied by log-normal factors."""
    rng = np.random.default_rng(seed)
    return [Arm(f"jitter{t}", "jitter", None, dict(zip([*axes, "set"], map(float, np.exp(rng.normal(0, sd, len(axes) + 1))), strict=True))) for t in range(n)]


def _pricing(w: Weights, arms: Sequence[Arm], seasons: Sequence[int], sets: Sets | DataFrame | None) -> Pricing:
    """Every arm's cost from one reading of the distances: a weight for each axis, and for sets if there are any; seasons that only one side has cost a penalty."""
    n, axes = len(w.axes), [*w.axes] + ([] if sets is None else ["set"])
    weight = {**w.axes, "set": w.sets}
    keyed, unknown = (sets.scale if isinstance(sets, Sets) else None), w.unknown_set

    def distances(x: np.ndarray, y: np.ndarray) -> list[np.ndarray]:
        out = list(np.abs(x[:n] - y[:n]))
        if keyed is not None:
            has_a, n_b = ~np.isnan(x[n:]).all(axis=0), (~np.isnan(y[n:])).sum(axis=0)
            # A key that one side lacks adds nothing.
            found = np.fmax(1 - np.abs(x[n:] - y[n:]) / keyed, 0.0).sum(axis=0)
            out.append(np.where(has_a & (n_b > 0), 1 - found / np.maximum(n_b, 1), unknown))
        return out

    weights = np.array([[weight[c] * m.factors.get(c, 1.0) for c in axes] for m in arms])
    when = [frozenset(map(int, seasons if m.seasons is None else m.seasons)) for m in arms]
    return Pricing(distances, weights, when, w.only_a, w.only_b, unknown if isinstance(sets, DataFrame) else None, n)


def rematch(a: DataFrame, b: DataFrame, w: Weights, block: Sequence[str], cell: Sequence[str], seasons: Sequence[int], sets: Sets | DataFrame | None = None, rounds: int = 3, tolerance: float = 0.25) -> tuple[Ranked, DataFrame]:
    """Matches two id spaces, ranks both anew against the sure pairs, and matches again, ``rounds`` times.

    ``a`` and ``b`` have (entity, season, block and cell columns, axes), one row an entity and season; ``sets`` are sessions, or scores of pairs
    (a, b, season, score). Returns the last round's sides and its pairs (block, a, b, cost, co, margin_row, margin_col, anchor, round). Pairs whose margin is at or above
    the median are the anchors of the next round; a pair without rival is one too. Pairs are made in tiles (``bidding.matched``); a round writes
    its sides and what it matched.
    """
    sure_a = sure_b = None
    spent: list[DataFrame] = []
    for i in range(rounds):
        ra, rb = (anchored(d, list(w.axes), cell, s, w.least_anchors) for d, s in ((a, sure_a), (b, sure_b)))
        sides = _ranked(ra, rb, w, block, sets)
        found = matched(sides.a, sides.b, block, _pricing(w, [Arm("base", "base")], seasons, sets), tolerance, edges=True)
        middle = quantiles(found, "margin_row", [0.5])[0]
        anchor = F.col("margin_row").isNull() | (F.col("margin_row") >= F.lit(middle))
        out = materialised(found.drop("arm").withColumns({"anchor": anchor, "round": F.lit(i)}))
        sure = out.filter("anchor")
        sure_a, sure_b = sure.select(F.col("a").alias("entity")), sure.select(F.col("b").alias("entity"))
        discard(found, *spent)
        spent = [sides.a, sides.b, out]
    return sides, out


def arm_matches(sides: Ranked, a: DataFrame, b: DataFrame, w: Weights, block: Sequence[str], arms: Sequence[Arm], seasons: Sequence[int], tolerance: float = 0.25) -> DataFrame:
    """(arm, kind, block, a, b, cost, co): the one-to-one pairs of every arm, all matched from one reading of the sides."""
    found = matched(sides.a, sides.b, block, _pricing(w, arms, seasons, sides.sets), tolerance)
    names = F.broadcast(found.sparkSession.createDataFrame([(i, m.name, m.kind) for i, m in enumerate(arms)], "_arm int, arm string, kind string"))
    return found.withColumnRenamed("arm", "_arm").join(names, "_arm").select("arm", "kind", *block, "a", "b", "cost", "co")


def agreement(base: DataFrame, votes: DataFrame) -> DataFrame:
    """Each base pair (a, b) with ``stability`` (share of jitters that have it too), ``season_mode``, ``n_seasons``, ``agree``,
    ``eras`` (in how many eras the id is matched) and ``same_era`` (whether all of them agree with each other).

    ``season_mode`` is the partner that most seasons' own matchings choose, the least id of several. A pair agrees with it, or with
    nothing if the id was matched in fewer than two seasons.
    """
    n_jitters = F.count_distinct(F.when(F.col("kind") == "jitter", F.col("arm")))
    total = votes.agg(n_jitters.alias("n_jitters"))
    jit = votes.filter("kind = 'jitter'").groupBy("a", "b").agg(F.count("*").alias("kept"))
    per = votes.filter("kind = 'season'").groupBy("a", "b").agg(F.count("*").alias("v"))
    first = F.row_number().over(Window.partitionBy("a").orderBy(F.desc("v"), "b"))
    mode = per.withColumn("r", first).groupBy("a").agg(F.max(F.when(F.col("r") == 1, F.col("b"))).alias("season_mode"), F.sum("v").alias("n_seasons"))
    era = votes.filter("kind = 'era'").groupBy("a").agg(F.count("*").alias("eras"), (F.min("b") == F.max("b")).alias("same_era"))
    d = base.select("a", "b").join(jit, ["a", "b"], "left").join(mode, "a", "left").join(era, "a", "left").crossJoin(F.broadcast(total))
    seasons = F.coalesce("n_seasons", F.lit(0))
    return d.select(
        "a",
        "b",
        F.try_divide(F.coalesce("kept", F.lit(0)), "n_jitters").alias("stability"),
        "season_mode",
        seasons.alias("n_seasons"),
        (F.coalesce(F.col("season_mode") == F.col("b"), F.lit(False)) | (seasons < 2)).alias("agree"),
        F.coalesce("eras", F.lit(0)).alias("eras"),
        "same_era",
    )


def posterior(base: DataFrame, votes: DataFrame, top: int = 5) -> DataFrame:
    """(a, b, p): shares of all votes for the ``top`` partners of each id: one of each season and jitter, two of the base."""
    v = votes.filter("kind IN ('season', 'jitter')").select("a", "b", F.lit(1).alias("v")).unionByName(base.select("a", "b", F.lit(2).alias("v")))
    v = v.groupBy("a", "b").agg(F.sum("v").alias("v"))
    order = Window.partitionBy("a").orderBy(F.desc("v"), "b")
    d = v.withColumns({"r": F.row_number().over(order), "total": F.sum("v").over(Window.partitionBy("a"))})
    return d.filter(F.col("r") <= top).select("a", "b", (F.col("v") / F.col("total")).alias("p"))


def sure_tiers(pairs: DataFrame, agreed: DataFrame, threshold: float, steady: float = 0.9, fair: float = 0.6) -> DataFrame:
    """(a, b, tier): 1 for pairs that agree, are stable and stand clear by ``threshold``, 2 for fairly stable ones, else 3.

    A pair must share a season to be above tier 3; one without a rival stands clear.
    """
    d = pairs.join(agreed, ["a", "b"])
    met, clear = F.col("co") > 0, F.col("margin_row").isNull() | (F.col("margin_row") >= threshold)
    tier = F.when(met & F.col("agree") & (F.col("stability") >= steady) & clear, 1).when(met & (F.col("stability") >= fair), 2).otherwise(3)
    return d.select("a", "b", tier.alias("tier"))


def asof_agreement(votes: DataFrame, base: DataFrame) -> DataFrame:
    """(arm, common, same, agreement) for each cutoff: the ids matched there and in the base, and how many have the same partner."""
    d = votes.filter("kind = 'cutoff'").select("arm", "a", F.col("b").alias("then")).join(base.select("a", "b"), "a")
    g = d.groupBy("arm").agg(F.count("*").alias("common"), F.count_if(F.col("then") == F.col("b")).alias("same"))
    return g.withColumn("agreement", F.col("same") / F.col("common"))


def polarity(a: DataFrame, b: DataFrame, w: Weights, block: Sequence[str], side: str, maps: dict[str, dict], seasons: Sequence[int], tolerance: float = 0.25) -> DataFrame:
    """(polarity, pairs, total, ratio): the total cost of the assignment under each mapping of a's sides to b's, and its ratio to the least.

    Ids are matched within mapped sides only. A ratio near 1 for the other mapping means that signatures don't tell sides apart.
    """
    cell = ["season", side]
    rb = materialised(anchored(b, list(w.axes), cell, None))
    ra = materialised(anchored(a, list(w.axes), cell, None))
    pricing = _pricing(w, [Arm("base", "base")], seasons, None)
    sides = []
    for d, to in ((ra, maps), (rb, {name: None for name in maps})):
        every = None
        for name, m in to.items():
            mapped = F.col(side) if m is None else F.create_map(*(F.lit(x) for kv in m.items() for x in kv))[F.col(side)]
            one = d.select(F.lit(name).alias("polarity"), *block, mapped.alias(side), "entity", "season", *w.axes)
            every = one if every is None else every.unionByName(one)
        sides.append(wide(every, ["polarity", *block, side], "season", "entity", list(w.axes)))
    found = matched(*sides, ["polarity", *block, side], pricing, tolerance)
    discard(ra, rb, *sides)
    g = found.groupBy("polarity").agg(F.count("*").alias("pairs"), F.sum("cost").alias("total"))
    least = F.broadcast(g.agg(F.min("total").alias("least")))
    return g.crossJoin(least).select("polarity", "pairs", "total", (F.col("total") / F.col("least")).alias("ratio"))
