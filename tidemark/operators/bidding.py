"""One-to-one pairs of two id spaces whose pairs are never a table: each id's cheapest partners from tiles, and an auction over these lists."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources.files import discard, materialised


@dataclass(frozen=True)
class Pricing:
    """What pairs cost: for each arm the weighted distances of the seasons that both ids have, and penalties of those that only one has.

    ``distances`` takes the measures of a and b, shaped (measure, season, n, 1) and (measure, season, 1, m) or the other way round, and gives arrays (season, n, m).
    An unknown (NaN) distance adds nothing; a pair without a known one in any season has no cost. With ``unknown_set`` given, the sides have pair scores, and
    the last distance is 1 - score, or that value where there is none.
    """

    distances: Callable[[np.ndarray, np.ndarray], list[np.ndarray]]
    #: (arm, distance).
    weights: np.ndarray
    #: Each arm's seasons; None are all.
    seasons: Sequence[frozenset | None]
    only_a: float = 0.0
    only_b: float = 0.0
    unknown_set: float | None = None
    #: The first measures, all by default, whose NaN can make a distance unknown.
    checked: int | None = None


def wide(d: DataFrame, by: Sequence[str], season: str, entity: str, measures: Sequence[str | Column], scores: DataFrame | None = None) -> DataFrame:
    """One row an id, with its seasons ``_p`` in order and an array over them for each measure; ``scores`` (a, b, season, score) are kept with a.

    Rows with a null group, season or id are left out. An id has one row a season and is in one group only.
    """
    columns = [F.col(m) if isinstance(m, str) else m for m in measures]
    rows = d.dropna(subset=[*by, season, entity]).select(*by, F.col(entity).alias("_id"), F.struct(F.col(season).cast("int").alias("p"), *(c.cast("double").alias(f"m{i}") for i, c in enumerate(columns))).alias("_s"))
    g = rows.groupBy(*by, "_id").agg(F.sort_array(F.collect_list("_s")).alias("_s"))
    out = g.select(*by, "_id", F.col("_s.p").alias("_p"), *(F.col(f"_s.m{i}").alias(f"_m{i}") for i in range(len(columns))))
    if scores is not None:
        own = scores.dropna(subset=["a", "b", "season", "score"]).groupBy(F.col("a").alias("_id")).agg(F.collect_list(F.struct("b", F.col("season").cast("int").alias("season"), "score")).alias("_known"))
        out = out.join(own, "_id", "left").select(*out.columns, "_known")
    return materialised(out)


class _Group:
    """Both sides of a group in a task, in order of their ids: measures (measure, season, id) and the seasons each id has."""

    def __init__(self, p: Pricing, bidders: pa.Table, partners: pa.Table, forward: bool):
        import pyarrow.compute as pc

        self.p, self.forward = p, forward
        self.bidders, self.partners = (t.take(pc.sort_indices(t["_id"].combine_chunks())) for t in (bidders, partners))
        a, b = (self.bidders, self.partners) if forward else (self.partners, self.bidders)
        seen = np.unique(np.concatenate([t["_p"].combine_chunks().flatten().to_numpy(zero_copy_only=False) for t in (a, b)])).astype(int)
        (self.xa, self.has_a), (self.xb, self.has_b) = self._cube(a, seen), self._cube(b, seen)
        self.in_arm = np.array([[s is None or int(v) in s for v in seen] for s in p.seasons], bool).reshape(len(p.seasons), len(seen))
        self.n_a, self.n_b = (self.in_arm.astype(float) @ h for h in (self.has_a, self.has_b))
        self.misses = any(np.isnan(x[: p.checked, h]).any() for x, h in ((self.xa, self.has_a), (self.xb, self.has_b)))
        self.known = None
        if p.unknown_set is not None:
            given = a["_known"].combine_chunks()
            who, flat = pc.list_parent_indices(given).to_numpy(), given.flatten()
            at_b = pc.index_in(flat.field("b"), value_set=b["_id"].combine_chunks()).fill_null(-1).to_numpy()
            s, ok = flat.field("season").to_numpy(zero_copy_only=False).astype(int), at_b >= 0
            at_s = np.minimum(np.searchsorted(seen, s), max(0, len(seen) - 1))
            ok &= seen[at_s] == s if len(seen) else False
            x, y = (who, at_b) if forward else (at_b, who)
            order = np.argsort(x[ok], kind="stable")
            self.known = [v[ok][order] for v in (x, y, at_s, flat.field("score").to_numpy(zero_copy_only=False))]

    @staticmethod
    def _cube(t: pa.Table, seen: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        p = t["_p"].combine_chunks()
        who, at = np.repeat(np.arange(len(t)), np.diff(p.offsets.to_numpy())), np.searchsorted(seen, p.flatten().to_numpy(zero_copy_only=False))
        names = [c for c in t.column_names if c.startswith("_m")]
        out, has = np.full((len(names), len(seen), len(t)), np.nan), np.zeros((len(seen), len(t)), bool)
        has[at, who] = True
        for m, c in enumerate(names):
            out[m, at, who] = t[c].combine_chunks().flatten().to_numpy(zero_copy_only=False)
        return out, has

    def costs(self, rows: np.ndarray, arms: np.ndarray) -> np.ndarray:
        """(arm, row, partner): what the bidders ``rows`` cost with every partner; infinite where they are no pair."""
        p, shape = self.p, (len(rows), len(self.partners))
        mine, all_of = (lambda x: x[..., rows][..., None]), (lambda x: x[..., None, :])
        side_a, side_b = (mine, all_of) if self.forward else (all_of, mine)
        both = side_a(self.has_a) & side_b(self.has_b)
        each = p.distances(side_a(self.xa), side_b(self.xb))
        if self.known is not None:
            x, y, at, score = self.known
            lo = np.searchsorted(x, rows)
            size = np.searchsorted(x, rows, side="right") - lo
            i = np.repeat(lo - (np.cumsum(size) - size), size) + np.arange(size.sum())
            last = np.full(both.shape, p.unknown_set)
            last[at[i], np.repeat(np.arange(len(rows)), size), y[i]] = 1 - score[i]
            each = [*each, last]
        d = np.empty((len(each), *both.shape))
        for i, x in enumerate(each):
            d[i] = x
        d[:, ~both] = 0.0
        on = self.in_arm[arms].astype(float)
        met = (on @ both.reshape(len(both), -1)).reshape(len(arms), *shape)
        known = met
        if self.misses:
            nan = np.isnan(d)
            known = (on @ (both & ~nan.any(axis=0)).reshape(len(both), -1)).reshape(met.shape)
            d[nan] = 0.0
        w = p.weights[arms][:, :, None] * on[:, None, :]
        total = (w.reshape(len(arms), -1) @ d.reshape(w[0].size, -1)).reshape(met.shape)
        if p.only_a or p.only_b:
            total += p.only_a * (side_a(self.n_a[arms]) - met) + p.only_b * (side_b(self.n_b[arms]) - met)
        total[known == 0] = np.inf
        return total

    def chunks(self, rows: np.ndarray):
        """Rows a few at a time, so that what is made of them stays small whatever the number of partners."""
        step = max(1, (1 << 18) // max(1, (len(self.xa) + 1) * len(self.has_a) * len(self.partners)))
        for i in range(0, len(rows), step):
            yield rows[i : i + step]


def _cheapest(total: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Places and values of each row's k least, of equal ones the first, in order; places of no pair (infinite) are 0."""
    n = total.shape[1]
    if n <= k:
        at = np.argsort(total, axis=1, kind="stable")
    else:
        kth = np.partition(total, k - 1, axis=1)[:, k - 1]
        at = np.empty((len(total), k), np.int64)
        for r, row in enumerate(total):
            some = np.flatnonzero(row <= kth[r])
            at[r] = some[np.argsort(row[some], kind="stable")[:k]]
    least = np.take_along_axis(total, at, axis=1)
    out_at, out = np.zeros((len(total), k), np.int64), np.full((len(total), k), np.inf)
    out_at[:, : at.shape[1]], out[:, : at.shape[1]] = np.where(least < np.inf, at, 0), least
    return out_at, out


def _rounds(ys: np.ndarray, cs: np.ndarray, lo: np.ndarray, hi: np.ndarray, n_y: int, tolerance: float, more: Callable[[np.ndarray, np.ndarray], tuple]) -> tuple[np.ndarray, np.ndarray]:
    """Each arm's partners' bidders (-1: none) and their costs, bid for bid as in ``matching.auction`` over all pairs; arms take their rounds side by side.

    Only the lists' partners are looked at. Prices never fall, so whoever isn't in a list costs at least ``limit``, the dearest of the list when it was made; a
    bidder whose two best aren't below that gets a new list, of the cheapest at the prices of now.
    """
    n_arms, n_x, listed = cs.shape
    # Bidders and partners of all arms are numbered through.
    ys, cs = (ys + (np.arange(n_arms) * n_y)[:, None, None]).reshape(-1, listed), cs.reshape(-1, listed).copy()
    waiting = np.flatnonzero(cs[:, 0] < np.inf)
    n_bidders = np.bincount(waiting // n_x, minlength=n_arms)
    lo, spread = np.where(n_bidders > 0, lo, 0.0), np.where(n_bidders > 0, hi - lo, 0.0)
    eps = np.repeat(np.where(spread > 0, tolerance * spread / np.maximum(n_bidders, 1), 1.0), n_x)
    stay = np.repeat(lo + 3 * spread + 1e-9, n_x)
    limit = cs[:, -1].copy() if n_y > listed else np.full(len(cs), np.inf)
    price, holder, paid = np.zeros(n_arms * n_y), np.full(n_arms * n_y, -1), np.zeros(n_arms * n_y)

    def look(who: np.ndarray) -> tuple[np.ndarray, ...]:
        y, c = ys[who], cs[who]
        total = c + price[y]
        t1 = total.min(axis=1)
        at = np.where(total == t1[:, None], y, len(price)).argmin(axis=1)
        line = np.arange(len(who))
        total[line, at] = np.inf
        return y[line, at], c[line, at], t1, np.minimum(total.min(axis=1), stay[who])

    while len(waiting):
        want, cost, t1, second = look(waiting)
        bound = limit[waiting]
        stale = (second > bound) | ((t1 >= bound) & (t1 < stay[waiting]))
        if stale.any():
            who = waiting[stale]
            at, cs[who], limit[who] = more(who, price)
            ys[who] = at + (who // n_x * n_y)[:, None]
            want[stale], cost[stale], t1[stale], second[stale] = look(who)
        bids = np.flatnonzero(t1 < stay[waiting])
        if not len(bids):
            break
        who, want, cost = waiting[bids], want[bids], cost[bids]
        bid = price[want] + second[bids] - t1[bids] + eps[who]
        # The highest bid for a partner, of equal ones that of the larger id.
        by_bid = np.lexsort((who, bid, want))
        sought, last = want[by_bid], np.ones(len(bids), bool)
        np.not_equal(sought[1:], sought[:-1], out=last[:-1])
        won, sought = by_bid[last], sought[last]
        ousted = holder[sought]
        lost = np.ones(len(bids), bool)
        lost[won] = False
        holder[sought], price[sought], paid[sought] = who[won], bid[won], cost[won]
        waiting = np.concatenate([who[lost], ousted[ousted >= 0]])
    return np.where(holder >= 0, holder % n_x, -1).reshape(n_arms, n_y), paid.reshape(n_arms, n_y)


def matched(a: DataFrame, b: DataFrame, by: Sequence[str], p: Pricing, tolerance: float = 0.25, edges: bool = False, listed: int = 32, tile: int = 2048, held: int = 8_000_000) -> DataFrame:
    """(by, arm, a, b, cost, co, margin_row, margin_col): the one-to-one pairs of each group and arm (by its number), as ``matching.auction`` finds them among all pairs.

    ``a`` and ``b`` are ``wide``. ``co`` counts the seasons of the arm that both have. With ``edges`` margins are the least cost of any other partner less the
    pair's own, null where there is no other, else they are all null. The side with fewer ids in the group bids.

    Scale: the job compares all pairs of a group, so its CPU is quadratic, but pairs are neither written nor shuffled. Bidders are dealt to parts of
    about ``tile``; a task has a part and the group's partners, makes costs a few rows at a time and keeps the ``listed`` cheapest of each bidder. Then a group's auction runs in one
    task over these lists, which holds both sides' measures: its memory grows with ids, not with pairs. Lists that prices outgrow are made anew
    there, from the measures; costs of up to ``held`` pairs are remembered meanwhile.
    """
    by, n_arms, listed = list(by), len(p.weights), max(2, listed)
    fields = [*a.columns, *(c for c in b.columns if c not in a.columns)]
    n_of = lambda d, n: d.groupBy(*by).agg(F.count("*").alias(n))
    size = n_of(a, "_na").join(n_of(b, "_nb"), by).withColumn("_forward", F.col("_na") <= F.col("_nb"))
    size = materialised(size.select(*by, "_forward", F.ceil(F.least("_na", "_nb") / tile).cast("int").alias("_parts")))
    tasks = size.agg(F.count("*").alias("groups"), F.coalesce(F.sum("_parts"), F.lit(0)).alias("parts")).first()
    # By number, with room for keys that meet: left to itself Spark would put small tables of much work into one task.
    dealt = lambda d, n, *keys: d.repartition(max(1, min(4 * n, 4096)), *keys)
    whole = lambda d: d.select(*by, *(F.col(c) if c in d.columns else F.lit(None).cast(a.schema[c].dataType).alias(c) for c in fields if c not in by))

    def sides(first: bool) -> DataFrame:
        d = whole(a).join(size.filter("_forward" if first else "NOT _forward"), by).unionByName(whole(b).join(size.filter("NOT _forward" if first else "_forward"), by))
        return d.toDF(*d.columns)  # columns of its own: two of these meet

    bidders = sides(True).withColumn("_part", F.pmod(F.xxhash64("_id"), F.col("_parts")).cast("int"))
    partners = sides(False).withColumn("_part", F.explode(F.sequence(F.lit(0), F.col("_parts") - 1)))
    own = [f for f in bidders.drop("_part", "_parts").schema]
    kinds = {f.name: f.dataType for f in own}
    id_type = kinds["_id"]
    numbers = T.ArrayType(T.DoubleType())
    extra = [T.StructField("_kind", T.IntegerType()), T.StructField("_ys", T.ArrayType(T.IntegerType())), *(T.StructField(c, numbers) for c in ("_cs", "_lo", "_hi")), T.StructField("_who", T.ArrayType(id_type))]
    schema = T.StructType([T.StructField(f.name, f.dataType) for f in own] + extra)
    every = np.arange(n_arms)

    def lists(values: np.ndarray, kind: pa.DataType) -> pa.Array:
        flat = values.reshape(len(values), -1)
        return pa.ListArray.from_arrays(pa.array(np.arange(len(flat) + 1) * flat.shape[1], pa.int32()), pa.array(flat.reshape(-1), kind))

    def survey(tb: pa.Table, tp: pa.Table) -> pa.Table:
        names = [f.name for f in own]
        empty = tb.select(names).slice(0, 0)
        if not len(tb) or not len(tp):
            return empty.append_column("_kind", pa.array([], pa.int32())).append_column("_ys", pa.array([], pa.list_(pa.int32()))).append_column("_cs", pa.array([], pa.list_(pa.float64()))).append_column("_lo", pa.array([], pa.list_(pa.float64()))).append_column("_hi", pa.array([], pa.list_(pa.float64()))).append_column("_who", pa.array([], pa.list_(tb["_id"].type)))
        g = _Group(p, tb, tp, tb["_forward"][0].as_py())
        n, m = len(g.bidders), len(g.partners)
        ys, cs = np.zeros((n, n_arms, listed), np.int64), np.full((n, n_arms, listed), np.inf)
        lo, hi = np.full((n, n_arms), np.inf), np.full((n, n_arms), -np.inf)
        near, near_who = np.full((m, 2), np.inf), np.zeros((m, 2), np.int64)
        for rows in g.chunks(np.arange(n)):
            c = g.costs(rows, every)
            for arm in range(n_arms):
                ys[rows, arm], cs[rows, arm] = _cheapest(c[arm], listed)
                hi[rows, arm] = np.where(c[arm] < np.inf, c[arm], -np.inf).max(axis=1)
            lo[rows] = cs[rows, :, 0]
            if edges:
                # Each partner's two cheapest bidders so far.
                both, who = np.vstack([near.T, c[0]]), np.vstack([near_who.T, np.repeat(rows[:, None], m, axis=1)])
                for r in range(2):
                    at = both.argmin(axis=0)
                    near[:, r], near_who[:, r] = both[at, np.arange(m)], who[at, np.arange(m)]
                    both[at, np.arange(m)] = np.inf
        t = g.bidders.select(names)
        ids, no_ids = g.bidders["_id"].combine_chunks(), pa.ListArray.from_arrays(pa.array(np.zeros(n + 1), pa.int32()), g.bidders["_id"].combine_chunks().slice(0, 0))
        for c, v in (("_kind", pa.array(np.zeros(n), pa.int32())), ("_ys", lists(ys, pa.int32())), ("_cs", lists(cs, pa.float64())), ("_lo", lists(lo, pa.float64())), ("_hi", lists(hi, pa.float64())), ("_who", no_ids)):
            t = t.append_column(c, v)
        if edges:
            none = lambda kind: pa.nulls(m, kind)
            keep = {*by, "_id", "_forward"}
            u = pa.table({c: g.partners[c] if c in keep else none(t.schema.field(c).type) for c in names})
            who = pa.ListArray.from_arrays(pa.array(np.arange(m + 1) * 2, pa.int32()), ids.take(pa.array(near_who.reshape(-1))))
            for c, v in (("_kind", pa.array(np.ones(m), pa.int32())), ("_ys", none(pa.list_(pa.int32()))), ("_cs", lists(near, pa.float64())), ("_lo", none(pa.list_(pa.float64()))), ("_hi", none(pa.list_(pa.float64()))), ("_who", who)):
                u = u.append_column(c, v)
            t = pa.concat_tables([t, u.cast(t.schema)])
        return t

    keys = [*by, "_part"]
    found = dealt(bidders, tasks["parts"], *keys).groupBy(*keys).cogroup(dealt(partners, tasks["parts"], *keys).groupBy(*keys)).applyInArrow(survey, schema)
    surveyed = materialised(found)
    result = T.StructType([*(T.StructField(c, kinds[c]) for c in by), T.StructField("arm", T.IntegerType()), T.StructField("a", id_type), T.StructField("b", id_type), T.StructField("cost", T.DoubleType()), T.StructField("co", T.LongType()), T.StructField("margin_row", T.DoubleType()), T.StructField("margin_col", T.DoubleType())])

    def solve(ts: pa.Table, tp: pa.Table) -> pa.Table:
        import pyarrow.compute as pc

        parts: dict[str, list] = {f.name: [] for f in result if f.name not in by}
        none = {"arm": pa.array([], pa.int32()), "a": tp["_id"].combine_chunks().slice(0, 0), "b": tp["_id"].combine_chunks().slice(0, 0), "co": pa.array([], pa.int64())} | {c: pa.array([], pa.float64()) for c in ("cost", "margin_row", "margin_col")}
        if len(ts) and len(tp):
            tb, seen_by = ts.filter(pc.equal(ts["_kind"], 0)), ts.filter(pc.equal(ts["_kind"], 1))
            g = _Group(p, tb, tp, tb["_forward"][0].as_py())
            n, m = len(g.bidders), len(g.partners)
            array = lambda c, *shape: g.bidders[c].combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(n, n_arms, *shape)
            ys, cs, lo, hi = array("_ys", listed), array("_cs", listed), array("_lo"), array("_hi")
            ids_x, ids_y = g.bidders["_id"].combine_chunks(), g.partners["_id"].combine_chunks()
            near, near_who = np.full((m, 2), np.inf), np.zeros((m, 2), np.int64)
            if len(seen_by):
                # The parts' cheapest bidders of each partner, merged to two.
                y = np.repeat(pc.index_in(seen_by["_id"].combine_chunks(), value_set=ids_y).to_numpy(), 2)
                c = seen_by["_cs"].combine_chunks().flatten().to_numpy()
                x = pc.index_in(seen_by["_who"].combine_chunks().flatten(), value_set=ids_x).to_numpy()
                order = np.lexsort((x, c, y))
                place = np.arange(len(y)) - np.searchsorted(y[order], y[order])
                for r in range(2):
                    at = order[place == r]
                    near[y[at], r], near_who[y[at], r] = c[at], x[at]
            together = np.concatenate([g.costs(rows, every) for rows in g.chunks(np.arange(n))], axis=1) if 1 < n_arms and n_arms * n * m <= held else np.full((n_arms, n, m), np.nan) if n_arms * n * m <= held else None

            def more(who: np.ndarray, price: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
                out_y, out_c, limit = np.zeros((len(who), listed), np.int64), np.full((len(who), listed), np.inf), np.full(len(who), np.inf)
                for arm in np.unique(who // n):
                    mine, its = np.flatnonzero(who // n == arm), price[arm * m : (arm + 1) * m]
                    for at in g.chunks(mine):
                        rows = who[at] % n
                        if together is None:
                            c = g.costs(rows, every[arm : arm + 1])[0]
                        else:
                            new = rows[np.isnan(together[arm, rows, 0])]
                            if len(new):
                                together[arm, new] = g.costs(new, every[arm : arm + 1])[0]
                            c = together[arm, rows]
                        out_y[at], total = _cheapest(c + its, listed)
                        out_c[at], limit[at] = np.where(total < np.inf, np.take_along_axis(c, out_y[at], axis=1), np.inf), total[:, -1]
                return out_y, out_c, limit

            holders, costs = _rounds(ys.transpose(1, 0, 2).astype(np.int64), cs.transpose(1, 0, 2), lo.min(axis=0), hi.max(axis=0), m, tolerance, more)
            for arm in range(n_arms):
                holder, paid = holders[arm], costs[arm]
                y = np.flatnonzero(holder >= 0)
                x, own_cost = holder[y], paid[y]
                other_x = np.where((ys[x, arm, 0] == y) & (cs[x, arm, 0] < np.inf), cs[x, arm, 1], cs[x, arm, 0])
                other_y = np.where((near_who[y, 0] == x) & (near[y, 0] < np.inf), near[y, 1], near[y, 0])
                ia, ib = (x, y) if g.forward else (y, x)
                edge = [v if edges else np.full(len(y), np.inf) for v in ((other_x, other_y) if g.forward else (other_y, other_x))]
                co = (g.in_arm[arm][:, None] & g.has_a[:, ia] & g.has_b[:, ib]).sum(axis=0)
                row = {"arm": pa.array(np.full(len(y), arm), pa.int32()), "a": (ids_x if g.forward else ids_y).take(pa.array(ia)), "b": (ids_y if g.forward else ids_x).take(pa.array(ib)), "cost": pa.array(own_cost), "co": pa.array(co.astype(np.int64))}
                row |= {c: pa.array(v - own_cost, mask=np.isinf(v)) for c, v in zip(("margin_row", "margin_col"), edge, strict=True)}
                for c, v in row.items():
                    parts[c].append(v)
        got = {c: pa.concat_arrays(v) if v else none[c] for c, v in parts.items()}
        return pa.table({c: pa.repeat(tp[c][0], len(got["a"])) if len(got["a"]) else tp[c].combine_chunks().slice(0, 0) for c in by} | got)

    out = materialised(dealt(surveyed, tasks["groups"], *by).groupBy(*by).cogroup(dealt(sides(False), tasks["groups"], *by).groupBy(*by)).applyInArrow(solve, result))
    discard(size, surveyed)
    return out
