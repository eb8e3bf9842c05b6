"""History of entities: what was known strictly before a row or a season."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F


def before(entity: str | list[str], order: str = "row_id", rows: int | None = None) -> WindowSpec:
    """All rows of the entity before the current one, or the last ``rows`` of them."""
    return Window.partitionBy(entity).orderBy(order).rowsBetween(Window.unboundedPreceding if rows is None else -rows, -1)


def shrunk(total: Column, n: Column, k: float, mean: float | Column) -> Column:
    """(total + k * mean) / (n + k): a rate pulled to ``mean`` with the weight of ``k`` rows. NULL sums count as none."""
    return (F.coalesce(total, F.lit(0)) + k * mean) / (n + k)


def as_of_rate(df: DataFrame, out: str, entity: str | list[str], y: str = "y", k: float = 50.0, mean: float = 0.2, order: str = "row_id", rows: int | None = None, mask: Column | None = None) -> DataFrame:
    """Adds the shrunk success rate of the rows before, optionally the last ``rows`` and only where ``mask`` holds."""
    w = before(entity, order, rows)
    v = F.col(y) if mask is None else F.when(mask, F.col(y))
    return df.withColumn(out, shrunk(F.sum(v).over(w), F.count(v).over(w), k, mean))


def beta_state(df: DataFrame, entity: str, y: str = "y", a: float = 1.0, b: float = 4.0, order: str = "row_id") -> DataFrame:
    """Adds ``past_n``, ``past_k`` and the variance of the Beta(a + k, b + n - k) posterior."""
    w = before(entity, order)
    n, k = F.count("*").over(w), F.coalesce(F.sum(y).over(w), F.lit(0))
    d = df.withColumns({"past_n": n, "past_k": k})
    pa, pb = a + F.col("past_k"), b + F.col("past_n") - F.col("past_k")
    return d.withColumn("beta_var", pa * pb / ((pa + pb) * (pa + pb) * (pa + pb + 1)))


def season_end(log: DataFrame, entity: str = "entity", season: str = "season", n: str = "n", k: str = "k", y: str = "y", row_id: str = "row_id") -> DataFrame:
    """(entity, season, n_end, k_end): the counters after the last row of each season.

    The last row is that with the greatest counter, of several the one with the least id; its own outcome counts.
    """
    top = Window.partitionBy(entity, season).orderBy(F.desc(n), row_id)
    last = log.withColumn("_r", F.row_number().over(top)).filter("_r = 1")
    return last.select(entity, season, (F.col(n) + 1).alias("n_end"), (F.col(k) + F.col(y)).alias("k_end"))


def as_of_season(rows: DataFrame, ends: DataFrame, entity: str = "entity", season: str = "season", values: tuple[str, ...] = ("n_end", "k_end")) -> DataFrame:
    """Each row with the values of its entity's last season strictly before its own, as ``base_<value>``; 0 if there is none.

    Seasons in which the entity has rows or ends form its grid (a few rows an entity); the last known end before
    each is one window over it, and the rows join it by an equi-join. No range join, no fan-out.
    """
    grid = rows.select(entity, season).distinct().join(ends, [entity, season], "full_outer")
    w = Window.partitionBy(entity).orderBy(season).rowsBetween(Window.unboundedPreceding, -1)
    base = grid.select(entity, season, *(F.last(v, True).over(w).alias(f"base_{v}") for v in values))
    return rows.join(base, [entity, season], "left").fillna(0, [f"base_{v}" for v in values])


def season_increment(ends: DataFrame, entity: str = "entity", season: str = "season") -> DataFrame:
    """What each season added to the counters; after a reset (a smaller counter) the season's total. ``dk`` stays within 0 and ``dn``."""
    w = Window.partitionBy(entity).orderBy(season)
    d = ends.withColumns({"pn": F.coalesce(F.lag("n_end").over(w), F.lit(0)), "pk": F.coalesce(F.lag("k_end").over(w), F.lit(0))})
    reset = F.col("n_end") < F.col("pn")
    d = d.withColumns({"dn": F.when(reset, F.col("n_end")).otherwise(F.col("n_end") - F.col("pn")), "dk": F.when(reset, F.col("k_end")).otherwise(F.col("k_end") - F.col("pk"))})
    return d.select(entity, season, "dn", F.greatest(F.lit(0), F.least("dk", "dn")).alias("dk"))


def completed_seasons(ends: DataFrame, weight: float = 200.0, least: int = 50, entity: str = "entity", season: str = "season") -> DataFrame:
    """What is known once a season is over, per (entity, season): of its increment log(1 + n) as ``ps_logn`` and the rate shrunk to one
    half as ``ps_sm``, the rate's change to the season before as ``ps_trend``, and the deviation of all seasons' own rates so far as ``ps_vol``.

    A season counts by what it adds to the one before, so an entity's first has no value. Own rates need ``least`` rows, the deviation two of them.
    """
    w = Window.partitionBy(entity).orderBy(season)
    n, k = F.col("n_end") - F.lag("n_end").over(w), F.col("k_end") - F.lag("k_end").over(w)
    d = ends.withColumns({"_n": F.when(n >= 1, n), "_k": k}).withColumns({"ps_sm": (F.col("_k") + weight / 2) / (F.col("_n") + weight), "_own": F.when(F.col("_n") >= least, F.col("_k") / F.col("_n"))})
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    spread = F.when(F.count("_own").over(upto) >= 2, F.stddev_samp("_own").over(upto))
    return d.select(entity, season, F.log1p("_n").alias("ps_logn"), "ps_sm", (F.col("ps_sm") - F.lag("ps_sm").over(w)).alias("ps_trend"), spread.alias("ps_vol"))


def latest_before(rows: DataFrame, table: DataFrame, values: list[str], entity: str = "entity", season: str = "season") -> DataFrame:
    """Rows with the values of the entity's last season in ``table`` before their own; NULL without one.

    The table is laid out over the grid of entities and seasons and joined by equal keys.
    """
    seasons = rows.select(season).union(table.select(season)).distinct()
    grid = table.select(entity).distinct().crossJoin(F.broadcast(seasons)).join(table.select(entity, season, F.struct(*values).alias("_v")), [entity, season], "left")
    last = grid.select(entity, season, F.last("_v", True).over(before(entity, season)).alias("_v"))
    return rows.join(last, [entity, season], "left").select(*rows.columns, *(F.col(f"_v.{v}").alias(v) for v in values))


def in_season_split(rows: DataFrame, K: float = 100.0, prefix: str = "is") -> DataFrame:
    """Splits career counters (n, k) by the season-end base (base_n_end, base_k_end) into this season's part.

    Adds n and k since the base (k within 0 and n), log(1 + n), the rate shrunk to one half with weight K, its difference
    to the career rate shrunk with weight 500, and the share of the career.
    """
    n = F.greatest(F.lit(0), F.col("n") - F.col("base_n_end"))
    d = rows.withColumns({f"{prefix}_n": n, f"{prefix}_k": F.least(n, F.greatest(F.lit(0), F.col("k") - F.col("base_k_end")))})
    rate = (F.col(f"{prefix}_k") + K / 2) / (F.col(f"{prefix}_n") + K)
    career = (F.col("k") + 250.0) / (F.col("n") + 500.0)
    return d.withColumns({f"{prefix}_logn": F.log1p(f"{prefix}_n"), f"{prefix}_rate": rate, f"{prefix}_delta": rate - career, f"{prefix}_share": F.col(f"{prefix}_n") / F.greatest(F.col("n"), F.lit(1))})


def in_season_block(rows: DataFrame, counts: list[str], K: float, prefix: str) -> DataFrame:
    """The in-season split of several counters at once (k_<name> beside n, bases base_n_end and base_k_<name>).

    Adds <prefix>_logn and _share, and for each counter its level <prefix>_<name>_sm (this season's rate shrunk to one half with
    weight K) and its departure _d from the career rate shrunk alike.
    """
    n = F.greatest(F.lit(0), F.col("n") - F.col("base_n_end"))
    out = {f"{prefix}_logn": F.log1p(n), f"{prefix}_share": n / F.greatest(F.col("n"), F.lit(1))}
    for c in counts:
        k = F.least(n, F.greatest(F.lit(0), F.col(f"k_{c}") - F.col(f"base_k_{c}")))
        level = (k + K / 2) / (n + K)
        out |= {f"{prefix}_{c}_sm": level, f"{prefix}_{c}_d": level - (F.col(f"k_{c}") + K / 2) / (F.col("n") + K)}
    return rows.withColumns(out)


def freeze_at(df: DataFrame, cutoff: int, entity: str = "entity", season: str = "season", y: str = "y", k: float = 50.0, mean: float = 0.2) -> DataFrame:
    """Adds the entity's shrunk rate over all rows before the cutoff season, the same for all its rows."""
    w = Window.partitionBy(entity)
    past = F.when(F.col(season) < cutoff, F.col(y))
    return df.withColumn("frozen_rate", shrunk(F.sum(past).over(w), F.count(past).over(w), k, mean))


def leave_one_out(df: DataFrame, key: str | list[str], K: float = 20.0, mean: float = 0.2, y: str = "y") -> DataFrame:
    """Adds the shrunk rate of the key's other rows. Keys are aggregated and joined back, so a key with many rows isn't gathered."""
    keys = [key] if isinstance(key, str) else key
    sums = df.groupBy(*keys).agg(F.sum(y).alias("_k"), F.count("*").alias("_n")).withColumnsRenamed({k: f"_{k}" for k in keys})
    on = [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys]
    d = df.join(sums, on).drop(*(f"_{k}" for k in keys))
    return d.withColumn("loo_rate", (F.col("_k") - F.col(y) + K * mean) / (F.col("_n") - 1 + K)).drop("_k", "_n")


def earlier_seasons(df: DataFrame, keys: list[str], season: str = "season", y: str = "y") -> DataFrame:
    """Each row with n and k of its keys over all seasons strictly before, as ``prior_n`` and ``prior_k``."""
    cells = df.groupBy(*keys, season).agg(F.count("*").alias("n_"), F.sum(y).alias("k_"))
    w = Window.partitionBy(*keys).orderBy(season).rowsBetween(Window.unboundedPreceding, -1)
    prior = cells.select(*keys, season, F.coalesce(F.sum("n_").over(w), F.lit(0)).alias("prior_n"), F.coalesce(F.sum("k_").over(w), F.lit(0)).alias("prior_k"))
    return df.join(prior, [*keys, season], "left")


def recover_events(df: DataFrame, entity: str = "entity", order: str = "row_id", n: str = "n", k: str = "k") -> DataFrame:
    """Adds the outcome of each row as the difference to the next row's counter; NULL where the counter doesn't advance by one."""
    w = Window.partitionBy(entity).orderBy(order)
    return df.withColumn("recovered", F.when(F.lead(n).over(w) - F.col(n) == 1, F.lead(k).over(w) - F.col(k)))


def clock_audit(df: DataFrame, entity: str = "entity", order: str = "row_id", n: str = "n") -> DataFrame:
    """Share of steps within an entity at which the counter doesn't rise by exactly one."""
    w = Window.partitionBy(entity).orderBy(order)
    step = df.select((F.col(n) - F.lag(n).over(w)).alias("d")).filter("d IS NOT NULL")
    return step.agg(F.count("*").alias("steps"), F.round(F.avg((F.col("d") != 1).cast("int")), 6).alias("bad_share"))
