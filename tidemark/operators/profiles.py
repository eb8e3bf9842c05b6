"""Measurement profiles of entities: prefix profiles, conditional deltas, mixes and snapshots."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .joins import on_keys
from .sessions import average_rank, prefix_profile, z_in_group


def measured_cells(rows: DataFrame, entity: str, season: str, group: str, measures: list[str], flag: str) -> DataFrame:
    """Per (entity, season, group): of each measure n, sum s and sum of squares q of its z within (season, group), and rows and flagged rows.

    Distances from the season's mean of the group take equipment's drift and the repertoire out. A null key is a group.
    """
    d = rows
    for m in measures:
        d = z_in_group(d, m, [season, group], f"_z_{m}")
    sums = [a for m in measures for z in [F.col(f"_z_{m}")] for a in (F.count(z).alias(f"n_{m}"), F.sum(z).alias(f"s_{m}"), F.sum(z * z).alias(f"q_{m}"))]
    return d.groupBy(entity, season, group).agg(*sums, F.count("*").alias("rows"), F.sum(F.col(flag)).alias("flagged"))


def career_prefix(cells: DataFrame, entity: str, season: str, group: str, main: str, other: str, speed: str, spin: str, moves: list[str], least: int = 100, least_group: int = 30, ahead: int = 0) -> DataFrame:
    """Six profile values per (entity, season) from all seasons strictly before it; NULL below ``least`` measured rows.

    ``sd_speed`` and ``sd_move`` pool the variance within (season, group) cells of two rows or more, so that neither a season's drift nor the
    mix of groups is spread; ``speed_main`` and ``spin_main`` are the main group's means, ``separation`` the main group's speed less the
    other's, each from ``least_group`` rows; ``share`` is that of flagged rows. ``cells`` is what ``measured_cells`` gives.
    """
    inner = lambda m: F.when(F.col(f"n_{m}") >= 2, F.col(f"q_{m}") - F.col(f"s_{m}") * F.col(f"s_{m}") / F.col(f"n_{m}")).otherwise(0.0)
    dof = lambda m: F.when(F.col(f"n_{m}") >= 2, F.col(f"n_{m}") - 1).otherwise(0)
    of = lambda g, c: F.coalesce(F.sum(F.when(F.col(group) == g, F.col(c))), F.lit(0))
    sums = {
        "ss": F.sum(inner(speed)), "df": F.sum(dof(speed)), "ms": F.sum(sum((inner(m) for m in moves[1:]), inner(moves[0]))), "md": F.sum(sum((dof(m) for m in moves[1:]), dof(moves[0]))),
        "vn": of(main, f"n_{speed}"), "vs": of(main, f"s_{speed}"), "pn": of(main, f"n_{spin}"), "ps": of(main, f"s_{spin}"), "on": of(other, f"n_{speed}"), "os": of(other, f"s_{speed}"),
        "tn": F.sum(f"n_{speed}"), "rn": F.sum("rows"), "rf": F.sum("flagged"),
    }
    wide = cells.groupBy(entity, season).agg(*(c.alias(n) for n, c in sums.items()))
    p = prefix_profile(wide, [entity], list(sums), season, ahead)
    ratio = lambda top, n, floor=1: F.when(F.col(n) >= floor, F.col(top) / F.col(n))
    fast = ratio("vs", "vn", least_group)
    values = {"sd_speed": F.sqrt(F.greatest(F.lit(0.0), ratio("ss", "df"))), "sd_move": F.sqrt(F.greatest(F.lit(0.0), ratio("ms", "md"))), "speed_main": fast, "spin_main": ratio("ps", "pn", least_group), "separation": fast - ratio("os", "on", least_group), "share": ratio("rf", "rn")}
    return p.select(entity, season, *(F.when(F.col("tn") >= least, c).alias(n) for n, c in values.items()))


def group_mix(rows: DataFrame, profile: DataFrame, entity: str, mix: dict[str, str], value: str = "value", group: str = "grp") -> DataFrame:
    """Adds ``mixed``: the profile's values averaged by the row's mix, over the groups that the profile has."""
    wide = profile.groupBy(entity).agg(*(F.max(F.when(F.col(group) == g, F.col(value))).alias(f"_v_{g}") for g in mix))
    d = rows.join(wide, entity, "left")
    top = sum((F.when(F.col(f"_v_{g}").isNotNull(), F.col(c) * F.col(f"_v_{g}")).otherwise(0.0) for g, c in mix.items()), F.lit(0.0))
    bottom = sum((F.when(F.col(f"_v_{g}").isNotNull(), F.col(c)).otherwise(0.0) for g, c in mix.items()), F.lit(0.0))
    return d.withColumn("mixed", F.when(bottom > 0, top / bottom)).drop(*(f"_v_{g}" for g in mix))


def conditional_delta(rows: DataFrame, entity: str, season: str, group: str, condition: str, value: str, pseudo: float = 30.0, least: int = 30, ahead: int = 0) -> DataFrame:
    """(entity, season, group, condition, n, delta): how the value, as z within (season, group), departs under a condition from the
    entity's own mean of the group, over the seasons strictly before; times n / (n + pseudo), 0 where the base has fewer than ``least`` rows.

    Only conditions met before have a row.
    """
    d = z_in_group(rows, value, [season, group], "_z").groupBy(entity, season, group, condition).agg(F.count("_z").alias("n"), F.coalesce(F.sum("_z"), F.lit(0.0)).alias("s"))
    cell = prefix_profile(d, [entity, group, condition], ["n", "s"], season, ahead).filter("n > 0")
    base = prefix_profile(d.groupBy(entity, season, group).agg(F.sum("n").alias("bn"), F.sum("s").alias("bs")), [entity, group], ["bn", "bs"], season, ahead)
    j = on_keys(cell, base, [entity, group, season])
    delta = (F.col("s") / F.col("n") - F.col("bs") / F.col("bn")) * F.col("n") / (F.col("n") + pseudo)
    return j.select(entity, season, group, condition, "n", F.when(F.col("bn") >= least, delta).otherwise(0.0).alias("delta"))


def posterior_tilt(rows: DataFrame, entity: str, season: str, condition: str, category: str, pseudo: float = 30.0, least: int = 30, ahead: int = 0) -> DataFrame:
    """(entity, season, condition, category, tilt): a category's share under a condition, smoothed to the entity's own share with
    ``pseudo`` rows, over that share, from the seasons strictly before. Entities with fewer than ``least`` rows before have none.

    Every category that the entity has shown before has a row under every condition it was in before.
    """
    n = rows.groupBy(entity, season, condition, category).agg(F.count("*").alias("n"))
    cell = prefix_profile(n, [entity, condition, category], ["n"], season, ahead)
    by = Window.partitionBy(entity, season)
    own = cell.groupBy(entity, season, category).agg(F.sum("n").alias("own")).withColumn("total", F.sum("own").over(by)).filter((F.col("own") > 0) & (F.col("total") >= least))
    met = cell.groupBy(entity, season, condition).agg(F.sum("n").alias("m")).filter("m > 0")
    grid = on_keys(own, met, [entity, season])
    j = on_keys(grid, cell, [entity, season, condition, category], "left")
    share = F.col("own") / F.col("total")
    return j.select(entity, season, condition, category, (((F.coalesce("n", F.lit(0)) + pseudo * share) / (F.col("m") + pseudo)) / share).alias("tilt"))


def prefix_dispersion(cells: DataFrame, entity: str, season: str, group: str, speed: str, moves: list[str], least: int = 30, ahead: int = 0) -> DataFrame:
    """(entity, season, group, sd_speed, sd_move): deviations within cells, pooled over the seasons strictly before; needs ``least`` - 1 degrees of freedom."""
    inner = lambda m: F.when(F.col(f"n_{m}") >= 2, F.col(f"q_{m}") - F.col(f"s_{m}") * F.col(f"s_{m}") / F.col(f"n_{m}")).otherwise(0.0)
    dof = lambda m: F.when(F.col(f"n_{m}") >= 2, F.col(f"n_{m}") - 1).otherwise(0)
    total = lambda f: sum((f(m) for m in moves[1:]), f(moves[0]))
    d = cells.select(entity, season, group, inner(speed).alias("ss"), dof(speed).alias("df"), total(inner).alias("ms"), total(dof).alias("md"))
    p = prefix_profile(d, [entity, group], ["ss", "df", "ms", "md"], season, ahead).filter(F.col("df") >= least - 1)
    root = lambda s, n: F.when(F.col(n) > 0, F.sqrt(F.greatest(F.lit(0.0), F.col(s) / F.col(n))))
    return p.select(entity, season, group, root("ss", "df").alias("sd_speed"), root("ms", "md").alias("sd_move"))


def snapshot(levels: DataFrame, entity: str, season: str, values: list[str], cutoff: int) -> DataFrame:
    """The last season before the cutoff: its values, their change to the season before, and the years since."""
    w = Window.partitionBy(entity).orderBy(season)
    d = levels.filter(F.col(season) < cutoff)
    d = d.select(entity, season, *values, *((F.col(v) - F.lag(v).over(w)).alias(f"d_{v}") for v in values))
    last = d.groupBy(entity).agg(F.max_by(F.struct(season, *values, *(f"d_{v}" for v in values)), season).alias("x"))
    return last.select(entity, (cutoff - F.col(f"x.{season}")).alias("age"), *(F.col(f"x.{v}").alias(v) for v in values), *(F.col(f"x.d_{v}").alias(f"d_{v}") for v in values))


def season_profile(cells: DataFrame, entity: str, season: str, group: str, main: str, other: str, least: int, least_level: int) -> DataFrame:
    """Per entity and season with ``least`` rows: ``sd`` pooled within groups, ``level`` of the main group, ``share`` of the other, and the rank of each in its season.

    Spread comes from within the groups, so how rows are divided among them doesn't count as spread. The level is NULL below
    ``least_level`` rows; a rank is the average percentile among the season's known values. ``cells`` has n, s (sum) and q (sum of squares).
    """
    keys = [entity, season]
    several = F.col("n") >= 2
    n_of = lambda g, c: F.sum(F.when(F.col(group) == g, F.col(c)))
    p = cells.groupBy(*keys).agg(
        F.sum("n").alias("_n"),
        (F.sum(F.when(several, F.col("q") - F.col("s") * F.col("s") / F.col("n"))) / F.sum(F.when(several, F.col("n") - 1))).alias("_v"),
        F.when(n_of(main, "n") >= least_level, n_of(main, "s") / n_of(main, "n")).alias("level"),
        (F.coalesce(n_of(other, "n"), F.lit(0)) / F.sum("n")).alias("share"),
    )
    p = p.filter(F.col("_n") >= least).select(*keys, F.sqrt("_v").alias("sd"), "level", "share")
    for c in ("sd", "level", "share"):
        p = average_rank(p, c, [season]).withColumnRenamed("pct", f"rank_{c}")
    return p
