"""Sessions, ranks and frames within ordered groups."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import common_denominator
from .history import before
from .joins import on_keys
from .ordered import running


def sessions(df: DataFrame, entity: str = "entity", order: str = "row_id", changed: list[str] = (), jumps: dict[str, float] | None = None, drops: dict[str, float] | None = None) -> DataFrame:
    """Adds ``session``, counted from 1 within the entity.

    A session begins at the entity's first row, where a column of ``changed`` differs from the row before, where one of
    ``jumps`` moves by more than its limit or appears after NULL, and where one of ``drops`` falls by more than its limit.
    """
    w = Window.partitionBy(entity).orderBy(order)
    rules = [F.lag(order).over(w).isNull()]
    rules += [F.coalesce(F.col(c) != F.lag(c).over(w), F.lit(False)) for c in changed]
    for c, limit in (jumps or {}).items():
        rules.append(F.coalesce(F.abs(F.col(c) - F.lag(c).over(w)) > limit, F.lit(False)) | (F.col(c).isNotNull() & F.lag(c).over(w).isNull()))
    rules += [F.coalesce(F.col(c) < F.lag(c).over(w) - limit, F.lit(False)) for c, limit in (drops or {}).items()]
    opens = df.withColumn("_opens", reduce(lambda a, b: a | b, rules).cast("long"))
    return opens.withColumn("session", F.sum("_opens").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_opens")


def gap_to_previous_other(df: DataFrame, what: str, entity: str = "entity", order: str = "row_id") -> DataFrame:
    """Adds ``gap``: how far back (in ``order``) the last row with another value of ``what`` lies; NULL if there is none."""
    w = Window.partitionBy(entity).orderBy(order)
    other = F.when(F.lag(order).over(w).isNotNull() & ~F.col(what).eqNullSafe(F.lag(what).over(w)), F.lag(order).over(w))
    return df.withColumn("_at", other).withColumn("gap", F.col(order) - F.last("_at", True).over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_at")


def average_rank(df: DataFrame, value: str, by: list[str]) -> DataFrame:
    """Adds ``pct``: the rank of the value in its group as a share, ties at their average; NULL for a NULL value.

    Distinct values are counted and numbered over range partitions of (group, value), so a group with many rows isn't
    sorted in one task; a group's first number comes from its least.
    """
    counts = df.filter(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count("*").alias("_c"))
    upto = running(counts, [*by, value], "_c", "_upto")
    groups = upto.groupBy(*by).agg(F.sum("_c").alias("_all"), F.max("_upto").alias("_end"))
    place = upto.join(groups, by).select(*by, value, ((F.col("_upto") - (F.col("_end") - F.col("_all")) - (F.col("_c") - 1) / 2) / F.col("_all")).alias("pct"))
    return df.join(place, [*by, value], "left")


def anchored_rank(df: DataFrame, reference: DataFrame, value: str) -> DataFrame:
    """Adds ``pct``: the share of reference values below a row's value, ties counting half.

    The reference is counted per value and broadcast as sorted arrays when small; rows look their place up.
    A reference of more than 100,000 different values is ranked with the rows in range partitions instead.
    """
    counts = reference.filter(F.col(value).isNotNull()).groupBy(value).agg(F.count("*").alias("_c"))
    rows = counts.orderBy(value).take(100_001)
    if len(rows) > 100_000:
        distinct = df.select(value).distinct().join(counts, value, "full_outer").fillna(0, ["_c"])
        ranked = ranked_by_range(distinct, value, "_c")
        return df.join(ranked, value, "left")
    total, upto, at = sum(r["_c"] for r in rows), 0, []
    for r in rows:
        at.append((float(r[value]), float(upto)))
        upto += r["_c"]
    spark = df.sparkSession
    edges = [(None, at[0][0] if at else None, 0.0, 0.0)]
    for i, (v, below) in enumerate(at):
        upper = at[i + 1][1] if i + 1 < len(at) else float(total)
        edges.append((v, v, below, upper))
    table = spark.createDataFrame([([e[1] for e in edges[1:]], [e[2] for e in edges[1:]], [e[3] for e in edges[1:]])], "_v array<double>, _below array<double>, _upto array<double>")
    d = df.crossJoin(F.broadcast(table))
    place = F.aggregate(F.sequence(F.lit(1), F.lit(max(1, len(at).bit_length() + 1))), F.struct(F.lit(0).alias("lo"), F.size("_v").alias("hi")), lambda s, _: F.when(s["lo"] >= s["hi"], s).otherwise(F.when(F.get(F.col("_v"), F.floor((s["lo"] + s["hi"]) / 2).cast("int")) < F.col(value), F.struct((F.floor((s["lo"] + s["hi"]) / 2) + 1).cast("int").alias("lo"), s["hi"].alias("hi"))).otherwise(F.struct(s["lo"].alias("lo"), F.floor((s["lo"] + s["hi"]) / 2).cast("int").alias("hi")))))
    d = d.withColumn("_i", place["lo"])
    exact = F.coalesce(F.get(F.col("_v"), F.col("_i")) == F.col(value), F.lit(False))
    below = F.coalesce(F.get(F.col("_below"), F.col("_i")), F.lit(float(total)))
    upper = F.when(exact, F.get(F.col("_upto"), F.col("_i"))).otherwise(below)
    return d.withColumn("pct", (below + upper) / (2.0 * total)).drop("_v", "_below", "_upto", "_i")


def ranked_by_range(counts: DataFrame, value: str, n: str) -> DataFrame:
    """(value, pct) of counted distinct values: running sums within range partitions, plus the sums of the partitions before."""
    parts = counts.repartitionByRange(value).withColumn("_p", F.spark_partition_id())
    own = parts.withColumn("_upto", F.sum(n).over(Window.partitionBy("_p").orderBy(value)))
    sums = parts.groupBy("_p").agg(F.sum(n).alias("_s"))
    # One row a partition.
    start = sums.withColumn("_start", F.coalesce(F.sum("_s").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    total = F.sum("_s").over(Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    start = start.withColumn("_total", total).select("_p", "_start", "_total")
    return own.join(F.broadcast(start), "_p").select(value, ((2 * (F.col("_start") + F.col("_upto")) - F.col(n)) / (2.0 * F.col("_total"))).alias("pct"))


def bands(counts: DataFrame, by: list[str] = ("entity", "season"), order: str = "session", weight: float = 20.0) -> DataFrame:
    """Adds what the last five sessions of the same group (entity and season) were: bands of one, two to three and four to five back.

    Of each band log(1 + n) and the rate shrunk to one half, with ``weight`` for one session and twice that for two; ``trend`` is the
    first band's rate less the last's, ``workload`` the last session's n less the mean of five. NULL where a session is missing.
    """
    w = Window.partitionBy(*by).orderBy(order)
    total = lambda c, i: sum((F.lag(c, j).over(w) for j in i[1:]), F.lag(c, i[0]).over(w))
    spans = {"1": [1], "23": [2, 3], "45": [4, 5]}
    n = {b: total("n", i) for b, i in spans.items()}
    rate = {b: (total("k", i) + weight * len(i) / 2) / (n[b] + weight * len(i)) for b, i in spans.items()}
    out = {f"log{b}": F.log1p(n[b]) for b in spans} | {f"band{b}": rate[b] for b in spans}
    return counts.withColumns(out | {"trend": rate["1"] - rate["45"], "workload": n["1"] - (n["1"] + n["23"] + n["45"]) / 5.0})


def prefix_profile(cells: DataFrame, keys: list[str], sums: list[str], season: str = "season", ahead: int = 0) -> DataFrame:
    """Sums over all seasons strictly before, on the full grid of keys and seasons (``ahead`` seasons beyond the last)."""
    seasons = cells.select(season).distinct()
    if ahead:
        seasons = seasons.union(seasons.agg(F.max(season).alias(season)).select(F.explode(F.sequence(F.col(season) + 1, F.col(season) + ahead))))
    grid = cells.select(*keys).distinct().crossJoin(F.broadcast(seasons))
    w = before(keys, season)
    d = on_keys(grid, cells.select(*keys, season, *sums), [*keys, season], "left")
    return d.select(*keys, season, *(F.coalesce(F.sum(c).over(w), F.lit(0)).alias(c) for c in sums))


def z_in_group(df: DataFrame, value: str, by: list[str], out: str = "z") -> DataFrame:
    """Adds the value's distance from its group's mean in sample standard deviations; NULL where that is 0 or unknown; a null key is a group.

    Groups are aggregated and joined back, so a group with a third of the rows isn't sorted in one task.
    """
    stats = df.groupBy(*by).agg(F.avg(value).alias("_m"), F.stddev_samp(value).alias("_s"))
    return on_keys(df, stats, by).withColumn(out, F.when(F.col("_s") > 0, (F.col(value) - F.col("_m")) / F.col("_s"))).drop("_m", "_s")


def double_centred(df: DataFrame, value: str, a: str, b: str) -> DataFrame:
    """Adds ``centred``: the value less the means of both groups, plus the overall mean."""
    ma = df.groupBy(a).agg(F.avg(value).alias("_a"))
    mb = df.groupBy(b).agg(F.avg(value).alias("_b"))
    m = df.agg(F.avg(value).alias("_m"))
    d = on_keys(on_keys(df, ma, [a]), mb, [b]).crossJoin(F.broadcast(m))
    return d.withColumn("centred", F.col(value) - F.col("_a") - F.col("_b") + F.col("_m")).drop("_a", "_b", "_m")


def last_k(df: DataFrame, columns: list[str], k: int, pad: dict, entity: str = "entity", order: str = "row_id") -> DataFrame:
    """Adds ``seq``: structs of the last ``k`` rows before, oldest first, padded on the left."""
    w = before(entity, order, k)
    rows = F.collect_list(F.struct(*columns)).over(w)
    blank = F.struct(*(F.lit(pad[c]).cast(dict(df.dtypes)[c]).alias(c) for c in columns))
    return df.withColumn("_rows", rows).withColumn("seq", F.concat(F.array_repeat(blank, k - F.size("_rows")), F.col("_rows"))).drop("_rows")


def window_audit(measured: DataFrame, stated: DataFrame, entity: str = "entity", season: str = "season", order: str = "session", most: int = 160, tolerance: float = 1e-5) -> DataFrame:
    """One row: whether the rates that a session states for the one before are those measured there.

    ``measured`` is (entity, session, season, n, rate), ``stated`` (entity, session, rate, other) with two stated rates. Sessions
    whose next one is in the same season and states a rate are ``compared``; ``agree`` counts those within the tolerance. From
    the two stated rates the number of rows is recovered where both are there: ``exact`` counts those equal to the measured one,
    ``divisor`` those that divide it, ``unknown`` those without any number up to ``most``.
    """
    w = Window.partitionBy(entity).orderBy(order)
    next_ = {"_session": F.lead(order).over(w), "_season": F.lead(season).over(w)}
    m = measured.withColumns(next_).filter(F.col("_season") == F.col(season)).select(entity, F.col("_session").alias(order), "n", F.col("rate").alias("_rate"))
    j = m.join(stated, [entity, order]).filter("rate IS NOT NULL")
    n = F.when(F.col("other").isNotNull(), common_denominator([F.col("rate"), F.col("other")], most))
    d = j.withColumns({"_n": n, "_both": F.col("other").isNotNull()})
    return d.agg(
        F.count("*").alias("compared"),
        F.count_if(F.abs(F.col("rate") - F.col("_rate")) < tolerance).alias("agree"),
        F.count_if("_both").alias("recovered_from"),
        F.count_if(F.col("_n") == F.col("n")).alias("exact"),
        F.count_if(F.col("n") % F.col("_n") == 0).alias("divisor"),
        F.count_if(F.col("_both") & F.col("_n").isNull()).alias("unknown"),
    )
