"""Orders over whole tables without a window over one task: range partitions, and the sums of those before."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.files import materialised


def _ranges(df: DataFrame, order: list[str | Column], size: Column) -> tuple[DataFrame, DataFrame]:
    """``df`` in range partitions ``_p``, written so that they stay as they are, and each one's ``_start`` with the ``_total``."""
    parts = materialised(df.repartitionByRange(*order).withColumn("_p", F.spark_partition_id()))
    sums = parts.groupBy("_p").agg(F.sum(size).alias("_s"))
    # One row a partition.
    start = F.coalesce(F.sum("_s").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    total = F.sum("_s").over(Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    return parts, sums.select("_p", start.alias("_start"), total.alias("_total"))


def running(df: DataFrame, order: list[str], size: str, out: str) -> DataFrame:
    """Adds the sum of ``size`` over the rows up to this one, in order. ``order`` should decide between all rows."""
    parts, start = _ranges(df, order, F.col(size))
    own = parts.withColumn("_own", F.sum(size).over(Window.partitionBy("_p").orderBy(*order)))
    return own.join(F.broadcast(start), "_p").withColumn(out, F.col("_start") + F.col("_own")).drop("_p", "_own", "_start", "_total")


def numbered(df: DataFrame, order: list[str | Column], out: str) -> DataFrame:
    """Adds the row's number in order, from 1. ``order`` should decide between all rows."""
    keyed = df.withColumns({f"_o{i}": F.col(c) if isinstance(c, str) else c for i, c in enumerate(order)})
    keys = [f"_o{i}" for i in range(len(order))]
    parts, start = _ranges(keyed, keys, F.lit(1))
    own = parts.withColumn("_n", F.row_number().over(Window.partitionBy("_p").orderBy(*keys)))
    return own.join(F.broadcast(start), "_p").withColumn(out, F.col("_start") + F.col("_n")).drop("_p", "_n", "_start", "_total", *keys)


def quantiles(df: DataFrame, value: str, probabilities: list[float]) -> list[float | None]:
    """Exact quantiles, interpolated between neighbours, of the values that aren't null; None for each of an empty column.

    Values are counted first; a quantile is the least value whose running count reaches its place.
    """
    counts = df.filter(F.col(value).isNotNull()).groupBy(F.col(value).alias("v")).agg(F.count("*").alias("n"))
    parts, start = _ranges(counts, ["v"], F.col("n"))
    upto = F.col("_start") + F.sum("n").over(Window.partitionBy("_p").orderBy("v"))
    d = parts.join(F.broadcast(start), "_p").select("v", upto.alias("upto"), (F.col("_total") - 1).alias("last"))
    at = lambda q, f: F.min(F.when(F.col("upto") > f(F.col("last") * q), F.col("v")))
    row = d.agg(F.max("last").alias("last"), *(at(q, f).alias(f"q{i}_{j}") for i, q in enumerate(probabilities) for j, f in enumerate((F.floor, F.ceil)))).first()
    if row["last"] is None:
        return [None] * len(probabilities)
    found = []
    for i, q in enumerate(probabilities):
        low, high, share = row[f"q{i}_0"], row[f"q{i}_1"], row["last"] * q % 1
        found.append(low + (high - low) * share)
    return found
