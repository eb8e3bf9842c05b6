"""Row-wise derivations: every function adds columns by one projection."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import entropy, flag, piecewise_linear
from .ordered import quantiles


def count_structure(df: DataFrame, good: str, bad: str) -> DataFrame:
    """The state of a count of bad (0 to 3) and good (0 to 2): cell, difference, and flags."""
    b, s = F.col(bad), F.col(good)
    return df.withColumns(
        {
            "cell": b * 3 + s,
            "diff": s - b,
            "ahead": flag(s > b),
            "behind": flag(b > s),
            "two_good": flag(s == 2),
            "three_bad": flag(b == 3),
            "full": flag((b == 3) & (s == 2)),
            "first": flag((b == 0) & (s == 0)),
            "state": F.when(s > b, 0).when(s == b, 1).otherwise(2),
        }
    )


def credibility(rate: Column, n: Column, k: float = 500.0, mean: float = 0.5) -> Column:
    """(rate * n + mean * k) / (n + k)."""
    return (rate * n + mean * k) / (n + k)


def one_hot(c: Column, values: list, prefix: str) -> dict[str, Column]:
    """A 0/1 column for each of fixed values; others get zeros."""
    return {f"{prefix}_{v}": flag(c == F.lit(v)) for v in values}


def fit_standard(df: DataFrame, columns: list[str]) -> dict[str, dict[str, float]]:
    """Median, mean and population deviation (after imputing the median) of each column, exact medians by counted values."""
    med = {c: quantiles(df, c, [0.5])[0] for c in columns}
    filled = df.select(*(F.coalesce(F.col(c), F.lit(med[c])).alias(c) for c in columns))
    row = filled.agg(*(F.avg(c).alias(f"m_{c}") for c in columns), *(F.stddev_pop(c).alias(f"s_{c}") for c in columns)).first()
    return {c: {"median": med[c], "mean": row[f"m_{c}"], "sd": row[f"s_{c}"]} for c in columns}


def standardise(df: DataFrame, fit: dict[str, dict[str, float]]) -> DataFrame:
    """Adds ``z_<c>`` and ``miss_<c>`` by fitted statistics; a constant column gives 0."""
    out = {}
    for c, s in fit.items():
        out[f"z_{c}"] = (F.coalesce(F.col(c), F.lit(s["median"])) - s["mean"]) / s["sd"] if s["sd"] else F.lit(0.0)
        out[f"miss_{c}"] = flag(F.col(c).isNull())
    return df.withColumns(out)


def fit_edges(df: DataFrame, column: str, bins: int) -> list[float]:
    """Distinct quantiles of a column at equal shares."""
    return sorted({q for q in quantiles(df, column, [i / bins for i in range(bins + 1)]) if q is not None})


def encode_piecewise(df: DataFrame, column: str, edges: list[float], out: str) -> DataFrame:
    return df.withColumn(out, piecewise_linear(F.col(column), edges))


def stratified_sample(df: DataFrame, by: list[str], per: int, key: str = "row_id", seed: int = 7) -> DataFrame:
    """``per`` rows of each stratum, the ones whose key hashes lowest: the same at any partitioning."""
    from pyspark.sql import Window

    w = Window.partitionBy(*by).orderBy(F.xxhash64(key, F.lit(seed)), key)
    return df.withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= per).drop("_r")


def mix_shape(df: DataFrame, shares: list[str]) -> DataFrame:
    """Adds entropy and greatest of some shares."""
    return df.withColumns({"mix_entropy": entropy(F.array(*shares)), "mix_max": F.greatest(*shares)})


def contract(df: DataFrame, columns: list[str]) -> DataFrame:
    """Exactly these columns in this order; a missing one is an error, never a column of NULLs."""
    return df.select(*columns)


def subspace(df: DataFrame, prefixes: tuple[str, ...], allow: tuple[str, ...] = ()) -> DataFrame:
    """The columns with one of the prefixes, and those allowed by name."""
    return df.select(*(c for c in df.columns if c in allow or c.startswith(prefixes)))
