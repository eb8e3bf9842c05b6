"""The row-local scorer, and the audit that keeps it so."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.metrics import affine_clip, blend, linear
from ..sources.files import materialised


def score_rows(rows: DataFrame, lookup: DataFrame, key: str, members: dict[str, dict[str, float]], weights: dict[str, float], slope: float = 1.0, shift: float = 0.0, terms: list[tuple[Column, float]] = (), safety: float | None = None, max_lookup: int = 1_000_000) -> DataFrame:
    """Adds ``score``: lookups, linear members, weighted mean over the members that ran, calibration and segment terms.

    Every row is scored by itself: the only join is with a frozen lookup, broadcast when it has at most ``max_lookup`` rows. A member
    whose inputs are NULL drops out and the weights of the others are renormalised; ``safety`` stands in when none is left.
    """
    if lookup.limit(max_lookup + 1).count() <= max_lookup:
        lookup = F.broadcast(lookup)
    d = rows.join(lookup, key, "left")
    d = d.withColumns({f"_m_{m}": linear(w) for m, w in members.items()})
    p = affine_clip(blend({f"_m_{m}": w for m, w in weights.items()}), slope, shift)
    for condition, value in terms:
        p = p + F.when(condition, value).otherwise(0.0)
    p = F.greatest(F.lit(0.0), F.least(F.lit(1.0), p))
    return d.withColumn("score", p if safety is None else F.coalesce(p, F.lit(safety))).drop(*(f"_m_{m}" for m in members))


#: Nodes by which a row could see another.
_SHARED = r"Aggregate|Window|Sort\b|(?<!Broadcast)Exchange|Limit|Sample|MapInPandas|FlatMapGroups"


def shared_state(df: DataFrame) -> list[str]:
    """Operators of the physical plan through which one row could influence another; a row-local plan has none."""
    plan = df._jdf.queryExecution().sparkPlan().toString()
    return sorted(set(re.findall(_SHARED, plan)))


def check_row_local(df: DataFrame) -> DataFrame:
    found = shared_state(df)
    if found:
        raise ValueError(f"the plan isn't row-local: {', '.join(found)}")
    return df


def flatten_json(df: DataFrame, text: str, name: str) -> DataFrame:
    """(name, path, value) of every scalar of JSON documents, nested to any depth; a null is an empty value, a broken document has none.

    Objects and arrays are exploded level by level, as long as a document has deeper ones: paths are ``a.b[0].c``.
    """
    level = df.select(F.col(name).alias("name"), F.lit("").alias("path"), F.try_parse_json(text).alias("v")).filter("v IS NOT NULL")
    kind = F.regexp_extract(F.schema_of_variant("v"), "^[A-Z]+", 0)
    out, spark = None, df.sparkSession
    while True:
        level = materialised(level.withColumn("kind", kind))
        leaves = level.filter("kind NOT IN ('OBJECT', 'ARRAY')").select("name", "path", F.coalesce(F.try_variant_get("v", "$", "string"), F.lit("")).alias("value"))
        out = leaves if out is None else out.unionByName(leaves)
        nested = level.filter("kind IN ('OBJECT', 'ARRAY')")
        if nested.isEmpty():
            return out
        nested.createOrReplaceTempView("_tidemark_nested")
        at = "CASE WHEN n.kind = 'ARRAY' THEN concat(n.path, '[', x.pos, ']') WHEN n.path = '' THEN x.key ELSE concat(n.path, '.', x.key) END"
        level = spark.sql(f"SELECT n.name, {at} AS path, x.value AS v FROM _tidemark_nested n, LATERAL variant_explode(n.v) AS x(pos, key, value)")


#: A match that stands within so many characters after a denial isn't one.
DENIALS = r"(?i)\b(not|no|never|without|non)\b[^.;]{0,24}$"


def provenance(leaves: DataFrame, constants: list[float], block: str, review: str, context: str, tolerance: float = 1e-9) -> DataFrame:
    """Per document BLOCK, REVIEW or CLEAN.

    A forbidden constant blocks, and so does a text that matches ``block``; ``review`` matches are looked at only where the leaf's path matches
    ``context``. A match that follows a denial ("not ...", "without ...") in its text doesn't count.
    """
    number = F.expr("try_cast(value AS DOUBLE)")
    hit = F.lit(False)
    for c in constants:
        hit = hit | F.coalesce(F.abs(number - c) <= tolerance * abs(c), F.lit(False))

    def met(pattern: str) -> Column:
        before = F.regexp_extract("value", f"(?s)^(.*?)({pattern})", 1)
        return F.col("value").rlike(pattern) & ~before.rlike(DENIALS)

    g = leaves.groupBy("name").agg(F.bool_or(hit | met(block)).alias("b"), F.bool_or(met(review) & F.col("path").rlike(context)).alias("r"))
    return g.select("name", F.when(F.col("b"), "BLOCK").when(F.col("r"), "REVIEW").otherwise("CLEAN").alias("verdict"))
