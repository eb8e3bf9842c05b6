"""The tables of a scale-factor folder, and the two event logs that the operators run over."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Day that week 0 of the event log begins with.
FIRST_DAY = "2024-01-01"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def nan_to_null(df: DataFrame) -> DataFrame:
    """NaN becomes NULL in every floating column, so that counts, sums and comparisons leave it out."""
    kinds = dict(df.dtypes)
    return df.select(*(F.when(~F.isnan(c), F.col(c)).alias(c) if kinds[c] in ("double", "float") else F.col(c) for c in df.columns))


def event_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as a log: row_id, entity, partner, season (week), kind, value, y (is it a purchase)."""
    e = table(spark, sf_dir, "events")
    return nan_to_null(e).select(
        F.col("event_id").alias("row_id"),
        "ts",
        F.col("user_id").alias("entity"),
        F.get_json_object("props", "$.k").cast("long").alias("partner"),
        F.floor(F.datediff(F.col("ts").cast("date"), F.lit(FIRST_DAY).cast("date")) / 7).cast("int").alias("season"),
        F.col("event_type").alias("kind"),
        "value",
        (F.col("event_type") == "purchase").cast("int").alias("y"),
    )


def counted_log(spark: SparkSession, sf_dir: str, entity: str = "entity") -> DataFrame:
    """The event log with ``n`` rows and ``k`` successes of the entity before each row."""
    w = Window.partitionBy(entity).orderBy("row_id").rowsBetween(Window.unboundedPreceding, -1)
    return event_log(spark, sf_dir).withColumns({"n": F.count("*").over(w), "k": F.coalesce(F.sum("y").over(w), F.lit(0))})


def line_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as a log without order: entity (supplier), partner (part), season (year), part of the year, measures, y (returned)."""
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_suppkey").alias("entity"),
        F.col("l_partkey").alias("partner"),
        F.year("l_shipdate").alias("season"),
        F.month("l_shipdate").alias("month"),
        F.col("l_linestatus").alias("grp"),
        F.col("l_quantity").alias("quantity"),
        F.col("l_extendedprice").alias("price"),
        F.col("l_discount").alias("discount"),
        (F.col("l_returnflag") == "R").cast("int").alias("y"),
    )
