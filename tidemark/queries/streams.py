"""Queries of streams: the events table read as a stream, drained into a table."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.files import shared_folder
from ..sources.tables import event_log
from ..streaming import twins as T
from .registry import EV, LOG, query


def _stream(spark: SparkSession, d: str) -> DataFrame:
    schema = spark.read.parquet(f"{d}/events.parquet").schema
    s = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(d)
    return s.select(F.col("event_id").alias("row_id"), F.col("ts").cast("timestamp").alias("ts"), F.col("user_id").alias("entity"), F.col("event_type").alias("kind"), "value", (F.col("event_type") == "purchase").cast("int").alias("y"))


def _drained(spark: SparkSession, stream: DataFrame) -> DataFrame:
    at = f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"
    return T.drain(stream, f"{at}/out", f"{at}/state")


@query("st1_windowed_counts", f"WITH {EV}, g AS (SELECT time_bucket(INTERVAL '1 day', ts) AS start, kind, count(*) AS n, round(sum(value), 4) AS total FROM ev GROUP BY ALL) SELECT * FROM g WHERE start + INTERVAL '1 day' <= (SELECT max(ts) - INTERVAL '1 hour' FROM ev)")
def st1(spark, d):
    out = _drained(spark, T.windowed_counts(_stream(spark, d), "ts", "1 day", ["kind"], "value", "1 hour"))
    return out.withColumn("start", F.col("start").cast("timestamp_ntz"))


@query("st2_running_counter", f"WITH {LOG} SELECT row_id, entity, n, k FROM log")
def st2(spark, d):
    return _drained(spark, T.running_counter(_stream(spark, d), "entity", "row_id", "y"))


@query("st3_sessions", f"WITH {EV}, f AS (SELECT *, CASE WHEN lag(value) OVER w IS NULL OR abs(value - lag(value) OVER w) > 60 THEN 1 ELSE 0 END AS b FROM ev WINDOW w AS (PARTITION BY entity ORDER BY row_id)) SELECT row_id, entity, CAST(sum(b) OVER (PARTITION BY entity ORDER BY row_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS session FROM f")
def st3(spark, d):
    return _drained(spark, T.sessions(_stream(spark, d), "entity", "row_id", "value", 60.0))


@query("st4_static_scores", f"WITH {EV}, l AS (SELECT entity, round(avg(value), 4) AS level FROM ev WHERE season < 2 GROUP BY entity) SELECT row_id, coalesce(level, 0.0) AS level FROM ev LEFT JOIN l USING (entity)")
def st4(spark, d):
    lookup = event_log(spark, d).filter("season < 2").groupBy("entity").agg(F.round(F.avg("value"), 4).alias("level"))
    return _drained(spark, T.static_scores(_stream(spark, d), lookup, "entity", "level", 0.0).select("row_id", "level"))


@query("st5_dedupe", f"WITH {EV} SELECT row_id, entity FROM ev")
def st5(spark, d):
    return _drained(spark, T.deduplicated(_stream(spark, d).union(_stream(spark, d)), "ts", "row_id", "1 hour").select("row_id", "entity"))
