"""Structured Streaming twins of batch operators. Each takes a streaming DataFrame and returns one."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def windowed_counts(events: DataFrame, ts: str, width: str, by: list[str], value: str, late: str) -> DataFrame:
    """Tumbling event-time windows with count and sum; rows later than the watermark are dropped."""
    g = events.withWatermark(ts, late).groupBy(F.window(ts, width), *by)
    return g.agg(F.count("*").alias("n"), F.round(F.sum(value), 4).alias("total")).select(F.col("window.start").alias("start"), *by, "n", "total")


def deduplicated(events: DataFrame, ts: str, key: str, late: str) -> DataFrame:
    """The first arrival of each key, with state kept for the watermark's span only."""
    return events.withWatermark(ts, late).dropDuplicatesWithinWatermark([key])


def static_scores(events: DataFrame, lookup: DataFrame, key: str, value: str, default: float) -> DataFrame:
    """A stream-static join with a frozen lookup: row by row, no state."""
    return events.join(lookup, key, "left").withColumn(value, F.coalesce(F.col(value), F.lit(default)))


def running_counter(events: DataFrame, entity: str, order: str, y: str) -> DataFrame:
    """Each row with n and k of its entity before it. State is two numbers an entity.

    Rows of a micro-batch are taken in the order of ``order``; rows that arrive in a later batch come after.
    """
    kind = dict(events.dtypes)

    def step(key, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        n, k = state.get if state.exists else (0, 0)
        for pdf in [pd.concat(list(batches)).sort_values(order)]:
            before = pdf[y].cumsum() - pdf[y]
            yield pd.DataFrame({order: pdf[order], entity: pdf[entity], "n": range(n, n + len(pdf)), "k": k + before})
            n, k = n + len(pdf), k + int(pdf[y].sum())
        state.update((n, k))

    schema = f"{order} {kind[order]}, {entity} {kind[entity]}, n long, k long"
    return events.groupBy(entity).applyInPandasWithState(step, schema, "n long, k long", "append", "NoTimeout")


def sessions(events: DataFrame, entity: str, order: str, value: str, limit: float) -> DataFrame:
    """Each row with its session number: a session begins where the value moves by more than ``limit``. State: last value, number."""
    kind = dict(events.dtypes)

    def step(key, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        last, number = state.get if state.exists else (None, 0)
        for pdf in [pd.concat(list(batches)).sort_values(order)]:
            before = pdf[value].shift(1)
            before.iloc[0] = float("nan") if last is None else last
            opens = ((pdf[value] - before).abs() > limit).astype(int)
            if last is None:
                opens.iloc[0] = 1
            ids = number + opens.cumsum()
            yield pd.DataFrame({order: pdf[order], entity: pdf[entity], "session": ids.astype("int64")})
            last, number = float(pdf[value].iloc[-1]), int(ids.iloc[-1])
        state.update((last, number))

    schema = f"{order} {kind[order]}, {entity} {kind[entity]}, session long"
    return events.groupBy(entity).applyInPandasWithState(step, schema, "last double, number long", "append", "NoTimeout")


def drain(stream: DataFrame, path: str, checkpoint: str, mode: str = "append") -> DataFrame:
    """Runs a stream over what there is now into a Parquet table, and returns the table."""
    q = stream.writeStream.outputMode(mode).format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(path)
