"""Registry of queries, and SQL that several of them begin with."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

#: The event log (``ev``), the log with counters (``log``), the line log (``li``).
EV = """ev AS (SELECT event_id AS row_id, ts, user_id AS entity, CAST(json_extract_string(props, '$.k') AS BIGINT) AS partner,
  CAST(date_diff('day', DATE '2024-01-01', CAST(ts AS DATE)) // 7 AS INTEGER) AS season, event_type AS kind, value,
  CAST(event_type = 'purchase' AS INTEGER) AS y FROM events)"""
LOG = EV + """, log AS (SELECT *, count(*) OVER w AS n, CAST(coalesce(sum(y) OVER w, 0) AS BIGINT) AS k FROM ev
  WINDOW w AS (PARTITION BY entity ORDER BY row_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))"""
LI = """li AS (SELECT l_suppkey AS entity, l_partkey AS partner, CAST(year(l_shipdate) AS INTEGER) AS season, CAST(month(l_shipdate) AS INTEGER) AS month,
  l_linestatus AS grp, l_quantity AS quantity, l_extendedprice AS price, l_discount AS discount, CAST(l_returnflag = 'R' AS INTEGER) AS y FROM lineitem)"""
ENDS = LOG + """, ends AS (SELECT entity, season, n + 1 AS n_end, k + y AS k_end FROM (
  SELECT *, row_number() OVER (PARTITION BY entity, season ORDER BY n DESC, row_id) AS r FROM log) WHERE r = 1)"""
BASED = ENDS + """, based AS (SELECT l.*, coalesce(e.n_end, 0) AS base_n, coalesce(e.k_end, 0) AS base_k
  FROM log l ASOF LEFT JOIN ends e ON l.entity = e.entity AND l.season > e.season)"""


def query(name: str, oracle: str | None = None):
    """Registers ``f(spark, sf_dir)`` under ``name``, with its SQL."""

    def add(f):
        if name in QUERIES:
            raise ValueError(f"two queries named {name}")
        QUERIES[name] = f
        if oracle:
            ORACLES[name] = oracle
        return f

    return add


def r6(c: Column | str) -> Column:
    """Rounded to six places: sums in another order may differ in the last digits."""
    return F.round(c, 6)
