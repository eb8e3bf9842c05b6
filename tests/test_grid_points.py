"""Entities halfway between two points of the grid of dom12_grid_inversion."""

import datetime

import duckdb
from compare import assert_same

from tidemark import catalog


def test_points_equally_far_are_decided_as_by_the_sql(spark, tmp_path):
    day = datetime.datetime(1996, 1, 1)
    kinds = "l_suppkey long, l_partkey long, l_shipdate timestamp, l_linestatus string, l_quantity double, l_extendedprice double, l_discount double, l_returnflag string"
    # One or two rows an entity: its mean discount is a point or halfway between two, its mean quantity likewise.
    rows = []
    for i in range(20):
        for j in range(40):
            rows += [(40 * i + j, 1, day, "F", q, 1.0, c, "R") for q, c in ((24.0, (80 + j) / 2000), (24.0 + 0.15 * i, (80 + j) / 2000))]
    spark.createDataFrame(rows, kinds).coalesce(1).write.parquet(str(tmp_path / "lineitem.parquet"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW lineitem AS SELECT * FROM read_parquet('{tmp_path}/lineitem.parquet/*.parquet')")
    assert_same(catalog.QUERIES["dom12_grid_inversion"](spark, str(tmp_path)), con, catalog.ORACLES["dom12_grid_inversion"])
