"""Queries of serving and of sources and sinks."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import history as H
from ..plans import scoring as S
from ..sources import files
from ..sources.tables import counted_log, event_log, table
from .registry import ENDS, EV, query, r6


@query("srv1_row_scorer", f"""WITH {ENDS}, l AS (SELECT entity, max_by(k_end / n_end, season) AS base FROM ends WHERE season < 3 GROUP BY entity),
m AS (SELECT log.*, 0.1 + 0.5 * base AS a, 0.15 + 0.001 * value AS b FROM log LEFT JOIN l USING (entity) WHERE season >= 3),
p AS (SELECT *, (CASE WHEN a IS NULL THEN 0 ELSE 2 * a END + b) / (CASE WHEN a IS NULL THEN 0 ELSE 2 END + 1) AS p FROM m)
SELECT row_id, round(greatest(0.0, least(1.0, greatest(0.0, least(1.0, 0.5 + 1.1 * (p - 0.5) + 0.01)) + CASE WHEN kind = 'click' THEN 0.02 ELSE 0 END)), 6) AS score FROM p""")
def srv1(spark, d):
    log = counted_log(spark, d)
    ends = H.season_end(log).filter("season < 3").withColumn("rate", F.col("k_end") / F.col("n_end"))
    lookup = ends.groupBy("entity").agg(F.max_by("rate", "season").alias("base"))
    rows = log.filter("season >= 3")
    members = {"a": {"base": 0.5, "intercept": 0.1}, "b": {"value": 0.001, "intercept": 0.15}}
    s = S.score_rows(rows, lookup, "entity", members, {"a": 2.0, "b": 1.0}, 1.1, 0.01, [(F.col("kind") == "click", 0.02)], safety=0.2)
    return s.select("row_id", r6("score").alias("score"))


@query("cmp1_provenance", f"""WITH {EV} SELECT CAST(row_id AS VARCHAR) AS name, CASE WHEN partner = 42 OR (kind = 'refund' AND partner % 5 <> 0) THEN 'BLOCK' WHEN kind = 'purchase' AND partner % 3 <> 0 THEN 'REVIEW' ELSE 'CLEAN' END AS verdict FROM ev""")
def cmp1(spark, d):
    """Documents made of events: a constant, a word that blocks, and one that matters in remarks only, denied in some."""
    e = event_log(spark, d)
    remark = F.concat(F.when(F.col("partner") % 3 == 0, "not a ").otherwise("a "), "kind")
    note = F.when(F.col("kind") == "refund", F.concat(F.when(F.col("partner") % 5 == 0, "without a ").otherwise("with a "), "kind")).otherwise("nothing")
    body = F.to_json(F.struct(F.struct(F.col("partner").alias("k"), F.array(F.struct(remark.alias("remark")), F.struct(F.lit("plain").alias("remark"))).alias("said")).alias("meta"), F.col("kind").alias("purchase_kind"), note.alias("note")))
    docs = e.select(F.col("row_id").cast("string").alias("name"), body.alias("body"))
    return S.provenance(S.flatten_json(docs, "body", "name"), [42.0], r"with(out)? a refund", "purchase", r"remark$")


@query("src3_cleansing", "SELECT o_orderkey, CAST(o_orderdate AS DATE) AS day, CAST(least(month(o_orderdate), 10) AS INTEGER) AS month, CASE WHEN o_totalprice > 1000 THEN o_totalprice END AS price, replace(lower(o_orderpriority), 'not specified', 'none') AS priority FROM orders WHERE o_orderstatus <> 'P'")
def src3(spark, d):
    o = table(spark, d, "orders").filter("o_orderstatus <> 'P'")
    return o.select("o_orderkey", F.col("o_orderdate").cast("date").alias("day"), F.least(F.month("o_orderdate"), F.lit(10)).alias("month"), F.when(F.col("o_totalprice") > 1000, F.col("o_totalprice")).alias("price"), F.replace(F.lower("o_orderpriority"), F.lit("not specified"), F.lit("none")).alias("priority"))


@query("src4_projected_scan", "SELECT l_orderkey, l_quantity FROM lineitem WHERE l_quantity > 45")
def src4(spark, d):
    return table(spark, d, "lineitem").filter("l_quantity > 45").select("l_orderkey", "l_quantity")


@query("prj12_contract", f"WITH {EV} SELECT row_id, kind, value FROM ev")
def prj12(spark, d):
    from ..operators.rowwise import contract

    return contract(event_log(spark, d), ["row_id", "kind", "value"])


@query("src7_keyed_cache", f"WITH {EV} SELECT season, count(*) AS n FROM ev GROUP BY season")
def src7(spark, d):
    """A table that is computed once per key and read again."""
    import uuid

    folder = files.shared_folder(spark)
    counts = event_log(spark, d).groupBy("season").agg(F.count("*").alias("n"))
    key = f"counts-{uuid.uuid4().hex}"
    files.cached(counts, folder, key)
    return files.cached(counts, folder, key)


def _folder(spark) -> str:
    import uuid

    return f"{files.shared_folder(spark)}/files-{uuid.uuid4().hex}"


@query("src1_typed_csv", "SELECT o_orderkey, round(CAST(CAST(o_totalprice AS FLOAT) AS DOUBLE), 2) AS price, o_orderstatus AS status FROM orders")
def src1(spark, d):
    """A CSV with a header, read by an explicit schema and stored in narrower types."""
    from pyspark.sql.types import StructType

    at = _folder(spark)
    table(spark, d, "orders").select("o_orderkey", "o_totalprice", "o_orderstatus").write.option("header", True).csv(at)
    o = files.read_csv(spark, at, StructType.fromDDL("o_orderkey long, o_totalprice double, o_orderstatus string"), shrink=True)
    return o.select(F.col("o_orderkey").cast("long").alias("o_orderkey"), F.round(F.col("o_totalprice").cast("double"), 2).alias("price"), F.col("o_orderstatus").alias("status"))


@query("snk1_ordered_csv", f"WITH {EV} SELECT row_id, round(value / 100, 6) AS p, row_number() OVER (ORDER BY row_id DESC) AS place FROM ev WHERE season = 1")
def snk1(spark, d):
    """Scores written in the order of a sample, and read back with the place that each row has in the files."""
    at = _folder(spark)
    e = event_log(spark, d).filter("season = 1")
    files.write_submission(e.select("row_id", r6(F.col("value") / 100).alias("p")), e.select("row_id", (-F.col("row_id")).alias("pos")), at)
    back = spark.read.schema("row_id long, p double").option("header", True).csv(at)
    back = back.select("row_id", "p", F.col("_metadata.file_name").alias("file"), F.col("_metadata.file_block_start").alias("block"))
    from pyspark.sql import Window

    # The files' names are in order; within a file a row's place is where it was read: by its block, then by the reader's own count.
    back = back.withColumn("at", F.monotonically_increasing_id())
    order = back.groupBy("file").agg(F.count("*").alias("n"))
    start = order.withColumn("start", F.coalesce(F.sum("n").over(Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    own = F.row_number().over(Window.partitionBy("file").orderBy("block", "at"))
    return back.join(F.broadcast(start.select("file", "start")), "file").withColumn("place", F.col("start") + own).select("row_id", "p", "place")


@query("snk3_run_history", f"WITH {EV}, r AS (SELECT 'week' || season AS run, CAST(count(*) AS DOUBLE) AS rows, round(avg(power(y - 0.2, 2)), 6) AS brier, round(avg(y), 6) AS rate FROM ev GROUP BY season) UNPIVOT r ON rows, brier, rate INTO NAME metric VALUE value")
def snk3(spark, d):
    """A record of each week's scores, appended one by one; the history is read from all of them."""
    at = _folder(spark)
    weeks = event_log(spark, d).groupBy("season").agg(F.count("*").alias("rows"), r6(F.avg(F.pow(F.col("y") - 0.2, 2))).alias("brier"), r6(F.avg("y")).alias("rate"))
    for r in weeks.collect():  # a row for each week
        files.append_run({"run": f"week{r['season']}", "rows": r["rows"], "brier": r["brier"], "rate": r["rate"], "note": "left out"}, spark, at)
    return files.run_history(spark, at)


@query("snk4_sealed_package", f"WITH {EV} SELECT count(*) AS n, 0::BIGINT AS broken, 1::BIGINT AS strange, true AS sealed FROM ev WHERE season = 0")
def snk4(spark, d):
    """A table as a package with a manifest of its files; what is read back is whole, and no seal is broken until a file is slipped in."""
    at = _folder(spark)
    manifest = files.package(event_log(spark, d).filter("season = 0").select("row_id", "value"), at)
    manifest = spark.createDataFrame(manifest.collect(), manifest.schema)  # a row per file
    whole = spark.read.parquet(f"{at}/data").count()
    broken = files.broken_seals(manifest, f"{at}/data").count()
    event_log(spark, d).filter("season = 1").select("row_id", "value").coalesce(1).write.mode("append").parquet(f"{at}/data")
    strange = files.broken_seals(manifest, f"{at}/data").agg(F.count("*").alias("strange"))
    rows = spark.createDataFrame([(whole, broken)], "n long, broken long")
    return rows.crossJoin(strange).crossJoin(manifest.agg((F.count("*") > 0).alias("sealed")))
