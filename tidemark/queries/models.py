"""Queries of ensemble members. Learners have no SQL; centring does."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import models as L
from ..sources.tables import event_log
from .metrics import predictions
from .registry import EV, query, r6

FEATURES = ["n", "k", "value", "partner"]


def _parts(spark, d):
    f = predictions(spark, d)
    return f.filter("season < 3"), f.filter("season >= 3")


@query("ml1_boosted_pair")
def ml1(spark, d):
    fit, rows = _parts(spark, d)
    two = L.boosted(fit, L.boosted(fit, rows, FEATURES, "y", "a", depth=2), FEATURES, "y", "b", depth=3)
    return two.select("row_id", "y", ((F.col("a") + F.col("b")) / 2).alias("p"))


@query("ml3_offset_boosting")
def ml3(spark, d):
    return L.offset_boosted(*_parts(spark, d), ["p"], FEATURES, "y", "score").select("row_id", "y", "score")


@query("ml5_additive_bins")
def ml5(spark, d):
    return L.additive_bins(*_parts(spark, d), FEATURES, "y", "score").select("row_id", "y", "score")


@query("ml11_centred_target", f"WITH {EV}, m AS (SELECT season, avg(y) AS m FROM ev GROUP BY season) SELECT row_id, round(y - m.m + (SELECT m FROM m WHERE season = 3), 6) AS y_centred, round(power(0.8, 3 - season), 6) AS weight FROM ev JOIN m USING (season)")
def ml11(spark, d):
    return L.centred(event_log(spark, d), "season", "y", 3, 0.8).select("row_id", r6("y_centred").alias("y_centred"), r6("weight").alias("weight"))
