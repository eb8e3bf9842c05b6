"""Members of an ensemble on spark.ml: boosted pairs, boosting over a linear offset, additive bins, centred targets."""

from __future__ import annotations

from pyspark.ml import Pipeline
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import Bucketizer, OneHotEncoder, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import GBTRegressor, LinearRegression
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .rowwise import fit_edges


def _vector(df: DataFrame, features: list[str]) -> DataFrame:
    """Adds ``_x``; NULL features become 0, which a missing flag should accompany."""
    filled = df.select("*", *(F.coalesce(F.col(f).cast("double"), F.lit(0.0)).alias(f"_f_{f}") for f in features))
    return VectorAssembler(inputCols=[f"_f_{f}" for f in features], outputCol="_x").transform(filled).drop(*(f"_f_{f}" for f in features))


def boosted(fit: DataFrame, rows: DataFrame, features: list[str], y: str, out: str, depth: int = 3, rounds: int = 10, seed: int = 1) -> DataFrame:
    """Adds the prediction of gradient boosted trees with squared loss, fitted on ``fit``."""
    model = GBTRegressor(featuresCol="_x", labelCol="_y", predictionCol=out, maxDepth=depth, maxIter=rounds, stepSize=0.1, seed=seed).fit(_vector(fit, features).withColumn("_y", F.col(y).cast("double")))
    return model.transform(_vector(rows, features)).drop("_x")


def offset_boosted(fit: DataFrame, rows: DataFrame, base: list[str], features: list[str], y: str, out: str) -> DataFrame:
    """A logistic model on ``base``, plus trees on what it leaves: p = p0 + tree(y - p0)."""
    glm = LogisticRegression(featuresCol="_x", labelCol="_y", regParam=1e-3).fit(_vector(fit, base).withColumn("_y", F.col(y).cast("double")))
    level = lambda d: glm.transform(_vector(d, base)).withColumn("_p0", vector_to_array("probability")[1]).drop("_x", "rawPrediction", "probability", "prediction")
    left = level(fit).withColumn("_r", F.col(y) - F.col("_p0"))
    d = boosted(left, level(rows), features, "_r", "_t")
    return d.withColumn(out, F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("_p0") + F.col("_t")))).drop("_p0", "_t")


def additive_bins(fit: DataFrame, rows: DataFrame, features: list[str], y: str, out: str, bins: int = 8, ridge: float = 1e-3) -> DataFrame:
    """Quantile bins of every feature, one-hot, and a ridge on them: effects add up, without interactions."""
    stages, hot = [], []
    for f in features:
        edges = fit_edges(fit, f, bins)
        if len(edges) < 3:
            continue
        stages.append(Bucketizer(splits=[-float("inf"), *edges[1:-1], float("inf")], inputCol=f, outputCol=f"_b_{f}", handleInvalid="keep"))
        stages.append(OneHotEncoder(inputCols=[f"_b_{f}"], outputCols=[f"_h_{f}"], handleInvalid="keep", dropLast=False))
        hot.append(f"_h_{f}")
    stages.append(VectorAssembler(inputCols=hot, outputCol="_x"))
    stages.append(LinearRegression(featuresCol="_x", labelCol="_y", predictionCol=out, regParam=ridge))
    cast = lambda d: d.withColumns({f: F.col(f).cast("double") for f in features})
    model = Pipeline(stages=stages).fit(cast(fit).withColumn("_y", F.col(y).cast("double")))
    return model.transform(cast(rows)).drop("_x", *hot, *(h.replace("_h_", "_b_") for h in hot))


def centred(df: DataFrame, season: str, y: str, reference: int, decay: float) -> DataFrame:
    """Adds ``y_centred`` (the label less its season's mean plus the reference season's) and ``weight`` (decay per season before the reference)."""
    means = F.broadcast(df.groupBy(season).agg(F.avg(y).alias("_m")))  # a row a season
    at = F.broadcast(df.filter(F.col(season) == reference).agg(F.avg(y).alias("_ref")))
    d = df.join(means, season).crossJoin(at)
    return d.withColumns({"y_centred": F.col(y) - F.col("_m") + F.col("_ref"), "weight": F.pow(F.lit(decay), F.lit(reference) - F.col(season))}).drop("_m", "_ref")
