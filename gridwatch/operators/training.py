"""Temporal splits, boosted trees with isotonic calibration, scoring and importance."""

from __future__ import annotations

from pyspark import SparkContext
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassificationModel, GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import IsotonicRegression, IsotonicRegressionModel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import flag
from .blocks import indexed
from .metrics import average_precision, brier, roc_auc


def fraction_split(df: DataFrame, share: float, ts: str = "ts") -> tuple[DataFrame, DataFrame]:
    """The first ``int(n * share)`` rows in time, and the others."""
    base = df if "idx" in df.columns else indexed(df, ts)
    cut = int(base.count() * share)
    return base.where(F.col("idx") < cut), base.where(F.col("idx") >= cut)


def expanding_folds(df: DataFrame, folds: int = 5, ts: str = "ts") -> list[tuple[DataFrame, DataFrame]]:
    """Training rows before each of ``folds`` test blocks of ``n // (folds + 1)`` rows at the end."""
    base = df if "idx" in df.columns else indexed(df, ts)
    n = base.count()
    size = n // (folds + 1)
    starts = [n - (folds - i) * size for i in range(folds)]
    return [(base.where(F.col("idx") < s), base.where(F.col("idx").between(s, s + size - 1))) for s in starts]


def boosted(features: list[str], label: str, positive_weight: float = 9.0, rounds: int = 30, depth: int = 4, rate: float = 0.05, seed: int = 42, validation: str | None = None) -> Pipeline:
    """Gradient-boosted trees; the positive class weighs more. Monotone constraints aren't available: ``attribution`` audits the direction."""
    gbt = GBTClassifier(featuresCol="_x", labelCol=label, weightCol="_w", maxIter=rounds, maxDepth=depth, stepSize=rate, subsamplingRate=0.8, featureSubsetStrategy="0.6", seed=seed, **({"validationIndicatorCol": validation} if validation else {}))
    return Pipeline(stages=[VectorAssembler(inputCols=features, outputCol="_x", handleInvalid="skip"), gbt])


def fit_boosted(df: DataFrame, features: list[str], label: str, positive_weight: float = 9.0, held: str | None = None, **options) -> PipelineModel:
    """All rounds are trained; rows where the boolean column ``held`` is true aren't learnt from, and the trees up to the round with the least loss on them are kept."""
    weighted = df.dropna(subset=[*features, label]).withColumn("_w", F.when(F.col(label) == 1, positive_weight).otherwise(1.0))
    if held is None:
        return boosted(features, label, positive_weight, **options).fit(weighted)
    model = boosted(features, label, positive_weight, **options).fit(weighted.where(~F.col(held)))
    assembler, gbt = model.stages
    losses = gbt.evaluateEachIteration(assembler.transform(weighted.where(held)))
    return PipelineModel([assembler, _first_trees(gbt, losses.index(min(losses)) + 1)])


def _first_trees(model: GBTClassificationModel, n: int) -> GBTClassificationModel:
    java, sc = model._java_obj, SparkContext._active_spark_context
    trees, weights = sc._gateway.new_array(sc._jvm.org.apache.spark.ml.regression.DecisionTreeRegressionModel, n), sc._gateway.new_array(sc._jvm.double, n)
    for i, (t, w) in enumerate(zip(list(java.trees())[:n], model.treeWeights, strict=False)):
        trees[i], weights[i] = t, w
    short = sc._jvm.org.apache.spark.ml.classification.GBTClassificationModel(java.uid(), trees, weights)
    for c in ("featuresCol", "labelCol", "predictionCol", "rawPredictionCol", "probabilityCol"):
        short.set(short.getParam(c), model.getOrDefault(c))
    return GBTClassificationModel(short)


def raw_scores(model: PipelineModel, df: DataFrame) -> DataFrame:
    """``prob_raw`` of each row without nulls in the features."""
    return model.transform(df).withColumn("prob_raw", vector_to_array("probability")[1]).drop("_x", "rawPrediction", "probability", "prediction")


def fit_calibration(scored: DataFrame, label: str) -> IsotonicRegressionModel:
    """Isotonic regression of the label on the raw score; it clips outside its range and is linear between its points."""
    return IsotonicRegression(featuresCol="prob_raw", labelCol="_y", predictionCol="prob_calibrated").fit(scored.withColumn("_y", F.col(label).cast("double")))


def predictions(model: PipelineModel, calibration: IsotonicRegressionModel, df: DataFrame, cut: float = 0.3415) -> DataFrame:
    out = calibration.transform(raw_scores(model, df))
    return out.withColumn("spike_predicted", flag(F.col("prob_calibrated") > cut))


def importance(model: PipelineModel, features: list[str], n: int = 10) -> DataFrame:
    """The ``n`` features with the largest gain."""
    from pyspark.sql import SparkSession

    values = model.stages[-1].featureImportances.toArray().tolist()
    rows = SparkSession.active().createDataFrame(list(zip(features, values, strict=True)), "feature string, importance double")
    return rows.orderBy(F.desc("importance"), "feature").limit(n)


def cross_validated(df: DataFrame, features: list[str], label: str, folds: int = 5, ts: str = "ts", **options) -> DataFrame:
    """Average precision, area under the curve and Brier score of each expanding fold, with their mean and population deviation."""
    parts = None
    for i, (train, test) in enumerate(expanding_folds(df, folds, ts)):
        s = raw_scores(fit_boosted(train, features, label, **options), test)
        one = average_precision(s, "prob_raw", label).crossJoin(roc_auc(s, "prob_raw", label)).crossJoin(s.agg(brier("prob_raw", label).alias("brier")))
        one = one.select(F.lit(i).alias("fold"), "*")
        parts = one if parts is None else parts.unionByName(one)
    names = ("average_precision", "roc_auc", "brier")
    return parts.select("*", *(F.lit(None).cast("double").alias(f"sd_{c}") for c in names)).unionByName(
        parts.agg(F.lit(-1).alias("fold"), *(F.avg(c).alias(c) for c in names), *(F.stddev_pop(c).alias(f"sd_{c}") for c in names))
    )
