"""Supervised models on Spark ML (T11-T17, V3 evaluator form, S11).

* Tabular: VectorAssembler -> StandardScaler (fit on the training rows
  only) -> GBTClassifier / RandomForestClassifier, as one ``Pipeline``.
* Text (T19) and term features (T18): ``text_model`` and ``tfidf``.
* Fitted trees as tables: ``tree_tables``.

Training reads the data once per tree level (Spark ML's distributed tree
learners); inputs are persisted for the duration of a fit.  Models are
saved and loaded with the ML writer (S11).
"""

from __future__ import annotations

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier, RandomForestClassifier
from pyspark.ml.evaluation import BinaryClassificationEvaluator
from pyspark.ml.feature import SQLTransformer, StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import lexicons as lx

BP, FP = lx.BOOSTED_PARAMS, lx.FOREST_PARAMS


def boosted_trees(max_iter: int = BP["n_estimators"], max_depth: int = BP["max_depth"],
                  step_size: float = BP["learning_rate"], subsample: float = BP["subsample"],
                  feature_subset: str = str(BP["colsample_bytree"]), seed: int = BP["random_state"],
                  label: str = "label") -> GBTClassifier:
    """T12 with the reference settings by default."""
    return GBTClassifier(featuresCol="features", labelCol=label, maxIter=max_iter, maxDepth=max_depth,
                         stepSize=step_size, subsamplingRate=subsample, featureSubsetStrategy=feature_subset,
                         seed=seed)


def random_forest(num_trees: int = FP["n_estimators"], max_depth: int = FP["max_depth"],
                  min_instances: int = FP["min_samples_leaf"], seed: int = FP["random_state"],
                  weight_col: str | None = "weight", label: str = "label") -> RandomForestClassifier:
    """T13; ``weight_col`` carries the balanced class weights (T14).  Spark's
    trees have no least number of rows for a split, so that setting has no effect."""
    kw = {"weightCol": weight_col} if weight_col else {}
    return RandomForestClassifier(featuresCol="features", labelCol=label, numTrees=num_trees, maxDepth=max_depth,
                                  minInstancesPerNode=min_instances, seed=seed, **kw)


def tabular_pipeline(features, estimator, scale: bool = True) -> Pipeline:
    """T11 + model: assemble the manifest columns (missing values kept as
    NaN-free zeros upstream), scale with mean and std fitted on train."""
    if not features:
        raise ValueError("no feature columns to fit on")
    stages = [VectorAssembler(inputCols=list(features), outputCol="raw_features", handleInvalid="keep")]
    if scale:
        stages.append(StandardScaler(inputCol="raw_features", outputCol="features", withMean=True, withStd=True))
    else:
        stages.append(SQLTransformer(statement="SELECT *, raw_features AS features FROM __THIS__"))
    stages.append(estimator)
    return Pipeline(stages=stages)


def check_classes(train: DataFrame, label: str) -> None:
    """Training rows of one class only (or none) are refused; reads the
    label column alone and stops at the second class."""
    if train.select(label).where(F.col(label).isNotNull()).distinct().limit(2).count() < 2:
        raise ValueError(f"the training rows need two classes in {label!r}")


PARTITIONS_PER_CORE = 2


def for_fit(train: DataFrame) -> DataFrame:
    """``train`` in at most ``PARTITIONS_PER_CORE`` partitions a core, whatever its
    size.  A fit runs hundreds to thousands of short stages over the same rows and
    every task of each returns a result to the driver; their number must not grow
    with the rows."""
    return train.coalesce(PARTITIONS_PER_CORE * train.sparkSession.sparkContext.defaultParallelism)


def fit(pipeline: Pipeline, train: DataFrame) -> PipelineModel:
    """Fits with the training rows persisted (tree learners read them once
    per level); the cache is released afterwards."""
    check_classes(train, pipeline.getStages()[-1].getOrDefault("labelCol"))
    cached = for_fit(train).persist()
    try:
        return pipeline.fit(cached)
    finally:
        cached.unpersist()


def with_probability(model: PipelineModel, df: DataFrame, out: str = "p", keep_vectors: bool = False) -> DataFrame:
    """Class-1 probability and prediction (p >= 0.5)."""
    scored = model.transform(df).withColumn(out, F.get(vector_to_array(F.col("probability")), 1))
    scored = scored.withColumn("prediction", (F.col(out) >= 0.5).cast("int"))
    if not keep_vectors:
        drop = [c for c in scored.columns if c.startswith("__") or c in
                ("raw_features", "features", "rawPrediction", "probability")]
        scored = scored.drop(*drop)
    return scored


def feature_importances(model: PipelineModel, features) -> DataFrame:
    """(feature, importance) by manifest name, largest first.  The
    vector has one entry per feature, so it is a small driver-side value."""
    tree = model.stages[-1]
    imp = tree.featureImportances.toArray().tolist()
    spark = _spark_of(model)
    rows = [(f, float(v)) for f, v in zip(features, imp)]
    return spark.createDataFrame(rows, "feature string, importance double").orderBy(F.desc("importance"), "feature")


def model_info(model: PipelineModel, n_features: int) -> DataFrame:
    """Type, fitted, feature count, tree count, depth, step size."""
    tree = model.stages[-1]
    kind = type(tree).__name__
    n_trees = getattr(tree, "getNumTrees", None)
    n_trees = n_trees if isinstance(n_trees, int) else len(getattr(tree, "trees", []) or [])
    depth = tree.getOrDefault("maxDepth") if tree.hasParam("maxDepth") else None
    step = tree.getOrDefault("stepSize") if tree.hasParam("stepSize") else None
    spark = _spark_of(model)
    return spark.createDataFrame(
        [(kind, True, int(n_features), int(n_trees), depth, step)],
        "model_type string, is_fitted boolean, n_features int, n_trees int, max_depth int, step_size double")


def auc(scored: DataFrame, label: str = "label", raw: str = "rawPrediction") -> float:
    """V3, evaluator form (distributed)."""
    ev = BinaryClassificationEvaluator(labelCol=label, rawPredictionCol=raw, metricName="areaUnderROC")
    return ev.evaluate(scored)


def save(model: PipelineModel, path: str) -> None:
    """Model and scaler are stages of one pipeline, saved together."""
    model.write().overwrite().save(path)


def load(path: str) -> PipelineModel:
    return PipelineModel.load(path)


def _spark_of(model):
    from pyspark.sql import SparkSession
    return SparkSession.getActiveSession()
