"""Evaluation tables and Spark ML round trip."""
import pytest
from pyspark.sql import functions as F

from lurelens.operators import evaluate as ev


def test_metrics_and_confusion(spark):
    df = spark.createDataFrame([(1, 1), (1, 0), (0, 0), (0, 0), (0, 1)], "label int, prediction int")
    m = ev.binary_metrics(df, "m").collect()[0]
    assert m["accuracy"] == pytest.approx(0.6) and m["precision"] == pytest.approx(0.5)
    assert m["recall"] == pytest.approx(0.5) and m["f1"] == pytest.approx(0.5)
    cm = {(r["label"], r["prediction"]): r["n"] for r in ev.confusion_matrix(df).collect()}
    assert cm == {(0, 0): 2, (0, 1): 1, (1, 0): 1, (1, 1): 1}
    none = ev.binary_metrics(spark.createDataFrame([(0, 0)], "label int, prediction int")).collect()[0]
    assert none["precision"] == 0.0 and none["f1"] == 0.0


def test_exact_auc_with_ties(spark):
    df = spark.createDataFrame([(0.1, 0), (0.4, 1), (0.4, 0), (0.8, 1)], "score double, label int")
    # pairs (pos, neg): (0.4,0.1)=1, (0.4,0.4)=0.5, (0.8,0.1)=1, (0.8,0.4)=1 -> 3.5/4
    assert ev.exact_auc(df).collect()[0]["auc"] == pytest.approx(0.875)


def test_model_fit_save_load(spark, tmp_path):
    from lurelens.operators import models as md
    rows = [(float(i % 2), float(i % 2) + 0.1 * (i % 5), float(i % 3)) for i in range(60)]
    df = spark.createDataFrame(rows, "label double, a double, b double")
    model = md.fit(md.tabular_pipeline(["a", "b"], md.boosted_trees(max_iter=5, max_depth=2)), df)
    p1 = [r["p"] for r in md.with_probability(model, df).orderBy("a", "b").collect()]
    path = str(tmp_path / "model")
    md.save(model, path)
    p2 = [r["p"] for r in md.with_probability(md.load(path), df).orderBy("a", "b").collect()]
    assert p1 == p2
    imp = md.feature_importances(model, ["a", "b"]).collect()
    assert imp[0]["feature"] == "a"
    info = md.model_info(model, 2).collect()[0]
    assert info["model_type"] == "GBTClassificationModel" and info["n_trees"] == 5
