"""The fit of the text model holds what weighs something, in bounded parts."""
import pytest
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import CountVectorizerModel, ElementwiseProduct
from pyspark.ml.linalg import Vectors
from pyspark.sql import functions as F

from lurelens.operators import fitted as ft
from lurelens.operators import models as md
from lurelens.operators import text_model as tm
from lurelens.plans import q_models as qm

BATCH = "spark.sql.parquet.columnarReaderBatchSize"


@pytest.fixture(scope="module")
def texts(spark):
    rows = [(i, f"common words {'free prize now' if i % 3 == 0 else 'meeting agenda today'} w{i % 7} w{i % 11}", float(i % 3 == 0 or i % 10 == 1)) for i in range(120)]
    return spark.createDataFrame([*rows, (200, None, 0.0), (201, "", 1.0)], "id long, text string, label double")


def test_only_weighted_buckets_are_held_and_give_the_same_probabilities(spark, texts):
    n = 1 << 10
    weight = {r["bucket"]: r["weight"] for r in tm.weights(texts, buckets=n).collect() if r["weight"]}
    old = spark.conf.get(BATCH)
    model = tm.fit(texts, buckets=n)
    assert sorted(map(int, model.stages[1].vocabulary)) == sorted(weight) and 0 < len(weight) < 30
    assert spark.conf.get(BATCH) == old
    # the same fit over all buckets, zeros too
    full = CountVectorizerModel.from_vocabulary([str(i) for i in range(n)], "__buckets", "__present", binary=True)
    scale = ElementwiseProduct(scalingVec=Vectors.dense([weight.get(i, 0.0) for i in range(n)]), inputCol="__present", outputCol="features")
    rows = scale.transform(full.transform(tm.bucketed(buckets=n).transform(texts)))
    linear = LogisticRegression(featuresCol="features", labelCol="label", regParam=0.01, maxIter=50, standardization=False).fit(rows)
    want = {r["id"]: r["probability"][1] for r in linear.transform(rows).collect()}
    got = {r["id"]: r["p"] for r in md.with_probability(model, texts).collect()}
    assert got == pytest.approx(want, abs=1e-9) and len(set(got.values())) > 2


def test_a_text_without_any_weight_gets_the_share_of_its_class(spark):
    d = spark.createDataFrame([(float(i % 4 == 0), "the same words") for i in range(40)], "label double, text string")
    p = {r["p"] for r in md.with_probability(tm.fit(d), d).collect()}
    assert len(p) == 1 and p.pop() == pytest.approx(0.25, abs=1e-4)


def test_parts_of_the_fit_are_bounded(spark):
    few = 2 * spark.sparkContext.defaultParallelism
    rows = spark.range(0, 4000, 1, 3 * few).select(F.col("id").cast("double").alias("label"))
    part = tm.PART_BYTES // tm.ENTRY_BYTES
    assert tm.in_parts(rows, 10).rdd.getNumPartitions() == few
    assert tm.in_parts(rows, 2 * few * part).rdd.getNumPartitions() == 2 * few
    many = tm.in_parts(rows, 5 * few * part)
    assert many.rdd.getNumPartitions() == 5 * few and many.distinct().count() == 4000


def test_batches_are_as_before_after_an_error(spark):
    old = spark.conf.get(BATCH)
    with pytest.raises(ValueError), tm.small_batches(spark):
        assert spark.conf.get(BATCH) == str(tm.BATCH_ROWS)
        raise ValueError
    assert spark.conf.get(BATCH) == old


def test_the_queries_with_three_models_persist_no_vectors_of_texts(spark, texts, monkeypatch):
    """Their text model is that of ``_fit``."""
    def refuse(*a, **k):
        raise AssertionError("persisted")
    monkeypatch.setattr(type(texts), "persist", refuse)
    monkeypatch.setattr(type(texts), "cache", refuse)
    model = qm._fit(texts, "text")
    assert 0 < len(model.stages[1].vocabulary) < 30
    p = ft.with_probabilities(texts, ft.Models(text=model)).select("p_text", "p_boosted").collect()
    assert len(p) == texts.count() and all(0 < r["p_text"] < 1 and r["p_boosted"] is None for r in p)
