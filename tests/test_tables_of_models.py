"""Term features, text weights and node tables against plain computations."""
import math
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from lurelens.functions import lexicons as lx
from lurelens.operators import evaluate as ev
from lurelens.operators import models as md
from lurelens.operators import text_model as tm
from lurelens.operators import tfidf as tf
from lurelens.operators import tree_tables as tt

TEXTS = ["the Cat sat on the cat mat", "dog dog dog éa x y 12", "", None, "the of and", "Cat_1 dog; mat-mat", "zz aa zz aa bb"]


def test_tfidf_equals_plain_python(spark):
    d = spark.createDataFrame(list(enumerate(TEXTS)), "id long, text string").repartition(3)
    words = [[w for w in re.findall(r"\w\w+", (t or "").lower()) if w not in lx.STOP_WORDS] for t in TEXTS]
    n = Counter(w for ws in words for w in ws)
    terms = sorted(sorted(n, key=lambda w: (-n[w], w))[:5])
    df = {t: sum(t in ws for ws in words) for t in terms}
    idf = {t: math.log((1 + len(TEXTS)) / (1 + df[t])) + 1 for t in terms}
    model = tf.fit(d, F.col("text"), 5)
    assert model.terms == tuple(terms) and model.n == tuple(n[t] for t in terms) and model.n_docs == tuple(df.values())
    assert model.idf == pytest.approx(tuple(idf.values()))
    got = {r["id"]: r["tfidf"] for r in tf.transform(d, model, F.col("text")).collect()}
    for i, ws in enumerate(words):
        raw = [ws.count(t) * idf[t] for t in terms]
        length = math.sqrt(sum(x * x for x in raw))
        assert got[i] == pytest.approx([x / length if length else 0.0 for x in raw])
    assert tf.fit(d.limit(0), F.col("text")).terms == ()
    assert {r["tfidf"][0] for r in tf.transform(d, tf.fit(d, F.col("text"), 1), F.col("text")).collect()} == {0.0, 1.0}


def test_terms_are_found_once_a_row(spark):
    d = spark.createDataFrame([(1, "cat dog")], "id long, text string")
    plan = tf.transform(d, tf.fit(d, F.col("text")), F.col("text"))
    assert plan._jdf.queryExecution().optimizedPlan().toString().count("regexp_extract_all") == 1


@pytest.fixture(scope="module")
def table(spark):
    d = spark.range(600).select(F.col("id"), F.rand(1).alias("a"), F.rand(2).alias("b"), F.lit(1.0).alias("c"), (F.rand(4) * 100).cast("int").cast("double").alias("d"))
    d = d.withColumn("label", ((F.col("a") + F.col("b") * F.col("d") / 100) > 0.8).cast("double"))
    return spark.createDataFrame(d.collect())


@pytest.mark.parametrize("kind", ["boosted", "forest"])
def test_node_walk_equals_the_model(spark, table, tmp_path, kind):
    cols = ["a", "b", "c", "d"]
    est = md.boosted_trees(8, 5) if kind == "boosted" else md.random_forest(9, 7, weight_col=None)
    model = md.fit(md.tabular_pipeline(cols, est), table)
    tt.write(model, cols, str(tmp_path / "t"))
    tables = tt.read(spark, str(tmp_path / "t"))
    got = {r["id"]: r["p"] for r in tt.probabilities(tables, table, "id").collect()}
    want = {r["id"]: r["p"] for r in md.with_probability(model, table).collect()}
    assert len(set(want.values())) > 20 and got == pytest.approx(want, abs=1e-12)
    imp = {r["feature"]: r["importance"] for r in tt.importances(tables).collect()}
    assert imp == pytest.approx({r["feature"]: r["importance"] for r in md.feature_importances(model, cols).collect()}, abs=1e-12)
    info = tt.info(tables).first()
    assert (info["kind"], info["n_trees"], info["n_features"]) == (kind, len(model.stages[-1].trees), 4)
    assert info["n_leaves"] == info["n_splits"] + info["n_trees"] and info["n_features_used"] == 3


def test_text_weights_and_model(spark, tmp_path):
    rows = [(i, f"common words {'free prize now' if i % 3 == 0 else 'meeting agenda today'} w{i % 7} w{i % 11}", float(i % 3 == 0)) for i in range(90)]
    rows += [(200, None, 0.0), (201, "", 1.0)]
    d = spark.createDataFrame(rows, "id long, text string, label double")
    w = {r["bucket"]: r for r in tm.weights(d).collect()}

    def bucket(t):
        import hashlib
        return int(hashlib.md5(t.encode()).hexdigest()[:8], 16) % tm.BUCKETS

    assert (w[bucket("free prize")]["n1"], w[bucket("free prize")]["n0"]) == (30, 0)
    assert w[bucket("free prize")]["weight"] == w[bucket("free prize")]["ratio"] > 3
    assert (w[bucket("common")]["n1"], w[bucket("common")]["n0"], w[bucket("agenda today")]["n1"]) == (30, 60, 0)
    assert w[bucket("common")]["weight"] == 0.0
    model = tm.fit(d)
    md.save(model, str(tmp_path / "m"))
    scored = md.with_probability(md.load(str(tmp_path / "m")), d)
    assert ev.binary_metrics(scored).first()["recall"] >= 30 / 31
    with pytest.raises(ValueError):
        tm.fit(d.filter("label = 1"))
