"""Work done once, in tasks that do not grow with a class or with the rows."""
import pytest
from pyspark.sql import functions as F

from lurelens.functions import email_features as ef
from lurelens.functions import lexicons as lx
from lurelens.operators import models as md
from lurelens.operators import scoring as sc
from lurelens.operators import splits as sp
from lurelens.operators import text_model as tm
from lurelens.operators import tfidf as tf


def optimized(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_counts_ruled_out_early_stay_the_same(spark):
    texts = ["URGENT act now", "a\u017fap", "cr\u0131t\u0131cal", "\u0130mmediately", "clic\u212a here", "will expire!!!", "nothing", "", "no@mail",
             "me@mail.example x@y.z", "Cat\u001ccat CAT \u0130 \u0130x", "  ", "\u03a3\u03a3 \u03c3\u03c2"]
    d = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id long, body string").withColumn("subject", F.lit(""))
    text = F.concat(F.lit(" "), F.col("body"))
    plain = sum((F.regexp_count(F.lower(text), F.lit("(?iU)" + p)) for p in lx.URGENCY_PATTERNS), F.lit(0))
    toks = F.array_remove(F.split(text, r"(?U)[\s\x{1c}-\x{1f}]+"), "")
    f = sc.email_features(d).select(
        "id", "urgency_score", "num_emails", "avg_word_length", "unique_word_ratio",
        F.least(plain / 10, F.lit(1.0)).alias("u"), F.regexp_count(text, F.lit(ef.EMAIL_IN_TEXT_RE)).alias("m"),
        F.when(F.size(toks) > 0, F.length(F.array_join(toks, "")) / F.size(toks)).otherwise(0.0).alias("a"),
        F.when(F.size(toks) > 0, F.size(F.array_distinct(F.split(F.lower(F.array_join(toks, " ")), " "))) / F.size(toks)).otherwise(0.0).alias("w"))
    for r in f.collect():
        assert (r.urgency_score, r.num_emails, r.avg_word_length, r.unique_word_ratio) == pytest.approx((r.u, r.m, r.a, r.w)), texts[r.id]
    assert {len(ef.literals_of(p)) for p in lx.URGENCY_PATTERNS} == {5, 4, 0}
    plan = optimized(sc.email_features(d))
    assert plan.count("split(") == 1 and "CASE WHEN Contains(__e_text" in plan


def test_terms_and_buckets_are_found_once_a_text(spark):
    d = spark.createDataFrame([(1.0, "cat dog cat"), (0.0, ""), (0.0, None)], "label double, text string")
    terms = tf.items(d.select(tf.terms_of(F.col("text")).alias("t")), F.col("t"), "term")
    assert sorted(r[0] for r in terms.collect()) == ["cat", "cat", "dog"] and optimized(terms).count("regexp_extract_all") == 1
    rows = tf.items(tm.bucketed().transform(d), F.col("__buckets"), "bucket", "label")
    assert rows.count() == 4 and optimized(rows).count("md5(") == 1


def test_rows_of_a_fit_do_not_take_more_tasks_as_they_grow(spark):
    most = md.PARTITIONS_PER_CORE * spark.sparkContext.defaultParallelism
    few, many = spark.range(0, 50, 1, 2), spark.range(0, 5000, 1, 10 * most)
    assert md.for_fit(few).rdd.getNumPartitions() == 2
    assert md.for_fit(many).rdd.getNumPartitions() == most and md.for_fit(many).count() == 5000


def test_rows_are_not_dealt_out_by_class(spark):
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        d = spark.range(100).select("id", (F.col("id") % 2).alias("label"))
        d = d.unionByName(spark.createDataFrame([(200, None)], "id long, label long"))
        split = sp.stratified_split(d, "id")
        for out in (split, sp.class_weights(split)):
            tops = out._jdf.queryExecution().sparkPlan().toString()
            assert "BroadcastHashJoin [label" in tops and out.count() == 101
        assert split.where("split = 'test'").count() == 20
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)


def test_a_whole_fit_has_tasks_by_cores_not_by_shuffle_partitions(spark):
    """Every task of a fit returns some 2 kB to the driver."""
    most = 2 * spark.sparkContext.defaultParallelism
    conf = {"spark.sql.shuffle.partitions": str(5 * most), "spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    old = {k: spark.conf.get(k) for k in conf}
    for k, v in conf.items():
        spark.conf.set(k, v)
    try:
        d = spark.range(0, 3000, 1, 5 * most).select("id", F.rand(1).alias("a"), F.rand(2).alias("b"))
        d = d.withColumn("label", (F.col("a") + F.col("b") * F.col("b") > 0.8).cast("double"))
        train = sp.stratified_split(d, "id").where("split = 'train'")
        spark.sparkContext.setJobGroup("whole-fit", "")
        model = md.fit(md.tabular_pipeline(["a", "b"], md.boosted_trees(3, 3)), train)
    finally:
        spark.sparkContext.setJobGroup("", "")
        for k, v in old.items():
            spark.conf.set(k, v)
    tracker = spark.sparkContext.statusTracker()
    stages = [tracker.getStageInfo(s) for j in tracker.getJobIdsForGroup("whole-fit") for s in tracker.getJobInfo(j).stageIds]
    tasks = [s.numTasks for s in stages if s and "RandomForest.scala" in s.name]
    assert len(tasks) > 10 and max(tasks) <= most
    assert list(model.stages[1].mean) == pytest.approx(list(train.agg(F.avg("a"), F.avg("b")).first()))   # of all training rows
