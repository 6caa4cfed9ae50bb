"""Inputs that the corpora do not hold: odd labels, NaN, bypassed mails, several
streams into one history, close scores."""
import pytest
from pyspark.sql import functions as F

from lurelens.functions import labels as lb
from lurelens.operators import evaluate as ev
from lurelens.operators import leakage as lk
from lurelens.operators import scoring as sc
from lurelens.session import scratch_path
from lurelens.streaming import streams as st


def test_labels_strip_and_numbers(spark):
    words = ["phishing\t", "\nspam", " spam ", "1d", "1.9", "1e0", "nan", "inf", "0x1", "-2", "1f", None, ""]
    df = spark.createDataFrame([(w,) for w in words], "x string")
    assert [r[0] for r in df.select(lb.email_label(F.col("x"))).collect()] == [1, 1, 1, 0, 1, 1, 0, 0, 0, -2, 0, 0, 0]
    rules = [r[0] for r in df.select(lb.label_rule(F.col("x"))).collect()]
    assert rules[0] == "word" and rules[3] == "fallback" and rules[4] == "number"


def test_numeric_raw_labels(spark):
    df = spark.createDataFrame([(float("nan"),), (float("inf"),), (1e300,), (1.0,), (None,)], "x double")
    assert [r[0] for r in df.select(lb.raw_url_label(F.col("x"), True)).collect()] == [0, 0, 0, 1, 0]


def test_nan_is_no_value(spark):
    nan = float("nan")
    df = spark.createDataFrame([(0, 1.0), (0, nan), (1, 2.0), (1, nan)], "label int, f double")
    assert lk.separation_report(df).collect()[0]["separates"]


def test_bypass_before_urls(spark):
    df = spark.createDataFrame([("IEEE renewal", "see http://[bad/x", "a@b.c")], "subject string, body string, sender string")
    r = sc.score_emails(df).collect()[0]
    assert (r.risk_level, r.risk_score) == ("SAFE", 0.05) and r.is_legitimate


def test_two_streams_one_history(spark, tmp_path):
    path = scratch_path(spark, "two")
    for k, ids in enumerate(([1, 2], [3])):
        folder = str(tmp_path / f"in{k}")
        spark.createDataFrame([(i,) for i in ids], "page_id long").coalesce(1).write.parquet(folder)
        stream = st.file_stream(spark, folder, "page_id long")
        ckpt = scratch_path(spark, f"two-ckpt{k}")
        st.append_history(stream, path, ckpt).awaitTermination()
        st.append_history(stream, path, ckpt).awaitTermination()
    assert sorted(r.page_id for r in st.history(spark, path).collect()) == [1, 2, 3]
    assert st.history_count(spark, path).collect()[0][0] == 3


def test_auc_tells_close_scores_apart(spark):
    df = spark.createDataFrame([(0.5, 0), (0.5 + 1e-9, 1), (0.5 + 2e-9, 0), (0.5 + 3e-9, 1)], "score double, label int")
    assert ev.exact_auc(df).collect()[0]["auc"] == pytest.approx(0.75)
