"""Labels, discovery, leakage, splits, class weights."""
import math

import pytest
from pyspark.sql import functions as F

from lurelens.functions import labels as lb
from lurelens.operators import leakage as lk
from lurelens.operators import prep as pp
from lurelens.operators import splits as sp


def test_label_vocabularies(spark):
    vals = [" Phishing", "benign", "LEGITIMATE", "spam", "1", "0", "1.0", "2.7", "malware", "ham", "nan", "x", None]
    df = spark.createDataFrame([(v,) for v in vals], "v string")
    r = df.select("v", lb.url_binary_label(F.col("v")).alias("u"), lb.email_label(F.col("v")).alias("e"),
                  lb.strict_binary_label(F.col("v")).alias("s"),
                  lb.raw_url_label(F.col("v"), numeric=False).alias("r")).collect()
    got = {x["v"]: (x["u"], x["e"], x["s"], x["r"]) for x in r}
    assert got[" Phishing"] == (1, 1, 1, 0)   # raw-URL rule does not trim
    assert got["benign"] == (0, 0, 0, 0)
    assert got["LEGITIMATE"] == (0, 0, 0, 0)
    assert got["spam"] == (1, 1, 1, 0)
    assert got["1.0"] == (1, 1, 1, 0) and got["2.7"] == (2, 2, 1, 0)
    assert got["malware"] == (1, 0, 1, 0)     # email vocabulary has no 'malware'
    assert got["ham"] == (0, 0, 1, 0)
    assert got["nan"] == (0, 0, 1, 0) and got["x"] == (0, 0, 1, 0) and got[None] == (0, 0, 1, 0)


def test_discovery_rules():
    assert pp.find_label_column(["URL", "Type", "label"]) == "Type"
    assert pp.find_url_column(["id", "Website", "url"]) == "Website"
    assert pp.find_email_columns(["Subject Line", "Message Body"]) == ("Subject Line", "Message Body")
    assert pp.find_email_columns(["text", "label"]) == ("text", "text")
    assert pp.find_email_label(["Spam", "is_phishing"]) == "is_phishing"
    assert pp.find_raw_url_columns(["url", "url2", "class", "label"]) == ("url2", "label")
    assert pp.alternate_feature_columns(["width", "len", "Unnamed: 0", "type"]) == ["len"]


def test_numeric_feature_columns(spark):
    df = spark.createDataFrame([(1, 2.0, 3, "a", 1)], "row_num int, score double, width int, name string, label int")
    assert pp.numeric_feature_columns(df.schema, "label") == ["score"]  # 'width' contains 'id'


def test_conform_and_fill(spark):
    df = spark.createDataFrame([("Hi", "body text", "phish"), (None, "x", "0")], "Subject string, content string, Label string")
    rows = pp.conform_email_table(df).collect()
    assert rows[0]["body"] == "Hi body text" and rows[0]["label"] == 1 and rows[0]["sender"] == "unknown@example.com"
    assert rows[1]["subject"] == "" and rows[1]["label"] == 0
    f = pp.fill_email_columns(spark.createDataFrame([("b", "f@x.com", 2)], "body_plain string, from_address string, has_attachments int"))
    r = f.collect()[0]
    assert (r["body"], r["sender"], r["num_attachments"], r["subject"]) == ("b", "f@x.com", 2, "")


def test_leakage(spark):
    rows = [(0, 1.0, 5.0, 0.1), (0, 2.0, 5.0, 0.2), (1, 3.0, 5.0, 0.1), (1, 4.0, 5.0, 0.3)]
    df = spark.createDataFrame(rows, "label int, sep double, const double, mixed double")
    rep = {r["feature"]: r for r in lk.separation_report(df, "label").collect()}
    assert rep["sep"]["separates"] and not rep["mixed"]["separates"] and not rep["const"]["separates"]
    assert rep["const"]["constant_per_class"]
    df2 = df.withColumn("risk_value", F.col("mixed"))
    leaks = {r["feature"]: r["reasons"] for r in lk.leaking_features(df2, "label").collect()}
    assert leaks == {"sep": "perfect_separation", "risk_value": "suspicious_name"}


def test_domain_split_isolation_and_exact_size(spark, sf001):
    from lurelens.sources.corpora import url_corpus
    u = url_corpus(spark, sf001)
    for exact in (False, True):
        s = sp.domain_split(u, exact=exact)
        assert sp.split_overlap(s).count() == 0
        if exact:
            n_dom = s.select("domain").distinct().count()
            n_test = s.where("split = 'test'").select("domain").distinct().count()
            assert n_test == math.ceil(0.2 * n_dom)
    a = sorted(map(tuple, sp.domain_split(u).select("page_id", "split").collect()))
    b = sorted(map(tuple, sp.domain_split(u).select("page_id", "split").collect()))
    assert a == b  # deterministic


def test_stratified_exact_counts(spark, sf001):
    from lurelens.sources.corpora import email_corpus
    e = email_corpus(spark, sf001).select("email_id", "label")
    s = sp.stratified_split(e, "email_id")
    per = {(r["label"], r["split"]): r["count"] for r in s.groupBy("label", "split").count().collect()}
    for c in (0, 1):
        n = per.get((c, "train"), 0) + per.get((c, "test"), 0)
        assert per.get((c, "test"), 0) == int(math.floor(0.2 * n + 0.5))


def test_class_weights(spark):
    df = spark.createDataFrame([(0,), (0,), (0,), (1,)], "label int")
    w = {r["label"]: r["weight"] for r in sp.class_weight_table(df).collect()}
    assert w[0] == pytest.approx(4 / (2 * 3)) and w[1] == pytest.approx(4 / (2 * 1))


def test_hot_domain_split(spark):
    """One domain holds a third of the rows: still isolated, exact size kept."""
    rows = [(i, "https://hot.example.com/p%d" % i if i % 3 == 0 else "https://d%d.example.org/x" % i) for i in range(3000)]
    df = spark.createDataFrame(rows, "id long, url string")
    s = sp.domain_split(df, exact=True)
    assert sp.split_overlap(s).count() == 0
    n_dom = s.select("domain").distinct().count()
    assert s.where("split = 'test'").select("domain").distinct().count() == math.ceil(0.2 * n_dom)
    assert s.count() == 3000  # every row kept
    hot = {r["split"] for r in s.where("domain = 'hot.example.com'").select("split").distinct().collect()}
    assert len(hot) == 1


def test_hot_class_stratified(spark):
    rows = [(i, 1 if i % 10 == 0 else 0) for i in range(5000)]
    s = sp.stratified_split(spark.createDataFrame(rows, "id long, label int"), "id")
    per = {(r["label"], r["split"]): r["count"] for r in s.groupBy("label", "split").count().collect()}
    assert per[(0, "test")] == 900 and per[(1, "test")] == 100
