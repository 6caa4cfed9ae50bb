"""Email features and rules on hand-checked rows of our own."""
import pytest
from pyspark.sql import functions as F

from lurelens.operators import scoring as sc

SCHEMA = ("id long, subject string, body string, sender string, html_content string, "
          "hdr array<struct<key:string,value:string>>, num_attachments int")


def emails(spark, rows):
    """Headers are given as dicts; the map is built from an ordered entry
    list (``map_from_entries``) so header order is kept."""
    rows = [r[:5] + ([(k, v) for k, v in r[5].items()],) + r[6:] for r in rows]
    df = spark.createDataFrame(rows, SCHEMA)
    return df.withColumn("headers", F.map_from_entries("hdr")).drop("hdr")


def test_feature_values(spark):
    df = emails(spark, [(1, "URGENT Notice", "Click here http://x.tk/a now!!! mail a@b.co 10.0.0.1",
                         "john123@gmail.com", "<a href='x'>l</a>", {"spf-check": "pass"}, 2)])
    f = sc.email_features(df).collect()[0]
    text = "URGENT Notice Click here http://x.tk/a now!!! mail a@b.co 10.0.0.1"
    assert f["total_length"] == len(text)
    assert f["num_caps"] == sum(c.isupper() for c in text)
    assert f["num_urls"] == 1 and f["num_emails"] == 1 and f["num_ips"] == 1 and f["num_links"] == 1
    assert f["num_attachments"] == 2
    assert f["has_spf"] == 1 and f["spf_result_match"] == 1.0 and f["has_dkim"] == 0
    # 0.5 - 0.1 (free mail) - 0.1 (three digits before '@')
    assert f["sender_reputation"] == pytest.approx(0.3)
    words = text.split()
    assert f["avg_word_length"] == pytest.approx(sum(map(len, words)) / len(words))
    assert f["unique_word_ratio"] == pytest.approx(len(set(w.lower() for w in words)) / len(words))


def test_spf_header_order(spark):
    # the first header whose key contains 'spf' and whose value says pass/fail decides
    df = emails(spark, [
        (1, "s", "b", "", "", {"spf": "none", "Received-SPF": "fail"}, 0),
        (2, "s", "b", "", "", {"Received-SPF": "softfail", "spf": "pass"}, 0),
        (3, "s", "b", "", "", {"Authentication-Results": "dmarc=pass"}, 0),
    ])
    f = {r["id"]: r for r in sc.email_features(df).collect()}
    assert f[1]["spf_result_match"] == 0.0 and f[1]["has_spf"] == 1
    assert f[2]["spf_result_match"] == 0.0
    assert f[3]["spf_result_match"] == 0.5 and f[3]["has_dmarc"] == 1 and f[3]["has_spf"] == 0


def test_blank_body(spark):
    f = sc.email_features(emails(spark, [(1, "", "     ", "", "", {}, None)])).collect()[0]
    assert f["avg_word_length"] == 0.0 and f["unique_word_ratio"] == 0.0 and f["num_attachments"] == 0
    assert f["sender_reputation"] == 0.5 and f["html_ratio"] == 0.0 and f["text_html_ratio"] == 1.0


def test_phishing_mail_is_high(spark):
    df = emails(spark, [(1, "Account alert", "Your account has been suspended. Visit http://pay-secure.tk/login now",
                         "service@gmail.com", "", {}, 0)])
    r = sc.score_emails(df).collect()[0]
    # strong indicator 0.5 + one suspicious URL 0.35
    assert r["risk_score"] == pytest.approx(0.85) and r["risk_level"] == "HIGH"
    assert r["risk_factors"][0] == "🔴 HIGH RISK: Multiple phishing indicators detected"
    assert r["risk_factors"][1:] == ["🚨 Strong phishing indicators detected", "🚨 1 suspicious URL(s) found"]


def test_brand_from_free_mail(spark):
    df = emails(spark, [(1, "Your PayPal and Amazon order", "Please review", "billing@gmail.com", "", {}, 0)])
    r = sc.score_emails(df).collect()[0]
    assert r["risk_score"] == pytest.approx(0.8)
    assert "⚠️ Claims to be from Paypal but uses gmail.com" in r["risk_factors"]
    assert "⚠️ Claims to be from Amazon but uses gmail.com" in r["risk_factors"]


def test_legitimate_short_circuits(spark):
    df = emails(spark, [
        (1, "Meeting", "Dr. Rao, Professor, Department of Physics. Best regards", "rao@uni.edu", "", {}, 0),
        (2, "IEEE", "wire transfer needed", "x@y.com", "", {}, 0),
        (3, "Hi", "Thanks, see you. Best regards", "a@b.com", "", {}, 0),
    ])
    r = {x["id"]: x for x in sc.score_emails(df).collect()}
    assert r[1]["risk_level"] == "SAFE" and r[1]["risk_score"] == 0.05
    assert r[1]["risk_factors"] == ["✅ Academic institution email with professional signature"]
    # 'ieee' bypasses even a strong indicator (kept quirk, flagged)
    assert r[2]["risk_level"] == "SAFE" and r[2]["bypassed_indicators"] is True
    assert r[2]["risk_factors"] == ["✅ IEEE or legitimate organization communication"]
    assert r[3]["risk_factors"] == ["✅ Short professional communication"]
    assert r[3]["ml_prediction"] == 0 and r[3]["ml_confidence"] == 0.0


def test_short_mail_boundary(spark):
    # 500 characters exactly is not 'short'
    body = ("thanks best regards " * 30)[:496]
    df = emails(spark, [(1, "abc", body, "a@b.com", "", {}, 0)])  # 'abc' + ' ' + 496 = 500
    r = sc.score_emails(df).collect()[0]
    assert r["risk_factors"] != ["✅ Short professional communication"]


def test_email_with_urls(spark):
    df = emails(spark, [(1, "Hello", "see https://github.com/explore, and http://paypa1-verify.ga/login.",
                         "a@b.com", "", {}, 0)])
    r = sc.score_emails_with_urls(df).collect()[0]
    assert r["urls_found"] == ["http://paypa1-verify.ga/login", "https://github.com/explore"]
    assert r["combined_risk_score"] == 1.0 and r["combined_risk_level"] == "HIGH"
    assert r["combined_risk_score"] >= r["email_risk_score"]
    assert r["recommendations"][0] == "🚨 DO NOT click any links in this message"


def test_combined_features_array_form_equals_explode_groupby(spark, sf001):
    """The shuffle-free array form of C2 equals explode + groupBy + left join."""
    from lurelens.functions.combine import body_urls
    from lurelens.functions.manifest import URL_FEATURES
    from lurelens.sources.corpora import email_corpus
    e = email_corpus(spark, sf001)
    arr = sc.combined_features(e, reference_year=2024).select("email_id", *[f"url_{n}" for n in URL_FEATURES],
                                                             "total_urls_in_email")
    ex = e.select("email_id", F.explode(body_urls(F.col("body"))).alias("url"))
    per = sc.url_features(ex, "url", 2024).groupBy("email_id").agg(
        *[F.avg(n).alias(f"url_{n}") for n in URL_FEATURES], F.count("*").alias("total_urls_in_email"))
    ref = e.select("email_id").join(per, "email_id", "left").fillna(0)
    a = {r["email_id"]: r for r in arr.collect()}
    for r in ref.collect():
        for n in URL_FEATURES:
            assert a[r["email_id"]][f"url_{n}"] == pytest.approx(r[f"url_{n}"], abs=1e-9), n
        assert a[r["email_id"]]["total_urls_in_email"] == r["total_urls_in_email"]


def test_mail_with_many_urls_is_one_row(spark):
    """A mail carrying thousands of URLs is scored in its own row (no regroup)."""
    body = " ".join(f"https://site{i}.example.com/p" for i in range(3000)) + " http://paypa1-verify.ga/login"
    df = emails(spark, [(1, "s", body, "a@b.com", "", {}, 0), (2, "t", "no links", "a@b.com", "", {}, 0)])
    r = {x["id"]: x for x in sc.score_emails_with_urls(df).collect()}
    assert len(r[1]["urls_found"]) == 3001 and r[1]["combined_risk_score"] == 1.0
    assert r[2]["urls_found"] == [] and r[2]["combined_risk_score"] == r[2]["email_risk_score"]
    c = {x["id"]: x for x in sc.combined_features(df).collect()}
    assert c[1]["total_urls_in_email"] == 3001 and c[2]["total_urls_in_email"] == 0
