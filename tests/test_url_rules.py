"""URL risk rules: the hand-derived example and ordering/quirk checks."""
import pytest

from lurelens.operators import scoring as sc


def score(spark, urls):
    df = spark.createDataFrame([(i, u) for i, u in enumerate(urls)], "id long, url string")
    return {r["url"]: r for r in sc.score_urls(df).collect()}


def test_hand_example(spark):
    u = "http://paypa1-verify.ga/login"
    r = score(spark, [u])[u]
    # brand +0.55 (pattern 'paypa1'), TLD .ga +0.25, no https + 'login' +0.25 -> 1.05 -> 1.0
    assert r["risk_score"] == 1.0 and r["risk_level"] == "HIGH"
    assert r["risk_factors"] == [
        "🚨 Brand impersonation: pretending to be 'PayPal'",
        "⚠️ Suspicious TLD (.ga)",
        "⚠️ No HTTPS encryption on login/payment page",
    ]


def test_legit_domain_clears_brand_and_later_brands(spark):
    r = score(spark, ["https://www.paypal.com/amazon"])["https://www.paypal.com/amazon"]
    assert r["risk_score"] == 0.0 and r["risk_level"] == "SAFE" and r["risk_factors"] == []


def test_free_hosting_rules(spark):
    u = "http://kraken-login-2024x9.weebly.com/x"
    r = score(spark, [u])[u]
    assert r["risk_factors"][:4] == [
        "🚨 Brand impersonation: pretending to be 'Kraken'",
        "🚨 Suspicious Kraken lookalike on free hosting (weebly.com)",
        "⚠️ Suspicious long subdomain on free hosting",
        "⚠️ Numeric subdomain on free hosting",
    ]
    assert r["risk_level"] == "HIGH"


def test_patterns_and_levels(spark):
    u = "http://192.168.1.1/a.b.c.d.e"
    r = score(spark, [u])[u]
    assert "⚠️ IP address used instead of domain name" in r["risk_factors"]
    assert "⚠️ Excessive subdomains (5)" in r["risk_factors"]
    assert r["risk_score"] == pytest.approx(0.5) and r["risk_level"] == "MEDIUM"


def test_shortener_first_in_list_order(spark):
    u = "https://t.co/bit.ly"
    r = score(spark, [u])[u]
    assert "⚠️ URL shortener (bit.ly) - hides destination" in r["risk_factors"]
    assert r["risk_level"] == "LOW"


def test_errors_are_rows(spark):
    got = score(spark, [None, "", "http://[::1/x", "https://ok.example.com"])
    assert got[None]["risk_level"] == "ERROR" and got[None]["risk_factors"] == ["Invalid URL provided"]
    assert got[""]["risk_level"] == "ERROR"
    assert got["http://[::1/x"]["risk_level"] == "ERROR" and got["http://[::1/x"]["url"] == "http://[::1/x"
    assert got["https://ok.example.com"]["risk_level"] == "SAFE"


def test_model_blend(spark):
    df = spark.createDataFrame([("http://a.example.com/x", 0.8, None), ("http://paypa1.tk/login", 0.1, 0.3)],
                               "url string, p double, t double")
    rows = {r["url"]: r for r in sc.score_urls(df, tabular_prob="p", text_prob="t").collect()}
    a = rows["http://a.example.com/x"]
    assert a["risk_score"] == pytest.approx(0.88) and a["ml_prediction"] == 1
    assert a["risk_factors"][-1] == "🤖 ML Model: PHISHING detected (80.0% confidence)"
    b = rows["http://paypa1.tk/login"]
    # rules 1.05 -> tabular says legit: min(., 0.2) -> text says legit: * 0.85
    assert b["risk_score"] == pytest.approx(0.2 * 0.85) and b["ml_prediction"] == 0
    assert b["risk_factors"][-1] == "✅ BERT Model: Legitimate (70.0% confidence)"


def test_scores_in_unit_interval(spark, sf001):
    from lurelens.sources.corpora import url_corpus
    for r in sc.score_urls(url_corpus(spark, sf001)).collect():
        assert 0.0 <= r["risk_score"] <= 1.0 and len(r["risk_factors"]) <= 8
