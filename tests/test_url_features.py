"""URL features: hand-checked values and properties."""
import math

import pytest
from pyspark.sql import functions as F

from lurelens.functions.manifest import URL_FEATURES
from lurelens.operators import scoring as sc


def feats(spark, urls, year=2024):
    df = spark.createDataFrame([(i, u) for i, u in enumerate(urls)], "id long, url string")
    return {r["url"]: r.asDict() for r in sc.url_features(df, "url", year).collect()}


def test_ip_port_url(spark):
    f = feats(spark, ["http://1.2.3.4:80/a"])["http://1.2.3.4:80/a"]
    assert f["url_length"] == 19 and f["num_dots"] == 3 and f["num_slashes"] == 3
    assert f["has_ip_address"] == 1 and f["has_port"] == 1 and f["num_subdomains"] == 2
    assert f["path_length"] == 2 and f["path_depth"] == 1 and f["has_https"] == 0
    assert f["digit_ratio_host"] == pytest.approx(4 / 7)


def test_userinfo_params_query(spark):
    f = feats(spark, ["http://u:p@h.com/x;y?q=1&r=2#f"])["http://u:p@h.com/x;y?q=1&r=2#f"]
    # netloc 'u:p@h.com' is cut at the first ':' -> host 'u': no subdomains
    assert f["has_authentication"] == 1 and f["has_port"] == 1 and f["num_subdomains"] == 0
    assert f["path_length"] == 2  # ';y' is split off as params
    assert f["query_length"] == 7 and f["num_query_params"] == 2
    assert f["has_at_symbol"] == 1


def test_substring_quirks(spark):
    f = feats(spark, ["https://www.linkedin.com", "https://www.microsoft.com"])
    assert f["https://www.linkedin.com"]["has_suspicious_tld"] == 1  # '.link'
    assert f["https://www.microsoft.com"]["has_shortening_service"] == 1  # 't.co'
    assert f["https://www.microsoft.com"]["brand_keyword_count"] == 1


def test_entropy_and_complexity(spark):
    u = "aab"
    f = feats(spark, [u])[u]
    expect = -(2 / 3 * math.log2(2 / 3) + 1 / 3 * math.log2(1 / 3))
    assert f["url_entropy"] == pytest.approx(expect, abs=1e-12)
    assert f["url_complexity"] == pytest.approx(min(expect * 3 / 50 / 10, 1.0))


def test_emoji_counts_code_points(spark):
    u = "http://a.b/\U0001F600x"
    f = feats(spark, [u])[u]
    assert f["url_length"] == len(u) == 13


def test_homograph_and_years(spark):
    u = "http://vvrn01lo.com/2021/IO"
    f = feats(spark, [u], year=2024)[u]
    # 0, 1, l, o, rn, vv (counted twice) -> 7 hits -> capped at 1.0; I/O never hit
    assert f["homograph_score"] == 1.0
    assert f["has_any_year"] == 1 and f["has_current_year"] == 0 and f["has_uppercase"] == 1


def test_properties_on_corpus(spark, sf001):
    from lurelens.sources.corpora import url_corpus
    rows = sc.url_features(url_corpus(spark, sf001), "url", 2024).collect()
    assert rows
    for r in rows:
        assert r["encoding_count"] == r["num_percent"]
        assert r["has_excessive_subdomains"] == int(r["num_subdomains"] > 2)
        assert 0.0 <= r["homograph_score"] <= 1.0 and 0.0 <= r["url_complexity"] <= 1.0
    assert set(URL_FEATURES) <= set(rows[0].asDict())


def test_error_rows_have_no_features(spark):
    df = spark.createDataFrame([(0, None), (1, ""), (2, "http://[::1/x")], "id long, url string")
    rows = {r["id"]: r for r in sc.url_features(df).collect()}
    assert rows[0]["error"] == "Invalid URL provided" and rows[0]["url_length"] is None
    assert rows[1]["error"] == "Invalid URL provided"
    assert rows[2]["error"].startswith("Error analyzing URL:")
