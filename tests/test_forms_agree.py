"""The same URL as a column and in an array gives the same features and analysis."""
import pytest
from pyspark.sql import functions as F

from lurelens.functions.combine import url_feature_array
from lurelens.functions.manifest import URL_FEATURES
from lurelens.functions.url_features import with_url_features
from lurelens.operators import scoring as sc

URLS = ["http://paypa1-verify.ga/login", "http://1.2.3.4:80/a", "http://u:p@h.com/x;y?q=1&r=2#f", "//host/p",
        "host/path", "HTTPS://A.COM/", "https://www.linkedin.com", "https://www.microsoft.com",
        "http://a.b/\U0001F600x", "http://kraken-login-2024x9.weebly.com/x", "https://t.co/bit.ly?utm_source=1",
        "http://amazon-prize-claim.tk/%7Euser//a..b", "https://a.b.c.d.accounts.google.com.evil.top/2021"]


@pytest.fixture(scope="module")
def urls(spark):
    return spark.createDataFrame([(i, u) for i, u in enumerate(URLS)], "id long, url string")


def test_features_of_columns_and_arrays_agree(urls):
    column = {r["id"]: r for r in with_url_features(urls, "url", 2024).collect()}
    arr = urls.select("id", F.array("url").alias("urls")).select("id", url_feature_array("urls", 2024).alias("a"))
    for r in arr.collect():
        for k in URL_FEATURES:
            assert float(r["a"][0][k]) == pytest.approx(float(column[r["id"]][k]), abs=1e-12), (URLS[r["id"]], k)


def test_analyses_of_columns_and_arrays_agree(urls):
    column = {r["id"]: r for r in sc.score_urls(urls).collect()}
    arr = sc.analyze_url_array(urls.select("id", F.array("url").alias("urls")), "urls", "a")
    for r in arr.collect():
        got, want = r["a"][0], column[r["id"]]
        assert (got["risk_score"], got["risk_level"], got["risk_factors"]) == (want["risk_score"], want["risk_level"], want["risk_factors"]), URLS[r["id"]]
