"""The two-level form of C2 and M17 equals the array form; one huge mail is spread."""
import random

import pytest
from pyspark.sql import functions as F

from lurelens.functions import combine as cb
from lurelens.functions.manifest import ALL_FEATURES
from lurelens.operators import large_mails as lm
from lurelens.operators import scoring as sc

HOSTS = ["http://paypa1-verify.ga/login", "http://1.2.3.4:80/a", "http://u:p@h.com/x;y?q=1&r=2#f", "https://bit.ly/2x9",
         "https://www.microsoft.com/a", "http://kraken-login-2024x9.weebly.com/x", "http://[::1", "http://[::1]/a", "https://a.b.c.d.e.top/é"]


@pytest.fixture(scope="module")
def mails(spark):
    rng = random.Random(4)
    rows = []
    for i in range(60):
        n = rng.choice([0, 1, 2, 6, 7, 8, 60, 300])
        urls = [f"{rng.choice(HOSTS[:6] if i % 5 else HOSTS)}{rng.randrange(80)}" for _ in range(n)]
        rows.append((i, rng.choice(["Hello", "verify your account", None]), " and ".join(urls) if n or i % 2 else None,
                     rng.choice(["a@gmail.com", "x@paypal.com", None, "dean@uni.edu"]), "k"))
    return spark.createDataFrame(rows, "id long, subject string, body string, sender string, note string").repartition(5)


def by_id(df):
    return {r["id"]: r.asDict(recursive=True) for r in df.collect()}


@pytest.mark.parametrize("part_urls", [7, 1024])
def test_combined_features_equal_the_array_form(mails, part_urls):
    want = by_id(sc.combined_features(mails, 2024).select("id", "note", *ALL_FEATURES))
    got = by_id(lm.combined_features(mails, ["id"], part_urls, 2024, keep=("note",)))
    assert got.keys() == want.keys()
    for i, row in want.items():
        assert got[i].pop("note") == row.pop("note") == "k"
        assert got[i] == pytest.approx(row, rel=1e-12, abs=1e-12)


@pytest.mark.parametrize("part_urls", [7, 1024])
def test_scores_equal_the_array_form(mails, part_urls):
    cols = ["id", "email_risk_score", "email_risk_level", "email_risk_factors", "combined_risk_score", "combined_risk_level",
            "recommendations", "urls_found", "url_analyses"]
    whole = sc.score_emails_with_urls(mails)
    got = lm.score_emails_with_urls(mails, ["id"], part_urls, with_analyses=True)
    assert by_id(got.select(cols)) == by_id(whole.select(cols))
    lean = by_id(lm.score_emails_with_urls(mails, ["id"], part_urls))
    assert {i: r["n_urls"] for i, r in lean.items()} == {i: len(r["urls_found"]) for i, r in by_id(whole).items()}
    assert "url_analyses" not in next(iter(lean.values()))


def test_a_mail_of_a_million_urls_is_spread(spark):
    n = 1_000_000
    body = F.array_join(F.transform(F.sequence(F.lit(1), F.lit(n)), lambda i: F.concat(F.lit("http://h"), i % 1000, F.lit(".tk/p"), i)), " ")
    big = spark.range(1).select(F.col("id"), body.alias("body")).union(spark.createDataFrame([(1, "see http://a.com/b"), (2, None)], "id long, body string"))
    dealt = lm.deal_urls(big, ["id"], cb.body_urls(F.coalesce("body", F.lit("")))).filter("id = 0")
    parts = dealt.select(F.size("urls").alias("n"), F.spark_partition_id().alias("task")).groupBy("task").agg(F.sum("n").alias("n"), F.max("n").alias("most")).collect()
    assert sum(r["n"] for r in parts) == n and max(r["most"] for r in parts) == lm.PART_URLS
    assert len(parts) == 8 and max(r["n"] for r in parts) < n / 4
    got = {r["id"]: r for r in lm.combined_features(big, ["id"], reference_year=2024).collect()}
    assert got[0]["total_urls_in_email"] == n == got[0]["suspicious_url_count"]
    assert got[0]["url_has_suspicious_tld"] == 1.0 and got[0]["url_num_dots"] == 1.0
    lengths = sum(len(f"http://h{i % 1000}.tk/p{i}") for i in range(1, n + 1))
    assert got[0]["url_url_length"] == pytest.approx(lengths / n, rel=1e-12)
    assert (got[1]["total_urls_in_email"], got[2]["total_urls_in_email"], got[2]["url_num_dots"]) == (1, 0, 0.0)


def test_each_url_is_parsed_once(spark):
    """One clean-up, one entropy and one pass over the features in the plan."""
    df = spark.createDataFrame([(1, "http://a.b/c")], "id long, body string")
    plan = sc.combined_features(df, 2024)._jdf.queryExecution().optimizedPlan().toString()
    # the entropy and the sums are the two aggregates over URLs
    assert (plan.count("LOG2("), plan.count("[\\t\\r\\n]"), plan.count("aggregate(")) == (1, 1, 2)
