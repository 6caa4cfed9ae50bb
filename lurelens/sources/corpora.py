"""Test corpora derived by Spark from the driver tables.

The driver tables carry page URLs and prose but no lures, so two
deterministic derivations plant them (the same definitions run as SQL in the
oracle).  They read whole tables; no row is dropped.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# FIXED VALUES: the planted URL hosts (by page_id % 12) and lure texts /
# senders (by doc_id % 10 and floor(doc_id / 10) % 8) of the test corpora.
URL_VARIANT_HOSTS = {
    1: "http://paypa1-verify.ga",
    3: "https://bit.ly",
    4: "http://user@secure-login.bank-verify.xyz",
    5: "https://a.b.c.d.accounts.google.com.evil.top",
    6: "http://kraken-login-2024x9.weebly.com",
    7: "https://www.microsoft.com",
    8: "http://amazon-prize-claim.tk/%7Euser//a..b",
    9: "HTTPS://WWW.PayPal.com",
}
URL_PHISHING_VARIANTS = (1, 2, 4, 5, 6, 8, 11)

EMAIL_LURES = {
    1: " Verify your account immediately: http://secure-verify-account.xyz/login!!!",
    2: " Dear winner, you have won. Claim: http://prize-claim-center.tk/claim and http://bit.ly/2x9",
    3: " Best regards, thanks",
    4: " Your PayPal account has been limited, see http://paypal-verify-account.ga/verify?id=1&utm_source=m",
    5: " Dr. A. Rao, Professor, Department of CS. Best regards",
    6: " IEEE account services: wire transfer due",
    7: " Update at http://192.168.10.7:8080/pay or https://www.google.com/a(b). Virus and malware found",
    8: " Amazon order, call 10.0.0.1 or write to help.desk@mail.example.com",
    9: " see https://github.com/explore, https://docs.python.org/3/ and https://github.com/explore",
}
EMAIL_SENDERS = {
    0: "user123@gmail.com", 1: "security@paypa1-verify.com", 2: "a.rao@nits.ac.in", 3: "",
    4: "billing@payment-update.xyz", 5: "hr@company.com", 6: "news@emails.ieee.org",
}
EMAIL_PHISHING_VARIANTS = (1, 2, 4, 7)

#: Session setting: number of partitions that scans are spread over (unset: none).
SPREAD_CONF = "spark.lurelens.spreadScans"


def balance(df: DataFrame, partitions: int | None = None) -> DataFrame:
    """Spreads rows over ``partitions`` tasks, or leaves the scan alone (the
    default: a cluster reading many files needs no shuffle for it).  The caller
    decides, by the argument or by the session setting ``SPREAD_CONF``; local
    runs over single-row-group files set it."""
    n = partitions or int(df.sparkSession.conf.get(SPREAD_CONF, "0"))
    return df.repartition(n) if n else df


def read_table(spark: SparkSession, sf_dir: str, name: str, spread: bool = True) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")
    return balance(df) if spread else df


def _case(key: Column, mapping: dict, default: Column) -> Column:
    out = None
    for k, v in mapping.items():
        val = v if isinstance(v, Column) else F.lit(v)
        out = F.when(key == k, val) if out is None else out.when(key == k, val)
    return out.otherwise(default)


def url_corpus_from_pages(pages: DataFrame) -> DataFrame:
    """``page_id, variant, url, label``: each page URL, host swapped by
    ``page_id % 12`` (variant 0 keeps the page URL).

    Written as prefix + tail + suffix with the page URL and its tail used
    once, so the expression stays small wherever the optimizer copies it."""
    v = F.col("page_id") % 12
    prefixes = [""] * 12
    for k, h in URL_VARIANT_HOSTS.items():
        prefixes[k] = h
    prefixes[10] = "https://login.coinbase.com"
    prefixes[11] = "http://netflix-billing-update.xyz"
    suffixes = [""] * 12
    suffixes[10], suffixes[11] = "&token=abc", ";v=1"
    pick = lambda arr: F.get(F.array(*[F.lit(x) for x in arr]), v.cast("int"))
    prefix = F.when(v == 2, F.concat(F.lit("http://192.168.7."), (F.col("page_id") % 256).cast("string"),
                                     F.lit(":8080"))).otherwise(pick(prefixes))
    tail = F.regexp_extract(F.col("url"), r"^[a-z]+://[^/?#]*(.*)$", 1)
    return pages.select(
        "page_id",
        v.alias("variant"),
        F.when(v == 0, F.col("url")).otherwise(F.concat(prefix, tail, pick(suffixes))).alias("url"),
        F.when(v.isin(*URL_PHISHING_VARIANTS), 1).otherwise(0).cast("int").alias("label"),
    )


def url_corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_corpus_from_pages(read_table(spark, sf_dir, "pages").select("page_id", "url"))


def email_corpus_from_documents(docs: DataFrame, spf_key: str = "Received-SPF") -> DataFrame:
    """``email_id, subject, body, sender, html_content, spf_header, dkim_header,
    auth_results, num_attachments, label, headers``."""
    d = F.col("doc_id")
    text = F.col("text")
    lure = _case(d % 10, EMAIL_LURES, F.lit(""))
    sender = _case(F.floor(d / 10).cast("bigint") % 8, EMAIL_SENDERS, F.lit(None).cast("string"))
    link = F.concat(F.lit("<a class=x href=http://t.example/"), d.cast("string"), F.lit(">go</a>"))
    html = F.when(d % 4 == 0, F.lit("")).otherwise(F.concat(
        F.lit("<p>"), text, F.lit("</p>"), F.repeat(link, (d % 4).cast("int")),
        F.when(d % 3 == 0, F.lit("<a name=top>top</a>")).otherwise(F.lit(""))))
    spf = _case(d % 5, {1: "pass", 2: "fail", 3: "softfail"}, F.lit(None).cast("string"))
    dkim = F.when(d % 3 == 1, F.lit("v=1"))
    auth = F.when(d % 7 == 1, F.lit("dmarc=pass"))
    out = docs.select(
        d.alias("email_id"),
        F.split_part(text, F.lit("\n"), F.lit(1)).alias("subject"),
        F.concat(text, lure).alias("body"),
        sender.alias("sender"),
        html.alias("html_content"),
        spf.alias("spf_header"),
        dkim.alias("dkim_header"),
        auth.alias("auth_results"),
        (d % 3).cast("int").alias("num_attachments"),
        F.when((d % 10).isin(*EMAIL_PHISHING_VARIANTS), 1).otherwise(0).cast("int").alias("label"),
    )
    return out.withColumn("headers", headers_map(spf_key))


def headers_map(spf_key: str = "Received-SPF") -> Column:
    """Header map in header order, NULL headers left out."""
    entries = F.array(
        F.struct(F.lit(spf_key).alias("key"), F.col("spf_header").alias("value")),
        F.struct(F.lit("DKIM-Signature").alias("key"), F.col("dkim_header").alias("value")),
        F.struct(F.lit("Authentication-Results").alias("key"), F.col("auth_results").alias("value")),
    )
    return F.map_from_entries(F.filter(entries, lambda e: e["value"].isNotNull()))


def email_corpus(spark: SparkSession, sf_dir: str, spf_key: str = "Received-SPF") -> DataFrame:
    return email_corpus_from_documents(read_table(spark, sf_dir, "documents").select("doc_id", "text"), spf_key)
