"""Mail and link counts: equal to the plain patterns, and linear on long runs."""
import random
import re
import time

from pyspark.sql import functions as F

from lurelens.functions import email_features as ef

MAIL = re.compile(r"\S+@\S+\.\S+")
LINK = re.compile(r"<a\s+.*?href.*?>", re.I)


def _mails(text):
    return F.regexp_count(text, F.lit(ef.EMAIL_IN_TEXT_RE))


def _links():
    cols = ef.email_cols(present={"html_content"})
    return ef.email_feature_columns(cols, text=F.lit(""), tl=F.lit(""), tokens=F.array())["num_links"]


def _strings(parts, n, seed):
    rnd = random.Random(seed)
    return ["".join(rnd.choice(parts) for _ in range(rnd.randint(0, 25))) for _ in range(n)]


def test_mail_count_equals_the_pattern(spark):
    texts = _strings(["a", "@", ".", " ", "\n", "é", "b", "\x1f", "@.", ".."], 3000, 1)
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    assert [r[0] for r in df.select(_mails(F.col("t"))).collect()] == [len(MAIL.findall(t)) for t in texts]


def test_link_count_equals_the_pattern(spark):
    parts = ["<a", " ", "\n", "href", "HREF", ">", "x", "<a ", "<A\n", "\r", "\u2028"]
    htmls = _strings(parts, 3000, 2)
    df = spark.createDataFrame([(h,) for h in htmls], "html_content string")
    assert [r[0] for r in df.select(_links()).collect()] == [len(LINK.findall(h)) for h in htmls]


def test_long_runs_take_linear_time(spark):
    df = spark.createDataFrame([("x" * 1_000_000, "<a name=y " * 100_000), ("@" * 1_000_000, "<a href " * 100_000)],
                               "t string, html_content string")
    start = time.time()
    rows = df.select(_mails(F.col("t")), _links()).collect()
    assert [tuple(r) for r in rows] == [(0, 0), (0, 0)]
    assert time.time() - start < 30
