"""URL parts against the standard library's urlparse."""
import random
from urllib.parse import urlparse

from pyspark.sql import functions as F

from lurelens.functions.url_parts import inline_parts

URLS = [
    "http://1.2.3.4:80/a", "http://u:p@h.com/x;y?q=1&r=2#f", "//host/p", "host/path", "HTTPS://A.COM/",
    "https://www.linkedin.com", "http://a.b/\U0001F600x", "mailto:someone@example.com", "ftp://f.example.org/a;type=i",
    "http://example.com/a/b;c/d;e?x#y", "https://ex.com?only=query", "  http://lead.space/p", "http://t\tab.com/x",
    "http://[::1]:8080/p", "javascript:alert(1)", "http://h.com/#frag?notq", "path:80", "a+b.c-d://netloc/x",
]


def test_parts_match_urlparse(spark):
    df = spark.createDataFrame([(u,) for u in URLS], "url string")
    p = inline_parts(F.col("url"))
    rows = df.select("url", p.netloc.alias("netloc"), p.path.alias("path"), p.query.alias("query")).collect()
    for r in rows:
        ref = urlparse(r["url"])
        assert (r["netloc"], r["path"], r["query"]) == (ref.netloc, ref.path, ref.query), r["url"]


def _refused(url):
    try:
        urlparse(url)
    except ValueError:
        return True
    return False


def test_parse_errors_match_urlparse(spark):
    rnd = random.Random(5)
    hosts = ["::", "::1", "1::", "1:2:3:4:5:6:7:8", "1:2:3:4:5:6:7::", "::2:3:4:5:6:7:8", "1:2:3:4:5:6:7", "1:2:3:4:5:6:7:8:9",
             "::ffff:1.2.3.4", "::1.2.3.256", "::01.2.3.4", "1.2.3.4", "1:2:3:4:5:6:1.2.3.4", "1:2:3:4:5:6:7:1.2.3.4",
             "fe80::1%eth0", "fe80::1%", "::%a%b", "v1.x", "v.x", "vg.x", "v1.", "V1.x", "abc", "", "12345::", ":::", "1::2::3"]
    hosts += ["".join(rnd.choice(["1", "ab", ":", "::", "0", "1.2.3.4", "%e", "g"]) for _ in range(rnd.randint(1, 9)))
              for _ in range(1500)]
    urls = [f"http://[{h}]/x" for h in hosts] + [f"http://a[{h}]c:80/x" for h in hosts[:40]]
    urls += ["http://[::1/x", "http://ok.com/x", "http://a]b[::1/x", "http://]a[b/x", "http://[::1]a[x]/", "http://a]/",
             "http://exam\u2100ple.com/", "http://a\uff0fb/", "http://a\u212bb/", "http://b\u00fccher.de/", "http://a.b/\u2100"]
    df = spark.createDataFrame([(u,) for u in urls], "url string")
    got = [r[0] for r in df.select(inline_parts(F.col("url")).parse_error).collect()]
    assert [(u, g) for u, g in zip(urls, got)] == [(u, _refused(u)) for u in urls]
