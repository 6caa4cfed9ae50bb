"""Mails with very many URLs: C2, M17 and M18 in two levels.

``scoring`` keeps the URLs of a mail in its row, which needs no shuffle and suits
ordinary mail; a mail of a million URLs is then one row of work.  Here the URLs
are dealt out to (mail, part) rows of about ``part_urls`` URLs each.  A part runs
the same array expressions and gives sums, counts and a maximum; the parts of a
mail are put together in order.  Which form to use is the caller's choice; the
results are equal (C2 up to the order of floating-point additions).

Only URLs, keys and the columns named in ``keep`` move: what the rules read from
a mail's text is computed before the join with its URLs.

``key`` names columns that identify a mail and are not null.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import combine as cb
from ..functions.email_features import email_cols
from ..functions.email_rules import STAGE, score_staged_emails, stage_email_rules
from ..functions.manifest import ALL_FEATURES, EMAIL_FEATURES, URL_FEATURES
from . import scoring as sc

PART_URLS = 1024


def deal_urls(df: DataFrame, key: list[str], urls: Column, part_urls: int = PART_URLS, distinct: bool = False) -> DataFrame:
    """key, part, urls: runs of ``part_urls`` URLs of each mail, in order.

    ``distinct``: equal URLs of a mail meet in one part, which is drawn by hash
    among as many parts as the mail's URLs need; a part holds each URL once, in
    sorted order.  Mails without URLs give no row."""
    rows = df.select(*key, urls.alias("u")).select(*key, F.size("u").alias("n"), F.posexplode("u").alias("pos", "url"))
    if distinct:
        part = F.pmod(F.xxhash64("url"), F.ceil(F.col("n") / part_urls))
        return rows.groupBy(*key, part.alias("part")).agg(F.sort_array(F.collect_set("url")).alias("urls"))
    part = F.floor(F.col("pos") / part_urls)
    run = rows.groupBy(*key, part.alias("part")).agg(F.sort_array(F.collect_list(F.struct("pos", "url"))).alias("run"))
    return run.select(*key, "part", F.transform("run", lambda x: x["url"]).alias("urls"))


def _in_order(parts: Column, fields: dict[str, Column]) -> Column:
    """Sums of ``fields`` over an array of part structs, in order of the parts."""
    zero = F.struct(*[z.alias(k) for k, z in fields.items()])
    return F.aggregate(F.sort_array(parts), zero, lambda a, p: F.struct(*[(a[k] + p[k]).alias(k) for k in fields]))


def url_means(df: DataFrame, key: list[str], body: Column, part_urls: int = PART_URLS,
              reference_year: int | None = None) -> DataFrame:
    """C2-C4 of mails with URLs: key, 40 means, total_urls_in_email,
    suspicious_url_count."""
    parts = deal_urls(df, key, cb.body_urls(body), part_urls).withColumn("feats", cb.url_feature_array("urls", reference_year))
    parts = parts.withColumn("sums", cb.url_feature_sums("feats"))
    row = F.struct("part", F.size("feats").alias("n"), cb.suspicious_features("feats").alias("suspicious"),
                   *[F.col("sums")[k].alias(k) for k in URL_FEATURES])
    fields = {"n": F.lit(0), "suspicious": F.lit(0), **{k: F.lit(0.0) for k in URL_FEATURES}}
    mails = parts.select(*key, row.alias("p")).groupBy(*key).agg(F.collect_list("p").alias("ps"))
    mails = mails.select(*key, _in_order(F.col("ps"), fields).alias("s"))
    s = F.col("s")
    return mails.select(*key, *[c.alias(k) for k, c in cb.url_feature_means(s, s["n"]).items()],
                        s["n"].alias("total_urls_in_email"), s["suspicious"].alias("suspicious_url_count"))


def combined_features(df: DataFrame, key: list[str], part_urls: int = PART_URLS, reference_year: int | None = None,
                      keep: tuple[str, ...] = (), **names) -> DataFrame:
    """C1-C7 as ``scoring.combined_features``: key, ``keep`` and the 63 features."""
    e = email_cols(present=set(df.columns), **names)
    own = sc.email_features(df, **names).select(*key, *keep, *EMAIL_FEATURES)
    joined = own.join(url_means(df, key, e.body, part_urls, reference_year), key, "left")
    zero = {k: F.coalesce(F.col(k), F.lit(0).cast(t)).alias(k) for k, t in joined.dtypes if k in ALL_FEATURES}
    return joined.select(*key, *keep, *[zero[k] for k in ALL_FEATURES])


def body_facts(df: DataFrame, key: list[str], body: Column, part_urls: int = PART_URLS) -> DataFrame:
    """key, n_suspicious, refused: C4 and whether a URL cannot be parsed."""
    parts = deal_urls(df, key, cb.body_urls(body), part_urls).withColumn("hosts", cb.body_hosts("urls"))
    return parts.select(*key, cb.suspicious_hosts("hosts").alias("n"), cb.any_parse_error("hosts").alias("bad")).groupBy(*key).agg(
        F.sum("n").cast("int").alias("n_suspicious"), F.max("bad").alias("refused"))


def url_analyses(df: DataFrame, key: list[str], text: Column, part_urls: int = PART_URLS) -> DataFrame:
    """key, part, urls, url_analyses: every distinct URL of each mail, analysed,
    in parts; explode for one row per URL."""
    return sc.analyze_url_array(deal_urls(df, key, cb.public_urls(text), part_urls, distinct=True), "urls", "url_analyses")


def score_emails_with_urls(df: DataFrame, key: list[str], part_urls: int = PART_URLS, keep: tuple[str, ...] = (),
                           with_analyses: bool = False, **names) -> DataFrame:
    """M17-M19 as ``scoring.score_emails_with_urls``: key, ``keep``, the email's
    own analysis (email_risk_*), n_urls, max_url_score, combined_risk_score,
    combined_risk_level, recommendations, error.

    The analyses themselves stay in parts (``url_analyses``).  ``with_analyses``
    puts them together again in sorted order, as urls_found and url_analyses: one
    array in the mail's row, which the caller then asks for."""
    quick = {k: v for k, v in names.items() if k in ("subject", "body", "sender")}
    e = email_cols(present=set(df.columns), headers=None, html=None, attachments=None, **quick)
    facts = body_facts(df, key, e.body, part_urls)
    staged = stage_email_rules(df, e)
    staged = staged.select(*key, *keep, *[c for c in staged.columns if c.startswith(STAGE)]).join(facts, key, "left")
    scored = score_staged_emails(staged, F.coalesce("n_suspicious", F.lit(0)), error=sc.mail_error(F.coalesce("refused", F.lit(False))))
    scored = scored.select(*key, *keep, F.col("risk_score").alias("email_risk_score"), F.col("risk_level").alias("email_risk_level"),
                           F.col("risk_factors").alias("email_risk_factors"), "error")
    parts = url_analyses(df, key, e.text, part_urls)
    aggs = [F.sum(F.size("urls")).alias("n_urls"),
            F.max(F.array_max(F.transform("url_analyses", lambda a: a["risk_score"]))).alias("max_url_score")]
    if with_analyses:
        aggs.append(F.sort_array(F.flatten(F.collect_list("url_analyses"))).alias("url_analyses"))
    out = scored.join(parts.groupBy(*key).agg(*aggs), key, "left").withColumn("n_urls", F.coalesce("n_urls", F.lit(0).cast("long")))
    if with_analyses:
        empty = F.array().cast(out.schema["url_analyses"].dataType)
        out = out.withColumn("url_analyses", F.coalesce("url_analyses", empty))
        out = out.withColumn("urls_found", F.transform("url_analyses", lambda a: a["url"]))
    return sc.combine_risk(out, F.col("max_url_score"))
