"""Table functions: features and risk scoring of URL and email tables.

Every function is ``DataFrame -> DataFrame`` (use with ``DataFrame.transform``),
narrow (no shuffle), and works on batch and streaming DataFrames alike.
Intermediate values used by several expressions (URL parts, URL arrays,
per-URL feature structs) are staged in their own projection so they are
computed once per row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import combine as cb
from ..functions.email_features import email_cols, email_feature_columns, stage_email_text
from ..functions.email_rules import analyze_emails, recommendations
from ..functions.manifest import ALL_FEATURES, EMAIL_FEATURES, URL_FEATURES
from ..functions.text import level
from ..functions import lexicons as lx
from ..functions.url_features import with_url_features
from ..functions.url_parts import parts_array_sql, stage_parts
from ..functions.url_rules import (analysis_from_rules, final_url_struct, finish_analysis, finish_url_struct,
                                   rule_values, rules_of, url_analysis_array_sql, url_error, url_rule_columns)

ANALYSIS_COLS = ("risk_score", "risk_level", "risk_factors", "ml_prediction", "ml_confidence", "error")


def _col(c):
    return F.col(c) if isinstance(c, str) else c


def url_features(df: DataFrame, url_col: str = "url", reference_year: int | None = None) -> DataFrame:
    """U42 (+U43 ``error``): the 40 URL features as columns."""
    return with_url_features(df, url_col, reference_year)


def score_urls(df: DataFrame, url_col: str = "url", tabular_prob=None, text_prob=None,
               with_features: bool = False, reference_year: int | None = None) -> DataFrame:
    """Rule-based analysis of every URL row (R1-R14, optional B2/B3).

    Adds risk_score, risk_level, risk_factors, ml_prediction, ml_confidence,
    error.  ``tabular_prob`` / ``text_prob`` are column names or Columns with
    model probabilities (NULL = no model for that row)."""
    base = with_url_features(df, url_col, reference_year, error_col=None) if with_features else df
    staged, p, tmp = stage_parts(base, url_col)
    rule_cols = {f"__r_{k}": c for k, c in rule_values(p).items()}
    staged = staged.withColumns({**rule_cols, "__r_err": url_error(p)})
    tab = None if tabular_prob is None else _col(tabular_prob)
    txt = None if text_prob is None else _col(text_prob)
    a = analysis_from_rules(rules_of(lambda k: F.col(f"__r_{k}")), tab, txt)
    staged = staged.withColumns({"__r_score": a["score"], "__r_factors": a["factors"]})
    fin = finish_analysis(F.col("__r_score"), F.col("__r_factors"), F.col("__r_err"), tab)
    return staged.withColumns(fin).drop(*tmp, *rule_cols, "__r_err", "__r_score", "__r_factors")


def url_pattern_list(df: DataFrame, url_col: str = "url") -> DataFrame:
    """The suspicious-pattern messages of each URL (ARRAY<STRING>)."""
    staged, p, tmp = stage_parts(df, url_col)
    return staged.withColumn("patterns", url_rule_columns(p).pattern_list()).drop(*tmp)


def _emails(df: DataFrame, **names) -> tuple:
    return email_cols(present=set(df.columns), **names)


def email_features(df: DataFrame, **names) -> DataFrame:
    """The 21 email features as columns (input column names overridable:
    subject, body, sender, html, headers, attachments)."""
    e = _emails(df, **names)
    staged, h, tmp = stage_email_text(df, e)
    return staged.withColumns(email_feature_columns(e, **h)).drop(*tmp)


def combined_features(df: DataFrame, reference_year: int | None = None, **names) -> DataFrame:
    """21 email features + 40 URL-feature means over the body URLs +
    URL counts, in manifest order (63 columns, missing values 0)."""
    e = _emails(df, **names)
    tmp_urls, tmp_feats, tmp_sums = "__c_urls", "__c_feats", "__c_sums"
    staged, h, tmp_text = stage_email_text(df, e)
    staged = staged.withColumn(tmp_urls, cb.body_urls(e.body))
    staged = staged.withColumn(tmp_feats, cb.url_feature_array(tmp_urls, reference_year))
    staged = staged.withColumn(tmp_sums, cb.url_feature_sums(tmp_feats))
    cols = dict(email_feature_columns(e, **h))
    cols.update(cb.url_feature_means(F.col(tmp_sums), F.size(tmp_feats)))
    cols["total_urls_in_email"] = F.size(tmp_feats)
    cols["suspicious_url_count"] = cb.suspicious_features(tmp_feats)
    cols = {k: cols[k] for k in ALL_FEATURES}
    return staged.withColumns(cols).drop(tmp_urls, tmp_feats, tmp_sums, *tmp_text)


def score_emails(df: DataFrame, tabular_prob=None, text_prob=None, **names) -> DataFrame:
    """Rule-based analysis of every email row (M1-M14, optional B4/B5)."""
    e = _emails(df, **names)
    tmp, hosts = "__m_urls", "__m_hosts"
    staged = df.withColumn(tmp, cb.body_urls(e.body)).withColumn(hosts, cb.body_hosts(tmp))
    out = analyze_emails(staged, e, cb.suspicious_hosts(hosts),
                         None if tabular_prob is None else _col(tabular_prob),
                         None if text_prob is None else _col(text_prob), error=mail_error(cb.any_parse_error(hosts)))
    return out.drop(tmp, hosts)


def mail_error(refused: Column) -> Column:
    """Error of a mail of which a body URL cannot be parsed."""
    return F.when(refused, F.lit(lx.MSG["url_error"].format(lx.MSG["parse_error"])))


def analyze_url_array(df: DataFrame, urls_col: str, out: str) -> DataFrame:
    """``out``: the analyses (url, risk_score, risk_level, risk_factors) of the
    URLs of an array column, in order; each step in its own projection."""
    tmp = "__a_urls"
    df = df.withColumn(tmp, F.expr(parts_array_sql(f"`{urls_col}`")))
    df = df.withColumn(tmp, F.expr(url_analysis_array_sql(tmp)))
    df = df.withColumn(tmp, F.transform(tmp, finish_url_struct))
    return df.withColumn(out, F.transform(tmp, final_url_struct)).drop(tmp)


def score_emails_with_urls(df: DataFrame, **names) -> DataFrame:
    """The email analysis plus the analysis of every URL found in
    subject and body (C8); combined score = max(email, max URL score),
    combined level on the email thresholds, recommendations.

    The URL analyses are an ARRAY<STRUCT> in the email row, so the query has
    no shuffle; ``explode`` it for one row per URL.  Headers and HTML are not
    used here (quick entry, M15)."""
    e = _emails(df, **names)
    quick = {k: v for k, v in names.items() if k in ("subject", "body", "sender")}
    scored = score_emails(df, headers=None, html=None, attachments=None, **quick)
    scored = scored.withColumns({
        "email_risk_score": F.col("risk_score"), "email_risk_level": F.col("risk_level"),
        "email_risk_factors": F.col("risk_factors"),
    }).drop(*[c for c in ANALYSIS_COLS if c in scored.columns], "is_legitimate", "bypassed_indicators")
    scored = scored.withColumn("urls_found", cb.public_urls(e.text))
    scored = analyze_url_array(scored, "urls_found", "url_analyses")
    max_url = F.array_max(F.transform("url_analyses", lambda a: a["risk_score"]))
    return combine_risk(scored, max_url)


def combine_risk(df: DataFrame, max_url: Column) -> DataFrame:
    """Combined score (of email_risk_score and the largest URL score,
    null without URLs), level and advice."""
    combined = F.greatest(F.col("email_risk_score"), F.coalesce(max_url, F.col("email_risk_score")))
    out = df.withColumn("combined_risk_score", combined)
    out = out.withColumn("combined_risk_level", level(F.col("combined_risk_score"), lx.EMAIL_LEVELS))
    return out.withColumn("recommendations", recommendations(F.col("combined_risk_level")))


def feature_matrix(df: DataFrame, features=ALL_FEATURES) -> DataFrame:
    """The manifest columns in manifest order as DOUBLE, missing -> 0.0."""
    present = set(df.columns)
    cols = [(F.coalesce(F.col(f).cast("double"), F.lit(0.0)) if f in present else F.lit(0.0)).alias(f)
            for f in features]
    others = [c for c in df.columns if c not in set(features)]
    return df.select(*others, *cols)


__all__ = [
    "url_features", "score_urls", "url_pattern_list", "email_features", "combined_features",
    "score_emails", "score_emails_with_urls", "feature_matrix", "EMAIL_FEATURES", "URL_FEATURES",
]
