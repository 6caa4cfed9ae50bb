"""Registered email queries (E, C, M, V1/V2/V5/V6 on the email corpus)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import combine as cb
from ..functions.email_features import email_cols
from ..functions.manifest import ALL_FEATURES, EMAIL_FEATURES, URL_FEATURES
from ..functions.email_rules import has_phishing_indicators, legitimacy_reason
from ..operators import evaluate as ev
from ..operators import large_mails as lm
from ..operators import scoring as sc
from ..sources.corpora import email_corpus, url_corpus
from . import oracle_email as oe
from . import oracle_url as ou
from . import sqlgen as g
from .registry import add, register
from .shape import joined, normalize, r6

YEAR = 2024


def _features(spark, sf, spf_key="Received-SPF"):
    return sc.email_features(email_corpus(spark, sf, spf_key))


@register("q_E22_email_features", oe.email_features_query())
def q_e22(spark, sf):
    """All 21 email features of every corpus email."""
    return normalize(_features(spark, sf).select("email_id", *EMAIL_FEATURES))


def _one_feature(name):
    def fn(spark, sf):
        return normalize(_features(spark, sf).select("email_id", name))
    return fn


for _i, _name in enumerate(EMAIL_FEATURES, 1):
    add(f"q_E{_i:02d}_{_name}", _one_feature(_name), oe.email_features_query(only=[_name]), f"Email feature {_name}")

_HDR = ["has_spf", "has_dkim", "has_dmarc", "spf_result_match"]


@register("q_E14_E17_spf_key_variant", oe.email_features_query("SPF", only=_HDR))
def q_e14(spark, sf):
    """Header features when the SPF header key starts with 'spf'."""
    return normalize(_features(spark, sf, "SPF").select("email_id", *_HDR))


@register("q_C1_body_urls", "SELECT email_id, CAST(pos AS BIGINT) AS pos, url FROM (" + oe.body_url_rows() + ") x")
def q_c1(spark, sf):
    """Raw body URLs of each email, one row per URL, duplicates kept."""
    e = email_corpus(spark, sf)
    ex = e.select("email_id", F.posexplode(cb.body_urls(F.coalesce("body", F.lit("")))).alias("p0", "url"))
    return ex.select("email_id", (F.col("p0") + 1).cast("bigint").alias("pos"), "url")


@register("q_C8_public_urls",
          f"SELECT email_id, coalesce(array_to_string({oe.public_urls_expr('_text')}, ' | '), '') AS urls "
          f"FROM ({oe.email_base()}) e")
def q_c8(spark, sf):
    """URLs for scoring found in subject and body (cleaned, distinct, sorted)."""
    e = email_corpus(spark, sf)
    text = F.concat(F.coalesce("subject", F.lit("")), F.lit(" "), F.coalesce("body", F.lit("")))
    return e.select("email_id", joined(cb.public_urls(text)).alias("urls"))


_MEANS = [f"url_{n}" for n in URL_FEATURES] + ["total_urls_in_email", "suspicious_url_count"]


@register("q_C2_url_feature_means", oe.url_means_query(YEAR))
def q_c2(spark, sf):
    """Mean of each URL feature over the body URLs (0 without URLs) + counts."""
    df = sc.combined_features(email_corpus(spark, sf), reference_year=YEAR)
    return normalize(df.select("email_id", *_MEANS))


@register("q_C2_by_parts", oe.url_means_query(YEAR))
def q_c2_parts(spark, sf):
    """C2 in two levels; parts of two URLs, so that mails are dealt out."""
    df = lm.combined_features(email_corpus(spark, sf), ["email_id"], part_urls=2, reference_year=YEAR)
    return normalize(df.select("email_id", *_MEANS))


@register("q_C7_feature_matrix",
          f"SELECT email_id, {', '.join(f'CAST({c} AS DOUBLE) AS {c}' for c in ALL_FEATURES)} FROM ("
          f"SELECT f.*, {', '.join('m.' + c for c in _MEANS)} FROM ({oe.email_features_query()}) f "
          f"JOIN ({oe.url_means_query(YEAR)}) m ON f.email_id = m.email_id) j")
def q_c7(spark, sf):
    """The 63-column feature matrix in manifest order (missing -> 0)."""
    df = sc.feature_matrix(sc.combined_features(email_corpus(spark, sf), reference_year=YEAR))
    return normalize(df.select("email_id", *ALL_FEATURES))


_SE = oe.scored_emails_select()


@register("q_M1_M2_indicators", f"SELECT email_id, CAST(_ind AS BIGINT) AS strong_indicators FROM ({_SE}) z")
def q_m1(spark, sf):
    """Strong phishing phrase or strong URL pattern present."""
    e = email_corpus(spark, sf)
    ec = email_cols(present=set(e.columns))
    staged = e.withColumn("__ft", F.lower(ec.text))
    return staged.select("email_id", has_phishing_indicators("`__ft`").cast("bigint").alias("strong_indicators"))


@register("q_M8_legitimacy", f"SELECT email_id, _reason AS legit_reason, CAST(_bypass AS BIGINT) AS is_legitimate FROM ({_SE}) z")
def q_m8(spark, sf):
    """Legitimacy decision (M3-M9): first matching reason and the bypass flag."""
    e = email_corpus(spark, sf)
    ec = email_cols(present=set(e.columns))
    staged = e.withColumns({"__ft": F.lower(ec.text), "__sl": F.lower(ec.sender)})
    staged = staged.withColumn("__ind", has_phishing_indicators("`__ft`"))
    staged = staged.withColumn("legit_reason", legitimacy_reason("`__ft`", "`__sl`", "`__ind`"))
    ieee = F.col("__sl").contains("ieee") | F.col("__ft").contains("ieee")
    return staged.select("email_id", "legit_reason",
                         (F.col("legit_reason").isNotNull() | ieee).cast("bigint").alias("is_legitimate"))


@register("q_M16_score_emails",
          f"SELECT email_id, {g.r6('_score')} AS risk_score, _level AS risk_level, "
          f"coalesce(array_to_string(_factors, ' | '), '') AS risk_factors FROM ({_SE}) z")
def q_m16(spark, sf):
    """Rule-based email analysis: score, level, reasons with headline."""
    s = sc.score_emails(email_corpus(spark, sf))
    return s.select("email_id", r6(F.col("risk_score")).alias("risk_score"), "risk_level",
                    joined(F.col("risk_factors")).alias("risk_factors"))


def m17(spark, sf):
    return sc.score_emails_with_urls(email_corpus(spark, sf))


def _m17_columns(s):
    max_url = F.array_max(F.transform("url_analyses", lambda a: a["risk_score"]))
    return s.select(
        "email_id", r6(F.col("email_risk_score")).alias("email_risk_score"), "email_risk_level",
        joined(F.col("email_risk_factors")).alias("email_risk_factors"),
        joined(F.col("urls_found")).alias("urls_found"),
        F.size("urls_found").cast("bigint").alias("n_urls"),
        r6(max_url).alias("max_url_score"),
        r6(F.col("combined_risk_score")).alias("combined_risk_score"), "combined_risk_level",
        joined(F.col("recommendations")).alias("recommendations"))


@register("q_M17_email_with_urls", oe.email_with_urls_query())
def q_m17(spark, sf):
    """Email analysis combined with the analysis of every URL it contains."""
    return _m17_columns(m17(spark, sf))


@register("q_M17_by_parts", oe.email_with_urls_query())
def q_m17_parts(spark, sf):
    """M17 in two levels, put together again; parts of two URLs."""
    return _m17_columns(lm.score_emails_with_urls(email_corpus(spark, sf), ["email_id"], part_urls=2, with_analyses=True))


# ------------------------------------------------------------ evaluation (V1, V2, V5, V6)

_PRED_SQL = ("SELECT label, CASE WHEN combined_risk_level IN ('HIGH', 'MEDIUM') THEN 1 ELSE 0 END AS prediction "
             f"FROM ({oe.email_with_urls_query()}) m JOIN ({g.email_corpus_sql()}) c USING (email_id)")
_URL_PRED_SQL = ("SELECT label, CASE WHEN risk_level IN ('HIGH', 'MEDIUM') THEN 1 ELSE 0 END AS prediction "
                 f"FROM ({ou.scored_urls_select(g.url_corpus_sql())}) s")


def _email_predictions(spark, sf):
    s = m17(spark, sf)
    return s.select("label", ev.level_prediction(F.col("combined_risk_level")).alias("prediction"))


def _url_predictions(spark, sf):
    s = sc.score_urls(url_corpus(spark, sf), "url")
    return s.select("label", ev.level_prediction(F.col("risk_level")).alias("prediction"))


def _cm_sql(src):
    return ("SELECT CAST(a.label AS BIGINT) AS label, CAST(p.prediction AS BIGINT) AS prediction, "
            "CAST(count(s.label) AS BIGINT) AS n "
            "FROM (SELECT 0 AS label UNION ALL SELECT 1) a CROSS JOIN (SELECT 0 AS prediction UNION ALL SELECT 1) p "
            f"LEFT JOIN ({src}) s ON s.label = a.label AND s.prediction = p.prediction GROUP BY a.label, p.prediction")


def _metrics_sql(src, model):
    tp = "sum(CASE WHEN label = 1 AND prediction = 1 THEN 1 ELSE 0 END)"
    fp = "sum(CASE WHEN label = 0 AND prediction = 1 THEN 1 ELSE 0 END)"
    fn_ = "sum(CASE WHEN label = 1 AND prediction = 0 THEN 1 ELSE 0 END)"
    acc = "sum(CASE WHEN label = prediction THEN 1 ELSE 0 END)::DOUBLE / count(*)"
    prec = f"CASE WHEN {tp} + {fp} = 0 THEN 0.0 ELSE {tp}::DOUBLE / ({tp} + {fp}) END"
    rec = f"CASE WHEN {tp} + {fn_} = 0 THEN 0.0 ELSE {tp}::DOUBLE / ({tp} + {fn_}) END"
    return (f"SELECT {g.q(model)} AS model, CAST(count(*) AS BIGINT) AS n, {acc} AS accuracy, {prec} AS precision, "
            f"{rec} AS recall FROM ({src}) s")


def _with_f1(inner):
    return (f"SELECT model, n, {g.r6('accuracy')} AS accuracy, {g.r6('precision')} AS precision, {g.r6('recall')} AS recall, "
            f"{g.r6('CASE WHEN precision + recall = 0 THEN 0.0 ELSE 2 * precision * recall / (precision + recall) END')} AS f1 "
            f"FROM ({inner}) t")


@register("q_V1_confusion_matrix", _cm_sql(_PRED_SQL))
def q_v1(spark, sf):
    """2x2 confusion matrix of the combined email+URL rule decision."""
    return ev.confusion_matrix(_email_predictions(spark, sf))


@register("q_V2_metrics", _with_f1(_metrics_sql(_PRED_SQL, "rules_email")))
def q_v2(spark, sf):
    """Accuracy, precision, recall, F1 of the rule decision on the email corpus."""
    return ev.binary_metrics(_email_predictions(spark, sf), model="rules_email")


_V5_SQL = _with_f1(_metrics_sql(_PRED_SQL, "rules_email") + " UNION ALL " + _metrics_sql(_URL_PRED_SQL, "rules_url"))


@register("q_V5_metrics_table", _V5_SQL)
def q_v5(spark, sf):
    """Metrics of both rule scorers, one row per model."""
    return ev.binary_metrics(_email_predictions(spark, sf), model="rules_email").unionByName(
        ev.binary_metrics(_url_predictions(spark, sf), model="rules_url"))


@register("q_V6_metrics_long",
          "SELECT model, metric, " + g.r6("value * 100") + " AS percent FROM (" + _V5_SQL + ") t "
          "UNPIVOT (value FOR metric IN (accuracy, precision, recall, f1))")
def q_v6(spark, sf):
    """Model comparison in long form: (model, metric, percent)."""
    return ev.metrics_long(q_v5(spark, sf))
