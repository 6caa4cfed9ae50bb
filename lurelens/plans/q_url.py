"""Registered URL queries (U, R, V7/V9/V10 on the URL corpus)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import lexicons as lx
from ..functions.manifest import URL_FEATURES
from ..functions.url_parts import stage_parts
from ..functions.url_rules import url_rule_columns
from ..operators import reporting as rp
from ..operators import scoring as sc
from ..sources.corpora import url_corpus
from . import oracle_url as ou
from . import sqlgen as g
from .registry import add, register
from .shape import joined, normalize, r6

YEAR = 2024  # fixed reference year for reproducible checks


def _features(spark, sf):
    return sc.url_features(url_corpus(spark, sf), "url", YEAR)


@register("q_U42_url_features", ou.url_features_query(year=YEAR))
def q_u42(spark, sf):
    """All 40 URL features of every corpus URL (+ parse error)."""
    df = _features(spark, sf)
    return normalize(df.select("page_id", "url", *URL_FEATURES, "error"))


def _one_feature(name):
    def fn(spark, sf):
        return normalize(_features(spark, sf).select("page_id", name))
    fn.__doc__ = f"URL feature {name}."
    return fn


for _i, _name in enumerate(URL_FEATURES, 1):
    add(f"q_U{_i:02d}_{_name}", _one_feature(_name),
        ou.url_features_query(id_cols="page_id", year=YEAR, only=[_name]), f"URL feature {_name}")


def _rules(spark, sf):
    staged, p, tmp = stage_parts(url_corpus(spark, sf), "url")
    return staged, url_rule_columns(p), tmp


_RULES_SQL = ou.rules_select(ou.parts_select(g.url_corpus_sql()))


@register("q_R2_brand_impersonation", f"SELECT page_id, r_brand AS brand FROM ({_RULES_SQL}) z")
def q_r2(spark, sf):
    """Impersonated brand per URL ('' when none)."""
    df, r, _ = _rules(spark, sf)
    return df.select("page_id", r.brand.alias("brand"))


@register("q_R3_R5_free_hosting",
          "SELECT page_id, r_hosting AS hosting, r_hosting_brand AS hosting_brand, "
          "CAST(coalesce(r_long_sub, FALSE) AS BIGINT) AS long_subdomain, "
          "CAST(coalesce(r_num_sub, FALSE) AS BIGINT) AS numeric_subdomain "
          f"FROM ({_RULES_SQL}) z")
def q_r3(spark, sf):
    """Free-hosting host, look-alike brand and subdomain flags."""
    df, r, _ = _rules(spark, sf)
    return df.select("page_id", r.hosting.alias("hosting"), r.hosting_brand.alias("hosting_brand"),
                     F.coalesce(r.long_subdomain, F.lit(False)).cast("bigint").alias("long_subdomain"),
                     F.coalesce(r.numeric_subdomain, F.lit(False)).cast("bigint").alias("numeric_subdomain"))


@register("q_R15_url_patterns",
          f"SELECT page_id, coalesce(array_to_string(_patterns, ' | '), '') AS patterns FROM ({_RULES_SQL}) z")
def q_r15(spark, sf):
    """Suspicious URL pattern messages (R6-R10), joined."""
    return sc.url_pattern_list(url_corpus(spark, sf)).select("page_id", joined(F.col("patterns")).alias("patterns"))


_SCORED_SQL = ou.scored_urls_select(g.url_corpus_sql())


@register("q_R17_score_urls",
          f"SELECT page_id, url, {g.r6('risk_score')} AS risk_score, risk_level, "
          "coalesce(array_to_string(risk_factors, ' | '), '') AS risk_factors, "
          f"CAST(len(risk_factors) AS BIGINT) AS n_factors FROM ({_SCORED_SQL}) z")
def q_r17(spark, sf):
    """Full rule-based URL analysis: score, level, ordered reasons."""
    s = sc.score_urls(url_corpus(spark, sf), "url")
    return s.select("page_id", "url", r6(F.col("risk_score")).alias("risk_score"), "risk_level",
                    joined(F.col("risk_factors")).alias("risk_factors"),
                    F.size("risk_factors").cast("bigint").alias("n_factors"))


@register("q_R14_level_counts",
          f"SELECT risk_level, count(*) AS n_urls, {g.r6('avg(risk_score)')} AS mean_score, "
          f"CAST(sum(label) AS BIGINT) AS n_phishing FROM ({_SCORED_SQL}) z GROUP BY risk_level")
def q_r14(spark, sf):
    """URLs per risk level with the mean score and planted phishing count."""
    s = sc.score_urls(url_corpus(spark, sf), "url")
    return s.groupBy("risk_level").agg(F.count("*").alias("n_urls"), r6(F.avg("risk_score")).alias("mean_score"),
                                       F.sum("label").cast("bigint").alias("n_phishing"))


@register("q_V7_batch_table",
          "SELECT page_id, CASE WHEN length(url) > 60 THEN concat(substring(url, 1, 60), '...') ELSE url END AS url_display, "
          "risk_level, printf('%.2f%%', risk_score * 100) AS risk_pct, CAST(len(risk_factors) AS BIGINT) AS issues "
          f"FROM ({_SCORED_SQL}) z")
def q_v7(spark, sf):
    """Batch result table: shortened URL, level, percent text, issue count."""
    return rp.batch_table(sc.score_urls(url_corpus(spark, sf), "url"), id_cols=["page_id"])


@register("q_V9_reason_severity",
          "SELECT page_id, CAST(pos AS BIGINT) AS pos, reason, "
          "CASE WHEN contains(upper(reason), '🚨') OR contains(upper(reason), 'CRITICAL') THEN 'HIGH' ELSE 'MEDIUM' END AS severity "
          "FROM (SELECT page_id, unnest(risk_factors) AS reason, unnest(generate_series(1, len(risk_factors))) AS pos "
          f"FROM ({_SCORED_SQL}) z) y")
def q_v9(spark, sf):
    """One row per reason with its number (from 1) and severity."""
    return rp.reason_severity(sc.score_urls(url_corpus(spark, sf), "url"), id_cols=["page_id"])


@register("q_V10_display_level",
          f"SELECT page_id, {g.level('risk_score', lx.DISPLAY_LEVELS)} AS display_level FROM ({_SCORED_SQL}) z")
def q_v10(spark, sf):
    """Display level by the configured thresholds .70/.45/.20."""
    s = sc.score_urls(url_corpus(spark, sf), "url")
    return s.select("page_id", rp.display_level(F.col("risk_score")).alias("display_level"))
