"""More registered queries: error rows (R1/R16), nested URL analyses (M18),
reporting rows (V8, V11-V13), D8/D13 and source round trips (S3, S4, S11)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.manifest import ALL_FEATURES, URL_FEATURES
from ..operators import models as md
from ..operators import prep as pp
from ..operators import reporting as rp
from ..operators import scoring as sc
from ..session import scratch_path
from ..sources import io
from ..sources.corpora import email_corpus, read_table, url_corpus
from . import oracle_email as oe
from . import q_url, q_models  # noqa: F401  (their SQL is reused)
from . import oracle_url as ou
from . import sqlgen as g
from .registry import REGISTRY, register
from .shape import joined, r6

# ------------------------------------------------------------------ R1 / R16 / U43


def error_corpus(spark, sf):
    """The URL corpus with planted bad inputs: NULL, '', and for some pages hosts
    with an unbalanced '[', brackets around no address and around an IPv6 address,
    and a character that stands for "a/c" (every row kept)."""
    u = url_corpus(spark, sf)
    k = F.col("page_id") % 50
    bad = (F.when(k == 0, F.lit(None).cast("string")).when(k == 1, F.lit(""))
           .when(k == 2, F.regexp_replace("url", "://", "://["))
           .when(k == 3, F.regexp_replace("url", "://", "://[abc]"))
           .when(k == 4, F.regexp_replace("url", "://", "://[fe80::1]:"))
           .when(k == 5, F.regexp_replace("url", "://", "://x℀y.")).otherwise(F.col("url")))
    return u.withColumn("url", bad)


_ERR_SQL = ("SELECT page_id, label, CASE WHEN page_id % 50 = 0 THEN NULL WHEN page_id % 50 = 1 THEN '' "
            "WHEN page_id % 50 = 2 THEN replace(url, '://', '://[') "
            "WHEN page_id % 50 = 3 THEN replace(url, '://', '://[abc]') "
            "WHEN page_id % 50 = 4 THEN replace(url, '://', '://[fe80::1]:') "
            "WHEN page_id % 50 = 5 THEN replace(url, '://', '://x℀y.') ELSE url END AS url "
            f"FROM ({g.url_corpus_sql()}) u")


@register("q_R16_batch_with_errors",
          f"SELECT page_id, {g.r6('risk_score')} AS risk_score, risk_level, "
          "coalesce(array_to_string(risk_factors, ' | '), '') AS risk_factors "
          f"FROM ({ou.scored_urls_select(_ERR_SQL)}) z")
def q_r16(spark, sf):
    """Batch scoring where bad URLs become ERROR rows and the batch goes on."""
    s = sc.score_urls(error_corpus(spark, sf))
    return s.select("page_id", r6(F.col("risk_score")).alias("risk_score"), "risk_level",
                    joined(F.col("risk_factors")).alias("risk_factors"))


# ------------------------------------------------------------------ M18, V11

def _m17_urls(spark, sf):
    from .q_email import m17
    return m17(spark, sf).select("email_id", F.posexplode_outer("url_analyses").alias("pos0", "a")).where(
        F.col("a").isNotNull())


_M17_URLS_SQL = ou.scored_urls_select(
    f"SELECT email_id, unnest({oe.public_urls_expr('_text')}) AS url FROM ({oe.email_base()}) e")


@register("q_M18_url_analyses",
          f"SELECT email_id, url, {g.r6('risk_score')} AS risk_score, risk_level, "
          "CAST(len(risk_factors) AS BIGINT) AS n_reasons FROM (" + _M17_URLS_SQL + ") z")
def q_m18(spark, sf):
    """One row per URL found in an email, with its own analysis (nested output)."""
    x = _m17_urls(spark, sf)
    return x.select("email_id", F.col("a.url").alias("url"), r6(F.col("a.risk_score")).alias("risk_score"),
                    F.col("a.risk_level").alias("risk_level"), F.size("a.risk_factors").cast("bigint").alias("n_reasons"))


@register("q_V11_top_url_reasons",
          "SELECT email_id, url, coalesce(array_to_string(risk_factors[1:3], ' | '), '') AS top_reasons "
          "FROM (" + _M17_URLS_SQL + ") z")
def q_v11(spark, sf):
    """The first three reasons of each embedded URL."""
    from .q_email import m17
    s = m17(spark, sf).select("email_id", rp.first_reasons(F.col("url_analyses")).alias("t"))
    x = s.select("email_id", F.explode_outer("t").alias("a")).where(F.col("a").isNotNull())
    return x.select("email_id", F.col("a.url").alias("url"), joined(F.col("a.top_factors")).alias("top_reasons"))


# ------------------------------------------------------------------ V8, V12, V13

@register("q_V8_feature_rows",
          "SELECT page_id, feature, " + g.r6("value") + " AS value FROM (SELECT page_id, "
          + ", ".join(f"CAST({n} AS DOUBLE) AS {n}" for n in URL_FEATURES)
          + f" FROM ({ou.url_features_query(year=2024)}) f) w UNPIVOT (value FOR feature IN ({', '.join(URL_FEATURES)}))")
def q_v8(spark, sf):
    """(feature, value) rows of every URL analysis."""
    f = sc.url_features(url_corpus(spark, sf), "url", 2024)
    return rp.feature_rows(f, ["page_id"], URL_FEATURES).select("page_id", "feature", r6(F.col("value")).alias("value"))


@register("q_V12_ml_status",
          "SELECT page_id, CASE WHEN ml_prediction = 1 THEN 'Phishing' WHEN ml_prediction IS NOT NULL THEN 'Legitimate' "
          f"ELSE 'N/A' END AS ml_status FROM ({REGISTRY['q_B2_B3_url_blend'].sql}) z")
def q_v12(spark, sf):
    """ML status text per scored URL: Phishing / Legitimate / N/A."""
    from .q_models import q_b2
    return q_b2(spark, sf).select("page_id", rp.ml_status(F.col("ml_prediction")).alias("ml_status"))


@register("q_V13_model_labels",
          "SELECT model, concat(upper(split_part(model, '_', 1)), CASE WHEN contains(model, 'url') THEN ' (URL)' "
          f"ELSE ' (Email)' END) AS display_name FROM ({REGISTRY['q_V5_metrics_table'].sql}) z")
def q_v13(spark, sf):
    """Display name of each evaluated model with its (URL)/(Email) suffix."""
    from .q_email import q_v5
    m = q_v5(spark, sf)
    return m.select("model", rp.model_label(F.upper(F.split_part("model", F.lit("_"), F.lit(1))), F.col("model"))
                    .alias("display_name"))


# ------------------------------------------------------------------ D8, D13

@register("q_D8_fill_email_columns",
          "SELECT doc_id, '' AS subject, text AS body, CASE WHEN doc_id % 2 = 0 THEN concat('u', CAST(doc_id AS VARCHAR), "
          "'@example.org') ELSE NULL END AS sender, CAST(doc_id % 3 AS INTEGER) AS num_attachments FROM documents")
def q_d8(spark, sf):
    """Email rows from other column names (body_plain, from_address, has_attachments)."""
    d = read_table(spark, sf, "documents").select(
        "doc_id", F.col("text").alias("body_plain"),
        F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit("u"), F.col("doc_id").cast("string"), F.lit("@example.org")))
        .alias("from_address"), (F.col("doc_id") % 3).cast("int").alias("has_attachments"))
    f = pp.fill_email_columns(d)
    return f.select("doc_id", "subject", "body", "sender", "num_attachments")


@register("q_D13_float_matrix",
          f"SELECT email_id, {', '.join(f'CAST({c} AS FLOAT) AS {c}' for c in ALL_FEATURES)} FROM ("
          f"SELECT f.*, {', '.join('m.' + c for c in [f'url_{n}' for n in URL_FEATURES] + ['total_urls_in_email', 'suspicious_url_count'])} "
          f"FROM ({oe.email_features_query()}) f JOIN ({oe.url_means_query(2024)}) m ON f.email_id = m.email_id) j")
def q_d13(spark, sf):
    """The 63-column feature matrix in single precision."""
    from .shape import normalize
    df = normalize(sc.feature_matrix(sc.combined_features(email_corpus(spark, sf), reference_year=2024))
                   .select("email_id", *ALL_FEATURES))
    return pp.as_float_matrix(df, ALL_FEATURES, keep=["email_id"])


# ------------------------------------------------------------------ S3, S4, S11

@register("q_S3_raw_url_csv", f"SELECT url, CAST(label AS INTEGER) AS label FROM ({g.url_corpus_sql()}) u "
          "WHERE url IS NOT NULL AND length(url) >= 5")
def q_s3(spark, sf):
    """Raw URL CSV (url, label) written and read back through the raw loader."""
    path = scratch_path(spark, "raw-url-csv")
    io.write_csv(url_corpus(spark, sf).select("url", "label"), path)
    return io.load_raw_url_dataset(spark, path, schema="url string, label int").select("url", F.col("label").cast("int"))


@register("q_S4_schema_peek",
          f"SELECT page_id, variant, url, CAST(label AS BIGINT) AS label FROM ({g.url_corpus_sql()}) u ORDER BY page_id LIMIT 5")
def q_s4(spark, sf):
    """First five rows of a CSV of several files written in order (a preview; the
    limit is the feature)."""
    path = scratch_path(spark, "peek-csv")
    io.write_csv(url_corpus(spark, sf).repartitionByRange(4, "page_id").sortWithinPartitions("page_id"), path)
    df, cols = io.peek_schema(spark, path)
    return df.select(*[F.col(c) if c == "url" else F.col(c).cast("bigint") for c in cols])


@register("q_S11_model_roundtrip",
          f"SELECT email_id, label, 0::BIGINT AS pipeline_differs, 0::BIGINT AS tables_differ FROM ({REGISTRY['q_T10_stratified_split'].sql}) s "
          "WHERE split = 'test'")
def q_s11(spark, sf):
    """Fitted pipeline (scaler + trees) saved and loaded, as a pipeline and as
    tables: test rows whose probability differs from the fitted model's."""
    from ..operators import tree_tables as tt
    from .q_models import _differs, fitted, training_table
    t = training_table(spark, sf)
    train, test = t.where("split = 'train'"), t.where("split = 'test'")
    model = fitted(spark, sf, train, "boosted")
    path = scratch_path(spark, "model")
    md.save(model, path + "/pipeline")
    tt.write(model, ALL_FEATURES, path + "/tables")
    out = test
    for name, m in (("fitted", model), ("loaded", md.load(path + "/pipeline"))):
        out = md.with_probability(m, out, name).drop("prediction")
    out = out.join(tt.probabilities(tt.read(spark, path + "/tables"), test, "email_id", "walked"), "email_id", "left")
    return out.select("email_id", F.col("label").cast("bigint").alias("label"), _differs("fitted", "loaded").alias("pipeline_differs"),
                      _differs("fitted", "walked").alias("tables_differ"))


# ------------------------------------------------------------------ S2

#: Feature columns that the loader keeps by name, and those that it drops as named like leaks.
_S2_COLS = [c for c in URL_FEATURES if c not in ("url_length", "num_subdomains", "url_entropy", "digit_url_ratio", "has_excessive_subdomains",
                                                 "url_complexity")]
_S2_LEAKS = ("is_common_tld", "homograph_score")


def _s2_sql():
    cand, by_name = _S2_COLS, _S2_LEAKS
    f = ou.feature_exprs("url", 2024)
    raw = (f"SELECT page_id, CAST(label AS BIGINT) AS label_numeric, "
           + ", ".join(f"CAST({f[n]} AS DOUBLE) AS {n}" for n in cand)
           + f" FROM ({ou.parts_select(g.url_corpus_sql())}) p")
    long = f"SELECT * FROM ({raw}) r UNPIVOT (value FOR feature IN ({', '.join(cand)}))"
    sep = ("SELECT feature FROM (SELECT feature, value, max((label_numeric = 0)::INT) AS in0, "
           f"max((label_numeric = 1)::INT) AS in1 FROM ({long}) l WHERE value IS NOT NULL GROUP BY feature, value) v "
           "GROUP BY feature HAVING sum(in0) > 0 AND sum(in1) > 0 AND sum(in0 * in1) = 0")
    names = ", ".join(g.q(n) for n in by_name) or "NULL"
    return (f"SELECT page_id, label_numeric, feature, {g.r6('value')} AS value FROM ({long}) l "
            f"WHERE feature NOT IN ({sep}) AND feature NOT IN ({names})")


@register("q_S2_url_feature_csv", _s2_sql())
def q_s2(spark, sf):
    """Pre-computed URL feature CSV: label and URL columns found by name,
    numeric features chosen by name, labels normalised, leaking features
    (perfect separation or leak-like name) dropped; one row per kept value."""
    feats = sc.url_features(url_corpus(spark, sf), "url", 2024).select("page_id", "url", *URL_FEATURES, "label")
    path = scratch_path(spark, "url-feature-csv")
    io.write_csv(feats, path)
    schema = "page_id long, url string, " + ", ".join(f"{n} double" for n in URL_FEATURES) + ", label int"
    df, kept = io.load_url_feature_dataset(spark, path, schema=schema)
    long = df.select(F.col("page_id").cast("bigint"), F.col("label_numeric").cast("bigint"),
                     *[F.col(c).cast("double") for c in kept]).unpivot(
        ["page_id", "label_numeric"], kept, "feature", "value")
    return long.select("page_id", "label_numeric", "feature", r6(F.col("value")).alias("value"))
