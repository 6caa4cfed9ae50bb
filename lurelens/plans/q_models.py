"""Registered model queries: blending (B), ensemble, Spark ML fits (T11-T19),
ROC AUC (V3).

Blending is checked against SQL with deterministic stand-in probabilities
derived from the row keys (they exercise both sides of every threshold).
Model fits get a rows-only check; they use few trees so the check stays
quick, the library defaults are the reference settings.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import blend as bl
from ..functions import lexicons as lx
from ..functions.manifest import ALL_FEATURES, URL_FEATURES
from ..operators import evaluate as ev
from ..operators import fitted as ft
from ..operators import models as md
from ..operators import scoring as sc
from ..operators import splits as sp
from ..operators import text_model as tm
from ..operators import tfidf as tf
from ..operators import tree_tables as tt
from ..sources.corpora import email_corpus, url_corpus
from . import oracle_email as oe
from . import oracle_url as ou
from . import sqlgen as g
from .registry import register
from .shape import joined, r6
from ..session import materialize, scratch_path


def stand_in(key: str, mult: int, null_every: int | None = None):
    """((key * mult) % 101) / 100: a deterministic probability in [0, 1]."""
    p = ((F.col(key) * mult) % 101) / F.lit(100.0)
    return F.when(F.col(key) % null_every == 0, F.lit(None)).otherwise(p) if null_every else p


def stand_in_sql(key: str, mult: int, null_every: int | None = None) -> str:
    p = f"(({key} * {mult}) % 101) / 100.0"
    return f"CASE WHEN {key} % {null_every} = 0 THEN NULL ELSE {p} END" if null_every else p


def pct1_sql(x: str) -> str:
    return f"printf('%.1f%%', ({x}) * 100.0)"


B = lx.BLEND


# ------------------------------------------------------------------ B2, B3

def _url_blend_sql():
    base = ou.rules_select(ou.parts_select(
        f"SELECT page_id, url, {stand_in_sql('page_id', 37, 7)} AS p_tab, {stand_in_sql('page_id', 53, 5)} AS p_text "
        f"FROM ({g.url_corpus_sql()}) c"))
    s1 = (f"CASE WHEN p_tab IS NULL THEN _score WHEN p_tab >= 0.5 THEN greatest(_score, p_tab * {g.dbl(B['url_tabular_up'])}) "
          f"ELSE least(_score, {g.dbl(B['url_tabular_cap_if_legit'])}) END")
    s2 = (f"CASE WHEN p_text IS NULL THEN _s1 WHEN p_text >= 0.5 THEN greatest(_s1, p_text * {g.dbl(B['url_text_up'])}) "
          f"ELSE _s1 * {g.dbl(B['url_text_down'])} END")
    r = (f"list_filter(_reasons || [CASE WHEN p_tab >= 0.5 THEN {g.fmt(lx.MSG['ml_phishing'], pct1_sql('p_tab'))} END, "
         f"CASE WHEN p_text IS NOT NULL THEN CASE WHEN p_text >= 0.5 THEN {g.fmt(lx.MSG['text_phishing'], pct1_sql('p_text'))} "
         f"ELSE {g.fmt(lx.MSG['text_legit'], pct1_sql('1.0 - p_text'))} END END], lambda x: x IS NOT NULL)[1:{lx.MAX_REASONS}]")
    step1 = f"SELECT *, {s1} AS _s1 FROM ({base}) a"
    step2 = f"SELECT *, least({s2}, 1.0) AS _fin, {r} AS _fr FROM ({step1}) b"
    return (f"SELECT page_id, {g.r6('_fin')} AS risk_score, {g.level('_fin', lx.URL_LEVELS)} AS risk_level, "
            "coalesce(array_to_string(_fr, ' | '), '') AS risk_factors, CAST((p_tab >= 0.5)::INT AS BIGINT) AS ml_prediction, "
            f"{g.r6('p_tab')} AS ml_confidence FROM ({step2}) c")


@register("q_B2_B3_url_blend", _url_blend_sql())
def q_b2(spark, sf):
    """URL rule score blended with a tabular and a text probability."""
    u = url_corpus(spark, sf).withColumns({"p_tab": stand_in("page_id", 37, 7), "p_text": stand_in("page_id", 53, 5)})
    s = sc.score_urls(u, "url", tabular_prob="p_tab", text_prob="p_text")
    return s.select("page_id", r6(F.col("risk_score")).alias("risk_score"), "risk_level",
                    joined(F.col("risk_factors")).alias("risk_factors"),
                    F.col("ml_prediction").cast("bigint"), r6(F.col("ml_confidence")).alias("ml_confidence"))


# ------------------------------------------------------------------ B4, B5

def _email_blend_sql():
    se = oe.scored_emails_select()
    src = (f"SELECT *, {stand_in_sql('email_id', 37, 7)} AS p_tab, {stand_in_sql('email_id', 53, 5)} AS p_text "
           f"FROM ({se}) z")
    s1 = (f"CASE WHEN p_tab IS NULL THEN _sum WHEN p_tab >= 0.5 THEN greatest(_sum, p_tab * {g.dbl(B['email_tabular_up'])}) "
          f"ELSE _sum * {g.dbl(B['email_tabular_down'])} END")
    s2 = (f"CASE WHEN p_text IS NULL THEN _s1 WHEN p_text >= 0.5 AND p_text > {g.dbl(B['email_text_strong'])} "
          f"THEN greatest(_s1, p_text * {g.dbl(B['email_text_up_strong'])}) "
          f"WHEN p_text >= 0.5 THEN greatest(_s1, p_text * {g.dbl(B['email_text_up_weak'])}) "
          f"ELSE _s1 * {g.dbl(B['email_text_down'])} END")
    rs = (f"list_filter(_rs || [CASE WHEN p_tab >= 0.5 THEN {g.fmt(lx.MSG['ml_phishing'], pct1_sql('p_tab'))} END, "
          f"CASE WHEN p_text IS NOT NULL THEN CASE WHEN p_text >= 0.5 THEN {g.fmt(lx.MSG['text_phishing'], pct1_sql('p_text'))} "
          f"ELSE {g.fmt(lx.MSG['text_legit'], pct1_sql('1.0 - p_text'))} END END], lambda x: x IS NOT NULL)")
    step1 = f"SELECT *, {s1} AS _s1 FROM ({src}) a"
    step2 = f"SELECT *, least({s2}, 1.0) AS _fin, {rs} AS _frs FROM ({step1}) b"
    lvl = g.level("_fin", lx.EMAIL_LEVELS)
    EW = lx.EMAIL_WEIGHTS
    head = (f"CASE WHEN ({lvl}) = 'SAFE' AND _fin < {g.dbl(EW['headline_safe_below'])} THEN {g.q(lx.MSG['head_safe'])} "
            f"WHEN ({lvl}) = 'HIGH' THEN {g.q(lx.MSG['head_high'])} WHEN ({lvl}) = 'MEDIUM' THEN {g.q(lx.MSG['head_medium'])} END")
    legit = f"[concat({g.q(lx.MSG['legit_prefix'])}, coalesce(_reason, {g.q(lx.MSG['legit_fallback'])}))]"
    factors = f"CASE WHEN _bypass THEN {legit} ELSE (list_filter([{head}], lambda x: x IS NOT NULL) || _frs)[1:{lx.MAX_REASONS}] END"
    return (f"SELECT email_id, {g.r6(f'CASE WHEN _bypass THEN {g.dbl(EW['legitimate_score'])} ELSE _fin END')} AS risk_score, "
            f"CASE WHEN _bypass THEN 'SAFE' ELSE {lvl} END AS risk_level, "
            f"coalesce(array_to_string({factors}, ' | '), '') AS risk_factors, "
            "CAST(CASE WHEN _bypass THEN 0 ELSE (p_tab >= 0.5)::INT END AS BIGINT) AS ml_prediction, "
            f"{g.r6('CASE WHEN _bypass THEN 0.0 ELSE p_tab END')} AS ml_confidence FROM ({step2}) c")


@register("q_B4_B5_email_blend", _email_blend_sql())
def q_b4(spark, sf):
    """Email rule score blended with a tabular and a text probability."""
    e = email_corpus(spark, sf).withColumns({"p_tab": stand_in("email_id", 37, 7), "p_text": stand_in("email_id", 53, 5)})
    s = sc.score_emails(e, tabular_prob="p_tab", text_prob="p_text")
    return s.select("email_id", r6(F.col("risk_score")).alias("risk_score"), "risk_level",
                    joined(F.col("risk_factors")).alias("risk_factors"),
                    F.col("ml_prediction").cast("bigint"), r6(F.col("ml_confidence")).alias("ml_confidence"))


# ------------------------------------------------------------------ B6

@register("q_B6_soft_vote",
          "SELECT page_id, " + g.r6("1.0 - p") + " AS p_legitimate, " + g.r6("p") + " AS p_phishing, "
          "CAST((p >= 0.5)::INT AS BIGINT) AS prediction FROM (SELECT page_id, "
          f"0.4 * pb + 0.3 * pf + CASE WHEN pt IS NULL THEN 0.0 ELSE 0.3 * pt END AS p FROM (SELECT page_id, "
          f"{stand_in_sql('page_id', 37)} AS pb, {stand_in_sql('page_id', 53)} AS pf, {stand_in_sql('page_id', 71, 3)} AS pt "
          f"FROM ({g.url_corpus_sql()}) c) s) t")
def q_b6(spark, sf):
    """Weighted soft vote of three model probabilities (text optional)."""
    u = url_corpus(spark, sf).select("page_id", stand_in("page_id", 37).alias("pb"), stand_in("page_id", 53).alias("pf"),
                                     stand_in("page_id", 71, 3).alias("pt"))
    p = bl.soft_vote(F.col("pb"), F.col("pf"), F.col("pt"))
    return u.select("page_id", r6(F.lit(1.0) - p).alias("p_legitimate"), r6(p).alias("p_phishing"),
                    (p >= 0.5).cast("bigint").alias("prediction"))


# ------------------------------------------------------------------ V3 exact

_M17 = oe.email_with_urls_query()
_AUC_SQL = (
    "SELECT " + g.r6("CASE WHEN n1 > 0 AND n0 > 0 THEN (rank_sum - n1 * (n1 + 1) / 2.0) / (n1 * n0) END") + " AS auc, "
    "CAST(n1 AS BIGINT) AS n_pos, CAST(n0 AS BIGINT) AS n_neg FROM (SELECT sum(pos * (before + (n + 1) / 2.0)) AS rank_sum, "
    "sum(pos) AS n1, sum(n) - sum(pos) AS n0 FROM (SELECT s, n, pos, coalesce(sum(n) OVER (ORDER BY s ROWS BETWEEN "
    "UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM (SELECT round(combined_risk_score * 1000000.0) / 1000000.0 AS s, "
    f"count(*) AS n, sum(label) AS pos FROM ({_M17}) m JOIN ({g.email_corpus_sql()}) c USING (email_id) GROUP BY 1) a) b) c")


@register("q_V3_auc_exact", _AUC_SQL)
def q_v3(spark, sf):
    """ROC AUC of the combined email+URL risk score (exact, tie-aware)."""
    from .q_email import m17
    s = m17(spark, sf).select(F.col("combined_risk_score").alias("score"), "label")
    return ev.exact_auc(s)


# ------------------------------------------------------------------ model fits (rows-only)

YEAR = 2024

#: Models fitted in this application, by data and kind (small driver objects):
#: the queries below share them, at the library's full settings.
_FITTED: dict = {}
FITTED_COLS = ("p_boosted", "p_forest", "p_text", "p_ensemble", "risk_score", "risk_level", "risk_factors",
               "ml_prediction", "ml_confidence")


def training_table(spark, sf, with_text: bool = False):
    """63-column feature table with label and stratified split.

    The feature table is computed once and written to the shared checkpoint
    folder (lineage cut): the split, the scaler, every tree level and the
    test scoring then read it instead of recomputing the text features."""
    feats = sc.feature_matrix(sc.combined_features(email_corpus(spark, sf), reference_year=YEAR))
    text = [F.concat_ws(" ", "subject", "body").alias("text")] if with_text else []
    feats = feats.select("email_id", F.col("label").cast("double").alias("label"), *text, *ALL_FEATURES)
    return sp.stratified_split(materialize(feats, "training-features"), "email_id")


def url_training_table(spark, sf):
    """The 40 URL features with label, text (the URL) and exact domain split."""
    d = sp.domain_split(url_corpus(spark, sf), exact=True)
    feats = sc.feature_matrix(sc.url_features(d, "url", YEAR), URL_FEATURES)
    return materialize(feats.select("page_id", F.col("label").cast("double").alias("label"), "split",
                                    F.col("url").alias("text"), *URL_FEATURES), "url-training-features")


def _sides(t):
    return t.where("split = 'train'"), t.where("split = 'test'")


def _fit(train, kind, features=ALL_FEATURES):
    """One fitted model; class weights (T14) are those of the training rows."""
    if kind == "text":
        return tm.fit(train.select("label", "text"))
    train = train.drop("text")                                    # a fit of trees keeps its rows in memory
    if kind == "boosted":
        return md.fit(md.tabular_pipeline(features, md.boosted_trees()), train)
    return md.fit(md.tabular_pipeline(features, md.random_forest()), sp.class_weights(train, "label"))


def fitted(spark, sf, train, kind, features=ALL_FEATURES):
    """The model of this kind for this data, fitted at its first use."""
    key = (spark.sparkContext.applicationId, sf, kind, len(features))
    if key not in _FITTED:
        _FITTED[key] = _fit(train, kind, features)
    return _FITTED[key]


def _fit_predict(spark, sf, kind):
    train, test = _sides(training_table(spark, sf))
    model = fitted(spark, sf, train, kind)
    return model, md.with_probability(model, test)


@register("q_T12_boosted_trees")
def q_t12(spark, sf):
    """Boosted trees on the 63 features: test-set probabilities and predictions."""
    _, pred = _fit_predict(spark, sf, "boosted")
    return pred.select("email_id", "label", r6(F.col("p")).alias("p"), "prediction")


@register("q_T13_random_forest")
def q_t13(spark, sf):
    """Random forest with balanced class weights: test-set predictions."""
    _, pred = _fit_predict(spark, sf, "forest")
    return pred.select("email_id", "label", r6(F.col("p")).alias("p"), "prediction")


def _t10_sql():
    from .registry import REGISTRY
    from . import q_prep  # noqa: F401  (its SQL is reused)
    return REGISTRY["q_T10_stratified_split"].sql


def _t11_sql():
    feats = (f"SELECT f.*, m.* EXCLUDE (email_id), s.split FROM ({oe.email_features_raw()}) f JOIN ({oe.url_means_query(YEAR, rounded=False)}) m "
             f"USING (email_id) JOIN ({_t10_sql()}) s USING (email_id)")
    stats = ", ".join(f"avg({c}) AS m_{c}, stddev_samp({c}) AS s_{c}" for c in ALL_FEATURES)
    scaled = ", ".join(g.r6(f"CASE WHEN s_{c} = 0 THEN 0.0 ELSE ({c} - m_{c}) / s_{c} END") + f" AS {c}" for c in ALL_FEATURES)
    return f"WITH f AS MATERIALIZED ({feats}) SELECT email_id, split, {scaled} FROM f, (SELECT {stats} FROM f WHERE split = 'train') t"


@register("q_T11_scaled_features", _t11_sql())
def q_t11(spark, sf):
    """Standard-scaled features (scaler fitted on train rows only)."""
    from pyspark.ml import Pipeline
    from pyspark.ml.feature import StandardScaler, VectorAssembler
    from pyspark.ml.functions import vector_to_array
    t = training_table(spark, sf)
    pipe = Pipeline(stages=[VectorAssembler(inputCols=list(ALL_FEATURES), outputCol="raw", handleInvalid="keep"),
                            StandardScaler(inputCol="raw", outputCol="scaled", withMean=True, withStd=True)])
    m = pipe.fit(t.where("split = 'train'"))
    v = m.transform(t).select("email_id", "split", vector_to_array("scaled").alias("v"))
    return v.select("email_id", "split", *[r6(F.col("v")[i]).alias(c) for i, c in enumerate(ALL_FEATURES)])


def _tables(spark, sf, train, kind):
    """The tree tables of a fitted model, written and read back."""
    path = scratch_path(spark, f"trees-{kind}")
    tt.write(fitted(spark, sf, train, kind), ALL_FEATURES, path)
    return tt.read(spark, path)


def _differs(a: str, b: str):
    """1 where two probabilities differ by more than 1e-9 (or one is missing)."""
    return F.when(F.abs(F.col(a) - F.col(b)) <= 1e-9, 0).otherwise(1).cast("bigint")


@register("q_T15_node_walk",
          f"SELECT email_id, label, 0::BIGINT AS boosted_differs, 0::BIGINT AS forest_differs FROM ({_t10_sql()}) s WHERE split = 'test'")
def q_t15(spark, sf):
    """Test rows whose probability by walking the node tables differs from the
    fitted model's (none may), for boosted trees and forest."""
    train, test = _sides(training_table(spark, sf))
    out = test
    for kind in ("boosted", "forest"):
        out = md.with_probability(fitted(spark, sf, train, kind), out, f"p_{kind}").drop("prediction")
        out = out.join(tt.probabilities(_tables(spark, sf, train, kind), test, "email_id", f"w_{kind}"), "email_id", "left")
    return out.select("email_id", F.col("label").cast("bigint").alias("label"),
                      *[_differs(f"p_{k}", f"w_{k}").alias(f"{k}_differs") for k in ("boosted", "forest")])


@register("q_T16_feature_importances")
def q_t16(spark, sf):
    """Boosted-tree feature importances by feature name: the model's, and those
    summed from its node table."""
    train, _ = _sides(training_table(spark, sf))
    own = tt.importances(_tables(spark, sf, train, "boosted")).withColumnRenamed("importance", "importance_of_nodes")
    return md.feature_importances(fitted(spark, sf, train, "boosted"), ALL_FEATURES).join(own, "feature", "left")


@register("q_T16_importances_of_nodes",
          "SELECT unnest([" + ", ".join(g.q(f) for f in ALL_FEATURES) + "]) AS feature, 0::BIGINT AS boosted_differs, 0::BIGINT AS forest_differs")
def q_t16_nodes(spark, sf):
    """Features whose importance summed from the node tables differs from the
    fitted model's (none may), for boosted trees and forest."""
    train, _ = _sides(training_table(spark, sf))
    out = None
    for kind in ("boosted", "forest"):
        own = tt.importances(_tables(spark, sf, train, kind)).withColumnRenamed("importance", "own")
        both = md.feature_importances(fitted(spark, sf, train, kind), ALL_FEATURES).join(own, "feature", "left")
        both = both.select("feature", _differs("importance", "own").alias(f"{kind}_differs"))
        out = both if out is None else out.join(both, "feature")
    return out


@register("q_T17_model_info")
def q_t17(spark, sf):
    """Model information as set, and as found in the node table."""
    train, _ = _sides(training_table(spark, sf))
    as_set = md.model_info(fitted(spark, sf, train, "boosted"), len(ALL_FEATURES))
    found = tt.info(_tables(spark, sf, train, "boosted")).select(
        F.col("n_trees").alias("trees_in_table"), F.col("depth").alias("depth_in_table"), "n_features_used", "n_splits", "n_leaves")
    return as_set.join(found)


# ------------------------------------------------------------------ T18, T19

_TEXT_SQL = f"SELECT email_id, label, lower(concat_ws(' ', subject, body)) AS _t FROM ({g.email_corpus_sql()}) e"
_STOP_SQL = ", ".join(g.q(w) for w in lx.STOP_WORDS)
_TF_SQL = (f"SELECT email_id, term, count(*) AS tf FROM (SELECT email_id, unnest(regexp_extract_all(_t, '[\\p{{L}}\\p{{N}}_]{{2,}}')) AS term "
           f"FROM ({_TEXT_SQL}) t) x WHERE term NOT IN ({_STOP_SQL}) GROUP BY ALL")
_VOCAB_SQL = ("SELECT term, CAST(sum(tf) AS BIGINT) AS n, count(*) AS n_docs, ln((1 + (SELECT count(*) FROM documents)) / (1.0 + count(*))) + 1 AS idf "
              "FROM tf GROUP BY term ORDER BY n DESC, term LIMIT 100")


def _mail_texts(spark, sf):
    e = email_corpus(spark, sf)
    return e.select("email_id", "label", F.concat_ws(" ", "subject", "body").alias("text"))


@register("q_T18_tfidf_terms", f"WITH tf AS MATERIALIZED ({_TF_SQL}) SELECT term, n, n_docs, {g.r6('idf')} AS idf FROM ({_VOCAB_SQL}) v")
def q_t18_terms(spark, sf):
    """The 100 most frequent terms of all mails, with document counts and idf."""
    model = tf.fit(_mail_texts(spark, sf), F.col("text"))
    return tf.vocabulary(spark, model).withColumn("idf", r6(F.col("idf")))


@register("q_T18_tfidf_features",
          f"WITH tf AS MATERIALIZED ({_TF_SQL}) SELECT email_id, term, {g.r6('w / sqrt(sum(w * w) OVER (PARTITION BY email_id))')} AS weight "
          f"FROM (SELECT email_id, term, tf * idf AS w FROM tf JOIN ({_VOCAB_SQL}) v USING (term)) x")
def q_t18(spark, sf):
    """TF-IDF over the 100 terms, scaled to length 1: a row per weight above 0."""
    t = materialize(_mail_texts(spark, sf), "mail-texts")
    model = tf.fit(t, F.col("text"))
    rows = tf.transform(t, model, F.col("text")).select("email_id", F.posexplode("tfidf").alias("i", "w")).filter("w > 0")
    return rows.select("email_id", F.get(F.array(*[F.lit(x) for x in model.terms]), F.col("i")).alias("term"), r6(F.col("w")).alias("weight"))


_BUCKET_SQL = (f"SELECT DISTINCT email_id, label, ('0x' || substr(md5(term), 1, 8))::BIGINT % {tm.BUCKETS} AS bucket FROM "
               "(SELECT email_id, label, unnest(w || list_transform(generate_series(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1])) AS term "
               f"FROM (SELECT email_id, t.label, regexp_extract_all(_t, '[\\p{{L}}\\p{{N}}_]+') AS w FROM ({_TEXT_SQL}) t "
               f"JOIN ({_t10_sql()}) s USING (email_id) WHERE split = 'train') x) y")
_LOG_SHARE = "ln((n1 + 1.0) / (d1 + 2.0)) - ln((n0 + 1.0) / (d0 + 2.0))"


@register("q_T19_term_weights",
          f"SELECT bucket, n1, n0, {g.r6('ratio')} AS ratio, {g.r6('CASE WHEN abs(ratio) >= 1.96::DOUBLE * sqrt(1 / (n1 + 1) + 1 / (n0 + 1)) THEN ratio ELSE 0.0 END')} "
          f"AS weight FROM (SELECT bucket, n1, n0, {_LOG_SHARE} AS ratio FROM "
          f"(SELECT bucket, CAST(sum(label) AS BIGINT) AS n1, CAST(sum(1 - label) AS BIGINT) AS n0 FROM ({_BUCKET_SQL}) b GROUP BY bucket) n, (SELECT sum(label) AS d1, sum(1 - label) AS d0 "
          f"FROM ({_t10_sql()}) s WHERE split = 'train') d) r")
def q_t19_weights(spark, sf):
    """Class counts, log-count ratio and weight of every bucket of terms of the train rows."""
    t = materialize(_mail_texts(spark, sf), "mail-texts")
    train, _ = _sides(sp.stratified_split(t, "email_id"))
    return tm.weights(train).select("bucket", "n1", "n0", r6(F.col("ratio")).alias("ratio"), r6(F.col("weight")).alias("weight"))


@register("q_T19_text_classifier")
def q_t19(spark, sf):
    """Text model over subject + body: test-set probabilities."""
    e = email_corpus(spark, sf).select("email_id", F.col("label").cast("double").alias("label"),
                                       F.concat_ws(" ", "subject", "body").alias("text"))
    train, test = _sides(sp.stratified_split(materialize(e, "training-texts"), "email_id"))
    model = fitted(spark, sf, train, "text")
    return md.with_probability(model, test).select("email_id", "label", r6(F.col("p")).alias("p"), "prediction")


@register("q_B7_individual_predictions")
def q_b7(spark, sf):
    """Boosted, forest, text and ensemble predictions side by side on the test rows."""
    train, test = _sides(training_table(spark, sf, with_text=True))
    models = ft.Models(*[fitted(spark, sf, train, kind) for kind in ("boosted", "forest", "text")])
    p = ft.with_probabilities(test, models).withColumn("p", ft.vote(models, with_text=True))
    return p.select("email_id", "label", bl.prediction(F.col("p_boosted")).alias("boosted"),
                    bl.prediction(F.col("p_forest")).alias("forest"), bl.prediction(F.col("p_text")).alias("text"),
                    r6(F.col("p")).alias("p_ensemble"), bl.prediction(F.col("p")).alias("ensemble"))


@register("q_B7_votes_from_tables",
          f"SELECT email_id, label, 0::BIGINT AS boosted_differs, 0::BIGINT AS forest_differs, 0::BIGINT AS ensemble_differs FROM ({_t10_sql()}) s "
          "WHERE split = 'test'")
def q_b7_tables(spark, sf):
    """Test rows whose predictions side by side differ from those that the node
    tables and the weights 0.4, 0.3, 0.3 give (none may)."""
    train, test = _sides(training_table(spark, sf, with_text=True))
    models = ft.Models(*[fitted(spark, sf, train, kind) for kind in ("boosted", "forest", "text")])
    p = ft.with_probabilities(test, models).withColumn("p", ft.vote(models, with_text=True))
    for kind in ("boosted", "forest"):
        p = p.join(tt.probabilities(_tables(spark, sf, train, kind), test, "email_id", f"w_{kind}"), "email_id", "left")
    p = p.withColumn("w", F.col("w_boosted") * 0.4 + F.col("w_forest") * 0.3 + F.col("p_text") * 0.3)
    differs = lambda a, b: (bl.prediction(F.col(a)) != bl.prediction(F.col(b))).cast("bigint")
    return p.select("email_id", F.col("label").cast("bigint").alias("label"), differs("p_boosted", "w_boosted").alias("boosted_differs"),
                    differs("p_forest", "w_forest").alias("forest_differs"), differs("p", "w").alias("ensemble_differs"))


@register("q_B2_fitted_url_scores")
def q_b2_fitted(spark, sf):
    """Every corpus URL scored with three models fitted on the train domains."""
    train, _ = _sides(url_training_table(spark, sf))
    models = ft.Models(*[fitted(spark, sf, train, kind, URL_FEATURES) for kind in ("boosted", "forest", "text")])
    s = ft.score_urls(url_corpus(spark, sf), models, "url", YEAR)
    return s.select("page_id", *FITTED_COLS)


@register("q_B4_fitted_email_scores")
def q_b4_fitted(spark, sf):
    """Every corpus mail scored with three models fitted on the train rows."""
    train, _ = _sides(training_table(spark, sf, with_text=True))
    models = ft.Models(*[fitted(spark, sf, train, kind) for kind in ("boosted", "forest", "text")])
    s = ft.score_emails(email_corpus(spark, sf), models, YEAR)
    return s.select("email_id", *FITTED_COLS)


@register("q_T12_url_boosted_trees")
def q_t12_url(spark, sf):
    """Boosted trees on the 40 URL features: probabilities on the test domains."""
    train, test = _sides(url_training_table(spark, sf))
    pred = md.with_probability(fitted(spark, sf, train, "boosted", URL_FEATURES), test)
    return pred.select("page_id", "label", r6(F.col("p")).alias("p"), "prediction")


@register("q_V2_url_model_metrics")
def q_v2_url(spark, sf):
    """Accuracy, precision, recall, F1 of both URL tree models on the test domains."""
    train, test = _sides(url_training_table(spark, sf))
    pb, pf = [md.with_probability(fitted(spark, sf, train, kind, URL_FEATURES), test) for kind in ("boosted", "forest")]
    return ev.binary_metrics(pb, "xgboost_url").unionByName(ev.binary_metrics(pf, "random_forest_url"))


@register("q_V3_auc_evaluator")
def q_v3e(spark, sf):
    """ROC AUC of the boosted-tree test predictions (evaluator form)."""
    train, test = _sides(training_table(spark, sf))
    model = fitted(spark, sf, train, "boosted")
    scored = model.transform(test)
    return spark.createDataFrame([(float(md.auc(scored)),)], "auc double")


@register("q_V2_model_metrics")
def q_v2m(spark, sf):
    """Accuracy, precision, recall, F1 of both tree models on the test rows."""
    train, test = _sides(training_table(spark, sf))
    pb, pf = [md.with_probability(fitted(spark, sf, train, kind), test) for kind in ("boosted", "forest")]
    return ev.binary_metrics(pb, "xgboost_email").unionByName(ev.binary_metrics(pf, "random_forest_email"))
