"""Registered training-data preparation queries (D, L, T1-T10, T14)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import labels as lb
from ..functions import lexicons as lx
from ..functions.manifest import ALL_FEATURES, EMAIL_FEATURES
from ..operators import leakage as lk
from ..operators import prep as pp
from ..operators import scoring as sc
from ..operators import splits as sp
from ..sources.corpora import email_corpus, read_table, url_corpus
from . import oracle_email as oe
from . import oracle_url as ou
from . import sqlgen as g
from .registry import register
from .shape import normalize, r6

# FIXED VALUES of the planted label corpus: raw label text by doc_id % 24
# (covers both vocabularies, case/blank variants, numbers, unknown, NULL).
RAW_LABELS = (" Phishing", "benign", "LEGITIMATE", "spam", "1", "0", "1.0", "malware", "good", "unknown", None,
              "ham", "yes", "no", "defacement", "nan", "Fraud ", "2.7", "true", "false", "phish", "bad", "safe",
              "normal")


def labelled_docs(spark, sf):
    d = F.col("doc_id") % len(RAW_LABELS)
    expr = None
    for i, v in enumerate(RAW_LABELS):
        val = F.lit(v).cast("string")
        expr = F.when(d == i, val) if expr is None else expr.when(d == i, val)
    return read_table(spark, sf, "documents").select("doc_id", expr.alias("raw_label"))


def _labelled_sql() -> str:
    cases = " ".join(f"WHEN {i} THEN {'NULL' if v is None else g.q(v)}" for i, v in enumerate(RAW_LABELS))
    return f"SELECT doc_id, CASE doc_id % {len(RAW_LABELS)} {cases} END AS raw_label FROM documents"


_LS = _labelled_sql()
_NUM = ("coalesce(CASE WHEN isfinite(TRY_CAST({s} AS DOUBLE)) THEN CAST(trunc(TRY_CAST({s} AS DOUBLE)) AS BIGINT) END, 0)")


def _word_sql(ones, zeros, first_one=True):
    s = "lower(trim(raw_label))"
    a, b = (ones, zeros)
    return (f"CASE WHEN {s} IN ({', '.join(g.q(x) for x in a)}) THEN {1 if first_one else 0} "
            f"WHEN {s} IN ({', '.join(g.q(x) for x in b)}) THEN {0 if first_one else 1} ELSE {_NUM.format(s=s)} END")


_L1 = _word_sql(lx.URL_BENIGN_LABELS, lx.URL_MALICIOUS_LABELS, first_one=False)
_L3 = _word_sql(lx.EMAIL_PHISHING_LABELS, lx.EMAIL_LEGIT_LABELS, first_one=True)


@register("q_L1_url_labels", f"SELECT doc_id, raw_label, CAST({_L1} AS BIGINT) AS label FROM ({_LS}) t")
def q_l1(spark, sf):
    """URL label text -> 0/1 (benign / malicious words, else number, else 0)."""
    d = labelled_docs(spark, sf)
    return d.select("doc_id", "raw_label", lb.url_binary_label(F.col("raw_label")).cast("bigint").alias("label"))


@register("q_L3_email_labels", f"SELECT doc_id, raw_label, CAST({_L3} AS BIGINT) AS label FROM ({_LS}) t")
def q_l3(spark, sf):
    """Email label text -> 0/1 (phishing / legitimate words, else number, else 0)."""
    d = labelled_docs(spark, sf)
    return d.select("doc_id", "raw_label", lb.email_label(F.col("raw_label")).cast("bigint").alias("label"))


@register("q_L4_raw_url_labels",
          f"SELECT doc_id, CAST(coalesce(lower(raw_label) IN ({', '.join(g.q(x) for x in lx.RAW_URL_PHISHING_LABELS)}), FALSE) AS BIGINT) "
          f"AS label FROM ({_LS}) t")
def q_l4(spark, sf):
    """Raw URL loader labels: 6 words -> 1, else 0 (lower-cased, not trimmed)."""
    d = labelled_docs(spark, sf)
    return d.select("doc_id", lb.raw_url_label(F.col("raw_label"), numeric=False).cast("bigint").alias("label"))


@register("q_L5_strict_labels",
          f"SELECT doc_id, CAST(CASE WHEN coalesce(lower(trim(raw_label)) IN ({', '.join(g.q(x) for x in lx.URL_BENIGN_LABELS)}), FALSE) "
          f"THEN 0 ELSE 1 END AS BIGINT) AS label FROM ({_LS}) t")
def q_l5(spark, sf):
    """Strict binary labels of the domain split: benign words -> 0, else 1."""
    d = labelled_docs(spark, sf)
    return d.select("doc_id", lb.strict_binary_label(F.col("raw_label")).cast("bigint").alias("label"))


@register("q_L2_label_index",
          "SELECT raw_label, CAST(row_number() OVER (ORDER BY first_doc) - 1 AS BIGINT) AS label_index "
          f"FROM (SELECT raw_label, min(doc_id) AS first_doc FROM ({_LS}) t GROUP BY raw_label) f")
def q_l2(spark, sf):
    """Multi-class index of each label by first appearance (document order)."""
    return pp.label_index_table(labelled_docs(spark, sf), "raw_label", "doc_id")


@register("q_L6_label_mapping", f"SELECT DISTINCT raw_label AS original_label, CAST({_L3} AS BIGINT) AS label FROM ({_LS}) t")
def q_l6(spark, sf):
    """Distinct original label -> normalised email label."""
    d = labelled_docs(spark, sf).withColumn("label", lb.email_label(F.col("raw_label")).cast("bigint"))
    return pp.label_mapping(d, "raw_label", "label")


@register("q_L7_class_distribution",
          f"SELECT label, count(*) AS n, {g.r6('count(*) * 100.0 / sum(count(*)) OVER ()')} AS percent "
          f"FROM (SELECT CAST({_L3} AS BIGINT) AS label FROM ({_LS}) t) x GROUP BY label")
def q_l7(spark, sf):
    """Rows and percent per normalised class."""
    d = labelled_docs(spark, sf).select(lb.email_label(F.col("raw_label")).cast("bigint").alias("label"))
    return pp.class_distribution(d).withColumn("percent", r6(F.col("percent")))


@register("q_L8_class_guard",
          "SELECT CAST(count(DISTINCT label) AS BIGINT) AS n_classes, "
          "CAST(max((label = 0)::INT) * max((label = 1)::INT) AS BIGINT) AS both_classes "
          f"FROM (SELECT CAST({_L3} AS BIGINT) AS label FROM ({_LS}) t) x")
def q_l8(spark, sf):
    """Guard before training: classes present."""
    d = labelled_docs(spark, sf).select(lb.email_label(F.col("raw_label")).cast("bigint").alias("label"))
    return pp.class_guard(d)


_WORDS = lx.EMAIL_PHISHING_LABELS + lx.EMAIL_LEGIT_LABELS


@register("q_L9_unknown_labels",
          "SELECT raw_label, CAST(count(*) AS BIGINT) AS n, CAST(0 AS BIGINT) AS fallback_label FROM "
          f"({_LS}) t WHERE NOT coalesce(lower(trim(raw_label)) IN ({', '.join(g.q(x) for x in _WORDS)}), FALSE) "
          "AND NOT coalesce(isfinite(TRY_CAST(lower(trim(raw_label)) AS DOUBLE)), FALSE) GROUP BY raw_label")
def q_l9(spark, sf):
    """Label values that matched no rule (counted, mapped to 0)."""
    return pp.unknown_labels(labelled_docs(spark, sf), "raw_label")


# ------------------------------------------------------------------ D rows

@register("q_D10_email_rows",
          "SELECT email_id, coalesce(subject, '') AS subject, concat(coalesce(subject, ''), ' ', coalesce(body, '')) AS body, "
          f"{g.q(lx.DEFAULT_SENDER)} AS sender, CAST(label AS BIGINT) AS label FROM ({g.email_corpus_sql()}) e")
def q_d10(spark, sf):
    """Discovered subject/body/label columns shaped into email rows."""
    e = email_corpus(spark, sf).select("email_id", "subject", "body", "label")
    c = pp.conform_email_table(e, keep=["email_id"])
    return c.select("email_id", "subject", "body", "sender", F.col("label").cast("bigint").alias("label"))


@register("q_D11_valid_urls", f"SELECT page_id, url FROM ({g.url_corpus_sql()}) u WHERE url IS NOT NULL AND length(url) >= 5")
def q_d11(spark, sf):
    """URLs kept for training (present, >= 5 characters)."""
    return pp.drop_short_urls(url_corpus(spark, sf), "url").select("page_id", "url")


_C7_SQL = (f"SELECT f.*, {', '.join('m.' + c for c in [f'url_{n}' for n in ou.URL_FEATURES] + ['total_urls_in_email', 'suspicious_url_count'])} "
           f"FROM ({oe.email_features_query()}) f JOIN ({oe.url_means_query(2024)}) m ON f.email_id = m.email_id")
_KEPT = [c for c in ALL_FEATURES if c != "spf_result_match"]


@register("q_D12_drop_leak_columns", f"SELECT email_id, {', '.join(_KEPT)} FROM ({_C7_SQL}) j")
def q_d12(spark, sf):
    """Feature matrix without columns named like leaks (spf_result_match goes)."""
    df = normalize(sc.combined_features(email_corpus(spark, sf), reference_year=2024).select("email_id", *ALL_FEATURES))
    return pp.drop_leak_columns(df, keep=["email_id"])


#: The features whose names hold none of url, link, id and the like.
_D6_COLS = [c for c in ALL_FEATURES if c not in ("num_urls", "num_links", "total_urls_in_email", "suspicious_url_count")
            and c not in {f"url_{n}" for n in ou.URL_FEATURES}]


@register("q_D6_numeric_features", f"SELECT email_id, label, {', '.join(_D6_COLS)} FROM ({_C7_SQL}) j "
          f"JOIN (SELECT email_id, CAST(label AS BIGINT) AS label FROM ({g.email_corpus_sql()}) c) l USING (email_id)")
def q_d6(spark, sf):
    """Numeric feature columns chosen by type and name (url/link/id... excluded)."""
    df = normalize(sc.combined_features(email_corpus(spark, sf), reference_year=2024).select("email_id", "label", *ALL_FEATURES))
    cols = pp.numeric_feature_columns(df.drop("email_id").schema, "label")
    return df.select("email_id", "label", *cols)


_D7_EXTRA = {"row_index": "page_id", "Unnamed: 0": "page_id", "date_inspection": "page_id", "domain_age": "page_id", "kind_type": "page_id",
             "grade": "page_id % 7"}
_D7_COLS = [c for c in ou.URL_FEATURES if c not in ("url_length", "num_subdomains", "url_entropy", "digit_url_ratio", "has_excessive_subdomains",
                                                    "url_complexity")]


@register("q_D7_alternate_features",
          f"SELECT page_id, feature, value FROM (SELECT page_id, {', '.join(f'CAST({c} AS DOUBLE) AS {c}' for c in _D7_COLS)}, "
          f"CAST(page_id % 7 AS DOUBLE) AS grade FROM ({ou.url_features_query(year=2024)}) f) w UNPIVOT (value FOR feature IN ({', '.join([*_D7_COLS, 'grade'])}))")
def q_d7(spark, sf):
    """Feature columns of a wide table chosen by the alternate name rule."""
    wide = normalize(sc.url_features(url_corpus(spark, sf), "url", 2024).drop("error"))
    wide = wide.withColumns({k: F.expr(v) for k, v in _D7_EXTRA.items()})
    cols = pp.alternate_feature_columns([c for c in wide.columns if c not in ("page_id", "variant")])
    long = wide.select("page_id", *[F.col(f"`{c}`").cast("double").alias(c) for c in cols])
    return long.unpivot("page_id", cols, "feature", "value")


# ------------------------------------------------------------------ T1-T4

_RAW_FEATS = oe.email_features_raw()
_LONG = (f"SELECT label, feature, value FROM (SELECT label, {', '.join(f'CAST({n} AS DOUBLE) AS {n}' for n in EMAIL_FEATURES)} "
         f"FROM ({_RAW_FEATS}) r) w UNPIVOT (value FOR feature IN ({', '.join(EMAIL_FEATURES)}))")
_SEP = ("SELECT feature, CAST(sum(in0) AS BIGINT) AS n_values_0, CAST(sum(in1) AS BIGINT) AS n_values_1, "
        "CAST(sum(in0 * in1) AS BIGINT) AS n_shared FROM (SELECT feature, value, max((label = 0)::INT) AS in0, "
        f"max((label = 1)::INT) AS in1 FROM ({_LONG}) l WHERE value IS NOT NULL AND label IN (0, 1) GROUP BY feature, value) v "
        "GROUP BY feature")


@register("q_T1_T2_separation",
          "SELECT feature, n_values_0, n_values_1, n_shared, "
          "CAST(n_values_0 > 0 AND n_values_1 > 0 AND n_shared = 0 AS BIGINT) AS separates, "
          "CAST(n_values_0 = 1 AND n_values_1 = 1 AND n_shared = 1 AS BIGINT) AS constant_per_class "
          f"FROM ({_SEP}) s")
def q_t1(spark, sf):
    """Per email feature: distinct values per class, shared values, leak flags."""
    df = sc.email_features(email_corpus(spark, sf)).select("label", *EMAIL_FEATURES)
    return normalize(lk.separation_report(df, "label", EMAIL_FEATURES))


_T3 = ("urgency_score", "threat_score", "spf_result_match")


@register("q_T4_leaking_features",
          "SELECT feature, array_to_string(list_sort(list_distinct(list(reason))), ',') AS reasons FROM ("
          f"SELECT feature, 'perfect_separation' AS reason FROM ({_SEP}) s WHERE n_values_0 > 0 AND n_values_1 > 0 AND n_shared = 0 "
          + "".join(f"UNION ALL SELECT {g.q(n)}, 'suspicious_name' " for n in _T3) + ") u GROUP BY feature")
def q_t4(spark, sf):
    """Features to drop: perfect separation or a leak-like name."""
    df = sc.email_features(email_corpus(spark, sf)).select("label", *EMAIL_FEATURES)
    return lk.leaking_features(df, "label", EMAIL_FEATURES)


# ------------------------------------------------------------------ T5-T10, T14

def _domain_sql():
    d0 = "CASE WHEN length(_netloc) > 0 THEN _netloc ELSE _path END"
    d1 = f"CASE WHEN starts_with({d0}, 'www.') THEN substring({d0}, 5) ELSE {d0} END"
    return (f"SELECT page_id, url, label, nullif(lower(split_part({d1}, ':', 1)), '') AS domain "
            f"FROM ({ou.parts_select(g.url_corpus_sql())}) p")


def _h(x):
    return f"('0x' || substr(md5(concat('{lx.SPLIT_SEED}|', CAST({x} AS VARCHAR))), 1, 8))::BIGINT"


_DOM = _domain_sql()
_T7 = (f"SELECT page_id, domain, CASE WHEN {_h('domain')} % 10000 < {int(round(lx.TEST_FRACTION * 10000))} "
       f"THEN 'test' ELSE 'train' END AS split FROM ({_DOM}) d WHERE domain IS NOT NULL")


@register("q_T5_domains", f"SELECT page_id, domain FROM ({_DOM}) d")
def q_t5(spark, sf):
    """Registered-domain key of every corpus URL."""
    return sp.with_domain(url_corpus(spark, sf)).select("page_id", "domain")


@register("q_T6_rows_without_domain", f"SELECT CAST(sum((domain IS NULL)::INT) AS BIGINT) AS n_dropped FROM ({_DOM}) d")
def q_t6(spark, sf):
    """Rows dropped because no domain could be taken from the URL."""
    return sp.dropped_without_domain(url_corpus(spark, sf))


@register("q_T7_domain_split", _T7)
def q_t7(spark, sf):
    """Domain-isolated 80/20 split by seeded hash of the domain."""
    return sp.domain_split(url_corpus(spark, sf)).select("page_id", "domain", "split")


_T7X = ("SELECT page_id, d.domain, CASE WHEN r.rn <= r.k THEN 'test' ELSE 'train' END AS split FROM "
        f"({_DOM}) d JOIN (SELECT domain, row_number() OVER (ORDER BY {_h('domain')}, domain) AS rn, "
        f"ceil(count(*) OVER () * {g.dbl(lx.TEST_FRACTION)}) AS k FROM (SELECT DISTINCT domain FROM ({_DOM}) x "
        "WHERE domain IS NOT NULL) y) r ON d.domain = r.domain")


@register("q_T7_domain_split_exact", _T7X)
def q_t7x(spark, sf):
    """Domain split with exactly ceil(20%) of the domains in test."""
    return sp.domain_split(url_corpus(spark, sf), exact=True).select("page_id", "domain", "split")


@register("q_T8_domain_overlap",
          f"SELECT domain FROM ({_T7}) a WHERE split = 'train' INTERSECT SELECT domain FROM ({_T7}) b WHERE split = 'test'")
def q_t8(spark, sf):
    """Domains present on both sides of the split (must be none)."""
    return sp.split_overlap(sp.domain_split(url_corpus(spark, sf)))


@register("q_T9_split_report",
          f"SELECT split, CAST(count(*) AS BIGINT) AS n_rows, CAST(count(DISTINCT domain) AS BIGINT) AS n_keys FROM ({_T7}) s GROUP BY split")
def q_t9(spark, sf):
    """Rows and domains per side of the domain split."""
    return sp.split_report(sp.domain_split(url_corpus(spark, sf)))


@register("q_T10_stratified_split",
          "SELECT email_id, CAST(label AS BIGINT) AS label, CASE WHEN row_number() OVER (PARTITION BY label ORDER BY "
          f"{_h('email_id')}, email_id) <= round(count(*) OVER (PARTITION BY label) * {g.dbl(lx.TEST_FRACTION)}) "
          f"THEN 'test' ELSE 'train' END AS split FROM ({g.email_corpus_sql()}) e")
def q_t10(spark, sf):
    """Stratified 80/20 split: exactly round(20%) of each class in test."""
    e = email_corpus(spark, sf).select("email_id", "label")
    return sp.stratified_split(e, "email_id").select("email_id", F.col("label").cast("bigint"), "split")


@register("q_T14_class_weights",
          f"SELECT CAST(label AS BIGINT) AS label, count(*) AS n, {g.r6('sum(count(*)) OVER () / (count(*) OVER () * count(*))')} "
          f"AS weight FROM ({g.email_corpus_sql()}) e GROUP BY label")
def q_t14(spark, sf):
    """Balanced class weights n / (k * n_c)."""
    t = sp.class_weight_table(email_corpus(spark, sf).select(F.col("label").cast("bigint")))
    return t.withColumn("weight", r6(F.col("weight")))
