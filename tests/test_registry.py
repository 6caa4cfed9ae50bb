"""Entry point and a subset of registered queries against the DuckDB oracle."""
import hashlib

import duckdb
import pytest

import __spark_entry__ as ent

TABLES = "pages documents labels".split()
SUBSET = ["q_U42_url_features", "q_R17_score_urls", "q_E22_email_features", "q_C2_url_feature_means",
          "q_M16_score_emails", "q_M17_email_with_urls", "q_T1_T2_separation", "q_T7_domain_split_exact",
          "q_T10_stratified_split", "q_L1_url_labels", "q_V5_metrics_table", "q_B4_B5_email_blend", "q_V3_auc_exact",
          "q_C2_by_parts", "q_M17_by_parts", "q_S1_mixed_encodings", "q_S4_schema_peek", "q_S5_url_lines", "q_S10_manifest",
          "q_D7_alternate_features", "q_L2_label_index", "q_T4_leaking_features", "q_T11_scaled_features", "q_T18_tfidf_features",
          "q_T19_term_weights", "q_W3_scan_history"]


def _digest(rows, cols):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    norm = lambda v: repr(round(v, 6)) if isinstance(v, float) else repr(v)
    return hashlib.sha1("\n".join(sorted("|".join(norm(r[i]) for i in order) for r in rows)).encode()).hexdigest()


@pytest.fixture(scope="module")
def con(sf001):
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf001}/{t}.parquet')")
    return c


def test_entry_runs(spark):
    df = ent.entry(spark)
    assert df.count() > 0 and "combined_risk_level" in df.columns


def test_every_query_has_docs_and_oracle_names():
    q, s = ent.queries(), ent.oracle_sql()
    assert set(s) <= set(q) and len(q) >= 100


@pytest.mark.parametrize("name", SUBSET)
def test_query_matches_oracle(spark, con, sf001, name):
    df = ent.queries()[name](spark, sf001)
    rows, cols = [tuple(r) for r in df.collect()], df.columns
    rel = con.sql(ent.oracle_sql()[name])
    assert sorted(cols) == sorted(rel.columns)
    orows = rel.fetchall()
    assert len(rows) == len(orows)
    assert _digest(rows, cols) == _digest(orows, rel.columns)
