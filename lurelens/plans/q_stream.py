"""Registered streaming queries (W1-W3, S12): a file stream over the driver
table, processed once (``availableNow``) into Parquet under the checkpoint
folder, read back and compared with the batch answer."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..session import scratch_path
from ..sources.corpora import email_corpus_from_documents, read_table, url_corpus_from_pages
from ..streaming import streams as st
from . import q_email, q_url
from .registry import REGISTRY, register
from .shape import joined, r6


def _stream_of(spark, sf, table):
    schema = read_table(spark, sf, table).schema
    return st.file_stream(spark, st.table_folder(sf, table), schema)


@register("q_W1_stream_score_urls", REGISTRY["q_R17_score_urls"].sql)
def q_w1(spark, sf):
    """URL scoring on a stream of page rows; equals the batch result."""
    pages = _stream_of(spark, sf, "pages").select("page_id", "url")
    out = st.run_to_table(spark, url_corpus_from_pages(pages), "w1", st.score_url_stream)
    return out.select("page_id", "url", r6(F.col("risk_score")).alias("risk_score"), "risk_level",
                      joined(F.col("risk_factors")).alias("risk_factors"),
                      F.size("risk_factors").cast("bigint").alias("n_factors"))


@register("q_W2_stream_emails_with_urls", REGISTRY["q_M17_email_with_urls"].sql)
def q_w2(spark, sf):
    """Email + embedded URL scoring on a stream of documents; equals batch."""
    docs = _stream_of(spark, sf, "documents").select("doc_id", "text")
    out = st.run_to_table(spark, email_corpus_from_documents(docs), "w2", st.score_email_stream)
    max_url = F.array_max(F.transform("url_analyses", lambda a: a["risk_score"]))
    return out.select(
        "email_id", r6(F.col("email_risk_score")).alias("email_risk_score"), "email_risk_level",
        joined(F.col("email_risk_factors")).alias("email_risk_factors"),
        joined(F.col("urls_found")).alias("urls_found"), F.size("urls_found").cast("bigint").alias("n_urls"),
        r6(max_url).alias("max_url_score"), r6(F.col("combined_risk_score")).alias("combined_risk_score"),
        "combined_risk_level", joined(F.col("recommendations")).alias("recommendations"))


def _history(spark, sf):
    """Two streams (even and odd pages) with checkpoints of their own append to
    one history."""
    pages = _stream_of(spark, sf, "pages").select("page_id", "url")
    path = scratch_path(spark, "history")
    for half in (0, 1):
        scored = st.score_url_stream(url_corpus_from_pages(pages.where(F.col("page_id") % 2 == half)))
        scored = scored.select("page_id", "url", "risk_score", "risk_level")
        st.append_history(scored, path, scratch_path(spark, "history-ckpt")).awaitTermination()
    return path


@register("q_W3_scan_history",
          "SELECT page_id, url, " + "round(risk_score * 1000000.0) / 1000000.0" + " AS risk_score, risk_level "
          f"FROM ({REGISTRY['q_R17_score_urls'].sql}) z")
def q_w3(spark, sf):
    """Scored URL rows appended to the history table by foreachBatch."""
    h = st.history(spark, _history(spark, sf))
    return h.select("page_id", "url", r6(F.col("risk_score")).alias("risk_score"), "risk_level")


@register("q_S12_history_count", "SELECT CAST(count(*) AS BIGINT) AS n_scans FROM pages")
def q_s12(spark, sf):
    """Rows in the scan history after two streams over the pages."""
    return st.history_count(spark, _history(spark, sf))
