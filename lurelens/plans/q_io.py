"""Registered source/sink round trips (S1, S5-S9): data derived from the
driver tables is written under the checkpoint folder and read back."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import lexicons as lx
from ..functions.manifest import ALL_FEATURES
from ..operators import evaluate as ev
from ..operators import scoring as sc
from ..session import scratch_path
from ..sources import io
from ..sources.corpora import email_corpus, url_corpus
from . import q_email
from . import q_url  # noqa: F401  (its SQL is reused)
from . import sqlgen as g
from .registry import REGISTRY, register
from .shape import r6


@register("q_S1_email_csv_roundtrip",
          "SELECT email_id, coalesce(subject, '') AS subject, concat(coalesce(subject, ''), ' ', coalesce(body, '')) AS body, "
          f"CAST(label AS BIGINT) AS label FROM ({g.email_corpus_sql()}) e")
def q_s1(spark, sf):
    """Email table written as quoted CSV, read back (multi-line), conformed."""
    path = scratch_path(spark, "emails-csv")
    io.write_csv(email_corpus(spark, sf).select("email_id", "subject", "body", "sender", "label"), path)
    df = io.load_email_dataset(spark, path, keep=[F.col("email_id").cast("bigint").alias("email_id")])
    return df.select("email_id", "subject", "body", F.col("label").cast("bigint").alias("label"))


_LATIN1 = "[^\\x{0}-\\x{FF}]"


@register("q_S1_mixed_encodings", REGISTRY["q_S1_email_csv_roundtrip"].sql)
def q_s1_mixed(spark, sf):
    """A folder of UTF-8 and latin1 CSV files read in one call: mails of odd id
    that latin1 can hold are written as latin1, the others as UTF-8."""
    path = scratch_path(spark, "emails-mixed")
    e = email_corpus(spark, sf).select("email_id", "subject", "body", "sender", "label")
    latin1 = (F.col("email_id") % 2 == 1) & ~F.concat_ws(" ", "subject", "body").rlike(_LATIN1)
    io.write_csv(e.where(~latin1), path)
    io.write_csv(e.where(latin1), path, mode="append", encoding="ISO-8859-1")
    df = io.load_email_dataset(spark, path, keep=[F.col("email_id").cast("bigint").alias("email_id")])
    return df.select("email_id", "subject", "body", F.col("label").cast("bigint").alias("label"))


# White space at the ends of the planted lines, by page_id % 8; some lines have nothing else.
_BEFORE = ("", "\t ", "\u00a0", "\u3000\x1f", " ", "\x85", "\u2003", "")
_AFTER = ("", " \r", "\u2028", "\x1c ", "\t\t", "\u00a0\r", "\x0b\x0c", "\u1680")


def _spelled(s):
    return " || ".join(f"chr({ord(c)})" for c in s) or "''"


def _s5_sql():
    pick = lambda arr: "CASE page_id % 8 " + " ".join(f"WHEN {i} THEN {_spelled(v)}" for i, v in enumerate(arr)) + " END"
    blank = "[" + "".join(f"\\x{{{a:x}}}-\\x{{{b:x}}}" for a, b in (
        (0x09, 0x0d), (0x1c, 0x20), (0x85, 0x85), (0xa0, 0xa0), (0x1680, 0x1680), (0x2000, 0x200a), (0x2028, 0x2029), (0x202f, 0x202f),
        (0x205f, 0x205f), (0x3000, 0x3000))) + "]+"
    line = f"{pick(_BEFORE)} || CASE WHEN page_id % 11 = 0 THEN '' ELSE url END || {pick(_AFTER)}"
    return (f"SELECT url FROM (SELECT regexp_replace(regexp_replace({line}, '^{blank}', ''), '{blank}$', '') AS url "
            f"FROM ({g.url_corpus_sql()}) u) s WHERE url <> ''")


@register("q_S5_url_lines", _s5_sql())
def q_s5(spark, sf):
    """URLs written one per line with white space of many kinds around them, read
    back stripped, without blank lines."""
    path = scratch_path(spark, "url-lines")
    pick = lambda arr: F.get(F.array(*[F.lit(v) for v in arr]), (F.col("page_id") % 8).cast("int"))
    line = F.concat(pick(_BEFORE), F.when(F.col("page_id") % 11 == 0, F.lit("")).otherwise(F.col("url")), pick(_AFTER))
    url_corpus(spark, sf).select(line.alias("value")).write.mode("overwrite").option("lineSep", "\n").text(path)
    return io.read_url_lines(spark, path)


@register("q_S10_manifest",
          "SELECT i AS position, list_extract([" + ", ".join(g.q(n) for n in ALL_FEATURES) + "], i + 1) AS feature "
          f"FROM range({len(ALL_FEATURES)}) t(i) WHERE EXISTS (SELECT 1 FROM documents)")
def q_s10(spark, sf):
    """The columns of the feature matrix of the mails, written as a manifest and
    read back in order."""
    path = scratch_path(spark, "manifest")
    io.write_manifest(spark, path, [c for c in sc.feature_matrix(sc.combined_features(email_corpus(spark, sf), 2024)).columns if c in ALL_FEATURES])
    return io.manifest(spark, path).select("position", "feature")


@register("q_S7_json_roundtrip",
          "SELECT page_id, round(risk_score * 1000000.0) / 1000000.0 AS risk_score, risk_level "
          f"FROM ({REGISTRY['q_R17_score_urls'].sql}) z")
def q_s7(spark, sf):
    """Scored URLs written as JSON lines and read back."""
    path = scratch_path(spark, "scored-json")
    io.write_json(sc.score_urls(url_corpus(spark, sf)).select("page_id", "url", "risk_score", "risk_level",
                                                               "risk_factors"), path)
    back = spark.read.schema("page_id long, url string, risk_score double, risk_level string, "
                             "risk_factors array<string>").json(path)
    return back.select("page_id", r6(F.col("risk_score")).alias("risk_score"), "risk_level")


_DEFAULTS = " UNION ALL ".join(
    f"SELECT {g.q(m)} AS model, {a!r} AS accuracy, {p!r} AS precision, {r!r} AS recall, {f!r} AS f1"
    for m, a, p, r, f in lx.DEFAULT_METRICS)


@register("q_S8_S9_metrics_with_defaults",
          f"SELECT model, accuracy, precision, recall, f1 FROM ({REGISTRY['q_V5_metrics_table'].sql}) m "
          f"UNION ALL SELECT model, {g.r6('accuracy')}, {g.r6('precision')}, {g.r6('recall')}, {g.r6('f1')} FROM ({_DEFAULTS}) d "
          f"WHERE model NOT IN (SELECT model FROM ({REGISTRY['q_V5_metrics_table'].sql}) x)")
def q_s8(spark, sf):
    """Metrics written as JSON, read back; models missing from the file
    take the published defaults."""
    path = scratch_path(spark, "metrics-json")
    io.write_json(q_email.q_v5(spark, sf).drop("n"), path)
    m = ev.metrics_with_defaults(spark, io.read_metrics(spark, path), keep_all_defaults=True)
    return m.select("model", *[r6(F.col(c)).alias(c) for c in ("accuracy", "precision", "recall", "f1")])
