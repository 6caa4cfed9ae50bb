"""Training-data preparation: column discovery (D1-D13) and label
statistics (L2, L6-L9).

Discovery rules run on the driver over ``df.columns`` / ``df.schema`` (names
and types only, never data); the operators they feed are DataFrame
transforms.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window

from ..functions import labels as lb
from ..functions import lexicons as lx
from .ordering import by_ranges, place

# ------------------------------------------------------------------ discovery


def find_label_column(columns) -> str | None:
    """First column whose lower-case name is label/type/class/category."""
    return next((c for c in columns if c.lower() in lx.LABEL_COLUMN_NAMES), None)


def find_url_column(columns) -> str | None:
    """First column named url/link/website/domain (any case)."""
    return next((c for c in columns if c.lower() in lx.URL_COLUMN_NAMES), None)


def find_email_columns(columns) -> tuple[str | None, str | None]:
    """D3: (subject, body); without a subject column the body serves as both."""
    subject = next((c for c in columns if "subject" in c.lower()), None)
    body = next((c for c in columns if any(s in c.lower() for s in lx.EMAIL_BODY_SUBSTRINGS) or c.lower() == "text"), None)
    if subject is None and body is not None:
        subject = body
    return subject, body


def find_email_label(columns) -> str | None:
    """Exact 'label', else the first of is_phishing, phishing, malicious,
    spam, class, type (in that priority)."""
    exact = next((c for c in columns if c.lower() == "label"), None)
    if exact:
        return exact
    for v in lx.EMAIL_LABEL_VARIANTS:
        hit = next((c for c in columns if c.lower() == v), None)
        if hit:
            return hit
    return None


def find_raw_url_columns(columns) -> tuple[str | None, str | None]:
    """The *last* column containing url/link/website and the last
    containing label/class/type."""
    url = label = None
    for c in columns:
        lc = c.lower()
        if any(s in lc for s in lx.RAW_URL_NAME_SUBSTRINGS):
            url = c
        if any(s in lc for s in lx.RAW_LABEL_NAME_SUBSTRINGS):
            label = c
    return url, label


def numeric_feature_columns(schema: T.StructType, label_col: str | None = None, url_col: str | None = None,
                            exclude=lx.FEATURE_EXCLUDE_PATTERNS) -> list[str]:
    """Numeric columns whose name contains none of the exclude patterns
    (substring test: 'id' also drops 'width')."""
    out = []
    for f in schema.fields:
        lc = f.name.lower()
        if f.name in (label_col, "label_numeric", url_col):
            continue
        if any(p in lc for p in exclude):
            continue
        if isinstance(f.dataType, T.NumericType):
            out.append(f.name)
    return out


def alternate_feature_columns(columns) -> list[str]:
    """Names containing none of url/type/label/domain/date_inspection/
    unnamed/index/id."""
    return [c for c in columns if not any(p in c.lower() for p in lx.ALT_FEATURE_EXCLUDE_PATTERNS)]


def drop_leak_columns(df: DataFrame, patterns=lx.EMAIL_LEAK_PATTERNS, keep=()) -> DataFrame:
    """Drop feature columns whose lower-case name contains a leak pattern."""
    drop = [c for c in df.columns if c not in keep and any(p in c.lower() for p in patterns)]
    return df.drop(*drop)


def as_float_matrix(df: DataFrame, cols, keep=()) -> DataFrame:
    """The feature columns cast to FLOAT (single precision)."""
    return df.select(*keep, *[F.col(f"`{c}`").cast("float").alias(c) for c in cols])


def drop_short_urls(df: DataFrame, url_col: str) -> DataFrame:
    """Keep URLs that are present and at least 5 characters long."""
    return df.where(F.col(url_col).isNotNull() & (F.length(F.col(url_col).cast("string")) >= 5))


def fill_email_columns(df: DataFrame) -> DataFrame:
    """Add missing email fields from alternative names or defaults."""
    cols = set(df.columns)
    add: dict[str, Column] = {}
    if "subject" not in cols:
        add["subject"] = F.lit("")
    if "body" not in cols:
        add["body"] = F.col("body_plain") if "body_plain" in cols else F.lit("")
    if "sender" not in cols:
        add["sender"] = F.col("from_address") if "from_address" in cols else F.lit(lx.DEFAULT_SENDER)
    if "html_content" not in cols:
        add["html_content"] = F.lit("")
    if "num_attachments" not in cols:
        add["num_attachments"] = F.col("has_attachments").cast("int") if "has_attachments" in cols else F.lit(0)
    return df.withColumns(add) if add else df


def conform_email_table(df: DataFrame, keep=()) -> DataFrame:
    """S1 after reading + D3, D4, D9, D10, L3: one row per email with
    subject, body (= subject + ' ' + body when both exist), fixed sender,
    empty headers, label, text, original label."""
    subject, body = find_email_columns(df.columns)
    label = find_email_label(df.columns)
    if subject is None:
        raise ValueError(f"no subject or body/text column in {df.columns}")
    if label is None:
        raise ValueError(f"no label column in {df.columns}")
    subj = F.coalesce(F.col(f"`{subject}`").cast("string"), F.lit(""))
    if body and body != subject:
        content = F.concat(subj, F.lit(" "), F.coalesce(F.col(f"`{body}`").cast("string"), F.lit("")))
    else:
        content = subj
    return df.select(
        *keep,
        subj.alias("subject"),
        content.alias("body"),
        F.lit(lx.DEFAULT_SENDER).alias("sender"),
        F.create_map().cast("map<string,string>").alias("headers"),
        F.lit("").alias("html_content"),
        F.lit(0).alias("num_attachments"),
        lb.email_label(F.col(f"`{label}`")).alias("label"),
        content.alias("text"),
        F.col(f"`{label}`").cast("string").alias("original_label"),
    )


# ------------------------------------------------------------------ labels


def label_index_by_first_appearance(df: DataFrame, label_col: str, order: str, out_col: str = "label_index") -> DataFrame:
    """L2: index of each distinct label in order of first appearance.

    ``order`` is a column that gives the row order, such as the place of a row
    in its files (``ordering.file_order``).  The per-label minimum is a partial
    aggregate; the distinct labels are numbered by ranges."""
    idx = label_index_table(df, label_col, order).withColumnRenamed("label_index", out_col)
    return df.join(idx, df[label_col].eqNullSafe(idx[label_col]), "left").drop(idx[label_col])


def label_mapping(df: DataFrame, original: str, normalized: str) -> DataFrame:
    """Distinct (original label, normalised label) pairs."""
    return df.select(F.col(original).alias("original_label"), F.col(normalized).alias("label")).distinct()


def class_distribution(df: DataFrame, label: str = "label") -> DataFrame:
    """Rows and percent per class."""
    counts = df.groupBy(label).agg(F.count("*").alias("n"))
    total = F.sum("n").over(Window.partitionBy(F.lit(1)))
    return counts.select(label, F.col("n").cast("bigint").alias("n"), (F.col("n") * 100.0 / total).alias("percent"))


def class_guard(df: DataFrame, label: str = "label") -> DataFrame:
    """Number of classes and whether both 0 and 1 are present."""
    return df.agg(F.countDistinct(label).cast("bigint").alias("n_classes"),
                  (F.max(F.when(F.col(label) == 0, 1).otherwise(0)) *
                   F.max(F.when(F.col(label) == 1, 1).otherwise(0))).cast("bigint").alias("both_classes"))


def unknown_labels(df: DataFrame, raw: str, vocab: str = "email") -> DataFrame:
    """Label values no word or number rule matched (mapped to 0), counted."""
    rule = lb.label_rule(F.col(raw), vocab)
    return (df.where(rule == "fallback").groupBy(F.col(raw).alias("raw_label"))
            .agg(F.count("*").cast("bigint").alias("n")).withColumn("fallback_label", F.lit(0).cast("bigint")))


def label_index_table(df: DataFrame, label_col: str, order_col: str) -> DataFrame:
    """L2 as a table: (label, label_index) by first appearance in ``order_col``."""
    firsts = df.groupBy(label_col).agg(F.min(order_col).alias("__first"))
    return place(by_ranges(firsts, ["__first"], "labels"), "label_index").select(label_col, F.col("label_index").cast("bigint").alias("label_index"))
