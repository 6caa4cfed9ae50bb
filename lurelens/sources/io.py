"""Sources and sinks.

CSV input is read as UTF-8 where a file is valid UTF-8 and as latin1 where it is
not, file by file (``file_encodings``); a caller may also name the encoding.
Mail tables hold line breaks inside quoted fields (``multiLine``), which cannot
be split inside a file, so large mail inputs should arrive as many files; URL
tables are read line by line and split anywhere.
"""

from __future__ import annotations

import re
from urllib.parse import unquote

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import labels as lb
from ..functions.manifest import ALL_FEATURES
from ..operators import leakage as lk
from ..operators import ordering as od
from ..operators import prep as pp

CSV_OPTIONS = {"header": "true", "escape": '"', "quote": '"'}


#: White space as the reference strips it (Unicode, and the separators U+001C to U+001F).
BLANKS = r"[\s\x{1c}-\x{1f}]+"


def file_encodings(spark: SparkSession, path) -> DataFrame:
    """file, encoding: 'utf-8' for every file whose bytes are valid UTF-8, else
    'iso-8859-1' (latin1).  Files are checked line by line (no UTF-8 sequence holds a line
    feed), so a large file is checked by many tasks; an empty file is UTF-8."""
    lines = spark.read.option("lineSep", "\n").text(path)
    bad = lines.select(F.col("_metadata.file_path").alias("file"), (~F.is_valid_utf8("value")).alias("bad"))
    return bad.groupBy("file").agg(F.when(F.max("bad"), "iso-8859-1").otherwise("utf-8").alias("encoding"))


def _as_path(uri: str) -> str:
    """A file's URI as a path for a reader: decoded, with glob characters escaped."""
    return re.sub(r"([\[\]{}*?\\])", r"\\\1", unquote(uri))


def read_csv(spark: SparkSession, path: str, encoding: str | None = None, schema=None, multi_line: bool = True) -> DataFrame:
    """S1/S3 reader: header, quoted fields.  Without ``encoding`` each file is
    read in its own: the files of each encoding are one scan.  Columns are
    strings unless ``schema`` says otherwise."""
    def scan(paths, enc):
        r = spark.read.options(**CSV_OPTIONS).option("multiLine", str(multi_line).lower()).option("encoding", enc)
        return (r.schema(schema) if schema is not None else r).csv(paths)

    if encoding is not None:
        return scan(path, encoding)
    files: dict[str, list[str]] = {}
    for r in file_encodings(spark, path).collect():               # one row a file
        files.setdefault(r["encoding"], []).append(_as_path(r["file"]))
    if len(files) < 2:
        return scan(path, next(iter(files), "utf-8"))
    parts = [scan(sorted(files[e]), e) for e in sorted(files)]
    return parts[0].unionByName(parts[1], allowMissingColumns=True)


def load_email_dataset(spark: SparkSession, path: str, encoding: str | None = None, keep=()) -> DataFrame:
    """S1 + D3/D4/D9/D10/L3: labelled email CSV -> one conformed email row each,
    every file in its own encoding unless one is named."""
    return pp.conform_email_table(read_csv(spark, path, encoding), keep=keep)


def load_url_feature_dataset(spark: SparkSession, path: str, binary: bool = True, drop_leaks: bool = True,
                             schema=None):
    """S2 + D1/D2/D6/L1/L2/T4: pre-computed URL feature CSV.

    Returns (table with ``label_numeric``, feature column list).  The leak
    list comes from a distributed aggregation; only column names return to
    the driver.  Pass ``schema`` on large inputs: schema inference reads
    the whole file once more."""
    r = spark.read.options(header="true", escape='"')
    df = (r.schema(schema) if schema is not None else r.option("inferSchema", "true")).csv(path)
    label = pp.find_label_column(df.columns)
    if label is None:
        raise ValueError(f"no label column in {df.columns}")
    url = pp.find_url_column(df.columns)
    if binary:
        df = df.withColumn("label_numeric", lb.url_binary_label(F.col(f"`{label}`")))
    else:
        placed = df.withColumn("__place", od.file_order(df))
        df = pp.label_index_by_first_appearance(placed, label, "__place", out_col="label_numeric").drop("__place")
    feats = pp.numeric_feature_columns(df.schema, label, url)
    if drop_leaks and feats:
        leaks = {r["feature"] for r in lk.leaking_features(
            df.select("label_numeric", *[F.col(f"`{c}`") for c in feats]), "label_numeric", feats).collect()}
        feats = [c for c in feats if c not in leaks]
    return df, feats


def load_raw_url_dataset(spark: SparkSession, path: str, encoding: str | None = None, schema=None) -> DataFrame:
    """S3 + D5/D11/L4: raw URL CSV -> (url, label).  Without ``schema`` the label
    counts as numeric if each of its values is a number (one more pass over that
    column)."""
    df = read_csv(spark, path, encoding, schema, multi_line=False)
    url, label = pp.find_raw_url_columns(df.columns)
    if url is None or label is None:
        raise ValueError(f"no url/label column in {df.columns}")
    from pyspark.sql import types as T
    if schema is None:
        number = F.expr(f"try_cast(`{label}` as double)")
        odd = df.filter(F.col(f"`{label}`").isNotNull() & number.isNull()).limit(1).count()
        df = df if odd else df.withColumn(label, number)
    numeric = isinstance(df.schema[label].dataType, T.NumericType)
    out = df.select(F.col(f"`{url}`").cast("string").alias("url"),
                    lb.raw_url_label(F.col(f"`{label}`"), numeric).alias("label"))
    return pp.drop_short_urls(out, "url")


def peek_schema(spark: SparkSession, path: str, n: int = 5):
    """The first ``n`` rows (of the first files by path, in their order) and
    the column names of a CSV.  As many files are read as the rows need."""
    files = [_as_path(f) for f in sorted(spark.read.option("header", "true").csv(path).inputFiles())]
    k = 1
    while True:
        df = spark.read.option("header", "true").csv(files[:k] or path)
        if k >= len(files) or df.limit(n).count() >= n:
            break
        k *= 2
    first = df.withColumn("__place", od.file_order(df)).orderBy("__place").limit(n).drop("__place")
    return first, df.columns


def strip(text: Column) -> Column:
    """Without white space at either end."""
    return F.regexp_replace(text, f"(?U)^{BLANKS}|{BLANKS}$", "")


def read_url_lines(spark: SparkSession, path: str) -> DataFrame:
    """One URL per line, white space stripped, blank lines dropped."""
    lines = spark.read.option("lineSep", "\n").text(path)
    return lines.select(strip(F.col("value")).alias("url")).where(F.col("url") != "")


def write_csv(df: DataFrame, path: str, mode: str = "overwrite", encoding: str = "UTF-8") -> None:
    """CSV with header, every field quoted, quotes doubled, blanks kept
    (Spark's writer trims leading/trailing blanks unless told not to)."""
    df.write.mode(mode).options(header="true", quoteAll="true", escape='"', encoding=encoding, ignoreLeadingWhiteSpace="false",
                                ignoreTrailingWhiteSpace="false").csv(path)


def write_json(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """JSON lines."""
    df.write.mode(mode).json(path)


def read_metrics(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("model string, accuracy double, precision double, recall double, f1 double").json(path)


def write_manifest(spark: SparkSession, path: str, names=ALL_FEATURES) -> None:
    """The feature-name manifest, one name per line, in order."""
    spark.createDataFrame([(n,) for n in names], "value string").coalesce(1).write.mode("overwrite").text(path)


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """Position, feature of a written manifest, in file order."""
    lines = spark.read.text(path)
    placed = lines.select(F.col("value").alias("feature"), od.file_order(lines).alias("__place"))
    return od.place(od.by_ranges(placed, ["__place"], "manifest"), "position").select("position", "feature")


def read_manifest(spark: SparkSession, path: str) -> list[str]:
    return [r["feature"] for r in manifest(spark, path).orderBy("position").collect()]
