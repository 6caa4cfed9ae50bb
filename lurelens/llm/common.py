"""Spark helpers shared by the operators of this subpackage."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lurelens.session import ensure_checkpoint_dir

#: Words are maximal runs of anything but blank, tab, newline, vertical tab,
#: form feed and carriage return (a Java pattern; also valid RE2).
WORD_RE = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Writes ``df`` once as Parquet below ``spark.checkpoint.dir`` (shared by
    driver and executors) and reads it back: lineage ends there, and a lost
    executor only costs a re-read."""
    spark = df.sparkSession
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/llm-{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def free_name(df: DataFrame, base: str) -> str:
    """A column name that does not clash with those of ``df`` (any case)."""
    have = {c.lower() for c in df.columns}
    while base.lower() in have:
        base += "_"
    return base


def n_words(text: str = "text"):
    """Number of words of a text column (null: 0), on the JVM."""
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORD_RE)), F.lit(0)).cast("long")


def spread(df: DataFrame) -> DataFrame:
    """More scan partitions where a few large files would keep cores idle is a
    matter of ``spark.sql.files.maxPartitionBytes``; here only the identity, so
    that no text is shuffled for it."""
    return df


def running_offsets(counts: DataFrame, key: list[str], order: list[str], n: str, out: str) -> DataFrame:
    """Adds ``out``: the sum of ``n`` over earlier rows of the same ``key``.
    ``counts`` holds one row per bucket (a fixed number of buckets a key)."""
    from pyspark.sql import Window
    w = Window.partitionBy(*key).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return counts.withColumn(out, F.coalesce(F.sum(n).over(w), F.lit(0)).cast("long"))
