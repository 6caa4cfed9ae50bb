"""The text model (T19): log-count-ratio weights and a linear fit.

Terms are words and pairs of adjacent words of the lower-cased text, dealt to
``BUCKETS`` buckets by md5.  Each bucket is weighted by the log ratio of its
smoothed share among the documents of class 1 to that of class 0; a ratio below
``Z`` of its standard errors weighs nothing.  A document is the weights of its
distinct buckets, and a logistic regression is fitted on them (without
standardisation, which would undo the weights).  Buckets that weigh nothing are
no part of the model.

The weights are one partial aggregation over (document, bucket); what returns to
the driver and goes into the model is one number a bucket, whatever the size of
the corpus.  The vectors of the training rows are written once and read from
there, in small batches; a partition of the fit holds some ``PART_BYTES`` of them
at most, so what a task of an executor holds does not grow with the rows.  The
fitted model is a ``PipelineModel``, saved and applied like the others.
"""

from __future__ import annotations

from contextlib import contextmanager

from pyspark.ml import PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import CountVectorizerModel, ElementwiseProduct, SQLTransformer
from pyspark.ml.linalg import Vectors
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import materialize
from .models import PARTITIONS_PER_CORE, check_classes
from .tfidf import items

BUCKETS = 1 << 17
Z = 1.96                 # two-sided 5 %
ENTRY_BYTES = 12         # of an entry of a sparse vector
PART_BYTES = 64 << 20
BATCH_ROWS = 256
WORD = r"[\p{L}\p{N}_]+"


def bucketed(text_col: str = "text", buckets: int = BUCKETS) -> SQLTransformer:
    """Adds ``__buckets``: the distinct buckets of a text's terms, as strings."""
    words = f"regexp_extract_all(lower(coalesce({text_col}, '')), '{WORD.replace(chr(92), chr(92) * 2)}', 0)"
    n = "greatest(size(__words) - 1, 0)"
    pairs = f"zip_with(slice(__words, 1, {n}), slice(__words, 2, {n}), (a, b) -> concat(a, ' ', b))"
    bucket = f"cast(cast(conv(substring(md5(t), 1, 8), 16, 10) as bigint) % {buckets} as string)"
    return SQLTransformer(statement=f"SELECT *, array_distinct(transform(array_distinct(concat(__words, {pairs})), t -> {bucket})) AS __buckets "
                                    f"FROM (SELECT *, {words} AS __words FROM __THIS__)")


def weights(train: DataFrame, text_col: str = "text", label: str = "label", buckets: int = BUCKETS) -> DataFrame:
    """bucket, n1, n0 (documents of each class that hold it), ratio and weight
    (the ratio, or 0), of every bucket that a document holds."""
    return _weights(bucketed(text_col, buckets).transform(train.select(text_col, label)), label)


def _weights(train: DataFrame, label: str) -> DataFrame:
    """``weights`` of rows with ``__buckets``."""
    rows = items(train, F.col("__buckets"), "bucket", label)
    n = rows.groupBy(F.col("bucket").cast("long").alias("bucket")).agg(
        F.sum((F.col(label) == 1).cast("long")).alias("n1"), F.sum((F.col(label) == 0).cast("long")).alias("n0"))
    n = materialize(n, "bucket-counts")
    docs = train.agg(F.sum((F.col(label) == 1).cast("long")).alias("n1"), F.sum((F.col(label) == 0).cast("long")).alias("n0")).first()
    share = [F.log((F.col(c) + 1) / F.lit(float((docs[c] or 0) + 2))) for c in ("n1", "n0")]
    n = n.withColumn("ratio", share[0] - share[1])
    error = F.sqrt(1 / (F.col("n1") + 1) + 1 / (F.col("n0") + 1))
    return n.withColumn("weight", F.when(F.abs("ratio") >= Z * error, F.col("ratio")).otherwise(F.lit(0.0)))


def fit(train: DataFrame, text_col: str = "text", label: str = "label", buckets: int = BUCKETS, reg: float = 0.01,
        max_iter: int = 50) -> PipelineModel:
    """A fitted model over ``text_col``; training rows of one class are refused."""
    check_classes(train, label)
    # the buckets of the training rows are found once, for the weights and for the fit
    rows = materialize(bucketed(text_col, buckets).transform(train.select(text_col, label)).select(
        label, F.col("__buckets").cast("array<int>").alias("__buckets")), "text-buckets")
    with small_batches(train.sparkSession):
        # at most one row a bucket; those that weigh nothing would be zeros of every document
        scale = _weights(rows, label).filter("weight <> 0").select("bucket", "weight", (F.col("n1") + F.col("n0")).alias("n")).orderBy("bucket").collect()
        stages = [bucketed(text_col, buckets),
                  CountVectorizerModel.from_vocabulary([str(r["bucket"]) for r in scale] or ["0"], "__buckets", "__present", binary=True),
                  ElementwiseProduct(scalingVec=Vectors.dense([r["weight"] for r in scale] or [0.0]), inputCol="__present", outputCol="features")]
        rows = rows.select(label, F.col("__buckets").cast("array<string>").alias("__buckets"))
        for s in stages[1:]:
            rows = s.transform(rows)
        # not persisted: the fit reads its rows twice and then holds blocks of its own
        vectors = in_parts(materialize(rows.select("features", label), "text-vectors"), sum(r["n"] for r in scale))
        linear = LogisticRegression(featuresCol="features", labelCol=label, regParam=reg, maxIter=max_iter, standardization=False, aggregationDepth=3)
        return PipelineModel([*stages, linear.fit(vectors)])


@contextmanager
def small_batches(spark: SparkSession):
    """Parquet is read ``BATCH_ROWS`` rows at a time meanwhile: a batch holds the
    whole arrays of its rows, and a long text has tens of thousands of buckets."""
    name = "spark.sql.parquet.columnarReaderBatchSize"
    old = spark.conf.get(name)
    spark.conf.set(name, str(BATCH_ROWS))
    try:
        yield
    finally:
        spark.conf.set(name, old)


def in_parts(vectors: DataFrame, entries: int) -> DataFrame:
    """``vectors``, that hold so many entries in all, in partitions of some
    ``PART_BYTES`` at most (in at most ``PARTITIONS_PER_CORE`` a core while those
    are smaller).  An executor sends and reads a cached partition as a whole."""
    least = -(-entries * ENTRY_BYTES // PART_BYTES)
    if vectors.rdd.getNumPartitions() < least:
        return vectors.repartition(least)
    return vectors.coalesce(max(least, PARTITIONS_PER_CORE * vectors.sparkSession.sparkContext.defaultParallelism))
