"""Evaluation tables (V1-V6): confusion matrix, metrics, ROC AUC.

All are aggregations with a bounded result (4 cells, one row per model);
Spark computes them with partial aggregation per partition, so the rows
themselves never meet in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import r6
from ..session import materialize
from .ordering import before, by_ranges


def level_prediction(level_col: Column) -> Column:
    """Rule decision: HIGH or MEDIUM counts as phishing."""
    return F.when(level_col.isin("HIGH", "MEDIUM"), 1).otherwise(0).cast("int")


def threshold_prediction(p: Column, t: float = 0.5) -> Column:
    """B1: prediction = p >= t; a missing prediction counts as class 0 (V4)."""
    return F.coalesce((p >= t).cast("int"), F.lit(0))


def confusion_matrix(pred: DataFrame, label: str = "label", prediction: str = "prediction") -> DataFrame:
    """V1: (label, prediction, n) for the four cells, zero cells included."""
    spark = pred.sparkSession
    cells = spark.range(4).select((F.col("id") / 2).cast("int").alias("label"),
                                  (F.col("id") % 2).cast("int").alias("prediction"))
    counts = pred.groupBy(F.col(label).cast("int").alias("label"),
                          F.coalesce(F.col(prediction).cast("int"), F.lit(0)).alias("prediction")).count()
    # four-row dimension table: a broadcast with a fixed size
    return (F.broadcast(cells).join(counts, ["label", "prediction"], "left")
            .select(F.col("label").cast("bigint"), F.col("prediction").cast("bigint"),
                    F.coalesce("count", F.lit(0)).cast("bigint").alias("n")))


def binary_metrics(pred: DataFrame, model: str = "model", label: str = "label",
                   prediction: str = "prediction") -> DataFrame:
    """V2: one row: accuracy, precision, recall, F1 (division by zero -> 0)."""
    y = F.col(label).cast("int")
    p = F.coalesce(F.col(prediction).cast("int"), F.lit(0))
    agg = pred.agg(
        F.count("*").alias("n"),
        F.sum(F.when(y == p, 1).otherwise(0)).alias("correct"),
        F.sum(F.when((y == 1) & (p == 1), 1).otherwise(0)).alias("tp"),
        F.sum(F.when((y == 0) & (p == 1), 1).otherwise(0)).alias("fp"),
        F.sum(F.when((y == 1) & (p == 0), 1).otherwise(0)).alias("fn"),
    )
    prec = F.when(F.col("tp") + F.col("fp") == 0, F.lit(0.0)).otherwise(F.col("tp") / (F.col("tp") + F.col("fp")))
    rec = F.when(F.col("tp") + F.col("fn") == 0, F.lit(0.0)).otherwise(F.col("tp") / (F.col("tp") + F.col("fn")))
    m = agg.select(F.lit(model).alias("model"), F.col("n").cast("bigint").alias("n"),
                   (F.col("correct") / F.col("n")).alias("accuracy"), prec.alias("precision"), rec.alias("recall"))
    f1 = F.when(F.col("precision") + F.col("recall") == 0, F.lit(0.0)).otherwise(
        F.lit(2) * F.col("precision") * F.col("recall") / (F.col("precision") + F.col("recall")))
    return m.select("model", "n", r6(F.col("accuracy")).alias("accuracy"), r6(F.col("precision")).alias("precision"),
                    r6(F.col("recall")).alias("recall"), r6(f1).alias("f1"))


def metrics_long(metrics: DataFrame) -> DataFrame:
    """V6: (model, metric, percent) rows."""
    long = metrics.unpivot(["model"], ["accuracy", "precision", "recall", "f1"], "metric", "value")
    return long.select("model", "metric", r6(F.col("value") * 100).alias("percent"))


def exact_auc(scored: DataFrame, score: str = "score", label: str = "label") -> DataFrame:
    """V3, exact form: Mann-Whitney U with mid-ranks for ties.

    Rows are counted by distinct score (partial counts first); the distinct
    scores are dealt out into equal-depth ranges, however close they lie, and
    each gets the number of rows before it (``ordering``).  Scores are not
    rounded; null and NaN scores take no part."""
    s = F.col(score).cast("double")
    g = scored.groupBy(s.alias("s")).agg(F.count("*").alias("n"), F.sum(F.col(label).cast("long")).alias("pos"))
    # filtered after the write: a filter before it would be pushed below the
    # score's projection and compute the score a second time
    g = materialize(g, "auc-counts").where(F.col("s").isNotNull() & ~F.isnan("s"))
    ranked = before(by_ranges(g, ["s"], "auc-ranges"), "n", "before")
    # mid-rank of the tied block: before + (n + 1) / 2
    sums = ranked.agg(F.sum(F.col("pos") * (F.col("before") + (F.col("n") + 1) / 2.0)).alias("rank_sum"),
                      F.sum("pos").alias("n1"), F.sum("n").alias("n_all"))
    n1, n0 = F.col("n1"), F.col("n_all") - F.col("n1")
    auc = (F.col("rank_sum") - n1 * (n1 + 1) / 2.0) / (n1 * n0)
    return sums.select(r6(F.when((n1 > 0) & (n0 > 0), auc)).alias("auc"),
                       n1.cast("bigint").alias("n_pos"), n0.cast("bigint").alias("n_neg"))


def metrics_with_defaults(spark: SparkSession, metrics: DataFrame | None, keep_all_defaults: bool = False) -> DataFrame:
    """Metrics per model; a value missing from the file is taken from the
    published defaults of that model; with ``keep_all_defaults`` the models
    absent from the file are listed with their defaults as well."""
    from ..functions import lexicons as lx
    names = ("accuracy", "precision", "recall", "f1")
    # fixed four-row defaults table: broadcast of a known size
    defaults = spark.createDataFrame(list(lx.DEFAULT_METRICS),
                                     "model string, accuracy double, precision double, recall double, f1 double")
    if metrics is None:
        return defaults
    m = metrics.select("model", *[F.col(c).cast("double").alias("m_" + c) for c in names])
    how = "full" if keep_all_defaults else "left"
    j = m.join(F.broadcast(defaults), "model", how)
    return j.select("model", *[F.coalesce("m_" + c, c).alias(c) for c in names])
