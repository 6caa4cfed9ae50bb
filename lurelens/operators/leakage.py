"""Leakage diagnosis.

T1/T2 need, per numeric column, the sets of values seen in class 0 and in
class 1.  The plan unpivots to (column, value, label), reduces to distinct
(column, value) with two flags (partial aggregation runs before the shuffle,
so one hot value costs one row per partition), then aggregates per column.
No value set is ever collected.  Where only the leaking columns are asked for
(T4), ``separating_columns`` settles most of them without that shuffle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import lexicons as lx


def numeric_columns(df: DataFrame, label: str) -> list[str]:
    return [f.name for f in df.schema.fields
            if f.name != label and isinstance(f.dataType, T.NumericType)]


def _long(df: DataFrame, label: str, cols: list[str]) -> DataFrame:
    """__y, feature, value of every value that counts."""
    return df.select(F.col(label).cast("int").alias("__y"), *[F.col(f"`{c}`").cast("double").alias(c) for c in cols]).unpivot(
        "__y", cols, "feature", "value").where(F.col("value").isNotNull() & ~F.isnan("value") & F.col("__y").isin(0, 1))


def separation_report(df: DataFrame, label: str = "label", columns=None) -> DataFrame:
    """T1 + T2: per column the number of distinct values in each class, the
    number shared, ``separates`` (both non-empty, none shared) and
    ``constant_per_class`` (one value per class, shared)."""
    cols = list(columns) if columns is not None else numeric_columns(df, label)
    if not cols:
        raise ValueError("no numeric feature columns")
    long = _long(df, label, cols)
    per_value = long.groupBy("feature", "value").agg(
        F.max((F.col("__y") == 0).cast("int")).alias("in0"),
        F.max((F.col("__y") == 1).cast("int")).alias("in1"))
    rep = per_value.groupBy("feature").agg(
        F.sum("in0").cast("bigint").alias("n_values_0"),
        F.sum("in1").cast("bigint").alias("n_values_1"),
        F.sum(F.col("in0") * F.col("in1")).cast("bigint").alias("n_shared"))
    return rep.select(
        "feature", "n_values_0", "n_values_1", "n_shared",
        ((F.col("n_values_0") > 0) & (F.col("n_values_1") > 0) & (F.col("n_shared") == 0)).alias("separates"),
        ((F.col("n_values_0") == 1) & (F.col("n_values_1") == 1) & (F.col("n_shared") == 1)).alias("constant_per_class"))


WITNESSES = 4


def separating_columns(df: DataFrame, label: str = "label", columns=None) -> list[str]:
    """T1 alone: the columns whose values tell the classes apart.

    One pass without a shuffle of values takes, per column and class, the
    smallest and largest value and ``WITNESSES`` values of smallest hash (a
    MinHash of the class's values that keeps the values).  Disjoint ranges
    separate; a witness that both classes have is a shared value, so the column
    does not.  Only columns that this leaves open go through the exact distinct
    values of ``separation_report``."""
    cols = list(columns) if columns is not None else numeric_columns(df, label)
    long = _long(df, label, cols)
    marks = [F.min_by("value", F.xxhash64("value", F.lit(i))).alias(f"w{i}") for i in range(WITNESSES)]
    rows = long.groupBy("feature", "__y").agg(F.min("value").alias("lo"), F.max("value").alias("hi"), *marks).collect()  # two a column
    side = {(r["feature"], r["__y"]): r for r in rows}
    out, open_ = [], []
    for c in cols:
        a, b = side.get((c, 0)), side.get((c, 1))
        if a is None or b is None:
            continue
        if a["hi"] < b["lo"] or b["hi"] < a["lo"]:
            out.append(c)
        elif not any(a[f"w{i}"] == b[f"w{i}"] for i in range(WITNESSES)) and not {a["lo"], a["hi"]} & {b["lo"], b["hi"]}:
            open_.append(c)
    if open_:
        exact = separation_report(df, label, open_).where("separates").select("feature").collect()
        out += [r["feature"] for r in exact]
    return [c for c in cols if c in set(out)]


def suspicious_name_columns(columns, label: str = "label") -> list[str]:
    """Columns whose lower-case name contains a leak keyword."""
    return [c for c in columns if c != label and any(k in c.lower() for k in lx.LEAK_NAME_KEYWORDS)]


def leaking_features(df: DataFrame, label: str = "label", columns=None) -> DataFrame:
    """T4: features to drop = perfectly separating (T1) or suspicious name."""
    spark = df.sparkSession
    by_data = spark.createDataFrame([(c, "perfect_separation") for c in separating_columns(df, label, columns)], "feature string, reason string")
    names = suspicious_name_columns([c for c in df.columns], label)
    by_name = spark.createDataFrame([(n, "suspicious_name") for n in names], "feature string, reason string")
    both = by_data.unionByName(by_name)
    return both.groupBy("feature").agg(F.array_join(F.array_sort(F.collect_set("reason")), ",").alias("reasons"))


def drop_leaking(df: DataFrame, label: str = "label", columns=None) -> DataFrame:
    """T4 applied: the table without the leaking feature columns.  The leak
    list is a small result (one row per column) read back to the driver."""
    leaks = [r["feature"] for r in leaking_features(df, label, columns).collect()]
    return df.drop(*leaks)
