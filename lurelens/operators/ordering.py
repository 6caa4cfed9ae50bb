"""Order over all rows without a task that holds them all.

``by_ranges`` deals rows out into equal-depth ranges of their order (Spark takes
the bounds from a sample), sorted inside, and writes them once; ``before`` and
``place`` add the sum or the number of rows that come earlier, from totals per
range (one row a range) and a running sum inside the range.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialize

RANGE, ROW = "__range", "__row"


def by_ranges(df: DataFrame, order: list, name: str, ranges: int | None = None) -> DataFrame:
    """``df`` with ``__range`` and ``__row`` (the row's place in its range), in
    ranges of the expressions ``order``.  Rows of equal order share a range."""
    n = ranges or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    r = df.repartitionByRange(n, *order).sortWithinPartitions(*order)
    # the lower 33 bits of the id count the rows of the partition
    return materialize(r.withColumns({RANGE: F.spark_partition_id(), ROW: F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)}), name)


def _with_offsets(r: DataFrame, per_range: Column) -> DataFrame:
    w = Window.orderBy(RANGE).rowsBetween(Window.unboundedPreceding, -1)          # one row a range
    first = r.groupBy(RANGE).agg(per_range.alias("__n")).select(RANGE, F.coalesce(F.sum("__n").over(w), F.lit(0)).alias("__offset"))
    return r.join(first, RANGE)


def place(r: DataFrame, out: str) -> DataFrame:
    """``by_ranges`` rows with ``out``: their place in the order, from 0."""
    return _with_offsets(r, F.count("*")).withColumn(out, F.col("__offset") + F.col(ROW)).drop(RANGE, ROW, "__offset")


def before(r: DataFrame, value: str, out: str) -> DataFrame:
    """``by_ranges`` rows with ``out``: the sum of ``value`` over earlier rows."""
    w = Window.partitionBy(RANGE).orderBy(ROW).rowsBetween(Window.unboundedPreceding, -1)
    inside = F.coalesce(F.sum(value).over(w), F.lit(0))
    return (_with_offsets(r, F.sum(value)).withColumn("__inside", inside).withColumn(out, F.col("__offset") + F.col("__inside"))
            .drop(RANGE, ROW, "__offset", "__inside"))


def file_order(df: DataFrame) -> Column:
    """The place of a row of a file source as a struct that sorts as the files
    are read: path, start of the block, row.  The order does not depend on how
    files are split over tasks."""
    m = df["_metadata"]
    return F.struct(m["file_path"].alias("file"), m["file_block_start"].alias("block"), F.monotonically_increasing_id().alias("row"))
