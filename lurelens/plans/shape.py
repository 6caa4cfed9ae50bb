"""Output shaping shared by the registered queries (Spark side).

Registered queries return plain comparable columns: integers as BIGINT,
doubles rounded to 6 decimals (``round(x * 1e6) / 1e6``, the same formula as
the oracle), arrays of reasons joined with `` | ``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import r6


def joined(arr: Column, sep: str = " | ") -> Column:
    return F.coalesce(F.array_join(arr, sep), F.lit(""))


def normalize(df: DataFrame) -> DataFrame:
    """BIGINT for integral/boolean columns, rounded DOUBLE for fractional ones."""
    cols = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, (T.IntegerType, T.ShortType, T.ByteType, T.BooleanType)):
            c = c.cast("bigint")
        elif isinstance(f.dataType, (T.DoubleType, T.FloatType, T.DecimalType)):
            c = r6(c)
        cols.append(c.alias(f.name))
    return df.select(*cols)
