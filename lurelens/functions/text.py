"""Small column helpers shared by the feature and rule builders.

All helpers take and return ``Column`` objects and use only built-in,
code-generated expressions, so they work on batch and streaming DataFrames
and inside higher-order-function lambdas.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Python's str.split() treats the Unicode White_Space characters and the
# four information separators U+001C..U+001F as blanks; Java's (?U)\s only
# the former, so they are added explicitly.
WS_CLASS = r"[\s\x{1c}-\x{1f}]"
WS_RUN = r"(?U)" + WS_CLASS + "+"
NON_WS_RUN = r"(?U)[^\s\x{1c}-\x{1f}]+"

# ASCII punctuation (Python's string.punctuation), POSIX class in Java.
PUNCT = r"\p{Punct}"
DIGIT = r"\p{Nd}"
UPPER = r"\p{IsUppercase}"


def sql_lit(w: str) -> str:
    """A Spark SQL string literal."""
    return "'" + w.replace("\\", "\\\\").replace("'", "\\'") + "'"


def sql_any(ref: str, words: Iterable[str]) -> str:
    words = list(words)
    return "(" + " OR ".join(f"contains({ref}, {sql_lit(w)})" for w in words) + ")" if words else "false"


def sql_hits(ref: str, words: Iterable[str]) -> str:
    words = list(words)
    return "(" + " + ".join(f"CAST(contains({ref}, {sql_lit(w)}) AS INT)" for w in words) + ")" if words else "0"


def sql_first(ref: str, words: Sequence[str], values: Sequence[str] | None = None) -> str:
    values = list(values) if values is not None else list(words)
    return "CASE " + " ".join(f"WHEN contains({ref}, {sql_lit(w)}) THEN {sql_lit(v)}"
                              for w, v in zip(words, values)) + " END"


# The helpers below take either a Column or, for a column that has been
# staged under a known name, its SQL reference (a str such as "`__u_ul`").
# With a reference the whole word list becomes one SQL expression: one call
# into the JVM instead of a few per word when the plan is built.

def contains_any(s, words: Iterable[str]) -> Column:
    if isinstance(s, str):
        return F.expr(sql_any(s, words))
    out = None
    for w in words:
        c = s.contains(w)
        out = c if out is None else (out | c)
    return F.lit(False) if out is None else out


def hits(s, words: Iterable[str]) -> Column:
    """How many of ``words`` occur in ``s`` (each listed entry counted once)."""
    if isinstance(s, str):
        return F.expr(sql_hits(s, words))
    out = None
    for w in words:
        c = s.contains(w).cast("int")
        out = c if out is None else (out + c)
    return F.lit(0) if out is None else out


def ratio(num: Column, den: Column) -> Column:
    return num.cast("double") / den.cast("double")


def level(score: Column, thresholds, default: str = "SAFE") -> Column:
    out = None
    for t, name in thresholds:
        cond = score >= F.lit(t)
        out = F.when(cond, F.lit(name)) if out is None else out.when(cond, F.lit(name))
    return out.otherwise(F.lit(default))


def words(text: Column) -> Column:
    """``text.split()``: whitespace-separated tokens, empty edges removed."""
    return F.array_remove(F.split(text, WS_RUN), "")


def compact(items: list[Column]) -> Column:
    """ARRAY<STRING> of the non-NULL items in order.

    Built with ``concat`` of 0/1-element arrays instead of ``array_compact``
    (a lambda function), so it stays inside whole-stage code generation."""
    empty = F.array().cast("array<string>")
    parts = [F.when(c.isNotNull(), F.array(c)).otherwise(empty) for c in items]
    return F.concat(*parts) if parts else empty


def r6(c: Column) -> Column:
    """Rounded to six decimals."""
    return F.round(c.cast("double") * F.lit(1000000.0), 0) / F.lit(1000000.0)
