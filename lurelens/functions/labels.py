"""Label normalisation (L1, L3, L4, L5) as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import lexicons as lx


# white space that a label is stripped of: blanks of any script, separators and
# control blanks
_BLANK = r"[\s\x{85}\x{1c}-\x{1f}\p{Z}]"
# a number as text: no type suffixes, no hexadecimal digits
_NUMBER = r"^[+-]?([0-9]+(_[0-9]+)*\.?([0-9]+(_[0-9]+)*)?|\.[0-9]+(_[0-9]+)*)([eE][+-]?[0-9]+(_[0-9]+)*)?$"


def _number(s: Column) -> tuple[Column, Column]:
    """The number that a stripped text holds, and whether it is finite."""
    d = F.when(s.rlike(_NUMBER), F.replace(s, F.lit("_"), F.lit("")).try_cast("double"))
    return d, F.coalesce(d.isNotNull() & (F.abs(d) < F.lit(float(2 ** 62))), F.lit(False))


def _numeric_or_zero(s: Column) -> Column:
    """``int(float(s))`` with any failure (text, NaN, inf, NULL) -> 0."""
    d, finite = _number(s)
    return F.when(finite, d.cast("long")).otherwise(F.lit(0).cast("long"))


def _norm_text(c: Column) -> Column:
    return F.lower(F.regexp_replace(c.cast("string"), f"^{_BLANK}+|{_BLANK}+$", ""))


def url_binary_label(c: Column) -> Column:
    """L1: benign words -> 0, malicious words -> 1, else the number, else 0."""
    s = _norm_text(c)
    return (F.when(s.isin(*lx.URL_BENIGN_LABELS), F.lit(0))
            .when(s.isin(*lx.URL_MALICIOUS_LABELS), F.lit(1))
            .otherwise(_numeric_or_zero(s)))


def email_label(c: Column) -> Column:
    """L3: 9 phishing words -> 1, 8 legitimate words -> 0, else the number,
    NULL or anything else -> 0."""
    s = _norm_text(c)
    return (F.when(s.isin(*lx.EMAIL_PHISHING_LABELS), F.lit(1))
            .when(s.isin(*lx.EMAIL_LEGIT_LABELS), F.lit(0))
            .otherwise(_numeric_or_zero(s)))


def raw_url_label(c: Column, numeric: bool) -> Column:
    """L4: text labels in 6 words -> 1 else 0 (lower-cased, not trimmed);
    numeric labels -> int, NULL -> 0."""
    if numeric:
        # NaN, infinite and out-of-range numbers count as 0
        return F.coalesce(c.cast("double").try_cast("int"), F.lit(0))
    return F.when(F.lower(c).isin(*lx.RAW_URL_PHISHING_LABELS), F.lit(1)).otherwise(F.lit(0))


def strict_binary_label(c: Column) -> Column:
    """Benign words -> 0, everything else (NULL included) -> 1."""
    return F.when(F.coalesce(_norm_text(c).isin(*lx.URL_BENIGN_LABELS), F.lit(False)), F.lit(0)).otherwise(F.lit(1))


def label_rule(c: Column, vocab: str = "email") -> Column:
    """Which rule decided the label: 'word', 'number' or 'fallback'."""
    s = _norm_text(c)
    words = (lx.EMAIL_PHISHING_LABELS + lx.EMAIL_LEGIT_LABELS) if vocab == "email" else (
        lx.URL_BENIGN_LABELS + lx.URL_MALICIOUS_LABELS)
    _, finite = _number(s)
    return (F.when(F.coalesce(s.isin(*words), F.lit(False)), F.lit("word"))
            .when(finite, F.lit("number")).otherwise(F.lit("fallback")))
