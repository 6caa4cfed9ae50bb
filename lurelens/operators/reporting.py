"""Reporting tables behind the user interface (V7-V13), as DataFrame transforms."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import lexicons as lx
from ..functions.text import level


def pct2(x: Column) -> Column:
    """``f"{x:.2%}"``."""
    return F.format_string("%.2f%%", x * F.lit(100.0))


def batch_table(scored: DataFrame, url_col: str = "url", id_cols=()) -> DataFrame:
    """V7: URL cut to 60 characters + '...', level, score as percent text,
    number of reasons."""
    u = F.col(url_col)
    display = F.when(F.length(u) > 60, F.concat(F.substring(u, 1, 60), F.lit("..."))).otherwise(u)
    return scored.select(*id_cols, display.alias("url_display"), "risk_level",
                         pct2(F.col("risk_score")).alias("risk_pct"),
                         F.size("risk_factors").cast("bigint").alias("issues"))


def severity(reason: Column) -> Column:
    up = F.upper(reason)
    return F.when(up.contains("🚨") | up.contains("CRITICAL"), F.lit("HIGH")).otherwise(F.lit("MEDIUM"))


def reason_severity(scored: DataFrame, id_cols=(), factors_col: str = "risk_factors") -> DataFrame:
    """V9: one row per reason, numbered from 1, with its severity."""
    # outer form + filter on the generated column: the same rows, without the
    # inferred size(array) > 0 filter that would be pushed below the scoring
    ex = scored.select(*id_cols, F.posexplode_outer(factors_col).alias("pos0", "reason")).where(
        F.col("reason").isNotNull())
    return ex.select(*id_cols, (F.col("pos0") + 1).cast("bigint").alias("pos"), "reason",
                     severity(F.col("reason")).alias("severity"))


def display_level(score: Column) -> Column:
    """Level text by the display thresholds."""
    return level(score, lx.DISPLAY_LEVELS)


def first_reasons(url_analyses: Column, n: int = 3) -> Column:
    """The first ``n`` reasons of each embedded URL analysis."""
    return F.transform(url_analyses, lambda a: F.struct(a["url"].alias("url"), a["risk_level"].alias("risk_level"),
                                                        a["risk_score"].alias("risk_score"),
                                                        F.slice(a["risk_factors"], 1, n).alias("top_factors")))


def ml_status(pred: Column) -> Column:
    """V12: 'Phishing' / 'Legitimate' / 'N/A'."""
    return F.when(pred == 1, F.lit("Phishing")).when(pred.isNotNull(), F.lit("Legitimate")).otherwise(F.lit("N/A"))


def model_label(label: Column, key: Column) -> Column:
    """Display label + ' (URL)' when the model key names URLs, else ' (Email)'."""
    return F.concat(label, F.when(key.contains("url"), F.lit(" (URL)")).otherwise(F.lit(" (Email)")))


def feature_rows(df: DataFrame, id_cols, features) -> DataFrame:
    """V8: (feature, value) rows of each result."""
    pairs = F.array(*[F.struct(F.lit(f).alias("feature"), F.col(f).cast("double").alias("value")) for f in features])
    return df.select(*id_cols, F.inline(pairs))
