"""Email + embedded URL features (C1-C8) as array expressions.

The URLs of one email stay in that email's row: they are extracted into an
array, scored with ``transform`` and reduced with ``aggregate``.  This needs
no shuffle, no join and no streaming state, and one email with very many
URLs is still one row of work; ``operators.large_mails`` deals the URLs of such
mails out over tasks with the same expressions.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import lexicons as lx
from .email_features import URL_IN_TEXT_RE
from .manifest import URL_FEATURES
from .text import sql_any, sql_lit
from .url_features import entropy_sql, url_feature_sql
from .url_parts import bad_netloc_sql, hosts_array_sql, parts_array_sql

# URL extraction for scoring (a different expression from C1).
PUBLIC_URL_RE = r"(?U)https?://[^\s\x{1c}-\x{1f}<>\"{}|\\^`\[\]]+"


def body_urls(body: Column) -> Column:
    """Raw ``https?://\\S+`` matches of the body, duplicates kept, in order."""
    return F.regexp_extract_all(body, F.lit(URL_IN_TEXT_RE), 0)


def public_urls(text: Column) -> Column:
    """URLs for scoring: right-strip ``.,;:!?)>``, keep length > 10,
    distinct, sorted (the original order is not defined)."""
    raw = F.regexp_extract_all(text, F.lit(PUBLIC_URL_RE), 0)
    cleaned = F.transform(raw, lambda u: F.rtrim(u, F.lit(lx.URL_RSTRIP_CHARS)))
    kept = F.filter(cleaned, lambda u: F.length(u) > lx.URL_MIN_LEN_EXCLUSIVE)
    return F.array_sort(F.array_distinct(kept))


def body_hosts(urls_col: str) -> Column:
    """Lower-cased URL and netloc of each URL of an array, parsed once; stage it
    for ``suspicious_hosts`` and ``any_parse_error``."""
    return F.expr(hosts_array_sql(f"`{urls_col}`"))


def suspicious_hosts(hosts_col: str) -> Column:
    """C4 over a column of ``body_hosts``: URLs with a bad TLD or an IP host."""
    ip = sql_lit(r"^\p{Nd}{1,3}\.\p{Nd}{1,3}\.\p{Nd}{1,3}\.\p{Nd}{1,3}$")
    cond = f"{sql_any('h.ul', lx.SUSPICIOUS_TLDS)} OR substring_index(h.netloc, ':', 1) RLIKE {ip}"
    return F.expr(f"size(filter(`{hosts_col}`, h -> {cond}))")


def any_parse_error(hosts_col: str) -> Column:
    """Whether a URL of ``body_hosts`` has a netloc that ``urlparse`` refuses."""
    return F.expr(f"exists(`{hosts_col}`, h -> {bad_netloc_sql('h.netloc')})")


def url_feature_array(urls_col: str, reference_year: int | None = None) -> Column:
    """ARRAY<STRUCT<40 features as DOUBLE>> for the URL array in column
    ``urls_col``: parts and entropy are computed once per URL, then the features
    from them, as one SQL expression."""
    parts = parts_array_sql(f"`{urls_col}`", ent=entropy_sql("p.url"))
    feats = url_feature_sql("s.url", "s.ul", "s.netloc", "s.path", "s.query", reference_year, ent="s.ent")
    body = ", ".join(f"{sql_lit(k)}, CAST({v} AS DOUBLE)" for k, v in feats.items())
    return F.expr(f"transform({parts}, s -> named_struct({body}))")


def url_feature_sums(feats_col: str) -> Column:
    """Struct of the sums of each feature over a feature array, in one pass;
    stage it."""
    zero = ", ".join(f"'{k}', 0.0D" for k in URL_FEATURES)
    add = ", ".join(f"'{k}', acc.{k} + s.{k}" for k in URL_FEATURES)
    return F.expr(f"aggregate(`{feats_col}`, named_struct({zero}), (acc, s) -> named_struct({add}))")


def url_feature_means(sums: Column, n: Column) -> dict[str, Column]:
    """Mean of each feature over ``n`` URLs from their sums, prefixed
    ``url_``; 0.0 when there are none."""
    return {f"url_{k}": F.when(n > 0, sums[k] / n).otherwise(F.lit(0.0)) for k in URL_FEATURES}


def suspicious_features(feats_col: str) -> Column:
    """C4 over a feature array."""
    return F.size(F.filter(feats_col, lambda s: (s["has_suspicious_tld"] == 1) | (s["has_ip_address"] == 1)))
