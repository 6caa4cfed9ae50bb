"""The 40 URL features as expressions over the URL's parts (one projection, no UDF).

``url_feature_sql`` gives them in manifest order as SQL text over references to the
parts: staged column names (batch or stream projection) or lambda fields (inside
``transform`` over an array of URLs).
"""

from __future__ import annotations

import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import lexicons as lx
from .manifest import URL_FEATURES
from .text import DIGIT, PUNCT, UPPER, sql_any, sql_hits, sql_lit
from .url_parts import stage_parts


def default_reference_year() -> int:
    return datetime.date.today().year


def entropy(s: Column) -> Column:
    """Shannon entropy in bits over the code points of ``s`` (0.0 if empty).

    Terms are added in order of first appearance of each character."""
    n = F.length(s)
    chars = F.array_distinct(F.split(s, ""))

    def step(acc, c):
        p = (n - F.length(F.replace(s, c, F.lit("")))).cast("double") / n.cast("double")
        return acc - p * F.log2(p)

    return F.when(n == 0, F.lit(0.0)).otherwise(F.aggregate(chars, F.lit(0.0), step))


def with_url_features(df: DataFrame, url_col: str = "url", reference_year: int | None = None,
                      error_col: str | None = "error") -> DataFrame:
    """Appends the 40 feature columns (U1-U40) and, optionally, the parse
    error message column (U43).  Features are NULL for error rows."""
    from .url_rules import url_error
    staged, p, tmp = stage_parts(df, url_col)
    staged = staged.withColumn("__u_err", url_error(p)).withColumn("__u_ent", entropy(p.url))
    sql = url_feature_sql(f"`{url_col}`", "`__u_ul`", "`__u_netloc`", "`__u_path`", "`__u_query`",
                          reference_year, ent="`__u_ent`")
    cols = {k: F.expr(v) for k, v in sql.items()}
    ok = F.col("__u_err").isNull()
    out = {k: F.when(ok, c) for k, c in cols.items()}
    if error_col:
        out[error_col] = F.col("__u_err")
    return staged.withColumns(out).drop(*tmp, "__u_err", "__u_ent")


# One expression per feature as SQL text, instead of a JVM call per word when
# the plan is built.

def _cnt(ref: str, sub: str) -> str:
    n = f"(length({ref}) - length(replace({ref}, {sql_lit(sub)}, '')))"
    return n if len(sub) == 1 else f"CAST({n} / {len(sub)} AS INT)"


def entropy_sql(u: str) -> str:
    p = f"(CAST(length({u}) - length(replace({u}, c, '')) AS DOUBLE) / CAST(length({u}) AS DOUBLE))"
    return (f"CASE WHEN length({u}) = 0 THEN 0.0D ELSE aggregate(array_distinct(split({u}, '')), 0.0D, "
            f"(acc, c) -> acc - {p} * log2({p})) END")


def url_feature_sql(u: str, ul: str, netloc: str, path: str, query: str, reference_year: int | None = None,
                    ent: str | None = None) -> dict[str, str]:
    year = default_reference_year() if reference_year is None else int(reference_year)
    host = f"substring_index({netloc}, ':', 1)"
    hostc = f"substring_index(regexp_replace({netloc}, '^www[.]', ''), ':', 1)"
    sub = f"greatest(size(split({host}, '[.]')) - 2, 0)"
    ent = ent or entropy_sql(u)
    flag = lambda c: f"CAST({c} AS INT)"
    ratio = lambda a, b: f"(CAST({a} AS DOUBLE) / CAST({b} AS DOUBLE))"
    rc = lambda ref, pat: f"regexp_count({ref}, {sql_lit(pat)})"
    f = {
        "url_length": f"length({u})",
        "num_dots": _cnt(u, "."), "num_hyphens": _cnt(u, "-"), "num_at_symbols": _cnt(u, "@"),
        "num_question_marks": _cnt(u, "?"), "num_percent": _cnt(u, "%"), "num_equals": _cnt(u, "="),
        "num_slashes": _cnt(u, "/"),
        "has_https": flag(f"startswith({u}, 'https://')"),
        "has_suspicious_tld": flag(sql_any(ul, lx.SUSPICIOUS_TLDS)),
        "has_ip_address": flag(f"{host} RLIKE {sql_lit(r'^' + DIGIT + '{1,3}\\.' + DIGIT + '{1,3}\\.' + DIGIT + '{1,3}\\.' + DIGIT + '{1,3}$')}"),
        "has_shortening_service": flag(sql_any(ul, lx.URL_SHORTENERS)),
        "num_subdomains": sub,
        "url_entropy": ent,
        "has_port": flag(f"contains({netloc}, ':')"),
        "has_authentication": flag(f"contains({netloc}, '@')"),
        "path_length": f"length({path})",
        "query_length": f"length({query})",
        "digit_url_ratio": ratio(rc(u, DIGIT), f"greatest(length({u}), 1)"),
        "special_char_ratio": ratio(rc(u, PUNCT), f"greatest(length({u}), 1)"),
        "num_redirects": f"greatest({_cnt(u, '//')} - 1, 0)",
        "has_tracking": flag(sql_any(ul, lx.TRACKING_PARAMS)),
        "has_current_year": flag(f"contains({u}, {sql_lit(str(year))})"),
        "has_any_year": flag(sql_any(u, [str(y) for y in range(lx.FIRST_YEAR, year + 1)])),
        "path_depth": rc(path, "[^/]+"),
        "digit_ratio_host": ratio(rc(hostc, DIGIT), f"greatest(length({hostc}), 1)"),
        "hyphens_in_host": _cnt(hostc, "-"),
        "brand_keyword_count": sql_hits(ul, lx.URL_BRAND_KEYWORDS),
        "suspicious_keyword_count": sql_hits(ul, lx.URL_SUSPICIOUS_KEYWORDS),
        "has_uppercase": flag(f"{u} RLIKE {sql_lit(UPPER)}"),
        "num_query_params": f"CASE WHEN length({query}) > 0 THEN {_cnt(query, '&')} + 1 ELSE 0 END",
        "is_common_tld": flag(sql_any(ul, lx.COMMON_TLDS)),
        "has_at_symbol": flag(f"(contains({u}, '@') AND NOT contains({u}, 'mailto:'))"),
        "has_double_dot": flag(f"contains({u}, '..')"),
        "has_encoding": flag(f"contains({u}, '%')"),
        "encoding_count": _cnt(u, "%"),
        "has_excessive_subdomains": flag(f"({sub} > 2)"),
        "homograph_score": f"least(CAST({sql_hits(ul, lx.HOMOGRAPH_CHARS)} AS DOUBLE) / 5.0D, 1.0D)",
        "has_typosquatting": flag(sql_any(ul, lx.TYPOSQUATS)),
        "url_complexity": f"least(({ent}) * length({u}) / 50 / 10, 1.0D)",
    }
    assert tuple(f) == URL_FEATURES
    return f
