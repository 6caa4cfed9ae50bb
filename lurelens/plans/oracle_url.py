"""Oracle SQL (DuckDB) for URL parts, features and rules."""

from __future__ import annotations

from ..functions import lexicons as lx
from ..functions.manifest import URL_DOUBLE_FEATURES, URL_FEATURES
from . import sqlgen as g

PUNCT_RE = r"[!-/:-@\[-`{-~]"
IP_HOST_RE = r"^\p{Nd}{1,3}\.\p{Nd}{1,3}\.\p{Nd}{1,3}\.\p{Nd}{1,3}$"


NETLOC_OF_LINK = "^[hH][tT][tT][pP][sS]?://([^/?#]*)"    # links found in texts start with http:// or https://
#: Schemes whose last path segment may carry ";params".
PARAM_SCHEMES = "ftp hdl prospero http imap https shttp rtsp rtsps rtspu sip sips mms sftp tel".split()


def parts_select(src: str, url: str = "url") -> str:
    """SELECT * plus _p (parse text), _netloc, _path, _query, _ul, _host, _hostc:
    the scheme is cut off first, then the part from a hash sign on, then the
    query, and what is left is netloc and path."""
    schemes = ", ".join(g.q(s) for s in ["", *PARAM_SCHEMES])
    s1 = f"SELECT *, ltrim(translate({url}, chr(9) || chr(10) || chr(13), ''), (SELECT string_agg(chr(CAST(i AS INT)), '') FROM range(1, 33) t(i))) AS _p FROM ({src}) s0"
    s2 = (f"SELECT *, CASE WHEN regexp_matches(_p, '^[a-zA-Z][-a-zA-Z0-9+.]*:') THEN split_part(_p, ':', 1) ELSE '' END AS _scheme FROM ({s1}) s1")
    s3 = "SELECT *, split_part(CASE WHEN _scheme = '' THEN _p ELSE substring(_p, length(_scheme) + 2) END, '#', 1) AS _rest FROM (" + s2 + ") s2"
    s4 = ("SELECT *, split_part(_rest, '?', 1) AS _main, CASE WHEN contains(_rest, '?') THEN substring(_rest, length(split_part(_rest, '?', 1)) + 2) "
          f"ELSE '' END AS _query FROM ({s3}) s3")
    s5 = f"SELECT *, CASE WHEN starts_with(_main, '//') THEN split_part(substring(_main, 3), '/', 1) ELSE '' END AS _netloc FROM ({s4}) s4"
    s6 = f"SELECT *, CASE WHEN starts_with(_main, '//') THEN substring(_main, 3 + length(_netloc)) ELSE _main END AS _whole FROM ({s5}) s5"
    s7 = (f"SELECT *, CASE WHEN lower(_scheme) IN ({schemes}) THEN regexp_replace(_whole, ';[^/]*$', '') ELSE _whole END AS _path, "
          f"lower({url}) AS _ul, split_part(_netloc, ':', 1) AS _host FROM ({s6}) s6")
    return f"SELECT *, CASE WHEN starts_with(_netloc, 'www.') THEN split_part(substring(_netloc, 5), ':', 1) ELSE _host END AS _hostc FROM ({s7}) s7"


def entropy_sql(u: str) -> str:
    return (f"CASE WHEN length({u}) = 0 THEN 0.0::DOUBLE ELSE -list_sum(list_transform("
            f"map_values(list_histogram(string_split({u}, ''))), "
            f"lambda c: (c::DOUBLE / length({u})) * log2(c::DOUBLE / length({u})))) END")


def feature_exprs(u: str = "url", year: int = 2024) -> dict[str, str]:
    ul, net, path, query, host, hostc = "_ul", "_netloc", "_path", "_query", "_host", "_hostc"
    subd = f"greatest(len(string_split({host}, '.')) - 2, 0)"
    ent = entropy_sql(u)
    f = {
        "url_length": f"length({u})",
        "num_dots": g.count(u, "."),
        "num_hyphens": g.count(u, "-"),
        "num_at_symbols": g.count(u, "@"),
        "num_question_marks": g.count(u, "?"),
        "num_percent": g.count(u, "%"),
        "num_equals": g.count(u, "="),
        "num_slashes": g.count(u, "/"),
        "has_https": f"starts_with({u}, 'https://')::INT",
        "has_suspicious_tld": f"{g.any_of(ul, lx.SUSPICIOUS_TLDS)}::INT",
        "has_ip_address": f"regexp_matches({host}, {g.q(IP_HOST_RE)})::INT",
        "has_shortening_service": f"{g.any_of(ul, lx.URL_SHORTENERS)}::INT",
        "num_subdomains": subd,
        "url_entropy": ent,
        "has_port": f"contains({net}, ':')::INT",
        "has_authentication": f"contains({net}, '@')::INT",
        "path_length": f"length({path})",
        "query_length": f"length({query})",
        "digit_url_ratio": f"{g.rcount(u, chr(92) + 'p{Nd}')}::DOUBLE / greatest(length({u}), 1)",
        "special_char_ratio": f"{g.rcount(u, PUNCT_RE)}::DOUBLE / greatest(length({u}), 1)",
        "num_redirects": f"greatest({g.count(u, '//')} - 1, 0)",
        "has_tracking": f"{g.any_of(ul, lx.TRACKING_PARAMS)}::INT",
        "has_current_year": f"contains({u}, {g.q(str(year))})::INT",
        "has_any_year": f"{g.any_of(u, [str(y) for y in range(lx.FIRST_YEAR, year + 1)])}::INT",
        "path_depth": g.rcount(path, "[^/]+"),
        "digit_ratio_host": f"{g.rcount(hostc, chr(92) + 'p{Nd}')}::DOUBLE / greatest(length({hostc}), 1)",
        "hyphens_in_host": g.count(hostc, "-"),
        "brand_keyword_count": g.hits(ul, lx.URL_BRAND_KEYWORDS),
        "suspicious_keyword_count": g.hits(ul, lx.URL_SUSPICIOUS_KEYWORDS),
        "has_uppercase": f"regexp_matches({u}, '\\p{{Lu}}')::INT",
        "num_query_params": f"CASE WHEN length({query}) > 0 THEN {g.count(query, '&')} + 1 ELSE 0 END",
        "is_common_tld": f"{g.any_of(ul, lx.COMMON_TLDS)}::INT",
        "has_at_symbol": f"(contains({u}, '@') AND NOT contains({u}, 'mailto:'))::INT",
        "has_double_dot": f"contains({u}, '..')::INT",
        "has_encoding": f"contains({u}, '%')::INT",
        "encoding_count": g.count(u, "%"),
        "has_excessive_subdomains": f"({subd} > 2)::INT",
        "homograph_score": f"least({g.hits(ul, lx.HOMOGRAPH_CHARS)}::DOUBLE / 5.0, 1.0)",
        "has_typosquatting": f"{g.any_of(ul, lx.TYPOSQUATS)}::INT",
        "url_complexity": f"least(({ent}) * length({u}) / 50 / 10, 1.0)",
    }
    assert tuple(f) == URL_FEATURES
    return f


def out_feature(name: str, expr: str) -> str:
    """Output typing shared with the Spark side: DOUBLE rounded, else BIGINT."""
    if name in URL_DOUBLE_FEATURES:
        return f"{g.r6(expr)} AS {name}"
    return f"CAST({expr} AS BIGINT) AS {name}"


def bad_netloc(n: str) -> str:
    """Netlocs that cannot be parsed: one bracket only, a bracketed host other
    than a shortened IPv6 address (the only kind that is planted), or a character
    that stands for ``/?#@:``."""
    host = f"regexp_extract({n}, '\\[([^\\]]*)', 1)"
    return (f"(contains({n}, '[') <> contains({n}, ']') OR (contains({n}, '[') AND NOT "
            f"regexp_matches({host}, '^[0-9A-Fa-f:]*::[0-9A-Fa-f:]*$')) OR regexp_matches({n}, '[℀℁℅℆／？＃＠：]'))")


def url_features_query(id_cols: str = "page_id, url", year: int = 2024, only: list[str] | None = None) -> str:
    f = feature_exprs("url", year)
    names = only or list(URL_FEATURES)
    cols = ", ".join(out_feature(n, f[n]) for n in names)
    err = (f"CASE WHEN url IS NULL OR url = '' THEN {g.q(lx.MSG['invalid_url'])} "
           f"WHEN {bad_netloc('_netloc')} "
           f"THEN {g.q(lx.MSG['url_error'].format(lx.MSG['parse_error']))} END")
    extra = "" if only else f", {err} AS error"
    return f"SELECT {id_cols}, {cols}{extra} FROM ({parts_select(g.url_corpus_sql())}) t"


# ------------------------------------------------------------------ rules

def rule_exprs(u: str = "url") -> dict[str, str]:
    ul = "_ul"
    brand_case = "CASE " + " ".join(
        f"WHEN {g.any_of(ul, pats)} THEN CASE WHEN {g.any_of(ul, lx.BRAND_LEGIT_DOMAINS.get(b, ()))} THEN '' ELSE {g.q(b)} END"
        for b, pats in lx.BRAND_PATTERNS) + " ELSE '' END"
    hosting = g.first(ul, lx.FREE_HOSTING_SITES)
    hbrand = g.first(ul, lx.FREE_HOSTING_BRANDS, [w.title() for w in lx.FREE_HOSTING_BRANDS])
    label = f"split_part(split_part({ul}, '://', 2), '.', 1)"
    has_sep = f"contains({ul}, '://')"
    return {
        "brand": brand_case,
        "hosting": hosting,
        "hosting_brand": f"CASE WHEN ({hosting}) IS NOT NULL THEN {hbrand} END",
        "long_sub": f"(({hosting}) IS NOT NULL AND {has_sep} AND length({label}) > 12)",
        "num_sub": f"(({hosting}) IS NOT NULL AND {has_sep} AND regexp_matches({label}, '\\p{{Nd}}') AND length({label}) > 8)",
        "ip": f"regexp_matches({u}, 'https?://\\p{{Nd}}{{1,3}}\\.\\p{{Nd}}{{1,3}}\\.\\p{{Nd}}{{1,3}}\\.\\p{{Nd}}{{1,3}}')",
        "subcount": f"({g.count(ul, '.')} - {g.count(ul, '://')} - 1)",
        "tld": g.first(ul, lx.SUSPICIOUS_TLDS),
        "at": f"(contains({u}, '@') AND NOT contains({u}, 'mailto:'))",
        "short": g.first(ul, lx.RULE_SHORTENERS),
        "nohttps": f"(NOT starts_with({u}, 'https://') AND {g.any_of(ul, lx.SENSITIVE_KEYWORDS)})",
    }


def rules_select(src_with_parts: str, u: str = "url") -> str:
    """SELECT * plus r_* rule columns, _score (uncapped), _patterns list, _reasons list."""
    r = rule_exprs(u)
    inner = "SELECT *, " + ", ".join(f"{v} AS r_{k}" for k, v in r.items()) + f" FROM ({src_with_parts}) a"
    W = lx.URL_WEIGHTS
    pre = lx.MSG["pattern_prefix"]
    pats = [
        ("r_ip", g.q(lx.MSG["ip"])),
        ("r_subcount > 3", g.fmt(lx.MSG["subdomains"], "r_subcount")),
        ("r_tld IS NOT NULL", g.fmt(lx.MSG["tld"], "r_tld")),
        ("r_at", g.q(lx.MSG["at"])),
        ("r_short IS NOT NULL", g.fmt(lx.MSG["shortener"], "r_short")),
    ]
    scored = [
        ("r_brand <> ''", W["brand"], g.fmt(lx.MSG["brand"], "r_brand")),
        ("(r_hosting IS NOT NULL AND r_hosting_brand IS NOT NULL)", W["free_hosting_brand"],
         g.fmt(lx.MSG["free_hosting_brand"], "r_hosting_brand", "r_hosting")),
        ("r_long_sub", W["long_subdomain"], g.q(lx.MSG["long_subdomain"])),
        ("r_num_sub", W["numeric_subdomain"], g.q(lx.MSG["numeric_subdomain"])),
    ] + [(c, W["pattern"], f"concat({g.q(pre)}, {m})") for c, m in pats] + [
        ("r_nohttps", W["no_https_sensitive"], g.q(lx.MSG["no_https"]))]
    score = "0.0::DOUBLE"
    for c, inc, _ in scored:
        score = f"({score} + CASE WHEN coalesce({c}, FALSE) THEN {g.dbl(inc)} ELSE 0.0::DOUBLE END)"
    reasons = "[" + ", ".join(f"CASE WHEN coalesce({c}, FALSE) THEN {m} END" for c, _, m in scored) + "]"
    patterns = "[" + ", ".join(f"CASE WHEN coalesce({c}, FALSE) THEN {m} END" for c, m in pats) + "]"
    return (f"SELECT *, {score} AS _score, list_filter({reasons}, lambda x: x IS NOT NULL) AS _reasons, "
            f"list_filter({patterns}, lambda x: x IS NOT NULL) AS _patterns FROM ({inner}) b")


def scored_urls_select(src: str, u: str = "url") -> str:
    """SELECT * plus risk_score (capped), risk_level, reasons (list, first 8);
    NULL / empty / unparsable URLs give ERROR rows."""
    rs = rules_select(parts_select(src, u), u)
    err = (f"CASE WHEN {u} IS NULL OR {u} = '' THEN {g.q(lx.MSG['invalid_url'])} "
           f"WHEN {bad_netloc('_netloc')} "
           f"THEN {g.q(lx.MSG['url_error'].format(lx.MSG['parse_error']))} END")
    return (f"SELECT *, CASE WHEN _err IS NULL THEN least(_score, 1.0) ELSE 0.0 END AS risk_score, "
            f"CASE WHEN _err IS NULL THEN {g.level('least(_score, 1.0)', lx.URL_LEVELS)} ELSE 'ERROR' END AS risk_level, "
            f"CASE WHEN _err IS NULL THEN _reasons[1:{lx.MAX_REASONS}] ELSE [_err] END AS risk_factors "
            f"FROM (SELECT *, {err} AS _err FROM ({rs}) c0) c")
