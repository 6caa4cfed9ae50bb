"""URL components with the splitting rules of Python's ``urlparse``.

Spark's ``parse_url`` is not used: its HOST drops the port and user-info and
it fails on malformed input.  The parts are plain regular expressions over
the URL, so they also run inside ``transform`` lambdas and on streams.

Rules reproduced:
* leading C0 control characters and spaces are ignored, TAB/CR/LF removed
  (for parsing only; length and counts use the raw URL);
* scheme = leading ``[A-Za-z][A-Za-z0-9+.-]*`` before the first ``:``;
* netloc = after ``//`` up to the first ``/``, ``?`` or ``#``;
* path = up to ``?``/``#``; for schemes that use parameters, a ``;...``
  suffix of the last segment is split off;
* query = after the first ``?`` up to ``#``;
* parse errors: a netloc with only one of ``[`` / ``]``, a bracketed host that is
  no IPv6 address (nor ``v<hex>.<any>``), and a character whose compatibility
  form (NFKC) holds one of ``/?#@:``.
"""

from __future__ import annotations

import unicodedata
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .text import sql_lit

SCHEME_RE = r"^([A-Za-z][A-Za-z0-9+.\-]*):"
NETLOC_RE = r"^(?:[A-Za-z][A-Za-z0-9+.\-]*:)?//([^/?#]*)"
PATH_RE = r"^(?:[A-Za-z][A-Za-z0-9+.\-]*:)?(?://[^/?#]*)?([^?#]*)"
QUERY_RE = r"^[^?#]*\?([^#]*)"
PARAMS_RE = r";[^/]*$"
LEADING_JUNK_RE = r"^[\x{00}-\x{20}]+"
UNSAFE_RE = r"[\t\r\n]"


def _ipv6_re() -> str:
    """An IPv6 address: eight groups, or fewer around one ``::``; the last two
    may be an IPv4 address; an optional ``%scope``."""
    h = "[0-9A-Fa-f]{1,4}"
    octet = "(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
    tail = f"(?:{h}:{h}|{octet}(?:\\.{octet}){{3}})"
    forms = [f"(?:{h}:){{6}}{tail}"]
    for right in range(8):               # groups after the "::"
        left = f"(?:{h}(?::{h}){{0,{6 - right}}})?" if right < 7 else ""
        rest = "" if right == 0 else h if right == 1 else f"(?:{h}:){{{right - 2}}}{tail}"
        forms.append(f"{left}::{rest}")
    return f"(?:{'|'.join(forms)})(?:%[^%\\]]+)?"


def _bad_netloc_re() -> str:
    odd = "".join(c for c in map(chr, (*range(0x80, 0xD800), *range(0xE000, 0x30000)))
                  if unicodedata.decomposition(c) and set(unicodedata.normalize("NFKC", c)) & set("/?#@:"))
    host = rf"(?:{_ipv6_re()}|v[0-9A-Fa-f]+\.[^\]]+)(?:\]|\z)"
    return (rf"[{odd}]|^[^\[]*\][^\[]*\z|^[^\]]*\[[^\]]*\z"
            rf"|^(?=[^\]]*\])[^\[]*\[(?!{host})")


#: Found in a netloc that ``urlparse`` refuses.
BAD_NETLOC_RE = _bad_netloc_re()


def bad_netloc_sql(netloc: str) -> str:
    """Whether ``urlparse`` refuses the netloc.  Only one with a bracket or a
    character beyond ASCII can be refused; the pattern is not run on others."""
    return (f"((contains({netloc}, '[') OR contains({netloc}, ']') OR octet_length({netloc}) <> length({netloc})) "
            f"AND {netloc} RLIKE {sql_lit(BAD_NETLOC_RE)})")


def bad_netloc(netloc: Column) -> Column:
    return ((netloc.contains("[") | netloc.contains("]") | (F.octet_length(netloc) != F.length(netloc)))
            & netloc.rlike(BAD_NETLOC_RE))


# FIXED VALUES: schemes whose last path segment may carry ";params".
PARAM_SCHEMES = (
    "", "ftp", "hdl", "prospero", "http", "imap", "https", "shttp", "rtsp",
    "rtsps", "rtspu", "sip", "sips", "mms", "sftp", "tel",
)


@dataclass(frozen=True)
class UrlParts:
    """Column handles for one URL; either inline expressions or staged columns."""

    url: Column
    ul: Column
    netloc: Column
    path: Column
    query: Column
    ul_ref: str | None = None   # SQL references when ``ul`` / ``url`` are
    url_ref: str | None = None  # staged columns with known names

    @property
    def ulx(self):
        """``ul`` for the word-list helpers: the SQL reference if staged."""
        return self.ul_ref or self.ul

    @property
    def host(self) -> Column:
        """netloc up to the first ':' (user-info and port cut the same way)."""
        return F.substring_index(self.netloc, ":", 1)

    @property
    def host_clean(self) -> Column:
        """netloc without a leading 'www.' and without anything after ':'."""
        return F.substring_index(F.regexp_replace(self.netloc, r"^www\.", ""), ":", 1)

    @property
    def parse_error(self) -> Column:
        return bad_netloc(self.netloc)


def _prepared(url: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(url, UNSAFE_RE, ""), LEADING_JUNK_RE, "")


def part_columns(url: Column, prepared: Column | None = None) -> dict[str, Column]:
    """The expressions of every part, keyed by name.  ``prepared``: the URL
    without what parsing ignores, if staged."""
    p = _prepared(url) if prepared is None else prepared
    scheme = F.lower(F.regexp_extract(p, SCHEME_RE, 1))
    raw_path = F.regexp_extract(p, PATH_RE, 1)
    path = F.when(scheme.isin(*PARAM_SCHEMES), F.regexp_replace(raw_path, PARAMS_RE, "")).otherwise(raw_path)
    return {
        "url": url,
        "ul": F.lower(url),
        "netloc": F.regexp_extract(p, NETLOC_RE, 1),
        "path": path,
        "query": F.regexp_extract(p, QUERY_RE, 1),
    }


def inline_parts(url: Column) -> UrlParts:
    return UrlParts(**part_columns(url))


def parts_array_sql(urls: str, **more: str) -> str:
    """Structs (url, ul, netloc, path, query) of the URLs of an array, as SQL:
    each URL is cleaned and parsed once, in two steps.  ``more``: further fields
    by name, over ``p.url``."""
    clean = f"regexp_replace(regexp_replace(u, {sql_lit(UNSAFE_RE)}, ''), {sql_lit(LEADING_JUNK_RE)}, '')"
    scheme = f"lower(regexp_extract(p.clean, {sql_lit(SCHEME_RE)}, 1))"
    raw_path = f"regexp_extract(p.clean, {sql_lit(PATH_RE)}, 1)"
    schemes = ", ".join(sql_lit(x) for x in PARAM_SCHEMES)
    path = f"CASE WHEN {scheme} IN ({schemes}) THEN regexp_replace({raw_path}, {sql_lit(PARAMS_RE)}, '') ELSE {raw_path} END"
    fields = {"url": "p.url", "ul": "p.ul", "netloc": f"regexp_extract(p.clean, {sql_lit(NETLOC_RE)}, 1)", "path": path,
              "query": f"regexp_extract(p.clean, {sql_lit(QUERY_RE)}, 1)", **more}
    return (f"transform(transform({urls}, u -> named_struct('url', u, 'ul', lower(u), 'clean', {clean})), "
            f"p -> named_struct({', '.join(f'{sql_lit(k)}, {v}' for k, v in fields.items())}))")


def hosts_array_sql(urls: str) -> str:
    """Structs (ul, netloc) of the URLs of an array, as SQL."""
    clean = f"regexp_replace(regexp_replace(u, {sql_lit(UNSAFE_RE)}, ''), {sql_lit(LEADING_JUNK_RE)}, '')"
    return f"transform({urls}, u -> named_struct('ul', lower(u), 'netloc', regexp_extract({clean}, {sql_lit(NETLOC_RE)}, 1)))"


STAGE_PREFIX = "__u_"


def stage_parts(df: DataFrame, url_col: str) -> tuple[DataFrame, UrlParts, list[str]]:
    """Adds the parts as columns once (a separate projection), returns handles."""
    clean = STAGE_PREFIX + "clean"
    cols = {STAGE_PREFIX + k: c for k, c in part_columns(F.col(url_col), F.col(clean)).items() if k != "url"}
    staged = df.withColumn(clean, _prepared(F.col(url_col))).withColumns(cols).drop(clean)
    handles = UrlParts(url=F.col(url_col), **{k[len(STAGE_PREFIX):]: F.col(k) for k in cols},
                       ul_ref=f"`{STAGE_PREFIX}ul`", url_ref=f"`{url_col}`")
    return staged, handles, list(cols)
