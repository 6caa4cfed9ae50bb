"""DuckDB SQL text for the correctness oracle.

The oracle is an independent second formulation of every query in plain SQL
(DuckDB dialect) over the same parquet tables.  These helpers only build SQL
strings from the fixed word lists; nothing here runs inside Spark.
"""

from __future__ import annotations

from ..sources import corpora as cp


def q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def dbl(x: float) -> str:
    return f"{float(x)!r}::DOUBLE"


def count(e: str, sub: str) -> str:
    n = f"(length({e}) - length(replace({e}, {q(sub)}, '')))"
    return n if len(sub) == 1 else f"({n} // {len(sub)})"


def any_of(e: str, words) -> str:
    words = list(words)
    if not words:
        return "FALSE"
    return "(" + " OR ".join(f"contains({e}, {q(w)})" for w in words) + ")"


def hits(e: str, words) -> str:
    return "(" + " + ".join(f"contains({e}, {q(w)})::INT" for w in words) + ")"


def first(e: str, words, values=None) -> str:
    values = list(values) if values is not None else list(words)
    return "CASE " + " ".join(f"WHEN contains({e}, {q(w)}) THEN {q(v)}" for w, v in zip(words, values)) + " END"


def rcount(e: str, pat: str) -> str:
    return f"len(regexp_extract_all({e}, {q(pat)}))"


def r6(e: str) -> str:
    return f"(round(({e}) * 1000000.0) / 1000000.0)"


def fmt(template: str, *exprs: str) -> str:
    pieces = template.split("{}")
    out = []
    for i, p in enumerate(pieces):
        if p:
            out.append(q(p))
        if i < len(exprs):
            out.append(f"CAST({exprs[i]} AS VARCHAR)")
    return "concat(" + ", ".join(out) + ")"


def level(e: str, thresholds, default="SAFE") -> str:
    return "CASE " + " ".join(f"WHEN {e} >= {dbl(t)} THEN {q(n)}" for t, n in thresholds) + f" ELSE {q(default)} END"


def join_list(items: list[str], n: int | None = None) -> str:
    """Non-NULL items in order (first n) joined with ' | ' ('' when none)."""
    lst = "list_filter([" + ", ".join(items) + "], lambda x: x IS NOT NULL)"
    if n is not None:
        lst = f"({lst})[1:{n}]"
    return f"coalesce(array_to_string({lst}, ' | '), '')"


def case_map(key: str, mapping: dict, default: str) -> str:
    return "CASE " + " ".join(f"WHEN {key} = {k} THEN {v}" for k, v in mapping.items()) + f" ELSE {default} END"


# ------------------------------------------------------------------ corpora

def url_corpus_sql() -> str:
    hosts = {k: f"concat({q(h)}, tail)" for k, h in cp.URL_VARIANT_HOSTS.items()}
    hosts[0] = "url"
    hosts[2] = "concat('http://192.168.7.', CAST(page_id % 256 AS VARCHAR), ':8080', tail)"
    hosts[10] = "concat('https://login.coinbase.com', tail, '&token=abc')"
    default = "concat('http://netflix-billing-update.xyz', tail, ';v=1')"
    phish = ",".join(str(v) for v in cp.URL_PHISHING_VARIANTS)
    return (
        "SELECT page_id, page_id % 12 AS variant, "
        + case_map("page_id % 12", dict(sorted(hosts.items())), default) + " AS url, "
        + f"CAST(CASE WHEN page_id % 12 IN ({phish}) THEN 1 ELSE 0 END AS INTEGER) AS label "
        "FROM (SELECT page_id, url, regexp_extract(url, '^[a-z]+://[^/?#]*(.*)$', 1) AS tail FROM pages) p"
    )


def email_corpus_sql() -> str:
    lure = case_map("doc_id % 10", {k: q(v) for k, v in cp.EMAIL_LURES.items()}, "''")
    sender = case_map("CAST(floor(doc_id / 10) AS BIGINT) % 8", {k: q(v) for k, v in cp.EMAIL_SENDERS.items()}, "NULL")
    phish = ",".join(str(v) for v in cp.EMAIL_PHISHING_VARIANTS)
    return (
        "SELECT doc_id AS email_id, split_part(text, chr(10), 1) AS subject, "
        f"concat(text, {lure}) AS body, {sender} AS sender, "
        "CASE WHEN doc_id % 4 = 0 THEN '' ELSE concat('<p>', text, '</p>', "
        "repeat(concat('<a class=x href=http://t.example/', CAST(doc_id AS VARCHAR), '>go</a>'), doc_id % 4), "
        "CASE WHEN doc_id % 3 = 0 THEN '<a name=top>top</a>' ELSE '' END) END AS html_content, "
        "CASE doc_id % 5 WHEN 1 THEN 'pass' WHEN 2 THEN 'fail' WHEN 3 THEN 'softfail' ELSE NULL END AS spf_header, "
        "CASE WHEN doc_id % 3 = 1 THEN 'v=1' ELSE NULL END AS dkim_header, "
        "CASE WHEN doc_id % 7 = 1 THEN 'dmarc=pass' ELSE NULL END AS auth_results, "
        "CAST(doc_id % 3 AS INTEGER) AS num_attachments, "
        f"CAST(CASE WHEN doc_id % 10 IN ({phish}) THEN 1 ELSE 0 END AS INTEGER) AS label "
        "FROM documents"
    )
