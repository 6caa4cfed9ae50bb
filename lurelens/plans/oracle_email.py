"""Oracle SQL (DuckDB) for email features, combined features and email rules."""

from __future__ import annotations

from ..functions import lexicons as lx
from ..functions.manifest import EMAIL_DOUBLE_FEATURES, EMAIL_FEATURES, URL_FEATURES
from . import oracle_url as ou
from . import sqlgen as g

PUNCT_RE = ou.PUNCT_RE
# DuckDB's \b, \w, \s are ASCII-only; Python's are Unicode.  Non-ASCII
# characters are turned into '_' (a word character that is no letter) before
# the word-boundary patterns, which gives Python's boundaries on this corpus.
ASCII = "regexp_replace({}, '[^\\x00-\\x7F]', '_', 'g')"


def email_base(spf_key: str = "Received-SPF") -> str:
    """Email corpus plus _text, _tl (lower), _html, _sender, header columns."""
    spf_key_l = spf_key.lower()
    has_spf = "(spf_header IS NOT NULL)" if spf_key_l.startswith("spf") else "FALSE"
    return (
        "SELECT *, concat(coalesce(subject, ''), ' ', coalesce(body, '')) AS _text, "
        "lower(concat(coalesce(subject, ''), ' ', coalesce(body, ''))) AS _tl, "
        "coalesce(html_content, '') AS _html, coalesce(sender, '') AS _sender, "
        f"{has_spf} AS _has_spf FROM ({g.email_corpus_sql()}) e0"
    )


def feature_exprs() -> dict[str, str]:
    t, tl, html, snd = "_text", "_tl", "_html", "_sender"
    urg = " + ".join(g.rcount(ASCII.format(tl), "(?i)" + p) for p in lx.URGENCY_PATTERNS)
    n_words = g.rcount(t, r"\S+")
    lw = f"list_filter(string_split_regex({tl}, '\\s+'), lambda x: x <> '')"
    rep = (f"(0.5::DOUBLE - CASE WHEN {g.any_of(f'lower({snd})', lx.FREE_MAIL_DOMAINS)} THEN 0.1::DOUBLE ELSE 0.0::DOUBLE END"
           f" - CASE WHEN regexp_matches(split_part({snd}, '@', 1), '[0-9]{{3,}}') THEN 0.1::DOUBLE ELSE 0.0::DOUBLE END"
           f" - CASE WHEN {g.any_of(snd, lx.SUSPICIOUS_TLDS)} THEN 0.2::DOUBLE ELSE 0.0::DOUBLE END)")
    f = {
        "total_length": f"length({t})",
        "num_caps": g.rcount(t, r"\p{Lu}"),
        "num_digits": g.rcount(t, r"\p{Nd}"),
        "num_special_chars": g.rcount(t, PUNCT_RE),
        "num_urls": g.rcount(t, r"https?://\S+"),
        "num_emails": g.rcount(t, r"\S+@\S+\.\S+"),
        "num_ips": g.rcount(ASCII.format(t), r"\b\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}\b"),
        "num_links": g.rcount(html, r"(?i)<a\s+.*?href.*?>"),
        "num_attachments": "coalesce(num_attachments, 0)",
        "suspicious_words_count": f"{g.hits(tl, lx.SUSPICIOUS_WORDS)}::DOUBLE / {len(lx.SUSPICIOUS_WORDS)}",
        "urgency_score": f"least(({urg})::DOUBLE / 10, 1.0::DOUBLE)",
        "threat_score": f"least({g.hits(tl, lx.THREAT_KEYWORDS)}::DOUBLE / {len(lx.THREAT_KEYWORDS)}, 1.0::DOUBLE)",
        "sender_reputation": f"CASE WHEN {snd} = '' THEN 0.5::DOUBLE ELSE greatest(0.0::DOUBLE, least({rep}, 1.0::DOUBLE)) END",
        "has_spf": "_has_spf::INT",
        "has_dkim": "(dkim_header IS NOT NULL)::INT",
        "has_dmarc": "coalesce(contains(lower(auth_results), 'dmarc'), FALSE)::INT",
        "spf_result_match": ("CASE WHEN spf_header IS NULL THEN 0.5::DOUBLE WHEN contains(lower(spf_header), 'pass') "
                             "THEN 1.0::DOUBLE WHEN contains(lower(spf_header), 'fail') THEN 0.0::DOUBLE ELSE 0.5::DOUBLE END"),
        "html_ratio": f"CASE WHEN {html} = '' THEN 0.0::DOUBLE ELSE length({html})::DOUBLE / (length({html}) + length({t})) END",
        "text_html_ratio": f"CASE WHEN {html} = '' THEN 1.0::DOUBLE ELSE length({t})::DOUBLE / length({html}) END",
        "avg_word_length": (f"CASE WHEN {n_words} = 0 THEN 0.0::DOUBLE ELSE "
                            f"length(regexp_replace({t}, '\\s', '', 'g'))::DOUBLE / {n_words} END"),
        "unique_word_ratio": f"CASE WHEN len({lw}) = 0 THEN 0.0::DOUBLE ELSE len(list_distinct({lw}))::DOUBLE / len({lw}) END",
    }
    assert tuple(f) == EMAIL_FEATURES
    return f


def out_feature(name: str, expr: str) -> str:
    if name in EMAIL_DOUBLE_FEATURES:
        return f"{g.r6(expr)} AS {name}"
    return f"CAST({expr} AS BIGINT) AS {name}"


def email_features_query(spf_key: str = "Received-SPF", only: list[str] | None = None) -> str:
    f = feature_exprs()
    names = only or list(EMAIL_FEATURES)
    return (f"SELECT email_id, {', '.join(out_feature(n, f[n]) for n in names)} "
            f"FROM ({email_base(spf_key)}) e")


def email_features_raw(spf_key: str = "Received-SPF") -> str:
    """Unrounded features with label (input of leakage checks)."""
    f = feature_exprs()
    return (f"SELECT email_id, label, {', '.join(f'{f[n]} AS {n}' for n in EMAIL_FEATURES)} "
            f"FROM ({email_base(spf_key)}) e")


# ------------------------------------------------------------------ C rows

def body_url_rows() -> str:
    """email_id, pos, url for every raw body URL."""
    return ("SELECT email_id, generate_subscripts(_u, 1) AS pos, unnest(_u) AS url FROM "
            f"(SELECT email_id, regexp_extract_all(coalesce(body, ''), 'https?://\\S+') AS _u FROM ({g.email_corpus_sql()}) e) x")


def url_means_query(year: int = 2024, rounded: bool = True) -> str:
    f = ou.feature_exprs("url", year)
    per_url = (f"SELECT email_id, {', '.join(f'({f[n]})::DOUBLE AS {n}' for n in URL_FEATURES)} "
               f"FROM ({ou.parts_select(body_url_rows())}) p")
    agg = ", ".join(f"avg({n}) AS url_{n}" for n in URL_FEATURES)
    grouped = (f"SELECT email_id, {agg}, count(*) AS total_urls_in_email, "
               "sum(CASE WHEN has_suspicious_tld = 1 OR has_ip_address = 1 THEN 1 ELSE 0 END) AS suspicious_url_count "
               f"FROM ({per_url}) q GROUP BY email_id")
    mean = [f"coalesce(m.url_{n}, 0.0)" for n in URL_FEATURES]
    cols = ", ".join(f"{g.r6(m) if rounded else m} AS url_{n}" for n, m in zip(URL_FEATURES, mean, strict=True))
    return (f"SELECT e.email_id, {cols}, CAST(coalesce(m.total_urls_in_email, 0) AS BIGINT) AS total_urls_in_email, "
            f"CAST(coalesce(m.suspicious_url_count, 0) AS BIGINT) AS suspicious_url_count "
            f"FROM ({g.email_corpus_sql()}) e LEFT JOIN ({grouped}) m ON e.email_id = m.email_id")


def public_urls_expr(text: str) -> str:
    raw = f"regexp_extract_all({text}, 'https?://[^\\s<>\"{{}}|\\\\^`\\[\\]]+')"
    return (f"list_sort(list_distinct(list_filter(list_transform({raw}, lambda u: rtrim(u, {g.q(lx.URL_RSTRIP_CHARS)})), "
            f"lambda u: length(u) > {lx.URL_MIN_LEN_EXCLUSIVE})))")


# ------------------------------------------------------------------ M rows

def legit_reason_expr(ft: str, sl: str, ind: str) -> str:
    org = "CASE " + " ".join(
        f"WHEN contains({ft}, {g.q(o)}) OR contains({sl}, {g.q(o)}) THEN {g.q(lx.MSG['legit_org'].format(o.upper()))}"
        for o in lx.LEGITIMATE_ORGS) + " END"
    sig = g.hits(ft, [s.lower() for s in lx.LEGITIMATE_SIGNATURES])
    phr = g.hits(ft, [s.lower() for s in lx.LEGITIMATE_PHRASES])
    title = g.any_of(ft, lx.TITLE_WORDS)
    academic = g.any_of(sl, lx.ACADEMIC_SENDER_DOMAINS)
    signature = f"(({sig}) >= 2 OR ({title} AND ({sig}) >= 1))"
    ieee = f"(contains({sl}, 'ieee') OR contains({ft}, 'ieee'))"
    return (f"CASE WHEN NOT {ind} AND ({org}) IS NOT NULL THEN ({org}) "
            f"WHEN {academic} AND {signature} THEN {g.q(lx.MSG['legit_academic'])} "
            f"WHEN {g.any_of(sl, lx.LEGITIMATE_DOMAINS)} AND ({phr}) >= 1 THEN {g.q(lx.MSG['legit_domain'])} "
            f"WHEN {signature} AND ({phr}) >= 1 THEN {g.q(lx.MSG['legit_signature'])} "
            f"WHEN length({ft}) < {lx.SHORT_MAIL_CHARS} AND ({phr}) >= 2 AND NOT {ind} THEN {g.q(lx.MSG['legit_short'])} "
            f"WHEN {ieee} AND NOT {ind} THEN {g.q(lx.MSG['legit_ieee'])} END")


def scored_emails_select() -> str:
    """Email corpus + _ind, _reason, _bypass, _score, _level, _factors (list)."""
    ft, sl = "_tl", "lower(_sender)"
    strong_re = "http://\\S*\\.(" + "|".join(lx.STRONG_URL_TLDS) + ")/"
    ind = f"({g.any_of(ft, lx.STRONG_INDICATORS)} OR regexp_matches({ft}, {g.q(strong_re)}))"
    susp = ("len(list_filter(regexp_extract_all(coalesce(body, ''), 'https?://\\S+'), lambda u: "
            f"{g.any_of('lower(u)', lx.SUSPICIOUS_TLDS)} OR regexp_matches(split_part(regexp_extract(u, "
            f"{g.q(ou.NETLOC_OF_LINK)}, 1), ':', 1), {g.q(ou.IP_HOST_RE)})))")
    dom = "CASE WHEN contains(_sender, '@') THEN lower(split_part(_sender, '@', 2)) END"
    s1 = (f"SELECT *, {ind} AS _ind, {susp} AS _nsusp, {dom} AS _dom, "
          f"(contains({sl}, 'ieee') OR contains({ft}, 'ieee')) AS _ieee FROM ({email_base()}) a")
    s2 = f"SELECT *, {legit_reason_expr(ft, sl, '_ind')} AS _reason FROM ({s1}) b"
    EW = lx.EMAIL_WEIGHTS
    score = (f"(0.0::DOUBLE + CASE WHEN _ind THEN {g.dbl(EW['strong_indicator'])} ELSE 0.0::DOUBLE END"
             f" + CASE WHEN _nsusp > 0 THEN least(_nsusp * {g.dbl(EW['suspicious_url_each'])}, {g.dbl(EW['suspicious_url_cap'])}) ELSE 0.0::DOUBLE END")
    reasons = [f"CASE WHEN _ind THEN {g.q(lx.MSG['strong'])} END",
               f"CASE WHEN _nsusp > 0 THEN {g.fmt(lx.MSG['suspicious_urls'], '_nsusp')} END"]
    free = "coalesce(_dom IN ('gmail.com', 'yahoo.com', 'hotmail.com'), FALSE)"
    for brand in lx.MAJOR_BRANDS:
        exp = lx.MAJOR_BRAND_DOMAINS.get(brand)
        if not exp:
            continue
        c = f"({free} AND contains({ft}, {g.q(brand)}) AND NOT contains(_dom, {g.q(exp)}))"
        score += f" + CASE WHEN {c} THEN {g.dbl(EW['brand_from_free_mail'])} ELSE 0.0::DOUBLE END"
        reasons.append(f"CASE WHEN {c} THEN {g.fmt(lx.MSG['brand_free_mail'], g.q(brand.title()), '_dom')} END")
    score += ")"
    s3 = (f"SELECT *, {score} AS _sum, least({score}, 1.0::DOUBLE) AS _raw, list_filter([{', '.join(reasons)}], lambda x: x IS NOT NULL) AS _rs, "
          f"(_reason IS NOT NULL OR _ieee) AS _bypass FROM ({s2}) c")
    lvl = g.level("_raw", lx.EMAIL_LEVELS)
    head = (f"CASE WHEN ({lvl}) = 'SAFE' AND _raw < {g.dbl(EW['headline_safe_below'])} THEN {g.q(lx.MSG['head_safe'])} "
            f"WHEN ({lvl}) = 'HIGH' THEN {g.q(lx.MSG['head_high'])} WHEN ({lvl}) = 'MEDIUM' THEN {g.q(lx.MSG['head_medium'])} END")
    legit = f"[concat({g.q(lx.MSG['legit_prefix'])}, coalesce(_reason, {g.q(lx.MSG['legit_fallback'])}))]"
    return (f"SELECT *, CASE WHEN _bypass THEN {g.dbl(EW['legitimate_score'])} ELSE _raw END AS _score, "
            f"CASE WHEN _bypass THEN 'SAFE' ELSE {lvl} END AS _level, "
            f"CASE WHEN _bypass THEN {legit} ELSE (list_filter([{head}], lambda x: x IS NOT NULL) || _rs)[1:{lx.MAX_REASONS}] END AS _factors "
            f"FROM ({s3}) d")


def email_with_urls_query() -> str:
    se = scored_emails_select()
    urls = f"SELECT email_id, unnest({public_urls_expr('_text')}) AS url FROM ({email_base()}) e"
    scored_urls = ou.scored_urls_select(urls)
    agg = f"SELECT email_id, max(risk_score) AS max_url, count(*) AS n_urls FROM ({scored_urls}) s GROUP BY email_id"
    comb = "greatest(m._score, coalesce(u.max_url, m._score))"
    lvl = g.level(comb, lx.EMAIL_LEVELS)
    rec = "CASE " + " ".join(
        f"WHEN ({lvl}) = {g.q(k)} THEN {g.q(' | '.join(v))}" for k, v in lx.RECOMMENDATIONS.items()) + " ELSE '' END"
    return (f"SELECT m.email_id, {g.r6('m._score')} AS email_risk_score, m._level AS email_risk_level, "
            "coalesce(array_to_string(m._factors, ' | '), '') AS email_risk_factors, "
            f"coalesce(array_to_string({public_urls_expr('m._text')}, ' | '), '') AS urls_found, "
            "CAST(coalesce(u.n_urls, 0) AS BIGINT) AS n_urls, "
            f"{g.r6('u.max_url')} AS max_url_score, {g.r6(comb)} AS combined_risk_score, "
            f"{lvl} AS combined_risk_level, {rec} AS recommendations "
            f"FROM ({se}) m LEFT JOIN ({agg}) u ON m.email_id = u.email_id")
