"""Email risk rules (M1-M19) as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import lexicons as lx
from .email_features import EmailCols
from .text import compact, level, sql_any, sql_hits, sql_lit
from .url_rules import fmt, pct1

EW = lx.EMAIL_WEIGHTS
STRONG_URL_RE = r"(?U)http://[^\s\x{1c}-\x{1f}]*\.(" + "|".join(lx.STRONG_URL_TLDS) + ")/"


def full_text_lower(e: EmailCols) -> Column:
    return F.lower(e.text)


def has_phishing_indicators(ft: str) -> Column:
    """M1/M2 on the lower-cased subject+body (a staged column's SQL reference)."""
    return F.expr(f"({sql_any(ft, lx.STRONG_INDICATORS)} OR {ft} RLIKE {sql_lit(STRONG_URL_RE)})")


def legitimacy_reason_sql(ft: str, sl: str, ind: str) -> str:
    """M3-M8 as one SQL expression over staged references."""
    org = "CASE " + " ".join(
        f"WHEN contains({ft}, {sql_lit(o)}) OR contains({sl}, {sql_lit(o)}) "
        f"THEN {sql_lit(lx.MSG['legit_org'].format(o.upper()))}" for o in lx.LEGITIMATE_ORGS) + " END"
    sig = sql_hits(ft, [x.lower() for x in lx.LEGITIMATE_SIGNATURES])
    phr = sql_hits(ft, [x.lower() for x in lx.LEGITIMATE_PHRASES])
    signature = f"(({sig}) >= 2 OR ({sql_any(ft, lx.TITLE_WORDS)} AND ({sig}) >= 1))"
    ieee = f"(contains({sl}, {sql_lit(lx.IEEE_WORD)}) OR contains({ft}, {sql_lit(lx.IEEE_WORD)}))"
    return (f"CASE WHEN NOT {ind} AND ({org}) IS NOT NULL THEN ({org}) "
            f"WHEN {sql_any(sl, lx.ACADEMIC_SENDER_DOMAINS)} AND {signature} THEN {sql_lit(lx.MSG['legit_academic'])} "
            f"WHEN {sql_any(sl, lx.LEGITIMATE_DOMAINS)} AND ({phr}) >= 1 THEN {sql_lit(lx.MSG['legit_domain'])} "
            f"WHEN {signature} AND ({phr}) >= 1 THEN {sql_lit(lx.MSG['legit_signature'])} "
            f"WHEN length({ft}) < {lx.SHORT_MAIL_CHARS} AND ({phr}) >= 2 AND NOT {ind} THEN {sql_lit(lx.MSG['legit_short'])} "
            f"WHEN {ieee} AND NOT {ind} THEN {sql_lit(lx.MSG['legit_ieee'])} END")


def legitimacy_reason(ft: str, sl: str, indicators: str) -> Column:
    """M3-M8: the first reason that marks a mail as legitimate, else NULL, over
    staged columns' SQL references."""
    return F.expr(legitimacy_reason_sql(ft, sl, indicators))


def sender_domain(sender: Column) -> Column:
    """Text between the first and the second '@', lower-cased (NULL without '@')."""
    return F.when(sender.contains("@"), F.lower(F.get(F.split(sender, "@"), 1)))


STAGE = "__e_"


def _brand_checks() -> list[tuple[str, str]]:
    return [(b, d) for b in lx.MAJOR_BRANDS if (d := lx.MAJOR_BRAND_DOMAINS.get(b, ""))]


def stage_email_rules(df: DataFrame, e: EmailCols) -> DataFrame:
    """What the rules M3-M12 read from subject, body and sender, as columns
    ``__e_*`` (indicator, legitimacy reason, bypass, sender domain, brands named
    by a free sender); ``score_staged_emails`` needs no text any more.

    Values used by several rules are staged in their own projection, so each is
    computed once per row and every projection stays small enough for generated
    code."""
    t = STAGE
    df = df.withColumns({t + "ft": full_text_lower(e), t + "sl": F.lower(e.sender), t + "dom": sender_domain(e.sender)})
    ft, sl, dom = (F.col(t + k) for k in ("ft", "sl", "dom"))
    df = df.withColumn(t + "ind", has_phishing_indicators(f"`{t}ft`"))
    df = df.withColumns({t + "reason": legitimacy_reason(f"`{t}ft`", f"`{t}sl`", f"`{t}ind`"),
                         t + "ieee": sl.contains(lx.IEEE_WORD) | ft.contains(lx.IEEE_WORD)})
    free = F.coalesce(dom.isin(*lx.FREE_SENDER_DOMAINS), F.lit(False))
    brands = [free & ft.contains(brand) & ~dom.contains(expected) for brand, expected in _brand_checks()]
    return df.withColumns({t + "bypass": F.col(t + "reason").isNotNull() | F.col(t + "ieee"),
                           t + "brands": F.array(*brands)}).drop(t + "ft", t + "sl", t + "ieee")


def analyze_emails(df: DataFrame, e: EmailCols, suspicious_urls: Column, tabular_p: Column | None = None,
                   text_p: Column | None = None, error: Column | None = None) -> DataFrame:
    """M9-M14 (M16): adds risk_score, risk_level, risk_factors, ml_prediction,
    ml_confidence, is_legitimate, bypassed_indicators (and error)."""
    return score_staged_emails(stage_email_rules(df, e), suspicious_urls, tabular_p, text_p, error)


def score_staged_emails(df: DataFrame, suspicious_urls: Column, tabular_p: Column | None = None,
                        text_p: Column | None = None, error: Column | None = None) -> DataFrame:
    """The scoring half of ``analyze_emails``, over ``stage_email_rules``."""
    t = STAGE
    df = df.withColumns({t + "nsusp": suspicious_urls, t + "err": error if error is not None else F.lit(None).cast("string")})
    dom, n, ind, reason, bypass = (F.col(t + k) for k in ("dom", "nsusp", "ind", "reason", "bypass"))

    score: Column = F.lit(0.0) + F.when(ind, F.lit(EW["strong_indicator"])).otherwise(F.lit(0.0))
    reasons = [F.when(ind, F.lit(lx.MSG["strong"]))]
    score = score + F.when(n > 0, F.least(n.cast("double") * F.lit(EW["suspicious_url_each"]),
                                           F.lit(EW["suspicious_url_cap"]))).otherwise(F.lit(0.0))
    reasons.append(F.when(n > 0, fmt(lx.MSG["suspicious_urls"], n)))
    for i, (brand, _) in enumerate(_brand_checks()):
        c = F.get(F.col(t + "brands"), i)
        score = score + F.when(c, F.lit(EW["brand_from_free_mail"])).otherwise(F.lit(0.0))
        reasons.append(F.when(c, fmt(lx.MSG["brand_free_mail"], F.lit(brand.title()), dom)))

    b = lx.BLEND
    ml_pred = F.lit(None).cast("int")
    ml_conf = F.lit(None).cast("double")
    if tabular_p is not None:
        up = tabular_p >= 0.5
        score = (F.when(tabular_p.isNull(), score)
                 .when(up, F.greatest(score, tabular_p * F.lit(b["email_tabular_up"])))
                 .otherwise(score * F.lit(b["email_tabular_down"])))
        reasons.append(F.when(up, fmt(lx.MSG["ml_phishing"], pct1(tabular_p))))
        ml_pred = up.cast("int")
        ml_conf = tabular_p.cast("double")
    if text_p is not None:
        up = text_p >= 0.5
        strong = text_p > b["email_text_strong"]
        score = (F.when(text_p.isNull(), score)
                 .when(up & strong, F.greatest(score, text_p * F.lit(b["email_text_up_strong"])))
                 .when(up, F.greatest(score, text_p * F.lit(b["email_text_up_weak"])))
                 .otherwise(score * F.lit(b["email_text_down"])))
        reasons.append(F.when(text_p.isNotNull(),
                              F.when(up, fmt(lx.MSG["text_phishing"], pct1(text_p)))
                              .otherwise(fmt(lx.MSG["text_legit"], pct1(F.lit(1.0) - text_p)))))
    df = df.withColumns({t + "score": F.least(score, F.lit(1.0)), t + "reasons": compact(reasons),
                         t + "mlp": ml_pred, t + "mlc": ml_conf})
    score = F.col(t + "score")
    df = df.withColumn(t + "lvl", level(score, lx.EMAIL_LEVELS))
    lvl = F.col(t + "lvl")
    head = (F.when((lvl == "SAFE") & (score < EW["headline_safe_below"]), F.lit(lx.MSG["head_safe"]))
            .when(lvl == "HIGH", F.lit(lx.MSG["head_high"]))
            .when(lvl == "MEDIUM", F.lit(lx.MSG["head_medium"])))
    factors = F.slice(F.concat(compact([head]), F.col(t + "reasons")), 1, lx.MAX_REASONS)
    legit_factors = F.array(F.concat(F.lit(lx.MSG["legit_prefix"]),
                                     F.coalesce(reason, F.lit(lx.MSG["legit_fallback"]))))
    # a legitimate mail is settled before its URLs are looked at
    err = F.when(bypass, F.lit(None).cast("string")).otherwise(F.col(t + "err"))
    ok = err.isNull()
    out = {
        "risk_score": F.when(~ok, F.lit(0.0)).when(bypass, F.lit(EW["legitimate_score"])).otherwise(score),
        "risk_level": F.when(~ok, F.lit("ERROR")).when(bypass, F.lit("SAFE")).otherwise(lvl),
        "risk_factors": F.when(~ok, F.array(err)).when(bypass, legit_factors).otherwise(factors),
        "ml_prediction": F.when(~ok, F.lit(None)).when(bypass, F.lit(0)).otherwise(F.col(t + "mlp")),
        "ml_confidence": F.when(~ok, F.lit(None)).when(bypass, F.lit(0.0)).otherwise(F.col(t + "mlc")),
        "is_legitimate": F.when(ok, bypass),
        "bypassed_indicators": F.when(ok, bypass & ind),
    }
    if error is not None:
        out["error"] = err
    tmp = [c for c in df.columns if c.startswith(t)]
    return df.withColumns(out).drop(*tmp)


def recommendations(level_col: Column) -> Column:
    """Advice per level; ERROR gets none (the reference gives SAFE advice)."""
    out = None
    for lvl in ("HIGH", "MEDIUM", "LOW", "SAFE"):
        arr = F.array(*[F.lit(s) for s in lx.RECOMMENDATIONS[lvl]])
        c = level_col == lvl
        out = F.when(c, arr) if out is None else out.when(c, arr)
    return out.otherwise(F.array().cast("array<string>"))
