"""URL risk rules (R1-R17) as column expressions.

Increments are added in a fixed order (brand, free hosting, patterns, missing
HTTPS) so floating-point sums and thresholds behave exactly as specified;
reasons keep the same order.  Every builder uses column expressions only,
so it also runs inside ``transform`` over an array of URLs.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import lexicons as lx
from .text import compact, sql_any, sql_first, sql_lit
from .url_parts import UrlParts, bad_netloc_sql

W = lx.URL_WEIGHTS


def fmt(template: str, *values: Column) -> Column:
    """``template.format(*values)`` for string columns (``{}`` placeholders)."""
    pieces = template.split("{}")
    assert len(pieces) == len(values) + 1
    out: list[Column] = []
    for i, piece in enumerate(pieces):
        if piece:
            out.append(F.lit(piece))
        if i < len(values):
            out.append(values[i].cast("string"))
    return F.concat(*out)


def pct1(p: Column) -> Column:
    """``f"{p:.1%}"``."""
    return F.format_string("%.1f%%", p * F.lit(100.0))


@dataclass(frozen=True)
class UrlRuleColumns:
    brand: Column
    hosting: Column
    hosting_brand: Column
    long_subdomain: Column
    numeric_subdomain: Column
    ip: Column
    subdomain_count: Column
    tld: Column
    at: Column
    shortener: Column
    no_https_sensitive: Column

    @property
    def patterns(self) -> list[tuple[Column, Column]]:
        """R6-R10 (condition, message) in order."""
        return [
            (self.ip, F.lit(lx.MSG["ip"])),
            (self.subdomain_count > 3, fmt(lx.MSG["subdomains"], self.subdomain_count)),
            (self.tld.isNotNull(), fmt(lx.MSG["tld"], self.tld)),
            (self.at, F.lit(lx.MSG["at"])),
            (self.shortener.isNotNull(), fmt(lx.MSG["shortener"], self.shortener)),
        ]

    def pattern_list(self) -> Column:
        """The pattern messages alone, as ARRAY<STRING>."""
        return compact([F.when(c, m) for c, m in self.patterns])

    def scored(self) -> list[tuple[Column, float, Column]]:
        """(condition, increment, reason) in the order they are applied."""
        pre = lx.MSG["pattern_prefix"]
        rows = [
            (self.brand != "", W["brand"], fmt(lx.MSG["brand"], self.brand)),
            (self.hosting.isNotNull() & self.hosting_brand.isNotNull(), W["free_hosting_brand"],
             fmt(lx.MSG["free_hosting_brand"], self.hosting_brand, self.hosting)),
            (self.long_subdomain, W["long_subdomain"], F.lit(lx.MSG["long_subdomain"])),
            (self.numeric_subdomain, W["numeric_subdomain"], F.lit(lx.MSG["numeric_subdomain"])),
        ]
        rows += [(c, W["pattern"], F.concat(F.lit(pre), m)) for c, m in self.patterns]
        rows.append((self.no_https_sensitive, W["no_https_sensitive"], F.lit(lx.MSG["no_https"])))
        return rows


RULE_FIELDS = ("brand", "hosting", "hosting_brand", "long_subdomain", "numeric_subdomain", "ip",
               "subdomain_count", "tld", "at", "shortener", "no_https_sensitive")


def rule_values_sql(ul: str, url: str) -> dict[str, str]:
    """The rule inputs of one URL (R2-R11) as SQL over references to the
    lower-cased URL and the URL (staged column names or lambda fields), so a
    whole word list is one expression however the rules are used."""
    hosting = sql_first(ul, lx.FREE_HOSTING_SITES)
    label = f"get(split(get(split({ul}, '://'), 1), '[.]'), 0)"
    on_hosting = f"(({hosting}) IS NOT NULL)"
    brand = "CASE " + " ".join(
        f"WHEN {sql_any(ul, pats)} THEN CASE WHEN {sql_any(ul, lx.BRAND_LEGIT_DOMAINS.get(b, ()))} "
        f"THEN '' ELSE {sql_lit(b)} END" for b, pats in lx.BRAND_PATTERNS) + " ELSE '' END"
    n_sub = (f"((length({ul}) - length(replace({ul}, '.', ''))) "
             f"- CAST((length({ul}) - length(replace({ul}, '://', ''))) / 3 AS INT) - 1)")
    return {
        "brand": brand,
        "hosting": hosting,
        "hosting_brand": f"CASE WHEN {on_hosting} THEN "
                         f"{sql_first(ul, lx.FREE_HOSTING_BRANDS, [w.title() for w in lx.FREE_HOSTING_BRANDS])} END",
        "long_subdomain": f"coalesce({on_hosting} AND length({label}) > 12, false)",
        "numeric_subdomain": f"coalesce({on_hosting} AND {label} RLIKE '\\\\p{{Nd}}' AND length({label}) > 8, false)",
        "ip": f"({url} RLIKE 'https?://\\\\p{{Nd}}{{1,3}}\\\\.\\\\p{{Nd}}{{1,3}}\\\\.\\\\p{{Nd}}{{1,3}}\\\\.\\\\p{{Nd}}{{1,3}}')",
        "subdomain_count": n_sub,
        "tld": sql_first(ul, lx.SUSPICIOUS_TLDS),
        "at": f"(contains({url}, '@') AND NOT contains({url}, 'mailto:'))",
        "shortener": sql_first(ul, lx.RULE_SHORTENERS),
        "no_https_sensitive": f"(NOT startswith({url}, 'https://') AND {sql_any(ul, lx.SENSITIVE_KEYWORDS)})",
    }


def rule_values(p: UrlParts) -> dict[str, Column]:
    """The rule inputs of one URL with staged parts (R2-R11), keyed by field name."""
    return {k: F.expr(v) for k, v in rule_values_sql(p.ul_ref, p.url_ref).items()}


def url_rule_columns(p: UrlParts) -> UrlRuleColumns:
    return UrlRuleColumns(**rule_values(p))


def rules_of(get) -> UrlRuleColumns:
    """Handles on rule values that were staged (``get(field) -> Column``)."""
    return UrlRuleColumns(**{k: get(k) for k in RULE_FIELDS})


def rule_score_and_reasons(rules: UrlRuleColumns) -> tuple[Column, list[Column]]:
    score: Column = F.lit(0.0)
    reasons: list[Column] = []
    for cond, inc, reason in rules.scored():
        c = F.coalesce(cond, F.lit(False))
        score = score + F.when(c, F.lit(inc)).otherwise(F.lit(0.0))
        reasons.append(F.when(c, reason))
    return score, reasons


def blend_url(score: Column, reasons: list[Column], tabular_p: Column | None = None,
              text_p: Column | None = None) -> tuple[Column, list[Column]]:
    """Optional model probabilities; NULL probability = no model."""
    b = lx.BLEND
    if tabular_p is not None:
        up = tabular_p >= 0.5
        score = (F.when(tabular_p.isNull(), score)
                 .when(up, F.greatest(score, tabular_p * F.lit(b["url_tabular_up"])))
                 .otherwise(F.least(score, F.lit(b["url_tabular_cap_if_legit"]))))
        reasons = reasons + [F.when(up, fmt(lx.MSG["ml_phishing"], pct1(tabular_p)))]
    if text_p is not None:
        up = text_p >= 0.5
        score = (F.when(text_p.isNull(), score)
                 .when(up, F.greatest(score, text_p * F.lit(b["url_text_up"])))
                 .otherwise(score * F.lit(b["url_text_down"])))
        reasons = reasons + [F.when(text_p.isNotNull(),
                                    F.when(up, fmt(lx.MSG["text_phishing"], pct1(text_p)))
                                    .otherwise(fmt(lx.MSG["text_legit"], pct1(F.lit(1.0) - text_p))))]
    return score, reasons


def url_error(p: UrlParts) -> Column:
    """Error message or NULL."""
    bad = p.url.isNull() | (p.url == "")
    return (F.when(bad, F.lit(lx.MSG["invalid_url"]))
            .when(p.parse_error, F.lit(lx.MSG["url_error"].format(lx.MSG["parse_error"]))))


def analysis_from_rules(rules: UrlRuleColumns, tabular_p: Column | None = None,
                        text_p: Column | None = None) -> dict[str, Column]:
    """Uncapped score and ordered reasons (before the error guard)."""
    score, reasons = rule_score_and_reasons(rules)
    score, reasons = blend_url(score, reasons, tabular_p, text_p)
    return {"score": F.least(score, F.lit(1.0)),
            "factors": F.slice(compact(reasons), 1, lx.MAX_REASONS)}


def finish_analysis(score: Column, factors: Column, err: Column, tabular_p: Column | None = None) -> dict[str, Column]:
    from .text import level
    ok = err.isNull()
    ml_pred = (tabular_p >= 0.5).cast("int") if tabular_p is not None else F.lit(None).cast("int")
    ml_conf = tabular_p.cast("double") if tabular_p is not None else F.lit(None).cast("double")
    return {
        "risk_score": F.when(ok, score).otherwise(F.lit(0.0)),
        "risk_level": F.when(ok, level(score, lx.URL_LEVELS)).otherwise(F.lit("ERROR")),
        "risk_factors": F.when(ok, factors).otherwise(F.array(err)),
        "ml_prediction": F.when(ok, ml_pred),
        "ml_confidence": F.when(ok, ml_conf),
        "error": err,
    }


def url_analysis_array_sql(parts_col: str, var: str = "s") -> str:
    """``transform`` over an array of part structs (url, ul, netloc, ...)
    giving (url, error, rules) structs, as one SQL expression."""
    u, ul, net = f"{var}.url", f"{var}.ul", f"{var}.netloc"
    err = (f"CASE WHEN {u} IS NULL OR {u} = '' THEN {sql_lit(lx.MSG['invalid_url'])} "
           f"WHEN {bad_netloc_sql(net)} "
           f"THEN {sql_lit(lx.MSG['url_error'].format(lx.MSG['parse_error']))} END")
    rules = ", ".join(f"{sql_lit(k)}, {v}" for k, v in rule_values_sql(ul, u).items())
    return (f"transform(`{parts_col}`, {var} -> named_struct('url', {u}, 'error', {err}, "
            f"'rules', named_struct({rules})))")


def finish_url_struct(s: Column) -> Column:
    """Second step of ``url_analysis_array_sql``: score, level, reasons."""
    a = analysis_from_rules(rules_of(lambda k: s["rules"][k]))
    return F.struct(s["url"].alias("url"), s["error"].alias("error"), a["score"].alias("score"),
                    a["factors"].alias("factors"))


def final_url_struct(s: Column) -> Column:
    """Third step: error guard and level."""
    f = finish_analysis(s["score"], s["factors"], s["error"])
    return F.struct(s["url"].alias("url"), f["risk_score"].alias("risk_score"),
                    f["risk_level"].alias("risk_level"), f["risk_factors"].alias("risk_factors"))
