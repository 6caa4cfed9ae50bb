"""The 21 email features (E1-E22) as column expressions.

Inputs are plain columns: subject, body, sender, html_content,
headers MAP<STRING,STRING> (insertion order is the header order) and
num_attachments.  Missing values are read as '' / empty map / 0.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import lexicons as lx
from .manifest import EMAIL_FEATURES
from .text import DIGIT, PUNCT, UPPER, contains_any, hits, ratio, words

NS = r"[^\s\x{1c}-\x{1f}]"  # one non-blank character (Python's \S), under (?U)
URL_IN_TEXT_RE = r"(?U)https?://" + NS + "+"
# One match per run of non-blanks at most; tried at its start only and never
# beyond its first usable @, so a run is read in linear time.
EMAIL_IN_TEXT_RE = (r"(?U)(?<!" + NS + ")" + NS + r"[^\s\x{1c}-\x{1f}@]*+@" + NS + r"+\." + NS + "+")
IP_IN_TEXT_RE = r"(?U)\b\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}\b"
# Group 1 is "<" for a link.  After an anchor without one, no link starts on the
# rest of its line, so the second branch takes that rest (linear time), but for
# an anchor that the line ends with: its link may follow on the next line.
LINK_IN_HTML_RE = (r"(?iUd)(<)a[\s\x{1c}-\x{1f}]++(?>.*?href)[^\n>]*+>"
                   r"|<a[\s\x{1c}-\x{1f}]++[^\n]*?(?=<a[\s\x{1c}-\x{1f}&&[^\n]]*+\n|\n|\z)")


@dataclass(frozen=True)
class EmailCols:
    subject: Column
    body: Column
    sender: Column
    html: Column
    headers: Column
    attachments: Column

    @property
    def text(self) -> Column:
        return F.concat(self.subject, F.lit(" "), self.body)


def email_cols(subject="subject", body="body", sender="sender", html="html_content",
               headers="headers", attachments="num_attachments", present: set[str] | None = None) -> EmailCols:
    """Column handles with '' / empty-map / 0 defaults; ``present`` limits to
    existing columns (others take the default)."""

    def pick(name, default):
        if name is None or (present is not None and name not in present):
            return default
        return F.coalesce(F.col(name), default) if isinstance(name, str) else F.coalesce(name, default)

    empty_map = F.create_map().cast("map<string,string>")
    return EmailCols(
        subject=pick(subject, F.lit("")),
        body=pick(body, F.lit("")),
        sender=pick(sender, F.lit("")),
        html=pick(html, F.lit("")),
        headers=pick(headers, empty_map),
        attachments=pick(attachments, F.lit(0)).cast("int"),
    )


# Characters outside ASCII that a pattern without case takes for an ASCII letter
# (long s, Kelvin sign, dotted capital i, dotless i).
CASE_TWINS = ("\u017f", "\u212a", "\u0130", "\u0131")


def count_if(possible: Column, count: Column) -> Column:
    """``count``, or 0 without looking where ``possible`` (cheaper) rules it out."""
    return F.when(possible, count).otherwise(F.lit(0))


def literals_of(pattern: str) -> list[str]:
    """The alternatives of a pattern of words only, one of which a match holds."""
    m = re.fullmatch(r"\\b\(([a-z |]+)\)\\b", pattern)
    return m[1].split("|") if m else []


def urgency_score(text: Column, lowered: bool = False) -> Column:
    tl = text if lowered else F.lower(text)
    total = None
    for pat in lx.URGENCY_PATTERNS:
        c = F.regexp_count(tl, F.lit("(?iU)" + pat))
        if words_of := literals_of(pat):
            c = count_if(contains_any(tl, [*words_of, *CASE_TWINS]), c)
        total = c if total is None else total + c
    return F.least(total.cast("double") / F.lit(10), F.lit(1.0))


def sender_reputation(sender: Column) -> Column:
    s = sender
    rep = (F.lit(0.5)
           - F.when(contains_any(F.lower(s), lx.FREE_MAIL_DOMAINS), F.lit(0.1)).otherwise(F.lit(0.0))
           - F.when(F.substring_index(s, "@", 1).rlike("[0-9]{3,}"), F.lit(0.1)).otherwise(F.lit(0.0))
           - F.when(contains_any(s, lx.SUSPICIOUS_TLDS), F.lit(0.2)).otherwise(F.lit(0.0)))
    return F.when(s == "", F.lit(0.5)).otherwise(F.greatest(F.lit(0.0), F.least(rep, F.lit(1.0))))


def header_flags(h: Column) -> dict[str, Column]:
    keys = F.map_keys(h)
    vals = F.map_values(h)
    has_spf = F.exists(keys, lambda k: F.lower(k).startswith(lx.SPF_KEY))
    has_dkim = F.exists(keys, lambda k: F.lower(k).startswith(lx.DKIM_KEY))
    has_dmarc = (F.exists(keys, lambda k: F.lower(k).contains(lx.DMARC_WORD))
                 | F.exists(vals, lambda v: F.coalesce(F.lower(v).contains(lx.DMARC_WORD), F.lit(False))))
    decisive = F.filter(F.map_entries(h), lambda e: F.lower(e["key"]).contains(lx.SPF_KEY)
                        & (F.lower(e["value"]).contains("pass") | F.lower(e["value"]).contains("fail")))
    first = F.get(decisive, 0)
    spf_match = (F.when(first.isNull(), F.lit(0.5))
                 .when(F.lower(first["value"]).contains("pass"), F.lit(1.0)).otherwise(F.lit(0.0)))
    return {"has_spf": has_spf.cast("int"), "has_dkim": has_dkim.cast("int"),
            "has_dmarc": has_dmarc.cast("int"), "spf_result_match": spf_match}


def email_feature_columns(e: EmailCols, text: Column | None = None, tl: Column | None = None,
                          tokens: Column | None = None, tl_ref: str | None = None) -> dict[str, Column]:
    """The 21 features.  ``text`` / ``tl`` (lower-cased text) / ``tokens``
    (``tl.split()``) may be staged columns so each is computed once."""
    text = e.text if text is None else text
    tl = F.lower(text) if tl is None else tl
    # lower-casing neither creates nor removes blanks, so both texts have the same
    # tokens, and what it adds in length it adds inside them
    toks = words(tl) if tokens is None else tokens
    n_text = F.length(text)
    n_html = F.length(e.html)
    no_html = e.html == ""
    n_words = F.size(toks)
    hf = header_flags(e.headers)
    f = {
        "total_length": n_text,
        "num_caps": F.regexp_count(text, F.lit(UPPER)),
        "num_digits": F.regexp_count(text, F.lit(DIGIT)),
        "num_special_chars": F.regexp_count(text, F.lit(PUNCT)),
        "num_urls": F.regexp_count(text, F.lit(URL_IN_TEXT_RE)),
        "num_emails": count_if(text.contains("@"), F.regexp_count(text, F.lit(EMAIL_IN_TEXT_RE))),
        "num_ips": F.regexp_count(text, F.lit(IP_IN_TEXT_RE)),
        "num_links": F.length(F.array_join(
            F.regexp_extract_all(e.html, F.lit(LINK_IN_HTML_RE), F.lit(1)), "")),
        "num_attachments": e.attachments,
        "suspicious_words_count": hits(tl_ref or tl, lx.SUSPICIOUS_WORDS).cast("double") / F.lit(len(lx.SUSPICIOUS_WORDS)),
        "urgency_score": urgency_score(tl, lowered=True),
        "threat_score": F.least(hits(tl_ref or tl, lx.THREAT_KEYWORDS).cast("double") / F.lit(len(lx.THREAT_KEYWORDS)),
                                F.lit(1.0)),
        "sender_reputation": sender_reputation(e.sender),
        **hf,
        "html_ratio": F.when(no_html, F.lit(0.0)).otherwise(ratio(n_html, n_html + n_text)),
        "text_html_ratio": F.when(no_html, F.lit(1.0)).otherwise(ratio(n_text, n_html)),
        "avg_word_length": F.when(n_words == 0, F.lit(0.0)).otherwise(
            ratio(F.length(F.array_join(toks, "")) - (F.length(tl) - n_text), n_words)),
        "unique_word_ratio": F.when(n_words == 0, F.lit(0.0)).otherwise(
            ratio(F.size(F.array_distinct(toks)), n_words)),
    }
    f = {k: f[k] for k in EMAIL_FEATURES}
    return f


def stage_email_text(df: DataFrame, e: EmailCols) -> tuple[DataFrame, dict[str, Column], list[str]]:
    """Adds the text, its lower-cased form and that one's tokens as columns (one
    projection each) and returns handles for ``email_feature_columns``."""
    df = df.withColumn("__e_text", e.text)
    df = df.withColumn("__e_tl", F.lower(F.col("__e_text"))).withColumn("__e_tok", words(F.col("__e_tl")))
    handles = {"text": F.col("__e_text"), "tl": F.col("__e_tl"), "tokens": F.col("__e_tok"), "tl_ref": "`__e_tl`"}
    return df, handles, ["__e_text", "__e_tl", "__e_tok"]
