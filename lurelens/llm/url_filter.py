"""URL filter: host and path rules, then a weighted vocabulary (operator 4).

A rule names a host and a path start with a verdict; it fits the host and all
its subdomains, and the longest rule wins (of two of equal length the one with the
longer host, of equal rules the first).  A url without a rule is judged by
its words: one Aho-Corasick pass over the lower-cased url finds strict and soft
terms; a hit counts only between boundaries (the characters before and after it
are no letters or digits), and one strict term, or soft terms whose weights
(each distinct term once) reach ``soft_limit``, block the url.  No weight reaches
the limit alone: telling words weigh 3 or 2, ordinary words that such urls often
hold weigh 1, so that it takes four of those.

The url column alone is read.  Rules and terms are parameters (a few thousand
entries at most) and travel with the task; no shuffle, no join.

Defined results: a null url has empty host and path, no rule and is allowed; a
url without ``://`` has empty host and path and is judged by its words; repeated
rows give a row each; an empty table gives an empty result; extra columns are
ignored, whatever their names.  Very long urls are read whole, in linear time.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Mapping, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: (host, path start, verdict)
RULES = (("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"),
         ("net", "/es/", "block"), ("net", "/fr/", "block"))

#: Terms of which one rejects a url.
STRICT = tuple("""
porn porno pornos xxx sex hentai camgirls camsex sexcam escort escorts milf casino casinos roulette viagra cialis
malware warez torrent torrents phishing darkweb
""".split())

#: Terms of which several distinct ones reject a url, by weight.
_BY_WEIGHT = {
    3: """bets betting poker slots jackpot gambling sportsbook nude nudes cams webcams lottery keygen serials nulled replica replicas
          pharmacy pills steroids payday""",
    2: """bet bonus blackjack bingo adult erotic dating singles hookup loan loans credit crack cracked hack hacked cheats forex
          crypto bitcoin airdrop weightloss""",
    1: "free win winner hot live cheap click promo promos ads deal deals offer offers prize gift sale earn money cash",
}
SOFT: Mapping[str, int] = {t: w for w, ts in _BY_WEIGHT.items() for t in ts.split()}
SOFT_LIMIT = 4

_PARTS = re.compile(r"://([^/?#]*)([^?#]*)", re.S)
_UPPER = {c: c + 32 for c in range(65, 91)}


def _alnum(c: str) -> bool:
    return "a" <= c <= "z" or "0" <= c <= "9"


def host_path(url: str | None) -> tuple[str, str]:
    m = _PARTS.search(url) if url else None
    return (m.group(1).translate(_UPPER), m.group(2)) if m else ("", "")


class Judge:
    """Rules by host and the automaton, built once a task."""

    def __init__(self, rules, strict: Sequence[str], soft: Mapping[str, int], soft_limit: int) -> None:
        import ahocorasick
        self.rules: dict[str, list[tuple[str, str]]] = {}
        for host, path, verdict in rules:
            self.rules.setdefault(host, []).append((path, verdict))
        for r in self.rules.values():
            r.sort(key=lambda x: -len(x[0]))
        self.soft_limit = soft_limit
        self.auto = ahocorasick.Automaton()
        for t, w in soft.items():
            self.auto.add_word(t, (t, len(t), w))
        for t in strict:
            self.auto.add_word(t, (t, len(t), 0))
        if len(self.auto):
            self.auto.make_automaton()

    def rule(self, host: str, path: str) -> tuple[str | None, str | None]:
        best = best_verdict = None
        labels = host.split(".") if host else []
        for i in range(len(labels)):
            name = ".".join(labels[i:])
            for start, verdict in self.rules.get(name, ()):
                if path.startswith(start) and (best is None or len(name) + len(start) > len(best)):
                    best, best_verdict = name + start, verdict
        return best, best_verdict

    def words(self, url: str) -> tuple[list[str], list[str]]:
        """Distinct strict and soft terms of a url between boundaries."""
        strict, soft = set(), {}
        if not len(self.auto):
            return [], []
        u = url.translate(_UPPER)
        for end, (term, n, weight) in self.auto.iter(u):
            if (end + 1 < len(u) and _alnum(u[end + 1])) or (end >= n and _alnum(u[end - n])):
                continue
            if weight:
                soft[term] = weight
            else:
                strict.add(term)
        return sorted(strict), sorted(soft)

    def judge(self, url: str | None, soft_weights: Mapping[str, int]):
        host, path = host_path(url)
        rule, verdict = self.rule(host, path)
        strict, soft = self.words(url) if url else ([], [])
        if verdict is None:
            score = sum(soft_weights[t] for t in soft)
            verdict = "block" if strict or score >= self.soft_limit else "allow"
        return host, path, rule, verdict, strict, soft


def filter_urls(pages: DataFrame, rules=RULES, strict: Sequence[str] = STRICT, soft: Mapping[str, int] = SOFT,
                soft_limit: int = SOFT_LIMIT) -> DataFrame:
    """page_id, host, path, rule, verdict, strict_terms, soft_terms (sorted
    distinct terms, joined by commas): a row per page."""
    soft = dict(soft)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        judge = Judge(rules, strict, soft, soft_limit)
        for b in batches:
            rows = [judge.judge(u, soft) for u in b.column(1).to_pylist()]
            cols = list(zip(*rows, strict=True)) if rows else [()] * 6
            text = [pa.array(c, pa.string()) for c in cols[:4]] + [pa.array([",".join(x) for x in c], pa.string()) for c in cols[4:]]
            yield pa.RecordBatch.from_arrays([b.column(0), *text], names=["page_id", "host", "path", "rule", "verdict", "strict_terms", "soft_terms"])

    return pages.select(F.col("page_id").cast("long"), F.col("url").cast("string")).mapInArrow(
        run, "page_id long, host string, path string, rule string, verdict string, strict_terms string, soft_terms string")


def oracle(rules=RULES, strict: Sequence[str] = STRICT, soft: Mapping[str, int] = SOFT, soft_limit: int = SOFT_LIMIT) -> str:
    """The same answer in SQL: regular expressions in place of the automaton."""
    when = "\n".join(
        f"    WHEN (host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}') THEN '{h}{p}'"
        for h, p, _ in sorted(rules, key=lambda r: (-len(r[0] + r[1]), -len(r[0]))))
    verdicts = " ".join(f"WHEN '{h}{p}' THEN '{v}'" for h, p, v in rules)
    edge = lambda t: f"regexp_matches(u, '(^|[^a-z0-9]){t}($|[^a-z0-9])')"
    def terms(ts):
        return "array_to_string(list_filter([" + ", ".join(f"CASE WHEN {edge(t)} THEN '{t}' END" for t in sorted(ts)) + "], lambda x: x IS NOT NULL), ',')"
    score = " + ".join(f"CASE WHEN {edge(t)} THEN {w} ELSE 0 END" for t, w in soft.items())
    lower = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    return f"""
WITH a AS (
  SELECT page_id, coalesce({lower.format("url")}, '') AS u,
         coalesce({lower.format("regexp_extract(url, '://([^/?#]*)([^?#]*)', 1)")}, '') AS host,
         coalesce(regexp_extract(url, '://([^/?#]*)([^?#]*)', 2), '') AS path
  FROM pages),
b AS (SELECT *, CASE
{when}
    END AS rule, {terms(strict)} AS strict_terms, {terms(soft)} AS soft_terms, {score} AS score FROM a)
SELECT page_id, host, path, rule,
       CASE rule {verdicts} ELSE CASE WHEN strict_terms <> '' OR score >= {soft_limit} THEN 'block' ELSE 'allow' END END AS verdict,
       strict_terms, soft_terms
FROM b
"""
