"""Toxicity: a lexicon trie met by Levenshtein automata (operator 6).

Lexicon.  Terms are whole words or word starts of 4 to 8 characters.  All are
learned from labelled rows: a Spark aggregation counts, over the training rows
(a hash sample of ``TRAIN_ROWS`` labels at most), in how many toxic and in how
many clean documents each candidate occurs.  Kept are those that a likelihood
ratio test tells from chance and whose log odds hold in both halves of the
training rows.  A term's weight is its log odds.

Matching.  One deterministic automaton is built, as far as the words need it,
as the product of the lexicon's trie with Levenshtein automata: a state is the
set of (trie node, edits so far).  Words of five or more letters may differ
from a term by one edit (a swap of neighbours counts as one), ten or more by
two; shorter terms and word starts must match
exactly, the first letter always.
Words that clean training documents use are no misspellings.  Look-alike digits
and signs are read as letters where a word has no match as it stands.

Context.  A hit's weight is multiplied by a factor from the words around it (a
window of ``WINDOW`` words): inside quotation marks, or after a word that
reports or denies ("said", "called", "not"), it counts a quarter; close to
words of address ("you", "are") it counts in full and a half more.  A document's
evidence is its summed weights; the score is a logistic of it, and predicted is
score >= 0.5.  The text alone is scored.

Defined results: null, empty and wordless text score the empty evidence (well
below one half); repeated rows give a row each; without labels of both classes
the lexicon is empty and every document scores the empty evidence; labels of unknown documents or with null marks are ignored, and
a document with several labels trains with each; in texts with the same two
longest words and mark a term counts once; an empty table gives an empty result; extra columns are
ignored, whatever their names.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import free_name, materialize

TRAIN_ROWS = 10_000       # labelled rows that the lexicon is learned from, at most
MIN_GAIN = 32.0           # likelihood ratio statistic of a learned term, at least
MIN_ODDS = 2.5            # log odds of a learned term, at least
HALF_ODDS = 2.0           # log odds in either half of the training rows, at least
MAX_ODDS = 5.0            # weight of a learned term, at most
WINDOW = 4                # words of context on each side
BIAS = -1.5
QUOTED = 0.25             # factor of a hit that is quoted, reported or denied
ADDRESS = 1.5             # factor of a hit near words of address
FOLDS = 5                 # rows with crc32(doc_id) mod FOLDS = 0 are held out

REPORT = frozenset(("said", "says", "called", "quote", "quoted", "quotes", "wrote", "term", "word", "not", "never", "dit", "sagte", "dijo"))
ADDRESSED = frozenset(("you", "your", "youre", "u", "du", "ihr", "tu", "vous", "usted", "eres"))
LOOKALIKE = str.maketrans({"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s", "!": "i"})
_WORD = re.compile(r"[^\W_]+(?:[@$!*][^\W_]+)*|[\"“”«»„]")
_OPEN, _CLOSE, _BOTH = "“«„", "”»", '"'


def allowed_edits(n: int) -> int:
    return 2 if n >= 10 else 1 if n >= 5 else 0


class Trie:
    """Terms as nodes: children by character, the end's (term, weight, edits)."""

    def __init__(self) -> None:
        self.next: list[dict[str, int]] = [{}]
        self.end: list[tuple[str, float] | None] = [None]
        self.edits = [0]          # most edits that any term below allows
        self.start = [False]      # the term also matches as the start of a word

    def add(self, term: str, weight: float, edits: int, start: bool) -> None:
        at, path = 0, [0]
        for c in term:
            if c not in self.next[at]:
                self.next[at][c] = len(self.next)
                self.next.append({})
                self.end.append(None)
                self.edits.append(0)
                self.start.append(False)
            at = self.next[at][c]
            path.append(at)
        self.end[at], self.start[at] = (term, weight), start
        for p in path:
            self.edits[p] = max(self.edits[p], edits)


class Matcher:
    """The product automaton, its states made when a word first needs them.

    An item is (node, edits, pending): pending is a character that a swap of
    neighbours still has to read, or ''."""

    #: Bounds of what a task remembers (states and words are made again when needed).
    MAX_STATES, MAX_WORDS = 10_000, 100_000

    def __init__(self, terms: list[tuple[str, float, int, bool]], ordinary: list[str] = ()) -> None:
        self.trie = Trie()
        self.ordinary = frozenset(ordinary)
        self.limit = {t: e for t, _, e, _ in terms}
        for t, w, e, s in terms:
            self.trie.add(t, w, e, s)
        self.words: dict[str, tuple[str, float, int] | None] = {}
        self._reset()

    def _reset(self) -> None:
        self.ids: dict[frozenset, int] = {}
        self.sets: list[frozenset] = []
        self.go: list[dict[str, int]] = []
        self.hit: list[tuple[str, float, int] | None] = []
        self.prefix: list[tuple[str, float, int] | None] = []
        self.first = self._state(self._close({(0, 0, "")}))

    def _close(self, items: set) -> frozenset:
        """Adds the deletions of term characters."""
        todo = list(items)
        while todo:
            node, e, pend = todo.pop()
            if pend or e >= self.trie.edits[node]:
                continue
            for child in self.trie.next[node].values():
                new = (child, e + 1, "")
                if e + 1 <= self.trie.edits[child] and new not in items:
                    items.add(new)
                    todo.append(new)
        return frozenset(items)

    def _state(self, items: frozenset) -> int:
        if items in self.ids:
            return self.ids[items]
        self.ids[items] = i = len(self.sets)
        self.sets.append(items)
        self.go.append({})
        best = start = None
        for node, e, pend in items:
            end = self.trie.end[node]
            if pend or end is None or e > self.limit[end[0]]:
                continue
            if best is None or (e, -end[1]) < (best[2], -best[1]):
                best = (end[0], end[1], e)
            if e == 0 and self.trie.start[node]:
                start = (end[0], end[1], 0)
        self.hit.append(best)
        self.prefix.append(start)
        return i

    def _step(self, state: int, c: str) -> int:
        out = set()
        for node, e, pend in self.sets[state]:
            if pend:
                if pend == c:
                    out.add((node, e, ""))
                continue
            child = self.trie.next[node].get(c)
            if child is not None:
                out.add((child, e, ""))
            if e < self.trie.edits[node]:
                out.add((node, e + 1, ""))                                   # an extra character
                for x, other in self.trie.next[node].items():
                    if x != c and e + 1 <= self.trie.edits[other]:
                        out.add((other, e + 1, ""))                          # another character
                        deep = self.trie.next[other].get(c)
                        if deep is not None and e + 1 <= self.trie.edits[deep]:
                            out.add((deep, e + 1, x))                        # neighbours swapped
        return self._state(self._close(out)) if out else -1

    def match(self, word: str) -> tuple[str, float, int] | None:
        """(term, weight, edits) of the best term for a lower-cased word."""
        if word in self.words:
            return self.words[word]
        if len(self.words) > self.MAX_WORDS:
            self.words.clear()
        if len(self.sets) > self.MAX_STATES:
            self._reset()
        at, found = self.first, None
        for c in word if word not in self.ordinary else "":
            nxt = self.go[at].get(c)
            if nxt is None:
                nxt = self.go[at][c] = self._step(at, c)
            at = nxt
            if at < 0:
                break
            found = self.prefix[at] or found
        if at >= 0 and self.hit[at] is not None and (found is None or self.hit[at][2] == 0):
            found = self.hit[at]
        if found and found[2] and word[0] != found[0][0]:      # misspellings keep the first letter
            found = None
        self.words[word] = found
        return found


def evidence(text: str | None, matcher: Matcher) -> tuple[float, int]:
    """Summed weights of the hits in their context, and the number of hits."""
    total, hits = 0.0, 0
    if not text:
        return total, hits
    tokens = _WORD.findall(text.lower())
    if _BOTH in text or any(c in text for c in _OPEN + _CLOSE):
        quoted, inside, words = [], False, []
        for t in tokens:
            if t in _BOTH:
                inside = not inside
            elif t in _OPEN:
                inside = True
            elif t in _CLOSE:
                inside = False
            else:
                words.append(t)
                quoted.append(inside)
    else:
        words, quoted = tokens, None
    known = matcher.words
    for i, w in enumerate(words):
        m = known.get(w, _MISS)
        if m is _MISS:
            m = matcher.match(w)
            if m is None and (plain := w.translate(LOOKALIKE).replace("*", "")) != w:
                m = matcher.match(plain)
            known[w] = m
        if m is None:
            continue
        hits += 1
        factor = 1.0 if m[2] == 0 else 0.6 if len(m[0]) > 5 else 0.45
        around = words[max(0, i - WINDOW):i]
        if (quoted and quoted[i]) or not REPORT.isdisjoint(around):
            factor *= QUOTED
        elif not ADDRESSED.isdisjoint(around) or not ADDRESSED.isdisjoint(words[i + 1:i + 1 + WINDOW]):
            factor *= ADDRESS
        total += m[1] * factor
    return total, hits


_MISS = object()


def score_of(total: float) -> float:
    return 1.0 / (1.0 + math.exp(-min(BIAS + total, 60.0)))


def held_out(doc_id="doc_id", folds: int = FOLDS):
    """True for the rows that training must not see."""
    return F.coalesce(F.pmod(F.crc32(F.col(doc_id).cast("string").cast("binary")), F.lit(folds)) == 0, F.lit(False))


def learn_terms(docs: DataFrame, labels: DataFrame) -> tuple[list[tuple[str, float, bool | None]], DataFrame | None]:
    """(term, weight, is a word start; None for a whole word that a learned word
    start covers) learned from the labelled rows of the
    training folds, and the counts of all their terms.  What reaches the driver
    are terms that recur in toxic rows of the sample (``TRAIN_ROWS`` rows at most,
    which also bounds the broadcast labels) and four totals."""
    lab = (labels.select(F.col("doc_id").alias("__id"), F.col("toxic").cast("int").alias("toxic"))
           .filter("toxic IS NOT NULL AND __id IS NOT NULL").filter(~held_out("__id"))
           .orderBy(F.xxhash64("__id"), "__id", "toxic").limit(TRAIN_ROWS))
    rows = docs.select("doc_id", "text").join(F.broadcast(lab), F.col("doc_id") == F.col("__id")).select("text", "toxic")
    words = F.array_distinct(F.regexp_extract_all(F.lower(F.coalesce("text", F.lit(""))), F.lit(r"[\p{L}\p{N}]+"), F.lit(0)))
    starts = lambda w: F.transform(F.sequence(F.lit(4), F.lit(8)), lambda k: F.when(F.length(w) > k, F.concat(F.substring(w, F.lit(1), k), F.lit("*"))))
    terms = F.array_distinct(F.concat(F.filter(words, lambda w: F.length(w).between(3, 24)),
                                      F.filter(F.flatten(F.transform(words, starts)), lambda t: t.isNotNull())))
    # near copies count once: of the texts with the same two longest words and mark, a term counts once
    longest = F.slice(F.array_sort(F.transform(words, lambda w: F.struct((-F.length(w)).alias("n"), w.alias("w")))), 1, 2)
    split = rows.select("toxic", F.md5(F.to_json(longest)).alias("group"), terms.alias("terms"))
    split = materialize(split.withColumn("half", F.pmod(F.xxhash64("group"), F.lit(2)).cast("int")), "training")
    toxic, clean = F.col("toxic"), 1 - F.col("toxic")
    sums = lambda: [F.sum(x * (F.col("half") == h).cast("int")).alias(f"{n}{h}") for n, x in (("t", toxic), ("c", clean)) for h in (0, 1)]
    all_ = {k: int(v or 0) for k, v in split.select("toxic", "group", "half").distinct().agg(*sums()).first().asDict().items()}
    n_t, n_c = all_["t0"] + all_["t1"], all_["c0"] + all_["c1"]
    if not n_t or not n_c:
        return [], None
    per = split.select("toxic", "group", "half", F.explode("terms").alias("term")).distinct().groupBy("term").agg(*sums())
    per = materialize(per.withColumn("t", F.col("t0") + F.col("t1")).withColumn("c", F.col("c0") + F.col("c1")), "terms")
    t, c, n = F.col("t"), F.col("c"), F.col("t") + F.col("c")
    odds = lambda t, c, n_t, n_c: F.log((t + 0.5) / (n_t + 1.0)) - F.log((c + 0.5) / (n_c + 1.0))
    part = lambda x, share: F.when(x > 0, x * F.log(x / (n * share))).otherwise(0.0)
    gain = 2 * (part(t, n_t / (n_t + n_c)) + part(c, n_c / (n_t + n_c)))
    holds = [odds(F.col(f"t{h}"), F.col(f"c{h}"), all_[f"t{h}"], all_[f"c{h}"]) >= HALF_ODDS for h in (0, 1)]
    best = (per.withColumn("odds", odds(t, c, n_t, n_c)).withColumn("gain", gain)
            .filter((F.col("gain") >= MIN_GAIN) & (F.col("odds") >= MIN_ODDS) & holds[0] & holds[1]).select("term", "odds").collect())
    # a start inside a broader start of no lower odds adds nothing, a whole word its misspellings
    out: list[tuple[str, float, bool | None]] = []
    have: dict[str, float] = {}
    for r in sorted(best, key=lambda r: (len(r["term"].rstrip("*")), r["term"])):
        t, start = r["term"].rstrip("*"), r["term"].endswith("*")
        if any(have.get(t[:k], -1e9) >= r["odds"] - 1.5 for k in range(4, len(t) + (not start))):
            if not start:
                out.append((t, min(float(r["odds"]), MAX_ODDS), None))
            continue
        if start:
            have[t] = r["odds"]
        out.append((t, min(float(r["odds"]), MAX_ODDS), start))
    return out, per


def ordinary_words(per: DataFrame | None, terms: list[tuple[str, float, int, bool]]) -> list[str]:
    """Words of clean training documents that pass for a misspelled term: they
    are words of their own (at most the words of the training rows)."""
    if per is None:
        return []

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = Matcher(terms)
        for b in batches:
            near = [(m := matcher.match(w)) is not None and m[2] > 0 for w in b.column(0).to_pylist()]
            yield b.filter(pa.array(near, pa.bool_()))

    words = per.filter("c > 0 AND t <= c AND NOT endswith(term, '*')").select("term")
    return sorted(r["term"] for r in words.mapInArrow(run, "term string").collect())


def lexicon(learned: list[tuple[str, float, bool | None]]) -> list[tuple[str, float, int, bool]]:
    """(term, weight, edits, is a start) of the learned terms.  Whole words may
    be misspelled, word starts not."""
    words = {t for t, _, start in learned if start is False}
    out: dict[str, tuple[str, float, int, bool]] = {}
    for t, w, start in learned:
        if not start:
            out[t] = (t, w, allowed_edits(len(t)), False)
        elif t not in out and not any(x.startswith(t) for x in words):   # the start of a learned word is that word's business
            out[t] = (t, w, 0, True)
    return list(out.values())


def score_documents(docs: DataFrame, terms: list[tuple[str, float, int, bool]], ordinary: list[str], keep: tuple[str, ...] = ("doc_id",),
                    names: tuple[str, str, str] = ("score", "predicted", "n_hits")) -> DataFrame:
    """The columns ``keep`` and score, predicted, n_hits (under ``names``): a row
    per document."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = Matcher(terms, ordinary)
        for b in batches:
            found = [evidence(t.as_py(), matcher) for t in b.column(b.num_columns - 1)]
            score = [score_of(x) for x, _ in found]
            yield pa.RecordBatch.from_arrays(
                [*b.columns[:-1], pa.array(score, pa.float64()), pa.array([int(s >= 0.5) for s in score], pa.int32()),
                 pa.array([n for _, n in found], pa.int64())], names=[*keep, *names])

    out = T.StructType([*docs.select(*keep).schema.fields, *(T.StructField(n, t) for n, t in zip(names, (T.DoubleType(), T.IntegerType(), T.LongType()), strict=True))])
    return docs.select(*keep, F.col("text").cast("string").alias(free_name(docs, "scored_text"))).mapInArrow(run, out)


def fit(docs: DataFrame, labels: DataFrame) -> tuple[list[tuple[str, float, int, bool]], list[str]]:
    """The lexicon and the ordinary words near it."""
    learned, per = learn_terms(docs, labels)
    terms = lexicon(learned)
    return terms, ordinary_words(per, terms)


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted, n_hits: a row per document."""
    return score_documents(docs, *fit(docs, labels)).select("doc_id", held_out().alias("held_out"), "score", "predicted", "n_hits")


def keep_clean(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents that are not predicted toxic, with all their columns."""
    cols = tuple(docs.columns)
    names = tuple(free_name(docs, n) for n in ("score", "predicted", "n_hits"))
    return score_documents(docs, *fit(docs, labels), keep=cols, names=names).filter(F.col(names[1]) == 0).select(*cols)
