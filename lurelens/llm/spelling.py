"""Spelling variant grouping by finite-state composition (operator 12).

Words are maximal runs of Latin letters, A-Z lower-cased; one run in 97 (by
crc32 of document id and run) loses a code point.  Words of five code points and
three occurrences make the vocabulary.  Two words are near if one inserted,
deleted or replaced code point turns one into the other; a word's form is its
most frequent near word if that one is at least twice as frequent.

1. Counts: one aggregation, partial before the shuffle.
2. Two near words, the shorter of m code points, share their first or their last
   m // 2 code points.  So the vocabulary is dealt out by initial state: the
   state that its acceptor reaches on such a prefix (or, with the ends taken
   off, a suffix), by m.  Every pair belongs to one state alone: to the prefix if
   the words agree that far, else to the suffix.  A state with more than
   ``CELLS`` letters behind it is dealt out again by half of what is left of its
   words, until it is small enough; an alphabet bounds what one letter can hold.
3. In each task the words behind a state become a minimised acceptor (states of
   equal right languages are one, built from the ends in numpy).  It is composed
   with the one-edit transducer and with itself: pairs of states advance on equal
   letters, take the edit once, at the first difference, and advance on equal
   letters again.  Where both sides reach the same state, all its words are
   accepted at once; the words' numbers come from counts along the path.
4. Near counts and best near words are reduced in the task, then by Spark.
5. Roots by pointer jumping: each round doubles the steps followed.

Defined results: null and empty texts have no words; a null id counts as the
empty string; rows of equal id count each; an empty table or vocabulary gives no
rows.  Letters are told apart by code point (composed and decomposed forms
differ).  Other columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize
from .textcore import U64, mix64

LETTERS = "[a-z\\u00C0-\\u00FF]+"
MIN_LENGTH, MIN_COUNT, ONE_IN = 5, 3, 97
CELLS = 1 << 20            # letters of one state's words that a task holds
NO_LIMIT = 1 << 30
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def vocabulary(docs: DataFrame, min_length: int = MIN_LENGTH, min_count: int = MIN_COUNT) -> DataFrame:
    """word, n: the words of all texts, with their planted misspellings."""
    runs = F.regexp_extract_all(F.translate(F.col("text").cast("string"), _UPPER, _LOWER), F.lit(LETTERS), F.lit(0))
    d = docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("id"), F.explode(runs).alias("run"))
    d = d.filter(F.length("run") >= min_length).select("run", F.crc32(F.concat("id", F.lit(":"), "run").cast("binary")).alias("h"))
    at = (F.col("h") % F.length("run")).cast("int")
    cut = F.concat(F.expr("substring(run, 1, cast(h % length(run) as int))"), F.substring("run", at + 2, F.length("run")))
    return (d.select(F.when(F.col("h") % ONE_IN == 0, cut).otherwise(F.col("run")).alias("word"))
            .filter(F.length("word") >= min_length).groupBy("word").agg(F.count("*").alias("n")).filter(F.col("n") >= min_count))


def _halves(rows: DataFrame, state: str, left: str, rest: str, limit: str, *keep: str) -> DataFrame:
    """Deals words out by the first and by the last half of ``left`` letters of
    ``rest``: state, left, limit, rest.  ``limit`` bounds the common prefix."""
    k = f"({left} div 2)"
    return rows.selectExpr(*keep, f"""explode(filter(array(
        named_struct('state', concat({state}, 'p', {left}, ':', substring({rest}, 1, {k})), 'left', {left} - {k},
                     'limit', {limit} - {k}, 'rest', substring({rest}, {k} + 1, length({rest}))),
        named_struct('state', concat({state}, 's', {left}, ':', substring({rest}, length({rest}) - {k} + 1, {k})), 'left', {left} - {k},
                     'limit', least({limit}, {k}), 'rest', substring({rest}, 1, length({rest}) - {k}))),
        x -> x.limit > 0)) as x""").select(*keep, "x.state", "x.left", "x.limit", "x.rest")


def initial_states(vocab: DataFrame, min_length: int = MIN_LENGTH, cells: int = CELLS) -> DataFrame:
    """word, n, state, left, limit, rest: every word under each of its initial
    states of at least two words, none of more than ``cells`` letters."""
    shortest = vocab.selectExpr("word", "n", f"explode(sequence(greatest({max(1, min_length)}, length(word) - 1), length(word))) as m")
    rows = _halves(shortest, "''", "m", "word", str(NO_LIMIT), "word", "n")
    parts = []
    while True:
        size = rows.groupBy("state").agg(F.count("*").alias("words"), F.max(F.col("left") + 1).alias("width")).filter("words > 1")
        size = materialize(size.select("state", ((F.col("words") * F.col("width") > cells) & (F.col("width") > 2)).alias("large")), "states")
        rows = rows.join(size, "state")
        parts.append(rows.filter("not large").drop("large"))
        if not size.filter("large").limit(1).count():
            break
        rows = materialize(_halves(rows.filter("large"), "concat(state, '|')", "left", "rest", "limit", "word", "n"), "split-states")
    out = parts[0].select(*(cols := ["word", "n", "state", "left", "limit", "rest"]))
    for p in parts[1:]:
        out = out.union(p.select(*cols))
    return out


def spans(lo: np.ndarray, n: np.ndarray) -> np.ndarray:
    """lo, lo + 1 .. lo + n - 1 of every pair, one after the other."""
    return np.repeat(lo - np.cumsum(n) + n, n) + np.arange(n.sum())


class Level:
    """Transitions of the states that stand before one column: ``first`` (of each
    state, and the end), ``label``, ``to`` and ``skip`` (words before this
    transition); ``words`` behind each state."""

    def __init__(self, first: np.ndarray, label: np.ndarray, to: np.ndarray, skip: np.ndarray, words: np.ndarray) -> None:
        self.first, self.label, self.to, self.skip, self.words = first, label, to, skip, words
        self.key = np.repeat(np.arange(len(first) - 1), np.diff(first)) << 21 | label

    def out(self, states: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row, transition) of all transitions from ``states``."""
        n = np.diff(self.first)[states]
        return np.repeat(np.arange(len(states)), n), spans(self.first[states], n)

    def find(self, states: np.ndarray, label: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(found, transition) by state and label."""
        want = states << 21 | label
        at = np.searchsorted(self.key, want)
        ok = at < len(self.key)
        ok[ok] = self.key[at[ok]] == want[ok]
        return ok, at


class Acceptor:
    """Minimised acceptor of sorted words, right-aligned in ``letters`` [word,
    column]; words of different ``owner`` have start states of their own."""

    def __init__(self, letters: np.ndarray, owner: np.ndarray) -> None:
        n, width = letters.shape
        differ = np.full(n, -1, np.int64)
        differ[1:] = np.where(owner[1:] != owner[:-1], -1, (letters[1:] != letters[:-1]).argmax(1))
        self.nodes = [np.flatnonzero(differ < c) for c in range(width + 1)]      # first word of each prefix of c columns
        self.states = [np.zeros(0, np.int64)] * width + [np.zeros(n, np.int64)]  # of each such prefix
        self.levels: list[Level] = [None] * width + [Level(np.zeros(2, np.int64), *[np.zeros(0, np.int64)] * 3, np.ones(1, np.int64))]
        for c in range(width - 1, -1, -1):
            here, below = self.nodes[c], self.nodes[c + 1]
            first = np.searchsorted(below, here)
            n_out = np.diff(np.append(first, len(below)))
            label, to = letters[below, c].astype(np.int64), self.states[c + 1]
            code = (to.astype(U64) << U64(21)) | label.astype(U64)
            sign = np.stack([np.add.reduceat(mix64(code + U64(s)), first) for s in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)], 1)
            _, at, state = np.unique(np.ascontiguousarray(sign).view("V16").ravel(), return_index=True, return_inverse=True)
            self.states[c] = state.ravel()
            own = spans(first[at], n_out[at])
            span = np.diff(np.append(here, n))
            self.levels[c] = Level(np.concatenate(([0], np.cumsum(n_out[at]))), label[own], to[own],
                                   below[own] - np.repeat(here[at], n_out[at]), span[at])

    def state(self, column: int, word: np.ndarray) -> np.ndarray:
        """State before ``column`` of the words that are first of their owner."""
        return self.states[column][np.searchsorted(self.nodes[column], word)]


def near_pairs(letters: np.ndarray, owner: np.ndarray, first0: np.ndarray, first1: np.ndarray, limit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Word numbers (u, v) that the composition of acceptor, one-edit transducer
    and acceptor accepts, each pair once.  For each initial state ``first0`` and
    ``first1`` are its first word without and with a letter in column 0 (-1:
    none); ``limit`` bounds the common prefix (of each word's state)."""
    acc = Acceptor(letters, owner)
    width = letters.shape[1]
    us, vs = [], []
    start = first0[first0 >= 0]
    same = (acc.state(1, start), start)                                   # one side alone: both read the same so far
    both = np.flatnonzero((first0 >= 0) & (first1 >= 0))
    longer = (acc.state(1, first0[both]), acc.state(0, first1[both]), first0[both], first1[both])
    none = np.zeros(0, np.int64)
    edited = (none, none, none, none, none)                               # after the edit: states, words, banned letter
    for c in range(1, width + 1):
        here, before = acc.levels[c], acc.levels[c - 1]
        # an inserted letter: the longer side reads it alone; the other's next letter must differ, so that the edit stands at the first difference
        row, t = before.out(longer[1])
        label, to, w2 = before.label[t], before.to[t], longer[3][row] + before.skip[t]
        free = limit[longer[2][row]] > c - 1
        edited = tuple(np.concatenate(x) for x in zip(edited, (longer[0][row[free]], to[free], longer[2][row[free]], w2[free], label[free]), strict=True))
        ok, t1 = here.find(longer[0][row], label)
        longer = (here.to[t1[ok]], to[ok], longer[2][row[ok]] + here.skip[t1[ok]], w2[ok])
        # equal states accept the same words
        s1, s2, w1, w2, ban = edited
        done = (s1 == s2) & ((ban == 0) | (c == width))
        many = here.words[s1[done]]
        us.append(spans(w1[done], many))
        vs.append(spans(w2[done], many))
        s1, s2, w1, w2, ban = (x[~done] for x in edited)
        row, t = here.out(s1)
        go = here.label[t] != ban[row]
        row, t = row[go], t[go]
        ok, t2 = here.find(s2[row], here.label[t])
        row, t, t2 = row[ok], t[ok], t2[ok]
        edited = (here.to[t], here.to[t2], w1[row] + here.skip[t], w2[row] + here.skip[t2], np.zeros(len(row), np.int64))
        # a replaced letter: two transitions of one state
        row, t = here.out(same[0])
        to, w = here.to[t], same[1][row] + here.skip[t]
        later = np.searchsorted(row, row, "right") - np.arange(len(row)) - 1
        later[limit[same[1][row]] <= c - 1] = 0
        a, b = np.repeat(np.arange(len(row)), later), spans(np.arange(len(row)) + 1, later)
        edited = tuple(np.concatenate(x) for x in zip(edited, (to[a], to[b], w[a], w[b], np.zeros(len(a), np.int64)), strict=True))
        same = (to, w)
    return np.concatenate(us), np.concatenate(vs)


def _compose(rows: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Near counts and best near words of whole states that have equal ``left``."""
    t = pa.Table.from_batches(rows)
    left = t.column("left")[0].as_py()
    rest, words = t.column("rest").to_pylist(), t.column("word").to_pylist()
    n, limit = t.column("n").to_numpy(), t.column("limit").to_numpy().astype(np.int64)
    states = t.column("state").combine_chunks().dictionary_encode().indices.to_numpy()
    long = np.fromiter((len(r) > left for r in rest), bool, len(rest))
    letters = np.zeros((len(rest), left + 1), np.uint32)
    for kind, from_ in ((False, 1), (True, 0)):
        if (long == kind).any():
            text = "".join(r for r, x in zip(rest, long, strict=True) if x == kind)
            letters[long == kind, from_:] = np.frombuffer(text.encode("utf-32-le"), np.uint32).reshape(-1, left + 1 - from_)
    owner = states.astype(np.int64) * 2 + long
    first = np.flatnonzero(np.append(True, owner[1:] != owner[:-1]))
    first0, first1 = (np.full(states.max() + 1, -1, np.int64) for _ in range(2))
    first0[states[first[~long[first]]]] = first[~long[first]]
    first1[states[first[long[first]]]] = first[long[first]]
    u, v = near_pairs(letters, owner, first0, first1, limit)
    if len(u):
        rank = np.empty(len(words), np.int64)
        rank[sorted(range(len(words)), key=words.__getitem__)] = np.arange(len(words))
        u, v = np.concatenate((u, v)), np.concatenate((v, u))
        order = np.lexsort((rank[v], -n[v], u))
        u, v = u[order], v[order]
        at = np.flatnonzero(np.append(True, u[1:] != u[:-1]))
        yield pa.RecordBatch.from_arrays([pa.array([words[i] for i in u[at]], pa.string()), pa.array(np.diff(np.append(at, len(u)))),
                                          pa.array(n[v[at]]), pa.array([words[i] for i in v[at]], pa.string())],
                                         names=["word", "n_near", "near_n", "near"])


def near_words(vocab: DataFrame, min_length: int = MIN_LENGTH, cells: int = CELLS) -> DataFrame:
    """word, n_near, near_n, near: of every word of ``vocab`` (word, n) that has
    near words their number, and the most frequent one (ties: the smallest)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        size, last = 0, None
        for b in batches:
            key = list(zip(b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True))
            a = 0
            for i in range(len(key) + 1):
                if i == len(key) or key[i] != last:
                    if i > a:
                        held.append(b.slice(a, i - a))
                        size, a = size + (i - a) * (last[1] + 1), i
                    if i < len(key):
                        if held and (size >= cells or key[i][1] != last[1]):
                            yield from _compose(held)
                            held, size = [], 0
                        last = key[i]
        if held:
            yield from _compose(held)

    dealt = initial_states(vocab, min_length, cells).repartition("state").sortWithinPartitions(
        "left", "state", F.length("rest"), "rest").select("word", "n", "state", "left", "limit", "rest")
    best = dealt.mapInArrow(run, "word string, n_near long, near_n long, near string")
    return (best.groupBy("word").agg(F.sum("n_near").alias("n_near"), F.min(F.struct(-F.col("near_n"), "near")).alias("b"))
            .select("word", "n_near", (-F.col("b.col1")).alias("near_n"), F.col("b.near").alias("near")))


def roots(links: DataFrame) -> DataFrame:
    """word, root of every word of ``links`` (word, form): where following the
    forms ends.  Forms must not run in circles."""
    now = materialize(links.select("word", F.col("form").alias("root")), "roots")
    while True:
        ahead = now.select(F.col("word").alias("root"), F.col("root").alias("further"))
        step = now.join(ahead, "root", "left")
        now = materialize(step.select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")), "roots")
        if not now.filter("moved").limit(1).count():
            return now.select("word", "root")


def variants(docs: DataFrame, min_length: int = MIN_LENGTH, min_count: int = MIN_COUNT) -> DataFrame:
    """word, form, root, n, n_near, form_n: a row per word of the vocabulary."""
    vocab = materialize(vocabulary(docs, min_length, min_count), "vocabulary")
    near = near_words(vocab, min_length)
    is_form = F.col("near_n") >= 2 * F.col("n")
    out = materialize(vocab.join(near, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(is_form, F.col("near")).alias("form"),
        F.when(is_form, F.col("near_n")).alias("form_n")), "forms")
    ends = roots(out.filter("form is not null"))
    return out.join(ends, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
