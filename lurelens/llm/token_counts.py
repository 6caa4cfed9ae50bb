"""Token counts by finite-state tokenizer compilation (operator 10).

A byte-level BPE tokenizer is compiled into two deterministic machines:

* a splitter over character classes (letter, number, blank, other white space,
  apostrophe, the letters that end a contraction, other) whose transitions say
  where a pre-token ends: the transition on a character carries the
  pre-token starts that it settles, on itself or one character back;
* a lexicon acceptor for whole pre-tokens whose final transition carries the
  number of tokens that the merges leave.  It is compiled as it is needed: each
  distinct pre-token is merged once by the vocabulary's own library and kept
  under its digest (a bounded table a worker).

Texts are cut into chunks of equal length whose first state is not known.  All
chunks advance together from every state at once, which gives each chunk's
state map; the maps compose by a parallel prefix scan over the chunks
(log2 steps), which gives each chunk's true first state; a last pass from the
true states marks pre-token starts.  Everything is array work over many
documents at once.

Strings of special tokens inside a text are cut out first and count one token
each, as the library does by default.

Defined results: null and empty text have 0 tokens; repeated rows and repeated
or null ids give a row each; an empty table gives an empty result; extra
columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import merger
from .textcore import U64, mix64

LIMIT = 512
CHUNK = 128            # characters a chunk of the scan
PART = 1 << 19         # characters worked on at once
LEXICON = 1_500_000    # pre-tokens kept by a worker

# character classes
L, N, B, S, A, O, C_ONE, C_E, C_L, C_R, C_V, C_D = range(12)
# L letter, N number, B blank (U+0020), S other white space, A apostrophe,
# O any other; the rest are letters that may stand in a contraction:
# C_ONE s t m, C_D d, C_E e, C_L l, C_R r, C_V v
N_CLASSES = 13
END = 12               # one after the text

# splitter states: what the current pre-token is
(START, LET, NUM, OTH, BLANK, SPACE, APO, APO_L, APO_R, APO_V, DONE) = range(11)
N_STATES = 11
# BLANK / SPACE: in a run of white space whose last character is / is not U+0020
# APO: an apostrophe that begins a pre-token; APO_x: that and a letter that
# begins a two-letter ending; DONE: a contraction has just ended

_LETTERS = (L, C_ONE, C_E, C_L, C_R, C_V, C_D)


def _compile() -> tuple[np.ndarray, np.ndarray]:
    """Transition table and marks [state, class].  Mark bits: 1 a pre-token
    starts at this character, 2 at the previous one."""
    go = np.zeros((N_STATES, N_CLASSES), np.uint8)
    mark = np.zeros((N_STATES, N_CLASSES), np.uint8)
    for s in range(N_STATES):
        for c in range(N_CLASSES):
            fresh = {N: NUM, O: OTH, B: BLANK, S: SPACE, A: APO}.get(c, LET)
            if c == END:
                go[s, c] = START
                continue
            letter = c in _LETTERS
            nxt, m = fresh, 1
            if s == LET and letter:
                nxt, m = LET, 0
            elif s == NUM and c == N:
                nxt, m = NUM, 0
            elif s == OTH and c in (O, A):
                nxt, m = OTH, 0
            elif s in (BLANK, SPACE):
                if c in (B, S):
                    nxt, m = fresh, 0
                elif s == BLANK:                      # the last blank joins what follows
                    nxt, m = (OTH if c in (O, A) else fresh), 2
                else:                                 # the last white space stands alone
                    nxt, m = fresh, 2 | 1
            elif s == APO:
                if c in (C_ONE, C_D):
                    nxt, m = DONE, 0
                elif c in (C_L, C_R, C_V):
                    nxt, m = {C_L: APO_L, C_R: APO_R, C_V: APO_V}[c], 0
                elif c in (O, A):
                    nxt, m = OTH, 0
            elif s in (APO_L, APO_R, APO_V):
                if (s == APO_L and c == C_L) or (s in (APO_R, APO_V) and c == C_E):
                    nxt, m = DONE, 0
                elif letter:                          # the letter began a word
                    nxt, m = LET, 2
                else:
                    nxt, m = fresh, 2 | 1
            go[s, c], mark[s, c] = nxt, m
    # at the end of the text a letter after an apostrophe stands as a word
    for s in (APO_L, APO_R, APO_V):
        mark[s, END] = 2
    return go, mark


GO, MARK = _compile()
_CLASS: list[np.ndarray] = []
_SAFE = re.compile("[!-~] [!-~]")


def char_classes() -> np.ndarray:
    """Class of every code point, from the Unicode properties that the
    pre-token pattern names."""
    if not _CLASS:
        import regex
        table = np.full(0x110000, O, np.uint8)
        every = "".join(map(chr, (*range(0xD800), *range(0xE000, 0x110000))))
        for pattern, cls in ((r"\p{L}", L), (r"\p{N}", N), (r"\s", S)):
            for m in regex.finditer(pattern + "+", every):
                table[np.frombuffer(m.group().encode("utf-32-le"), "<u4")] = cls
        # white space as the pattern's engine has it: the separators of
        # information U+001C..U+001F are not white space there
        table[0x1C:0x20] = O
        table[0x20], table[0x27] = B, A
        for chars, cls in (("stm", C_ONE), ("d", C_D), ("e", C_E), ("l", C_L), ("r", C_R), ("v", C_V)):
            for ch in chars:
                table[ord(ch)] = cls
        _CLASS.append(table)
    return _CLASS[0]


def pretoken_starts(cls: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Flags of the characters at which a pre-token starts.  ``cls``: classes
    of the concatenated texts; ``off``: first character of each text (length +
    1).  Each text gets an END class after it and is scanned from START."""
    nd = len(off) - 1
    n = len(cls) + nd
    padded = -(-max(n, 1) // CHUNK) * CHUNK
    x = np.full(padded, END, np.uint8)
    place = np.arange(len(cls)) + np.repeat(np.arange(nd), np.diff(off))
    x[place] = cls
    grid = np.ascontiguousarray(x.reshape(-1, CHUNK).T)          # [position, chunk]
    chunks = grid.shape[1]
    # state maps of all chunks, from every state at once
    flat_go = GO.ravel()
    state = np.repeat(np.arange(N_STATES, dtype=np.uint8)[:, None], chunks, 1)
    for j in range(CHUNK):
        state = flat_go[state.astype(np.uint16) * N_CLASSES + grid[j]]
    # parallel prefix scan: after step k each map covers 2**k chunks
    maps, step = state, 1
    cols = np.arange(chunks)
    while step < chunks:
        left = maps[:, :-step]
        maps = np.concatenate((maps[:, :step], maps[left, cols[step:][None, :]]), 1)
        step *= 2
    first = np.full(chunks, START, np.uint8)
    first[1:] = maps[START, :-1]
    # true pass
    marks = np.empty((CHUNK, chunks), np.uint8)
    state, flat_mark = first, MARK.ravel()
    for j in range(CHUNK):
        at = state.astype(np.uint16) * N_CLASSES + grid[j]
        marks[j] = flat_mark[at]
        state = flat_go[at]
    m = np.ascontiguousarray(marks.T).ravel()
    start = (m & 1).astype(bool)
    start[:-1] |= (m[1:] & 2) > 0
    return start[place]


class Lexicon:
    """Digest of a pre-token -> number of tokens, as sorted arrays: a large one
    and a recent one that is merged into it when it has grown to a share."""

    def __init__(self, path: str) -> None:
        self.merger = merger(path)
        self.special = self.merger.special
        self.clear()

    def clear(self) -> None:
        self.keys, self.counts = np.zeros(0, U64), np.zeros(0, np.int32)
        self.new_keys, self.new_counts = self.keys, self.counts

    def find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        counts, known = np.zeros(len(keys), np.int64), np.zeros(len(keys), bool)
        for k, c in ((self.keys, self.counts), (self.new_keys, self.new_counts)):
            if len(k):
                at = np.minimum(np.searchsorted(k, keys), len(k) - 1)
                hit = k[at] == keys
                counts[hit] = c[at[hit]]
                known |= hit
        return counts, known

    def add(self, keys: np.ndarray, words: list[str]) -> np.ndarray:
        ids = self.merger.ids
        counts = np.fromiter((len(ids(w.encode())) for w in words), np.int32, len(words))
        if len(self.keys) + len(self.new_keys) + len(keys) > LEXICON:
            self.clear()
        self.new_keys, self.new_counts = _sorted(np.append(self.new_keys, keys), np.append(self.new_counts, counts))
        if len(self.new_keys) > max(20_000, len(self.keys) // 8):
            self.keys, self.counts = _sorted(np.append(self.keys, self.new_keys), np.append(self.counts, self.new_counts))
            self.new_keys, self.new_counts = np.zeros(0, U64), np.zeros(0, np.int32)
        return counts


def _sorted(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(keys, kind="stable")
    return keys[order], counts[order]


@cache
def lexicon_of(path: str) -> Lexicon:
    """One a process: kept over the tasks that a worker runs."""
    return Lexicon(path)


_POW = np.ones(1, U64)
_POW_INV = np.ones(1, U64)


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    global _POW, _POW_INV
    if len(_POW) < n:
        base = 0xA0761D6478BD642F
        size = 1 << (n - 1).bit_length()
        for name, b in (("_POW", base), ("_POW_INV", pow(base, -1, 1 << 64))):
            a = np.full(size, b, U64)
            a[0] = 1
            globals()[name] = np.multiply.accumulate(a)
    return _POW, _POW_INV


def count_tokens(texts: list[str], lexicon: Lexicon) -> np.ndarray:
    """Tokens of each text (no special strings inside)."""
    lens = np.fromiter(map(len, texts), np.int64, len(texts))
    off = np.zeros(len(texts) + 1, np.int64)
    np.cumsum(lens, out=off[1:])
    whole = "".join(texts)
    if not whole:
        return np.zeros(len(texts), np.int64)
    points = np.frombuffer(whole.encode("utf-32-le", "surrogatepass"), "<u4")
    starts = np.flatnonzero(pretoken_starts(char_classes()[points], off))
    n = len(points)
    up, down = _powers(n + 1)
    run = np.empty(n + 1, U64)
    run[0] = 0
    np.cumsum((points.astype(U64) + U64(1)) * up[:n], out=run[1:])
    ends = np.append(starts[1:], n)
    keys = mix64((run[ends] - run[starts]) * down[starts])
    uniq, at, back = np.unique(keys, return_index=True, return_inverse=True)
    counts, known = lexicon.find(uniq)
    if not known.all():
        new = np.flatnonzero(~known)
        words = [whole[starts[i]:ends[i]] for i in at[new]]
        counts = counts.copy()
        counts[new] = lexicon.add(uniq[new], words)
    per = np.zeros(len(starts) + 1, np.int64)
    np.cumsum(counts[back], out=per[1:])
    return per[np.searchsorted(starts, off[1:])] - per[np.searchsorted(starts, off[:-1])]


def safe_parts(text: str) -> Iterator[str]:
    """A very long text in parts, cut before a blank between two printable
    ASCII characters: a pre-token always starts there."""
    a = 0
    while len(text) - a > 2 * PART and (m := _SAFE.search(text, a + PART)):
        yield text[a:m.start() + 1]
        a = m.start() + 1
    yield text[a:] if a else text


def batch_counts(texts: list[str | None], lexicon: Lexicon) -> np.ndarray:
    """Tokens of each text as the library counts them by default."""
    parts: list[str] = []
    owner: list[int] = []
    out = np.zeros(len(texts), np.int64)

    def flush() -> None:
        if parts:
            np.add.at(out, owner, count_tokens(parts, lexicon))
            parts.clear()
            owner.clear()

    size = 0
    for i, t in enumerate(texts):
        if not t:
            continue
        segments = [t]
        for s in lexicon.special:
            if s in t:
                nxt = []
                for seg in segments:
                    cut = seg.split(s)
                    out[i] += len(cut) - 1
                    nxt += cut
                segments = nxt
        for seg in segments:
            for part in safe_parts(seg):
                parts.append(part)
                owner.append(i)
                size += len(part)
                if size >= PART:
                    flush()
                    size = 0
    flush()
    return out


def token_counts(docs: DataFrame, vocabulary: str, limit: int = LIMIT) -> DataFrame:
    """doc_id, n_bytes (UTF-8), n_tokens, over_limit: a row per document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lexicon = lexicon_of(vocabulary)
        for batch in batches:
            for a in range(0, max(batch.num_rows, 1), 512):
                part = batch.slice(a, 512)
                texts = part.column(1).to_pylist()
                n = batch_counts(texts, lexicon)
                nb = np.fromiter((len(t.encode()) if t else 0 for t in texts), np.int64, len(texts))
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(nb), pa.array(n), pa.array(n > limit)],
                    names=["doc_id", "n_bytes", "n_tokens", "over_limit"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(
        run, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")
