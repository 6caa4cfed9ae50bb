"""Vectorised text work inside Arrow tasks: words, word hashes, n-gram hashes.

All functions work on the raw UTF-8 bytes of many documents at once.  A word
hash is a polynomial over byte codes modulo 2**64 taken from one running sum,
so a word costs a few array operations whatever its length; an n-gram hash is
the same construction over word hashes.  Both are finished with a bijective
mixer.  Hashes depend on the content alone: two runs, executors or batches
give the same value for the same text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U64 = np.uint64
_R = 0x9E3779B97F4A7C15 | 1          # odd, so invertible modulo 2**64
_Q = 0xD1342543DE82EF95
PIECE = 1 << 20                       # bytes of text worked on at once


def mix64(x: np.ndarray) -> np.ndarray:
    """Bijective 64-bit mixer (splitmix64 finish)."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


class _Powers:
    """base**i and base**-i modulo 2**64, grown on demand."""

    def __init__(self, base: int) -> None:
        self.base, self.inv = base, pow(base, -1, 1 << 64)
        self.up = self.down = np.ones(1, U64)

    def get(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            n = 1 << (n - 1).bit_length()
            for name, b in (("up", self.base), ("down", self.inv)):
                a = np.full(n, b, U64)
                a[0] = 1
                setattr(self, name, np.multiply.accumulate(a))
        return self.up, self.down


_BYTE_POW, _WORD_POW = _Powers(_R), _Powers(_Q)
_CODES = mix64(np.arange(1, 257, dtype=U64))
_LOWER_CODES = _CODES.copy()
_LOWER_CODES[65:91] = _CODES[97:123]
_IS_SPACE = np.zeros(256, bool)
_IS_SPACE[[32, 9, 10, 11, 12, 13]] = True


def text_buffers(arr: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets (length + 1) of a string column; null counts as empty."""
    if isinstance(arr, pa.ChunkedArray):
        arr = arr.combine_chunks()
    arr = arr.cast(pa.large_string()) if not pa.types.is_large_string(arr.type) else arr
    if arr.null_count:
        arr = arr.fill_null("")
    if len(arr) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offs, data = arr.buffers()
    off = np.frombuffer(offs, np.int64)[arr.offset:arr.offset + len(arr) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[off[0]:off[-1]], off - off[0]


def pieces(off: np.ndarray, limit: int = PIECE) -> Iterator[tuple[int, int]]:
    """Ranges of documents of about ``limit`` bytes (one at least)."""
    n, i = len(off) - 1, 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(off, off[i] + limit, "right")) - 1)
        yield i, min(j, n)
        i = min(j, n)


def _words_of(data: np.ndarray, off: np.ndarray, codes: np.ndarray):
    n = len(data)
    solid = ~_IS_SPACE[data]
    first = np.zeros(n + 1, bool)
    first[off] = True
    before = np.empty(n, bool)
    before[0] = False
    before[1:] = solid[:-1]
    start = np.flatnonzero(solid & (~before | first[:n]))
    after = np.empty(n, bool)
    after[-1] = False
    after[:-1] = solid[1:]
    end = np.flatnonzero(solid & (~after | first[1:])) + 1
    up, down = _BYTE_POW.get(n + 1)
    run = np.empty(n + 1, U64)
    run[0] = 0
    np.cumsum(codes[data] * up[:n], out=run[1:])
    h = mix64((run[end] - run[start]) * down[start])
    return h, start, end


def word_hashes(data: np.ndarray, off: np.ndarray, lower: bool = True):
    """(hash, start byte, end byte) of every word and, by document, the index
    of its first word (length + 1).  A word never crosses documents.  Very long
    documents are worked on in pieces cut at white space."""
    codes = _LOWER_CODES if lower else _CODES
    n, limit = len(data), 4 * PIECE
    if n == 0:
        e = np.zeros(0, np.int64)
        return np.zeros(0, U64), e, e, np.zeros(len(off), np.int64)
    if n <= limit:
        h, s, e = _words_of(data, off, codes)
    else:
        parts, a = [], 0
        while a < n:
            b = min(n, a + limit)
            if b < n:                 # back to white space or a document's start; else on to the next one
                cut = np.flatnonzero(_IS_SPACE[data[a:b]])
                doc = off[(off > a) & (off <= b)]
                best = max(int(cut[-1]) + 1 + a if len(cut) else 0, int(doc[-1]) if len(doc) else 0)
                if best <= a:
                    nxt = np.flatnonzero(_IS_SPACE[data[b:]])
                    later = off[off > b]
                    best = min(int(nxt[0]) + b + 1 if len(nxt) else n, int(later[0]) if len(later) else n)
                b = best
            inner = off[(off >= a) & (off <= b)] - a
            h, s, e = _words_of(data[a:b], np.unique(np.concatenate(([0], inner, [b - a]))), codes)
            parts.append((h, s + a, e + a))
            a = b
        h, s, e = (np.concatenate(x) for x in zip(*parts, strict=True))
    return h, s, e, np.searchsorted(s, off, "left")


def ngram_hashes(h: np.ndarray, k: int) -> np.ndarray:
    """Hash of the ``k`` words from each word on (n - k + 1 of them)."""
    n = len(h)
    if n < k:
        return np.zeros(0, U64)
    out, step = np.empty(n - k + 1, U64), 1 << 19
    for a in range(0, n - k + 1, step):
        b = min(n, a + step + k - 1)
        part = h[a:b]
        m = len(part)
        up, down = _WORD_POW.get(m + 1)
        run = np.empty(m + 1, U64)
        run[0] = 0
        np.cumsum(part * up[:m], out=run[1:])
        out[a:a + m - k + 1] = mix64((run[k:] - run[:m - k + 1]) * down[:m - k + 1] + U64(k))
    return out


def doc_ngrams(h: np.ndarray, woff: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """k-word shingle hashes document by document, with offsets (length + 1).
    A document of fewer words (one at least) has one shingle: all its words."""
    nw = np.diff(woff)
    nsh = np.where(nw >= k, nw - k + 1, (nw > 0).astype(np.int64))
    off = np.zeros(len(woff), np.int64)
    np.cumsum(nsh, out=off[1:])
    out = np.empty(int(off[-1]), U64)
    full = ngram_hashes(h, k)
    if len(full):
        keep = np.zeros(len(h), bool)
        lo, hi = woff[:-1], np.maximum(woff[1:] - k + 1, woff[:-1])
        mark = np.zeros(len(h) + 1, np.int64)
        np.add.at(mark, lo, 1)
        np.add.at(mark, hi, -1)
        keep = np.cumsum(mark[:-1]) > 0
        src = np.flatnonzero(keep)
        big = np.repeat(nw >= k, nsh)
        out[big] = full[src]
    for d in np.flatnonzero((nw > 0) & (nw < k)):
        part = h[woff[d]:woff[d + 1]]
        out[off[d]] = ngram_hashes(part, len(part))[0]
    return out, off


def distinct_by_doc(x: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct values of each document, with offsets."""
    if len(x) == 0:
        return x, off
    doc = np.repeat(np.arange(len(off) - 1), np.diff(off))
    order = np.lexsort((x, doc))
    x, doc = x[order], doc[order]
    new = np.ones(len(x), bool)
    new[1:] = (x[1:] != x[:-1]) | (doc[1:] != doc[:-1])
    x, doc = x[new], doc[new]
    return x, np.searchsorted(doc, np.arange(len(off)), "left")


def segment_min(x: np.ndarray, off: np.ndarray, empty) -> np.ndarray:
    """Minimum of each segment; ``empty`` for one without values."""
    out = np.full(len(off) - 1, empty, x.dtype)
    some = np.flatnonzero(off[1:] > off[:-1])
    if len(some):
        out[some] = np.minimum.reduceat(x, off[some])
    return out


def chunk_rows(n: int, size: int) -> Iterator[tuple[int, int]]:
    for a in range(0, n, size):
        yield a, min(n, a + size)
