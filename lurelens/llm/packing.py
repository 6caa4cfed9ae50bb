"""Packing by power-of-two decomposition (operator 7).

Every document becomes token ids followed by an end id, and is cut into pieces
of binary lengths: as many of ``max_len`` as fit, then one piece for each set
bit of the rest, longest first.  Pieces of one length form a bucket; each piece
is a sequence of its own, so no sequence crosses documents, and since every
length is a power of two no sequence needs padding.  Sequence ids number the
pieces bucket by bucket, longest bucket first.

Token ids: a text is cut at ASCII white space, which the tokenizer drops, and
every distinct piece between is encoded once a worker (a bounded cache); white
space never joins two tokens, so the ids equal those of the whole text.

Defined results: a null text counts as empty (one piece: the end id); repeated
rows and repeated or null ids each give their own pieces; an empty table gives
an empty result; extra columns are ignored.
"""

from __future__ import annotations

import re
import unicodedata
import zlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .bpe import merger
from .common import materialize
from .textcore import U64, pieces, text_buffers, word_hashes

MAX_LEN = 4096
END_ID = 2
BUCKETS = 4096        # hash buckets a length, for numbering without one large task
CACHE = 2_000_000     # distinct words kept by a worker
ODD = re.compile("[\x00-\x1f\x7f-\xa0԰-\U0010ffff]")   # left to the library, whose Unicode tables differ

PIECES = ("doc_id long, start long, length long, ids_crc32 long, doc_tokens long")


class WordIds:
    """Digest of the bytes between white space -> their token ids.

    Ids stand in one flat array; sorted digests hold each word's place there.
    A word is encoded when it is first met, by the vocabulary's own steps:
    compose, lower-case, split into contractions, letter runs, single digits
    and runs of other signs, merge."""

    def __init__(self, path: str) -> None:
        import regex
        self.merger = merger(path)
        self.split = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\s\p{L}\p{N}]+").findall
        self.clear()

    def clear(self) -> None:
        self.flat, self.used = np.zeros(1 << 16, np.uint32), 0
        none = (np.zeros(0, U64), np.zeros(0, np.int64), np.zeros(0, np.int64))
        self.main, self.recent = none, none

    def encode(self, word: bytes) -> list[int]:
        if word.isalpha():
            return self.merger.ids(word.lower())
        text = word.decode("utf-8", "replace")
        if "<|" in text or ODD.search(text):
            return self.merger.whole(text)
        if text.isascii():
            text = text.lower()
        else:
            text = "".join([c.lower() for c in unicodedata.normalize("NFC", text)])
        return [i for p in self.split(text) for i in self.merger.ids(p.encode())]

    def places(self, keys: np.ndarray, raw: bytes, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First id and number of ids of each of some distinct words."""
        if len(self.main[0]) + len(self.recent[0]) + len(keys) > CACHE:
            self.clear()
        at, n = np.zeros(len(keys), np.int64), np.full(len(keys), -1, np.int64)
        for k, p, c in (self.main, self.recent):
            if len(k):
                i = np.minimum(np.searchsorted(k, keys), len(k) - 1)
                hit = k[i] == keys
                at[hit], n[hit] = p[i[hit]], c[i[hit]]
        new = np.flatnonzero(n < 0)
        if len(new):
            found = [self.encode(raw[a:b]) for a, b in zip(start[new].tolist(), end[new].tolist(), strict=True)]
            n[new] = np.fromiter(map(len, found), np.int64, len(found))
            at[new] = self.used + np.concatenate(([0], np.cumsum(n[new])[:-1]))
            flat = np.fromiter((i for f in found for i in f), np.uint32)
            while self.used + len(flat) > len(self.flat):
                self.flat = np.concatenate((self.flat, np.zeros_like(self.flat)))
            self.flat[self.used:self.used + len(flat)] = flat
            self.used += len(flat)
            self.recent = merged(self.recent, (keys[new], at[new], n[new]))
            if len(self.recent[0]) > max(20_000, len(self.main[0]) // 8):
                self.main, self.recent = merged(self.main, self.recent), tuple(x[:0] for x in self.main)
        return at, n

    def ids(self, data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of some texts one after the other, and each text's first (length + 1)."""
        h, start, end, woff = word_hashes(data, off, lower=False)
        if not len(h):
            return np.zeros(0, np.uint32), np.zeros(len(off), np.int64)
        keys, first, back = np.unique(h, return_index=True, return_inverse=True)
        at, n = self.places(keys, data.tobytes(), start[first], end[first])
        n = n[back]
        ends = np.cumsum(n)
        ids = self.flat[np.repeat(at[back] - (ends - n), n) + np.arange(int(ends[-1]))]
        return ids, np.append(0, ends)[woff]


def merged(a: tuple, b: tuple) -> tuple:
    both = [np.concatenate(x) for x in zip(a, b, strict=True)]
    order = np.argsort(both[0], kind="stable")
    return tuple(x[order] for x in both)


@cache
def word_ids(path: str) -> WordIds:
    """One a process: kept over the tasks that a worker runs."""
    return WordIds(path)


def binary_lengths(n: int, max_len: int = MAX_LEN) -> list[int]:
    """``n`` as pieces of ``max_len`` and of its binary digits, longest first."""
    out = [max_len] * (n // max_len)
    rest = n % max_len
    return out + [1 << b for b in range(max_len.bit_length() - 1, -1, -1) if rest >> b & 1]


def doc_pieces(docs: DataFrame, vocabulary: str, max_len: int = MAX_LEN, end_id: int = END_ID,
               extra: bool = False) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens (and,
    with ``extra``, ``ids``: the token ids themselves)."""
    if max_len & (max_len - 1):
        raise ValueError("max_len must be a power of two")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = word_ids(vocabulary)
        end = np.asarray([end_id], "<u4").tobytes()
        for batch in batches:
            data, off = text_buffers(batch.column(1))
            doc_ids = batch.column(0).to_pylist()
            rows: list[tuple] = []
            for i, j in pieces(off):
                ids, first = words.ids(data[off[i]:off[j]], off[i:j + 1] - off[i])
                for d in range(i, j):
                    raw = ids[first[d - i]:first[d - i + 1]].tobytes() + end
                    n, at = len(raw) // 4, 0
                    for m in binary_lengths(n, max_len):
                        part = raw[4 * at:4 * (at + m)]
                        rows.append((doc_ids[d], at, m, zlib.crc32(part), n, part if extra else None))
                        at += m
                if len(rows) >= 20_000:
                    yield pack(rows)
                    rows = []
            if rows:
                yield pack(rows)

    def pack(rows: list[tuple]) -> pa.RecordBatch:
        cols = list(zip(*rows, strict=True))
        arrays = [pa.array(c, pa.int64()) for c in cols[:5]]
        names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]
        if extra:
            arrays.append(pa.array([np.frombuffer(p, "<u4").tolist() for p in cols[5]], pa.list_(pa.int32())))
            names.append("ids")
        return pa.RecordBatch.from_arrays(arrays, names=names)

    schema = PIECES + (", ids array<int>" if extra else "")
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(cut, schema)


def number_sequences(parts: DataFrame) -> DataFrame:
    """Adds sequence_id (gapless from 0, bucket by bucket, longest first) and
    offset 0.  Ranks are taken inside (length, hash) buckets and shifted by the
    number of pieces in earlier buckets, so no bucket is ordered as a whole."""
    p = parts.withColumn("__b", F.pmod(F.xxhash64("doc_id", "start", "ids_crc32"), F.lit(BUCKETS)))
    counts = p.groupBy("length", "__b").agg(F.count("*").alias("__n"))
    # at most 13 lengths: two small steps, first within a length, then over lengths
    w = Window.partitionBy("length").orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
    inside = counts.withColumn("__in", F.coalesce(F.sum("__n").over(w), F.lit(0)))
    lengths = counts.groupBy("length").agg(F.sum("__n").alias("__t"))
    wl = Window.orderBy(F.col("length").desc()).rowsBetween(Window.unboundedPreceding, -1)
    before = lengths.withColumn("__before", F.coalesce(F.sum("__t").over(wl), F.lit(0))).drop("__t")
    offsets = inside.join(F.broadcast(before), "length").select("length", "__b", (F.col("__in") + F.col("__before")).alias("__off"))
    wr = Window.partitionBy("length", "__b").orderBy("doc_id", "start", "ids_crc32")
    return (p.withColumn("__r", F.row_number().over(wr))
            .join(offsets, ["length", "__b"])
            .withColumn("sequence_id", (F.col("__off") + F.col("__r") - 1).cast("long"))
            .withColumn("offset", F.lit(0).cast("long"))
            .drop("__b", "__r", "__off"))


def pack_documents(docs: DataFrame, vocabulary: str, max_len: int = MAX_LEN, end_id: int = END_ID) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset: one
    row per piece.  The pieces (no ids) are written once before numbering, so
    texts are tokenized once."""
    cut = materialize(doc_pieces(docs, vocabulary, max_len, end_id), "pieces")
    cols = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    return number_sequences(cut).select(*cols)
