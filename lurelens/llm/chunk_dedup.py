"""Substring deduplication by content-defined chunking (operator 9).

A gear rolling hash runs over the bytes of a text (each byte's code is added
to the hash shifted by one, kept to the last 16 bytes).  A cut is
made after a byte whose hash is the largest within ``REACH`` bytes on both
sides, so cuts depend on nearby content alone: an insertion moves only the cuts
next to it.  Chunks have variable length (about 2 * REACH bytes).  Text that
repeats itself after at most REACH bytes (a word said over and over, lines of
dashes) has equal largest hashes, one a period; there the first is a cut and
then each that lies a fixed number of periods, over REACH bytes, further on.  The unit of comparison is a run of ``RUN`` consecutive chunks,
taken at every cut and named by its digest, so that common phrases of a single
chunk do not count.

Runs whose digest occurs in two documents are repeats; overlapping runs of a
document join into a span.  A span of at least ``MIN_BYTES`` bytes is reported
with the place of its first occurrence (smallest id, then start; runs of one
digest that overlap or touch from there on are one occurrence); a passage of
fifty words holds such a span, a repeated line does not.

Plan: runs are counted by digest (partial counts before the shuffle); those of
digests that occur twice are kept by a join on the digest and written; on these
few the first place of each digest is found and joined back.  Runs of one digest
that follow each other in a text (text that repeats itself) are one row before
any shuffle, and the joins deal hot digests out over parts of their documents.

Defined results: null, empty and short text has no run; what repeats only inside
one document is no repeat; rows of equal id and text are one document, rows of
equal id and different texts are documents of their own; null ids take no part;
an empty table gives an empty result; extra columns are ignored, whatever their
names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import free_name, materialize
from .suffix_dedup import join_hot
from .textcore import PIECE, U64, mix64, pieces, text_buffers

REACH = 16            # bytes on either side over which a cut's hash is the largest
RUN = 4               # chunks in a compared run
MIN_BYTES = 150       # bytes of a reported span
WARM = 16             # bytes that the rolling hash sees

_GEAR = (mix64(np.arange(1, 257, dtype=U64)) >> U64(32)).astype(np.uint32)
_DIGEST = mix64(np.arange(1001, 1257, dtype=U64))
_BASE = 0xD6E8FEB86659FD93


def gear(data: np.ndarray) -> np.ndarray:
    """Rolling hash after each byte: sum of gear[b[i - j]] << j over 16 bytes, by doubling."""
    h = _GEAR[data]
    step = 1
    while step < WARM:
        nxt = h.copy()
        nxt[step:] += h[:-step] << np.uint32(step)
        h, step = nxt, step * 2
    return h


def window_max(x: np.ndarray, reach: int) -> np.ndarray:
    """Largest value within ``reach`` places to the left (itself included)."""
    out, have = x.copy(), 1
    while have <= reach:
        step = min(have, reach + 1 - have)
        nxt = out.copy()
        nxt[step:] = np.maximum(out[step:], out[:-step])
        out, have = nxt, have + step
    return out


def cut_places(data: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Cuts (a cut at i ends a chunk before byte i) of concatenated texts,
    away from the texts' first bytes, where the hash is not settled."""
    n = len(data)
    if n == 0:
        return np.zeros(0, np.int64)
    h = gear(data)
    right = window_max(h[::-1], REACH)[::-1]
    left = np.zeros(n, np.uint32)               # the largest of the REACH hashes before
    left[1:] = window_max(h, REACH - 1)[:-1]
    top = (h == right) & (h >= left)
    at = np.flatnonzero(top)
    d = np.searchsorted(off, at, "right") - 1
    # the hash and both windows must lie inside the text
    ok = (at - off[d] >= WARM - 1 + REACH) & (off[d + 1] - at > REACH)
    return thinned(at[ok]) + 1


def thinned(at: np.ndarray) -> np.ndarray:
    """Of places at equal steps of at most REACH bytes (equal hashes: the text
    repeats itself) the first and each that lies a fixed number of steps, over
    REACH bytes, after it; all other places."""
    if len(at) < 2:
        return at
    step = np.diff(at, prepend=at[0] - REACH - 1)
    start = np.flatnonzero((step > REACH) | (step != np.append(0, step[:-1])))
    nth = np.arange(len(at)) - np.repeat(start, np.diff(np.append(start, len(at))))
    every = np.where(step > REACH, 1, -(-(REACH + 1) // step))
    return at[nth % every == 0]


def runs_of(data: np.ndarray, off: np.ndarray, run: int = RUN) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(document, start, end, digest) of each run of ``run`` chunks; start and
    end count bytes of the document."""
    cuts = cut_places(data, off)
    if len(cuts) <= run:
        e = np.zeros(0, np.int64)
        return e, e, e, np.zeros(0, U64)
    a, b = cuts[:-run], cuts[run:]
    d = np.searchsorted(off, a, "right") - 1
    same = b <= off[d + 1]
    a, b, d = a[same], b[same], d[same]
    up, down = _powers(len(data) + 1)
    total = np.empty(len(data) + 1, U64)
    total[0] = 0
    np.cumsum(_DIGEST[data] * up[:len(data)], out=total[1:])
    dig = mix64((total[b] - total[a]) * down[a] + (b - a).astype(U64))
    return d, a - off[d], b - off[d], dig


_POW: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    size = 1 << (n - 1).bit_length()
    have = max(_POW, default=0)
    if have < size:
        out = []
        for b in (_BASE, pow(_BASE, -1, 1 << 64)):
            p = np.full(size, b, U64)
            p[0] = 1
            out.append(np.multiply.accumulate(p))
        _POW.clear()
        _POW[size] = (out[0], out[1])
        have = size
    return _POW[have]


def text_runs(data: np.ndarray, off: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """``runs_of`` by parts; a very long text in overlapping windows, each run
    given once."""
    limit, lap = 4 * PIECE, 1 << 16
    for i, j in pieces(off):
        lo, hi = int(off[i]), int(off[j])
        if hi - lo <= limit or j > i + 1:
            d, a, b, g = runs_of(data[lo:hi], off[i:j + 1] - lo)
            yield d + i, a, b, g
            continue
        at, last = lo, -1
        while at < hi:
            end = min(hi, at + limit)
            _, a, b, g = runs_of(data[at:end], np.array([0, end - at]))
            new = a + (at - lo) > last
            a, b, g = a[new] + (at - lo), b[new] + (at - lo), g[new]
            if len(a):
                last = int(a[-1])
                yield np.full(len(a), i), a, b, g
            if end == hi:
                break
            at = end - lap


def stretches(d: np.ndarray, a: np.ndarray, b: np.ndarray, g: np.ndarray) -> tuple[np.ndarray, ...]:
    """Runs of one document and digest that overlap or touch one after the other
    as one."""
    if not len(d):
        return d, a, b, g
    more = (d[1:] == d[:-1]) & (g[1:] == g[:-1]) & (a[1:] <= b[:-1])
    at = np.flatnonzero(np.append(True, ~more))
    return d[at], a[at], np.maximum.reduceat(b, at), g[at]


def text_key():
    return F.xxhash64("text")


def chunk_runs(docs: DataFrame) -> DataFrame:
    """digest, doc_id, key (of the text), start, length (bytes): the runs of
    every document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, off = text_buffers(batch.column(2))
            ids, keys = (batch.column(c).to_numpy(zero_copy_only=False) for c in (0, 1))
            for found in text_runs(data, off):
                d, a, b, g = stretches(*found)
                for x in range(0, len(d), 50_000):
                    y = x + 50_000
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(g[x:y].view(np.int64)), pa.array(ids[d[x:y]], pa.int64()), pa.array(keys[d[x:y]], pa.int64()), pa.array(a[x:y]), pa.array(b[x:y] - a[x:y])],
                        names=["digest", "doc_id", "key", "start", "length"])

    d = docs.filter("doc_id IS NOT NULL").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return d.select("doc_id", text_key().alias("key"), "text").mapInArrow(run, "digest long, doc_id long, key long, start long, length long")


def repeats(docs: DataFrame) -> DataFrame:
    """doc_id, key, start, end (bytes), first (whether this is the first place of
    its digest), first_doc, first_start: every run that occurs in two documents.
    In the first document, runs of the digest that overlap or touch one after
    the other from the first place on are part of it."""
    twice = materialize(chunk_runs(docs).groupBy("digest").agg(F.count("*").alias("n")).filter("n > 1"), "digests")
    marked = materialize(join_hot(chunk_runs(docs), twice, "digest", ["doc_id", "start"]), "runs")
    first = marked.groupBy("digest").agg(F.count("*").alias("n"), F.min(F.struct("doc_id", "key", "start")).alias("lo"), F.max(F.struct("doc_id", "key")).alias("hi"))
    first = materialize(first.filter("lo.doc_id <> hi.doc_id OR lo.key <> hi.key").select("digest", "n", "lo"), "first-places")
    runs = join_hot(marked, first, "digest", ["doc_id", "start"]).select(
        "digest", "doc_id", "key", "start", (F.col("start") + F.col("length")).alias("end"), "lo")
    # by document, as the spans are joined next
    w = Window.partitionBy("doc_id", "key", "digest").orderBy("start")
    apart = F.when(F.lag("end").over(w) < F.col("start"), 1).otherwise(0)
    mine = (F.col("doc_id") == F.col("lo.doc_id")) & (F.col("key") == F.col("lo.key"))
    return (runs.repartition("doc_id", "key").withColumn("__apart", apart).withColumn("__apart", F.sum("__apart").over(w))
            .select("doc_id", "key", "start", "end", (mine & (F.col("__apart") == 0)).alias("first"),
                    F.col("lo.doc_id").alias("first_doc"), F.col("lo.start").alias("first_start")))


def joined(runs: DataFrame, min_bytes: int) -> DataFrame:
    """doc_id, key, start, end, is_first, first_doc, first_start, n_runs:
    overlapping or touching runs of a document as one span.  A document's runs
    are one group (as many as its text holds)."""
    w = Window.partitionBy("doc_id", "key").orderBy("start", "end")
    reach = F.max("end").over(w.rowsBetween(Window.unboundedPreceding, -1))
    s = (runs.withColumn("__new", F.when(reach.isNull() | (F.col("start") > reach), 1).otherwise(0))
         .withColumn("__span", F.sum("__new").over(w)))
    head = F.min_by(F.struct("first_doc", "first_start"), F.struct("start", "first_doc", "first_start"))
    return (s.groupBy("doc_id", "key", "__span").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.every("first").alias("is_first"),
                                              F.count("*").alias("n_runs"), head.alias("h"))
            .filter(F.col("end") - F.col("start") >= min_bytes)
            .select("doc_id", "key", "start", "end", "is_first", F.col("h.first_doc").alias("first_doc"), F.col("h.first_start").alias("first_start"), "n_runs"))


def repeated_spans(docs: DataFrame, min_bytes: int = MIN_BYTES) -> DataFrame:
    """doc_id, start_byte, n_bytes, first_doc, first_start_byte, is_first,
    n_runs: a row per span of repeated text.  Spans at the first occurrence are
    reported too (is_first)."""
    return joined(repeats(docs), min_bytes).select(
        "doc_id", F.col("start").alias("start_byte"), (F.col("end") - F.col("start")).alias("n_bytes"), "first_doc",
        F.col("first_start").alias("first_start_byte"), "is_first", "n_runs")


def drop_repeats(docs: DataFrame, min_bytes: int = MIN_BYTES) -> DataFrame:
    """The documents with all columns; of a passage that occurs at several
    places only the first stays, the others are cut out of the texts (at the
    chunk cuts inside the passage, widened to whole words).  ``n_chars`` follows
    the text; documents stay even if little text is left."""
    id_, key, cuts = (free_name(docs, "cut_" + x) for x in ("id", "key", "spans"))
    spans = (joined(repeats(docs).filter("NOT first"), min_bytes).groupBy(F.col("doc_id").alias(id_), F.col("key").alias(key))
             .agg(F.array_sort(F.collect_list(F.struct("start", "end"))).alias(cuts)))
    at, n_at = docs.columns.index("text"), next((i for i, c in enumerate(docs.columns) if c.lower() == "n_chars"), None)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts, sp = b.column(at).to_pylist(), b.column(b.num_columns - 1).to_pylist()
            for i, s in enumerate(sp):
                if s and texts[i]:
                    texts[i] = cut_out(texts[i].encode(), [(x["start"], x["end"]) for x in s])
            cols = list(b.columns[:-1])
            cols[at] = pa.array(texts, cols[at].type)
            if n_at is not None:
                was = cols[n_at].to_pylist()
                cols[n_at] = pa.array([len(t) if s and t is not None else n for t, s, n in zip(texts, sp, was, strict=True)], cols[n_at].type)
            yield pa.RecordBatch.from_arrays(cols, names=b.schema.names[:-1])

    keyed = docs.withColumn(id_, F.col("doc_id").cast("long")).withColumn(key, F.xxhash64(F.col("text").cast("string")))
    rows = keyed.join(spans, [id_, key], "left").select(*docs.columns, cuts)
    return rows.mapInArrow(run, docs.schema)


def cut_out(raw: bytes, spans: list[tuple[int, int]]) -> str:
    """A text without those spans (bytes), each widened to whole words."""
    out, last, blank = [], 0, b" \t\n\r\x0b\x0c"
    for a, b in spans:
        while a > last and raw[a - 1] not in blank:
            a -= 1
        while b < len(raw) and raw[b] not in blank:
            b += 1
        if a > last:
            out.append(raw[last:a])
        last = max(last, b)
    out.append(raw[last:])
    return b"".join(out).decode("utf-8", "replace")
