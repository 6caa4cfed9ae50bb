"""Document fingerprints by MinHash (operator 3).

A fingerprint is the vector of minima of ``PERMS`` universal hash functions
(a * x + b on 64-bit words, upper half kept) over a text's five-word shingles,
written as hexadecimal; likeness is the share of equal coordinates, an unbiased
estimate of the shingle sets' Jaccard similarity.

``fingerprint_edits`` gives every document's fingerprint, that of an edited text
(its last third replaced by the start of the next document), and their likeness.
The next document (descending id, after the last the first) is found without
ordering the table in one task: ids are cut into ranges at quantiles, each range
also gets a copy of the first document of the range after it, and a task streams
its range in order.  Texts are shuffled once.

``near_pairs`` joins signature bands in Spark and verifies the Jaccard
similarity on full shingle sets, of all pairs that share a band; documents with
equal shingle sets are one class (by a 128-bit digest of the sorted set).

Defined results: null text counts as empty; a text without words has the
fingerprint of the empty set, which is like itself and unlike all others; null
ids come last, equal ids are ordered by text; a single document is its own next;
an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize
from .textcore import U64, chunk_rows, distinct_by_doc, doc_ngrams, mix64, pieces, segment_min, text_buffers, word_hashes

K = 5
PERMS = 64
SEED = 20240229
GROUP_CHARS = 1 << 20
LONG = 1 << 20            # shingles of one document hashed at once
BLOCK = 512               # members of a bucket in a block

_RNG = np.random.default_rng(SEED)
_A = _RNG.integers(0, 1 << 63, PERMS, dtype=U64) * U64(2) + U64(1)
_B = _RNG.integers(0, 1 << 63, PERMS, dtype=U64)
EMPTY = np.uint32(0xFFFFFFFF)


def minima(shingles: np.ndarray, off: np.ndarray) -> np.ndarray:
    """[document, permutation] minima (32 bits)."""
    out = np.empty((len(off) - 1, PERMS), np.uint32)
    if len(shingles) <= 2 * LONG:
        for p in range(PERMS):
            out[:, p] = segment_min(((shingles * _A[p] + _B[p]) >> U64(32)).astype(np.uint32), off, EMPTY)
        return out
    for d in range(len(off) - 1):
        out[d] = EMPTY
        for a, b in chunk_rows(int(off[d + 1] - off[d]), LONG):
            part = shingles[off[d] + a:off[d] + b]
            for p in range(PERMS):
                out[d, p] = min(out[d, p], ((part * _A[p] + _B[p]) >> U64(32)).min().astype(np.uint32))
    return out


def fingerprints_of(texts: list[str]) -> np.ndarray:
    """[text, permutation] of some texts."""
    if not texts:
        return np.zeros((0, PERMS), np.uint32)
    data, off = text_buffers(pa.array(texts, pa.large_string()))
    parts = []
    for i, j in pieces(off):
        h, _, _, woff = word_hashes(data[off[i]:off[j]], off[i:j + 1] - off[i])
        parts.append(minima(*doc_ngrams(h, woff, K)))
    return np.concatenate(parts)


def as_hex(sig: np.ndarray) -> list[str]:
    raw = sig.astype(">u4").tobytes().hex()
    n = 8 * PERMS
    return [raw[i:i + n] for i in range(0, len(raw), n)]


def likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return (a == b).mean(axis=1)


def edited(text: str, nxt: str) -> str:
    """``text`` with its last third replaced by the start of ``nxt``."""
    k = len(text) // 3
    return text[:len(text) - k] + nxt[:k]


OUT = ("doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, "
       "near_edited double, near_next double")


def with_next(docs: DataFrame, ranges: int) -> DataFrame:
    """__range, __halo, doc_id, text: the documents by ranges of descending ids,
    each range with the document that follows it (__halo).  ``ranges`` bounds
    what reaches the driver: one boundary and one id a range."""
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    ids = d.select("doc_id")
    cuts = ids.filter("doc_id IS NOT NULL").approxQuantile("doc_id", [i / ranges for i in range(1, ranges)], 0.25 / ranges) if ranges > 1 else []
    cuts = sorted({int(c) for c in cuts}, reverse=True)
    # range 0 holds the largest ids; null ids are a last range of their own
    n = F.size(F.filter(F.array(*[F.lit(c) for c in cuts]), lambda c: c > F.col("doc_id"))) if cuts else F.lit(0)
    rng = F.when(F.col("doc_id").isNull(), F.lit(len(cuts) + 1)).otherwise(n).cast("int")
    firsts = ids.groupBy(rng.alias("r")).agg(F.max("doc_id").alias("first"), F.count("*").alias("n")).orderBy("r").collect()
    if not firsts:
        return d.select(F.lit(0).alias("__range"), F.lit(False).alias("__halo"), "doc_id", "text")
    # the range before the one that starts with an id (around the end)
    before = {firsts[i]["first"]: firsts[i - 1]["r"] for i in range(len(firsts))}
    pairs = [x for f, r in before.items() if f is not None for x in (F.lit(f), F.lit(r))]
    halo = F.create_map(*pairs)[F.col("doc_id")] if pairs else F.lit(None).cast("int")
    halo = F.when(F.col("doc_id").isNull(), F.lit(before.get(None))).otherwise(halo).cast("int")
    both = F.array(F.struct(rng.alias("r"), F.lit(False).alias("h")), F.struct(halo.alias("r"), F.lit(True).alias("h")))
    rows = d.select(F.explode(F.filter(both, lambda x: x["r"].isNotNull())).alias("__x"), "doc_id", "text")
    return rows.select(F.col("__x.r").alias("__range"), F.col("__x.h").alias("__halo"), "doc_id", "text")


def fingerprint_edits(docs: DataFrame) -> DataFrame:
    """The columns of ``OUT``, a row per document."""
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = (with_next(docs, 2 * n).repartition(2 * n, "__range")
            .sortWithinPartitions("__range", "__halo", F.col("doc_id").desc_nulls_last(), "text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # rows of a range in order; the last one waits for its next
        held: list[tuple] = []         # (doc_id, text) of one range, in order
        size, rng = 0, None

        def done(nxt: str) -> Iterator[pa.RecordBatch]:
            """All held documents; ``nxt`` is the text after the last."""
            texts = [t for _, t in held]
            after = texts[1:] + [nxt]
            edits = [edited(t, x) for t, x in zip(texts, after, strict=True)]
            own = fingerprints_of([*texts, nxt])
            other = fingerprints_of(edits)
            yield pa.RecordBatch.from_arrays([
                pa.array([i for i, _ in held], pa.int64()), pa.array([len(t) for t in texts], pa.int64()),
                pa.array([hashlib.sha256(e.encode()).hexdigest() for e in edits], pa.string()),
                pa.array(as_hex(own[:-1]), pa.string()), pa.array(as_hex(other), pa.string()),
                pa.array(likeness(own[:-1], other)), pa.array(likeness(own[:-1], own[1:]))],
                names=["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"])

        for b in batches:
            for r, halo, doc, text in zip(*(b.column(i).to_pylist() for i in range(4)), strict=True):
                if halo:
                    if held and r == rng:
                        yield from done(text)
                        held, size = [], 0
                    continue
                if size >= GROUP_CHARS and held and r == rng:
                    yield from done(text)
                    held, size = [], 0
                rng = r
                held.append((doc, text))
                size += len(text)

    return rows.select("__range", "__halo", "doc_id", "text").mapInArrow(run, OUT)


def fingerprint_table(docs: DataFrame) -> DataFrame:
    """doc_id, signature (little-endian 32-bit minima as bytes)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for a, z in chunk_rows(b.num_rows, 256):
                sig = fingerprints_of([t or "" for t in b.column(1).slice(a, z - a).to_pylist()])
                yield pa.RecordBatch.from_arrays([b.column(0).slice(a, z - a), pa.array([s.astype("<u4").tobytes() for s in sig], pa.binary())],
                                                 names=["doc_id", "signature"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, signature binary")


def set_classes(docs: DataFrame) -> DataFrame:
    """doc_id, digest (of the shingle set), signature: documents with shingles."""
    from .near_dedup import shingle_sets

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, j, sets, so in shingle_sets(b.column(1), K):
                sig, raw = minima(sets, so).astype("<u4"), sets.astype("<u8").tobytes()
                some = np.flatnonzero(np.diff(so))
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).slice(i, j - i).take(pa.array(some)), pa.array([set_digest(raw[8 * so[d]:8 * so[d + 1]]) for d in some], pa.binary()),
                     pa.array([sig[d].tobytes() for d in some], pa.binary())], names=["doc_id", "digest", "signature"])

    return (docs.filter("doc_id IS NOT NULL").select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
            .mapInArrow(run, "doc_id long, digest binary, signature binary"))


def set_digest(raw: bytes) -> bytes:
    return hashlib.blake2b(raw, digest_size=16).digest()


def block_pairs(ids: np.ndarray, sets: list[np.ndarray], bands: np.ndarray, band: int, one: np.ndarray, two: np.ndarray, similarity: float) -> Iterator[tuple[int, int, float]]:
    """(u, v, jaccard) of the pairs between the members ``one`` and ``two`` (of
    one block: its pairs) that share no band before ``band``, so that a pair is
    given by its first bucket only."""
    same = one is two
    values, place = np.unique(np.concatenate([sets[i] for i in two]), return_inverse=True)
    owner = np.repeat(np.arange(len(two)), [len(sets[i]) for i in two])
    order = np.argsort(place, kind="stable")
    owner, bounds = owner[order], np.searchsorted(place[order], np.arange(len(values) + 1))
    n = np.array([len(sets[i]) for i in two])
    for x, i in enumerate(one):
        s = sets[i]
        at = np.minimum(np.searchsorted(values, s), len(values) - 1)
        at = at[values[at] == s]
        both = np.bincount(np.concatenate([owner[bounds[k]:bounds[k + 1]] for k in at] or [owner[:0]]), minlength=len(two))
        jaccard = both / (len(s) + n - both)
        good = jaccard >= similarity
        if same:
            good[:x + 1] = False
        good &= ~(bands[two, :band] == bands[i, :band]).any(1)
        for y in np.flatnonzero(good):
            u, v = int(ids[i]), int(ids[two[y]])
            if u != v:
                yield min(u, v), max(u, v), float(jaccard[y])


def near_pairs(docs: DataFrame, similarity: float = 0.8, rows: int = 4) -> DataFrame:
    """u, v (u < v, the smallest id for each class of equal shingle sets),
    jaccard: all pairs of that similarity or more that share a band of ``rows``
    minima, verified on full shingle sets.  A bucket's members are cut into
    blocks of about ``BLOCK``; a task holds one pair of blocks."""
    classes = materialize(set_classes(docs).groupBy("digest").agg(F.min("doc_id").alias("doc_id"), F.first("signature").alias("signature")), "classes")
    size, n_bands = 4 * rows, PERMS // rows
    band = F.transform(F.sequence(F.lit(0), F.lit(n_bands - 1)), lambda i: F.substring(F.col("signature"), i * size + 1, F.lit(size)))
    keys = classes.select("digest", F.posexplode(band).alias("band", "key"))
    heads = keys.groupBy("band", "key").agg(F.ceil(F.count("*") / F.lit(BLOCK)).cast("int").alias("nb"), F.count("*").alias("n")).filter("n > 1").drop("n")
    held = materialize(keys.join(heads, ["band", "key"]), "buckets")
    from .near_dedup import full_sets
    wanted = classes.join(held.select("digest").distinct(), "digest", "left_semi")
    digest = F.udf(lambda raw: set_digest(bytes(raw)), "binary")
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).join(wanted.select("doc_id").distinct(), "doc_id", "left_semi")
    sets = full_sets(texts, K).select(digest("shingles").alias("digest"), "shingles").dropDuplicates(["digest"])
    sets = materialize(sets.join(wanted, "digest"), "sets")
    mine = F.pmod(F.xxhash64("digest"), F.col("nb")).cast("int")
    # a member of block b is in the block pairs (a, b), a <= b, and (b, c), c > b
    other = F.explode(F.sequence(F.lit(0), F.col("nb") - 1))
    rows_ = (held.withColumn("mine", mine).withColumn("other", other)
             .select("band", "key", F.least("mine", "other").alias("a"), F.greatest("mine", "other").alias("b"), (F.col("mine") <= F.col("other")).alias("left"), "digest"))
    both = rows_.join(sets, "digest").select("band", "key", "a", "b", "left", "doc_id", "signature", "shingles")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, group = None, []

        def done() -> pa.RecordBatch:
            band, _, a, b = at
            ids, sets = np.array([r[1] for r in group]), [np.frombuffer(r[3], "<u8") for r in group]
            sig = np.frombuffer(b"".join(r[2] for r in group), f"V{size}").reshape(len(group), -1)[:, :n_bands]
            left = np.array([r[0] for r in group])
            one = np.flatnonzero(left)
            two = one if a == b else np.flatnonzero(~left)
            found = list(block_pairs(ids, sets, sig, band, one, two, similarity)) if len(one) and len(two) else []
            u, v, j = zip(*found, strict=True) if found else ((), (), ())
            return pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64()), pa.array(j, pa.float64())], names=["u", "v", "jaccard"])

        for b in batches:
            for band, key, x, y, *row in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if (band, key, x, y) != at:
                    if group:
                        yield done()
                    at, group = (band, key, x, y), []
                group.append(row)
        if group:
            yield done()

    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return both.repartition(n, "band", "key", "a", "b").sortWithinPartitions("band", "key", "a", "b").mapInArrow(run, "u long, v long, jaccard double")


__all__ = ["fingerprint_edits", "fingerprint_table", "fingerprints_of", "near_pairs", "mix64"]
