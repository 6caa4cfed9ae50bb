"""MinHash near-duplicate removal with circulant signatures (operator 5).

Shingles: five words, lower-cased A-Z (a shorter text: all its words as one).
Signatures use two permutations only: ``sigma`` scatters the shingles over
2**32 places, and coordinate k is the minimum of ``pi`` over the places shifted
circularly by k times a stride.  ``BANDS`` bands of ``ROWS`` coordinates put
documents into buckets; a link of similarity 0.85 is missed by all bands with a
probability of 8e-6.  Every link used is confirmed on the full shingle sets.

1. Documents with equal shingle sets form a class (grouped by a 128-bit digest
   of the sorted set); only the class goes on, under a number of its own.
2. In each bucket every member is compared with the smallest one (distinct
   pairs over all bands): linear in the bucket.  Links give components.
3. Buckets that still hold several components: the members outside the bucket's
   largest component are compared with all members of other components, block
   by block, on full sets, inside a task; a task emits a spanning forest of what
   it links, never all pairs.  So any two documents that share a bucket are
   either compared or already in one component, whatever the bucket's size.
4. Components over both link tables; members of a class follow it.

Sets are never written for all documents: only those that share a bucket with
another have their text read again and shingled.  A pivot with very many
partners is dealt out in blocks of ``PIVOT_BLOCK`` members, each with its own
copy of the pivot's set.

Defined results: null, empty and wordless text has no shingles and links with
nothing; rows of equal id and text are one document that gives a row for each;
rows of equal id and different texts are documents of their own that share an
id, each with the component of its own text; a null id takes part under no id of
its own and gets its class's component, or null; an empty table gives an empty
result; extra columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import free_name, materialize
from .components import connected_components
from .textcore import U64, chunk_rows, distinct_by_doc, doc_ngrams, mix64, pieces, segment_min, text_buffers, word_hashes

K = 5
BANDS, ROWS = 20, 5
STRIDE = 0x01000193          # odd: shifts by k * STRIDE never repeat below 2**32
PIVOT_BLOCK = 2048
BLOCK = 512                  # members of a block, and their shingles, on average
BLOCK_SHINGLES = 1 << 20
LONG_SET = 1 << 20           # shingles of one document worked on at once
THRESHOLD = (85, 100)


def sigma(shingles: np.ndarray) -> np.ndarray:
    return (mix64(shingles ^ U64(0x5851F42D4C957F2D)) >> U64(32)).astype(np.uint32)


def pi(places: np.ndarray) -> np.ndarray:
    """A permutation of 0 .. 2**32 - 1 (odd products and a shift that undoes)."""
    x = places * np.uint32(0x85EBCA6B)
    x ^= x >> np.uint32(15)
    x *= np.uint32(0xC2B2AE35)
    return x


def signatures(sets: np.ndarray, off: np.ndarray, n: int) -> np.ndarray:
    """[document, coordinate] minima; documents without shingles all ones."""
    out = np.empty((len(off) - 1, n), np.uint32)
    top = np.uint32(0xFFFFFFFF)
    if len(sets) <= LONG_SET:
        places = sigma(sets)
        for k in range(n):
            out[:, k] = segment_min(pi(places + np.uint32((k * STRIDE) & 0xFFFFFFFF)), off, top)
        return out
    for d in range(len(off) - 1):
        out[d] = top
        for a, b in chunk_rows(int(off[d + 1] - off[d]), LONG_SET):
            places = sigma(sets[off[d] + a:off[d] + b])
            for k in range(n):
                out[d, k] = min(out[d, k], pi(places + np.uint32((k * STRIDE) & 0xFFFFFFFF)).min())
    return out


def shingle_sets(arr: pa.Array, k: int = K) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, sorted distinct shingles, offsets) by parts of a batch."""
    data, off = text_buffers(arr)
    for i, j in pieces(off):
        part, po = data[off[i]:off[j]], off[i:j + 1] - off[i]
        h, _, _, woff = word_hashes(part, po)
        sh, so = doc_ngrams(h, woff, k)
        sets, so = distinct_by_doc(sh, so)
        yield i, j, sets, so


def features(docs: DataFrame, bands: int = BANDS, rows: int = ROWS, k: int = K) -> DataFrame:
    """doc_id, text_key (a hash of the text), n_shingles, digest (of the set;
    null without shingles), bands (one hash a band): a row per document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, j, sets, so in shingle_sets(b.column(2), k):
                sig = signatures(sets, so, bands * rows).reshape(-1, bands, rows).astype(U64)
                key = np.repeat(np.arange(1, bands + 1, dtype=U64)[None, :] * U64(0x9E3779B97F4A7C15), len(sig), 0)
                for r in range(rows):
                    key = mix64(key ^ sig[:, :, r])
                n = np.diff(so)
                raw = sets.astype("<u8").tobytes()
                digest = [set_digest(raw[8 * so[d]:8 * so[d + 1]]) if n[d] else None for d in range(j - i)]
                keys = pa.ListArray.from_arrays(pa.array(np.arange(0, (j - i) * bands + 1, bands, dtype=np.int32)), pa.array(key.ravel().view(np.int64)))
                yield pa.RecordBatch.from_arrays([b.column(0).slice(i, j - i), b.column(1).slice(i, j - i), pa.array(n), pa.array(digest, pa.binary()), keys],
                                                 names=["doc_id", "text_key", "n_shingles", "digest", "bands"])

    return docs.select(F.col("doc_id").cast("long"), text_key().alias("text_key"), F.col("text").cast("string")).mapInArrow(
        run, "doc_id long, text_key long, n_shingles long, digest binary, bands array<long>")


def text_key():
    return F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit("")), F.col("text").isNull())


def set_digest(raw: bytes) -> bytes:
    return hashlib.blake2b(raw, digest_size=16).digest()


def full_sets(docs: DataFrame, k: int = K) -> DataFrame:
    """doc_id (the number of the document's class), shingles (the sorted set as
    little-endian 64-bit bytes)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, j, sets, so in shingle_sets(b.column(0), k):
                raw = sets.astype("<u8").tobytes()
                each = [raw[8 * so[d]:8 * so[d + 1]] for d in range(j - i)]
                yield pa.RecordBatch.from_arrays([pa.array([set_digest(x) for x in each], pa.binary()), pa.array(each, pa.binary())],
                                                 names=["digest", "shingles"])

    rows = docs.select(F.col("text").cast("string")).mapInArrow(run, "digest binary, shingles binary")
    return rows.select(F.xxhash64("digest").alias("doc_id"), "shingles")


def linked(a: np.ndarray, b: np.ndarray, num: int, den: int) -> bool:
    """den * |a & b| >= num * |a | b| for sorted distinct arrays."""
    if min(len(a), len(b)) * den < max(len(a), len(b)) * num:
        return False
    both = len(a) + len(b) - len(np.unique(np.concatenate((a, b))))
    return den * both >= num * (len(a) + len(b) - both)


def verify_pivots(pairs: DataFrame, sets: DataFrame, threshold: tuple[int, int]) -> DataFrame:
    """Links (u, v) among pairs (pivot, member), by streaming each pivot block:
    the pivot's set first, then its members'."""
    num, den = threshold
    blocks = pairs.groupBy("pivot").agg(F.ceil(F.count("*") / F.lit(PIVOT_BLOCK)).cast("int").alias("__nb"))
    salted = pairs.join(blocks, "pivot").select("pivot", F.pmod(F.xxhash64("member"), F.col("__nb")).cast("int").alias("salt"), "member")
    salted = materialize(salted, "pairs")
    heads = (salted.groupBy("pivot", "salt").agg(F.count("*")).select("pivot", "salt", F.col("pivot").alias("doc_id"))
             .join(sets, "doc_id").select("pivot", "salt", F.lit(0).alias("kind"), "doc_id", "shingles"))
    tails = (salted.select("pivot", "salt", F.lit(1).alias("kind"), F.col("member").alias("doc_id"))
             .join(sets, "doc_id").select("pivot", "salt", "kind", "doc_id", "shingles"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pivot = mine = None
        for b in batches:
            us, vs = [], []
            ids, kinds, raw = b.column(3).to_pylist(), b.column(2).to_pylist(), b.column(4)
            for i, kind in enumerate(kinds):
                s = np.frombuffer(raw[i].as_py(), "<u8")
                if kind == 0:
                    pivot, mine = ids[i], s
                elif linked(mine, s, num, den):
                    us.append(pivot)
                    vs.append(ids[i])
            yield pa.RecordBatch.from_arrays([pa.array(us, pa.int64()), pa.array(vs, pa.int64())], names=["u", "v"])

    n = int(pairs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return (heads.union(tails).repartition(n, "pivot", "salt").sortWithinPartitions("pivot", "salt", "kind", "doc_id")
            .mapInArrow(run, "u long, v long"))


def forest(ids: list[np.ndarray], comp: list[int], minor: list[bool], num: int, den: int, left: list[int], right: list[int]) -> list[tuple[int, int]]:
    """Index pairs that connect what is linked between ``left`` and ``right``
    members of different components: one link where a spanning forest needs it."""
    root = list(range(len(ids)))

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    first: dict[int, int] = {}
    for i, c in enumerate(comp):          # what is known to be connected already
        if c in first:
            root[find(i)] = find(first[c])
        else:
            first[c] = i
    values = np.unique(np.concatenate([ids[i] for i in right] or [np.zeros(0, U64)]))
    n = np.array([len(ids[i]) for i in right])
    place = np.concatenate([np.searchsorted(values, ids[i]) for i in right] or [np.zeros(0, np.int64)])
    owner = np.repeat(np.arange(len(right)), n)
    order = np.argsort(place, kind="stable")
    place, owner = place[order], owner[order]
    bounds = np.searchsorted(place, np.arange(len(values) + 1))
    out = []
    for i in left:
        s = ids[i]
        if not len(values) or not len(s):
            continue
        at = np.minimum(np.searchsorted(values, s), len(values) - 1)
        at = at[values[at] == s]
        lo, size = bounds[at], bounds[at + 1] - bounds[at]
        if not size.sum():
            continue
        pos = np.repeat(lo - np.concatenate(([0], np.cumsum(size)[:-1])), size) + np.arange(size.sum())
        both = np.bincount(owner[pos], minlength=len(right))
        for j in np.flatnonzero(den * both >= num * (len(s) + n - both)):
            a, b = find(i), find(right[j])
            if a != b:
                root[a] = b
                out.append((i, right[j]))
    return out


def verify_blocks(members: DataFrame, sets: DataFrame, threshold: tuple[int, int]) -> DataFrame:
    """Links (u, v) inside buckets that hold several components.  ``members``:
    key (the bucket), doc_id, comp, n_shingles.  A bucket's minor members (those
    outside its largest component) and all its members are cut into blocks of
    about ``BLOCK`` members or ``BLOCK_SHINGLES`` shingles, whichever is less; a
    task holds one pair of blocks."""
    num, den = threshold
    per = members.groupBy("key", "comp").agg(F.count("*").alias("n"), F.sum("n_shingles").alias("w"))
    # at most one row a component and bucket; the largest by (size, id)
    top = per.groupBy("key").agg(F.max_by("comp", F.struct("n", "comp")).alias("major"), F.sum("n").alias("m"), F.sum("w").alias("w"),
                                F.max(F.struct("n", "comp", "w")).alias("big"))
    blocks = lambda n, w: F.ceil(F.greatest(n / F.lit(BLOCK), w / F.lit(BLOCK_SHINGLES))).cast("int")
    top = top.withColumn("nb", blocks(F.col("m"), F.col("w"))).withColumn("mb", blocks(F.col("m") - F.col("big.n"), F.col("w") - F.col("big.w")))
    rows = members.join(top.select("key", "major", "nb", "mb"), "key")
    h = F.xxhash64("doc_id")
    rows = rows.withColumn("mine", F.pmod(h, F.col("nb")).cast("int")).withColumn("minor", F.col("comp") != F.col("major"))
    as_all = rows.select("key", "doc_id", "comp", F.lit(False).alias("left"), F.col("mine").alias("b"),
                         F.explode(F.sequence(F.lit(0), F.col("mb") - 1)).alias("a"))
    as_minor = rows.filter("minor").select("key", "doc_id", "comp", F.lit(True).alias("left"),
                                           F.explode(F.sequence(F.lit(0), F.col("nb") - 1)).alias("b"), F.pmod(h, F.col("mb")).cast("int").alias("a"))
    both = as_all.unionByName(as_minor.select(*as_all.columns)).join(sets, "doc_id").select("key", "a", "b", "left", "doc_id", "comp", "shingles")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, rows = None, []

        def done() -> pa.RecordBatch:
            us, vs = [], []
            left = [i for i, r in enumerate(rows) if r[0]]
            right = [i for i, r in enumerate(rows) if not r[0]]
            if left and right:
                docs = [r[1] for r in rows]
                for i, j in forest([np.frombuffer(r[3], "<u8") for r in rows], [r[2] for r in rows], [r[0] for r in rows], num, den, left, right):
                    if docs[i] != docs[j]:
                        us.append(docs[i])
                        vs.append(docs[j])
            return pa.RecordBatch.from_arrays([pa.array(us, pa.int64()), pa.array(vs, pa.int64())], names=["u", "v"])

        for b in batches:
            for at in range(0, b.num_rows, 256):
                cols = [b.column(x).slice(at, 256).to_pylist() for x in range(7)]
                for k, x, y, left, doc, comp, raw in zip(*cols, strict=True):
                    if (k, x, y) != key:
                        if rows:
                            yield done()
                        key, rows = (k, x, y), []
                    rows.append((left, doc, comp, raw))
        if rows:
            yield done()

    n = int(members.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return both.repartition(n, "key", "a", "b").sortWithinPartitions("key", "a", "b").mapInArrow(run, "u long, v long")


def _groups(docs: DataFrame, threshold: tuple[int, int], bands: int, rows: int, k: int) -> DataFrame:
    """doc_id, text_key, n_shingles, digest, group (a number of the component;
    null without shingles or where no row of the class has an id), component_id:
    a row per document."""
    feats = materialize(features(docs, bands, rows, k), "features")
    classes = feats.filter("digest IS NOT NULL AND doc_id IS NOT NULL").groupBy("digest").agg(
        F.min("doc_id").alias("least"), F.max("n_shingles").alias("n_shingles"), F.first("bands").alias("bands"))
    classes = materialize(classes.select("digest", F.xxhash64("digest").alias("rep"), "least", "n_shingles", "bands"), "classes")
    # buckets with two classes at least: their smallest member and all members
    keys = classes.select("rep", F.explode("bands").alias("key"))
    small = keys.groupBy("key").agg(F.min("rep").alias("pivot"), F.count("*").alias("n")).filter("n > 1")
    held = materialize(keys.join(small, "key").select("key", "rep", "pivot", "n"), "buckets")
    wanted = classes.join(held.select("rep").distinct(), "rep", "left_semi").select(F.col("least").alias("doc_id")).distinct()
    # always by a shuffle, so that the plan does not change with the number of ids
    texts = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).join(wanted.hint("merge"), "doc_id", "left_semi")
    sets = materialize(full_sets(texts, k).dropDuplicates(["doc_id"]), "sets")
    pairs = (held.filter("rep <> pivot").select("pivot", F.col("rep").alias("member")).distinct())
    links = materialize(verify_pivots(pairs, sets, threshold), "links")
    comp = connected_components(links)
    open_ = held.filter("n > 2").join(comp.withColumnRenamed("node", "rep"), "rep", "left").select(
        "key", F.col("rep").alias("doc_id"), F.coalesce("component", "rep").alias("comp"))
    several = open_.groupBy("key").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).filter("lo <> hi").select("key")
    sizes = classes.select(F.col("rep").alias("doc_id"), "n_shingles")
    members = materialize(open_.join(several, "key").join(sizes, "doc_id"), "open")
    more = materialize(verify_blocks(members, sets, threshold), "links")
    comp = materialize(connected_components(links.union(more)).withColumnRenamed("node", "rep"), "components")
    linked_ = comp.join(classes.select("rep", "least"), "rep")
    least = linked_.groupBy("component").agg(F.min("least").alias("component_id"))
    where = classes.select("digest", "rep", "least").join(comp.join(least, "component"), "rep", "left").select(
        "digest", F.coalesce("component", "rep").alias("group"), F.coalesce("component_id", "least").alias("component_id"))
    out = feats.select("doc_id", "text_key", "n_shingles", "digest").join(where, "digest", "left")
    return out.withColumn("component_id", F.coalesce("component_id", "doc_id"))


def near_duplicates(docs: DataFrame, threshold: tuple[int, int] = THRESHOLD, bands: int = BANDS, rows: int = ROWS, k: int = K) -> DataFrame:
    """doc_id, n_shingles, component_id, kept: a row per document."""
    kept = F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(False))
    return _groups(docs, threshold, bands, rows, k).select("doc_id", "n_shingles", "component_id", kept.alias("kept"))


def drop_near_duplicates(docs: DataFrame, threshold: tuple[int, int] = THRESHOLD, bands: int = BANDS, rows: int = ROWS, k: int = K) -> DataFrame:
    """One document of each group, with all columns: of its rows with the
    smallest id those of one text (by hashes), and of rows equal in id and text
    one.  Documents without shingles link with nothing: one row of each id and
    text stays.  Rows with a null id stay."""
    groups = _groups(docs, threshold, bands, rows, k).filter("doc_id = component_id")
    none = F.xxhash64("doc_id", "text_key", F.lit("no shingles"))
    best = groups.groupBy(F.coalesce("group", none), F.col("group").isNull()).agg(F.min(F.struct("digest", "text_key", "doc_id")).alias("b"))
    kept = best.select(F.col("b.doc_id").alias("id"), F.col("b.text_key").alias("key"))
    id_, key = free_name(docs, "id"), free_name(docs, "key")
    rows_ = docs.withColumn(id_, F.col("doc_id").cast("long")).withColumn(key, text_key())
    good = rows_.join(kept.toDF(id_, key), [id_, key], "left_semi").dropDuplicates([id_, key])
    return good.select(*docs.columns).unionByName(docs.filter("doc_id IS NULL"))
