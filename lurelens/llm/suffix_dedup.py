"""Repeated passages by sparse suffix arrays (operator 2).

Texts are word sequences (A-Z lower-cased).  Of all suffixes only those are kept
that start at a minimiser: in every stretch of ``WINDOW`` word positions the one
with the smallest hash of its next ``GRAM`` words (the leftmost of equals).  So
two copies of a passage of ``MIN_WORDS`` words keep suffixes at the same places,
and each kept suffix has ``HEAD`` = MIN_WORDS - WINDOW + 1 words of the passage
after it.

1. Heads (the hash of the HEAD words after a kept place) are counted; a suffix
   whose head occurs once cannot start a repeat and is left.
2. The others get their context: the words after the head and, nearest first,
   the words before the place, as 32-bit hashes.  The suffixes are sorted over
   all data by (head, words after, words before), in ranges, so a very common
   passage is spread over tasks.
3. Each suffix is compared with its nearest neighbours of other documents in
   the order, ``LAGS`` on each side: equal words to the right and to the left
   give the match, if they are ``MIN_WORDS`` words together.  The first and last
   ``EDGE`` suffixes of a range are compared once more, in the order of ranges.
4. Where more than ``LAGS`` neighbours share a head, a copy may lie further away
   (same words after, other words before).  There the runs of MIN_WORDS words
   around the place that no match covers are hashed, one for each offset, and
   equal runs of different documents are found by their hash.  The nearest
   neighbours bound the words matched to the right, so only offsets within that
   bound are hashed.
5. Overlapping matches of a document join into maximal spans.

So the reported words are exactly those that lie in a run of MIN_WORDS words
that occurs in another document, whichever texts stand around it.  A head or a
run that holds over a thousandth of all rows is joined in ``SALTS`` parts.

Defined results: null, empty and short text has no suffix; what repeats only
inside one document is no repeat; repeated rows of one id are one document;
null ids take no part; an empty table gives an empty result; extra columns are
ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize
from .textcore import U64, mix64, ngram_hashes, pieces, text_buffers, word_hashes

MIN_WORDS = 50
WINDOW = 32
GRAM = 4
HEAD = MIN_WORDS - WINDOW + 1      # 19
SIDE = WINDOW - 1                  # words of context before the place and after the head
LAGS = 8
EDGE = 64
SALTS = 64
_PLACE = (1 << 21) - 1             # low bits of a minimiser's value hold its place
PART_WORDS = 1 << 20               # words of a very long text worked on at once


def kept_places(h: np.ndarray, woff: np.ndarray) -> np.ndarray:
    """Places (word indices) of the minimisers of some documents."""
    n = len(h)
    if n < MIN_WORDS:
        return np.zeros(0, np.int64)
    if n > _PLACE:
        raise ValueError("too many words at once")
    g = np.full(n, np.uint64(0xFFFFFFFFFFFFFFFF))
    grams = ngram_hashes(h, GRAM)
    g[:len(grams)] = grams
    v = (g & ~U64(_PLACE)) | np.arange(n, dtype=U64)
    m, have = v, 1                                   # smallest of the next WINDOW values
    while have < WINDOW:
        step = min(have, WINDOW - have)
        nxt = m.copy()
        nxt[:-step] = np.minimum(m[:-step], m[step:])
        m, have = nxt, have + step
    # windows that lie, with MIN_WORDS words, in one document
    ok = np.zeros(n + 1, np.int64)
    lo, hi = woff[:-1], np.maximum(woff[1:] - MIN_WORDS + 1, woff[:-1])
    np.add.at(ok, lo, 1)
    np.add.at(ok, hi, -1)
    q = np.flatnonzero(np.cumsum(ok[:-1]) > 0)
    return np.unique((m[q] & U64(_PLACE)).astype(np.int64))


def document_words(arr: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, int]]:
    """(word hashes, first words, document numbers, first word's number) by
    parts; a very long text in parts that overlap by MIN_WORDS + WINDOW words."""
    data, off = text_buffers(arr)
    for i, j in pieces(off):
        h, _, _, woff = word_hashes(data[off[i]:off[j]], off[i:j + 1] - off[i])
        if len(h) <= PART_WORDS:
            yield h, woff, np.arange(i, j), 0
            continue
        for d in range(i, j):
            mine = h[woff[d - i]:woff[d - i + 1]]
            lap = MIN_WORDS + WINDOW
            for a in range(0, max(len(mine), 1), PART_WORDS):
                part = mine[a:a + PART_WORDS + lap]
                yield part, np.array([0, len(part)]), np.array([d]), a


def suffix_heads(docs: DataFrame) -> DataFrame:
    """head, doc_id, place: the kept suffixes of every document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids = b.column(0).to_numpy(zero_copy_only=False)
            for h, woff, numbers, base in document_words(b.column(1)):
                p = kept_places(h, woff)
                if not len(p):
                    continue
                d = np.searchsorted(woff, p, "right") - 1
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ngram_hashes(h, HEAD)[p].view(np.int64)), pa.array(ids[numbers[d]], pa.int64()), pa.array((p - woff[d] + base).astype(np.int32))],
                    names=["head", "doc_id", "place"])

    return docs.select("doc_id", "text").mapInArrow(run, "head long, doc_id long, place int")


def keyed(docs: DataFrame) -> DataFrame:
    """doc_id (a key of id and text), text, id: the documents that take part."""
    d = docs.filter("doc_id IS NOT NULL").select(F.col("doc_id").cast("long").alias("id"), F.col("text").cast("string").alias("text"))
    return d.select(F.xxhash64("id", "text").alias("doc_id"), "text", "id")


CONTEXT = "head long, after binary, before binary, doc_id long, place int, n_after int, n_before int"


def contexts(docs: DataFrame, places: DataFrame) -> DataFrame:
    """The rows of ``CONTEXT`` for the places (doc_id, places: array of structs
    head, place) of each document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            data, off = text_buffers(b.column(1))
            for i, doc in enumerate(b.column(0).to_pylist()):
                found = b.column(2)[i].values
                place = found.field("place").to_numpy(zero_copy_only=False).astype(np.int64)
                head = found.field("head")
                h, _, _, _ = word_hashes(data[off[i]:off[i + 1]], np.array([0, off[i + 1] - off[i]]))
                n = len(h)
                small = np.concatenate((np.zeros(SIDE, np.uint32), (h >> U64(32)).astype(np.uint32), np.zeros(SIDE + HEAD, np.uint32)))
                for x in range(0, len(place), 20_000):
                    p = place[x:x + 20_000]
                    after = small[(p + SIDE + HEAD)[:, None] + np.arange(SIDE)].astype(">u4")
                    before = small[(p + SIDE - 1)[:, None] - np.arange(SIDE)].astype(">u4")
                    fixed = lambda m: pa.array([r.tobytes() for r in m], pa.binary())
                    yield pa.RecordBatch.from_arrays(
                        [head.slice(x, len(p)), fixed(after), fixed(before), pa.array(np.full(len(p), doc), pa.int64()), pa.array(p.astype(np.int32)),
                         pa.array(np.clip(n - p - HEAD, 0, SIDE).astype(np.int32)), pa.array(np.minimum(p, SIDE).astype(np.int32))],
                        names=["head", "after", "before", "doc_id", "place", "n_after", "n_before"])

    rows = docs.select("doc_id", "text").join(places, "doc_id").dropDuplicates(["doc_id"])
    return rows.select("doc_id", "text", "places").mapInArrow(run, CONTEXT)


def common_start(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Equal leading words of each row."""
    differ = a != b
    first = differ.argmax(1)
    return np.where(differ.any(1), first, a.shape[1])


def neighbour_matches(cols: dict[str, np.ndarray], lags: int = LAGS) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """For sorted suffixes: words matched to the left and to the right of the
    place (0 without a match of MIN_WORDS words), the other's document, and the
    most words to the right that any other document can share (0 where all
    suffixes of the head were compared)."""
    n, doc = len(cols["head"]), cols["doc_id"]
    left, right, other = np.zeros(n, np.int64), np.zeros(n, np.int64), np.full(n, -1, np.int64)
    new = np.flatnonzero(np.append(True, doc[1:] != doc[:-1])) if n else np.zeros(0, np.int64)
    run = np.searchsorted(new, np.arange(n), "right") - 1
    back = new[run] - 1                                            # the last suffix of the document before
    ahead = np.append(new[1:], n)[run]                             # the first of the document after
    bound = np.zeros(n, np.int64)
    for step in (back, ahead):
        at, mine = step, np.arange(n)
        bound[(at < 0) | (at >= n)] = HEAD + SIDE                  # the nearest is not here
        for lag in range(lags):
            ok = (at >= 0) & (at < n)
            mine, at = mine[ok], at[ok]
            ok = cols["head"][mine] == cols["head"][at]
            mine, at = mine[ok], at[ok]
            if not len(mine):
                break
            use = doc[mine] != doc[at]
            a, b = mine[use], at[use]
            r = HEAD + np.minimum(common_start(cols["after"][a], cols["after"][b]), np.minimum(cols["n_after"][a], cols["n_after"][b]))
            w = np.minimum(common_start(cols["before"][a], cols["before"][b]), np.minimum(cols["n_before"][a], cols["n_before"][b]))
            if lag == 0:
                bound[a] = np.maximum(bound[a], r)
            good = r + w >= MIN_WORDS
            a, b, r, w = a[good], b[good], r[good], w[good]
            left[a], right[a] = np.maximum(left[a], w), np.maximum(right[a], r)
            other[a] = doc[b]
            at = step[at]
    if n:
        # heads with few suffixes, one a document, that do not reach the ends of the array: all were compared
        starts = np.flatnonzero(np.append(True, cols["head"][1:] != cols["head"][:-1]))
        size = np.diff(np.append(starts, n))
        fresh = np.append(True, (doc[1:] != doc[:-1]) | (cols["head"][1:] != cols["head"][:-1]))
        done = (size <= lags + 1) & (np.add.reduceat(fresh.astype(np.int64), starts) == size)
        done[0] = done[-1] = False
        bound[np.repeat(done, size)] = 0
    return left, right, other, bound


def prefix_hashes(words: np.ndarray) -> np.ndarray:
    """[row, i]: hash of the first i words of each row, i = 0 .. SIDE."""
    out = np.zeros((len(words), words.shape[1] + 1), U64)
    for i in range(words.shape[1]):
        out[:, i + 1] = mix64((out[:, i] + U64(0x9E3779B97F4A7C15)) ^ words[:, i].astype(U64))
    return out


def open_runs(cols: dict[str, np.ndarray], left: np.ndarray, right: np.ndarray, bound: np.ndarray, a: int, z: int) -> tuple[np.ndarray, ...]:
    """(hash, document, first word, witness) of the runs of MIN_WORDS words
    around the places of rows a .. z - 1 that a document not compared might
    share: those that the bound to the right allows.  Runs whose words the
    matches found cover are witnesses: of each hash the smallest and the largest
    document."""
    at = a + np.flatnonzero(bound[a:z] > 0)
    l = np.arange(SIDE + 1)[None, :]                               # words of the run before the place
    fits = (l <= cols["n_before"][at][:, None]) & (SIDE - l <= cols["n_after"][at][:, None])
    may = MIN_WORDS - l <= bound[at][:, None]
    covered = (l <= left[at][:, None]) & (MIN_WORDS - l <= right[at][:, None])
    row, l = np.nonzero(fits & may)
    witness = covered[row, l]
    some, row = np.unique(row, return_inverse=True)
    at = at[some]
    before, after = prefix_hashes(cols["before"][at]), prefix_hashes(cols["after"][at])
    key = mix64(mix64(cols["head"][at][row].view(U64) ^ before[row, l]) + after[row, SIDE - l]) + l.astype(U64)
    key, doc, first = mix64(key).view(np.int64), cols["doc_id"][at][row], (cols["place"][at][row] - l).astype(np.int32)
    order = np.lexsort((doc, key, ~witness))                       # the witnesses first, by hash
    n = np.count_nonzero(witness)
    w = order[:n]
    new = np.append(True, key[w][1:] != key[w][:-1])[:n]
    keep = np.append(w[new | np.append(new[1:], True)[:n]], order[n:])
    return key[keep], doc[keep], first[keep], witness[keep]


FOUND = "doc_id long, start int, end int, other long, seq long, " + CONTEXT.replace("doc_id long, ", "")


def _columns(b: pa.RecordBatch) -> dict[str, np.ndarray]:
    side = lambda c: np.frombuffer(b"".join(b.column(c).to_pylist()), ">u4").reshape(-1, SIDE).astype(np.uint32)
    plain = lambda c: b.column(c).to_numpy(zero_copy_only=False)
    return {c: (side(c) if c in ("after", "before") else plain(c)) for c in ("head", "after", "before", "doc_id", "place", "n_after", "n_before")}


def compare(keep_edges: bool):
    """Streams sorted suffixes; gives matches and, with ``keep_edges``, the
    first and last EDGE suffixes of the partition (rows with seq) and the runs
    that are left to compare by hash (rows without start: head is the hash,
    place the first word, n_after 1 for a witness)."""

    def run_rows(found: tuple[np.ndarray, ...]) -> pa.RecordBatch:
        key, doc, first, witness = found
        none = lambda t: pa.nulls(len(key), t)
        return pa.RecordBatch.from_arrays(
            [pa.array(doc, pa.int64()), none(pa.int32()), none(pa.int32()), none(pa.int64()), none(pa.int64()), pa.array(key, pa.int64()),
             none(pa.binary()), none(pa.binary()), pa.array(first, pa.int32()), pa.array(witness.astype(np.int32)), none(pa.int32())], names=NAMES)

    def match_rows(cols: dict[str, np.ndarray], left: np.ndarray, right: np.ndarray, other: np.ndarray) -> pa.RecordBatch | None:
        hit = np.flatnonzero(right > 0)
        if not len(hit):
            return None
        p = cols["place"][hit].astype(np.int64)
        none = lambda t: pa.nulls(len(hit), t)
        return pa.RecordBatch.from_arrays(
            [pa.array(cols["doc_id"][hit], pa.int64()), pa.array((p - left[hit]).astype(np.int32)), pa.array((p + right[hit]).astype(np.int32)), pa.array(other[hit]),
             none(pa.int64()), none(pa.int64()), none(pa.binary()), none(pa.binary()), none(pa.int32()), none(pa.int32()), none(pa.int32())], names=NAMES)

    def edge_rows(b: pa.RecordBatch, seq: int) -> pa.RecordBatch:
        n = b.num_rows
        none = lambda t: pa.nulls(n, t)
        return pa.RecordBatch.from_arrays(
            [b.column("doc_id"), none(pa.int32()), none(pa.int32()), none(pa.int64()), pa.array(np.arange(seq, seq + n), pa.int64()),
             b.column("head"), b.column("after"), b.column("before"), b.column("place"), b.column("n_after"), b.column("n_before")], names=NAMES)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext
        ctx = TaskContext.get()
        seq = (ctx.partitionId() if ctx else 0) << 32
        tail: pa.RecordBatch | None = None
        rest = None                                                # the open runs of the tail
        seen = 0
        for b in batches:
            for x in range(0, b.num_rows, 20_000):
                part = b.slice(x, 20_000)
                if keep_edges and seen < EDGE:
                    yield edge_rows(part.slice(0, EDGE - seen), seq + seen)
                seen += part.num_rows
                both = part if tail is None else pa.Table.from_batches([tail, part]).combine_chunks().to_batches()[0]
                cols = _columns(both)
                left, right, other, bound = neighbour_matches(cols)
                if (m := match_rows(cols, left, right, other)) is not None:
                    yield m
                cut = max(0, both.num_rows - EDGE)
                if keep_edges:
                    yield run_rows(open_runs(cols, left, right, bound, 0, cut))
                    rest = open_runs(cols, left, right, bound, cut, both.num_rows)
                tail = both.slice(cut)
        if rest is not None:
            yield run_rows(rest)
        if keep_edges and tail is not None and seen > EDGE:
            n = min(tail.num_rows, seen - EDGE)
            yield edge_rows(tail.slice(tail.num_rows - n), seq + seen)

    return run


NAMES = [c.split()[0] for c in FOUND.split(", ")]


def join_hot(rows: DataFrame, keys: DataFrame, key: str, spread: list[str]) -> DataFrame:
    """Rows joined with ``keys`` (key, n, ...; one row a key).  Keys that hold
    over a thousandth of the sum of n, so fewer than a thousand, are dealt over
    SALTS parts by the columns ``spread``."""
    total = keys.agg(F.sum("n")).first()[0] or 0
    is_hot = F.col("n") * 1000 > F.lit(total)
    hot = keys.filter(is_hot).select(key, F.lit(True).alias("__hot"))
    salted = rows.join(F.broadcast(hot), key, "left").withColumn(
        "__salt", F.when(F.col("__hot"), F.pmod(F.xxhash64(*spread), F.lit(SALTS)).cast("int")).otherwise(0)).drop("__hot")
    copies = keys.withColumn("__salt", F.explode(F.when(is_hot, F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))))
    return salted.join(copies.drop("n"), [key, "__salt"]).drop("__salt")


def matches(docs: DataFrame) -> DataFrame:
    """doc_id, start, end (words), other: the matches of single suffixes, under
    the keys of ``keyed`` documents."""
    heads = suffix_heads(docs)
    twice = materialize(heads.groupBy("head").agg(F.count("*").alias("n")).filter("n > 1"), "heads")
    places = materialize(join_hot(suffix_heads(docs), twice, "head", ["doc_id", "place"]), "suffixes")
    # a set: repeated rows of one id are one document
    grouped = places.groupBy("doc_id").agg(F.collect_set(F.struct("head", "place")).alias("places"))
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    order = ["head", "after", "before", "doc_id", "place"]
    rows = materialize(contexts(docs, grouped), "contexts").repartitionByRange(n, *order).sortWithinPartitions(*order)
    found = materialize(rows.mapInArrow(compare(True), FOUND), "matches")
    # at most 2 * EDGE suffixes a range: compared in the order of the ranges
    edges = found.filter("seq IS NOT NULL").repartition(1).sortWithinPartitions("seq").select(*[c.split()[0] for c in CONTEXT.split(", ")])
    runs = found.filter("seq IS NULL AND start IS NULL").select(F.col("head").alias("run"), "doc_id", F.col("place").alias("start"), F.col("n_after").alias("witness"))
    shared = materialize(runs.groupBy("run").agg(F.sum(F.lit(1) - F.col("witness")).alias("n"), F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi"))
                         .filter("lo < hi AND n > 0"), "runs")
    far = join_hot(runs.filter("witness = 0").drop("witness"), shared, "run", ["doc_id", "start"]).select(
        "doc_id", "start", (F.col("start") + F.lit(MIN_WORDS)).cast("int").alias("end"), F.when(F.col("doc_id") == F.col("lo"), F.col("hi")).otherwise(F.col("lo")).alias("other"))
    cols = ["doc_id", "start", "end", "other"]
    return (found.filter("seq IS NULL AND start IS NOT NULL").select(*cols)
            .union(edges.mapInArrow(compare(False), FOUND).select(*cols)).union(far))


def repeated_passages(docs: DataFrame) -> DataFrame:
    """doc_id, start_word, n_words, other_doc: a row per maximal span of words
    that repeat at another place, with one document that shares words of it."""
    d = keyed(docs)
    w = Window.partitionBy("doc_id").orderBy("start", "end")
    reach = F.max("end").over(w.rowsBetween(Window.unboundedPreceding, -1))
    s = (matches(d).withColumn("__new", F.when(reach.isNull() | (F.col("start") > reach), 1).otherwise(0))
         .withColumn("__span", F.sum("__new").over(w)))
    spans = s.groupBy("doc_id", "__span").agg(F.min("start").alias("a"), F.max("end").alias("z"), F.min("other").alias("other"))
    ids = d.select("doc_id", "id").distinct()
    named = spans.join(ids, "doc_id").join(ids.select(F.col("doc_id").alias("other"), F.col("id").alias("other_doc")), "other")
    return named.select(F.col("id").alias("doc_id"), F.col("a").cast("long").alias("start_word"),
                        (F.col("z") - F.col("a")).cast("long").alias("n_words"), "other_doc")
