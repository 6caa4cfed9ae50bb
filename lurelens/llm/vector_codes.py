"""Vector code compression with cover-tree Lloyd rounds (operator 13).

Vectors are cut into ``PARTS`` equal parts; each part position has a codebook of
up to ``ENTRIES`` integer points.  A code is one entry index a part.  All
arithmetic is on integers (a component x is floor(256 * x)), so results do not
depend on partitions, on their order or on reruns.

1. Every task cuts its rows into blocks and builds, for each part position, a
   cover tree over the block's points: a node has a centre, the distance of its
   farthest point and a contiguous range of the points in tree order; children
   lie within half the parent's cover of their own centre and farther than that
   from each other's.  Blocks are written once, one row each, below
   ``spark.checkpoint.dir``; all rounds read them there.
2. A round walks the trees from the roots.  If the entry nearest to a centre is
   nearer than every other one by more than twice the node's radius, the
   triangle inequality gives the entry of the whole subtree: its count and sum
   come from cumulative sums over the range.  Only the other nodes descend, and
   ambiguous leaves compare point by point.  Tasks emit one partial sum for each
   entry that they used; Spark adds them up.
3. Entries become the componentwise floor of sum / count; after the last round
   the same walk gives every point's entry, and exact errors.

What reaches the driver and goes with the tasks is the codebooks alone: 64
entries of one vector's length each.

Defined results: rows with a null vector, or null or non-finite components, are
dropped.  Integers beyond 2**24 either way (components beyond 65,536) are held
there, a label's error at the largest long.  Vectors that are shorter than the longest one, or than the next multiple
of 16, count as filled up with zeros.  Repeated rows and ids are rows of their
own; the first entries are those of the 64 smallest rows by (vec_id, vector),
null ids last, and equal entries stay as they are (ties go to the lower index).
With fewer than 64 rows there are as many entries as rows; without rows the
result is empty.  Labels are compared as text, nulls together.  Other columns
are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
import io
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize

PARTS, ENTRIES, ROUNDS, SCALE = 16, 64, 2, 256
TOP = 1 << 24
LEAF = 32                  # points of a node that is not split further
BLOCK = 1 << 19            # components of a block
SCHEMA = "vec_id long, code string, error long, label_error long, codebooks_sha256 string"


def to_integers(vectors: list[np.ndarray], dims: int) -> np.ndarray:
    """[vector, component] integers, filled up with zeros to ``dims``."""
    out = np.zeros((len(vectors), dims))
    for i, v in enumerate(vectors):
        out[i, :len(v)] = v
    return np.clip(np.floor(out * SCALE), -TOP, TOP).astype(np.int64)


class CoverTree:
    """Nodes over points in tree order: ``lo``, ``hi`` (range of a node, its
    centre first), ``radius`` (rounded up), ``first``, ``n`` (its children;
    none: a leaf)."""

    def __init__(self, order: np.ndarray, lo: np.ndarray, hi: np.ndarray, radius: np.ndarray, first: np.ndarray, n: np.ndarray) -> None:
        self.order, self.lo, self.hi, self.radius, self.first, self.n = order, lo, hi, radius, first, n

    @classmethod
    def build(cls, x: np.ndarray) -> CoverTree:
        order = np.arange(len(x))
        lo, hi, radius, first, n = [0], [len(x)], [0.0], [0], [0]
        at = 0
        while at < len(lo):                # nodes are numbered by level, children of one node together
            a, b = lo[at], hi[at]
            ids = order[a:b].copy()
            dist = np.sqrt(((x[ids] - x[ids[0]]) ** 2).sum(1).astype(float))
            r = float(dist.max())
            radius[at] = r * (1 + 1e-12)
            if b - a > LEAF and r > 0:
                cover = r / 2
                first[at], rest, put = len(lo), ids, a
                while len(rest):
                    near = dist <= cover
                    mine = rest[near]
                    order[put:put + len(mine)] = mine
                    lo.append(put)
                    hi.append(put + len(mine))
                    radius.append(0.0)
                    first.append(0)
                    n.append(0)
                    put += len(mine)
                    rest = rest[~near]
                    if len(rest):
                        dist = np.sqrt(((x[rest] - x[rest[0]]) ** 2).sum(1).astype(float))
                n[at] = len(lo) - first[at]
            at += 1
        return cls(order, np.array(lo), np.array(hi), np.array(radius), np.array(first), np.array(n))

    def assign(self, x: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(lo, hi, entry) of the ranges that are settled as a whole, and
        (place in tree order, entry) of single points, for ``x`` in tree order."""
        ranges, singles = [], []
        at = np.zeros(1, np.int64)
        while len(at):
            d = squared(x[self.lo[at]], book)
            best = d.argmin(1)
            near = np.sqrt(d.astype(float))
            own = near[np.arange(len(at)), best]
            near[np.arange(len(at)), best] = np.inf
            other = near.min(1)
            r = self.radius[at]
            sure = (r == 0) | (other * (1 - 1e-9) > own * (1 + 1e-9) + 2 * r)
            ranges.append(np.stack([self.lo[at[sure]], self.hi[at[sure]], best[sure]], 1))
            at = at[~sure]
            leaf = self.n[at] == 0
            if leaf.any():
                places = spans(self.lo[at[leaf]], self.hi[at[leaf]] - self.lo[at[leaf]])
                singles.append(np.stack([places, nearest(x[places], book)], 1))
            at = spans(self.first[at[~leaf]], self.n[at[~leaf]])
        one = np.concatenate(singles) if singles else np.zeros((0, 2), np.int64)
        whole = np.concatenate(ranges)
        return whole[:, :2], whole[:, 2], one[:, 0], one[:, 1]


def squared(x: np.ndarray, book: np.ndarray) -> np.ndarray:
    """[point, entry] squared distances, exact."""
    out = np.zeros((len(x), len(book)), np.int64)
    for j in range(x.shape[1]):
        out += (x[:, j, None] - book[None, :, j]) ** 2
    return out


def nearest(x: np.ndarray, book: np.ndarray) -> np.ndarray:
    """Entry of each point, the lower index on ties."""
    out = np.empty(len(x), np.int64)
    for a in range(0, len(x), 1 << 14):
        out[a:a + (1 << 14)] = squared(x[a:a + (1 << 14)], book).argmin(1)
    return out


def spans(lo: np.ndarray, n: np.ndarray) -> np.ndarray:
    """lo, lo + 1 .. lo + n - 1 of every pair, one after the other."""
    return np.repeat(lo - np.cumsum(n) + n, n) + np.arange(n.sum())


def finite_vectors(rows: DataFrame) -> DataFrame:
    """vec_id, label (text), vector: the rows that count."""
    v = F.col("embedding").cast("array<double>")
    d = rows.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("string").alias("label"), v.alias("vector"))
    return d.filter(F.col("vector").isNotNull() & F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))))


def blocks(kept: DataFrame, dims: int) -> DataFrame:
    """One row a block: vec_id and label arrays, and the block's points and
    trees (``pack``)."""
    size = max(LEAF, BLOCK // dims)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        n = 0
        for b in batches:
            while b.num_rows:
                cut = b.slice(0, size - n)
                held.append(cut)
                n += cut.num_rows
                b = b.slice(cut.num_rows)
                if n == size:
                    yield block_row(held, dims)
                    held, n = [], 0
        if held:
            yield block_row(held, dims)

    return kept.mapInArrow(run, "vec_ids array<long>, labels array<string>, trees binary")


def block_row(held: list[pa.RecordBatch], dims: int) -> pa.RecordBatch:
    t = pa.Table.from_batches(held)
    col = t.column("vector").combine_chunks()
    off = np.asarray(col.offsets)
    flat = col.values.to_numpy(zero_copy_only=False)
    x = to_integers([flat[a:b] for a, b in zip(off[:-1], off[1:], strict=True)], dims)
    wide = dims // PARTS
    saved = {}
    for p in range(PARTS):
        tree = CoverTree.build(x[:, p * wide:(p + 1) * wide])
        saved |= {f"{p}{k}": v for k, v in vars(tree).items()}
    out = io.BytesIO()
    np.savez(out, x=x.astype(np.int32), **{k: v if v.dtype == float else v.astype(np.int32) for k, v in saved.items()})
    return pa.RecordBatch.from_arrays([pa.array([t.column("vec_id").to_pylist()], pa.list_(pa.int64())),
                                       pa.array([t.column("label").to_pylist()], pa.list_(pa.string())),
                                       pa.array([out.getvalue()], pa.binary())], names=["vec_ids", "labels", "trees"])


def read_block(raw: bytes) -> Iterator[tuple[int, CoverTree, np.ndarray]]:
    """(part, tree, points in tree order) of a block."""
    with np.load(io.BytesIO(raw)) as z:
        x = z["x"].astype(np.int64)
        wide = x.shape[1] // PARTS
        for p in range(PARTS):
            tree = CoverTree(*(z[f"{p}{k}"] if k == "radius" else z[f"{p}{k}"].astype(np.int64) for k in ("order", "lo", "hi", "radius", "first", "n")))
            yield p, tree, x[tree.order, p * wide:(p + 1) * wide]


def lloyd_round(trees: DataFrame, books: list[np.ndarray]) -> list[np.ndarray]:
    """The codebooks after one round over all blocks."""
    k, wide = books[0].shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = np.zeros((PARTS, k), np.int64)
        total = np.zeros((PARTS, k, wide), np.int64)
        for b in batches:
            for raw in b.column(0):
                for p, tree, x in read_block(raw.as_py()):
                    ran, entry, places, single = tree.assign(x, books[p])
                    upto = np.zeros((len(x) + 1, wide), np.int64)
                    np.cumsum(x, 0, out=upto[1:])
                    np.add.at(count[p], entry, ran[:, 1] - ran[:, 0])
                    np.add.at(total[p], entry, upto[ran[:, 1]] - upto[ran[:, 0]])
                    np.add.at(count[p], single, 1)
                    np.add.at(total[p], single, x[places])
        part, entry = np.nonzero(count)
        if len(part):
            sums = pa.ListArray.from_arrays(pa.array(np.arange(0, len(part) * wide + 1, wide, dtype=np.int32)), pa.array(total[part, entry].ravel()))
            yield pa.RecordBatch.from_arrays([pa.array(part.astype(np.int32)), pa.array(entry.astype(np.int32)), pa.array(count[part, entry]), sums],
                                             names=["part", "entry", "n", "sums"])

    partial = trees.select("trees").mapInArrow(run, "part int, entry int, n long, sums array<long>")
    rows = (partial.select("part", "entry", "n", F.posexplode("sums").alias("at", "s")).groupBy("part", "entry", "at")
            .agg(F.sum("n").alias("n"), F.sum(F.col("s").cast("decimal(38,0)")).alias("s")).collect())  # 64 entries of one vector's length
    out = [b.copy() for b in books]
    for r in rows:
        out[r["part"]][r["entry"], r["at"]] = int(r["s"]) // r["n"]
    return out


def codes(trees: DataFrame, books: list[np.ndarray]) -> DataFrame:
    """vec_id, label, code, error of every row of the blocks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for ids, labels, raw in zip(b.column(0), b.column(1), b.column(2), strict=True):
                n = len(ids)
                got = np.empty((n, PARTS), np.uint8)
                error = np.zeros(n, np.int64)
                for p, tree, x in read_block(raw.as_py()):
                    ran, entry, places, single = tree.assign(x, books[p])
                    mine = np.empty(n, np.int64)
                    mine[spans(ran[:, 0], ran[:, 1] - ran[:, 0])] = np.repeat(entry, ran[:, 1] - ran[:, 0])
                    mine[places] = single
                    got[tree.order, p] = mine
                    error[tree.order] += ((x - books[p][mine]) ** 2).sum(1)
                yield pa.RecordBatch.from_arrays([ids.values, labels.values, pa.array([r.tobytes().hex() for r in got], pa.string()), pa.array(error)],
                                                 names=["vec_id", "label", "code", "error"])

    return trees.mapInArrow(run, "vec_id long, label string, code string, error long")


def compress(rows: DataFrame, rounds: int = ROUNDS, entries: int = ENTRIES) -> DataFrame:
    """vec_id, code, error, label_error, codebooks_sha256: a row per kept vector."""
    kept = finite_vectors(rows)
    longest = kept.agg(F.max(F.size("vector")).alias("n")).first()["n"]
    if longest is None:
        return rows.sparkSession.createDataFrame([], SCHEMA)
    dims = max(PARTS, -(-longest // PARTS) * PARTS)
    start = to_integers([np.array(r["vector"]) for r in kept.orderBy(F.asc_nulls_last("vec_id"), "vector").limit(entries).collect()], dims)
    wide = dims // PARTS
    books = [start[:, p * wide:(p + 1) * wide] for p in range(PARTS)]
    trees = materialize(blocks(kept, dims), "cover-trees")
    for _ in range(rounds):
        books = lloyd_round(trees, books)
    sha = hashlib.sha256(",".join(str(v) for b in books for v in b.ravel().tolist()).encode()).hexdigest()
    key = F.coalesce(F.concat(F.lit("="), "label"), F.lit(""))
    out = materialize(codes(trees, books).withColumn("key", key), "codes")
    sums = out.groupBy("key").agg(
        F.least(F.sum(F.col("error").cast("decimal(38,0)")), F.lit(2**63 - 1).cast("decimal(38,0)")).cast("long").alias("label_error"))
    return out.join(sums, "key").select("vec_id", "code", "error", "label_error", F.lit(sha).alias("codebooks_sha256"))


def oracle() -> str:
    """DuckDB SQL of ``compress`` over embeddings (vectors of one length, a
    multiple of 16)."""
    with_ = ["""kept AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY vec_id NULLS LAST, embedding) - 1 AS r, vec_id, label,
         list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)""",
             """cut AS MATERIALIZED (
  SELECT r, p, list_slice(v, p * (len(v) // 16) + 1, (p + 1) * (len(v) // 16)) AS x
  FROM kept, (SELECT unnest(generate_series(0, 15)) AS p))""",
             "b0 AS MATERIALIZED (SELECT p, r AS e, x AS c FROM cut WHERE r < 64)"]
    for i in range(ROUNDS + 1):
        with_.append(f"""a{i} AS MATERIALIZED (
  SELECT r, cut.p, any_value(x) AS x, arg_min(e, d * 64 + e) AS e, min(d) AS d
  FROM (SELECT r, cut.p, x, e, list_sum(list_transform(list_zip(x, c), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS d
        FROM cut JOIN b{i} USING (p)) cut GROUP BY r, cut.p)""")
        if i < ROUNDS:
            with_.append(f"""m{i} AS (
  SELECT p, e, list(CAST((s - ((s % n + n) % n)) // n AS BIGINT) ORDER BY i) AS c
  FROM (SELECT p, e, i, CAST(sum(x[i]) AS BIGINT) AS s, count(*) AS n
        FROM (SELECT p, e, x, unnest(generate_series(1, len(x))) AS i FROM a{i}) GROUP BY p, e, i) GROUP BY p, e)""")
            with_.append(f"b{i + 1} AS MATERIALIZED (SELECT b{i}.p, b{i}.e, coalesce(m{i}.c, b{i}.c) AS c FROM b{i} LEFT JOIN m{i} USING (p, e))")
    with_.append(f"""done AS (
  SELECT r, string_agg(printf('%02x', e), '' ORDER BY p) AS code, CAST(sum(d) AS BIGINT) AS error FROM a{ROUNDS} GROUP BY r)""")
    with_.append(f"""sha AS (
  SELECT sha256(string_agg(array_to_string(c, ','), ',' ORDER BY p, e)) AS h FROM b{ROUNDS})""")
    return "WITH " + ",\n".join(with_) + """
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, h AS codebooks_sha256
FROM kept JOIN done USING (r), sha"""
