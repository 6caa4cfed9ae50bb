"""Embedding near-duplicates by an inverted multi-index (operator 8).

Equal vectors of a label are one class; only its smallest id is indexed, with the
number of its copies.  Vectors are scaled to length one and split in halves; each
half has a codebook of its own (k-means on a bounded sample of ``SAMPLE``
vectors), and the pairs of codes form a product grid of cells.  There are as many
codes as give about ``CELL_ROWS`` classes a cell of the largest label (16 at
least, an eighth of the sample at most).  A vector's cells are visited by
multi-sequence traversal: both halves' codes in order of distance, and a heap that
gives the pairs of codes in ascending order of the summed distances.  How many
cells are visited is measured: ``QUERIES`` sampled vectors are compared with all
classes of their labels, and the depth is the least at which ``RECALL`` of the
links found lie in visited cells.  Every row is indexed and every row queries;
what a visited cell holds is verified by cosine in double precision.

Plan: a row goes once to its own cell (as a member) and once to each visited
cell (as a visitor), keyed by (label, cell).  Large cells are cut into blocks of
members and visitors of about ``BLOCK`` rows, dealt to tasks as pairs of blocks;
a task multiplies the blocks and returns, for each vector, how many links it
found and a spanning forest of them, never the pairs.  A link is found if either
end visits the other's cell, and is counted once for both.

Defined results: vectors that are null, zero or hold null or non-finite
components, and vectors with a null label, link with nothing and are their own
component; rows of equal id are one vector for links, the smallest by label and
components (a vector never links with itself), and a row each in the result; a null id links with nothing and has a
null component; halves of vectors of odd length differ by one; lengths other
than the commonest of the sample compare only with their own length (by brute
force blocks); an empty table gives an empty result; extra columns are ignored, whatever their names.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize
from .components import connected_components

THRESHOLD = 0.93
SAMPLE = 4096        # vectors that reach the driver, at most: fits the codebooks
QUERIES = 512        # of them that are compared with all classes, to measure the depth
CODES = 16           # codes of a half, at least
CELL_ROWS = 64       # classes of the largest label in a cell, on average
RECALL = 0.995       # of the links of the queries, in visited cells
MIN_VISITS = 8
BLOCK = 1024
SEED = 7


def unit(v: np.ndarray) -> np.ndarray:
    return v / np.linalg.norm(v, axis=1, keepdims=True)


def kmeans(x: np.ndarray, k: int, rounds: int = 12) -> np.ndarray:
    rng = np.random.default_rng(SEED)
    c = x[rng.choice(len(x), min(k, len(x)), replace=False)].copy()
    for _ in range(rounds):
        near = np.argmin(dist(x, c), 1)
        for j in range(len(c)):
            if (near == j).any():
                c[j] = x[near == j].mean(0)
    return c


def dist(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    return np.maximum((x * x).sum(1)[:, None] - 2 * x @ c.T + (c * c).sum(1)[None, :], 0)


class Index:
    """Codebooks of the two halves, and how many cells are visited."""

    def __init__(self, first: np.ndarray, second: np.ndarray, visits: int) -> None:
        self.first, self.second, self.visits = first, second, visits

    @property
    def dim(self) -> int:
        return self.first.shape[1] + self.second.shape[1]

    def halves(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """[vector, code] distances of each half."""
        h = self.first.shape[1]
        return dist(x[:, :h], self.first), dist(x[:, h:], self.second)

    def own(self, x: np.ndarray) -> np.ndarray:
        """The cell of each vector."""
        one, two = self.halves(x)
        return one.argmin(1) * len(self.second) + two.argmin(1)

    def visited(self, x: np.ndarray) -> np.ndarray:
        """The first cells of each vector's multi-sequence traversal, its own first."""
        one, two = self.halves(x)
        n = min(self.visits, len(self.first) * len(self.second))
        return np.array([traversal(a, b, n) for a, b in zip(one, two, strict=True)]).reshape(len(x), n)


def traversal(one: np.ndarray, two: np.ndarray, n: int) -> list[int]:
    """The ``n`` cells of least summed distance, ascending: a pair of places
    (i, j) in the two sorted lists brings (i, j + 1) onto the heap and, from the
    start of a row, (i + 1, j)."""
    a, b = np.argsort(one, kind="stable").tolist(), np.argsort(two, kind="stable").tolist()
    da, db = one[a].tolist(), two[b].tolist()
    heap, out = [(da[0] + db[0], 0, 0)], []
    while len(out) < n:
        _, i, j = heapq.heappop(heap)
        out.append(a[i] * len(b) + b[j])
        if j + 1 < len(b):
            heapq.heappush(heap, (da[i] + db[j + 1], i, j + 1))
        if j == 0 and i + 1 < len(a):
            heapq.heappush(heap, (da[i + 1] + db[0], i + 1, 0))
    return out


def visit_rank(one: np.ndarray, two: np.ndarray, cell: int) -> int:
    """How many cells the traversal visits until ``cell``, those of an equal
    distance included."""
    return int((one[:, None] + two[None, :] <= one[cell // len(two)] + two[cell % len(two)]).sum())


def fit(x: np.ndarray, codes: int = CODES) -> Index:
    """Codebooks from sampled unit vectors."""
    h = x.shape[1] // 2
    return Index(kmeans(x[:, :h], codes), kmeans(x[:, h:], codes), MIN_VISITS)


def measured_depth(classes: DataFrame, queries: list, index: Index, threshold: float) -> int:
    """The depth at which ``RECALL`` of the links between ``queries`` and all
    classes of their labels lie in visited cells, of either end."""
    ids = np.array([r["vec_id"] for r in queries])
    labels = np.array([r["name"] for r in queries], object)
    x = unit(np.array([r["vec"] for r in queries], np.float64))
    own, (one, two) = index.own(x), index.halves(x)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            vecs = b.column(2).to_pylist()
            fits = [i for i, v in enumerate(vecs) if len(v) == index.dim]
            need = []
            for a in range(0, len(fits), 512):
                part = fits[a:a + 512]
                y = unit(np.array([vecs[i] for i in part], np.float64))
                his = np.array(b.column(0).take(pa.array(part)).to_pylist())
                name = np.array(b.column(1).take(pa.array(part)).to_pylist(), object)
                mine, (y1, y2) = index.own(y), index.halves(y)
                for i, j in zip(*np.nonzero((y @ x.T >= threshold) & (name[:, None] == labels[None, :]) & (his[:, None] != ids[None, :])), strict=True):
                    need.append(min(visit_rank(one[j], two[j], mine[i]), visit_rank(y1[i], y2[i], own[j])))
            yield pa.RecordBatch.from_arrays([pa.array(need, pa.int64())], names=["need"])

    counts = (classes.select("vec_id", F.col("label").cast("string").alias("name"), "vec").mapInArrow(run, "need long")
              .groupBy("need").agg(F.count("*").alias("n")).orderBy("need").collect())     # one row a depth: at most the cells
    total, so_far = sum(r["n"] for r in counts), 0
    for r in counts:
        so_far += r["n"]
        if so_far >= RECALL * total:
            return max(MIN_VISITS, r["need"])
    return MIN_VISITS


def clean(vectors: DataFrame) -> DataFrame:
    """vec_id, label, vec: the rows that may link, one per id."""
    v = F.col("vec")
    # single precision stays so on the way (half the bytes); all sums are in double
    kind = vectors.schema["embedding"].dataType.simpleString()
    vec = F.col("embedding") if kind in ("array<float>", "array<double>") else F.col("embedding").cast("array<double>")
    ok = (F.size(v) > 0) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    rows = (vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").alias("label"), vec.alias("vec"))
            .filter("vec_id IS NOT NULL AND label IS NOT NULL AND vec IS NOT NULL").filter(F.coalesce(ok, F.lit(False))))
    return rows.groupBy("vec_id").agg(F.min(F.struct("label", "vec")).alias("r")).select("vec_id", "r.label", "r.vec")


def block(ids_m, x_m, visit_m, cell_m, copies_m, ids_v, x_v, visit_v, cell_v, copies_v, threshold: float):
    """Links of a block pair: counts by vector (copies counted), and forest edges.  The visitors
    visit the cell in which the members lie.  A pair is counted for both ends
    here; if the member also visits the visitor's cell, the pair comes up there
    again, and only its visitor's count is taken each time."""
    sim = (x_v @ x_m.T >= threshold) & (ids_v[:, None] != ids_m[None, :])
    if not sim.any():
        return [], [], []
    count_v = sim @ copies_m
    back = np.zeros(sim.shape, bool)
    for cols in range(visit_m.shape[1]):
        back |= cell_v[:, None] == visit_m[None, :, cols]
    count_m = copies_v @ (sim & ~back)
    counts = [(int(i), int(c)) for i, c in zip(ids_v, count_v, strict=True) if c] + [(int(i), int(c)) for i, c in zip(ids_m, count_m, strict=True) if c]
    root: dict[int, int] = {}

    def find(x: int) -> int:
        while root.setdefault(x, x) != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    us, vs = [], []
    for r in np.flatnonzero(count_v):
        a = int(ids_v[r])
        for c in np.flatnonzero(sim[r]):
            b = int(ids_m[c])
            p, q = find(a), find(b)
            if p != q:
                root[p] = q
                us.append(a)
                vs.append(b)
    return counts, us, vs


def near_vectors(vectors: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """vec_id, n_links, component_id, kept: a row per vector."""
    spark = vectors.sparkSession
    every = materialize(clean(vectors), "vectors")
    good = materialize(every.groupBy("label", "vec").agg(F.min("vec_id").alias("vec_id"), F.count("*").alias("copies"))
                       .select("vec_id", "label", "vec", "copies"), "classes")
    largest = good.groupBy("label").agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 0
    head = good.orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE).withColumn("name", F.col("label").cast("string")).collect()
    sizes = [len(r["vec"]) for r in head]
    dim = max(set(sizes), key=sizes.count) if sizes else 0
    rows = [r for r in head if len(r["vec"]) == dim]
    index = None
    if len(rows) > 1 and dim > 1:
        codes = min(max(CODES, math.ceil(math.sqrt(largest / CELL_ROWS))), max(CODES, SAMPLE // 8))
        index = fit(unit(np.array([r["vec"] for r in rows], np.float64)), codes)
        index.visits = measured_depth(good, rows[:QUERIES], index, threshold)
    other = -1          # the one cell of vectors without an index

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, vecs = b.column(0).to_pylist(), b.column(2).to_pylist()
            out: list[tuple] = []
            fits = [i for i, v in enumerate(vecs) if index is not None and len(v) == index.dim]
            lists = {}
            for a in range(0, len(fits), 512):
                part = fits[a:a + 512]
                for i, cells in zip(part, index.visited(unit(np.array([vecs[i] for i in part], np.float64))).tolist(), strict=True):
                    lists[i] = cells
            for i, doc in enumerate(ids):
                cells = lists.get(i, [other])
                out.append((i, doc, cells[0], cells))
            yield pa.RecordBatch.from_arrays(
                [pa.array([o[1] for o in out], pa.int64()), b.column(1).take(pa.array([o[0] for o in out], pa.int64())),
                 b.column(2), b.column(3), pa.array([o[2] for o in out], pa.int32()), pa.array([o[3] for o in out], pa.list_(pa.int32()))],
                names=["vec_id", "label", "vec", "copies", "cell", "cells"])

    label_type = good.schema["label"].dataType.simpleString()
    vec_type = good.schema["vec"].dataType.simpleString()
    placed = materialize(good.mapInArrow(place, f"vec_id long, label {label_type}, vec {vec_type}, copies long, cell int, cells array<int>"), "cells")
    visits = placed.select("vec_id", "label", F.explode("cells").alias("at"))
    n_m = placed.groupBy("label", F.col("cell").alias("at")).agg(F.count("*").alias("m"))
    n_v = visits.groupBy("label", "at").agg(F.count("*").alias("v"))
    blocks = n_m.join(n_v, ["label", "at"]).select("label", "at", F.ceil(F.col("m") / F.lit(BLOCK)).cast("int").alias("mb"),
                                                   F.ceil(F.col("v") / F.lit(BLOCK)).cast("int").alias("vb"))
    h = F.xxhash64("vec_id")
    members = (placed.withColumn("at", F.col("cell")).join(blocks, ["label", "at"])
               .select("label", "at", F.pmod(h, F.col("mb")).cast("int").alias("a"), F.explode(F.sequence(F.lit(0), F.col("vb") - 1)).alias("b"),
                       F.lit(True).alias("member"), "vec_id", "vec", "cell", "cells", "copies"))
    visitors = (placed.withColumn("at", F.explode("cells")).join(blocks, ["label", "at"])
                .select("label", "at", F.explode(F.sequence(F.lit(0), F.col("mb") - 1)).alias("a"), F.pmod(h, F.col("vb")).cast("int").alias("b"),
                        F.lit(False).alias("member"), "vec_id", "vec", "cell", "cells", "copies"))

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, m, v = None, [], []

        def done() -> pa.RecordBatch:
            out: list[tuple] = []
            if m and v:
                for d in {len(r[1]) for r in m}:
                    mm, vv = [r for r in m if len(r[1]) == d], [r for r in v if len(r[1]) == d]
                    if vv:
                        pack = lambda rs: (np.array([r[0] for r in rs]), unit(np.array([r[1] for r in rs])), np.array([r[3] for r in rs]), np.array([r[2] for r in rs]), np.array([r[4] for r in rs]))
                        counts, us, vs = block(*pack(mm), *pack(vv), threshold)
                        out += [(i, c, None) for i, c in counts] + [(a, 0, b) for a, b in zip(us, vs, strict=True)]
            cols = list(zip(*out, strict=True)) if out else [()] * 3
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], names=["vec_id", "n", "other"])

        for b in batches:
            values, offs = b.column(6).flatten().to_numpy(zero_copy_only=False), b.column(6).value_lengths().to_numpy().cumsum()
            for r, (label, at, x, y, member, i, cell, cells, copies) in enumerate(zip(*(b.column(c).to_pylist() for c in (0, 1, 2, 3, 4, 5, 7, 8, 9)), strict=True)):
                if (label, at, x, y) != key:
                    if key is not None:
                        yield done()
                    key, m, v = (label, at, x, y), [], []
                vec = values[offs[r - 1] if r else 0:offs[r]].astype(np.float64)
                (m if member else v).append((i, vec, cell, cells, copies))
        if key is not None:
            yield done()

    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    found = materialize(members.union(visitors).repartition(n, "label", "at", "a", "b").sortWithinPartitions("label", "at", "a", "b")
                        .mapInArrow(compare, "vec_id long, n long, other long"), "found")
    links = found.filter("n > 0").groupBy("vec_id").agg(F.sum("n").cast("long").alias("__n"))
    comp = connected_components(found.filter("other IS NOT NULL"), "vec_id", "other").withColumnRenamed("node", "vec_id")
    per = (good.select("vec_id", "copies").join(links, "vec_id", "left").join(comp, "vec_id", "left")
           .select(F.col("vec_id").alias("first"), (F.coalesce("__n", F.lit(0)) + F.col("copies") - 1).alias("__n"), F.coalesce("component", "vec_id").alias("__c")))
    first = every.join(good.select("label", "vec", F.col("vec_id").alias("first")), ["label", "vec"]).select("vec_id", "first")
    c = F.coalesce("__c", "vec_id")
    return (vectors.select(F.col("vec_id").cast("long").alias("vec_id")).join(first.join(per, "first"), "vec_id", "left")
            .select("vec_id", F.coalesce("__n", F.lit(0)).cast("long").alias("n_links"), c.alias("component_id"),
                    F.coalesce(F.col("vec_id") == c, F.lit(False)).alias("kept")))
