"""Mixing sources to target weights by a low-discrepancy schedule (operator 1).

Native: DataFrame functions only.

* Targets: sources in code point order (null last) weigh 5, 2, 1, repeating.
  They share ``share`` times all words by weight; a target stops at
  ``max_epochs`` times its source's words and the excess is shared again by
  weight.  That fixed point is a water level: target = min(cap, weight * level),
  found from running sums over sources ordered by cap / weight.
* Stream of a source: its documents in md5 order of their ids, word by word,
  repeated for a second epoch; cut into blocks of ``block_words`` words.
* Schedule: slot i holds the van der Corput point of i (its ``BITS`` bits in
  reverse order), mapped through the sources' cumulative shares; the r-th slot of
  a source takes its r-th block.  The last block stops at the target.  Blocks
  that the points leave without a slot take the slots that other sources have
  left over, so each source reaches its target.

Scale: texts are read once for word counts (written once, ids and counts only).
Word offsets and slot ranks are taken in two levels (65,536 md5 buckets a source,
65,536 slots a bucket), so a source with a third of all rows is never ordered
in one task.  Slots and pieces join on (source, block), an even key.  Joins with
the table of sources (one row each) are plain; Spark broadcasts it if it is small.

Defined results: null text and text without words have size 0 and are never
taken; a null source is a source of its own; repeated rows count as separate
documents; an empty table gives an empty result; extra columns are ignored,
whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import free_name, materialize, n_words

SHARE = 1.5
MAX_EPOCHS = 2
WEIGHTS = (5, 2, 1)
BLOCK_WORDS = 64
BITS = 44                      # of a point: more than slots of any corpus
RANGE = 1 << BITS
CELL = 1 << (BITS - 12)        # points a cell of the share lookup
SLOT_BUCKET = 1 << 16


def document_sizes(docs: DataFrame, *keep: str) -> DataFrame:
    """doc_id, source, size (words) and the columns ``keep``."""
    return docs.select("doc_id", "source", n_words("text").alias("size"), *keep)


def source_targets(sizes: DataFrame, share: float = SHARE, max_epochs: int = MAX_EPOCHS,
                   weights: tuple[int, ...] = WEIGHTS) -> DataFrame:
    """One row per source: source, sidx (0 first), weight, source_size, target.
    Windows without a partition run over this table of sources only."""
    per = sizes.groupBy("source").agg(F.sum("size").cast("long").alias("source_size"))
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]),
                     (F.pmod(F.col("sidx"), F.lit(len(weights))) + 1).cast("int"))
    per = (per.withColumn("sidx", (F.row_number().over(by_name) - 1).cast("long"))
           .withColumn("weight", w)
           .withColumn("cap", F.col("source_size") * float(max_epochs)))
    level = Window.orderBy((F.col("cap") / F.col("weight")).asc(), "sidx")
    done = level.rowsBetween(Window.unboundedPreceding, -1)
    rest = level.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    whole = level.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    lam = ((F.sum("source_size").over(whole) * F.lit(float(share)) - F.coalesce(F.sum("cap").over(done), F.lit(0.0)))
           / F.sum("weight").over(rest))
    per = per.withColumn("__lam", lam).withColumn("__full", F.col("cap") / F.col("weight") <= F.col("__lam"))
    water = F.first(F.when(~F.col("__full"), F.col("__lam")), ignorenulls=True).over(whole)
    return (per.withColumn("__water", water)
            .withColumn("target", F.when(F.col("__full"), F.col("cap")).otherwise(F.col("weight") * F.col("__water")))
            .select("source", "sidx", "weight", "source_size", "target"))


def with_shares(targets: DataFrame, block_words: int = BLOCK_WORDS) -> DataFrame:
    """Adds quota (whole words of the target), blocks, total_blocks and the
    source's interval [lo, hi) of the points."""
    order = Window.orderBy("sidx")
    total = Window.partitionBy()
    t = (targets.withColumn("quota", F.floor("target").cast("long"))
         .withColumn("blocks", F.ceil(F.col("quota") / F.lit(block_words)).cast("long"))
         .withColumn("total_blocks", F.sum("blocks").over(total).cast("long"))
         .withColumn("__cum", F.sum("blocks").over(order.rowsBetween(Window.unboundedPreceding, 0))))
    edge = lambda c: F.when(F.col("total_blocks") > 0, F.floor(c / F.col("total_blocks") * float(RANGE))).otherwise(0).cast("long")
    return t.withColumn("lo", edge(F.col("__cum") - F.col("blocks"))).withColumn("hi", edge(F.col("__cum"))).drop("__cum")


def slots(shares: DataFrame, n: int) -> DataFrame:
    """slot, sidx, block: slot i's source and the rank of the slot among its
    source's slots."""
    spark = shares.sparkSession
    point = F.conv(F.reverse(F.lpad(F.bin("slot"), BITS, "0")), 2, 10).cast("long")
    pts = (spark.range(n).select(F.col("id").alias("slot")).withColumn("point", point)
           .withColumn("cell", F.floor(F.col("point") / F.lit(CELL)).cast("long")))
    cells = (shares.filter("hi > lo")
             .select("sidx", "lo", "hi", F.explode(F.sequence(F.floor(F.col("lo") / F.lit(CELL)).cast("long"),
                                                              F.floor((F.col("hi") - 1) / F.lit(CELL)).cast("long"))).alias("cell")))
    hit = (pts.join(cells, "cell").filter("point >= lo AND point < hi")
           .select("slot", "sidx", F.floor(F.col("slot") / F.lit(SLOT_BUCKET)).cast("long").alias("part")))
    inside = Window.partitionBy("sidx", "part").orderBy("slot")
    counts = hit.groupBy("sidx", "part").agg(F.count("*").alias("__n"))
    before = Window.partitionBy("sidx").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select("sidx", "part", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__before"))
    return (hit.withColumn("__r", F.row_number().over(inside)).join(counts, ["sidx", "part"])
            .select("slot", "sidx", (F.col("__before") + F.col("__r") - 1).cast("long").alias("block")))


def filled(taken: DataFrame, shares: DataFrame) -> DataFrame:
    """The slots with those past a source's last block given to the blocks that
    have none, in the order of sources.  There are as many slots as blocks, so
    every block has its slot."""
    taken = materialize(taken, "slots")
    per = (shares.select("sidx", "blocks").join(taken.groupBy("sidx").agg(F.count("*").alias("n")), "sidx", "left")
           .withColumn("n", F.coalesce("n", F.lit(0))))
    before = Window.orderBy("sidx").rowsBetween(Window.unboundedPreceding, -1)
    so_far = lambda c: F.coalesce(F.sum(F.greatest(c, F.lit(0))).over(before), F.lit(0))
    per = materialize(per.withColumn("__spare", so_far(F.col("n") - F.col("blocks"))).withColumn("__need", so_far(F.col("blocks") - F.col("n"))), "slot-counts")
    all_ = taken.join(per, "sidx")
    spare = all_.filter("block >= blocks").select("slot", (F.col("__spare") + F.col("block") - F.col("blocks")).alias("__nth"))
    need = (per.filter("n < blocks").withColumn("block", F.explode(F.sequence(F.col("n"), F.col("blocks") - 1)))
            .select("sidx", F.col("block").cast("long").alias("block"), (F.col("__need") + F.col("block") - F.col("n")).alias("__nth")))
    return all_.filter("block < blocks").select("slot", "sidx", "block").unionByName(spare.join(need, "__nth").select("slot", "sidx", "block"))


def stream_offsets(sizes: DataFrame) -> DataFrame:
    """Adds ``pos``: the first word of each document (of one word at least) in
    its source's stream."""
    tie = [c for c in sizes.columns if c not in ("doc_id", "size", "sidx")]
    d = (sizes.filter("size > 0").withColumn("__h", F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))))
         .withColumn("__b", F.substring("__h", 1, 4)))
    counts = d.groupBy("sidx", "__b").agg(F.sum("size").alias("__n"))
    before = Window.partitionBy("sidx").orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select("sidx", "__b", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__before"))
    inside = Window.partitionBy("sidx", "__b").orderBy("__h", "doc_id", "size", *tie).rowsBetween(Window.unboundedPreceding, -1)
    return (d.withColumn("__in", F.coalesce(F.sum("size").over(inside), F.lit(0))).join(counts, ["sidx", "__b"])
            .withColumn("pos", (F.col("__before") + F.col("__in")).cast("long")).drop("__h", "__b", "__in", "__before"))


class Mix:
    """The mix of a table of documents (doc_id, text, source).

    ``documents``: doc_id, source, size, sidx, source_size, target and kept
    columns, one row per document; ``schedule()``: the mix itself; ``taken()``:
    words taken of every document."""

    def __init__(self, docs: DataFrame, keep: tuple[str, ...] = (), share: float = SHARE, max_epochs: int = MAX_EPOCHS,
                 weights: tuple[int, ...] = WEIGHTS, block_words: int = BLOCK_WORDS) -> None:
        self.block_words, self.max_epochs = block_words, max_epochs
        sizes = materialize(document_sizes(docs, *keep), "sizes")
        self.shares = materialize(with_shares(source_targets(sizes, share, max_epochs, weights), block_words), "shares")
        self.n_slots = int(self.shares.agg(F.max("total_blocks")).first()[0] or 0)
        s = self.shares.select(F.col("source").alias("__s"), "sidx", "source_size", "target", "quota")
        self.documents = sizes.join(s, F.col("source").eqNullSafe(F.col("__s"))).drop("__s")

    def pieces(self) -> DataFrame:
        """sidx, block, pos, epoch, doc_id, start, length: the words of a
        document (from ``start`` on) that lie in a block of its source."""
        b = F.lit(self.block_words)
        d = stream_offsets(self.documents.select("doc_id", "size", "sidx", "source_size", "quota"))
        d = d.select("*", F.explode(F.sequence(F.lit(0), F.lit(self.max_epochs - 1))).alias("epoch"))
        first = F.col("epoch") * F.col("source_size") + F.col("pos")
        d = (d.withColumn("a", first).withColumn("z", F.least(F.col("a") + F.col("size"), F.col("quota"))).filter("a < z")
             .withColumn("block", F.explode(F.sequence(F.floor(F.col("a") / b).cast("long"), F.floor((F.col("z") - 1) / b).cast("long")))))
        lo, hi = F.greatest("a", F.col("block") * b), F.least("z", (F.col("block") + 1) * b)
        return d.select("sidx", "block", "pos", "epoch", "doc_id", (lo - F.col("a")).cast("long").alias("start"),
                        (hi - lo).cast("long").alias("length"))

    def schedule(self) -> DataFrame:
        """slot, sidx, block, pos, epoch, doc_id, start, length: the mixed
        order; the words of a slot are its rows by (epoch, pos)."""
        return filled(slots(self.shares, self.n_slots), self.shares).join(self.pieces(), ["sidx", "block"])

    def taken(self) -> DataFrame:
        """``documents`` and ``taken``: words of each in the mix, repeats counted."""
        t = self.schedule().groupBy("sidx", "pos").agg(F.sum("length").cast("long").alias("taken"))
        keep = [c for c in self.documents.columns if c not in ("sidx", "quota")]
        some = stream_offsets(self.documents).join(t, ["sidx", "pos"], "left").select(*keep, F.coalesce("taken", F.lit(0)).cast("long").alias("taken"))
        none = self.documents.filter("size = 0").select(*keep, F.lit(0).cast("long").alias("taken"))
        return some.unionByName(none)


def mix_documents(docs: DataFrame, **options) -> DataFrame:
    """doc_id, source, size, source_size, target, taken: one row per document."""
    return Mix(docs, **options).taken().select("doc_id", "source", "size", "source_size", "target", "taken")


def mixed_texts(docs: DataFrame, **options) -> DataFrame:
    """The mixed documents themselves, with the columns of ``docs``: a row for
    each time the mix takes a document, whole, or up to the word at which its
    source's target ends.  Order within the table is not kept.  Documents that
    the mix does not reach and documents without words are not in it."""
    key = F.md5(F.concat_ws("|", F.coalesce(F.col("doc_id").cast("string"), F.lit("null")),
                            F.when(F.col("source").isNull(), "n").otherwise(F.concat(F.lit("s"), "source")), F.coalesce("text", F.lit(""))))
    k, taken, size, part = (free_name(docs, "mix_" + x) for x in ("key", "taken", "size", "part"))
    keyed = docs.withColumn(k, key)
    t = (Mix(keyed.select("doc_id", "source", "text", F.col(k).alias("mix_key")), keep=("mix_key",), **options).taken().filter("taken > 0")
         .groupBy("mix_key").agg(F.sum("taken").alias(taken), F.first("size").alias(size)).withColumnRenamed("mix_key", k))
    # rows that are equal in id, source and text are one row with the sum of their words
    one = keyed.dropDuplicates([k])
    full, rest = F.floor(F.col(taken) / F.col(size)).cast("int"), F.pmod(F.col(taken), F.col(size)).cast("int")
    parts = F.concat(F.array_repeat(F.lit(0), full), F.when(rest > 0, F.array(rest)).otherwise(F.array().cast("array<int>")))
    cut = F.array_join(F.slice(F.regexp_extract_all("text", F.lit(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+"), F.lit(0)), F.lit(1), F.col(part)), "")
    out = one.join(t, k).select(*one.columns, F.explode(parts).alias(part))
    out = out.withColumn("text", F.when(F.col(part) == 0, F.col("text")).otherwise(cut))
    cols = [c if c.lower() != "n_chars" else F.length("text").cast(docs.schema[c].dataType).alias(c) for c in docs.columns]
    return out.select(*cols)


ORACLE = """
WITH d AS (
  SELECT doc_id, source,
         CAST(coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0) AS BIGINT) AS size
  FROM documents),
s0 AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
s1 AS (SELECT *, row_number() OVER (ORDER BY source ASC NULLS LAST) - 1 AS sidx FROM s0),
s2 AS (SELECT *, CASE sidx % 3 WHEN 0 THEN 5.0::DOUBLE WHEN 1 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS weight,
              source_size * 2.0::DOUBLE AS cap FROM s1),
s3 AS (SELECT *, (sum(source_size) OVER () * 1.5::DOUBLE
                  - coalesce(sum(cap) OVER (ORDER BY cap / weight, sidx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
                 / sum(weight) OVER (ORDER BY cap / weight, sidx ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS lam
       FROM s2),
s4 AS (SELECT *, (SELECT arg_min(lam, cap / weight) FROM s3 WHERE cap / weight > lam) AS water FROM s3),
s5 AS (SELECT source, sidx, source_size, CASE WHEN cap / weight <= lam THEN cap ELSE weight * water END AS target FROM s4),
s6 AS (SELECT *, CAST(floor(target) AS BIGINT) AS quota FROM s5),
pos AS (SELECT d.*, s6.sidx, s6.source_size, s6.target, s6.quota AS stop,
               CAST(coalesce(sum(size) OVER (PARTITION BY s6.sidx ORDER BY md5(coalesce(CAST(doc_id AS VARCHAR), 'null')), doc_id, size
                    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS pos
        FROM d JOIN s6 ON d.source IS NOT DISTINCT FROM s6.source)
SELECT doc_id, source, size, source_size, target,
       CAST(greatest(0, least(pos + size, stop) - pos) + greatest(0, least(source_size + pos + size, stop) - source_size - pos) AS BIGINT) AS taken
FROM pos
"""
