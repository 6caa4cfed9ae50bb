"""Domain-isolated and stratified train/test splits.

Both splits are deterministic functions of a seeded hash, so they need no
random state, survive recomputation after an executor loss and give the
same answer on every run.

* Hash split (default): a row goes to test when the hash of its group key
  falls below ``fraction`` of the hash range.  Narrow, no shuffle; groups
  are isolated exactly, sizes are approximate.
* Exact split: exactly ``k`` keys per stratum (``ceil`` for domains, ``round``
  per class) - the keys with the smallest (hash, key).  The k-th key is
  found from a 65,536-bucket histogram of the hash (a small aggregate) and
  the order, by ranges, of the one boundary bucket per stratum; then every
  row is flagged by comparing with that cut-off (one row per stratum: a
  literal for the domain split, a join for the classes).  The distinct domains
  are written once to the checkpoint folder so the URLs are parsed once for
  ranking and once for flagging.
  No step orders all rows in one task or collects keys to the driver.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from ..functions import lexicons as lx
from ..functions.url_parts import stage_parts
from ..session import materialize
from .ordering import by_ranges, place

HASH_RANGE = 1 << 32
BUCKETS = 1 << 16


def seeded_hash(key: Column, seed: int = lx.SPLIT_SEED) -> Column:
    """First 32 bits of md5('<seed>|<key>') as BIGINT in [0, 2^32)."""
    hexs = F.substring(F.md5(F.concat(F.lit(f"{seed}|"), key.cast("string"))), 1, 8)
    return F.conv(hexs, 16, 10).cast("bigint")


def with_domain(df: DataFrame, url_col: str = "url", out: str = "domain") -> DataFrame:
    """T5: registered-domain key of each URL: netloc, else path; a leading
    'www.' (case-sensitive) removed; cut at ':'; lower-cased; empty or
    unparsable -> NULL.

    Every intermediate value is used once by the next step, so when the
    optimizer copies the expression (e.g. into a pushed-down ``domain IS NOT
    NULL`` filter) it does not multiply."""
    staged, p, tmp = stage_parts(df, url_col)
    staged = staged.withColumn("__d0", F.when(~p.parse_error, F.when(F.length(p.netloc) > 0, p.netloc).otherwise(p.path)))
    d = F.lower(F.regexp_extract(F.col("__d0"), r"^(?:www\.)?([^:]*)", 1))
    # NULL for '' without naming the value twice: [d] minus '' -> first or NULL
    return staged.withColumn(out, F.get(F.array_remove(F.array(d), ""), 0)).drop(*tmp, "__d0")


def hash_split(df: DataFrame, key: str, fraction: float = lx.TEST_FRACTION, seed: int = lx.SPLIT_SEED,
               out: str = "split") -> DataFrame:
    cut = int(round(fraction * 10000))
    return df.withColumn(out, F.when(seeded_hash(F.col(key), seed) % 10000 < cut, F.lit("test")).otherwise(F.lit("train")))


def lowest_k_cutoff(keys: DataFrame, h: str, tie: str, k_of_n, strata=()) -> DataFrame:
    """Per stratum the (hash, tie) of the k-th smallest key, k = k_of_n(n).

    ``keys`` has one row per key to rank.  Returns strata + __h_cut, __t_cut
    (no row for strata with k = 0).  A histogram of the hash finds the bucket of
    the k-th key; the keys of that bucket are put in order by ranges, so even if
    all keys fall into one bucket no task ranks them alone."""
    strata = list(strata)
    b = (F.col(h) * BUCKETS / HASH_RANGE).cast("bigint").alias("__b")
    hist = keys.groupBy(*strata, b).agg(F.count("*").alias("__n"))
    w_before = Window.partitionBy(*[F.col(s) for s in strata]).orderBy("__b").rowsBetween(
        Window.unboundedPreceding, -1) if strata else Window.orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
    w_all = Window.partitionBy(*[F.col(s) for s in strata]) if strata else Window.partitionBy(F.lit(1))
    hist = (hist.withColumn("__before", F.coalesce(F.sum("__n").over(w_before), F.lit(0)))
            .withColumn("__total", F.sum("__n").over(w_all)))
    hist = hist.withColumn("__k", k_of_n(F.col("__total")).cast("bigint"))
    boundary = hist.where((F.col("__k") > 0) & (F.col("__before") < F.col("__k"))
                          & (F.col("__before") + F.col("__n") >= F.col("__k")))
    boundary = boundary.select(*strata, "__b", (F.col("__k") - F.col("__before")).alias("__need"))
    cand = keys.select(*strata, h, tie).withColumn("__b", b).join(boundary, [*strata, "__b"])
    ranked = place(by_ranges(cand, [*strata, h, tie], "boundary-keys"), "__i")
    first = ranked.groupBy(*strata).agg(F.min("__i").alias("__i0"))
    at = ranked.join(first, strata) if strata else ranked.join(first)          # one row a stratum
    return at.where(F.col("__i") - F.col("__i0") + 1 == F.col("__need")).select(
        *strata, F.col(h).alias("__h_cut"), F.col(tie).alias("__t_cut"))


def domain_split(df: DataFrame, url_col: str = "url", fraction: float = lx.TEST_FRACTION,
                 seed: int = lx.SPLIT_SEED, exact: bool = False, keep_domain: bool = True) -> DataFrame:
    """Rows without a domain are dropped (T6); every domain goes
    wholly to train or test.  Adds ``domain`` and ``split``."""
    d = with_domain(df, url_col).where(F.col("domain").isNotNull())
    d = d.withColumn("__h", seeded_hash(F.col("domain"), seed))
    if not exact:
        cut = int(round(fraction * 10000))
        out = d.withColumn("split", F.when(F.col("__h") % 10000 < cut, F.lit("test")).otherwise(F.lit("train")))
    else:
        # distinct domains are far fewer than rows: write them once, rank
        # them there, and bring back the one cut-off row
        keys = materialize(d.select("domain", "__h").distinct(), "split-domains")
        cut = lowest_k_cutoff(keys, "__h", "domain", lambda n: F.ceil(n * F.lit(fraction))).first()
        if cut is None:
            is_test = F.lit(False)
        else:
            h_cut, t_cut = F.lit(cut["__h_cut"]), F.lit(cut["__t_cut"])
            is_test = (F.col("__h") < h_cut) | ((F.col("__h") == h_cut) & (F.col("domain") <= t_cut))
        out = d.withColumn("split", F.when(is_test, F.lit("test")).otherwise(F.lit("train")))
    out = out.drop("__h")
    return out if keep_domain else out.drop("domain")


def dropped_without_domain(df: DataFrame, url_col: str = "url") -> DataFrame:
    """T6 report: number of rows removed for lack of a domain."""
    return with_domain(df, url_col).agg(F.sum(F.col("domain").isNull().cast("int")).cast("bigint").alias("n_dropped"))


def split_report(split_df: DataFrame, key: str = "domain") -> DataFrame:
    """Rows and distinct keys per side."""
    return split_df.groupBy("split").agg(F.count("*").cast("bigint").alias("n_rows"),
                                         F.countDistinct(key).cast("bigint").alias("n_keys"))


def split_overlap(split_df: DataFrame, key: str = "domain") -> DataFrame:
    """Keys found on both sides (must be empty)."""
    train = split_df.where(F.col("split") == "train").select(key)
    test = split_df.where(F.col("split") == "test").select(key)
    return train.intersect(test)


def stratified_split(df: DataFrame, key: str, label: str = "label", fraction: float = lx.TEST_FRACTION,
                     seed: int = lx.SPLIT_SEED) -> DataFrame:
    """Exactly round(fraction * n_c) rows of each class go to test: the
    rows with the smallest (hash(key), key).  ``key`` should identify a row."""
    d = df.withColumn("__h", seeded_hash(F.col(key), seed))
    cut = lowest_k_cutoff(d.select(label, "__h", key), "__h", key,
                          lambda n: F.round(n * F.lit(fraction)), strata=[label])
    # one row a class: broadcast, since a shuffle by label would put all rows of a class into one task
    out = d.join(F.broadcast(cut), [label], "left")
    is_test = (F.col("__h") < F.col("__h_cut")) | ((F.col("__h") == F.col("__h_cut")) & (F.col(key) <= F.col("__t_cut")))
    out = out.withColumn("split", F.when(F.coalesce(is_test, F.lit(False)), F.lit("test")).otherwise(F.lit("train")))
    return out.drop("__h", "__h_cut", "__t_cut")


def class_weights(df: DataFrame, label: str = "label", out: str = "weight") -> DataFrame:
    """Balanced weights n / (k * n_c), joined to every row (the class table
    has one row per class and is broadcast: a shuffle by label would put all rows
    of a class into one task)."""
    counts = df.groupBy(label).agg(F.count("*").alias("__nc"))
    stats = counts.withColumn("__n", F.sum("__nc").over(Window.partitionBy(F.lit(1)))) \
                  .withColumn("__k", F.count("*").over(Window.partitionBy(F.lit(1))))
    stats = stats.select(label, (F.col("__n") / (F.col("__k") * F.col("__nc"))).alias(out))
    return df.join(F.broadcast(stats), [label], "left")


def class_weight_table(df: DataFrame, label: str = "label") -> DataFrame:
    counts = df.groupBy(label).agg(F.count("*").alias("n"))
    w = Window.partitionBy(F.lit(1))
    return counts.select(label, F.col("n").cast("bigint").alias("n"),
                         (F.sum("n").over(w) / (F.count("*").over(w) * F.col("n"))).alias("weight"))
