"""Connected components of an edge table, as Spark joins.

Alternates large-star and small-star steps: every node hands its neighbours to
the smallest id it knows.  Each step keeps at most as many edges as before, a
hub's neighbours are only aggregated by ``min`` (partial sums before the
shuffle) and joined on the hub's id (a join that adaptive execution may split),
never gathered.  Every round is written as Parquet, so lineage stays short and
nothing of the graph reaches the driver but a count and a checksum.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize


def _mins(e: DataFrame) -> DataFrame:
    return e.groupBy("u").agg(F.min("v").alias("m0")).select("u", F.least("u", "m0").alias("m"))


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    return (both.join(_mins(both), "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
            .filter("u <> v").distinct())


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    mins = _mins(down)
    return (down.join(mins, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v")
            .union(mins.select("u", F.col("m").alias("v"))).distinct())


def connected_components(edges: DataFrame, src: str = "u", dst: str = "v") -> DataFrame:
    """node, component (smallest id reachable) of every node that has an edge
    to another node; the ids are longs.  An empty edge table gives no rows."""
    e = edges.select(F.greatest(src, dst).cast("long").alias("u"), F.least(src, dst).cast("long").alias("v")).filter("u <> v").distinct()
    e = materialize(e, "edges")
    last = None
    while True:
        now = e.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        if now["n"] == 0 or tuple(now) == last:
            break
        last = tuple(now)
        e = materialize(_small_star(_large_star(e)), "edges")
    # stars: every node points at its component's smallest id
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).union(
        e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
