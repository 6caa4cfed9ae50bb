"""Fitted tree ensembles as tables.

A saved model is three Parquet tables: ``nodes`` (tree, node, weight, feature,
threshold, left, right, value, gain, mass), ``scaler`` (position, feature, mean,
std) and ``model`` (kind, trees, depth, features).  They are derived by Spark
from what the ML writer saves, and everything else here reads them alone: class
probabilities by walking the trees, and feature importances.

``probabilities`` follows all trees of all rows level by level: a state (row,
tree, node) is joined with its node on (tree, node), and goes left if the scaled
feature is not above the threshold.  A leaf leads to itself.  The node table is
as large as the ensemble, not the data, so Spark broadcasts it if it is small
enough and otherwise shuffles states; the rows of a state are its key and the
scaled features.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml import PipelineModel
from pyspark.ml.classification import GBTClassificationModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import scratch_path
from . import models as md


@dataclass(frozen=True)
class TreeTables:
    nodes: DataFrame
    scaler: DataFrame
    model: DataFrame


def write(model: PipelineModel, features, path: str) -> None:
    """Writes the tables of a fitted ``tabular_pipeline`` (with scaler) below ``path``."""
    spark = SparkSession.getActiveSession()
    scaler, trees = model.stages[-2], model.stages[-1]
    boosted = isinstance(trees, GBTClassificationModel)
    saved = scratch_path(spark, "ml-model")
    md.save(model, saved)
    stage = f"{saved}/stages/*_{trees.uid}"
    names = F.array(*[F.lit(f) for f in features])
    n = F.col("nodeData")
    leaf = n["leftChild"] < 0
    stats = n["impurityStats"]
    mass = stats[0] if boosted else F.aggregate(stats, F.lit(0.0), lambda a, x: a + x)
    nodes = spark.read.parquet(f"{stage}/data").select(
        F.col("treeID").alias("tree"), n["id"].alias("node"), F.when(~leaf, F.get(names, n["split"]["featureIndex"])).alias("feature"),
        F.when(~leaf, n["split"]["featureIndex"]).alias("position"),
        F.when(~leaf, F.get(n["split"]["leftCategoriesOrThreshold"], 0)).alias("threshold"),
        F.when(leaf, n["id"]).otherwise(n["leftChild"]).alias("left"), F.when(leaf, n["id"]).otherwise(n["rightChild"]).alias("right"),
        (n["prediction"] if boosted else stats[1] / mass).alias("value"), F.when(~leaf, n["gain"]).alias("gain"), mass.alias("mass"))
    weights = spark.read.parquet(f"{stage}/treesMetadata").select(F.col("_1").alias("tree"), F.col("_3").alias("weight"))
    nodes.join(weights, "tree").write.parquet(f"{path}/nodes")
    rows = [(i, f, float(m), float(s)) for i, (f, m, s) in enumerate(zip(features, scaler.mean, scaler.std, strict=True))]
    spark.createDataFrame(rows, "position int, feature string, mean double, std double").write.parquet(f"{path}/scaler")
    depth = max(t.depth for t in trees.trees)
    spark.createDataFrame([("boosted" if boosted else "forest", len(trees.trees), depth, len(rows))],
                          "kind string, n_trees int, depth int, n_features int").write.parquet(f"{path}/model")


def read(spark: SparkSession, path: str) -> TreeTables:
    return TreeTables(*[spark.read.parquet(f"{path}/{t}") for t in ("nodes", "scaler", "model")])


def probabilities(tables: TreeTables, df: DataFrame, key: str, out: str = "p") -> DataFrame:
    """key, ``out``: class-1 probability of every row of ``df`` (the model's
    features and a ``key`` that identifies rows)."""
    info = tables.model.first()
    scaler = tables.scaler.orderBy("position").collect()          # one row a feature
    scaled = F.array(*[(F.col(r["feature"]) - F.lit(r["mean"])) * F.lit(1.0 / r["std"] if r["std"] else 0.0) for r in scaler])
    at = df.select(key, scaled.alias("x")).select(key, "x", F.explode(F.sequence(F.lit(0), F.lit(info["n_trees"] - 1))).alias("tree"))
    at = at.withColumn("node", F.lit(0))
    steps = tables.nodes.select("tree", "node", "position", "threshold", "left", "right")
    for _ in range(info["depth"]):
        at = at.join(steps, ["tree", "node"]).select(
            key, "x", "tree", F.when(F.get("x", "position") > F.col("threshold"), F.col("right")).otherwise(F.col("left")).alias("node"))
    leaves = at.select(key, "tree", "node").join(tables.nodes.select("tree", "node", "value", "weight"), ["tree", "node"])
    total = leaves.groupBy(key).agg(F.sum(F.col("value") * F.col("weight")).alias("sum"), F.sum("weight").alias("weights"))
    p = 1 / (1 + F.exp(-2 * F.col("sum"))) if info["kind"] == "boosted" else F.col("sum") / F.col("weights")
    return total.select(key, p.alias(out))


def importances(tables: TreeTables) -> DataFrame:
    """T16 from the nodes: feature, importance (share of the gain, weighted by
    the rows of the node; forests count each tree's shares)."""
    boosted = tables.model.first()["kind"] == "boosted"
    gain = tables.nodes.filter("feature is not null").groupBy("tree", "feature").agg(F.sum(F.col("gain") * F.col("mass")).alias("g"))
    if not boosted:
        per = gain.groupBy("tree").agg(F.sum("g").alias("all"))
        gain = gain.join(per, "tree").withColumn("g", F.when(F.col("all") > 0, F.col("g") / F.col("all")).otherwise(0.0))
    by = gain.groupBy("feature").agg(F.sum("g").alias("g"))
    total = by.agg(F.sum("g")).first()[0] or 1.0
    return tables.scaler.select("feature").join(by, "feature", "left").select(
        "feature", (F.coalesce("g", F.lit(0.0)) / F.lit(total)).alias("importance"))


def info(tables: TreeTables) -> DataFrame:
    """T17 from the tables: kind, trees and their depth as walked, features used
    at least once, internal nodes and leaves."""
    n = tables.nodes
    per = n.groupBy("tree").agg(F.count("*").alias("nodes"))
    counts = n.agg(F.countDistinct("tree").alias("n_trees"), F.sum((F.col("left") == F.col("node")).cast("long")).alias("n_leaves"),
                   F.sum((F.col("left") != F.col("node")).cast("long")).alias("n_splits"), F.countDistinct("feature").alias("n_features_used"))
    return tables.model.select("kind", "depth", "n_features").join(counts).join(per.agg(F.max("nodes").alias("largest_tree")))
