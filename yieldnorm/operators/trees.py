"""M2-M4, M6 as relations: the trees of a fitted boosted-tree model as a table, and scoring by descent over it.

The table (tree, node, feature, threshold, left, right, value, weight) is read from the node files of a stored
pipeline; a leaf has no feature. ``score`` packs it into one value (a model has trees x 2^(depth + 1) nodes at most) and
descends every tree with built-in higher-order functions: no shuffle, no Python, one pass over the rows. A model over
``MODEL_BYTES`` is joined instead, level by level (``score_by_join``). Summing only the first trees gives the
prediction of the model with fewer iterations, so one fit serves every ``maxIter`` of a grid.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.sizing import list_names
from .model import FEATURES, LABEL

#: Bytes of a model that is carried as one value, and of a node in it (about).
MODEL_BYTES, NODE_BYTES = 32 << 20, 64
_NODES = ("treeID int, nodeData struct<id: int, prediction: double, leftChild: int, rightChild: int, "
          "split: struct<featureIndex: int, leftCategoriesOrThreshold: array<double>, numCategories: int>>")


def nodes(spark: SparkSession, stored: str) -> DataFrame:
    """The trees of the last stage of the pipeline stored at ``stored``. Features must be continuous."""
    stages = f"{stored.rstrip('/')}/stages"
    last = max(list_names(spark, stages), key=lambda n: int(n.split("_")[0]))
    data = spark.read.schema(_NODES).parquet(f"{stages}/{last}/data")
    weights = spark.read.schema("_1 int, _2 string, _3 double").parquet(f"{stages}/{last}/treesMetadata")
    split = F.col("nodeData.split")
    leaf = F.col("nodeData.leftChild") < 0
    out = data.select(
        F.col("treeID").alias("tree"), F.col("nodeData.id").alias("node"),
        F.when(~leaf, split["featureIndex"]).alias("feature"), F.when(~leaf, split["leftCategoriesOrThreshold"][0]).alias("threshold"),
        F.when(~leaf, F.col("nodeData.leftChild")).alias("left"), F.when(~leaf, F.col("nodeData.rightChild")).alias("right"),
        F.col("nodeData.prediction").alias("value"))
    return out.join(weights.select(F.col("_1").alias("tree"), F.col("_3").alias("weight")), "tree")


def packed(trees: DataFrame) -> DataFrame:
    """The whole model as one row: an array of trees, each with its weight and its nodes in order."""
    node = F.struct("node", "feature", "threshold", "left", "right", "value")
    each = trees.groupBy("tree").agg(F.first("weight").alias("weight"), F.array_sort(F.collect_list(node)).alias("nodes"))
    return each.agg(F.array_sort(F.collect_list(F.struct("tree", "weight", "nodes"))).alias("trees"))


def _leaf(nodes_: Column, x: Column, depth: int) -> Column:
    """The leaf that the feature array ``x`` reaches; null and NaN go right, as in the fitted model."""
    def step(at: Column, _: Column) -> Column:
        n = nodes_[at]
        left = F.coalesce(x[n["feature"]] <= n["threshold"], F.lit(False))
        return F.when(n["feature"].isNull(), at).when(left, n["left"]).otherwise(n["right"])

    return F.aggregate(F.sequence(F.lit(1), F.lit(max(1, depth))), F.lit(0), step)


def depth_of(trees: DataFrame) -> int:
    """Levels below the root that a tree may have: no path is longer than half its nodes, and Spark ML allows 30."""
    most = trees.groupBy("tree").agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0] or 1
    return min(30, int(most) // 2)


def score(df: DataFrame, trees: DataFrame, features: Sequence[str] = FEATURES, depth: int | None = None) -> DataFrame:
    """``df`` with ``parts``, the weighted leaf value of each tree, and ``leaves``, the leaf's node in each tree."""
    if trees.count() * NODE_BYTES > MODEL_BYTES:
        return score_by_join(df, trees, features, depth)
    depth = depth_of(trees) if depth is None else depth
    x = F.array(*[F.col(f).cast("double") for f in features])
    model = packed(trees).select(F.struct("trees").alias("m")).scalar()
    got = df.withColumn("__model", model).withColumn("__x", x)
    got = got.withColumn("leaves", F.transform(F.col("__model.trees"), lambda t: _leaf(t["nodes"], F.col("__x"), depth)))
    parts = F.zip_with(F.col("__model.trees"), F.col("leaves"), lambda t, n: t["weight"] * t["nodes"][n]["value"])
    return got.withColumn("parts", parts).drop("__model", "__x")


def score_by_join(df: DataFrame, trees: DataFrame, features: Sequence[str] = FEATURES, depth: int | None = None) -> DataFrame:
    """As ``score``, by one equi-join a level; a row is repeated for each tree until its values are gathered."""
    depth = depth_of(trees) if depth is None else depth
    rows = df.withColumn("__row", F.monotonically_increasing_id())
    x = F.array(*[F.col(f).cast("double") for f in features])
    n = (trees.agg(F.max("tree")).first()[0] or 0) + 1
    at = rows.select("__row", x.alias("x"), F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("tree"), F.lit(0).alias("node"))
    inner = trees.filter(F.col("feature").isNotNull()).select("tree", "node", "feature", "threshold", "left", "right")
    for _ in range(max(1, depth)):
        at = at.join(inner, ["tree", "node"], "left")
        left = F.coalesce(F.col("x")[F.col("feature")] <= F.col("threshold"), F.lit(False))
        to = F.when(F.col("feature").isNull(), F.col("node")).when(left, F.col("left")).otherwise(F.col("right"))
        at = at.select("__row", "x", "tree", to.alias("node"))
    hit = at.join(trees.select("tree", "node", (F.col("weight") * F.col("value")).alias("part")), ["tree", "node"])
    each = hit.groupBy("__row").agg(F.array_sort(F.collect_list(F.struct("tree", "node", "part"))).alias("h"))
    got = rows.join(each, "__row", "left").drop("__row")
    return got.withColumn("leaves", F.col("h.node")).withColumn("parts", F.col("h.part")).drop("h")


def first_trees(parts: Column, n: int | None = None) -> Column:
    """The prediction of the model's first ``n`` trees (all of them without ``n``)."""
    some = parts if n is None else F.slice(parts, 1, n)
    return F.aggregate(some, F.lit(0.0), lambda a, p: a + p)


def rmse_by_iterations(scored: DataFrame, iterations: Sequence[int], label: str = LABEL) -> DataFrame:
    """maxIter, n, rmse for every number of iterations, in one pass over the scored rows."""
    points = F.array(*[F.struct(F.lit(int(k)).alias("maxIter"), first_trees(F.col("parts"), int(k)).alias("p")) for k in iterations])
    each = scored.select(F.col(label).alias("y"), F.explode(points).alias("i"))
    err = F.col("y") - F.col("i.p")
    return each.groupBy(F.col("i.maxIter").alias("maxIter")).agg(F.count(F.lit(1)).alias("n"), F.sqrt(F.avg(err * err)).alias("rmse"))


def leaf_means(scored: DataFrame, trees: DataFrame, tree: int = 0, label: str = LABEL) -> DataFrame:
    """node, n, mean (of the labels that reach it), value for the leaves of one tree. In the first tree of a boosted model
    fitted to squared error both are equal."""
    reached = scored.groupBy(F.col("leaves")[tree].alias("node")).agg(F.count(F.lit(1)).alias("n"), F.avg(label).alias("mean"))
    leaves = trees.filter((F.col("tree") == tree) & F.col("feature").isNull()).select("node", "value")
    return leaves.join(reached, "node", "full")
