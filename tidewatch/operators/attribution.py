"""Per-row, per-class contributions that add up to the model's raw score.

For trees, the change in node value at every split on a row's path is credited to
the split's feature, so base + contributions equals the score exactly. Those credits
depend on the leaf alone. A leaf table (tree, leaf) -> credits is built once by Spark
from the saved model, paths by pointer doubling in about log2(depth) joins. Rows get their
leaf ids from the model's own transform, meet the table in a join and are summed.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.classification import GBTClassificationModel, OneVsRestModel, RandomForestClassificationModel
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions.names import c
from ..session import bounded, shared_dir, stored

#: Largest leaf table that is sent to every executor; a larger one is joined by (tree, leaf).
BROADCAST_BYTES = 128 << 20


def _members(model) -> list:
    """The ensembles of a model: one of a forest or booster, one per class of one-vs-rest."""
    if isinstance(model, OneVsRestModel):
        return list(model.models)
    if isinstance(model, (RandomForestClassificationModel, GBTClassificationModel)):
        return [model]
    raise TypeError(f"no tree contributions for {type(model).__name__}")


def node_table(spark: SparkSession, model, classes: int) -> DataFrame:
    """(tree, id, left, right, feature, value) of every node; value has one entry per class.

    Trees of all members are numbered one after the other, and ids are in pre-order. A forest's value is the
    node's class shares over the number of trees; a booster's is its weighted prediction, in the entry of its class.
    """
    tables, first = [], 0
    for k, member in enumerate(_members(model)):
        path = shared_dir(spark, "trees")
        member.write().save(path)
        node = F.col("nodeData")
        nodes = spark.read.parquet(f"{path}/data")
        if isinstance(member, RandomForestClassificationModel):
            total = F.aggregate(node["impurityStats"], F.lit(0.0), lambda a, x: a + x)
            shares = F.transform(node["impurityStats"], lambda x: F.when(total > 0, x / total / member.getNumTrees).otherwise(0.0))
            value = F.concat(shares, F.array_repeat(F.lit(0.0), classes - member.numClasses))
        else:
            weight = F.get(F.array(*[F.lit(float(w)) for w in member.treeWeights]), F.col("treeID"))
            value = F.concat(F.array_repeat(F.lit(0.0), k), F.array(node["prediction"] * weight), F.array_repeat(F.lit(0.0), classes - k - 1))
        tables.append(nodes.select(
            (F.col("treeID") + first).alias("tree"), node["id"].alias("id"), node["leftChild"].alias("left"), node["rightChild"].alias("right"),
            node["split"]["featureIndex"].alias("feature"), value.alias("value")))
        first += member.getNumTrees
    out = tables[0]
    for t in tables[1:]:
        out = out.union(t)
    return stored(out, "nodes")


def leaf_table(nodes: DataFrame, features: int) -> DataFrame:
    """(tree, leaf, steps): per leaf the credits (f, d) of its path, d with one entry per class, a feature once.

    ``leaf`` counts a tree's leaves from left to right, as MLlib's leaf column does. Leaves of tree 0
    list all features, so that every row has a sum for each. Every round doubles the part of
    the path a node knows; the rounds end when all know the root.
    """
    minus = lambda a, b: F.zip_with(a, b, lambda x, y: x - y)
    inner = nodes.where("left >= 0")
    edges = inner.select("tree", "feature", F.col("value").alias("_above"), F.col("id").alias("up"), F.explode(F.array("left", "right")).alias("id"))
    steps = F.array(F.struct(F.col("feature").alias("f"), minus(F.col("value"), F.col("_above")).alias("d")))
    known = nodes.drop("feature").join(edges, ["tree", "id"], "left").select(
        "tree", "id", (F.col("left") < 0).alias("is_leaf"), F.coalesce("up", F.lit(-1)).alias("up"),
        F.when(F.col("up").isNotNull(), steps).otherwise(F.array().cast("array<struct<f:int,d:array<double>>>")).alias("steps"))
    known = stored(known, "paths")
    while known.where("up >= 0").limit(1).count():
        above = known.select("tree", F.col("id").alias("up"), F.col("up").alias("_up"), F.col("steps").alias("_steps"))
        known = stored(known.join(above, ["tree", "up"], "left").select(
            "tree", "id", "is_leaf", F.coalesce("_up", F.lit(-1)).alias("up"),
            F.when(F.col("_steps").isNull(), F.col("steps")).otherwise(F.concat("steps", "_steps")).alias("steps")), "paths")
    order = W.partitionBy("tree").orderBy("id")
    leaves = known.where("is_leaf").withColumn("leaf", F.row_number().over(order) - 1)
    each = leaves.select("tree", "leaf", F.inline_outer("steps"))
    zero = F.array_repeat(F.lit(0.0), F.size("value"))
    width = nodes.where("tree = 0 and id = 0").select(zero.alias("d"))
    every = leaves.where("tree = 0").select("tree", "leaf", F.explode(F.sequence(F.lit(0), F.lit(features - 1))).alias("f")).crossJoin(F.broadcast(width))
    each = each.where("f is not null").union(every.select("tree", "leaf", "f", "d"))
    # a feature that splits a path more than once is one step
    merged = each.groupBy("tree", "leaf", "f").agg(Summarizer.sum(array_to_vector("d")).alias("d"))
    return merged.groupBy("tree", "leaf").agg(F.collect_list(F.struct("f", vector_to_array("d").alias("d"))).alias("steps"))


def with_leaves(df: DataFrame, model, features: Sequence[str], out: str = "_leaves") -> DataFrame:
    """Add the leaf of every tree of ``model`` that each row falls into."""
    rows = df.withColumn("_features", array_to_vector(F.array(*[c(f).cast("double") for f in features])))
    parts = []
    for k, member in enumerate(_members(model)):
        m = member.copy()
        m.setFeaturesCol("_features").setRawPredictionCol("").setProbabilityCol("").setPredictionCol("").setLeafCol(f"_leaf{k}")
        rows = m.transform(rows)
        parts.append(vector_to_array(f"_leaf{k}"))
    leaves = F.concat(*parts) if len(parts) > 1 else parts[0]
    return rows.withColumn(out, leaves.cast("array<int>")).drop("_features", *[f"_leaf{k}" for k in range(len(parts))])


def base_scores(nodes: DataFrame) -> list[float]:
    """Raw score of the empty path per class: the sum of the trees' roots."""
    found = nodes.where("id = 0").select(Summarizer.sum(array_to_vector("value")).alias("v")).first()
    return [float(x) for x in found["v"]]


def tree_contributions(
    scored: DataFrame, model, features: Sequence[str], row: str, classes: int, predicted: str = "predicted_id",
    broadcast_bytes: int = BROADCAST_BYTES,
) -> DataFrame:
    """Contributions per row; ``row`` names it.

    ``contribution`` and ``base`` belong to the predicted class and add up to its raw
    score; ``all_abs`` sums the absolute contributions over the classes. Rows are dealt by
    ``row`` once, as leaf ids. Where the leaf table goes by broadcast, nothing else is shuffled.
    """
    nodes = node_table(scored.sparkSession, model, classes)
    base = F.array(*[F.lit(x) for x in base_scores(nodes)])
    table = stored(leaf_table(nodes, len(features)), "leaves")
    steps = table.agg(F.sum(F.size("steps"))).first()[0]
    table = F.broadcast(table) if steps * (48 + 8 * classes) <= broadcast_bytes else table

    rows = with_leaves(scored, model, features).select(F.col(row), F.col(predicted).cast("int").alias("_k"), "_leaves")
    met = rows.repartition(row).select(row, "_k", F.posexplode("_leaves").alias("tree", "leaf")).join(table, ["tree", "leaf"])
    met = met.select(row, "_k", F.inline("steps"))
    sums = met.groupBy(row, "_k", "f").agg(*[F.sum(F.col("d")[i]).alias(f"_s{i}") for i in range(classes)])
    own = F.get(F.array(*[f"_s{i}" for i in range(classes)]), F.col("_k"))
    size = sum((F.abs(f"_s{i}") for i in range(1, classes)), F.abs("_s0"))
    cells = sums.groupBy(row, "_k").agg(F.array_sort(F.collect_list(F.struct("f", own.alias("own"), size.alias("size")))).alias("_cells"))
    return cells.select(row, F.get(base, F.col("_k")).alias("base"), F.col("_cells.own").alias("contribution"), F.col("_cells.size").alias("all_abs"))


def global_importance(contributions: DataFrame, features: Sequence[str], classes: int) -> DataFrame:
    """Mean absolute contribution per feature over rows and classes, in one pass over row arrays."""
    means = contributions.agg(Summarizer.mean(array_to_vector("all_abs")).alias("m")).where("m is not null")
    names = F.array(*[F.lit(f) for f in features])
    cells = means.select(F.posexplode(vector_to_array("m")).alias("_i", "_m"))
    return cells.select(F.get(names, F.col("_i")).alias("feature"), (F.col("_m") / F.lit(float(classes))).alias("mean_abs"))


def linear_rows(values: Column, weights: Sequence[Sequence[float]], means: Sequence[float]) -> Column:
    """``w * (x - mean)`` of a linear scorer as one array per class; row-local. ``weights`` is class by feature."""
    less = F.zip_with(values, F.array(*[F.lit(float(m)) for m in means]), lambda x, m: x - m)
    return F.array(*[F.zip_with(less, F.array(*[F.lit(float(w)) for w in row]), lambda x, w: x * w) for row in weights])


def linear_contributions(
    long: DataFrame, weights: DataFrame, means: DataFrame, row: str, features: int, classes: int
) -> DataFrame:
    """``w * (x - mean)`` per (row, class, feature) for a linear scorer.

    ``long`` is (row, feature, value); weights (class, feature, w) and means
    (feature, mean) are model tables of ``classes * features`` rows.
    """
    model = weights.join(bounded(means, features), "feature")
    return long.join(bounded(model, features * classes), "feature").select(
        row, "label_class", "feature", (F.col("w") * (F.col("value") - F.col("mean"))).alias("contribution")
    )
