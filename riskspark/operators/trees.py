"""Exact attributions of tree ensembles (A-10), path by path.

A leaf's path is a product of conditions, one a distinct feature: a value range and the share of the
training rows that go that way. With S the known features, the leaf counts with the product of its
conditions (0 or 1) over S and of its shares over the rest. The Shapley value of one of its m features is then

    value * (met - share) * integral over t in 0..1 of the product over the others of (met * t + share * (1 - t))

a polynomial of degree m - 1, which Gauss-Legendre nodes integrate exactly: no sampling, no background rows.

The ensemble becomes a table with a row for each leaf, of the model's size (trees times leaves). It goes to every task as arrays, where Arrow
batches of rows meet it in numpy: nothing is shuffled.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence

import numpy as np
from pyspark.ml import Model
from pyspark.ml.classification import GBTClassificationModel, RandomForestClassificationModel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, StructField, StructType

from ..session import checkpoint_path, materialized

INFINITY = float("inf")


def ensemble_nodes(model: Model) -> DataFrame:
    """(tree, id, left, right, feature, threshold, cover, value) of a random forest (value: the leaf's share in the probability of
    class 1) or of boosted trees (in the log-odds). Leaves have a NULL feature. The model is written to the
    shared folder, where MLlib stores its nodes as a table."""
    path = checkpoint_path(_session(model), f"model-{uuid.uuid4().hex}")
    model.write().save(path)
    spark = _session(model)
    n = F.col("nodeData")
    stats, leaf = n["impurityStats"], n["leftChild"] < 0
    if isinstance(model, RandomForestClassificationModel):
        cover = F.aggregate(stats, F.lit(0.0), lambda a, x: a + x)
        value = stats[1] / cover / F.lit(float(model.getNumTrees))
    elif isinstance(model, GBTClassificationModel):
        cover = stats[0]
        weight = F.get(F.array(*[F.lit(2.0 * float(w)) for w in model.treeWeights]), F.col("treeID"))  # log-odds: twice the margin
        value = weight * n["prediction"]
    else:
        raise ValueError(f"no trees in a {type(model).__name__}")
    split = n["split"]
    kind = F.when(split["numCategories"] >= 0, F.raise_error(F.lit("categorical splits are not supported"))).otherwise(split["featureIndex"])
    return spark.read.parquet(f"{path}/data").select(
        F.col("treeID").cast("int").alias("tree"), n["id"].cast("int").alias("id"), n["leftChild"].cast("int").alias("left"), n["rightChild"].cast("int").alias("right"),
        F.when(leaf, F.lit(None)).otherwise(kind).cast("int").alias("feature"), F.when(~leaf, split["leftCategoriesOrThreshold"][0]).alias("threshold"),
        cover.alias("cover"), F.when(leaf, value).alias("value"),
    )


def _session(model: Model):
    from pyspark.sql import SparkSession

    return SparkSession.active()


def leaf_paths(nodes: DataFrame) -> DataFrame:
    """(tree, leaf, value, steps): for every leaf, its distinct features as (feature, low, high, share), a row meeting the condition when low < x <= high."""
    nodes = materialized(nodes, "tree-nodes")
    inner, child = nodes.where(F.col("feature").isNotNull()), nodes.select("tree", F.col("id").alias("child"), F.col("cover").alias("child_cover"))

    def side(to: str, low: Column, high: Column) -> DataFrame:
        return inner.select("tree", F.col(to).alias("child"), F.col("id").alias("parent"), F.col("feature"), low.alias("low"), high.alias("high"), "cover")

    edges = side("left", F.lit(-INFINITY), F.col("threshold")).unionByName(side("right", F.col("threshold"), F.lit(INFINITY)))
    edges = materialized(
        edges.join(child, ["tree", "child"]).select("tree", "child", "parent", F.struct("feature", "low", "high", (F.col("child_cover") / F.col("cover")).alias("share")).alias("step")), "tree-edges"
    )
    step_type = "array<struct<feature:int,low:double,high:double,share:double>>"
    walk = nodes.where(F.col("feature").isNull()).select("tree", F.col("id").alias("leaf"), "value", F.col("id").alias("child"), F.array().cast(step_type).alias("steps"))
    while True:  # up the trees, a level a join; four levels a round
        for _ in range(4):
            up = walk.join(edges, ["tree", "child"], "left")
            walk = up.select(
                "tree", "leaf", "value", F.coalesce("parent", F.lit(-1)).alias("child"),
                F.when(F.col("parent").isNull(), F.col("steps")).otherwise(F.concat("steps", F.array("step"))).cast(step_type).alias("steps"),
            )
        walk = materialized(walk, "tree-walk")
        if walk.where(F.col("child") >= 0).isEmpty():
            break
    each = walk.select("tree", "leaf", F.explode("steps").alias("s")).groupBy("tree", "leaf", F.col("s.feature").alias("feature"))
    merged = each.agg(F.max("s.low").alias("low"), F.min("s.high").alias("high"), F.product("s.share").alias("share"))
    steps = merged.groupBy("tree", "leaf").agg(F.array_sort(F.collect_list(F.struct("feature", "low", "high", "share"))).alias("steps"))
    known = walk.select("tree", "leaf", "value").join(steps, ["tree", "leaf"], "left")
    return materialized(known.withColumn("steps", F.coalesce("steps", F.array().cast(step_type))), "tree-paths")


def base_value(paths: DataFrame) -> DataFrame:
    """One row: the ensemble's expected value, every feature unknown (``base``)."""
    share = F.aggregate("steps", F.lit(1.0), lambda a, s: a * s["share"])
    return paths.agg(F.sum(F.col("value") * share).alias("base"))


CELLS = 1 << 18  # rows times leaves that a task works on at once


def _path_values(x: np.ndarray, leaves: dict[str, np.ndarray], nodes: list[tuple[float, float]], k: int) -> np.ndarray:
    """Attributions (rows, k) of rows ``x`` over paths of up to m conditions. A place without a condition has share and met 1 and adds nothing."""
    feature, low, high, share, value = (leaves[n] for n in ("feature", "low", "high", "share", "value"))
    m, phi = feature.shape[1], np.zeros((len(x), k))
    met = []
    for s in range(m):
        v = x[:, feature[:, s]]  # NaN is a missing value: it meets no bound
        met.append((((v > low[:, s]) | (low[:, s] == -INFINITY)) & ((v <= high[:, s]) | (high[:, s] == INFINITY))).astype("float64"))
    rest = [np.zeros_like(met[0]) for _ in range(m)]
    for at, weight in nodes:
        factors = [met[s] * at + share[:, s] * (1.0 - at) for s in range(m)]
        after = [np.full_like(met[0], weight)]  # products of the factors from the last on
        for f in reversed(factors[1:]):
            after.append(after[-1] * f)
        before = 1.0
        for s in range(m):
            rest[s] += before * after[m - 1 - s]
            before = before * factors[s]
    for s in range(m):
        phi += (value * (met[s] - share[:, s]) * rest[s]) @ (feature[:, s][:, None] == np.arange(k))
    return phi


def tree_attributions(paths: DataFrame, df: DataFrame, features: Sequence[str], values: Column, key: str = "id") -> DataFrame:
    """A-10 (tree-exact): (key, feature, attribution) for every row and each of ``features``, with 0 for those the trees don't use. ``values`` is the array of
    a row's feature values in the model's order; NaN goes right, as in the model. The paths (of the model's size) go to the tasks; a row's values come
    from its own task, so that rows are neither multiplied by the leaves nor shuffled."""
    import pyarrow as pa

    k, found = len(features), paths.select("value", "steps").collect()  # a row a leaf
    m = max((len(r["steps"]) for r in found), default=0)
    leaves = {"feature": np.zeros((len(found), m), "int64"), "low": np.full((len(found), m), -INFINITY), "high": np.full((len(found), m), INFINITY), "share": np.ones((len(found), m))}
    leaves["value"] = np.array([r["value"] for r in found], "float64")
    for i, r in enumerate(found):
        for s, step in enumerate(r["steps"]):
            for n in ("feature", "low", "high", "share"):
                leaves[n][i, s] = step[n]
    t, w = np.polynomial.legendre.leggauss(max((m + 1) // 2, 1))
    nodes = [((float(a) + 1) / 2, float(b) / 2) for a, b in zip(t, w)]
    size = max(1, CELLS // max(len(found), 1))

    def run(batches):
        for b in batches:
            lists, n = b.column(1), b.num_rows
            lengths = np.asarray(lists.value_lengths().fill_null(0))
            flat = lists.flatten().to_numpy(zero_copy_only=False).astype("float64")
            x = np.full((n, k), np.nan)
            if (lengths == k).all():
                x = flat.reshape(n, k)
            else:  # rows without an array, or with another number of values
                for i, (end, length) in enumerate(zip(np.cumsum(lengths), lengths)):
                    own = flat[end - length : end][:k]
                    x[i, : len(own)] = own
            phi = np.zeros((n, k))
            if m:
                for at in range(0, n, size):
                    phi[at : at + size] = _path_values(x[at : at + size], leaves, nodes, k)
            offsets = pa.array(np.arange(0, n * k + 1, k, dtype="int32"))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.ListArray.from_arrays(offsets, pa.array(phi.ravel()))], names=["_key", "_phi"])

    # NaN is above every cut
    known = F.transform(values.cast("array<double>"), lambda v: F.when(F.isnan(v), F.lit(INFINITY)).otherwise(v))
    x = df.select(F.col(key).alias("_key"), known.alias("_x"))
    phi = x.mapInArrow(run, StructType([x.schema["_key"], StructField("_phi", ArrayType(DoubleType()))]))
    names = F.array(*[F.lit(f) for f in features])
    return phi.select(F.col("_key").alias(key), F.posexplode("_phi").alias("_f", "attribution")).select(key, F.get(names, F.col("_f")).alias("feature"), "attribution")
