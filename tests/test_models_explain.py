"""Model stage and explanations against brute force: exact tree attributions, local surrogates, naive Bayes, folds, optimum, formulas."""

import itertools
import math
import random

import numpy as np
import pytest
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from riskspark.operators import explain as A
from riskspark.operators import models as ML
from riskspark.operators import trees as TR

NODE_SCHEMA = "tree int, id int, left int, right int, feature int, threshold double, cover double, value double"


def expected(nodes, at, x, known):
    """Expected value of a tree below a node when only the features in ``known`` are known."""
    _, _, left, right, feature, cut, cover, value = nodes[at]
    if feature is None:
        return value
    if feature in known:
        return expected(nodes, right if x[feature] > cut or math.isnan(x[feature]) else left, x, known)
    a, b = (nodes[n][6] / cover * expected(nodes, n, x, known) for n in (left, right))
    return a + b


def shapley(trees, x, k):
    """By the definition: over all subsets of the other features."""
    out = []
    for f in range(k):
        others, total = [g for g in range(k) if g != f], 0.0
        for n in range(k):
            for known in itertools.combinations(others, n):
                weight = math.factorial(n) * math.factorial(k - n - 1) / math.factorial(k)
                total += weight * sum(expected(t, 0, x, {*known, f}) - expected(t, 0, x, set(known)) for t in trees)
        out.append(total)
    return out


def random_tree(rng, number, depth, k):
    rows = []

    def grow(level, cover):
        at = len(rows)
        rows.append(None)
        if level == depth or rng.random() < 0.15 and level:
            rows[at] = (number, at, None, None, None, None, cover, rng.uniform(-1, 1))
            return at
        share = rng.uniform(0.05, 0.95)
        feature, cut = rng.randrange(k), rng.choice([-0.5, 0.0, 0.25, 0.5])
        left, right = grow(level + 1, cover * share), grow(level + 1, cover * (1 - share))
        rows[at] = (number, at, left, right, feature, cut, cover, None)
        return at

    grow(0, 100.0)
    return rows


def test_tree_attributions_equal_the_definition(spark):
    rng, k = random.Random(3), 4
    trees = [random_tree(rng, t, d, k) for t, d in enumerate((0, 1, 3, 6, 6))]  # a lone leaf, and features met again on a path
    paths = TR.leaf_paths(spark.createDataFrame([r for t in trees for r in t], NODE_SCHEMA))
    rows = [(i, [rng.choice([-1.0, -0.5, 0.0, 0.1, 0.25, 0.5, 0.9]) for _ in range(k)]) for i in range(25)] + [(90, [math.nan, 0.0, math.nan, 0.5]), (91, [0.25] * k), (92, [math.inf] * k), (93, [-math.inf] * k)]
    df = spark.createDataFrame(rows, "id long, x array<double>")
    names = [f"f{j}" for j in range(k)]
    got = {(r.id, r.feature): r.attribution for r in TR.tree_attributions(paths, df, names, F.col("x")).collect()}
    base = TR.base_value(paths).first().base
    assert base == pytest.approx(sum(expected(t, 0, None, ()) for t in trees))
    assert len(got) == k * df.count()
    for i, x in rows:
        want = shapley(trees, x, k)
        assert [got[i, n] for n in names] == pytest.approx(want, abs=1e-12)
        assert sum(want) + base == pytest.approx(sum(expected(t, 0, x, set(range(k))) for t in trees))
    assert TR.tree_attributions(paths, df.limit(0), names, F.col("x")).count() == 0


def model_rows(spark, n=400):
    rng = random.Random(7)
    rows = []
    for i in range(n):
        x = [rng.gauss(0, 1), rng.choice([0.0, 1.0, 2.0]), rng.uniform(0, 5)]
        rows.append((i, *x, int(rng.random() < 1 / (1 + math.exp(-(x[0] - 0.8 * x[1] + 0.3 * x[2]))))))
    df = spark.createDataFrame(rows, "id long, a double, b double, c double, label int")
    return VectorAssembler(inputCols=["a", "b", "c"], outputCol="features").transform(df).repartition(3).cache()


def test_ensembles_sum_to_their_scores(spark):
    """Forest probabilities and boosted log-odds, to the last row; a forest's values by the definition too."""
    df = model_rows(spark)
    for model, score in ((ML.forest(6, 4).fit(df), vector_to_array("probability")[1]), (ML.boosted(3, 0.3, 5).fit(df), 2 * vector_to_array("rawPrediction")[1])):
        paths = TR.leaf_paths(TR.ensemble_nodes(model))
        attr = TR.tree_attributions(paths, df, ["a", "b", "c"], vector_to_array("features"))
        total = attr.groupBy("id").agg(F.sum("attribution").alias("t"))
        off = model.transform(df).select("id", score.alias("s")).join(total, "id").crossJoin(TR.base_value(paths))
        assert off.agg(F.max(F.abs(F.col("t") + F.col("base") - F.col("s")))).first()[0] < 1e-9
    forest = ML.forest(3, 3).fit(df)
    nodes = TR.ensemble_nodes(forest)
    trees = {}
    for r in nodes.orderBy("tree", "id").collect():
        trees.setdefault(r.tree, {})[r.id] = tuple(r)
    got = {(r.id, r.feature): r.attribution for r in TR.tree_attributions(TR.leaf_paths(nodes), df.where("id < 10"), ["a", "b", "c"], vector_to_array("features")).collect()}
    for r in df.where("id < 10").collect():
        assert [got[r.id, n] for n in "abc"] == pytest.approx(shapley(list(trees.values()), [r.a, r.b, r.c], 3), abs=1e-12)


def test_cholesky_solve(spark):
    rng = np.random.default_rng(2)
    for n in (1, 2, 7, 22):
        m = rng.normal(size=(n, n + 3))
        a, b = m @ m.T, rng.normal(size=n)
        low = [float(a[i, j]) for i in range(n) for j in range(i + 1)]
        df = spark.createDataFrame([(low, b.tolist())], "m array<double>, b array<double>")
        assert df.select(A.cholesky_solve(F.col("m"), F.col("b"), n)).first()[0] == pytest.approx(np.linalg.solve(a, b).tolist())
    singular = spark.createDataFrame([([0.0, 1.0, 0.0], [1.0, 1.0])], "m array<double>, b array<double>")
    assert singular.select(A.cholesky_solve(F.col("m"), F.col("b"), 2)).first()[0] == [None, None]


def test_weighted_ridge_equals_least_squares(spark):
    """Every key's fit, with all features and with the two of the largest weights."""
    rng = np.random.default_rng(5)
    rows, k, ridge = [], 4, 0.7
    for key in ("x", "y", None):
        z, w = rng.normal(size=(60, k)), rng.uniform(0.1, 1, 60)
        y = z @ np.array([1.0, -2.0, 0.1, 0.5]) + 0.3 + rng.normal(scale=0.1, size=60)
        rows += [(key, v.tolist(), float(t), float(u)) for v, t, u in zip(z, y, w)]
    df = spark.createDataFrame(rows, "_key string, _z array<double>, _y double, _w double").repartition(5)

    def fit(key, columns):
        own = [r for r in rows if r[0] == key]
        a = np.array([[1.0] + [r[1][c] for c in columns] for r in own])
        w, y = np.array([r[3] for r in own]), np.array([r[2] for r in own])
        return np.linalg.solve(a.T @ (a * w[:, None]) + ridge * np.diag([0.0] + [1.0] * len(columns)), a.T @ (w * y))

    every = {r.key: r.coef for r in A.weighted_ridge(df, k, ridge).collect()}
    top = {r.key: r.coef for r in A.weighted_ridge(df, k, ridge, top=2).collect()}
    for key in ("x", "y", None):
        assert every[key] == pytest.approx(fit(key, range(k)).tolist())
        best = sorted(sorted(range(k), key=lambda j: -abs(every[key][j + 1]))[:2])
        want = fit(key, best)
        assert [top[key][0], *[top[key][j + 1] for j in best]] == pytest.approx(want.tolist())
        assert [top[key][j + 1] for j in range(k) if j not in best] == [None, None]


def test_local_surrogate_finds_a_linear_score(spark):
    df = spark.createDataFrame([(i, float(i % 7), float(i % 5)) for i in range(100)], "id long, p double, `q.r` double")
    score = lambda points: points.withColumn("_y", 0.25 * F.col("_v")[0] - 0.5 * F.col("_v")[1])
    stats = A.gaussian_stats(df, ["p", "q.r"])
    scale = stats.first().scale
    got = {(r.id, r.feature): r.weight for r in A.local_surrogate(score, df.where("id < 3"), stats, ["p", "q.r"], n_samples=200, ridge=1e-6).collect()}
    assert len(got) == 9
    for i in range(3):
        assert [got[i, "p"], got[i, "q.r"]] == pytest.approx([0.25 * scale[0], -0.5 * scale[1]], rel=1e-4)
    buckets = A.quartile_stats(df, ["p", "q.r"]).first().buckets
    assert [b.cuts for b in buckets] == [[1.0, 3.0, 5.0], [1.0, 2.0, 3.0]] and buckets[1].share == pytest.approx([0.4, 0.6, 0.8, 1.0])
    assert buckets[0].least == [0.0, 2.0, 4.0, 6.0] and buckets[0].most == [1.0, 3.0, 5.0, 6.0]
    one = A.local_surrogate(score, df.where("id < 3"), A.quartile_stats(df, ["p", "q.r"]), ["p", "q.r"], n_samples=100, top=1).collect()
    assert len(one) == 6 and all(sum(r.id == i and r.feature != "intercept" for r in one) == 1 for i in range(3))


def test_naive_bayes_equals_mllib(spark):
    df = model_rows(spark)
    mine = ML.gaussian_bayes(ML.class_moments(df, ["a", "b", "c"]), df, ["a", "b", "c"], ["id"])
    theirs = ML.naive_bayes().fit(df).transform(df).select("id", vector_to_array("probability").alias("p"))
    off = mine.join(theirs, "id").select(F.abs(F.col("probabilities")[1] - F.col("p")[1]).alias("d"))
    assert off.count() == 400 and off.agg(F.max("d")).first()[0] < 1e-9
    constant = df.withColumn("a", F.lit(2.0))  # the floor keeps a constant feature usable
    p = ML.gaussian_bayes(ML.class_moments(constant, ["a", "b"]), constant, ["a", "b"], ["id"]).select(F.col("probabilities")[0].alias("p"))
    assert p.where(F.isnan("p") | F.col("p").isNull()).count() == 0


def test_folds_are_stratified_and_reproducible(spark):
    df = model_rows(spark).select("id", "label", "features")
    folds = [{r.id: r.fold for r in ML.stratified_folds(df.repartition(n), 3).collect()} for n in (4, 16)]
    assert folds[0] == folds[1] and len(folds[0]) == 400
    sizes = ML.stratified_folds(df, 3).groupBy("label").pivot("fold").count().collect()
    assert all(max(r[1:]) - min(r[1:]) <= 1 for r in sizes)
    grid = {"C": [0.05, 1.0], "penalty": ["l1", "l2"]}
    found = [ML.grid_search("Logistic Regression", grid, ML.stratified_folds(df.repartition(n), 3).select("label", "features", "fold"), 400) for n in (4, 16)]
    assert found[0][0] == found[1][0] and found[0][1] == pytest.approx(found[1][1], abs=1e-6)


def test_logistic_optimum(spark):
    """The slope is 0 at a fit, and the loss's own derivative anywhere else."""
    df = model_rows(spark)
    x = np.array([[r.a, r.b, r.c] for r in df.collect()])
    y = np.array([r.label for r in df.collect()])
    for c, penalty in itertools.product((0.01, 1.0), ("l1", "l2")):
        model = ML.logistic(c, penalty, 400, max_iter=200, tol=1e-10).fit(df)
        rows = ML.logistic_optimum(model, df, ["a", "b", "c"], c, penalty).collect()
        assert [r.feature for r in rows] == ["intercept", "a", "b", "c"]
        assert max(abs(r.slope) for r in rows) < 1e-4
    far = ML.logistic(1.0, "l2", 400, max_iter=1).fit(df)
    w, b = far.coefficients.toArray(), far.intercept
    p = 1 / (1 + np.exp(-(x @ w + b)))
    want = [np.mean(p - y), *((x * (p - y)[:, None]).mean(axis=0) + w / 400)]
    assert [r.slope for r in ML.logistic_optimum(far, df, ["a", "b", "c"], 1.0, "l2").collect()] == pytest.approx(want)


def test_formula_forms(spark):
    df = spark.createDataFrame([(0.5, 0), (1.5, 0), (1.4, 1), (-0.5, 0), (2.4, 1), (None, 1)], "x double, label int")
    assert tuple(A.score_formula(df, "x", threshold=None).first()) == (pytest.approx(3 / 6), 6)  # halves to even; 2 and NULL are wrong
    assert A.score_logits(df, ["1.0", "x"]).first().accuracy == pytest.approx(4 / 6)
    ties = spark.createDataFrame([(1.0, 0), (1.0, 1)], "x double, label int")
    assert A.score_logits(ties, ["x", "x"]).first().accuracy == 0.5
