"""What keeps time, shuffles and files in proportion to the input: no shuffle or join where a row decides alone, few hand-overs to Python."""

import numpy as np
import pandas as pd
import pytest
from pyspark.ml.evaluation import BinaryClassificationEvaluator
from pyspark.sql import functions as F

from riskspark.operators import explain as A
from riskspark.operators import features as FE
from riskspark.operators import models as ML
from riskspark.operators import ordered as O
from riskspark.operators import sampling as M
from riskspark.operators import trees as TR
from riskspark.operators import udf as U
from riskspark.plans import proxies as X
from riskspark.plans import queries as Q
from riskspark.session import materialized, small_methods
from riskspark.sources import files as IO


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_split_of_another_table_needs_no_join(spark):
    every = spark.range(3000).select(F.concat(F.lit("k"), "id").alias("id"))
    some = every.where("id like '%7%'")
    for train, dev in ((0.7, 0.1), (0.0, 0.0), (1.0, 0.0), (0.5, 0.5)):
        want = {r.id: r.split for r in M.split_three(every, train, dev, seed=5).collect()}
        tagged = M.split_three(some, train, dev, seed=5, of=every)
        assert "Join" not in plan(tagged) and "Exchange" not in plan(tagged)
        got = {r.id: r.split for r in tagged.collect()}
        assert len(got) == some.count() and all(want[k] == v for k, v in got.items())
    numbers = spark.createDataFrame([(i, j) for i in range(40) for j in range(5)], "a long, b int")
    want = {(r.a, r.b): r.split for r in M.split_three(numbers, 0.3, 0.3, key=["a", "b"]).collect()}
    assert want == {(r.a, r.b): r.split for r in M.split_three(numbers, 0.3, 0.3, key=["a", "b"], of=numbers).collect()}
    assert M.split_three(every, 0.7, 0.1, of=every.limit(0)).where("split = 'test'").count() == 0


def test_small_groups_are_numbered_in_one_shuffle(spark, monkeypatch):
    """As over ranges, for a NULL group too; ranges are left to large groups."""
    df = spark.range(2000).select(F.when(F.col("id") % 50 > 0, F.col("id") % 50).alias("g"), ((F.col("id") * 7919) % 2000).alias("k"))
    with monkeypatch.context() as m:
        m.setattr(O, "_ranged", None)
        got = sorted(map(str, O.row_index(df, ["k"], by=["g"], name="i").collect()))
    with monkeypatch.context() as m:
        m.setattr(O, "_has_large_group", lambda *a: True)
        assert got == sorted(map(str, O.row_index(df, ["k"], by=["g"], name="i").select("g", "k", "i").collect()))
    assert O._has_large_group(df.withColumn("g", F.lit(1)), ["g"], 8) and not O._has_large_group(df, ["g"], 8) and not O._has_large_group(df.limit(0), ["g"], 8)


def test_tree_attributions_shuffle_nothing(spark):
    nodes = spark.createDataFrame(Q.FIXED_FOREST, "tree int, id int, left int, right int, feature int, threshold double, cover double, value double")
    df = spark.createDataFrame([(1, [3.0, 640.0, 3.0]), (2, [9.0, None, float("nan")]), (3, None), (4, [1.0])], "id long, x array<double>")
    attr = TR.tree_attributions(TR.leaf_paths(nodes), df, ["a", "b", "c"], F.col("x"))
    assert "Exchange" not in plan(attr) and "Join" not in plan(attr)
    got = attr.collect()
    assert len(got) == 12 and all(r.attribution is not None and r.attribution == r.attribution for r in got)


def test_surrogate_samples_are_not_shuffled(spark):
    """Only the rows, before they become points, and one array a key and batch are."""
    samples = spark.createDataFrame([("x", [1.0, 2.0], 1.0, 1.0)] * 3, "_key string, _z array<double>, _y double, _w double")
    told = plan(A.weighted_ridge(samples, 2, 1.0))
    below = told[told.index("MapInArrow") :]
    assert "Exchange" not in below and told.count("Exchange") == 1


def test_draws_are_the_md5_of_their_place(spark):
    points = spark.createDataFrame([("p", 0), (None, 3)], "_key string, _s int")
    u = lambda i, kind: A._u01(F.col("_key"), F.col("_s"), F.lit(i), F.lit(9), F.lit(kind))
    both = A._with_draws(points, 2, 9, True).select("_u", "_n", *[u(i, c).alias(f"{c}{i}") for c in "uab" for i in range(2)])
    for r in both.collect():
        assert r._u == [r.u0, r.u1]
        assert r._n == pytest.approx([(-2 * __import__("math").log(a)) ** 0.5 * __import__("math").cos(2 * __import__("math").pi * b) for a, b in ((r.a0, r.b0), (r.a1, r.b1))])


def test_quantile_cuts_keep_their_rank_error(spark):
    """Exact on tables of few rows, missing values and NaN too; within 1 / accuracy where tasks thin their values several times; no aggregate of Spark's."""
    rng = np.random.default_rng(8)
    x, y = rng.normal(size=70_000), rng.integers(0, 50, 70_000).astype(float)
    df = spark.createDataFrame(pd.DataFrame({"i": range(70_000), "x": x, "y": y})).repartition(2)
    df = df.select(F.col("x").alias("a"), F.expr("if(i % 3 = 0, y, null)").alias("b"), F.lit(None).cast("double").alias("c"), F.expr("if(i % 8 = 0, double('nan'), 1.0D)").alias("d"))
    shares = [0.0001, 0.25, 0.5, 0.75, 1.0]
    for accuracy in (10_000, 20):  # 320 values at a time: seven times thinned
        a, b, c, d = A.quantile_cuts(df, shares, accuracy)
        assert c is None and d[:4] == [1.0] * 4 and np.isnan(d[4])
        for got, held in ((a, np.sort(x)), (b, np.sort(y[::3]))):
            for v, p in zip(got, shares):
                lo, hi = np.searchsorted(held, v, "left") / len(held), np.searchsorted(held, v, "right") / len(held)
                assert lo - 1 / accuracy <= p <= hi + 1 / accuracy
                assert accuracy < 10_000 or v == held[int(np.ceil(p * len(held))) - 1]
    assert [A.quantile_cuts(df.limit(0), [0.5]), A.quantile_cuts(df.where(F.col("a") == float(x[5])).select("a"), [0.5])] == [[None] * 4, [[x[5]]]]


def test_bucket_points_are_made_without_lambdas(spark):
    """Quartiles take one row a feature and no row a value, points no interpreted lambda; both are those of their definition, with a constant feature, a
    missing value, NaN and a long key."""
    import hashlib
    import math

    rng = np.random.default_rng(4)
    train = [(float(a), 3.0, float(b)) for a, b in zip(rng.normal(size=300), rng.integers(0, 3, 300))]
    df = spark.createDataFrame(train, "a double, `b.c` double, d double").repartition(3)
    names, k = ["a", "b.c", "d"], 3
    stats = A.quartile_stats(df, names)
    assert "Generate" not in plan(stats) and "Aggregate" not in plan(stats)
    buckets = stats.first().buckets
    for i, b in enumerate(buckets):
        v = np.array([r[i] for r in train])
        at = sum((v > c).astype(int) for c in b.cuts)
        assert b.at == i and b.cuts == [np.sort(v)[math.ceil(p * 300) - 1] for p in (0.25, 0.5, 0.75)]
        for j in range(4):
            own = v[at == j]
            want = [own.mean(), own.std(), own.min(), own.max()] if len(own) else [0.0] * 4
            assert [b.mean[j], b.deviation[j], b.least[j], b.most[j]] == pytest.approx(want, abs=1e-12) and b.share[j] == pytest.approx((at <= j).mean())
    rows = [("r", 0.1, 3.0, None), (None, float("nan"), 2.0, 9.0), ("k" * 60, -5.0, 4.0, 1.0)]
    made = A.perturbed(spark.createDataFrame(rows, "id string, a double, `b.c` double, d double"), stats, names, 70, "id", 5)
    assert "lambda" not in plan(made) and "Generate" not in plan(made)
    got = {}
    for r in made.collect():
        got.setdefault(r._key, []).append(r)
    for key, *x in rows:
        own = [0 if v is None else sum(not v <= c for c in b.cuts) for v, b in zip(x, buckets)]
        assert len(got[key]) == 70
        for s, r in enumerate(got[key]):
            def u(i, kind):
                text = ":".join([*([key] if key else []), str(s), str(i), "5", kind])
                return (int(hashlib.md5(text.encode()).hexdigest()[:12], 16) + 0.5) / 16**12

            at = own if s == 0 else [sum(u(i, "u") > c for c in b.share[:3]) for i, b in enumerate(buckets)]
            n = [math.sqrt(-2 * math.log(u(i, "a"))) * math.cos(2 * math.pi * u(i, "b")) for i in range(k)]
            v = x if s == 0 else [min(max(b.mean[j] + b.deviation[j] * d, b.least[j]), b.most[j]) for b, j, d in zip(buckets, at, n)]
            assert r._z == [float(a == o) for a, o in zip(at, own)] and r._d2 == k - sum(r._z)
            assert [m is None for m in r._v] == [w is None for w in v]
            assert [m for m in r._v if m is not None] == pytest.approx([w for w in v if w is not None], nan_ok=True, abs=1e-12)
    with pytest.raises(ValueError, match="d"):
        A.quartile_stats(df.withColumn("d", F.lit(None).cast("double")), names)


def test_scored_batches_go_back_together():
    """Batches of the stated size reach the scorer; their results are handed over in large frames, types and missing values kept."""

    class Table:
        def mapInPandas(self, run, schema):
            return run

    sizes = []

    def load():
        def score(b):
            sizes.append(len(b))
            return pd.DataFrame({"id": b["id"], "v": [None] * len(b) if b["id"].iloc[0] < 64 else b["id"] * 2})

        return score

    frames = list(U.score_partitions(Table(), load, "id long, v long", 64, key="growth")(iter([pd.DataFrame({"id": range(k, k + 1000)}) for k in range(0, 25_000, 1000)])))
    assert set(sizes) == {64, 25_000 % 64} and [len(f) for f in frames] == [10_048, 10_048, 4904]
    assert [i for f in frames for i in f["id"]] == list(range(25_000))
    assert frames[0]["v"].iloc[:64].isna().all() and frames[0]["v"].iloc[64] == 128 and isinstance(frames[0]["v"].iloc[64], int)


def test_rounding_equals_half_away_from_zero(spark):
    values = [0.0, -0.0, 0.5e-6, -0.5e-6, 1.5e-6, 2.5e-6, 0.49999999999999994e-6, 1e-7, -1e-7, 123.4567885, -7.0000005, 1e300, float("inf"), float("-inf"), None, 4503599627.370497]
    df = spark.createDataFrame([(v,) for v in values], "x double")
    y = F.round(F.col("x") * F.lit(1e6))
    for r in df.select(Q.round6(F.col("x")).alias("new"), F.when(y == 0, F.lit(0.0)).otherwise(y / F.lit(1e6)).alias("old")).collect():
        assert repr(r.new) == repr(r.old)
    assert Q.round6(F.lit(float("nan"))) is not None and df.limit(1).select(Q.round6(F.lit(float("nan"))).alias("n")).first().n != 0


def test_text_sinks_compress_on_demand(spark, tmp_path):
    df = spark.createDataFrame([("a", 1), ("é", 2)], "s string, part int")
    IO.write_parts(df, f"{tmp_path}/parts", compression="gzip")
    IO.append_records(df, f"{tmp_path}/more.jsonl", compression="gzip")
    IO.write_records(df, f"{tmp_path}/ids.jsonl", compression="gzip")
    assert len(list(tmp_path.rglob("*.json.gz"))) >= 3 and not list(tmp_path.rglob("*.json"))
    for path in ("more.jsonl", "ids.jsonl"):
        assert sorted(r.s for r in IO.read_records(spark, f"{tmp_path}/{path}", df.schema).collect()) == ["a", "é"]


def test_large_methods_are_split_unless_the_user_says_otherwise(spark):
    name = "spark.sql.codegen.hugeMethodLimit"
    before = spark.conf.get(name)
    try:
        for value, want in (("65535", "8000"), ("20000", "20000")):
            spark.conf.set(name, value)
            small_methods(spark)
            assert spark.conf.get(name) == want
    finally:
        spark.conf.set(name, before)


def test_stored_table_in_folders_reads_its_own_files(spark):
    df = spark.range(100).select("id", F.when(F.col("id") % 3 == 0, "a").otherwise("b").alias("split"))
    d = materialized(df, "folders", by="split")
    assert d.filter("split = 'a'").count() == 34 and "PartitionFilters: [isnotnull(split" in d.filter("split = 'a'")._jdf.queryExecution().toString()
    assert sorted(map(tuple, d.select("id", "split").collect())) == sorted(map(tuple, df.collect()))


def test_categories_are_found_in_one_look(spark, monkeypatch):
    """Cardinalities, values and codes come from the distinct values; a column without values is there too."""
    df = spark.createDataFrame([("1", "x", "a", None), ("2", None, "b", None), ("3", "y", "c", None)], "id string, small string, big string, none string")
    looks = []
    with monkeypatch.context() as m:
        m.setattr(FE, "category_values", lambda d, c, f=FE.category_values: looks.append(list(c)) or f(d, c))
        tr, _, mapping = FE.encode_categories(df, df.limit(0), threshold=2, label="no label")
    assert looks == [["small", "big", "none"]]
    assert sorted(tr.columns) == ["big", "id", "small_x", "small_y"] and sorted(map(tuple, mapping.collect())) == [("big", "a", 0), ("big", "b", 1), ("big", "c", 2)]
    values = FE.category_values(df, ["small", "big", "none"])
    assert sorted(FE.cardinalities(df, ["small", "big", "none"]).collect()) == sorted(FE.cardinalities(df, ["small", "big", "none"], values=values).collect())


def test_linear_attributions_carry_plain_numbers(spark):
    df = spark.createDataFrame([(1, 2.0, 3), (2, None, 5)], "id long, `a.b` double, c int")
    attr = A.linear_attributions(df, ["a.b", "c"], [0.5, -2.0], df)
    assert "Join" not in plan(attr) and "posexplode" in plan(attr)
    assert sorted(map(tuple, attr.filter("value is not null").collect())) == [(1, "a.b", 2.0, 0.0), (1, "c", 3.0, 2.0), (2, "c", 5.0, -2.0)]
    assert attr.filter("value is null and attribution is null").count() == 1


def _points(spark):
    rows = [(i, float(i % 7), float(i * 13 % 11), int((i * 31 % 17) + i % 7 > 12)) for i in range(300)]
    return FE.assemble(spark.createDataFrame(rows, "id long, x double, y double, label int"), exclude=["id", "label"])


def test_all_fits_are_checked_in_one_look(spark):
    """The slopes of several fits by their definition, each by its own C and penalty, a coefficient of 0 too."""
    df = _points(spark)
    fits = [(ML.logistic(c, p, 300).fit(df), c, p) for c in (0.01, 1.0) for p in ("l1", "l2")] + [(ML.logistic(0.0001, "l1", 300).fit(df), 1.0, "l1")]
    optima = ML.logistic_optima(fits, df, ["x", "y"])
    assert plan(optima).count("MapInArrow") == 1 and "Exchange" not in plan(optima)[plan(optima).index("MapInArrow") :]
    told = [tuple(r) for r in optima.collect()]
    data = df.collect()
    x, y = np.array([r.features.toArray() for r in data]), np.array([r.label for r in data])
    want = []
    for m, c, p in fits:
        w, miss = m.coefficients.toArray(), 1 / (1 + np.exp(-(x @ m.coefficients.toArray() + m.intercept))) - y
        g, s = x.T @ miss / 300, 1 / (c * 300)
        want.append((c, p, "intercept", m.intercept, miss.mean()))
        for f, v, d in zip("xy", w, g):
            want.append((c, p, f, v, d + v * s if p == "l2" else d + np.sign(v) * s if v else np.sign(d) * max(abs(d) - s, 0.0)))
    assert any(r[3] == 0 for r in want)
    for a, b in zip(sorted(told), sorted(want)):
        assert a[:3] == b[:3] and a[3:] == pytest.approx(b[3:], abs=1e-9)


def test_a_longer_boosted_fit_holds_the_shorter(spark):
    """The first trees of five are the fit of three, so one fit serves both grid points; the search finds what separate fits do."""
    df = _points(spark).repartition(3).cache()
    grid = {"max_depth": [2], "learning_rate": [0.1, 0.3], "n_estimators": [3, 5], "scale_pos_weight": [1, 5]}
    runs = ML._runs("Boosted Trees", [dict(zip(grid, v)) for v in __import__("itertools").product(*grid.values())])
    assert [[p["n_estimators"] for p in r] for r in runs] == [[3, 5]] * 4
    assert len(ML._runs("Boosted Trees", [{"n_estimators": 3, "subsample": 0.5}, {"n_estimators": 5, "subsample": 0.5}])) == 2
    for name, points in (("Boosted Trees", runs[1]), ("Leafwise Trees", [{"num_leaves": 4, "n_estimators": n, "min_child_samples": 5} for n in (3, 5)])):
        short, long = (ML.fit(name, p, df, 300) for p in points)
        a = {r.id: r.rawPrediction[1] for r in short.transform(df).collect()}
        assert a == pytest.approx({r.id: r.rawPrediction for r in ML.first_trees(long, df, 3).collect()}, abs=1e-12)
    folds = ML.stratified_folds(df.select("id", "label", "features"), 3).select("label", "features", "fold").cache()
    params, score = ML.grid_search("Boosted Trees", grid, folds, 300)
    auc = BinaryClassificationEvaluator(labelCol="label")
    means = []
    for p in (p for r in runs for p in r):
        means.append((np.mean([auc.evaluate(ML.fit("Boosted Trees", p, folds.where(f"fold <> {f}"), 300).transform(folds.where(f"fold = {f}"))) for f in range(3)]), p))
    assert score == pytest.approx(max(m for m, _ in means)) and score == pytest.approx(next(m for m, p in means if p == params))


def test_search_fits_nothing_twice(spark, monkeypatch):
    """A fit a run and fold, none on all rows, and no Python function over the rows."""
    fits = []
    monkeypatch.setattr(ML, "fit", lambda name, params, rows, *a, f=ML.fit: fits.append(plan(rows)) or f(name, params, rows, *a))
    ML.grid_search("Boosted Trees", {"max_depth": [2], "n_estimators": [1, 2]}, ML.stratified_folds(_points(spark), 3).select("label", "features", "fold").cache(), 300)
    assert len(fits) == 3 and not any("Python" in p for p in fits)
    drawn = ML.grid_search("Naive Bayes", {}, _points(spark).select("label", "features"), 300)
    assert drawn[0] == {} and 0.4 < drawn[1] <= 1.0


def test_a_failing_model_is_no_result(spark, monkeypatch):
    """The other models are still searched, then the error names the one that failed; only who asks for it gets the others' rows alone."""
    searched = []

    def search(name, *a, f=ML.grid_search):
        searched.append(name)
        if name == "Random Forest":
            raise OSError("executor lost")
        return f(name, *a)

    monkeypatch.setattr(ML, "grid_search", search)
    grids = {"Random Forest": {"n_estimators": [1]}, "Naive Bayes": {}}
    with pytest.raises(RuntimeError, match="Random Forest") as error:
        ML.benchmark_models(_points(spark), _points(spark), grids)
    assert searched == list(grids) and isinstance(error.value.__cause__, OSError)
    metrics, fitted = ML.benchmark_models(_points(spark), _points(spark), grids, skip_failing=True)
    assert [r.model for r in metrics.collect()] == list(fitted) == ["Naive Bayes"]


def test_all_models_score_a_row_in_one_look(spark):
    """One read a side for all models, what is kept stays with its row, and the scores are those of the models alone."""
    df = _points(spark).withColumn("text", F.concat(F.lit("t"), "id"))
    stored = {"Logistic Regression": {"C": 1, "penalty": "l2"}, "Boosted Trees": {"max_depth": 2, "n_estimators": 2}, "Naive Bayes": {}}
    both = ML.score_both(stored, df, df.where("id < 50"), keep=["text"])
    assert plan(both).count("Scan ExistingRDD") == 2 and "Exchange" not in plan(both)
    got = {(r.id, r.side, r.model): r for r in both.collect()}
    assert len(got) == 3 * 350 and all(r.text == f"t{r.id}" for r in got.values())
    for name, params in stored.items():
        for r in ML.predict_proba(ML.fit(name, params, df.select("label", "features"), 300), df).collect():
            assert got[r.id, "train", name].bad_prob == pytest.approx(r.bad_prob, abs=1e-9) and got[r.id, "train", name].label == r.label
            assert r.id >= 50 or got[r.id, "test", name].good_prob == pytest.approx(r.good_prob, abs=1e-9)


def test_whole_numbers_equal_round(spark):
    values = [0.0, -0.0, 0.5, -0.5, 1.5, 2.5, 0.49999999999999994, -0.3, 123.5, -7.49999, 1e300, float("inf"), None, 4503599627370497.5, 5.000000000000001]
    df = spark.createDataFrame([(v,) for v in values], "x double")
    for r in df.select("x", X._whole(F.col("x")).alias("new"), F.round("x").alias("old")).collect():
        assert repr(r.new) == repr(r.old), r


def test_shapley_points_are_made_without_lambdas(spark):
    """The hybrid vectors of the points are compiled place by place; a linear margin's values are exact whatever the draws."""
    df = _points(spark)
    model = ML.boosted(1, 0.3, 1).fit(df)
    attr = A.sampled_shapley(model, df.where("id < 4"), ["x", "y"], df.where("id = 9"), n_perm=3)
    made = next(line for line in attr._jdf.queryExecution().optimizedPlan().toString().splitlines() if "_at" in line and "UDF" in line)
    assert "lambdafunction(CASE WHEN" not in made
    total = {r.id: r.t for r in attr.groupBy("id").agg(F.sum("attribution").alias("t")).collect()}
    p = {r.id: r.bad_prob for r in ML.predict_proba(model, df).collect()}
    assert total == pytest.approx({i: p[i] - p[9] for i in range(4)})
