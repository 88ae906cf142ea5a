"""Unit tables for ties, NULLs, empty groups, single class and Python-regex edge cases, plus
properties and guards (the reference has no tests; its worked examples and guards are the model)."""

import math

import pytest
from pyspark.sql import functions as F

from riskspark.functions import parse as P
from riskspark.functions import steps as S
from riskspark.operators import metrics as E
from riskspark.operators import ordered as O
from riskspark.operators import rerank as V
from riskspark.operators import rl as L
from riskspark.operators import sampling as M
from riskspark.operators import udf as U
from riskspark.operators.features import encode_label


def rows(df, *cols):
    return [tuple(r) for r in df.select(*cols).collect()]


# ----------------------------------------------------------------------------- parsing


ANSWERS = [
    (1, "Final assessment: good\nDefault risk: 20"),
    (2, "Final assessment: bad\nDefault risk: 90\n"),
    (3, "Final assessment: bad\nDefault risk: 80\nmore text"),
    (4, "**Final assessment**: good"),
    (5, "Final assessment: good\nDefault risk: 10\n...Final assessment: bad\nDefault risk: 99"),
    (6, "final assessment: good and bad"),
    (7, "no verdict here"),
    (8, "FINAL ASSESSMENT: BAD"),
    (9, "Final assessment: good\nDefault risk: 0"),
    (10, "Final assessment: good\nDefault risk: 100"),
    (11, "Final assessment: good\nDefault risk: 101"),
    (12, "Final assessment: good\nDefault risk: 1"),
]


@pytest.fixture(scope="module")
def answers(spark):
    return spark.createDataFrame(ANSWERS, "id int, response string")


def test_parse_last_segment(answers):
    got = dict(rows(answers.select("id", P.parse_last_segment("response").alias("l")), "id", "l"))
    assert got[1] == 0 and got[2] == 1 and got[4] == 0
    assert got[5] == 1  # last segment wins
    assert got[6] == 0  # both words: good is checked first
    assert got[7] is None  # miss
    assert got[8] == 1  # case-insensitive


def test_parse_strict_and_loose(answers):
    sv, sr = P.parse_strict("response")
    lv, lr = P.parse_loose("response")
    got = {r[0]: r[1:] for r in rows(answers.select("id", sv, sr, lv, lr), "*")}
    assert got[1] == ("good", 20, "good", 20)
    assert got[2] == ("bad", 90, "bad", 90)  # trailing newline still strict
    assert got[3] == (None, None, "bad", 80)  # text after the risk: loose only
    assert got[5][2:] == ("good", 10)  # loose takes the first match
    assert got[9] == (None, None, None, None)  # risk 0 is not allowed
    assert got[10][:2] == ("good", 100)
    assert got[11][:2] == (None, None) and got[11][2:] == ("good", 10)  # 101: strict fails, loose reads 10 (as Python re)
    assert got[12][:2] == ("good", 1)


def test_parse_answer_fallback(answers):
    pa = P.parse_answer("response")
    got = {r[0]: r[1:] for r in rows(answers.select("id", pa["pred_label"], pa["good_prob"], pa["bad_prob"]), "*")}
    assert got[1] == (0, 0.8, 0.2)
    assert got[4] == (0, 0.5, 0.5)  # no risk: probabilities 0.5 / 0.5, label from the last segment
    assert got[7] == (None, 0.5, 0.5)


def test_last_verdict(answers):
    got = dict(rows(answers.select("id", P.parse_last_verdict("response").alias("v")), "id", "v"))
    assert got[4].strip() == "good"
    assert got[5].strip() == "bad"
    assert got[7] is None


def test_think_format(spark):
    cases = [
        ("<think>\nreason</think>\nFinal assessment: good\nDefault risk: 10", True),
        ("<think>\na<think>b</think>\nx", False),  # two <think>
        ("<think>reason</think>\n", False),  # no newline after <think>
        ("<think>\nreason</think> x", False),  # </think> not followed by a newline
        ("<think>\nuse <b>bold</b></think>\n", True),  # other tags are fine
    ]
    df = spark.createDataFrame(cases, "t string, want boolean")
    for t, want, got in df.select("t", "want", P.has_think_format("t")).collect():
        assert got == want, t


def test_rewards(spark):
    df = spark.createDataFrame(
        [("<think>\nx</think>\nFinal assessment: good\nDefault risk: 10", "good"),
         ("Final assessment: bad\nDefault risk: 50", "bad"),
         ("nothing", "good")],
        "c string, label string",
    )
    got = rows(df.select(L.reward_format("c"), L.reward_accuracy("c", "label"), L.reward_risk("c", "label")), "*")
    assert got[0] == (1.5, 2.0, 2.0)
    assert got[1] == (-1.5, 2.0, -2.0)
    assert got[2] == (-1.5, -0.5, -0.5)


# ----------------------------------------------------------------------------- metrics


def test_curve_metrics_hand_case(spark):
    # labels 1,0,1,1,0,0 scores .9,.8,.8,.3,.2,.9 -> AUC 0.555556, PR-AUC 0.6, KS 0.333333
    df = spark.createDataFrame([(1, 0.9), (0, 0.8), (1, 0.8), (1, 0.3), (0, 0.2), (0, 0.9)], "label int, score double")
    r = E.curve_metrics(df).first()
    assert round(r["roc_auc"], 6) == 0.555556
    assert round(r["pr_auc"], 6) == 0.6
    assert round(r["ks"], 6) == 0.333333


def test_auc_invariant_to_monotone_map_and_ks_symmetry(spark):
    data = [(i % 2 if i % 5 else 1, ((i * 37) % 101) / 101.0) for i in range(300)]
    df = spark.createDataFrame(data, "label int, score double")
    a = E.curve_metrics(df).first()
    b = E.curve_metrics(df.withColumn("score", F.exp(F.col("score") * 3))).first()
    c = E.curve_metrics(df.withColumn("score", 1 - F.col("score"))).first()
    assert math.isclose(a["roc_auc"], b["roc_auc"], abs_tol=1e-12)
    assert math.isclose(a["ks"], c["ks"], abs_tol=1e-12)


def test_single_class_and_all_miss(spark):
    df = spark.createDataFrame([(1, 0.3, None), (1, 0.6, None)], "label int, score double, pred_label int")
    r = E.evaluate(df, score="score", by=[]).first()
    assert r["roc_auc"] is None  # undefined with one class
    assert r["accuracy"] is None and r["num_valid"] == 0 and r["miss_pct"] == 1.0


def test_select_best_ties_and_nan(spark):
    m = spark.createDataFrame([("b", 0.7), ("a", 0.7), ("c", float("nan")), ("d", None)], "model string, roc_auc double")
    assert rows(E.select_best(m, "roc_auc"), "model") == [("a",)]


# ----------------------------------------------------------------------------- rerank


def test_best_of_n_and_vote(spark):
    c = spark.createDataFrame(
        [(1, 0, 0.5, 1), (1, 1, 0.9, 0), (1, 2, 0.9, 0), (2, 0, 0.1, None), (2, 1, 0.2, None), (2, 2, 0.3, 1), (3, 0, None, 1)],
        "prompt_id long, pos int, score double, pred_label int",
    )
    best = dict(rows(V.best_of_n(c), "prompt_id", "pos"))
    assert best == {1: 1, 2: 2, 3: 0}  # first position wins the tie
    maj = {r[0]: (r[1], r[2]) for r in rows(V.majority_label(c), "prompt_id", "majority_label", "votes")}
    assert maj[1] == (0, 2)
    assert maj[2] == (None, 2)  # miss is a label and can win
    with pytest.raises(ValueError):
        V.solution_score("x", "mean")


# ----------------------------------------------------------------------------- ordered primitives


def test_row_index_and_running_totals(spark):
    n = 2000
    df = spark.range(n).select((F.col("id") % 3).alias("g"), ((F.col("id") * 7919) % n).alias("k"), F.lit(1).alias("one"))
    idx = O.row_index(df, ["k"], by=["g"], name="i", num_partitions=7)
    check = idx.groupBy("g").agg(F.min("i"), F.max("i"), F.count("*"), F.countDistinct("i")).collect()
    for g, lo, hi, cnt, d in check:
        assert lo == 0 and hi == cnt - 1 and d == cnt
    rt = O.running_totals(df, ["k"], {"c": "one"}, by=["g"], num_partitions=5)
    bad = rt.join(idx, ["g", "k", "one"]).filter(F.col("c") != F.col("i") + 1).count()
    assert bad == 0


def test_suffix_scan_blocks_equal_sequential(spark):
    # one long key spanning several blocks and levels vs the plain recursion
    n = 1000
    df = spark.range(n).select(F.lit(1).alias("k"), F.col("id").alias("s"), (((F.col("id") * 13) % 7) / 10.0).alias("a"), (((F.col("id") * 17) % 11) / 3.0).alias("b"))
    got = {r["s"]: r["y"] for r in O.suffix_scan(df, ["k"], "s", "a", "b", "y", block=16).collect()}
    data = sorted((r["s"], r["a"], r["b"]) for r in df.collect())
    y, want = 0.0, {}
    for s, a, b in reversed(data):
        y = b + a * y
        want[s] = y
    assert all(math.isclose(got[s], want[s], rel_tol=1e-9, abs_tol=1e-9) for s in want)


def test_gae_matches_loop(spark):
    g, lam = 0.95, 0.95
    steps = [(0, 1.0, 0.5, False), (1, 0.0, 0.4, True), (2, 2.0, 0.3, False), (3, 1.0, 0.2, False)]
    df = spark.createDataFrame(
        [(7, s, r, v, d, steps[s + 1][2] if s + 1 < len(steps) else 0.0) for s, r, v, d in steps],
        "traj_id long, step long, reward double, v double, done boolean, next_value double",
    )
    got = {r["step"]: r["advantage"] for r in L.gae(df, g, lam).collect()}
    a, want = 0.0, {}
    for s, r, v, d in reversed(steps):
        m = 0.0 if d else 1.0
        nv = steps[s + 1][2] if s + 1 < len(steps) else 0.0
        delta = r + g * nv * m - v
        a = delta + g * lam * m * a
        want[s] = a
    assert all(math.isclose(got[s], want[s], abs_tol=1e-12) for s in want)


def test_group_advantage_sums_to_zero(spark):
    df = spark.createDataFrame([(1, 1.0), (1, 2.0), (1, 4.0), (2, 3.0)], "prompt_id long, reward double")
    out = L.group_advantage(df).groupBy("prompt_id").agg(F.sum("advantage").alias("s")).collect()
    d = {r[0]: r[1] for r in out}
    assert abs(d[1]) < 1e-9
    assert d[2] is None  # a group of one has no sample std


# ----------------------------------------------------------------------------- sampling and guards


def test_split_three_complete_and_disjoint(spark):
    df = spark.range(1001).select(F.col("id").cast("string").alias("id"))
    s = M.split_three(df, 0.7, 0.1, key="id", seed=1)
    counts = dict(rows(s.groupBy("split").count(), "split", "count"))
    assert counts == {"train": 700, "dev": 100, "test": 201}
    assert s.select("id").distinct().count() == 1001


def test_guards(spark):
    bad = spark.createDataFrame([("Fully Paid",), ("Current",)], "`Loan Status` string")
    with pytest.raises(ValueError):
        encode_label(bad)
    pos = spark.createDataFrame([(str(i), 1) for i in range(5)], "id string, y int")
    with pytest.raises(ValueError):
        M.balance_to_total(pos, "y", 1, total=3, key="id")
    with pytest.raises(ValueError):
        M.top_up(pos, F.col("y") == 0, target=10, key="id")


# ----------------------------------------------------------------------------- step functions


def test_step_functions(spark):
    df = spark.createDataFrame([("a.\n\n", [5, 1, 2, 0, 0], [1, 9, 1, 9, 9])], "t string, arr array<int>, toks array<int>")
    r = df.select(
        S.ensure_step_tag("t").alias("tagged"),
        S.last_non_pad("arr", 0).alias("last"),
        S.find_subsequence("arr", [1, 2]).alias("sub"),
        S.eos_mask("arr", 2).alias("eos"),
        S.left_truncate("arr", 2).alias("left"),
    ).first()
    assert r["tagged"] == "a.\n\n"
    assert r["last"] == 2 and r["sub"] == 1 and r["eos"] == [1, 1, 1, 0, 0] and r["left"] == [0, 0]
    lbl, att = S.step_token_labels("toks", 9, F.array(F.lit(1), F.lit(0), F.lit(1)), 100, 200)
    r2 = df.select(lbl.alias("l"), att.alias("a")).first()
    assert r2["l"] == [-100, 100, -100, 200, 100] and r2["a"] == [1, 0, 1, 0, 0]


def test_step_tags_of_whole_documents(spark, tmp_path):
    """Later lines and the real endings count."""
    import hashlib

    from riskspark.plans import queries as Q

    texts = ["one", "a\nb.\n\nc:\n   \nd", "a\n \nb\n \n", "x\n\n\ny \n\n", "\n\na\n", "", "a" + "\n" * 50_000 + "b"]
    steps = [["one"], ["a\n", "b.\n\n", "c:\n   \n", "d"], ["a\n \n", "b\n \n"], ["x\n\n\n", "y \n\n"], ["\n\n", "a\n"], [], ["a" + "\n" * 50_000, "b"]]

    def tagged(t):  # the reference's rule
        end = next((e for e in S.END_TOKENS if t.endswith(e)), None)
        return t.replace(end, "\n\n") if end else t + "\n\n"

    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    want = [(k, len(s), *(hashlib.md5(x.encode()).hexdigest() for x in (tagged(t), "".join(map(tagged, s))))) for k, (t, s) in enumerate(zip(texts, steps))]
    assert sorted(map(tuple, Q.doc_step_tags(spark, str(tmp_path)).collect())) == want


def test_doc_steps_has_its_step_tag(spark, tmp_path):
    import hashlib

    from riskspark.plans import queries as Q

    texts = ["one\ntwo", "", "a:\n\nb", "last."]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = dict(rows(Q.doc_steps(spark, str(tmp_path)), "doc_id", "tagged_md5"))
    assert got == {k: hashlib.md5((t.split("\n")[0] + ".\n\n").encode()).hexdigest() for k, t in enumerate(texts)}


def test_whole_conversation_masks(spark, tmp_path):
    """A conversation of over 256 places keeps its later turns and their loss masks."""
    import hashlib

    from riskspark.plans import queries as Q

    said = " ".join(f"w{k}" for k in range(400))
    turns = [("c", 0, "user", said), ("c", 1, "assistant", "yes no"), ("c", 2, "user", "x"), ("c", 3, "assistant", said)]
    spark.createDataFrame(turns, "conv_id string, turn int, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    given, wanted = (["<|im_start|>", *a, "<|im_end|>", "\n"] for a in (["system", "\n", "You", "judge", "credit", "risk"], ["-100"] * 6))
    for _, _, role, text in turns:
        words = text.split()
        given += ["<|im_start|>", role, "\n", *words, "<|im_end|>", "\n"]
        wanted += ["<|im_start|>", "-100", "-100", *(words if role == "assistant" else ["-100"] * len(words)), "<|im_end|>", "\n"]
    md5 = [hashlib.md5("|".join(a).encode()).hexdigest() for a in (given, wanted)]
    assert [tuple(r) for r in Q.conversation_masks_whole(spark, str(tmp_path)).collect()] == [("c", len(given), *md5)]


def test_flag_done(spark):
    long = "x" * 2000
    rows_in = [
        (1, 0, long),
        (1, 1, long + "\nFinal assessment: bad"),  # > 3000 chars and verdict in the last 1000
        (2, 0, "Final assessment: good" + "y" * 3500),  # verdict too far back
        (3, 0, "a"),
    ] + [(3, s, "b") for s in range(1, 31)]
    df = spark.createDataFrame(rows_in, "traj_id long, step long, action string")
    got = {(r[0], r[1]): r[2] for r in L.flag_done(df).select("traj_id", "step", "done").collect()}
    assert got[(1, 0)] is False and got[(1, 1)] is True
    assert got[(2, 0)] is False
    assert got[(3, 28)] is False and got[(3, 29)] is True and got[(3, 30)] is True  # 30th step ends the episode


def test_hot_group_is_spread_over_partitions(spark):
    # one group holds 90 % of the rows: its numbering must still be exact and its rows must sit
    # in several range partitions (no single task holds the whole group)
    n = 5000
    df = spark.range(n).select(F.when(F.col("id") % 10 == 0, F.col("id") % 7).otherwise(F.lit(99)).alias("g"), F.col("id").alias("k"))
    r = O._ranged(df, ["g"], ["k"], 8)
    parts = r.filter(F.col("g") == 99).select(O._PID).distinct().count()
    assert parts >= 4
    idx = O.row_index(df, ["k"], by=["g"], name="i", num_partitions=8)
    hot = idx.filter(F.col("g") == 99).agg(F.min("i"), F.max("i"), F.countDistinct("i"), F.count("*")).first()
    assert hot[0] == 0 and hot[1] == hot[3] - 1 and hot[2] == hot[3]


def test_sampled_shapley_telescopes(spark):
    # for every permutation draw the contributions telescope to f(x) - f(background row), so per
    # row the attributions sum to f(x) minus the mean model output over the drawn background rows
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.functions import vector_to_array

    from riskspark.operators import explain as A

    data = [(i, float(i % 7), float((i * 3) % 5), float(i % 2), int((i % 7) + (i % 2) > 4)) for i in range(200)]
    df = spark.createDataFrame(data, "id long, a double, b double, c double, label int")
    feats = ["a", "b", "c"]
    train = VectorAssembler(inputCols=feats, outputCol="features").transform(df)
    model = LogisticRegression(maxIter=50).fit(train)
    rows = df.filter("id < 5")
    bg = df.filter("id >= 100 and id < 101")  # a single background row: f(b) is one number
    phi = A.sampled_shapley(model, rows, feats, bg, n_perm=3, key="id")
    total = {r[0]: r[1] for r in phi.groupBy("id").agg(F.sum("attribution")).collect()}
    fx = {r[0]: r[1] for r in model.transform(VectorAssembler(inputCols=feats, outputCol="features").transform(rows))
          .select("id", vector_to_array("probability")[1]).collect()}
    fb = model.transform(VectorAssembler(inputCols=feats, outputCol="features").transform(bg)).select(vector_to_array("probability")[1]).first()[0]
    for k in fx:
        assert math.isclose(total[k], fx[k] - fb, abs_tol=1e-9)


def test_stream_equals_batch(spark):
    # K-01: the streaming job (available-now trigger) yields the batch rewards of the same logs
    from riskspark.plans import queries as Q

    sf = "/root/testdata/sf0.001"
    s = Q.stream_rewards(spark, sf).select("r_format", "r_accuracy", "r_risk")
    b = Q.answer_rewards(spark, sf).select("r_format", "r_accuracy", "r_risk")
    assert s.count() == b.count()
    assert s.exceptAll(b).count() == 0 and b.exceptAll(s).count() == 0


def test_parts_and_batches(spark):
    df = spark.range(10).select(F.col("id").cast("string").alias("id"), F.col("id").alias("k"))
    even = dict(rows(M.split_even(df, 4, ["k"]).groupBy("part").count(), "part", "count"))
    assert even == {1: 3, 2: 3, 3: 3, 4: 1}  # ceil(10 / 4) = 3 per part, short tail part
    chunks = dict(rows(M.split_chunks(df, 4, ["k"]).groupBy("part").count(), "part", "count"))
    assert chunks == {1: 4, 2: 4, 3: 2}
    shuffled = M.minibatches(df, 4, ["k"], shuffled=True, key="id", seed=1)
    assert sorted(r[1] for r in rows(shuffled.groupBy("batch").count(), "batch", "count")) == [4, 4]  # remainder dropped


def test_holdout_and_few_shot(spark):
    df = spark.range(25).select(F.col("id").cast("string").alias("id"), F.col("id").alias("k"))
    first = dict(rows(M.holdout(df, "first_frac", 0.1, key="id").groupBy("split").count(), "split", "count"))
    assert first == {"eval": 3, "train": 22}  # ceil(25 * 0.1)
    last = M.holdout(df, "last_n", 5, order=["k"]).filter("split = 'eval'")
    assert sorted(r[0] for r in rows(last, "k")) == [20, 21, 22, 23, 24]
    assert M.few_shot(df, 100, key="id").count() == 25  # min(k, n)
    with pytest.raises(ValueError):
        M.holdout(df, "bogus", 1)


def test_encode_categories_threshold(spark):
    from riskspark.operators import features as FE

    tr = spark.createDataFrame([("1", "x", "a", "Fully Paid"), ("2", None, "b", "Charged Off"), ("3", "y", "c", "Fully Paid")],
                               "id string, small string, big string, `Loan Status` string")
    te = spark.createDataFrame([("4", "x", "d", "Charged Off")], "id string, small string, big string, `Loan Status` string")
    a, b, mapping = FE.encode_categories(tr, te, threshold=2)
    assert {"small_x", "small_y"} <= set(a.columns) and "small" not in a.columns  # 2 values -> one-hot
    codes = dict(rows(a.unionByName(b), "id", "big"))
    assert codes == {"1": 0, "2": 1, "3": 2, "4": 3}  # 4 values -> label codes, fitted on train and test
    assert dict(rows(a, "id", "small_x"))["2"] == 0  # NULL -> all zero
    m = dict(rows(FE.label_mapping(tr, ["small"]), "value", "code"))
    assert m == {"x": 0, "y": 1, None: 2}  # NULL is the last code


# ----------------------------------------------------------------------------- NULL groups, deep trees, long texts


def test_null_groups_keep_their_rows(spark):
    df = spark.createDataFrame([(None, 1, 0.1), (None, 2, 0.4), ("a", 3, 0.3), ("a", 4, 0.9)], "g string, id int, x double")
    assert rows(O.row_index(df, ["id"], by=["g"]).orderBy("id"), "id", "row_idx") == [(1, 0), (2, 1), (3, 0), (4, 1)]
    run = O.running_totals(df, ["id"], {"t": "id"}, by=["g"]).orderBy("id")
    assert rows(run, "id", "t") == [(1, 1), (2, 3), (3, 3), (4, 7)]
    scan = df.withColumn("step", (F.col("id") - 1) % 2).withColumn("a", F.lit(0.5)).withColumn("b", F.lit(1.0))
    assert O.suffix_scan(scan, ["g"], "step", "a", "b", "y").count() == 4
    assert L.group_advantage(df, "x", "g").count() == 4
    assert L.global_advantage(df, "x", by=["g"]).count() == 4
    assert L.normalize_nonzero(df, "x", by=["g"]).count() == 4
    assert L.normalize_batch(df, "x", "g").count() == 4
    assert M.stratified_sample(df, "g", 0.5).groupBy("g").count().count() == 2
    assert M.undersample(df.union(df.limit(0)), "g").count() == 4
    scores = df.withColumn("label", F.col("id") % 2).withColumn("pred_label", F.col("id") % 2)
    assert E.evaluate(scores, score="x", by=["g"]).count() == 2
    assert E.token_metrics(scores, prob="x", by=["g"]).count() == 2
    best = V.best_of_n(df.withColumnsRenamed({"g": "prompt_id", "id": "pos", "x": "score"}))
    assert sorted(r.pos for r in best.collect()) == [2, 4]
    from riskspark.operators import process_reward as G

    assert G.u_values(df.withColumnsRenamed({"g": "question_id", "id": "visits"})).count() == 4


def test_paths_of_any_depth(spark):
    from riskspark.operators import process_reward as G

    nodes = [("q", i, i - 1 if i else None, f"s{i}") for i in range(9)] + [(None, 0, None, "r"), (None, 1, 0, "t")]
    got = G.full_paths(spark.createDataFrame(nodes, "question_id string, node_id int, parent_id int, text string"), sep="/")
    paths = {(r.question_id, r.node_id): r.path for r in got.collect()}
    assert paths == {**{("q", i): "/".join(f"s{k}" for k in range(i + 1)) for i in range(9)}, (None, 0): "r", (None, 1): "r/t"}


def test_samples_refuse_impossible_totals(spark):
    df = spark.createDataFrame([(str(i), "bad" if i < 6 else "good") for i in range(10)], "id string, s string")
    assert M.balance_to_total(df, "s", "bad", total=8).groupBy("s").count().orderBy("s").collect() == [("bad", 6), ("good", 2)]
    with pytest.raises(ValueError):
        M.balance_to_total(df, "s", "bad", total=5)
    with pytest.raises(ValueError):
        M.top_up(df, F.col("s") == "bad", 5)
    with pytest.raises(ValueError):
        M.top_up(df, F.col("s") == "bad", 11)
    both = M.holdout(df, "overlap", 3)
    assert both.filter("split = 'train'").count() == 10 and both.filter("split = 'eval'").count() == 3


@pytest.mark.parametrize("prefixes", [1, 16, 4096])
def test_md5_cuts_equal_the_full_order(spark, prefixes, monkeypatch):
    import hashlib

    monkeypatch.setattr(M, "PREFIXES", prefixes)
    df = spark.createDataFrame([(str(i), i % 3 or None) for i in range(200)], "id string, g int")
    got = M.md5_parts(df, [F.floor(F.col("_n") * 0.5), F.col("_n") - 3], "id", 7, by=["g"]).collect()
    for g in (None, 1, 2):
        order = sorted((r.id for r in got if r.g == g), key=lambda i: hashlib.md5(f"{i}:7".encode()).hexdigest())
        part = {r.id: r._part for r in got}
        assert [part[i] for i in order] == [(k >= len(order) // 2) + (k >= len(order) - 3) for k in range(len(order))]


def test_think_format_on_long_texts(spark):
    good = "<think>\n" + "<" * 200_000 + "</think>\nrest"
    cases = [(good, True), ("<" * 200_000, False), (good + "<think>", False), ("<think>\nx</think>y</think>\n", False), (None, False), ("", False)]
    df = spark.createDataFrame([(t,) for t, _ in cases], "t string")
    assert [r[0] for r in df.select(P.has_think_format("t")).collect()] == [w for _, w in cases]


def test_python_number_and_blank_rules(spark):
    from riskspark.functions import text as T

    values = [0.0, -0.0, 1.0, 12.5, 1e-3, 1e-4, 1.5e-4, 1e-5, 1.25e-7, 0.125, 2.675, 1e7, 12345678.1234567, 1e15, 123456789012345.6,
              1e16, 1.5e16, 1e22, 1e33, 0.1, -2.5e-9, 66925700.0, 0.005, 1.005, -2.675, 1234567.875, float("inf"), float("nan"), 0.015, 99.995]
    got = spark.createDataFrame([(v,) for v in values], "x double").select(T.fmt_num("x"), T.fmt2("x")).collect()
    assert [r[0] for r in got] == [str(v) for v in values]
    assert [r[1] for r, v in zip(got, values) if abs(v) < 1e13 and v] == [f"{v:.2f}" for v in values if abs(v) < 1e13 and v]
    texts = ["a b", "\u3000good\u00a0", "\x1c a\x85b ", "", "  ", "one\ttwo\nthree\u2003four"]
    got = spark.createDataFrame([(t,) for t in texts], "t string").select(T.word_count("t"), T.py_strip("t")).collect()
    assert [tuple(r) for r in got] == [(len(t.split()), t.strip()) for t in texts]
    said = spark.createDataFrame([("Final assessment: good", " good ")], "t string, e string")
    assert said.select(P.is_correct("t", "e")).first()[0] is True


def test_empty_arrays_and_bad_labels(spark):
    df = spark.createDataFrame([([],), ([1],), ([1, 2, 1, 2],)], "a array<int>")
    assert rows(df.select(S.find_all("a", 1).alias("x")), "x") == [([],), ([0],), ([0, 2],)]
    assert rows(df.select(S.find_subsequence("a", [1, 2]).alias("x")), "x") == [(None,), (None,), (0,)]
    assert rows(df.select(S.last_non_pad("a", 2).alias("x")), "x") == [(-1,), (0,), (2,)]
    with pytest.raises(Exception, match="step label"):
        df.select(S.step_token_labels("a", 1, F.array(F.lit(0), F.lit(5)), 8, 9)[0]).collect()


def test_huber_branches(spark):
    errors = [-30.0, -10.0, -1.0, 0.0, 4.0, 10.0, 30.0]
    df = spark.createDataFrame([(e,) for e in errors], "e double")

    def want(e, faithful):
        if abs(e) <= 10:
            return e * e / 2
        return 0.0 if faithful and e < 0 else 10 * (abs(e) - 5)

    for faithful in (True, False):
        assert rows(df.select(L.huber(F.col("e"), 10.0, faithful).alias("l")), "l") == [(want(e, faithful),) for e in errors]
    v = spark.createDataFrame([(1.0, 0.0, 2.0, 1), (5.0, 5.0, 3.0, 0)], "v_new double, v double, ret double, m int")
    assert L.value_loss(v, use_huber=False).first()[0] == pytest.approx((1.8**2 / 2 + 2.0) / 2)
    assert L.value_loss(v, use_huber=False, mask="m").first()[0] == pytest.approx(1.8**2 / 2)


def test_names_with_dots_and_missing_values(spark):
    from riskspark.operators import features as FE

    df = spark.createDataFrame([(1, "a.b", 1.0), (2, "c", 2.0), (3, None, 3.0)], "id int, `k.x` string, `v.y` double")
    train, test, _ = FE.encode_categories(df, df.limit(0), label="none")
    assert [tuple(r) for r in train.select("id", "`k.x_a.b`", "`k.x_c`").orderBy("id").collect()] == [(1, 1, 0), (2, 0, 1), (3, 0, 0)]
    assert FE.assemble(train, exclude=["id"]).count() == 3


def test_flattened_prefixes(spark):
    from riskspark.operators import process_reward as G

    df = spark.createDataFrame([("q", [("a", 0.5), ("b", 1.0)]), ("r", []), ("s", None)], "question_id string, reasoning_steps_text array<struct<solution_prefix:string,mc_value:double>>")
    assert rows(G.flatten_prefixes(df), "question_id", "pos", "solution_prefix", "mc_value") == [("q", 0, "a", 0.5), ("q", 1, "b", 1.0)]


def test_best_model_is_the_first_listed_on_ties(spark):
    df = spark.createDataFrame([(1, "z", 0.7), (2, "a", 0.7), (0, "m", None)], "pos int, model string, roc_auc double")
    assert [r.model for r in E.select_best(df, "roc_auc", order="pos").collect()] == ["z"]


def test_grid_search_and_refit(spark):
    from riskspark.operators import features as FE
    from riskspark.operators import models as ML

    df = spark.createDataFrame([(i, float(i % 7), float(i % 5), int(i % 7 > 3)) for i in range(120)], "id int, x double, y double, label int")
    table = FE.assemble(df, exclude=["id", "label"]).select("id", "label", "features")
    grids = {"Logistic Regression": {"C": [0.1, 1], "penalty": ["l1", "l2"]}, "No such model": {}, "Boosted Trees": {"n_estimators": [2], "max_depth": [2], "scale_pos_weight": [1, 5]}}
    metrics, fitted = ML.benchmark_models(table, table, grids)
    got = {r.model: r for r in metrics.collect()}
    assert set(got) == set(fitted) == {"Logistic Regression", "Boosted Trees"}
    assert set(__import__("json").loads(got["Boosted Trees"].best_params)) == {"n_estimators", "max_depth", "scale_pos_weight"}
    assert 0.5 < got["Logistic Regression"].fold_auc <= 1.0
    name, model = ML.refit_best(metrics, table)
    again = ML.predict_proba(model, table).select("bad_prob").collect()
    assert name in got and again == ML.predict_proba(fitted[name], table).select("bad_prob").collect()


def test_scorers_load_once_a_worker_and_keep_batch_sizes(spark, tmp_path):
    """Batches hold ``batch_size`` rows across Arrow batches; a worker that is used again loads nothing."""
    import os
    import pandas as pd

    folder = str(tmp_path)

    def load():
        open(os.path.join(folder, f"{os.getpid()}-{os.urandom(4).hex()}"), "w").close()
        return lambda b: pd.DataFrame({"id": b["id"], "n": len(b), "pid": os.getpid()})

    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        df = spark.range(0, 1000, 1, 20)
        for _ in range(3):
            rows = U.score_partitions(df, load, "id long, n int, pid long", batch_size=16).collect()
            assert sorted(r.id for r in rows) == list(range(1000))
            assert {r.n for r in rows} == {16, 50 % 16}
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    loads = [f.split("-")[0] for f in os.listdir(folder)]
    assert len(loads) == len(set(loads))  # one load a worker process, not one a task
    other = U.score_partitions(spark.range(5), lambda: (lambda b: b.assign(n=-1)), "id long, n long", batch_size=2).collect()
    assert {r.n for r in other} == {-1}


def test_scorer_cache_is_bounded():
    loaded = []
    for k in ("a", "b", "a", "c", "a", "b"):
        assert U.worker_scorer(f"t-{k}", lambda k=k: loaded.append(k) or k) == k
    assert loaded == ["a", "b", "c", "b"] and len(U._scorers) == U.KEPT_SCORERS


def test_checked_records_and_repeated_append(spark, tmp_path):
    from pyspark.sql import types as T

    from riskspark.sources import files as IO

    schema = T.StructType.fromDDL("id bigint, name string")
    (tmp_path / "a.jsonl").write_text('{"id": 1, "name": "é"}\n{"id": 2, "na\n\n{"id": "x", "name": "n"}\n')
    (tmp_path / "b.jsonl").write_text('{"id": 3}\n')
    (tmp_path / "c.json").write_text('[{"id": 4, "name": "n"},\n {"id": 5}]')
    (tmp_path / "d.json").write_text('[{"id": 6}, {"id"')
    lines = IO.read_checked(spark, [str(tmp_path / "a.jsonl"), str(tmp_path / "b.jsonl")], schema)
    report = {r.source_file[-7:]: (r.records, r.bad_records) for r in IO.file_report(lines).collect()}
    assert report == {"a.jsonl": (1, 2), "b.jsonl": (1, 0)}
    assert sorted((r.id, r.name) for r in IO.good_records(lines.persist()).collect()) == [(1, "é"), (3, None)]
    arrays = IO.read_checked(spark, [str(tmp_path / "c.json"), str(tmp_path / "d.json")], schema)
    assert {r.source_file[-6:]: (r.records, r.bad_records) for r in IO.file_report(arrays).collect()} == {"c.json": (2, 0), "d.json": (0, 1)}
    with pytest.raises(ValueError, match="one kind"):
        IO.read_checked(spark, ["x.json", "y.jsonl"], schema)
    path = str(tmp_path / "units")
    df = spark.createDataFrame([(i, f"u{i}") for i in range(6)], schema)
    for batch, rows in (("0", df.where("id < 3")), ("1", df.where("id = 3")), ("1", df.where("id >= 3")), ("1", df.where("id >= 3"))):
        IO.append_batch(rows, path, batch)
    assert sorted((r.batch, r.id) for r in spark.read.schema("id bigint, name string, batch string").json(path).collect()) == [("0", 0), ("0", 1), ("0", 2), ("1", 3), ("1", 4), ("1", 5)]


def test_sft_arrays_of_tokens_and_unknown_roles(spark):
    from riskspark.functions import prompts as T

    turns = "array<struct<`from`: string, value: array<int>>>"
    df = spark.createDataFrame([([("user", [5, 6]), ("assistant", [7, 8, 9])],), ([],)], f"c {turns}")
    system = F.array(F.lit(40), F.lit(41))
    given, wanted = T.sft_arrays("c", system, 24, start=1, end=2, newline=3, pad=0, ignore=-100, encode=lambda v: v, header=lambda r: F.array(*[F.lit(x) for x in {"system": [10], "user": [11], "assistant": [12, 13]}[r]]))
    a, b = df.select(given, wanted).first()
    assert a == [1, 10, 3, 40, 41, 2, 3, 1, 11, 3, 5, 6, 2, 3, 1, 12, 13, 3, 7, 8, 9, 2, 3, 0]
    assert b == [1, -100, -100, -100, -100, 2, 3, 1, -100, -100, -100, -100, 2, 3, 1, -100, -100, -100, 7, 8, 9, 2, 3, -100]
    odd = spark.createDataFrame([([("tool", "x")],)], "c array<struct<`from`: string, value: string>>")
    with pytest.raises(Exception, match="unknown role in a conversation: tool"):
        odd.select(*T.sft_arrays("c", "s", None)).collect()


def test_verdict_lookup(spark):
    from riskspark.operators import prep as PR

    df = spark.createDataFrame([(" Good",), ("BAD  ",), ("bad",), ("gOOD",), ("",), (None,), ("  good  ",)], "token string")
    got = {r.token: (r.verdict_word, r.variant_number, r.good_token, r.bad_token) for r in PR.verdict_lookup(df, "token").collect()}
    none = (None, None, None, None)
    assert got == {" Good": ("good", 12, " Good", " Bad"), "BAD  ": ("bad", 8, "GOOD  ", "BAD  "), "bad": ("bad", 0, "good", "bad"), "gOOD": none, "": none, None: none, "  good  ": ("good", 20, "  good  ", "  bad  ")}
    same = PR.verdict_lookup(df, "token", "good", "GOOD").where("token = ' Good'").collect()
    assert [(r.verdict_word, r.variant_number) for r in same] == [("good", 12)]


def test_null_groups_keep_children_and_parents(spark):
    from riskspark.operators import process_reward as G

    nodes = spark.createDataFrame([(None, 0, None, "p"), (None, 1, 0, "p\n\nq"), (7, 0, None, "r")], "question_id long, node_id long, parent_id long, prefix string").withColumn("mc", F.lit(0.5))
    edges = {(r.question_id, r.node_id): r.text for r in G.tree_edges(nodes).collect()}
    assert len(edges) == 3 and edges[None, 1] == G.tree_edges(nodes.fillna({"question_id": 1})).where("node_id = 1").first().text
    rollouts = spark.createDataFrame([(None, 0, 0, "x", True), (None, 0, 1, "y", False), (7, 0, 0, "z", True), (7, 0, 1, "w", False)], "question_id long, node_id long, pos int, rollout string, correct boolean")
    assert G.expand_correct(nodes, rollouts, G.mc_values(rollouts)).count() == 2


def test_word_count_splits_as_python(spark):
    from riskspark.functions.text import word_count

    texts = ["", " ", "a", " a  b\tc\n", "a\x1cb\x85c d e", "　x y ", None, "a​b"]
    got = spark.createDataFrame([(t,) for t in texts], "t string").select("t", word_count("t").alias("n")).collect()
    assert [r.n for r in got if r.t is not None] == [len(t.split()) for t in texts if t is not None]


def test_scan_keeps_rows_and_agrees_for_any_block(spark):
    """NULL keys, odd column names and payloads; every block size gives the plain recursion."""
    rows = [(k, t, f"p{t}", 0.5 if t % 3 else 0.0, float(t)) for k, n in (("x", 130), ("y", 4), (None, 33), ("z", 1)) for t in range(n)]
    df = spark.createDataFrame(rows, "k string, t int, `a.b` string, c double, d double").repartition(7)
    want = {}
    for k, n in (("x", 130), ("y", 4), (None, 33), ("z", 1)):
        y = 0.0
        for t in reversed(range(n)):
            y = float(t) + (0.5 if t % 3 else 0.0) * y
            want[k, t] = (f"p{t}", y)
    for block in (2, 4, 32, 256):
        out = O.suffix_scan(df, ["k"], "t", "c", "d", "y", block=block)
        assert out.columns == [*df.columns, "y"]
        got = {(r.k, r.t): (r["a.b"], r.y) for r in out.collect()}
        assert got.keys() == want.keys()
        assert all(got[i][0] == want[i][0] and math.isclose(got[i][1], want[i][1], rel_tol=1e-12) for i in want)
    assert O.suffix_scan(df.limit(0), ["k"], "t", "c", "d", "y").count() == 0


def test_number_formats_equal_python_on_random_values(spark):
    import random

    from riskspark.functions.text import fmt2, fmt_num

    rng = random.Random(21)
    values = [0.0, -0.0, 0.005, 0.015, 0.125, 1.005, 2.675, -2.675, 0.995, 99.995, 1e-3, 9.99e-4, 9_999_999.0, 1e7, 123456789.125, 1e9 + 0.125, 1e9 + 0.375, 1e15, 1e16, 1e22, 1.7e308]
    values += [rng.uniform(-200, 200) for _ in range(300)] + [round(rng.uniform(0, 1000), 3) for _ in range(300)] + [rng.randint(0, 10**6) / 200 for _ in range(300)]
    values += [rng.uniform(1, 10) * 10.0 ** rng.randint(-12, 20) for _ in range(300)] + [rng.randint(1, 10**9) / 8 for _ in range(300)]
    for r in spark.createDataFrame([(v,) for v in values], "v double").select("v", fmt2("v").alias("two"), fmt_num("v").alias("num")).collect():
        # outside these Java 17 may write a digit more than the shortest form
        assert r.num == str(r.v) if r.v == 0 or 1e-3 <= abs(r.v) < 1e7 else float(r.num) == r.v
        if abs(r.v) < 1e13 and not (r.v == 0 and str(r.v)[0] == "-"):
            assert r.two == f"{r.v:.2f}", r.v
