"""Registered queries: each takes (spark, sf_dir) and returns a DataFrame over the whole driver
tables. Floating outputs are rounded to 6 decimals for the cross-engine check."""

from __future__ import annotations

import json

from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T_

from ..functions import parse as P
from ..functions.text import word_count
from ..operators import metrics as E
from ..operators import rerank as V
from ..operators import rl as L
from ..functions import prompts as T
from ..functions import steps as S
from ..operators import explain as A
from ..operators import features as FE
from ..operators import models as ML
from ..operators import prep as PR
from ..operators import process_reward as G
from ..operators import sampling as M
from ..operators import trees as TR
from ..operators import udf as U
from ..session import materialized
from . import proxies as X


HELPERS = {"r6", "round6", "word_count", "materialized"}


def round6(c) -> "F.Column":
    """Scale by 1e6, round half away from zero, scale back; negative zero becomes zero.
    Written so that any engine computing the same double gets the same rounded double."""
    x = c * F.lit(1e6)
    even = F.rint(x)  # ties go to even there; ``x - even`` is exact
    y = F.when(F.abs(x - even) == 0.5, x + F.signum(x) * F.lit(0.5)).otherwise(even)
    return F.when(y == 0, F.lit(0.0)).otherwise(y / F.lit(1e6))


def _r6(df: DataFrame, cols: list[str]) -> DataFrame:
    return df.select(*[round6(F.col(c)).alias(c) if c in cols else F.col(c) for c in df.columns])


def _doubles(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if f.dataType.typeName() in ("double", "float")]


def r6(df: DataFrame) -> DataFrame:
    return _r6(df, _doubles(df))


# ----------------------------------------------------------------------------- metrics


def metrics_by_model(spark: SparkSession, sf: str) -> DataFrame:
    """E-01 ... E-11: one metric row per model over every prediction."""
    return r6(E.evaluate(X.predictions(spark, sf), label="label", score="bad_prob", pred="pred_label", by=["model"]))


def metrics_from_scores(spark: SparkSession, sf: str) -> DataFrame:
    """E-01 + E-11: label from the score (> 0.5), metrics per model."""
    return r6(E.evaluate(X.predictions(spark, sf), label="label", score="bad_prob", pred=None, by=["model"]))


def roc_points(spark: SparkSession, sf: str) -> DataFrame:
    """E-04 / E-06: curve points per (model, distinct score)."""
    pts = E.curve_points(X.predictions(spark, sf), label="label", score="bad_prob", by=["model"])
    return r6(pts.select("model", "score", "pos", "neg", "tpr", "fpr", "precision"))


def best_model(spark: SparkSession, sf: str) -> DataFrame:
    """E-12: model with the highest ROC-AUC (first listed, by first appearance in the predictions' order, on ties)."""
    m = E.evaluate(X.predictions(spark, sf), by=["model"]).withColumn("pos", F.dense_rank().over(Window.orderBy("model")))  # one row per model
    return r6(E.select_best(m, "roc_auc", order="pos").select("model", "roc_auc", "accuracy"))


# ----------------------------------------------------------------------------- parsing and rewards


def answer_parse(spark: SparkSession, sf: str) -> DataFrame:
    """R-01 ... R-10 on every answer."""
    a = X.answers(spark, sf)
    strict_v, strict_r = P.parse_strict("response")
    loose_v, loose_r = P.parse_loose("response")
    pa = P.parse_answer("response")
    return r6(
        a.select(
            *X.LINE_KEY,
            P.parse_exact("response").alias("exact_label"),
            P.parse_last_segment("response").alias("segment_label"),
            P.parse_last_verdict("response").alias("last_verdict"),
            strict_v.alias("strict_verdict"),
            strict_r.alias("strict_risk"),
            loose_v.alias("loose_verdict"),
            loose_r.alias("loose_risk"),
            P.parse_risk("response").alias("risk"),
            pa["pred_label"].alias("pred_label"),
            pa["good_prob"].alias("good_prob"),
            pa["bad_prob"].alias("bad_prob"),
            P.is_correct("response", "expected").alias("correct"),
            P.has_think_format("response").alias("think_ok"),
        )
    )


def answer_rewards(spark: SparkSession, sf: str) -> DataFrame:
    """L-01 ... L-05: rule rewards per answer and their sum."""
    return r6(_rewarded(spark, sf).select(*X.LINE_KEY, "r_format", "r_accuracy", "r_risk", "r_outcome", "reward"))


def _rewarded(spark: SparkSession, sf: str) -> DataFrame:
    return L.with_rewards(
        X.answers(spark, sf),
        {
            "r_format": L.reward_format("response"),
            "r_accuracy": L.reward_accuracy("response", "expected"),
            "r_risk": L.reward_risk("response", "expected"),
            "r_outcome": L.reward_outcome("response", "expected"),
        },
    )


def reward_summary(spark: SparkSession, sf: str) -> DataFrame:
    """L-05: mean of each reward function per verdict label."""
    a = _rewarded(spark, sf)
    return r6(L.reward_means(a, ["r_format", "r_accuracy", "r_risk", "r_outcome", "reward"], by=["expected"]))


def group_advantages(spark: SparkSession, sf: str) -> DataFrame:
    """L-06: group-normalised advantages; group = prompt (order)."""
    a = answer_rewards(spark, sf)
    adv = L.group_advantage(a, reward="reward", group="l_orderkey")
    return r6(adv.select(*X.LINE_KEY, "reward", "advantage"))


def global_advantages(spark: SparkSession, sf: str) -> DataFrame:
    """L-07 and L-10 over trajectory rewards."""
    t = X.trajectories(spark, sf)
    g = L.global_advantage(t, reward="reward", out="advantage")
    n = L.normalize_nonzero(g.withColumn("adv0", F.when(F.col("done"), F.lit(0.0)).otherwise(F.col("advantage"))), adv="adv0")
    return r6(n.select("traj_id", "step", "advantage", "adv_norm"))


# ----------------------------------------------------------------------------- rerank and vote


def best_of_n_min(spark: SparkSession, sf: str) -> DataFrame:
    """V-01 (min) + V-02."""
    c = X.candidates(spark, sf).withColumn("score", V.solution_score("step_good_probs", "min"))
    return r6(V.best_of_n(c).select("prompt_id", "pos", "score", "pred_label", "label"))


def best_of_n_prod(spark: SparkSession, sf: str) -> DataFrame:
    """V-01 (product) + V-02."""
    c = X.candidates(spark, sf).withColumn("score", V.solution_score("step_good_probs", "prod"))
    return r6(V.best_of_n(c).select("prompt_id", "pos", "score", "pred_label", "label"))


def best_of_n_metrics(spark: SparkSession, sf: str) -> DataFrame:
    """V-06: metrics of the selected candidates."""
    c = X.candidates(spark, sf).withColumn("score", V.solution_score("step_good_probs", "min"))
    b = V.best_of_n(c).withColumn("method", F.lit("best_of_n"))
    return r6(E.evaluate(b, label="label", score="bad_prob", pred="pred_label", by=["method"]))


def majority_vote(spark: SparkSession, sf: str) -> DataFrame:
    """V-04: majority label per prompt (miss is a label; first seen wins ties)."""
    return V.majority_label(X.candidates(spark, sf))


def vote_pick(spark: SparkSession, sf: str) -> DataFrame:
    """V-05 + M-10: one pseudo-random candidate carrying the majority label."""
    v = V.vote_select(X.candidates(spark, sf), seed=7)
    return r6(v.select("prompt_id", "pos", "pred_label", "label"))


# ----------------------------------------------------------------------------- trajectories


def gae_advantages(spark: SparkSession, sf: str) -> DataFrame:
    """L-08: action-level GAE (gamma = lambda = 0.95) and returns."""
    g = L.gae(X.trajectories(spark, sf), gamma=0.95, lam=0.95)
    return r6(g.select("traj_id", "step", "advantage", "ret"))


def ppo_losses(spark: SparkSession, sf: str) -> DataFrame:
    """L-12, L-13, L-14 per trajectory over GAE advantages."""
    g = L.gae(X.trajectories(spark, sf), gamma=0.95, lam=0.95)
    g = g.withColumn("v_new", F.col("v") + (F.col("event_id") % 7 - 3) / F.lit(10.0))
    pl = L.policy_losses(g, by=["traj_id"])
    vl = L.value_loss(g, v_new="v_new", v_old="v", ret="ret", by=["traj_id"])
    return r6(pl.join(vl, "traj_id"))


def episode_summary(spark: SparkSession, sf: str) -> DataFrame:
    """L-21: mean step reward and mean reward of finishing steps per trajectory. Rewards are taken
    in integer cents (event values have two decimals) so every engine sums them exactly in any
    order; a mean of two-decimal values over a power-of-two count is otherwise an exact decimal
    tie at the 6th decimal that float summation order decides."""
    t = X.trajectories(spark, sf).withColumn("reward", F.round(F.col("reward") * 100))
    st = L.episode_stats(t, by=["traj_id"])
    return r6(st.select("traj_id", *[(F.col(c) / F.lit(100.0)).alias(c) for c in ("mean_step_reward", "mean_episode_return")]))


# ----------------------------------------------------------------------------- loans: prep, sampling, encoding


SEED = 10086


def _final_loans(spark: SparkSession, sf: str) -> DataFrame:
    return PR.filter_status(X.loans(spark, sf), status="loan_status")


def loan_features(spark: SparkSession, sf: str) -> DataFrame:
    """S-02, P-01, P-02, P-03: final-status loans with every feature present, display names."""
    return PR.drop_incomplete(PR.select_loan_features(_final_loans(spark, sf), keep=["id"]))


def _final_statuses(spark: SparkSession, sf: str) -> DataFrame:
    return PR.filter_status(X.loan_statuses(spark, sf), status="loan_status")


def loan_split(spark: SparkSession, sf: str) -> DataFrame:
    """M-02 (with P-06): exact 70 / 10 / 20 split in md5 order."""
    return M.split_three(_final_statuses(spark, sf).select("id"), 0.7, 0.1, key="id", seed=SEED)


def _with_split(spark: SparkSession, sf: str, loans: DataFrame) -> DataFrame:
    """The rows of ``loan_split`` in ``loans``, tagged by their own id."""
    return M.split_three(loans, 0.7, 0.1, key="id", seed=SEED, of=_final_statuses(spark, sf).select("id"))


def loan_stratified(spark: SparkSession, sf: str) -> DataFrame:
    """M-01: 1 % per status, md5 order."""
    return M.stratified_sample(X.loan_statuses(spark, sf), "loan_status", 0.01, key="id", seed=SEED)


def loan_balanced_test(spark: SparkSession, sf: str) -> DataFrame:
    """M-03: every 'Charged Off' row of the test split and as many 'Fully Paid' rows."""
    test = M.split_three(_final_statuses(spark, sf), 0.7, 0.1, key="id", seed=SEED).filter("split = 'test'").drop("split")
    positives = test.filter("loan_status = 'Charged Off'").count()
    return M.balance_to_total(test, "loan_status", "Charged Off", total=2 * positives, key="id", seed=SEED)


def loan_undersample(spark: SparkSession, sf: str) -> DataFrame:
    """M-04: every status cut to the smallest status count."""
    return M.undersample(X.loan_statuses(spark, sf), "loan_status", key="id", seed=SEED)


def loan_few_shot(spark: SparkSession, sf: str) -> DataFrame:
    """M-07 / M-08: 8 training examples (top-k in md5 order)."""
    tr = loan_split(spark, sf).filter(F.col("split") == "train")
    return M.few_shot(tr.select("id"), 8, key="id", seed=SEED)


def loan_holdout(spark: SparkSession, sf: str) -> DataFrame:
    """M-09: first ceil(10 %) in md5 order is the evaluation part."""
    return M.holdout(_final_statuses(spark, sf).select("id"), "first_frac", 0.1, key="id", seed=SEED)


def loan_holdout_modes(spark: SparkSession, sf: str) -> DataFrame:
    """M-09: the other modes: the last 100 in id order, an md5 fraction, an evaluation sample that overlaps train."""
    ids = _final_statuses(spark, sf).select("id")
    modes = [("last_n", 100, ["id"]), ("fraction", 0.1, ()), ("overlap", 100, ())]
    parts = [M.holdout(ids, m, size, key="id", seed=SEED, order=order).withColumn("mode", F.lit(m)) for m, size, order in modes]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def loan_set_ops(spark: SparkSession, sf: str) -> DataFrame:
    """J-01, J-03, J-04: tagged union of train and the rest; rest = anti-join of train ids."""
    split = loan_split(spark, sf)
    loans = _final_statuses(spark, sf)
    train_ids = split.filter(F.col("split") == "train").select("id")
    train = PR.semi_ids(loans, train_ids, "id")
    rest = PR.except_ids(loans, train_ids, "id")
    return PR.union_tagged(train, rest).select("id", "loan_status", F.col("_side").alias("side"))


def event_batches(spark: SparkSession, sf: str) -> DataFrame:
    """M-11: contiguous mini-batches of 64 events in id order and shuffled batches (last dropped)."""
    ev = X.load(spark, sf, "events").select("event_id")
    a = M.minibatches(ev, 64, ["event_id"]).withColumnRenamed("batch", "batch_contiguous")
    b = M.minibatches(ev, 64, ["event_id"], shuffled=True, key="event_id", seed=SEED).withColumnRenamed("batch", "batch_shuffled")
    return a.join(b, "event_id", "left")


def order_parts(spark: SparkSession, sf: str) -> DataFrame:
    """S-09 and S-10: 7 near-equal parts and parts of 1000 in order-key order."""
    o = X.load(spark, sf, "orders").select("o_orderkey")
    a = M.split_even(o, 7, ["o_orderkey"]).withColumnRenamed("part", "part_even")
    b = M.split_chunks(o, 1000, ["o_orderkey"]).withColumnRenamed("part", "part_chunk")
    return a.join(b, "o_orderkey")


def replicated_prompts(spark: SparkSession, sf: str) -> DataFrame:
    """J-07: 10 generations per prompt (order), batches of 4."""
    return PR.replicate(X.load(spark, sf, "orders").select("o_orderkey"), 10, 4)


def verdict_spellings(spark: SparkSession, sf: str) -> DataFrame:
    """J-09: 27 spellings of every verdict word found in the answers."""
    words = X.answers(spark, sf).select(F.col("expected").alias("word")).distinct()
    return PR.verdict_variants(words).select("word", "number", "variant")


def verdict_tokens(spark: SparkSession, sf: str) -> DataFrame:
    """J-09: the raw verdict tail of every answer, looked up among the spellings of both words."""
    a = X.answers(spark, sf).select(*X.LINE_KEY, F.regexp_extract("response", r"(?i)assessment\**:([^\n]*)", 1).alias("token"))
    return PR.verdict_lookup(a, "token")


def loan_cardinality(spark: SparkSession, sf: str) -> DataFrame:
    """F-02, F-03: distinct values per category column."""
    d = PR.select_loan_features(_final_loans(spark, sf))
    return FE.cardinalities(d, FE.category_columns(d))


def loan_subset(spark: SparkSession, sf: str) -> DataFrame:
    """P-04, P-05: final loans with an employment length, without the label."""
    return PR.features_only(PR.drop_incomplete(PR.select_loan_features(_final_loans(spark, sf), keep=["id"]), cols=["Employment Length"]))


def attached_outputs(spark: SparkSession, sf: str) -> DataFrame:
    """J-05: every candidate answer with its prompt's columns."""
    prompts = X.load(spark, sf, "orders").select(F.col("o_orderkey").alias("prompt_id"), "o_orderpriority", "o_custkey")
    outputs = X.candidates(spark, sf).select("prompt_id", "pos", "pred_label", F.md5("response").alias("response_md5"))
    return PR.attach(prompts, outputs, on="prompt_id")


def loan_label_map(spark: SparkSession, sf: str) -> DataFrame:
    """F-05, F-09: value -> code tables (sorted values, NULL last) of every category column."""
    d = PR.select_loan_features(_final_loans(spark, sf))
    return FE.label_mapping(d, FE.category_columns(d))


def loan_encoded(spark: SparkSession, sf: str) -> DataFrame:
    """F-01, F-04, F-05, F-06 (threshold 20, fitted on train and test together): every column of both sides."""
    d = _with_split(spark, sf, PR.select_loan_features(_final_loans(spark, sf), keep=["id"]))
    tr, te, _ = FE.encode_categories(d.filter("split = 'train'").drop("split"), d.filter("split = 'test'").drop("split"), threshold=20)
    return tr.withColumn("side", F.lit("train")).unionByName(te.withColumn("side", F.lit("test")))


#: The numeric raw columns.
NUMERIC_FEATURES = [
    "installment", "int_rate", "last_pymnt_amnt", "loan_amnt", "revol_bal", "delinq_2yrs", "inq_last_6mths", "mort_acc", "open_acc", "revol_util", "total_acc",
    "fico_range_low", "fico_range_high", "annual_inc",
]


def loan_standardized(spark: SparkSession, sf: str) -> DataFrame:
    """F-08: z-scores (sample std) of every numeric column."""
    d = _final_loans(spark, sf).select("id", *NUMERIC_FEATURES)
    return r6(FE.standardize(d, NUMERIC_FEATURES, suffix="_z").drop(*NUMERIC_FEATURES))


# ----------------------------------------------------------------------------- prompts



def prior_prompts(spark: SparkSession, sf: str) -> DataFrame:
    """T-01, T-02, P-07, P-08, P-09: prompt records of the complete final-status loans."""
    d = loan_features(spark, sf)
    feats = PR.DISPLAY_NAMES[:-1]
    text = T.render_prior_text(d, feats)
    g = PR.with_gold(d.select("id", "Loan Status", *[F.col(f"`{f}`") for f in feats], text.alias("text")))
    return g.select(
        "id",
        "text",
        T.render_prior_query("text").alias("query"),
        "answer",
        "gold",
        F.array_join("choices", ",").alias("choices"),
        PR.label_word("choices", "gold").alias("label_word"),
    )


def posterior_prompts(spark: SparkSession, sf: str) -> DataFrame:
    """T-03, T-04: posterior prompts with a model's probabilities in percent."""
    d = loan_features(spark, sf)
    feats = PR.DISPLAY_NAMES[:-1]
    k = (F.col("`Fico Range Low`").cast("int") * 7 + F.col("`Open Accounts`").cast("int") * 13) % 1000
    d = d.withColumn("bad_prob", k / F.lit(1000.0)).withColumn("good_prob", (F.lit(1000) - k) / F.lit(1000.0))
    text = T.render_posterior_text(d, feats)
    q, qc = T.render_posterior_query(text, "Random Forest", "good_prob", "bad_prob")
    return d.select("id", text.alias("text"), q.alias("query"), qc.alias("query_cot"))


COT_INSTRUCTION = "Please analyse the credit report step by step.\n" + T.INTRO_CREDIT_REPORT
COT_EXPLANATIONS = "Feature notes: rates are in percent.\n"


def cot_messages(spark: SparkSession, sf: str) -> DataFrame:
    """T-05, T-06: CoT prompt (with feature explanations) and [system, user] messages."""
    p = posterior_prompts(spark, sf)
    prompt = T.cot_prompt("query_cot", COT_INSTRUCTION, COT_EXPLANATIONS)
    m = T.chat_messages(prompt)
    return p.select(
        "id",
        F.md5(prompt).alias("prompt_md5"),
        F.size(m).alias("n_messages"),
        m[0]["role"].alias("first_role"),
        F.md5(m[1]["content"]).alias("user_md5"),
    )


def conversation_records(spark: SparkSession, sf: str) -> DataFrame:
    """T-07, T-08, T-19: ordered conversations, leading non-user turn dropped, turn loss weights."""
    c = T.to_conversations(X.load(spark, sf, "conversations"))
    t = c.select("conv_id", T.trim_leading_turn("conversations").alias("conv"))
    return t.select(
        "conv_id",
        F.size("conv").alias("n_turns"),
        F.try_element_at("conv", F.lit(1))["from"].alias("first_from"),
        F.array_join(T.turn_mask("conv"), ",").alias("turn_mask"),
    )


def conversation_masks(spark: SparkSession, sf: str) -> DataFrame:
    """T-19: input and target arrays of every conversation, padded or cut to the 2,048 places of the trainer; ``conversation_masks_whole`` has the whole ones."""
    c = T.to_conversations(X.load(spark, sf, "conversations"))
    given, wanted = T.sft_arrays(T.trim_leading_turn("conversations"), "You judge credit risk", 2048)
    return c.select("conv_id", F.md5(F.array_join(given, "|")).alias("input_md5"), F.md5(F.array_join(wanted, "|")).alias("target_md5"))


def conversation_masks_whole(spark: SparkSession, sf: str) -> DataFrame:
    """T-19: input and target arrays of every whole conversation, with every turn, uncut and unpadded."""
    c = T.to_conversations(X.load(spark, sf, "conversations"))
    given, wanted = T.sft_arrays(T.trim_leading_turn("conversations"), "You judge credit risk", None)
    return c.select("conv_id", F.size(given).alias("n_places"), F.md5(F.array_join(given, "|")).alias("input_md5"), F.md5(F.array_join(wanted, "|")).alias("target_md5"))


def doc_steps(spark: SparkSession, sf: str) -> DataFrame:
    """T-09, T-10, T-11, T-12, T-16 on whole documents (steps are lines); ``doc_step_tags`` has T-10 for every line and the whole text."""
    d = X.load(spark, sf, "documents").select("doc_id", "text")
    first, rest = S.split_observation(F.col("text"))
    steps = S.split_steps("text", "\n")
    return d.select(
        "doc_id",
        F.size(steps).alias("n_steps"),
        word_count("text").alias("n_words"),
        F.md5(S.join_steps(steps, S.STEP_TAG)).alias("joined_md5"),
        F.md5(S.ensure_step_tag(F.concat(F.substring_index("text", "\n", 1), F.lit(".\n\n")))).alias("tagged_md5"),
        F.md5(S.mark_steps("text", "\n")).alias("marked_md5"),
        F.length(first).alias("obs_head_len"),
        F.length(rest).alias("obs_tail_len"),
    )


def doc_step_tags(spark: SparkSession, sf: str) -> DataFrame:
    """T-10 on every whole document, and on each of its steps (lines) with the ending that it has."""
    d = X.load(spark, sf, "documents").select("doc_id", "text")
    steps = S.steps_with_endings("text")
    return d.select(
        "doc_id",
        F.size(steps).alias("n_steps"),
        F.md5(S.ensure_step_tag("text")).alias("tagged_md5"),
        F.md5(F.array_join(F.transform(steps, lambda x: S.ensure_step_tag(x)), "")).alias("step_tagged_md5"),
    )


# ----------------------------------------------------------------------------- process-reward data



def question_mixed(spark: SparkSession, sf: str) -> DataFrame:
    """G-01: questions with both correct and incorrect rollouts."""
    return G.mixed_questions(X.rollouts(spark, sf))


def node_mc(spark: SparkSession, sf: str) -> DataFrame:
    """G-02, G-03 (class), G-04 (distinct incorrect rollouts per node)."""
    r = X.rollouts(spark, sf)
    mc = G.mc_values(r)
    inc = G.incorrect_rollouts(r).groupBy("question_id", "node_id").agg(F.count(F.lit(1)).alias("n_incorrect"))
    return r6(mc.join(inc, ["question_id", "node_id"], "left").withColumn("n_incorrect", F.coalesce("n_incorrect", F.lit(0))))


def _tree(spark: SparkSession, sf: str, rollouts: DataFrame | None = None) -> DataFrame:
    """Nodes with prefix and MC; the numbered rollouts are made once."""
    rollouts = X.rollouts(spark, sf) if rollouts is None else rollouts
    nodes = X.nodes_of(rollouts)
    paths = G.full_paths(nodes).select("question_id", "node_id", F.col("path").alias("prefix"))
    mc = G.mc_values(rollouts).select("question_id", "node_id", "mc")
    return nodes.join(paths, ["question_id", "node_id"]).join(mc, ["question_id", "node_id"])


def tree_export(spark: SparkSession, sf: str) -> DataFrame:
    """T-13, T-14, G-11, G-12: root-to-node prefixes, edge texts, flat per-question export."""
    t = materialized(_tree(spark, sf).select("question_id", "node_id", "parent_id", "seq", "prefix", "mc"), "tree")  # read four times
    edges = G.tree_edges(t).select("question_id", "node_id", F.md5("text").alias("edge_md5"))
    flat = G.collect_prefixes(t).select(
        "question_id",
        F.size("reasoning_steps_text").alias("n_prefixes"),
        F.md5(F.array_join(F.transform("reasoning_steps_text", lambda x: F.concat(x["solution_prefix"], F.lit("|"), F.round(x["mc_value"] * 1000).cast("long").cast("string"))), "#")).alias("export_md5"),
    )
    return t.select("question_id", "node_id", F.md5("prefix").alias("prefix_md5")).join(edges, ["question_id", "node_id"]).join(flat, "question_id")


def flattened_prefixes(spark: SparkSession, sf: str) -> DataFrame:
    """P-15, P-16: the nested export flattened again, inside the MC bands."""
    flat = G.select_by_mc(G.flatten_prefixes(G.collect_prefixes(_tree(spark, sf))))
    return r6(flat.select("question_id", "pos", F.md5("solution_prefix").alias("prefix_md5"), "mc_value"))


def expanded_children(spark: SparkSession, sf: str) -> DataFrame:
    """G-03: correct rollouts of mixed nodes become children with MC 1."""
    r = X.rollouts(spark, sf)
    t = _tree(spark, sf, r)
    ch = G.expand_correct(t, r, G.mc_values(r))
    return ch.select("question_id", "parent_id", "pos", F.md5("prefix").alias("prefix_md5"), "mc")


def next_selection(spark: SparkSession, sf: str) -> DataFrame:
    """T-16, G-05, G-06, G-07: Q + U score of every incorrect rollout; best per question."""
    every = X.rollouts(spark, sf)
    r = every.filter(~F.col("correct"))
    nodes = G.u_values(X.nodes_of(every), c_puct=0.125)
    mc = G.mc_values(every).select("question_id", "node_id", "mc")
    pool = (
        r.join(mc, ["question_id", "node_id"])
        .join(nodes.select("question_id", "node_id", "u"), ["question_id", "node_id"])
        .withColumn("score", G.q_value("mc", G.word_count("rollout"), 0.5, 0.9, 500) + F.col("u"))
        .select("question_id", "node_id", F.col("pos").alias("seq"), "score")
    )
    return r6(G.select_next(pool))


def latest_pool(spark: SparkSession, sf: str) -> DataFrame:
    """G-08: newest pool entry per (question, node, rollout text)."""
    r = X.rollouts(spark, sf).select("question_id", "node_id", "rollout", F.col("pos").alias("seq"), (F.col("pos") * 10).alias("priority"))
    return G.latest_priority(r)


def first_error(spark: SparkSession, sf: str) -> DataFrame:
    """G-09: first node (step) whose MC is 0 per question."""
    mc = G.mc_values(X.rollouts(spark, sf)).select(F.col("question_id").alias("solution_id"), F.col("node_id").alias("step"), "mc")
    return G.first_error_step(mc)


def budget_cut(spark: SparkSession, sf: str) -> DataFrame:
    """G-10: rollouts kept while the per-question running cost stays within 4."""
    r = X.rollouts(spark, sf).withColumn("cost", F.col("pos") % 3 + 1)
    return G.within_budget(r, "cost", 4, seq="pos").select("question_id", "pos", "cost")


def step_dataset(spark: SparkSession, sf: str) -> DataFrame:
    """P-16, T-15, G-13, G-14: labelled step records from document prefixes: every negative and half of the positives."""
    prefixes = X.doc_prefixes(spark, sf)
    neg, pos = G.select_by_mc(prefixes).agg(F.count(F.when(F.col("mc_value") != 1.0, 1)), F.count(F.when(F.col("mc_value") == 1.0, 1))).first()
    d = G.build_step_dataset(prefixes, neg + pos // 2, key="doc_id", seed=42, tag="\n")
    return r6(
        d.select(
            "doc_id",
            "mc_value",
            F.size("label").alias("n_labels"),
            F.element_at("label", -1).alias("last_label"),
            F.size(S.split_steps("reasoning_steps", "\n")).alias("n_parts"),
            F.md5("reasoning_steps").alias("steps_md5"),
        )
    )


def step_pipeline(spark: SparkSession, sf: str) -> DataFrame:
    """S-05, P-15, P-16, G-13, G-14, S-07 as one job: nested exports in part folders are merged and flattened, the step data is
    built, saved as records and read back. The same rows as ``step_dataset``."""
    import uuid

    from ..session import checkpoint_path
    from ..sources import files as IO

    base = checkpoint_path(spark, f"steps-{uuid.uuid4().hex}")
    item = F.struct("doc_id", "solution_prefix", "mc_value")
    nested = X.doc_prefixes(spark, sf).groupBy("question").agg(F.collect_list(item).alias("reasoning_steps_text"))
    IO.write_parts(nested.withColumn("part", F.pmod(F.xxhash64("question"), F.lit(4))), f"{base}/parts")
    item_type = "struct<doc_id: bigint, solution_prefix: string, mc_value: double>"
    merged = IO.read_parts(spark, [f"{base}/parts"], T_.StructType.fromDDL(f"question string, reasoning_steps_text array<{item_type}>"))
    flat = merged.select("question", F.explode("reasoning_steps_text").alias("_x")).select("question", "_x.*")
    flat = materialized(flat, "prefixes")
    neg, pos = G.select_by_mc(flat).agg(F.count(F.when(F.col("mc_value") != 1.0, 1)), F.count(F.when(F.col("mc_value") == 1.0, 1))).first()
    IO.write_records(G.build_step_dataset(flat, neg + pos // 2, key="doc_id", seed=42, tag="\n"), f"{base}/steps.jsonl")
    saved = IO.read_records(spark, f"{base}/steps.jsonl", T_.StructType.fromDDL("doc_id bigint, mc_value double, reasoning_steps string, label array<int>"))
    return r6(saved.select("doc_id", "mc_value", F.size("label").alias("n_labels"), F.element_at("label", -1).alias("last_label"),
                           F.size(S.split_steps("reasoning_steps", "\n")).alias("n_parts"), F.md5("reasoning_steps").alias("steps_md5")))


def record_files(spark: SparkSession, sf: str) -> DataFrame:
    """S-03, S-04, S-05: orders as JSON lines in a folder a priority, some lines broken, and as one array a file; records, bad
    records and the total of the good ones for every folder."""
    import uuid

    from ..session import checkpoint_path
    from ..sources import files as IO

    base = checkpoint_path(spark, f"records-{uuid.uuid4().hex}")
    o = X.load(spark, sf, "orders").select("o_orderkey", "o_custkey", F.substring("o_orderpriority", 1, 1).alias("part"))
    line = F.to_json(F.struct("o_orderkey", "o_custkey"))
    torn = F.when(F.col("o_orderkey") % 50 == 0, F.substring(line, 1, 12)).otherwise(line)
    o.select(torn.alias("value"), "part").write.partitionBy("part").text(f"{base}/lines")
    array = o.groupBy("part", F.pmod("o_orderkey", F.lit(64)).alias("k")).agg(F.to_json(F.collect_list(F.struct("o_orderkey", "o_custkey"))).alias("value"))
    array.select(F.when(F.col("k") % 16 == 0, F.substr("value", F.lit(1), F.length("value") - 3)).otherwise(F.col("value")).alias("value"), F.concat("part", F.lit("-"), "k").alias("part")).write.partitionBy("part").text(f"{base}/arrays.json")
    schema, out = T_.StructType.fromDDL("o_orderkey bigint, o_custkey bigint"), []
    for kind in ("lines", "arrays.json"):
        checked = materialized(IO.read_checked(spark, [f"{base}/{kind}"], schema), "checked")
        folder = F.regexp_extract("source_file", "part=([0-9])", 1)
        counts = IO.file_report(checked).groupBy(folder.alias("part")).agg(F.sum("records").alias("records"), F.sum("bad_records").alias("bad_records"))
        totals = IO.good_records(checked).groupBy(folder.alias("part")).agg(F.sum("o_custkey").alias("customers"))
        out.append(counts.join(totals, "part").withColumn("kind", F.lit(kind)))
    return out[0].unionByName(out[1])


def append_retry(spark: SparkSession, sf: str) -> DataFrame:
    """S-08: finished units appended in three batches, one of them tried twice (first with half of its rows); what is there afterwards."""
    import uuid

    from ..session import checkpoint_path
    from ..sources import files as IO

    path = checkpoint_path(spark, f"append-{uuid.uuid4().hex}")
    o = X.load(spark, sf, "orders").select("o_orderkey", "o_orderstatus", "o_orderpriority")
    for status in ("F", "O", "P"):
        units = o.filter(F.col("o_orderstatus") == status)
        if status == "O":
            IO.append_batch(units.filter(F.col("o_orderkey") % 2 == 0), path, status)
        IO.append_batch(units, path, status)
    back = spark.read.schema("o_orderkey bigint, o_orderstatus string, o_orderpriority string, batch string").json(path)
    return back.groupBy("batch", "o_orderpriority").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("o_orderkey").alias("n_units"))


def hard_subset(spark: SparkSession, sf: str) -> DataFrame:
    """P-10, P-11, G-15: every incorrect candidate and as many correct ones (miss counts as correct)."""
    # stored: counted, cut and joined several times, and the answers should be parsed once
    c = materialized(X.candidates(spark, sf).select("prompt_id", "pos", "pred_label", "label"), "candidates")
    h = G.build_hard_subset(c, key=["prompt_id", "pos"], seed=3)
    kept = PR.keep_correct(c).select("prompt_id", "pos").withColumn("strict_ok", F.lit(1))
    return h.join(kept, ["prompt_id", "pos"], "left").select("prompt_id", "pos", "_ok", F.coalesce("strict_ok", F.lit(0)).alias("strict_ok"))


# ----------------------------------------------------------------------------- token arrays (embeddings)

PAD, EOS, TAG = 12, 13, 11


def _tokens(spark: SparkSession, sf: str) -> DataFrame:
    e = X.load(spark, sf, "embeddings")
    toks = F.transform("embedding", lambda x: (F.floor(x.cast("double") * 20) + 12).cast("int"))
    return e.select("vec_id", (F.col("label") % 2).alias("label"), "embedding", toks.alias("tokens"))


def embedding_tokens(spark: SparkSession, sf: str) -> DataFrame:
    """T-17, T-18, T-21 ... T-24, R-11 on token arrays."""
    t = _tokens(spark, sf)
    padded, att = S.pad_truncate("tokens", 80, PAD)
    pa, _ = P.softmax2(F.col("embedding")[0].cast("double"), F.col("embedding")[1].cast("double"))
    return r6(
        t.select(
            "vec_id",
            F.array_join(S.left_truncate("tokens", 16), ",").alias("left16"),
            F.array_join(padded, ",").alias("padded"),
            F.aggregate(att, F.lit(0), lambda a, x: a + x).alias("n_attended"),
            F.array_join(S.find_all("tokens", TAG), ",").alias("tag_positions"),
            S.find_subsequence("tokens", [TAG, TAG + 1]).alias("first_pair"),
            S.last_non_pad("tokens", PAD).alias("last_real"),
            F.aggregate(S.eos_mask("tokens", EOS), F.lit(0), lambda a, x: a + x).alias("eos_kept"),
            pa.alias("p_first"),
        )
    )


def embedding_step_labels(spark: SparkSession, sf: str) -> DataFrame:
    """T-20: step-token labels at tag positions."""
    t = _tokens(spark, sf)
    labels = F.transform(S.find_all("tokens", TAG), lambda i, k: (F.col("vec_id") + k) % 2)
    lbl, att = S.step_token_labels("tokens", TAG, labels, 100, 200)
    return t.select("vec_id", F.array_join(lbl, ",").alias("labels"), F.array_join(att, ",").alias("attention"))


def embedding_token_metrics(spark: SparkSession, sf: str) -> DataFrame:
    """E-13: AUC, log-loss and accuracy of a per-vector probability."""
    t = _tokens(spark, sf).withColumn("prob", F.lit(1.0) / (F.lit(1.0) + F.exp(-F.col("embedding")[1].cast("double") * 10)))
    return r6(E.token_metrics(t, label="label", prob="prob"))


def _token_rows(spark: SparkSession, sf: str) -> DataFrame:
    t = _tokens(spark, sf)
    x = t.select("vec_id", "label", S.last_non_pad("tokens", PAD).alias("last_pos"), F.posexplode("embedding").alias("pos", "x"))
    return x.withColumn("x", F.col("x").cast("double"))


def sequence_logprobs(spark: SparkSession, sf: str) -> DataFrame:
    """L-19: sequence log-prob up to the last real token and mean entropy."""
    x = _token_rows(spark, sf).withColumn("logp", -F.abs("x")).withColumn("entropy", F.col("x") * F.col("x"))
    return r6(L.sequence_logp(x, seq="vec_id"))


def grpo_token_loss(spark: SparkSession, sf: str) -> DataFrame:
    """L-15 ... L-18: token-masked policy loss, KL to reference, group policy loss, lengths."""
    x = _token_rows(spark, sf)
    x = (
        x.withColumn("advantage", (F.col("label") * 2 - 1) * F.lit(0.5))
        .withColumn("logp", -F.abs("x"))
        .withColumn("ref_logp", -F.abs("x") - F.col("pos") / F.lit(1000.0))
        .withColumn("mask", (F.col("pos") <= F.col("last_pos")).cast("int"))
        .withColumn("entropy", F.col("x") * F.col("x"))
    )
    g = L.grpo_loss(x, seq="vec_id", beta=0.001)
    p = L.policy_losses(x, logp_new="logp", logp_old="ref_logp", mask="mask")
    return r6(g.crossJoin(p))


def token_gae(spark: SparkSession, sf: str) -> DataFrame:
    """L-09: token-level GAE; step t has (event_id % 3) + 1 tokens, token values v + k / 100."""
    t = X.trajectories(spark, sf)
    tok = t.select("*", F.explode(F.sequence(F.lit(0), (F.col("event_id") % 3).cast("int"))).alias("token")).withColumn(
        "v", F.col("v") + F.col("token") / F.lit(100.0)
    )
    g = L.gae_tokens(tok.drop("next_value"), gamma=0.95, lam=0.95)
    return r6(g.select("traj_id", "step", "token", "advantage", "ret"))


def batch_normalized(spark: SparkSession, sf: str) -> DataFrame:
    """M-11 + L-11: GAE advantages normalised inside contiguous mini-batches of 32."""
    g = L.gae(X.trajectories(spark, sf))
    b = M.minibatches(g, 32, ["traj_id", "step"])
    return r6(L.normalize_batch(b, adv="advantage", batch="batch").select("traj_id", "step", "batch", "adv_norm"))


def continuation(spark: SparkSession, sf: str) -> DataFrame:
    """L-22: mask 0 for an order (step) whose lines (agents) are all done (returned)."""
    li = X.load(spark, sf, "lineitem").select("l_orderkey", (F.col("l_returnflag") == "R").alias("done"))
    return L.continuation_mask(li, ["l_orderkey"])


# ----------------------------------------------------------------------------- models, explanations (rows-only checks)


#: The registered search: at least two values of every parameter (the default is the full reference grid).
GRIDS = {
    "Logistic Regression": {"C": [0.1, 1], "penalty": ["l1", "l2"]},
    "Random Forest": {"n_estimators": [5, 10], "max_depth": [3, 5], "min_samples_split": [2, 10]},
    "Boosted Trees": {"max_depth": [2, 3], "learning_rate": [0.1, 0.2], "n_estimators": [3, 5], "scale_pos_weight": [1, 5]},
    "Leafwise Trees": {"num_leaves": [4, 8], "learning_rate": [0.2], "n_estimators": [3], "min_child_samples": [10, 30]},
    "Naive Bayes": {},
}


def _model_tables(spark: SparkSession, sf: str, raw: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Train and test rows with all 21 features encoded, complete rows only. The complete rows are stored once, in a folder a split; the encoding is
    arithmetic on them. With ``raw`` a column of that name has the row's features as they were."""
    # stored here: the constraints of a NULL filter over 22 columns stall the planner later
    complete = PR.drop_incomplete(PR.select_loan_features(_final_loans(spark, sf), keep=["id"]))
    d = materialized(_with_split(spark, sf, complete).filter("split <> 'dev'"), "complete", by="split")
    if raw:
        d = d.withColumn(raw, F.struct(*[FE.quoted(c) for c in PR.DISPLAY_NAMES[:-1]]))
    tr, te, _ = FE.encode_categories(d.filter("split = 'train'").drop("split"), d.filter("split = 'test'").drop("split"), threshold=20, stored=True)
    tr, te = (x.withColumnRenamed("Loan Status", "label") for x in (tr, te))
    return tr, te


def _assembled(df: DataFrame, keep: list[str] = []) -> DataFrame:  # noqa: B006
    return materialized(FE.assemble(df, exclude=["label", "id"]).select("id", "label", "features", *keep), "features")


def model_benchmark(spark: SparkSession, sf: str) -> DataFrame:
    """F-10, J-08, A-01 ... A-07: logistic regression, random forest, both boosted trees, naive Bayes with a
    stratified 3-fold grid search; per model the metrics on the test split, the best parameters and their fold score."""
    tr, te = _model_tables(spark, sf)
    m, _ = ML.benchmark_models(_assembled(tr), _assembled(te), GRIDS)
    return r6(m)


#: Parameters as a search has stored them, one set a model.
STORED = {
    "Logistic Regression": {"C": 1, "penalty": "l1"},
    "Random Forest": {"n_estimators": 10, "max_depth": 5, "min_samples_split": 2},
    "Boosted Trees": {"max_depth": 3, "learning_rate": 0.2, "n_estimators": 5, "scale_pos_weight": 1, "min_child_weight": 5, "subsample": 1.0},
    "Leafwise Trees": {"num_leaves": 8, "learning_rate": 0.2, "n_estimators": 5, "min_child_samples": 20},
    "Naive Bayes": {},
}


def posterior_scores(spark: SparkSession, sf: str) -> DataFrame:
    """A-07, A-08, A-09, M-03: all five models score both splits, fitted from their stored parameters; of
    the test split, every positive and as many md5-sampled negatives; with their posterior prompts."""
    # the features as they were stay with their row, so that the texts need no join
    trf, tef = (_assembled(x, ["raw"]) for x in _model_tables(spark, sf, raw="raw"))
    positives = tef.filter("label = 1").count()
    chosen = M.balance_to_total(tef, "label", 1, total=2 * positives, key="id", seed=SEED)

    def told(df: DataFrame) -> DataFrame:
        feats = df.select("id", "label", "features", "raw.*")
        return feats.select("id", "label", "features", T.render_posterior_text(feats, PR.DISPLAY_NAMES[:-1]).alias("text"))

    out = ML.score_both(STORED, told(trf), told(chosen), keep=["text"])
    q, qc = T.render_posterior_query(F.col("text"), F.col("model"), "good_prob", "bad_prob")
    return r6(out.select("id", "side", "model", "label", "good_prob", "bad_prob", F.md5(q).alias("query_md5"), F.md5(qc).alias("query_cot_md5")))


#: The rows to explain, as a user states them: defaults-prone loans at the top rate.
EXPLAINED = "`Interest Rate` = 10 AND `Delinquency In 2 years` >= 5"


def _explain_rows(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Train rows, the test rows to explain, and 50 background rows."""
    tr, te = _model_tables(spark, sf)
    return tr, te.filter(EXPLAINED), materialized(M.few_shot(tr, 50, key="id", seed=SEED), "background")


def linear_attribution(spark: SparkSession, sf: str) -> DataFrame:
    """A-10 (exact for linear models), A-11, A-12 over the whole test split."""
    tr, te = _model_tables(spark, sf)
    feats = [c for c in tr.columns if c not in ("id", "label")]
    points = _assembled(tr)
    lr = ML.logistic(1.0, "l2", points.count()).fit(points)
    w = [float(x) for x in lr.coefficients.toArray()]  # one weight per feature
    attr = A.linear_attributions(te, feats, w, tr)
    imp = materialized(A.importance(attr), "importance")  # one row a feature, read twice
    dep = A.dependence_table(attr, imp).groupBy("feature").agg(F.count(F.lit(1)).alias("n_points"), F.avg("attribution").alias("mean_attr"))
    return r6(imp.join(dep, "feature", "left"))


FIXED_WEIGHTS = {"int_rate": 0.05, "fico_range_low": -0.01, "delinq_2yrs": 0.2, "revol_util": 0.015, "open_acc": -0.02}


def linear_attribution_fixed(spark: SparkSession, sf: str) -> DataFrame:
    """A-10, A-11, A-12 of a linear score with given weights, over all final-status loans."""
    d = _final_loans(spark, sf).select("id", *FIXED_WEIGHTS)
    attr = A.linear_attributions(d, list(FIXED_WEIGHTS), list(FIXED_WEIGHTS.values()), d)
    imp = A.importance(attr)
    dep = A.dependence_table(attr, imp).groupBy("feature").agg(F.count(F.lit(1)).alias("n_points"), F.max("attribution").alias("max_attr"))
    return r6(imp.join(dep, "feature", "left"))


def shapley_sample(spark: SparkSession, sf: str) -> DataFrame:
    """A-10 (sampled Shapley, any model) for the test rows of the stated filter."""
    tr, rows, background = _explain_rows(spark, sf)
    feats = [c for c in tr.columns if c not in ("id", "label")]
    rf = ML.forest(20, 5).fit(_assembled(tr))
    return r6(A.sampled_shapley(rf, rows, feats, background, n_perm=4, key="id"))


def lime_surrogate(spark: SparkSession, sf: str) -> DataFrame:
    """A-13: local weighted ridge surrogate (200 perturbations) of the random forest, same rows."""
    tr, te = _model_tables(spark, sf)
    tr, rows = materialized(tr, "train"), te.filter(EXPLAINED)  # stored: read by the fit and by each step of the quartiles
    feats = [c for c in tr.columns if c not in ("id", "label")]
    rf = ML.forest(20, 5).fit(_assembled(tr))
    return r6(A.local_surrogate(A.model_score(rf), rows, A.quartile_stats(tr, feats), feats, n_samples=200, key="id"))


#: The logit of a fixed scorer, and the columns a surrogate sees.
SURROGATE_LOGIT, SURROGATE_COLUMNS = (0.08, 0.3, -0.9), ["int_rate", "delinq_2yrs"]


def _fixed_score(points: DataFrame) -> DataFrame:
    a, b, c = SURROGATE_LOGIT
    logit = F.lit(a) * F.col("_v")[0] + F.lit(b) * F.col("_v")[1] + F.lit(c)
    return points.withColumn("_y", F.lit(1.0) / (F.lit(1.0) + F.exp(-logit)))


def _surrogate_rows(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """All final loans, and those to explain: the stated filter."""
    d = _final_loans(spark, sf).select("id", *SURROGATE_COLUMNS)
    return d, d.filter("int_rate = 10 AND delinq_2yrs >= 5")


def lime_fixed(spark: SparkSession, sf: str) -> DataFrame:
    """A-13: surrogate of a fixed scorer on normal draws around the stated rows; statistics over all final loans."""
    d, rows = _surrogate_rows(spark, sf)
    return r6(A.local_surrogate(_fixed_score, rows, A.gaussian_stats(d, SURROGATE_COLUMNS), SURROGATE_COLUMNS, n_samples=40, key="id"))


def lime_quartiles(spark: SparkSession, sf: str) -> DataFrame:
    """A-13: the same on quartile buckets, of the two features only the one of the larger weight."""
    d, rows = _surrogate_rows(spark, sf)
    return r6(A.local_surrogate(_fixed_score, rows, A.quartile_stats(d, SURROGATE_COLUMNS), SURROGATE_COLUMNS, n_samples=40, key="id", top=1))


#: A small forest as a node table: (tree, id, left, right, feature, threshold, cover, value), features by their place in FOREST_COLUMNS.
FOREST_COLUMNS = ["int_rate", "fico_range_low", "delinq_2yrs"]
FIXED_FOREST = [
    (0, 0, 1, 2, 0, 5.0, 100.0, None), (0, 1, 3, 4, 1, 700.0, 60.0, None), (0, 3, None, None, None, None, 20.0, 0.5), (0, 4, None, None, None, None, 40.0, 0.1),
    (0, 2, 5, 6, 2, 2.0, 40.0, None), (0, 5, 7, 8, 0, 8.0, 30.0, None), (0, 7, None, None, None, None, 10.0, 0.3), (0, 8, None, None, None, None, 20.0, 0.7),
    (0, 6, None, None, None, None, 10.0, 0.9),
    (1, 0, 1, 2, 1, 650.0, 100.0, None), (1, 1, None, None, None, None, 25.0, 0.8), (1, 2, 3, 4, 2, 4.0, 75.0, None), (1, 3, None, None, None, None, 50.0, 0.2),
    (1, 4, 5, 6, 0, 3.0, 25.0, None), (1, 5, None, None, None, None, 5.0, 0.35), (1, 6, None, None, None, None, 20.0, 0.6),
]


def tree_attribution_fixed(spark: SparkSession, sf: str) -> DataFrame:
    """A-10 (tree-exact): Shapley values of a given forest for every final-status loan."""
    nodes = spark.createDataFrame(FIXED_FOREST, "tree int, id int, left int, right int, feature int, threshold double, cover double, value double")
    d = _final_loans(spark, sf)
    return r6(TR.tree_attributions(TR.leaf_paths(nodes), d, FOREST_COLUMNS, F.array(*FOREST_COLUMNS), key="id"))


def tree_attribution(spark: SparkSession, sf: str) -> DataFrame:
    """A-10 (tree-exact): a random forest's exact attributions for every test row; whether they sum to the probability less the base."""
    tr, te = _model_tables(spark, sf)
    feats = [c for c in tr.columns if c not in ("id", "label")]
    rf = ML.forest(10, 4).fit(_assembled(tr))
    points = _assembled(te)
    paths = TR.leaf_paths(TR.ensemble_nodes(rf))
    attr = TR.tree_attributions(paths, points, feats, vector_to_array("features"), key="id")
    total = attr.groupBy("id").agg(F.sum("attribution").alias("total"))
    scored = ML.predict_proba(rf, points).select("id", "bad_prob").crossJoin(F.broadcast(TR.base_value(paths)))  # one row
    return total.join(scored, "id").select("id", (F.abs(F.col("total") + F.col("base") - F.col("bad_prob")) < 1e-9).alias("sums"))


def _split_numbers(spark: SparkSession, sf: str) -> DataFrame:
    """Id, split, label and the 14 numeric features of every final-status loan."""
    d = _final_loans(spark, sf).withColumn("label", F.when(F.col("loan_status") == "Charged Off", 1).otherwise(0))
    return _with_split(spark, sf, d).select("id", "split", "label", *NUMERIC_FEATURES)


def bayes_probabilities(spark: SparkSession, sf: str) -> DataFrame:
    """A-04: closed-form Gaussian naive Bayes of the train split's numeric features; the probability of every test loan."""
    d = _split_numbers(spark, sf)
    moments = ML.class_moments(d.filter("split = 'train'"), NUMERIC_FEATURES)
    scored = ML.gaussian_bayes(moments, d.filter("split = 'test'"), NUMERIC_FEATURES, ["id", "label"])
    return r6(scored.select("id", "label", F.col("probabilities")[1].alias("bad_prob")))


def loan_folds(spark: SparkSession, sf: str) -> DataFrame:
    """A-05: three folds, stratified by status, of every final-status loan."""
    return ML.stratified_folds(_final_statuses(spark, sf), 3, key="id", label="loan_status", seed=SEED)


def logistic_optimum(spark: SparkSession, sf: str) -> DataFrame:
    """A-01: for every C and penalty of the grid, fitted to the standardised numeric features of the train split, whether each coefficient's slope is under 1e-3."""
    train = _split_numbers(spark, sf).filter("split = 'train'")
    scaled = FE.standardize(train.select("label", *NUMERIC_FEATURES), NUMERIC_FEATURES)
    points = materialized(FE.assemble(scaled, exclude=["label"]).select("label", "features"), "scaled")
    n, grid, out = points.count(), ML.REFERENCE_GRIDS["Logistic Regression"], []
    for c in grid["C"]:
        for penalty in grid["penalty"]:
            out.append((ML.logistic(c, penalty, n, max_iter=300, tol=1e-9).fit(points), c, penalty))
    found = ML.logistic_optima(out, points, NUMERIC_FEATURES)
    return found.select("c", "penalty", "feature", (F.abs("slope") < 1e-3).alias("optimal"))


FORMULA = "1 / (1 + exp(-(0.05 * int_rate - 0.01 * (fico_range_low - 650) + 0.2 * delinq_2yrs - 0.5)))"


#: Two logits of the classes, and a score that leaves 0 ... 1.
LOGITS = ["0.4 - 0.02 * int_rate + 0.01 * (fico_range_low - 700)", "0.05 * int_rate + 0.1 * delinq_2yrs - 0.3"]
ROUNDED = "0.25 * (int_rate - 4) + 0.5 * (delinq_2yrs - 2)"


def formula_logits(spark: SparkSession, sf: str) -> DataFrame:
    """A-14: two closed-form logits scored together; the larger is the class."""
    d = _final_loans(spark, sf).withColumn("label", F.when(F.col("loan_status") == "Charged Off", 1).otherwise(0))
    return r6(A.score_logits(d, LOGITS))


def formula_rounded(spark: SparkSession, sf: str) -> DataFrame:
    """A-14: a closed-form score rounded half to even; values other than 0 and 1 are wrong."""
    d = _final_loans(spark, sf).withColumn("label", F.when(F.col("loan_status") == "Charged Off", 1).otherwise(0))
    return r6(A.score_formula(d, ROUNDED, threshold=None))


def formula_accuracy(spark: SparkSession, sf: str) -> DataFrame:
    """A-14: closed-form score and its accuracy on the final-status loans."""
    d = _final_loans(spark, sf).withColumn("label", F.when(F.col("loan_status") == "Charged Off", 1).otherwise(0))
    return r6(A.score_formula(d, FORMULA))


# ----------------------------------------------------------------------------- user functions, streaming, files (rows-only)



def _keyword_scorer():
    def score(pdf):
        import pandas as pd

        seg = [s.lower().rsplit("final assessment", 1)[-1] for s in pdf["response"]]
        label = pd.array([0 if "good" in s else (1 if "bad" in s else None) for s in seg], dtype="Int32")
        return pd.DataFrame({"prompt_id": pdf["prompt_id"], "pos": pdf["pos"], "pred_label": label})

    return score


def batch_scorer(spark: SparkSession, sf: str) -> DataFrame:
    """U-01: a user scorer applied in Arrow batches of 64 (one load per task)."""
    c = X.candidates(spark, sf).select("prompt_id", "pos", "response")
    return U.score_partitions(c, _keyword_scorer, "prompt_id long, pos int, pred_label int", batch_size=64)


def _step_scorer():
    def score(texts):
        return texts.map(lambda t: [round((len(s) % 10) / 10.0, 6) for s in t.split("\n\n")])

    return score


def step_scorer(spark: SparkSession, sf: str) -> DataFrame:
    """U-03 + V-01 + L-20: user step scores -> min score and last-step reward per candidate."""
    from ..operators.rerank import solution_score

    c = X.candidates(spark, sf).select("prompt_id", "pos", "response")
    s = U.score_steps(c, _step_scorer, text="response", out="step_probs")
    return r6(s.select("prompt_id", "pos", solution_score("step_probs", "min").alias("score"), L.last_step_reward("step_probs").alias("last_reward")))


def stream_rewards(spark: SparkSession, sf: str) -> DataFrame:
    """K-01: answers written as completion logs, streamed through the reward expressions
    (available-now trigger) into a parquet sink, read back."""
    import uuid

    from ..session import checkpoint_path
    from ..streaming.rewards import run_reward_stream

    base = checkpoint_path(spark, f"stream-{uuid.uuid4().hex}")
    logs = X.answers(spark, sf).select(F.array("response").alias("completions"), F.array("expected").alias("label"))
    logs.write.mode("overwrite").json(f"{base}/logs")
    q = run_reward_stream(spark, f"{base}/logs", f"{base}/out", f"{base}/ckpt", available_now=True)
    q.awaitTermination()
    return spark.read.parquet(f"{base}/out")


def io_roundtrip(spark: SparkSession, sf: str) -> DataFrame:
    """S-01 ... S-12: loans through CSV, parquet and JSON-lines sinks and sources."""
    import uuid

    from ..session import checkpoint_path
    from ..sources import files as IO

    base = checkpoint_path(spark, f"io-{uuid.uuid4().hex}")
    loans = X.loans(spark, sf)
    loans.write.mode("overwrite").option("header", True).option("compression", "gzip").csv(f"{base}/csv")
    back = IO.read_loans(spark, f"{base}/csv")
    IO.write_parquet(back, f"{base}/parquet", partition_by=["grade"])
    pq = IO.read_parquet(spark, f"{base}/parquet")
    parts = M.split_chunks(pq.select("loan_status", "loan_amnt", "grade", F.md5(F.concat_ws("|", *[F.col(c).cast("string") for c in ("installment", "purpose", "loan_amnt")])).alias("rid")), 10000, ["rid"])
    IO.write_parts(parts, f"{base}/parts", compression="gzip")
    IO.append_records(parts.filter(F.col("loan_status") == "Current"), f"{base}/extra.jsonl", compression="gzip")
    IO.write_once(parts, f"{base}/once")
    IO.write_once(parts.limit(0), f"{base}/once")  # the output is there: nothing changes
    n_once = IO.read_parquet(spark, f"{base}/once").count()
    ids = IO.passed_ids(parts.withColumn("passed", F.col("loan_status") != "Current"), key="rid")
    IO.write_records(ids, f"{base}/ids.jsonl", compression="gzip")
    merged = IO.read_parts(spark, [f"{base}/parts"], T_.StructType.fromDDL("loan_status string, loan_amnt double, grade string, rid string, part int"))
    n_ids = IO.read_records(spark, f"{base}/ids.jsonl", T_.StructType.fromDDL("rid string")).count()
    return merged.groupBy("part", "loan_status").agg(F.count(F.lit(1)).alias("n")).withColumn("ids", F.lit(n_ids)).withColumn("once", F.lit(n_once))


def episode_done(spark: SparkSession, sf: str) -> DataFrame:
    """R-12: done flags of reasoning episodes (length window + verdict, or 30 steps)."""
    return L.flag_done(X.episodes(spark, sf)).select("traj_id", "step", "done")


def prediction_records(spark: SparkSession, sf: str) -> DataFrame:
    """P-14, J-05, J-06: raw prediction records ('miss' labels, [good, bad] probability pairs,
    truth under gold_label) normalised, attached to their prompts and prompt attributes."""
    c = X.candidates(spark, sf)
    raw = c.select(
        "prompt_id",
        "pos",
        F.coalesce(F.col("pred_label").cast("string"), F.lit("miss")).alias("pred_label"),
        F.array("good_prob", "bad_prob").alias("pred_prob"),
        F.col("label").alias("gold_label"),
    )
    norm = PR.normalize_predictions(raw)
    prompts = X.load(spark, sf, "orders").select(F.col("o_orderkey").alias("prompt_id"), F.col("o_orderpriority").alias("priority"))
    return r6(PR.with_prompt_attrs(norm, prompts, on="prompt_id").select("prompt_id", "pos", "pred_label", "label", "good_prob", "bad_prob", "priority"))


def nested_candidates(spark: SparkSession, sf: str) -> DataFrame:
    """V-03: candidates nested back per prompt in position order."""
    c = X.candidates(spark, sf).select("prompt_id", "pos", "pred_label")
    n = V.nest_candidates(c, name="cands")
    return n.select(
        "prompt_id",
        F.size("cands").alias("n"),
        F.array_join(F.transform("cands", lambda x: F.concat_ws(":", x["pos"].cast("string"), F.coalesce(x["pred_label"].cast("string"), F.lit("miss")))), ",").alias("cands"),
    )


def clean_coerce(spark: SparkSession, sf: str) -> DataFrame:
    """P-12, P-13: bracket characters in names become '_', text columns become numbers or NULL."""
    d = _final_loans(spark, sf).select(
        "id", F.col("loan_amnt").alias("Loan Amount [USD]"), F.col("grade").alias("<Grade>"), F.col("emp_length").alias("Employment Length")
    )
    return PR.coerce_numeric(PR.clean_names(d), exclude=["id"])


def shuffled_rewards(spark: SparkSession, sf: str) -> DataFrame:
    """M-06, U-02, U-04: answers in md5 order (hash-spread, sorted inside partitions), a
    vectorised Python reward (pandas UDF) added by a row map."""
    import pandas as pd

    def contains_label(c: pd.Series, lab: pd.Series) -> pd.Series:
        return pd.Series([1.0 if b in a.lower() else 0.0 for a, b in zip(c, lab)])

    reward = U.pandas_reward(contains_label)
    a = M.shuffle(X.answers(spark, sf), key=X.LINE_KEY[:4], seed=SEED)
    return U.map_rows(a.select(*X.LINE_KEY, "response", "expected"), {"response": F.md5("response"), "r_user": reward("response", "expected")}).drop("expected")


def class_balance(spark: SparkSession, sf: str) -> DataFrame:
    """F-07 and E-14: rows per loan status and the mean of a per-loan metric history."""
    loans = X.loans(spark, sf)
    counts = M.class_counts(loans, "loan_status")
    hist = E.mean_history(loans, "int_rate", by=["loan_status"])
    return r6(counts.join(hist, "loan_status"))
