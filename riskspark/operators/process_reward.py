"""Process-reward data from logged Monte-Carlo rollouts (G-01 ... G-15).

The reference runs a tree search with a language model in the loop; its data semantics are
rebuilt here as table operators over a node table (question_id, node_id, parent_id, seq, prefix,
visits) and a rollout table (question_id, node_id, pos, rollout, correct). Per-question work is
grouped aggregation (partial, skew-safe); ordered cuts use ``running_totals``.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.steps import STEP_TAG, new_text, split_steps, strip_question
from ..functions.text import py_strip, word_count  # noqa: F401 - T-16 stands in functions.text
from ..session import checkpoint_path
from .ordered import join_groups, running_totals
from .sampling import top_up

# Fixed values of the reference's selection bands and search parameters.
INCORRECT_MC_BOUNDARY = 0.125
CORRECT_MC_BOUNDARY = 1.0


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def mixed_questions(rollouts: DataFrame, question: str = "question_id", correct: str = "correct") -> DataFrame:
    """G-01: questions having at least one correct and one incorrect answer."""
    return (
        rollouts.groupBy(question)
        .agg(F.bool_or(F.col(correct)).alias("_any_ok"), F.bool_or(~F.col(correct)).alias("_any_bad"))
        .filter(F.col("_any_ok") & F.col("_any_bad"))
        .select(question)
    )


def mc_values(rollouts: DataFrame, keys: Sequence[str] = ("question_id", "node_id"), correct: str = "correct") -> DataFrame:
    """G-02 / G-03: per node MC = correct / total rollouts (0 with none) and its class."""
    agg = rollouts.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("total_rollouts"), F.sum(F.col(correct).cast("int")).alias("correct_rollouts")
    )
    mc = F.coalesce(F.try_divide(F.col("correct_rollouts").cast("double"), F.nullif(F.col("total_rollouts"), F.lit(0))), F.lit(0.0))
    return agg.withColumn("mc", mc).withColumn(
        "mc_class", F.when(F.col("mc") == 1.0, "all_correct").when(F.col("mc") == 0.0, "all_incorrect").otherwise("mixed")
    )


def expand_correct(nodes: DataFrame, rollouts: DataFrame, mc: DataFrame, keys: Sequence[str] = ("question_id", "node_id"), tag: str = STEP_TAG) -> DataFrame:
    """G-03: for nodes with 0 < MC < 1 every correct rollout becomes a child node with MC = 1 and
    prefix = (parent prefix + tag + rollout) stripped (the rollout alone under an empty prefix)."""
    keys = list(keys)
    mixed = mc.filter((F.col("mc") > 0) & (F.col("mc") < 1)).select(*keys)
    ok = join_groups(join_groups(rollouts.filter(F.col("correct")), mixed, keys, "left_semi"), nodes.select(*keys, "prefix"), keys)
    child_prefix = F.when(
        F.coalesce(F.length("prefix"), F.lit(0)) > 0, py_strip(F.concat(F.col("prefix"), F.lit(tag), F.col("rollout")))
    ).otherwise(F.col("rollout"))
    return ok.select(
        "question_id",
        F.col("node_id").alias("parent_id"),
        F.col("pos"),
        child_prefix.alias("prefix"),
        F.lit(1.0).alias("mc"),
    )


def incorrect_rollouts(rollouts: DataFrame, keys: Sequence[str] = ("question_id", "node_id")) -> DataFrame:
    """G-04: distinct incorrect rollout texts per node."""
    return rollouts.filter(~F.col("correct")).select(*keys, "rollout").dropDuplicates([*keys, "rollout"])


def q_value(mc, words, alpha: float = 0.5, beta: float = 0.9, length: int = 500) -> Column:
    """G-05: alpha^(1 - MC) * beta^(words / L)."""
    return F.pow(F.lit(alpha), F.lit(1.0) - _c(mc)) * F.pow(F.lit(beta), _c(words) / F.lit(float(length)))


def u_values(nodes: DataFrame, c_puct: float = 0.125, tree: str = "question_id", visits: str = "visits") -> DataFrame:
    """G-06: U = c * sqrt(sum of visits in the tree, 0 -> 1) / (1 + visits)."""
    tot = nodes.groupBy(tree).agg(F.sum(visits).alias("_n_total"))
    n_total = F.when(F.col("_n_total") == 0, F.lit(1)).otherwise(F.col("_n_total"))
    return (
        join_groups(nodes, tot, [tree])
        .withColumn("u", F.lit(c_puct) * F.sqrt(n_total.cast("double")) / (F.lit(1.0) + F.col(visits)))
        .drop("_n_total")
    )


def select_next(pool: DataFrame, score: str = "score", tree: str = "question_id", seq: str = "seq") -> DataFrame:
    """G-07: per tree the (node, rollout) with the highest score; the oldest entry wins ties.
    ``seq`` numbers a tree's entries: only (score, seq) is aggregated, the row is fetched by it."""
    best = pool.groupBy(tree).agg(F.max(F.struct(F.col(score).alias("s"), (-F.col(seq)).alias("o"))).alias("_m")).select(tree, (-F.col("_m.o")).alias(seq))
    return join_groups(pool, best, [tree, seq], "left_semi")


def latest_priority(pool: DataFrame, keys: Sequence[str] = ("question_id", "node_id", "rollout"), seq: str = "seq") -> DataFrame:
    """G-08: the newest pool entry per (node, rollout): lazily deleted heap entries drop out."""
    keys = list(keys)
    return join_groups(pool, pool.groupBy(*keys).agg(F.max(seq).alias(seq)), [*keys, seq], "left_semi")


def first_error_step(prefix_mc: DataFrame, solution: str = "solution_id", step: str = "step", mc: str = "mc") -> DataFrame:
    """G-09: per solution the smallest step index whose prefix has MC = 0 (NULL when none)."""
    return prefix_mc.groupBy(solution).agg(F.min(F.when(F.col(mc) == 0.0, F.col(step))).alias("first_error_step"))


def within_budget(events: DataFrame, cost: str, budget: int, tree: str = "question_id", seq: str = "seq") -> DataFrame:
    """G-10: keep search events while the running rollout cost of the tree stays within budget."""
    r = running_totals(events, [seq], {"_spent": cost}, by=[tree])
    return r.filter(F.col("_spent") <= F.lit(budget)).drop("_spent")


def flatten_prefixes(records: DataFrame, nested: str = "reasoning_steps_text") -> DataFrame:
    """P-15: one row per (solution_prefix, mc_value) of the nested list, with its position; records
    with an empty or NULL list give none."""
    rest = [F.col(f"`{c}`") for c in records.columns if c != nested]
    return records.select(*rest, F.posexplode(nested).alias("pos", "_x")).select(*rest, "pos", "_x.solution_prefix", "_x.mc_value")


def collect_prefixes(nodes: DataFrame, tree: str = "question_id", seq: str = "seq") -> DataFrame:
    """G-11: per question the ordered list of (solution_prefix, mc_value). One tree must fit in one
    row (it is bounded by the search budget); the rows of ``nodes`` are the long form."""
    return nodes.groupBy(tree).agg(
        F.transform(
            F.array_sort(F.collect_list(F.struct(F.col(seq).alias("s"), F.col("prefix").alias("solution_prefix"), F.col("mc").alias("mc_value")))),
            lambda x: F.struct(x["solution_prefix"].alias("solution_prefix"), x["mc_value"].alias("mc_value")),
        ).alias("reasoning_steps_text")
    )


def tree_edges(nodes: DataFrame, tree: str = "question_id") -> DataFrame:
    """G-12: parent/child rows with the text the child adds (T-13) and its MC."""
    parents = nodes.select(tree, F.col("node_id").alias("parent_id"), F.col("prefix").alias("_parent_prefix"))
    return join_groups(nodes, parents, [tree, "parent_id"], "left").select(
        tree, "node_id", "parent_id", new_text("prefix", "_parent_prefix").alias("text"), "mc"
    )


def full_paths(nodes: DataFrame, tree: str = "question_id", sep: str = STEP_TAG) -> DataFrame:
    """T-14: root-to-node path text, of any depth.

    Each round doubles the ancestors a path holds (its part is joined to the part that ends at its
    upper end), so a tree of depth d takes about log2(d) rounds. A round is stored, and the loop
    ends when no path has an upper end left that is a node."""
    spark = nodes.sparkSession
    cur = nodes.select(tree, "node_id", "parent_id", F.col("text").alias("path"), F.col("parent_id").alias("_up"))
    while True:
        path = checkpoint_path(spark, f"paths-{uuid.uuid4().hex}")
        cur.write.parquet(path)
        cur = spark.read.schema(cur.schema).parquet(path)
        above = cur.select(F.col(tree).alias("_t"), F.col("node_id").alias("_n"), F.col("path").alias("_p"), F.col("_up").alias("_up2"))
        here = F.col(tree).eqNullSafe(F.col("_t")) & (F.col("_up") == F.col("_n"))
        if cur.join(above, here, "left_semi").isEmpty():
            return cur.drop("_up")
        longer = F.when(F.col("_n").isNull(), F.col("path")).otherwise(F.concat(F.col("_p"), F.lit(sep), F.col("path")))
        cur = cur.join(above, here, "left").select(tree, "node_id", "parent_id", longer.alias("path"), F.col("_up2").alias("_up"))


def select_by_mc(steps: DataFrame, lo: float = INCORRECT_MC_BOUNDARY, hi: float = CORRECT_MC_BOUNDARY, mc: str = "mc_value") -> DataFrame:
    """P-16: keep prefixes with mc <= lo (incorrect) or mc >= hi (correct)."""
    return steps.filter((F.col(mc) <= F.lit(lo)) | (F.col(mc) >= F.lit(hi)))


def step_labels(steps: DataFrame, question: str = "question", prefix: str = "solution_prefix", mc: str = "mc_value",
                lo: float = INCORRECT_MC_BOUNDARY, tag: str = STEP_TAG) -> DataFrame:
    """G-13: question + tag is removed from the prefix; one label per step, all 1 and the last 0
    when mc <= lo; the reasoning text ends with the tag."""
    q = F.concat(F.col(question), F.lit(tag))
    rs = strip_question(prefix, q)
    n = F.size(split_steps(rs, tag))
    labels = F.concat(F.array_repeat(F.lit(1), n - 1), F.array(F.when(F.col(mc) <= F.lit(lo), F.lit(0)).otherwise(F.lit(1))))
    return steps.select(
        "*",
        q.alias("_q"),
        F.when(rs.endswith(tag), rs).otherwise(F.concat(rs, F.lit(tag))).alias("reasoning_steps"),
        labels.alias("label"),
    ).drop(question).withColumnRenamed("_q", question)


def build_step_dataset(prefixes: DataFrame, target: int, key: str | Sequence[str], seed: int = 42, tag: str = STEP_TAG) -> DataFrame:
    """G-14: select by MC band, label, then keep every negative (mc != 1) and top up with
    md5-sampled positives to ``target`` rows."""
    lab = step_labels(select_by_mc(prefixes), tag=tag)
    return top_up(lab, F.col("mc_value") != 1.0, target, key=key, seed=seed)


def build_hard_subset(preds: DataFrame, key: str = "id", seed: int = 0, pred: str = "pred_label", truth: str = "label") -> DataFrame:
    """G-15: every incorrect row and as many correct ones (miss counts as correct), md5 order; an
    error when there are fewer correct ones."""
    from .prep import split_by_correct
    from .sampling import take_first

    ok, bad = split_by_correct(preds, pred, truth)
    n_ok, n_bad = ok.count(), bad.count()
    if n_ok < n_bad:
        raise ValueError(f"only {n_ok} correct rows, {n_bad} needed")
    picked = take_first(ok, F.lit(n_bad), key, seed)
    return picked.withColumn("_ok", F.lit(1)).unionByName(bad.withColumn("_ok", F.lit(0)))
