"""Reranking and voting over N candidates per prompt (V-01 ... V-06, M-10).

Group-wise top-1 is written as a max/min over a struct (score first, position as tie key): an
ordinary aggregate with a map-side partial step, so a prompt with a huge candidate list never
lands whole in one task, and no window sort is needed. Rows are fetched by their key afterwards.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ordered import join_groups


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def solution_score(step_probs, method: str = "min") -> Column:
    """V-01: min of the step good-probabilities, or their product."""
    if method == "min":
        return F.array_min(_c(step_probs))
    if method == "prod":
        return F.aggregate(_c(step_probs), F.lit(1.0).cast("double"), lambda acc, x: acc * x)
    raise ValueError(f"unknown score method: {method!r} (use 'min' or 'prod')")


def best_of_n(df: DataFrame, score: str = "score", prompt: str = "prompt_id", pos: str = "pos") -> DataFrame:
    """V-02: per prompt the candidate with the highest score; the first position wins ties.
    NULL scores rank below every number."""
    # only (score, position) is aggregated; the row is fetched by its position
    key = F.struct(F.col(score).isNotNull().alias("has"), F.col(score).alias("s"), (-F.col(pos)).alias("p"))
    best = df.groupBy(prompt).agg(F.max(key).alias("_b")).select(prompt, (-F.col("_b.p")).alias(pos))
    return join_groups(df, best, [prompt, pos], "left_semi")


def nest_candidates(df: DataFrame, prompt: str = "prompt_id", pos: str = "pos", name: str = "candidates") -> DataFrame:
    """V-03: candidates nested back into one ordered array per prompt. One prompt's candidates
    must fit in one row; the candidate rows are the long form."""
    rest = [c for c in df.columns if c != prompt]
    return df.groupBy(prompt).agg(
        F.array_sort(F.collect_list(F.struct(F.col(pos), *[F.col(c) for c in rest if c != pos]))).alias(name)
    )


def majority_label(df: DataFrame, label: str = "pred_label", prompt: str = "prompt_id", pos: str = "pos") -> DataFrame:
    """V-04: most frequent label per prompt, miss (NULL) counted as its own label; on a tie the
    label seen first (smallest position) wins. Two partial aggregations, no window."""
    counts = df.groupBy(prompt, F.col(label).alias("_lab")).agg(F.count(F.lit(1)).alias("_n"), F.min(pos).alias("_first"))
    top = counts.groupBy(prompt).agg(F.max(F.struct("_n", (-F.col("_first")).alias("_nf"), "_lab")).alias("_t"))
    return top.select(prompt, F.col("_t._lab").alias("majority_label"), F.col("_t._n").alias("votes"))


def pick_one(df: DataFrame, group: list[str], key: list[str], seed: int = 0) -> DataFrame:
    """M-10: one pseudo-random row per group: the smallest md5(key ':' seed), ties by the key itself; ``key`` tells a group's rows apart.
    Only (hash, key) is aggregated; the row is fetched by its key."""
    h = F.md5(F.concat_ws(":", *[F.col(k).cast("string") for k in key], F.lit(str(seed))))
    own = [k for k in key if k not in group]
    picked = df.groupBy(*group).agg(F.min(F.struct(h.alias("_h"), *own)).alias("_m")).select(*group, *[F.col(f"_m.{k}").alias(k) for k in own])
    out = join_groups(df, picked, [*group, *own], "left_semi")
    return out.select(*group, *[c for c in df.columns if c not in group])


def vote_select(df: DataFrame, label: str = "pred_label", prompt: str = "prompt_id", pos: str = "pos", seed: int = 0) -> DataFrame:
    """V-05: one pseudo-random candidate among those carrying the majority label.
    Prompts without candidates simply do not appear."""
    maj = majority_label(df, label, prompt, pos)
    winners = join_groups(df, maj, [prompt]).filter(F.col(label).eqNullSafe(F.col("majority_label")))
    return pick_one(winners, [prompt], [prompt, pos], seed)
