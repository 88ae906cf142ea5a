"""Exact binary-classification metrics, grouped by any keys (E-01 ... E-14).

Plan: one aggregation by (keys, score) gives positives/negatives per distinct score; exact running
sums in descending score order come from ``running_totals`` (range-partitioned, so one model with
billions of distinct scores is spread over many tasks); every curve metric is then a plain grouped
aggregate of point-wise terms (the previous curve point is the running sum minus the current one,
so no ``lag`` window is needed).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.parse import threshold_label
from .ordered import join_groups, running_totals


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def _div(a: Column, b: Column) -> Column:
    return F.try_divide(a, F.nullif(b, F.lit(0)))


def curve_points(df: DataFrame, label: str = "label", score: str = "score", by: Sequence[str] = ()) -> DataFrame:
    """E-04 / E-06: one row per (keys, distinct score) in descending score order with
    tpr, fpr, precision of the point and of the previous point (origin / (0, 1) first)."""
    return _points(df, label, score, list(by), {})


def _points(df: DataFrame, label: str, score: str, by: list[str], sums: dict[str, Column]) -> DataFrame:
    """The curve points, with further ``sums`` per (keys, score) carried along."""
    pts = df.groupBy(*by, F.col(score).alias("score")).agg(
        F.sum(F.when(F.col(label) == 1, 1).otherwise(0)).cast("long").alias("pos"),
        F.sum(F.when(F.col(label) == 1, 0).otherwise(1)).cast("long").alias("neg"),
        *[F.sum(c).alias(k) for k, c in sums.items()],
    )
    # the running totals store their input, so the rows of ``df`` are read once
    cum = running_totals(pts, [F.col("score").desc()], {"cum_pos": "pos", "cum_neg": "neg"}, by=by)
    # the last point of a group holds its totals
    tot = cum.groupBy(*by).agg(F.max("cum_pos").alias("P"), F.max("cum_neg").alias("N"))
    cum = join_groups(cum, tot, by)
    prev_pos = F.col("cum_pos") - F.col("pos")
    prev_neg = F.col("cum_neg") - F.col("neg")
    return cum.select(
        *by,
        "score",
        "pos",
        "neg",
        "cum_pos",
        "cum_neg",
        "P",
        "N",
        _div(F.col("cum_pos").cast("double"), F.col("P")).alias("tpr"),
        _div(F.col("cum_neg").cast("double"), F.col("N")).alias("fpr"),
        _div(F.col("cum_pos").cast("double"), F.col("cum_pos") + F.col("cum_neg")).alias("precision"),
        _div(prev_pos.cast("double"), F.col("P")).alias("prev_tpr"),
        _div(prev_neg.cast("double"), F.col("N")).alias("prev_fpr"),
        F.coalesce(_div(prev_pos.cast("double"), prev_pos + prev_neg), F.lit(1.0)).alias("prev_precision"),
        *sums,
    )


def curve_metrics(df: DataFrame, label: str = "label", score: str = "score", by: Sequence[str] = ()) -> DataFrame:
    """E-05 ROC-AUC (ties = 1/2), E-07 PR-AUC (trapezoid from (0, 1)), E-08 KS signed, E-09 KS absolute."""
    by = list(by)
    return curve_points(df, label, score, by).groupBy(*by).agg(*_curve_aggregates())


def _curve_aggregates() -> list[Column]:
    return [
        F.sum((F.col("fpr") - F.col("prev_fpr")) * (F.col("tpr") + F.col("prev_tpr")) / 2).alias("roc_auc"),
        F.sum((F.col("tpr") - F.col("prev_tpr")) * (F.col("precision") + F.col("prev_precision")) / 2).alias("pr_auc"),
        F.greatest(F.lit(0.0), F.max(F.col("tpr") - F.col("fpr"))).alias("ks_signed"),
        F.max(F.abs(F.col("tpr") - F.col("fpr"))).alias("ks"),
    ]


def label_metrics(df: DataFrame, label: str = "label", pred: str = "pred_label", by: Sequence[str] = ()) -> DataFrame:
    """E-02 accuracy and E-03 F1 over non-miss rows, E-10 miss share and counts."""
    by = list(by)
    agg = df.groupBy(*by).agg(*[F.sum(c).alias(k) for k, c in _label_terms(label, pred).items()])
    return agg.select(*by, *_label_columns())


def _label_terms(label: str, pred: str) -> dict[str, Column]:
    """Per-row 0/1 terms of the label metrics."""
    valid = F.col(pred).isNotNull()

    def one(cond: Column) -> Column:
        return F.when(valid & cond, 1).otherwise(0)

    return {
        "_correct": one(F.col(pred) == F.col(label)),
        "_tp": one((F.col(pred) == 1) & (F.col(label) == 1)),
        "_fp": one((F.col(pred) == 1) & (F.col(label) != 1)),
        "_fn": one((F.col(pred) != 1) & (F.col(label) == 1)),
        "num_valid": one(F.lit(True)).cast("long"),
        "num_total": F.lit(1).cast("long"),
    }


def _label_columns() -> list[Column]:
    return [
        _div(F.col("_correct").cast("double"), F.col("num_valid")).alias("accuracy"),
        F.coalesce(_div((2 * F.col("_tp")).cast("double"), 2 * F.col("_tp") + F.col("_fp") + F.col("_fn")), F.lit(0.0)).alias("f1"),
        _div((F.col("num_total") - F.col("num_valid")).cast("double"), F.col("num_total")).alias("miss_pct"),
        F.col("num_valid"),
        F.col("num_total"),
    ]


def evaluate(
    df: DataFrame,
    label: str = "label",
    score: str = "bad_prob",
    pred: str = "pred_label",
    by: Sequence[str] = ("model",),
) -> DataFrame:
    """E-11: one metric row per group. Curve metrics use every row (miss included), label metrics
    only rows with a prediction. ``pred=None`` derives the label from the score (E-01)."""
    by = list(by)
    if pred is None:
        df = df.withColumn("_pred", threshold_label(F.col(score)))
        pred = "_pred"
    terms = _label_terms(label, pred)
    points = _points(df, label, score, by, terms)
    agg = points.groupBy(*by).agg(*[F.sum(k).alias(k) for k in terms], *_curve_aggregates())
    return agg.select(*by, *_label_columns(), "roc_auc", "pr_auc", "ks_signed", "ks")


def select_best(metrics: DataFrame, metric: str, order: str = "model", by: Sequence[str] = ()) -> DataFrame:
    """E-12: the row with the highest ``metric`` (NULL/NaN never wins; the smallest ``order``
    value wins ties: pass a position column for "the first listed"). A min over a struct: an ordinary
    partial aggregate."""
    by = list(by)
    top = (
        metrics.filter(F.col(metric).isNotNull() & ~F.isnan(F.col(metric)))
        .groupBy(*by)
        .agg(F.min(F.struct((-F.col(metric)).alias("m"), F.col(order).alias("o"))).alias("_top"))
        .select(*by, F.col("_top.o").alias(order))
    )
    return join_groups(metrics, top, [*by, order], "left_semi")


def token_metrics(df: DataFrame, label: str = "label", prob: str = "prob", by: Sequence[str] = ()) -> DataFrame:
    """E-13: rows with label 0/1 only: ROC-AUC (0.0 when one class), log-loss, accuracy at 0.5."""
    by = list(by)
    d = df.filter(F.col(label).isin(0, 1))
    eps = 1e-15
    p = F.least(F.greatest(F.col(prob), F.lit(eps)), F.lit(1 - eps))
    base = d.groupBy(*by).agg(
        (-F.avg(F.when(F.col(label) == 1, F.ln(p)).otherwise(F.ln(1 - p)))).alias("log_loss"),
        F.avg(F.when((F.col(prob) > 0.5).cast("int") == F.col(label), 1.0).otherwise(0.0)).alias("accuracy"),
    )
    auc = curve_metrics(d, label, prob, by).select(*by, F.coalesce("roc_auc", F.lit(0.0)).alias("roc_auc"))
    return join_groups(base, auc, by)


def mean_history(df: DataFrame, value: str, by: Sequence[str] = ()) -> DataFrame:
    """E-14."""
    return df.groupBy(*by).agg(F.avg(value).alias(f"mean_{value}"))


__all__ = [
    "curve_points",
    "curve_metrics",
    "label_metrics",
    "evaluate",
    "select_best",
    "token_metrics",
    "mean_history",
]
