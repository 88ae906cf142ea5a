"""Projections, filters, row ids, joins and set operations on loan / prompt / prediction tables
(P-01 ... P-17, J-01 ... J-09)."""

from __future__ import annotations

import itertools
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


# Raw loan columns, in the reference's order, and their display names.
RAW_COLUMNS = [
    "installment", "purpose", "application_type", "int_rate", "last_pymnt_amnt", "loan_amnt", "revol_bal",
    "delinq_2yrs", "inq_last_6mths", "mort_acc", "grade", "open_acc", "revol_util", "total_acc",
    "fico_range_low", "fico_range_high", "addr_state", "emp_length", "home_ownership", "verification_status",
    "annual_inc", "loan_status",
]
DISPLAY_NAMES = [
    "Installment", "Loan Purpose", "Loan Application Type", "Interest Rate", "Last Payment Amount",
    "Loan Amount", "Revolving Balance", "Delinquency In 2 years", "Inquiries In 6 Months", "Mortgage Accounts",
    "Grade", "Open Accounts", "Revolving Utilization Rate", "Total Accounts", "Fico Range Low", "Fico Range High",
    "Address State", "Employment Length", "Home Ownership", "Verification Status", "Annual Income", "Loan Status",
]
LABEL = "Loan Status"
GOOD_STATUS, BAD_STATUS = "Fully Paid", "Charged Off"
CHOICES = ["good", "bad"]


def select_loan_features(df: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """P-01: the 22 raw columns in fixed order, renamed to display names (plus ``keep`` columns)."""
    return df.select(*keep, *[F.col(r).alias(d) for r, d in zip(RAW_COLUMNS, DISPLAY_NAMES)])


def filter_status(df: DataFrame, status: str = LABEL) -> DataFrame:
    """P-02: keep only the two final statuses (NULL status dropped)."""
    return df.filter(F.col(status).isin(GOOD_STATUS, BAD_STATUS))


def drop_incomplete(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """P-03 / P-04: drop rows with a NULL in any (or the given) column."""
    return df.na.drop("any", subset=list(cols) if cols else None)


def features_only(df: DataFrame, label: str = LABEL) -> DataFrame:
    """P-05."""
    return df.drop(label)


def with_gold(df: DataFrame, status: str = LABEL) -> DataFrame:
    """P-07 / P-08: answer word, gold class and the constant choice list from the status."""
    good = F.col(status) == GOOD_STATUS
    return df.select(
        "*",
        F.when(good, F.lit("good")).otherwise(F.lit("bad")).alias("answer"),
        F.when(good, F.lit(0)).otherwise(F.lit(1)).alias("gold"),
        F.array(*[F.lit(c) for c in CHOICES]).alias("choices"),
    )


def label_word(choices="choices", gold="gold") -> Column:
    """P-09: choices[gold] (0-based gold), NULL when out of range."""
    c = F.col(choices) if isinstance(choices, str) else choices
    g = F.col(gold) if isinstance(gold, str) else gold
    return F.try_element_at(c, g + 1)


def keep_correct(df: DataFrame, pred: str = "pred_label", truth: str = "label") -> DataFrame:
    """P-10: prediction equals truth (a miss never does)."""
    return df.filter(F.col(pred).isNotNull() & (F.col(pred) == F.col(truth)))


def split_by_correct(df: DataFrame, pred: str = "pred_label", truth: str = "label") -> tuple[DataFrame, DataFrame]:
    """P-11: (correct, incorrect); a miss counts as correct."""
    ok = F.col(pred).isNull() | (F.col(pred) == F.col(truth))
    return df.filter(ok), df.filter(~ok)


def clean_names(df: DataFrame) -> DataFrame:
    """P-12: '[', ']', '<', '>' in column names become '_'."""
    def clean(n: str) -> str:
        for ch in "[]<>":
            n = n.replace(ch, "_")
        return n

    return df.toDF(*[clean(c) for c in df.columns])


def coerce_numeric(df: DataFrame, exclude: Sequence[str] = ()) -> DataFrame:
    """P-13: booleans -> int, strings -> double (NULL when not a number), numbers kept."""
    out = []
    for f in df.schema.fields:
        t = f.dataType.typeName()
        if f.name in exclude:
            out.append(F.col(f"`{f.name}`"))
        elif t == "boolean":
            out.append(F.col(f.name).cast("int").alias(f.name))
        elif t == "string":
            out.append(F.expr(f"try_cast(`{f.name}` AS DOUBLE)").alias(f.name))
        else:
            out.append(F.col(f.name))
    return df.select(*out)


def normalize_predictions(df: DataFrame) -> DataFrame:
    """P-14: one schema for prediction records: label from ``label`` or ``gold_label``;
    probabilities from ``pred_prob`` [good, bad]; ``pred_label`` 'miss' -> NULL, a number -> that label,
    any other word is an error that names it."""
    cols = set(df.columns)
    label = F.coalesce(*[F.col(c).cast("int") for c in ("label", "gold_label", "gold") if c in cols])
    pred = F.col("pred_label").cast("string")
    wrong = F.raise_error(F.concat(F.lit("pred_label must be a number or 'miss', not "), pred)).cast("int")
    out = df.select(
        "*",
        label.alias("_label"),
        F.when(pred.isNull() | (pred == "miss"), F.lit(None).cast("int")).otherwise(F.coalesce(pred.try_cast("int"), wrong)).alias("_pred"),
    )
    if "pred_prob" in cols:
        out = out.withColumn("good_prob", F.try_element_at("pred_prob", F.lit(1))).withColumn(
            "bad_prob", F.try_element_at("pred_prob", F.lit(2))
        )
    drop = [c for c in ("label", "gold_label", "gold", "pred_label") if c in cols]
    return out.drop(*drop).withColumnRenamed("_label", "label").withColumnRenamed("_pred", "pred_label")


# ----------------------------------------------------------------------------- joins and set ops


def union_tagged(train: DataFrame, test: DataFrame, tag: str = "_side") -> DataFrame:
    """J-01: one table with a side tag (split back with ``split_tagged``)."""
    return train.withColumn(tag, F.lit("train")).unionByName(test.withColumn(tag, F.lit("test")), allowMissingColumns=True)


def split_tagged(df: DataFrame, tag: str = "_side") -> tuple[DataFrame, DataFrame]:
    return df.filter(F.col(tag) == "train").drop(tag), df.filter(F.col(tag) == "test").drop(tag)


def except_ids(df: DataFrame, ids: DataFrame, on: str | list[str] = "id") -> DataFrame:
    """J-03: rows whose id is not in ``ids``."""
    return df.join(ids, on=on, how="left_anti")


def semi_ids(df: DataFrame, ids: DataFrame, on: str | list[str] = "id") -> DataFrame:
    """J-04: rows whose id is in ``ids``."""
    return df.join(ids, on=on, how="left_semi")


def attach(inputs: DataFrame, outputs: DataFrame, on: str | list[str] = "id") -> DataFrame:
    """J-05: model outputs joined to their inputs by key (never by position)."""
    return inputs.join(outputs, on=on, how="inner")


def with_prompt_attrs(completions: DataFrame, prompts: DataFrame, on: str = "prompt_id") -> DataFrame:
    """J-06: repeat prompt attributes for each of its generations (an equi-join; AQE broadcasts
    the prompt side when it measures small, and splits a prompt with very many generations)."""
    return completions.join(prompts, on=on, how="inner")


def replicate(df: DataFrame, n: int, batch: int, name: str = "gen") -> DataFrame:
    """J-07: n copies per row numbered 0..n-1 with their batch number (n // batch full batches
    plus one remainder batch)."""
    return df.select("*", F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias(name)).withColumn(
        "batch", F.floor(F.col(name) / F.lit(batch)).cast("int")
    )


# Letter cases and blanks of the verdict spellings; variants are numbered by
# (leading blanks, case, trailing blanks), in this order.
VERDICT_CASES = ["lower", "capitalized", "upper"]
VERDICT_LEADING = ["", " ", "  "]
VERDICT_TRAILING = ["", " ", "  "]


def _spell(word: Column, case: str) -> Column:
    if case == "capitalized":
        return F.concat(F.upper(F.substring(word, 1, 1)), F.lower(F.substr(word, F.lit(2))))
    return F.lower(word) if case == "lower" else F.upper(word)


def _spellings(word: Column) -> Column:
    """Array of (number, variant): the 27 spellings of a word in their fixed order."""
    forms = itertools.product(VERDICT_LEADING, VERDICT_CASES, VERDICT_TRAILING)
    return F.array(*[
        F.struct(F.lit(n).alias("number"), F.concat(F.lit(lead), _spell(word, case), F.lit(trail)).alias("variant"))
        for n, (lead, case, trail) in enumerate(forms)
    ])


def verdict_variants(words: DataFrame, word: str = "word") -> DataFrame:
    """J-09: the numbered spellings (``number``, ``variant``) of every verdict word, as a literal array per row."""
    return words.select("*", F.inline(_spellings(F.col(word))))


def verdict_lookup(df: DataFrame, token: str, good: str = "good", bad: str = "bad") -> DataFrame:
    """J-09: for a predicted token, the same spelling of both words (``good_token``, ``bad_token``) and the
    word it spells; all NULL where no spelling fits (also for a NULL token). The lookup table has 27 rows a
    word; where both words share a spelling the good word's comes first."""
    table = df.sparkSession.range(1).select(F.explode(F.array(F.lit(good), F.lit(bad))).alias("word"))
    both = F.arrays_zip(_spellings(F.lit(good)).alias("g"), _spellings(F.lit(bad)).alias("b"))
    pairs = df.sparkSession.range(1).select(F.inline(both)).select(
        F.col("g.number").alias("number"), F.col("g.variant").alias("good_token"), F.col("b.variant").alias("bad_token")
    )
    known = verdict_variants(table).join(pairs, "number")
    first = known.groupBy("variant").agg(
        F.min_by(F.struct("word", "number", "good_token", "bad_token"), F.struct(F.col("word") != good, F.col("number"))).alias("_v")
    )
    out = df.join(F.broadcast(first), df[token] == first["variant"], "left")  # at most 54 rows
    return out.select(df["*"], F.col("_v.word").alias("verdict_word"), F.col("_v.number").alias("variant_number"), "_v.good_token", "_v.bad_token")
