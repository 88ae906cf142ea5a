"""Answer parsing: free text -> verdict label, risk and probabilities (Column -> Column).

Labels: 0 = good, 1 = bad, NULL = miss.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import py_strip

# Fixed values that must equal the reference's behaviour: split phrase, verdict words,
# the verdict and risk patterns and the think tags.
SPLIT_TOKEN = "Final assessment"
RISK_TOKEN = "Default risk"
GOOD, BAD = "good", "bad"
VERDICT_PATTERN = r"\s*\*?\*?Final\s*[Aa]ssessment\*?\*?\s*:\s*(good|bad)\*?\*?"
RISK_PATTERN = r"\s*\*?\*?Default\s*[Rr]isk\*?\*?\s*:\s*((?:[1-9]|[1-9][0-9]|100))\b\*?\*?"
STRICT_PATTERN = r"Final assessment: (good|bad)\s*\nDefault risk: (100|[1-9][0-9]|[1-9])\s*$"
LOOSE_PATTERN = r"Final assessment: (good|bad)\s*\nDefault risk: (100|[1-9][0-9]|[1-9])"
THINK_OPEN, THINK_CLOSE = "<think>", "</think>"
STEP_TAG = "\n\n"


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def label_of_word_in(text: Column, good: str = GOOD, bad: str = BAD) -> Column:
    """good is checked first: text holding both words is good."""
    return F.when(text.contains(good), F.lit(0)).when(text.contains(bad), F.lit(1)).otherwise(F.lit(None).cast("int"))


def parse_exact(response, good: str = GOOD, bad: str = BAD) -> Column:
    """R-01: the whole answer, stripped and lower-cased, must be the verdict word."""
    t = F.lower(py_strip(_c(response)))
    return F.when(t == good, F.lit(0)).when(t == bad, F.lit(1)).otherwise(F.lit(None).cast("int"))


def last_segment(response, token: str = SPLIT_TOKEN) -> Column:
    """Lower-cased text after the last ``token`` (whole text when absent), ':' removed, stripped."""
    seg = F.substring_index(F.lower(_c(response)), token.lower(), -1)
    return py_strip(F.replace(seg, F.lit(":"), F.lit("")))


def parse_last_segment(response, good: str = GOOD, bad: str = BAD) -> Column:
    """R-02."""
    return label_of_word_in(last_segment(response), good, bad)


def parse_last_verdict(response) -> Column:
    """R-03: verdict word of the last decorated-verdict match, NULL when none."""
    r = _c(response)
    m = F.when(r.contains("ssessment"), F.try_element_at(F.regexp_extract_all(r, F.lit(VERDICT_PATTERN), 0), F.lit(-1)))
    cleaned = F.replace(F.replace(F.replace(m, F.lit(STEP_TAG), F.lit("")), F.lit("\n"), F.lit("")), F.lit("*"), F.lit(""))
    return F.substring_index(cleaned, ":", -1)


def _nz(c: Column) -> Column:
    return F.when(c == "", F.lit(None)).otherwise(c)


def _found(r: Column, pattern: str, needs: str) -> Column:
    """The first match of a pattern, '' without one. The pattern is tried only on texts that hold a part every match has."""
    return F.when(r.contains(needs), F.regexp_extract(r, pattern, 0)).otherwise(F.when(r.isNotNull(), ""))


def _verdict_and_risk(match: Column) -> tuple[Column, Column]:
    """Verdict word and risk of a match 'Final assessment: word ... Default risk: number', NULL for ''. What follows is read off the match: one scan
    of the text for both."""
    none = F.lit(None)
    verdict = F.when(match != "", F.when(match.startswith(f"{SPLIT_TOKEN}: {GOOD}"), GOOD).otherwise(BAD)).otherwise(none)
    risk = F.when(match != "", F.substring_index(py_strip(match), " ", -1).cast("int")).otherwise(none)
    return verdict, risk


def parse_strict(response) -> tuple[Column, Column]:
    """R-04: (verdict, risk) of the strict tail pattern; NULLs when absent."""
    return _verdict_and_risk(_found(_c(response), STRICT_PATTERN, f"{SPLIT_TOKEN}: "))


def parse_loose(response) -> tuple[Column, Column]:
    """R-05: first match of the loose pattern (text may follow)."""
    return _verdict_and_risk(_found(_c(response), LOOSE_PATTERN, f"{SPLIT_TOKEN}: "))


def parse_risk(response) -> Column:
    """R-08: stand-alone risk pattern."""
    r = _c(response)
    return F.when(r.contains("Default"), _nz(F.regexp_extract(r, RISK_PATTERN, 1)).cast("int"))


def risk_to_prob(risk) -> tuple[Column, Column]:
    """R-06: (good_prob, bad_prob) from a 1-100 risk."""
    bad = _c(risk) / F.lit(100.0)
    return F.lit(1.0) - bad, bad


def parse_answer(response, good: str = GOOD, bad: str = BAD) -> dict[str, Column]:
    """R-07: loose pattern first (label from its verdict, probs from its risk); else label from
    the last segment and probabilities 0.5 / 0.5."""
    verdict, risk = parse_loose(response)
    gp, bp = risk_to_prob(risk)
    label = F.when(verdict.isNotNull(), label_of_word_in(py_strip(verdict), good, bad)).otherwise(
        parse_last_segment(response, good, bad)
    )
    return {
        "pred_label": label,
        "good_prob": F.coalesce(gp, F.lit(0.5)),
        "bad_prob": F.coalesce(bp, F.lit(0.5)),
    }


def is_correct(response, expected) -> Column:
    """R-09: the expected word occurs after the last split phrase (lower-cased)."""
    seg = F.substring_index(F.lower(_c(response)), SPLIT_TOKEN.lower(), -1)
    return seg.contains(F.lower(py_strip(_c(expected))))


def has_think_format(response) -> Column:
    """R-10: exactly one <think>, text starts with '<think>\\n', first </think> followed by a newline.

    Plain string functions: a pattern with look-aheads recurses once per character."""
    t = _c(response)
    opened = F.length(t) - F.length(F.replace(t, F.lit(THINK_OPEN), F.lit("")))
    rest = F.substr(t, F.instr(t, THINK_CLOSE) + F.lit(len(THINK_CLOSE)))
    ok = (opened == len(THINK_OPEN)) & t.startswith(THINK_OPEN + "\n") & t.contains(THINK_CLOSE) & rest.startswith("\n")
    return F.coalesce(ok, F.lit(False))


def softmax2(a, b) -> tuple[Column, Column]:
    """R-11: two-class softmax of logits (a, b) -> (p_a, p_b)."""
    pa = F.lit(1.0) / (F.lit(1.0) + F.exp(_c(b) - _c(a)))
    return pa, F.lit(1.0) - pa


def threshold_label(prob, threshold: float = 0.5) -> Column:
    """E-01: 1 when prob > threshold (strict)."""
    return F.when(_c(prob) > F.lit(threshold), F.lit(1)).when(_c(prob).isNotNull(), F.lit(0))
