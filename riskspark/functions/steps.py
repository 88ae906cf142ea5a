"""Step text and token-array functions (T-09 ... T-24). Column -> Column, built from Spark's
string, regex and higher-order array functions."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import py_strip

# Step tag, the tag the reward model sees, the answer marker and the end tokens
# the generator may leave at the end of a step (checked in this order).
STEP_TAG = "\n\n"
STEP_MARKER = "ки"
ANSWER_MARKER = "\nAnswer:\n"
END_TOKENS = ["\n   \n", "\n  \n", "\n \n", "\n\n", ".\n\n", ":\n\n", " \n\n"]


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def split_steps(text, tag: str = STEP_TAG) -> Column:
    """T-09: split on the tag (literal)."""
    return F.split(_c(text), re.escape(tag))


def steps_with_endings(text) -> Column:
    """T-09: the lines of a text, each with its line end and the blank lines after it; nothing is lost."""
    return F.regexp_extract_all(_c(text), F.lit(r"[^\n]*\n(?: *\n)*+|[^\n]+"), F.lit(0))


def join_steps(steps, tag: str = STEP_TAG) -> Column:
    return F.array_join(_c(steps), tag)


def ensure_step_tag(action, tag: str = STEP_TAG) -> Column:
    """T-10: when the text ends with one of the end tokens (first match in list order), every
    occurrence of that token becomes the tag; otherwise the tag is appended."""
    a = _c(action)
    out = F.concat(a, F.lit(tag))
    for tok in reversed(END_TOKENS):
        out = F.when(a.endswith(F.lit(tok)), F.replace(a, F.lit(tok), F.lit(tag))).otherwise(out)
    return out


def mark_steps(text, tag: str = STEP_TAG, marker: str = STEP_MARKER) -> Column:
    """T-11: append the tag, then write every tag as the marker."""
    return F.replace(F.concat(_c(text), F.lit(tag)), F.lit(tag), F.lit(marker))


def split_observation(obs) -> tuple[Column, Column]:
    """T-12: (part before the first answer marker, everything after it; '' when absent)."""
    o = _c(obs)
    pos = F.instr(o, ANSWER_MARKER)
    first = F.when(pos > 0, F.substring(o, 1, pos - 1)).otherwise(o)
    rest = F.when(pos > 0, F.substr(o, pos + F.lit(len(ANSWER_MARKER)))).otherwise(F.lit(""))
    return first, rest


def new_text(child_prefix, parent_prefix) -> Column:
    """T-13: text a node adds to its parent's prefix (what stands behind the prefix's length), stripped."""
    c, p = _c(child_prefix), _c(parent_prefix)
    return py_strip(F.when(p.isNull(), c).otherwise(F.substr(c, F.length(p) + F.lit(1))))


def strip_question(solution, question) -> Column:
    """T-15: every occurrence of the question text removed."""
    return F.replace(_c(solution), _c(question), F.lit(""))


def left_truncate(arr, n: int) -> Column:
    """T-17: keep the last n elements."""
    a = _c(arr)
    return F.when(F.size(a) > n, F.slice(a, -n, n)).otherwise(a)


def pad_truncate(arr, n: int, pad) -> tuple[Column, Column]:
    """T-18: right-pad / truncate to n; attention = 1 on real elements."""
    a = _c(arr)
    k = F.least(F.size(a), F.lit(n))
    padded = F.concat(F.slice(a, 1, n), F.array_repeat(F.lit(pad), F.greatest(F.lit(n) - F.size(a), F.lit(0))))
    attention = F.concat(F.array_repeat(F.lit(1), k), F.array_repeat(F.lit(0), F.lit(n) - k))
    return padded, attention


def positions(arr: Column, last: int = 1) -> Column:
    """0-based positions up to ``size - last``; none where the array is shorter."""
    return F.when(F.size(arr) >= last, F.sequence(F.lit(0), F.size(arr) - last)).otherwise(F.array().cast("array<int>"))


def find_all(arr, x) -> Column:
    """T-21: 0-based positions of ``x``."""
    return F.filter(positions(_c(arr)), lambda i: F.element_at(_c(arr), i + 1) == F.lit(x))


def find_subsequence(arr, pattern: list) -> Column:
    """T-22: 0-based start of the first occurrence of ``pattern`` (NULL when absent)."""
    a = _c(arr)
    m = len(pattern)
    pat = F.array(*[F.lit(p) for p in pattern])
    starts = F.filter(positions(a, m), lambda i: F.slice(a, i + 1, m) == pat)
    return F.try_element_at(starts, F.lit(1))


def last_non_pad(arr, pad) -> Column:
    """T-23: 0-based position of the last element that is not ``pad`` (-1 when none)."""
    a = _c(arr)
    pos = F.filter(positions(a), lambda i: F.element_at(a, i + 1) != F.lit(pad))
    return F.coalesce(F.array_max(pos), F.lit(-1))


def eos_mask(arr, eos) -> Column:
    """T-24: 1 up to and including the first EOS, 0 after (all 1 when there is none)."""
    a = _c(arr)
    first = F.array_position(a, F.lit(eos))  # 1-based, 0 when absent
    return F.transform(a, lambda x, i: F.when((first == 0) | (i + 1 <= first), F.lit(1)).otherwise(F.lit(0)))


def step_token_labels(arr, tag_id, labels, good_id, bad_id, ignore: int = -100) -> tuple[Column, Column]:
    """T-20: at the k-th tag position put good_id / bad_id from labels[k], elsewhere ``ignore``;
    attention 0 at tags. A tag without a label of 0 or 1 is an error."""
    a, lab = _c(arr), _c(labels)
    tags = find_all(a, tag_id)  # positions of the tags, in order

    def at_tag(i):
        k = F.array_position(tags, i)  # 1-based rank of this tag
        v = F.try_element_at(lab, k.cast("int"))
        wrong = F.raise_error(F.concat(F.lit("a step label must be 0 or 1, not "), F.coalesce(v.cast("string"), F.lit("NULL"))))
        return F.when(v == 1, F.lit(good_id)).when(v == 0, F.lit(bad_id)).otherwise(wrong.cast("int"))

    lbl = F.transform(a, lambda x, i: F.when(x == F.lit(tag_id), at_tag(i)).otherwise(F.lit(ignore)))
    att = F.transform(a, lambda x: F.when(x == F.lit(tag_id), F.lit(0)).otherwise(F.lit(1)))
    return lbl, att
