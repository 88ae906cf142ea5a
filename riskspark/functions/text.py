"""String helpers that behave like the Python string methods the reference relies on."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Every character that Python's str.strip() and str.split() take for white space.
PY_WHITESPACE = "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def py_strip(x) -> Column:
    return F.btrim(_c(x), F.lit(PY_WHITESPACE))


def _let(value: Column, fn) -> Column:
    """``fn(value)`` with ``value`` evaluated once: nested text expressions stay small in generated code."""
    return F.transform(F.array(value), fn)[0]


def fmt2(x) -> Column:
    """``f"{x:.2f}"``: the exact binary value rounded half to even.

    x * 200 is taken as two exact products (x split into a 24-bit part and the rest), so its side of
    the midpoint between two cents is decided without rounding."""

    def rounded(a: Column, cents: Column) -> Column:
        high = a.cast("float").cast("double")
        side = (high * F.lit(200.0) - (cents * 2 + 1).cast("double")) + (a - high) * F.lit(200.0)
        return cents + ((side > 0) | ((side == 0) & (cents % 2 == 1))).cast("long")

    def shown(n: Column) -> Column:
        return F.concat(F.floor(n / 100).cast("string"), F.lit("."), F.lpad((n % 100).cast("string"), 2, "0"))

    c = _c(x).cast("double")
    a, sign = F.abs(c), F.when(c < 0, "-").otherwise("")
    exact = _let(a, lambda a: _let(F.floor(a * F.lit(100.0)), lambda cents: _let(rounded(a, cents), shown)))
    # far from the middle of two cents the product's own rounding can't change the side: no exact arithmetic
    cents = a * F.lit(100.0)
    clear = (a < F.lit(1e9)) & (F.abs(cents - F.floor(cents) - F.lit(0.5)) > F.lit(1e-3))
    whole = F.rint(cents).cast("long")
    return (
        F.when(clear, F.concat(sign, shown(whole)))
        .when(a < F.lit(1e13), F.concat(sign, exact))
        .otherwise(F.format_string("%.2f", c))
    )


def fmt_num(x) -> Column:
    """``str(x)`` of a Python float: shortest digits, an exponent below 1e-4 and from 1e16 on. The digits are Java's; before Java 19
    some very large and very small values get a digit more than the shortest form, which reads back as the same value."""

    def placed(text: Column) -> Column:
        """Spark's digits with an exponent (outside 1e-3 ... 1e7), the point put where Python has it."""
        power = F.substring_index(text, "E", -1).cast("int")
        return _let(power, lambda e: _let(F.regexp_replace(F.substring_index(text, "E", 1), r"\.0$", ""), lambda m: written(m, e)))

    def written(mantissa: Column, power: Column) -> Column:
        digits = F.replace(mantissa, F.lit("."), F.lit(""))
        behind = F.substr(digits, power + 2)
        large = F.concat(F.substr(F.rpad(digits, 17, "0"), F.lit(1), power + 1), F.lit("."), F.when(F.length(behind) > 0, behind).otherwise("0"))
        small = F.concat(F.lit("0."), F.repeat(F.lit("0"), -power - 1), digits)
        size = F.abs(power).cast("string")
        other = F.concat(mantissa, F.when(power < 0, "e-").otherwise("e+"), F.lpad(size, F.greatest(F.length(size), F.lit(2)), F.lit("0")))
        return F.when(power.between(0, 15), large).when(power.between(-4, -1), small).otherwise(other)

    c = _c(x).cast("double")
    text = c.cast("string")
    plain = (c == 0) | F.abs(c).between(F.lit(1e-3), F.lit(9_999_999.0))  # Spark writes these without an exponent
    special = F.when(F.isnan(c), "nan").when(F.abs(c) == F.lit(float("inf")), F.when(c > 0, "inf").otherwise("-inf"))
    sign = F.when(text.startswith("-"), "-").otherwise("")
    return F.when(plain, text).otherwise(F.coalesce(special, F.when(text.contains("E"), F.concat(sign, _let(F.regexp_replace(text, "^-", ""), placed))).otherwise(text)))


def word_count(x) -> Column:
    """T-16: Python ``len(text.split())``."""
    # the other blanks become plain spaces first: a split at one fixed character needs no regular expression
    plain = F.translate(_c(x), PY_WHITESPACE, " " * len(PY_WHITESPACE))
    return F.size(F.filter(F.split(plain, " "), lambda w: w != ""))
