"""Column expressions shared by the operators. All of them stay in generated JVM code."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The three scales, their long names, and the upper end of the scale.
DIMENSIONS = ("V", "A", "D")
DIMENSION_NAMES = {"V": "Valence", "A": "Arousal", "D": "Dominance"}
SCALE = 5.0

# What a CSV field may hold to mean "missing".
MISSING_TOKENS = (
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN",
    "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
)


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def is_present(c: Column | str) -> Column:
    """Neither NULL nor NaN, for a floating-point column."""
    c = _col(c)
    return c.isNotNull() & ~F.isnan(c)


def scale_target(c: Column | str) -> Column:
    return _col(c).cast("double") / F.lit(SCALE)


def unscale_prediction(c: Column | str) -> Column:
    """Back to the annotation scale. Values are not clipped."""
    return _col(c).cast("double") * F.lit(SCALE)


def is_scaled(peak: Column) -> Column:
    """Whether a column whose largest value is ``peak`` still lies on the 0-1 scale."""
    return F.coalesce(peak <= F.lit(1.0 + 1e-8), F.lit(False))


def smooth_l1(error: Column | str) -> Column:
    """Quadratic below an absolute error of one, linear above."""
    size = F.abs(_col(error))
    return F.when(size < F.lit(1.0), size * size * F.lit(0.5)).otherwise(size - F.lit(0.5))


def missing_to_null(c: Column | str) -> Column:
    c = _col(c)
    return F.when(~c.isin(*MISSING_TOKENS), c)


def to_number(c: Column | str) -> Column:
    """Lenient conversion: what is no number becomes NULL."""
    text = F.trim(_col(c).cast("string"))
    # A cast also takes type letters, as in "1d", which are no part of a number here.
    return F.when(~text.rlike("[0-9.][dDfF]$"), text.try_cast("double"))


def fixed4(c: Column | str) -> Column:
    """Four decimals; both NaN and NULL are written as ``nan`` and read back as NaN."""
    c = _col(c).cast("double")
    return F.when(is_present(c), F.format_string("%.4f", c)).otherwise(F.lit("nan"))


def dimension_name(c: Column | str) -> Column:
    pairs = [F.lit(text) for item in DIMENSION_NAMES.items() for text in item]
    return F.element_at(F.create_map(*pairs), _col(c))


def number_after_equals(line: Column, label: str | None = None) -> Column:
    """The signed number (or ``nan``) behind ``label =``, or behind the last ``=`` without a label.

    An exponent belongs to the number; what follows the number is left out.
    """
    number = r"([-+]?(?:(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][-+]?[0-9]+)?|[nN][aA][nN]))"
    if label is None:
        found = F.regexp_extract(F.element_at(F.split(line, "="), -1), number, 1)
    else:
        found = F.regexp_extract(line, rf"{label}\s*=\s*{number}", 1)
    return found.try_cast("double")


def rest_after_equals(line: Column) -> Column:
    """All that stands behind the last ``=`` as one number; NULL if it is none."""
    return to_number(F.element_at(F.split(line, "="), -1))


def tokens(text: Column | str) -> Column:
    """Whitespace tokens of the whole text, in order; NULL for a NULL text."""
    return F.array_remove(F.split(_col(text), r"[ \t\n\r\f]+"), "")
