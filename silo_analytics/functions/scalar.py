"""Scalar feature expressions with the null rules of the cohort tables.

A flag is 0/1 and never null; an encoding falls back to a default; a product
either reads null as zero or passes null on, as its name says.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

NUMBER = r"^\s*[-+]?(\d+\.?\d*|\.\d+)([eE][-+]?\d+)?\s*$"


def _flag(condition: Column) -> Column:
    return F.coalesce(condition, F.lit(False)).cast("int")


def flag_equals(col: Column, value) -> Column:
    """1 where ``col`` equals ``value``; null counts as 0."""
    return _flag(col == F.lit(value))


def flag_equals_folded(col: Column, value: str) -> Column:
    """Case-insensitive ``flag_equals``."""
    return flag_equals(F.lower(col), value.lower())


def flag_in(col: Column, values: Sequence) -> Column:
    """1 where ``col`` is one of ``values``; null counts as 0."""
    return _flag(col.isin(*values))


def flag_positive(col: Column) -> Column:
    """1 where ``col`` > 0; null counts as 0."""
    return _flag(col > 0)


def flag_above(col: Column, threshold: float | None) -> Column:
    """1 where null-as-zero ``col`` is strictly above ``threshold``; no threshold gives 0."""
    if threshold is None:
        return F.lit(0)
    return (F.coalesce(col, F.lit(0.0)) > F.lit(threshold)).cast("int")


def encode(col: Column, codes: Mapping[str, int], default: int) -> Column:
    """Code of a category; unknown and null take ``default``."""
    pairs = [F.lit(x) for item in codes.items() for x in item]
    # a null cannot be looked up in a map, so look up the empty string instead
    found = F.create_map(*pairs)[F.coalesce(col, F.lit(""))]
    return F.coalesce(found, F.lit(default))


def to_number(col: Column, replace: Mapping[str, str] | None = None) -> Column:
    """Text to double after literal replacements; text that is no number gives null."""
    text = reduce(
        lambda c, kv: F.replace(c, F.lit(kv[0]), F.lit(kv[1])),
        (replace or {}).items(),
        col.cast("string"),
    )
    return F.when(text.rlike(NUMBER), F.trim(text).try_cast("double"))


def known(col: Column) -> Column:
    """The column as a double, with null for NaN: both mean that the value is missing."""
    return F.nanvl(col.cast("double"), F.lit(None).cast("double"))


def zero_product(*cols: Column) -> Column:
    """Product in which null counts as zero."""
    return reduce(lambda a, b: a * b, [F.coalesce(known(c), F.lit(0.0)) for c in cols])


def product(*cols: Column) -> Column:
    """Product that is null when a factor is null."""
    return reduce(lambda a, b: a * b, [known(c) for c in cols])


def smoothed_ratio(top: Column, bottom: Column) -> Column:
    """top / (bottom + 1); over zero it is infinite with the sign of ``top``, and NaN for zero over zero."""
    over = known(bottom) + F.lit(1)
    return F.when(over == 0, known(top) * F.lit(float("inf"))).otherwise(known(top) / over)


def guarded_ratio(top: Column, bottom: Column) -> Column:
    """top / (bottom + 1) where bottom > 0, else 0."""
    return F.when(known(bottom) > 0, smoothed_ratio(top, bottom)).otherwise(F.lit(0.0))


def differs_or_null(col: Column, value) -> Column:
    """``col`` is not ``value``; a null differs."""
    return ~col.eqNullSafe(F.lit(value))


def relabel_null(col: Column, label: str = "Unknown") -> Column:
    return F.coalesce(col, F.lit(label))


def threshold_class(probability: Column, cut: float = 0.5) -> Column:
    return (probability >= F.lit(cut)).cast("int")
