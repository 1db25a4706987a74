"""Algebra on ``array<double>`` columns, kept inside generated code where the length is known."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def constant(values: Sequence[float]) -> Column:
    """A constant ``array<double>``, parsed in one call."""
    return F.expr("array(" + ", ".join(f"{float(v)!r}D" for v in values) + ")")


def probability(features: str, params: str, size: int) -> Column:
    """sigmoid(x.w + b) for params laid out as [w_0 .. w_{size-1}, b]; both are column names."""
    terms = [f"{features}[{i}] * {params}[{i}]" for i in range(size)]
    return F.expr(f"1.0D / (1.0D + exp(-({' + '.join(terms)} + {params}[{size}])))")


def dense(entries: str, size: int) -> Column:
    """``array<double>`` of ``size`` numbers from an array of structs (place, value); the others are 0.

    Places differ and lie in 0 .. size - 1.  Every entry follows the zeros since the one before.
    """
    ordered = F.array_sort(entries)
    after = F.concat(F.array(F.lit(-1)), F.transform(ordered, lambda e: e["place"]))

    def run(e: Column, before: Column) -> Column:
        return F.concat(F.array_repeat(F.lit(0.0), e["place"] - before - 1), F.array(e["value"]))

    runs = F.zip_with(ordered, F.slice(after, 1, F.size(ordered)), run)
    return F.concat(F.flatten(runs), F.array_repeat(F.lit(0.0), size - 1 - F.element_at(after, -1)))


def blend(a: Column, b: Column, share: float) -> Column:
    """(1 - share) * a + share * b, element by element."""
    return F.zip_with(a, b, lambda x, y: x * F.lit(1.0 - share) + y * F.lit(share))


def pull_coefficients(local: Column, target: Column, mu: float, size: int) -> Column:
    """Move the ``size`` coefficients toward ``target`` by mu (at most 1); keep the intercept."""
    share = min(mu, 1.0)
    moved = blend(F.slice(local, 1, size), F.slice(target, 1, size), share)
    return F.concat(moved, F.slice(local, size + 1, 1))


def relative_importance(params: Column, size: int) -> Column:
    """|coefficient| divided by the largest; all zeros stay zeros."""
    sizes = F.transform(F.slice(params, 1, size), lambda v: F.abs(v))
    top = F.array_max(sizes)
    return F.transform(sizes, lambda v: F.when(top > 0, v / top).otherwise(v))
