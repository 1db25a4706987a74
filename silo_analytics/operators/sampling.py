"""Stratified splits, folds and label-skewed partitions.

Every assignment is a comparison with a few cuts in hash order (see
``ranking``), so the sizes are exact and no row is shuffled.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ranking import cut_segments, wanted_ranks


def class_counts(df: DataFrame, by: Sequence[str], label: str) -> DataFrame:
    """One row per group with the rows of class 0 and class 1."""
    return df.groupBy(*by).agg(
        F.count_if(F.col(label) == 0).alias("n0"), F.count_if(F.col(label) == 1).alias("n1")
    )


def _by_class(counts: DataFrame, by: Sequence[str], label: str, values: Sequence[Column]) -> DataFrame:
    """One row per (group, class) with the value of that class."""
    entries = [
        F.struct(F.lit(c).alias(label), F.col(f"n{c}").alias("n"), v.cast("long").alias("quota"))
        for c, v in enumerate(values)
    ]
    return (
        counts.select(*by, F.explode(F.array(*entries)).alias("e"))
        .select(*by, f"e.{label}", "e.n", "e.quota")
        .filter(F.col("n") > 0)
    )


def test_quotas(counts: DataFrame, fraction: float, at_least_one: bool) -> tuple[Column, Column]:
    """Test rows of class 0 and 1: ceil(fraction * n) in all, shared by largest remainder.

    ``at_least_one`` keeps a row of each class on both sides where the class has two.
    """
    n0, n1 = F.col("n0"), F.col("n1")
    total = F.ceil(F.round((n0 + n1) * F.lit(fraction), 9))
    share = [total * n / (n0 + n1) for n in (n0, n1)]
    base = [F.floor(F.round(s, 9)) for s in share]
    left = total - base[0] - base[1]
    first_is_positive = (share[1] - base[1]) >= (share[0] - base[0])
    quota = [
        base[0] + F.when(first_is_positive, F.greatest(left - 1, F.lit(0))).otherwise(F.least(left, F.lit(1))),
        base[1] + F.when(first_is_positive, F.least(left, F.lit(1))).otherwise(F.greatest(left - 1, F.lit(0))),
    ]
    if at_least_one:
        quota = [
            F.when(n >= 2, F.greatest(F.lit(1), F.least(q, n - 1))).otherwise(F.lit(0))
            for q, n in zip(quota, (n0, n1))
        ]
    return quota[0], quota[1]


def stratified_split(
    df: DataFrame,
    label: str,
    key: str,
    fraction: float,
    seed: int,
    by: Sequence[str] = (),
    name: str = "is_test",
) -> DataFrame:
    """Mark an exact, seeded, class-stratified share of the rows as test rows.

    With ``by`` the split is done inside every group and keeps a row of each
    class on both sides; a null group is a group.  A row whose label is not 0 or 1
    gets null: it is on neither side.
    """
    group = [*by, label]
    counts = class_counts(df, by, label)
    quotas = _by_class(counts, by, label, test_quotas(counts, fraction, bool(by)))
    salt = "split" + "".join(f":{c}" for c in by)
    wanted = wanted_ranks(quotas, group, [F.col("quota")])
    marked = cut_segments(df, group, key, seed, salt, wanted, "_segment")
    return marked.withColumn(name, F.col("_segment") == 0).drop("_segment")


def stratified_folds(
    df: DataFrame, label: str, key: str, folds: int, seed: int, name: str = "fold"
) -> DataFrame:
    """Add a fold number 0 .. folds-1; each class is spread evenly, to within one row.

    A row whose label is not 0 or 1 gets null.
    """
    counts = class_counts(df, (), label)
    sizes = _by_class(counts, (), label, [F.col("n0"), F.col("n1")])
    ranks = [F.floor(F.col("n") * j / folds) for j in range(1, folds)]
    return cut_segments(df, [label], key, seed, "fold", wanted_ranks(sizes, [label], ranks), name)


def skew_proportions(silos: int, alpha: float, seed: int) -> dict[int, list[float]]:
    """Dirichlet shares of the silos for class 1 and class 0."""
    draw = np.random.default_rng(seed)
    return {c: draw.dirichlet([alpha] * silos).tolist() for c in (1, 0)}


def skew_partition(
    df: DataFrame,
    label: str,
    key: str,
    silos: int,
    alpha: float,
    seed: int,
    name: str = "silo",
) -> DataFrame:
    """Spread each class over ``silos`` by Dirichlet shares (small alpha = strong skew).

    Sizes are rounded down and the last silo takes what is left.  A row whose label is not 0
    or 1 gets null.
    """
    if silos < 1 or alpha <= 0:
        raise ValueError("silos must be at least 1 and alpha positive")
    shares = skew_proportions(silos, alpha, seed)
    counts = class_counts(df, (), label)
    sizes = _by_class(counts, (), label, [F.col("n0"), F.col("n1")])
    ranks, running = [], F.lit(0)
    for i in range(silos - 1):
        share = F.when(F.col(label) == 1, F.lit(shares[1][i])).otherwise(F.lit(shares[0][i]))
        running = running + F.floor(share * F.col("n"))
        ranks.append(running)
    if not ranks:
        return df.withColumn(name, F.when(F.col(label).isin(0, 1), F.lit(0)))
    return cut_segments(df, [label], key, seed, "skew", wanted_ranks(sizes, [label], ranks), name)
