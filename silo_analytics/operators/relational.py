"""Counts, de-duplication, existence marks and dimension joins of the cohort tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def count_per_key(df: DataFrame, key: str, name: str, keep: Column | None = None) -> DataFrame:
    """Rows per key, optionally only those for which ``keep`` holds."""
    kept = df if keep is None else df.filter(keep)
    return kept.groupBy(key).agg(F.count(F.lit(1)).alias(name))


def attach(base: DataFrame, side: DataFrame, on: str, zero: Sequence[str] = ()) -> DataFrame:
    """Left join a side with unique keys; the ``zero`` columns read a missing row as 0."""
    joined = base.join(side, on, "left")
    return joined.withColumns({c: F.coalesce(F.col(c), F.lit(0)) for c in zero})


def max_row_per_key(
    df: DataFrame,
    key: str,
    score: str,
    tie_breakers: Sequence[str],
    payload: Sequence[str],
    nulls: str = "first",
) -> DataFrame:
    """The row with the highest score of every key.

    ``nulls="first"`` lets a row without a score beat the scored rows (the
    behaviour of sort-then-keep-last); ``"last"`` takes it only when the key has
    no scored row.  The maximum is combined before the shuffle, so a hot key
    sends one row per task.
    """
    if nulls not in ("first", "last"):
        raise ValueError("nulls is 'first' or 'last'")
    missing = F.col(score).isNull()
    preference = missing if nulls == "first" else ~missing
    order = F.struct(
        preference.alias("p"),
        F.col(score).alias("s"),
        *[F.col(c).alias(f"t{i}") for i, c in enumerate(tie_breakers)],
    )
    names = list(dict.fromkeys([score, *payload]))
    best = df.groupBy(key).agg(F.max_by(F.struct(*names), order).alias("_best"))
    return best.select(key, *[F.col(f"_best.{c}").alias(c) for c in names])


def mark_exists(df: DataFrame, keys: DataFrame, on: str, flag: str) -> DataFrame:
    """Add a 0/1 column telling whether the row's key occurs in ``keys``."""
    present = keys.select(on).filter(F.col(on).isNotNull()).distinct().withColumn("_hit", F.lit(1))
    return df.join(present, on, "left").withColumn(flag, F.coalesce("_hit", F.lit(0))).drop("_hit")


def first_row_marked(df: DataFrame, key: str, order: Sequence[str], payload: Sequence[str], flag: str) -> DataFrame:
    """The first row of every key, and 0/1 whether the key has another row; rows with a null key are one key.

    One scan and one aggregate: every map task sends one row per key, however many rows a key has.
    ``order`` should tell the rows of a key apart.
    """
    names = list(dict.fromkeys([*order, *payload]))
    first = F.min_by(F.struct(*names), F.struct(*[F.struct(F.col(c).isNotNull(), F.col(c)) for c in order])).alias("_first")
    found = df.groupBy(key).agg(first, (F.count(F.lit(1)) > 1).cast("int").alias(flag))
    return found.select(key, *[F.col(f"_first.{c}").alias(c) for c in names if c != key], flag)


def first_rows(df: DataFrame, key: str, order: Sequence[str], n: int, rank: str) -> DataFrame:
    """The first ``n`` rows of every key with their rank.

    Spark limits the group inside every map task before the shuffle, so a hot
    key sends n rows per task.
    """
    window = Window.partitionBy(key).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(window)).filter(F.col(rank) <= n)


def label_profile(df: DataFrame, label: str, by: Sequence[str] = ()) -> DataFrame:
    """Rows, positives and the rate in percent with one decimal."""
    return df.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"),
        F.sum(F.col(label).cast("long")).alias("n_pos"),
        F.round(F.avg(F.col(label).cast("double")) * 100, 1).alias("rate_pct"),
    )


def group_label_counts(df: DataFrame, group: str, label: str) -> DataFrame:
    """Rows, positives and negatives per group; rows without a group are left out."""
    return (
        df.filter(F.col(group).isNotNull())
        .groupBy(group)
        .agg(
            F.count(label).alias("n"),
            F.coalesce(F.sum(F.col(label).cast("long")), F.lit(0)).alias("n_pos"),
            F.count_if(F.col(label) == 0).alias("n_neg"),
        )
    )


def size_gate(stats: DataFrame, min_n: int, min_pos: int, min_neg: int) -> DataFrame:
    """Mark the groups that are large enough to be candidates."""
    ok = (F.col("n") >= min_n) & (F.col("n_pos") >= min_pos) & (F.col("n_neg") >= min_neg)
    return stats.withColumn("candidate", ok)


def trainable(stats: DataFrame, min_n: int = 5) -> DataFrame:
    """Mark the silos that cannot be trained: too few rows or only one class."""
    skip = (F.col("n") < min_n) | (F.col("n_pos") < 1) | (F.col("n_neg") < 1)
    return stats.withColumn("skipped", skip)


def group_size_profile(df: DataFrame, group: str) -> DataFrame:
    """Number of groups, mean and smallest group size; a group-less row is no group."""
    sizes = df.filter(F.col(group).isNotNull()).groupBy(group).agg(F.count(F.lit(1)).alias("n"))
    return sizes.agg(
        F.count(F.lit(1)).alias("groups"),
        F.avg("n").alias("mean_size"),
        F.min("n").alias("min_size"),
    )


def distinct_keys(df: DataFrame, column: str) -> DataFrame:
    """Sorted distinct non-null values."""
    return df.select(column).filter(F.col(column).isNotNull()).distinct().orderBy(column)


def hospital_profile(df: DataFrame, hospital: str, label: str, attributes: Sequence[str]) -> DataFrame:
    """Rows, label rate and the (constant) attributes of every hospital."""
    return (
        df.filter(F.col(hospital).isNotNull())
        .groupBy(hospital)
        .agg(
            F.count(label).alias("n"),
            F.avg(F.col(label).cast("double")).alias("rate"),
            *[F.max(F.col(a).cast("double")).alias(a) for a in attributes],
        )
    )


def stack_tables(*tables: DataFrame) -> DataFrame:
    """Union by column name; a column a table lacks is null there."""
    out = tables[0]
    for other in tables[1:]:
        out = out.unionByName(other, allowMissingColumns=True)
    return out
