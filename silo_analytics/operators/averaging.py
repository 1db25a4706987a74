"""Averaging, pulling and merging of model parameters."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.vectors import blend, pull_coefficients, relative_importance


def weighted_mean(df: DataFrame, value: str, weight: str, by: Sequence[str] = (), name: str = "mean") -> DataFrame:
    """Sum(value * weight) / sum(weight); 0 when the weights add up to nothing."""
    total = F.sum(F.col(weight))
    mean = F.sum(F.col(value) * F.col(weight)) / F.nullif(total, F.lit(0))
    return df.groupBy(*by).agg(F.coalesce(mean, F.lit(0.0)).alias(name))


def average_vectors(
    df: DataFrame, vector: str, weight: str, by: Sequence[str] = (), name: str = "params"
) -> DataFrame:
    """Row-count-weighted mean of parameter vectors, element by element.

    The vectors are taken apart by position and added up before the shuffle; what
    is put together again is one value per position.
    """
    cells = df.select(*by, F.col(weight).alias("_w"), F.posexplode(vector).alias("_pos", "_v"))
    means = cells.groupBy(*by, "_pos").agg((F.sum(F.col("_v") * F.col("_w")) / F.sum("_w")).alias("_mean"))
    packed = F.array_sort(F.collect_list(F.struct("_pos", "_mean")))
    return means.groupBy(*by).agg(F.transform(packed, lambda s: s["_mean"]).alias(name))


def check_averageable(df: DataFrame, vector: str, weight: str) -> None:
    """Refuse an empty set, vectors of different length and a total weight of zero."""
    r = df.agg(
        F.count(F.lit(1)).alias("rows"),
        F.min(F.size(vector)).alias("shortest"),
        F.max(F.size(vector)).alias("longest"),
        F.sum(weight).alias("total"),
    ).first()
    if r.rows == 0:
        raise ValueError("nothing to average")
    if r.shortest != r.longest:
        raise ValueError(f"vectors of {r.shortest} and {r.longest} values cannot be averaged")
    if not r.total:
        raise ValueError("the weights add up to zero")


def pull_toward(df: DataFrame, local: str, target: str, mu: float, size: int, name: str = "params") -> DataFrame:
    """(1 - mu) * local + mu * target for the coefficients, mu at most 1; intercept as it was."""
    return df.withColumn(name, pull_coefficients(F.col(local), F.col(target), mu, size))


def merge_half(df: DataFrame, a: str, b: str, name: str = "params") -> DataFrame:
    """The plain mean of two parameter vectors, intercept included."""
    return df.withColumn(name, blend(F.col(a), F.col(b), 0.5))


def importances(df: DataFrame, params: str, size: int, name: str = "importances") -> DataFrame:
    return df.withColumn(name, relative_importance(F.col(params), size))


def average_importances(
    df: DataFrame, importance: str, weight: str, by: Sequence[str] = (), name: str = "importances"
) -> DataFrame:
    """Weighted mean of importances; null where the vectors differ in length."""
    cells = df.select(
        *by,
        F.col(weight).alias("_w"),
        F.size(importance).alias("_len"),
        F.posexplode(importance).alias("_pos", "_v"),
    )
    means = cells.groupBy(*by, "_pos").agg(
        (F.sum(F.col("_v") * F.col("_w")) / F.sum("_w")).alias("_mean"),
        F.min("_len").alias("_short"),
        F.max("_len").alias("_long"),
    )
    packed = F.transform(F.array_sort(F.collect_list(F.struct("_pos", "_mean"))), lambda s: s["_mean"])
    same = F.min("_short") == F.max("_long")
    return means.groupBy(*by).agg(F.when(same, packed).alias(name))
