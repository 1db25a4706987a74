"""Median fill and standard scaling, fitted on training rows."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalar import known
from ..scratch import local_table, quoted
from .quantiles import exact_medians, quantiles_and


@dataclass(frozen=True)
class FittedPrep:
    """Median, mean and population deviation of every feature, in feature order."""

    features: tuple[str, ...]
    median: tuple[float, ...]
    mean: tuple[float, ...]
    std: tuple[float, ...]

    def table(self, spark: SparkSession) -> DataFrame:
        rows = list(zip(self.features, self.median, self.mean, self.std))
        return local_table(spark, rows, "feature string, median double, mean double, std_pop double")

    def scaled(self, feature: str) -> str:
        """SQL text of the filled and scaled feature."""
        i = self.features.index(feature)
        filled = f"coalesce(nanvl(cast({quoted(feature)} AS double), NULL), {self.median[i]!r}D)"
        return f"({filled} - {self.mean[i]!r}D) / {(self.std[i] if self.std[i] > 0 else 1.0)!r}D"

    def transform(self, df: DataFrame, name: str = "features") -> DataFrame:
        """Add the filled and scaled feature vector."""
        return df.withColumn(name, F.expr(f"array({', '.join(map(self.scaled, self.features))})"))


def fit_prep(df: DataFrame, features: Sequence[str]) -> FittedPrep:
    """Exact medians, and mean and deviation of the filled columns, in two passes.

    A feature without any value is refused: there is nothing to fill it with.
    """
    moments = []
    for i in range(len(features)):
        moments += [F.expr(f"count(c{i}) AS k{i}"), F.expr(f"avg(c{i}) AS m{i}"), F.expr(f"stddev_pop(c{i}) AS s{i}")]
    found, row = quantiles_and(df, {f: (0.5,) for f in features}, [F.count(F.lit(1)).alias("rows"), *moments])
    empty = [f for f in features if found[f, 0.5] is None]
    if empty:
        raise ValueError(f"no values to fit: {empty}")
    means, stds = [], []
    for i, f in enumerate(features):
        # the filled column is the known values plus (rows - known) copies of the median
        known, filled, median = row[f"k{i}"], row.rows - row[f"k{i}"], found[f, 0.5]
        mean = (known * row[f"m{i}"] + filled * median) / row.rows
        spread = known * (row[f"s{i}"] ** 2 + (row[f"m{i}"] - mean) ** 2) + filled * (median - mean) ** 2
        means.append(mean)
        stds.append((spread / row.rows) ** 0.5)
    return FittedPrep(tuple(features), tuple(found[f, 0.5] for f in features), tuple(means), tuple(stds))


def fill_medians(df: DataFrame, columns: Sequence[str], stats_from: DataFrame | None = None) -> DataFrame:
    """Replace nulls and NaN by the column median of ``stats_from`` (default: the same rows)."""
    medians = exact_medians(df if stats_from is None else stats_from, columns)
    return df.withColumns(
        {c: F.coalesce(known(F.col(c)), F.lit(medians[c])) for c in columns if medians[c] is not None}
    )
