"""Fill small groups up with noisy copies of their own rows.

Only groups below the target are touched, so every group that is ranked or
summarised here has fewer than ``target`` rows.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.hashing import hash_uniform, normal_sql
from ..scratch import join_lookup, materialize, quoted
from .ranking import running_total

# Noise relative to the spread of the column in the group, and the smallest usable spread.
NOISE_SHARE = 0.05
TINY = 1e-6
LAST_RESORT = 0.01


def jitter_stats(df: DataFrame, group: str, columns: Sequence[str]) -> DataFrame:
    """Per group and column the noise scale and whether the column is 0/1.

    The scale is the population deviation; if that is next to nothing, 5 % of the
    mean absolute value; if that is too, 0.01.  A column without values counts
    as 0/1.
    """
    raw = []
    for i, c in enumerate(columns):
        x = f"nanvl(cast({quoted(c)} AS double), NULL)"
        raw += [
            F.expr(f"stddev_pop({x}) AS sd{i}"),
            F.expr(f"avg(abs({x})) * {NOISE_SHARE}D AS level{i}"),
            F.expr(f"coalesce(bool_and({x} IN (0D, 1D)), true) AS _bin{i}"),
        ]
    scales = [
        f"CASE WHEN sd{i} >= {TINY}D THEN sd{i} WHEN level{i} >= {TINY}D THEN level{i} "
        f"ELSE {LAST_RESORT}D END AS _scale{i}"
        for i in range(len(columns))
    ]
    kept = [f"_bin{i}" for i in range(len(columns))]
    return df.groupBy(group).agg(*raw).selectExpr(quoted(group), *scales, *kept)


def jitter(column: str, scale: str, is_binary: str, normal: str) -> Column:
    """column + N(0, 5 % of scale); 0/1 columns are rounded back and null becomes 0.

    Takes column names and the SQL text of a standard normal.
    """
    moved = f"(nanvl(cast({quoted(column)} AS double), NULL) + {scale} * {NOISE_SHARE}D * {normal})"
    clipped = f"coalesce(least(greatest(rint({moved}), 0D), 1D), 0D)"
    return F.expr(f"CASE WHEN {is_binary} THEN {clipped} ELSE {moved} END")


def augment_groups(
    df: DataFrame,
    group: str,
    key: str,
    columns: Sequence[str],
    target: int,
    seed: int,
    subject: str | None = None,
    recompute: Callable[[DataFrame], DataFrame] | None = None,
) -> DataFrame:
    """Real rows plus synthetic rows that bring every group to ``target`` rows.

    ``columns`` are jittered independently; other columns, the label among them,
    are copied.  ``recompute`` may rebuild derived columns of the synthetic rows.
    Rows without a group stay as they are.  ``key`` is an integer id; synthetic
    rows get fresh ids above the largest one.
    """
    real = df.withColumn("is_synthetic", F.lit(False))
    real = real.withColumns({c: F.col(c).cast("double") for c in columns})

    sizes = (
        df.filter(F.col(group).isNotNull())
        .groupBy(group)
        .agg(F.count(F.lit(1)).alias("_n"))
        .filter(F.col("_n") < target)
    )
    small = materialize(join_lookup(real, sizes, [group], "inner"), "small-groups")
    order = Window.partitionBy(group).orderBy(hash_uniform(seed, "order", key), key)
    ranked = small.withColumn("_rank", F.row_number().over(order))

    needs = small.groupBy(group).agg(F.max("_n").alias("_size")).withColumn("_need", F.lit(target) - F.col("_size"))
    top = df.agg(F.max(key).alias("m")).first().m
    draws = (
        running_total(needs, group, "_need", "_before")
        .withColumn("_i", F.explode(F.sequence(F.lit(1), F.col("_need").cast("int"))))
        .withColumn(
            "_rank",
            (F.floor(hash_uniform(seed, "draw", group, "_i") * F.col("_size")) + 1).cast("int"),
        )
        .select(group, "_i", "_rank", (F.lit(top) + F.col("_before") + F.col("_i")).alias("_id"))
    )
    stats = jitter_stats(small, group, columns)
    sampled = draws.join(ranked, [group, "_rank"]).join(stats, group)

    replaced = {
        c: jitter(c, f"_scale{i}", f"_bin{i}", normal_sql(seed, f"noise:{c}", group, "_i"))
        for i, c in enumerate(columns)
    }
    replaced[key] = F.col("_id").cast(df.schema[key].dataType)
    replaced["is_synthetic"] = F.lit(True)
    if subject:
        replaced[subject] = F.concat(F.lit("Syn_"), (F.col("_id") - F.lit(top) - 1).cast("string"))
    synthetic = sampled.withColumns(replaced).select(*real.columns)
    if recompute:
        synthetic = recompute(synthetic).select(*real.columns)
    return real.unionByName(synthetic)
