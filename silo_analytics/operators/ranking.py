"""Ranks and rank cuts inside groups of any size.

The order within a group is (hash uniform, key).  The uniform is also the
bucket number, so a group of a billion rows falls into equal buckets that are
counted before they are shuffled; no window ever sees a whole group.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.hashing import hash_uniform
from ..scratch import join_lookup, null_safe_join, settle

CUT_BUCKETS = 4096
# Rows that one task may order, on average.
ROWS_PER_BUCKET = 200_000
# Cuts kept on the driver: (groups x cuts) rows of three values.
CUT_ROWS = 100_000


def _bucket(u: Column, buckets: int) -> Column:
    return F.floor(u * F.lit(float(buckets))).cast("int")


def buckets_for(df: DataFrame, group: Sequence[str], per_bucket: int = ROWS_PER_BUCKET) -> int:
    """Buckets that leave about ``per_bucket`` rows of the largest group in each."""
    largest = df.groupBy(*group).agg(F.count(F.lit(1)).alias("_n")).agg(F.max("_n")).first()[0] or 0
    return max(1, -(-largest // per_bucket))


def rank_in_group(
    df: DataFrame,
    group: Sequence[str],
    key: str,
    seed: int,
    salt: str,
    name: str = "rank",
    buckets: int | None = None,
) -> DataFrame:
    """Add the 1-based rank of each row in its group, in hash order.

    A null group is a group like any other.  ``buckets`` follows from the largest group
    unless it is given.
    """
    buckets = buckets or buckets_for(df, group)
    spread = df.withColumn("_u", hash_uniform(seed, salt, key))
    spread = spread.withColumn("_b", _bucket(F.col("_u"), buckets))
    counts = spread.groupBy(*group, "_b").agg(F.count(F.lit(1)).alias("_n"))
    earlier = Window.partitionBy(*group).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(
        *group, "_b", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_earlier")
    )
    local = Window.partitionBy(*group, "_b").orderBy("_u", key)
    return (
        null_safe_join(spread.withColumn("_r", F.row_number().over(local)), offsets, [*group, "_b"])
        .withColumn(name, (F.col("_r") + F.col("_earlier")).cast("long"))
        .drop("_u", "_b", "_r", "_earlier")
    )


def running_total(df: DataFrame, key: str, amount: str, name: str, buckets: int | None = None) -> DataFrame:
    """Add the sum of ``amount`` over all rows earlier in hash order of ``key``."""
    buckets = buckets or buckets_for(df, [])
    spread = df.withColumn("_u", hash_uniform(0, "total", key))
    spread = spread.withColumn("_b", _bucket(F.col("_u"), buckets))
    sums = spread.groupBy("_b").agg(F.sum(amount).alias("_s"))  # one row per bucket
    whole = Window.partitionBy(F.lit(0)).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select("_b", F.coalesce(F.sum("_s").over(whole), F.lit(0)).alias("_earlier"))
    local = Window.partitionBy("_b").orderBy("_u", key).rowsBetween(Window.unboundedPreceding, -1)
    return (
        spread.withColumn("_l", F.coalesce(F.sum(amount).over(local), F.lit(0)))
        .join(offsets, "_b")
        .withColumn(name, F.col("_l") + F.col("_earlier"))
        .drop("_u", "_b", "_l", "_earlier")
    )


def wanted_ranks(counts: DataFrame, group: Sequence[str], ranks: Sequence[Column]) -> DataFrame:
    """Rows (group, cut, rank) from one rank expression per cut."""
    entries = [
        F.struct(F.lit(i).alias("cut"), r.cast("long").alias("rank")) for i, r in enumerate(ranks)
    ]
    return counts.select(*group, F.explode(F.array(*entries)).alias("e")).select(
        *group, "e.cut", "e.rank"
    )


def rank_cuts(
    df: DataFrame,
    group: Sequence[str],
    key: str,
    seed: int,
    salt: str,
    wanted: DataFrame,
    buckets: int = CUT_BUCKETS,
) -> tuple[DataFrame, bool]:
    """Where in hash order the wanted ranks of each group lie, and whether there are few of them.

    ``wanted`` has the group columns, ``cut`` and ``rank`` (1-based; 0 lies before
    every row).  Counts per bucket find the bucket of every cut; only the rows of
    those buckets, about one in ``buckets``, are ordered.
    """
    u = hash_uniform(seed, salt, key)
    spread = df.select(*group, F.col(key).alias("_k"), u.alias("_u"))
    spread = spread.withColumn("_b", _bucket(F.col("_u"), buckets))
    upto = Window.partitionBy(*group).orderBy("_b")
    counts = (
        spread.groupBy(*group, "_b")
        .agg(F.count(F.lit(1)).alias("_n"))
        .withColumn("_upto", F.sum("_n").over(upto))
    )
    rank, before = F.col("rank"), F.col("_upto") - F.col("_n")
    # a cut of rank 0 is kept with the first bucket
    inside = (rank <= F.col("_upto")) & ((rank > before) | ((rank <= 0) & (before == 0)))
    hits = (
        null_safe_join(counts, wanted, group)
        .filter(inside)
        .select(*group, "_b", "cut", F.greatest(rank - before, F.lit(0)).alias("_local"))
    )
    hits, few = settle(hits, CUT_ROWS, "hits")
    inner = hits.filter(F.col("_local") > 0)
    order = Window.partitionBy(*group, "_b", "cut").orderBy("_u", "_k")
    found = (
        null_safe_join(spread, F.broadcast(inner) if few else inner, [*group, "_b"])
        .withColumn("_r", F.row_number().over(order))
        .filter(F.col("_r") == F.col("_local"))
        .select(*group, "cut", F.col("_u").alias("cut_u"), F.col("_k").alias("cut_key"))
    )
    start = hits.filter(F.col("_local") == 0).select(
        *group,
        "cut",
        F.lit(-1.0).alias("cut_u"),
        F.lit(None).cast(df.schema[key].dataType).alias("cut_key"),
    )
    return found.unionByName(start), few


def cut_segments(
    df: DataFrame, group: Sequence[str], key: str, seed: int, salt: str, wanted: DataFrame, name: str
) -> DataFrame:
    """Add the number of the group's cuts that lie before the row (0 = up to the first cut).

    Null where the group has no cuts: such rows, e.g. those without a label, are in no segment.

    A scan with a comparison per cut: no row of ``df`` is shuffled while the cut
    table stays within its checked size.
    """
    cuts, few = rank_cuts(df, group, key, seed, salt, wanted)
    place = F.struct(hash_uniform(seed, salt, key).alias("u"), F.col(key).alias("k"))
    cut = F.struct(F.col("cut_u").alias("u"), F.col("cut_key").alias("k"))
    arrays = cuts.groupBy(*group).agg(F.collect_list(cut).alias("_cuts"))  # a few cuts per group
    if few:
        joined = null_safe_join(df, F.broadcast(arrays), group, "left")
    else:
        joined = join_lookup(df, arrays, group)
    # through an array of one, so that a row is hashed once and not once per cut
    passed = F.transform(F.array(place), lambda p: F.size(F.filter("_cuts", lambda c: c < p)))[0]
    return joined.withColumn(name, F.when(F.col("_cuts").isNotNull(), passed)).drop("_cuts")
