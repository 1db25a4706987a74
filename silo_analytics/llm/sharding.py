"""A global shuffle of any number of rows by two passes, and shards of equal counts.

Pass 1 scatters the rows into buckets that fit in memory, by a seeded hash.  Pass 2 sorts each
bucket by that hash, puts it into a random order (the shuffle function is a Fisher-Yates
shuffle, seeded per bucket) and writes it.  Buckets one after the other are the shuffled order;
shards are equal stretches of it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..scratch import materialize
from .common import col

BUCKET_BYTES = 16 << 20
# A table with a row per bucket is broadcast up to this size.
BROADCAST_BUCKETS = 200_000
ROW_BYTES = 16


def text_size(text_col: str = "text"):
    return F.coalesce(F.octet_length(col(text_col)), F.lit(0)).cast("long") + ROW_BYTES


def shuffle_rows(df: DataFrame, seed: int, key_cols: list[str], size, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """Written rows (bucket, place, row) in a random order within buckets of about ``bucket_bytes``.

    ``row`` holds all columns of ``df``.  ``size`` is the size of a row in bytes.  The place of a
    row among the input's partitions takes part in the hash, so that identical rows spread over
    buckets too; the same files read in the same way give the same order.
    """
    total = df.agg(F.sum(size)).first()[0] or 0
    buckets = max(1, -(-int(total) // bucket_bytes))
    draw = F.xxhash64(F.lit(seed), *[col(c) for c in key_cols], F.monotonically_increasing_id())
    rows = df.select(F.struct(*[col(c) for c in df.columns]).alias("row"), draw.alias("draw"))
    rows = rows.withColumn("bucket", F.pmod("draw", F.lit(buckets)).cast("int"))
    rows = rows.repartitionById(buckets, F.col("bucket")).sortWithinPartitions("bucket", "draw")
    mixed = rows.groupBy("bucket").agg(F.collect_list("row").alias("rows"))
    mixed = mixed.select("bucket", F.posexplode(F.shuffle("rows", seed)).alias("place", "row"))
    return materialize(mixed, "shuffled")


def with_positions(shuffled: DataFrame) -> tuple[DataFrame, int]:
    """The written rows with their position in the whole order, and the number of rows."""
    counts = shuffled.groupBy("bucket").agg(F.count("*").alias("n"))
    before = Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = materialize(counts.select("bucket", "n", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before")), "offsets")
    size = offsets.agg(F.count("*"), F.sum("n")).first()
    small = offsets.select("bucket", "before")
    if size[0] <= BROADCAST_BUCKETS:
        small = F.broadcast(small)
    return shuffled.join(small, "bucket").withColumn("position", F.col("before") + F.col("place")), int(size[1] or 0)


def equal_shards(positioned: DataFrame, rows: int, shards: int) -> DataFrame:
    """Adds shard (0 to shards - 1, counts at most one apart) and slot (gapless from 0)."""
    base, extra = divmod(rows, shards)
    edge = extra * (base + 1)
    at = F.col("position")
    late = at - edge
    return positioned.withColumns(
        {
            "shard": F.when(at < edge, F.floor(at / (base + 1))).otherwise(extra + F.floor(late / max(base, 1))).cast("int"),
            "slot": F.when(at < edge, at % (base + 1)).otherwise(late % max(base, 1)).cast("long"),
        }
    )


def shard_documents(
    docs: DataFrame, shards: int = 40, seed: int = 5, id_col: str = "doc_id", text_col: str = "text",
    bucket_bytes: int = BUCKET_BYTES,
) -> DataFrame:
    """All rows with their columns in ``row``, and shard and slot, read from the shuffled files.

    Null ids and texts are rows like others; repeated rows get places of their own.  Columns
    with any name are kept inside ``row``.  No rows give no shard.
    """
    size = text_size(text_col)
    shuffled = shuffle_rows(docs, seed, [id_col, text_col], size, bucket_bytes)
    positioned, rows = with_positions(shuffled)
    return equal_shards(positioned, rows, shards).select("shard", "slot", "row")
