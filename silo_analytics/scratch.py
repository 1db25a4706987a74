"""Shared scratch tables and size-checked joins.

Intermediate results that are read more than once (training tables, score
tables, per-silo parameters) are written as Parquet below the folder the session
names in ``spark.checkpoint.dir``.  A lost executor then costs a re-read, not a
recomputation, and the plan of the next step starts at a scan.
"""

from __future__ import annotations

import itertools
import tempfile
import uuid
from collections.abc import Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

# A lookup side is broadcast only when a count and the width of its rows show it to be this small.
BROADCAST_BYTES = 64 << 20
# Results up to this size are held by the driver between two steps.
DRIVER_ROWS = 10_000
# Rows of one key that a task may join when a lookup is too large to be broadcast.
ROWS_PER_SALT = 1_000_000

_numbers = itertools.count()


def scratch_root(spark: SparkSession) -> str:
    """The folder for intermediate tables, as named by the session."""
    context = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if named:
        return named.rstrip("/")
    if not context.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
    context.setCheckpointDir(tempfile.mkdtemp(prefix="silo-scratch-"))
    return context.getCheckpointDir().rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    app = spark.sparkContext.applicationId
    return f"{scratch_root(spark)}/silo/{app}/{name}-{next(_numbers)}-{uuid.uuid4().hex[:8]}"


def materialize(df: DataFrame, name: str, partition_by: Sequence[str] = ()) -> DataFrame:
    """Write ``df`` to a scratch table and return a scan of it."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.partitionBy(*partition_by).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def remove_tree(spark: SparkSession, path: str) -> None:
    """Delete a scratch folder, in whatever store it lies."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def collect_bounded(df: DataFrame, limit: int) -> list[Row] | None:
    """Rows of a small result, or None when there are more than ``limit``."""
    rows = df.limit(limit + 1).collect()
    return rows if len(rows) <= limit else None


def local_table(spark: SparkSession, rows: Sequence[Sequence], schema: str) -> DataFrame:
    """A few driver-side rows as a table whose size the optimizer knows."""
    fields = T.StructType.fromDDL(schema)
    columns = list(zip(*rows)) if rows else [() for _ in fields]
    arrow = to_arrow_schema(fields)
    arrays = [pa.array(list(c), f.type) for c, f in zip(columns, arrow)]
    return spark.createDataFrame(pa.Table.from_arrays(arrays, schema=arrow), fields)


def settle(df: DataFrame, limit: int, name: str) -> tuple[DataFrame, bool]:
    """Fix a result that later steps read again: as local rows up to ``limit``, else as a table.

    The flag tells whether the size bound held, i.e. whether it may be broadcast.
    """
    found = df.limit(limit + 1).toArrow()
    if found.num_rows > limit:
        return materialize(df, name), False
    return df.sparkSession.createDataFrame(found, df.schema), True


def null_safe_join(left: DataFrame, right: DataFrame, on: Sequence[str], how: str = "inner") -> DataFrame:
    """Equi-join in which null equals null; the key columns are those of ``left``."""
    a, b = left.alias("_a"), right.alias("_b")
    same = [F.col(f"_a.{quoted(c)}").eqNullSafe(F.col(f"_b.{quoted(c)}")) for c in on]
    condition = same[0]
    for part in same[1:]:
        condition = condition & part
    joined = a.join(b, condition, how)
    if how == "left_semi":
        return joined
    added = [F.col(f"_b.{quoted(c)}") for c in right.columns if c not in on]
    return joined.select(*[F.col(f"_a.{quoted(c)}") for c in left.columns], *added)


def quoted(name: str) -> str:
    """A column name for SQL text, whatever characters it holds."""
    return "`" + name.replace("`", "``") + "`"


def join_lookup(
    big: DataFrame,
    lookup: DataFrame,
    on: Sequence[str],
    how: str = "left",
    limit: int = BROADCAST_BYTES,
) -> DataFrame:
    """Equi-join a large table to a lookup with unique keys, safe for hot and null keys.

    ``lookup`` is computed once; its rows are counted and their width measured.  Within
    ``limit`` bytes it is broadcast.  Above that it is copied as often as the largest key of
    ``big`` needs and joined on (key, salt), so that a hot key is spread over several tasks.
    """
    if how not in ("left", "inner", "left_semi"):
        raise ValueError(f"join_lookup cannot do a {how} join")
    found = lookup.limit(DRIVER_ROWS + 1).toArrow()
    if found.num_rows <= DRIVER_ROWS and found.nbytes <= limit:
        small = lookup.sparkSession.createDataFrame(found, lookup.schema)
        return null_safe_join(big, F.broadcast(small), on, how)
    small = materialize(lookup, "lookup")
    if small.count() * found.nbytes <= limit * max(found.num_rows, 1):
        return null_safe_join(big, F.broadcast(small), on, how)
    hottest = big.groupBy(*on).agg(F.count(F.lit(1)).alias("_n")).agg(F.max("_n")).first()[0] or 0
    salts = -(-hottest // ROWS_PER_SALT) or 1
    salted = small.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    spread = big.withColumn("_salt", F.pmod(F.xxhash64(*big.columns), F.lit(salts)).cast("int"))
    return null_safe_join(spread, salted, [*on, "_salt"], how).drop("_salt")
