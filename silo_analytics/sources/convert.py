"""One-off conversion of CSV files to Parquet that many tasks can read.

A compressed CSV file, and one with line breaks inside quotes, is read by a single task.  It is
read so once: its rows become Parquet files of a bounded number of rows, with an id that follows from
their content.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..plans.orchestrate import with_row_ids
from ..scratch import local_table, remove_tree
from .tables import MISSING_TEXTS, read_csv

ROWS_PER_FILE = 1_000_000
_MANIFEST = "current string, source string, n bigint"


def _system(spark: SparkSession, path: str):
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()), place


def source_state(spark: SparkSession, path: str) -> str:
    """A digest of names, lengths and times of the files at ``path``."""
    fs, place = _system(spark, path)
    if not fs.exists(place):
        raise FileNotFoundError(path)
    files = fs.listFiles(place, True)
    found = []
    while files.hasNext():
        status = files.next()
        name = status.getPath().getName()
        if not name.startswith(("_", ".")):
            found.append(f"{status.getPath()}|{status.getLen()}|{status.getModificationTime()}")
    return hashlib.md5("\n".join(sorted(found)).encode()).hexdigest()


def _manifest(spark: SparkSession, target: str) -> tuple[str, str, int] | None:
    """(folder of the data, digest of the source and settings, rows) of the newest finished conversion."""
    fs, place = _system(spark, f"{target}/manifests")
    if not fs.exists(place):
        return None
    done = [s.getPath().getName() for s in fs.listStatus(place) if fs.exists(s.getPath().suffix("/_SUCCESS"))]
    if not done:
        return None
    newest = max(done, key=int)
    row = spark.read.schema(_MANIFEST).parquet(f"{target}/manifests/{newest}").first()
    return (row.current, row.source, row.n)


def read_converted(spark: SparkSession, target: str) -> DataFrame:
    """The rows of the newest finished conversion; one that was broken off is never seen."""
    found = _manifest(spark, target)
    if found is None:
        raise FileNotFoundError(f"nothing converted in {target}")
    return spark.read.parquet(f"{target}/{found[0]}")


def convert_csv(
    spark: SparkSession, source: str, target: str, schema: T.StructType, key: str = "row_id",
    rows_per_file: int = ROWS_PER_FILE, missing: tuple[str, ...] = MISSING_TEXTS,
) -> bool:
    """Convert the CSV file or folder ``source``; tells whether anything was written.

    Line breaks inside quotes are part of the value.  ``key`` becomes the first column: an id from the row's content,
    the same in every run; equal rows are told apart by their number among them.  Files hold at most ``rows_per_file``
    rows.  The data are written to a folder of their own and named by a manifest that is written last, so a run that
    dies leaves what was there readable, and a run over an unchanged source writes nothing.  A file without rows gives an
    empty table.
    """
    if key in schema.names:
        raise ValueError(f"the source has a column {key} of its own")
    settings = f"{source_state(spark, source)}|{schema.simpleString()}|{key}|{rows_per_file}|{missing}"
    state = hashlib.md5(settings.encode()).hexdigest()
    before = _manifest(spark, target)
    if before is not None and before[1] == state:
        return False
    rows = with_row_ids(read_csv(spark, source, schema, missing, multi_line=True), key).select(key, *schema.names)
    n = rows.count()
    folder = f"data-{state[:12]}"
    # A conversion that was broken off may have left part of the folder.
    remove_tree(spark, f"{target}/{folder}")
    spread = rows.repartition(max(1, -(-n // rows_per_file)), key).sortWithinPartitions(key)
    spread.write.option("maxRecordsPerFile", rows_per_file).parquet(f"{target}/{folder}")
    fs, place = _system(spark, f"{target}/manifests")
    taken = [int(s.getPath().getName()) for s in fs.listStatus(place)] if fs.exists(place) else []
    number = max(taken, default=0) + 1
    local_table(spark, [(folder, state, n)], _MANIFEST).coalesce(1).write.parquet(f"{target}/manifests/{number}")
    return True
