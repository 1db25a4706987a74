"""CSV scans with an explicit schema, and a check of what a folder lacks."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..scratch import local_table, quoted

# Texts that a CSV reader of the pandas family takes for "missing".
MISSING_TEXTS = (
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN",
    "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
)


def list_folder(spark: SparkSession, folder: str) -> list[str] | None:
    """File names in a folder of any Hadoop file system; None when it is no folder."""
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(folder)
    fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(path) or not fs.getFileStatus(path).isDirectory():
        return None
    return sorted(status.getPath().getName() for status in fs.listStatus(path))


def _typed(df: DataFrame, schema: T.StructType, missing: Sequence[str]) -> DataFrame:
    """Texts to the wanted types; missing texts and texts that do not fit become null."""
    out = []
    for f in schema.fields:
        text = F.when(~F.trim(F.col(f.name)).isin(*missing), F.col(f.name))
        if isinstance(f.dataType, T.StringType):
            out.append(text.alias(f.name))
        elif isinstance(f.dataType, (T.IntegerType, T.LongType)):
            # "3.0" is a whole number too
            number = F.trim(text).try_cast("double")
            whole = F.when(number == F.floor(number), number)
            direct = F.trim(text).try_cast(f.dataType)
            out.append(F.coalesce(direct, whole.try_cast(f.dataType)).alias(f.name))
        else:
            out.append(F.trim(text).try_cast(f.dataType).alias(f.name))
    return df.select(*out, *[c for c in df.columns if c not in schema.names])


def _text_schema(names: Sequence[str]) -> T.StructType:
    return T.StructType([T.StructField(n, T.StringType()) for n in names])


def read_csv(
    spark: SparkSession,
    paths: str | Sequence[str],
    schema: T.StructType,
    missing: Sequence[str] = MISSING_TEXTS,
    multi_line: bool = False,
) -> DataFrame:
    """CSV files with a header line; columns are taken by name.

    Only the columns in ``schema`` are read.  The header line of each path names them, so
    every path may have more columns, in any order of its own; files of one folder share a
    header.  ``multi_line`` accepts line breaks inside quotes, at the price that a file is
    read by one task.
    """
    if not isinstance(paths, str):
        parts = [read_csv(spark, p, schema, missing, multi_line) for p in paths]
        return reduce(DataFrame.unionByName, parts)
    reader = spark.read.option("header", True).option("quote", '"').option("escape", '"')
    raw = reader.option("enforceSchema", False).option("multiLine", multi_line).csv(paths)
    absent = [n for n in schema.names if n not in raw.columns]
    if absent:
        raise ValueError(f"columns not in the file: {absent}")
    return _typed(raw.select(*schema.names), schema, missing)


def read_table(
    spark: SparkSession, folder: str, name: str, schema: T.StructType
) -> DataFrame:
    """Table ``name`` of a folder: ``name.csv.gz`` or else ``name.csv``.

    A gzip file is read by one task; convert large ones to Parquet once.
    """
    present = list_folder(spark, folder) or []
    for file in (f"{name}.csv.gz", f"{name}.csv"):
        if file in present:
            return read_csv(spark, f"{folder}/{file}", schema)
    raise FileNotFoundError(f"no {name}.csv.gz or {name}.csv in {folder}; it holds {present[:12]}")


def read_any_case(spark: SparkSession, folder: str, name: str, schema: T.StructType) -> DataFrame:
    """The CSV file whose name equals ``name`` but for upper and lower case."""
    present = list_folder(spark, folder) or []
    same = [f for f in present if f.lower() == name.lower()]
    if not same:
        raise FileNotFoundError(f"no {name} in {folder}")
    chosen = name if name in same else same[0]
    return read_csv(spark, f"{folder}/{chosen}", schema)


def read_sites(
    spark: SparkSession,
    folder: str,
    sites: Sequence[tuple[str, str, int]],
    schema: T.StructType,
    missing: Sequence[str] = (*MISSING_TEXTS, "?"),
) -> DataFrame:
    """Headerless files of several sites in one scan, each row tagged with its site.

    ``sites`` lists (name, region, hospital id); the name is a file or a folder of
    part files.
    """
    raw = spark.read.schema(_text_schema(schema.names)).csv([f"{folder}/{name}" for name, _, _ in sites])
    path = F.col("_metadata.file_path")
    region, number = F.lit(None).cast("string"), F.lit(None).cast("int")
    for name, label, hospital in sites:
        mine = path.endswith(f"/{name}") | path.contains(f"/{name}/")
        region = F.when(mine, F.lit(label)).otherwise(region)
        number = F.when(mine, F.lit(hospital)).otherwise(number)
    tagged = raw.select("*", region.alias("region"), number.alias("hospitalid"))
    return _typed(tagged, schema, missing)


def missing_files(
    spark: SparkSession, folder: str, expected: Mapping[str, Sequence[str]], any_case: bool = False
) -> list[str]:
    """What a folder lacks; ``expected`` maps a table to the file names that will do."""
    present = list_folder(spark, folder)
    if present is None:
        return [f"no folder {folder}"]
    fold = (lambda s: s.lower()) if any_case else (lambda s: s)
    have = {fold(f) for f in present}
    return [
        f"table {table} has no file {', '.join(names)}"
        for table, names in expected.items()
        if not any(fold(n) in have for n in names)
    ]


def check_sources(
    tables: Mapping[str, DataFrame], expected: Mapping[str, Sequence[str]], spark: SparkSession
) -> DataFrame:
    """Rows (table, problem) for expected tables and columns that are not readable."""
    problems = []
    for table, columns in expected.items():
        if table not in tables:
            problems.append((table, "table is missing"))
            continue
        have = set(tables[table].columns)
        problems += [(table, f"column {c} is missing") for c in columns if c not in have]
    return local_table(spark, problems, "table string, problem string")


def profile_sources(tables: Mapping[str, DataFrame], expected: Mapping[str, Mapping[str, str]], spark: SparkSession) -> DataFrame:
    """Rows (table, column, n_rows, n_null, n_uncastable, problem): what the data of the expected columns are like.

    ``expected`` maps tables to columns and their types.  Every table is aggregated once, over its expected
    columns alone.  A value that is there but cannot be cast counts as uncastable.  A missing table has
    one row without a column; a missing column has the table's rows and null counts.  The problem is null where there is none;
    an empty table is one.
    """
    out = []
    for table, columns in expected.items():
        name = F.lit(table).alias("table")
        if table not in tables:
            none = [F.lit(None).cast(t).alias(c) for t, c in (("string", "column"), ("long", "n_rows"), ("long", "n_null"), ("long", "n_uncastable"))]
            out.append(spark.range(1).select(name, *none, F.lit("table is missing").alias("problem")))
            continue
        df, have = tables[table], set(tables[table].columns)
        counts = [F.count(F.lit(1)).alias("n_rows")]
        for i, (column, kind) in enumerate(columns.items()):
            if column in have:
                value = F.col(quoted(column))
                counts.append(F.count_if(value.isNull()).alias(f"null{i}"))
                counts.append(F.count_if(value.isNotNull() & value.try_cast(kind).isNull()).alias(f"bad{i}"))
        found = []
        for i, column in enumerate(columns):
            there = column in have
            numbers = [F.col(f"{c}{i}") if there else F.lit(None).cast("long") for c in ("null", "bad")]
            problem = F.lit("column is missing") if not there else (
                F.when(F.col("n_rows") == 0, "table is empty").when(numbers[1] > 0, "values of another type")
                .when(numbers[0] == F.col("n_rows"), "no value at all")
            )
            found.append(F.struct(
                F.lit(column).alias("column"), F.col("n_rows"), numbers[0].alias("n_null"), numbers[1].alias("n_uncastable"), problem.alias("problem")
            ))
        if found:
            out.append(df.agg(*counts).select(name, F.inline(F.array(*found))))
    return reduce(DataFrame.unionByName, out) if out else local_table(
        spark, [], "table string, column string, n_rows bigint, n_null bigint, n_uncastable bigint, problem string"
    )
