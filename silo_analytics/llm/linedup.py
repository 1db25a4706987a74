"""Repeated passages of lines: windows of three lines that were there before.

Consecutive lines are hashed and every three neighbouring hashes make a window.  A window that
is found more than once stays at its first place, in the order of (doc_id, text hash, copy, line);
the lines of the later ones are removed.  Covered positions of overlapping windows are merged.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..scratch import materialize
from .common import col

LINES = 3


# Rows written for the copies of one text by one step of the explosion.
COPIES = 10_000


def _split(text: Column) -> Column:
    return F.when(F.octet_length(text) > 0, F.split(text, "\n")).otherwise(F.array().cast("array<string>"))


def _rows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(no_id, id, text_hash, text); the hash is the first 60 bits of the MD5."""
    text = F.coalesce(col(text_col), F.lit(""))
    digest = F.conv(F.substring(F.md5(text.cast("binary")), 1, 15), 16, 10).cast("long")
    return docs.select(col(id_col).isNull().alias("no_id"), col(id_col).alias("id"), digest.alias("text_hash"), text.alias("text"))


def later_windows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(no_id, id, text_hash, places): first lines of the windows to remove, per document with any."""
    rows = _rows(docs, id_col, text_col).withColumn("lines", _split(F.col("text"))).where(F.size("lines") >= LINES)
    hashed = rows.select(
        "no_id", "id", "text_hash", F.transform("lines", lambda x: F.xxhash64(F.lit(1), x)).alias("a"),
        F.transform("lines", lambda x: F.xxhash64(F.lit(2), x, F.octet_length(x))).alias("b"),
    )
    # Two copies of the array, shifted by one and two lines, line up the windows.
    moved = [F.slice("a", F.lit(k + 1), F.size("a") - (LINES - 1)) for k in range(LINES)]
    again = [F.slice("b", F.lit(k + 1), F.size("b") - (LINES - 1)) for k in range(LINES)]
    pairs = F.arrays_zip(
        *[m.alias(f"a{k}") for k, m in enumerate(moved)], *[m.alias(f"b{k}") for k, m in enumerate(again)]
    )
    windows = hashed.select("no_id", "id", "text_hash", F.posexplode(pairs).alias("place", "w")).select(
        "no_id", "id", "text_hash", "place", F.xxhash64("w.a0", "w.a1", "w.a2").alias("a"),
        F.xxhash64("w.b2", "w.b1", "w.b0").alias("b"),
    )
    windows = materialize(windows, "line-windows")
    spot = F.struct("no_id", "id", "text_hash", "place")
    first = windows.groupBy("a", "b").agg(F.count("*").alias("n"), F.min(spot).alias("first")).where("n > 1")
    first = materialize(first.select("a", "b", "first"), "repeated-line-windows")
    later = windows.join(first, ["a", "b"]).where(spot != F.col("first"))
    places = later.groupBy("no_id", "id", "text_hash").agg(F.array_sort(F.collect_set("place")).alias("places"))
    return materialize(places, "later-line-windows")


def remove_later_windows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id, n_lines, n_removed and kept (the text that stays).

    Null and empty texts have no lines and keep an empty text.  A text of fewer than three lines
    has no window.  Of rows that agree in id and text, null ids included, all but one are later
    copies: every window of theirs was there before, so all their lines go if there are three or
    more.  Null ids come after all others.  Other columns are not read.
    """
    places = later_windows(docs, id_col, text_col)
    # Copies of a row meet before the shuffle; what a copy keeps follows from its number.
    name = F.coalesce(F.col("id").cast("string"), F.lit("")).alias("name")
    rows = _rows(docs, id_col, text_col).withColumn("name", name).groupBy("no_id", "name", "text_hash")
    rows = rows.agg(F.first("id").alias("id"), F.first("text").alias("text"), F.count("*").alias("n"))
    places = places.select("no_id", name, "text_hash", "places")
    # Shuffled at every size: the texts meet the places by a merge, however few places there are.
    rows = rows.withColumn("lines", _split(F.col("text")))
    joined = rows.join(places.hint("merge"), ["no_id", "name", "text_hash"], "left").select("id", "lines", "places", "n")
    places = F.col("places")
    # Windows that touch or overlap make one covered stretch, from a head to the end of a tail.
    heads = F.filter(places, lambda x, i: (i == 0) | (x > F.get(places, i - 1) + LINES))
    tails = F.filter(places, lambda x, i: (i == F.size(places) - 1) | (F.get(places, i + 1) > x + LINES))
    spans = joined.select("id", "lines", "n", heads.alias("heads"), F.transform(tails, lambda x: x + LINES).alias("ends"))
    size = F.size("lines")
    begins = F.concat(F.array(F.lit(0)), F.col("ends"))
    gaps = F.zip_with(
        begins, F.concat(F.col("heads"), F.array(size)), lambda b, e: F.slice(F.col("lines"), b + 1, F.greatest(e - b, F.lit(0)))
    )
    kept = F.when(F.col("heads").isNull(), F.col("lines")).otherwise(F.flatten(gaps))
    out = spans.select("id", size.cast("long").alias("n_lines"), kept.alias("kept"))
    first = out.select(
        "id", "n_lines", (F.col("n_lines") - F.size("kept")).cast("long").alias("n_removed"),
        F.array_join("kept", "\n").alias("kept"),
    )
    return first.unionByName(_copies(docs, id_col, text_col))


def _copies(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """The rows of ``remove_later_windows`` for all but one of the rows that agree in id and text."""
    name = F.coalesce(F.col("id").cast("string"), F.lit(""))
    lines = F.size(_split(F.col("text"))).cast("long")
    rows = _rows(docs, id_col, text_col).withColumn("name", name).withColumn("n_lines", lines)
    rows = rows.withColumn("short", F.when(F.col("n_lines") < LINES, F.col("text")))
    groups = rows.groupBy("no_id", "name", "text_hash").agg(
        F.first("id").alias("id"), F.first("n_lines").alias("n_lines"), F.first("short").alias("short"), F.count("*").alias("n")
    )
    groups = groups.where("n > 1").select("id", "n_lines", "short", (F.col("n") - 1).alias("more"))
    # A group of very many copies is written by several tasks.
    parts = groups.select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("more") - 1) / COPIES).cast("long"))).alias("part"))
    parts = materialize(parts, "line-copies")
    parts = parts.repartition(max(1, min(parts.count(), parts.sparkSession.sparkContext.defaultParallelism)))
    last = F.least(F.col("more") - F.col("part") * COPIES, F.lit(COPIES).cast("long"))
    each = parts.select("id", "n_lines", "short", F.explode(F.sequence(F.lit(1).cast("long"), last)).alias("copy"))
    removed = F.when(F.col("n_lines") >= LINES, F.col("n_lines")).otherwise(F.lit(0).cast("long"))
    return each.select("id", "n_lines", removed.alias("n_removed"), F.coalesce("short", F.lit("")).alias("kept"))
