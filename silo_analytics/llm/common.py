"""Helpers shared by the corpus operators: column checks, bounded samples, linked groups."""

from __future__ import annotations

import contextlib
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..scratch import materialize


# Keys of 8 or 16 bytes that are broadcast at most.
BROADCAST_KEYS = 2_000_000


def table(spark, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def col(name: str) -> Column:
    """A column by its exact name, whatever characters it holds."""
    return F.col("`" + name.replace("`", "``") + "`")


def fold_of(doc_id: Column) -> Column:
    """crc32 of the id as text, modulo 3; a null id counts as the empty text."""
    return F.crc32(F.encode(F.coalesce(doc_id.cast("string"), F.lit("")), "UTF-8")) % 3


def texts_of(column: pa.Array) -> Iterator[bytes | None]:
    """The UTF-8 bytes of each text of an Arrow column."""
    return (v.as_py() for v in column.cast(pa.binary()))


def labelled_rows(docs: DataFrame, labels: DataFrame, label: str, rows: int, seed: int) -> DataFrame:
    """At most about ``rows`` rows (text, label) of the training folds, drawn by a hash of the id.

    Ids labelled both ways, null labels and null ids are left out.  The share to draw is
    taken from a count of the labelled ids, before any text is read; the drawn ids are few and
    broadcast, so that no text is shuffled.
    """
    known = (
        labels.select(col("doc_id").alias("doc_id"), col(label).cast("int").alias("y"))
        .where("doc_id IS NOT NULL AND y IN (0, 1)")
        .groupBy("doc_id")
        .agg(F.min("y").alias("y"), F.max("y").alias("top"))
        .where("y = top")
        .where(fold_of(F.col("doc_id")) != 1)
        .select("doc_id", "y")
    )
    n = known.count()
    if n > rows:
        draw = F.pmod(F.xxhash64(F.lit(seed), F.col("doc_id")), F.lit(1_000_000))
        known = known.where(draw < int(1_000_000 * rows / n))
    texts = docs.select(col("doc_id").alias("doc_id"), F.coalesce(col("text"), F.lit("")).alias("text"))
    return texts.join(F.broadcast(known), "doc_id").select("text", "y")


def select_rows(docs: DataFrame, keys: DataFrame, how: str) -> DataFrame:
    """The rows of ``docs`` whose (doc_id, hash of text) is or is not in ``keys``.

    ``how`` is left_semi or left_anti; ``keys`` has the columns id and text_hash; nulls equal nulls.  Up to ``BROADCAST_KEYS`` counted keys are broadcast, more
    are merged, for which the texts are shuffled.
    """
    with small_batches(docs.sparkSession):
        keys = materialize(keys.select(F.col("id").alias("_key"), F.col("text_hash").alias("_hash")).distinct(), "keys")
    few = keys.count() <= BROADCAST_KEYS
    same = F.col("doc_id").eqNullSafe(F.col("_key")) & F.xxhash64("text").eqNullSafe(F.col("_hash"))
    return docs.join(F.broadcast(keys) if few else keys.hint("merge"), same, how)


def components(edges: DataFrame) -> DataFrame:
    """Connected components of the links (a, b): one row (node, root) per node but the roots.

    The root is the smallest node.  Rounds of large-star and small-star steps, each written
    to the shared scratch folder, until a round changes nothing.  Only minima per node are
    aggregated and every join is between two written tables, so that the rows of a node with
    very many links can be split over tasks.
    """

    def stamp(t: DataFrame) -> tuple:
        return tuple(t.agg(F.count("*"), F.expr("bit_xor(xxhash64(a, b))"), F.expr("sum(pmod(b, 1000003))")).first())

    edges = materialize(
        edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links"
    )
    seen = stamp(edges)
    while seen[0]:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = materialize(both.groupBy("a").agg(F.min("b").alias("m")), "lowest")
        # Larger neighbours of a node move to the smallest of its neighbourhood.
        large = edges.select(F.col("b").alias("a"), F.col("a").alias("v")).join(low, "a")
        large = large.select(F.col("v").alias("a"), F.least("a", "m").alias("b")).where("a <> b")
        large = materialize(large.distinct(), "large-star")
        low = materialize(large.groupBy("a").agg(F.min("b").alias("m")), "lowest")
        small = large.join(low, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        small = small.unionByName(low.select("a", F.col("m").alias("b")))
        edges = materialize(small.distinct(), "small-star")
        now = stamp(edges)
        if now == seen:
            break
        seen = now
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))


# ------------------------------------------------------------------ hashing in tasks
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_K1, _K2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def mix(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """One 64-bit hash per ordered pair of 64-bit hashes."""
    with np.errstate(over="ignore"):
        h = a * _K1 + np.uint64(1)
        h ^= h >> np.uint64(29)
        h += b * _K2
        h ^= h >> np.uint64(30)
        h *= _M1
        h ^= h >> np.uint64(27)
        h *= _M2
        h ^= h >> np.uint64(31)
    return h


BLANKS = np.isin(np.arange(256), [32, *range(9, 14)])


class Words:
    """Places and hashes of the words of some texts, without an object per word.

    ``start`` and ``stop`` are byte places in ``data``, ``inside`` tells the bytes of words, ``text`` numbers the text of each word and
    ``first`` has the number of the first word of each text, and of one more.
    """

    def __init__(self, column: pa.Array, separators: np.ndarray) -> None:
        column = column.cast(pa.large_binary()).fill_null(b"")
        n = len(column)
        offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + n + 1]
        low, high = (int(offsets[0]), int(offsets[-1])) if n else (0, 0)
        self.offsets = offsets - low if n else np.zeros(1, np.int64)
        buffer = column.buffers()[2]
        self.data = np.frombuffer(buffer, np.uint8)[low:high] if buffer is not None else np.zeros(0, np.uint8)
        size = high - low
        inside = np.zeros(size + 1, bool)  # one blank more
        np.logical_not(separators[self.data], out=inside[:size])
        fresh = np.zeros(size + 1, bool)
        fresh[self.offsets] = True
        begins = inside.copy()
        begins[1:] &= ~inside[:-1] | fresh[1:]
        ends = inside[:size] & (~inside[1:] | fresh[1:])
        self.inside = inside[:size]
        self.start, self.stop = np.flatnonzero(begins), np.flatnonzero(ends) + 1
        self.first = np.searchsorted(self.start, self.offsets)
        self.counts = np.diff(self.first)
        self.text = np.repeat(np.arange(n), self.counts)

    def hashes(self, seed: int, same: bytes | None = None) -> np.ndarray:
        """A 64-bit hash per word; ``same`` maps bytes that count as equal to one byte."""
        draw = np.random.default_rng(seed)
        letters = draw.integers(0, 2**64, 256, dtype=np.uint64)
        if same is not None:
            letters = letters[np.frombuffer(same, np.uint8)]
        base = int(draw.integers(0, 2**64, dtype=np.uint64)) | 1
        up, down = _powers(base, len(self.data) + 1)
        total = np.zeros(len(self.data) + 1, np.uint64)
        np.cumsum(letters[self.data] * up[: len(self.data)], out=total[1:])
        value = (total[self.stop] - total[self.start]) * down[self.start]
        return mix(value, (self.stop - self.start).astype(np.uint64))


def _powers(base: int, n: int, _held: dict = {}) -> tuple[np.ndarray, np.ndarray]:  # noqa: B006
    """base**i and base**-i modulo 2**64 for i < n; the longest asked for so far is held."""
    if base not in _held or len(_held[base][0]) < n:
        size = max(n, 1 << 19)
        up = np.full(size, base, np.uint64)
        down = np.full(size, pow(base, -1, 1 << 64), np.uint64)
        up[0] = down[0] = 1
        _held[base] = np.cumprod(up, dtype=np.uint64), np.cumprod(down, dtype=np.uint64)
    return _held[base]


def trimmed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The batches; what is freed after each goes back to the system, for the worker may live on."""
    for batch in batches:
        yield batch
        del batch
        pa.default_memory_pool().release_unused()


@contextlib.contextmanager
def small_batches(spark: SparkSession, rows: int = 1_000) -> Iterator[None]:
    """Jobs run inside hand texts to Python in batches of at most ``rows``, so that workers stay small."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, str(min(rows, int(before)) if int(before) > 0 else rows))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def pieces(batches: Iterator[pa.RecordBatch], column: str, size: int = 512 << 10) -> Iterator[pa.RecordBatch]:
    """Slices of rows with about ``size`` bytes of text; a longer text is a slice by itself."""
    for batch in trimmed(batches):
        lengths = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        part = np.cumsum(lengths, dtype=np.int64) // size
        cuts = np.flatnonzero(np.diff(part)) + 1
        for i, j in zip([0, *cuts.tolist()], [*cuts.tolist(), batch.num_rows]):
            if j > i:
                yield batch.slice(i, j - i)


def lists(owner: np.ndarray, count: int, values: pa.Array) -> pa.ListArray:
    """One list per owner 0 to count - 1, from values in the order of their owners."""
    return pa.ListArray.from_arrays(pa.array(starts(np.bincount(owner, minlength=count)), pa.int32()), values)


def starts(lengths: Iterable[int]) -> np.ndarray:
    """0 and the running totals of the lengths."""
    return np.concatenate([[0], np.cumsum(np.fromiter(lengths, np.int64))])


def crc(data: bytes) -> int:
    return zlib.crc32(data) & 0xFFFFFFFF


# ------------------------------------------------------------------ hot keys and running totals
# A key with more than this share of all rows is hot; there are fewer than this many hot keys.
HOT_KEYS = 10_000


def uneven_join(big: DataFrame, lookup: DataFrame, on: list[str], sizes: DataFrame, rows: str = "n") -> DataFrame:
    """Left join to a lookup with unique keys, where some keys may hold most rows of ``big``.

    ``sizes`` has the keys and ``n`` (or another name, ``rows``), the rows of each key in ``big``.  Keys with over 10,000 rows and
    over 1/10,000 of all rows are fewer than 10,000: their lookup rows are broadcast, and the rows
    of all other keys are shuffled.  ``big`` is read twice where there is a hot key, so it should be a
    written table.  Keys must not be null.
    """
    total = sizes.agg(F.sum(rows)).first()[0] or 0
    hot = sizes.where(F.col(rows) > max(HOT_KEYS, total // HOT_KEYS)).select(*on)
    hot = materialize(hot.join(lookup, on), "hot-keys")
    if hot.isEmpty():
        return big.join(lookup, on, "left")
    cold = big.join(F.broadcast(hot.select(*on)), on, "left_anti").join(lookup, on, "left")
    return cold.unionByName(big.join(F.broadcast(hot), on))


PIECE_ROWS = 500_000


def running(rows: DataFrame, key: str, order: list[str], sums: dict[str, str], xors: dict[str, str], name: str) -> DataFrame:
    """Adds running totals per key: ``sums`` and ``xors`` map new names to columns of integers.

    The rows are cut into pieces by range, so a key with very many rows lies in several pieces.
    Each piece is added up by itself and shifted by the earlier pieces of its key; only the first
    key of a piece can have any, so there are fewer shifts than pieces.  The result is a written table.
    """
    pieces = max(2, rows.sparkSession.sparkContext.defaultParallelism, rows.count() // PIECE_ROWS)
    tie = "_tie"
    placed = rows.withColumn(tie, F.monotonically_increasing_id())
    placed = placed.repartitionByRange(pieces, key, *order, tie).withColumn("_piece", F.spark_partition_id())
    upto = Window.partitionBy("_piece", key).orderBy(*order, tie).rowsBetween(Window.unboundedPreceding, 0)
    parts = [F.sum(c).over(upto).alias(n) for n, c in sums.items()] + [F.bit_xor(c).over(upto).alias(n) for n, c in xors.items()]
    inside = materialize(placed.select("*", *parts).drop(tie), f"{name}-pieces")
    totals = [F.sum(c).alias(f"_{n}") for n, c in sums.items()] + [F.bit_xor(c).alias(f"_{n}") for n, c in xors.items()]
    per = inside.groupBy(key, "_piece").agg(*totals)
    earlier = Window.partitionBy(key).orderBy("_piece").rowsBetween(Window.unboundedPreceding, -1)
    before = [F.sum(f"_{n}").over(earlier).alias(f"_{n}") for n in sums] + [F.bit_xor(f"_{n}").over(earlier).alias(f"_{n}") for n in xors]
    place = F.row_number().over(Window.partitionBy(key).orderBy("_piece")).alias("_nth")
    shifts = per.select(key, "_piece", place, *before).where("_nth > 1").drop("_nth")
    shifts = materialize(shifts, f"{name}-shifts")
    out = inside.join(F.broadcast(shifts), [key, "_piece"], "left")
    nothing = F.lit(0).cast("long")
    shifted = {n: (F.col(n) + F.coalesce(f"_{n}", nothing)).alias(n) for n in sums}
    shifted |= {n: F.col(n).bitwiseXOR(F.coalesce(f"_{n}", nothing)).alias(n) for n in xors}
    return materialize(out.select(*rows.columns, *shifted.values()), name)


# ------------------------------------------------------------------ bitmaps of fixed size
# Bits of a bitmap of hashes: 8 MB at every size of the data.
FILTER_BITS = 26


def bits_of(rows: DataFrame, hash_col: str) -> np.ndarray:
    """A bitmap with the bits set that the first bits of 64-bit hashes name, added up by Spark."""
    word = F.shiftrightunsigned(hash_col, 64 - FILTER_BITS + 6).cast("int").alias("word")
    bit = F.shiftrightunsigned(hash_col, 64 - FILTER_BITS).bitwiseAND(F.lit(63)).cast("int").alias("bit")
    found = rows.select(word, bit).groupBy("word").agg(F.expr("bit_or(shiftleft(1L, bit))").alias("bits")).toArrow()
    out = np.zeros(1 << (FILTER_BITS - 6), np.uint64)
    out[found.column("word").to_numpy()] = found.column("bits").to_numpy().view(np.uint64)
    return out


def has_bit(bits: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Whether the bit of each hash is set; some are set for other hashes."""
    h = hashes.view(np.uint64)
    word, bit = h >> np.uint64(64 - FILTER_BITS + 6), (h >> np.uint64(64 - FILTER_BITS)) & np.uint64(63)
    return ((bits[word] >> bit) & np.uint64(1)).astype(bool)
