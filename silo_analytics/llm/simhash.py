"""SimHash near-duplicates through pivot distance tables.

A fingerprint has a bit set where over half of the hashes of the word shingles have it set.
Fingerprints at most ``max_bits`` apart are linked, and links join into groups.

Candidates: the 64 bits are cut into ``blocks`` blocks.  Two fingerprints at most k bits apart
agree on at least blocks - k of them, so they meet under one of the choices of that many
blocks.  The number of blocks follows the number of distinct fingerprints, so that a bucket
of unrelated ones stays small at every size.

Pivots: inside a bucket, the rows are in the order of their distance to the first reference
fingerprint.  A Hamming distance differs between two fingerprints by no more than these are
apart, so the sweep stops where the first coordinate differs by over k, and further pairs are
discarded while any coordinate differs by over k.  The survivors are verified bit by bit.

A bucket of many near copies is dealt into pairs of chunks of bounded size.  A task keeps only
the links that connect something new (at most one per member), never all pairs of a bucket.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..scratch import materialize
from .common import col, components, select_rows, small_batches, starts, texts_of, trimmed

CHUNK = 1024
PIVOTS = 16
_UNPACK = 1 << 15


def _reference(count: int) -> np.ndarray:
    """Seeded reference fingerprints."""
    return np.random.default_rng(20_240_611).integers(0, 2**64, count, dtype=np.uint64)


def _signed(value: int) -> int:
    return value - (1 << 64) if value >> 63 else value


def fingerprint(text: bytes | None, shingle: int = 4) -> int:
    """The SimHash of one text; 0 for a text without words."""
    import xxhash

    words = text.lower().split() if text else []
    if not words:
        return 0
    whole = b" ".join(words)
    if len(words) <= shingle:
        return xxhash.xxh64_intdigest(whole, 42)
    digest = xxhash.xxh64_intdigest
    begin = starts(len(w) + 1 for w in words)
    first, last = begin[: len(words) - shingle + 1].tolist(), (begin[shingle:] - 1).tolist()
    n = len(first)
    hashes = np.fromiter((digest(whole[i:j], 42) for i, j in zip(first, last)), np.uint64, n)
    counts = np.zeros(64, np.int64)
    for at in range(0, n, _UNPACK):
        part = hashes[at : at + _UNPACK].astype("<u8").view(np.uint8).reshape(-1, 8)
        counts += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > n, bitorder="little").view("<u8")[0])


def _fingerprints(batches: Iterator[pa.RecordBatch], shingle: int) -> Iterator[pa.RecordBatch]:
    for batch in trimmed(batches):
        values = [_signed(fingerprint(t, shingle)) for t in texts_of(batch.column("text"))]
        yield pa.record_batch(
            [batch.column("id"), batch.column("text_hash"), pa.array(values, pa.int64())], ["id", "text_hash", "fp"]
        )


def _links(batches: Iterator[pa.RecordBatch], max_bits: int) -> Iterator[pa.RecordBatch]:
    """Verified links of each block; rows come in the order of (block, first coordinate)."""
    pivots = _reference(PIVOTS)
    held: list[np.ndarray] | None = None

    def flush(rows: list[np.ndarray]) -> pa.RecordBatch:
        a, b = _sweep(*rows, pivots, max_bits)
        return pa.record_batch([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], ["a", "b"])

    for batch in batches:
        rows = [
            batch.column("block").to_numpy(), batch.column("side").to_numpy(),
            batch.column("fp").to_numpy().view(np.uint64),
        ]
        if held is not None:
            rows = [np.concatenate(pair) for pair in zip(held, rows)]
        cut = int(np.searchsorted(rows[0], rows[0][-1])) if len(rows[0]) else 0
        if cut:
            yield flush([r[:cut] for r in rows])
        held = [r[cut:] for r in rows]
    if held is not None and len(held[0]):
        yield flush(held)


def _sweep(
    block: np.ndarray, side: np.ndarray, fp: np.ndarray, pivots: np.ndarray, max_bits: int
) -> tuple[np.ndarray, np.ndarray]:
    n = len(fp)
    table = np.bitwise_count(fp[None, :] ^ pivots[:, None]).astype(np.int16)
    root = np.arange(n)
    left = np.arange(n)
    found: list[tuple[np.ndarray, np.ndarray]] = []

    def top(i: int) -> int:
        while root[i] != i:
            i = root[i]
        return i

    for k in range(1, n):
        left = left[left + k < n]
        right = left + k
        near = (block[left] == block[right]) & (table[0][right] - table[0][left] <= max_bits)
        left = left[near]
        if not len(left):
            break
        i, j = left, left + k
        # side 2 marks a block that holds one chunk; otherwise only pairs across two chunks count
        open_ = ((side[i] == 2) | (side[i] != side[j])) & (root[i] != root[j])
        i, j = i[open_], j[open_]
        for line in table[1:]:
            if not len(i):
                break
            close = np.abs(line[i] - line[j]) <= max_bits
            i, j = i[close], j[close]
        sure = np.bitwise_count(fp[i] ^ fp[j]) <= max_bits
        i, j = i[sure], j[sure]
        kept = []
        for x, y in zip(i.tolist(), j.tolist()):
            p, q = top(x), top(y)
            if p != q:
                root[max(p, q)] = min(p, q)
                kept.append((x, y))
        if kept:
            x, y = np.array(kept).T
            found.append((fp[x], fp[y]))
            while not np.array_equal(root, root[root]):
                root = root[root]
    if not found:
        return fp[:0], fp[:0]
    return np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found])


def _masks(blocks: int, keep: int) -> list[int]:
    edges = np.linspace(0, 64, blocks + 1).astype(int).tolist()
    parts = [((1 << (hi - lo)) - 1) << lo for lo, hi in zip(edges, edges[1:])]
    return [_signed(sum(chosen)) for chosen in combinations(parts, keep)]


def blocks_for(count: int, max_bits: int) -> int:
    """The fewest blocks whose keys have room for ``count`` unrelated fingerprints."""
    for blocks in range(max_bits + 1, max_bits + 5):
        if count <= 1 << ((64 // blocks) * (blocks - max_bits)):
            break
    return blocks


def links(fps: DataFrame, max_bits: int = 4) -> DataFrame:
    """Links (a, b) that connect all fingerprints at most ``max_bits`` apart.

    ``fps`` has one column fp of distinct fingerprints and is read several times.  The links
    join the same fingerprints as all close pairs would, without listing all of them.
    """
    blocks = blocks_for(fps.count(), max_bits)
    masks = F.array(*[F.lit(m) for m in _masks(blocks, blocks - max_bits)])
    keys = fps.select("fp", F.posexplode(masks).alias("choice", "mask"))
    keys = keys.select("fp", "choice", F.col("fp").bitwiseAND(F.col("mask")).alias("key"))
    sizes = keys.groupBy("choice", "key").agg(F.count("*").alias("n")).where("n > 1")
    sizes = materialize(sizes, "bucket-sizes")
    members = keys.join(sizes, ["choice", "key"])
    members = members.withColumn("chunks", F.ceil(F.col("n") / CHUNK).cast("int"))
    members = members.withColumn("chunk", F.pmod(F.xxhash64(F.lit(7), "fp"), F.col("chunks")).cast("int"))
    members = members.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    members = members.select(
        "fp",
        F.xxhash64("choice", "key", F.least("chunk", "other"), F.greatest("chunk", "other"), F.col("chunks")).alias("block"),
        F.expr("CASE WHEN chunk = other THEN 2 WHEN chunk < other THEN 0 ELSE 1 END").alias("side"),
    )
    first = F.lit(_signed(int(_reference(PIVOTS)[0])))
    near = F.bit_count(F.col("fp").bitwiseXOR(first)).alias("near")
    ordered = members.select("block", "side", "fp", near).repartition("block").sortWithinPartitions("block", "near")
    return ordered.select("block", "side", "fp").mapInArrow(partial(_links, max_bits=max_bits), "a long, b long")


def simhash_groups(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 4, max_bits: int = 4
) -> DataFrame:
    """One row per input row: id, text_hash, fp (long), root (long) and component_id.

    ``root`` names the group of linked fingerprints, ``component_id`` is its smallest id.
    Null and empty texts have fingerprint 0 and are linked like any other.  Null ids take
    part but are never the smallest, unless a group has no other (then component_id is
    null).  Repeated rows give repeated rows.  Other input columns are not read.
    """
    rows = docs.select(
        col(id_col).alias("id"), col(text_col).alias("text"), F.xxhash64(col(text_col)).alias("text_hash")
    )
    kind = rows.schema["id"].dataType.simpleString()
    prints = rows.mapInArrow(partial(_fingerprints, shingle=shingle), f"id {kind}, text_hash long, fp long")
    with small_batches(docs.sparkSession):
        prints = materialize(prints, "fingerprints")
    fps = materialize(prints.groupBy("fp").agg(F.min("id").alias("first")), "distinct-fingerprints")
    groups = components(links(fps.select("fp"), max_bits))
    rooted = fps.join(groups, F.col("fp") == F.col("node"), "left").select(
        "fp", F.coalesce("root", "fp").alias("root"), "first"
    )
    rooted = materialize(rooted, "rooted")
    smallest = materialize(rooted.groupBy("root").agg(F.min("first").alias("component_id")), "smallest")
    named = materialize(rooted.select("fp", "root").join(smallest, "root"), "named")
    return prints.join(named, "fp").select("id", "text_hash", "fp", "root", "component_id")


def keep_one_per_group(docs: DataFrame, shingle: int = 4, max_bits: int = 4) -> DataFrame:
    """The rows of ``docs``, one per group: that of the smallest doc_id (ties: smallest text hash).

    A null doc_id comes after all others.  Of rows repeated with the same doc_id and text, one
    stays.  All columns of ``docs`` are returned.
    """
    groups = materialize(simhash_groups(docs, "doc_id", "text", shingle, max_bits), "groups")
    rank = F.struct(F.col("id").isNull().alias("missing"), "id", "text_hash")
    keep = groups.groupBy("root").agg(F.min(rank).alias("r")).select("r.id", "r.text_hash")
    kept = select_rows(docs, keep, "left_semi")
    if groups.count() > groups.select("id", "text_hash").distinct().count():
        kept = kept.dropDuplicates(["doc_id", "text"])
    return kept
