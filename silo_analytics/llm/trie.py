"""A prefix trie of conversations, added up by depth bands.

A node is a distinct beginning of conversations: depth turns, each told by its role and text.
Its key is (depth, a, b), where a and b are two 64-bit hashes of (place, turn) combined by
exclusive or.  Such hashes run along a conversation like a running total, so a conversation
with very many turns is cut into pieces like any other sorted rows.

Totals over subtrees go up in bands of ``band`` depths.  A node is exploded only to its ancestors
within its band, whose keys lie on the path of its smallest member.  Before that, the nodes are
added up into the tops of their bands, the tops into the tops of bands of bands, and so on, so
that there are log_band(deepest) rounds; then the finished totals of band tops are handed to the
nodes right above them, from the coarsest bands to the finest.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..scratch import materialize
from .common import col, running, uneven_join

BAND = 8
KEY = ["depth", "a", "b"]
# Bytes of joined ids in one row.
RUN_BYTES = 64 << 10


def ordered_turns(
    turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text"
) -> DataFrame:
    """(conv, place, digest, bytes) of each turn; places count from 0 in the order of the turn number.

    Null turn numbers come first; turns with one number are ordered by the digest of role and
    text.  Null roles and texts count as empty.  Rows without a conversation are left out.
    Repeated rows are turns of their own.  Other columns are not read.
    """
    role, text = F.coalesce(col(role_col), F.lit("")), F.coalesce(col(text_col), F.lit(""))
    digest = F.md5(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text).cast("binary"))
    # A null comes first in Spark's ascending order.
    rows = turns.where(col(conv_col).isNotNull()).select(
        col(conv_col).cast("long").alias("conv"), col(turn_col).alias("turn"), digest.alias("digest"),
        F.octet_length(text).cast("long").alias("bytes"), F.lit(1).cast("long").alias("one"),
    )
    ranked = running(rows, "conv", ["turn", "digest"], {"place": "one"}, {}, "turn-places")
    return ranked.select("conv", (F.col("place") - 1).alias("place"), "digest", "bytes")


def borrowed_beginnings(turns: DataFrame, base: Column, taken: Column) -> tuple[DataFrame, DataFrame]:
    """Conversations that begin like others: (turns rebuilt, sizes).

    ``turns`` are rows of ``ordered_turns``; ``base`` and ``taken`` are expressions of ``conv``: whose beginning
    it takes and how many turns of it, at most (a small number).  Its own turns follow, without as
    many at its beginning.  A base that is not there gives nothing, a shorter one all it has.
    ``sizes`` has every conversation with its number of turns, 0 included.
    """
    sizes = turns.groupBy("conv").agg(F.count("*").alias("n"))
    sizes = materialize(sizes.select("conv", "n", base.alias("base"), taken.cast("long").alias("taken")), "conversation-sizes")
    whole = sizes.select(F.col("conv").alias("base"), F.col("n").alias("there"))
    plan = sizes.join(whole, "base", "left").select(
        "conv", "base", "taken", F.least("taken", F.coalesce("there", F.lit(0).cast("long"))).alias("lent")
    )
    plan = materialize(plan, "conversation-plans")
    top = plan.agg(F.max("taken")).first()[0] or 0
    first = turns.where(F.col("place") < top).withColumnRenamed("conv", "base")
    lent = plan.join(first, "base").where("place < lent").select("conv", "place", "digest", "bytes")
    own = uneven_join(turns, plan.select("conv", "taken", "lent"), ["conv"], sizes).where("place >= taken")
    own = own.select("conv", (F.col("place") - F.col("taken") + F.col("lent")).alias("place"), "digest", "bytes")
    kept = F.greatest(F.col("n") - F.col("taken"), F.lit(0).cast("long")) + F.col("lent")
    rebuilt = sizes.select("conv", "n").join(plan, "conv").select("conv", kept.alias("n"))
    return materialize(lent.unionByName(own), "rebuilt-turns"), materialize(rebuilt, "rebuilt-sizes")


def _sum_up(rows: DataFrame, name: str) -> DataFrame:
    total = rows.groupBy(*KEY).agg(F.min("conv").alias("conv"), F.sum("leaves").alias("leaves"), F.sum("saved").alias("saved"))
    return materialize(total, name)


def subtree_totals(nodes: DataFrame, paths: DataFrame, deepest: int, band: int = BAND) -> DataFrame:
    """Sums of ``leaves`` and ``saved`` over the subtrees of the nodes (depth, a, b, conv, leaves, saved).

    ``conv`` is any member of the node; ``paths`` has (conv, depth, a, b) of every turn of every conversation.
    """
    cells, step = [nodes], 1
    while step * band < deepest:
        # The sums of the cells of a band go to the top of the band.
        wide = step * band
        top = (F.floor((F.col("depth") - 1) / wide) * wide + 1).cast("long")
        moved = cells[-1].select("conv", top.alias("depth"), "leaves", "saved").join(paths, ["conv", "depth"])
        cells.append(_sum_up(moved, "band-tops"))
        step = wide
    totals = None
    for cell in reversed(cells):
        if totals is not None:
            # Finished totals of band tops go to the nodes right above them.
            above = totals.where(F.col("depth") > step).select("conv", (F.col("depth") - step).alias("depth"), "leaves", "saved")
            above = above.join(paths, ["conv", "depth"]).select(*KEY, "conv", "leaves", "saved")
            cell = cell.select(*KEY, "conv", "leaves", "saved").unionByName(above)
            cell = cell.groupBy(*KEY).agg(F.min("conv").alias("conv"), F.sum("leaves").alias("leaves"), F.sum("saved").alias("saved"))
        wide = step * band
        top = (F.floor((F.col("depth") - 1) / wide) * wide + 1).cast("long")
        ancestors = F.explode(F.sequence(top, F.col("depth"), F.lit(step).cast("long"))).alias("depth")
        exploded = cell.select("conv", ancestors, "leaves", "saved").join(paths, ["conv", "depth"])
        totals = _sum_up(exploded, "band-totals")
        step //= band
    return totals


def _joined_ids(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted rows (depth, a, b, conv) as runs of comma-joined ids of one node."""
    node, first, held, size = None, 0, [], 0

    def run() -> pa.RecordBatch:
        columns = [pa.array([x], pa.int64()) for x in (*node, first)]
        return pa.record_batch([*columns, pa.array([",".join(held)])], [*KEY, "first", "ids"])

    for batch in batches:
        for *key, conv in zip(*(batch.column(c).to_pylist() for c in (*KEY, "conv"))):
            if held and (key != node or size >= RUN_BYTES):
                yield run()
                held, size = [], 0
            if not held:
                node, first = key, conv
            held.append(str(conv))
            size += len(held[-1]) + 1
    if held:
        yield run()


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One SHA-256 per node over its runs, which arrive one after the other."""
    node, digest, keys, sums = None, None, [], []
    for batch in batches:
        for *key, ids in zip(*(batch.column(c).to_pylist() for c in (*KEY, "ids"))):
            if key != node:
                if node is not None:
                    keys.append(node)
                    sums.append(digest.hexdigest())
                node, digest = key, hashlib.sha256()
            else:
                digest.update(b",")
            digest.update(ids.encode())
        if keys:
            yield pa.record_batch([*(pa.array(c, pa.int64()) for c in zip(*keys)), pa.array(sums)], [*KEY, "ends_sha256"])
            keys, sums = [], []
    if node is not None:
        yield pa.record_batch([*(pa.array([c], pa.int64()) for c in node), pa.array([digest.hexdigest()])], [*KEY, "ends_sha256"])


def _ends(members: DataFrame) -> DataFrame:
    """SHA-256 of the ids that end at each node, from (depth, a, b, conv).

    The ids of one node are joined where they lie, in runs; only the runs meet in one task, one at a time.
    """
    pieces = max(2, members.sparkSession.sparkContext.defaultParallelism)
    keys = "depth long, a long, b long"
    runs = members.repartitionByRange(pieces, *KEY, "conv").sortWithinPartitions(*KEY, "conv")
    runs = runs.mapInArrow(_joined_ids, f"{keys}, first long, ids string")
    runs = runs.repartition(pieces, *KEY).sortWithinPartitions(*KEY, "first")
    return runs.mapInArrow(_digests, f"{keys}, ends_sha256 string")


def prefix_trie(turns: DataFrame, sizes: DataFrame, band: int = BAND) -> DataFrame:
    """One row per node: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256.

    ``turns`` are (conv, place, digest, bytes) with places 0, 1, ... per conversation, ``sizes`` has (conv, n) of all
    conversations, those without turns included.  The root (depth 0) has all as members; it is
    there as soon as there is a conversation.  Without conversations there is no row.
    """
    marked = turns.select(
        "conv", (F.col("place") + 1).alias("depth"), "bytes", F.xxhash64(F.lit(1), "place", "digest").alias("ha"),
        F.xxhash64(F.lit(2), "place", "digest").alias("hb"),
    )
    rows = running(marked, "conv", ["depth"], {}, {"a": "ha", "b": "hb"}, "prefixes")
    paths = rows.select("conv", *KEY)
    found = rows.groupBy(*KEY).agg(
        F.count("*").alias("n_convs"), F.min("conv").alias("conv"), F.min("bytes").alias("bytes"),
        F.min(F.col("a").bitwiseXOR(F.col("ha"))).alias("up_a"), F.min(F.col("b").bitwiseXOR(F.col("hb"))).alias("up_b"),
    )
    found = materialize(found, "trie-nodes")
    children = found.groupBy((F.col("depth") - 1).alias("depth"), F.col("up_a").alias("a"), F.col("up_b").alias("b"))
    children = materialize(children.agg(F.count("*").alias("n_children")), "trie-children")
    nodes = found.join(children, KEY, "left").withColumn("n_children", F.coalesce("n_children", F.lit(0).cast("long")))
    nodes = materialize(nodes, "trie-inner")
    own = nodes.select(
        *KEY, "conv", (F.col("n_children") == 0).cast("long").alias("leaves"),
        ((F.col("n_convs") - 1) * F.col("bytes")).alias("saved"),
    )
    deepest = found.agg(F.max("depth")).first()[0] or 0
    totals = subtree_totals(own, paths, deepest, band)

    zero = F.lit(0).cast("long")
    tops = totals.where("depth = 1").agg(F.count("*").alias("n_children"), F.sum("leaves").alias("leaves"), F.sum("saved").alias("saved"))
    root = sizes.agg(F.count("*").alias("n_convs"), F.min("conv").alias("conv")).where("n_convs > 0").crossJoin(tops)  # one row each
    root = root.select(
        zero.alias("depth"), zero.alias("a"), zero.alias("b"), "conv", "n_convs", "n_children", F.lit(None).cast("long").alias("up"),
        F.when(F.col("n_children") == 0, F.lit(1).cast("long")).otherwise(F.col("leaves")).alias("n_leaves"),
        F.coalesce("saved", zero).alias("saved_tokens"),
    )
    root = materialize(root, "trie-root")
    # The parent's smallest member; the children of one parent may be most of all nodes.
    parents = found.select(*KEY, F.col("conv").alias("up")).unionByName(root.select(*KEY, F.col("conv").alias("up")))
    names = [F.col(c).alias(f"up_{c}") for c in KEY]
    below = nodes.withColumn("up_depth", F.col("depth") - 1)
    up = [f"up_{c}" for c in KEY]
    below = uneven_join(
        below, parents.select(*names, "up"), up, children.select(*names, F.col("n_children").alias("n"))
    ).drop(*up)
    below = below.join(totals.select(*KEY, "leaves", "saved"), KEY).select(
        *KEY, "conv", "n_convs", "n_children", "up", F.col("leaves").alias("n_leaves"), F.col("saved").alias("saved_tokens")
    )
    members = rows.join(sizes.where("n > 0").withColumnRenamed("n", "depth"), ["conv", "depth"], "left_semi").select(*KEY, "conv")
    members = members.unionByName(sizes.where("n = 0").select(zero.alias("depth"), zero.alias("a"), zero.alias("b"), "conv"))
    everything = below.unionByName(root).join(_ends(members), KEY, "left")
    return everything.select(
        F.col("conv").alias("conv_id"), "depth", F.col("up").alias("parent_conv_id"), "n_convs", "n_children", "n_leaves", "saved_tokens",
        F.coalesce("ends_sha256", F.sha2(F.lit("").cast("binary"), 256)).alias("ends_sha256"),
    )
