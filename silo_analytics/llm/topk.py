"""Exact top-k inner products by three phases of a uniform threshold.

The components of a vector are cut into a few slices; each slice gives every (query, row) a
partial score, i.e. one score list per slice.

1. Gather: per list, the k best rows of a block of rows; their whole scores are summed.  The
   k-th best of these over all blocks is a cutoff below which no result lies.
2. Collect: the cutoff goes to all blocks with its query.  In every list, shifted to start at 0,
   the entries of at least cutoff / lists are collected: a row that reaches the cutoff has one.
   A row is dropped when its collected parts, with the threshold for each part that was not
   collected, stay below the cutoff.
3. Resolve: the whole scores of the rows left are summed exactly, and the best k are kept.

Rows and queries are packed into blocks.  The blocks of rows stay where they lie; those of the queries come to
them in broadcasts of a bounded size, so neither the queries nor the rows are ever in one place.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..scratch import materialize
from .common import col, small_batches, starts

ROW_BLOCK = 2048
QUERY_BLOCK = 2048
# Bytes of query blocks that one broadcast holds, on average.
QUERY_BYTES = 16 << 20
# Pairs of blocks (about 0.5 MB each, 2 MB where components need 64 bits) that a task holds at once.
PAIRS_PER_BATCH = 8
LISTS = 4
_STEP = 256  # queries whose scores a task holds at once


def integer_vectors(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", scale: int = 256) -> DataFrame:
    """(id, v): floor(scale * x) of every component, one row per id and vector.

    Left out: rows without an id, and vectors that are null, empty or hold a null or non-finite
    component.  Different vectors under one id are rows of their own; equal rows count once.
    """
    v = F.transform(col(vec_col), lambda x: F.floor(F.lit(float(scale)) * x.cast("double")).cast("long"))
    fine = F.forall(col(vec_col), lambda x: x.isNotNull() & (F.abs(x.cast("double")) < float("inf")) & ~F.isnan(x))
    rows = vectors.where(col(id_col).isNotNull() & fine & (F.size(col(vec_col)) > 0))
    return rows.select(col(id_col).cast("long").alias("id"), v.alias("v")).distinct()


def _packed(batches: Iterator[pa.RecordBatch], block: int, cutoffs: bool) -> Iterator[pa.RecordBatch]:
    """Rows of a partition as blocks: ids, lengths and components as bytes, these in the narrowest type that holds them."""
    held, count = [], 0

    def close() -> pa.RecordBatch:
        ids, lengths, parts, cuts = (np.concatenate(x) for x in zip(*held))
        low, high = parts.min(initial=0), parts.max(initial=0)
        kind = next(t for t in (np.int16, np.int32, np.int64) if np.iinfo(t).min <= low and high <= np.iinfo(t).max)
        columns = [pa.array([x.tobytes()], pa.binary()) for x in (ids, lengths, parts.astype(kind), cuts)]
        return pa.record_batch(columns, ["ids", "lengths", "parts", "cuts"])

    for batch in batches:
        for at in range(0, batch.num_rows, block):
            part = batch.slice(at, block)
            v = part.column("v")
            lengths = np.diff(v.offsets.to_numpy()).astype(np.int32)
            # The cutoff is null for a query with fewer rows than it asks for.
            cuts = part.column("cut").fill_null(-(2**63)).to_numpy() if cutoffs else np.zeros(0, np.int64)
            if held and count + part.num_rows > block:
                yield close()
                held, count = [], 0
            held.append((part.column("id").to_numpy(), lengths, v.flatten().to_numpy(), cuts))
            count += part.num_rows
    if held:
        yield close()


def _matrix(lengths: np.ndarray, raw: bytes, width: int) -> np.ndarray:
    """Vectors as rows; missing components count as 0."""
    parts = np.frombuffer(raw, f"i{len(raw) // int(lengths.sum())}")
    out = np.zeros((len(lengths), width), np.int64)
    at = starts(lengths)[:-1]
    row = np.repeat(np.arange(len(lengths)), lengths)
    out[row, np.arange(len(parts)) - np.repeat(at, lengths)] = parts
    return out


def _lists(q: np.ndarray, r: np.ndarray) -> list[np.ndarray]:
    """Partial scores of every (query, row) by slice of the components."""
    edges = np.linspace(0, q.shape[1], min(LISTS, q.shape[1]) + 1).astype(int)
    big = float(np.abs(q).max(initial=0)) * float(np.abs(r).max(initial=0)) * q.shape[1]
    if big < 2**53:  # doubles hold all sums exactly
        q, r = q.astype(np.float64), r.astype(np.float64)
    return [q[:, i:j] @ r[:, i:j].T for i, j in zip(edges, edges[1:])]


def _meet(batches: Iterator[pa.RecordBatch], k: int, final: bool) -> Iterator[pa.RecordBatch]:
    """The best k of each query among the rows of a task's blocks."""
    best: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def offer(query: int, ids: np.ndarray, scores: np.ndarray) -> None:
        if query in best:
            ids, scores = np.concatenate([best[query][0], ids]), np.concatenate([best[query][1], scores])
        keep = np.lexsort((ids, -scores))[:k]
        best[query] = ids[keep], scores[keep]

    for batch in batches:
        for row in batch.to_pylist():
            ids, q_ids = (np.frombuffer(row[c], np.int64) for c in ("r_ids", "q_ids"))
            lengths, q_lengths = (np.frombuffer(row[c], np.int32) for c in ("r_lengths", "q_lengths"))
            width = int(max(lengths.max(), q_lengths.max()))
            r = _matrix(lengths, row["r_parts"], width)
            q = _matrix(q_lengths, row["q_parts"], width)
            cuts = np.frombuffer(row["q_cuts"], np.int64)
            for at in range(0, len(q), _STEP):
                names = q_ids[at : at + _STEP]
                parts = _lists(q[at : at + _STEP], r)
                chosen = _collect(parts, cuts[at : at + _STEP]) if final else _gather(parts, k)
                chosen &= names[:, None] != ids[None, :]
                query, entry = np.nonzero(chosen)
                scores = sum(p[query, entry] for p in parts).astype(np.int64)
                if final:
                    enough = scores >= cuts[at : at + _STEP][query]
                    query, entry, scores = query[enough], entry[enough], scores[enough]
                edges = np.searchsorted(query, np.arange(len(names) + 1))
                for n, (i, j) in enumerate(zip(edges, edges[1:])):
                    if j > i:
                        offer(int(names[n]), ids[entry[i:j]], scores[i:j])
    if best:
        queries = np.repeat(np.fromiter(best, np.int64), [len(b[0]) for b in best.values()])
        ids, scores = (np.concatenate([b[x] for b in best.values()]) for x in (0, 1))
        yield pa.record_batch([pa.array(queries), pa.array(ids), pa.array(scores)], ["query_id", "vec_id", "score"])


def _gather(parts: list[np.ndarray], k: int) -> np.ndarray:
    """Marks the k + 1 best rows of every list; one of them may be the query itself."""
    chosen = np.zeros(parts[0].shape, bool)
    n = parts[0].shape[1]
    for p in parts:
        top = np.argpartition(p, n - min(k + 1, n), axis=1)[:, n - min(k + 1, n) :]
        np.put_along_axis(chosen, top, True, axis=1)
    return chosen


def _collect(parts: list[np.ndarray], cuts: np.ndarray) -> np.ndarray:
    """Marks the rows that can reach the cutoff, by the uniform threshold of every list."""
    lows = [p.min(axis=1, keepdims=True) for p in parts]
    need = cuts.astype(np.float64)[:, None] - sum(x.astype(np.float64) for x in lows)
    threshold = need / len(parts)
    seen = np.zeros(parts[0].shape, bool)
    bound = np.zeros(parts[0].shape)
    for p, low in zip(parts, lows):
        shifted = p - low
        here = shifted >= threshold
        seen |= here
        bound += np.where(here, shifted, np.maximum(threshold, 0))
    # Rounding of doubles is far below the margin of one.
    return seen & (bound >= need - 1 - np.abs(need) * 1e-9)


def top_inner_products(
    vectors: DataFrame, queries: DataFrame, k: int = 5, row_block: int = ROW_BLOCK, query_block: int = QUERY_BLOCK
) -> DataFrame:
    """query_id, rank (from 1), vec_id, score of the k best rows of (id, v) for each query (id, v).

    Rows under a query's own id are left out; ties go to the smaller id; fewer rows give fewer
    results.  Of several vectors under a query's id each asks, and their scores are ranked together;
    several vectors under another id are ranked each by itself.
    Vectors of different lengths are compared as if padded with zeros.  Scores are exact as
    long as they fit in 64 bits.
    """
    spark = vectors.sparkSession
    vectors = materialize(vectors, "vectors")
    queries = materialize(queries, "queries")
    count = queries.count()
    rows = vectors.count()
    layout = "ids binary, lengths binary, parts binary, cuts binary"
    packed = vectors.repartition(max(1, -(-rows // row_block)), "id").mapInArrow(
        partial(_packed, block=row_block, cutoffs=False), layout
    )
    packed = materialize(packed.select(*[F.col(c).alias(f"r_{c}") for c in ("ids", "lengths", "parts")]), "row-blocks")

    def met(asked: DataFrame, final: bool) -> DataFrame:
        blocks = asked.repartition(max(1, -(-count // query_block)), "id").mapInArrow(
            partial(_packed, block=query_block, cutoffs=True), layout
        )
        columns = ["q_ids", "q_lengths", "q_parts", "q_cuts"]
        blocks = materialize(blocks.toDF(*columns), "query-blocks")
        size = blocks.agg(F.sum(sum(map(F.octet_length, columns[1:]), F.octet_length(columns[0])))).first()[0] or 0
        chunks = max(1, -(-size // QUERY_BYTES))
        found = None
        for i in range(chunks):
            some = blocks.where(F.pmod(F.xxhash64("q_ids"), F.lit(chunks)) == i)
            pairs = packed.crossJoin(F.broadcast(some))
            best = pairs.mapInArrow(partial(_meet, k=k, final=final), "query_id long, vec_id long, score long")
            with small_batches(spark, PAIRS_PER_BATCH):
                part = materialize(best, "met")
            found = part if found is None else found.unionByName(part)
        return found

    local = met(queries.withColumn("cut", F.lit(None).cast("long")), final=False)
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    cutoff = local.select("query_id", F.row_number().over(best).alias("rank"), "score").where(F.col("rank") == k)
    cutoff = materialize(cutoff.select(F.col("query_id").alias("id"), F.col("score").alias("cut")), "cutoffs")
    found = met(queries.join(cutoff, "id", "left"), final=True)
    ranked = found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")
