"""Bootstrap intervals of the AUROC.

``bootstrap_auroc`` draws Poisson(1) weights per row and replicate from the hash
of the row's key.  Rows are shuffled once, not once per replicate: a task turns
its piece of the score range into one partial sum per replicate.
``multinomial_resample`` is the textbook form with exactly n draws, for small
test sets.
"""

from __future__ import annotations

import math
import sys
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ..functions.hashing import hash_sql, hash_uniform
from ..scratch import join_lookup
from .metrics import edges_below, ranking_metrics, scored_rows, with_edges
from .ranking import rank_in_group

# The functions that run inside tasks travel with the job; executors need no copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

ROWS_PER_PIECE = 50_000
# Rows whose replicate weights are expanded at once.
BLOCK = 256
DRAW_BITS = 16


def poisson_cuts() -> list[int]:
    """Draws at which the weight passes from k to k + 1 (Poisson with mean 1)."""
    cuts, term, total, k = [], math.exp(-1.0), 0.0, 0
    while True:
        total += term
        step = math.floor(total * 2**DRAW_BITS)
        if step >= 2**DRAW_BITS - 1:
            return cuts
        cuts.append(step)
        k += 1
        term /= k


def replicate_draws(seed: int, key: str, replicates: int) -> Column:
    """One 16-bit draw per replicate, as the bytes of hashes of (seed, block, key)."""
    per_hash = 128 // DRAW_BITS
    texts = [hash_sql(seed, "boot", i, key) for i in range(-(-replicates // per_hash))]
    return F.expr(f"unhex(concat({', '.join(texts)}))")


class _Unit:
    """Running sums of one piece of the score range, for all replicates at once.

    Rows come in score order; the rows of the last score are held back because the
    next batch may go on with it.
    """

    def __init__(self, key: tuple, replicates: int):
        self.key = key
        self.pos, self.neg, self.pairs, self.tie_pos, self.tie_neg = np.zeros((5, replicates))
        self.score = None

    def add(self, score: np.ndarray, positive: np.ndarray, weight: np.ndarray) -> None:
        starts = np.flatnonzero(np.r_[True, score[1:] != score[:-1]])
        p = weight * positive[:, None]
        n = weight - p
        if len(starts) < len(score):
            p, n = (np.add.reduceat(v, starts, axis=0) for v in (p, n))
        if self.score is not None and self.score == score[0]:
            p[0] += self.tie_pos
            n[0] += self.tie_neg
        else:
            self.close_tie()
        # halves of whole numbers: the sums are exact in any order
        below = np.cumsum(n, axis=0)
        below -= n / 2.0
        below += self.neg
        self.pairs += np.einsum("ij,ij->j", p[:-1], below[:-1])
        self.pos += p[:-1].sum(axis=0)
        self.neg += n[:-1].sum(axis=0)
        self.score, self.tie_pos, self.tie_neg = score[-1], p[-1], n[-1]

    def close_tie(self) -> None:
        self.pairs += self.tie_pos * (self.neg + self.tie_neg / 2.0)
        self.pos += self.tie_pos
        self.neg += self.tie_neg
        self.tie_pos, self.tie_neg = np.zeros((2, len(self.pos)))


def _piece_sums(schema: pa.Schema, replicates: int, cuts: Sequence[int]):
    """Weighted positives, negatives and concordant pairs of every piece, per replicate.

    Reads rows sorted by piece and score and holds one batch at a time.
    """

    def emit(unit: _Unit) -> pa.RecordBatch:
        unit.close_tie()
        values = [*unit.key, unit.pos, unit.neg, unit.pairs]
        return pa.RecordBatch.from_arrays(
            [pa.array([v], f.type) for v, f in zip(values, schema)], schema=schema
        )

    # the weight of every draw, in the order of its two bytes
    weights = np.searchsorted(cuts, np.arange(2**DRAW_BITS, dtype=np.uint16).byteswap(), side="right").astype(float)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unit = None
        names = schema.names[:-3]
        for batch in batches:
            rows = batch.num_rows
            if not rows:
                continue
            change = np.zeros(rows, dtype=bool)
            change[0] = True
            for name in names:
                codes = np.asarray(batch.column(name).dictionary_encode().indices)
                change[1:] |= codes[1:] != codes[:-1]
            score = batch.column("_s").to_numpy()
            positive = batch.column("_y").to_numpy() == 1
            hashes = np.frombuffer(b"".join(batch.column("_h").to_pylist()), dtype="<u2")
            draws = hashes.reshape(rows, -1)[:, :replicates]
            bounds = [*np.flatnonzero(change), rows]
            for low, high in zip(bounds, bounds[1:]):
                key = tuple(batch.column(name)[int(low)].as_py() for name in names)
                if unit is None or unit.key != key:
                    if unit is not None:
                        yield emit(unit)
                    unit = _Unit(key, replicates)
                for at in range(low, high, BLOCK):
                    part = slice(at, min(at + BLOCK, high))
                    unit.add(score[part], positive[part], weights[draws[part]])
        if unit is not None:
            yield emit(unit)

    return run


def bootstrap_auroc_replicates(
    df: DataFrame,
    by: Sequence[str],
    key: str,
    label: str = "label",
    score: str = "score",
    replicates: int = 200,
    seed: int = 7,
) -> DataFrame:
    """AUROC of each replicate (``by``, ``rep``, ``auroc``); one-class replicates are absent.

    All groups see the same weights of a row.
    """
    s = F.col(score).cast("double")
    # odd pieces hold the rows that equal an edge: their order does not matter, so
    # a score shared by many rows can be split over tasks
    at_edge = F.coalesce(F.get("_edges", "_below") == s, F.lit(False))
    # and into as many parts as the group has pieces
    placed = with_edges(scored_rows(df, label, score), by, score, ROWS_PER_PIECE).withColumn("_below", edges_below(s)).select(
        *by,
        (2 * F.col("_below") + at_edge.cast("int")).alias("_piece"),
        F.when(at_edge, F.pmod(F.xxhash64(F.col(key)), F.col("_pieces"))).otherwise(0).cast("int").alias("_salt"),
        s.alias("_s"),
        F.col(label).cast("int").alias("_y"),
        F.col(key).alias("_k"),
    )
    unit = [*by, "_piece", "_salt"]
    kinds = dict(placed.dtypes)
    schema = ", ".join(f"`{c}` {kinds[c]}" for c in unit) + ", _pos array<double>, _neg array<double>, _u array<double>"
    arrow = to_arrow_schema(T.StructType.fromDDL(schema))
    # hashed after the shuffle and the sort, so the draws are not moved
    drawn = placed.repartition(*unit).sortWithinPartitions(*unit, "_s").select(
        *unit, "_s", "_y", replicate_draws(seed, "_k", replicates).alias("_h")
    )
    sums = drawn.mapInArrow(_piece_sums(arrow, replicates, poisson_cuts()), schema)
    cells = sums.select(
        *by, "_piece", "_salt", F.posexplode(F.arrays_zip("_pos", "_neg", "_u")).alias("rep", "_c")
    )
    merged = cells.groupBy(*by, "rep", "_piece").agg(
        F.sum("_c._pos").alias("_pos"), F.sum("_c._neg").alias("_neg"), F.sum("_c._u").alias("_u")
    )
    point = F.col("_piece") % 2 == 1
    pairs = F.when(point, F.col("_pos") * F.col("_neg") / 2.0).otherwise(F.col("_u"))
    before = Window.partitionBy(*by, "rep").orderBy("_piece").rowsBetween(Window.unboundedPreceding, -1)
    lower = merged.withColumn("_pairs", pairs).withColumn(
        "_below", F.coalesce(F.sum("_neg").over(before), F.lit(0.0))
    )
    total = lower.groupBy(*by, "rep").agg(
        F.sum("_pos").alias("_P"),
        F.sum("_neg").alias("_N"),
        F.sum(F.col("_pairs") + F.col("_pos") * F.col("_below")).alias("_U"),
    )
    return total.filter((F.col("_P") > 0) & (F.col("_N") > 0)).select(
        *by, "rep", (F.col("_U") / (F.col("_P") * F.col("_N"))).alias("auroc")
    )


def interval(replicates: DataFrame, by: Sequence[str]) -> DataFrame:
    """Mean and 95 % percentile interval of the replicate scores."""
    bounds = F.percentile("auroc", [0.025, 0.975])
    return replicates.groupBy(*by).agg(
        F.avg("auroc").alias("auroc_boot"),
        bounds[0].alias("auroc_ci_lo"),
        bounds[1].alias("auroc_ci_hi"),
    )


def bootstrap_auroc(df: DataFrame, by: Sequence[str], key: str, **options) -> DataFrame:
    """Bootstrap mean of the AUROC with its 95 % interval, per group."""
    return interval(bootstrap_auroc_replicates(df, by, key, **options), by)


def multinomial_resample(
    df: DataFrame, key: str, replicates: int, seed: int, group: Sequence[str] = ()
) -> DataFrame:
    """Exactly n draws with replacement per replicate and group: (group, rep, key, times).

    Makes replicates x n draws; meant for test sets, with ``bootstrap_auroc`` for
    large ones.
    """
    given = list(group)
    rows = df.select(*given, key)
    if not given:
        rows, given = rows.withColumn("_all", F.lit(0)), ["_all"]
    sizes = rows.groupBy(*given).agg(F.count(F.lit(1)).alias("_n"))
    ranked = rank_in_group(rows, given, key, seed, "resample")
    draws = (
        join_lookup(rows, sizes, given, "inner")
        .withColumn("rep", F.explode(F.sequence(F.lit(0), F.lit(replicates - 1))))
        .withColumn("rank", F.floor(hash_uniform(seed, "pick", "rep", key) * F.col("_n")) + 1)
        .groupBy(*given, "rep", "rank")
        .agg(F.count(F.lit(1)).alias("times"))
    )
    return draws.join(ranked, [*given, "rank"]).select(*group, "rep", key, "times")


def multinomial_auroc(
    df: DataFrame, key: str, label: str = "label", score: str = "score", replicates: int = 200, seed: int = 7
) -> DataFrame:
    """AUROC of each replicate of the textbook bootstrap (``rep``, ``auroc``)."""
    picks = multinomial_resample(df, key, replicates, seed)
    scored = picks.join(df.select(key, label, score), key)
    out = ranking_metrics(scored, ["rep"], label, score, F.col("times"))
    return out.filter((F.col("n_pos") > 0) & (F.col("n_pos") < F.col("n"))).select("rep", "auroc")
