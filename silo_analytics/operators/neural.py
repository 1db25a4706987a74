"""Perceptron with two hidden layers: pooled, and one per silo averaged over rounds.

Sigmoid layers, softmax output, full-batch L-BFGS.  It plays the role of a ReLU network
trained with Adam but is not the same model.  A model is its flat weight vector: per layer the
(out x in) matrix by columns, then the biases.

Rows are laid out once, packed in blocks of one silo, and all silos of all groups (strategies, folds)
are trained in one chain of jobs: an evaluation adds up loss and gradient per silo where the
blocks lie, and only those sums leave the tasks.  No silo is gathered, and small and large ones are trained
the same way.  The steps of up to ``MODELS_PER_FIT`` silos are held by the driver, and their blocks are dealt evenly to
tasks and persisted for the chain; the steps of more silos are rows of a table that every evaluation reads and
writes, so that the number of jobs does not depend on the number of silos.

A row that trains silos of several groups (the pooled network and folds, or a region, a hospital and a skewed silo)
is laid out and sent once for all of them, as long as the driver holds the steps (``lay_out_shared``).
"""

from __future__ import annotations

import json
import sys
from collections.abc import Iterator, Mapping, Sequence
from dataclasses import dataclass, replace
from functools import partial

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import RDD, StorageLevel, cloudpickle
from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

from ..scratch import join_lookup, local_table, materialize, remove_tree, scratch_path
from .averaging import average_vectors
from .metrics import ranking_metrics

cloudpickle.register_pickle_by_value(sys.modules[__name__])

HIDDEN = (64, 32)
POOLED_EPOCHS = 500
ROUND_EPOCHS = 100
# Values (rows x features) of a silo whose sums are added up in one part; a larger silo has several.
LOCAL_VALUES = 1_000_000
# Silos whose L-BFGS steps the driver holds (about 0.5 MB each); those of more are a table.
MODELS_PER_FIT = 200
# Bytes of weights that one evaluation broadcasts to the blocks of a chunk.
WEIGHTS_PER_CHUNK = 32 << 20
# Values (rows x features) of a block.
BLOCK_VALUES = 100_000
# Rows that a task of an evaluation goes through, at least, and tasks per core, at most.
ROWS_PER_TASK = 8_000
TASKS_PER_CORE = 2
# Rows whose layers are computed together: their outputs stay in the cache of a core.
ROWS_PER_STEP = 384
# Sums that a task holds at once before it hands them on.
SUMS_PER_TASK = 256
# Silos whose parts one task of the second stage adds up, at least.
MODELS_PER_TASK = 16
SUMS = "grp string, silo string, part long, sums array<double>"
FITS = "grp string, silo string, n long, n_pos long, params array<double>, auroc double, ap double"
STEPS = "grp string, silo string, n long, wanted array<double>, state array<double>, open boolean"
BLOCKS = "chunk int, grp string, silo string, part long, n long, y binary, times binary, x binary"


def weight_count(size: int) -> int:
    layers = (size, *HIDDEN, 2)
    return sum((a + 1) * b for a, b in zip(layers, layers[1:]))


def initial_weights(size: int, seed: int) -> np.ndarray:
    """Seeded start weights, the same for every silo."""
    draw, parts = np.random.default_rng(seed), []
    layers = (size, *HIDDEN, 2)
    for a, b in zip(layers, layers[1:]):
        spread = np.sqrt(6.0 / (a + b))
        parts += [draw.uniform(-spread, spread, a * b), np.zeros(b)]
    return np.concatenate(parts)


def _unpacked(flat: np.ndarray, size: int) -> list[tuple[np.ndarray, np.ndarray]]:
    layers, at = [], 0
    shape = (size, *HIDDEN, 2)
    for a, b in zip(shape, shape[1:]):
        layers.append((flat[at : at + a * b].reshape((b, a), order="F"), flat[at + a * b : at + (a + 1) * b]))
        at += (a + 1) * b
    return layers


def _squashed(z: np.ndarray) -> np.ndarray:
    """1 / (1 + exp(-z)) in place."""
    np.clip(z, -500, 500, out=z)
    np.negative(z, out=z)
    np.exp(z, out=z)
    z += 1.0
    return np.divide(1.0, z, out=z)


def _forward(flat: np.ndarray, x: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
    """Outputs of every layer but the last, and the probability of class 1."""
    seen = [x]
    layers = _unpacked(flat, x.shape[1])
    for matrix, bias in layers[:-1]:
        z = seen[-1] @ matrix.T
        z += bias
        seen.append(_squashed(z))
    z = seen[-1] @ layers[-1][0].T + layers[-1][1]
    return seen, 1.0 / (1.0 + np.exp(np.clip(z[:, 0] - z[:, 1], -500, 500)))


def _loss_sums(flat: np.ndarray, x: np.ndarray, y: np.ndarray, times: np.ndarray) -> np.ndarray:
    """Cross-entropy and its gradient, added up over rows that count ``times`` each.

    Biases are weights of an input that is 1, so that a layer takes one matrix product each way.
    """
    layers = _unpacked(flat, x.shape[1])
    inner = [-np.vstack([matrix.T, bias]) for matrix, bias in layers[:-1]]  # exp(-z) is wanted
    last, bias = layers[-1]
    lean, tilt = last[0] - last[1], bias[0] - bias[1]
    step = min(ROWS_PER_STEP, len(y))
    room = [np.ones((step, len(m))) for m in inner]
    slopes = [np.zeros((m.shape[1], len(m))) for m in inner]
    loss, end = 0.0, np.zeros(len(lean) + 1)
    for at in range(0, len(y), step or 1):
        ys, ts = y[at : at + step], times[at : at + step]
        ins, outs = [v[: len(ys)] for v in room], []
        ins[0][:, :-1] = x[at : at + step]
        for k, matrix in enumerate(inner):
            z = ins[k] @ matrix
            with np.errstate(over="ignore"):
                np.exp(z, out=z)
            z += 1.0
            outs.append(np.reciprocal(z, out=z))
            if k + 1 < len(ins):
                ins[k + 1][:, :-1] = z
        p = 1.0 / (1.0 + np.exp(np.clip(outs[-1] @ lean + tilt, -500, 500)))
        loss -= np.sum(ts * np.log(np.where(ys == 1, p, 1 - p) + 1e-12))
        away = (ys - p) * ts
        end[:-1] += away @ outs[-1]
        end[-1] += away.sum()
        error = away[:, None] * lean
        for k in range(len(inner) - 1, -1, -1):
            error *= outs[k]
            error *= np.subtract(1.0, outs[k], out=outs[k])
            slopes[k] += error.T @ ins[k]
            if k:
                error = error @ layers[k][0]
    return np.concatenate([[loss], *(v.ravel(order="F") for v in slopes), np.stack([end, -end]).ravel(order="F")])


def loss_and_slope(flat: np.ndarray, x: np.ndarray, y: np.ndarray) -> tuple[float, np.ndarray]:
    """Mean cross-entropy and its gradient."""
    sums = _loss_sums(flat, x, y, np.ones(len(y))) / len(y)
    return float(sums[0]), sums[1:]


class Descent:
    """L-BFGS with halving steps, one evaluation at a time.

    ``wanted`` are the weights whose loss and gradient ``send`` is to be given next; ``open`` tells
    whether there is more to do, and ``w`` is the result.  Stops after ``epochs`` steps, or when the loss changes
    by less than ``tol / 100`` of itself.  The whole state is a vector of numbers (``packed``).
    """

    TOL, MEMORY = 1e-4, 10

    def __init__(self, start: np.ndarray, epochs: int) -> None:
        self.w = self.wanted = np.array(start, float)
        self.loss, self.slope, self.d = 0.0, np.zeros_like(self.w), np.zeros_like(self.w)
        self.pairs: list[tuple[np.ndarray, np.ndarray]] = []
        self.step, self.down, self.left, self.begun, self.open = 1.0, 0.0, epochs, False, True

    def packed(self) -> np.ndarray:
        head = [self.loss, self.step, self.down, self.left, self.begun, self.open, len(self.w)]
        return np.concatenate([head, self.w, self.wanted, self.slope, self.d, *(v for pair in self.pairs for v in pair)])

    @classmethod
    def unpacked(cls, flat: np.ndarray) -> Descent:
        size = int(flat[6])
        self = cls(flat[7 : 7 + size], int(flat[3]))
        self.loss, self.step, self.down, self.begun, self.open = *flat[:3].tolist(), bool(flat[4]), bool(flat[5])
        self.wanted, self.slope, self.d, *rest = flat[7 + size :].reshape(-1, size)
        self.pairs = list(zip(rest[::2], rest[1::2]))
        return self

    def send(self, loss: float, slope: np.ndarray) -> None:
        if not self.begun:
            self.begun, self.loss, self.slope = True, loss, slope
            self._aim(self.left > 0)
        elif loss <= self.loss + 1e-4 * self.step * self.down:
            s, t = self.step * self.d, slope - self.slope
            if s @ t > 1e-12:
                self.pairs = [*self.pairs, (s, t)][-self.MEMORY :]
            done = abs(self.loss - loss) <= self.TOL * max(abs(loss), 1e-12) * 1e-2
            self.w, self.loss, self.slope, self.left = self.w + s, loss, slope, self.left - 1
            self._aim(not done and self.left > 0)
        else:
            self.step /= 2
            self.open = self.step > 1e-10
            self.wanted = self.w + self.step * self.d

    def _aim(self, more: bool) -> None:
        """The direction of the next step, if there is one."""
        self.open = more
        if not more:
            return
        d, weights = -self.slope, []
        for s, t in reversed(self.pairs):
            weights.append(s @ d / (s @ t))
            d = d - weights[-1] * t
        if self.pairs:
            s, t = self.pairs[-1]
            d = d * (s @ t) / (t @ t)
        for (s, t), a in zip(self.pairs, reversed(weights)):
            d = d + (a - t @ d / (s @ t)) * s
        self.step, self.down = 1.0, self.slope @ d
        if self.down >= 0:
            d, self.down, self.pairs = -self.slope, -(self.slope @ self.slope), []
        self.d, self.wanted = d, self.w + d


# ------------------------------------------------------------------ layout
@dataclass
class Layout:
    """Training rows of the silos (grp, silo) as blocks, and ``sizes`` (grp, silo, n, n_pos, usable).

    If ``shared``, the silo of a block is the text of a list of all the (grp, silo) that its rows train.
    """

    blocks: DataFrame
    sizes: DataFrame
    size: int
    silos: int
    chunks: int
    shared: bool = False

    def only(self, silos: DataFrame) -> Layout:
        """The same rows, with the named silos (grp, silo) to be trained alone."""
        kept = materialize(join_lookup(self.sizes, silos, ["grp", "silo"], "left_semi"), "silo-sizes")
        return replace(self, sizes=kept, silos=kept.filter("usable").count())


def _packed_rows(batches: Iterator[pa.RecordBatch], size: int, most: int) -> Iterator[pa.RecordBatch]:
    """Rows sorted by silo and part as blocks of one part; labels, counts and features as bytes."""
    held: list[tuple] = []
    key, count = None, 0

    def close() -> pa.RecordBatch:
        y, times, x = (np.concatenate(part) for part in zip(*held))
        values = [*key, len(y), y.tobytes(), times.tobytes(), x.tobytes()]
        kinds = [pa.int32(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.binary()]
        names = ["chunk", "grp", "silo", "part", "n", "y", "times", "x"]
        return pa.record_batch([pa.array([v], k) for v, k in zip(values, kinds)], names)

    for batch in batches:
        codes = [np.asarray(batch.column(c).dictionary_encode().indices) for c in ("grp", "silo")]
        columns = [*codes, np.asarray(batch.column("part")), np.asarray(batch.column("chunk"))]
        change = np.any([np.diff(c) != 0 for c in columns], axis=0)
        cuts = np.flatnonzero(change) + 1
        y, times = (np.asarray(batch.column(c), float) for c in ("y", "times"))
        x = np.asarray(batch.column("x").flatten(), float).reshape(len(y), size)
        for i, j in zip([0, *cuts.tolist()], [*cuts.tolist(), len(y)]):
            for at in range(i, j, most):
                to = min(at + most, j)
                here = tuple(batch.column(c)[at].as_py() for c in ("chunk", "grp", "silo", "part"))
                if held and (here != key or count + to - at > most):
                    yield close()
                    held, count = [], 0
                key, count = here, count + to - at
                held.append((y[at:to], times[at:to], x[at:to]))
    if held:
        yield close()


def lay_out(
    df: DataFrame, silo: str, label: str, features: str, size: int, min_rows: int = 5,
    local_values: int = LOCAL_VALUES, group: str | None = None,
) -> Layout:
    """Write the rows once, in parts and order that follow from the rows alone.

    A silo is named by (``group``, ``silo``).  Equal rows become one that counts several times, so that
    no value is common enough to fill a task.  Rows with a null silo train nothing; a silo with fewer than ``min_rows``
    rows or one class is not usable.
    """
    grp = F.lit("") if group is None else F.col(group).cast("string")
    rows = df.filter(F.col(silo).isNotNull()).select(
        grp.alias("grp"), F.col(silo).cast("string").alias("silo"), F.col(label).cast("long").alias("y"), F.col(features).alias("x")
    )
    sizes = rows.groupBy("grp", "silo").agg(F.count(F.lit(1)).alias("n"), F.sum("y").alias("n_pos"))
    sizes = materialize(sizes.withColumn("usable", _usable(min_rows)), "silo-sizes")
    found = sizes.filter("usable").agg(F.count(F.lit(1)).alias("silos"), F.sum("n").alias("rows")).first()
    chunks = max(1, -(-found.silos * weight_count(size) * 8 // WEIGHTS_PER_CHUNK))
    taken = join_lookup(rows, sizes.filter("usable").select("grp", "silo"), ["grp", "silo"], "left_semi")
    blocks = _blocks(taken, sizes, size, found.rows or 0, local_values, chunks)
    return Layout(blocks, sizes, size, found.silos, chunks)


def lay_out_shared(
    df: DataFrame, silos: Column, label: str, features: str, size: int, min_rows: int = 5, local_values: int = LOCAL_VALUES
) -> Layout:
    """``lay_out`` for rows that train several silos each: ``silos`` is an array of structs (grp, silo).

    A row is written once for all of its silos.  Where there are more silos than the driver holds the steps of,
    it is written once per silo.
    """
    named = F.filter(silos, lambda m: m["silo"].isNotNull())
    rows = df.select(named.alias("silos"), F.col(label).cast("long").alias("y"), F.col(features).alias("x")).filter(F.size("silos") > 0)
    text = F.to_json(F.transform("silos", lambda m: F.array(m["grp"], m["silo"])))
    cells = rows.groupBy("silos").agg(F.count(F.lit(1)).alias("n"), F.sum("y").alias("n_pos"))
    cells = materialize(cells.select(F.lit("").alias("grp"), text.alias("silo"), "silos", "n", "n_pos"), "silo-cells")
    sizes = cells.select(F.explode("silos").alias("m"), "n", "n_pos").groupBy("m.grp", "m.silo")
    sizes = sizes.agg(F.sum("n").alias("n"), F.sum("n_pos").alias("n_pos")).withColumn("usable", _usable(min_rows))
    sizes = materialize(sizes, "silo-sizes")
    number = sizes.filter("usable").count()
    if number > MODELS_PER_FIT:
        spread = rows.select(F.explode("silos").alias("m"), "y", "x").select("m.grp", "m.silo", "y", "x")
        return lay_out(spread, "silo", "y", "x", size, min_rows, local_values, "grp")
    taken = rows.select(F.lit("").alias("grp"), text.alias("silo"), "y", "x")
    total = cells.agg(F.sum("n").alias("rows")).first().rows or 0
    return Layout(_blocks(taken, cells, size, total, local_values, 1), sizes, size, number, 1, True)


def _usable(min_rows: int) -> Column:
    return F.coalesce(F.expr(f"n >= {min_rows} AND n_pos > 0 AND n_pos < n"), F.lit(False))


def _blocks(rows: DataFrame, sizes: DataFrame, size: int, total: int, local_values: int, chunks: int) -> DataFrame:
    """The written blocks of ``total`` rows (grp, silo, y, x)."""
    most = max(1, local_values // size)
    cut = sizes.select("grp", "silo", F.ceil(F.col("n") / most).alias("_parts")).filter("_parts > 1")
    distinct = rows.groupBy("grp", "silo", "y", "x").agg(F.count(F.lit(1)).cast("double").alias("times"))
    marked = join_lookup(distinct, cut, ["grp", "silo"], "left").select(
        F.pmod(F.xxhash64("grp", "silo"), F.lit(chunks)).cast("int").alias("chunk"), "grp", "silo",
        F.pmod(F.xxhash64("y", "x"), F.coalesce("_parts", F.lit(1))).alias("part"), "y", "times", "x",
    )
    spread = marked.repartition(max(1, -(-total // most)), "grp", "silo", "part")
    spread = spread.sortWithinPartitions("chunk", "grp", "silo", "part", "y", "x")
    blocks = spread.mapInArrow(partial(_packed_rows, size=size, most=max(1, BLOCK_VALUES // size)), BLOCKS)
    return materialize(blocks, "network-rows", partition_by=["chunk"])


# ------------------------------------------------------------------ grouped training
def _opened(row: dict, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    y, times, x = (np.frombuffer(row[c], np.float64) for c in ("y", "times", "x"))
    return x.reshape(len(y), size), y, times


def _sum_batch(held: Mapping[tuple[str, str, int], np.ndarray]) -> pa.RecordBatch:
    grp, silo, part = zip(*held)
    columns = [pa.array(grp, pa.string()), pa.array(silo, pa.string()), pa.array(part, pa.int64())]
    return pa.record_batch([*columns, pa.array(list(held.values()), pa.list_(pa.float64()))], ["grp", "silo", "part", "sums"])


def _part_sums(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    """Loss and gradient sums of every part of an open silo, whose weights are beside each block."""
    held: dict[tuple[str, str, int], np.ndarray] = {}
    for batch in batches:
        for i in range(batch.num_rows):
            named = tuple(batch.column(c)[i].as_py() for c in ("grp", "silo", "part"))
            row = {c: batch.column(c)[i].as_buffer() for c in ("y", "times", "x")}
            sums = _loss_sums(batch.column("wanted")[i].values.to_numpy(), *_opened(row, size))
            held[named] = held[named] + sums if named in held else sums
        if len(held) > SUMS_PER_TASK:
            yield _sum_batch(held)
            held = {}
    if held:
        yield _sum_batch(held)


def _total(parts: list[tuple[int, np.ndarray]]) -> np.ndarray:
    """Parts added in their order, so that the sum is the same every time."""
    return np.sum([s for _, s in sorted(parts, key=lambda p: (p[0], p[1][0]))], axis=0)


def _step_batch(rows: list[tuple]) -> pa.RecordBatch:
    grp, silo, n, steps = zip(*rows)
    floats = pa.list_(pa.float64())
    columns = [pa.array(grp, pa.string()), pa.array(silo, pa.string()), pa.array(n, pa.int64())]
    columns += [pa.array([d.wanted for d in steps], floats), pa.array([d.packed() for d in steps], floats), pa.array([d.open for d in steps])]
    return pa.record_batch(columns, ["grp", "silo", "n", "wanted", "state", "open"])


def _first_steps(batches: Iterator[pa.RecordBatch], plans: Mapping[str, tuple[int, np.ndarray]]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = [(r["grp"], r["silo"], r["n"], Descent(plans[r["grp"]][1], plans[r["grp"]][0])) for r in batch.to_pylist()]
        if rows:
            yield _step_batch(rows)


def _next_steps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """States (part null) and sums, sorted by silo: every silo moves on by one evaluation."""
    key, n, state, parts = None, 0, None, []

    def close() -> pa.RecordBatch:
        step, total = Descent.unpacked(state), _total(parts)
        step.send(float(total[0] / n), total[1:] / n)
        return _step_batch([(*key, n, step)])

    for batch in batches:
        for i in range(batch.num_rows):
            here = batch.column("grp")[i].as_py(), batch.column("silo")[i].as_py()
            if here != key:
                if key is not None:
                    yield close()
                key, parts = here, []
            part = batch.column("part")[i].as_py()
            if part is None:
                n, state = batch.column("n")[i].as_py(), batch.column("state")[i].values.to_numpy()
            else:
                parts.append((part, batch.column("sums")[i].values.to_numpy()))
    if key is not None:
        yield close()


def _block(row: Row, size: int) -> tuple[tuple[str, str], tuple[np.ndarray, np.ndarray, np.ndarray]]:
    return (row.grp, row.silo), _opened(row.asDict(), size)


def _dealt(layout: Layout, silos: DataFrame, rows: int) -> RDD:
    """The blocks of the silos as ((grp, silo), (x, y, times)), persisted in tasks of equally many blocks.

    The blocks of a silo are neighbours, so that the tasks have about one sum per silo and one per task.
    """
    most = TASKS_PER_CORE * silos.sparkSession.sparkContext.defaultParallelism
    tasks = max(1, min(most, -(-rows // ROWS_PER_TASK)))
    order = ["grp", "silo", "part", "place"]
    blocks = layout.blocks if layout.shared else join_lookup(layout.blocks, silos, ["grp", "silo"], "left_semi")
    dealt = blocks.withColumn("place", F.xxhash64("y", "x"))
    dealt = dealt.repartitionByRange(tasks, *order).sortWithinPartitions(*order).select("grp", "silo", "y", "times", "x")
    return dealt.rdd.map(partial(_block, size=layout.size)).persist(StorageLevel.MEMORY_AND_DISK)


def _silo_sums(number: int, blocks: Iterator[tuple], wanted: Mapping, shared: bool = False) -> Iterator[tuple]:
    """((grp, silo), (number of the task, sums of loss and gradient)) of the open silos."""
    held: dict[tuple[str, str], np.ndarray] = {}
    for named, block in blocks:
        for key in map(tuple, json.loads(named[1])) if shared else (named,):
            if key in wanted:
                sums = _loss_sums(wanted[key], *block)
                held[key] = held[key] + sums if key in held else sums
    return ((key, (number, sums)) for key, sums in held.items())


def _descend(layout: Layout, plans: Mapping[str, tuple[int, np.ndarray]]) -> DataFrame:
    """(grp, silo, params) of all usable silos, whose steps the driver holds: one job per evaluation."""
    spark = layout.blocks.sparkSession
    usable = layout.sizes.filter("usable").select("grp", "silo", "n")
    known = usable.collect()  # at most MODELS_PER_FIT
    open_ = {(r.grp, r.silo): (r.n, Descent(plans[r.grp][1], plans[r.grp][0])) for r in known}
    done: dict[tuple[str, str], np.ndarray] = {}
    blocks = _dealt(layout, usable.select("grp", "silo"), sum(r.n for r in known))
    while open_:
        wanted = {key: step.wanted for key, (_, step) in open_.items()}
        parts: dict[tuple[str, str], list] = {}
        # about one row per open silo and one per task
        for key, part in blocks.mapPartitionsWithIndex(partial(_silo_sums, wanted=wanted, shared=layout.shared)).collect():
            parts.setdefault(key, []).append(part)
        for key, rows in parts.items():
            n, step = open_[key]
            total = _total(rows)
            step.send(float(total[0] / n), total[1:] / n)
            if not step.open:
                done[key] = open_.pop(key)[1].w
    blocks.unpersist()
    return local_table(spark, [(*key, w.tolist()) for key, w in done.items()], "grp string, silo string, params array<double>")


def _descend_in_table(layout: Layout, plans: Mapping[str, tuple[int, np.ndarray]]) -> DataFrame:
    """The same for any number of silos: their steps are a table, written anew by every evaluation.

    An evaluation is one job and a look at what is still open.  Weights are broadcast chunk by
    chunk to the blocks of the chunk, ``WEIGHTS_PER_CHUNK`` bytes at most on average.
    """
    spark = layout.blocks.sparkSession
    base = scratch_path(spark, "network-steps")
    sizes = layout.sizes.filter("usable").select("grp", "silo", "n")
    tasks = max(1, -(-layout.silos // MODELS_PER_TASK))
    steps = sizes.repartition(tasks, "grp", "silo").mapInArrow(partial(_first_steps, plans=plans), STEPS)
    chunk = F.pmod(F.xxhash64("grp", "silo"), F.lit(layout.chunks))
    number = 0
    while True:
        steps.write.partitionBy("open").parquet(f"{base}/step={number}")
        if number:
            remove_tree(spark, f"{base}/step={number - 1}/open=true")
        written = spark.read.schema(STEPS).parquet(f"{base}/step={number}")
        open_ = written.filter("open")
        if open_.isEmpty():
            break
        sums = None
        for k in range(layout.chunks):
            mine = open_.filter(chunk == k).select("grp", "silo", "wanted")
            part = layout.blocks.filter(F.col("chunk") == k).join(F.broadcast(mine), ["grp", "silo"])
            part = part.select("grp", "silo", "part", "y", "times", "x", "wanted").mapInArrow(
                partial(_part_sums, size=layout.size), SUMS
            )
            sums = part if sums is None else sums.unionByName(part)
        none = F.lit(None).cast("array<double>")
        both = open_.select("grp", "silo", "n", "state", F.lit(None).cast("long").alias("part"), none.alias("sums")).unionByName(
            sums.select("grp", "silo", F.lit(None).cast("long").alias("n"), none.alias("state"), "part", "sums")
        )
        both = both.repartition(tasks, "grp", "silo").sortWithinPartitions("grp", "silo", "part")
        steps = both.mapInArrow(_next_steps, STEPS)
        number += 1
    closed = spark.read.schema(STEPS).option("basePath", base).parquet(f"{base}/step=*").filter("NOT open")
    weights = F.slice("state", 8, F.element_at("state", 7).cast("int"))
    return materialize(closed.select("grp", "silo", weights.alias("params")), "networks")


def train(
    layout: Layout, epochs: int | Mapping[str, int], seed: int = 0, start: Sequence[float] | Mapping[str, Sequence[float]] | None = None,
    scores: bool = True,
) -> DataFrame:
    """One network per silo of a layout: grp, silo, n, n_pos, params, auroc, ap.

    ``epochs`` and ``start`` may differ by group.  A start of None is drawn from the seed.  The scores are of the
    silo's own rows; without ``scores`` they are zero.  A silo that is not usable has null parameters and zero scores.
    """
    size = layout.size
    groups = [r.grp for r in layout.sizes.select("grp").distinct().collect()]  # strategies and folds of one run
    plans = {}
    for g in groups:
        begin = start.get(g) if isinstance(start, Mapping) else start
        if begin is not None and len(begin) != weight_count(size):
            raise ValueError(f"start has {len(begin)} weights, not {weight_count(size)}")
        begin = initial_weights(size, seed) if begin is None else np.asarray(begin, float)
        plans[g] = (epochs[g] if isinstance(epochs, Mapping) else epochs), begin
    few = layout.silos <= MODELS_PER_FIT
    weights = (_descend if few else _descend_in_table)(layout, plans) if layout.silos else None
    fits = layout.sizes.drop("usable")
    if weights is None:
        return materialize(fits.withColumns({"params": F.lit(None).cast("array<double>"), "auroc": F.lit(0.0), "ap": F.lit(0.0)}), "networks")
    fits = join_lookup(fits, weights, ["grp", "silo"], "left")
    if scores:
        ranked = _own_scores(layout, weights).select("grp", "silo", "auroc", "ap")
        fits = join_lookup(fits, ranked, ["grp", "silo"], "left")
    else:
        fits = fits.withColumns({"auroc": F.lit(0.0), "ap": F.lit(0.0)})
    return materialize(fits.withColumns({c: F.coalesce(c, F.lit(0.0)) for c in ("auroc", "ap")}), "networks")


def _own_scores(layout: Layout, weights: DataFrame) -> DataFrame:
    """Ranking metrics of every silo's own rows."""
    size = layout.size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                x, y, times = _opened(row, size)
                names = [pa.array([row[c]] * len(y), pa.string()) for c in ("grp", "silo")]
                found = [pa.array(y.astype(np.int64)), pa.array(times), pa.array(_forward(np.asarray(row["params"]), x)[1])]
                yield pa.record_batch([*names, *found], ["grp", "silo", "y", "times", "score"])

    blocks = layout.blocks.drop("chunk")
    if layout.shared:
        each = blocks.withColumn("_m", F.explode(F.from_json("silo", "array<array<string>>")))
        blocks = each.withColumns({"grp": F.col("_m")[0], "silo": F.col("_m")[1]}).drop("_m")
    beside = join_lookup(blocks, weights, ["grp", "silo"], "inner")
    scored = beside.mapInArrow(run, "grp string, silo string, y long, times double, score double")
    return ranking_metrics(scored, ["grp", "silo"], "y", weight=F.col("times"))


def fit_silos(
    df: DataFrame,
    silo: str,
    label: str,
    features: str,
    size: int,
    epochs: int = ROUND_EPOCHS,
    seed: int = 0,
    start: Sequence[float] | None = None,
    min_rows: int = 5,
    local_values: int = LOCAL_VALUES,
    scores: bool = True,
) -> DataFrame:
    """One network per silo, continued from ``start``: silo, n, n_pos, params, auroc, ap (see ``train``)."""
    layout = lay_out(df, silo, label, features, size, min_rows, local_values)
    return train(layout, epochs, seed, start, scores).drop("grp")


def fit_mlp(
    df: DataFrame,
    label: str,
    features: str,
    size: int,
    epochs: int = POOLED_EPOCHS,
    seed: int = 0,
    start: Sequence[float] | None = None,
    local_values: int = LOCAL_VALUES,
) -> np.ndarray:
    """Weights of a network trained on all rows."""
    one = df.select(F.lit("all").alias("silo"), label, features)
    fit = fit_silos(one, "silo", label, features, size, epochs, seed, start, local_values=local_values, scores=False).first()
    if fit is None or fit.params is None:
        raise ValueError("both classes are needed")
    return np.array(fit.params)


# ------------------------------------------------------------------ scoring
# Rows scored together by one network.
SCORED_ROWS = 4096


def _bundled(batches: Iterator[pa.RecordBatch], on: str) -> Iterator[pa.RecordBatch]:
    """Sorted rows as bundles of one key."""
    for batch in batches:
        codes = np.asarray(batch.column(on).dictionary_encode().indices)
        cuts = {0, batch.num_rows, *(np.flatnonzero(np.diff(codes)) + 1).tolist(), *range(0, batch.num_rows, SCORED_ROWS)}
        edges = pa.array(sorted(cuts), pa.int32())
        if batch.num_rows:
            rows = pa.StructArray.from_arrays(batch.columns, batch.schema.names)
            keys = batch.column(on).take(edges.slice(0, len(edges) - 1))
            yield pa.record_batch([keys, pa.ListArray.from_arrays(edges, rows)], ["key", "rows"])


def score_networks(df: DataFrame, networks: DataFrame, on: str, size: int, features: str = "features") -> DataFrame:
    """Score each row with the network of its own key (``networks``: on, params); rows without one are left out.

    Rows are sorted by key and bundled, and every bundle meets its network once, however many
    networks there are; the rows of one key may be in many bundles.  The key is compared as text.
    """
    names = [c for c in df.columns if c != on]
    keyed = df.filter(F.col(on).isNotNull()).select(F.col(on).cast("string").alias(on), *names)
    parts = max(1, df.sparkSession.sparkContext.defaultParallelism)
    spread = keyed.repartitionByRange(parts, on, F.xxhash64(*names)).sortWithinPartitions(on)
    inner = ", ".join(f"`{f.name}`:{f.dataType.simpleString()}" for f in spread.schema)
    bundles = spread.mapInArrow(partial(_bundled, on=on), f"key string, rows array<struct<{inner}>>")
    given = networks.filter("params IS NOT NULL").select(F.col(on).cast("string").alias("key"), "params")
    joined = join_lookup(bundles, given, ["key"], "inner")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                rows = batch.column("rows")[i].values
                x = np.asarray(rows.field(features).flatten(), float).reshape(len(rows), size)
                score = _forward(batch.column("params")[i].values.to_numpy(), x)[1]
                yield pa.record_batch([*rows.flatten(), pa.array(score)], [*(f.name for f in rows.type), "score"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in spread.schema)
    return joined.mapInArrow(run, f"{schema}, score double")


def score_mlp(df: DataFrame, weights: Sequence[float], size: int, features: str = "features") -> DataFrame:
    """Add the probability of class 1 as ``score``."""
    flat = np.asarray(weights, dtype=float)

    @F.pandas_udf("double")
    def positive(x: pd.Series) -> pd.Series:
        rows = np.stack(x.to_numpy()) if len(x) else np.zeros((0, size))
        return pd.Series(_forward(flat, rows)[1])

    return df.withColumn("score", positive(F.col(features)))


def score_with_each(
    df: DataFrame, networks: Mapping[str, Sequence[float]], size: int, features: str = "features"
) -> DataFrame:
    """Score each row with every one of a run's few global networks in one pass: a row per (row, model)."""
    held = {name: np.asarray(w, dtype=float) for name, w in networks.items()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            x = np.asarray(batch.column(features).flatten(), float).reshape(n, size)
            for name, weights in held.items():
                found = [pa.array([name] * n, pa.string()), pa.array(_forward(weights, x)[1])]
                yield pa.record_batch([*batch.columns, *found], [*batch.schema.names, "model", "score"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)
    return df.mapInArrow(run, f"{fields}, model string, score double")


def average_weights(weights: Sequence[np.ndarray], rows: Sequence[int]) -> np.ndarray:
    """Row-count-weighted mean of flat weight vectors (a few thousand numbers per silo)."""
    if not len(weights):
        raise ValueError("nothing to average")
    if len({len(w) for w in weights}) > 1:
        raise ValueError("weight vectors differ in length")
    if not sum(rows):
        raise ValueError("the row counts add up to zero")
    return np.average(np.asarray(weights), axis=0, weights=np.asarray(rows, dtype=float))


def federated_rounds(
    df: DataFrame,
    silo: str,
    label: str,
    features: str,
    size: int,
    rounds: int = 3,
    epochs: int = ROUND_EPOCHS,
    seed: int = 0,
    start: Sequence[float] | None = None,
) -> tuple[list[np.ndarray], list[DataFrame]]:
    """Averaged weights after every round, and the silos' networks of every round.

    Each silo continues from the last average.  No usable silo leaves the start weights as
    they are (none at all without a start).
    """
    layout = lay_out(df, silo, label, features, size)
    current, averaged, fits = start, [], []
    for _ in range(rounds):
        fit = train(layout, epochs, seed, current).drop("grp")
        row = average_vectors(fit.filter("params IS NOT NULL"), "params", "n").first()
        if row is None or row.params is None:
            return ([] if start is None else [np.asarray(start)] * rounds), [fit] * rounds
        current = np.array(row.params)
        averaged.append(current)
        fits.append(fit)
    return averaged, fits


def federated_mlp(df: DataFrame, silo: str, label: str, features: str, size: int, **options) -> list[np.ndarray]:
    """Averaged weights after every round of ``federated_rounds``."""
    return federated_rounds(df, silo, label, features, size, **options)[0]
