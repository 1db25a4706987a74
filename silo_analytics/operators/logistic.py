"""Logistic regression: pooled, one model per silo, cross-validated, and scoring.

The grouped fit trains every model of a run at once.  A row carries the names of
the models it belongs to (its region, its hospital, the pooled model, the folds
it is not held out from ...).  In each Newton step every partition adds up
gradient and Hessian per model where the rows lie, and only those sums are
shuffled.  A silo is never gathered, so one that holds most of the rows costs no
more than its share, and the number of jobs does not depend on the number of
silos.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator, Mapping, Sequence
from dataclasses import dataclass, field
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.vectors import constant, probability
from ..scratch import collect_bounded, join_lookup, local_table, materialize
from . import wide

# The functions that run inside tasks travel with the job; executors need no copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

PARAMS_SCHEMA = (
    "model string, n long, n_pos long, skipped boolean, iterations int, converged boolean, "
    "params array<double>"
)
# Features up to which models are fitted by Newton steps; wider ones by gradients alone.
NEWTON_FEATURES = 128
# Rows of one silo that go into one partition.
ROWS_PER_PART = 1_000_000
# Rows of a silo that keep together in the training table; many such parts fill the partitions evenly.
ROWS_TOGETHER = 25_000
# Models whose parameters are held on the driver and broadcast in one step.
MODELS_PER_FIT = 20_000
# Models whose sums a task holds at once before it hands them on.
SUMS_PER_TASK = 2_048
# Models whose sums one task of the second stage adds up, at least.
MODELS_PER_TASK = 16
# Global models whose parameters are written into one scoring expression.
MODELS_PER_SCAN = 1_000
_SUM_SCHEMA = "model string, sums array<double>"
_STEP_SCHEMA = "model string, loss double, gmax double, step array<double>"


def class_weights(df: DataFrame, group: str, label: str) -> DataFrame:
    """Balanced weights n / (2 n_c) of both classes in every group; null without that class."""
    return df.groupBy(group).agg(
        F.count(F.lit(1)).alias("n"),
        F.try_divide(F.count(F.lit(1)), 2 * F.count_if(F.col(label) == 1)).alias("w1"),
        F.try_divide(F.count(F.lit(1)), 2 * F.count_if(F.col(label) == 0)).alias("w0"),
    )


def fit_pooled(
    df: DataFrame, label: str, features: str, c: float = 0.01, max_iter: int = 2000, tol: float = 1e-10
) -> np.ndarray:
    """Class-balanced ridge logistic regression on all rows; returns coefficients and intercept."""
    counts = df.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col(label) == 1).alias("p")).first()
    if counts.p in (0, counts.n):
        raise ValueError("both classes are needed")
    weight = F.when(F.col(label) == 1, counts.n / (2 * counts.p)).otherwise(
        counts.n / (2 * (counts.n - counts.p))
    )
    train = df.select(
        F.col(label).cast("double").alias("label"),
        weight.alias("weight"),
        array_to_vector(F.col(features)).alias("features"),
    )
    model = LogisticRegression(
        weightCol="weight", regParam=1.0 / (c * counts.n), elasticNetParam=0.0, standardization=False,
        maxIter=max_iter, tol=tol,
    ).fit(train)
    return np.append(model.coefficients.toArray(), model.intercept)


def balanced_training_table(
    df: DataFrame, silo: str, key: str, sizes_from: DataFrame, name: str = "training"
) -> DataFrame:
    """Write the training rows with each silo kept together, large silos in several parts.

    A partition then meets few models.  ``sizes_from`` is a cheaper table with the
    same large silos; those above ``ROWS_TOGETHER`` rows are split by a hash of the
    key.
    """
    sizes = sizes_from.groupBy(silo).agg(F.ceil(F.count(F.lit(1)) / ROWS_TOGETHER).alias("_parts"))
    # the rows without a silo are counted and spread like a silo
    marked = join_lookup(df, sizes.filter(F.col("_parts") > 1), [silo], "left")
    part = F.pmod(F.xxhash64(key), F.coalesce("_parts", F.lit(1)))
    return materialize(marked.withColumn("_part", part).repartition(silo, "_part").drop("_parts", "_part"), name)


# ------------------------------------------------------------------ grouped Newton
def _sums(size: int, params: Mapping[str, np.ndarray], weights: Mapping[str, tuple[float, float]]):
    """Per partition: loss, gradient and upper Hessian of every model met."""
    upper = np.triu_indices(size)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, np.ndarray] = {}
        for batch in batches:
            models, y, x = batch.columns
            counts = np.diff(np.asarray(models.offsets))
            names = models.flatten().dictionary_encode()
            codes = np.asarray(names.indices)
            rows = np.repeat(np.arange(len(y)), counts)
            matrix = np.asarray(x.flatten()).reshape(len(y), size - 1)
            matrix = np.column_stack([matrix, np.ones(len(matrix))])
            labels = np.asarray(y)
            order = np.argsort(codes, kind="stable")
            bounds = np.searchsorted(codes[order], np.arange(len(names.dictionary) + 1))
            for code, model in enumerate(names.dictionary.to_pylist()):
                if model not in params:
                    continue
                mine = rows[order[bounds[code] : bounds[code + 1]]]
                xs, ys = matrix[mine], labels[mine]
                z = xs @ params[model]
                p = 1.0 / (1.0 + np.exp(-z))
                s = np.where(ys == 1, weights[model][0], weights[model][1])
                loss = np.sum(s * (np.logaddexp(0.0, z) - ys * z))
                hessian = (xs * (s * p * (1.0 - p))[:, None]).T @ xs
                part = np.concatenate([[loss], xs.T @ (s * (p - ys)), hessian[upper]])
                held[model] = held[model] + part if model in held else part
            if len(held) > SUMS_PER_TASK:
                yield _sum_batch(held)
                held = {}
        if held:
            yield _sum_batch(held)

    return run


def _sum_batch(held: Mapping[str, np.ndarray]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(list(held)), pa.array(list(held.values()), pa.list_(pa.float64()))],
        names=["model", "sums"],
    )


def _steps(size: int, c: float, params: Mapping[str, np.ndarray], mu: float, anchor: np.ndarray | None):
    """Add up the sums of the partitions and solve for the Newton step of every model."""
    upper = np.triu_indices(size)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, np.ndarray] = {}
        for batch in batches:
            parts = np.asarray(batch.column("sums").flatten()).reshape(batch.num_rows, -1)
            for model, part in zip(batch.column("model").to_pylist(), parts):
                held[model] = held[model] + part if model in held else part
        out = []
        for model, total in held.items():
            w = params[model]
            ridge = np.append(np.ones(size - 1), 0.0)
            loss = c * total[0] + 0.5 * np.sum(ridge * w * w)
            gradient = c * total[1 : size + 1] + ridge * w
            hessian = np.zeros((size, size))
            hessian[upper] = c * total[size + 1 :]
            hessian = hessian + np.triu(hessian, 1).T + np.diag(ridge)
            if mu and anchor is not None:
                away = w - anchor
                loss += 0.5 * mu * np.sum(away * away)
                gradient = gradient + mu * away
                hessian = hessian + mu * np.eye(size)
            try:
                step = np.linalg.solve(hessian, gradient)
            except np.linalg.LinAlgError:
                step = np.linalg.lstsq(hessian, gradient, rcond=None)[0]
            out.append((model, float(loss), float(np.max(np.abs(gradient))), step.tolist()))
        if out:
            cols = list(zip(*out))
            yield pa.RecordBatch.from_arrays(
                [pa.array(cols[0]), pa.array(cols[1]), pa.array(cols[2]), pa.array(cols[3])],
                names=["model", "loss", "gmax", "step"],
            )

    return run


@dataclass
class _State:
    """One model between two Newton steps."""

    n: int
    n_pos: int
    params: np.ndarray
    skipped: bool = False
    done: bool = False
    iterations: int = 0
    accepted: np.ndarray | None = field(default=None)
    accepted_loss: float = float("inf")

    @property
    def weights(self) -> tuple[float, float]:
        """Balanced weights of the positive and the other rows."""
        return self.n / (2.0 * self.n_pos), self.n / (2.0 * (self.n - self.n_pos))

    def update(self, loss: float, gmax: float, step: np.ndarray, tol: float) -> None:
        self.iterations += 1
        if loss > self.accepted_loss + 1e-12 * max(1.0, abs(self.accepted_loss)):
            if np.allclose(self.params, self.accepted, rtol=0.0, atol=1e-14):
                self.params, self.done = self.accepted, True
            else:
                self.params = (self.params + self.accepted) / 2.0
            return
        self.accepted, self.accepted_loss = self.params, loss
        if gmax < tol:
            self.done = True
        else:
            self.params = self.params - step


def fit_grouped(
    df: DataFrame,
    models: str | Column,
    label: str = "label",
    features: str = "features",
    c: float = 0.01,
    max_iter: int = 100,
    tol: float = 1e-6,
    min_rows: int = 5,
    init: Mapping[str, Sequence[float]] | Sequence[float] | None = None,
    prox_mu: float = 0.0,
    anchor: Sequence[float] | None = None,
) -> DataFrame:
    """Fit one class-balanced ridge logistic regression per model name.

    ``models`` is an ``array<string>``: the models a row trains.  A model with
    fewer than ``min_rows`` rows or one class is kept as a skipped row with zero
    parameters.  ``init`` is one start vector or one per model.  With ``prox_mu``
    the objective gains mu/2 |w - anchor|^2.  Returns ``PARAMS_SCHEMA``; the
    intercept is the last parameter and is not penalised.

    Beyond ``NEWTON_FEATURES`` features no Hessian is added up: ``wide.descend``
    takes the same objective to the same gradient bound, at a few vectors of
    memory per model and 20 times ``max_iter`` steps at most.
    """
    rows = df.select(
        (F.col(models) if isinstance(models, str) else models).alias("models"),
        F.col(label).cast("double").alias("y"),
        F.col(features).alias("x"),
    )
    stats = (
        rows.select(F.explode("models").alias("model"), "y", F.size("x").alias("d"))
        .groupBy("model")
        .agg(
            F.count(F.lit(1)).alias("n"),
            F.sum(F.col("y").cast("long")).alias("n_pos"),
            F.max("d").alias("d"),
        )
    )
    found = collect_bounded(stats, MODELS_PER_FIT)
    if found is None:
        return _fit_in_chunks(
            rows, stats, c=c, max_iter=max_iter, tol=tol, min_rows=min_rows, init=init,
            prox_mu=prox_mu, anchor=anchor,
        )
    if not found:
        return local_table(df.sparkSession, [], PARAMS_SCHEMA)

    size = found[0].d + 1
    slim = size - 1 <= NEWTON_FEATURES
    states: dict[str, _State] = {}
    for r in found:
        start = init.get(r.model) if isinstance(init, Mapping) else init
        start = np.zeros(size) if start is None else np.asarray(start, dtype=float)
        if start.shape != (size,):
            raise ValueError(f"start vector of {r.model} has {start.shape[0]} values, not {size}")
        skip = r.n < min_rows or r.n_pos < 1 or r.n - r.n_pos < 1
        states[r.model] = _State(r.n, r.n_pos, start, skipped=skip, done=skip)
    target = None if anchor is None else np.asarray(anchor, dtype=float)

    spark = df.sparkSession
    if not slim:
        _descend(rows, states, wide.Objective(c, prox_mu, target), 20 * max_iter, tol)
    fan = int(spark.conf.get("spark.sql.shuffle.partitions"))
    for _ in range(max_iter if slim else 0):
        current = {m: s.params for m, s in states.items() if not s.done}
        if not current:
            break
        weights = {m: states[m].weights for m in current}
        steps = (
            rows.mapInArrow(_sums(size, current, weights), _SUM_SCHEMA)
            .repartition(min(fan, -(-len(current) // MODELS_PER_TASK)), "model")
            .mapInArrow(_steps(size, c, current, prox_mu, target), _STEP_SCHEMA)
            .collect()  # one row per open model, at most MODELS_PER_FIT
        )
        for r in steps:
            states[r.model].update(r.loss, r.gmax, np.asarray(r.step), tol)

    result = []
    for name, s in sorted(states.items()):
        params = np.zeros(size) if s.skipped else (s.accepted if s.accepted is not None else s.params)
        converged = s.done and not s.skipped
        result.append((name, s.n, s.n_pos, s.skipped, s.iterations, converged, params.tolist()))
    return local_table(spark, result, PARAMS_SCHEMA)


def _descend(rows: DataFrame, states: Mapping[str, _State], objective: wide.Objective, max_iter: int, tol: float) -> None:
    """Fit the open models by gradients alone; the states keep what is found.

    More models than a chain of evaluations may hold are cut into chains.  The rows are then
    written once per model they train, and a chain scans only its own folder.
    """
    names = [m for m, s in states.items() if not s.done]
    if not names:
        return
    most = wide.models_per_chain(len(states[names[0]].params))
    chains = [names[i : i + most] for i in range(0, len(names), most)]
    parts = [rows]
    if len(chains) > 1:
        number = local_table(rows.sparkSession, [(m, i) for i, chain in enumerate(chains) for m in chain], "model string, chunk int")
        single = rows.select(F.explode("models").alias("model"), "y", "x").join(F.broadcast(number), "model")
        salts = max(1, -(-sum(states[m].n for m in names) // (len(chains) * ROWS_PER_PART)))
        spread = single.repartition(F.col("chunk"), F.pmod(F.xxhash64("model", "x"), F.lit(salts)))
        table = materialize(spread.select("chunk", F.array("model").alias("models"), "y", "x"), "wide-rows", partition_by=["chunk"])
        parts = [table.filter(F.col("chunk") == i).drop("chunk") for i in range(len(chains))]
    for chain, part in zip(chains, parts):
        starts, weights = ({m: pick(states[m]) for m in chain} for pick in (lambda s: s.params, lambda s: s.weights))
        pairs = sum(states[m].n for m in chain)
        for model, (params, rounds, flat) in wide.descend(part, starts, weights, objective, max_iter, tol, pairs).items():
            state = states[model]
            state.accepted, state.iterations, state.done = params, rounds, flat


def _fit_in_chunks(rows: DataFrame, stats: DataFrame, **options) -> DataFrame:
    """More models than one step may hold: fit them in groups of bounded size.

    The rows are written once per chunk they matter to, so each chunk's steps scan
    only their own folder.
    """
    sizes = stats.agg(F.count(F.lit(1)).alias("models"), F.sum("n").alias("rows")).first()
    chunks = -(-sizes.models // (MODELS_PER_FIT // 2))
    salts = max(1, -(-sizes.rows // (chunks * ROWS_PER_PART)))
    number = F.pmod(F.xxhash64("model"), F.lit(chunks)).cast("int")
    single = rows.select(F.explode("models").alias("model"), "y", "x").withColumn("chunk", number)
    spread = single.repartition(F.col("chunk"), F.pmod(F.xxhash64("model", "x"), F.lit(salts)))
    table = materialize(spread, "chunks", partition_by=["chunk"])
    parts = []
    for i in range(chunks):
        part = table.filter(F.col("chunk") == i).select(F.array("model").alias("models"), "y", "x")
        parts.append(materialize(fit_grouped(part, "models", "y", "x", **options), "params"))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


# ------------------------------------------------------------------ scoring
def score_by_key(df: DataFrame, params: DataFrame, on: str, size: int, features: str = "features") -> DataFrame:
    """Score each row with the parameters of its own key (``params``: on, params)."""
    joined = join_lookup(df, params.select(on, "params"), [on], "inner")
    return joined.withColumn("score", probability(features, "params", size)).drop("params")


def score_models(
    df: DataFrame, params: Mapping[str, Sequence[float]], size: int, features: str = "features"
) -> DataFrame:
    """Score each row with every model: one output row per (row, model).

    For the global models of a run; their parameters become constants of the expression,
    those of ``MODELS_PER_SCAN`` models in every scan.
    """
    if len(params) > MODELS_PER_SCAN:
        names = list(params)
        blocks = [names[i : i + MODELS_PER_SCAN] for i in range(0, len(names), MODELS_PER_SCAN)]
        return reduce(DataFrame.unionByName, [score_models(df, {m: params[m] for m in b}, size, features) for b in blocks])
    entries = [F.struct(F.lit(m).alias("model"), constant(w).alias("params")) for m, w in params.items()]
    table = F.array(*entries)
    spread = df.withColumn("_m", F.explode(table))
    scored = spread.withColumn("score", probability(features, "_m.params", size))
    return scored.withColumn("model", F.col("_m.model")).drop("_m")


def fold_models(fold: str, folds: int) -> Column:
    """Names of the fold models a row trains: all but the one it is held out from."""
    names = F.array(*[F.lit(f"fold:{i}") for i in range(folds)])
    own = F.concat(F.lit("fold:"), F.col(fold).cast("string"))
    return F.array_remove(names, own)
