"""The five training strategies on one prepared table.

All linear models of a run (pooled, folds, regions, hospitals, skewed silos) are
fitted together by one grouped fit.  A silo's ridge logistic model has a single
optimum that does not depend on the start, so later averaging rounds reuse it
instead of fitting again; only the proximal variant, whose objective moves with
the averaged model, is fitted every round.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalar import relabel_null
from ..functions.vectors import constant, pull_coefficients, relative_importance
from ..operators.averaging import average_importances, average_vectors
from ..operators.bootstrap import bootstrap_auroc
from ..operators.logistic import fit_grouped, fold_models, score_by_key, score_models
from ..operators.metrics import ranking_metrics, threshold_metrics
from ..operators.neural import POOLED_EPOCHS, ROUND_EPOCHS, Layout, lay_out_shared, score_networks, score_with_each, train
from ..operators.relational import group_label_counts, size_gate
from ..operators.sampling import skew_partition, stratified_folds
from ..scratch import join_lookup, local_table, materialize
from ..spec import STRATEGIES, DatasetSpec, RunConfig

GLOBAL_METRICS = (
    "global_auroc", "global_auroc_single", "auroc_ci_lo", "auroc_ci_hi", "global_ap", "global_f1",
    "global_precision", "global_recall",
)
METRICS = "strategy string, round int, silo string, metric string, value double, n long"
PARAMS = "strategy string, round int, params array<double>"
GATE = "silo string, n long, n_pos long, n_neg long, local_auroc double, status string"


@dataclass
class Prepared:
    """Training and test rows with feature vectors; ``train`` is a written table."""

    train: DataFrame
    test: DataFrame
    spec: DatasetSpec
    cfg: RunConfig

    @property
    def size(self) -> int:
        return self.spec.size


@dataclass
class StrategyResults:
    """Long metric table, global parameters per round, gate report and importances."""

    metrics: DataFrame
    params: DataFrame
    gate: DataFrame | None = None
    local_params: DataFrame | None = None
    importances: dict[str, list[float]] = field(default_factory=dict)


def _name(prefix: str, value: Column) -> Column:
    return F.concat(F.lit(prefix + ":"), value.cast("string"))


def gate_candidates(train: DataFrame, spec: DatasetSpec, cfg: RunConfig) -> DataFrame:
    """Hospitals with their counts and whether they are large enough."""
    stats = group_label_counts(train, spec.hospital, spec.label)
    return size_gate(stats, cfg.min_hospital_stays, cfg.min_hospital_pos, cfg.min_hospital_neg)


def membership(prepared: Prepared, strategies: Sequence[int]) -> tuple[DataFrame, list[Column], list[Column]]:
    """Training rows with the columns that the models of the strategies need.

    Returns the rows, the names of the models a row trains, and the names of the
    models it is scored with afterwards (its own silos, the fold it is held out from).
    """
    spec, cfg = prepared.spec, prepared.cfg
    rows = prepared.train.withColumn("_region", relabel_null(F.col(spec.region).cast("string")))
    trains: list[Column] = []
    scores: list[Column] = []
    if 1 in strategies:
        rows = stratified_folds(rows, spec.label, spec.key, cfg.cv_folds, cfg.random_state, "_fold")
        trains += [F.array(F.lit("pooled")), fold_models("_fold", cfg.cv_folds)]
        scores.append(_name("fold", F.col("_fold")))
    if {2, 4} & set(strategies):
        trains.append(F.array(_name("region", F.col("_region"))))
        scores.append(_name("region", F.col("_region")))
    if 3 in strategies:
        large = gate_candidates(rows, spec, cfg).filter("candidate").select(
            spec.hospital, F.lit(True).alias("_large")
        )
        rows = join_lookup(rows, large, [spec.hospital], "left")
        hospital = F.when(F.col("_large"), _name("hospital", F.col(spec.hospital)))
        trains.append(F.array(hospital))
        scores.append(hospital)
    if 5 in strategies:
        rows = skew_partition(
            rows, spec.label, spec.key, cfg.noniid_n_clients, cfg.dirichlet_alpha, cfg.random_state, "_skew"
        )
        trains.append(F.array(_name("skew", F.col("_skew"))))
        scores.append(_name("skew", F.col("_skew")))
    return rows, trains, scores


def averaging_rounds(
    local: DataFrame, rounds: int, size: int, start: Sequence[float], mu: float = 0.0
) -> list[list[float]]:
    """Global parameters after every round, from the silos' optima (``params``, ``n``).

    With ``mu`` each silo's coefficients are first pulled toward the previous
    global ones.  No silo leaves the start as it is.
    """
    current, out = list(start), []
    for _ in range(rounds):
        if mu == 0.0 and out:
            out.append(out[-1])  # same silo optima, same weights, same mean
            continue
        target = constant(current)
        moved = local if mu == 0.0 else local.withColumn(
            "params", pull_coefficients(F.col("params"), target, mu, size)
        )
        row = average_vectors(moved, "params", "n").first()
        current = list(row.params) if row is not None and row.params else current
        out.append(current)
    return out


def proximal_rounds(
    rows: DataFrame, models: Column, prepared: Prepared, start: Sequence[float]
) -> tuple[list[list[float]], list[DataFrame]]:
    """Rounds in which each silo minimises its loss plus mu/2 |w - global|^2."""
    cfg, current, out, fits = prepared.cfg, list(start), [], []
    for _ in range(cfg.fl_rounds):
        fit = fit_grouped(
            rows, models, prepared.spec.label, c=cfg.c, init=current, prox_mu=cfg.fedprox_mu, anchor=current
        ).filter(~F.col("skipped"))
        row = average_vectors(fit, "params", "n").first()
        current = list(row.params) if row is not None else current
        out.append(current)
        fits.append(fit)
    return out, fits


def global_metrics(scored: DataFrame, spec: DatasetSpec, cfg: RunConfig, by: Sequence[str] = ("model",)) -> DataFrame:
    """Held-out metrics of every model, rounded to four decimals.

    ``global_auroc`` is the mean over bootstrap replicates; the plain one is used
    where no replicate has both classes.
    """
    by = list(by)
    rank = ranking_metrics(scored, by, spec.label)
    hard = threshold_metrics(scored, by, spec.label).drop("n")
    boot = bootstrap_auroc(
        scored, by, spec.key, label=spec.label, replicates=cfg.n_bootstrap, seed=cfg.bootstrap_seed
    )
    joined = rank.join(hard, by).join(boot, by, "left")
    values = {
        "global_auroc": F.coalesce("auroc_boot", "auroc"),
        "global_auroc_single": F.col("auroc"),
        "auroc_ci_lo": F.coalesce("auroc_ci_lo", F.lit(0.0)),
        "auroc_ci_hi": F.coalesce("auroc_ci_hi", F.lit(1.0)),
        "global_ap": F.col("ap"),
        "global_f1": F.col("f1"),
        "global_precision": F.col("precision"),
        "global_recall": F.col("recall"),
    }
    return joined.select(*by, "n", "n_pos", *[F.round(v, 4).alias(k) for k, v in values.items()], "accuracy")


def run_linear(prepared: Prepared, strategies: Sequence[int], evaluate: bool = True) -> StrategyResults:
    """Fit, average, gate and evaluate the logistic strategies.

    Without ``evaluate`` only the global parameters are found (not those of the gated strategy,
    whose gate is an evaluation).
    """
    spec, cfg, size = prepared.spec, prepared.cfg, prepared.size
    spark = prepared.train.sparkSession
    rows, trains, score_names = membership(prepared, strategies)
    models = F.array_compact(F.concat(*trains))
    rows = materialize(
        rows.select(
            spec.label, "features", models.alias("_models"), F.array_compact(F.array(*score_names)).alias("_own")
        ),
        "memberships",
    )
    fitted = fit_grouped(rows, "_models", spec.label, c=cfg.c).select("model", "n", "n_pos", "skipped", "params")
    usable = fitted.filter(~F.col("skipped"))

    def of(prefix: str) -> DataFrame:
        return usable.filter(F.col("model").startswith(prefix + ":"))

    pooled = usable.filter(F.col("model") == "pooled").first()
    start = list(pooled.params) if pooled else [0.0] * (size + 1)

    globals_: dict[tuple[int, int], list[float]] = {}
    if pooled:
        globals_[1, 1] = start
    if 2 in strategies:
        for r, w in enumerate(averaging_rounds(of("region"), cfg.fl_rounds, size, start), 1):
            globals_[2, r] = w
    pulled: list[DataFrame] = []
    if 4 in strategies:
        if cfg.prox_mode == "proximal" and cfg.fedprox_mu > 0:
            region_only = F.filter("_models", lambda m: m.startswith("region:"))
            averaged, pulled = proximal_rounds(rows, region_only, prepared, start)
        else:
            averaged = averaging_rounds(of("region"), cfg.fl_rounds, size, start, cfg.fedprox_mu)
            for before in [start, *averaged[:-1]]:
                target = constant(before)
                pulled.append(
                    of("region").withColumn("params", pull_coefficients(F.col("params"), target, cfg.fedprox_mu, size))
                )
        for r, w in enumerate(averaged, 1):
            globals_[4, r] = w
    if 5 in strategies:
        for r, w in enumerate(averaging_rounds(of("skew"), cfg.fl_rounds, size, start), 1):
            globals_[5, r] = w

    if not evaluate:
        found = [(STRATEGIES[s], r, list(map(float, w))) for (s, r), w in sorted(globals_.items())]
        return StrategyResults(local_table(spark, [], METRICS), local_table(spark, found, PARAMS), None, fitted)

    # in-sample metrics of the silo models and held-out metrics of the folds, in one pass
    own = usable.filter(F.col("model") != "pooled").select("model", "params")
    for r, table in enumerate(pulled, 1):
        own = own.unionByName(table.select(F.concat(F.lit(f"pulled{r}:"), "model").alias("model"), "params"))
    names = F.col("_own")
    regions = F.filter("_own", lambda m: m.startswith("region:"))
    for r in range(1, len(pulled) + 1):
        tag = F.lit(f"pulled{r}:")
        names = F.concat(names, F.transform(regions, lambda m: F.concat(tag, m)))
    spread = rows.select(spec.label, "features", F.explode(names).alias("model"))
    # written once: the ranking reads the scores several times
    own_scores = materialize(score_by_key(spread, own, "model", size).drop("features"), "own-scores")
    local = ranking_metrics(own_scores, ["model"], spec.label)
    local = materialize(
        local.select("model", F.round("auroc", 4).alias("local_auroc"), F.round("ap", 4).alias("local_ap"), "n"),
        "local-metrics",
    )

    gate = None
    if 3 in strategies:
        gate = gate_report(prepared, fitted, local)
        gate = materialize(gate, "gate")
        passed = of("hospital").join(
            gate.filter(F.col("status") == "in").select(F.concat(F.lit("hospital:"), "silo").alias("model")),
            "model", "left_semi",
        )
        if not gate.filter(F.col("status") == "in").isEmpty():
            for r, w in enumerate(averaging_rounds(passed, cfg.fl_rounds, size, start), 1):
                globals_[3, r] = w
        usable = usable.join(
            of("hospital").join(passed, "model", "left_anti").select("model"), "model", "left_anti"
        )

    metrics = evaluate_rounds(prepared, {(STRATEGIES[s], r): w for (s, r), w in globals_.items()})
    metrics = metrics.unionByName(_silo_metrics(usable, local, cfg, strategies))
    metrics = metrics.unionByName(_skipped_silos(fitted, cfg, strategies))
    metrics = metrics.unionByName(_label_profile(prepared, strategies, usable))
    if gate is not None:
        metrics = metrics.unionByName(_gate_counts(gate))
        metrics = metrics.unionByName(_nobody_passed(prepared, (3, 1) in globals_))
    params = local_table(spark, 
        [(STRATEGIES[s], r, list(map(float, w))) for (s, r), w in sorted(globals_.items())], PARAMS
    )
    result = StrategyResults(materialize(metrics, "metrics"), params, gate, fitted)
    result.importances = _importances(usable, strategies, size)
    return result


def gate_report(prepared: Prepared, fitted: DataFrame, local: DataFrame) -> DataFrame:
    """Every hospital with its counts, in-sample AUROC and status.

    Status is ``in``, ``not_candidate`` (below the minimum size), ``too_small``
    (cannot be trained) or the failed comparison with the gate.
    """
    spec, cfg = prepared.spec, prepared.cfg
    hospitals = gate_candidates(prepared.train, spec, cfg)
    hospitals = hospitals.withColumn("model", _name("hospital", F.col(spec.hospital)))
    joined = hospitals.join(fitted.select("model", "skipped"), "model", "left").join(
        local.select("model", "local_auroc"), "model", "left"
    )
    auroc = F.coalesce("local_auroc", F.lit(0.0))
    # The texts of the statuses.
    reason = F.concat(F.lit("auroc_"), F.format_string("%.3f", auroc), F.lit(f"<{cfg.auroc_gate}"))
    status = (
        F.when(~F.col("candidate"), F.lit("not_candidate"))
        .when(F.coalesce("skipped", F.lit(True)), F.lit("too_small"))
        .when(auroc >= cfg.auroc_gate, F.lit("in"))
        .otherwise(reason)
    )
    return joined.select(
        F.col(spec.hospital).cast("string").alias("silo"), "n", "n_pos", "n_neg", auroc.alias("local_auroc"),
        status.alias("status"),
    )


def evaluate_rounds(prepared: Prepared, globals_: dict[tuple[str, int], list[float]]) -> DataFrame:
    """Held-out metrics of every (strategy name, round); equal models are scored once."""
    spark = prepared.train.sparkSession
    distinct: dict[tuple[float, ...], str] = {}
    where = []
    for (s, r), w in sorted(globals_.items()):
        name = distinct.setdefault(tuple(w), f"m{len(distinct)}")
        where.append((s, r, name))
    if not where:
        return local_table(spark, [], METRICS)
    scored = score_models(
        prepared.test.select(prepared.spec.key, prepared.spec.label, "features"),
        {name: w for w, name in distinct.items()},
        prepared.size,
    ).drop("features")
    scored = materialize(scored, "scored")
    values = global_metrics(scored, prepared.spec, prepared.cfg)
    table = F.broadcast(local_table(spark, where, "strategy string, round int, model string"))
    long = values.join(table, "model").unpivot(
        ["strategy", "round", "n"], list(GLOBAL_METRICS), "metric", "value"
    )
    return long.select("strategy", "round", F.lit(None).cast("string").alias("silo"), "metric", "value", "n")


def _silo_metrics(usable: DataFrame, local: DataFrame, cfg: RunConfig, strategies: Sequence[int]) -> DataFrame:
    """Local metrics per silo and round, their weighted mean, and the fold summary."""
    silos = usable.select("model", "n").join(local.drop("n"), "model")
    parts = []
    kinds = {2: "region", 3: "hospital", 5: "skew"}
    for s in strategies:
        rounds = F.explode(F.sequence(F.lit(1), F.lit(cfg.fl_rounds)))
        if s in kinds:
            mine = silos.filter(F.col("model").startswith(kinds[s] + ":")).withColumn("round", rounds)
            mine = mine.withColumn("silo", F.regexp_replace("model", "^[a-z]+:", ""))
        elif s == 4:
            found = local.filter(F.col("model").rlike("^pulled[0-9]+:"))
            mine = found.withColumn("round", F.regexp_extract("model", "^pulled([0-9]+):", 1).cast("int"))
            mine = mine.withColumn("silo", F.regexp_replace("model", "^pulled[0-9]+:region:", ""))
        else:
            folds = local.filter(F.col("model").startswith("fold:"))
            cv = folds.agg(
                F.avg("local_auroc").alias("cv_auroc"), F.stddev_pop("local_auroc").alias("cv_std"), F.sum("n").alias("n")
            ).withColumns({"strategy": F.lit(STRATEGIES[1]), "round": F.lit(1), "silo": F.lit(None).cast("string")})
            parts.append(cv.unpivot(["strategy", "round", "silo", "n"], ["cv_auroc", "cv_std"], "metric", "value"))
            mine = folds.withColumns({"round": F.lit(1), "silo": F.col("model")})
        mine = mine.withColumn("strategy", F.lit(STRATEGIES[s]))
        keys = ["strategy", "round", "silo", "n"]
        parts.append(mine.unpivot(keys, ["local_auroc", "local_ap"], "metric", "value"))
        if s != 1:
            total = mine.groupBy("strategy", "round").agg(
                (F.sum(F.col("local_auroc") * F.col("n")) / F.sum("n")).alias("local_weighted_auroc"),
                F.count(F.lit(1)).cast("double").alias("participants"),
                F.sum("n").alias("n"),
            ).withColumn("silo", F.lit(None).cast("string"))
            parts.append(total.unpivot(keys, ["local_weighted_auroc", "participants"], "metric", "value"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.select("strategy", "round", "silo", "metric", F.round("value", 4).alias("value"), "n")


def _skipped_silos(fitted: DataFrame, cfg: RunConfig, strategies: Sequence[int]) -> DataFrame:
    """Zero scores of the silos that are too small or have one class, for every round."""
    kinds = F.array(*[F.struct(F.lit(k).alias("kind"), F.lit(STRATEGIES[s]).alias("strategy"))
                      for s, k in ((2, "region"), (4, "region"), (5, "skew")) if s in strategies]
                    or [F.struct(F.lit("").alias("kind"), F.lit("").alias("strategy"))])
    rows = fitted.filter("skipped").withColumn("k", F.explode(kinds))
    rows = rows.filter(F.col("model").startswith(F.concat("k.kind", F.lit(":"))) & (F.col("k.kind") != ""))
    rows = rows.withColumn("round", F.explode(F.sequence(F.lit(1), F.lit(cfg.fl_rounds))))
    metric = F.explode(F.array(F.lit("local_auroc"), F.lit("local_ap"))).alias("metric")
    return rows.select(
        "k.strategy", "round", F.regexp_replace("model", "^[a-z]+:", "").alias("silo"), metric,
        F.lit(0.0).alias("value"), "n",
    )


def _label_profile(prepared: Prepared, strategies: Sequence[int], usable: DataFrame) -> DataFrame:
    """Rows, positives and rate of the training table, repeated for every strategy."""
    label = F.col(prepared.spec.label).cast("double")
    profile = prepared.train.agg(
        F.count(F.lit(1)).alias("n"),
        F.sum(label).alias("n_pos"),
        F.round(F.avg(label) * 100, 1).alias("rate_pct"),
    )
    names = F.array(*[F.lit(STRATEGIES[s]) for s in strategies])
    spread = profile.select("*", F.explode(names).alias("strategy")).withColumns(
        {"round": F.lit(1), "silo": F.lit(None).cast("string")}
    )
    long = spread.unpivot(["strategy", "round", "silo", "n"], ["n_pos", "rate_pct"], "metric", "value")
    return long.select("strategy", "round", "silo", "metric", "value", "n")


def _gate_counts(gate: DataFrame) -> DataFrame:
    status = F.col("status")
    counts = gate.agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(status == "in").cast("double").alias("screened_in"),
        F.count_if((status != "in") & (status != "not_candidate")).cast("double").alias("screened_out"),
        F.count_if(status == "not_candidate").cast("double").alias("skipped_too_small"),
    ).withColumns({"strategy": F.lit(STRATEGIES[3]), "round": F.lit(1), "silo": F.lit(None).cast("string")})
    names = ["screened_in", "screened_out", "skipped_too_small"]
    long = counts.unpivot(["strategy", "round", "silo", "n"], names, "metric", "value")
    return long.select("strategy", "round", "silo", "metric", "value", "n")


def _importances(usable: DataFrame, strategies: Sequence[int], size: int) -> dict[str, list[float]]:
    """Row-weighted mean importance of every feature per strategy (one short vector each)."""
    kind = F.substring_index("model", ":", 1)
    known = {1: "pooled", 2: "region", 3: "hospital", 4: "region", 5: "skew"}
    table = usable.withColumns({"kind": kind, "imp": relative_importance(F.col("params"), size)})
    rows = average_importances(table.filter(kind.isin(*known.values())), "imp", "n", ["kind"]).collect()
    found = {r.kind: r.importances for r in rows}
    return {STRATEGIES[s]: found[known[s]] for s in strategies if found.get(known[s])}


def run_mlp(
    prepared: Prepared, strategies: Sequence[int], pooled_epochs: int = POOLED_EPOCHS, epochs: int = ROUND_EPOCHS
) -> StrategyResults:
    """The strategies with the perceptron: the same metric rows as ``run_linear``.

    Pulling toward the global model changes linear coefficients only, so strategy 4
    equals strategy 2 here.
    """
    spec, cfg, size = prepared.spec, prepared.cfg, prepared.size
    spark: SparkSession = prepared.train.sparkSession
    rows = prepared.train.withColumn("_region", relabel_null(F.col(spec.region).cast("string")))
    found: dict[tuple[int, int], np.ndarray] = {}
    local: list[DataFrame] = []
    gate = start = None
    if 1 in strategies:
        start, folds = _mlp_pooled(rows, prepared, pooled_epochs)
        found[1, 1] = start
        local.append(folds)
    # The silos of all strategies are laid out once and go through every round together.
    members = []
    if {2, 4} & set(strategies):
        members.append(_member("region", F.col("_region")))
    if 3 in strategies:
        large = gate_candidates(rows, spec, cfg).filter("candidate").select(spec.hospital, F.lit(True).alias("_large"))
        rows = join_lookup(rows, large, [spec.hospital], "left")
        members.append(_member("hospital", F.when(F.col("_large"), F.col(spec.hospital).cast("string"))))
    if 5 in strategies:
        rows = skew_partition(rows, spec.label, spec.key, cfg.noniid_n_clients, cfg.dirichlet_alpha, cfg.random_state, "_skew")
        members.append(_member("skew", F.col("_skew").cast("string")))
    rounds: dict[str, list[tuple[np.ndarray, DataFrame]]] = {}
    if members:
        layout = lay_out_shared(rows, F.array(*members), spec.label, "features", size)
        fits = train(layout, epochs, cfg.random_state, start)
        if 3 in strategies:
            # The gate looks at the fits of the first round; hospitals that pass go on from there.
            first = fits.filter("grp = 'hospital'")
            model = F.concat(F.lit("hospital:"), "silo").alias("model")
            gate = materialize(
                gate_report(
                    prepared, first.select(model, F.col("params").isNull().alias("skipped")),
                    first.select(model, F.round("auroc", 4).alias("local_auroc")),
                ),
                "gate",
            )
            out = gate.filter("status <> 'in'").select(F.lit("hospital").alias("grp"), "silo")
            named = layout.sizes.select("grp", "silo")
            stay = materialize(named.join(out, ["grp", "silo"], "left_anti"), "taking-part")
            layout, fits = layout.only(stay), join_lookup(fits, stay, ["grp", "silo"], "left_semi")
        rounds = _mlp_rounds(layout, fits, epochs, prepared, start)
    groups = {2: "region", 3: "hospital", 4: "region", 5: "skew"}
    for s in strategies:
        for r, (weights, fit) in enumerate(rounds.get(groups.get(s, ""), []), 1):
            if weights is not None:
                found[s, r] = weights
            local.append(_mlp_silos(fit, s, r))

    metrics = _mlp_global(prepared, found)
    for part in local:
        metrics = metrics.unionByName(part)
    everything = spark.range(1).select(F.lit("").alias("model"))
    metrics = metrics.unionByName(_label_profile(prepared, strategies, everything))
    if gate is not None:
        metrics = metrics.unionByName(_gate_counts(gate))
        metrics = metrics.unionByName(_nobody_passed(prepared, (3, 1) in found))
    params = local_table(spark, [(STRATEGIES[s], r, w.tolist()) for (s, r), w in sorted(found.items())], PARAMS)
    return StrategyResults(materialize(metrics, "metrics"), params, gate)


def _member(group: str, silo: Column) -> Column:
    return F.struct(F.lit(group).alias("grp"), silo.alias("silo"))


def _mlp_rounds(
    layout: Layout, fits: DataFrame, epochs: int, prepared: Prepared, start: np.ndarray | None
) -> dict[str, list[tuple[np.ndarray | None, DataFrame]]]:
    """(averaged weights, fits) of every round by group; each silo goes on from the last average of its group.

    A group without a usable silo keeps the start weights, or has none.
    """
    cfg = prepared.cfg
    groups = [r.grp for r in layout.sizes.select("grp").distinct().collect()]
    rounds: dict[str, list] = {g: [] for g in groups}
    current: dict[str, np.ndarray | None] = dict.fromkeys(groups, start)
    for number in range(cfg.fl_rounds):
        if number:
            fits = train(layout, epochs, cfg.random_state, current)
        means = average_vectors(fits.filter("params IS NOT NULL"), "params", "n", ["grp"]).collect()  # a row per strategy
        current |= {r.grp: np.array(r.params) for r in means}
        for g in groups:
            rounds[g].append((current[g], fits.filter(F.col("grp") == g).drop("grp")))
    return rounds


def _mlp_global(prepared: Prepared, found: dict[tuple[int, int], np.ndarray]) -> DataFrame:
    """Held-out metrics of every (strategy, round); equal networks are scored once, all in one pass."""
    spec, cfg, size = prepared.spec, prepared.cfg, prepared.size
    spark = prepared.train.sparkSession
    if not found:
        return local_table(spark, [], METRICS)
    test = prepared.test.select(spec.key, spec.label, "features")
    distinct: dict[bytes, str] = {}
    for w in found.values():
        distinct.setdefault(w.tobytes(), f"m{len(distinct)}")
    scored = score_with_each(test, {name: np.frombuffer(w) for w, name in distinct.items()}, size).drop("features")
    values = global_metrics(materialize(scored, "scored"), spec, cfg)
    where = [(STRATEGIES[s], r, distinct[w.tobytes()]) for (s, r), w in found.items()]
    table = F.broadcast(local_table(spark, where, "strategy string, round int, model string"))
    long = values.join(table, "model").unpivot(["strategy", "round", "n"], list(GLOBAL_METRICS), "metric", "value")
    return long.select("strategy", "round", F.lit(None).cast("string").alias("silo"), "metric", "value", "n")


def _mlp_silos(fit: DataFrame, strategy: int, number: int) -> DataFrame:
    """In-sample scores of every silo of one round, skipped ones with zeros, and their weighted mean."""
    mine = fit.select(
        F.lit(STRATEGIES[strategy]).alias("strategy"), F.lit(number).alias("round"), "silo", "n",
        F.round("auroc", 4).alias("local_auroc"), F.round("ap", 4).alias("local_ap"), F.col("params").isNotNull().alias("used"),
    )
    total = mine.filter("used").groupBy("strategy", "round").agg(
        (F.sum(F.col("local_auroc") * F.col("n")) / F.sum("n")).alias("local_weighted_auroc"),
        F.count(F.lit(1)).cast("double").alias("participants"), F.sum("n").alias("n"),
    ).withColumn("silo", F.lit(None).cast("string"))
    keys = ["strategy", "round", "silo", "n"]
    both = mine.drop("used").unpivot(keys, ["local_auroc", "local_ap"], "metric", "value").unionByName(
        total.unpivot(keys, ["local_weighted_auroc", "participants"], "metric", "value")
    )
    return both.select("strategy", "round", "silo", "metric", F.round("value", 4).alias("value"), "n")


def _mlp_pooled(rows: DataFrame, prepared: Prepared, epochs: int) -> tuple[np.ndarray, DataFrame]:
    """The pooled network, and its cross-validation: every fold scored by the network of the others.

    All of them are trained together.
    """
    spec, cfg, size = prepared.spec, prepared.cfg, prepared.size
    folded = stratified_folds(rows, spec.label, spec.key, cfg.cv_folds, cfg.random_state, "_fold")
    folded = materialize(folded.select(spec.label, "features", "_fold"), "folds")
    names = F.concat(F.array(F.lit("all")), fold_models("_fold", cfg.cv_folds))
    layout = lay_out_shared(folded, F.transform(names, lambda n: _member("", n)), spec.label, "features", size)
    fits = train(layout, epochs, cfg.random_state, scores=False)
    pooled = fits.filter("silo = 'all'").first()
    if pooled is None or pooled.params is None:
        raise ValueError("both classes are needed")
    own = folded.withColumn("silo", F.concat(F.lit("fold:"), F.col("_fold").cast("string"))).drop("_fold")
    scored = score_networks(own, fits.filter("silo <> 'all'"), "silo", size)
    keys = ["strategy", "round", "silo", "n"]
    scored = ranking_metrics(scored, ["silo"], spec.label).select(
        F.lit(STRATEGIES[1]).alias("strategy"), F.lit(1).alias("round"), "silo", "n",
        F.round("auroc", 4).alias("local_auroc"), F.round("ap", 4).alias("local_ap"),
    )
    cv = scored.groupBy("strategy", "round").agg(
        F.avg("local_auroc").alias("cv_auroc"), F.stddev_pop("local_auroc").alias("cv_std"), F.sum("n").alias("n")
    ).withColumn("silo", F.lit(None).cast("string"))
    both = scored.unpivot(keys, ["local_auroc", "local_ap"], "metric", "value").unionByName(
        cv.unpivot(keys, ["cv_auroc", "cv_std"], "metric", "value")
    )
    return np.array(pooled.params), both.select("strategy", "round", "silo", "metric", F.round("value", 4).alias("value"), "n")


def _nobody_passed(prepared: Prepared, passed: bool) -> DataFrame:
    """Zeros for the gated strategy when no hospital took part."""
    if passed:
        return local_table(prepared.train.sparkSession, [], METRICS)
    zero = prepared.test.agg(F.count(F.lit(1)).alias("n")).withColumns({m: F.lit(0.0) for m in (*GLOBAL_METRICS, "participants")})
    long = zero.unpivot(["n"], [*GLOBAL_METRICS, "participants"], "metric", "value")
    return long.select(
        F.lit(STRATEGIES[3]).alias("strategy"), F.lit(1).alias("round"), F.lit(None).cast("string").alias("silo"),
        "metric", "value", "n",
    )
