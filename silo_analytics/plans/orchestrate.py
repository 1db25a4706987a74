"""From a cohort table to metrics: split, fill up, scale, train, evaluate, compare."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.augment import augment_groups
from ..operators.logistic import balanced_training_table
from ..operators.prep import FittedPrep, fit_prep
from ..operators.sampling import stratified_split
from ..operators.store import MODEL_SCHEMA, config_column, save_clusters, save_metrics, save_models, summarize
from ..scratch import join_lookup, materialize, null_safe_join, quoted
from ..spec import DatasetSpec, RunConfig
from .clusters import ClusterResults, run_clusters
from .regional import RegionalComparison, compare_regions
from .strategies import GLOBAL_METRICS, Prepared, StrategyResults, run_linear, run_mlp

SUMMARY = (
    "n_pos", "rate_pct", "cv_auroc", "cv_std", *GLOBAL_METRICS, "local_weighted_auroc", "participants",
    "screened_in", "screened_out", "skipped_too_small",
)


@dataclass
class RunResult:
    run_id: str
    summary: DataFrame
    results: StrategyResults
    comparison: RegionalComparison | None
    prepared: Prepared
    prep: FittedPrep
    clusters: ClusterResults | None = None


def with_row_ids(df: DataFrame, key: str) -> DataFrame:
    """Give the rows of a table without a key ids that follow from their content.

    The id is a hash of all columns.  Rows that agree in a hash, copies mostly, are told apart
    by their number among them, so any file split or order of the rows gives the same ids.
    """
    content = F.xxhash64(*[F.col(quoted(c)) for c in sorted(df.columns)])
    rows = materialize(df.withColumn(key, content), "numbered")
    twice = rows.groupBy(key).agg(F.count(F.lit(1)).alias("_n")).filter("_n > 1")
    twice = materialize(twice, "copies")
    single = null_safe_join(rows, twice, [key], "left").filter("_n IS NULL").drop("_n")
    copies = join_lookup(rows, twice.select(key), [key], "left_semi")
    # equal rows are interchangeable, so one row per distinct content is counted out again
    counted = copies.groupBy(*[F.col(quoted(c)) for c in copies.columns]).agg(F.count(F.lit(1)).cast("int").alias("_n"))
    numbered = counted.withColumn("_i", F.explode(F.sequence(F.lit(1), F.col("_n"))))
    numbered = numbered.withColumn(key, F.xxhash64(key, "_i", *[F.col(quoted(c)) for c in sorted(df.columns)]))
    return materialize(single.unionByName(numbered.select(*single.columns)), "numbered")


def prepare(
    cohort: DataFrame,
    spec: DatasetSpec,
    cfg: RunConfig,
    recompute: Callable[[DataFrame], DataFrame] | None = None,
) -> tuple[Prepared, FittedPrep]:
    """Split off the test rows, fit the scaling on real training rows, fill up small hospitals.

    Test rows are real and are never used to fit or to fill up.
    """
    if spec.key not in cohort.columns:
        cohort = with_row_ids(cohort, spec.key)
    else:
        cohort = materialize(cohort, "cohort")
    unlabelled = cohort.filter(~F.coalesce(F.col(spec.label).isin(0, 1), F.lit(False))).count()
    if unlabelled:
        raise ValueError(f"{unlabelled} rows have a {spec.label} that is not 0 or 1")
    marked = materialize(
        stratified_split(cohort, spec.label, spec.key, cfg.global_test_size, cfg.random_state), "split"
    )
    test, real = marked.filter("is_test").drop("is_test"), marked.filter(~F.col("is_test")).drop("is_test")
    prep = fit_prep(real, spec.features)
    if cfg.augment_data and spec.augment:
        train = augment_groups(
            real, spec.hospital, spec.key, spec.jitter_columns, cfg.augment_target_per_hosp,
            cfg.random_state, subject=spec.subject, recompute=recompute,
        )
    else:
        train = real.withColumn("is_synthetic", F.lit(False))
    kept = list(dict.fromkeys([spec.key, spec.label, spec.region, spec.hospital, "is_synthetic", "features"]))
    table = balanced_training_table(prep.transform(train).select(*kept), spec.hospital, spec.key, real)
    tested = prep.transform(test.withColumn("is_synthetic", F.lit(False))).select(*kept)
    return Prepared(table, materialize(tested, "test"), spec, cfg), prep


def run(
    cohort: DataFrame,
    spec: DatasetSpec,
    cfg: RunConfig | None = None,
    run_id: str | None = None,
    models_path: str | None = None,
    metrics_path: str | None = None,
    compare: bool = False,
    hospitals: DataFrame | None = None,
    hospital_columns: Sequence[str] = (),
    clusters_path: str | None = None,
) -> RunResult:
    """Run the strategies that both the dataset and the configuration allow.

    With ``hospitals`` (a row per hospital) the averaging over clusters of hospitals runs too; its metrics and
    parameters join the others', and the clustering is stored at ``clusters_path``.
    """
    cfg = cfg or RunConfig()
    run_id = run_id or uuid.uuid4().hex[:8]
    strategies = [s for s in sorted(set(cfg.strategies)) if s in spec.strategies]
    if not strategies:
        raise ValueError("none of the configured strategies suits the dataset")
    prepared, prep = prepare(cohort, spec, cfg)
    linear = cfg.algorithm == "logistic_regression"
    if hospitals is not None and not linear:
        raise ValueError("clusters of hospitals are averaged for logistic models only")
    results = run_linear(prepared, strategies) if linear else run_mlp(prepared, strategies)

    comparison = None
    if compare:
        last = {r.strategy: list(r.params) for r in results.params.orderBy("round").collect()}
        comparison = compare_regions(
            prepared, last.get("pooled"), last.get("fedavg_region", last.get("fedprox_region"))
        )
    clusters = None
    if hospitals is not None:
        first = results.params.filter((F.col("strategy") == "pooled")).first()
        clusters = run_clusters(prepared, hospitals, hospital_columns, first.params if first else None)
        results.metrics = results.metrics.unionByName(clusters.metrics)
        results.params = results.params.unionByName(clusters.params)
        if clusters_path:
            save_clusters(clusters.clusters.withColumn("run_id", F.lit(run_id)), clusters_path)
    whole = results.metrics.filter(F.col("silo").isNull())
    summary = summarize(whole, SUMMARY)
    if models_path:
        save_models(model_rows(results, cfg, run_id), models_path)
    if metrics_path:
        save_metrics(results.metrics.withColumn("run_id", F.lit(run_id)), metrics_path)
    return RunResult(run_id, summary, results, comparison, prepared, prep, clusters)


def model_rows(results: StrategyResults, cfg: RunConfig, run_id: str) -> DataFrame:
    """The final global model of every strategy with its metrics, as rows of the model table."""
    final = results.params.groupBy("strategy").agg(F.max_by("params", "round").alias("params"))
    held_out = results.metrics.filter(F.col("silo").isNull() & F.col("metric").isin(*GLOBAL_METRICS))
    last = held_out.groupBy("strategy", "metric").agg(F.max_by("value", "round").alias("value"))
    maps = last.groupBy("strategy").agg(
        F.map_from_entries(F.collect_list(F.struct("metric", "value"))).alias("metrics")
    )
    return final.join(maps, "strategy", "left").select(
        F.col("strategy").alias("tag"), F.current_timestamp().alias("ts"), F.lit(cfg.algorithm).alias("kind"),
        "params", "metrics", config_column(cfg.to_dict()).alias("config"), F.lit(run_id).alias("run_id"),
    ).select(*MODEL_SCHEMA.names)
