import uuid

import numpy as np
import pytest
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from silo_analytics import DatasetSpec, RunConfig
from silo_analytics.operators import clustering, neural
from silo_analytics.operators.metrics import ranking_metrics
from silo_analytics.plans import clusters, orchestrate
from silo_analytics.plans.regional import compare_regions
from silo_analytics.plans.strategies import run_linear, run_mlp
from silo_analytics.scratch import materialize

SPEC = DatasetSpec(name="toy", features=("x", "y", "z"), label="label", key="id", augment=True)


@pytest.fixture(scope="module")
def cohort(spark):
    rng = np.random.default_rng(5)
    rows = []
    for i in range(800):
        x, y, z = map(float, rng.normal(size=3))
        region = ["North", "South", "East", None][int(rng.integers(4))] if i % 3 else "North"
        hospital = int(rng.integers(12)) if i % 40 else None
        rows.append((i, int(x + 0.5 * y + rng.normal() > 0.5), region, hospital, x, None if i % 9 == 0 else y, z))
    schema = "id long, label int, region string, hospitalid int, x double, y double, z double"
    return spark.createDataFrame(rows, schema)


def config(**changes):
    base = {"strategies": (1, 2, 3, 4, 5), "n_bootstrap": 30, "min_hospital_stays": 55, "augment_target_per_hosp": 40}
    return RunConfig(**{**base, **changes})


@pytest.fixture(scope="module")
def result(cohort):
    return orchestrate.run(cohort, SPEC, config(), compare=True)


def params(results):
    return {(r.strategy, r.round): np.array(r.params) for r in results.params.collect()}


def test_split_and_training_table(result):
    train, test = result.prepared.train, result.prepared.test
    assert test.count() == 160 and test.filter("is_synthetic").count() == 0
    assert train.filter("NOT is_synthetic").count() == 640
    assert train.join(test, "id", "left_semi").count() == 0
    assert train.filter("NOT is_synthetic AND hospitalid IS NULL").count() > 0
    sizes = [r["count"] for r in train.filter("hospitalid IS NOT NULL").groupBy("hospitalid").count().collect()]
    assert min(sizes) >= 40
    real = train.filter("NOT is_synthetic").select(*[F.col("features")[i].alias(f"f{i}") for i in range(3)]).toPandas()
    assert np.allclose(real.mean(), 0, atol=1e-9) and np.allclose(real.std(ddof=0), 1, atol=1e-9)


def test_strategies(result):
    found = params(result.results)
    for name in ("fedavg_region", "label_skew", "gated_hospital"):
        assert np.array_equal(found[name, 1], found[name, 3])
    assert not np.array_equal(found["fedprox_region", 1], found["fedprox_region", 3])
    local = {r.model: r for r in result.results.local_params.collect()}
    regions = [r for m, r in local.items() if m.startswith("region:") and not r.skipped]
    assert {r.model for r in regions} == {"region:North", "region:South", "region:East", "region:Unknown"}
    mean = np.average([r.params for r in regions], axis=0, weights=[r.n for r in regions])
    assert np.allclose(found["fedavg_region", 1], mean)
    # intercepts are not pulled
    assert found["fedprox_region", 1][-1] == pytest.approx(mean[-1])
    mu, start = 0.01, found["pooled", 1]
    assert np.allclose(found["fedprox_region", 1][:3], (1 - mu) * mean[:3] + mu * start[:3])


def test_metrics_and_summary(result):
    rows = {r.strategy: r for r in result.summary.collect()}
    assert set(rows) == {"pooled", "fedavg_region", "gated_hospital", "fedprox_region", "label_skew"}
    assert all(0.6 < r.global_auroc <= 1 and r.auroc_ci_lo <= r.global_auroc <= r.auroc_ci_hi for r in rows.values())
    assert 0.6 < rows["pooled"].cv_auroc < 1
    assert rows["fedavg_region"].participants == 4 and rows["fedprox_region"].local_weighted_auroc > 0.6
    gate = result.results.gate.collect()
    assert len(gate) == 12
    gated = rows["gated_hospital"]
    assert gated.screened_in + gated.screened_out + gated.skipped_too_small == 12
    assert gated.screened_in == sum(r.status == "in" for r in gate) > 0
    assert gated.skipped_too_small == sum(r.n < 55 for r in gate) > 0
    assert set(result.results.importances) == set(rows)
    assert all(len(v) == 3 for v in result.results.importances.values())


def test_regional_comparison(result):
    c = result.comparison
    rows = {r.region: r for r in c.regions.collect()}
    assert set(rows) == {"North", "South", "East", "Unknown"}
    assert all(r.passed for r in c.checks.collect()) and c.checks.count() == 5
    for r in rows.values():
        scores = [v for v in (r.e2_auroc, r.e3_auroc, r.e4_auroc, r.e5_auroc) if v is not None]
        assert r.best_auroc == max(scores)
        assert r.e3_auroc_uplift == pytest.approx(r.e3_auroc - r.e2_auroc, abs=1e-9)
        assert r.e6_equivalent
    assert c.verdict.first().verdict == "EQUIVALENT"
    assert c.unified.first().n_test == 160


def test_gate_that_nobody_passes(result):
    strict = orchestrate.Prepared(result.prepared.train, result.prepared.test, SPEC, config(auroc_gate=1.01))
    out = run_linear(strict, (3,))
    assert out.params.count() == 0
    reasons = {r.status for r in out.gate.collect()}
    assert "in" not in reasons and any(s.endswith("<1.01") for s in reasons)


def test_special_values_of_mu(result):
    def last(**changes):
        p = result.prepared
        out = run_linear(orchestrate.Prepared(p.train, p.test, SPEC, config(fl_rounds=2, **changes)), (2, 4))
        return params(out)

    none = last(fedprox_mu=0.0)
    assert np.allclose(none["fedprox_region", 2], none["fedavg_region", 2])
    frozen = last(fedprox_mu=1.0)
    assert np.allclose(frozen["fedprox_region", 2][:3], 0.0)
    proximal = last(fedprox_mu=1e6, prox_mode="proximal")
    assert np.allclose(proximal["fedprox_region", 2], 0.0, atol=1e-2)


def test_one_silo_equals_pooled(result):
    p = result.prepared
    single = orchestrate.Prepared(p.train.withColumn("region", F.lit("all")), p.test, SPEC, config())
    found = params(run_linear(single, (1, 2)))
    assert np.allclose(found["pooled", 1], found["fedavg_region", 1], atol=1e-9)


def test_holdout_from_the_global_test_rows(result):
    p = orchestrate.Prepared(result.prepared.train, result.prepared.test, SPEC, config(holdout="global"))
    c = compare_regions(p, [0.1, 0.2, 0.3, 0.0], None)
    rows = c.regions.collect()
    assert sum(r.n_test for r in rows) == 160 and all(r.e4_auroc is None for r in rows)


def test_region_names_with_separators(result):
    name = F.concat(F.when(F.col("region") == "North", F.lit("a")).otherwise(F.lit("b:c")), F.lit("|x|y:z"))
    p = result.prepared
    named = orchestrate.Prepared(p.train.withColumn("region", name), p.test.withColumn("region", name), SPEC, config())
    rows = {r.region: r for r in compare_regions(named, [0.1, 0.2, 0.3, 0.0], [0.2, 0.1, 0.3, 0.0]).regions.collect()}
    assert set(rows) == {"a|x|y:z", "b:c|x|y:z", "Unknown"} - ({"Unknown"} - set(rows))
    assert rows["a|x|y:z"].e2_auroc != rows["b:c|x|y:z"].e2_auroc
    silos = run_linear(named, (2,)).metrics.filter("metric = 'local_auroc' AND round = 1").collect()
    assert {r.silo for r in silos} == set(rows)


def test_rows_without_a_label_are_refused(cohort):
    with pytest.raises(ValueError, match="20 rows"):
        orchestrate.prepare(cohort.withColumn("label", F.when(F.col("id") >= 20, F.col("label"))), SPEC, config())


def test_ids_follow_the_content(cohort):
    rows = cohort.drop("id")
    rows = rows.unionByName(rows.limit(30))
    first = sorted(map(str, orchestrate.with_row_ids(rows, "k").collect()))
    again = sorted(map(str, orchestrate.with_row_ids(rows.repartition(7), "k").collect()))
    assert first == again and len(first) == 830
    assert orchestrate.with_row_ids(rows, "k").select("k").distinct().count() == 830


def test_a_saved_run_replaces_itself(spark, tmp_path):
    from silo_analytics.operators.store import load_metrics, save_metrics

    def rows(value):
        return spark.createDataFrame([("s", 1, None, "m", value, 5, "r1")], "strategy string, round int, silo string, metric string, value double, n long, run_id string")

    path = str(tmp_path / "k")
    save_metrics(rows(1.0), path)
    save_metrics(rows(9.0).withColumn("run_id", F.lit("r2")), path)
    save_metrics(rows(2.0), path)
    assert sorted(r.value for r in load_metrics(spark, path).collect()) == [2.0, 9.0]


def test_models_are_stored(cohort, spark, tmp_path):
    from silo_analytics.operators.store import list_models, load_metrics

    cfg = config(strategies=(2,), augment_data=False)
    run = orchestrate.run(cohort, SPEC, cfg, "r7", str(tmp_path / "m"), str(tmp_path / "k"))
    row = list_models(spark, str(tmp_path / "m")).first()
    assert (row.run_id, row.tag) == ("r7", "fedavg_region") and row.metrics["global_auroc"] > 0.6
    assert load_metrics(spark, str(tmp_path / "k"), "r7").count() > 0
    assert run.prepared.train.filter("is_synthetic").count() == 0


def test_table_without_key(cohort):
    spec = DatasetSpec(name="toy", features=("x", "z"), label="label", key="row_id", strategies=(1, 2))
    prepared, _ = orchestrate.prepare(cohort.drop("id"), spec, config())
    assert prepared.train.count() == 640 and prepared.train.select("row_id").distinct().count() == 640


def test_clusters(spark):
    rows = [(h, int(i < rate), beds) for h, rate, beds in ((1, 1, 0), (2, 2, 0), (3, 8, 3), (4, 9, 3), (5, 5, 9)) for i in range(10)]
    df = spark.createDataFrame([*rows, (None, 1, None)], "h int, label int, beds int")
    got = clustering.cluster_hospitals(df, "h", "label", ["beds"], k=3, restarts=4)
    assert {r.h: r.hospital_cluster for r in got.collect()} == {1: 1, 2: 1, 5: 2, 3: 3, 4: 3}
    back = clustering.assign_clusters(df, got, "h")
    assert back.count() == 51 and back.filter("hospital_cluster IS NULL").count() == 1


def test_clusters_cost_no_more_than_the_best_of_single_fits(spark):
    draw = np.random.default_rng(8)
    x = np.concatenate([draw.normal(m, 1.0, (60, 2)) for m in (0, 2, 4, 7)])
    points = materialize(spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "key long, x array<double>").repartition(5), "points")
    centres, jobs = _jobs(spark, lambda: clustering.best_centres(points, 4, 20, 1))
    cost = ((x[:, None] - centres[None]) ** 2).sum(axis=2).min(axis=1).sum()
    vectors = points.select(array_to_vector("x").alias("features"))
    single = min(KMeans(k=4, seed=s, maxIter=100).fit(vectors).summary.trainingCost for s in range(5))
    assert cost <= single * 1.0001 and jobs < 250
    same = clustering.best_centres(materialize(spark.createDataFrame([(1, [2.0])] * 3, "key long, x array<double>"), "points"), 3, 2, 1)
    assert (same == 2.0).all()


def test_perceptron(result):
    p = result.prepared
    w = neural.fit_mlp(p.train, "label", "features", 3, epochs=60)
    assert len(w) == neural.weight_count(3)
    scores = neural.score_mlp(p.test, w, 3).select("label", "score").toPandas()
    assert scores.score.between(0, 1).all() and scores[scores.label == 1].score.mean() > scores[scores.label == 0].score.mean() + 0.1
    rows = p.train.filter("region IS NOT NULL")
    rounds, fits = neural.federated_rounds(rows, "region", "label", "features", 3, rounds=2, epochs=3, start=w)
    assert len(rounds) == 2 and rounds[0].shape == w.shape and not np.allclose(rounds[0], w)
    first = fits[0].collect()
    assert {r.silo for r in first} == {"North", "South", "East"}
    assert np.allclose(rounds[0], neural.average_weights([np.array(r.params) for r in first], [r.n for r in first]))
    own = neural.score_mlp(rows.filter("region = 'North'"), [r for r in first if r.silo == "North"][0].params, 3)
    exact = ranking_metrics(own.withColumn("g", F.lit(1)), ["g"]).first()
    north = [r for r in first if r.silo == "North"][0]
    assert (north.auroc, north.ap) == (pytest.approx(exact.auroc), pytest.approx(exact.ap))
    with pytest.raises(ValueError):
        neural.average_weights([], [])


def test_slope_of_the_loss():
    draw = np.random.default_rng(1)
    x, y, w = draw.normal(size=(40, 3)), draw.integers(0, 2, 40), neural.initial_weights(3, 0)
    slope = neural.loss_and_slope(w, x, y)[1]
    for k in draw.integers(0, len(w), 20):
        step = np.zeros(len(w))
        step[k] = 1e-6
        numeric = (neural.loss_and_slope(w + step, x, y)[0] - neural.loss_and_slope(w - step, x, y)[0]) / 2e-6
        assert slope[k] == pytest.approx(numeric, abs=1e-6)


def test_perceptrons_of_many_silos_and_of_large_ones(spark, result):
    rows = spark.range(3000).select(
        (F.col("id") % 300).alias("silo"), (F.col("id") % 7 < 3).cast("int").alias("label"),
        F.array((F.col("id") % 7).cast("double"), F.lit(1.0)).alias("features"),
    ).unionByName(spark.createDataFrame([(999, 1, [1.0, 1.0]), (None, 0, [0.0, 0.0])], "silo long, label int, features array<double>"))
    fits = {r.silo: r for r in neural.fit_silos(rows, "silo", "label", "features", 2, epochs=5).collect()}
    assert len(fits) == 301 and fits["999"].params is None and fits["5"].n == 10
    train = result.prepared.train.filter("region IS NOT NULL")
    sizes = {r.region: r["count"] for r in train.groupBy("region").count().collect()}
    bound = 3 * (max(sizes.values()) - 1)
    mixed = {r.silo: r for r in neural.fit_silos(train, "region", "label", "features", 3, epochs=20, local_values=bound).collect()}
    assert set(mixed) == set(sizes) and all(r.auroc > 0.6 for r in mixed.values())


def _jobs(spark, run):
    """The result of a function and how many Spark jobs it started."""
    group = uuid.uuid4().hex
    spark.sparkContext.setJobGroup(group, group)
    try:
        return run(), len(spark.sparkContext.statusTracker().getJobIdsForGroup(group))
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)


def test_a_thousand_silos_take_the_jobs_of_ten(spark, monkeypatch):
    def silos(n):
        return spark.range(12 * n).select(
            (F.col("id") % n).cast("string").alias("silo"), (F.col("id") % 12 < 5).cast("int").alias("label"),
            F.array((F.col("id") % 5).cast("double"), ((F.col("id") * 7) % 11).cast("double")).alias("features"),
        )

    def fits(n):
        return {r.silo: r for r in neural.fit_silos(silos(n), "silo", "label", "features", 2, epochs=3).collect()}

    monkeypatch.setattr(neural, "HIDDEN", (3, 2))
    held = fits(10)
    monkeypatch.setattr(neural, "MODELS_PER_FIT", 4)
    (ten, few), (many, same) = _jobs(spark, lambda: fits(10)), _jobs(spark, lambda: fits(1000))
    assert len(many) == 1000 and all(r.params is not None for r in many.values()) and abs(few - same) <= 3
    for silo, r in held.items():
        assert np.allclose(r.params, ten[silo].params) and r.auroc == pytest.approx(ten[silo].auroc)


def test_blocks_of_large_and_small_silos_are_dealt_evenly(spark, monkeypatch):
    monkeypatch.setattr(neural, "BLOCK_VALUES", 40)
    monkeypatch.setattr(neural, "ROWS_PER_TASK", 300)
    silo = F.when(F.col("id") < 2400, F.lit("large")).otherwise((F.col("id") % 20).cast("string"))
    rows = spark.range(3000).select(
        silo.alias("silo"), (F.col("id") % 7 < 3).cast("int").alias("label"), F.array(F.col("id").cast("double"), F.lit(1.0)).alias("features")
    )
    layout = neural.lay_out(rows, "silo", "label", "features", 2, local_values=2_000)
    dealt = neural._dealt(layout, layout.sizes.select("grp", "silo"), 3000)
    tasks = dealt.mapPartitions(lambda blocks: [[(key[1], len(x)) for key, (x, _, _) in blocks]]).collect()
    counts = [sum(n for _, n in task) for task in tasks]
    assert sum(counts) == 3000 and len(tasks) == 10 and max(counts) <= 1.5 * 300
    assert sum(len({silo for silo, _ in task}) for task in tasks) <= 21 + len(tasks)
    dealt.unpersist()
    fits = neural.train(layout, {"": 3}, scores=False).collect()
    assert len(fits) == 21 and all(len(r.params) == neural.weight_count(2) for r in fits)


def test_rows_of_several_silos_are_laid_out_and_sent_once(spark, monkeypatch):
    monkeypatch.setattr(neural, "BLOCK_VALUES", 400)
    rows = spark.range(1200).select(
        (F.col("id") % 7 < 3).cast("int").alias("label"), F.array((F.col("id") % 601).cast("double") / 300, F.lit(1.0)).alias("features"),
        F.array(
            F.struct(F.lit("a").alias("grp"), F.when(F.col("id") % 5 > 0, F.concat(F.lit('x"|,'), F.col("id") % 5)).alias("silo")),
            F.struct(F.lit("b").alias("grp"), (F.col("id") % 3).cast("string").alias("silo")),
        ).alias("silos"),
    )
    single = rows.select("label", "features", F.explode("silos").alias("m")).select("m.grp", "m.silo", "label", "features")
    apart = neural.train(neural.lay_out(single, "silo", "label", "features", 2, group="grp"), {"a": 4, "b": 2}).collect()
    layout = neural.lay_out_shared(rows, F.col("silos"), "label", "features", 2)
    assert layout.blocks.agg(F.sum("n")).first()[0] == 1200 and layout.silos == 7  # 2,160 if written once per silo
    found = {(r.grp, r.silo): r for r in neural.train(layout, {"a": 4, "b": 2}).collect()}
    only = layout.only(layout.sizes.filter("grp = 'b'").select("grp", "silo"))
    assert {r.grp for r in neural.train(only, {"b": 2}, scores=False).collect()} == {"b"}
    monkeypatch.setattr(neural, "MODELS_PER_FIT", 4)
    many = neural.lay_out_shared(rows, F.col("silos"), "label", "features", 2)
    assert not many.shared and many.silos == 7 and len(apart) == len(found) == 7
    for r in apart:
        got = found[r.grp, r.silo]
        assert np.allclose(r.params, got.params) and (r.n, r.n_pos, r.auroc) == (got.n, got.n_pos, pytest.approx(got.auroc))


def test_rows_scored_by_the_network_of_their_key(spark):
    draw = np.random.default_rng(3)
    weights = {k: draw.normal(size=neural.weight_count(2)) for k in ("a", "b|c")}
    rows = [(k, i, draw.normal(size=2).tolist()) for i in range(50) for k in ("a", "b|c", "none", None)]
    df = spark.createDataFrame(rows, "name string, id int, features array<double>")
    nets = spark.createDataFrame([(k, w.tolist()) for k, w in weights.items()] + [("none", None)], "name string, params array<double>")
    got = {(r.name, r.id): r.score for r in neural.score_networks(df, nets, "name", 2).collect()}
    assert len(got) == 100
    for name, i, x in rows:
        if name in weights:
            assert got[name, i] == pytest.approx(neural._forward(weights[name], np.array([x]))[1][0])


def test_perceptrons_are_compared_by_region(result, monkeypatch):
    monkeypatch.setattr(neural, "ROUND_EPOCHS", 8)
    monkeypatch.setattr(neural, "POOLED_EPOCHS", 20)
    p = result.prepared
    own = orchestrate.Prepared(p.train, p.test, SPEC, config(algorithm="mlp", fl_rounds=1))
    found = run_mlp(own, (1, 2), 20, 8).params.collect()
    last = {r.strategy: list(r.params) for r in found}
    out = compare_regions(own, last["pooled"], last["fedavg_region"])
    linear = result.comparison.regions
    assert out.regions.columns == linear.columns
    same = ["region", "n_test", "pos_pct", "small_warn"]
    assert sorted(out.regions.select(same).collect()) == sorted(linear.select(same).collect())
    assert all(r.passed for r in out.checks.collect()) and out.unified.count() == 1


def test_perceptrons_are_the_same_in_one_part_and_in_many(result):
    train = result.prepared.train.filter("region IS NOT NULL")
    one, many = (
        {r.silo: r for r in neural.fit_silos(train, "region", "label", "features", 3, epochs=20, local_values=v).collect()}
        for v in (1_000_000, 60)
    )
    assert set(one) == set(many) and len(one) == 3
    for silo, r in one.items():
        assert np.allclose(r.params, many[silo].params, rtol=1e-4, atol=1e-6)
        assert (r.n, r.auroc) == (many[silo].n, pytest.approx(many[silo].auroc, abs=1e-6))
    whole, parts = (neural.fit_mlp(train, "label", "features", 3, epochs=20, local_values=v) for v in (1_000_000, 60))
    assert np.allclose(whole, parts, rtol=1e-4, atol=1e-6)


def test_perceptron_strategies_report_like_the_linear_ones(result):
    p = result.prepared
    cfg = config(algorithm="mlp", fl_rounds=1)
    out = run_mlp(orchestrate.Prepared(p.train, p.test, SPEC, cfg), (1, 2, 3, 4, 5), 30, 10)
    names = {(r.strategy, r.metric) for r in out.metrics.filter("silo IS NULL").collect()}
    linear = {(r.strategy, r.metric) for r in result.results.metrics.filter("silo IS NULL").collect()}
    assert names == linear
    assert out.gate.count() == 12 and out.params.count() == 5
    silos = out.metrics.filter("strategy = 'fedavg_region' AND metric = 'local_auroc'").collect()
    assert {r.silo for r in silos} == {"North", "South", "East", "Unknown"}


def test_perceptron_gate_that_nobody_passes(result):
    p = result.prepared
    strict = orchestrate.Prepared(p.train, p.test, SPEC, config(auroc_gate=1.01, algorithm="mlp", fl_rounds=1))
    out = run_mlp(strict, (3,), 5, 2)
    zero = out.metrics.filter("metric = 'global_auroc'").collect()
    assert out.params.count() == 0 and [(r.strategy, r.value, r.n) for r in zero] == [("gated_hospital", 0.0, 160)]


def test_spec_and_config():
    with pytest.raises(ValueError):
        DatasetSpec(name="e", features=())
    for bad in ({"fl_rounds": 21}, {"cv_folds": 1}, {"global_test_size": 1.0}, {"strategies": (9,)}, {"algorithm": "svm"}):
        with pytest.raises(ValueError):
            RunConfig(**bad)
    cfg = RunConfig.from_dict({"augment_data": "false", "random_state": "3", "strategies": ["1", 2], "unknown": 1})
    assert (cfg.augment_data, cfg.random_state, cfg.strategies) == (False, 3, (1, 2))


def hospital_table(spark):
    return spark.createDataFrame([(i, float(i % 3 * 10), i % 2) for i in range(12)], "hospitalid int, beds double, teaching int")


def test_cluster_strategy(spark, result):
    prepared = result.prepared
    found = clusters.run_clusters(prepared, hospital_table(spark), ["beds", "teaching"])
    groups = {r.hospitalid: r.hospital_cluster for r in found.clusters.collect()}
    # Beds are far apart and not scaled, so they alone decide.
    assert len(groups) == 12 and all((groups[a] == groups[b]) == (a % 3 == b % 3) for a in groups for b in groups)
    rows = [r for r in prepared.train.select("hospitalid", "label", "features").collect() if r.hospitalid is not None]
    fits = {r.model: r for r in found.local_params.collect()}
    assert sum(r.n for r in fits.values()) == len(rows)
    mean = sum(np.array(r.params) * r.n for r in fits.values()) / len(rows)
    got = {r.round: r.params for r in found.params.collect()}
    assert set(got) == {1, 2, 3} and all(np.allclose(w, mean, atol=1e-9) for w in got.values())
    values = {(r.round, r.silo, r.metric): r.value for r in found.metrics.collect()}
    for number in (1, 2, 3):
        own = {m: values[number, m.split(":")[1], "local_auroc"] for m in fits}
        weighted = sum(own[m] * fits[m].n for m in fits) / len(rows)
        assert values[number, None, "local_weighted_auroc"] == pytest.approx(weighted, abs=1e-4)
        assert values[number, None, "participants"] == 3 and 0 < values[number, None, "global_auroc"] < 1
    assert values[1, None, "n_pos"] == sum(r.label for r in rows)


def test_clusters_join_a_run_and_are_stored(spark, cohort, tmp_path):
    cfg = config(strategies=(1,), n_bootstrap=5)
    paths = {f"{n}_path": str(tmp_path / n) for n in ("models", "metrics", "clusters")}
    done = orchestrate.run(cohort, SPEC, cfg, run_id="r", hospitals=hospital_table(spark).filter("hospitalid < 6"), hospital_columns=["beds"], **paths)
    assert {r.strategy for r in done.summary.collect()} == {"pooled", "cluster_fedavg"}
    stored = spark.read.parquet(paths["clusters_path"])
    assert stored.count() == 12 and stored.filter("beds IS NULL").count() == 6 and {r.run_id for r in stored.collect()} == {"r"}
    assert {r.tag for r in spark.read.parquet(paths["models_path"]).collect()} == {"pooled", "cluster_fedavg"}
    with pytest.raises(ValueError):
        orchestrate.run(cohort, SPEC, config(algorithm="mlp"), hospitals=hospital_table(spark))


def test_a_cluster_of_one_class_takes_no_part(spark, result):
    prepared = result.prepared
    alone = prepared.train.withColumn("label", F.when(F.col("hospitalid") == 3, 1).otherwise(F.col("label")))
    beds = spark.createDataFrame([(i, 1000.0 if i == 3 else float(i % 2)) for i in range(12)], "hospitalid int, beds double")
    one = orchestrate.Prepared(materialize(alone, "one-class"), prepared.test, prepared.spec, prepared.cfg)
    found = clusters.run_clusters(one, beds, ["beds"])
    lone = found.local_params.filter("skipped").collect()
    assert len(lone) == 1 and lone[0].n == lone[0].n_pos
    silo = lone[0].model.split(":")[1]
    assert {r.value for r in found.metrics.filter(F.col("silo") == silo).collect()} == {0.0}
    assert {r.value for r in found.metrics.filter("metric = 'participants'").collect()} == {2.0}
