import numpy as np
import pytest
from pyspark.sql import functions as F

from silo_analytics.functions.vectors import dense
from silo_analytics.operators import logistic as L


def solve(x, y, c=0.01, mu=0.0, anchor=None):
    """Plain Newton on the balanced ridge objective."""
    x = np.column_stack([x, np.ones(len(x))])
    s = np.where(y == 1, len(y) / (2 * y.sum()), len(y) / (2 * (len(y) - y.sum())))
    ridge = np.append(np.ones(x.shape[1] - 1), 0.0)
    w = np.zeros(x.shape[1])
    for _ in range(60):
        p = 1 / (1 + np.exp(-x @ w))
        g = c * x.T @ (s * (p - y)) + ridge * w
        h = c * (x * (s * p * (1 - p))[:, None]).T @ x + np.diag(ridge)
        if mu:
            g, h = g + mu * (w - anchor), h + mu * np.eye(len(w))
        w = w - np.linalg.solve(h, g)
    return w


@pytest.fixture(scope="module")
def data(spark):
    rng = np.random.default_rng(0)
    n = 900
    x = rng.normal(size=(n, 3))
    y = (x[:, 0] - 0.5 * x[:, 1] + rng.normal(size=n) > 0.4).astype(int)
    silo = np.where(np.arange(n) % 3 == 0, 0, np.arange(n) % 7)
    rows = [(i, int(silo[i]), int(y[i]), x[i].tolist()) for i in range(n)]
    df = spark.createDataFrame(rows, "id long, silo int, label int, features array<double>").cache()
    return df, x, y, silo


def by_model(df):
    return {r.model: r for r in df.collect()}


def test_every_silo_matches_its_own_solution(data):
    df, x, y, silo = data
    got = by_model(L.fit_grouped(df.repartition(5), F.array(F.col("silo").cast("string")), tol=1e-9))
    assert len(got) == 7
    for s in range(7):
        mine = silo == s
        assert got[str(s)].n == mine.sum() and got[str(s)].converged
        assert np.allclose(got[str(s)].params, solve(x[mine], y[mine]), atol=1e-8)


def test_pooled_matches_spark_trainer(data):
    df, x, y, _ = data
    grouped = by_model(L.fit_grouped(df, F.array(F.lit("pooled"))))["pooled"].params
    assert np.allclose(L.fit_pooled(df, "label", "features"), grouped, atol=1e-5)
    assert np.allclose(solve(x, y), grouped, atol=1e-6)


def test_memberships_overlap(data):
    df, x, y, silo = data
    folds = df.withColumn("fold", (F.col("id") % 3).cast("int"))
    names = F.concat(F.array(F.lit("pooled")), L.fold_models("fold", 3))
    got = by_model(L.fit_grouped(folds, names, tol=1e-9))
    keep = np.arange(len(y)) % 3 != 1
    assert np.allclose(got["fold:1"].params, solve(x[keep], y[keep]), atol=1e-8)
    assert np.allclose(got["pooled"].params, solve(x, y), atol=1e-8)


def test_result_does_not_depend_on_partitions_start_or_chunks(data, monkeypatch):
    df, *_ = data
    names = F.array(F.col("silo").cast("string"))
    want = by_model(L.fit_grouped(df, names, tol=1e-9))
    other = by_model(L.fit_grouped(df.repartition(16), names, tol=1e-9, init=[1.0, -1.0, 0.5, 0.1]))
    monkeypatch.setattr(L, "MODELS_PER_FIT", 4)
    chunked = by_model(L.fit_grouped(df, names, tol=1e-9))
    assert set(want) == set(other) == set(chunked)
    for m in want:
        assert np.allclose(want[m].params, other[m].params, atol=1e-8)
        assert np.allclose(want[m].params, chunked[m].params, atol=1e-8)


def test_small_and_one_class_silos_are_skipped(spark):
    rows = [("few", 1, [1.0]), ("few", 0, [0.0]), *[("one", 1, [float(i)]) for i in range(9)]]
    rows += [("fine", i % 2, [float(i)]) for i in range(9)]
    df = spark.createDataFrame(rows, "m string, label int, features array<double>")
    got = by_model(L.fit_grouped(df, F.array("m")))
    assert got["few"].skipped and got["one"].skipped and not got["fine"].skipped
    assert got["one"].params == [0.0, 0.0]
    with pytest.raises(ValueError):
        L.fit_grouped(df, F.array("m"), init=[0.0])


def test_separable_silo_stays_finite(spark):
    rows = [("a", int(i > 5), [float(i) * 1000]) for i in range(12)]
    df = spark.createDataFrame(rows, "m string, label int, features array<double>")
    got = L.fit_grouped(df, F.array("m")).first()
    assert np.all(np.isfinite(got.params)) and got.params[0] > 0


def test_proximal_objective(data):
    df, x, y, _ = data
    anchor = np.array([0.2, 0.1, -0.3, 0.5])
    got = L.fit_grouped(df, F.array(F.lit("m")), prox_mu=2.0, anchor=anchor, tol=1e-9).first().params
    assert np.allclose(got, solve(x, y, mu=2.0, anchor=anchor), atol=1e-8)


def test_class_weights(spark):
    df = spark.createDataFrame([("a", 1), ("a", 0), ("a", 0), ("b", 0)], "g string, label int")
    got = {r.g: (r.w1, r.w0) for r in L.class_weights(df, "g", "label").collect()}
    assert got == {"a": (1.5, 0.75), "b": (None, 0.5)}


def test_scoring(data):
    df, x, *_ = data
    params = {"a": [0.5, -1.0, 2.0, 0.1], "b": [0.0, 0.0, 0.0, 0.0]}
    got = {(r.id, r.model): r.score for r in L.score_models(df, params, 3).collect()}
    assert len(got) == 1800
    assert got[7, "a"] == pytest.approx(1 / (1 + np.exp(-(x[7] @ params["a"][:3] + 0.1))))
    assert got[7, "b"] == 0.5


@pytest.fixture(scope="module")
def wide_data(spark):
    rng = np.random.default_rng(4)
    n, d = 600, 1000
    x = np.where(rng.random((n, d)) < 0.05, rng.normal(size=(n, d)), 0.0)
    y = (x @ rng.normal(size=d) + rng.normal(size=n) > 0.3).astype(int)
    rows = [(i, i % 3, int(y[i]), x[i].tolist()) for i in range(n)]
    return spark.createDataFrame(rows, "id long, silo int, label int, features array<double>").repartition(6).cache(), x, y


def test_wide_models_reach_the_optimum_without_a_hessian(wide_data, monkeypatch):
    df, x, y = wide_data
    monkeypatch.setattr(L, "_sums", None)  # a Newton step would fail
    names = F.array(F.lit("pooled"), F.col("silo").cast("string"))
    got = by_model(L.fit_grouped(df, names, c=1.0))
    for model, mine in [("pooled", slice(None)), *((str(s), np.arange(len(y)) % 3 == s) for s in range(3))]:
        a, b, w = x[mine], y[mine], np.array(got[model].params)
        assert got[model].converged and got[model].n == len(b)
        s = np.where(b == 1, len(b) / (2 * b.sum()), len(b) / (2 * (len(b) - b.sum())))
        error = s * (1 / (1 + np.exp(-a @ w[:-1] - w[-1])) - b)
        assert np.abs(np.append(a.T @ error + w[:-1], error.sum())).max() < 1e-5
        assert np.allclose(w, solve(a, b, c=1.0), atol=1e-5)


def test_wide_and_newton_fits_agree(data, monkeypatch):
    df, *_ = data
    names = F.array(F.lit("pooled"), F.col("silo").cast("string"))
    anchor = [0.2, -0.1, 0.1, 0.05]
    want = by_model(L.fit_grouped(df, names, tol=1e-9, prox_mu=0.5, anchor=anchor))
    monkeypatch.setattr(L, "NEWTON_FEATURES", 2)
    got = by_model(L.fit_grouped(df, names, tol=1e-8, prox_mu=0.5, anchor=anchor))
    monkeypatch.setattr(L.wide, "PARAMETERS", 12)  # three models in a chain
    chained = by_model(L.fit_grouped(df, names, tol=1e-8, prox_mu=0.5, anchor=anchor, init=[1.0, -1.0, 0.5, 0.1]))
    assert set(got) == set(want) == set(chained)
    for m in want:
        assert np.allclose(got[m].params, want[m].params, atol=1e-7)
        assert np.allclose(chained[m].params, want[m].params, atol=1e-7)


def test_wide_rows_are_packed_once_and_add_up_to_the_dense_sums(spark, monkeypatch):
    monkeypatch.setattr(L.wide, "BLOCK_ROWS", 70)
    monkeypatch.setattr(L.wide, "ROWS_PER_TASK", 100)
    rng = np.random.default_rng(8)
    n, d = 400, 40
    x = np.where(rng.random((n, d)) < 0.05, rng.integers(1, 300, (n, d)), 0.0)
    x[::50], x[1::50] = 0.0, rng.normal(size=(8, d))  # rows without a value, and full ones
    y = rng.integers(0, 2, n)
    lists = [[["a"], ["a", "b"], ["b", "c"], []][i % 4] for i in range(n)]
    schema = "models array<string>, y double, x array<double>"
    rows = spark.createDataFrame([(m, float(b), v.tolist()) for m, b, v in zip(lists, y, x)], schema).repartition(3)
    dealt = L.wide._dealt(rows, d + 1, 400)
    blocks = dealt.collect()
    assert dealt.is_cached and dealt.getNumPartitions() == 4
    dealt.unpersist()
    assert sum(len(b[0]) for _, b in blocks) == 300 and max(len(b[0]) for _, b in blocks) <= 140
    # mostly zeros: a few bytes per value that is not zero
    assert sum(b[3] is not None for _, b in blocks) > 5 and all(b[1].dtype == np.int16 for _, b in blocks if b[3] is not None)
    w, weights = rng.normal(size=d + 1), (1.5, 0.75)
    got = dict.fromkeys("abc", 0.0)
    for models, block in blocks:
        for m in models:
            got[m] = got[m] + L.wide._block_sums(block, w, weights)
    for m in "abc":
        mine = np.array([m in names for names in lists])
        z, s = x[mine] @ w[:-1] + w[-1], np.where(y[mine] == 1, *weights)
        error = s * (1 / (1 + np.exp(-z)) - y[mine])
        want = [np.sum(s * (np.logaddexp(0, z) - y[mine] * z)), *(x[mine].T @ error), error.sum()]
        assert np.allclose(got[m], want, rtol=1e-10)
    asked = rows, dict.fromkeys("abc", np.zeros(d + 1)), dict.fromkeys("abc", weights), L.wide.Objective(0.01), 5, 1e-6, 400
    by_driver = L.wide.descend(*asked)
    monkeypatch.setattr(L.wide, "DRIVER_VALUES", 0)  # sums take a second stage
    by_tasks = L.wide.descend(*asked)
    assert all(np.allclose(by_driver[m][0], by_tasks[m][0]) and by_driver[m][1] == by_tasks[m][1] > 2 for m in "abc")


def test_dense_array_of_places_and_values(spark):
    rows = [(0, []), (1, [(4, 2.0)]), (2, [(3, 1.0), (0, 7.0)]), (3, [(1, 0.5), (2, 1.5), (4, -1.0)])]
    df = spark.createDataFrame(rows, "id int, bag array<struct<place:int,value:double>>")
    got = {r.id: r.x for r in df.select("id", dense("bag", 5).alias("x")).collect()}
    assert got == {0: [0.0] * 5, 1: [0, 0, 0, 0, 2.0], 2: [7.0, 0, 0, 1.0, 0], 3: [0, 0.5, 1.5, 0, -1.0]}


def test_wide_silos_of_one_class_are_skipped(spark, monkeypatch):
    monkeypatch.setattr(L, "NEWTON_FEATURES", 1)
    rows = [("a", 1, [0.1 * i, 1.0]) for i in range(8)] + [("b", i % 2, [0.1 * i, 1.0]) for i in range(8)]
    df = spark.createDataFrame(rows, "silo string, label int, features array<double>")
    got = by_model(L.fit_grouped(df, F.array("silo")))
    assert got["a"].skipped and got["a"].params == [0.0] * 3 and not got["b"].skipped and got["b"].converged


def test_large_silos_fill_the_partitions_of_the_training_table(spark):
    rows = spark.range(800_000).select((F.col("id") % 4).alias("silo"), "id")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # the rows are few bytes
    try:
        table = L.balanced_training_table(rows, "silo", "id", rows)
        counts = [r["count"] for r in table.groupBy(F.input_file_name()).count().collect()]
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    # With a silo as one part, no partition can hold less than a fourth if it holds anything.
    assert sum(counts) == 800_000 and len(counts) > 4 and max(counts) < 200_000
