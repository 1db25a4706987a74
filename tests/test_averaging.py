import pytest

from silo_analytics.operators import averaging as A
from silo_analytics.operators import compare as C
from silo_analytics.operators import store as S
from silo_analytics.plans.strategies import averaging_rounds

PARAMS = "model string, n long, params array<double>"


def test_weighted_average(spark):
    df = spark.createDataFrame([("a", 1, [1.0, 0.0]), ("b", 2, [4.0, 3.0]), ("c", 3, [0.0, 1.0])], PARAMS)
    assert A.average_vectors(df.repartition(3), "params", "n").first().params == pytest.approx([1.5, 1.5])
    same = spark.createDataFrame([("a", 1, [0.1, 0.2]), ("b", 5, [0.1, 0.2])], PARAMS)
    assert A.average_vectors(same, "params", "n").first().params == pytest.approx([0.1, 0.2])
    assert A.weighted_mean(df.selectExpr("n", "params[0] AS v"), "v", "n").first()[0] == pytest.approx(1.5)
    assert A.weighted_mean(df.selectExpr("n", "params[0] AS v").limit(0), "v", "n").first()[0] == 0.0


def test_average_refuses_bad_input(spark):
    for rows in ([], [("a", 1, [1.0]), ("b", 1, [1.0, 2.0])], [("a", 0, [1.0])]):
        with pytest.raises(ValueError):
            A.check_averageable(spark.createDataFrame(rows, PARAMS), "params", "n")
    mixed = spark.createDataFrame([("a", 1, [1.0]), ("b", 1, [1.0, 2.0])], PARAMS)
    assert A.average_importances(mixed, "params", "n").first().importances is None


@pytest.mark.parametrize("mu, want", [(0.0, [2.0, 4.0]), (0.25, [1.75, 3.5]), (1.0, [1.0, 2.0]), (2.0, [1.0, 2.0])])
def test_pull_keeps_the_intercept(spark, mu, want):
    df = spark.createDataFrame([([2.0, 4.0, 9.0], [1.0, 2.0, 0.0])], "l array<double>, t array<double>")
    assert A.pull_toward(df, "l", "t", mu, 2).first().params == pytest.approx([*want, 9.0])
    assert A.merge_half(df, "l", "t").first().params == [1.5, 3.0, 4.5]


def test_importance(spark):
    df = spark.createDataFrame([([-4.0, 2.0, 9.0],), ([0.0, 0.0, 1.0],)], "params array<double>")
    assert [r.importances for r in A.importances(df, "params", 2).collect()] == [[1.0, 0.5], [0.0, 0.0]]


def test_rounds(spark):
    local = spark.createDataFrame([("a", 1, [1.0, 1.0]), ("b", 3, [3.0, 5.0])], PARAMS)
    assert averaging_rounds(local, 3, 1, [0.0, 0.0]) == [[2.5, 4.0]] * 3
    pulled = averaging_rounds(local, 2, 1, [0.0, 0.0], mu=0.5)
    assert pulled[0] == pytest.approx([1.25, 4.0]) and pulled[1] == pytest.approx([1.875, 4.0])
    assert averaging_rounds(local, 2, 1, [7.0, 0.0], mu=1.0)[1] == pytest.approx([7.0, 4.0])
    assert averaging_rounds(local.limit(0), 2, 1, [7.0, 8.0]) == [[7.0, 8.0]] * 2


def test_best_uplift_verdict(spark):
    rows = [("r1", 0.5, 0.7, 0.7), ("r2", None, 0.4, None), ("r3", None, None, None)]
    df = spark.createDataFrame(rows, "region string, a double, b double, c double")
    best = {r.region: (r.best_approach, r.best_value) for r in
            C.best_of(df, "region", {"a": "A", "b": "B", "c": "C"}).collect()}
    assert best == {"r1": ("B", 0.7), "r2": ("B", 0.4), "r3": ("—", None)}
    up = {r.region: (r.b_uplift, r.b_uplift_label) for r in C.uplift(df, ["b"], "a").collect()}
    assert up == {"r1": (pytest.approx(0.2), "+0.2000"), "r2": (None, "—"), "r3": (None, "—")}
    down = C.uplift(spark.createDataFrame([(0.5, 0.4)], "a double, b double"), ["b"], "a").first()
    assert down.b_uplift_label == "-0.1000"

    def conclude(pairs):
        table = spark.createDataFrame(pairs, "a double, b double")
        return tuple(C.verdict(C.equivalence(table, "a", "b")).first())

    assert conclude([(0.5, 0.504), (0.5, None)]) == (1, 0, "EQUIVALENT")
    assert conclude([(0.5, 0.504), (0.5, 0.506)]) == (1, 1, "DIFFERENT")
    assert conclude([(None, 0.5)]) == (0, 0, "NOT EVALUATED")


def test_region_warnings(spark):
    rows = [("ok", 100, 10, 90, 60), ("small", 100, 10, 90, 20), ("few", 9, 4, 5, 2), ("pos", 50, 1, 49, 10)]
    df = spark.createDataFrame(rows, "region string, n long, n_pos long, n_neg long, n_test long")
    got = {r.region: r.warning for r in C.region_warnings(df).collect()}
    assert got == {"small": "SMALL SAMPLE", "few": "SKIP", "pos": "SKIP"}


def test_model_and_metric_tables(spark, tmp_path):
    path = str(tmp_path / "models")
    assert S.list_models(spark, path).count() == 0
    for i, run in enumerate(("r1", "r2")):
        rows = [("pooled", [float(i), 2.0], {"auroc": 0.5 + i / 10})]
        df = spark.createDataFrame(rows, "tag string, params array<double>, metrics map<string,double>")
        S.save_models(
            df.selectExpr("*", f"timestamp_seconds({1000 + i}) AS ts", "'lr' AS kind", f"'{run}' AS run_id")
            .withColumn("config", S.config_column({"c": 0.01})),
            path,
        )
    assert S.load_models(spark, path, "r2", "pooled").first().params == [1.0, 2.0]
    assert S.load_models(spark, path, "r3").count() == 0
    listed = S.list_models(spark, path)
    assert [r.run_id for r in listed.collect()] == ["r2", "r1"] and "params" not in listed.columns

    rows = [("s", 1, None, "global_auroc", 0.6, 5), ("s", 2, None, "global_auroc", 0.7, 5), ("s", 1, None, "cv", 0.1, 5)]
    long = spark.createDataFrame(rows, "strategy string, round int, silo string, metric string, value double, n long")
    S.save_metrics(long.selectExpr("*", "'r1' AS run_id"), str(tmp_path / "metrics"))
    back = S.load_metrics(spark, str(tmp_path / "metrics"), "r1")
    assert tuple(S.summarize(back, ["global_auroc", "cv"]).first()) == ("s", 0.7, 0.1)
    assert [r.value for r in S.convergence(back).collect()] == [0.6, 0.7]
