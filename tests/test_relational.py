import numpy as np
import pytest
from pyspark.sql import functions as F

from silo_analytics import scratch
from silo_analytics.functions.scalar import differs_or_null
from silo_analytics.operators import quantiles
from silo_analytics.operators import relational as R


def test_max_row_null_rules_and_ties(spark):
    rows = [(1, 10.0, 1, "a"), (1, 20.0, 2, "b"), (1, None, 3, "c"), (2, 5.0, 1, "d"), (2, 5.0, 2, "e")]
    df = spark.createDataFrame(rows, "k int, s double, t int, p string")
    first = {r.k: r.p for r in R.max_row_per_key(df, "k", "s", ["t"], ["p"]).collect()}
    assert first == {1: "c", 2: "e"}
    last = {r.k: r.p for r in R.max_row_per_key(df, "k", "s", ["t"], ["p"], nulls="last").collect()}
    assert last == {1: "b", 2: "e"}


def test_counts_keep_null_and_join_zero(spark):
    detail = spark.createDataFrame([(1, None), (1, "Yes"), (1, "No")], "k int, c string")
    base = spark.createDataFrame([(1,), (2,)], "k int")
    counted = R.count_per_key(detail, "k", "n", differs_or_null(F.col("c"), "Yes"))
    assert {r.k: r.n for r in R.attach(base, counted, "k", zero=["n"]).collect()} == {1: 2, 2: 0}


def test_mark_exists_does_not_multiply(spark):
    base = spark.createDataFrame([("a",), ("a",), ("b",), (None,)], "k string")
    keys = spark.createDataFrame([("a",), ("a",), (None,)], "k string")
    got = sorted((r.k or "", r.hit) for r in R.mark_exists(base, keys, "k", "hit").collect())
    assert got == [("", 0), ("a", 1), ("a", 1), ("b", 0)]


def test_group_stats_leave_out_null_groups(spark):
    rows = [(1, 1), (1, 0), (2, 0), (None, 1)]
    df = spark.createDataFrame(rows, "g int, label int")
    stats = {r.g: (r.n, r.n_pos, r.n_neg, r.candidate, r.skipped) for r in
             R.trainable(R.size_gate(R.group_label_counts(df, "g", "label"), 2, 1, 1), 2).collect()}
    assert stats == {1: (2, 1, 1, True, False), 2: (1, 0, 1, False, True)}
    profile = R.group_size_profile(df, "g").first()
    assert (profile.groups, profile.mean_size, profile.min_size) == (2, 1.5, 1)


def test_first_rows(spark):
    df = spark.createDataFrame([(1, 3), (1, 1), (1, 2), (2, 9)], "k int, t int")
    got = sorted((r.k, r.t, r.r) for r in R.first_rows(df, "k", ["t"], 2, "r").collect())
    assert got == [(1, 1, 1), (1, 2, 2), (2, 9, 1)]


@pytest.mark.parametrize("p", [0.0, 0.25, 0.5, 0.75, 0.975, 1.0])
def test_exact_quantiles_match_numpy(spark, p):
    rng = np.random.default_rng(1)
    values = np.concatenate([rng.lognormal(size=3000), np.full(800, 2.5), rng.normal(size=701)])
    rows = [(float(v), 7.0, None) for v in values] + [(None, 7.0, None)] * 50
    df = spark.createDataFrame(rows, "x double, c double, e double").repartition(7)
    got = quantiles.exact_quantiles(df, {"x": (p,), "c": (p,), "e": (p,)})
    assert got["x", p] == pytest.approx(np.quantile(values, p), abs=1e-12)
    assert got["c", p] == 7.0
    assert got["e", p] is None


def test_quantiles_recover_from_a_missed_bracket(spark, monkeypatch):
    monkeypatch.setattr(quantiles, "ACCURACY", 10)
    monkeypatch.setattr(quantiles, "_SLACK", 0.0)
    values = np.random.default_rng(2).normal(size=5000)
    df = spark.createDataFrame([(float(v),) for v in values], "x double").repartition(5)
    assert quantiles.exact_medians(df, ["x"])["x"] == pytest.approx(np.median(values), abs=1e-12)


@pytest.mark.parametrize("driver, broadcast", [(10_000, 200_000), (0, 200_000), (0, 0)])
def test_join_lookup_ways_agree(spark, monkeypatch, driver, broadcast):
    monkeypatch.setattr(scratch, "DRIVER_ROWS", driver)
    big = spark.range(1000).select((F.col("id") % 4).alias("k"), "id")  # a few hot keys
    small = spark.createDataFrame([(0, "a"), (1, "b"), (2, "c")], "k long, v string")
    for how, rows in (("left", 1000), ("inner", 750), ("left_semi", 750)):
        got = scratch.join_lookup(big, small, ["k"], how, limit=broadcast)
        assert got.count() == rows
        if how != "left_semi":
            assert got.filter("k = 1 AND v = 'b'").count() == 250
        assert "_salt" not in got.columns


def test_first_row_marked_in_one_scan(spark, tmp_path):
    rows = [("a", 2, "x"), ("a", 1, "y"), ("b", 5, "z"), (None, 3, "n"), (None, 1, None), ("c", None, "p"), ("c", 4, "q")]
    spark.createDataFrame(rows, "k string, t int, v string").write.parquet(str(tmp_path / "t"))
    got = R.first_row_marked(spark.read.parquet(str(tmp_path / "t")), "k", ["t"], ["v"], "more")
    found = {(r.k, r.t, r.v, r.more) for r in got.collect()}
    assert found == {("a", 1, "y", 1), ("b", 5, "z", 0), (None, 1, None, 1), ("c", None, "p", 1)}
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Relation") == 1 and "Window" not in plan and "Join" not in plan
