import numpy as np
import pytest
from pyspark.sql import functions as F

from silo_analytics.operators import ranking
from silo_analytics.operators import sampling as P
from silo_analytics.operators.augment import augment_groups, jitter_stats


@pytest.fixture(scope="module")
def labelled(spark):
    """2,119 rows with 358 positives, in a hot group and small ones."""
    df = spark.range(2119).select(
        "id", (F.col("id") < 358).cast("int").alias("label"),
        F.when(F.col("id") % 3 == 0, F.lit(0)).otherwise(F.col("id") % 40).cast("int").alias("g"),
    )
    return df.cache()


def pairs(df, *columns):
    return sorted(tuple(r) for r in df.select(*columns).collect())


def test_split_sizes_are_exact(labelled):
    out = P.stratified_split(labelled, "label", "id", 0.2, 0)
    counts = {(r.label, r.is_test): r["count"] for r in out.groupBy("label", "is_test").count().collect()}
    assert counts == {(1, True): 72, (1, False): 286, (0, True): 352, (0, False): 1409}


@pytest.mark.parametrize("parts", [1, 7, 64])
def test_assignments_do_not_depend_on_partitioning(labelled, parts):
    shuffled = labelled.repartition(parts)
    for make in (
        lambda d: P.stratified_split(d, "label", "id", 0.2, 0),
        lambda d: P.stratified_folds(d, "label", "id", 4, 3, "is_test"),
    ):
        assert pairs(make(labelled), "id", "is_test") == pairs(make(shuffled), "id", "is_test")


def test_split_by_group_keeps_both_classes(labelled):
    out = P.stratified_split(labelled, "label", "id", 0.2, 0, by=["g"])
    assert out.count() == 2119
    per = out.groupBy("g", "label").agg(F.count("*").alias("n"), F.count_if("is_test").alias("t")).collect()
    assert all(1 <= r.t < r.n for r in per if r.n >= 2)
    assert all(r.t == 0 for r in per if r.n == 1)


def test_folds_are_balanced_per_class(labelled):
    out = P.stratified_folds(labelled, "label", "id", 5, 0)
    sizes = [r["count"] for r in out.filter("label = 1").groupBy("fold").count().collect()]
    assert sorted(sizes) == [71, 71, 72, 72, 72]
    assert sum(r["count"] for r in out.groupBy("fold").count().collect()) == 2119


def test_skew_sizes_follow_the_shares(labelled):
    shares = P.skew_proportions(5, 0.5, 3)
    out = P.skew_partition(labelled, "label", "id", 5, 0.5, 3)
    for label, n in ((1, 358), (0, 1761)):
        want = [int(s * n) for s in shares[label]]
        want[-1] = n - sum(want[:-1])
        got = {r.silo: r["count"] for r in out.filter(F.col("label") == label).groupBy("silo").count().collect()}
        assert [got.get(i, 0) for i in range(5)] == want
    assert set(pairs(P.skew_partition(labelled, "label", "id", 1, 0.5, 3), "silo")) == {(0,)}


def test_rank_in_group_is_a_permutation(labelled):
    out = ranking.rank_in_group(labelled, ["g"], "id", 0, "r", buckets=8)
    by_group = {}
    for r in out.collect():
        by_group.setdefault(r.g, []).append(r["rank"])
    assert all(sorted(v) == list(range(1, len(v) + 1)) for v in by_group.values())
    assert sum(map(len, by_group.values())) == 2119


def test_cuts_without_the_driver_agree(labelled, monkeypatch):
    want = pairs(P.stratified_folds(labelled, "label", "id", 3, 0), "id", "fold")
    monkeypatch.setattr(ranking, "CUT_ROWS", 0)
    assert pairs(P.stratified_folds(labelled, "label", "id", 3, 0), "id", "fold") == want


@pytest.fixture(scope="module")
def groups(spark):
    rows = []
    for i in range(12):
        rows.append((i, "big", i % 2, float(i), 1, None, 5.0))
    for i in range(12, 16):
        rows.append((i, "small", i % 2, float(i) * 10, i % 2, None, 5.0))
    rows.append((16, "zero", 1, 0.0, 0, None, 0.0))
    rows.append((17, None, 1, 3.0, 0, 1.0, 1.0))
    return spark.createDataFrame(rows, "id long, g string, label int, x double, flag int, empty double, same double")


def test_augment_fills_small_groups_only(groups):
    out = augment_groups(groups, "g", "id", ["x", "flag", "empty", "same"], 10, 1)
    rows = out.collect()
    sizes = {}
    for r in rows:
        sizes[r.g] = sizes.get(r.g, 0) + 1
    assert sizes == {"big": 12, "small": 10, "zero": 10, None: 1}
    made = [r for r in rows if r.is_synthetic]
    assert len(made) == 15
    assert sorted(r.id for r in made) == list(range(18, 33))
    assert all(r.empty == 0.0 for r in made)  # a column without values counts as 0/1
    assert all(r.flag in (0.0, 1.0) for r in made)
    assert all(r.label == 1 for r in made if r.g == "zero")
    real = {r.x for r in rows if r.g == "small" and not r.is_synthetic}
    assert all(min(abs(r.x - v) for v in real) < 5 for r in made if r.g == "small")
    assert all(r.x not in real for r in made if r.g == "small")


def test_augment_does_not_depend_on_partitioning(groups):
    args = ("g", "id", ["x", "flag"], 10, 1)
    a = pairs(augment_groups(groups, *args), "id", "x", "label")
    assert a == pairs(augment_groups(groups.repartition(5), *args), "id", "x", "label")


def test_jitter_scales(groups):
    stats = {r.g: r for r in jitter_stats(groups.filter("g IS NOT NULL"), "g", ["x", "same"]).collect()}
    assert stats["small"]["_scale0"] == pytest.approx(np.std([120, 130, 140, 150]))
    assert stats["small"]["_scale1"] == pytest.approx(0.25)  # constant column: 5 % of the level
    assert stats["zero"]["_scale0"] == 0.01


def test_null_groups_are_ranked_and_null_labels_left_out(spark):
    rows = spark.createDataFrame([(i, ["a", None][i % 2], [0, 1, None][i % 3]) for i in range(60)], "id long, g string, label int")
    ranks = {(r.g, r.rank) for r in ranking.rank_in_group(rows, ["g"], "id", 0, "r").collect()}
    assert ranks == {(g, k) for g in ("a", None) for k in range(1, 31)}
    for got in (
        P.stratified_split(rows, "label", "id", 0.2, 0, by=["g"], name="x"),
        P.stratified_folds(rows, "label", "id", 5, 0, name="x"),
        P.skew_partition(rows, "label", "id", 3, 0.5, 0, name="x"),
    ):
        rows_ = got.collect()
        assert len(rows_) == 60 and all((r.x is None) == (r.label is None) for r in rows_)
    split = P.stratified_split(rows, "label", "id", 0.2, 0, by=["g"])
    assert split.filter("g IS NULL AND is_test").count() == split.filter("g = 'a' AND is_test").count() == 4
