import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from silo_analytics.operators import bootstrap as B
from silo_analytics.operators import metrics as M
from silo_analytics.operators import quantiles


def auroc(y, s, w=None):
    w = np.ones(len(y)) if w is None else w
    pos, neg = y == 1, y == 0
    gap = s[pos][:, None] - s[neg][None, :]
    both = w[pos][:, None] * w[neg][None, :]
    return float(np.sum(both * ((gap > 0) + 0.5 * (gap == 0))) / both.sum())


def average_precision(y, s):
    out, seen = 0.0, 0
    for cut in sorted(set(s), reverse=True):
        hit = s >= cut
        new = y[hit].sum() - seen
        out += new / y.sum() * y[hit].mean()
        seen = y[hit].sum()
    return out


@pytest.fixture(scope="module")
def scores(spark):
    rng = np.random.default_rng(3)
    rows = []
    for m, n in (("hot", 900), ("a", 60), ("b", 25)):
        for _ in range(n):
            y = int(rng.random() < 0.4)
            s = round(0.5 * rng.random() + 0.3 * y, 2)
            rows.append((len(rows), m, y, 0.5 if rng.random() < 0.3 else s))
    return rows, spark.createDataFrame(rows, "id long, model string, label int, score double").cache()


def test_hand_computed_ties(spark):
    rows = [(0.1, 0), (0.4, 1), (0.4, 0), (0.8, 1), (0.3, 1)]
    df = spark.createDataFrame(rows, "score double, label int").withColumn("m", F.lit("x"))
    assert M.ranking_metrics(df, ["m"]).first().auroc == pytest.approx(0.75)


@pytest.mark.parametrize("per_piece", [500_000, 7])
def test_ranking_metrics_match_brute_force(scores, monkeypatch, per_piece):
    rows, df = scores
    monkeypatch.setattr(M, "SCORES_PER_PIECE", per_piece)
    got = {r.model: r for r in M.ranking_metrics(df, ["model"]).collect()}
    for m in ("hot", "a", "b"):
        y = np.array([r[2] for r in rows if r[1] == m])
        s = np.array([r[3] for r in rows if r[1] == m])
        assert (got[m].n, got[m].n_pos) == (len(y), y.sum())
        assert got[m].auroc == pytest.approx(auroc(y, s), abs=1e-12)
        assert got[m].ap == pytest.approx(average_precision(y, s), abs=1e-12)


def test_reversed_scores_mirror_the_auroc(scores):
    _, df = scores
    up = {r.model: r.auroc for r in M.ranking_metrics(df, ["model"]).collect()}
    down = {r.model: r.auroc for r in M.ranking_metrics(df.withColumn("score", -F.col("score")), ["model"]).collect()}
    assert all(up[m] + down[m] == pytest.approx(1.0) for m in up)


def test_one_class_and_empty_groups_score_zero(spark):
    df = spark.createDataFrame([("a", 1, 0.3), ("a", 1, 0.6)], "m string, label int, score double")
    got = M.ranking_metrics(df, ["m"])
    assert (got.first().auroc, got.first().ap) == (0.0, 0.0)
    groups = spark.createDataFrame([("a",), ("none",)], "m string")
    full = {r.m: r for r in M.with_all_groups(got, groups, ["m"]).collect()}
    assert full["none"].n == 0 and full["none"].auroc == 0.0


def test_threshold_metrics(spark):
    rows = [("a", 1, 0.5), ("a", 0, 0.7), ("a", 1, 0.2), ("a", 0, 0.1), ("b", 0, 0.1)]
    df = spark.createDataFrame(rows, "m string, label int, score double")
    got = {r.m: r for r in M.threshold_metrics(df, ["m"]).collect()}
    assert (got["a"].precision, got["a"].recall, got["a"].f1, got["a"].accuracy) == (0.5, 0.5, 0.5, 0.5)
    assert (got["b"].precision, got["b"].recall, got["b"].f1, got["b"].accuracy) == (0.0, 0.0, 0.0, 1.0)


def weight(key, rep, seed=7):
    text = hashlib.md5(f"{seed}|boot|{rep // 8}|{key}".encode()).hexdigest()
    draw = int(text[4 * (rep % 8) : 4 * (rep % 8) + 4], 16)
    return sum(draw >= c for c in B.poisson_cuts())


@pytest.mark.parametrize("per_piece, block", [(50_000, 4096), (40, 16)])
def test_bootstrap_matches_brute_force(scores, monkeypatch, per_piece, block):
    rows, df = scores
    monkeypatch.setattr(B, "ROWS_PER_PIECE", per_piece)
    monkeypatch.setattr(B, "BLOCK", block)
    got = B.bootstrap_auroc_replicates(df.repartition(3), ["model"], "id", replicates=11)
    got = {(r.model, r.rep): r.auroc for r in got.collect()}
    assert len(got) == 33
    for m in ("hot", "b"):
        y = np.array([r[2] for r in rows if r[1] == m])
        s = np.array([r[3] for r in rows if r[1] == m])
        for rep in (0, 7, 10):
            w = np.array([weight(r[0], rep) for r in rows if r[1] == m], dtype=float)
            assert got[m, rep] == pytest.approx(auroc(y, s, w), abs=1e-12)


def test_poisson_weights_have_mean_one():
    w = np.array([weight(k, r) for k in range(2000) for r in range(8)])
    assert w.mean() == pytest.approx(1.0, abs=0.03) and w.var() == pytest.approx(1.0, abs=0.05)


def test_one_class_replicates_are_dropped(spark):
    df = spark.createDataFrame([(i, "m", int(i == 0), 0.1 * i) for i in range(6)], "id long, model string, label int, score double")
    got = B.bootstrap_auroc_replicates(df, ["model"], "id", replicates=40).collect()
    want = [r for r in range(40) if weight(0, r) > 0 and sum(weight(k, r) for k in range(1, 6)) > 0]
    assert sorted(r.rep for r in got) == want


def test_multinomial_draws_add_up(scores):
    rows, df = scores
    picks = B.multinomial_resample(df, "id", 3, 1)
    assert {r.rep: r.n for r in picks.groupBy("rep").agg(F.sum("times").alias("n")).collect()} == {0: 985, 1: 985, 2: 985}
    whole = [r.auroc for r in B.multinomial_auroc(df, "id", replicates=20).collect()]
    y, s = np.array([r[2] for r in rows]), np.array([r[3] for r in rows])
    assert len(whole) == 20 and np.mean(whole) == pytest.approx(auroc(y, s), abs=0.02)


def test_more_pieces_than_any_fixed_number(spark, monkeypatch):

    monkeypatch.setattr(M, "SCORES_PER_PIECE", 10)
    monkeypatch.setattr(B, "ROWS_PER_PIECE", 10)
    rows = spark.range(4000).select(
        "id", (F.col("id") % 2).alias("g"), (F.col("id") % 5 < 2).cast("int").alias("label"),
        F.when(F.col("id") % 3 == 0, F.lit(0.5)).otherwise(F.pmod(F.xxhash64("id"), F.lit(1000)) / 1000.0).alias("score"),
    )
    edges = M.score_edges(rows, ["g"], "score", 4)
    assert max(r.n for r in edges.select(F.size("_edges").alias("n")).collect()) > 256
    small = {r.g: (r.auroc, r.ap) for r in M.ranking_metrics(rows, ["g"]).collect()}
    boot = {(r.g, r.rep): r.auroc for r in B.bootstrap_auroc_replicates(rows, ["g"], "id", replicates=5).collect()}
    monkeypatch.undo()
    whole = {r.g: (r.auroc, r.ap) for r in M.ranking_metrics(rows, ["g"]).collect()}
    assert small[0] == pytest.approx(whole[0]) and small[1] == pytest.approx(whole[1])
    again = {(r.g, r.rep): r.auroc for r in B.bootstrap_auroc_replicates(rows, ["g"], "id", replicates=5).collect()}
    assert set(boot) == set(again) and all(boot[k] == pytest.approx(again[k]) for k in boot)


def test_quantiles_with_narrow_brackets(spark, monkeypatch):
    from silo_analytics.operators import quantiles

    monkeypatch.setattr(quantiles, "BRACKET_ROWS", 5)
    values = [float(i % 97) for i in range(3000)] + [7.0] * 2000 + [float("nan")] * 50 + [None] * 9
    df = spark.createDataFrame([(v,) for v in values], "`a``b` double")
    got = quantiles.exact_quantiles(df, {"a`b": (0.0, 0.1, 0.5, 0.77, 1.0)})
    known = np.array(values[:5000])
    assert all(got["a`b", p] == pytest.approx(np.quantile(known, p)) for p in (0.0, 0.1, 0.5, 0.77, 1.0))


def test_pieces_are_found_by_halving(spark, monkeypatch):
    monkeypatch.setattr(M, "EDGE_ERROR", 0.01)
    rows = spark.range(3000).select(
        F.when(F.col("id") % 3 > 0, "many").otherwise("few").alias("g"), (F.col("id") * 7919 % 1009 / 1009 - 0.2).alias("score")
    )
    placed = M.with_edges(rows, ["g"], "score", 20).withColumn("below", M.edges_below(F.col("score"))).collect()
    assert max(len(r["_edges"]) for r in placed) > 60
    for r in placed:
        assert r.below == sum(e < r.score for e in r["_edges"])
        assert 2 ** (len(r["_steps"]) - 1) <= len(r["_edges"])  # the logarithm of the edges, not all of them, per row
    for odd in (float("-inf"), float("inf")):
        one = M.with_edges(rows, ["g"], "score", 20).withColumn("below", M.edges_below(F.lit(odd))).first()
        assert one.below == (0 if odd < 0 else len(one["_edges"]))
    whole = M.with_edges(rows, ["g"], "score", 10_000).withColumn("below", M.edges_below(F.col("score")))
    assert whole.agg(F.max("below")).first()[0] == 0


def test_quantiles_of_columns_with_common_values(spark):
    values = [(float(i % 2), 0.5 if i % 10 else float(i), None if i % 4 else -0.0, float(i * 37 % 1001)) for i in range(1001)]
    df = spark.createDataFrame(values, "a double, b double, c double, d double")
    wanted = {c: (0.0, 0.25, 0.5, 0.9, 1.0) for c in "abcd"}
    got = quantiles.exact_quantiles(df, wanted)
    for i, c in enumerate("abcd"):
        known = [v[i] for v in values if v[i] is not None]
        for p in wanted[c]:
            assert got[c, p] == pytest.approx(np.quantile(known, p), abs=1e-12)
