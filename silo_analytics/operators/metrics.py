"""Exact ranking and threshold metrics for any number of models at once.

Scores are first counted by distinct value.  Value edges from a sketch then cut
each model's score range into pieces of bounded size; running totals inside a
piece plus the totals of the earlier pieces give exact ranks without a task ever
seeing all scores of a model.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.vectors import constant
from ..scratch import join_lookup, null_safe_join, settle

# Rank error of the edges: this share of the width of a piece.
EDGE_ERROR = 0.1
SCORES_PER_PIECE = 500_000
# Groups whose edges the driver holds between the two steps.
EDGE_GROUPS = 10_000


def score_edges(df: DataFrame, by: Sequence[str], score: str, per_piece: int) -> DataFrame:
    """Per group, the score values that cut it into pieces of about ``per_piece`` rows.

    As many pieces as the counted rows of the largest group need; ``_pieces`` is the number
    that the group itself needs.
    """
    sizes = df.groupBy(*by).agg(F.count(F.lit(1)).alias("_rows"))
    most = -(-(sizes.agg(F.max("_rows")).first()[0] or 0) // per_piece)
    if most <= 1:
        return sizes.filter("false").select(*by, F.array().cast("array<double>").alias("_edges"), F.lit(1).alias("_pieces"))
    shares = constant([i / most for i in range(1, most)])
    sketch = df.groupBy(*by).agg(
        F.count(F.lit(1)).alias("_rows"),
        F.percentile_approx(F.col(score).cast("double"), shares, int(most / EDGE_ERROR)).alias("_all"),
    )
    pieces = F.greatest(F.ceil(F.col("_rows") / per_piece), F.lit(1))
    kept = F.filter("_all", lambda e, i: (i + 1) % F.col("_step") == 0)
    return (
        sketch.withColumn("_pieces", pieces.cast("int"))
        .withColumn("_step", F.floor(F.lit(most) / F.col("_pieces")))
        .withColumn("_edges", F.array_sort(F.array_distinct(kept)))
        .select(*by, "_edges", "_pieces")
    )


def with_edges(df: DataFrame, by: Sequence[str], score: str, per_piece: int) -> DataFrame:
    """Add the edges of the row's group (null for a group that is one piece), and the steps of a search in them.

    The edges come from one scan whose sketches are merged, not from a shuffle of
    the rows; they are few and are broadcast while their number is within bounds.
    """
    edges, few = settle(
        score_edges(df, by, score, per_piece).filter(F.size("_edges") > 0), EDGE_GROUPS, "edges"
    )
    steps = F.transform(F.sequence(F.floor(F.log2(F.size("_edges"))).cast("int"), F.lit(0), F.lit(-1)), lambda i: F.pow(F.lit(2), i).cast("int"))
    edges = edges.withColumn("_steps", steps)
    if not few:
        return join_lookup(df, edges, by)
    if edges.isEmpty():
        none = {f"_{c}": F.lit(None).cast(f"array<{kind}>") for c, kind in (("edges", "double"), ("steps", "int"))}
        return df.withColumns({**none, "_pieces": F.lit(1)})
    return null_safe_join(df, F.broadcast(edges), by, "left")


def edges_below(score: Column) -> Column:
    """How many of the sorted ``_edges`` are below the score, by halving: ``_steps`` are powers of two, the largest first."""

    def on(below: Column, step: Column) -> Column:
        return F.when(F.get("_edges", below + step - 1) < score, below + step).otherwise(below)

    return F.coalesce(F.aggregate("_steps", F.lit(0), on), F.lit(0))


def scored_rows(df: DataFrame, label: str, score: str) -> DataFrame:
    """Rows that can be judged: the label is 0 or 1 and the score a number."""
    s = F.col(score).cast("double")
    return df.filter(F.col(label).isin(0, 1) & s.isNotNull() & ~F.isnan(s))


def score_counts(
    df: DataFrame, by: Sequence[str], label: str, score: str, weight: Column | None = None
) -> DataFrame:
    """Positives and negatives (or their weight) for every distinct score of a group."""
    w = F.lit(1) if weight is None else weight
    zero = F.lit(0)
    return df.groupBy(*by, F.col(score).cast("double").alias("_score")).agg(
        F.sum(F.when(F.col(label) == 1, w).otherwise(zero)).alias("_pos"),
        F.sum(F.when(F.col(label) == 0, w).otherwise(zero)).alias("_neg"),
    )


def ranking_metrics(
    df: DataFrame,
    by: Sequence[str],
    label: str = "label",
    score: str = "score",
    weight: Column | None = None,
) -> DataFrame:
    """Exact AUROC (a tie counts one half) and average precision per group.

    Returns the ``by`` columns, ``n``, ``n_pos``, ``auroc``, ``ap``.  A group with
    one class scores 0.  Rows without a score or a label of 0 or 1 do not count.
    """
    placed = with_edges(scored_rows(df, label, score), by, score, SCORES_PER_PIECE)
    placed = placed.withColumn("_piece", edges_below(F.col(score).cast("double")))
    counts = score_counts(placed, [*by, "_piece"], label, score, weight)
    # by piece and not by group alone, whatever the partitioning so far would allow
    placed = counts.repartition(*by, "_piece")

    group = Window.partitionBy(*by)
    before = group.orderBy("_piece").rowsBetween(Window.unboundedPreceding, -1)
    sums = placed.groupBy(*by, "_piece").agg(F.sum("_pos").alias("_pp"), F.sum("_neg").alias("_pn"))
    offsets = sums.select(
        *by,
        "_piece",
        F.coalesce(F.sum("_pp").over(before), F.lit(0)).alias("_pos_before"),
        F.coalesce(F.sum("_pn").over(before), F.lit(0)).alias("_neg_before"),
        F.sum("_pp").over(group).alias("_P"),
        F.sum("_pn").over(group).alias("_N"),
    )
    inside = (
        Window.partitionBy(*by, "_piece").orderBy("_score").rowsBetween(Window.unboundedPreceding, -1)
    )
    lower = placed.withColumns(
        {
            "_lp": F.coalesce(F.sum("_pos").over(inside), F.lit(0)),
            "_ln": F.coalesce(F.sum("_neg").over(inside), F.lit(0)),
        }
    )
    lower = null_safe_join(lower, offsets, [*by, "_piece"])
    pos, neg = F.col("_pos").cast("double"), F.col("_neg").cast("double")
    neg_below = F.col("_neg_before") + F.col("_ln")
    true_pos = (F.col("_P") - F.col("_pos_before") - F.col("_lp")).cast("double")
    false_pos = (F.col("_N") - neg_below).cast("double")
    total = lower.groupBy(*by).agg(
        F.max("_P").alias("n_pos"),
        F.max("_N").alias("_N"),
        F.sum(pos * (neg_below + neg / 2.0)).alias("_u"),
        F.sum(F.when(pos > 0, pos * true_pos / (true_pos + false_pos)).otherwise(0.0)).alias("_ap"),
    )
    both = (F.col("n_pos") > 0) & (F.col("_N") > 0)
    return total.select(
        *by,
        (F.col("n_pos") + F.col("_N")).alias("n"),
        "n_pos",
        F.when(both, F.col("_u") / (F.col("n_pos").cast("double") * F.col("_N"))).otherwise(0.0).alias("auroc"),
        F.when(both, F.col("_ap") / F.col("n_pos")).otherwise(0.0).alias("ap"),
    )


def threshold_metrics(
    df: DataFrame, by: Sequence[str], label: str = "label", score: str = "score", cut: float = 0.5
) -> DataFrame:
    """Precision, recall, F1 and accuracy of score >= cut; an undefined ratio is 0.

    Rows without a score or a label of 0 or 1 do not count.
    """
    hit, true = F.col(score) >= cut, F.col(label) == 1
    counts = scored_rows(df, label, score).groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(hit & true).alias("tp"),
        F.count_if(hit & ~true).alias("fp"),
        F.count_if(~hit & true).alias("fn"),
    )
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")

    def ratio(top: Column, bottom: Column) -> Column:
        return F.coalesce(F.try_divide(top.cast("double"), bottom), F.lit(0.0))

    return counts.select(
        *by,
        "n",
        "tp",
        "fp",
        "fn",
        ratio(tp, tp + fp).alias("precision"),
        ratio(tp, tp + fn).alias("recall"),
        ratio(2 * tp, 2 * tp + fp + fn).alias("f1"),
        ratio(F.col("n") - fp - fn, F.col("n")).alias("accuracy"),
    )


def with_all_groups(metrics: DataFrame, groups: DataFrame, by: Sequence[str]) -> DataFrame:
    """A row for every group: one without scored rows gets zeros, and 1 as upper bound."""
    joined = groups.select(*by).distinct().join(metrics, list(by), "left")
    numbers = [c for c in metrics.columns if c not in by]
    return joined.select(
        *by, *[F.coalesce(F.col(c), F.lit(1 if c == "auroc_ci_hi" else 0)).alias(c) for c in numbers]
    )


def rounded(df: DataFrame, digits: int = 4) -> DataFrame:
    """Round every double column."""
    doubles = {name for name, kind in df.dtypes if kind == "double"}
    return df.select(*[F.round(c, digits).alias(c) if c in doubles else F.col(c) for c in df.columns])


def score_summary(df: DataFrame, by: Sequence[str], value: str = "auroc") -> DataFrame:
    """Mean and population deviation of fold scores."""
    return df.groupBy(*by).agg(F.avg(value).alias("cv_auroc"), F.stddev_pop(value).alias("cv_std"))
