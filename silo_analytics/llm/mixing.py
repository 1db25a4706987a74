"""Mixing sources to target weights by budgets that go down a tree.

Leaves are paths such as (domain, language, source).  A node can give at most the tokens below
it times ``max_epochs``.  The total budget is split among the top nodes by their weights; a node
that cannot give its share is set to what it can, and its shortage goes to its siblings by
their weights.  Only what all siblings together cannot give was never asked of them: their
parent was set to that much before, and its siblings, the next level up, took the rest.

A leaf takes whole epochs of its documents while the budget lasts, and then the beginning of
one more epoch, in an order drawn from the seed and the epoch.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..scratch import materialize
from .common import col, running

# Rows that the exact cut of a leaf's last epoch may have to order, on average.
CUT_ROWS = 2_000


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def weight_of(name: Column, weights: Mapping[str, int], default: int) -> Column:
    out = F.lit(default)
    for key, value in weights.items():
        out = F.when(name == key, F.lit(value)).otherwise(out)
    return out.cast("double")


def split_budget(children: DataFrame, parents: Sequence[str], name: str) -> DataFrame:
    """Adds ``share``: the parent's ``budget`` dealt out by ``weight``, none above its ``cap``.

    Children fill up in the order of cap / weight.  The first that does not fill up sets the
    amount per weight of all after it.  A weight of 0 gets nothing.
    """
    group = Window.partitionBy(*parents)
    ratio = F.when(F.col("weight") > 0, F.col("cap") / F.col("weight"))
    ordered = group.orderBy(F.col("ratio").asc_nulls_last(), name)
    before = ordered.rowsBetween(Window.unboundedPreceding, -1)
    rows = children.withColumn("ratio", ratio)
    rows = rows.withColumn("full", F.coalesce(F.sum("cap").over(before), F.lit(0.0)))
    rows = rows.withColumn("left", F.sum("weight").over(group) - F.coalesce(F.sum("weight").over(before), F.lit(0.0)))
    rows = rows.withColumn("level", (F.col("budget") - F.col("full")) / F.nullif("left", F.lit(0.0)))
    rows = rows.withColumn("stops", (F.col("ratio") > F.col("level")) | F.col("ratio").isNull())
    rows = rows.withColumn("place", F.row_number().over(ordered))
    first = F.min(F.when(F.col("stops"), F.struct("place", "level"))).over(group)
    rows = rows.withColumn("first", first)
    share = F.when(F.col("first").isNull() | (F.col("place") < F.col("first.place")), F.col("cap")).otherwise(
        F.col("weight") * F.coalesce("first.level", F.lit(0.0))
    )
    return rows.withColumn("share", share).drop("ratio", "full", "left", "level", "stops", "place", "first")


def leaf_budgets(
    leaves: DataFrame, levels: Sequence[str], weights: Sequence[Mapping[str, int]], defaults: Sequence[int],
    budget: float, max_epochs: int,
) -> DataFrame:
    """Budgets of leaves (levels..., tokens), found level by level from the top."""
    asked = None
    for depth, name in enumerate(levels):
        path = list(levels[: depth + 1])
        nodes = leaves.groupBy(*path).agg((F.sum("tokens") * F.lit(max_epochs)).cast("double").alias("cap"))
        nodes = nodes.where("cap > 0").withColumn("weight", weight_of(F.col(name), weights[depth], defaults[depth]))
        if asked is None:
            nodes = nodes.withColumn("budget", F.lit(float(budget)))
            nodes = nodes.withColumn("_all", F.lit(0))
            nodes = split_budget(nodes, ["_all"], name).drop("_all")
        else:
            parents = path[:-1]
            nodes = nodes.join(asked, parents)
            nodes = split_budget(nodes, parents, name)
        asked = nodes.select(*path, F.col("share").alias("budget"))
    return asked


def choose_documents(
    docs: DataFrame, levels: Sequence[str], weights: Sequence[Mapping[str, int]], defaults: Sequence[int],
    share: float = 0.5, max_epochs: int = 2, seed: int = 3, id_col: str = "doc_id", text_col: str = "text",
) -> DataFrame:
    """(id, text_hash, levels..., tokens, epochs): how often each row of ``docs`` is taken.

    ``levels`` are columns of ``docs``; null counts as "".  The budget is ``share`` of all tokens
    (words between blanks).  A taken document is always whole: a leaf's last epoch ends before
    the document that would pass its budget.  Documents without words are taken in every epoch
    that reaches their place, and an epoch without budget takes none.  Rows that agree in leaf, id and text
    are numbered, and each has a place of its own; so have rows with a null id.  No rows give no rows.
    """
    rows = docs.select(
        col(id_col).alias("id"), F.xxhash64(col(text_col)).alias("text_hash"),
        *[F.coalesce(col(c).cast("string"), F.lit("")).alias(f"level{k}") for k, c in enumerate(levels)],
        F.coalesce(F.md5(col(text_col).cast("binary")), F.lit("")).alias("digest"),
        word_count(col(text_col)).alias("tokens"), F.lit(1).cast("long").alias("one"),
    )
    names = [f"level{k}" for k in range(len(levels))]
    # Equal rows get the numbers 1, 2, ..., however many there are.
    rows = rows.withColumn("same", F.xxhash64("id", F.col("id").isNull(), "digest", *names))
    rows = running(rows, "same", [], {"copy": "one"}, {}, "counted").drop("same", "one")
    leaves = materialize(rows.groupBy(*names).agg(F.sum("tokens").alias("tokens"), F.count("*").alias("n")), "leaves")
    total = leaves.agg(F.sum("tokens"), F.sum("n")).first()
    budget = float(int(share * (total[0] or 0)))
    plan = leaf_budgets(leaves.select(*names, "tokens"), names, weights, defaults, budget, max_epochs)
    plan = leaves.join(plan, names, "left").withColumn("budget", F.floor(F.coalesce("budget", F.lit(0.0))).cast("long"))
    plan = plan.withColumn("whole", F.when(F.col("tokens") > 0, F.floor(F.col("budget") / F.col("tokens"))).otherwise(0).cast("long"))
    plan = plan.withColumn("rest", F.col("budget") - F.col("whole") * F.col("tokens"))
    plan = materialize(plan.select(*names, "whole", "rest"), "leaf-budgets")
    # One order per leaf and epoch; the beginning of the hash is the bucket of the exact cut.
    drawn = rows.join(F.broadcast(plan), names) if leaves.count() <= 100_000 else rows.join(plan, names)
    place = F.md5(F.concat_ws("|", F.lit(str(seed)), F.col("whole").cast("string"), F.coalesce(F.col("id").cast("string"), F.lit("")), "digest", F.col("copy").cast("string"), *names))
    drawn = drawn.withColumn("draw", place)
    digits = 1
    while 16**digits * CUT_ROWS < (total[1] or 0) and digits < 8:
        digits += 1
    drawn = drawn.withColumn("bucket", F.substring("draw", 1, digits))
    sums = drawn.groupBy(*names, "bucket").agg(F.sum("tokens").alias("held"), F.first("rest").alias("rest"))
    in_leaf = Window.partitionBy(*names).orderBy("bucket")
    sums = sums.withColumn("upto", F.sum("held").over(in_leaf))
    edges = sums.select(
        *names, "bucket", (F.col("upto") - F.col("held")).alias("before"),
        F.when((F.col("rest") <= 0) | (F.col("upto") - F.col("held") > F.col("rest")), F.lit(0))
        .when(F.col("upto") <= F.col("rest"), F.lit(1)).alias("all"),
    )
    edges = materialize(edges, "leaf-buckets")
    marked = drawn.join(edges, [*names, "bucket"])
    sure = marked.where(F.col("all").isNotNull()).withColumn("more", F.col("all"))
    inside = Window.partitionBy(*names, "bucket").orderBy("draw")
    cut = marked.where(F.col("all").isNull())
    cut = cut.withColumn("more", (F.col("before") + F.sum("tokens").over(inside) <= F.col("rest")).cast("int"))
    out = sure.unionByName(cut)
    return out.select("id", "text_hash", *[F.col(n).alias(c) for n, c in zip(names, levels)], "tokens",
                      (F.col("whole") + F.col("more")).alias("epochs"))
