"""The same cohort roles on the order tables: one row per customer with a first order.

subject = customer, visit = order, stay = first order, hospital = nation,
region = region of the nation.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalar as S
from ..operators.quantiles import exact_quantiles
from ..operators.relational import attach, count_per_key, first_rows
from ..scratch import materialize
from ..spec import DatasetSpec

TABLES = ("region", "nation", "customer", "orders", "lineitem", "events", "documents", "labels")
STATUS_CODES = {"F": 0, "O": 1, "P": 2}
URGENT = ("1-URGENT", "2-HIGH")
WINDOW_DAYS = 90

ORDERS = DatasetSpec(
    name="orders",
    features=(
        "acct_bal", "is_building", "is_urgent", "status_enc", "total_price", "top_price", "top_qty",
        "top_discount", "line_count", "kept_count", "event_count", "price_x_lines", "kept_ratio",
        "high_price",
    ),
    label="label",
    key="id",
    hospital="silo",
    augment=True,
)


def load_tables(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    return {t: spark.read.parquet(f"{folder}/{t}.parquet") for t in TABLES}


def first_orders(orders: DataFrame) -> DataFrame:
    """First order of each customer, and whether the next one came within the window."""
    columns = ("o_orderkey", "o_orderdate", "o_orderstatus", "o_orderpriority", "o_totalprice")
    two = first_rows(orders.select("o_custkey", *columns), "o_custkey", ("o_orderdate", "o_orderkey"), 2, "visit")
    first = F.col("visit") == 1
    firsts = two.groupBy("o_custkey").agg(
        *[F.max(F.when(first, F.col(c))).alias(c) for c in columns],
        F.max(F.when(~first, F.col("o_orderdate"))).alias("next_date"),
    )
    soon = F.col("next_date") <= F.col("o_orderdate") + F.expr(f"INTERVAL {WINDOW_DAYS} DAYS")
    return firsts.withColumn("label_a", F.coalesce(soon, F.lit(False)).cast("int"))


def order_lines(lineitem: DataFrame) -> DataFrame:
    """Per order: line counts, the dearest line and whether any line was returned."""
    price = F.col("l_extendedprice")
    # of equally dear lines the one of the larger number counts
    rank = F.when(price.isNotNull(), F.struct(price, "l_linenumber"))
    return lineitem.groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(
        F.count(F.lit(1)).alias("line_count"),
        F.count_if(S.differs_or_null(F.col("l_returnflag"), "R")).alias("kept_count"),
        F.max(price).alias("top_price"),
        F.max_by("l_quantity", rank).alias("top_qty"),
        F.max_by("l_discount", rank).alias("top_discount"),
        F.max(S.flag_equals(F.col("l_returnflag"), "R")).alias("label_b"),
    )


def nation_context(nation: DataFrame, region: DataFrame) -> DataFrame:
    return nation.join(region, nation.n_regionkey == region.r_regionkey).select(
        F.col("n_nationkey").alias("silo"), F.col("r_name").alias("region_name")
    )


def build_orders_cohort(tables: Mapping[str, DataFrame], label: str = "label_b") -> DataFrame:
    """Cohort table with the columns of ``ORDERS``; ``label_a`` and ``label_b`` are kept.

    Customers whose number ends in 0 in the Middle East have no region.
    """
    base = first_orders(tables["orders"]).withColumnRenamed("o_custkey", "id")
    counted = ["line_count", "kept_count", "label_b"]
    # written once: the lines are read for the quartile and for the cohort
    base = materialize(attach(base, order_lines(tables["lineitem"]), "o_orderkey", zero=counted), "first-orders")
    cut = exact_quantiles(base, {"top_price": (0.75,)})["top_price", 0.75]
    people = tables["customer"].select(
        F.col("c_custkey").alias("id"),
        F.col("c_nationkey").alias("silo"),
        F.col("c_acctbal").alias("acct_bal"),
        S.flag_equals(F.col("c_mktsegment"), "BUILDING").alias("is_building"),
    )
    df = attach(base, people, "id")
    happened = S.differs_or_null(F.col("event_type"), "error")
    events = count_per_key(tables["events"].withColumnRenamed("user_id", "id"), "id", "event_count", happened)
    df = attach(df, events, "id", zero=["event_count"])
    df = attach(df, nation_context(tables["nation"], tables["region"]), "silo")

    top = F.col("top_price")
    no_region = (F.col("id") % 10 == 0) & (F.col("region_name") == "MIDDLE EAST")
    return df.select(
        "id",
        "silo",
        F.when(~F.coalesce(no_region, F.lit(False)), F.col("region_name")).alias("region"),
        F.col(label).cast("int").alias("label"),
        F.col("label_a").cast("int").alias("label_a"),
        F.col("label_b").cast("int").alias("label_b"),
        "acct_bal",
        "is_building",
        S.flag_in(F.col("o_orderpriority"), URGENT).alias("is_urgent"),
        S.encode(F.col("o_orderstatus"), STATUS_CODES, -1).alias("status_enc"),
        F.col("o_totalprice").alias("total_price"),
        "top_price",
        "top_qty",
        "top_discount",
        "line_count",
        "kept_count",
        "event_count",
        S.zero_product(top, F.col("line_count").cast("double")).alias("price_x_lines"),
        S.smoothed_ratio(F.col("kept_count"), F.col("line_count")).alias("kept_ratio"),
        S.flag_above(top, cut).alias("high_price"),
    )
