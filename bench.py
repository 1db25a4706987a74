"""Time the headline queries and print one JSON line.

BENCH_SF_DIR is the folder of tables (default /root/testdata/sf0.1), BENCH_CPUS the
number of local threads (default 8).  Every query first runs once on the smallest
tables, so that the times do not include the start of the JVM and of the Python
workers; then it is timed once, reading from Parquet and computing every row.
"""

from __future__ import annotations

import json
import os
import sys
import time
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

sys.path.insert(0, str(Path(__file__).resolve().parent))

from silo_analytics import RunConfig  # noqa: E402
from silo_analytics.plans import orders  # noqa: E402
from silo_analytics.plans.orchestrate import prepare  # noqa: E402
from silo_analytics.plans.strategies import run_linear  # noqa: E402
from silo_analytics.queries import QUERIES  # noqa: E402

HEADLINE = (
    "cohort_features", "max_row_per_key", "exact_quantiles", "stratified_split", "skew_partition", "augment_groups",
    "prep_transform", "auroc_pooled", "bootstrap_auroc", "param_average", "grouped_lr_at_optimum",
    "fedavg_region", "gated_hospital", "strategy_summary", "regional_comparison",
)


def augmented_fit(spark: SparkSession, folder: str) -> DataFrame:
    """Fill every silo up to 7,440 rows, 186,000 in all, and fit the pooled model with its cross-validation."""
    cfg = RunConfig(strategies=(1,), augment_target_per_hosp=7_440)
    cohort = orders.build_orders_cohort(orders.load_tables(spark, folder))
    return run_linear(prepare(cohort, orders.ORDERS, cfg)[0], (1,)).metrics


# Like for like with the known times: not registered, because its size is fixed by the target.
EXTRA = {"augmented_fit_186k": augmented_fit}


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("bench")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "8g")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    small = Path(folder).parent / "sf0.001"
    times: dict[str, float] = {}
    for name, query in {**{n: QUERIES[n] for n in HEADLINE}, **EXTRA}.items():
        if small.exists() and str(small) != folder and name not in EXTRA:
            query(spark, str(small)).write.format("noop").mode("overwrite").save()
        start = time.perf_counter()
        query(spark, folder).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
    scale = Path(folder).name.removeprefix("sf")
    print(
        json.dumps(
            {
                "metric": "headline_queries_total",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                "sf": float(scale) if scale.replace(".", "", 1).isdigit() else folder,
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
