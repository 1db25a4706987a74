import math
from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry

FOLDER = Path("/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
CHECKED = (
    "cohort_features max_row_per_key quantile_flags region_split stratified_folds skew_partition augment_groups "
    "prep_transform split_with_null_labels region_split_with_null_regions metrics_with_null_scores prep_with_nan "
    "cv_lr_at_optimum pooled_lr_at_optimum averages_of_optima proximal_at_optimum cluster_by_nearest_centre score_by_silo auroc_by_group bootstrap_auroc param_average best_of_uplift model_load "
    "second_visit_label any_case_scan csv_convert bank_run cluster_strategy wide_lr_at_optimum"
)
pytestmark = pytest.mark.skipif(not FOLDER.exists(), reason="driver tables are not here")


def plain(rows):
    def one(v):
        if v is None or isinstance(v, float) and math.isnan(v):
            return "None"
        return str(v) if isinstance(v, (str, bool)) else repr(float(v) + 0.0)

    return sorted(tuple(one(v) for v in row) for row in rows)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES.split():
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{FOLDER}/{t}.parquet')")
    return con


@pytest.mark.parametrize("name", CHECKED.split())
def test_query_gives_the_rows_of_its_sql(spark, duck, name):
    ours = entry.queries()[name](spark, str(FOLDER))
    columns = sorted(ours.columns)
    result = duck.execute(entry.oracle_sql()[name])
    theirs = [d[0] for d in result.description]
    assert sorted(theirs) == columns
    order = [theirs.index(c) for c in columns]
    assert plain(ours.select(*columns).collect()) == plain([[r[i] for i in order] for r in result.fetchall()])


def test_entry_runs(spark):
    assert entry.entry(spark).count() == 150
    assert set(entry.oracle_sql()) <= set(entry.queries())
