import pytest
from pyspark.sql import functions as F

from silo_analytics.functions import scalar as S


def values(spark, rows, schema, expr):
    return [r[0] for r in spark.createDataFrame(rows, schema).select(expr).collect()]


def test_flags_read_null_as_zero(spark):
    rows = [("Male",), ("Female",), (None,)]
    assert values(spark, rows, "x string", S.flag_equals(F.col("x"), "Male")) == [1, 0, 0]
    assert values(spark, rows, "x string", S.flag_in(F.col("x"), ["Male", "Female"])) == [1, 1, 0]
    assert values(spark, rows, "x string", S.flag_equals_folded(F.col("x"), "MALE")) == [1, 0, 0]
    assert values(spark, [(2.0,), (0.0,), (None,)], "x double", S.flag_positive(F.col("x"))) == [1, 0, 0]


def test_encode_falls_back(spark):
    rows = [("MICU",), ("unknown",), (None,)]
    assert values(spark, rows, "x string", S.encode(F.col("x"), {"MICU": 0}, -1)) == [0, -1, -1]


def test_differs_or_null_keeps_null(spark):
    rows = [("Yes",), ("No",), (None,)]
    assert values(spark, rows, "x string", S.differs_or_null(F.col("x"), "Yes")) == [False, True, True]


@pytest.mark.parametrize(
    "text, number",
    [("> 89", 90.0), ("45", 45.0), (" 45 ", 45.0), ("1e2", 100.0), ("", None), ("x", None), ("45d", None), (None, None)],
)
def test_to_number(spark, text, number):
    assert values(spark, [(text,)], "x string", S.to_number(F.col("x"), {"> 89": "90"})) == [number]


def test_products_and_ratios(spark):
    rows = [(2.0, 3.0), (None, 3.0), (2.0, None)]
    schema = "a double, b double"
    a, b = F.col("a"), F.col("b")
    assert values(spark, rows, schema, S.zero_product(a, b)) == [6.0, 0.0, 0.0]
    assert values(spark, rows, schema, S.product(a, b)) == [6.0, None, None]
    assert values(spark, rows, schema, S.smoothed_ratio(a, b)) == [0.5, None, None]
    rows = [(10.0, 0.0), (10.0, None), (10.0, 4.0), (None, 4.0)]
    assert values(spark, rows, schema, S.guarded_ratio(a, b)) == [0.0, 0.0, 2.0, None]


def test_a_ratio_over_zero_is_infinite(spark):
    rows = [(2.0, -1.0), (-2.0, -1.0), (0.0, -1.0), (None, -1.0), (2.0, 3.0)]
    a, b = F.col("a"), F.col("b")
    found = values(spark, rows, "a double, b double", S.smoothed_ratio(a, b))
    assert found[:2] == [float("inf"), float("-inf")] and found[2] != found[2] and found[3:] == [None, 0.5]
    assert values(spark, rows, "a double, b double", S.guarded_ratio(a, b)) == [0.0, 0.0, 0.0, 0.0, 0.5]


def test_flag_above_is_strict_and_safe(spark):
    rows = [(1.0,), (2.0,), (None,)]
    assert values(spark, rows, "x double", S.flag_above(F.col("x"), 1.0)) == [0, 1, 0]
    assert values(spark, rows, "x double", S.flag_above(F.col("x"), None)) == [0, 0, 0]
