import numpy as np
import pytest

from silo_analytics.plans.cohort import build_icu_cohort
from silo_analytics.sources.datasets import ICU, ICU_TABLES


@pytest.fixture(scope="module")
def tables(spark):
    rows = {
        "patient": [
            # subject, stay, visit, age, gender, source, discharge, unit, hospital, weight
            ("p1", 1, 1, "> 89", "Male", "Operating Room", "Telemetry", "MICU", 1, 70.0),
            ("p1", 2, 2, "> 89", "Male", None, None, "MICU", 1, 70.0),
            ("p2", 3, 1, "45", None, "Emergency", None, "Unknown ICU", 2, None),
            ("p3", 4, 1, None, "Female", "Recovery Room", "Home", None, 99, 60.0),
            ("p4", 5, 1, "x", "Male", None, "Other", "SICU", None, 80.0),
        ],
        "hospital": [(1, "West", "t", ">= 500"), (2, None, None, None)],
        "apachePatientResult": [
            (1, 10.0, 1.0, 2.0, 3.0, 0.1), (1, 30.0, 2.0, 4.0, 5.0, 0.2), (3, 20.0, 3.0, 1.0, 9.0, 0.3),
            (4, 50.0, 1.0, 8.0, 8.0, 0.4), (4, None, 7.0, 7.0, 7.0, 0.7),
        ],
        "diagnosis": [(1,), (1,), (3,)],
        "medication": [(1, None), (1, "Yes"), (1, "No"), (3, "Yes")],
        "pastHistory": [(1, "NoHealthProblems"), (1, None), (3, "x"), (3, "y")],
    }
    return {t: spark.createDataFrame(r, ICU_TABLES[t]) for t, r in rows.items()}


def test_icu_cohort(tables):
    rows = {r.patientunitstayid: r for r in build_icu_cohort(tables).collect()}
    assert sorted(rows) == [1, 3, 4, 5]
    a, b, c, d = rows[1], rows[3], rows[4], rows[5]
    assert [r.readmitted for r in (a, b, c, d)] == [1, 0, 0, 0]
    assert [r.age_num for r in (a, b, c, d)] == [90.0, 45.0, None, None]
    assert [r.is_male for r in (a, b, c, d)] == [1, 0, 0, 1]
    assert [r.is_elective for r in (a, b, c, d)] == [1, 0, 1, 0]
    assert [r.high_risk_discharge for r in (a, b, c, d)] == [1, 0, 0, 1]
    assert [r.unittype_enc for r in (a, b, c, d)] == [0, -1, -1, 1]
    # a result without a score beats the scored one
    assert [r.apachescore for r in (a, b, c, d)] == [30.0, 20.0, None, None]
    assert c.actualiculos == 7.0
    assert [r.diagnosis_count for r in (a, b, c, d)] == [2, 1, 0, 0]
    assert [r.medication_count for r in (a, b, c, d)] == [2, 0, 0, 0]
    assert [r.comorbidity_count for r in (a, b, c, d)] == [1, 2, 0, 0]
    # an unknown hospital leaves nulls, a known one with unknown values gets defaults
    assert [r.is_teaching for r in (a, b, c, d)] == [1, 0, None, None]
    assert [r.bed_size_enc for r in (a, b, c, d)] == [3, 1, None, None]
    assert [r.teaching_bed_interaction for r in (a, b, c, d)] == [3, 0, None, None]
    assert [r.apache_los_interaction for r in (a, b, c, d)] == [120.0, 20.0, 0.0, 0.0]
    assert [r.severity_age for r in (a, b, c, d)] == [2700.0, 900.0, 0.0, 0.0]
    assert [r.med_diag_ratio for r in (a, b, c, d)] == pytest.approx([2 / 3, 0, 0, 0])
    q_score, q_stay = np.quantile([30, 20], 0.75), np.quantile([4, 1, 7], 0.75)
    assert [r.high_risk_apache for r in (a, b, c, d)] == [int(v > q_score) for v in (30, 20, 0, 0)]
    assert [r.long_stay for r in (a, b, c, d)] == [int(v > q_stay) for v in (4, 1, 7, 0)]
    assert [r.comorbidity_severity for r in (a, b, c, d)] == [30.0, 40.0, 0.0, 0.0]
    assert set(ICU.features) <= set(a.asDict())


def test_scored_rows_first(tables):
    rows = {r.patientunitstayid: r for r in build_icu_cohort(tables, nulls="last").collect()}
    assert rows[4].apachescore == 50.0 and rows[4].actualiculos == 8.0


def test_statistics_from_chosen_rows(tables):
    from pyspark.sql import functions as F

    rows = build_icu_cohort(tables, stats_filter=F.col("patientunitstayid") == 3).collect()
    assert {r.patientunitstayid: r.high_risk_apache for r in rows} == {1: 1, 3: 0, 4: 0, 5: 0}
