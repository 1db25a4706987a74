"""One labelled feature row per first visit, from six raw tables."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import scalar as S
from ..operators.quantiles import exact_quantiles
from ..operators.relational import attach, count_per_key, mark_exists, max_row_per_key
from ..scratch import materialize
from ..sources.datasets import BED_BANDS, ELECTIVE_SOURCES, HIGH_RISK_DISCHARGES, UNIT_TYPES

STAY = "patientunitstayid"
SCORES = (
    "apachescore", "acutephysiologyscore", "actualiculos", "actualhospitallos",
    "predictedhospitalmortality",
)


def first_visits(patient: DataFrame) -> DataFrame:
    """First visits with label and the flags that come from the visit itself."""
    first = patient.filter(F.col("unitvisitnumber") == 1)
    second = patient.filter(F.col("unitvisitnumber") == 2)
    labelled = mark_exists(first, second, "uniquepid", "readmitted")
    return labelled.withColumns(
        {
            "age_num": S.to_number(F.col("age"), {"> 89": "90"}),
            "is_male": S.flag_equals(F.col("gender"), "Male"),
            "is_elective": S.flag_in(F.col("hospitaladmitsource"), ELECTIVE_SOURCES),
            "high_risk_discharge": S.flag_in(F.col("unitdischargelocation"), HIGH_RISK_DISCHARGES),
            "unittype_enc": S.encode(F.col("unittype"), UNIT_TYPES, -1),
        }
    )


def hospital_context(hospital: DataFrame) -> DataFrame:
    """Encoded before the join, so an unknown hospital leaves nulls, not defaults."""
    return hospital.select(
        "hospitalid",
        "region",
        S.flag_equals(F.col("teachingstatus"), "t").alias("is_teaching"),
        S.encode(F.col("numbedscategory"), BED_BANDS, 1).alias("bed_size_enc"),
    )


def build_icu_cohort(
    tables: Mapping[str, DataFrame], nulls: str = "first", stats_filter=None
) -> DataFrame:
    """Cohort table of the intensive-care dataset.

    ``nulls`` as in :func:`max_row_per_key`; the other scores break ties.
    ``stats_filter`` (a condition on the cohort) restricts the rows that the
    median and the quartiles are taken from; by default all rows count.
    """
    result = tables["apachePatientResult"]
    best = max_row_per_key(result, STAY, SCORES[0], SCORES[1:], SCORES, nulls)
    kept_drugs = S.differs_or_null(F.col("drugordercancelled"), "Yes")
    kept_history = S.differs_or_null(F.col("pasthistoryvaluetext"), "NoHealthProblems")

    # written once: the statistics and the cohort both read it
    df = materialize(attach(first_visits(tables["patient"]), best, STAY), "first-visits")
    scored = df
    for table, name, keep in (
        ("diagnosis", "diagnosis_count", None),
        ("medication", "medication_count", kept_drugs),
        ("pastHistory", "comorbidity_count", kept_history),
    ):
        df = attach(df, count_per_key(tables[table], STAY, name, keep), STAY, zero=[name])
    df = attach(df, hospital_context(tables["hospital"]), "hospitalid")

    base = scored if stats_filter is None else df.filter(stats_filter)
    cut = exact_quantiles(
        base, {"age_num": (0.5,), "apachescore": (0.75,), "actualiculos": (0.75,)}
    )
    score, stay = F.col("apachescore"), F.col("actualiculos")
    age = F.coalesce(F.col("age_num"), F.lit(cut["age_num", 0.5]).cast("double"))
    return df.withColumns(
        {
            "apache_los_interaction": S.zero_product(score, stay),
            "severity_age": F.coalesce(score, F.lit(0.0)) * age,
            "med_diag_ratio": S.smoothed_ratio(F.col("medication_count"), F.col("diagnosis_count")),
            "high_risk_apache": S.flag_above(score, cut["apachescore", 0.75]),
            "long_stay": S.flag_above(stay, cut["actualiculos", 0.75]),
            "comorbidity_severity": F.col("comorbidity_count") * F.coalesce(score, F.lit(0.0)),
            "teaching_bed_interaction": S.product(F.col("is_teaching"), F.col("bed_size_enc")),
        }
    )
