"""Registered queries on the driver tables and the SQL that gives the same rows.

Each query is a pair: a function (spark, folder) -> DataFrame built from the
operators, and SQL for an independent engine.  Queries that train models have no
SQL.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import scalar as S
from .functions.hashing import hash_uniform
from .functions.vectors import constant, dense, probability
from .operators import (
    augment,
    averaging,
    bootstrap,
    clustering,
    compare,
    logistic,
    metrics,
    neural,
    prep,
    quantiles,
    ranking,
    relational,
    sampling,
    store,
)
from .plans import orders as O
from .plans.clusters import run_clusters
from .plans.cohort import build_icu_cohort
from .plans.orchestrate import SUMMARY, prepare, run
from .plans.regional import compare_regions
from .plans.strategies import averaging_rounds, run_linear, run_mlp
from .schemas import schema
from .scratch import materialize, scratch_path
from .sources import datasets
from .sources.convert import convert_csv, read_converted
from .sources import tables as src
from .spec import RunConfig

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def register(fn: Query) -> Query:
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return register


# ------------------------------------------------------------------ shared inputs
def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def base(spark: SparkSession, folder: str) -> DataFrame:
    """One row per order: silo = nation, region, label = urgent, two numbers and a flag."""
    t = {n: table(spark, folder, n) for n in ("orders", "customer", "nation", "region")}
    people = t["customer"].select(
        F.col("c_custkey").alias("cust"), F.col("c_nationkey").alias("silo"), F.col("c_acctbal").alias("bal"),
        S.flag_equals(F.col("c_mktsegment"), "BUILDING").alias("building"),
    )
    rows = t["orders"].select(
        F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("cust"),
        S.flag_in(F.col("o_orderpriority"), O.URGENT).alias("label"), F.col("o_totalprice").alias("price"),
        F.col("o_orderstatus").alias("status"),
    )
    joined = relational.attach(rows, people, "cust")
    joined = relational.attach(joined, O.nation_context(t["nation"], t["region"]), "silo")
    lacking = F.coalesce((F.col("cust") % 10 == 0) & (F.col("region_name") == "MIDDLE EAST"), F.lit(False))
    return joined.select(
        "id", "cust", "silo", F.when(~lacking, F.col("region_name")).alias("region"), "label", "price", "status",
        "bal", "building",
    )


def U(seed: int, salt: str, *keys: str) -> str:
    """SQL text of ``hash_uniform``."""
    parts = ", ".join(f"coalesce(cast({k} AS VARCHAR), '')" for k in keys)
    text = f"md5(concat_ws('|', '{seed}', '{salt}', {parts}))"
    return f"(('0x' || substr({text}, 1, 13))::BIGINT / 4503599627370496::DOUBLE)"


def scored(df: DataFrame) -> DataFrame:
    """A score with ties that leans on the label."""
    raw = (
        F.col("price") / 500000.0 * 0.6
        + hash_uniform(1, "score", "id") * 0.3
        + F.col("label") * 0.1
    )
    return df.withColumn("score", F.floor(raw * 1000.0) / 1000.0)


BASE = """
base AS (
  SELECT o.o_orderkey AS id, o.o_custkey AS cust, c.c_nationkey AS silo,
    CASE WHEN o.o_custkey % 10 = 0 AND r.r_name = 'MIDDLE EAST' THEN NULL ELSE r.r_name END AS region,
    CASE WHEN o.o_orderpriority IN ('1-URGENT', '2-HIGH') THEN 1 ELSE 0 END AS label,
    o.o_totalprice AS price, o.o_orderstatus AS status, c.c_acctbal AS bal,
    CASE WHEN c.c_mktsegment = 'BUILDING' THEN 1 WHEN c.c_custkey IS NULL THEN NULL ELSE 0 END AS building
  FROM orders o
  LEFT JOIN customer c ON o.o_custkey = c.c_custkey
  LEFT JOIN nation n ON c.c_nationkey = n.n_nationkey
  LEFT JOIN region r ON n.n_regionkey = r.r_regionkey
)"""
SCORED = BASE + f""",
scored AS (
  SELECT *, floor((price / 500000.0::DOUBLE * 0.6::DOUBLE + {U(1, 'score', 'id')} * 0.3::DOUBLE
    + label * 0.1::DOUBLE) * 1000.0::DOUBLE) / 1000.0::DOUBLE AS score
  FROM base
)"""
COHORT = f"""
visits AS (
  SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS visit FROM orders
),
firsts AS (
  SELECT a.*, CASE WHEN b.o_orderdate <= a.o_orderdate + INTERVAL {O.WINDOW_DAYS} DAY THEN 1 ELSE 0 END AS label_a
  FROM (SELECT * FROM visits WHERE visit = 1) a
  LEFT JOIN (SELECT * FROM visits WHERE visit = 2) b ON a.o_custkey = b.o_custkey
),
lines AS (
  SELECT l_orderkey, count(*) AS line_count,
    count(*) FILTER (WHERE l_returnflag IS DISTINCT FROM 'R') AS kept_count,
    max(l_extendedprice) AS top_price, arg_max(l_quantity, l_extendedprice) AS top_qty,
    arg_max(l_discount, l_extendedprice) AS top_discount,
    max(CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END) AS label_b
  FROM lineitem GROUP BY l_orderkey
),
happened AS (
  SELECT user_id, count(*) AS event_count FROM events WHERE event_type IS DISTINCT FROM 'error' GROUP BY user_id
),
cut AS (
  SELECT quantile_cont(top_price, 0.75) AS q FROM firsts LEFT JOIN lines ON o_orderkey = l_orderkey
),
cohort AS (
  SELECT f.o_custkey AS id, c.c_nationkey AS silo,
    CASE WHEN f.o_custkey % 10 = 0 AND r.r_name = 'MIDDLE EAST' THEN NULL ELSE r.r_name END AS region,
    coalesce(l.label_b, 0) AS label, f.label_a, coalesce(l.label_b, 0) AS label_b,
    c.c_acctbal AS acct_bal, CASE WHEN c.c_mktsegment = 'BUILDING' THEN 1 ELSE 0 END AS is_building,
    CASE WHEN f.o_orderpriority IN ('1-URGENT', '2-HIGH') THEN 1 ELSE 0 END AS is_urgent,
    CASE f.o_orderstatus WHEN 'F' THEN 0 WHEN 'O' THEN 1 WHEN 'P' THEN 2 ELSE -1 END AS status_enc,
    f.o_totalprice AS total_price, l.top_price, l.top_qty, l.top_discount,
    coalesce(l.line_count, 0) AS line_count, coalesce(l.kept_count, 0) AS kept_count,
    coalesce(h.event_count, 0) AS event_count,
    coalesce(l.top_price, 0) * coalesce(l.line_count, 0) AS price_x_lines,
    coalesce(l.kept_count, 0) / (coalesce(l.line_count, 0) + 1) AS kept_ratio,
    CASE WHEN coalesce(l.top_price, 0) > (SELECT q FROM cut) THEN 1 ELSE 0 END AS high_price
  FROM firsts f
  LEFT JOIN customer c ON f.o_custkey = c.c_custkey
  LEFT JOIN lines l ON f.o_orderkey = l.l_orderkey
  LEFT JOIN happened h ON f.o_custkey = h.user_id
  LEFT JOIN nation n ON c.c_nationkey = n.n_nationkey
  LEFT JOIN region r ON n.n_regionkey = r.r_regionkey
)"""


def rounded(df: DataFrame, **digits: int) -> DataFrame:
    return df.withColumns({c: F.round(c, d) for c, d in digits.items()})


# ------------------------------------------------------------------ cohort
@query("cohort_features", f"""WITH {COHORT}
SELECT * REPLACE (round(price_x_lines, 2) AS price_x_lines, round(kept_ratio, 6) AS kept_ratio) FROM cohort""")
def cohort_features(spark, folder):
    return rounded(O.build_orders_cohort(O.load_tables(spark, folder)), price_x_lines=2, kept_ratio=6)


@query("second_visit_label", """
WITH v AS (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS visit
  FROM orders)
SELECT o_custkey, o_orderkey,
  CASE WHEN o_custkey IN (SELECT o_custkey FROM v WHERE visit = 2) THEN 1 ELSE 0 END AS returned
FROM v WHERE visit = 1""")
def second_visit_label(spark, folder):
    orders = table(spark, folder, "orders").select("o_custkey", "o_orderkey", "o_orderdate")
    marked = relational.first_row_marked(orders, "o_custkey", ("o_orderdate", "o_orderkey"), ("o_orderkey",), "returned")
    return marked.select("o_custkey", "o_orderkey", "returned")


def _priced(spark, folder):
    lines = table(spark, folder, "lineitem")
    return lines.withColumn("score", F.when(F.col("l_quantity") <= 45, F.col("l_extendedprice")))


_TIES = ["l_linenumber", "l_partkey", "l_suppkey"]
_MAX_ROW = """
WITH p AS (SELECT *, CASE WHEN l_quantity <= 45 THEN l_extendedprice END AS score FROM lineitem)
SELECT l_orderkey, score, l_linenumber, l_quantity, l_discount FROM (
  SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY score DESC NULLS {nulls}, l_linenumber DESC, l_partkey DESC, l_suppkey DESC) AS r FROM p)
WHERE r = 1"""


@query("max_row_per_key", _MAX_ROW.format(nulls="FIRST"))
def max_row_per_key(spark, folder):
    return relational.max_row_per_key(
        _priced(spark, folder), "l_orderkey", "score", _TIES, ["l_linenumber", "l_quantity", "l_discount"]
    )


@query("max_row_scored_first", _MAX_ROW.format(nulls="LAST"))
def max_row_scored_first(spark, folder):
    return relational.max_row_per_key(
        _priced(spark, folder), "l_orderkey", "score", _TIES,
        ["l_linenumber", "l_quantity", "l_discount"], nulls="last",
    )


@query("null_keeping_counts", """
WITH e AS (SELECT user_id, nullif(event_type, (SELECT min(event_type) FROM events)) AS kind FROM events)
SELECT user_id, count(*) AS kept FROM e WHERE kind IS DISTINCT FROM 'error' GROUP BY user_id""")
def null_keeping_counts(spark, folder):
    events = table(spark, folder, "events")
    first = events.agg(F.min("event_type").alias("m")).first().m
    kinds = events.withColumn("kind", F.nullif("event_type", F.lit(first)))
    return relational.count_per_key(kinds, "user_id", "kept", S.differs_or_null(F.col("kind"), "error"))


@query("dim_encode_join", """
SELECT c_custkey, d.code, d.is_first FROM customer c LEFT JOIN (
  SELECT n_nationkey, CASE r_name WHEN 'AFRICA' THEN 0 WHEN 'AMERICA' THEN 1 WHEN 'EUROPE' THEN 2 ELSE -1 END AS code,
    CASE WHEN n_nationkey = 0 THEN 1 ELSE 0 END AS is_first
  FROM nation JOIN region ON n_regionkey = r_regionkey WHERE r_name <> 'ASIA') d ON c.c_nationkey = d.n_nationkey""")
def dim_encode_join(spark, folder):
    dim = table(spark, folder, "nation").join(table(spark, folder, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    dim = dim.filter(F.col("r_name") != "ASIA").select(
        F.col("n_nationkey").alias("c_nationkey"),
        S.encode(F.col("r_name"), {"AFRICA": 0, "AMERICA": 1, "EUROPE": 2}, -1).alias("code"),
        S.flag_equals(F.col("n_nationkey"), 0).alias("is_first"),
    )
    people = table(spark, folder, "customer").select("c_custkey", "c_nationkey")
    return relational.attach(people, dim, "c_nationkey").select("c_custkey", "code", "is_first")


@query("quantile_flags", """
WITH p AS (SELECT l_orderkey, l_linenumber, CASE WHEN l_quantity <= 45 THEN l_extendedprice END AS x FROM lineitem),
q AS (SELECT quantile_cont(x, 0.75) AS t FROM p)
SELECT l_orderkey, l_linenumber, CASE WHEN coalesce(x, 0) > (SELECT t FROM q) THEN 1 ELSE 0 END AS high FROM p""")
def quantile_flags(spark, folder):
    rows = _priced(spark, folder)
    cut = quantiles.exact_quantiles(rows, {"score": (0.75,)})["score", 0.75]
    return rows.select("l_orderkey", "l_linenumber", S.flag_above(F.col("score"), cut).alias("high"))


@query("exact_quantiles", " UNION ALL ".join(
    f"SELECT '{c}' AS column_name, {p}::DOUBLE AS p, round(quantile_cont({c}, {p}), 4) AS value FROM lineitem"
    for c in ("l_extendedprice", "l_quantity") for p in (0.1, 0.5, 0.75)
))
def exact_quantiles(spark, folder):
    asks = {"l_extendedprice": (0.1, 0.5, 0.75), "l_quantity": (0.1, 0.5, 0.75)}
    got = quantiles.exact_quantiles(table(spark, folder, "lineitem"), asks)
    rows = [(c, p, v) for (c, p), v in got.items()]
    return rounded(spark.createDataFrame(rows, "column_name string, p double, value double"), value=4)


def _holes(df: DataFrame) -> DataFrame:
    return df.withColumn("price", F.when(F.col("id") % 7 != 0, F.col("price")))


_HOLES = BASE + ", holes AS (SELECT * REPLACE (CASE WHEN id % 7 <> 0 THEN price END AS price) FROM base)"


@query("median_fill", f"""WITH {_HOLES}
SELECT id, round(coalesce(price, (SELECT median(price) FROM holes)), 4) AS price FROM holes""")
def median_fill(spark, folder):
    return rounded(prep.fill_medians(_holes(base(spark, folder)), ["price"]).select("id", "price"), price=4)


@query("label_profile", f"""WITH {BASE}
SELECT silo, count(*) AS n, sum(label)::BIGINT AS n_pos, round(avg(label::DOUBLE) * 100, 1) AS rate_pct FROM base GROUP BY silo""")
def label_profile(spark, folder):
    return relational.label_profile(base(spark, folder), "label", ["silo"])


@query("group_size_gate", f"""WITH {BASE}
SELECT *, n >= 600 AND n_pos >= 2 AND n_neg >= 2 AS candidate, n < 5 OR n_pos < 1 OR n_neg < 1 AS skipped FROM (
  SELECT silo, count(label) AS n, sum(label)::BIGINT AS n_pos, count(*) FILTER (WHERE label = 0) AS n_neg
  FROM base WHERE silo IS NOT NULL GROUP BY silo)""")
def group_size_gate(spark, folder):
    stats = relational.group_label_counts(base(spark, folder), "silo", "label")
    return relational.trainable(relational.size_gate(stats, 600, 2, 2))


@query("group_size_profile", """
SELECT count(*) AS groups, round(avg(n), 6) AS mean_size, min(n) AS min_size FROM (
  SELECT o_custkey, count(*) AS n FROM orders WHERE o_custkey IS NOT NULL GROUP BY 1)""")
def group_size_profile(spark, folder):
    return rounded(relational.group_size_profile(table(spark, folder, "orders"), "o_custkey"), mean_size=6)


@query("distinct_groups", f"WITH {BASE} SELECT DISTINCT coalesce(region, 'Unknown') AS region FROM base")
def distinct_groups(spark, folder):
    return relational.distinct_keys(base(spark, folder).withColumn("region", S.relabel_null(F.col("region"))), "region")


@query("hospital_profile", f"""WITH {BASE}
SELECT silo, count(label) AS n, round(avg(label::DOUBLE), 6) AS rate, max(building)::DOUBLE AS building, round(max(bal), 4) AS bal
FROM base WHERE silo IS NOT NULL GROUP BY silo""")
def hospital_profile(spark, folder):
    out = relational.hospital_profile(base(spark, folder), "silo", "label", ["building", "bal"])
    return rounded(out, rate=6, bal=4)


def _icu_tables(spark, folder) -> dict[str, DataFrame]:
    """The six tables of the intensive-care cohort, derived from the order tables."""
    orders = table(spark, folder, "orders")
    visits = relational.first_rows(
        orders.select("o_custkey", "o_orderkey", "o_orderdate", "o_orderstatus", "o_orderpriority", "o_totalprice"),
        "o_custkey", ("o_orderdate", "o_orderkey"), 2, "visit",
    )
    lines = table(spark, folder, "lineitem").withColumnRenamed("l_orderkey", "patientunitstayid")
    wards = table(spark, folder, "nation").join(table(spark, folder, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return {
        "patient": visits.selectExpr(*[f"{e} AS {n}" for n, e in _ICU_PATIENT.items()]),
        "hospital": wards.selectExpr(*[f"{e} AS {n}" for n, e in _ICU_HOSPITAL.items()]),
        "apachePatientResult": lines.selectExpr("patientunitstayid", *[f"{e} AS {n}" for n, e in _ICU_RESULT.items()]),
        "diagnosis": lines.select("patientunitstayid"),
        "medication": lines.selectExpr("patientunitstayid", f"{_ICU_DRUG} AS drugordercancelled"),
        "pastHistory": lines.selectExpr("patientunitstayid", f"{_ICU_PAST} AS pasthistoryvaluetext"),
    }


_ICU_PATIENT = {
    "uniquepid": "cast(o_custkey AS string)",
    "patientunitstayid": "o_orderkey",
    "unitvisitnumber": "visit",
    "age": "CASE WHEN o_custkey % 13 = 0 THEN '> 89' WHEN o_custkey % 7 = 0 THEN NULL ELSE cast(o_custkey % 80 + 18 AS string) END",
    "gender": "CASE o_orderstatus WHEN 'F' THEN 'Female' WHEN 'O' THEN 'Male' END",
    "hospitaladmitsource": "CASE o_orderpriority WHEN '1-URGENT' THEN 'Operating Room' WHEN '2-HIGH' THEN 'Recovery Room' ELSE 'Ward' END",
    "unitdischargelocation": "CASE WHEN o_orderpriority = '5-LOW' THEN 'Telemetry' WHEN o_custkey % 3 = 0 THEN NULL ELSE 'Home' END",
    "unittype": "CASE o_custkey % 4 WHEN 0 THEN 'MICU' WHEN 1 THEN 'SICU' WHEN 2 THEN 'Elsewhere' END",
    "hospitalid": "cast(o_custkey % 30 AS int)",
    "admissionweight": "o_totalprice",
}
_ICU_HOSPITAL = {
    "hospitalid": "n_nationkey",
    "region": "CASE WHEN r_name <> 'MIDDLE EAST' THEN r_name END",
    "teachingstatus": "CASE n_nationkey % 3 WHEN 0 THEN 't' WHEN 1 THEN 'f' END",
    "numbedscategory": "CASE n_nationkey % 5 WHEN 0 THEN '<100' WHEN 1 THEN '100 - 249' WHEN 2 THEN '250 - 499' WHEN 3 THEN '>= 500' END",
}
_ICU_RESULT = {
    "apachescore": "CASE WHEN l_quantity <= 48 THEN l_extendedprice END",
    "acutephysiologyscore": "l_quantity",
    "actualiculos": "l_partkey / 100.0",
    "actualhospitallos": "l_suppkey / 10.0",
    "predictedhospitalmortality": "l_discount",
}
_ICU_DRUG = "CASE l_returnflag WHEN 'R' THEN 'Yes' WHEN 'N' THEN 'No' END"
_ICU_PAST = "CASE WHEN l_linestatus = 'O' THEN 'NoHealthProblems' WHEN l_quantity <= 40 THEN 'Known' END"
_ICU_KEPT = (
    "patientunitstayid", "readmitted", "region", "age_num", "is_male", "is_elective", "high_risk_discharge", "unittype_enc",
    "apachescore", "acutephysiologyscore", "diagnosis_count", "medication_count", "comorbidity_count", "is_teaching",
    "bed_size_enc", "high_risk_apache", "long_stay", "teaching_bed_interaction",
)
_ICU_ROUNDED = {"apache_los_interaction": 4, "severity_age": 4, "med_diag_ratio": 6, "comorbidity_severity": 2}


def _duck(exprs: dict[str, str]) -> str:
    return ", ".join(
        f"{e.replace('AS string', 'AS VARCHAR').replace(' / 100.0', ' / 100.0::DOUBLE').replace(' / 10.0', ' / 10.0::DOUBLE')} AS {n}"
        for n, e in exprs.items()
    )


@query("icu_cohort", f"""WITH visits AS (
  SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS visit FROM orders),
p AS (SELECT {_duck(_ICU_PATIENT)} FROM visits WHERE visit <= 2),
h AS (SELECT {_duck(_ICU_HOSPITAL)} FROM nation JOIN region ON n_regionkey = r_regionkey),
a AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY stay ORDER BY apachescore DESC NULLS FIRST, acutephysiologyscore DESC,
  actualiculos DESC, actualhospitallos DESC, predictedhospitalmortality DESC) AS r
  FROM (SELECT l_orderkey AS stay, {_duck(_ICU_RESULT)} FROM lineitem)) WHERE r = 1),
c AS (SELECT l_orderkey AS stay, count(*) AS dx, count(*) FILTER (WHERE {_ICU_DRUG} IS DISTINCT FROM 'Yes') AS med,
  count(*) FILTER (WHERE {_ICU_PAST} IS DISTINCT FROM 'NoHealthProblems') AS co FROM lineitem GROUP BY 1),
j AS (SELECT p.*, a.apachescore, a.acutephysiologyscore, a.actualiculos, h.region,
  CASE WHEN uniquepid IN (SELECT uniquepid FROM p WHERE unitvisitnumber = 2) THEN 1 ELSE 0 END AS readmitted,
  try_cast(replace(age, '> 89', '90') AS DOUBLE) AS age_num, coalesce(dx, 0) AS diagnosis_count, coalesce(med, 0) AS medication_count,
  coalesce(co, 0) AS comorbidity_count,
  CASE WHEN h.hospitalid IS NOT NULL THEN CASE WHEN teachingstatus = 't' THEN 1 ELSE 0 END END AS is_teaching,
  CASE WHEN h.hospitalid IS NOT NULL THEN CASE numbedscategory WHEN '<100' THEN 0 WHEN '100 - 249' THEN 1 WHEN '250 - 499' THEN 2
    WHEN '>= 500' THEN 3 ELSE 1 END END AS bed_size_enc
  FROM p LEFT JOIN a ON patientunitstayid = a.stay LEFT JOIN c ON patientunitstayid = c.stay LEFT JOIN h ON p.hospitalid = h.hospitalid
  WHERE unitvisitnumber = 1),
q AS (SELECT median(age_num) AS age, quantile_cont(apachescore, 0.75) AS score, quantile_cont(actualiculos, 0.75) AS stay FROM j)
SELECT patientunitstayid, readmitted, region, age_num, CASE WHEN gender = 'Male' THEN 1 ELSE 0 END AS is_male,
  CASE WHEN hospitaladmitsource IN ('Operating Room', 'Recovery Room') THEN 1 ELSE 0 END AS is_elective,
  CASE WHEN unitdischargelocation = 'Telemetry' THEN 1 ELSE 0 END AS high_risk_discharge,
  CASE unittype WHEN 'MICU' THEN 0 WHEN 'SICU' THEN 1 ELSE -1 END AS unittype_enc, apachescore, acutephysiologyscore,
  diagnosis_count, medication_count, comorbidity_count, is_teaching, bed_size_enc,
  CASE WHEN coalesce(apachescore, 0) > q.score THEN 1 ELSE 0 END AS high_risk_apache,
  CASE WHEN coalesce(actualiculos, 0) > q.stay THEN 1 ELSE 0 END AS long_stay, is_teaching * bed_size_enc AS teaching_bed_interaction,
  round(coalesce(apachescore, 0) * coalesce(actualiculos, 0), 4) AS apache_los_interaction,
  round(coalesce(apachescore, 0) * coalesce(age_num, q.age), 4) AS severity_age,
  round(medication_count / (diagnosis_count + 1), 6) AS med_diag_ratio,
  round(comorbidity_count * coalesce(apachescore, 0), 2) AS comorbidity_severity FROM j, q""")
def icu_cohort(spark, folder):
    out = build_icu_cohort(_icu_tables(spark, folder))
    return rounded(out.select(*_ICU_KEPT, *_ICU_ROUNDED), **_ICU_ROUNDED)


_HEART = {
    "age": "l_quantity", "sex": "l_linenumber % 2", "cp": "l_linenumber % 4",
    "trestbps": "CASE WHEN l_partkey % 9 <> 0 THEN l_quantity * 3 END",
    "chol": "CASE WHEN l_suppkey % 4 <> 0 THEN l_extendedprice END", "fbs": "l_discount", "restecg": "l_tax",
    "thalach": "CASE WHEN l_partkey % 5 <> 0 THEN l_quantity + l_linenumber END",
    "exang": "CASE l_linestatus WHEN 'O' THEN 1 WHEN 'F' THEN 0 END", "oldpeak": "l_tax * 10",
    "slope": "CASE WHEN l_linenumber < 6 THEN l_linenumber END", "ca": "l_discount", "thal": "l_tax",
    "target": "CASE l_returnflag WHEN 'R' THEN 3 WHEN 'A' THEN 0 END",
}


@query("heart_features", f"""WITH raw AS (SELECT l_orderkey, l_linenumber, l_partkey, {', '.join(f'({e})::DOUBLE AS {n}' for n, e in _HEART.items())} FROM lineitem),
f AS (SELECT * REPLACE ({', '.join(f'coalesce({c}, (SELECT median({c}) FROM raw)) AS {c}' for c in ('trestbps', 'chol', 'thalach', 'exang', 'oldpeak', 'slope'))}) FROM raw)
SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN target > 0 THEN 1 ELSE 0 END AS readmitted, round(trestbps, 4) AS trestbps,
  round(chol, 4) AS chol, exang, round(age * thalach, 4) AS age_thalach, round(oldpeak * slope, 4) AS oldpeak_slope,
  round(cp * exang, 4) AS cp_exang, FALSE AS is_synthetic FROM f""")
def heart_features(spark, folder):
    raw = table(spark, folder, "lineitem").selectExpr(
        "l_orderkey", "l_linenumber", "l_partkey", *[f"cast({e} AS double) AS {n}" for n, e in _HEART.items()]
    )
    out = datasets.heart_features(raw).select(
        "l_orderkey", "l_linenumber", "l_partkey", "readmitted", "trestbps", "chol", "exang", "age_thalach", "oldpeak_slope",
        "cp_exang", "is_synthetic",
    )
    return rounded(out, trestbps=4, chol=4, age_thalach=4, oldpeak_slope=4, cp_exang=4)


_BANK = {
    "Age": "c_nationkey + 20", "Tenure": "c_custkey % 10", "Balance": "c_acctbal", "NumOfProducts": "c_custkey % 4 + 1",
    "IsActiveMember": "c_custkey % 2",
    "EstimatedSalary": "CASE WHEN c_custkey % 5 = 0 THEN NULL WHEN c_custkey % 3 = 0 THEN 0 ELSE c_custkey % 1000 + 100 END",
}
_BANK_TEXT = {
    "Gender": "CASE c_custkey % 3 WHEN 0 THEN 'MALE' WHEN 1 THEN 'Female' END",
    "Geography": "CASE c_nationkey % 4 WHEN 0 THEN 'France' WHEN 1 THEN 'Germany' WHEN 2 THEN 'Spain' ELSE 'Italy' END",
}


@query("bank_features", f"""WITH raw AS (SELECT c_custkey, {', '.join(f'({e})::DOUBLE AS {n}' for n, e in _BANK.items())},
  {', '.join(f'{e} AS {n}' for n, e in _BANK_TEXT.items())}, CASE WHEN c_custkey % 6 = 0 THEN 1 ELSE 0 END AS Exited FROM customer)
SELECT c_custkey, Exited AS readmitted, CASE WHEN lower(Gender) = 'male' THEN 1 ELSE 0 END AS "Gender_enc",
  round(CASE WHEN EstimatedSalary > 0 THEN Balance / (EstimatedSalary + 1) ELSE 0 END, 6) AS balance_salary_ratio,
  Age * Tenure AS age_tenure, NumOfProducts * IsActiveMember AS products_active, Geography AS region,
  CASE Geography WHEN 'France' THEN 1 WHEN 'Germany' THEN 2 WHEN 'Spain' THEN 3 ELSE 0 END AS hospitalid FROM raw""")
def bank_features(spark, folder):
    raw = table(spark, folder, "customer").selectExpr(
        "c_custkey", *[f"cast({e} AS double) AS {n}" for n, e in _BANK.items()],
        *[f"{e} AS {n}" for n, e in _BANK_TEXT.items()], "CASE WHEN c_custkey % 6 = 0 THEN 1 ELSE 0 END AS Exited",
    )
    out = datasets.bank_features(raw).select(
        "c_custkey", "readmitted", "Gender_enc", "balance_salary_ratio", "age_tenure", "products_active", "region", "hospitalid"
    )
    return rounded(out, balance_salary_ratio=6)


# ------------------------------------------------------------------ scalar features and sources
@query("number_cleaning", """
WITH t AS (SELECT o_orderkey AS id, CASE WHEN o_orderkey % 11 = 0 THEN '> 89' WHEN o_orderkey % 7 = 0 THEN 'x'
    WHEN o_orderkey % 5 = 0 THEN '' WHEN o_orderkey % 3 = 0 THEN NULL ELSE cast(o_custkey % 90 AS VARCHAR) END AS age
  FROM orders)
SELECT id, try_cast(replace(age, '> 89', '90') AS DOUBLE) AS age_num FROM t""")
def number_cleaning(spark, folder):
    key = F.col("o_orderkey")
    text = (
        F.when(key % 11 == 0, "> 89").when(key % 7 == 0, "x").when(key % 5 == 0, "")
        .when(key % 3 == 0, F.lit(None)).otherwise((F.col("o_custkey") % 90).cast("string"))
    )
    return table(spark, folder, "orders").select(key.alias("id"), S.to_number(text, {"> 89": "90"}).alias("age_num"))


@query("flags_and_codes", """
SELECT o_orderkey AS id, CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END AS is_f,
  CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH') THEN 1 ELSE 0 END AS urgent,
  CASE o_orderstatus WHEN 'F' THEN 0 WHEN 'O' THEN 1 ELSE -1 END AS code,
  CASE WHEN lower(o_orderstatus) = 'p' THEN 1 ELSE 0 END AS is_p,
  CASE WHEN o_totalprice > 0 THEN 1 ELSE 0 END AS positive,
  coalesce(nullif(o_orderstatus, 'P'), 'Unknown') AS relabelled FROM orders""")
def flags_and_codes(spark, folder):
    status = F.col("o_orderstatus")
    return table(spark, folder, "orders").select(
        F.col("o_orderkey").alias("id"), S.flag_equals(status, "F").alias("is_f"),
        S.flag_in(F.col("o_orderpriority"), O.URGENT).alias("urgent"),
        S.encode(status, {"F": 0, "O": 1}, -1).alias("code"), S.flag_equals_folded(status, "p").alias("is_p"),
        S.flag_positive(F.col("o_totalprice")).alias("positive"),
        S.relabel_null(F.nullif(status, F.lit("P"))).alias("relabelled"),
    )


@query("ratios_and_products", f"""WITH {_HOLES}
SELECT id, round(coalesce(price, 0) * coalesce(bal, 0), 4) AS zero_product, round(price * building, 4) AS passed_product,
  round(price / (bal + 1), 6) AS smoothed, round(CASE WHEN bal > 0 THEN price / (bal + 1) ELSE 0 END, 6) AS guarded,
  round(coalesce(price, 0) * coalesce(bal, (SELECT median(bal) FROM holes)), 4) AS filled_product FROM holes""")
def ratios_and_products(spark, folder):
    rows = _holes(base(spark, folder))
    median = quantiles.exact_medians(rows, ["bal"])["bal"]
    price, bal = F.col("price"), F.col("bal")
    out = rows.select(
        "id", S.zero_product(price, bal).alias("zero_product"), S.product(price, F.col("building")).alias("passed_product"),
        S.smoothed_ratio(price, bal).alias("smoothed"), S.guarded_ratio(price, bal).alias("guarded"),
        S.zero_product(price, F.coalesce(bal, F.lit(median))).alias("filled_product"),
    )
    return rounded(out, zero_product=4, passed_product=4, smoothed=6, guarded=6, filled_product=4)


@query("csv_scan", """SELECT c_custkey, nullif(c_name, '') AS c_name, c_nationkey, c_acctbal,
  CASE WHEN c_custkey % 4 <> 0 THEN c_mktsegment END AS c_mktsegment FROM customer""")
def csv_scan(spark, folder):
    """Write customers as a compressed CSV and read them back with a schema."""
    path = scratch_path(spark, "csv")
    out = table(spark, folder, "customer").withColumn(
        "c_mktsegment", F.when(F.col("c_custkey") % 4 == 0, "NA").otherwise(F.col("c_mktsegment"))
    )
    out.write.option("header", True).option("compression", "gzip").csv(f"{path}/customer.csv.gz")
    fields = schema(
        "c_custkey bigint, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string"
    )
    return src.read_table(spark, path, "customer", fields)


@query("any_case_scan", """SELECT n_nationkey, n_name, count(c_custkey) AS customers FROM nation LEFT JOIN customer ON c_nationkey = n_nationkey GROUP BY ALL""")
def any_case_scan(spark, folder):
    """Customers and nations written under names of other letters, and found by theirs."""
    path = scratch_path(spark, "any-case")
    for name, file in (("customer", "CUSTOMER.Csv"), ("nation", "nation.CSV")):
        table(spark, folder, name).write.option("header", True).csv(f"{path}/{file}")
    people = src.read_any_case(spark, path, "customer.csv", schema("c_custkey bigint, c_nationkey int"))
    nations = src.read_any_case(spark, path, "Nation.csv", schema("n_nationkey int, n_name string"))
    counts = relational.count_per_key(people, "c_nationkey", "customers").withColumnRenamed("c_nationkey", "n_nationkey")
    return relational.attach(nations, counts, "n_nationkey", zero=["customers"])


@query("csv_convert", """
WITH t AS (SELECT o_custkey % 50 AS silo, o_orderpriority || chr(10) || 'say "' || o_orderstatus || '", twice' AS note, o_totalprice AS price
  FROM orders UNION ALL SELECT o_custkey % 50, NULL, NULL FROM orders)
SELECT silo, note, count(*) AS n, count(*) AS n_ids, sum(CAST(round(price * 100) AS BIGINT))::BIGINT AS cents, 1 AS runs
FROM t GROUP BY silo, note""")
def csv_convert(spark, folder):
    """Orders with quoted line breaks, quotes and repeated rows: converted once; a second run finds nothing to do."""
    path = scratch_path(spark, "convert")
    note = F.concat("o_orderpriority", F.lit('\nsay "'), "o_orderstatus", F.lit('", twice'))
    silo = (F.col("o_custkey") % 50).alias("silo")
    orders = table(spark, folder, "orders")
    rows = orders.select(silo, note.alias("note"), F.col("o_totalprice").alias("price"))
    rows = rows.unionByName(orders.select(silo), allowMissingColumns=True)
    writer = rows.write.option("header", True).option("quote", '"').option("escape", '"').option("quoteAll", True)
    writer.option("compression", "gzip").csv(f"{path}/raw")
    fields = schema("silo bigint, note string, price double")
    runs = sum(convert_csv(spark, f"{path}/raw", f"{path}/parquet", fields, rows_per_file=10_000) for _ in range(2))
    found = read_converted(spark, f"{path}/parquet")
    return found.groupBy("silo", "note").agg(
        F.count(F.lit(1)).alias("n"), F.count_distinct("row_id").alias("n_ids"),
        F.sum(F.round(F.col("price") * 100).cast("long")).alias("cents"), F.lit(runs).alias("runs"),
    )


@query("site_scan", """
SELECT o_orderkey::DOUBLE AS key, o_totalprice AS price, CASE WHEN o_orderkey % 6 <> 0 THEN o_custkey::DOUBLE END AS cust,
  CASE o_orderstatus WHEN 'F' THEN 'Filled' WHEN 'O' THEN 'Open' ELSE 'Partial' END AS region,
  CASE o_orderstatus WHEN 'F' THEN 1 WHEN 'O' THEN 2 ELSE 3 END AS hospitalid
FROM orders WHERE o_orderstatus IN ('F', 'O', 'P')""")
def site_scan(spark, folder):
    """Write one headerless file set per status and read all of them in one tagged scan."""
    path = scratch_path(spark, "sites")
    orders = table(spark, folder, "orders").select(
        F.col("o_orderkey").alias("key"), F.col("o_totalprice").alias("price"),
        F.when(F.col("o_orderkey") % 6 == 0, "?").otherwise(F.col("o_custkey").cast("string")).alias("cust"),
        F.col("o_orderstatus").alias("status"),
    )
    sites = [("filled.data", "Filled", 1), ("open.data", "Open", 2), ("partial.data", "Partial", 3)]
    for (file, _, _), status in zip(sites, "FOP"):
        orders.filter(F.col("status") == status).drop("status").write.csv(f"{path}/{file}")
    return src.read_sites(spark, path, sites, schema("key double, price double, cust double"))


@query("stack_tables", """
SELECT c_custkey AS key, c_acctbal AS amount, NULL::VARCHAR AS note, FALSE AS is_synthetic FROM customer
UNION ALL SELECT o_orderkey, o_totalprice, o_orderstatus, TRUE FROM orders""")
def stack_tables(spark, folder):
    a = table(spark, folder, "customer").select(
        F.col("c_custkey").alias("key"), F.col("c_acctbal").alias("amount"), F.lit(False).alias("is_synthetic")
    )
    b = table(spark, folder, "orders").select(
        F.col("o_orderkey").alias("key"), F.col("o_totalprice").alias("amount"), F.col("o_orderstatus").alias("note"),
        F.lit(True).alias("is_synthetic"),
    )
    return relational.stack_tables(a, b).select("key", "amount", "note", "is_synthetic")


_EXPECTED = {
    "orders": {"o_orderkey": "bigint", "o_orderpriority": "int", "o_totalprice": "double"},
    "customer": {"c_custkey": "int", "c_mktsegment": "string", "c_acctbal": "int"},
    "lineitem": {"l_quantity": "double", "l_returnflag": "boolean"},
    "events": {"user_id": "bigint", "event_type": "date"},
}


def _profile_sql(table: str, columns: dict[str, str]) -> str:
    return " UNION ALL ".join(
        f"""SELECT '{table}' AS "table", '{c}' AS "column", count(*) AS n_rows, count(*) - count({c}) AS n_null,
  count(*) FILTER ({c} IS NOT NULL AND TRY_CAST({c} AS {t}) IS NULL) AS n_uncastable FROM {table}"""
        for c, t in columns.items()
    )


@query("source_check", f"""WITH p AS ({" UNION ALL ".join(_profile_sql(t, c) for t, c in _EXPECTED.items()).replace(" AS string)", " AS VARCHAR)")})
SELECT *, CASE WHEN n_rows = 0 THEN 'table is empty' WHEN n_uncastable > 0 THEN 'values of another type'
  WHEN n_null = n_rows THEN 'no value at all' END AS problem FROM p""")
def source_check(spark, folder):
    tables = {name: table(spark, folder, name) for name in _EXPECTED}
    return src.profile_sources(tables, _EXPECTED, spark)


# ------------------------------------------------------------------ splits and samples
def _ranked(group: str, salt: str, seed: int = 0, key: str = "id") -> str:
    return (
        f"SELECT *, row_number() OVER (PARTITION BY {group} ORDER BY {U(seed, salt, key)}, {key}) AS rk, "
        f"count(*) OVER (PARTITION BY {group}) AS n_c"
    )


@query("group_rank", f"""WITH {BASE} SELECT id, silo, row_number() OVER (PARTITION BY silo ORDER BY {U(5, 'rank', 'id')}, id) AS rank
FROM base WHERE silo IS NOT NULL""")
def group_rank(spark, folder):
    rows = base(spark, folder).filter(F.col("silo").isNotNull()).select("id", "silo")
    return ranking.rank_in_group(rows, ["silo"], "id", 5, "rank")


def _quota(by: str, at_least_one: bool) -> str:
    """SQL: test rows of each class by largest remainder."""
    part = f"PARTITION BY {by}" if by else ""
    out = f"""
sizes AS (SELECT {by + ', ' if by else ''}label, count(*) AS n FROM base GROUP BY ALL),
shares AS (SELECT *, ceil(round(sum(n) OVER ({part}) * 0.2, 9)) AS total,
  ceil(round(sum(n) OVER ({part}) * 0.2, 9)) * n / sum(n) OVER ({part}) AS share FROM sizes),
quotas AS (SELECT *, floor(round(share, 9)) + CASE WHEN row_number() OVER ({part} ORDER BY share - floor(round(share, 9)) DESC, label DESC)
   <= total - sum(floor(round(share, 9))) OVER ({part}) THEN 1 ELSE 0 END AS q FROM shares)"""
    return out if not at_least_one else out.replace(
        "quotas AS", "plain AS") + """,
quotas AS (SELECT * REPLACE (CASE WHEN n >= 2 THEN greatest(1, least(q, n - 1)) ELSE 0 END AS q) FROM plain)"""


@query("stratified_split", f"""WITH {BASE}, {_quota('', False)},
ranked AS ({_ranked('label', 'split')} FROM base)
SELECT r.id, r.label, r.rk <= q.q AS is_test FROM ranked r JOIN quotas q ON r.label = q.label""")
def stratified_split(spark, folder):
    return sampling.stratified_split(base(spark, folder).select("id", "label"), "label", "id", 0.2, 0)


_UNLABELLED = BASE.replace("base AS (", "whole AS (", 1) + """,
marked AS (SELECT * REPLACE (CASE WHEN id % 11 = 0 THEN NULL ELSE label END AS label) FROM whole),
base AS (SELECT * FROM marked WHERE label IS NOT NULL)"""


def _unlabelled(df: DataFrame) -> DataFrame:
    return df.withColumn("label", F.when(F.col("id") % 11 != 0, F.col("label")))


@query("split_with_null_labels", f"""WITH {_UNLABELLED}, {_quota('', False)},
ranked AS ({_ranked('label', 'split')} FROM base)
SELECT r.id, r.label, r.rk <= q.q AS is_test FROM ranked r JOIN quotas q ON r.label = q.label
UNION ALL SELECT id, label, NULL FROM marked WHERE label IS NULL""")
def split_with_null_labels(spark, folder):
    """Rows without a label are on neither side; the sides are those of the labelled rows."""
    return sampling.stratified_split(_unlabelled(base(spark, folder)).select("id", "label"), "label", "id", 0.2, 0)


@query("region_split_with_null_regions", f"""WITH {BASE}, {_quota('region', True)},
ranked AS ({_ranked('region, label', 'split:region')} FROM base)
SELECT r.id, r.region, r.label, r.rk <= q.q AS is_test FROM ranked r
JOIN quotas q ON r.label = q.label AND r.region IS NOT DISTINCT FROM q.region""")
def region_split_with_null_regions(spark, folder):
    """Rows without a region are split like those of a region."""
    return sampling.stratified_split(base(spark, folder).select("id", "region", "label"), "label", "id", 0.2, 0, by=["region"])


@query("region_split", f"""WITH {BASE.replace(' AS region,', ' AS region0,')}, based AS (SELECT id, label, coalesce(region0, 'Unknown') AS region FROM base),
{_quota('region', True).replace('FROM base', 'FROM based')},
ranked AS ({_ranked('region, label', 'split:region')} FROM based)
SELECT r.id, r.region, r.label, r.rk <= q.q AS is_test FROM ranked r JOIN quotas q ON r.label = q.label AND r.region = q.region""")
def region_split(spark, folder):
    rows = base(spark, folder).select("id", S.relabel_null(F.col("region")).alias("region"), "label")
    return sampling.stratified_split(rows, "label", "id", 0.2, 0, by=["region"])


@query("stratified_folds", f"""WITH {BASE}, ranked AS ({_ranked('label', 'fold')} FROM base)
SELECT id, label, (CASE WHEN rk > floor(n_c * 1 / 5) THEN 1 ELSE 0 END + CASE WHEN rk > floor(n_c * 2 / 5) THEN 1 ELSE 0 END
 + CASE WHEN rk > floor(n_c * 3 / 5) THEN 1 ELSE 0 END + CASE WHEN rk > floor(n_c * 4 / 5) THEN 1 ELSE 0 END) AS fold FROM ranked""")
def stratified_folds(spark, folder):
    return sampling.stratified_folds(base(spark, folder).select("id", "label"), "label", "id", 5, 0)


def _skew_sql(silos: int, alpha: float, seed: int) -> str:
    shares = sampling.skew_proportions(silos, alpha, seed)
    cases = []
    for i in range(1, silos):
        upto = {c: " + ".join(f"floor({shares[c][j]!r}::DOUBLE * n_c)" for j in range(i)) for c in (0, 1)}
        cases.append(f"CASE WHEN rk > (CASE WHEN label = 1 THEN {upto[1]} ELSE {upto[0]} END) THEN 1 ELSE 0 END")
    return f"WITH {BASE}, ranked AS ({_ranked('label', 'skew')} FROM base) SELECT id, label, ({' + '.join(cases)}) AS silo FROM ranked"


@query("skew_partition", _skew_sql(5, 0.5, 0))
def skew_partition(spark, folder):
    return sampling.skew_partition(base(spark, folder).select("id", "label"), "label", "id", 5, 0.5, 0)


_SCALE = "CASE WHEN {sd} >= 1e-6 THEN {sd} WHEN {ma} * 0.05::DOUBLE >= 1e-6 THEN {ma} * 0.05::DOUBLE ELSE 0.01::DOUBLE END"


def _normal(column: str) -> str:
    u1, u2 = U(3, f"noise:{column}:r", "cust", "i"), U(3, f"noise:{column}:a", "cust", "i")
    return f"(sqrt(-2.0::DOUBLE * ln(1.0::DOUBLE - {u1})) * cos(2.0::DOUBLE * pi() * {u2}))"


@query("augment_groups", f"""
WITH {_HOLES}, sizes AS (SELECT cust, count(*) AS n FROM holes WHERE cust IS NOT NULL GROUP BY cust HAVING count(*) < 12),
small AS (SELECT h.*, s.n FROM holes h JOIN sizes s ON h.cust = s.cust),
ranked AS (SELECT *, row_number() OVER (PARTITION BY cust ORDER BY {U(3, 'order', 'id')}, id) AS rk FROM small),
stats AS (SELECT cust, stddev_pop(price) AS sd0, avg(abs(price)) AS ma0, coalesce(bool_and(price IN (0, 1)), TRUE) AS bin0,
  stddev_pop(building) AS sd1, avg(abs(building)) AS ma1, coalesce(bool_and(building IN (0, 1)), TRUE) AS bin1 FROM small GROUP BY cust),
before AS (SELECT cust, n, 12 - n AS need,
  coalesce(sum(12 - n) OVER (ORDER BY {U(0, 'total', 'cust')}, cust ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS b FROM sizes),
draws AS (SELECT cust, i, b, floor({U(3, 'draw', 'cust', 'i')} * n) + 1 AS rk FROM before, unnest(range(1, need + 1)) t(i)),
made AS (SELECT (SELECT max(id) FROM holes) + d.b + d.i AS id, d.cust, r.label,
  r.price + ({_SCALE.format(sd='s.sd0', ma='s.ma0')}) * 0.05::DOUBLE * {_normal('price').replace('cust', 'd.cust').replace('(i ', '(d.i ')} AS p0, s.bin0,
  r.building + ({_SCALE.format(sd='s.sd1', ma='s.ma1')}) * 0.05::DOUBLE * {_normal('building').replace('cust', 'd.cust').replace('(i ', '(d.i ')} AS p1, s.bin1
  FROM draws d JOIN ranked r ON d.cust = r.cust AND d.rk = r.rk JOIN stats s ON d.cust = s.cust)
SELECT id::BIGINT AS id, cust, label, round(price, 3) AS price, building::DOUBLE AS building, FALSE AS is_synthetic FROM holes
UNION ALL SELECT id::BIGINT, cust, label,
  round(CASE WHEN bin0 THEN coalesce(least(greatest(round_even(p0, 0), 0), 1), 0) ELSE p0 END, 3),
  round(CASE WHEN bin1 THEN coalesce(least(greatest(round_even(p1, 0), 0), 1), 0) ELSE p1 END, 6), TRUE FROM made""")
def augment_groups(spark, folder):
    rows = _holes(base(spark, folder)).select("id", "cust", "label", "price", "building")
    out = augment.augment_groups(rows, "cust", "id", ["price", "building"], 12, 3)
    return rounded(out, price=3, building=6)


@query("bootstrap_resample", f"""WITH {BASE}, ranked AS (SELECT id, row_number() OVER (ORDER BY {U(7, 'resample', 'id')}, id) AS rk,
  count(*) OVER () AS n FROM base),
picks AS (SELECT rep, floor({U(7, 'pick', 'rep', 'id')} * n) + 1 AS rk, count(*) AS times FROM ranked, range(3) t(rep) GROUP BY 1, 2)
SELECT rep::INT AS rep, r.id, times FROM picks p JOIN ranked r ON p.rk = r.rk""")
def bootstrap_resample(spark, folder):
    return bootstrap.multinomial_resample(base(spark, folder), "id", 3, 7)


# ------------------------------------------------------------------ preparation
FEATURES = ("price", "bal", "building")


@query("prep_stats", f"""WITH {_HOLES}, f AS (
  SELECT 'price' AS feature, median(price) AS m FROM holes UNION ALL SELECT 'bal', median(bal) FROM holes
  UNION ALL SELECT 'building', median(building) FROM holes),
v AS (SELECT 'price' AS feature, price AS x FROM holes UNION ALL SELECT 'bal', bal FROM holes UNION ALL SELECT 'building', building FROM holes)
SELECT feature, round(any_value(m), 4) AS median, round(avg(coalesce(x, m)), 4) AS mean, round(stddev_pop(coalesce(x, m)), 4) AS std_pop
FROM v JOIN f USING (feature) GROUP BY feature""")
def prep_stats(spark, folder):
    fitted = prep.fit_prep(_holes(base(spark, folder)), FEATURES)
    return rounded(fitted.table(spark), median=4, mean=4, std_pop=4)


@query("prep_with_nan", f"""WITH {BASE}, holes AS (SELECT CASE WHEN id % 5 <> 0 THEN price END AS price FROM base)
SELECT 'price' AS feature, round(m, 4) AS median, round(avg(coalesce(price, m)), 4) AS mean,
  round(stddev_pop(coalesce(price, m)), 4) AS std_pop FROM holes, (SELECT median(price) AS m FROM holes) GROUP BY m""")
def prep_with_nan(spark, folder):
    """NaN is a missing value."""
    price = F.when(F.col("id") % 5 == 0, F.lit(float("nan"))).otherwise(F.col("price"))
    fitted = prep.fit_prep(base(spark, folder).select(price.alias("price")), ["price"])
    return rounded(fitted.table(spark), median=4, mean=4, std_pop=4)


@query("prep_transform", f"""WITH {_HOLES},
m AS (SELECT median(price) AS p, median(bal) AS b, median(building) AS g FROM holes),
filled AS (SELECT id, coalesce(price, p) AS price, coalesce(bal, b) AS bal, coalesce(building, g) AS building FROM holes, m),
s AS (SELECT avg(price) AS mp, stddev_pop(price) AS sp, avg(bal) AS mb, stddev_pop(bal) AS sb, avg(building) AS mg, stddev_pop(building) AS sg FROM filled)
SELECT id, round((price - mp) / sp, 5) AS price, round((bal - mb) / sb, 5) AS bal, round((building - mg) / sg, 5) AS building FROM filled, s""")
def prep_transform(spark, folder):
    rows = _holes(base(spark, folder))
    vector = F.col("features")
    out = prep.fit_prep(rows, FEATURES).transform(rows)
    return out.select("id", *[F.round(vector[i], 5).alias(f) for i, f in enumerate(FEATURES)])


# ------------------------------------------------------------------ scores and metrics
@query("class_weights", f"""WITH {BASE}
SELECT silo, count(*) AS n, round(count(*) / nullif(2 * count(*) FILTER (WHERE label = 1), 0), 6) AS w1,
  round(count(*) / nullif(2 * count(*) FILTER (WHERE label = 0), 0), 6) AS w0 FROM base GROUP BY silo""")
def class_weights(spark, folder):
    return rounded(logistic.class_weights(base(spark, folder), "silo", "label"), w1=6, w0=6)


def _silo_params(df: DataFrame) -> DataFrame:
    """Parameters per silo that SQL can compute too: [rate, -mean price share, mean balance share]."""
    mean = df.filter(F.col("silo").isNotNull()).groupBy("silo").agg(
        F.count(F.lit(1)).alias("n"), F.avg(F.col("label").cast("double")).alias("a"),
        (F.avg("price") / -500000.0).alias("b"), (F.avg("bal") / 10000.0).alias("c"),
    )
    return mean.select("silo", "n", F.array("a", "b", "c").alias("params"))


_PARAMS = BASE + """, params AS (SELECT silo, count(*) AS n, avg(label::DOUBLE) AS a, avg(price) / -500000.0::DOUBLE AS b,
  avg(bal) / 10000.0::DOUBLE AS c FROM base WHERE silo IS NOT NULL GROUP BY silo),
regions AS (SELECT n_nationkey AS silo, r_name AS region_name FROM nation JOIN region ON n_regionkey = r_regionkey)"""


def _with_features(df: DataFrame) -> DataFrame:
    return df.withColumn("features", F.array(F.col("price") / 500000.0, F.col("building").cast("double")))


@query("score_by_silo", f"""WITH {_PARAMS}
SELECT id, base.silo, round(1 / (1 + exp(-(a * (price / 500000.0::DOUBLE) + b * building + c))), 6) AS score
FROM base JOIN params ON base.silo = params.silo""")
def score_by_silo(spark, folder):
    rows = base(spark, folder)
    out = logistic.score_by_key(_with_features(rows), _silo_params(rows), "silo", 2)
    return rounded(out.select("id", "silo", "score"), score=6)


@query("score_linear", f"""WITH {BASE}, m AS (SELECT * FROM (VALUES ('a', 0.5::DOUBLE, -1.0::DOUBLE, 0.25::DOUBLE), ('b', -2.0, 0.5, 1.0)) t(model, w0, w1, b))
SELECT id, model, round(1 / (1 + exp(-(w0 * (price / 500000.0::DOUBLE) + w1 * building + b))), 6) AS score,
  CASE WHEN 1 / (1 + exp(-(w0 * (price / 500000.0::DOUBLE) + w1 * building + b))) >= 0.5 THEN 1 ELSE 0 END AS class FROM base, m""")
def score_linear(spark, folder):
    models = {"a": [0.5, -1.0, 0.25], "b": [-2.0, 0.5, 1.0]}
    out = logistic.score_models(_with_features(base(spark, folder)), models, 2)
    out = out.withColumn("class", S.threshold_class(F.col("score")))
    return rounded(out.select("id", "model", "score", "class"), score=6)


_AUROC = """counts AS (SELECT {g} AS g, score, count(*) FILTER (WHERE label = 1) AS p, count(*) FILTER (WHERE label = 0) AS q FROM scored
  WHERE {g} IS NOT NULL GROUP BY 1, 2),
run AS (SELECT *, coalesce(sum(q) OVER (PARTITION BY g ORDER BY score ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below,
  sum(p) OVER (PARTITION BY g ORDER BY score DESC) AS tp, sum(q) OVER (PARTITION BY g ORDER BY score DESC) AS fp FROM counts),
ranking AS (SELECT g, sum(p + q)::BIGINT AS n, sum(p)::BIGINT AS n_pos,
  sum(p * (below + q / 2.0::DOUBLE)) / (sum(p)::DOUBLE * sum(q)) AS auroc, sum(p * (tp / (tp + fp)::DOUBLE)) / sum(p) AS ap FROM run GROUP BY g)"""


@query("auroc_by_group", f"WITH {SCORED}, {_AUROC.format(g='silo')} SELECT g AS silo, n, n_pos, round(auroc, 6) AS auroc FROM ranking")
def auroc_by_group(spark, folder):
    rows = scored(base(spark, folder)).filter(F.col("silo").isNotNull())
    return rounded(metrics.ranking_metrics(rows, ["silo"]).drop("ap"), auroc=6)


@query("average_precision", f"WITH {SCORED}, {_AUROC.format(g='status')} SELECT g AS status, n, round(ap, 6) AS ap FROM ranking")
def average_precision(spark, folder):
    rows = scored(base(spark, folder)).filter(F.col("status").isNotNull())
    return rounded(metrics.ranking_metrics(rows, ["status"]).select("status", "n", "ap"), ap=6)


@query("auroc_pooled", """WITH counts AS (SELECT l_extendedprice AS s, count(*) FILTER (WHERE l_returnflag = 'R') AS p,
  count(*) FILTER (WHERE l_returnflag <> 'R') AS q FROM lineitem GROUP BY 1),
run AS (SELECT *, coalesce(sum(q) OVER (ORDER BY s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below,
  sum(p) OVER (ORDER BY s DESC) AS tp, sum(q) OVER (ORDER BY s DESC) AS fp FROM counts)
SELECT 'price' AS model, sum(p + q)::BIGINT AS n, sum(p)::BIGINT AS n_pos,
  round(sum(p * (below + q / 2.0::DOUBLE)) / (sum(p)::DOUBLE * sum(q)), 6) AS auroc,
  round(sum(p * (tp / (tp + fp)::DOUBLE)) / sum(p), 6) AS ap FROM run""")
def auroc_pooled(spark, folder):
    rows = table(spark, folder, "lineitem").select(
        F.lit("price").alias("model"), S.flag_equals(F.col("l_returnflag"), "R").alias("label"),
        F.col("l_extendedprice").alias("score"),
    )
    return rounded(metrics.ranking_metrics(rows, ["model"]), auroc=6, ap=6)


_PRF = """SELECT {g} AS g, count(*) AS n, count(*) FILTER (WHERE score >= 0.5 AND label = 1) AS tp,
  count(*) FILTER (WHERE score >= 0.5 AND label <> 1) AS fp, count(*) FILTER (WHERE score < 0.5 AND label = 1) AS fn
  FROM scored WHERE {g} IS NOT NULL GROUP BY 1"""


@query("prf_accuracy", f"""WITH {SCORED}, c AS ({_PRF.format(g='silo')})
SELECT g AS silo, n, tp, fp, fn, round(coalesce(tp / nullif(tp + fp, 0), 0), 6) AS precision, round(coalesce(tp / nullif(tp + fn, 0), 0), 6) AS recall,
  round(coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0), 6) AS f1, round((n - fp - fn) / n, 6) AS accuracy FROM c""")
def prf_accuracy(spark, folder):
    rows = scored(base(spark, folder)).filter(F.col("silo").isNotNull())
    return rounded(metrics.threshold_metrics(rows, ["silo"]), precision=6, recall=6, f1=6, accuracy=6)


_HOLED = SCORED.replace("scored AS (", "all_scored AS (", 1) + """,
scored AS (SELECT * FROM all_scored WHERE id % 7 <> 0 AND id % 13 <> 0 AND id % 11 <> 0)"""


@query("metrics_with_null_scores", f"""WITH {_HOLED}, c AS ({_PRF.format(g='silo')}), {_AUROC.format(g='silo')}
SELECT c.g AS silo, c.n, tp, fp, fn, round((c.n - fp - fn) / c.n, 6) AS accuracy, round(auroc, 6) AS auroc
FROM c JOIN ranking ON c.g = ranking.g""")
def metrics_with_null_scores(spark, folder):
    """Rows without a score, with NaN as score or without a label do not count."""
    rows = scored(base(spark, folder)).filter(F.col("silo").isNotNull())
    rows = _unlabelled(rows).withColumn(
        "score", F.when(F.col("id") % 13 == 0, F.lit(float("nan"))).otherwise(F.when(F.col("id") % 7 != 0, F.col("score")))
    )
    hard = metrics.threshold_metrics(rows, ["silo"]).select("silo", "n", "tp", "fp", "fn", "accuracy")
    ranks = metrics.ranking_metrics(rows, ["silo"]).select("silo", "auroc")
    return rounded(hard.join(ranks, "silo"), accuracy=6, auroc=6)


@query("metric_guards", f"""WITH {SCORED.replace('floor((price', 'floor((CASE WHEN silo % 5 = 0 THEN NULL ELSE 1 END * price')},
used AS (SELECT * FROM scored WHERE score IS NOT NULL), {_AUROC.format(g='silo').replace('FROM scored', 'FROM used')}
SELECT s.silo, coalesce(n, 0) AS n, coalesce(n_pos, 0) AS n_pos, round(coalesce(auroc, 0), 6) AS auroc, round(coalesce(ap, 0), 6) AS ap
FROM (SELECT DISTINCT silo FROM base WHERE silo IS NOT NULL) s LEFT JOIN ranking ON s.silo = g""")
def metric_guards(spark, folder):
    rows = scored(base(spark, folder)).filter(F.col("silo").isNotNull())
    found = metrics.ranking_metrics(rows.filter(F.col("silo") % 5 != 0), ["silo"])
    return rounded(metrics.with_all_groups(found, rows, ["silo"]), auroc=6, ap=6)


def _boot_sql(replicates: int, seed: int) -> str:
    cuts = bootstrap.poisson_cuts()
    text = f"md5(concat_ws('|', '{seed}', 'boot', cast(rep // 8 AS VARCHAR), cast(id AS VARCHAR)))"
    draw = f"('0x' || substr({text}, (4 * (rep % 8) + 1)::INT, 4))::BIGINT"
    weight = " + ".join(f"(d >= {c})::INT" for c in cuts)
    return f"""WITH {SCORED}, drawn AS (SELECT status, rep, score, label, {draw} AS d FROM scored, range({replicates}) t(rep) WHERE status IS NOT NULL),
weighed AS (SELECT status, rep, score, label, {weight} AS w FROM drawn),
counts AS (SELECT status, rep, score, sum(CASE WHEN label = 1 THEN w ELSE 0 END) AS p, sum(CASE WHEN label = 0 THEN w ELSE 0 END) AS q
  FROM weighed GROUP BY ALL),
run AS (SELECT *, coalesce(sum(q) OVER (PARTITION BY status, rep ORDER BY score ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below FROM counts),
reps AS (SELECT status, rep, sum(p * (below + q / 2.0::DOUBLE)) / (sum(p)::DOUBLE * sum(q)) AS auroc FROM run GROUP BY ALL
  HAVING sum(p) > 0 AND sum(q) > 0)
SELECT status, round(avg(auroc), 6) AS auroc_boot, round(quantile_cont(auroc, 0.025), 6) AS auroc_ci_lo,
  round(quantile_cont(auroc, 0.975), 6) AS auroc_ci_hi FROM reps GROUP BY status"""


@query("bootstrap_auroc", _boot_sql(200, 7))
def bootstrap_auroc(spark, folder):
    rows = scored(base(spark, folder)).filter(F.col("status").isNotNull())
    out = bootstrap.bootstrap_auroc(rows, ["status"], "id", replicates=200, seed=7)
    return rounded(out, auroc_boot=6, auroc_ci_lo=6, auroc_ci_hi=6)


@query("fold_summary", f"""WITH {SCORED}, {_AUROC.format(g='silo')}
SELECT region_name, round(avg(round(auroc, 6)), 5) AS cv_auroc, round(stddev_pop(round(auroc, 6)), 5) AS cv_std FROM ranking
JOIN (SELECT n_nationkey, r_name AS region_name FROM nation JOIN region ON n_regionkey = r_regionkey) ON g = n_nationkey GROUP BY region_name""")
def fold_summary(spark, folder):
    found = QUERIES["auroc_by_group"](spark, folder)
    names = O.nation_context(table(spark, folder, "nation"), table(spark, folder, "region"))
    joined = relational.attach(found, names, "silo")
    return rounded(metrics.score_summary(joined, ["region_name"]), cv_auroc=5, cv_std=5)


# ------------------------------------------------------------------ parameters
def _region_params(spark, folder):
    names = O.nation_context(table(spark, folder, "nation"), table(spark, folder, "region"))
    return _silo_params(base(spark, folder)).join(names, "silo")


def _spread_params(df: DataFrame) -> DataFrame:
    return df.select(
        *[c for c in df.columns if c != "params"], *[F.round(F.col("params")[i], 6).alias(f"p{i}") for i in range(3)]
    )


@query("param_average", f"""WITH {_PARAMS}
SELECT region_name, round(sum(a * n) / sum(n), 6) AS p0, round(sum(b * n) / sum(n), 6) AS p1, round(sum(c * n) / sum(n), 6) AS p2
FROM params JOIN regions USING (silo) GROUP BY region_name""")
def param_average(spark, folder):
    params = _region_params(spark, folder)
    averaging.check_averageable(params, "params", "n")
    return _spread_params(averaging.average_vectors(params, "params", "n", ["region_name"]))


def _with_average(spark, folder):
    params = _region_params(spark, folder)
    mean = averaging.average_vectors(params, "params", "n", ["region_name"], "target")
    return params.join(mean, "region_name")


_MEANS = _PARAMS + """, means AS (SELECT region_name, sum(a * n) / sum(n) AS ta, sum(b * n) / sum(n) AS tb, sum(c * n) / sum(n) AS tc
  FROM params JOIN regions USING (silo) GROUP BY region_name)"""


@query("pull_to_global", f"""WITH {_MEANS}
SELECT silo, round(a * 0.9 + ta * 0.1, 6) AS p0, round(b * 0.9 + tb * 0.1, 6) AS p1, round(c, 6) AS p2
FROM params JOIN regions USING (silo) JOIN means USING (region_name)""")
def pull_to_global(spark, folder):
    out = averaging.pull_toward(_with_average(spark, folder), "params", "target", 0.1, 2)
    return _spread_params(out.select("silo", "params"))


@query("merge_models", f"""WITH {_MEANS}
SELECT silo, round(a * 0.5 + ta * 0.5, 6) AS p0, round(b * 0.5 + tb * 0.5, 6) AS p1, round(c * 0.5 + tc * 0.5, 6) AS p2
FROM params JOIN regions USING (silo) JOIN means USING (region_name)""")
def merge_models(spark, folder):
    return _spread_params(averaging.merge_half(_with_average(spark, folder), "params", "target").select("silo", "params"))


@query("importance", f"""WITH {_PARAMS} SELECT silo, round(abs(a) / greatest(abs(a), abs(b)), 6) AS i0, round(abs(b) / greatest(abs(a), abs(b)), 6) AS i1 FROM params""")
def importance(spark, folder):
    out = averaging.importances(_silo_params(base(spark, folder)), "params", 2)
    return out.select("silo", *[F.round(F.col("importances")[i], 6).alias(f"i{i}") for i in range(2)])


@query("average_importance", f"""WITH {_PARAMS}, i AS (SELECT *, abs(a) / greatest(abs(a), abs(b)) AS x, abs(b) / greatest(abs(a), abs(b)) AS y FROM params JOIN regions USING (silo))
SELECT region_name, round(sum(x * n) / sum(n), 6) AS i0, round(sum(y * n) / sum(n), 6) AS i1 FROM i GROUP BY region_name""")
def average_importance(spark, folder):
    each = averaging.importances(_region_params(spark, folder), "params", 2)
    out = averaging.average_importances(each, "importances", "n", ["region_name"])
    return out.select("region_name", *[F.round(F.col("importances")[i], 6).alias(f"i{i}") for i in range(2)])


@query("weighted_local_metric", f"""WITH {SCORED}, {_AUROC.format(g='silo')}
SELECT round(sum(round(auroc, 6) * n) / sum(n), 5) AS local_weighted_auroc FROM ranking""")
def weighted_local_metric(spark, folder):
    found = QUERIES["auroc_by_group"](spark, folder)
    return rounded(averaging.weighted_mean(found, "auroc", "n", name="local_weighted_auroc"), local_weighted_auroc=5)


@query("cluster_rank", f"""WITH {BASE}, h AS (SELECT silo, avg(label::DOUBLE) AS rate, silo % 3 AS raw FROM base WHERE silo IS NOT NULL GROUP BY silo),
k AS (SELECT raw, row_number() OVER (ORDER BY avg(rate), raw)::INT AS hospital_cluster FROM h GROUP BY raw)
SELECT b.id, b.silo, k.hospital_cluster FROM base b LEFT JOIN h ON b.silo = h.silo LEFT JOIN k ON h.raw = k.raw""")
def cluster_rank(spark, folder):
    rows = base(spark, folder).select("id", "silo", "label")
    hospitals = relational.hospital_profile(rows, "silo", "label", []).withColumn("raw", F.col("silo") % 3)
    ranked = clustering.rank_clusters(hospitals, "raw", "rate", "hospital_cluster")
    return clustering.assign_clusters(rows, ranked, "silo").select("id", "silo", "hospital_cluster")


# ------------------------------------------------------------------ comparison and stores
def _region_scores(spark, folder):
    """AUROC per region of four candidate scores; the last exists for some regions only."""
    rows = scored(base(spark, folder)).withColumn("region", S.relabel_null(F.col("region")))
    scores = {
        "a": F.col("score"), "b": F.col("price"), "c": -F.col("score"),
        "d": F.when(F.col("region").isin("ASIA", "EUROPE"), F.col("score")),
    }
    entries = F.array(*[F.struct(F.lit(k).alias("m"), v.cast("double").alias("s")) for k, v in scores.items()])
    long = rows.select("region", "label", F.explode(entries).alias("e")).select("region", "label", "e.m", F.col("e.s").alias("score"))
    found = metrics.ranking_metrics(long.filter(F.col("score").isNotNull()), ["region", "m"])
    return found.groupBy("region").pivot("m", ["a", "b", "c", "d"]).agg(F.max(F.round("auroc", 4)))


_REGION_SCORES = SCORED + """, named AS (SELECT *, coalesce(region, 'Unknown') AS reg FROM scored),
long AS (SELECT reg, label, 'a' AS m, score AS s FROM named UNION ALL SELECT reg, label, 'b', price FROM named
  UNION ALL SELECT reg, label, 'c', -score FROM named UNION ALL SELECT reg, label, 'd', score FROM named WHERE reg IN ('ASIA', 'EUROPE')),
counts AS (SELECT reg, m, s, count(*) FILTER (WHERE label = 1) AS p, count(*) FILTER (WHERE label = 0) AS q FROM long GROUP BY ALL),
run AS (SELECT *, coalesce(sum(q) OVER (PARTITION BY reg, m ORDER BY s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below FROM counts),
au AS (SELECT reg, m, round(sum(p * (below + q / 2.0::DOUBLE)) / (sum(p)::DOUBLE * sum(q)), 4) AS v FROM run GROUP BY ALL),
wide AS (SELECT reg AS region, max(CASE WHEN m = 'a' THEN v END) AS a, max(CASE WHEN m = 'b' THEN v END) AS b,
  max(CASE WHEN m = 'c' THEN v END) AS c, max(CASE WHEN m = 'd' THEN v END) AS d FROM au GROUP BY reg)"""


@query("best_of_uplift", f"""WITH {_REGION_SCORES}, ups AS (SELECT *, round(a - b, 4) AS a_uplift, round(d - b, 4) AS d_uplift FROM wide)
SELECT *, CASE WHEN a_uplift >= 0 THEN '+' ELSE '' END || printf('%.4f', a_uplift) AS a_uplift_label,
  CASE WHEN d_uplift IS NULL THEN '—' ELSE CASE WHEN d_uplift >= 0 THEN '+' ELSE '' END || printf('%.4f', d_uplift) END AS d_uplift_label,
  greatest(a, b, c, d) AS best_value,
  CASE WHEN a = greatest(a, b, c, d) THEN 'first' WHEN b = greatest(a, b, c, d) THEN 'second' WHEN c = greatest(a, b, c, d) THEN 'third' ELSE 'fourth' END AS best_approach
FROM ups""")
def best_of_uplift(spark, folder):
    wide = materialize(_region_scores(spark, folder), "region-scores")
    best = compare.best_of(wide, "region", {"a": "first", "b": "second", "c": "third", "d": "fourth"})
    return compare.uplift(wide, ["a", "d"], "b").join(best, "region")


@query("verdict", f"""WITH {_REGION_SCORES}, e AS (SELECT abs(a - d) < 0.005 AS same FROM wide),
c AS (SELECT count(*) FILTER (WHERE same) AS n_equivalent, count(*) FILTER (WHERE NOT same) AS n_different FROM e)
SELECT *, CASE WHEN n_different > 0 THEN 'DIFFERENT' WHEN n_equivalent > 0 THEN 'EQUIVALENT' ELSE 'NOT EVALUATED' END AS verdict FROM c""")
def verdict(spark, folder):
    return compare.verdict(compare.equivalence(_region_scores(spark, folder), "a", "d"))


@query("region_warnings", """WITH g AS (SELECT o_custkey % 500 AS region, count(*) AS n,
  count(*) FILTER (WHERE o_orderpriority IN ('1-URGENT', '2-HIGH')) AS n_pos FROM orders GROUP BY 1),
t AS (SELECT *, n - n_pos AS n_neg, n // 5 AS n_test FROM g)
SELECT region, CASE WHEN n < 10 OR n_pos < 2 OR n_neg < 1 THEN 'SKIP' ELSE 'SMALL SAMPLE' END AS warning, n, n_pos FROM t
WHERE n < 10 OR n_pos < 2 OR n_neg < 1 OR n_test < 50""")
def region_warnings(spark, folder):
    rows = table(spark, folder, "orders").select(
        (F.col("o_custkey") % 500).alias("region"), S.flag_in(F.col("o_orderpriority"), O.URGENT).alias("label")
    )
    stats = relational.group_label_counts(rows, "region", "label")
    return compare.region_warnings(stats.withColumn("n_test", F.floor(F.col("n") / 5)))


@query("run_checks", f"""WITH {BASE}
SELECT * FROM (VALUES ('train and test are disjoint', TRUE, '0 violations')) t("check", passed, detail)
UNION ALL SELECT 'every row has a silo', count(*) = 0, count(*)::VARCHAR || ' violations' FROM base WHERE silo IS NULL
UNION ALL SELECT 'every row has a region', count(*) = 0, count(*)::VARCHAR || ' violations' FROM base WHERE region IS NULL""")
def run_checks(spark, folder):
    rows = base(spark, folder)
    split = sampling.stratified_split(rows.select("id", "label"), "label", "id", 0.2, 0)
    train, test = split.filter("NOT is_test"), split.filter("is_test")
    return compare.check_rows(
        spark,
        [
            ("train and test are disjoint", test.join(train.select("id"), "id", "left_semi")),
            ("every row has a silo", rows.filter(F.col("silo").isNull())),
            ("every row has a region", rows.filter(F.col("region").isNull())),
        ],
    )


def _model_table(spark, folder):
    """Silo parameters saved as models of one run per region, and read back."""
    path = scratch_path(spark, "models")
    stamp = F.timestamp_seconds(F.lit(1_600_000_000) + F.col("silo") * 60)
    rows = _region_params(spark, folder).select(
        F.concat(F.lit("silo_"), F.col("silo").cast("string")).alias("tag"), stamp.alias("ts"),
        F.lit("logistic_regression").alias("kind"), "params",
        F.create_map(F.lit("n"), F.col("n").cast("double")).alias("metrics"),
        store.config_column({"c": 0.01}).alias("config"), F.col("region_name").alias("run_id"),
    )
    store.save_models(rows, path)
    return path


@query("model_listing", f"""WITH {_PARAMS}
SELECT region_name AS run_id, 'silo_' || silo AS tag, (1600000000 + silo * 60)::BIGINT AS stored_at, n::DOUBLE AS n FROM params JOIN regions USING (silo)""")
def model_listing(spark, folder):
    found = store.list_models(spark, _model_table(spark, folder))
    return found.select("run_id", "tag", F.unix_timestamp("ts").alias("stored_at"), F.col("metrics")["n"].alias("n"))


@query("model_load", f"""WITH {_PARAMS}
SELECT 'silo_' || silo AS tag, round(a, 6) AS p0, round(b, 6) AS p1, round(c, 6) AS p2 FROM params JOIN regions USING (silo) WHERE region_name = 'ASIA'""")
def model_load(spark, folder):
    found = store.load_models(spark, _model_table(spark, folder), "ASIA")
    return _spread_params(found.select("tag", "params"))


def _metric_table(spark, folder):
    """AUROC and AP of every silo as long metrics: strategy = region, round = silo."""
    rows = scored(base(spark, folder)).filter(F.col("silo").isNotNull())
    wide = metrics.ranking_metrics(rows, ["silo"])
    names = O.nation_context(table(spark, folder, "nation"), table(spark, folder, "region"))
    wide = relational.attach(wide, names, "silo").select(
        F.col("region_name").alias("strategy"), F.col("silo").alias("round"), F.col("silo").cast("string").alias("silo"),
        "n", F.round("auroc", 6).alias("global_auroc"), F.round("ap", 6).alias("global_ap"),
    )
    long = store.long_metrics(wide, ["strategy", "round", "silo"], ["global_auroc", "global_ap"])
    path = scratch_path(spark, "metrics")
    store.save_metrics(long.withColumn("run_id", F.lit("r1")), path)
    return store.load_metrics(spark, path, "r1")


_METRICS = f"""{SCORED}, {_AUROC.format(g='silo')}, m AS (SELECT r_name AS strategy, g AS round, round(auroc, 6) AS global_auroc, round(ap, 6) AS global_ap, n
  FROM ranking JOIN nation ON g = n_nationkey JOIN region ON n_regionkey = r_regionkey)"""


@query("metric_sink", f"WITH {_METRICS} SELECT strategy, round, 'global_auroc' AS metric, global_auroc AS value, n FROM m UNION ALL SELECT strategy, round, 'global_ap', global_ap, n FROM m")
def metric_sink(spark, folder):
    return _metric_table(spark, folder).select("strategy", "round", "metric", "value", "n")


@query("summary_pivot", f"""WITH {_METRICS} SELECT strategy, arg_max(global_auroc, round) AS global_auroc, arg_max(global_ap, round) AS global_ap FROM m GROUP BY strategy""")
def summary_pivot(spark, folder):
    return store.summarize(_metric_table(spark, folder), ["global_auroc", "global_ap"])


@query("convergence_series", f"WITH {_METRICS} SELECT strategy, round, global_auroc AS value FROM m")
def convergence_series(spark, folder):
    return store.convergence(_metric_table(spark, folder))


# ------------------------------------------------------------------ trained models
CONFIG = RunConfig(strategies=(1, 2, 3, 4, 5))


def _prepared(spark, folder, **changes):
    cfg = RunConfig(**{**CONFIG.to_dict(), **changes})
    cohort = O.build_orders_cohort(O.load_tables(spark, folder))
    return prepare(cohort, O.ORDERS, cfg)[0]


@query("pooled_lr")
def pooled_lr(spark, folder):
    prepared = _prepared(spark, folder)
    w = logistic.fit_pooled(prepared.train, "label", "features")
    names = [*O.ORDERS.features, "intercept"]
    return spark.createDataFrame([(n, float(v)) for n, v in zip(names, w)], "feature string, coefficient double")


@query("grouped_lr")
def grouped_lr(spark, folder):
    prepared = _prepared(spark, folder)
    return logistic.fit_grouped(prepared.train, F.array(F.col("silo").cast("string")))


def _base_features(spark, folder) -> DataFrame:
    rows = base(spark, folder).filter(F.col("silo").isNotNull())
    fitted = prep.fit_prep(rows, FEATURES)
    return materialize(fitted.transform(rows).select("id", "silo", "label", "features"), "base-features")


def flat_models(rows: DataFrame, params: DataFrame, size: int, mu: float = 0.0, anchor: Sequence[float] | None = None) -> DataFrame:
    """(model, n, n_pos, flat): whether the gradient of each model's objective vanishes.

    ``rows`` has models, label and features.  The objective is strictly convex up to the
    intercept, so a vanishing gradient identifies the one solution.
    """
    spread = rows.select(F.explode("models").alias("model"), "label", "features")
    joined = spread.join(F.broadcast(params.select("model", "n", "n_pos", "params")), "model")  # few models
    n, pos = F.col("n"), F.col("n_pos")
    weight = F.when(F.col("label") == 1, n / (2 * pos)).otherwise(n / (2 * (n - pos)))
    residual = weight * (probability("features", "params", size) - F.col("label"))
    sums = [F.sum(residual * F.col("features")[i]).alias(f"g{i}") for i in range(size)]
    totals = joined.groupBy("model", "n", "n_pos", "params").agg(*sums, F.sum(residual).alias(f"g{size}"))
    away = [F.lit(0.0)] * (size + 1)
    if anchor is not None:
        away = [F.lit(mu) * (F.col("params")[i] - F.lit(float(anchor[i]))) for i in range(size + 1)]
    gradient = [F.abs(0.01 * F.col(f"g{i}") + F.col("params")[i] + away[i]) for i in range(size)]
    gradient.append(F.abs(0.01 * F.col(f"g{size}") + away[size]))
    return totals.select("model", "n", "n_pos", (F.greatest(*gradient) < 1e-5).alias("flat"))


@query("grouped_lr_at_optimum", f"""WITH {BASE}
SELECT silo, count(*) AS n, sum(label)::BIGINT AS n_pos, TRUE AS flat FROM base WHERE silo IS NOT NULL GROUP BY silo""")
def grouped_lr_at_optimum(spark, folder):
    """Fit one model per silo and test that the gradient of its objective vanishes."""
    rows = _base_features(spark, folder).withColumn("models", F.array(F.col("silo").cast("string")))
    flat = flat_models(rows, logistic.fit_grouped(rows, "models"), len(FEATURES))
    return flat.select(F.col("model").cast("int").alias("silo"), "n", "n_pos", "flat")


_FOLDS = f"""ranked AS ({_ranked('label', 'fold')} FROM based),
folds AS (SELECT label, (CASE WHEN rk > floor(n_c * 1 / 5) THEN 1 ELSE 0 END + CASE WHEN rk > floor(n_c * 2 / 5) THEN 1 ELSE 0 END
 + CASE WHEN rk > floor(n_c * 3 / 5) THEN 1 ELSE 0 END + CASE WHEN rk > floor(n_c * 4 / 5) THEN 1 ELSE 0 END) AS fold FROM ranked)"""


@query("cv_lr_at_optimum", f"""WITH {BASE}, based AS (SELECT * FROM base WHERE silo IS NOT NULL), {_FOLDS}
SELECT 'pooled' AS model, count(*) AS n, sum(label)::BIGINT AS n_pos, TRUE AS flat FROM folds
UNION ALL SELECT 'fold:' || f, count(*), sum(label)::BIGINT, TRUE FROM folds, range(5) t(f) WHERE fold <> f GROUP BY f""")
def cv_lr_at_optimum(spark, folder):
    """The pooled model and the five models of the cross-validation, fitted together, each at its optimum."""
    rows = sampling.stratified_folds(_base_features(spark, folder), "label", "id", 5, 0)
    models = F.concat(F.array(F.lit("pooled")), logistic.fold_models("fold", 5))
    rows = materialize(rows.withColumn("models", models), "folds")
    return flat_models(rows, logistic.fit_grouped(rows, "models"), len(FEATURES))


@query("pooled_lr_at_optimum", f"""WITH {BASE}
SELECT 'pooled' AS model, count(*) AS n, sum(label)::BIGINT AS n_pos, TRUE AS flat FROM base WHERE silo IS NOT NULL""")
def pooled_lr_at_optimum(spark, folder):
    """The separate pooled fit is at the optimum of its objective."""
    rows = _base_features(spark, folder).withColumn("models", F.array(F.lit("pooled")))
    w = [float(v) for v in logistic.fit_pooled(rows, "label", "features")]
    params = rows.agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("label").cast("long")).alias("n_pos"))
    params = params.select(F.lit("pooled").alias("model"), "n", "n_pos", constant(w).alias("params"))
    return flat_models(rows, params, len(FEATURES))


@query("averages_of_optima", f"""WITH {BASE}
SELECT round AS round, count(DISTINCT silo) AS silos, count(*) AS n, TRUE AS is_mean FROM base, range(1, 4) t(round) WHERE silo IS NOT NULL GROUP BY round""")
def averages_of_optima(spark, folder):
    """Every averaging round gives the mean of the silo optima, weighted by their rows."""
    rows = _base_features(spark, folder).withColumn("models", F.array(F.col("silo").cast("string")))
    fits = materialize(logistic.fit_grouped(rows, "models"), "fits")
    size = len(FEATURES)
    rounds = averaging_rounds(fits, 3, size, [0.0] * (size + 1))
    means = [F.sum(F.col("params")[i] * F.col("n")) / F.sum("n") for i in range(size + 1)]
    found = fits.agg(F.count(F.lit(1)).alias("silos"), F.sum("n").alias("n"), *[m.alias(f"m{i}") for i, m in enumerate(means)])
    apart = [F.greatest(*[F.abs(F.col(f"m{i}") - w[i]) for i in range(size + 1)]) for w in rounds]
    same = F.array(*[F.struct(F.lit(r).cast("long").alias("round"), (d < 1e-9).alias("is_mean")) for r, d in enumerate(apart, 1)])
    return found.select("silos", "n", F.explode(same).alias("r")).select("r.round", "silos", "n", "r.is_mean")


@query("proximal_at_optimum", f"""WITH {BASE}
SELECT silo::VARCHAR AS model, count(*) AS n, sum(label)::BIGINT AS n_pos, TRUE AS flat FROM base WHERE silo IS NOT NULL GROUP BY silo""")
def proximal_at_optimum(spark, folder):
    """Models with a proximal term are at the optimum of the loss with that term."""
    rows = _base_features(spark, folder).withColumn("models", F.array(F.col("silo").cast("string")))
    anchor = [0.2, -0.1, 0.1, 0.05]
    params = logistic.fit_grouped(rows, "models", prox_mu=0.5, anchor=anchor)
    return flat_models(rows, params, len(FEATURES), 0.5, anchor)


@query("cluster_by_nearest_centre", f"""WITH {BASE}
SELECT silo, count(*) AS n, TRUE AS nearest, TRUE AS ordered FROM base WHERE silo IS NOT NULL GROUP BY silo""")
def cluster_by_nearest_centre(spark, folder):
    """Every silo is nearest to the mean of its own cluster, and cluster numbers follow the label rate."""
    rows = base(spark, folder).filter(F.col("silo").isNotNull())
    found = clustering.cluster_hospitals(rows, "silo", "label", ["building"])
    found = materialize(found.select("silo", "n", "rate", "building", F.col("hospital_cluster").alias("c")), "clusters")
    centres = found.groupBy("c").agg(F.avg("rate").alias("r"), F.avg("building").alias("b"))
    k = centres.select(F.array_sort(F.collect_list(F.struct("c", "r", "b"))).alias("all"))  # three rows
    placed = found.join(F.broadcast(k), F.lit(True))
    apart = F.transform("all", lambda m: (m["r"] - F.col("rate")) ** 2 + (m["b"] - F.col("building")) ** 2)
    own = F.element_at(apart, F.col("c"))
    rates = F.transform("all", lambda m: m["r"])
    return placed.select("silo", "n", (own <= F.array_min(apart) + 1e-12).alias("nearest"), (F.array_sort(rates) == rates).alias("ordered"))


def _linear(spark, folder, *strategies: int, **changes) -> DataFrame:
    found = run_linear(_prepared(spark, folder, **changes), strategies).metrics
    return found.select("strategy", "round", "silo", "metric", "value", "n")


@query("cv_lr")
def cv_lr(spark, folder):
    return _linear(spark, folder, 1)


@query("fedavg_region")
def fedavg_region(spark, folder):
    return _linear(spark, folder, 2)


@query("fedprox_region")
def fedprox_region(spark, folder):
    return _linear(spark, folder, 4, fedprox_mu=0.1)


@query("fedprox_proximal")
def fedprox_proximal(spark, folder):
    return _linear(spark, folder, 4, fedprox_mu=0.1, prox_mode="proximal")


@query("gated_hospital")
def gated_hospital(spark, folder):
    return run_linear(_prepared(spark, folder, auroc_gate=0.9), (3,)).gate


@query("skew_strategy")
def skew_strategy(spark, folder):
    return _linear(spark, folder, 5)


@query("strategy_summary")
def strategy_summary(spark, folder):
    return run(O.build_orders_cohort(O.load_tables(spark, folder)), O.ORDERS, CONFIG).summary


@query("cluster_hospitals")
def cluster_hospitals(spark, folder):
    cohort = materialize(O.build_orders_cohort(O.load_tables(spark, folder)), "cohort")
    return clustering.cluster_hospitals(cohort, "silo", "label", ["is_building", "line_count"])


@query("cluster_fedavg")
def cluster_fedavg(spark, folder):
    """Average one model per hospital cluster and score the held-out rows."""
    prepared = _prepared(spark, folder)
    groups = clustering.cluster_hospitals(prepared.train, "silo", "label", [])
    rows = clustering.assign_clusters(prepared.train, groups, "silo").filter(F.col("hospital_cluster").isNotNull())
    fits = logistic.fit_grouped(rows, F.array(F.col("hospital_cluster").cast("string"))).filter("NOT skipped")
    last = averaging_rounds(fits, CONFIG.fl_rounds, prepared.size, [0.0] * (prepared.size + 1))[-1]
    return metrics.ranking_metrics(logistic.score_models(prepared.test, {"cluster": last}, prepared.size), ["model"])


_TRAIN = f"""base AS (SELECT id, label, silo FROM cohort), {_quota('', False)},
ranked AS ({_ranked('label', 'split')} FROM base),
train AS (SELECT r.id, r.label, r.silo FROM ranked r JOIN quotas q ON r.label = q.label WHERE r.rk > q.q)"""


@query("cluster_strategy", f"""WITH {COHORT}, {_TRAIN}
SELECT CAST(round AS INTEGER) AS round, count(DISTINCT silo) AS hospitals, least(3, count(DISTINCT silo)) AS clusters, count(*) AS n,
  sum(label)::BIGINT AS n_pos, count(*) AS n_weighted, 0.0 AS mean_gap FROM train, range(1, 4) t(round) WHERE silo IS NOT NULL GROUP BY round""")
def cluster_strategy(spark, folder):
    """Averaging over clusters of nations by population, wealth and label rate: sizes per round, and the weighted mean of the
    silos' scores beside one taken from their rows."""
    prepared = _prepared(spark, folder, augment_data=False)
    people = table(spark, folder, "customer").groupBy(F.col("c_nationkey").alias("silo"))
    nations = people.agg(
        F.avg(S.flag_equals(F.col("c_mktsegment"), "BUILDING")).alias("building"), F.avg(F.signum("c_acctbal")).alias("in_credit")
    )
    found = run_clusters(prepared, nations, ["building", "in_credit"])
    sizes = found.clusters.agg(
        F.count(F.lit(1)).alias("hospitals"), F.count_distinct("hospital_cluster").alias("clusters"), F.sum("n").alias("n"),
    )
    pos = found.local_params.agg(F.sum("n_pos").alias("n_pos"))
    silos = found.metrics.filter("silo IS NOT NULL AND metric = 'local_auroc'").groupBy("round")
    means = silos.agg(F.sum("n").alias("n_weighted"), (F.sum(F.col("value") * F.col("n")) / F.sum("n")).alias("mean"))
    stated = found.metrics.filter("silo IS NULL AND metric = 'local_weighted_auroc'").select("round", F.col("value").alias("stated"))
    gap = F.round(F.abs(F.col("mean") - F.col("stated")), 3).alias("mean_gap")
    rounds = means.join(stated, "round").select("round", "n_weighted", gap)  # one row per round
    return rounds.crossJoin(F.broadcast(sizes)).crossJoin(F.broadcast(pos))  # one row each


def _run_sql(source: str, label: str) -> str:
    """SQL of the counts that a run of strategies 1 and 2 reports."""
    train = f"base AS (SELECT {label} AS label FROM {source}), {_quota('', False)}"
    return f"""WITH {train}, kept AS (SELECT sum(n - q) AS n, sum(n - q) FILTER (label = 1) AS n_pos, sum(q) AS n_test FROM quotas)
SELECT strategy, CAST(n AS BIGINT) AS n, CAST(n_pos AS DOUBLE) AS n_pos, round(n_pos / n * 100, 1) AS rate_pct, CAST(n_test AS BIGINT) AS n_test,
  CASE strategy WHEN 'pooled' THEN NULL ELSE (SELECT count(DISTINCT part)::DOUBLE FROM (SELECT CASE c_nationkey % 4 WHEN 0 THEN 1 WHEN 1 THEN 2 WHEN 2 THEN 3 ELSE 4 END AS part FROM customer)) END AS participants
FROM kept, (VALUES ('pooled'), ('fedavg_region')) AS s(strategy)"""


def _run_report(result) -> DataFrame:
    """What a run reports of its rows: sizes of both sides, positives and how many silos took part."""
    n = result.results.metrics.filter("metric = 'n_pos'").select("strategy", "n")
    tested = result.results.metrics.filter("metric = 'global_ap'").groupBy("strategy").agg(F.max("n").alias("n_test"))
    return result.summary.select("strategy", "n_pos", "rate_pct", "participants").join(n, "strategy").join(tested, "strategy")


@query("bank_run", _run_sql("customer", "CASE WHEN c_custkey % 6 = 0 THEN 1 ELSE 0 END"))
def bank_run(spark, folder):
    """A whole run on the bank features, regions as silos; the customers play the accounts."""
    raw = table(spark, folder, "customer").selectExpr(
        *[f"cast({e} AS double) AS {n}" for n, e in _BANK.items()], *[f"{e} AS {n}" for n, e in _BANK_TEXT.items()],
        "cast(c_custkey % 300 + 400 AS double) AS CreditScore", "cast(c_custkey % 2 AS double) AS HasCrCard",
        "CASE WHEN c_custkey % 6 = 0 THEN 1 ELSE 0 END AS Exited",
    )
    return _run_report(run(datasets.bank_features(raw), datasets.BANK, RunConfig(strategies=(1, 2)), "bank"))


@query("heart_run", _run_sql("lineitem", "CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END").replace(
    "(SELECT CASE c_nationkey % 4 WHEN 0 THEN 1 WHEN 1 THEN 2 WHEN 2 THEN 3 ELSE 4 END AS part FROM customer)",
    "(SELECT l_suppkey % 4 AS part FROM lineitem)"))
def heart_run(spark, folder):
    """A whole run on the heart features with four sites; the order lines play the patients."""
    site = "cast(l_suppkey % 4 AS int)"
    raw = table(spark, folder, "lineitem").selectExpr(
        *[f"cast({e} AS double) AS {n}" for n, e in _HEART.items()],
        f"concat('site ', {site}) AS region", f"{site} AS hospitalid",
    )
    return _run_report(run(datasets.heart_features(raw), datasets.HEART, RunConfig(strategies=(1, 2)), "heart"))


@query("wide_lr_at_optimum", f"""WITH {BASE}
SELECT CAST(b.silo AS VARCHAR) AS model, count(*) AS n, sum(b.label)::BIGINT AS n_pos, count(*) / 2.0::DOUBLE AS mass,
  (SELECT count(DISTINCT l_partkey % 150) + 1 FROM lineitem) AS n_flat
FROM base AS b WHERE b.silo IS NOT NULL GROUP BY b.silo""")
def wide_lr_at_optimum(spark, folder):
    """One model per nation on 150 counts of parts: weighted probabilities add up to half the rows (the intercept's condition), and
    the gradient vanishes in every part that occurs and in the intercept."""
    size = 150
    rows = base(spark, folder).filter(F.col("silo").isNotNull()).select("id", "silo", "label")
    part = (F.col("l_partkey") % size).cast("int")
    lines = table(spark, folder, "lineitem").groupBy(F.col("l_orderkey").alias("id"), part.alias("place"))
    lines = lines.agg(F.count(F.lit(1)).cast("double").alias("value"))
    bags = lines.groupBy("id").agg(F.collect_list(F.struct("place", "value")).alias("bag"))
    rows = relational.attach(rows, bags, "id")
    inside = F.filter(F.coalesce("bag", F.array().cast(bags.schema["bag"].dataType)), lambda e: e["place"].between(0, size - 1))
    rows = rows.select("silo", "label", inside.alias("bag"))
    rows = materialize(rows.withColumn("features", dense("bag", size)), "wide-rows")
    params = logistic.fit_grouped(rows, F.array(F.col("silo").cast("string"))).withColumn("silo", F.col("model").cast("int"))
    joined = rows.join(F.broadcast(params.select("silo", "model", "n", "n_pos", "params")), "silo")  # few models
    n, pos, seen = F.col("n"), F.col("n_pos"), F.lit(CONFIG.c)
    weight = F.when(F.col("label") == 1, n / (2 * pos)).otherwise(n / (2 * (n - pos)))
    # counts of 0 add nothing to a score or a slope; the intercept is a count of 1 at the last place
    one = F.array(F.struct(F.lit(size).alias("place"), F.lit(1.0).alias("value")))
    whole = joined.select("model", "label", weight.alias("w"), "params", F.concat("bag", one).alias("bag"))
    score = F.aggregate("bag", F.lit(0.0), lambda z, e: z + e["value"] * F.get("params", e["place"]))
    scored = whole.withColumn("p", 1.0 / (1.0 + F.exp(-score)))
    error = F.col("w") * (F.col("p") - F.col("label"))
    cells = scored.select("model", "w", "p", error.alias("e"), F.inline("bag").alias("i", "x"))
    sums = cells.groupBy("model", "i").agg(
        F.sum(F.col("e") * F.col("x")).alias("g"), F.sum(F.when(F.col("i") == size, F.col("w") * F.col("p"))).alias("mass")
    )
    slopes = params.select("model", "n", "n_pos", F.posexplode("params").alias("i", "v")).join(sums, ["model", "i"], "left")
    slope = F.abs(seen * F.coalesce("g", F.lit(0.0)) + F.when(F.col("i") < size, F.col("v")).otherwise(F.lit(0.0)))
    return slopes.groupBy("model", "n", "n_pos").agg(F.round(F.sum("mass"), 2).alias("mass"), F.count_if(slope < 1e-5).alias("n_flat"))


@query("regional_comparison")
def regional_comparison(spark, folder):
    prepared = _prepared(spark, folder)
    found = run_linear(prepared, (1, 2), evaluate=False).params
    params = {r.strategy: list(r.params) for r in found.orderBy("round").collect()}
    return compare_regions(prepared, params["pooled"], params["fedavg_region"]).regions


# Rows of the training table that the global split leaves, cut once more inside every region.
_REGION_TESTS = _quota("region", True).replace("FROM base", "FROM train")
for _name in ("sizes", "shares", "plain", "quotas"):
    _REGION_TESTS = re.sub(rf"\b{_name}\b", f"r_{_name}", _REGION_TESTS)


@query("mlp_regional", f"""WITH {COHORT}, base AS (SELECT id, label, region FROM cohort), {_quota('', False)},
ranked AS ({_ranked('label', 'split')} FROM base),
train AS (SELECT r.id, r.label, coalesce(r.region, 'Unknown') AS region FROM ranked r JOIN quotas q ON r.label = q.label WHERE r.rk > q.q),
{_REGION_TESTS},
counted AS (
  SELECT region, CAST(sum(q) AS BIGINT) AS n_test, sum(n) AS n, sum(n) FILTER (label = 1) AS n_pos, count(*) FILTER (q > 0) = 2 AS mixed
  FROM r_quotas GROUP BY region)
SELECT region, n_test, round(n_pos / n * 100, 1) AS pos_pct, n_test < 50 AS small_warn,
  CASE WHEN mixed THEN 5 ELSE 0 END AS n_scores, CASE WHEN mixed THEN 3 ELSE 0 END AS n_gains, CASE WHEN mixed THEN 1 ELSE 0 END AS n_best
FROM counted WHERE n >= 10 AND n_pos >= 2 AND n - n_pos >= 1""")
def mlp_regional(spark, folder):
    """The comparison of perceptrons: its regions, and how many scores, gains and best values in each are as they have to be."""
    prepared = _prepared(spark, folder, algorithm="mlp", fl_rounds=1)
    found = {r.strategy: list(r.params) for r in run_mlp(prepared, (1, 2)).params.collect()}
    regions = compare_regions(prepared, found["pooled"], found["fedavg_region"]).regions

    def count(*conditions) -> Column:
        return sum((F.coalesce(c, F.lit(False)).cast("int") for c in conditions), F.lit(0))

    scores = [F.col(f"e{k}_auroc") for k in (2, 3, 4, 5, 6)]
    gains = [F.abs(F.col(f"e{k}_auroc") - F.col("e2_auroc") - F.col(f"e{k}_auroc_uplift")) < 1e-9 for k in (3, 4, 5)]
    best = F.greatest(*scores[:4]) == F.col("best_auroc")
    return regions.select(
        "region", "n_test", "pos_pct", "small_warn", count(*[s.between(0, 1) for s in scores]).alias("n_scores"),
        count(*gains).alias("n_gains"), count(best).alias("n_best"),
    )


@query("mlp_pooled")
def mlp_pooled(spark, folder):
    prepared = _prepared(spark, folder)
    w = neural.fit_mlp(prepared.train, "label", "features", prepared.size)
    scores = neural.score_mlp(prepared.test, w, prepared.size).withColumn("model", F.lit("mlp"))
    return metrics.ranking_metrics(scores, ["model"])


@query("mlp_fedavg")
def mlp_fedavg(spark, folder):
    prepared = _prepared(spark, folder)
    rows = prepared.train.withColumn("region", S.relabel_null(F.col("region")))
    rounds = neural.federated_mlp(rows, "region", "label", "features", prepared.size)
    scores = None
    for r, w in enumerate(rounds, 1):
        part = neural.score_mlp(prepared.test, w, prepared.size).withColumn("round", F.lit(r))
        scores = part if scores is None else scores.unionByName(part)
    return metrics.ranking_metrics(scores, ["round"])


def _perceptron(spark, folder, *strategies: int, **changes):
    prepared = _prepared(spark, folder, algorithm="mlp", **changes)
    return run_mlp(prepared, strategies)


@query("mlp_summary")
def mlp_summary(spark, folder):
    """All five strategies with the perceptron: one row each."""
    found = _perceptron(spark, folder, 1, 2, 3, 4, 5).metrics
    return store.summarize(found.filter(F.col("silo").isNull()), SUMMARY)


@query("mlp_gated")
def mlp_gated(spark, folder):
    return _perceptron(spark, folder, 3, auroc_gate=0.9).gate
