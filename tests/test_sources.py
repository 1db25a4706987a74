import gzip

import pytest

from silo_analytics.schemas import schema
from silo_analytics.sources import convert as C
from silo_analytics.sources import datasets as D
from silo_analytics.sources import tables as S

SCHEMA = schema("id bigint, name string, x double")


def write(path, text):
    opener = gzip.open if str(path).endswith(".gz") else open
    with opener(path, "wt") as f:
        f.write(text)


def test_csv_prefers_gzip_and_types_by_name(spark, tmp_path):
    write(tmp_path / "t.csv.gz", 'x,extra,id,name\n1.5,e,3,"a, b"\nNA,e,4,NaN\nbad,e,5.0,c\n')
    write(tmp_path / "t.csv", "x,id,name\n9,9,z\n")
    rows = sorted(tuple(r) for r in S.read_table(spark, str(tmp_path), "t", SCHEMA).collect())
    assert rows == [(3, "a, b", 1.5), (4, None, None), (5, "c", None)]
    (tmp_path / "only").mkdir()
    write(tmp_path / "only" / "t.csv", "x,id,name\n9,9,z\n")
    assert S.read_table(spark, str(tmp_path / "only"), "t", SCHEMA).collect()[0].name == "z"
    with pytest.raises(FileNotFoundError):
        S.read_table(spark, str(tmp_path), "absent", SCHEMA)
    with pytest.raises(ValueError):
        S.read_table(spark, str(tmp_path), "t", schema("nope int"))


def test_name_in_any_case(spark, tmp_path):
    write(tmp_path / "CHURN_modelling.csv", "id,name,x\n1,a,2\n")
    assert S.read_any_case(spark, str(tmp_path), "Churn_Modelling.csv", SCHEMA).count() == 1
    assert D.folder_problems(spark, str(tmp_path), "bank") == []
    assert D.folder_problems(spark, str(tmp_path), "heart") == [f"table {f} has no file {f}" for f, _, _ in D.HEART_SITES]
    assert len(D.folder_problems(spark, str(tmp_path), "icu")) == 6
    assert D.folder_problems(spark, str(tmp_path / "no"), "icu")[0].startswith("no folder")


def test_heart_sites(spark, tmp_path):
    line = "{age},1,3,{bp},200,0,0,150,1,2.0,2,?,3.0,{target}\n"
    for i, (file, _, _) in enumerate(D.HEART_SITES):
        write(tmp_path / file, line.format(age=50 + i, bp="?" if i == 0 else 100 + i, target=3 if i else 0)
              + line.format(age=40, bp=130, target="?"))
    rows = D.load_heart(spark, str(tmp_path)).collect()
    assert len(rows) == 8
    assert {(r.region, r.hospitalid) for r in rows} == {(n, h) for _, n, h in D.HEART_SITES}
    assert {r.age: r.readmitted for r in rows} == {50.0: 0, 51.0: 1, 52.0: 1, 53.0: 1, 40.0: 0}
    first = next(r for r in rows if r.age == 50.0)
    assert first.trestbps == 130.0  # median of 101, 102, 103, 130 x 4
    assert first.ca is None and first.age_thalach == 7500.0 and first.oldpeak_slope == 4.0 and first.cp_exang == 3.0


def test_bank(spark, tmp_path):
    write(
        tmp_path / "Churn_Modelling.csv",
        "CreditScore,Age,Tenure,Balance,NumOfProducts,HasCrCard,IsActiveMember,EstimatedSalary,Gender,Geography,Exited\n"
        "600,40,2,100,1,1,0,0,MALE,France,1\n600,40,2,100,2,1,1,99,Female,Italy,0\n600,40,2,100,2,1,1,,Female,Spain,0\n",
    )
    rows = D.load_bank(spark, str(tmp_path)).orderBy("hospitalid").collect()
    assert [r.hospitalid for r in rows] == [0, 1, 3]
    assert [r.balance_salary_ratio for r in rows] == [1.0, 0.0, 0.0]
    assert [r.Gender_enc for r in rows] == [0, 1, 0]
    assert [r.products_active for r in rows] == [2.0, 0.0, 2.0]
    assert [r.readmitted for r in rows] == [0, 1, 0]
    assert set(D.BANK.features) <= set(rows[0].asDict())


def test_check_sources(spark):
    df = spark.createDataFrame([(1,)], "a int")
    got = {tuple(r) for r in S.check_sources({"t": df}, {"t": ["a", "b"], "u": ["x"]}, spark).collect()}
    assert got == {("t", "column b is missing"), ("u", "table is missing")}


def test_profile_of_sources(spark):
    df = spark.createDataFrame([("1", None, 1), ("x", None, 2), (None, None, 3)], "a string, b string, c int")
    expected = {"t": {"a": "int", "b": "double", "c": "int", "d": "int"}, "u": {"x": "int"}, "v": {"a": "int"}}
    got = {(r.table, r.column): tuple(r)[2:] for r in S.profile_sources({"t": df, "v": df.where("false")}, expected, spark).collect()}
    assert got == {
        ("t", "a"): (3, 1, 1, "values of another type"), ("t", "b"): (3, 3, 0, "no value at all"), ("t", "c"): (3, 0, 0, None),
        ("t", "d"): (3, None, None, "column is missing"), ("u", None): (None, None, None, "table is missing"),
        ("v", "a"): (0, 0, 0, "table is empty"),
    }
    assert S.profile_sources({}, {}, spark).count() == 0


NOTES = 'id,name,x\n1,"two\nlines, ""quoted""",1.5\n2,b,\n2,b,\n3,,7\n'


def parquet_files(folder):
    return sorted((p.relative_to(folder), p.stat().st_mtime_ns) for p in folder.rglob("part-*"))


def test_conversion_keeps_line_breaks_and_runs_once(spark, tmp_path):
    write(tmp_path / "t.csv.gz", NOTES)
    source, target = str(tmp_path / "t.csv.gz"), str(tmp_path / "out")
    assert C.convert_csv(spark, source, target, SCHEMA, rows_per_file=2)
    rows = C.read_converted(spark, target).collect()
    assert sorted((r.id, r.name, r.x) for r in rows if r.id != 2) == [(1, 'two\nlines, "quoted"', 1.5), (3, None, 7.0)]
    assert [(r.id, r.name, r.x) for r in rows if r.id == 2] == [(2, "b", None)] * 2
    assert len({r.row_id for r in rows}) == 4
    assert len(list((tmp_path / "out").glob("data-*/part-*"))) >= 2
    before = parquet_files(tmp_path / "out")
    assert not C.convert_csv(spark, source, target, SCHEMA, rows_per_file=2)
    assert parquet_files(tmp_path / "out") == before
    # Ids follow from the content, whatever the place and the size of the files.
    assert C.convert_csv(spark, source, str(tmp_path / "other"), SCHEMA)
    ids = {r.row_id for r in C.read_converted(spark, str(tmp_path / "other")).collect()}
    assert ids == {r.row_id for r in rows}


def test_conversion_follows_the_source_and_survives_a_broken_run(spark, tmp_path, monkeypatch):
    source, target = str(tmp_path / "t.csv"), str(tmp_path / "out")
    write(tmp_path / "t.csv", NOTES)
    with pytest.raises(FileNotFoundError):
        C.read_converted(spark, target)
    C.convert_csv(spark, source, target, SCHEMA)
    write(tmp_path / "t.csv", NOTES + "9,new,1\n")
    with monkeypatch.context() as broken:
        broken.setattr(C, "local_table", None)  # the manifest is not written
        with pytest.raises(TypeError):
            C.convert_csv(spark, source, target, SCHEMA)
    assert C.read_converted(spark, target).count() == 4
    assert C.convert_csv(spark, source, target, SCHEMA)
    assert C.read_converted(spark, target).count() == 5
    assert not C.convert_csv(spark, source, target, SCHEMA)
    assert C.convert_csv(spark, source, target, schema("id bigint, name string"))
    assert C.read_converted(spark, target).columns == ["row_id", "id", "name"]


def test_conversion_of_nothing(spark, tmp_path):
    write(tmp_path / "t.csv", "id,name,x\n")
    assert C.convert_csv(spark, str(tmp_path / "t.csv"), str(tmp_path / "out"), SCHEMA)
    found = C.read_converted(spark, str(tmp_path / "out"))
    assert found.count() == 0 and found.columns == ["row_id", "id", "name", "x"]
    with pytest.raises(FileNotFoundError):
        C.convert_csv(spark, str(tmp_path / "absent.csv"), str(tmp_path / "out"), SCHEMA)
    with pytest.raises(ValueError):
        C.convert_csv(spark, str(tmp_path / "t.csv"), str(tmp_path / "out"), SCHEMA, key="id")
