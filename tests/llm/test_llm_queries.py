import math
from pathlib import Path

import duckdb
import pytest
from conftest_llm import brute_groups, make
from test_llm_passages import contaminated

import __spark_entry__ as entry
import corpus_pipeline
from silo_analytics.llm import queries
from silo_analytics.scratch import materialize

FOLDER = Path("/root/testdata/sf0.001")
TABLES = "documents embeddings benchmark labels conversations"
pytestmark = pytest.mark.skipif(not FOLDER.exists(), reason="driver tables are not here")


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_gives_the_rows_of_its_sql(spark, name):
    con = duckdb.connect()
    for t in TABLES.split():
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{FOLDER}/{t}.parquet')")
    ours = entry.queries()[name](spark, str(FOLDER))
    result = con.execute(entry.oracle_sql()[name])
    names = [d[0] for d in result.description]
    assert sorted(names) == sorted(ours.columns)
    assert sorted(map(str, map(tuple, ours.select(*names).collect()))) == sorted(map(str, result.fetchall()))


def test_every_operator_has_one_query():
    found = [n for n in entry.queries() if n.startswith("op")]
    assert sorted(int(n[2:].split("_")[0]) for n in found) == list(range(1, 14)) and "pipeline" in entry.queries()


def test_pipeline_stages(spark):
    """Each stage against what its predecessor kept."""
    folder = str(FOLDER)
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    kept = [docs]
    for name, stage in corpus_pipeline.STAGES:
        kept.append(materialize(stage(spark, kept[-1], folder), name))
    assert all(k.columns == docs.columns for k in kept[:-1])
    rows = [{r.doc_id: r.text for r in k.collect()} for k in kept[:-1]]
    assert all(set(b) <= set(a) for a, b in zip(rows, rows[1:]))
    # near copies: one document of each group of the stage's input
    prints = {r.doc_id: int(r.fingerprint, 16) for r in queries.QUERIES["op1_simhash_pivots"](spark, folder).collect()}
    ids = sorted(rows[1])
    groups = brute_groups([prints[d] for d in ids], lambda a, b: (a ^ b).bit_count() <= 4)
    assert set(rows[2]) == {ids[g] for g in groups}
    items = duckdb.sql(f"SELECT item_id, text FROM read_parquet('{folder}/benchmark.parquet')").fetchall()
    dirty = {d for d, t in rows[2].items() if "True" in contaminated([(d, t)], items, 10)[0]}
    assert set(rows[3]) == set(rows[2]) - dirty
    total = sum(len(t.split()) for t in rows[3].values())
    assert 0.5 * total < sum(len(t.split()) for t in rows[4].values()) <= 0.8 * total
    out = kept[-1].orderBy("start").collect()
    assert [r.doc_id for r in out] == sorted(rows[4]) and out[0].start == 0
    assert all(a.start + a.n_tokens == b.start for a, b in zip(out, out[1:])) and not math.isnan(out[0].n_tokens)


def test_clean_texts_stay_beside_contaminated_ones_of_the_same_id(spark, tmp_path):
    item = "one two three four five six seven eight nine ten eleven"
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    rows = [(None, f"a {item} b"), (None, "clean"), (None, None), (7, item), (7, "clean"), (7, "clean"), (8, "other")]
    kept = corpus_pipeline.drop_benchmark(spark, make(spark, rows), str(tmp_path))
    expected = [r for r in rows if item not in (r[1] or "")]
    assert sorted(map(str, map(tuple, kept.select("doc_id", "text").collect()))) == sorted(map(str, expected))
