"""The registered queries on tables with null and repeated ids, copies, empties and clashing columns, against their SQL."""

import random

import duckdb
import pytest
from conftest_llm import make

import corpus_pipeline
from silo_analytics.llm import queries
from silo_analytics.scratch import materialize

TABLES = "documents embeddings benchmark labels conversations"


def odd_documents():
    draw = random.Random(9)
    words = ["".join(draw.choices("abcdeft", k=draw.randint(2, 6))) for _ in range(120)]
    texts = [" ".join(draw.choices(words, k=draw.choice([2, 12, 40, 90]))) for _ in range(60)]
    lines = "\n".join(f"shared line {k}" for k in range(4))
    texts += [f"{texts[k]}\n{lines}\n{texts[k + 1]}" for k in range(5)] + [None, "", "one", "a\nb", lines]
    rows = [(k if k % 3 else None, t) for k, t in enumerate(texts)]
    # The same row under a null and a known id, many times; several texts under one id.
    rows += [(None, texts[62])] * 7 + [(500, texts[63])] * 4 + [(501, texts[3]), (501, texts[4]), (None, None), (None, "")]
    return rows


@pytest.fixture(scope="module")
def odd_folder(spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("odd"))
    docs = make(spark, odd_documents()).repartition(5)
    texts = [t for _, t in odd_documents() if t]
    items = [(1, texts[2]), (1, texts[5]), (2, "a, B"), (None, texts[7]), (None, texts[8]), (3, None), (4, ""), (5, texts[2]), (6, "zzzz")]
    vectors = [(k if k % 7 else 7, [k % 5 - 2.0, 0.25 * k, -0.5]) for k in range(120)]
    vectors += [(50, [0.1, 0.2, 0.3]), (50, [0.9, 0.9, 0.1]), (7, [0.9, 0.9, 0.9]), (7, [0.9, 0.9, 0.9]), (None, [1.0, 1.0, 1.0]), (8, None), (9, [1.0, None, 2.0])]
    draw = random.Random(3)
    talk = [(c, t, draw.choice(["user", "bot", None]), draw.choice(["hi", "", None, "yes", "ünï"])) for c in range(40) for t in range(draw.randint(1, 12))]
    talk += [(41, None, "user", "hi"), (41, None, "user", "hi"), (41, 0, "bot", "x"), (None, 1, "user", "lost"), (46, 0, "user", "hi"), (52, 0, "a", "b")]
    talk += [(60, t, "user", f"turn {t % 7}") for t in range(90)] + [(61, 1, "user", "own")]
    labels = [(k, k % 2, (k // 2) % 2) for k in range(60)] + [(None, 1, 1), (5, None, None)]
    made = {
        "documents": docs,
        "benchmark": spark.createDataFrame([(*i, "x") for i in items], "item_id long, text string, id string"),
        "embeddings": spark.createDataFrame(vectors, "vec_id long, embedding array<float>"),
        "conversations": spark.createDataFrame([(*t, 1) for t in talk], "conv_id long, turn long, role string, text string, depth int").repartition(4),
        "labels": spark.createDataFrame(labels, "doc_id long, quality int, toxic int"),
    }
    for name, rows in made.items():
        rows.write.parquet(f"{folder}/{name}.parquet")
    return folder


def compared(spark, name, folder):
    con = duckdb.connect()
    for t in TABLES.split():
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{folder}/{t}.parquet/*.parquet')")
    ours = queries.QUERIES[name](spark, folder)
    result = con.execute(queries.ORACLES[name])
    names = [d[0] for d in result.description]
    assert sorted(names) == sorted(ours.columns)
    return sorted(map(str, map(tuple, ours.select(*names).collect()))), sorted(map(str, result.fetchall()))


# The SQL of these two names documents by their id, so it only holds for unique ones.
@pytest.mark.parametrize("name", sorted(set(queries.ORACLES) - {"op6_winnowing", "op7_recompression"}))
def test_query_and_sql_agree_on_odd_tables(spark, odd_folder, name):
    ours, expected = compared(spark, name, odd_folder)
    assert ours == expected


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_queries_on_empty_tables(spark, odd_folder, tmp_path, name):
    for t in TABLES.split():
        spark.read.parquet(f"{odd_folder}/{t}.parquet").where("false").write.parquet(f"{tmp_path}/{t}.parquet")
    assert queries.QUERIES[name](spark, str(tmp_path)).count() == 0


def test_pipeline_on_odd_tables(spark, odd_folder):
    """Null and repeated ids, copies and clashing columns pass all stages; each keeps whole rows of its predecessor."""
    docs = spark.read.parquet(f"{odd_folder}/documents.parquet")
    kept = [docs]
    for name, stage in corpus_pipeline.STAGES:
        kept.append(materialize(stage(spark, kept[-1], odd_folder), name))
    assert all(k.columns == docs.columns for k in kept[:-1])
    rows = [sorted(map(str, map(tuple, k.select("doc_id", "text").collect()))) for k in kept[:-1]]
    assert all(set(b) <= set(a) for a, b in zip(rows, rows[1:])) and rows[-1]
    out = kept[-1].orderBy("start").collect()
    assert len(out) == len(rows[-1]) and all(a.start + a.n_tokens == b.start for a, b in zip(out, out[1:]))


def test_pipeline_on_empty_tables(spark, odd_folder, tmp_path):
    for t in TABLES.split():
        rows = spark.read.parquet(f"{odd_folder}/{t}.parquet")
        # Models need labelled rows; the stages after that get none at all.
        (rows if t == "labels" else rows.where("false")).write.parquet(f"{tmp_path}/{t}.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[1:]:
        docs = materialize(stage(spark, docs, str(tmp_path)), name)
        assert docs.count() == 0
