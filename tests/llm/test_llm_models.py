import zlib

import numpy as np
import pytest
from conftest_llm import make
from pyspark.sql import functions as F

from silo_analytics.llm import quality, queries, toxicity

FOLDER = "/root/testdata/sf0.01"


def accuracy(rows, labels, column):
    known = {r.doc_id: r[column] for r in labels.collect()}
    held = [r for r in rows if r.held_out and known.get(r.doc_id) is not None]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in rows)
    assert all(0 <= r.score <= 1 for r in rows)
    return np.mean([r.predicted == known[r.doc_id] for r in held])


@pytest.mark.parametrize("name,column,cut,least", [
    ("op2_bradley_terry", "quality", 0.5, 0.97), ("op9_boosted_toxicity", "toxic", 0.7, 0.93)
])
def test_held_out_accuracy(spark, name, column, cut, least):
    rows = queries.QUERIES[name](spark, FOLDER).collect()
    labels = spark.read.parquet(f"{FOLDER}/labels.parquet")
    assert len(rows) == 1000 and all(r.predicted == (r.score >= cut) for r in rows)
    assert accuracy(rows, labels, column) >= least


def labels_of(spark, column, rows):
    return spark.createDataFrame([(*r, "z") for r in rows], f"doc_id long, {column} int, text string")


@pytest.mark.parametrize("column,score", [("quality", quality.quality_scores), ("toxic", toxicity.toxicity_scores)])
def test_odd_documents_and_labels(spark, odd, none, column, score):
    some = labels_of(spark, column, [(k, k % 2) for k in range(60)] + [(3, 0), (None, 1), (70, None), (5, 1), (100, 0), (101, 1)])
    got = score(odd, some).collect()
    assert sorted(str(r.id) for r in got) == sorted(str(r.doc_id) for r in odd.collect())
    assert all(0 <= r.score <= 1 for r in got)
    assert score(none, some).collect() == []
    one = score(odd, labels_of(spark, column, [(k, 1) for k in range(60)])).collect()
    assert {r.score for r in one} == {1.0}
    unlabelled = {r.score for r in score(odd, labels_of(spark, column, [])).collect()}
    assert unlabelled == {0.5 if column == "quality" else 0.0}


@pytest.mark.parametrize("column,score", [("quality", quality.quality_scores), ("toxic", toxicity.toxicity_scores)])
def test_held_out_labels_change_nothing(spark, column, score):
    rows = [(k, ("good words of a text " * 5 if k % 3 else "bad!!! BAD!!! ") + str(k)) for k in range(120)]
    docs = make(spark, rows)
    held = {k for k in range(120) if zlib.crc32(str(k).encode()) % 3 == 1}
    true = [(k, int(k % 3 > 0)) for k in range(120)]
    turned = [(k, 1 - y if k in held else y) for k, y in true]
    a, b = (sorted(map(tuple, score(docs, labels_of(spark, column, ls)).collect())) for ls in (true, turned))
    assert a == b


def test_pairs_rank_good_over_bad():
    draw = np.random.default_rng(0)
    x = draw.normal(size=(400, len(quality.FEATURES)))
    y = (x[:, 3] - x[:, 7] + draw.normal(0, 0.3, 400) > -0.5).astype(int)
    model = quality.fit_ranking(x, y)
    scores = model.scores(x)
    assert np.mean((scores >= 0.5) == y) > 0.9
    # the cut leaves as many documents below as there are bad labels
    assert (scores < 0.5).sum() == (y == 0).sum()
    assert quality.fit_ranking(x, np.ones(400)) is None


def test_lexicon_leaves_copied_passages_out(spark):
    rows = [(f"clean words number {k} and {k * 7 % 13} more plain text here", 0) for k in range(200)]
    rows += [(f"some {chr(97 + k)} zonk text {chr(98 + k)} brak and words {k}", 1) for k in range(20)]
    rows += [(f"zonk a copied passage of rare wumpus things {k}", 1) for k in range(20)]
    words, begins = toxicity.learn_lexicon(spark.createDataFrame(rows, "text string, y int").where(F.lit(True)))
    assert {b"zonk", b"brak"} <= words and not {b"wumpus", b"copied", b"words"} & words and not begins


def test_obfuscated_words_are_undone():
    lexicon = frozenset([b"stupid", b"trash"])
    names = toxicity.FEATURES
    get = lambda t: dict(zip(names, toxicity.features(t, lexicon, frozenset(), toxicity._blanks())))
    assert get(b"you are stupid")["hits"] > 0 and get(b"you are stupid")["near_second_person"] > 0
    for text in (b"so $tup1d", b"a tr4sh thing", b"s t u p i d", b"stuuupid"):
        assert get(text)["undone_hits"] > 0, text
    assert get(b"")["words"] == 0


def test_clean_texts_stay_beside_toxic_ones_of_the_same_id(spark):
    clean, toxic = "good words of a text " * 5, "bad!!! BAD!!! "
    rows = [(k, (clean if k % 3 else toxic) + str(k)) for k in range(120)]
    ids = [k for k in range(120) if zlib.crc32(str(k).encode()) % 3 != 1]
    odd = [(None, toxic), (None, clean), (None, clean + "2"), (None, None), (500, toxic), (500, clean)]
    docs = make(spark, rows + odd)
    labels = labels_of(spark, "toxic", [(k, int(k % 3 == 0)) for k in ids])
    kept = toxicity.clean_documents(docs, labels)
    assert kept.columns == docs.columns
    got = [(r.doc_id, r.text) for r in kept.select("doc_id", "text").collect() if r.doc_id in (None, 500)]
    assert {(None, clean), (None, clean + "2"), (500, clean)} <= set(got)
    assert not {(None, toxic), (500, toxic)} & set(got)
