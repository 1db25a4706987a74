"""Toxicity by gradient-boosted trees over dense features, calibrated by isotonic regression.

The lexicon is learned from the labelled sample: words, and beginnings of words, that are found
in many different surroundings of toxic documents and rarely in others.  Counting different
words before a word, instead of documents, keeps passages that were copied out of it.

Features are densities and rates of a document: lexicon hits, hits next to the second person,
hits after undoing look-alike signs, capitals, punctuation, and obfuscated words.  The trees
and the calibration are fitted on separate parts of a bounded sample of the training folds.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..scratch import materialize
from .common import col, fold_of, labelled_rows, select_rows, texts_of, trimmed

SAMPLE = 16_000
LEXICON = 4_000
BEGINNING = 4
NEAR = 3
FEATURES = (
    "words", "hits", "hit_density", "begin_hits", "begin_density", "near_second_person", "second_person", "undone_hits",
    "capitals", "capital_words", "punctuation", "exclaims", "mixed_words", "stretched", "spaced", "longest_gap",
)
SECOND_PERSON = frozenset(
    "you your yours yourself u ur tu te toi ton ta tes vous votre vos du dich dir dein deine ihr euch euer "
    "ti tus usted ustedes vosotros".split()
)
_LOOKALIKE = str.maketrans("013457@$!|*", "oieastasiix")
_MIXED = re.compile(rb"[a-z][0-9@$!|*#]+[a-z]")
_STRETCHED = re.compile(rb"([a-z])\1\1")
_SPACED = re.compile(rb"(?:\b[a-z][ .\-_]){3,}[a-z]\b")


def _blanks() -> bytes:
    """Byte map that leaves small letters, digits and all bytes over 127."""
    return bytes(b if 48 <= b <= 57 or 97 <= b <= 122 or b > 127 else 32 for b in range(256))


def _terms(text: bytes | None, blanks: bytes) -> tuple[list[str], list[str]]:
    """The words of a text and, marked by ^, the beginnings of the longer ones."""
    words = [w.decode("utf-8", "replace") for w in (text or b"").lower().translate(blanks).split()]
    return words, ["^" + w[:BEGINNING] if len(w) > BEGINNING else "" for w in words]


def _surroundings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Distinct (term, word before) of each text."""
    blanks = _blanks()
    for batch in trimmed(batches):
        for text in texts_of(batch.column("text")):
            words, begins = _terms(text, blanks)
            before = ["", *words]
            pairs = list({*zip(words, before), *((b, w) for b, w in zip(begins, before) if b)})
            yield pa.record_batch([pa.array([p[k] for p in pairs], pa.string()) for k in (0, 1)], ["term", "before"])


def _found(batches: Iterator[pa.RecordBatch], wanted: frozenset[str]) -> Iterator[pa.RecordBatch]:
    """How many distinct (term, word before) the texts of a task have, by wanted term."""
    blanks, counts = _blanks(), Counter()
    for batch in trimmed(batches):
        for text in texts_of(batch.column("text")):
            words, begins = _terms(text, blanks)
            before = ["", *words]
            counts.update(t for t, _ in {*zip(words, before), *zip(begins, before)} if t in wanted)
    yield pa.record_batch([pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())], ["term", "n"])


def learn_lexicon(drawn: DataFrame, words: int = LEXICON) -> tuple[frozenset[bytes], frozenset[bytes]]:
    """(words, beginnings) typical of toxic rows of (text, y), at most ``words`` of each.

    Terms with few different words before them are left out: chance and copied passages give
    such.  Toxic documents must have the term at least six times as often as clean ones, and by
    more than chance explains.
    """
    toxic, clean = drawn.where("y = 1").select("text"), drawn.where("y = 0").select("text")
    around = toxic.mapInArrow(_surroundings, "term string, before string").groupBy("term").agg(
        F.count_distinct("before").alias("around")
    )
    enough = F.when(F.col("term").startswith("^"), 12).otherwise(4)
    rows = around.where(F.col("around") >= enough).orderBy(F.desc("around"), "term").limit(20 * words).collect()
    wanted = frozenset(r.term for r in rows)
    seen = clean.mapInArrow(partial(_found, wanted=wanted), "term string, n long").groupBy("term").agg(F.sum("n").alias("n"))
    usual = {r.term: r.n for r in seen.collect()}
    share = toxic.count() / max(clean.count(), 1)
    chance = share / (1 + share)

    def surprise(r) -> float:
        """Standard deviations by which toxic texts have more of the surroundings than their share."""
        known = r.around + usual.get(r.term, 0)
        return (r.around - chance * known) / (known * chance * (1 - chance)) ** 0.5

    chosen = [r.term for r in rows if surprise(r) >= 5 and r.around >= 6 * share * usual.get(r.term, 0)]
    plain = [t.encode() for t in chosen if not t.startswith("^")][:words]
    begin = [t[1:].encode() for t in chosen if t.startswith("^")][:words]
    return frozenset(plain), frozenset(begin)


def features(text: bytes, lexicon: frozenset[bytes], begins: frozenset[bytes], blanks: bytes) -> list[float]:
    low = text.lower()
    words = low.translate(blanks).split()
    n = len(words)
    if not n:
        return [0.0] * len(FEATURES)
    seen = np.bincount(np.frombuffer(text, np.uint8), minlength=256)
    letters = max(int(seen[65:91].sum() + seen[97:123].sum() + seen[128:].sum()), 1)
    place = [i for i, hit in enumerate(map(lexicon.__contains__, words)) if hit]
    begin = sum(w.decode("utf-8", "replace")[:BEGINNING].encode() in begins for w in set(words) if len(w) > BEGINNING) if begins else 0
    person = [i for i, w in enumerate(words) if w in _PERSONS]
    near = 0
    if place and person:
        at = np.searchsorted(person, place)
        spots = np.array([-(10**9), *person, 10**9])
        near = int(np.sum(np.minimum(np.array(place) - spots[at], spots[at + 1] - np.array(place)) <= NEAR))
    mixed = [m.group() for m in _MIXED.finditer(low)]
    spaced = _SPACED.findall(low)
    undone = 0
    if mixed:
        odd = {w.strip(".,;:?\"'()") for w in low.decode("utf-8", "replace").split() if not w.isalpha()}
        undone += sum(w.translate(_LOOKALIKE).encode() in lexicon for w in odd if not w.encode() in lexicon)
    for run in spaced:
        undone += re.sub(rb"[ .\-_]", b"", run) in lexicon
    stretched = {re.sub(rb"([a-z])\1\1+", rb"\1", w) for w in set(words) if _STRETCHED.search(w)} if _STRETCHED.search(low) else ()
    undone += sum(w in lexicon for w in stretched)
    gap = n if not place else int(np.diff([0, *place, n]).max())
    return [
        float(np.log1p(n)), float(np.log1p(len(place))), len(place) / n, float(np.log1p(begin)), begin / n, near / n,
        len(person) / n, float(np.log1p(undone)), seen[65:91].sum() / letters,
        sum(map(bytes.isupper, set(text.split()))) / n, (seen[33:48].sum() + seen[58:65].sum()) / len(text), seen[33] / n,
        len(mixed) / n, len(stretched) / n, len(spaced) / n, gap / n,
    ]


_PERSONS = frozenset(w.encode() for w in SECOND_PERSON)


def _features(
    batches: Iterator[pa.RecordBatch], lexicon: frozenset[bytes], begins: frozenset[bytes], keep: str
) -> Iterator[pa.RecordBatch]:
    blanks = _blanks()
    for batch in trimmed(batches):
        rows = [features(t or b"", lexicon, begins, blanks) for t in texts_of(batch.column("text"))]
        yield pa.record_batch([batch.column(keep), pa.array(rows, pa.list_(pa.float64()))], [keep, "x"])


def toxicity_scores(
    docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, seed: int = 29, threshold: float = 0.7,
    id_col: str = "doc_id", text_col: str = "text",
) -> DataFrame:
    """id, text_hash, held_out, score (0 to 1) and predicted (score >= ``threshold``) of every row of ``docs``.

    Labels come from ``labels`` (doc_id, toxic), only from ids outside the held-out fold.
    Null texts count as empty; empty texts are scored like others.  Without labels of both
    kinds every score is 1.0, 0.0 or, without any label, 0.0.  Repeated rows give repeated
    rows.  Other columns are not read.
    """
    rows = docs.select(col(id_col).alias("doc_id"), col(text_col).alias("text"))
    drawn = materialize(labelled_rows(rows, labels, "toxic", sample, seed), "labelled-texts")
    kind = rows.schema["doc_id"].dataType.simpleString()
    key = F.struct(F.col("doc_id").alias("id"), F.xxhash64("text").alias("text_hash")).alias("key")
    counts = {r.y: r["count"] for r in drawn.groupBy("y").count().collect()}
    if len(counts) < 2:
        # Nothing to learn from
        scored = rows.select(key, F.lit(1.0 if 1 in counts else 0.0).alias("score"))
        return _decided(scored, threshold)
    lexicon, begins = learn_lexicon(drawn)
    read = partial(_features, lexicon=lexicon, begins=begins)
    known = drawn.withColumn("part", F.pmod(F.xxhash64(F.lit(seed), "text"), F.lit(4)))
    known = known.select("text", F.struct(F.col("y").cast("double").alias("label"), "part").alias("y"))
    known = materialize(known.mapInArrow(partial(read, keep="y"), "y struct<label:double,part:long>, x array<double>"), "features")
    known = known.select("y.label", "y.part", array_to_vector("x").alias("features")).coalesce(2)
    trees = GBTClassifier(maxIter=20, maxDepth=3, stepSize=0.3, maxBins=64, seed=seed, checkpointInterval=-1, cacheNodeIds=False)
    fit_part, held_part = known.where("part > 0"), known.where("part = 0")
    if fit_part.select("label").distinct().count() < 2 or held_part.select("label").distinct().count() < 2:
        fit_part = held_part = known
    model = trees.fit(fit_part)
    margin = vector_to_array("probability")[1]
    held = model.transform(held_part).select("label", margin.alias("p"))
    steps = IsotonicRegression(featuresCol="p", labelCol="label", predictionCol="level").fit(held)
    scan = rows.select(key, "text").mapInArrow(
        partial(read, keep="key"), f"key struct<id:{kind},text_hash:long>, x array<double>"
    )
    scored = model.transform(scan.select("key", array_to_vector("x").alias("features"))).select("key", margin.alias("p"))
    # The trees' own probability only orders documents within one calibrated step.
    scored = steps.transform(scored).select(
        "key", F.least(F.greatest(0.99 * F.col("level") + 0.01 * F.col("p"), F.lit(0.0)), F.lit(1.0)).alias("score")
    )
    return _decided(scored, threshold)


def _decided(scored: DataFrame, threshold: float) -> DataFrame:
    return scored.select(
        "key.id", "key.text_hash", (fold_of(F.col("key.id")) == 1).alias("held_out"), "score",
        (F.col("score") >= threshold).cast("int").alias("predicted"),
    )


def clean_documents(docs: DataFrame, labels: DataFrame, threshold: float = 0.7) -> DataFrame:
    """The rows of ``docs`` that are not rejected as toxic, with their columns.

    Rows are rejected by doc_id and text: other texts under a null or repeated doc_id stay.
    """
    scores = toxicity_scores(docs, labels, threshold=threshold)
    return select_rows(docs, scores.where("predicted = 1"), "left_anti")
