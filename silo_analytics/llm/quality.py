"""Document quality by Bradley-Terry ranking of preference pairs.

Each pair sets a document labelled good against one labelled bad.  The weights maximize the
probability sigmoid(w . (features of the good - features of the bad)); a document's score is
w . features.  The cut lies at the quantile of the training scores that leaves the share of
bad labels below it, and the reported score is the logistic of the distance to the cut.

The fit uses at most ``SAMPLE`` labelled documents of the training folds, whose few features
are brought to the driver.  All documents are scored, from their whole texts, in one scan.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import col, fold_of, labelled_rows, texts_of, trimmed

SAMPLE = 16_000
PARTNERS = 8
FEATURES = (
    "words", "chars_per_word", "word_spread", "distinct", "next_equal", "pairs_distinct", "top_share", "capitals",
    "capital_words", "digits", "blanks", "stops", "exclaims", "signs", "sign_words", "bars", "lines", "line_words",
    "lines_distinct", "line_ends", "other_bytes", "long_words", "single_words", "entropy",
)
_SIGNS = b"#$%&*@^~=<>{}[]\\/+_"
_BARS = b"|>\xc2\xbb"


def features(text: bytes) -> list[float]:
    """Dense features of one text, none of which depends on what its words mean."""
    words = text.split()
    n, size = len(words), len(text)
    if not n:
        return [0.0] * len(FEATURES)
    seen = np.bincount(np.frombuffer(text, np.uint8), minlength=256)
    letters = seen[65:91].sum() + seen[97:123].sum() + seen[128:].sum()
    lengths = np.fromiter(map(len, words), np.int64, n)
    counts = Counter(words)
    share = np.fromiter(counts.values(), np.float64, len(counts)) / n
    lines = [line for line in text.split(b"\n") if line.strip()]
    pairs = list(zip(words, words[1:]))
    signed = sum(map(_signs_in, counts))
    return [
        float(np.log1p(n)), min(size / n, 40.0), float(min(lengths.std(), 20.0)), len(counts) / n,
        sum(a == b for a, b in pairs) / n, len(set(pairs)) / max(n - 1, 1), float(share.max()),
        seen[65:91].sum() / max(letters, 1), sum(map(bytes.isupper, counts)) / len(counts),
        seen[48:58].sum() / size, seen[32] / size, (seen[46] + seen[44]) / n, seen[33] / n,
        sum(int(seen[b]) for b in _SIGNS) / n, signed / len(counts), seen[124] / n, float(np.log1p(len(lines))),
        float(np.log1p(n / max(len(lines), 1))), len(set(lines)) / max(len(lines), 1),
        sum(line.rstrip()[-1:] in b".!?" for line in lines) / max(len(lines), 1), seen[128:].sum() / size,
        float((lengths > 20).mean()), float((lengths == 1).mean()), float(-(share * np.log(share)).sum() / np.log(n + 1)),
    ]


def _signs_in(word: bytes) -> bool:
    return not word.strip(b".,!?;:'\"()-").isalnum() and any(b in _SIGNS for b in word)


@dataclass
class Ranking:
    """Standardization, weights, cut and spread of the scores."""

    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    cut: float
    spread: float

    def scores(self, x: np.ndarray) -> np.ndarray:
        raw = expand((x - self.mean) / self.scale) @ self.weights
        return 1.0 / (1.0 + np.exp(np.clip(-(raw - self.cut) / self.spread, -500, 500)))


def expand(z: np.ndarray) -> np.ndarray:
    """Each standardized feature, clipped, with its distances above and below the middle."""
    z = np.clip(z, -6, 6)
    return np.concatenate([z, np.maximum(z - 1, 0), np.maximum(-1 - z, 0)], axis=1)


def fit_ranking(x: np.ndarray, y: np.ndarray, seed: int = 0, penalty: float = 1.0) -> Ranking | None:
    """Bradley-Terry weights from seeded pairs; None without both labels."""
    good, bad = np.flatnonzero(y == 1), np.flatnonzero(y == 0)
    if not len(good) or not len(bad):
        return None
    mean, scale = x.mean(axis=0), x.std(axis=0)
    scale[scale < 1e-9] = 1.0
    z = expand((x - mean) / scale)
    draw = np.random.default_rng(seed)
    # Every labelled document meets PARTNERS documents of the other label.
    first = np.concatenate([np.repeat(good, PARTNERS), draw.choice(good, len(bad) * PARTNERS)])
    second = np.concatenate([draw.choice(bad, len(good) * PARTNERS), np.repeat(bad, PARTNERS)])
    w = np.zeros(z.shape[1])
    gap = z[first] - z[second]
    for _ in range(30):
        p = 1.0 / (1.0 + np.exp(np.clip(gap @ w, -500, 500)))
        slope = gap.T @ p - penalty * w
        bend = (gap * (p * (1 - p))[:, None]).T @ gap + penalty * np.eye(len(w))
        step = np.linalg.solve(bend, slope)
        w = w + step
        if np.abs(step).max() < 1e-6:
            break
    raw = np.sort(z @ w)
    k = int(np.clip(len(bad), 1, len(raw) - 1))
    return Ranking(mean, scale, w, float((raw[k - 1] + raw[k]) / 2), max(float(raw.std()) / 4, 1e-6))


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in trimmed(batches):
        rows = [features(t or b"") for t in texts_of(batch.column("text"))]
        yield pa.record_batch([batch.column("y"), pa.array(rows, pa.list_(pa.float64()))], ["y", "x"])


def _score(batches: Iterator[pa.RecordBatch], model: Ranking | None, neutral: float) -> Iterator[pa.RecordBatch]:
    for batch in trimmed(batches):
        x = np.array([features(t or b"") for t in texts_of(batch.column("text"))]).reshape(-1, len(FEATURES))
        scores = model.scores(x) if model else np.full(len(x), neutral)
        yield pa.record_batch([batch.column("id"), pa.array(scores, pa.float64())], ["id", "score"])


def quality_scores(
    docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, seed: int = 17, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """id, held_out, score (0 to 1) and predicted (score >= 0.5) of every row of ``docs``.

    Labels come from ``labels`` (doc_id, quality), only from ids outside the held-out fold.
    Null texts count as empty; empty texts are scored like others.  Without labels of both
    kinds every score is 1.0, 0.0 or, without any label, 0.5.  Repeated rows give repeated
    rows.  Other columns are not read.
    """
    rows = docs.select(col(id_col).alias("doc_id"), col(text_col).alias("text"))
    drawn = labelled_rows(rows, labels, "quality", sample, seed)
    known = drawn.select("text", "y").mapInArrow(_features, "y int, x array<double>").toArrow()
    y = known.column("y").to_numpy()
    x = np.array(known.column("x").to_pylist(), float).reshape(-1, len(FEATURES))
    order = np.lexsort(np.vstack([x.T, y]))  # the fit must not depend on the order of the tasks
    model = fit_ranking(x[order], y[order], seed)
    neutral = float(y.mean()) if len(y) else 0.5
    kind = rows.schema["doc_id"].dataType.simpleString()
    scored = rows.select(F.col("doc_id").alias("id"), "text").mapInArrow(
        partial(_score, model=model, neutral=neutral), f"id {kind}, score double"
    )
    return scored.select(
        "id", (fold_of(F.col("id")) == 1).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted")
    )
