"""Benchmark decontamination by winnowed k-gram fingerprints.

Of every ``window`` words in a row, the smallest hash of a k-gram is kept as a fingerprint.  A
document and a benchmark item that share a window keep the same smallest hash there, so a
join of the fingerprints finds every shared window.  The windows behind a fingerprint are told
apart by a 128-bit hash of all their words, which the join compares as well.

An item shorter than a window is one window by itself, and its fingerprint is the hash of it.

The windows of the items are a table written by Spark.  A bitmap of fixed size over their fingerprints
spares the documents' other windows the join; a bit set by chance only costs a row of it.  The
documents are read once, and neither side is ever in one place.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..scratch import materialize
from .common import Words, bits_of, col, has_bit, lists, mix, pieces, uneven_join

WINDOW = 10
GRAM = 5


def _word_bytes() -> tuple[np.ndarray, bytes]:
    """Which bytes are no part of a word, and the byte map of A-Z to a-z."""
    parts = [b > 127 or chr(b).isalnum() for b in range(256)]
    return ~np.array(parts), bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


def _chain(hashes: np.ndarray, length: int, keep: set[int]) -> dict[int, np.ndarray]:
    """Hashes of all runs of n words, for the wanted n up to ``length``; place i is the run from word i."""
    out, run = {}, hashes
    for n in range(1, length + 1):
        if n > 1:
            run = mix(run[:-1], hashes[n - 1 :]) if len(run) else run
        if n in keep:
            out[n] = run
    return out


def winnow(grams: np.ndarray, span: int) -> np.ndarray:
    """The smallest of every ``span`` neighbouring hashes (place i: those from i on)."""
    n = len(grams) - span + 1
    if n <= 0:
        return grams[:0]
    low, have = grams, 1
    while have < span:
        step = min(have, span - have)
        low = np.minimum(low[: len(low) - step], low[step:])
        have += step
    return low


def _wide(hashes: np.ndarray, at: np.ndarray, length: int) -> np.ndarray:
    """Hashes of the runs of ``length`` words that begin at some places."""
    out = hashes[at]
    for k in range(1, length):
        out = mix(out, hashes[at + k])
    return out


def _short_mark(run: np.ndarray, length: int) -> np.ndarray:
    """The fingerprint of a window shorter than usual."""
    return mix(run, np.full(len(run), length, np.uint64))


def _item_windows(batches: Iterator[pa.RecordBatch], window: int, gram: int) -> Iterator[pa.RecordBatch]:
    """(item, n, mark, a, b) of every window of the items."""
    separators, same = _word_bytes()
    for batch in pieces(batches, "text"):
        words = Words(batch.column("text"), separators)
        hashes = words.hashes(11, same), words.hashes(12, same)
        rows, lengths, parts = [], [], []
        for k in np.flatnonzero(words.counts).tolist():
            a, b = (h[words.first[k] : words.first[k + 1]] for h in hashes)
            n = min(window, len(a))
            at = np.arange(len(a) - n + 1)
            run = _wide(a, at, n)
            mark = winnow(_chain(a, gram, {gram})[gram], n - gram + 1) if n == window else _short_mark(run, n)
            rows.append(np.full(len(at), k))
            lengths.append(np.full(len(at), n, np.int32))
            parts.append((mark, run, _wide(b, at, n)))
        if rows:
            items = batch.column("item").take(pa.array(np.concatenate(rows)))
            marks = [pa.array(np.concatenate(p).view(np.int64)) for p in zip(*parts)]
            yield pa.record_batch([items, pa.array(np.concatenate(lengths)), *marks], ["item", "n", "mark", "a", "b"])


_CANDIDATE = ["n", "place", "mark", "a", "b"]


def _scan(
    batches: Iterator[pa.RecordBatch], bits: np.ndarray, lengths: list[int], window: int, gram: int
) -> Iterator[pa.RecordBatch]:
    """The windows of each document whose fingerprint may be one of the items'."""
    separators, same = _word_bytes()
    short = [n for n in lengths if n < window]
    for batch in pieces(batches, "text"):
        words = Words(batch.column("text"), separators)
        text, total = words.text, len(words.text)
        first = words.hashes(11, same)
        found: list[tuple[int, np.ndarray, np.ndarray]] = []
        runs = _chain(first, short[-1], set(short)) if short else {}
        for n in short:
            mark = _short_mark(runs[n], n)
            at = np.flatnonzero(has_bit(bits, mark) & (text[: len(mark)] == text[n - 1 :][: len(mark)]))
            found.append((n, at, mark[at]))
        if window in lengths and total >= window:
            low = winnow(_chain(first, gram, {gram})[gram], window - gram + 1)
            at = np.flatnonzero(has_bit(bits, low) & (text[: len(low)] == text[window - 1 :]))
            found.append((window, at, low[at]))
        second = words.hashes(12, same) if any(len(at) for _, at, _ in found) else first
        columns = [
            (np.full(len(at), n), at, mark.view(np.int64), _wide(first, at, n).view(np.int64), _wide(second, at, n).view(np.int64))
            for n, at, mark in found
        ]
        n, at, mark, a, b = (np.concatenate(c) if c else np.zeros(0, np.int64) for c in (list(zip(*columns)) or [()] * 5))
        owner = text[at]
        order = np.argsort(owner, kind="stable")
        owner = owner[order]
        place = at[order] - words.first[owner]
        values = [n[order].astype(np.int32), place.astype(np.int64), mark[order], a[order], b[order]]
        windows = pa.StructArray.from_arrays([pa.array(v) for v in values], _CANDIDATE)
        yield pa.record_batch(
            [batch.column("id"), batch.column("text_hash"), pa.array(words.counts.astype(np.int64)), lists(owner, batch.num_rows, windows)],
            ["id", "text_hash", "n_words", "windows"],
        )


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Spans [first, last) per row, joined where they meet or overlap."""
    kind = pa.list_(pa.struct([("first", pa.int64()), ("last", pa.int64())]))
    for batch in batches:
        out = []
        for spans in batch.column("spans"):
            first, last = (spans.values.field(c).to_numpy() for c in ("first", "last"))
            order = np.argsort(first, kind="stable")
            first, reach = first[order], np.maximum.accumulate(last[order])
            begins = np.append(True, first[1:] > reach[:-1])
            ends = np.append(begins[1:], True)
            out.append([{"first": i, "last": j} for i, j in zip(first[begins].tolist(), reach[ends].tolist())])
        yield pa.record_batch([batch.column("row"), pa.array(out, kind)], ["row", "spans"])


def contamination(
    docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id",
    item_text: str = "text", window: int = WINDOW, gram: int = GRAM,
) -> DataFrame:
    """One row per document row: id, text_hash, n_words, spans of hit words [first, last), items (ids as strings).

    Words are counted from 0.  Null and empty texts have no words; an item without words is in
    no document.  Rows of items with a null id count under the name "".  Repeated rows of
    documents give repeated rows, repeated items are named once.  Other columns are not read.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    gram = min(gram, window)
    named = items.select(F.coalesce(col(item_col).cast("string"), F.lit("")).alias("item"), col(item_text).alias("text"))
    windows = named.mapInArrow(partial(_item_windows, window=window, gram=gram), "item string, n int, mark long, a long, b long")
    windows = materialize(windows.distinct(), "item-windows")
    key = ["n", "mark", "a", "b"]
    numbered = windows.groupBy(*key).agg(F.collect_set("item").alias("items"))
    numbered = materialize(numbered.withColumn("number", F.monotonically_increasing_id()), "numbered-windows")
    lengths = [r.n for r in numbered.select("n").distinct().orderBy("n").collect()]  # at most ``window`` numbers
    rows = docs.select(col(id_col).alias("id"), F.xxhash64(col(text_col)).alias("text_hash"), col(text_col).alias("text"))
    scan = rows.mapInArrow(
        partial(_scan, bits=bits_of(numbered, "mark"), lengths=lengths, window=window, gram=gram),
        f"id {kind}, text_hash long, n_words long, windows array<struct<n:int,place:long,mark:long,a:long,b:long>>",
    )
    # The numbers of the rows are written, so that later steps see the same ones.
    found = materialize(scan.withColumn("row", F.monotonically_increasing_id()), "document-windows")
    some = found.where(F.size("windows") > 0).select("row", F.inline("windows"))
    some = materialize(some, "fingerprint-hits")
    joined = uneven_join(some, numbered.select(*key, "number"), key, some.groupBy(*key).agg(F.count("*").alias("rows")), "rows")
    hits = materialize(joined.where("number IS NOT NULL").select("row", "number", "n", "place"), "window-hits")
    span = F.struct(F.col("place").alias("first"), (F.col("place") + F.col("n")).alias("last"))
    spans = hits.groupBy("row").agg(F.collect_list(span).alias("spans"))
    spans = spans.mapInArrow(_merge, "row long, spans array<struct<first:long,last:long>>")
    pairs = materialize(hits.select("row", "number").distinct(), "window-pairs")
    each = pairs.groupBy("number").agg(F.count("*").alias("n"))
    names = uneven_join(pairs, numbered.select("number", "items"), ["number"], each)
    names = names.select("row", F.explode("items").alias("item")).groupBy("row").agg(F.collect_set("item").alias("items"))
    hit = materialize(spans.join(names, "row"), "contaminated-rows")
    empty = F.from_json(F.lit("[]"), "array<struct<first:long,last:long>>")
    out = found.select("row", "id", "text_hash", "n_words").join(hit, "row", "left")
    return out.select(
        "id", "text_hash", "n_words", F.coalesce("spans", empty).alias("spans"),
        F.coalesce("items", F.array().cast("array<string>")).alias("items"),
    )


def contamination_report(found: DataFrame) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated of each row of ``contamination``."""
    hit = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["last"] - s["first"])
    ids = F.array_join(F.array_sort("items"), ",")
    return found.select(
        F.col("id").alias("doc_id"), "n_words", hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"),
        F.sha2(ids, 256).alias("items_sha256"), (hit > 0).alias("contaminated"),
    )
