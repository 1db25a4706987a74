"""Repeated passages by recompression of the words into consistently named symbols.

The words of a document are symbols at first.  Rounds replace every run of one symbol by a
symbol for (symbol, length), and every neighbouring pair of a left and a right symbol by a
symbol for the pair; a hash of a symbol and the round tells which symbols are left and which
right.  Names are hashes of what they stand for, so all tasks give the same name to the same
thing and equal passages get equal symbols, except near their ends.

For every symbol the words are known that decide it: its own and those of the neighbours that
could have joined it.  If these lie inside a window, every copy of the window has the symbol
at the same place.  Each window of ``window`` words picks one such symbol, the longest.  A job
counts the picked symbols of all documents; a window whose symbol is found once is nowhere
else.  The other windows, and the few without such a symbol, are verified by a 96-bit hash of
all their words.  One aggregate finds those that are there once and tells where; the rest are
repeated.  Copies of a passage are combined before the shuffle, so a passage that very many
documents share is no hot key, and equal windows are never listed together.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..scratch import materialize
from .common import BLANKS, Words, col, lists, mix, pieces

ROUNDS = ("run", "pair", "pair", "run", "pair", "pair")
# Names of shared symbols that a task may hold (8 bytes each).
HELD_NAMES = 4_000_000
PLACE_BITS = 30
_PLACE = np.uint64((1 << PLACE_BITS) - 1)
_FREE = np.uint64(2**64 - 1)


def symbols(
    words: np.ndarray, rounds: tuple[str, ...] = ROUNDS
) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Symbols, the words [low, high) that decide each, and the number of words in each.

    ``words`` are word hashes, with 0 between documents.

    ``words`` starts and ends with 0.  A 0 stays as it is and joins nothing.
    """
    sym, low = words, np.arange(len(words))
    high, width = low + 1, np.ones(len(words), np.int64)
    for number, kind in enumerate(rounds):
        m = len(sym)
        if kind == "run":
            new = np.ones(m, bool)
            new[1:] = (sym[1:] != sym[:-1]) | (sym[1:] == 0)
            first = np.flatnonzero(new)
            last = np.append(first[1:], m) - 1
            length = last - first + 1
            named = sym[first]
            runs = length > 1
            named[runs] = mix(named[runs], length[runs].astype(np.uint64) + np.uint64(number << 40))
            before, after = np.maximum(first - 1, 0), np.minimum(last + 1, m - 1)
            if runs.any():
                own_low, own_high = np.minimum.reduceat(low, first), np.maximum.reduceat(high, first)
                width = np.add.reduceat(width, first)
            else:
                own_low, own_high = low, high
            sym, low, high = named, np.minimum(own_low, low[before]), np.maximum(own_high, high[after])
        else:
            salt = np.full(1, 1000 + number, np.uint64)
            right = mix(sym, np.broadcast_to(salt, m)) >> np.uint64(63) == 1
            word = sym != 0
            joins = np.zeros(m, bool)
            joins[:-1] = word[:-1] & ~right[:-1] & word[1:] & right[1:]
            second = np.zeros(m, bool)
            second[1:] = joins[:-1]
            head = np.flatnonzero(~second)
            joined, is_right = joins[head], right[head]
            after, before = np.minimum(head + 1, m - 1), np.maximum(head - 1, 0)
            named = sym[head]
            named[joined] = mix(named[joined], sym[after][joined])
            width = width[head] + np.where(joined, width[after], 0)
            next_low = np.where(joined, low[after], np.where(is_right, low[before], low[head]))
            next_high = np.where(joined | ~is_right, high[after], high[head])
            sym, low, high = named, np.minimum(low[head], next_low), np.maximum(high[head], next_high)
    return sym, low, high, width


def picks(
    sym: np.ndarray, low: np.ndarray, high: np.ndarray, width: np.ndarray, words: int, window: int
) -> np.ndarray:
    """For the window from each word on: the number of its symbol of most words, or -1.

    Long symbols are rarer.  Among equally long ones the smaller name is taken, then the first.

    Every symbol counts for the windows that hold all its deciding words; the intervals are
    laid out as two overlapping powers of two and passed down by halves.
    """
    n = max(words - window + 1, 0)
    start, stop = np.maximum(high - window, 0), np.minimum(low, n - 1)
    good = np.flatnonzero((sym != 0) & (start <= stop))
    start, stop = start[good], stop[good]
    rank = np.uint64(63) - np.minimum(width[good], 63).astype(np.uint64)
    value = (rank << np.uint64(58)) | ((sym[good] >> np.uint64(6)) & ~_PLACE) | good.astype(np.uint64)
    level = np.zeros(len(good), np.int64)
    for j in range(1, window.bit_length()):
        level += (stop - start + 1) >> j > 0
    above = None
    for j in range(window.bit_length() - 1, -1, -1):
        here = np.full(n, _FREE)
        if above is not None:
            half = 1 << j
            np.minimum(here, above, out=here)
            np.minimum(here[half:], above[:-half], out=here[half:])
        at = level == j
        np.minimum.at(here, start[at], value[at])
        np.minimum.at(here, stop[at] - (1 << j) + 1, value[at])
        above = here
    return np.where(above == _FREE, -1, (above & _PLACE).astype(np.int64))


def window_hashes(hashes: np.ndarray, window: int) -> np.ndarray:
    """A hash of the words of every window, by doubling."""
    if len(hashes) < window:
        return hashes[:0]
    out, have, run, size = None, 0, hashes, 1
    while True:
        if window & size:
            if out is None:
                out = run
            else:
                n = min(len(out), len(run) - have)
                out = mix(out[:n], run[have : have + n])
            have += size
        if have == window:
            return out[: max(len(hashes) - window + 1, 0)]
        n = len(run) - size
        run, size = mix(run[: max(n, 0)], run[size:]), size * 2


def _laid_out(words: Words, seed: int) -> np.ndarray:
    """Word hashes of several texts with a 0 before, between and after the texts."""
    laid = np.zeros(len(words.text) + len(words.counts) + 1, np.uint64)
    hashes = words.hashes(seed)
    hashes[hashes == 0] = 1
    laid[np.arange(len(hashes)) + words.text + 1] = hashes
    return laid


def _window_places(words: Words, window: int) -> tuple[np.ndarray, np.ndarray]:
    """(text, place among the words laid out) of every window."""
    counts = np.maximum(words.counts - window + 1, 0)
    text = np.repeat(np.arange(len(counts)), counts)
    within = np.arange(len(text)) - np.repeat(np.cumsum(counts) - counts, counts)
    return text, _firsts(words)[text] + within


def _firsts(words: Words) -> np.ndarray:
    return words.first[:-1] + np.arange(len(words.counts)) + 1


def joined_words(words: Words, stay: np.ndarray) -> list[bytes]:
    """Each text's words that stay, joined by one blank."""
    size, inside = len(words.data), words.inside
    keep = inside.copy()
    keep[inside] = np.repeat(stay, words.stop - words.start)
    after = words.stop[stay]
    after = after[after < size]
    keep[after[~inside[after]]] = True
    out = np.where(inside, words.data, 32)[keep].astype(np.uint8).tobytes()
    at = np.concatenate([[0], np.cumsum(keep)])[words.offsets].tolist()
    return [out[i:j].strip(b" ") for i, j in zip(at, at[1:])]


def _pick(batches: Iterator[pa.RecordBatch], window: int) -> Iterator[pa.RecordBatch]:
    for rows in pieces(batches, "text"):
        words = Words(rows.column("text"), BLANKS)
        laid = _laid_out(words, 21)
        sym, low, high, width = symbols(laid)
        place = _window_places(words, window)[1]
        picked = picks(sym, low, high, width, len(laid), window)[place] if len(place) else place
        chosen = np.unique(picked[picked >= 0])
        owner = np.searchsorted(_firsts(words), low[chosen], "right") - 1
        names = lists(owner, rows.num_rows, pa.array(sym[chosen].view(np.int64)))
        yield pa.record_batch([rows.column("key"), rows.column("size"), names], ["key", "size", "names"])


def _open_windows(words: Words, laid: np.ndarray, shared: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """(text, place among the words laid out) of the windows that may be found elsewhere."""
    text, place = _window_places(words, window)
    if not len(place):
        return text, place
    sym, low, high, width = symbols(laid)
    picked = picks(sym, low, high, width, len(laid), window)[place]
    names = sym.view(np.int64)
    at = np.minimum(np.searchsorted(shared, names), max(len(shared) - 1, 0))
    known = shared[at] == names if len(shared) else np.zeros(len(names), bool)
    open_ = (picked < 0) | known[picked]
    return text[open_], place[open_]


def _shared(rows: pa.RecordBatch, shared: np.ndarray | None) -> np.ndarray:
    return np.unique(rows.column("names").flatten().to_numpy()) if shared is None else shared


def _verify(batches: Iterator[pa.RecordBatch], window: int, shared: np.ndarray | None) -> Iterator[pa.RecordBatch]:
    """A 96-bit hash and the spot of the windows that may be found elsewhere."""
    for rows in pieces(batches, "text"):
        words = Words(rows.column("text"), BLANKS)
        laid = _laid_out(words, 21)
        text, place = _open_windows(words, laid, _shared(rows, shared), window)
        if not len(place):
            continue
        a = window_hashes(laid, window)[place]
        b = window_hashes(_laid_out(words, 22), window)[place] >> np.uint64(32)
        key, size = (rows.column(c).to_numpy()[text] for c in ("key", "size"))
        spot = (size << PLACE_BITS) + place - _firsts(words)[text]
        columns = [pa.array(a.view(np.int64)), pa.array(b.astype(np.int64)), pa.array(key), pa.array(spot)]
        yield pa.record_batch(columns, ["a", "b", "key", "spot"])


def _cut(batches: Iterator[pa.RecordBatch], window: int, shared: np.ndarray | None) -> Iterator[pa.RecordBatch]:
    """Number of words removed, and hash of those that stay, from the places of the windows found once."""
    for rows in pieces(batches, "text"):
        words = Words(rows.column("text"), BLANKS)
        laid, n = _laid_out(words, 21), rows.num_rows
        text, place = _open_windows(words, laid, _shared(rows, shared), window)
        once = rows.column("once")
        owner = np.repeat(np.arange(n), pc.fill_null(pc.list_value_length(once), 0).to_numpy(zero_copy_only=False))
        single = np.zeros(len(laid) + 1, bool)
        single[once.flatten().to_numpy() + _firsts(words)[owner]] = True
        place = place[~single[place]]
        edge = np.zeros(len(laid) + 1, np.int64)
        edge[place] += 1
        edge[place + window] -= 1
        gone = np.cumsum(edge)[np.arange(len(words.text)) + words.text + 1] > 0
        removed = np.bincount(words.text[gone], minlength=n)
        kept = [hashlib.sha256(t).hexdigest() for t in joined_words(words, ~gone)]
        columns = [rows.column("id"), pa.array(words.counts), pa.array(removed, pa.int64()), pa.array(kept, pa.string())]
        yield pa.record_batch(columns, ["id", "n_words", "n_removed", "kept_sha256"])


def remove_repeats(
    docs: DataFrame, window: int = 35, id_col: str = "doc_id", text_col: str = "text", held_names: int = HELD_NAMES
) -> DataFrame:
    """One row per input row: id, n_words, n_removed, kept_sha256, without the repeated passages.

    A word goes if a window over it has the words of another window, in any text or the same.
    Null and empty texts have no words and nothing removed.  Repeated rows are copies of each
    other and lose all windows.  Null ids are kept as they are.  Other columns are not read.

    Up to ``held_names`` names of shared symbols are held by every task that reads the texts;
    more are joined to the texts, which are then shuffled for it.
    """
    text = F.coalesce(col(text_col), F.lit(""))
    rows = docs.select(
        col(id_col).alias("id"), text.alias("text"), F.xxhash64(text).alias("key"),
        F.octet_length(text).cast("long").alias("size"),
    )
    kind = rows.schema["id"].dataType.simpleString()
    picked = rows.mapInArrow(partial(_pick, window=window), "key long, size long, names array<long>")
    names = picked.select("key", "size", F.explode("names").alias("name"))
    shared = names.groupBy("name").agg(F.count("*").alias("n")).where("n > 1").select("name")
    shared = materialize(shared, "shared-symbols")
    held = None
    if shared.count() <= held_names:
        held = np.sort(shared.toArrow().column("name").to_numpy())
        named = rows
    else:
        found = names.distinct().join(shared, "name").groupBy("key", "size").agg(F.collect_list("name").alias("names"))
        named = rows.join(materialize(found, "shared-by-text"), ["key", "size"], "left")
        named = named.withColumn("names", F.coalesce("names", F.array().cast("array<long>")))
    windows = named.mapInArrow(partial(_verify, window=window, shared=held), "a long, b long, key long, spot long")
    # Of a window found once, the minima are its own key and spot.
    once = windows.groupBy("a", "b").agg(F.count("*").alias("n"), F.min("key").alias("key"), F.min("spot").alias("spot"))
    size, place = F.shiftright("spot", PLACE_BITS), F.col("spot").bitwiseAND((1 << PLACE_BITS) - 1)
    once = once.where("n = 1").select("key", size.alias("size"), place.alias("place"))
    once = materialize(once.groupBy("key", "size").agg(F.collect_list("place").alias("once")), "found-once")
    return named.join(once, ["key", "size"], "left").mapInArrow(
        partial(_cut, window=window, shared=held), f"id {kind}, n_words long, n_removed long, kept_sha256 string"
    )
