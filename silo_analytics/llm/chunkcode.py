"""Byte-level BPE of whole texts, in which chunks shared by documents are encoded once.

1. Texts are cut by content: a place where a rolling hash of the bytes before it is the smallest
   for ``radius`` bytes to both sides.  Equal passages are cut alike wherever they stand.
2. Chunks are counted by a 128-bit hash.  Those found more than once are marked in a bitmap of
   fixed size, which goes to the tasks; a chunk marked by mistake is only encoded by the longer way.
3. A document without a marked chunk is encoded where it lies.  The others are taken apart: each
   distinct marked chunk is encoded once, and its ids go to every distinct text that holds it.
4. Joins are repaired.  The encoder splits a text into words from left to right and looks only a
   few letters ahead, so from a place where a word of the whole text begins and a word of the
   chunk by itself begins, both agree until shortly before the end of the chunk.  From the last
   such place of the text so far, words are encoded again until they agree with the next chunk;
   a chunk that never agrees is encoded again as a whole.

The words of a text are those of the tokenizer's own split; their ids are remembered per task.
"""

from __future__ import annotations

import hashlib
import os
import re
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..scratch import materialize
from .common import _powers, bits_of, col, has_bit, small_batches, texts_of, trimmed, uneven_join
from .winnow import winnow

RADIUS = 512
ROLL = 32
# Bytes of text per task, where tasks can be merged: larger ones meet more of their words again.
TASK_BYTES = 48 << 20
# Word ends of a chunk at which it may meet the text before it.
HEADS = 6
# A word that ends this many letters before the end of what is known does not depend on the rest.
AHEAD = 4


# ------------------------------------------------------------------ cutting
class Cutter:
    """Places where texts are cut, by their content alone."""

    def __init__(self, radius: int) -> None:
        draw = np.random.default_rng(21)
        self.radius = radius
        self.letters = draw.integers(0, 2**64, 256, dtype=np.uint64)
        self.base = int(draw.integers(0, 2**64, dtype=np.uint64)) | 1

    def places(self, text: bytes) -> list[int]:
        """Byte places of the cuts, each at the beginning of a letter; they are further apart than the radius."""
        n, r = len(text), self.radius
        if n <= ROLL + r:
            return []
        data = np.frombuffer(text, np.uint8)
        up, down = _powers(self.base, n + 1)
        total = np.zeros(n + 1, np.uint64)
        np.cumsum(self.letters[data] * up[:n], out=total[1:])
        count = n - ROLL
        roll = (total[ROLL:n] - total[:count]) * down[:count]
        padded = np.full(count + 2 * r, 2**32 - 1, np.uint32)
        rank = padded[r : r + count]
        rank[:] = roll >> np.uint64(32)
        rank[(data[ROLL:] & 0xC0) == 0x80] = 2**32 - 1
        low = winnow(padded, r)
        return (np.flatnonzero((rank < low[:count]) & (rank <= low[r + 1 : r + 1 + count])) + ROLL).tolist()

    def chunks(self, text: bytes) -> list[bytes]:
        edges = [0, *self.places(text), len(text)]
        return [text[i:j] for i, j in zip(edges, edges[1:])]


def _hashes(chunks: list[bytes]) -> np.ndarray:
    """Two signed 64-bit halves of a 128-bit hash per chunk."""
    import xxhash

    return np.frombuffer(b"".join(map(xxhash.xxh3_128_digest, chunks)), ">i8").reshape(-1, 2).astype(np.int64)


# ------------------------------------------------------------------ encoding
# Letters, digits and blanks below U+0250, and ranges of characters for which the
# installed pattern library and the tokenizers library agree; other texts are split by the latter.
_LETTERS = [(0x41, 0x5A), (0x61, 0x7A), (0xAA, 0xAA), (0xB5, 0xB5), (0xBA, 0xBA), (0xC0, 0xD6), (0xD8, 0xF6), (0xF8, 0x24F)]
_DIGITS = [(0x30, 0x39), (0xB2, 0xB3), (0xB9, 0xB9), (0xBC, 0xBE)]
_BLANKS = [(0x9, 0xD), (0x20, 0x20), (0x85, 0x85), (0xA0, 0xA0)]
_NEAR = [(0x0, 0x24F)]
_AGREED = [
    (0x0, 0x557), (0x590, 0x85F), (0x900, 0xB7F), (0xD00, 0x208E), (0x20A0, 0xA4FF), (0xAC00, 0xD7FF), (0xE000, 0xFFFF),
    (0x1F000, 0x1FAFF),
]
_SPLIT = r"'(?:[stmd]|re|ve|ll)| ?[{l}]+| ?[{n}]+| ?[^{s}{l}{n}]+|[{s}]+(?![^{s}])|[{s}]+"


def _ranges(pairs: list[tuple[int, int]]) -> str:
    """Ranges of characters for a class of a pattern."""
    return "".join(f"\\U{a:08x}-\\U{b:08x}" for a, b in pairs)


class PieceCoder:
    """Ids of texts and of pieces of texts by a byte-level BPE of the tokenizers library.

    ``source`` is the content of its JSON file.  Refused are tokenizers that normalize, put a blank
    first, or split by another rule than the usual one of byte-level BPE.
    """

    def __init__(self, source: str, limit: int = 500_000) -> None:
        import regex
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # the tasks are parallel already
        self.tokenizer = Tokenizer.from_str(source)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        split = self.tokenizer.pre_tokenizer
        if self.tokenizer.normalizer is not None or type(split).__name__ != "ByteLevel" or split.add_prefix_space or not split.use_regex:
            raise ValueError("not a plain byte-level tokenizer")
        size = self.tokenizer.get_vocab_size()
        self.type = np.dtype("<u2" if size <= 1 << 16 else "<u4")
        added = {i: t.content for i, t in self.tokenizer.get_added_tokens_decoder().items()}
        self.added = [t.encode() for t in added.values()]
        # The alphabet of byte-level BPE: printable bytes stand for themselves, the others follow U+00FF.
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
        other = [b for b in range(256) if b not in set(plain)]
        letters = {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(other)}
        token_bytes = [b""] * size
        for token, i in self.tokenizer.get_vocab().items():
            token_bytes[i] = added[i].encode() if i in added else bytes(map(letters.__getitem__, token))
        self.lengths = np.array([len(b) for b in token_bytes])
        self.offsets = np.cumsum(self.lengths) - self.lengths
        self.letters = np.frombuffer(b"".join(token_bytes), np.uint8)
        self.near = re.compile(_SPLIT.format(l=_ranges(_LETTERS), n=_ranges(_DIGITS), s=_ranges(_BLANKS)))
        self.far = re.compile(f"[^{_ranges(_NEAR)}]")
        self.wide = regex.compile(_SPLIT.format(l=r"\p{L}", n=r"\p{N}", s=r"\s"))
        self.rare = re.compile(f"[^{_ranges(_AGREED)}]")
        self.limit = limit
        self.known: dict[str, bytes] = {}

    def special(self, text: bytes) -> bool:
        return any(t in text for t in self.added)

    def words(self, text: str) -> list[str]:
        """The text as the tokenizer splits it."""
        if text.isascii() or not self.far.search(text):
            return self.near.findall(text)
        if not self.rare.search(text):
            return self.wide.findall(text)
        return [text[i:j] for _, (i, j) in self.tokenizer.pre_tokenizer.pre_tokenize_str(text)]

    def ids(self, words: list[str]) -> list[bytes]:
        """The ids of each word, as bytes."""
        found = list(map(self.known.get, words))
        gaps = [k for k, i in enumerate(found) if i is None]
        if gaps:
            if len(self.known) > self.limit:
                self.known, gaps = {}, range(len(words))
            self._learn(list({words[k] for k in gaps}))
            for k in gaps:
                found[k] = self.known[words[k]]
        return found

    def _learn(self, new: list[str]) -> None:
        # A blank and letters are one word wherever they stand, so many are encoded in one go.
        run = [w for w in new if w[0] == " " and w[1:].isalpha() and not self.far.search(w)]
        ids = np.array(self.tokenizer.encode_batch_fast(["".join(run)], add_special_tokens=False)[0].ids, self.type)
        ends = np.cumsum([len(w.encode()) for w in run], dtype=np.int64)
        cuts = (np.searchsorted(np.cumsum(self.lengths[ids]), ends) + 1) * self.type.itemsize
        raw, edges = ids.tobytes(), [0, *cuts.tolist()]
        self.known.update((w, raw[i:j]) for w, i, j in zip(run, edges, edges[1:]))
        other = [w for w in new if w not in self.known]
        found = self.tokenizer.encode_batch_fast(other, add_special_tokens=False)
        self.known.update((w, np.array(e.ids, self.type).tobytes()) for w, e in zip(other, found))

    def whole(self, text: bytes) -> bytes:
        """The ids of a whole text."""
        if self.special(text):
            return np.array(self.tokenizer.encode(text.decode(), add_special_tokens=False).ids, self.type).tobytes()
        return b"".join(self.ids(self.words(text.decode())))

    def decoded(self, ids: bytes) -> bytes:
        """The text of ids as the library decodes them; what is no UTF-8 becomes U+FFFD."""
        numbers = np.frombuffer(ids, self.type)
        lengths = self.lengths[numbers]
        ends = np.cumsum(lengths)
        total = int(ends[-1]) if len(ends) else 0
        # The place of each letter in the joined letters of all tokens.
        place = np.repeat(self.offsets[numbers] - (ends - lengths), lengths) + np.arange(total)
        return self.letters[place].tobytes().decode("utf-8", "replace").encode()

    def digests(self, ids: bytes) -> tuple[int, bytes, bytes]:
        """Number of ids, SHA-256 of the ids as 32-bit integers, SHA-256 of the decoded text."""
        numbers = np.frombuffer(ids, self.type)
        return len(numbers), hashlib.sha256(numbers.astype("<u4").tobytes()).digest(), hashlib.sha256(self.decoded(ids)).digest()

    def chunk(self, text: str) -> tuple[bytes, list[int]]:
        """A chunk by itself: its ids and (letter, number of ids before it) of its first word ends and its last sure one."""
        words = self.words(text)
        ids = self.ids(words)
        size = self.type.itemsize
        ends, at, token = [(0, 0)], 0, 0
        for w, i in zip(words, ids):
            at, token = at + len(w), token + len(i) // size
            ends.append((at, token))
        sure = [e for e in ends if e[0] <= len(text) - AHEAD] or ends[:1]
        return b"".join(ids), [x for e in [*sure[:HEADS], sure[-1]] for x in e]

    def joined(self, parts: list[tuple[str | None, bytes | None, list[int] | None]]) -> bytes:
        """Ids of a text from its parts in order: (text, None, None), or (None, ids, marks) of a chunk encoded by itself."""
        out: list[bytes] = []
        size = self.type.itemsize
        rest, due = "", 0
        for k, (text, ids, marks) in enumerate(parts):
            last = k == len(parts) - 1
            if ids is not None:
                text = self.decoded(ids).decode()
                marks = list(zip(marks[::2], marks[1::2]))
                met = self._meet(rest, text, dict(marks[:-1]), last)
                if met is not None:
                    words, letter, token = met
                    end, end_token = marks[-1] if not last and letter <= marks[-1][0] else (len(text), len(ids) // size)
                    if not last and letter > marks[-1][0]:
                        end, end_token = letter, token
                    out += self.ids(words)
                    out.append(ids[token * size : end_token * size])
                    rest, due = text[end:], 0
                    continue
            rest += text
            # A word without an end is not looked at again before it has doubled.
            if last or len(rest) >= due:
                words = self.words(rest)
                if not last:
                    left = len(rest)
                    while words and left > len(rest) - AHEAD:
                        left -= len(words.pop())
                    rest = rest[left:]
                    due = 2 * len(rest) if len(rest) > 1000 else 0
                out += self.ids(words)
        return b"".join(out)

    def _meet(self, rest: str, text: str, heads: dict[int, int], last: bool) -> tuple[list[str], int, int] | None:
        """The words from ``rest`` on up to a word end of the chunk, and that place in it; None if there is none in time."""
        if not rest:
            return [], 0, 0
        if len(rest) > 1000:
            return None
        reach = max(heads) + 8
        window = rest + text[:reach]
        sure = len(window) - (0 if last and reach >= len(text) else AHEAD)
        at, words = 0, []
        for word in self.words(window):
            at += len(word)
            if at > sure:
                return None
            words.append(word)
            if at - len(rest) in heads:
                return words, at - len(rest), heads[at - len(rest)]
        return None


# ------------------------------------------------------------------ tasks
def _census(batches: Iterator[pa.RecordBatch], special: list[bytes], radius: int) -> Iterator[pa.RecordBatch]:
    cutter = Cutter(radius)
    for batch in trimmed(batches):
        chunks = [c for t in texts_of(batch.column("text")) if t and not any(s in t for s in special) for c in cutter.chunks(t)]
        found = _hashes(chunks)
        yield pa.record_batch([pa.array(found[:, 0]), pa.array(found[:, 1])], ["h1", "h2"])


_PART = pa.struct([("h1", pa.int64()), ("h2", pa.int64()), ("text", pa.binary())])
_SCANNED = "id {}, k1 long, k2 long, n_tokens long, ids_sha binary, text_sha binary, parts array<struct<h1:long,h2:long,text:binary>>, size long"


def _scan(batches: Iterator[pa.RecordBatch], source: str, bits: np.ndarray, radius: int) -> Iterator[pa.RecordBatch]:
    """Digests of the documents without marked chunks, and the parts of the others."""
    coder, cutter = PieceCoder(source), Cutter(radius)
    for batch in trimmed(batches):
        for at in range(0, batch.num_rows, 256):
            part = batch.slice(at, 256)
            digests, parts, texts = [], [], []
            for text in texts_of(part.column("text")):
                text = text or b""
                chunks = cutter.chunks(text) if text and not coder.special(text) else []
                found = _hashes(chunks)
                shared = has_bit(bits, found[:, 0])
                texts.append(text)
                if not shared.any():
                    digests.append(coder.digests(coder.whole(text)))
                    parts.append(None)
                    continue
                digests.append((None, None, None))
                cut = []
                for chunk, (h1, h2), marked in zip(chunks, found.tolist(), shared.tolist()):
                    if marked:
                        cut.append({"h1": h1, "h2": h2, "text": chunk})
                    elif cut and cut[-1]["h1"] is None:
                        cut[-1]["text"] += chunk
                    else:
                        cut.append({"h1": None, "h2": None, "text": chunk})
                parts.append(cut)
            keys = _hashes(texts)
            n, ids, text = zip(*digests)
            yield pa.record_batch(
                [
                    part.column("id"), pa.array(keys[:, 0]), pa.array(keys[:, 1]), pa.array(n, pa.int64()), pa.array(ids, pa.binary()),
                    pa.array(text, pa.binary()), pa.array(parts, pa.list_(_PART)), pa.array([len(t) for t in texts], pa.int64()),
                ],
                ["id", "k1", "k2", "n_tokens", "ids_sha", "text_sha", "parts", "size"],
            )


def _code(batches: Iterator[pa.RecordBatch], source: str) -> Iterator[pa.RecordBatch]:
    coder = PieceCoder(source)
    for batch in trimmed(batches):
        codes = [coder.chunk(t.decode()) for t in texts_of(batch.column("text"))]
        ids, marks = zip(*codes) if codes else ((), ())
        yield pa.record_batch(
            [batch.column("h1"), batch.column("h2"), pa.array(ids, pa.binary()), pa.array(marks, pa.list_(pa.int32()))],
            ["h1", "h2", "ids", "marks"],
        )


def _join(batches: Iterator[pa.RecordBatch], source: str) -> Iterator[pa.RecordBatch]:
    coder = PieceCoder(source)
    for batch in trimmed(batches):
        found = []
        for parts in batch.column("parts"):
            ordered = sorted(parts.as_py(), key=lambda p: p["place"])
            texts = [(p["text"] if p["text"] is None else p["text"].decode(), p["ids"], p["marks"]) for p in ordered]
            found.append(coder.digests(coder.joined(texts)))
        n, ids, text = zip(*found) if found else ((), (), ())
        columns = [pa.array(n, pa.int64()), pa.array(ids, pa.binary()), pa.array(text, pa.binary())]
        yield pa.record_batch([batch.column("k1"), batch.column("k2"), *columns], ["k1", "k2", "n_tokens", "ids_sha", "text_sha"])


def encode_documents(
    docs: DataFrame, source: str, id_col: str = "doc_id", text_col: str = "text", radius: int = RADIUS
) -> DataFrame:
    """(id, n_tokens, ids_sha, text_sha) per row: its ids as the tokenizers library gives them for the whole text.

    ``source`` is the JSON of a byte-level BPE.  ``ids_sha`` is the SHA-256 of the ids as little-endian
    32-bit integers, ``text_sha`` that of the text decoded from them, both as bytes.  Null texts count as empty
    (no ids).  Texts with a special token are encoded whole.  Null and repeated ids stay rows of their
    own; other columns are not read.  No rows give no rows.
    """
    from tokenizers import Tokenizer

    spark = docs.sparkSession
    kind = docs.schema[id_col].dataType.simpleString()
    special = [t.content.encode() for t in Tokenizer.from_str(source).get_added_tokens_decoder().values()]
    rows = docs.select(col(id_col).alias("id"), col(text_col).alias("text"))
    counted = rows.select("text").mapInArrow(partial(_census, special=special, radius=radius), "h1 long, h2 long")
    with small_batches(spark):
        shared = materialize(counted.groupBy("h1", "h2").agg(F.count("*").alias("n")).where("n > 1").select("h1", "h2"), "shared-chunks")
        bits = bits_of(shared, "h1")
        scanned = rows.mapInArrow(partial(_scan, source=source, bits=bits, radius=radius), _SCANNED.format(kind))
        scanned = materialize(scanned, "scanned-documents")
        size = scanned.where("parts IS NOT NULL").agg(F.sum("size")).first()[0] or 0
        tasks = max(spark.sparkContext.defaultParallelism, size // TASK_BYTES)
        apart = scanned.where("parts IS NOT NULL").select("k1", "k2", F.posexplode("parts").alias("place", "part"))
        apart = apart.select("k1", "k2", "place", "part.h1", "part.h2", "part.text")
        chunks = apart.where("h1 IS NOT NULL")
        codes = chunks.groupBy("h1", "h2").agg(F.first("text").alias("text"))
        codes = codes.coalesce(tasks)
        codes = materialize(codes.mapInArrow(partial(_code, source=source), "h1 long, h2 long, ids binary, marks array<int>"), "chunk-codes")
        uses = materialize(chunks.select("k1", "k2", "place", "h1", "h2").distinct(), "chunk-uses")
        coded = uneven_join(uses, codes, ["h1", "h2"], uses.groupBy("h1", "h2").agg(F.count("*").alias("n")))
        texts = apart.where("h1 IS NULL").groupBy("k1", "k2", "place").agg(F.first("text").alias("text"))
        nothing = [F.lit(None).cast("binary").alias("ids"), F.lit(None).cast("array<int>").alias("marks")]
        pieces = coded.select("k1", "k2", "place", F.lit(None).cast("binary").alias("text"), "ids", "marks")
        pieces = pieces.unionByName(texts.select("k1", "k2", "place", "text", *nothing))
        pieces = pieces.groupBy("k1", "k2").agg(F.collect_list(F.struct("place", "text", "ids", "marks")).alias("parts"))
        digests = pieces.coalesce(tasks).mapInArrow(partial(_join, source=source), "k1 long, k2 long, n_tokens long, ids_sha binary, text_sha binary")
        digests = materialize(digests, "joined-documents")
    here = scanned.where("parts IS NULL").select("id", "n_tokens", "ids_sha", "text_sha")
    there = scanned.where("parts IS NOT NULL").select("id", "k1", "k2")
    there = uneven_join(there, digests, ["k1", "k2"], there.groupBy("k1", "k2").agg(F.count("*").alias("n")))
    return here.unionByName(there.select("id", "n_tokens", "ids_sha", "text_sha"))
