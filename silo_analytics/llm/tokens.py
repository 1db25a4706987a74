"""Token ids in binary files of independent zstandard frames with a trailing seek table.

A file holds the documents of one range of ids, in ascending order:

    frame 0 | frame 1 | ... | document index | seek table

Each frame is a zstandard frame of the ids of whole documents, little-endian unsigned
integers of 2 or 4 bytes.  The document index is a skippable frame that tells the frame,
place and number of ids of each document.  The seek table is that of the zstandard seekable
format: sizes of every frame and a checksum of its content, and a footer at the very end.
A reader fetches the footer, the table, the index, and then only the frames it needs.

Documents go to files by boundaries taken from the ids alone, so the texts are tokenized
once.  The files are read back through Spark, which also reaches stores that only Spark knows.
"""

from __future__ import annotations

import io
import os
import re
import struct
import uuid
import zlib
from collections.abc import Iterable, Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..scratch import materialize
from .common import col, pieces, small_batches, starts

FILE_BYTES = 24 << 20
FRAME_BYTES = 128 << 10
ENCODE_BYTES = 192 << 20
# Bytes of text whose stretches are looked up together, and letters of stretches that are encoded in one go, at least 16 for each.
BLOCK_BYTES = 2 << 20
LEARN_LETTERS = 64 << 10
# Stretches of a block whose ids are brought together in one go.
GATHERED_WORDS = 1 << 16
# Stretches that are remembered, and as many older ones (about 50 bytes each).
HELD_STRETCHES = 500_000
# Bytes of remembered stretches and ids, for scripts without blanks and other long ones.
HELD_BYTES = 32 << 20
# Fixed values of the zstandard seekable format.
SKIPPABLE_INDEX = 0x184D2A50
SKIPPABLE_SEEK = 0x184D2A5E
SEEKABLE_MAGIC = 0x8F92EAB1
HAS_CHECKSUMS = 0x80
_INDEX = "<4sIIQ"  # mark, bytes per id, number of file, number of documents
_MARK = b"TIX1"


# ------------------------------------------------------------------ encoding
def _runs(ids: np.ndarray, begin: np.ndarray, count: np.ndarray) -> np.ndarray:
    """The runs of ``count`` ids from ``begin`` on, one after the other."""
    ends = np.cumsum(count, dtype=np.int64)
    return ids[np.arange(count.sum(), dtype=np.int64) + np.repeat(begin - ends + count, count)]


class _Held:
    """Distinct stretches, each with the blank behind it, and their ids, packed (about 50 bytes a stretch).

    They are found by an ordered list of their hashes, to which new ones are added, so that no
    lookup builds a table of all that is held; a found stretch is compared byte by byte.
    """

    def __init__(self, words: list[bytes], ids: np.ndarray, count: list[int]) -> None:
        self.words = pa.array(words, pa.large_binary())
        self.ids, self.count = ids, np.array(count, np.int32)
        self.begin = np.cumsum(self.count) - self.count
        hashes = _hashes(self.words)
        self.order = np.argsort(hashes, kind="stable").astype(np.int32)
        self.hashes = hashes[self.order]

    def __len__(self) -> int:
        return len(self.words)

    @property
    def nbytes(self) -> int:
        return self.words.nbytes + self.ids.nbytes

    def __contains__(self, word: str) -> bool:
        words = pa.array([word.encode() + b" "], pa.large_binary())
        return bool(self.find(words, _hashes(words))[0] >= 0)

    def find(self, words: pa.Array, hashes: np.ndarray) -> np.ndarray:
        """The place of each word, or -1, also if an earlier one has its hash."""
        at = np.minimum(np.searchsorted(self.hashes, hashes), len(self.hashes) - 1)
        rows = np.flatnonzero(self.hashes[at] == hashes)
        found = self.order[at[rows]]
        same = pc.equal(words.take(pa.array(rows)), self.words.take(pa.array(found))).to_numpy(zero_copy_only=False)
        place = np.full(len(words), -1, np.int64)
        place[rows[same]] = found[same]
        return place

    def add(self, words: pa.Array, hashes: np.ndarray, ids: np.ndarray, count: np.ndarray) -> np.ndarray:
        """Hold further words; returns their places."""
        at = len(self.words)
        self.words = pa.concat_arrays([self.words, words])
        self.begin = np.concatenate([self.begin, np.cumsum(count) - count + len(self.ids)])
        self.ids, self.count = np.concatenate([self.ids, ids]), np.concatenate([self.count, count.astype(np.int32)])
        order = np.argsort(hashes, kind="stable")
        to = np.searchsorted(self.hashes, hashes[order], "right")
        self.hashes, self.order = np.insert(self.hashes, to, hashes[order]), np.insert(self.order, to, at + order)
        return np.arange(at, len(self.words))


def _hashes(words: pa.Array) -> np.ndarray:
    """A 64-bit hash per word, which holds within this process."""
    return np.fromiter(map(hash, words.to_pylist()), np.int64, len(words))


class Encoder:
    """Ids of texts as bytes, by the JSON of a tokenizer of the tokenizers library.

    With ``separable`` (a lower-casing tokenizer of at most 65,536 ids with word ends that
    keeps letters, signs and blanks apart), every distinct stretch between blanks is looked up once per block of texts,
    encoded once and remembered.  When more than ``limit`` or ``HELD_BYTES`` are held, they become the ``older`` ones in place of those before;
    what is met again moves on, so that rare stretches go and memory does not grow with the task.  Otherwise, and where
    a text holds a special token in small or capital letters, it is encoded by itself.
    """

    def __init__(self, source: str, end_id: int, separable: bool, limit: int = HELD_STRETCHES) -> None:
        from tokenizers import Tokenizer, pre_tokenizers

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # the tasks are parallel already
        self.tokenizer = Tokenizer.from_str(source)
        self.type = np.dtype("<u2" if max(self.tokenizer.get_vocab_size(), end_id + 1) <= 1 << 16 else "<u4")
        self.end = np.array([end_id], self.type).tobytes()
        self.specials = {t.content: i for i, t in self.tokenizer.get_added_tokens_decoder().items()}
        # Special tokens are told by case, stretches are not.
        self.special = re.compile("|".join(map(re.escape, self.specials)), re.IGNORECASE)
        # What all special tokens begin with before their first letter; most texts hold none of it.
        self.mark = re.match(r"\W*", os.path.commonprefix([*self.specials])).group()
        self.separator = next(iter(self.specials), None) if separable else None
        ends = [i for t, i in self.tokenizer.get_vocab().items() if t.endswith("</w>")] if separable else []
        self.ends = np.zeros(1 << 16, bool)
        self.ends[[i for i in ends if i < 1 << 16]] = True
        if separable:
            # The same merges, held once, for small letters of ASCII, which need neither normalizing nor mapping.
            self.plain = Tokenizer(self.tokenizer.model)
            self.plain.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
        self.known, self.older = self._none(), self._none()
        self.limit = limit

    def _none(self) -> _Held:
        """The end of a text, and nothing between two blanks."""
        return _Held([b"\n ", b" "], np.frombuffer(self.end, self.type), [1, 0])

    def _whole(self, texts: list[str]) -> list[bytes]:
        found = self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)
        return [np.array(e.ids, self.type).tobytes() for e in found]

    def _learn(self, new: list[str]) -> tuple[list[int], np.ndarray, np.ndarray]:
        """The ids of stretches, in another order: the place of each in ``new``, all ids, and how many each has."""
        # Words of letters give ids of which only the last ends a word.
        near, far, plain, odd = kinds = [], [], [], []
        for k, w in enumerate(new):
            kind = (near if w.isascii() else far) if w.isalpha() else (odd if "<" in w else plain)
            kind.append(k)
        found: list[tuple[np.ndarray, np.ndarray]] = []
        for places, coder, mark in ((near, self.plain, None), (far, self.tokenizer, None), (plain, self.tokenizer, self.separator)):
            for part in _parts([new[k] for k in places]):
                text = " ".join(part) if mark is None else mark.join(part) + mark
                ids = np.array(coder.encode_batch_fast([text], add_special_tokens=False)[0].ids, self.type)
                last = self.ends[ids] if mark is None else ids == self.specials[mark]
                cuts = np.flatnonzero(last) + 1
                if len(cuts) != len(part):
                    found.append(self._each(part))
                elif mark is None:
                    found.append((ids[: cuts[-1]], np.diff(cuts, prepend=0)))
                else:
                    found.append((ids[: cuts[-1]][~last[: cuts[-1]]], np.diff(cuts, prepend=0) - 1))
        found += map(self._each, _parts([new[k] for k in odd]))
        return [k for places in kinds for k in places], *map(np.concatenate, zip(*found))

    def _each(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        found = self._whole(words)
        return np.frombuffer(b"".join(found), self.type), np.array([len(f) // self.type.itemsize for f in found], np.int64)

    def __call__(self, texts: list[str]) -> list[bytes]:
        """The ids of each text and the end id, as bytes."""
        if self.separator is None:
            return [ids + self.end for ids in self._whole(texts)]
        out: list[bytes] = []
        at = 0
        while at < len(texts):
            to, size = at, 0
            while to < len(texts) and size < BLOCK_BYTES:
                size += len(texts[to])
                to += 1
            out += self._some(texts[at:to])
            at = to
        return out

    def _some(self, texts: list[str]) -> list[bytes]:
        """Ids of a block of texts, whose new stretches are encoded together."""
        if len(self.known) > self.limit or self.known.nbytes > HELD_BYTES:
            self.known, self.older = self._none(), self.known
        alone = [k for k, t in enumerate(texts) if self.mark in t and self.special.search(t)]
        spaced = [*map(_spaced, texts)]
        for k in alone:
            spaced[k] = b""
        # No text holds a line break any more, so one stands for the end of a text.
        raw = b" \n ".join([*spaced, b""])
        # Small letters for A-Z give the same ids in a lower-casing tokenizer and fewer stretches.
        del spaced
        words = _cut(raw.lower())
        del raw
        words = words.dictionary_encode()
        code, distinct = words.indices.to_numpy(), words.dictionary
        place = self._places(distinct, _hashes(distinct))
        begin, count, ids = self.known.begin[place], self.known.count[place], self.known.ids
        runs = []
        for at in range(0, len(code), GATHERED_WORDS):
            part = code[at : at + GATHERED_WORDS]
            runs.append(_runs(ids, begin[part], count[part]))
        raw = np.concatenate(runs).tobytes()
        edges = (np.cumsum(count[code])[code == code[-1]] * self.type.itemsize).tolist()
        out = [raw[i:j] for i, j in zip([0, *edges], edges)]
        for k in alone:
            out[k] = self._whole([texts[k]])[0] + self.end
        return out

    def _places(self, words: pa.Array, hashes: np.ndarray) -> np.ndarray:
        """Where the ids of distinct stretches are held, after those not held yet have been found or encoded."""
        place = self.known.find(words, hashes)
        gaps = np.flatnonzero(place < 0)
        missing, hashes = words.take(pa.array(gaps)), hashes[gaps]
        old = self.older.find(missing, hashes)
        again, new = np.flatnonzero(old >= 0), np.flatnonzero(old < 0)
        if len(again):
            begin, count = self.older.begin[old[again]], self.older.count[old[again]]
            ids = _runs(self.older.ids, begin, count)
            place[gaps[again]] = self.known.add(missing.take(pa.array(again)), hashes[again], ids, count)
        if len(new):
            order, ids, count = self._learn([w[:-1].decode() for w in missing.take(pa.array(new)).to_pylist()])
            new = new[order]
            place[gaps[new]] = self.known.add(missing.take(pa.array(new)), hashes[new], ids, count)
        return place


def _parts(words: list[str]) -> Iterator[list[str]]:
    """The words in parts of about ``LEARN_LETTERS`` letters; a longer word is in a part with what comes before it."""
    begin = size = 0
    for k, word in enumerate(words, 1):
        size += max(16, len(word))
        if size >= LEARN_LETTERS or k == len(words):
            yield words[begin:k]
            begin, size = k, 0


_TOUCHED = re.compile(r"(?s)[.,][ \n](?<=[^\w \n]..|[_İ]..)")


def _spaced(text: str) -> bytes:
    """The text with blanks for line breaks, and a blank before a comma or full stop at the end of a word.

    That blank is left out where another sign touches one, because signs in a row are one token.
    """
    raw = text.encode()
    if not _TOUCHED.search(text):
        raw = raw.replace(b", ", b" , ").replace(b". ", b" . ").replace(b".\n", b" . ")
    return raw.replace(b"\n", b" ")


def _cut(raw: bytes) -> pa.Array:
    """The stretches of bytes that end with a blank, each with the blank behind it."""
    ends = np.flatnonzero(np.frombuffer(raw, np.uint8) == 32) + 1
    offsets = np.concatenate([[0], ends]).astype(np.int64)
    return pa.Array.from_buffers(pa.large_binary(), len(ends), [None, pa.py_buffer(offsets), pa.py_buffer(raw)])


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows again, some ``BLOCK_BYTES`` at a time, and more where a text is longer."""
    held: list[pa.RecordBatch] = []

    def joined() -> pa.RecordBatch:
        return pa.Table.from_batches(held).combine_chunks().to_batches()[0]

    for piece in pieces(batches, "text", BLOCK_BYTES):
        if held and sum(p.nbytes for p in held) + piece.nbytes > BLOCK_BYTES:
            yield joined()
            held = []
        held.append(piece)
    if held:
        yield joined()


def _encode(
    batches: Iterator[pa.RecordBatch], source: str, end_id: int, separable: bool, bounds: list[int]
) -> Iterator[pa.RecordBatch]:
    encoder, edges = Encoder(source, end_id, separable), np.array(bounds, np.int64)
    for block in _blocks(batches):
        ids = block.column("id")
        keys = ids.fill_null(-(2**63)).to_numpy(zero_copy_only=False)
        lowest, highest = np.searchsorted(edges, keys, "left"), np.searchsorted(edges, keys, "right")
        tie = block.column("tie").to_numpy()
        # An id that fills several files is spread over them.
        file = lowest + tie.view(np.uint64) % (highest - lowest + 1).astype(np.uint64)
        texts = [t or "" for t in block.column("text").to_pylist()]
        yield pa.record_batch(
            [pa.array(file.astype(np.int32)), ids, pa.array(tie), pa.array(encoder(texts), pa.binary())],
            ["file", "id", "tie", "ids"],
        )


# ------------------------------------------------------------------ the file format
def write_token_file(out, number: int, width: int, documents: Iterable[tuple[int | None, bytes]]) -> tuple[int, int]:
    """Write (id, ids as bytes) pairs to a binary stream; returns the numbers of documents and ids."""
    import xxhash
    import zstandard

    packer = zstandard.ZstdCompressor(level=3, write_checksum=True)
    table: list[tuple[int, int, int]] = []
    index: list[tuple[int, bool, int, int, int]] = []
    held: list[bytes] = []
    size = total = 0

    def close_frame() -> None:
        nonlocal size
        raw = b"".join(held)
        packed = packer.compress(raw)
        out.write(packed)
        table.append((len(packed), len(raw), xxhash.xxh64_intdigest(raw) & 0xFFFFFFFF))
        held.clear()
        size = 0

    for key, ids in documents:
        index.append((0 if key is None else key, key is None, len(table), size // width, len(ids) // width))
        held.append(ids)
        size += len(ids)
        total += len(ids) // width
        if size >= FRAME_BYTES:
            close_frame()
    if held:
        close_frame()
    body = struct.pack(_INDEX, _MARK, width, number, len(index))
    for k, kind in enumerate(("<i8", "u1", "<u4", "<u4", "<u4")):
        body += np.array([row[k] for row in index], kind).tobytes()
    body += struct.pack("<I", zlib.crc32(body))
    out.write(struct.pack("<II", SKIPPABLE_INDEX, len(body)) + body)
    table.append((len(body) + 8, 0, xxhash.xxh64_intdigest(b"") & 0xFFFFFFFF))
    seek = b"".join(struct.pack("<III", *row) for row in table) + struct.pack("<IBI", len(table), HAS_CHECKSUMS, SEEKABLE_MAGIC)
    out.write(struct.pack("<II", SKIPPABLE_SEEK, len(seek)) + seek)
    return len(index), total


class TokenFile:
    """Reads documents of a token file from a seekable binary stream, frame by frame."""

    def __init__(self, stream) -> None:
        self.stream = stream
        self.length = stream.seek(0, io.SEEK_END)
        frames, flags, magic = struct.unpack("<IBI", self._at(self.length - 9, 9))
        if magic != SEEKABLE_MAGIC or flags != HAS_CHECKSUMS:
            raise ValueError("not a token file")
        table = np.frombuffer(self._at(self.length - 9 - 12 * frames, 12 * frames), "<u4").reshape(-1, 3)
        self.packed, self.raw, self.sums = (table[:, k].astype(np.int64) for k in range(3))
        self.begin = starts(self.packed)
        body = self._at(int(self.begin[-2]) + 8, int(self.packed[-1]) - 8)
        if zlib.crc32(body[:-4]) != struct.unpack("<I", body[-4:])[0]:
            raise ValueError("the document index is damaged")
        mark, self.width, self.number, n = struct.unpack_from(_INDEX, body)
        if mark != _MARK:
            raise ValueError("unknown document index")
        at, parts = struct.calcsize(_INDEX), []
        for kind in ("<i8", "u1", "<u4", "<u4", "<u4"):
            parts.append(np.frombuffer(body, kind, n, at))
            at += parts[-1].nbytes
        self.ids, missing, self.frame, self.place, self.count = parts
        self.missing = missing.astype(bool)

    def _at(self, place: int, size: int) -> bytes:
        self.stream.seek(place)
        return self.stream.read(size)

    def read_frame(self, k: int) -> np.ndarray:
        import xxhash
        import zstandard

        packed = self._at(int(self.begin[k]), int(self.packed[k]))
        raw = zstandard.ZstdDecompressor().decompress(packed, max_output_size=int(self.raw[k]))
        if xxhash.xxh64_intdigest(raw) & 0xFFFFFFFF != self.sums[k]:
            raise ValueError(f"frame {k} is damaged")
        return np.frombuffer(raw, f"<u{self.width}")

    def documents(self, wanted: Iterable[int] | None = None) -> Iterator[tuple[int | None, np.ndarray]]:
        """(id, ids) of all documents, or of the wanted ones, unpacking only their frames."""
        rows = np.arange(len(self.ids))
        if wanted is not None:
            rows = rows[np.isin(self.ids, np.fromiter(wanted, np.int64)) & ~self.missing]
        last, frame = -1, None
        for r in rows.tolist():
            if self.frame[r] != last:
                last = int(self.frame[r])
                frame = self.read_frame(last)
            at = int(self.place[r])
            yield None if self.missing[r] else int(self.ids[r]), frame[at : at + int(self.count[r])]


def _write(batches: Iterator[pa.RecordBatch], folder: str, width: int) -> Iterator[pa.RecordBatch]:
    """One file per number, under its final name only when it is whole: a repeated task writes the same file."""
    from pyarrow import fs

    store, root = fs.FileSystem.from_uri(folder)

    def rows() -> Iterator[tuple[int, int | None, bytes]]:
        for batch in batches:
            yield from zip(*(batch.column(c).to_pylist() for c in ("file", "id", "ids")))

    pending = rows()
    row = next(pending, None)
    while row is not None:
        number = row[0]

        def of_file() -> Iterator[tuple[int | None, bytes]]:
            nonlocal row
            while row is not None and row[0] == number:
                yield row[1], row[2]
                row = next(pending, None)

        name = f"{root}/part-{number:07d}.tok"
        part = f"{name}.{uuid.uuid4().hex}.part"
        with store.open_output_stream(part) as out:
            documents, ids = write_token_file(out, number, width, of_file())
        store.move(part, name)
        yield pa.record_batch(
            [pa.array([number], pa.int32()), pa.array([documents], pa.int64()), pa.array([ids], pa.int64())],
            ["file", "documents", "ids"],
        )


def write_tokens(
    docs: DataFrame, folder: str, tokenizer: str, end_id: int, id_col: str = "doc_id", text_col: str = "text",
    separable: bool = False, file_bytes: int = FILE_BYTES,
) -> DataFrame:
    """Write token files in ascending order of the id; returns (file, documents, ids) per file.

    Null ids come first, null texts count as empty, and every document ends with ``end_id``.
    Rows with one id keep together in an order given by a hash of their text; an id with more
    rows than fit in a file goes on in the next files.  Other columns are not read.  No rows
    give no file.
    """
    from pyarrow import fs

    spark = docs.sparkSession
    rows = docs.select(col(id_col).cast("long").alias("id"), col(text_col).alias("text"))
    size = rows.agg(F.count("*"), F.sum(F.octet_length("text"))).first()
    files = max(1, -(-((size[1] or 0) + 16 * size[0]) // file_bytes))
    bounds: list[int] = []
    if files > 1:
        shares = [k / files for k in range(1, files)]
        place = F.percentile_approx(F.coalesce("id", F.lit(-(2**63))), shares, max(10_000, 20 * files))
        bounds = rows.agg(place).first()[0]
    store, root = fs.FileSystem.from_uri(folder)
    store.create_dir(root)
    with open(tokenizer, encoding="utf-8") as file:
        source = file.read()  # executors need not have the file
    width = Encoder(source, end_id, separable).type.itemsize
    # The tie also tells identical rows apart, so that they can be spread.
    tie = F.xxhash64("text", F.monotonically_increasing_id()).alias("tie")
    # Larger tasks meet more of their words again; the number of tasks still follows the size.
    tasks = max(spark.sparkContext.defaultParallelism, -(-(size[1] or 0) // ENCODE_BYTES))
    encoded = rows.select("id", tie, F.col("text")).coalesce(tasks).mapInArrow(
        partial(_encode, source=source, end_id=end_id, separable=separable, bounds=bounds),
        "file int, id long, tie long, ids binary",
    )
    placed = encoded.repartitionById(files, F.col("file")).sortWithinPartitions("file", "id", "tie").select("file", "id", "ids")
    written = placed.mapInArrow(partial(_write, folder=folder, width=width), "file int, documents long, ids long")
    with small_batches(spark):
        return materialize(written, "token-files")


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for content in batch.column("content"):
            file = TokenFile(pa.BufferReader(content.as_buffer()))
            ids, counts, sums = [], [], []
            for key, values in file.documents():
                ids.append(key)
                counts.append(len(values))
                sums.append(zlib.crc32(values.astype("<u4").tobytes()))
            n = len(ids)
            yield pa.record_batch(
                [
                    pa.array(np.full(n, file.number, np.int32)), pa.array(ids, pa.int64()),
                    pa.array(starts(counts)[:n]), pa.array(counts, pa.int64()), pa.array(sums, pa.int64()),
                ],
                ["file", "id", "place", "n_tokens", "ids_crc32"],
            )


def read_tokens(spark: SparkSession, folder: str, written: DataFrame) -> DataFrame:
    """One row per document in the files: id, start (ids before it), n_tokens, ids_crc32."""
    content = spark.read.format("binaryFile").option("pathGlobFilter", "*.tok").load(folder).select("content")
    rows = content.mapInArrow(_read, "file int, id long, place long, n_tokens long, ids_crc32 long")
    before = F.coalesce(F.sum("ids").over(Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = materialize(written.select("file", before.alias("before")), "token-offsets")
    return rows.join(offsets, "file").select("id", (F.col("before") + F.col("place")).alias("start"), "n_tokens", "ids_crc32")


def read_documents(folder: str, file: int, wanted: Iterable[int]) -> dict[int, np.ndarray]:
    """Ids of some documents of one file, fetching only the frames that hold them."""
    from pyarrow import fs

    store, root = fs.FileSystem.from_uri(folder)
    with store.open_input_file(f"{root}/part-{file:07d}.tok") as stream:
        return dict(TokenFile(stream).documents(wanted))
