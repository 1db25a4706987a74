"""Ranked search by ball trees, chunk-wise encoding and the conversation trie against plain versions."""

import hashlib
import math
import random
import re
from collections import Counter, defaultdict
from pathlib import Path

import numpy as np
import public_tokenizers
import pytest
from conftest_llm import LETTERS, make, odd_rows
from tokenizers import Tokenizer

from silo_analytics.llm import balltree, chunkcode, common, trie

SOURCE = Path(public_tokenizers.path("byte_bpe_50k.json")).read_text()
ODD_PARTS = ["a", "b", "'s", "'re", "'", " ", "  ", "\n", "\t", "1", "22", "!", "...", "é", "東京", "😀", " the", "\x1c", "\x85", "ll", "͸", "𐤀", " \n ", "word ", "Ж"]


# ------------------------------------------------------------------ encoding
@pytest.fixture(scope="module")
def coders():
    return chunkcode.PieceCoder(SOURCE), Tokenizer.from_str(SOURCE)


def test_joined_parts_give_the_ids_of_the_whole_text(coders):
    coder, library = coders
    draw = random.Random(1)
    for _ in range(4000):
        text = "".join(draw.choices(ODD_PARTS, k=draw.randint(0, 60)))
        edges = [0, *sorted(draw.choices(range(len(text) + 1), k=draw.randint(0, 6))), len(text)]
        parts = []
        for i, j in zip(edges, edges[1:]):
            ids, marks = coder.chunk(text[i:j])
            parts.append((None, ids, marks) if draw.random() < 0.6 else (text[i:j], None, None))
        expected = library.encode(text, add_special_tokens=False).ids
        assert np.frombuffer(coder.joined(parts), coder.type).tolist() == expected, (text, edges)
        assert coder.decoded(coder.joined(parts)).decode() == library.decode(expected, skip_special_tokens=False)


def test_characters_are_split_as_by_the_library(coders):
    coder, library = coders
    for c in [*range(0x3000), *range(0x3000, 0x110000, 37)]:
        if not 0xD800 <= c < 0xE000:
            text = f"a{chr(c)}1{chr(c)} {chr(c)}{chr(c)}!{chr(c)}a "
            assert coder.words(text) == [text[i:j] for _, (i, j) in library.pre_tokenizer.pre_tokenize_str(text)], hex(c)


def test_a_word_without_end_and_many_words(coders):
    coder, library = coders
    small = chunkcode.PieceCoder(SOURCE, limit=50)
    for text in ("a" * 30_000, "x y " * 3000, " " * 5000 + "end", "".join(f" w{k}" for k in range(4000))):
        parts = [(None, *coder.chunk(text[i : i + 700])) for i in range(0, len(text), 700)]
        expected = library.encode(text, add_special_tokens=False).ids
        assert np.frombuffer(coder.joined(parts), coder.type).tolist() == expected
        assert np.frombuffer(small.whole(text.encode()), coder.type).tolist() == expected


def test_cuts_follow_the_content():
    draw = random.Random(2)
    shared = "".join(draw.choices("abcdefgh é ", k=3000)).encode()
    cutter = chunkcode.Cutter(32)
    first = set(cutter.chunks(shared))
    other = cutter.chunks(b"some other beginning " + shared)
    assert len(first) > 20 and len(first & set(other)) > 0.9 * len(first) and b"".join(other).endswith(shared)
    run = cutter.chunks(b"a" * 5000)
    assert len(run) <= 2 and b"".join(run) == b"a" * 5000 and all(c.decode() for c in other)


@pytest.mark.parametrize("radius,hot", [(16, 10_000), (16, 1), (512, 10_000)])
def test_documents_are_encoded_as_by_the_library(spark, monkeypatch, radius, hot):
    monkeypatch.setattr(common, "HOT_KEYS", hot)
    rows = [*odd_rows(), (200, "a <|endoftext|> b"), (201, "<|ENDOFTEXT|>"), (None, "<|endoftext|>")]
    got = chunkcode.encode_documents(make(spark, rows), SOURCE, radius=radius).collect()
    library, expected = Tokenizer.from_str(SOURCE), Counter()
    for key, text in rows:
        ids = library.encode(text or "", add_special_tokens=False).ids
        decoded = library.decode(ids, skip_special_tokens=False)
        expected[key, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).digest(), hashlib.sha256(decoded.encode()).digest()] += 1
    assert Counter((r.id, r.n_tokens, bytes(r.ids_sha), bytes(r.text_sha)) for r in got) == expected


def test_no_documents_to_encode(spark, none):
    assert chunkcode.encode_documents(none, SOURCE).count() == 0
    word = Path(public_tokenizers.path("word_bpe_49k.json")).read_text()
    with pytest.raises(ValueError):
        chunkcode.PieceCoder(word)


# ------------------------------------------------------------------ search
def search_terms(text):
    return re.findall("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+", (text or "").translate(LETTERS))


def brute_ranks(docs, items, k):
    words = [Counter(search_terms(t)) for _, t in docs]
    sizes = [sum(w.values()) for w in words]
    n, total = sum(s > 0 for s in sizes), sum(sizes)
    held = Counter(t for w in words for t in w)
    asked = defaultdict(set)
    for item, text in items:
        asked[item] |= set(search_terms(text))
    out = []
    for item, terms in asked.items():
        rows = []
        for (key, _), w, size in zip(docs, words, sizes):
            m = 50 + 50 * size * n // total if total else 0
            score = sum(
                math.floor(1000 * math.log((2 * n + 2) / (2 * held[t] + 1))) * (10**9 * w[t] // (1000 * w[t] + 20 * m)) for t in terms if t in w
            )
            rows.append((-score, key is None, key or 0))
        out += [(item, r, None if none else key, -s) for r, (s, none, key) in enumerate(sorted(x for x in rows if x[0] < 0)[:k], 1)]
    return sorted(map(str, out))


@pytest.mark.parametrize("block,group,leaf", [(2048, 512, 32), (24, 3, 4)])
def test_ranks_as_by_brute_force(spark, monkeypatch, block, group, leaf):
    monkeypatch.setattr(balltree, "LEAF", leaf)
    monkeypatch.setattr(balltree, "QUERY_BYTES", 32 << 20 if block > 100 else 0)
    draw = random.Random(5)
    docs = [*odd_rows(), *((300 + k, "same text a b c d") for k in range(40)), (None, "same text a b c d")]
    texts = [t for _, t in docs if t]
    items = [(k, " ".join(draw.choices(texts[k].split() or ["zz"], k=6))) for k in range(12)]
    items += [(3, "same, TEXT"), (None, texts[4]), (None, texts[5]), (20, None), (21, "nowhere"), (22, "")]
    table = spark.createDataFrame([(*i, "x", "y") for i in items], "item_id long, text string, id string, terms string")
    counts = {}
    got = balltree.ranked_documents(make(spark, docs), table, k=7, block=block, group=group, counts=counts).collect()
    assert sorted(str((r.item_id, r.rank, r.doc_id, r.score)) for r in got) == brute_ranks(docs, items, 7)
    assert 0 < counts["scored"] <= counts["pairs"]


def test_bounds_hold_for_every_node():
    draw = np.random.default_rng(6)
    n, width = 300, 40
    lengths = draw.integers(1, 12, n)
    terms = np.concatenate([draw.choice(width, k, replace=False) for k in lengths])
    values = draw.integers(1, 10**6, len(terms))
    block = balltree.Block.build(np.arange(n), np.zeros(n, np.uint8), lengths, terms, values)
    dense = np.zeros((n, len(block.vocabulary)), np.int64)
    dense[np.repeat(np.arange(n), block.lengths), block.places] = block.values
    queries = []
    for _ in range(20):
        places = draw.choice(len(block.vocabulary), 6, replace=False)
        queries.append((places, draw.integers(1, 12_000, 6)))
    for (places, weights), bounds in zip(queries, block.bounds(queries)):
        scores = dense[:, places] @ weights
        assert all(scores[i:j].max() <= b for i, j, b in zip(block.begin, block.end, bounds))


# ------------------------------------------------------------------ trie
def brute_trie(turns):
    """Rows of the trie of {conversation: [(role, text), ...]}."""
    members = defaultdict(list)
    for c in sorted(turns):
        for d in range(len(turns[c]) + 1):
            members[tuple(turns[c][:d])].append(c)
    out = []
    for path, convs in members.items():
        below = [p for p in members if p[: len(path)] == path]
        ends = ",".join(str(c) for c in convs if len(turns[c]) == len(path))
        leaves = [p for p in below if not any(len(q) == len(p) + 1 and q[: len(p)] == p for q in members)]
        saved = sum((len(members[p]) - 1) * len(p[-1][1].encode()) for p in below if p)
        children = sum(len(p) == len(path) + 1 for p in below)
        up = members[path[:-1]][0] if path else None
        out.append((convs[0], len(path), up, len(convs), children, len(leaves), saved, hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(map(str, out))


@pytest.mark.parametrize("band,hot,piece", [(8, 10_000, 500_000), (2, 10_000, 20), (3, 1, 20)])
def test_trie_as_by_brute_force(spark, monkeypatch, band, hot, piece):
    monkeypatch.setattr(common, "HOT_KEYS", hot)
    monkeypatch.setattr(common, "PIECE_ROWS", piece)
    draw = random.Random(7)
    turns = {c: [(draw.choice("ub"), draw.choice(["", "hi", "ünï"])) for _ in range(draw.choice([1, 2, 5, 9, 30]))] for c in range(25)}
    turns |= {30 + c: turns[3] for c in range(5)} | {40: []}
    rows = [(c, k, *t, "x") for c, ts in turns.items() for k, t in enumerate(ts)]
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, place string").repartition(3)
    ordered = trie.ordered_turns(table)
    sizes = spark.createDataFrame([(c, len(t)) for c, t in turns.items()], "conv long, n long")
    got = trie.prefix_trie(ordered, sizes, band).collect()
    assert sorted(str(tuple(r)) for r in got) == brute_trie(turns)
