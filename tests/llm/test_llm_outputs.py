import io
import random
import zlib
from collections import Counter, defaultdict
from pathlib import Path

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from conftest_llm import plain_words
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from silo_analytics.llm import mixing, sharding, tokens, topk
from silo_analytics.scratch import scratch_path

WORD_BPE = public_tokenizers.path("word_bpe_49k.json")
BYTE_BPE = public_tokenizers.path("byte_bpe_50k.json")


# ------------------------------------------------------------------ token files
@pytest.mark.parametrize("path,separable,file_bytes", [(WORD_BPE, True, 1 << 30), (WORD_BPE, True, 20_000), (BYTE_BPE, False, 50_000)])
def test_token_files_give_back_all_ids_in_order(spark, odd, path, separable, file_bytes):
    folder = scratch_path(spark, "token-test")
    written = tokens.write_tokens(odd, folder, path, end_id=2, separable=separable, file_bytes=file_bytes)
    assert (written.count() > 3) == (file_bytes < 1 << 20)
    got = tokens.read_tokens(spark, folder, written).collect()
    coder = Tokenizer.from_file(path)
    rows = [(r.doc_id, coder.encode(r.text or "", add_special_tokens=False).ids + [2]) for r in odd.select("doc_id", "text").collect()]
    expected = Counter((d, len(i), zlib.crc32(np.array(i, "<u4").tobytes())) for d, i in rows)
    assert Counter((r.id, r.n_tokens, r.ids_crc32) for r in got) == expected
    ordered = sorted(got, key=lambda r: r.start)
    assert [r.start for r in ordered] == np.cumsum([0, *[r.n_tokens for r in ordered]])[:-1].tolist()
    ids = [-1 if r.id is None else r.id for r in ordered]
    assert ids == sorted(ids)
    file = written.orderBy("file").first().file
    some = tokens.read_documents(folder, file, [1, 2])
    known = dict(rows)
    assert all(v.tolist() == known[k] for k, v in some.items())


def test_only_asked_frames_are_read_and_damage_is_found():
    draw = np.random.default_rng(2)
    docs = [(k, draw.integers(0, 40_000, 30_000).astype("<u2").tobytes()) for k in range(20)]
    out = io.BytesIO()
    assert tokens.write_token_file(out, 7, 2, [*docs, (None, b"")]) == (21, 600_000)
    raw = out.getvalue()

    class Watched(io.BytesIO):
        read_bytes = 0

        def read(self, n=-1):
            Watched.read_bytes += n
            return super().read(n)

    file = tokens.TokenFile(Watched(raw))
    (key, ids), = file.documents([11])
    assert key == 11 and ids.tobytes() == docs[11][1] and Watched.read_bytes < len(raw) / 4
    assert file.number == 7 and len(list(file.documents())) == 21
    bad = bytearray(raw)
    bad[int(file.begin[3]) + 20] ^= 1
    with pytest.raises(Exception):
        list(tokens.TokenFile(io.BytesIO(bytes(bad))).documents())


def test_stretches_give_the_ids_of_whole_texts():
    coder = tokens.Encoder(Path(WORD_BPE).read_text(), 2, True, limit=500)
    draw = np.random.default_rng(1)
    signs = [*"abCÉéßΣσİıK  \n\n,,..''!?_-12<>|\t\x1ć̇ ", "<|endoftext|>", "'s", ". ", ", ", "日本", ".\n"]
    texts = ["".join(draw.choice(signs, draw.integers(0, 25))) for _ in range(4000)]
    whole = coder.tokenizer.encode_batch(texts, add_special_tokens=False)
    assert coder(texts) == [np.array([*e.ids, 2], "<u2").tobytes() for e in whole]


def test_special_tokens_in_other_letters_are_text():
    coder = tokens.Encoder(Path(WORD_BPE).read_text(), 2, True)
    texts = ["a <|ENDOFTEXT|> b", "<|EndOfText|>", "a<|startOFtext|>, B.", "A <|endoftext|> <|ENDOFTEXT|>", "<|StartOfText|><|startoftext|>\nC"]
    whole = coder.tokenizer.encode_batch(texts, add_special_tokens=False)
    assert coder(texts) == [np.array([*e.ids, 2], "<u2").tobytes() for e in whole]


def test_no_documents(spark, none):
    folder = scratch_path(spark, "token-test")
    written = tokens.write_tokens(none, folder, WORD_BPE, 2, separable=True)
    assert written.count() == 0 and tokens.read_tokens(spark, folder, written).count() == 0


# ------------------------------------------------------------------ shards
@pytest.mark.parametrize("bucket_bytes", [1 << 24, 3000])
def test_shards_hold_every_row_once_in_equal_counts(odd, bucket_bytes):
    got = sharding.shard_documents(odd, shards=7, bucket_bytes=bucket_bytes)
    rows = got.collect()
    assert sorted(str(r.row) for r in rows) == sorted(str(r) for r in odd.collect())
    slots = defaultdict(list)
    for r in rows:
        slots[r.shard].append(r.slot)
    assert set(slots) == set(range(7)) and all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert max(map(len, slots.values())) - min(map(len, slots.values())) <= 1


def test_order_is_random_and_comes_again(spark):
    rows = spark.range(4000).select(F.col("id").alias("doc_id"), F.lit("text").alias("text"))
    ids = [
        [r.row.doc_id for r in sharding.shard_documents(rows, 4, seed, bucket_bytes=8000).orderBy("shard", "slot").collect()]
        for seed in (1, 1, 2)
    ]
    assert ids[0] == ids[1] != ids[2] and sorted(ids[0]) == list(range(4000))
    assert abs(np.corrcoef(ids[0], range(4000))[0, 1]) < 0.1
    first = np.bincount(np.array([r // 1000 for r in ids[0][:1000]]), minlength=4)
    assert first.min() > 180  # a shard takes rows from everywhere


def test_copies_of_one_row_spread_over_buckets(spark):
    rows = spark.range(3000).select(F.lit(1).alias("doc_id"), F.lit("copy").alias("text"))
    shuffled = sharding.shuffle_rows(rows, 5, ["doc_id", "text"], sharding.text_size(), bucket_bytes=6000)
    counts = [r["count"] for r in shuffled.groupBy("bucket").count().collect()]
    assert len(counts) == 10 and max(counts) < 400


def test_fewer_rows_than_shards_and_none(spark, odd, none):
    got = sharding.shard_documents(odd.limit(3), shards=10).collect()
    assert sorted((r.shard, r.slot) for r in got) == [(0, 0), (1, 0), (2, 0)]
    assert sharding.shard_documents(none).collect() == []


# ------------------------------------------------------------------ top k
def brute_top(rows, k, every):
    out = []
    for q, v in rows.items():
        if q % every == 0:
            scored = sorted((-sum(a * b for a, b in zip(v, w)), c) for c, w in rows.items() if c != q)
            out += [(q, n, c, -s) for n, (s, c) in enumerate(scored[:k], 1)]
    return sorted(out)


@pytest.mark.parametrize("kind,block", [("random", 2048), ("random", 16), ("ties", 16), ("large", 16), ("one side", 16)])
def test_top_k_equals_all_pairs(spark, kind, block):
    draw = np.random.default_rng(3)
    n = 120
    x = {
        "random": draw.normal(0, 1, (n, 10)), "ties": draw.integers(0, 2, (n, 10)) / 256, "large": draw.normal(0, 1e5, (n, 10)),
        "one side": np.abs(draw.normal(0, 1, (n, 10))),
    }[kind]
    data = [(int(k), [float(c) for c in row]) for k, row in enumerate(x)]
    vectors = topk.integer_vectors(spark.createDataFrame(data, "vec_id long, embedding array<double>"))
    rows = {k: [int(np.floor(256 * c)) for c in v] for k, v in data}
    assert {r.id: r.v for r in vectors.collect()} == rows
    got = topk.top_inner_products(vectors, vectors.where("id % 10 = 0"), 5, block, block).collect()
    assert sorted(map(tuple, got)) == brute_top(rows, 5, 10)


def test_queries_reach_the_rows_in_bounded_broadcasts(spark, monkeypatch):
    draw = np.random.default_rng(5)
    data = [(k, v.tolist()) for k, v in enumerate(draw.normal(0, 1, (600, 10)))]
    vectors = topk.integer_vectors(spark.createDataFrame(data, "vec_id long, embedding array<double>"))
    rows = {r.id: r.v for r in vectors.collect()}
    sent = []

    def broadcast(df):
        sent.append(sum(len(r[c]) for r in df.collect() for c in r.__fields__))
        return df.hint("broadcast")

    monkeypatch.setattr(topk.F, "broadcast", broadcast)
    monkeypatch.setattr(topk, "QUERY_BYTES", 2_000, raising=False)
    got = topk.top_inner_products(vectors, vectors.where("id % 5 = 0"), 5, 16, 16).collect()
    assert sorted(map(tuple, got)) == brute_top(rows, 5, 5)
    # Two phases; per query an id, a cutoff, a length and ten components of two bytes, once each.
    assert len(sent) > 2 and sum(sent) == 2 * 120 * (8 + 8 + 4 + 20) and max(sent) <= 3 * 2_000


def test_odd_vectors(spark):
    data = [(0, [1.0, 2.0]), (0, [1.0, 2.0]), (0, [0.5]), (1, None), (2, [None, 1.0]), (3, [float("nan"), 1.0]), (None, [1.0, 1.0]),
            (4, [float("inf")]), (5, []), (6, [3.0, 1.0, 2.0]), (10, [0.0, -1.0])]
    table = spark.createDataFrame([(*d, "z", "z") for d in data], "vec_id long, embedding array<double>, id string, v string")
    vectors = topk.integer_vectors(table)
    held = [(0, [128]), (0, [256, 512]), (6, [768, 256, 512]), (10, [0, -256])]
    assert sorted((r.id, r.v) for r in vectors.collect()) == held
    got = topk.top_inner_products(vectors, vectors.where("id % 10 = 0"), 5).collect()
    # Every vector of a query's id asks, and every vector under another id answers.
    expected = []
    for query in (0, 10):
        pairs = [(-sum(a * b for a, b in zip(q, v)), i) for name, q in held if name == query for i, v in held if i != query]
        expected += [(query, rank, i, -score) for rank, (score, i) in enumerate(sorted(pairs), 1)]
    assert sorted(map(tuple, got)) == expected and expected[0] == (0, 1, 6, 327680)
    none = vectors.where("false")
    assert topk.top_inner_products(none, none).collect() == [] and topk.top_inner_products(vectors, none).collect() == []
    alone = vectors.where("id = 0")
    assert topk.top_inner_products(alone, alone).collect() == []


# ------------------------------------------------------------------ mixing
def fill(budget, caps, weights):
    """Shares of siblings, by capping whoever is over its share until nobody is."""
    share, free = dict.fromkeys(caps, 0.0), {c for c in caps if weights[c] > 0}
    left = budget
    while free:
        total = sum(weights[c] for c in free)
        over = {c for c in free if caps[c] <= weights[c] * left / total}
        if not over:
            share.update((c, weights[c] * left / total) for c in free)
            break
        share.update((c, caps[c]) for c in over)
        left -= sum(caps[c] for c in over)
        free -= over
    return share


@pytest.mark.parametrize("share,epochs", [(0.3, 1), (0.9, 2), (3.0, 2)])
def test_budgets_go_down_the_tree(spark, share, epochs):
    tokens_of = {("a", "x", "1"): 1000, ("a", "x", "2"): 10, ("a", "y", "1"): 500, ("b", "x", "1"): 40, ("c", "z", "9"): 300}
    leaves = spark.createDataFrame([(*k, v) for k, v in tokens_of.items()], "p string, q string, r string, tokens long")
    weights = [{"a": 10, "b": 70}, {"x": 3}, {}]
    defaults = [20, 1, 1]
    budget = share * sum(tokens_of.values())
    got = {tuple(r[:3]): r.budget for r in mixing.leaf_budgets(leaves, ["p", "q", "r"], weights, defaults, budget, epochs).collect()}
    asked = {(): budget}
    for depth in range(3):
        below = {}
        for parent, amount in asked.items():
            caps = defaultdict(float)
            for k, v in tokens_of.items():
                if k[:depth] == parent:
                    caps[k[depth]] += v * epochs
            w = {c: weights[depth].get(c, defaults[depth]) for c in caps}
            below |= {(*parent, c): s for c, s in fill(amount, caps, w).items()}
        asked = below
    assert got == pytest.approx(asked)
    assert sum(got.values()) == pytest.approx(min(budget, epochs * sum(tokens_of.values())))


@pytest.mark.parametrize("cut_rows", [2000, 1])
def test_leaves_take_whole_epochs_and_a_prefix(odd, monkeypatch, cut_rows):
    monkeypatch.setattr(mixing, "CUT_ROWS", cut_rows)
    taken = mixing.choose_documents(odd, ["lang", "source"], [{"en": 3, "fr": 1}, {}], [1, 1], share=1.1, max_epochs=2).collect()
    rows = odd.select("doc_id", "text").collect()
    assert Counter((r.id, r.tokens) for r in taken) == Counter((r.doc_id, len(plain_words(r.text))) for r in rows)
    total = sum(r.tokens for r in taken)
    by_leaf = defaultdict(list)
    for r in taken:
        by_leaf[(r.lang, r.source)].append(r)
    assert sum(r.epochs * r.tokens for r in taken) <= 1.1 * total
    for leaf in by_leaf.values():
        assert max(r.epochs for r in leaf) <= 2 and max(r.epochs for r in leaf) - min(r.epochs for r in leaf) <= 1


def test_nothing_to_mix(none):
    assert mixing.choose_documents(none, ["lang"], [{}], [1]).collect() == []


@pytest.mark.parametrize("ids", ["distinct", "null", "half null", "repeated"])
def test_a_leaf_takes_its_budget_whatever_the_ids(spark, ids):
    number = {"distinct": lambda k: k, "null": lambda k: None, "half null": lambda k: k if k % 2 else None, "repeated": lambda k: k % 3}[ids]
    rows = [(number(k), " ".join(["w"] * (k % 9 + 1)), "en", "s0") for k in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    taken = mixing.choose_documents(docs, ["lang", "source"], [{}, {}], [1, 1], share=0.5, max_epochs=1).collect()
    total = sum(r.tokens for r in taken)
    assert len(taken) == 400 and total // 2 - 9 <= sum(r.tokens * r.epochs for r in taken) <= total // 2


def test_an_encoder_forgets_what_is_rare():
    source = Path(public_tokenizers.path("word_bpe_49k.json")).read_text()
    plain, small = tokens.Encoder(source, 2, False), tokens.Encoder(source, 2, True, limit=300)
    draw = random.Random(4)
    often = ["the", "of", "And", "x1,", "end.", "<|", "é"]
    kept = []
    for k in range(40):
        texts = [" ".join(draw.choice(often) if draw.random() < 0.7 else f"w{draw.randrange(10**6)}" for _ in range(60)) for _ in range(5)]
        assert small(texts) == plain(texts)
        kept.append("the" in small.known or "the" in small.older)
        assert len(small.known) + len(small.older) <= 2 * (300 + 300)
    assert all(kept) and small.older


def test_an_encoder_learns_a_large_vocabulary_once_and_holds_it_packed():
    coder, learned = tokens.Encoder(Path(WORD_BPE).read_text(), 2, True), []
    learn = coder._learn
    coder._learn = lambda new: learned.extend(new) or learn(new)
    draw = random.Random(5)
    words = ["".join(draw.choices("abcdeé", k=9)) for _ in range(250_000)]
    texts = [" ".join(words[at : at + 5000]) for at in range(0, len(words), 5000)]
    first = [coder([t])[0] for t in texts]
    assert first[::10] == [coder._whole([t])[0] + coder.end for t in texts[::10]]
    assert [coder([t])[0] for t in texts] == first and coder(texts) == first
    assert len(learned) == len(set(words))
    held = coder.known
    assert held.words.nbytes + held.ids.nbytes + held.begin.nbytes + held.count.nbytes < 60 * len(held)


def test_a_lookup_takes_memory_by_what_is_looked_up_not_by_what_is_held():
    coder, draw = tokens.Encoder(Path(WORD_BPE).read_text(), 2, True), random.Random(6)
    texts = [" ".join("".join(draw.choices("abcde", k=9)) for _ in range(5000)) for _ in range(40)]
    first = [coder([t])[0] for t in texts]
    before = pa.default_memory_pool()
    pool = pa.proxy_memory_pool(before)
    pa.set_memory_pool(pool)
    try:
        again = coder(texts[:1])
    finally:
        pa.set_memory_pool(before)
    assert again == first[:1] and len(coder.known) > 150_000
    assert pool.max_memory() < 2_000_000


def test_long_stretches_are_held_by_their_bytes(monkeypatch):
    monkeypatch.setattr(tokens, "HELD_BYTES", 50_000)
    coder, draw = tokens.Encoder(Path(WORD_BPE).read_text(), 2, True), random.Random(7)
    for _ in range(20):
        texts = ["".join(draw.choices("日本語の文章。<x>é", k=2000)) + " a" for _ in range(3)]
        assert coder(texts) == [coder._whole([t])[0] + coder.end for t in texts]
        assert coder.known.words.nbytes + coder.older.words.nbytes < 2 * (50_000 + 30_000)
    assert coder.older


def test_stretches_of_one_hash_are_told_apart(monkeypatch):
    monkeypatch.setattr(tokens, "_hashes", lambda words: np.array([len(w.as_py()) % 2 for w in words], np.int64))
    coder = tokens.Encoder(Path(WORD_BPE).read_text(), 2, True, limit=20)
    texts = ["the cat sat on the mat", "on a mat, cats sat.", "", "cat the"] * 5
    assert [coder([t])[0] for t in texts] == [coder._whole([t])[0] + coder.end for t in texts]


def test_blocks_hold_all_rows_in_order_whatever_their_size(monkeypatch):
    monkeypatch.setattr(tokens, "BLOCK_BYTES", 2000)
    texts = [None, "", "a b" * 3000, *["x" * (k % 300) for k in range(500)], "z" * 5000, None]
    rows = pa.record_batch([pa.array(range(len(texts))), pa.array(texts, pa.string())], ["id", "text"])
    blocks = list(tokens._blocks(iter([rows.slice(0, 7), rows.slice(7, 0), rows.slice(7)])))
    assert pa.Table.from_batches(blocks).equals(pa.Table.from_batches([rows]).combine_chunks())
    assert 10 < len(blocks) < 200
    assert all(b.nbytes - max(len(t or "") for t in b.column("text").to_pylist()) < 4000 for b in blocks)
