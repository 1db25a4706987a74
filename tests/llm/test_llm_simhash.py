import random

import numpy as np
import pytest
import xxhash
from conftest_llm import LETTERS, brute_groups, plain_words
from pyspark.sql import functions as F

from silo_analytics.llm import simhash


def brute_print(text):
    words = plain_words((text or "").translate(LETTERS))
    if not words:
        return 0
    parts = [" ".join(words[i : i + 4]) for i in range(len(words) - 3)] if len(words) >= 4 else [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(p.encode(), 42) for p in parts]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_groups_of_odd_rows_are_those_of_all_pairs(odd):
    rows = [(r.doc_id, r.text) for r in odd.collect()]
    prints = [brute_print(t) for _, t in rows]
    groups = brute_groups(prints, lambda a, b: (a ^ b).bit_count() <= 4)
    smallest = {g: min((rows[i][0] for i in range(len(rows)) if groups[i] == g and rows[i][0] is not None), default=None) for g in groups}
    expected = sorted(map(str, ((d, p, smallest[g]) for (d, _), p, g in zip(rows, prints, groups))))
    got = simhash.simhash_groups(odd).collect()
    assert sorted(str((r.id, r.fp & (2**64 - 1), r.component_id)) for r in got) == expected


def near_prints(count, seed):
    """Fingerprints around a few centres, chained and dense, and unrelated ones."""
    draw = random.Random(seed)
    out = {draw.getrandbits(64) for _ in range(count)}
    for _ in range(3):
        at = draw.getrandbits(64)
        for _ in range(count // 2):
            at ^= 1 << draw.randrange(64)
            out.add(at)
            out.add(at ^ sum({1 << draw.randrange(64) for _ in range(6)}))
    return sorted(simhash._signed(p) for p in out)


@pytest.mark.parametrize("chunk", [1024, 16])
def test_links_join_what_all_close_pairs_join(spark, monkeypatch, chunk):
    monkeypatch.setattr(simhash, "CHUNK", chunk)
    prints = near_prints(300, 8)
    fps = spark.createDataFrame([(p,) for p in prints], "fp long")
    links = {(r.a, r.b) for r in simhash.links(fps, 4).collect()}
    assert all(((a ^ b) & (2**64 - 1)).bit_count() <= 4 for a, b in links)
    expected = brute_groups(prints, lambda a, b: ((a ^ b) & (2**64 - 1)).bit_count() <= 4)
    assert brute_groups(prints, lambda a, b: (a, b) in links or (b, a) in links) == expected


@pytest.mark.parametrize("count", [10, 2**14, 2**22, 2**26])
def test_blocks_leave_room_and_every_close_pair_meets(count):
    blocks = simhash.blocks_for(count, 4)
    masks = simhash._masks(blocks, blocks - 4)
    draw = np.random.default_rng(1)
    for _ in range(200):
        x = int(draw.integers(0, 2**63))
        y = x ^ sum({1 << int(b) for b in draw.integers(0, 64, 4)})
        assert any(x & (m & (2**64 - 1)) == y & (m & (2**64 - 1)) for m in masks)


def test_one_of_each_group_stays(odd):
    kept = simhash.keep_one_per_group(odd)
    assert kept.columns == odd.columns
    rows = [(r.doc_id, r.text) for r in kept.collect()]
    groups = simhash.simhash_groups(odd)
    assert len(rows) == groups.select("root").distinct().count()
    ids = [d for d, _ in rows]
    assert 105 not in ids and 106 not in ids and ids.count(7) == 2 and {1, 6, 100} <= set(ids)


def test_no_rows(none):
    assert simhash.simhash_groups(none).collect() == []
    assert simhash.keep_one_per_group(none).collect() == []


def test_a_group_of_thousands_of_copies_is_one_row_per_document(spark):
    rows = spark.range(5000).select(F.col("id").alias("doc_id"), F.lit("the same words in every text of this group").alias("text"))
    got = simhash.simhash_groups(rows)
    assert got.count() == 5000 and [r.component_id for r in got.select("component_id").distinct().collect()] == [0]
