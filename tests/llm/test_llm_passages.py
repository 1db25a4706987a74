import hashlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from conftest_llm import make
from conftest_llm import item_words, plain_words
from pyspark.sql import functions as F

from silo_analytics.llm import common, linedup, recompress, winnow


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def without_repeats(rows, window):
    words = [plain_words(t) for _, t in rows]
    count = Counter(tuple(w[i : i + window]) for w in words for i in range(len(w) - window + 1))
    out = []
    for (d, _), w in zip(rows, words):
        gone = set()
        for i in range(len(w) - window + 1):
            if count[tuple(w[i : i + window])] > 1:
                gone.update(range(i, i + window))
        out.append((d, len(w), len(gone), sha(" ".join(x for i, x in enumerate(w) if i not in gone))))
    return sorted(map(str, out))


@pytest.mark.parametrize("window,held", [(35, 4_000_000), (35, 0), (20, 4_000_000)])
def test_repeats_go_as_by_brute_force(odd, window, held):
    rows = [(r.doc_id, r.text) for r in odd.select("doc_id", "text").collect()]
    got = recompress.remove_repeats(odd, window, held_names=held).collect()
    assert sorted(str(tuple(r)) for r in got) == without_repeats(rows, window)


def test_equal_windows_pick_the_same_symbol():
    draw = np.random.default_rng(3)
    for kinds in (3, 30, 3000):
        words = draw.integers(1, kinds + 1, 4000).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        words[1000:1200] = words[3000:3200]
        words[1500:1560] = words[1500]  # a run
        words[2000:2060] = words[1500]
        words[[0, 700, 2500, -1]] = 0
        sym, low, high, width = recompress.symbols(words)
        picked = recompress.picks(sym, low, high, width, len(words), 35)
        seen = {}
        for p, k in enumerate(picked.tolist()):
            content = words[p : p + 35].tobytes()
            what = None if k < 0 else (int(sym[k]), int(low[k]) - p, int(high[k]) - p)
            assert what is None or 0 <= what[1] < what[2] <= 35
            if 0 not in words[p : p + 35]:
                assert seen.setdefault(content, what) == what


def test_window_hashes_are_of_the_whole_window():
    words = np.arange(1, 200, dtype=np.uint64) % np.uint64(7) + np.uint64(1)
    hashes = recompress.window_hashes(words, 35)
    assert len(hashes) == 199 - 34 and len(np.unique(hashes)) == 7
    assert len(recompress.window_hashes(words[:10], 35)) == 0


def contaminated(rows, items, window):
    known, lengths = defaultdict(set), set()
    for name, text in items:
        w = item_words(text)
        n = min(window, len(w))
        if n:
            lengths.add(n)
            for i in range(len(w) - n + 1):
                known[tuple(w[i : i + n])].add("" if name is None else str(name))
    out = []
    for d, text in rows:
        w, hit, names = item_words(text), set(), set()
        for n in lengths:
            for i in range(len(w) - n + 1):
                found = known.get(tuple(w[i : i + n]))
                if found:
                    names |= found
                    hit.update(range(i, i + n))
        out.append((d, len(w), len(hit), len(names), sha(",".join(sorted(names))), bool(hit)))
    return sorted(map(str, out))


@pytest.mark.parametrize("hot", [10_000, 1])
def test_contamination_as_by_brute_force(spark, odd, hot, monkeypatch):
    monkeypatch.setattr(common, "HOT_KEYS", hot)
    rows = [(r.doc_id, r.text) for r in odd.select("doc_id", "text").collect()]
    texts = [t for _, t in rows if t and len(t) > 60][:12]
    items = [(1, texts[0][:90].upper()), (2, "line"), (3, "of the shared"), (4, None), (5, ""), (6, "--"), (None, texts[1][5:80])]
    items += [(7, texts[2]), (7, texts[2]), (11, "東京"), (12, texts[3][:200]), (10, texts[3][:200]), (13, "same " * 12)]
    table = spark.createDataFrame(items, "item_id long, text string").withColumn("items", F.lit("z"))
    got = winnow.contamination_report(winnow.contamination(odd, table, window=10)).collect()
    assert sorted(str(tuple(r)) for r in got) == contaminated(rows, items, 10)


def test_an_item_with_several_texts_is_named_once(spark):
    items = [(1, "one two three"), (1, "four five six"), (None, "seven eight"), (None, "nine ten"), (2, "one two")]
    rows = [(1, "one two three four five six seven eight nine ten"), (2, "four five six one two three"), (3, "nine")]
    table = spark.createDataFrame(items, "item_id long, text string")
    got = winnow.contamination_report(winnow.contamination(make(spark, rows), table)).collect()
    assert [r.n_items for r in sorted(got)] == [3, 2, 0]
    assert sorted(str(tuple(r)) for r in got) == contaminated(rows, items, 10)


def test_every_span_of_a_window_shares_a_fingerprint():
    draw = np.random.default_rng(5)
    grams = draw.integers(0, 50, 2000).astype(np.uint64)
    low = winnow.winnow(grams, 6)
    assert [int(grams[i : i + 6].min()) for i in range(len(low))] == low.tolist()


def later_lines(rows):
    lines = {k: (t.split("\n") if t else []) for k, (_, t) in enumerate(rows)}
    first = {}
    order = sorted(lines, key=lambda k: (rows[k][0] is None, rows[k][0] or 0, k))
    gone = {k: set() for k in lines}
    for k in order:
        for i in range(len(lines[k]) - 2):
            if first.setdefault(tuple(lines[k][i : i + 3]), (k, i)) != (k, i):
                gone[k].update(range(i, i + 3))
    return sorted(
        str((rows[k][0], len(ls), len(gone[k]), "\n".join(x for i, x in enumerate(ls) if i not in gone[k]))) for k, ls in lines.items()
    )


def test_later_line_windows_go_as_by_brute_force(spark, odd):
    rows = [(r.doc_id, r.text) for r in odd.select("doc_id", "text").collect()]
    # Here no two rows with lines share an id.
    got = linedup.remove_later_windows(odd).collect()
    assert sorted(str(tuple(r)) for r in got) == later_lines(rows)


def test_line_windows_of_rows_stored_twice(spark):
    rows = [(1, "a\nb\nc\nd"), (1, "a\nb\nc\nd"), (2, "x\na\nb\nc"), (None, "a\nb\nc"), (3, "a\nb")]
    got = linedup.remove_later_windows(make(spark, rows)).collect()
    assert sorted((r.id or 0, r.n_removed, r.kept) for r in got) == [
        (0, 3, ""), (1, 0, "a\nb\nc\nd"), (1, 4, ""), (2, 3, "x"), (3, 0, "a\nb")
    ]


def test_no_rows(spark, none):
    items = spark.createDataFrame([(1, "a b c")], "item_id long, text string")
    assert recompress.remove_repeats(none).collect() == []
    assert linedup.remove_later_windows(none).collect() == []
    assert winnow.contamination(none, items).collect() == []


def test_no_items(spark, odd):
    items = spark.createDataFrame([], "item_id long, text string")
    got = winnow.contamination_report(winnow.contamination(odd, items)).collect()
    assert len(got) == odd.count() and not any(r.contaminated for r in got)
