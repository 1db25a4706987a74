"""Plain helpers of these tests."""

import random
import re

LETTERS = str.maketrans({c: chr(c + 32) for c in range(65, 91)})


def plain_words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def item_words(text):
    return re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", (text or "").translate(LETTERS))


def brute_groups(values, linked):
    """The number of the first member of each value's group."""
    root = list(range(len(values)))

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(values)):
        for j in range(i):
            if linked(values[i], values[j]):
                a, b = top(i), top(j)
                root[max(a, b)] = min(a, b)
    return [top(i) for i in range(len(values))]


CLASHING = "id text_hash fp root key size names place a b y x bucket draw row tokens epochs file ids lang source word".split()


def make(spark, rows):
    """(doc_id, text) rows as documents with many more columns, whose names operators use inside."""
    more = [c for c in CLASHING if c not in ("lang", "source")]
    schema = "doc_id long, text string, lang string, source string, " + ", ".join(f"`{c}` string" for c in more)
    full = [(d, t, ("en", "fr", None)[k % 3], f"src{k % 4}" if k % 5 else None, *["z"] * len(more)) for k, (d, t) in enumerate(rows)]
    return spark.createDataFrame(full, schema)


def odd_rows():
    """Nulls, empties, ties, repeats, copies, blanks of all kinds, other scripts and a very long text."""
    draw = random.Random(4)
    words = ["".join(draw.choices("abcdeft", k=draw.randint(1, 6))) for _ in range(300)]
    prose = [" ".join(draw.choices(words, k=draw.choice([3, 9, 34, 35, 36, 80, 200]))) for _ in range(40)]
    passage = " ".join(draw.choices(words, k=50))
    lines = "\n".join(f"line {k} of the shared lines" for k in range(5))
    rows = list(enumerate(prose, 1))
    rows += [(100, None), (101, ""), (102, " \t\n "), (None, prose[3]), (None, None), (103, "one"), (104, "Ünï çödé Straße 東京 😀")]
    rows += [(105, prose[5]), (106, prose[5]), (7, prose[6]), (7, prose[6]), (7, prose[7])]
    rows += [(110 + k, f"{prose[k]} {passage}\t{prose[k + 1]}") for k in range(5)]
    rows += [(120, f"a\n{lines}\nb"), (121, lines), (122, f"{lines}\n{lines}"), (123, "x\n\n\n\n\nx")]
    rows += [(130, " ".join(["same"] * 500)), (131, "ab " * 90), (132, " ".join(draw.choices(words, k=60_000)))]
    return rows
