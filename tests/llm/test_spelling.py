"""Spelling variants against counting and comparing every pair in plain Python."""

import re
from collections import Counter
from random import Random
from zlib import crc32

import pytest

from footfall.llm import spelling

SCHEMA = "doc_id long, text string, n long"


def one_edit(a, b):
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    if len(a) > len(b):
        a, b = b, a
    i = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), len(a))
    return a[i + (len(a) == len(b)):] == b[i + 1:]


def brute(rows):
    counts = Counter()
    for doc, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = crc32(f"{'' if doc is None else doc}:{run}".encode())
            if h % 31 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1:]
            counts[run] += 1
    words = {w: n for w, n in counts.items() if len(w) >= 7 and n >= 2}
    near = {w: [v for v in words if one_edit(w, v)] for w in words}
    form = {}
    for w, n in words.items():
        best = min(near[w], key=lambda v: (-words[v], v), default=None)
        form[w] = best if best is not None and words[best] >= 10 * n else None
    out = set()
    for w, n in words.items():
        root = w
        while form[root]:
            root = form[root]
        out.add((w, form[w], root, n, len(near[w]), words.get(form[w])))
    return out


def result(docs):
    found = spelling.spelling_variants(spelling.spoken(docs))
    rows = found.select("word", "form", "root", "n", "n_near", "form_n").collect()
    assert len(rows) == len({r["word"] for r in rows})
    return {tuple(r) for r in rows}


def edited(word, rng):
    i, c = rng.randrange(len(word)), rng.choice("abcdeÀéÿ×")
    return rng.choice([word[:i] + word[i + 1:], word[:i] + c + word[i:], word[:i] + c + word[i + 1:], word + c])


@pytest.mark.parametrize("seed", [1, 2])
def test_equals_comparing_all_pairs(spark, seed):
    rng = Random(seed)
    base = ["".join(rng.choice("abcé") for _ in range(rng.randint(6, 11))) for _ in range(60)]
    vocabulary = base + [edited(w, rng) for w in base for _ in range(4)]
    weights = [rng.choice([1, 3, 40, 900]) for _ in vocabulary]
    texts = [" ".join(w.upper() if rng.random() < 0.2 else w for w in rng.choices(vocabulary, weights, k=rng.randint(0, 300)))
             for _ in range(120)]
    rows = [(i if i % 9 else None, t) for i, t in enumerate(texts)] + [(5, None), (6, ""), (7, texts[7]), (7, texts[7])]
    docs = spark.createDataFrame([(i, t, 1) for i, t in rows], SCHEMA).repartition(4)
    assert result(docs) == brute(rows)


def test_forms_chain_to_the_root_and_ties_take_the_smallest(spark):
    rows = [(100 + i, w) for w, n in [("leftist", 3000), ("leftisx", 200), ("leftiyx", 10), ("legtist", 200), ("oftenly", 9)] for i in range(n)]
    found = result(spark.createDataFrame([(i, t, 1) for i, t in rows], SCHEMA))
    assert found == brute(rows)
    roots = {w: (f, r) for w, f, r, *_ in found}
    assert roots["leftiyx"][1] == "leftist" and roots["oftenly"] == (None, "oftenly")


def test_anagrams_are_no_variants_and_very_long_words_are_words(spark):
    long = "abcdefgh" * 20_000
    rows = [(1, f"abcdefg gfedcba {long} {long}x"), (2, f"abcdefg gfedcba {long} {long}x")]
    found = result(spark.createDataFrame([(i, t, 1) for i, t in rows], SCHEMA))
    assert found == brute(rows)


def test_empty_table_and_other_columns(spark):
    assert result(spark.createDataFrame([], SCHEMA)) == set()
    docs = spark.createDataFrame([(1, "variants variants", "x", 3)], "doc_id long, text string, word string, N long")
    assert result(docs) == brute([(1, "variants variants")])


def test_near_words_share_a_signature():
    """The guarantee behind the join, on random words and edits."""
    import numpy as np

    rng = Random(3)
    codes = lambda w: np.frombuffer(w.encode("utf-32-le"), np.uint32).reshape(1, -1).astype(np.uint64)
    for _ in range(400):
        word = "".join(rng.choice("abcdé") for _ in range(rng.randint(7, 14)))
        other = edited(word, rng)
        if not one_edit(word, other):
            continue
        short, long = sorted((word, other), key=len)
        one, two = spelling.signatures(codes(short))[0], spelling.signatures(codes(long))[0]
        half = len(one) // 2
        assert set(one[:half]) & set(two[half:] if len(short) < len(long) else two[:half])
