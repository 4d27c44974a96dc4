"""The model of the quality rules: bad votes never help, planted accuracies are found, measures equal independent counts."""

import itertools
import re
from collections import Counter
from random import Random

import duckdb
import numpy as np
import pytest

from footfall.llm import quality

EVERY = ["".join(p) for p in itertools.product("-0+", repeat=8)]


def drawn(n, seed, share=0.85, sense=(0.9, 0.8, 0.85), err=0.001):
    """Patterns of five rules: three see bad texts, each by itself, one says "good", one is silent."""
    r = np.random.default_rng(seed)
    good = r.random(n) < share
    votes = np.full((n, 5), "0")
    for rule in range(3):
        votes[r.random(n) < np.where(good, err, sense[rule]), rule] = "-"
    votes[r.random(n) < np.where(good, 0.9, 0.3), 3] = "+"
    return good, ["".join(v) for v in votes]


@pytest.mark.parametrize("seed", range(6))
def test_one_more_bad_vote_never_raises_the_chance_of_good(seed):
    r = Random(seed)
    patterns = Counter(r.choices(EVERY[:: r.choice([1, 7, 50])], k=400)) + Counter({"0+000000": r.choice([10, 5000]), "0+-00000": 300, "0+0-000-": 1})
    chance = dict(zip(EVERY, quality.fit(dict(patterns)).p_good(EVERY), strict=True))
    for k in EVERY:
        for i, v in enumerate(k):
            if v != "-":
                assert chance[k[:i] + "-" + k[i + 1:]] <= chance[k] + 1e-12


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_planted_accuracies_are_recovered(seed):
    good, votes = drawn(40_000, seed)
    model = quality.fit(dict(Counter(votes)))
    bad = model.shares[1:] / model.shares[1:].sum()
    assert model.minus[:3, 1:] @ bad == pytest.approx([0.9, 0.8, 0.85], abs=0.05)
    assert (model.minus[:3, 0] <= 0.002).all() and model.shares[0] == pytest.approx(0.85, abs=0.02)
    assert ((model.p_good(votes) >= 0.5) == good).mean() > 0.98


def test_labelled_bad_texts_with_bad_votes_are_rejected(spark):
    folder = "/root/testdata/sf0.1"
    docs = spark.read.parquet(f"{folder}/documents.parquet").join(spark.read.parquet(f"{folder}/labels.parquet"), "doc_id")
    rows = quality.judge(docs.select("doc_id", "text", "quality"), keep=["doc_id", "quality"]).where("not base_failed").collect()
    assert all(not r["kept"] for r in rows if r["quality"] == 0 and "-" in r["votes"])
    assert sum(r["kept"] for r in rows if r["quality"] == 1) > 0.99 * sum(r["quality"] == 1 for r in rows)


def test_base_measures_of_the_given_documents(spark):
    folder = "/root/testdata/sf0.01"
    texts = dict(duckdb.sql(f"SELECT doc_id, coalesce(text, '') FROM '{folder}/documents.parquet'").fetchall())
    for r in quality.measures(spark.read.parquet(f"{folder}/documents.parquet"), keep=["doc_id"]).collect():
        text = texts[r["doc_id"]]
        words = re.findall(r"[^\x20\x09-\x0D]+", text)
        lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        runs = [tuple(words[i:i + 8]) for i in range(len(words) - 7)]
        often = Counter(runs)
        inside = {j for i, run in enumerate(runs) if often[run] > 1 for j in range(i, i + 8)}
        assert (r["n_words"], r["word_chars"], r["n_repeat_words"]) == (len(words), sum(map(len, words)), len(inside))
        assert r["n_symbols"] == len(re.findall(r"[#*$%&|<>]", text)) and r["n_dup_lines"] == len(lines) - len(set(lines))
