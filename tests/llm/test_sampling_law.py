"""Sampled segmentations: the law of both samples, inclusion scores, and the round trip of the query."""

import zlib
from collections import Counter

import duckdb
import numpy as np
import pyarrow as pa
import pytest

from footfall.llm import segmentation
from footfall.llm.queries import QUERIES


def test_samples_without_replacement_and_inclusion_scores():
    known = segmentation.lattices(segmentation.vocabulary_path())
    n = 30_000
    rows = segmentation.sample_texts(known, pa.array(["the cat"] * n), np.arange(n, dtype=np.uint64) * np.uint64(7919), 2).to_pylist()
    chance = {tuple(x["ids"]): x["log_prob"] for r in rows for x in r}
    chance = {k: np.exp(p) for k, p in chance.items()}
    first, pairs, weight = Counter(), Counter(), Counter()
    for a, b in rows:
        assert a["ids"] != b["ids"] and a["perturbed"] >= b["perturbed"]
        first[tuple(a["ids"])] += 1
        pairs[tuple(a["ids"]), tuple(b["ids"])] += 1
        for x in (a, b):
            weight[tuple(x["ids"])] += np.exp(-x["log_inclusion"])
    assert sum(chance.values()) == pytest.approx(1, abs=0.02)  # nearly all segmentations were seen
    for k, p in chance.items():
        spread = 5 * np.sqrt(p * (1 - p) / n) + 5 / n
        assert abs(first[k] / n - p) < spread
        if p > 0.02:  # each segmentation counts once on average, by its inclusion score
            assert weight[k] / n == pytest.approx(1, abs=0.15)
    for (a, b), m in pairs.most_common(6):  # the second one is drawn from the rest
        p = chance[a] * chance[b] / (1 - chance[a])
        assert abs(m / n - p) < 5 * np.sqrt(p * (1 - p) / n) + 5 / n


def test_every_sample_of_the_given_documents_decodes_to_its_text(spark):
    folder = "/root/testdata/sf0.001"
    texts = dict(duckdb.sql(f"SELECT doc_id, coalesce(text, '') FROM '{folder}/documents.parquet'").fetchall())
    rows = QUERIES["op1_sampled_segmentations"](spark, folder).collect()
    assert {r["doc_id"] for r in rows} == set(texts)
    assert all(r["text_crc32"] == zlib.crc32(texts[r["doc_id"]].encode()) for r in rows)


def test_odd_ids_and_clashing_columns(spark):
    path = segmentation.vocabulary_path()
    df = spark.createDataFrame([([1, 5, None, 10**6, -3],), ([],), (None,)], "ids array<int>")
    got = [r["text"] for r in segmentation.decode(df, path).collect()]
    assert got[1:] == ["", None] and len(got[0]) <= 8
    docs = spark.createDataFrame([(1, " two  blanks ", 3, "x"), (2, None, 4, "y"), (3, "▁ü﷑\n", 5, "z")], "doc_id int, text string, sample int, ids string")
    found = segmentation.decode(segmentation.sample(docs, path), path, text="back").collect()
    wanted = {1: " two  blanks ", 2: "", 3: "▁ü﷑\n"}
    assert {r["doc_id"] for r in found} == {1, 2, 3} and all(r["back"] == wanted[r["doc_id"]] for r in found)
    assert segmentation.sample(docs.limit(0), path).count() == 0
