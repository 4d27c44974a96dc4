"""Near-duplicates among rows whose ids are null or repeat."""

import random

import corpus_pipeline
from footfall.llm import near_texts


def prose(seed):
    r = random.Random(seed)
    return [f"w{r.randrange(10**6)}" for _ in range(60)]


def near(words):
    return " ".join([*words[:30], "changed", *words[31:]])


def kept_texts(spark, rows):
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    return sorted((r.doc_id is None, r.doc_id, r.text or "") for r in corpus_pipeline.drop_near_duplicates(spark, docs, "").collect())


def test_null_and_repeated_ids(spark):
    w = [prose(i) for i in range(12)]
    full = [" ".join(x) for x in w]
    stay = [(None, full[0]), (None, None), (None, ""), (1, full[2]), (2, full[3]), (2, full[4]), (2, None), (3, full[5]),
            (6, full[7]), (6, full[8])]
    go = [(None, near(w[2])), (4, near(w[3])), (5, near(w[4])), (None, full[5]), (None, full[0]), (3, full[5]), (7, near(w[8]))]
    got = kept_texts(spark, stay + go)
    assert got == sorted((i is None, i, t or "") for i, t in stay)
    pair = [(None, full[9]), (None, near(w[9])), (8, full[10]), (8, near(w[10]))]  # one of each two
    assert [(i, t in (full[9], near(w[9]))) for _, i, t in kept_texts(spark, pair)] == [(8, False), (None, True)]


def test_components_of_repeated_ids(spark):
    w = prose(50), prose(51)
    rows = [(2, " ".join(w[0])), (2, " ".join(w[1])), (5, near(w[0])), (1, near(w[1])), (None, "few words")]
    got = near_texts.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r.doc_id or 0, r.component_id or 0, r.kept) for r in got) == [
        (0, 0, True), (1, 1, True), (2, 1, False), (2, 2, True), (5, 2, False)]
