"""Toxicity fitted on few labelled rows."""

import random

import pytest

from footfall.llm import toxicity

CLEAN = [f"{a}{b}" for a in ("river", "stone", "cloud", "garden", "window") for b in ("side", "light", "path", "song")]


def rows(n, n_toxic):
    r = random.Random(n)
    texts = [" ".join(r.choice(CLEAN) for _ in range(40)) for _ in range(n)]
    return [(i, t + " you vile moron" if i < n_toxic else t) for i, t in enumerate(texts)]


@pytest.mark.parametrize("n, n_toxic", [(90, 11), (40, 5), (20, 4)])
def test_few_labelled_rows_give_a_model(spark, n, n_toxic):
    known = rows(n, n_toxic)
    unseen = [(1000, " ".join(CLEAN) + " vile moron you"), (1001, " ".join(CLEAN))]
    frame = spark.createDataFrame(known + unseen, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i < n_toxic)) for i in range(n)], "doc_id long, toxic int")
    got = {r.doc_id: r.p_toxic >= 0.5 for r in toxicity.score(frame, toxicity.train(frame, labels)).collect()}
    assert all(got[i] == (i < n_toxic) for i in range(n)) and got[1000] and not got[1001]
