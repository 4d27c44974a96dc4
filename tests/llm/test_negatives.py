"""Hard negatives against scoring every pair in plain Python and SQL."""

import math
from random import Random

import duckdb
import pytest

from footfall.llm import negatives

SCHEMA = "vec_id long, embedding array<float>, label int"
COLUMNS = ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]


def brute(rows):
    clean = []
    for i, v, label in rows:
        if label is None or not v or any(x is None or math.isnan(x) or math.isinf(x) for x in v):
            continue
        clean.append((i, [math.floor(256 * x) for x in v], (label + 1) % 10 if i is not None and i % 7 == 0 else label))
    big = 1 << 62
    key = lambda r: (-r[0], big if r[1] is None else r[1])
    out = []
    for a, (i, v, label) in enumerate(clean):
        if i is None or i % 100:
            continue
        scored = [(sum(map(int.__mul__, v, w)), j, other) for b, (j, w, other) in enumerate(clean) if b != a]
        positives = sorted((r for r in scored if r[2] == label), key=key)[:5]
        others = sorted((r for r in scored if r[2] != label), key=key)
        for p, pid, _ in positives:
            inside = [r for r in others if 80 * p <= 100 * r[0] <= 100 * p][:5]
            out += [(i, pid, k, j, p, s) for k, (s, j, _) in enumerate(inside, 1)]
    return sorted(out, key=str)


def result(df):
    return sorted((tuple(r) for r in negatives.hard_negatives(df).select(COLUMNS).collect()), key=str)


def vectors(seed, n=900, size=20, labels=3):
    rng = Random(seed)
    centres = [[rng.gauss(0, 1) for _ in range(size)] for _ in range(6)]
    out = []
    for i in range(n):
        c = rng.choice(centres)
        v = [x + rng.gauss(0, 0.6) for x in c]
        norm = math.sqrt(sum(x * x for x in v))
        out.append((i, [x / norm for x in v], rng.randrange(labels)))
    return out


def as_stored(rows):
    import numpy as np

    return [(i, None if v is None else [None if x is None else float(np.float32(x)) for x in v], label) for i, v, label in rows]


@pytest.mark.parametrize("seed", [1, 2])
def test_equals_scoring_all_pairs(spark, seed):
    rows = as_stored(vectors(seed, labels=2 + 6 * seed))
    assert result(spark.createDataFrame(rows, SCHEMA).repartition(5)) == brute(rows)


def test_odd_rows(spark):
    rows = as_stored(vectors(3, 420))
    rows += [(500, None, 1), (600, [], 1), (700, [0.0] * 20, 1), (701, [math.nan] + [0.1] * 19, 1), (800, [math.inf] + [0.1] * 19, 2),
             (900, [None] + [0.1] * 19, 2), (1000, rows[5][1], None), (1100, rows[6][1], 0), (None, rows[6][1], 1), (1200, rows[6][1], 2)]
    rows += [(2000 + i, rows[100][1], 1) for i in range(60)] + [(3000 + i, rows[100][1], 2) for i in range(60)]  # copies and ties
    rows = as_stored(rows)
    assert result(spark.createDataFrame(rows, SCHEMA)) == brute(rows)


def test_few_rows_lone_anchors_and_empty(spark):
    for rows in ([], [(100, [0.5, 0.5], 1)], [(100, [0.5, 0.5], 1), (101, [0.5, 0.5], 1)],
                 [(100, [0.5, 0.5], 1), (101, [0.5, 0.4], 1), (102, [0.5, 0.35], 2), (103, [-0.5, -0.5], 2)]):
        assert result(spark.createDataFrame(rows, SCHEMA)) == brute(rows)


def test_extra_columns(spark):
    rows = as_stored(vectors(4, 150))
    df = spark.createDataFrame([(*r, 1, 2, 3) for r in rows], SCHEMA + ", score long, anchor long, a long")
    assert result(df) == brute(rows)


def test_index_leaves_out_dimensions_and_loses_nothing():
    import numpy as np

    rng = np.random.default_rng(5)
    rows = np.floor(256 * rng.standard_normal((300, 32)) * np.linspace(1, 0.05, 32)).astype(np.int64)
    anchors = rows[:20]
    scores = anchors @ rows.T
    least = np.sort(scores, axis=1)[:, -6].astype(float)
    for i, at, score in negatives.threshold_join(anchors, least, rows):
        wanted = np.flatnonzero(scores[i] >= least[i])
        assert sorted(at) == wanted.tolist() and sorted(score) == sorted(scores[i][wanted])


def test_given_vectors_equal_sql(spark):
    folder = "/root/testdata/sf0.001"
    rows = duckdb.sql(f"SELECT vec_id, embedding, label FROM '{folder}/embeddings.parquet'").fetchall()
    assert result(spark.read.parquet(f"{folder}/embeddings.parquet")) == brute(rows)
