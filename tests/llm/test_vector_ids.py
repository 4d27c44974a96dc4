"""Vector near-duplicates with repeated and null ids, and recall against all pairs."""

import math
from collections import Counter

import duckdb
import numpy as np

from footfall.llm import vectors

SCHEMA = "vec_id long, embedding array<double>, label int"


def brute(rows):
    """(id, links, component, kept) of each row, by comparing all pairs."""
    ok = [v is not None and label is not None and len(v) > 0 and any(v) and all(x is not None and math.isfinite(x) for x in v) for _, v, label in rows]
    near = [set() for _ in rows]
    for i, (_, v, a) in enumerate(rows):
        for j, (_, w, b) in enumerate(rows[:i]):
            if ok[i] and ok[j] and a == b and len(v) == len(w):
                if np.dot(v, w) / (np.linalg.norm(v) * np.linalg.norm(w)) >= 0.98:
                    near[i].add(j)
                    near[j].add(i)
    out = []
    for i, (key, *_) in enumerate(rows):
        seen, todo = {i}, [i]
        while todo:
            new = near[todo.pop()] - seen
            seen |= new
            todo += new
        least = min((rows[j][0] for j in seen if rows[j][0] is not None), default=None)
        out.append((key, len(near[i]), least, key == least))
    return Counter(out)


def result(df):
    return Counter((r["vec_id"], r["n_links"], r["component_id"], r["kept"]) for r in vectors.near_vectors(df).collect())


def test_repeated_and_null_ids(spark):
    rng = np.random.default_rng(1)
    a, b, c, d = np.linalg.qr(rng.normal(size=(8, 4)))[0].T
    near = lambda v: (v + rng.normal(size=8) * 0.01).tolist()
    rows = [(5, a.tolist(), 1), (5, b.tolist(), 1), (2, near(a), 1), (3, near(b), 1), (None, near(c), 1), (None, near(c), 1), (None, d.tolist(), 1),
            (None, near(a), 1), (7, None, 1), (8, [0.0] * 8, 1), (9, [1.0, None], 1), (10, [math.nan] * 8, 1), (11, a.tolist(), None), (12, [], 1),
            (13, near(a), 2), (14, near(a), 2), (14, near(a), 2), (15, a.tolist()[:4], 1), (None, None, None), (5, a.tolist(), 1)]
    assert result(spark.createDataFrame(rows, SCHEMA)) == brute(rows)
    assert result(spark.createDataFrame([], SCHEMA)) == Counter()
    more = spark.createDataFrame([(*r, 1, "x") for r in rows], SCHEMA + ", n_links int, class string")
    assert result(more) == brute(rows)


def test_given_vectors_equal_all_pairs(spark):
    folder = "/root/testdata/sf0.01"
    rows = duckdb.sql(f"SELECT vec_id, embedding, label FROM '{folder}/embeddings.parquet'").fetchall()
    rows += [(10_000 + i, (np.array(v) + np.random.default_rng(i).normal(size=len(v)) * s).astype(np.float32).astype(float).tolist(), label)
             for i, (_, v, label) in enumerate(rows[:200]) for s in (0.01, 0.02)]
    assert result(spark.createDataFrame(rows, SCHEMA).repartition(4)) == brute(rows)
