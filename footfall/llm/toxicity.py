"""Toxicity by cumulative-link ordinal regression (operator 2).

Severity grades 0..K are predicted from sparse text features by one weight vector and K ordered thresholds:
P(grade >= k) = logistic(w.x - t_k). The expected severity is the sum of these probabilities over k.

Features are words (letters, lower case) and word beginnings of ``STEMS`` letters; a value is log(1 + count). They are chosen
by their association with toxic labels: beyond chance, or strong for the number of rows, so that small tables have features
too. The model is fitted on at most ``SAMPLE`` labelled rows (those of smallest hashed
id); every document is scored on its whole text.

Defined results: a null or empty text has no features and gets the grade of the thresholds alone; labels that are null, of
unknown ids, or at odds for one id or for equal texts are not used for the fit; of texts that share an id, the fit reads the one
of smallest hash; repeated rows get equal results; without labelled rows of both kinds nothing is toxic; result
columns replace columns of the same names.
"""

from __future__ import annotations

import re
from collections import Counter
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import cut, map_texts, table
from .registry import register

WORD = re.compile(r"[^\W\d_]+")
STEMS = (4, 5)
#: Labelled rows that the model is fitted on, and features that it may have, at most.
SAMPLE, FEATURES = 16_000, 2048
#: Bytes of text that are turned into features at a time for the fit.
FIT_BYTES = 1 << 20
#: Grades above 0 that toxic labels are spread over, and the association from which a feature counts: chi-square, or
#: chi-square for each row, which does not grow with the rows.
LEVELS, ASSOCIATION, STRONG = 3, 50.0, 0.15
RESULTS = [("severity", "double"), ("grade", "int"), ("p_toxic", "double")]


def features(text: str | None) -> Counter:
    words = Counter(WORD.findall(text.lower())) if text else Counter()
    found = Counter(words)
    for word, n in words.items():
        for size in STEMS:
            if len(word) > size:
                found["^" + word[:size]] += n
    return found


def counted(texts: list[str | None]) -> list[pa.Array]:
    """The features of each text with their counts, as flat arrays and not as objects."""
    names, counts, ends = [], [], [0]
    for text in texts:
        found = features(text)
        names.append(pa.array(list(found), pa.string()))
        counts.append(np.fromiter(found.values(), np.int32, len(found)))
        ends.append(ends[-1] + len(found))
    each = pa.StructArray.from_arrays([pa.concat_arrays(names), pa.array(np.concatenate(counts))], ["feature", "n"])
    return [pa.ListArray.from_arrays(pa.array(ends, pa.int32()), each)]


class Model(NamedTuple):
    weights: dict[str, float]
    thresholds: np.ndarray

    def chances(self, found: Counter) -> np.ndarray:
        """P(grade >= k) for k from 1 on."""
        score = sum(self.weights[f] * np.log1p(n) for f, n in found.items() if f in self.weights)
        return 1 / (1 + np.exp(-np.clip(score - self.thresholds, -50, 50)))


def fit(
    rows: list[dict[int, int]], grades: np.ndarray, width: int, levels: int, ridge: float = 0.05, rounds: int = 600,
) -> tuple[np.ndarray, np.ndarray]:
    """Weights and ordered thresholds by accelerated gradient steps on the ridge-penalised mean log likelihood.

    ``rows`` map feature numbers to counts; ``grades`` are 0..levels. Thresholds stay ordered: the first is free, the others
    are sums of exponentials. A grade that no row has keeps a threshold next to its neighbour's.
    """
    at = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
    col = np.array([f for r in rows for f in r], np.int64)
    val = np.log1p(np.array([n for r in rows for n in r.values()], float))
    w, raw = np.zeros(width), np.concatenate([[1.0], np.full(levels - 1, -1.0)])
    steps = [np.zeros(width), np.zeros(width), np.zeros(levels), np.zeros(levels)]
    n = max(1, len(rows))
    upper, lower = np.minimum(grades, levels - 1), np.maximum(grades - 1, 0)
    for i in range(1, rounds + 1):
        t = raw[0] + np.concatenate([[0.0], np.cumsum(np.exp(raw[1:]))])
        score = np.bincount(at, val * w[col], len(rows))
        below = np.where(grades < levels, 1 / (1 + np.exp(np.clip(score - t[upper], -50, 50))), 1.0)  # P(grade <= y)
        under = np.where(grades > 0, 1 / (1 + np.exp(np.clip(score - t[lower], -50, 50))), 0.0)  # P(grade < y)
        p = np.maximum(below - under, 1e-12)
        d_below, d_under = below * (1 - below) / p, under * (1 - under) / p
        g_score = d_below - d_under  # of -log p
        g_w = np.bincount(col, val * g_score[at], width) / n + ridge * w / n
        g_t = (np.bincount(upper, -d_below * (grades < levels), levels) + np.bincount(lower, d_under * (grades > 0), levels)) / n
        g_raw = np.concatenate([[g_t.sum()], np.exp(raw[1:]) * np.cumsum(g_t[::-1])[::-1][1:] + 1e-3 * (raw[1:] + 1)])
        for x, g, m, v in ((w, g_w, steps[0], steps[1]), (raw, g_raw, steps[2], steps[3])):
            m += 0.1 * (g - m)
            v += 0.01 * (g * g - v)
            x -= 0.1 * min(1.0, 2 - 2 * i / rounds) * (m / (1 - 0.9**i)) / (np.sqrt(v / (1 - 0.99**i)) + 1e-8)
    return w, raw[0] + np.concatenate([[0.0], np.cumsum(np.exp(raw[1:]))])


def severity_grades(toxic: np.ndarray, amount: np.ndarray, levels: int = LEVELS) -> np.ndarray:
    """Ordered grades from 0/1 labels: 0 is not toxic; toxic rows are spread over 1..levels by how much they hold of it."""
    marks = np.quantile(amount[toxic], np.arange(1, levels) / levels) if toxic.any() else np.zeros(0)
    return np.where(toxic, 1 + np.searchsorted(marks, amount, side="left"), 0)


def train(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", sample: int = SAMPLE) -> Model:
    """``labels``: ``key`` and ``toxic`` (0 or 1). At most ``sample`` rows with at most ``FEATURES`` features reach the driver."""
    sure = labels.where(F.col("toxic").isin(0, 1)).groupBy(F.col(key).alias("id")).agg(
        F.min("toxic").alias("toxic"), F.max("toxic").alias("__other")).where("toxic = __other")
    chosen = sure.select("id", "toxic").orderBy(F.xxhash64("id"), "id").limit(sample)
    rows = docs.select(F.col(f"`{key}`").alias("id"), F.col(f"`{text}`").cast("string").alias("text"))
    one = F.min(F.struct(F.xxhash64("text").alias("h"), "text"))["text"]
    rows = rows.join(F.broadcast(chosen), "id").groupBy("id", "toxic").agg(one.alias("text"))  # at most ``sample`` ids
    # Copies would make their rare words look telling.
    rows = rows.groupBy(F.sha2(F.coalesce("text", F.lit("")), 256).alias("__copy")).agg(
        F.min("id").alias("id"), F.min("toxic").alias("toxic"), F.max("toxic").alias("__other"), F.min("text").alias("text"))
    rows = rows.where("toxic = __other").select("id", "toxic", "text")
    kind = T.ArrayType(T.StructType([T.StructField("feature", T.StringType()), T.StructField("n", T.IntegerType())]))
    rows = cut(map_texts(rows, lambda: counted, [T.StructField("features", kind)], "text", ["id", "toxic"], most=FIT_BYTES))
    counts = {r["toxic"]: r["count"] for r in rows.groupBy("toxic").count().collect()}
    bad, good = counts.get(1, 0), counts.get(0, 0)
    if not bad or not good:
        return Model({}, np.full(LEVELS, 50.0))
    each = rows.select("toxic", F.inline("features")).groupBy("feature").agg(
        F.sum("toxic").cast("double").alias("a"), F.count(F.lit(1)).cast("double").alias("n"))
    total = float(bad + good)
    gap = F.col("a") * total - F.col("n") * bad
    score = gap * F.abs(gap) * total / (F.col("n") * (total - F.col("n") + 1.0) * float(bad) * float(good))
    support = min(5, max(min(2, bad), bad / 4))  # toxic rows that a feature is in
    best = (
        each.where(F.col("a") >= support).withColumn("score", score)
        .where((F.col("score") > ASSOCIATION) | (F.col("score") >= STRONG * total))
        .orderBy(F.desc("score"), "feature").limit(FEATURES).collect())
    number = {r["feature"]: i for i, r in enumerate(best)}
    known = rows.sparkSession.createDataFrame(list(number.items()), "feature string, f int") if number else None
    if known is None:
        return Model({}, np.full(LEVELS, 50.0))
    found = (
        rows.select("id", "toxic", F.inline("features")).join(F.broadcast(known), "feature")
        .groupBy("id").agg(F.collect_list(F.struct("f", "n")).alias("found")))
    local = rows.select("id", "toxic").join(found, "id", "left").collect()
    local.sort(key=lambda r: r["id"])
    sparse = [{x["f"]: x["n"] for x in sorted(r["found"] or [])} for r in local]
    toxic = np.array([r["toxic"] == 1 for r in local])
    amount = np.array([sum(np.log1p(n) for n in r.values()) for r in sparse])
    w, t = fit(sparse, severity_grades(toxic, amount), len(number), LEVELS)
    return Model({f: float(w[i]) for f, i in number.items()}, t)


def score(df: DataFrame, model: Model, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Adds ``severity`` (expected grade), ``grade`` (most probable) and ``p_toxic``, P(grade >= 1)."""
    stems = {f[1:] for f in model.weights if f[0] == "^"}

    def relevant(value: str | None) -> Counter:
        words = WORD.findall(value.lower()) if value else ()
        found: Counter = Counter()
        for word in words:
            if word in model.weights:
                found[word] += 1
            for size in STEMS:
                if word[:size] in stems and len(word) > size:
                    found["^" + word[:size]] += 1
        return found

    def work(texts):
        out = []
        for value in texts:
            p = model.chances(relevant(value))
            grades = -np.diff(np.concatenate([[1.0], p, [0.0]]))
            out.append((float(p.sum()), int(grades.argmax()), float(p[0])))
        return [pa.array(c) if i != 1 else pa.array(c, pa.int32()) for i, c in enumerate(zip(*out))]

    fields = [T.StructField(n, T._parse_datatype_string(k)) for n, k in RESULTS]
    return map_texts(df, lambda: work, fields, text, keep)


#: Documents are rejected from this chance of being toxic at all.
REJECT = 0.5


@register("op2_toxicity")
def op2_toxicity(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    model = train(docs, table(spark, sf_dir, "labels"))
    scored = score(docs, model, keep=["doc_id"])
    return scored.select(
        "doc_id", F.col("severity").alias("expected_severity"), "grade", "p_toxic",
        (F.col("p_toxic") >= REJECT).alias("toxic"), (F.col("p_toxic") < REJECT).alias("kept"))
