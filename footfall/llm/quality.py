"""Quality rules by weak supervision (operator 10).

Rules vote "good", "bad" or abstain on each text. Expectation-maximisation over the counts of vote patterns estimates how
each rule votes on good texts and on the kinds of bad ones, and the posterior probability of "good" decides, instead of all
rules together. One more bad vote never raises it.

Defined results: a null text has no words; a text without words or with fewer than ``MIN_WORDS`` fails the base rules and is
not kept; repeated rows and ties are treated like any other rows; an empty table gives an empty result.
"""

from __future__ import annotations

import re
from typing import NamedTuple

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import cut, map_texts
from .registry import register

MIN_WORDS = 20
WINDOW = 8
#: Share of good texts on which a rule votes "bad", at most: without a bound, one class could explain all votes.
ERRS = 0.002
SYMBOLS = "#*$%&|<>"
SPACES = " \t\n\x0b\x0c\r"
UPPER = re.compile(r"[A-ZÀ-ÖØ-Þ]")

MEASURES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_marks",
            "n_distinct"]


def repeated_words(words: list[bytes], window: int = WINDOW) -> int:
    """Words that lie in a window of eight words that the text holds twice or more. Exact: windows are numbered, not hashed."""
    n = len(words) - window + 1
    if n < 2:
        return 0
    numbers: dict[bytes, int] = {}
    ids = np.fromiter((numbers.setdefault(w, len(numbers)) for w in words), np.int64, len(words))
    step = 1
    while step < window:  # numbers of runs of 2, 4 and 8 words
        pairs = ids[:-step] * len(words) + ids[step:]
        found, ids = np.unique(pairs, return_inverse=True)
        if len(found) == len(pairs):
            return 0
        step *= 2
    starts = np.flatnonzero(np.bincount(ids)[ids] >= 2)
    edges = np.zeros(len(words) + 1, np.int64)
    np.add.at(edges, starts, 1)
    np.add.at(edges, starts + window, -1)
    return int((np.cumsum(edges[:-1]) > 0).sum())


def measure(text: str | None) -> tuple[int, ...]:
    text = text or ""
    words = text.encode().split()  # splits at \x20 and \x09-\x0D exactly
    seen: set[str] = set()
    duplicates = lines = 0
    for line in text.split("\n"):
        if line.strip(SPACES):
            lines += 1
            duplicates += line in seen
            seen.add(line)
    return (
        len(words), len(text) - sum(map(text.count, SPACES)), sum(map(text.count, SYMBOLS)), duplicates,
        repeated_words(words), lines, len(UPPER.findall(text)), text.count("!") + text.count("?"), len(set(words)),
    )


def measures(df: DataFrame, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Adds the counts that the rules look at, as long."""
    def work(texts: list[str | None]) -> list[list[int]]:
        return [list(c) for c in zip(*map(measure, texts))]

    return map_texts(df, lambda: work, [T.StructField(c, T.LongType()) for c in MEASURES], text, keep)


def _vote(bad: Column, good: Column | None = None) -> Column:
    chosen = F.when(bad, "-")
    return (chosen if good is None else chosen.when(good, "+")).otherwise("0")


def votes() -> Column:
    """One character a rule: ``+`` good, ``-`` bad, ``0`` abstains.

    Each rule knows one defect, and a text without that defect may have another, so most rules abstain where they find none.
    """
    c, n = F.col, F.greatest(F.col("n_words"), F.lit(1))
    return F.concat(
        _vote(c("n_words") < MIN_WORDS),
        _vote((c("word_chars") < 2 * n) | (c("word_chars") > 16 * n), (c("word_chars") >= 3 * n) & (c("word_chars") <= 12 * n)),
        _vote(c("n_symbols") * 10 > n),
        _vote((c("n_lines") >= 4) & (c("n_dup_lines") * 10 > 3 * c("n_lines"))),
        _vote(c("n_repeat_words") * 10 > 3 * n),
        _vote(c("n_upper") * 2 > c("word_chars")),
        _vote(c("n_marks") * 4 > n),
        _vote((c("n_words") >= 50) & (c("n_distinct") * 5 < n)),
    )


class Model(NamedTuple):
    """Chances of votes in each class: good texts, then one kind of bad text for each rule that has voted "bad" somewhere.

    ``minus`` (rules, classes) is the chance of "bad", ``plus`` that of "good" where the vote is not "bad".
    """

    shares: np.ndarray
    minus: np.ndarray
    plus: np.ndarray

    def classes(self, seen: np.ndarray) -> np.ndarray:
        """Posterior of each class (columns) for patterns of votes 0 (bad), 1 (abstains), 2 (good)."""
        logs = np.log(np.stack([self.minus, (1 - self.minus) * (1 - self.plus), (1 - self.minus) * self.plus], axis=1))
        score = np.log(self.shares) + sum(logs[rule][seen[:, rule]] for rule in range(seen.shape[1]))
        score = np.exp(score - score.max(axis=1, keepdims=True))
        return score / score.sum(axis=1, keepdims=True)

    def p_good(self, patterns: list[str]) -> np.ndarray:
        return self.classes(numbers(patterns))[:, 0]


def numbers(patterns: list[str]) -> np.ndarray:
    return np.array([["-0+".index(v) for v in k] for k in patterns])


def fit(patterns: dict[str, int], rounds: int = 300, prior: float = 0.1) -> Model:
    """Expectation-maximisation over vote patterns and their counts, for all texts at once.

    Texts are bad in different ways, and a rule sees one of them, so each rule has a kind of bad text of its own: in a single
    bad class the defect that is most frequent would make all others look good. Rules vote "bad" only where they are
    sure, so it starts from the number of bad votes and on good texts a rule errs in ``ERRS`` of the cases at most. On
    no kind of bad text is "bad" less likely against the other votes than on good ones, so another bad vote can never raise
    the chance of "good". ``prior`` texts are added to each count.
    """
    keys = sorted(patterns)
    if not keys:
        return Model(np.ones(1), np.zeros((0, 1)), np.zeros((0, 1)))
    seen, weight = numbers(keys), np.array([patterns[k] for k in keys], float)
    bad = seen == 0
    kinds = np.flatnonzero(bad.any(axis=0))
    rules = seen.shape[1]
    good = np.choose(np.minimum(bad.sum(axis=1), 2), [0.99, 0.1, 0.02])
    parts = np.where(bad.any(axis=1)[:, None], bad, True)[:, kinds].astype(float)
    parts /= np.maximum(parts.sum(axis=1, keepdims=True), 1.0)
    found = np.column_stack([good, (1 - good)[:, None] * parts])
    own = np.zeros((rules, 1 + len(kinds)))
    own[kinds, 1 + np.arange(len(kinds))] = 1.0
    usual = (weight @ bad) / weight.sum()
    usual_plus = (weight @ (seen == 2) + prior) / (weight @ ~bad + 2 * prior)
    for _ in range(rounds):
        mass = weight[:, None] * found
        total = mass.sum(axis=0)
        minus = (bad.T @ mass + prior * np.where(own > 0, 0.9, usual[:, None])) / (total + prior)
        plus = ((seen == 2).T @ mass + prior * usual_plus[:, None]) / ((~bad).T @ mass + prior)
        minus = np.clip(minus, 1e-6, 1 - 1e-6)
        plus = np.clip(plus, 1e-6, 1 - 1e-6)
        minus[:, 0] = np.minimum(minus[:, 0], ERRS)
        plus[:, 1:] = np.minimum(plus[:, 1:], plus[:, :1])  # "good" is no likelier on bad texts
        least = minus[:, :1] / (1 - minus[:, :1]) * (1 - plus) / (1 - plus[:, :1])
        minus[:, 1:] = np.maximum(minus, least / (1 + least))[:, 1:]
        model = Model((total + prior) / (total + prior).sum(), minus, plus)
        before, found = found, model.classes(seen)
        if np.abs(before - found).max() < 1e-9:
            break
    return model


def judge(df: DataFrame, text: str = "text", keep: list[str] | None = None, threshold: float = 0.5) -> DataFrame:
    """Adds the measures, the votes, the posterior probability ``p_good``, ``base_failed`` and ``kept``.

    The model is fitted to all texts that pass the base rules. The measures are written once; at most 3^8 vote patterns with their counts reach the driver.
    """
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    rows = cut(measures(df, text, keep).withColumns({"votes": votes(), "base_failed": failed}))
    counts = rows.groupBy("votes").agg(F.count_if(~F.col("base_failed")).alias("n")).collect()
    model = fit({r["votes"]: r["n"] for r in counts if r["n"]})
    keys = sorted(r["votes"] for r in counts)
    chance = model.p_good(keys).tolist() if len(model.minus) else [0.0] * len(keys)
    known = df.sparkSession.createDataFrame(list(zip(keys, chance)), "votes string, p_good double")
    return (
        rows.join(F.broadcast(known), "votes", "left")  # at most 3^8 rows
        .withColumn("kept", ~F.col("base_failed") & (F.col("p_good") >= threshold))
    )


@register("op10_quality_rules")
def op10_quality_rules(spark, sf_dir):
    from .common import table

    return judge(table(spark, sf_dir, "documents"), keep=["doc_id"]).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "p_good",
        "votes",
    )
