"""Spelling variant grouping (operator 13): PartEnum signatures of letter multisets, equi-joined and verified.

A word's letters with their occurrence numbers (a1, a2, b1, ...) are a binary vector. One inserted, deleted or replaced code
point changes at most ``DISTANCE`` = 2 of its entries. The entries are dealt into ``PARTS`` = 4 parts; two changes leave two
parts equal at least, so every near pair shares one of the six signatures that enumerate two parts. A signature also holds
the length of the shorter word and one half of the word, as a single edit leaves the letters before or behind the middle
alone. Pairs that share a signature are verified by edit distance, and each is counted once.

Words are counted in one pass over the whole texts; the form of a word is its most frequent near word if that is at least
``RATIO`` times as frequent. Counts grow tenfold along forms, so the path to a root is short; it is followed by doubling.

Defined results: null and empty texts have no words; a null id counts as an empty string in the checksum; repeated rows count
again; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from itertools import combinations
from zlib import crc32

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, slices, table
from .registry import register

#: Code points and occurrences that a word has at least; how much more frequent a form is; one checksum in so many drops a letter.
LETTERS, OCCURRENCES, RATIO, EVERY = 7, 2, 10, 31
PARTS, DISTANCE = 4, 2


def spoken(docs: DataFrame, key: str = "doc_id", text: str = "text", letters: int = LETTERS, every: int = EVERY) -> DataFrame:
    """``word`` and ``n``: counts of the letter runs of the whole texts, several rows a word.

    A-Z are in lower case; where ``every`` divides the checksum of id and run, the run has lost one code point. Only words of
    ``letters`` code points are counted, so shorter runs are passed over. A text is counted by itself, then added to its slice.
    """
    source = docs.select(F.col(f"`{key}`").cast("string").alias("id"), F.col(f"`{text}`").cast("string").alias("text"))
    source = source.where("text is not null")

    def count(ids: list[str | None], texts: list[str]) -> Counter:
        found: Counter = Counter()
        for id_, value in zip(ids, texts, strict=True):
            low = value.encode("utf-8", "surrogatepass").lower().decode("utf-8", "surrogatepass")  # bytes: A-Z only
            start = crc32(f"{id_ or ''}:".encode())
            for run, n in Counter(re.findall(rf"[a-z\u00c0-\u00ff]{{{letters},}}", low)).items():
                checksum = crc32(run.encode(), start)
                if checksum % every == 0:
                    at = checksum % len(run)
                    run = run[:at] + run[at + 1:]
                    if len(run) < letters:
                        continue
                found[run] += n
        return found

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts = batch.columns
            for a, b in slices(pc.binary_length(texts).to_pylist()):
                found = count(ids.slice(a, b - a).to_pylist(), texts.slice(a, b - a).to_pylist())
                yield pa.RecordBatch.from_arrays(
                    [pa.array(list(found), pa.string()), pa.array(list(found.values()), pa.int64())], names=["word", "n"])

    return source.mapInArrow(work, "word string, n long")


def vocabulary(words: DataFrame, letters: int = LETTERS, occurrences: int = OCCURRENCES) -> DataFrame:
    """``word`` and its count ``n``, of those long and frequent enough."""
    long = words.where(F.length("word") >= letters)
    return long.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= occurrences)


def _mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: equal inputs stay equal, others spread."""
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0x9E3779B97F4A7C15)
    x = x ^ (x >> np.uint64(29))
    return x * np.uint64(0xD6E8FEB86659FD93)


def _folded(codes: np.ndarray, salt: int) -> np.ndarray:
    """One number for each row of code points, in order."""
    out = np.full(len(codes), salt, np.uint64)
    for column in codes.T:
        out = _mixed(out + column)
    return out


def signatures(codes: np.ndarray, parts: int = PARTS, distance: int = DISTANCE) -> np.ndarray:
    """The signatures of words of one length (rows of code points): columns for own length, then for one letter less.

    Two words of equal length that are near share one of the first columns; a word and a near one that is a letter longer
    share one of its first and one of the other's last columns.
    """
    n, size = codes.shape
    letters = np.sort(codes, axis=1)
    fresh = np.ones((n, size), bool)
    fresh[:, 1:] = letters[:, 1:] != letters[:, :-1]
    place = np.arange(size)
    start = np.maximum.accumulate(np.where(fresh, place, 0), axis=1)
    entry = _mixed(letters * np.uint64(1 << 24) + (place - start).astype(np.uint64))
    part = (entry >> np.uint64(40)) % np.uint64(parts)
    sums = np.stack([np.where(part == p, entry, np.uint64(0)).sum(axis=1, dtype=np.uint64) for p in range(parts)], axis=1)
    chosen = [(i, _folded(sums[:, list(c)], 1 + i)) for i, c in enumerate(combinations(range(parts), parts - distance))]
    out = []
    for length in (size, size - 1):
        half = length // 2
        for side, letters_there in enumerate((codes[:, :half], codes[:, size - (length - half):])):
            there = _folded(letters_there, 1000 * length + side)
            out += [_mixed(there + s) for _, s in chosen]
    return np.stack(out, axis=1).view(np.int64)


def _signed(batches: Iterator[pa.RecordBatch], longer: bool) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        words, counts = batch.column(0), batch.column(1)
        sizes = pc.utf8_length(words).to_numpy()
        for size in np.unique(sizes):
            at = np.flatnonzero(sizes == size)
            for some in np.array_split(at, max(1, at.size * int(size) // 2_000_000)):  # few letters at a time
                chosen, n = words.take(pa.array(some)), counts.take(pa.array(some))
                codes = np.frombuffer("".join(chosen.to_pylist()).encode("utf-32-le"), np.uint32).reshape(-1, size)
                keys = signatures(codes.astype(np.uint64))
                keys = keys if longer else keys[:, :keys.shape[1] // 2]
                each = pa.array(np.repeat(np.arange(len(chosen)), keys.shape[1]))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.ascontiguousarray(keys).ravel()), chosen.take(each), n.take(each)], names=["sig", "word", "n"])


def near_pairs(words: DataFrame) -> DataFrame:
    """Each pair of near words once: ``a``, ``n_a``, ``b``, ``n_b``. ``words`` has distinct ``word`` and ``n``."""
    schema = "sig long, word string, n long"
    rows = words.select("word", "n")
    left = rows.mapInArrow(lambda b: _signed(b, False), schema).select("sig", F.col("word").alias("a"), F.col("n").alias("n_a"))
    right = rows.mapInArrow(lambda b: _signed(b, True), schema).select("sig", F.col("word").alias("b"), F.col("n").alias("n_b"))
    size = F.length("b") - F.length("a")
    once = (size == 1) | (size == 0) & (F.col("a") < F.col("b"))
    return (
        left.join(right, "sig").where(once & (F.levenshtein("a", "b", 1) == 1))
        .select("a", "n_a", "b", "n_b").distinct())


def forms(words: DataFrame, pairs: DataFrame, ratio: int = RATIO) -> DataFrame:
    """``word``, ``n``, ``n_near``, and ``form`` with its count ``form_n`` where a near word is frequent enough."""
    both = pairs.select(F.col("a").alias("word"), F.col("b").alias("near"), F.col("n_b").alias("n")).union(
        pairs.select("b", "a", "n_a"))
    first = F.min(F.struct((-F.col("n")).alias("m"), "near"))  # most frequent, then smallest
    best = both.groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), first.alias("best"))
    taken = F.col("best.m") * -1 >= F.col("n") * ratio
    return words.join(best, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
        F.when(taken, F.col("best.near")).alias("form"), F.when(taken, -F.col("best.m")).alias("form_n"))


def roots(found: DataFrame) -> DataFrame:
    """``word`` and ``root`` of the words that have a form, by doubling the paths along forms."""
    paths = cut(found.where("form is not null").select("word", F.col("form").alias("root")))
    while True:
        ahead = paths.select(F.col("word").alias("root"), F.col("root").alias("far"))
        if paths.join(ahead, "root", "left_semi").isEmpty():
            return paths
        paths = cut(paths.join(ahead, "root", "left").select("word", F.coalesce("far", "root").alias("root")))


def spelling_variants(words: DataFrame, letters: int = LETTERS, occurrences: int = OCCURRENCES, ratio: int = RATIO) -> DataFrame:
    """Groups words by ``word`` and ``n`` (their counts, which are added up): word, form, root, n, n_near, form_n."""
    counted = cut(vocabulary(words, letters, occurrences))
    found = cut(forms(counted, cut(near_pairs(counted)), ratio))
    return found.join(roots(found), "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


@register("op13_spelling_variants")
def op13_spelling_variants(spark, sf_dir):
    return spelling_variants(spoken(table(spark, sf_dir, "documents")))
