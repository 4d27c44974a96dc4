"""Token counts without tokens (operator 4): greedy longest-match lengths from a linear automaton.

The vocabulary is a trie with failure links. Each node knows how many tokens are done with when its longest match is popped,
so a word's count is a sum along its path: no piece is cut out, and no character is looked at again. The words of a batch
are walked side by side, one character of all of them at a time, each distinct word once.

A word is a run between ASCII blanks, in lower case; every character that is neither letter nor digit is a word of its own.
The last byte of a word is a symbol of its own, which matches only tokens that end a word.

Defined results: a null or blank text has 0 words and 0 tokens; a word that the vocabulary cannot spell counts as one token
and is also counted in ``n_unknown``; the length of a text or word is not limited.
"""

from __future__ import annotations

import json
from collections import deque
from collections.abc import Iterable
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import by_string, map_texts, table
from .registry import register

APART = r"([^\s\pL\pN])"
#: Symbols: 256 bytes, and 256 bytes that end a word.
SYMBOLS = 512
WORD_END = "</w>"


class Automaton(NamedTuple):
    """Edges sorted by ``node * SYMBOLS + symbol``; failure link (-1: none), popped tokens and tokens at a word's end by node."""

    edges: np.ndarray
    targets: np.ndarray
    fail: np.ndarray
    pops: np.ndarray
    rest: np.ndarray


def automaton(tokens: Iterable[tuple[int, ...]]) -> Automaton:
    """From tokens as symbols."""
    children: list[dict[int, int]] = [{}]
    is_token = [False]
    for token in tokens:
        at = 0
        for symbol in token:
            if symbol not in children[at]:
                children[at][symbol] = len(children)
                children.append({})
                is_token.append(False)
            at = children[at][symbol]
        is_token[at] = at > 0
    fail, pops, rest = [-1] * len(children), [0] * len(children), [-1] * len(children)
    rest[0] = 0
    queue = deque([0])
    while queue:
        u = queue.popleft()
        for symbol, v in children[u].items():
            if is_token[v]:
                fail[v], pops[v] = 0, 1
            else:  # pop what the parent holds until some node goes on with this symbol
                z, popped = fail[u], pops[u]
                while z >= 0 and symbol not in children[z]:
                    z, popped = fail[z], popped + pops[z]
                if z >= 0:
                    fail[v], pops[v] = children[z][symbol], popped
            if fail[v] >= 0 and rest[fail[v]] >= 0:
                rest[v] = pops[v] + rest[fail[v]]
            queue.append(v)
    keys = [(u * SYMBOLS + s, v) for u, found in enumerate(children) for s, v in found.items()]
    edges = np.array(sorted(keys), np.int64).reshape(-1, 2)
    as_array = lambda x: np.array(x, np.int32)
    return Automaton(edges[:, 0].copy(), as_array(edges[:, 1]), as_array(fail), as_array(pops), as_array(rest))


def lengths(found: Automaton, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Tokens of each word, and whether the vocabulary cannot spell it (then 1; an empty word has 0)."""
    offsets = np.frombuffer(words.buffers()[1], np.int32)[words.offset : words.offset + len(words) + 1].astype(np.int64)
    data = np.frombuffer(words.buffers()[2], np.uint8) if words.buffers()[2] is not None else np.zeros(0, np.uint8)
    size = np.diff(offsets)
    order = np.argsort(-size, kind="stable")
    starts, ends = offsets[:-1][order], size[order]
    state = np.zeros(len(order), np.int64)
    count = np.zeros(len(order), np.int64)
    dead = np.zeros(len(order), bool)
    live = len(order)
    for t in range(int(ends[0]) if len(order) else 0):
        live = int(np.searchsorted(-ends[:live], -t, side="left"))  # words are ordered, so the longer ones come first
        at = np.flatnonzero(~dead[:live])
        symbols = data[starts[at] + t].astype(np.int64) + 256 * (ends[at] == t + 1)
        while len(at):
            key = state[at] * SYMBOLS + symbols
            place = np.minimum(np.searchsorted(found.edges, key), len(found.edges) - 1)
            hit = found.edges[place] == key
            state[at[hit]] = found.targets[place[hit]]
            at, symbols = at[~hit], symbols[~hit]
            back = found.fail[state[at]]
            dead[at[back < 0]] = True
            count[at] += found.pops[state[at]]
            state[at] = back
            at, symbols = at[back >= 0], symbols[back >= 0]
    state[dead] = 0
    dead |= found.rest[state] < 0
    count = np.where(dead, 1, count + found.rest[state])
    out, unknown = np.zeros(len(order), np.int64), np.zeros(len(order), bool)
    out[order], unknown[order] = count, dead
    return out, unknown


def byte_letters() -> dict[str, int]:
    """Letters by which byte-level vocabularies write bytes: printable ones stand for themselves, others follow from 256 on."""
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    others = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(others)}


def vocabulary_tokens(path: str) -> list[tuple[int, ...]]:
    """Tokens of a vocabulary file with word ends, as symbols; special tokens are left out."""
    with open(path) as file:
        content = json.load(file)
    special = {x["content"] for x in content.get("added_tokens", [])}
    letters = byte_letters()
    out = []
    for token in content["model"]["vocab"]:
        ends = token.endswith(WORD_END)
        body = [letters[c] for c in (token[: -len(WORD_END)] if ends else token)] if token not in special else []
        if body:
            out.append((*body[:-1], body[-1] + 256 * ends))
    return out


def token_counts(df: DataFrame, path: str, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Adds ``n_words``, ``n_tokens`` and ``n_unknown``, as long. The automaton is as large as the vocabulary."""
    found = automaton(vocabulary_tokens(path))

    def work(texts: pa.Array) -> list[np.ndarray]:
        words = by_string(texts.fill_null(""), APART)
        tokens, unknown = lengths(found, words.strings)
        filled = pa.compute.binary_length(words.strings).to_numpy() > 0
        sums = []
        for each in (filled, tokens * filled, unknown & filled):
            total = np.concatenate([[0], np.cumsum(each.astype(np.int64)[words.codes])])
            sums.append(pa.array(np.diff(total[words.offsets]), pa.int64()))
        return sums

    fields = [T.StructField(n, T.LongType()) for n in ("n_words", "n_tokens", "n_unknown")]
    return map_texts(df, lambda: work, fields, text, keep, 16 << 20, arrow=True)


@register("op4_token_counts")
def op4_token_counts(spark, sf_dir):
    from .packing import vocabulary

    return token_counts(table(spark, sf_dir, "documents"), vocabulary(), keep=["doc_id"]).select(
        "doc_id", "n_words", "n_tokens", "n_unknown")
