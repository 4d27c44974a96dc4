"""Main text of web pages (operator 11): a linear-chain conditional random field over the leaf blocks of a page.

A page is read into blocks: the text between two boundaries of block elements, in page order, each with the names of the
elements around it, the words of their ``class``, ``id`` and ``role`` attributes, and the share of its text inside links.
Scripts, styles, comments and other text that is never shown make no blocks. The field labels each block as main text or not
by features of the block (surrounding elements and words, size, links, marks, place on the page) and by the label before it,
in the same or in another container; the best labelling is found by the Viterbi algorithm.

The field is trained on labelled pages: ``DRAWN`` pages drawn by rule (module ``page_layouts``), and at most ``SAMPLE`` given
pages (those of smallest hashed id) that mark their main text by an ``article`` or ``main`` element. For some of them the
surroundings are hidden, so that sizes, links and places count as well. The fit runs on the driver over this bounded set;
every page is then read whole, and all its blocks are labelled.

Defined results: a null or empty page, one without text, and one without main text give an empty text; an element that is not
closed ends with its parent, a tag that is cut off at the end of the page is no text; white space is what Unicode calls so;
a line break inside a block is white space; rows with equal or null ids are read each by itself; an empty table gives an empty
result; other columns are not read.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterable
from functools import cache
from html import unescape
from random import Random
from typing import NamedTuple

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import map_texts, table
from .page_layouts import drawn_page
from .registry import register

#: Elements whose text is not shown, or is no running text; of RAW ones the text is taken as it is up to the end tag.
HIDDEN = frozenset("script style head title template noscript iframe object canvas svg textarea select option".split())
RAW = frozenset("script style textarea title noscript iframe".split())
#: Elements of the head, and those that do not begin a block.
IN_HEAD = frozenset("title meta link style script base noscript template html".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i img input ins kbd label mark q ruby rb rp rt s samp small span"
    " strike strong sub sup time tt u var wbr br".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: An element that begins closes one of its group that is open right around it.
CLOSES = {t: g for g in (("li",), ("dt", "dd"), ("tr", "td", "th"), ("td", "th"), ("option",)) for t in g} | {"tr": ("tr", "td", "th")}
TAG = re.compile(r"""</?([a-zA-Z][^\s/>]*)((?:=\s*"[^"]*"|=\s*'[^']*'|[^>])*+)>""")
NAMED = re.compile(r"""(?:^|\s)(?:class|id|role)\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)""", re.I)
PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
#: Labelled pages that the field is trained on at most, drawn and given, and blocks of them; chance that surroundings are hidden.
DRAWN, SAMPLE, BLOCKS, BLIND = 300, 100, 60, 0.25
SEED = 20250611


class Block(NamedTuple):
    text: str
    around: frozenset[str]  # names of the elements around it and, after a dot, words of their attributes
    own: str  # name of the element that holds it
    container: int  # number of the element around that one
    linked: int  # code points of its source inside links


def blocks(html: str, known: frozenset[str] | None = None) -> list[Block]:
    """The blocks of a page in order. With ``known``, ``around`` holds only names and words of it.

    Work is in proportion to the page, whatever is open, unclosed or cut off.
    """
    out: list[Block] = []
    stack: list[tuple[str, tuple[str, ...], int]] = []
    open_: Counter = Counter()  # open elements by name
    words: Counter = Counter()  # names and words around this place
    around, changed = frozenset(), False
    pieces: list[str] = []
    linked = number = hidden = 0

    def flush() -> None:
        nonlocal pieces, linked, around, changed
        if not pieces:
            return
        text = " ".join(unescape("".join(pieces)).split())
        if text:
            if changed:
                around, changed = frozenset(words), False
            holders = [e for e in stack[-3:] if e[0] != "a"][-2:]
            own = holders[-1][0] if holders else ""
            out.append(Block(text, around, own, holders[0][2] if len(holders) > 1 else 0, linked))
        pieces, linked = [], 0

    def pop() -> None:
        nonlocal hidden, changed
        name, named, _ = stack.pop()
        open_[name] -= 1
        hidden -= name in HIDDEN
        changed = True
        for w in named:
            words[w] -= 1
            if not words[w]:
                del words[w]

    def close(name: str) -> None:
        while open_[name] and stack[-1][0] != name:
            pop()
        if open_[name]:
            pop()

    i, size = 0, len(html)
    while i < size:
        j = html.find("<", i)
        j = size if j < 0 else j
        if j > i and not hidden:
            pieces.append(html[i:j])
            linked += j - i if open_["a"] else 0
        if j == size:
            break
        if html.startswith("<!--", j):
            end = html.find("-->", j + 4)
            i = size if end < 0 else end + 3
            continue
        if html[j + 1:j + 2] in ("!", "?"):
            end = html.find(">", j)
            i = size if end < 0 else end + 1
            continue
        m = TAG.match(html, j)
        if not m:
            if re.match("</?[a-zA-Z]", html[j:j + 3]):
                break  # cut off inside a tag
            if not hidden:
                pieces.append("<")
            i = j + 1
            continue
        i, name = m.end(), m[1].lower()
        if name in INLINE and name != "a":
            if name == "br" and not hidden:
                pieces.append(" ")
            continue
        if name != "a" and not hidden:
            flush()
        if html[j + 1] == "/":
            close(name)
            continue
        if name == "a":
            close("a")
        elif name not in HIDDEN:
            close("p")
        if open_["head"] and name not in IN_HEAD:
            close("head")
        while name in CLOSES and stack and stack[-1][0] in CLOSES[name]:
            pop()
        if name in VOID:
            continue
        if name in RAW:
            end = re.compile(f"</{name}", re.I | re.A).search(html, i)
            if not end:
                break
            i = end.start()
        number += 1
        named = {name, *(f".{w.lower()}" for v in NAMED.findall(m[2]) for w in PART.findall(v))}
        named = tuple(named if known is None else named & known)
        stack.append((name, named, number))
        open_[name] += 1
        hidden += name in HIDDEN
        words.update(named)
        changed = True
    if not hidden:
        flush()
    return out


def shape(page: list[Block]) -> list[list[str]]:
    """Features of each block apart from its surroundings."""
    out = []
    for i, b in enumerate(page):
        share = min(1.0, b.linked / len(b.text))
        count = b.text.count(" ") + 1
        out.append([
            "=bias", f"=own {b.own}", f"=size {min(12, len(b.text).bit_length())}", f"=words {min(8, count.bit_length())}",
            f"=links {0 if not share else 1 if share < 0.3 else 2 if share < 0.7 else 3}",
            f"=end {b.text[-1] in '.!?…'}", f"=first {min(i, 4)}", f"=last {min(len(page) - 1 - i, 4)}",
            *(["=rights"] if "©" in b.text else []), *(["=bars"] if "|" in b.text or "·" in b.text else [])])
    return out


class Field(NamedTuple):
    """Weights of main text by feature, and of pairs of labels: [same container][label before][label]."""

    weights: dict[str, float]
    pairs: np.ndarray

    def labels(self, page: list[Block]) -> list[bool]:
        """The most probable labelling (Viterbi)."""
        if not page:
            return []
        surroundings: dict[frozenset[str], float] = {}
        gain = []
        for b, own in zip(page, shape(page), strict=True):
            if b.around not in surroundings:
                surroundings[b.around] = sum(self.weights.get(f, 0.0) for f in sorted(b.around))
            gain.append(surroundings[b.around] + sum(self.weights.get(f, 0.0) for f in own))
        pairs = self.pairs.tolist()
        off, on, back = 0.0, gain[0], []
        for b, before, g in zip(page[1:], page, gain[1:], strict=False):
            (p00, p01), (p10, p11) = pairs[b.container == before.container]
            back.append((on + p10 > off + p00, on + p11 > off + p01))
            off, on = max(off + p00, on + p10), max(off + p01, on + p11) + g
        found = [on > off]
        for choice in reversed(back):
            found.append(choice[found[-1]])
        return found[::-1]


class Labelled(NamedTuple):
    """A page for training, by block: shape, names around it, number of its container, and whether it is main text."""

    shapes: list[list[str]]
    around: list[list[str]]
    containers: list[int]
    labels: list[bool]


def labelled(page: list[Block], labels: list[bool]) -> Labelled:
    """The first ``BLOCKS`` blocks of a page, for training."""
    some = page[:BLOCKS]
    return Labelled(shape(page)[:BLOCKS], [sorted(b.around) for b in some], [b.container for b in some], labels[:BLOCKS])


def fit(pages: Iterable[Labelled], rng: Random, blind: float = BLIND, ridge: float = 1e-3, rounds: int = 150) -> Field:
    """Weights by accelerated gradient steps on the penalised mean log likelihood of the labels of a page."""
    rows, truth, same, lengths = [], [], [], []
    for page in pages:
        if page.labels:
            unseen = rng.random() < blind
            rows += [own if unseen else [*own, *around] for own, around in zip(page.shapes, page.around, strict=True)]
            truth += page.labels
            same += [False, *(b == a for a, b in zip(page.containers, page.containers[1:], strict=False))]
            lengths.append(len(page.labels))
    uses = Counter(f for r in rows for f in r)
    number = {f: k for k, f in enumerate(sorted(f for f, n in uses.items() if n > 1))}
    if not number:
        return Field({}, np.zeros((2, 2, 2)))
    at = np.array([i for i, r in enumerate(rows) for f in r if f in number])
    col = np.array([number[f] for r in rows for f in r if f in number])
    n, longest = len(lengths), max(lengths)
    page_of = np.repeat(np.arange(n), lengths)
    place = np.arange(len(rows)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    there = np.zeros((n, longest), bool)
    there[page_of, place] = True
    kind, label = np.zeros((n, longest), int), np.zeros((n, longest), int)
    kind[page_of, place], label[page_of, place] = same, truth
    inner = there[:, 1:]
    counted = np.zeros((2, 2, 2))
    np.add.at(counted, (kind[:, 1:][inner], label[:, :-1][inner], label[:, 1:][inner]), 1)
    theta = np.zeros(len(number) + 8)
    m, v = np.zeros_like(theta), np.zeros_like(theta)
    for step in range(1, rounds + 1):
        pairs = theta[-8:].reshape(2, 2, 2)
        gain = np.zeros((n, longest))
        gain[page_of, place] = np.bincount(at, theta[col], len(rows))
        score = np.stack([np.zeros_like(gain), gain], axis=2)
        forward, backward = np.zeros((n, longest, 2)), np.zeros((n, longest, 2))
        forward[:, 0] = score[:, 0]
        step_pairs = pairs[kind]  # pages x places x label before x label
        for t in range(1, longest):
            ahead = np.logaddexp.reduce(forward[:, t - 1, :, None] + step_pairs[:, t], axis=1) + score[:, t]
            forward[:, t] = np.where(there[:, t, None], ahead, forward[:, t - 1])
        total = np.logaddexp.reduce(forward[:, -1], axis=1)
        for t in range(longest - 2, -1, -1):
            behind = np.logaddexp.reduce(step_pairs[:, t + 1] + (score[:, t + 1] + backward[:, t + 1])[:, None, :], axis=2)
            backward[:, t] = np.where(there[:, t + 1, None], behind, 0.0)
        on = np.exp(forward[:, :, 1] + backward[:, :, 1] - total[:, None])[page_of, place]
        joint = np.exp(
            forward[:, :-1, :, None] + step_pairs[:, 1:] + (score[:, 1:] + backward[:, 1:])[:, :, None, :] - total[:, None, None, None])
        expected = np.zeros((2, 2, 2))
        np.add.at(expected, kind[:, 1:][inner], joint[inner])
        gradient = np.concatenate([np.bincount(col, (on - np.array(truth))[at], len(number)), (expected - counted).ravel()]) / n + ridge * theta
        m += 0.1 * (gradient - m)
        v += 0.01 * (gradient * gradient - v)
        theta -= 0.15 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    return Field({f: float(theta[k]) for f, k in number.items()}, theta[-8:].reshape(2, 2, 2).copy())


@cache
def drawn_pages(count: int = DRAWN, seed: int = SEED) -> list[Labelled]:
    """Labelled pages by rule."""
    out = []
    for i in range(count):
        html, mark = drawn_page(Random(f"{seed}/{i}"))
        page = blocks(html)
        out.append(labelled([b._replace(text=b.text.replace(mark, "")) for b in page], [mark in b.text for b in page]))
    return out


def marked(html: str) -> Labelled | None:
    """A given page labelled by its own ``article`` or ``main`` element, if it has one around some blocks and not all."""
    page = blocks(html)
    labels = [bool(b.around & {"article", "main"}) and not b.around & {"nav", "aside", "footer", "form"} for b in page]
    return labelled(page, labels) if any(labels) and not all(labels) else None


def train(pages: DataFrame, key: str = "page_id", html: str = "html", drawn: int = DRAWN, sample: int = SAMPLE) -> Field:
    """The field, fitted on ``drawn`` pages by rule and at most ``sample`` given ones, of which features reach the driver."""
    kind = "struct<shapes:array<array<string>>,around:array<array<string>>,containers:array<int>,labels:array<boolean>>"

    def work(texts):
        return [[None if (m := marked(t)) is None else m._asdict() for t in texts]]

    chosen = (
        pages.where(F.col(f"`{html}`").isNotNull()).select(F.col(f"`{key}`").alias("id"), F.col(f"`{html}`").alias("html"))
        .orderBy(F.xxhash64("id"), "id", F.xxhash64("html"), "html").limit(sample))
    read = map_texts(chosen, lambda: work, [T.StructField("page", T._parse_datatype_string(kind))], "html", ["id"])
    given = [Labelled(*r["page"]) for r in read.where("page is not null").collect()]
    return fit([*drawn_pages(drawn), *given], Random(SEED))


def main_text(df: DataFrame, field: Field, html: str = "html", keep: list[str] | None = None) -> DataFrame:
    """Adds ``text``, the blocks of main text joined by two line ends, ``n_chars``, ``n_blocks`` and ``n_main``."""
    known = frozenset(f for f in field.weights if not f.startswith("="))

    def work(pages):
        texts, all_, main = [], [], []
        for page in pages:
            found = blocks(page, known) if page else []
            kept = [b.text for b, on in zip(found, field.labels(found), strict=True) if on]
            texts.append("\n\n".join(kept))
            all_.append(len(found))
            main.append(len(kept))
        return [texts, [len(t) for t in texts], all_, main]

    fields = [T.StructField("text", T.StringType()), *[T.StructField(n, T.LongType()) for n in ("n_chars", "n_blocks", "n_main")]]
    return map_texts(df, lambda: work, fields, html, keep)


@register("op11_main_text")
def op11_main_text(spark, sf_dir):
    pages = table(spark, sf_dir, "pages")
    return main_text(pages, train(pages), keep=["page_id", "url"]).select("page_id", "url", "text", "n_chars")
