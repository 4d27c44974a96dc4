"""SentencePiece encoding and decoding with sampled segmentations (operator 1).

``sample`` draws ``k`` distinct segmentations of a whole text without replacement (Gumbel top-k). The lattice of a text holds
every way to spell it by pieces; its distribution gives each piece a weight by its rank in the vocabulary (Zipf's law).
Pieces never cross a blank, so the lattice is a chain of small lattices, one a chunk (blanks and what follows them).

The search is best first over sets of segmentations, each with a perturbed score: the largest Gumbel value of its members.
The whole lattice starts with a Gumbel value for mass 1. Popping a set draws the member that attains its value; the rest of
the set is split by the first chunk in which a segmentation differs from that member, and every part draws its value below
the popped one. So members come out in the order of independent Gumbel-perturbed log probabilities, without enumerating
them. The value of the best set left after ``k`` pops is the threshold of the inclusion scores: a segmentation with
log probability p is among the first k with probability 1 - exp(-exp(p - threshold)), given the threshold.

All draws are counted from a hash of the row's key, so results depend neither on partitions nor on batches.

``decode`` turns ids into the text again; every sampled segmentation decodes to the text it came from.

Defined results: a null or empty text has one segmentation, the empty one (log probability 0); a text with fewer than ``k``
segmentations gives them all, each with inclusion score 0 (certain) once nothing is left; rows with equal keys and texts
give equal samples; unknown characters are spelled in byte pieces; texts and chunks of any length are taken whole.
"""

from __future__ import annotations

import math
import re
from functools import lru_cache
from itertools import repeat
from typing import NamedTuple
from zlib import crc32

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import slices, table, without
from .registry import register

SAMPLES = 2
BLANK = "▁"
#: Stands for a text's own U+2581, which is spelled in bytes so that it does not come back as a blank.
OWN_BLANK = "\ufdd0"
#: Marks the ends of chunks while texts are split; a text's own mark is spelled in bytes like any unknown character.
CUT, OWN_CUT = "\ufdd1", "\ufdd2"
#: Places at which the lattice is cut: before blanks, and between Latin words and other characters if no piece spans both.
CHUNK = f"{BLANK}+[^{BLANK}]*|[^{BLANK}]+"
LATIN = "0-9A-Za-zÀ-ÖØ-öø-ɏ"
WORD_CHUNK = f"{BLANK}*[{LATIN}]+|{BLANK}*[^{LATIN}{BLANK}]+|{BLANK}+"
BEYOND = re.compile(f"[{LATIN}][^{LATIN}]|[^{LATIN}{BLANK}][{LATIN}]")
#: Added to a piece's rank before its weight -log(rank) is taken.
SHIFT = 2
CODE_POINTS = 1 << 21
#: Chunks whose lattices a worker remembers beside those of its batch.
REMEMBERED = 60_000
#: Bits of a hash of trie edges; there are some 20 times as many places as edges.
SLOTS = 20
#: Bytes of text that are sampled at a time; a longer text comes alone.
SLICE = 1 << 20

# Fixed values of the splitmix64 generator.
_A, _B, _C = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * _B
    x = (x ^ (x >> np.uint64(27))) * _C
    return x ^ (x >> np.uint64(31))


def unit(x: np.ndarray) -> np.ndarray:
    """Numbers in (0, 1) from 64-bit hashes."""
    return ((x >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53


class Pieces:
    """The vocabulary as a trie over code points, and the byte pieces."""

    def __init__(self, path: str) -> None:
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.names = [model.id_to_piece(i) for i in range(model.get_piece_size())]
        self.byte = np.full(256, -1)
        children: dict[tuple[int, int], int] = {}
        ids, weights = [-1], [0.0]
        self.size = len(self.names)
        for i, name in enumerate(self.names):
            if model.is_byte(i):
                self.byte[int(name[1:-1], 16)] = i
            elif not (model.is_unknown(i) or model.is_control(i) or model.is_unused(i)):
                at = 0
                for c in name:
                    if (at, ord(c)) not in children:
                        children[at, ord(c)] = len(ids)
                        ids.append(-1)
                        weights.append(0.0)
                    at = children[at, ord(c)]
                ids[at], weights[at] = i, -math.log(min(-model.get_score(i), self.size) + SHIFT)
        keys = np.array([(a * CODE_POINTS + c, v) for (a, c), v in children.items()], np.int64)
        keys = keys[np.argsort(keys[:, 0])]
        self.keys, self.targets = keys[:, 0].copy(), keys[:, 1].copy()
        self.slots = np.full(1 << SLOTS, -1, np.int32)  # a place holds one of the edges hashed there
        self.slots[self.slot(self.keys)] = np.arange(len(keys), dtype=np.int32)
        self.ids, self.weights = np.array(ids), np.array(weights)
        spans = any(BEYOND.search(self.names[i]) for i in ids if i >= 0)
        self.split = CHUNK if spans else WORD_CHUNK

    @staticmethod
    def slot(key: np.ndarray) -> np.ndarray:
        return ((key.astype(np.uint64) * _A) >> np.uint64(64 - SLOTS)).astype(np.int64)

    def step(self, nodes: np.ndarray, codes: np.ndarray) -> np.ndarray:
        """Where the trie's edges lead from nodes (below 0: there is none)."""
        key = nodes * CODE_POINTS + codes
        at = self.slots[self.slot(key)]
        out = np.where((at >= 0) & (self.keys[at] == key), self.targets[at], -1)
        other = np.flatnonzero((at >= 0) & (out < 0))  # the place holds another edge
        late = np.minimum(np.searchsorted(self.keys, key[other]), len(self.keys) - 1)
        out[other] = np.where(self.keys[late] == key[other], self.targets[late], -1)
        return out


@lru_cache(maxsize=1)
def pieces(path: str) -> Pieces:
    return Pieces(path)


def utf8_sizes(codes: np.ndarray) -> np.ndarray:
    return 1 + (codes >= 0x80) + (codes >= 0x800) + (codes >= 0x10000)


class Lattices:
    """Lattices of chunks, end to end: a position before each character and one after the last.

    For each position the number of its first edge and the log of the mass behind it; for each edge where it leads, its id
    (below 0: a character in byte pieces), and the running sum of the chances of a position's edges.
    """

    def __init__(self, vocabulary: Pieces) -> None:
        self.vocabulary = vocabulary
        self.clear()

    def clear(self) -> None:
        self.number: dict[str, int] = {}  # of the remembered chunks, which are the first ones
        self.uses = np.zeros(0, np.int64)
        self.start = np.zeros(0, np.int64)
        self.first = np.zeros(1, np.int64)
        self.mass = np.zeros(0)
        self.to, self.id, self.running, self.chance = (np.zeros(0, t) for t in (np.int32, np.int32, np.float32, float))

    def codes(self, chunks: pa.Array) -> np.ndarray:
        """Numbers of the chunks; lattices of new ones are built together.

        What comes twice in a batch is remembered, the rest until the next batch only.
        """
        coded = chunks.dictionary_encode()
        distinct, indices = coded.dictionary.to_pylist(), coded.indices.to_numpy()
        self.forget()
        count = np.bincount(indices, minlength=len(distinct))
        numbers = self.numbers(distinct)
        if len(self.number) + int(((numbers < 0) & (count > 1)).sum()) > REMEMBERED and self.number:
            names = list(self.number)
            most = np.argsort(-self.uses, kind="stable")[: REMEMBERED // 2]
            uses = self.uses[most] // 2
            self.clear()
            self.remember([names[i] for i in most.tolist()], uses)
            numbers = self.numbers(distinct)
        fresh = np.flatnonzero(numbers < 0)
        fresh = fresh[np.argsort([-len(distinct[i]) for i in fresh.tolist()], kind="stable")]
        often = count[fresh] > 1
        again = fresh[often][: max(0, REMEMBERED - len(self.number))]
        numbers[again] = self.remember([distinct[i] for i in again.tolist()], np.zeros(len(again), np.int64))
        held = numbers >= 0
        self.uses[numbers[held]] += count[held]
        rest = fresh[numbers[fresh] < 0]
        numbers[rest] = self.add([distinct[i] for i in rest.tolist()])
        return numbers[indices] if len(chunks) else numbers

    def numbers(self, chunks: list[str]) -> np.ndarray:
        """Numbers of remembered chunks, -1 for others."""
        return np.fromiter(map(self.number.get, chunks, repeat(-1)), np.int64, len(chunks))

    def remember(self, chunks: list[str], uses: np.ndarray) -> np.ndarray:
        """Adds chunks that stay, and returns their numbers."""
        order = np.array(sorted(range(len(chunks)), key=lambda i: -len(chunks[i])), np.int64)
        names = [chunks[i] for i in order.tolist()]
        numbers = np.empty(len(chunks), np.int64)
        numbers[order] = self.add(names)
        self.number.update(zip(names, numbers[order].tolist(), strict=True))
        self.uses = np.concatenate([self.uses, uses[order]])
        return numbers

    def forget(self) -> None:
        """Only the lattices of remembered chunks stay."""
        n = len(self.number)
        if n < len(self.start):
            at = int(self.start[n])
            edge = int(self.first[at])
            self.start, self.first, self.mass = self.start[:n], self.first[: at + 1], self.mass[:at]
            self.to, self.id, self.running, self.chance = (x[:edge] for x in (self.to, self.id, self.running, self.chance))

    def add(self, chunks: list[str]) -> np.ndarray:
        """Builds the lattices of chunks, the longest first, and returns their numbers."""
        if not chunks:
            return np.zeros(0, np.int64)
        v = self.vocabulary
        sizes = np.fromiter(map(len, chunks), np.int64, len(chunks))
        text = np.frombuffer("".join(chunks).encode("utf-32-le"), np.uint32).astype(np.int64)
        chars = np.cumsum(sizes) - sizes
        ends = np.repeat(chars + sizes, sizes)  # of the chunk of each character
        shift = np.repeat(np.arange(len(chunks)), sizes)  # positions before it beyond one a character
        at, nodes, n = np.arange(len(text)), np.zeros(len(text), np.int64), 0
        found = []
        while len(at):
            nodes = v.step(nodes, text[at + n])
            at, nodes = at[nodes >= 0], nodes[nodes >= 0]
            n += 1
            hit = v.ids[nodes] >= 0
            found.append((at[hit], np.full(int(hit.sum()), n), v.ids[nodes[hit]], v.weights[nodes[hit]]))
            inside = at + n < ends[at]
            at, nodes = at[inside], nodes[inside]
        spelled = np.zeros(len(text), bool)
        spelled[found[0][0]] = True
        rest = np.flatnonzero(~spelled)
        own = np.where(text[rest] == ord(OWN_BLANK), ord(BLANK), np.where(text[rest] == ord(OWN_CUT), ord(CUT), text[rest]))
        ids = np.where(own < 0x80, v.byte[np.minimum(own, 0x7F)], -1 - own)
        found.append((rest, np.ones(len(rest), np.int64), ids, -utf8_sizes(own) * math.log(v.size + SHIFT)))
        source, span, ids, weights = (np.concatenate(x) for x in zip(*found))
        order = np.argsort(source, kind="stable")
        source, span, ids, weights = source[order], span[order], ids[order], weights[order]
        first = np.searchsorted(source, np.arange(len(text) + 1))
        mass = np.zeros(len(text) + len(chunks))
        source, own = source + shift[source], source
        to = source + span
        for t in range(1, int(sizes[0]) + 1):
            live = np.arange(np.searchsorted(-sizes, -t, side="right"))
            p = chars[live] + sizes[live] - t
            count = first[p + 1] - first[p]
            starts = np.cumsum(count) - count
            edge = np.repeat(first[p] - starts, count) + np.arange(int(count.sum()))
            value = weights[edge] + mass[to[edge]]
            top = np.maximum.reduceat(value, starts)
            mass[p + shift[p]] = top + np.log(np.add.reduceat(np.exp(value - np.repeat(top, count)), starts))
        chance = weights + mass[to] - mass[source]
        order = np.argsort(own - 0.5 * np.exp(chance), kind="stable")  # likely edges first, so that draws end early
        to, ids, chance = to[order], ids[order], chance[order]
        summed = np.cumsum(np.exp(chance))
        lead = first[own]
        running = summed - np.where(lead > 0, summed[lead - 1], 0.0)
        running[first[1:] - 1] = 2.0  # a position's last edge takes what rounding leaves
        place = np.zeros(len(mass) + 1, np.int64)  # first edge of each position; the last one of a chunk has none
        place[1:] = np.cumsum(np.bincount(source, minlength=len(mass)))
        base, edges = len(self.mass), len(self.to)
        self.start = np.concatenate([self.start, base + chars + np.arange(len(chunks))])
        self.first = np.concatenate([self.first[:-1], edges + place])
        self.mass = np.concatenate([self.mass, mass])
        self.to = np.concatenate([self.to, (base + to).astype(np.int32)])
        self.id = np.concatenate([self.id, ids.astype(np.int32)])
        self.running = np.concatenate([self.running, running.astype(np.float32)])
        self.chance = np.concatenate([self.chance, chance])
        return np.arange(len(self.start) - len(chunks), len(self.start))

    def length(self, code: int) -> int:
        """Positions of a chunk, at most: no path has more edges."""
        return int((self.start[code + 1] if code + 1 < len(self.start) else len(self.mass)) - self.start[code])

    def draw(self, codes: np.ndarray, seeds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """A segmentation of each chunk: its edges end to end, how many they are, and its log probability."""
        at, edges, who = self.start[codes], [], []
        live = np.arange(len(codes))
        count, chance = np.zeros(len(codes), np.int64), np.zeros(len(codes))
        state = seeds
        while len(live):
            state = mix(state + _A)
            u = unit(state)
            edge = self.first[at]
            late = np.flatnonzero(u > self.running[edge])
            while len(late):
                edge[late] += 1
                late = late[u[late] > self.running[edge[late]]]
            chance[live] += self.chance[edge]
            count[live] += 1
            edges.append(edge)
            who.append(live)
            at = self.to[edge]
            more = self.first[at + 1] > self.first[at]
            at, live, state = at[more], live[more], state[more]
        begins = np.cumsum(count) - count
        out = np.empty(int(count.sum()), np.int64)
        for i, (edge, chunk) in enumerate(zip(edges, who)):
            out[begins[chunk] + i] = edge
        return out, count, chance

    def draw_other(self, code: int, known: list[tuple[int, ...]], uniform) -> tuple[tuple[int, ...], float]:
        """A segmentation of a chunk that is none of ``known``, by its chance among the others, and its log probability."""
        at, path, total = int(self.start[code]), [], 0.0
        while self.first[at + 1] > self.first[at]:
            edges = range(int(self.first[at]), int(self.first[at + 1]))
            shares = []
            for e in edges:
                inside = [k for k in known if k[0] == e]
                taken = sum(math.exp(sum(self.chance[x] for x in k[1:])) for k in inside)
                done = any(len(k) == 1 for k in inside)
                shares.append(0.0 if done else math.exp(self.chance[e]) * max(0.0, 1.0 - taken))
            mark = uniform() * sum(shares)
            for e, share in zip(edges, shares):
                mark -= share
                if mark <= 0 and share > 0:
                    break
            else:
                e = edges[int(np.argmax(shares))]
            known = [k[1:] for k in known if k[0] == e and len(k) > 1]
            path.append(e)
            total += self.chance[e]
            at = int(self.to[e])
        return tuple(path), total


def below(mass: np.ndarray, bound: np.ndarray, u: np.ndarray) -> np.ndarray:
    """Gumbel values of sets with log masses ``mass``, given that they lie below ``bound``."""
    with np.errstate(over="ignore", divide="ignore", invalid="ignore"):
        value = mass - np.log(np.exp(np.minimum(mass - bound, 700)) - np.log(u))
    return np.where(mass > -np.inf, value, -np.inf)


def log_rest(log_p: np.ndarray) -> np.ndarray:
    """log(1 - p); -inf where rounding leaves nothing."""
    with np.errstate(divide="ignore"):
        rest = -np.expm1(np.minimum(log_p, 0.0))
        return np.where(rest > 1e-15, np.log(np.maximum(rest, 1e-300)), -np.inf)


class Pool(NamedTuple):
    """Drawn paths: for each chunk of the batch where its edges begin, how many they are, and the log probability."""

    begins: np.ndarray
    count: np.ndarray
    chance: np.ndarray


class Search:
    """The best-first search over the segmentations of each of a batch of texts, all texts in step."""

    def __init__(self, lattices: Lattices, codes: np.ndarray, ends: np.ndarray, seeds: np.ndarray) -> None:
        self.lattices, self.codes, self.seeds = lattices, codes, seeds
        self.full = np.flatnonzero(np.diff(ends) > 0)  # texts with chunks
        self.first = ends[:-1][self.full]
        self.size = np.diff(ends)[self.full]
        self.text = np.repeat(np.arange(len(self.full)), self.size)
        self.place = np.arange(len(codes)) - self.first[self.text]
        self.row = seeds[self.full][self.text]
        self.edges: list[np.ndarray] = []  # the pools' edges, end to end
        self.n_edges = 0
        self.samples: list[Pool] = []
        self.values: list[np.ndarray] = []  # perturbed score by text; -inf: the text has no such sample
        self.parts: list[np.ndarray] = []  # values of the sets split off each sample, by chunk
        self.known: list[dict[int, list[tuple[int, ...]]]] = []  # by chunk: excluded beside the sample's own path

    def pooled(self, edges: np.ndarray, count: np.ndarray, chance: np.ndarray) -> Pool:
        begins = np.cumsum(count) - count + self.n_edges
        self.edges.append(edges)
        self.n_edges += len(edges)
        return Pool(begins, count, chance)

    def path(self, pool: Pool, chunk: int) -> tuple[int, ...]:
        at, n = int(pool.begins[chunk]), int(pool.count[chunk])
        for block in self.edges:
            if at < len(block):
                return tuple(block[at : at + n].tolist())
            at -= len(block)
        return ()

    def best(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """By text: value of the best set left, the sample it was split off, and its chunk."""
        value, parent, chunk = (np.full(len(self.full), x) for x in (-np.inf, 0, 0))
        for i, part in enumerate(self.parts):
            top = np.maximum.reduceat(part, self.first)
            at = np.minimum.reduceat(np.where(part == top[self.text], np.arange(len(part)), len(part)), self.first)
            better = top > value
            value, parent, chunk = np.where(better, top, value), np.where(better, i, parent), np.where(better, at, chunk)
        return value, parent, chunk

    def others(self, at: np.ndarray, known: list[list[tuple[int, ...]]], seeds: np.ndarray) -> tuple[list, np.ndarray]:
        """For each chunk a path that is none of its known ones: free draws until one is new, for the last ones by shares."""
        paths: list = [None] * len(at)
        chance, left = np.zeros(len(at)), np.arange(len(at))
        for attempt in range(6):
            if not len(left):
                break
            edges, count, found = self.lattices.draw(self.codes[at[left]], mix(seeds[left] + np.array([attempt], np.uint64) * _C))
            begins = np.cumsum(count) - count
            again = []
            for j, (i, start, n) in enumerate(zip(left.tolist(), begins.tolist(), count.tolist())):
                path = tuple(edges[start : start + n].tolist())
                if path in known[i]:
                    again.append(i)
                else:
                    paths[i], chance[i] = path, found[j]
            left = np.array(again, np.int64)
        for i in left.tolist():
            uniform = unit(mix(seeds[i] + np.arange(7, 7 + self.lattices.length(int(self.codes[at[i]])), dtype=np.uint64) * _A)).tolist()
            paths[i], chance[i] = self.lattices.draw_other(int(self.codes[at[i]]), known[i], iter(uniform).__next__)
        return paths, chance

    def take(self) -> None:
        """One more sample of every text that has one left."""
        if not len(self.full):
            return
        turn = np.array([len(self.samples) + 1], np.uint64)
        place = self.place.astype(np.uint64)
        fresh = self.pooled(*self.lattices.draw(self.codes, mix(self.row + place * _C + turn * _B)))
        own = mix(self.seeds[self.full] ^ (turn * _C))
        known: dict[int, list[tuple[int, ...]]] = {}
        if not self.samples:
            value, begins, count, chance = -np.log(-np.log(unit(own))), *fresh
            start = np.zeros(len(self.full), np.int64) - 1
        else:
            value, parent, at = self.best()
            live = np.flatnonzero(value > -np.inf)
            start = np.where(value > -np.inf, at - self.first, -1)
            excluded = []
            for t in live.tolist():
                i, c = int(parent[t]), int(at[t])
                excluded.append([*self.known[i].get(c, []), self.path(self.samples[i], c)])
                self.parts[i][c] = -np.inf  # taken: its rest is split off the new sample
            paths, special = self.others(at[live], excluded, own[live])
            known = dict(zip(at[live].tolist(), excluded))
            before = self.place < start[self.text]
            old = [np.choose(parent[self.text], [s[j] for s in self.samples]) for j in range(3)]
            begins, count, chance = (np.where(before, o, f) for o, f in zip(old, fresh))
            flat = np.array([e for p in paths for e in p], np.int64)
            sizes = np.array([len(p) for p in paths], np.int64)
            extra = self.pooled(flat, sizes, special)
            begins[at[live]], count[at[live]], chance[at[live]] = extra
        self.samples.append(Pool(begins, count, chance))
        self.values.append(value)
        self.known.append(known)
        total = np.cumsum(chance) - chance
        prefix = total - total[self.first][self.text]
        mass = prefix + log_rest(chance)
        mass[self.place < start[self.text]] = -np.inf  # those sets belong to the parent
        mass[(value == -np.inf)[self.text]] = -np.inf
        for c, paths in known.items():
            left = 1.0 - sum(math.exp(self.lattices.chance[list(k)].sum()) for k in paths) - math.exp(chance[c])
            mass[c] = prefix[c] + math.log(left) if left > 1e-15 else -np.inf
        self.parts.append(below(mass, value[self.text], unit(mix(self.row + place * _B + turn * _A))))


def prepared(texts: pa.Array, split: str) -> tuple[pa.Array, np.ndarray]:
    """Chunks of the texts as the vocabulary spells them, end to end, and the end of each text's chunks."""
    whole = pc.replace_substring(pc.replace_substring(texts.fill_null(""), BLANK, OWN_BLANK), " ", BLANK)
    whole = pc.if_else(pc.equal(whole, ""), "", pc.binary_join_element_wise(BLANK, whole, ""))
    odd = pc.match_substring(whole, CUT)
    marked = pc.replace_substring_regex(pc.if_else(odd, "", whole), f"({split})", r"\1" + CUT)
    if pc.any(odd).as_py():  # texts that hold the mark itself are split one by one
        values = [
            CUT.join([*re.findall(split, x.replace(CUT, OWN_CUT)), ""]) if o else m
            for x, m, o in zip(whole.to_pylist(), marked.to_pylist(), odd.to_pylist())]
        marked = pa.array(values, pa.string())
    chunks = pc.split_pattern(marked, CUT)
    flat, offsets = chunks.flatten(), chunks.offsets.to_numpy()
    last = np.zeros(len(flat), bool)
    last[offsets[1:] - 1] = True  # after each text's last mark
    return flat.filter(pa.array(~last)), np.concatenate([[0], np.cumsum(np.diff(offsets) - 1)]).astype(np.int64)


def sample_texts(lattices: Lattices, texts: pa.Array, seeds: np.ndarray, k: int) -> pa.Array:
    """For each text its samples, as list of structs."""
    chunks, ends = prepared(texts, lattices.vocabulary.split)
    search = Search(lattices, lattices.codes(chunks), ends, seeds)
    for _ in range(k):
        search.take()
    threshold = search.best()[0] if search.parts else np.zeros(0)
    pool = np.concatenate([*search.edges, np.zeros(0, np.int64)])
    columns, sizes = [], []
    n = len(texts)
    for i in range(k):
        alive, p, value, score = np.zeros(n, bool), np.zeros(n), np.zeros(n), np.zeros(n)
        ids, spans = np.zeros(0, np.int32), np.zeros(n, np.int64)
        if i == 0:  # the empty text has one segmentation
            alive[:] = True
            value = -np.log(-np.log(unit(mix(seeds ^ _A))))
        if search.samples:
            begins, count, chance = search.samples[i]
            alive[search.full] = search.values[i] > -np.inf
            count = np.where(alive[search.full][search.text], count, 0)
            ids, count = final_ids(lattices, pool, begins, count)
            spans[search.full] = np.add.reduceat(count, search.first)
            p[search.full] = np.add.reduceat(chance, search.first)
            value[search.full] = search.values[i]
            gap = p[search.full] - threshold
            with np.errstate(over="ignore", divide="ignore"):
                inclusion = np.where(gap < -30, gap, np.log(-np.expm1(-np.exp(np.clip(gap, -30, 40)))))
            score[search.full] = np.where(threshold == -np.inf, 0.0, inclusion)
        columns.append((alive, p, value, score, ids, spans))
        sizes.append(alive)
    alive = np.stack(sizes, axis=1)
    flat = alive.ravel()  # text by text, sample by sample
    stack = lambda j: np.stack([c[j] for c in columns], axis=1).ravel()[flat]
    spans = np.stack([c[5] for c in columns], axis=1)
    starts = np.concatenate([[0], np.cumsum(spans.ravel())])
    ids = np.empty(int(starts[-1]), np.int32)
    for i, c in enumerate(columns):
        to = starts[:-1].reshape(n, k)[:, i]
        ids[np.repeat(to - (np.cumsum(c[5]) - c[5]), c[5]) + np.arange(len(c[4]))] = c[4]
    edges = np.concatenate([[0], np.cumsum(spans.ravel()[flat])]).astype(np.int32)
    lists = pa.ListArray.from_arrays(pa.array(edges), pa.array(ids))
    checks = [crc32(x) for x in decoded(lattices.vocabulary, lists)]
    fields = [pa.array(np.tile(np.arange(k, dtype=np.int32), n)[flat]), pa.array(stack(1)), pa.array(stack(2)), pa.array(stack(3)),
              lists, pa.array(checks, pa.int64())]
    rows = pa.StructArray.from_arrays(fields, names=["sample", "log_prob", "perturbed", "log_inclusion", "ids", "text_crc32"])
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(alive.sum(axis=1))]).astype(np.int32)), rows)


def final_ids(
    lattices: Lattices, pool: np.ndarray, begins: np.ndarray, count: np.ndarray,
) -> tuple[np.ndarray, np.ndarray]:
    """Ids of the chunks' paths, end to end, and how many each chunk has; characters in byte pieces have several."""
    ends = np.cumsum(count)
    ids = lattices.id[pool[np.repeat(begins - (ends - count), count) + np.arange(int(ends[-1]) if len(ends) else 0)]]
    odd = np.flatnonzero(ids < 0)
    if len(odd):
        spelled = [lattices.vocabulary.byte[list(chr(-1 - i).encode())] for i in ids[odd].tolist()]
        wide = np.ones(len(ids), np.int64)
        wide[odd] = [len(x) for x in spelled]
        chunk = np.repeat(np.arange(len(count)), count)
        count = np.bincount(chunk, wide, len(count)).astype(np.int64)
        ids = np.repeat(ids, wide)
        ids[ids < 0] = np.concatenate(spelled)
    return ids.astype(np.int32), count


SAMPLE = "array<struct<sample:int,log_prob:double,perturbed:double,log_inclusion:double,ids:array<int>,text_crc32:bigint>>"


@lru_cache(maxsize=1)
def lattices(path: str) -> Lattices:
    """One for each Python worker, so that its chunks serve all tasks there."""
    return Lattices(pieces(path))


def sample(df: DataFrame, path: str, k: int = SAMPLES, key: str = "doc_id", text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """A row a segmentation: the columns ``keep``, ``sample`` (from 0, by perturbed score), ``log_prob``, ``perturbed``,
    ``log_inclusion``, ``ids``, and ``text_crc32`` of the text that they decode to (its UTF-8 bytes)."""
    names = [c for c in (df.columns if keep is None else keep)
             if c.lower() not in ("sample", "log_prob", "perturbed", "log_inclusion", "ids", "text_crc32")]
    source = df.select(*[F.col(f"`{c}`") for c in names], F.xxhash64(F.col(f"`{key}`").cast("string")).alias("__seed"),
                       F.col(f"`{text}`").cast("string").alias("__text"))
    schema = T.StructType([*[source.schema[c] for c in names], T.StructField("__samples", T._parse_datatype_string(SAMPLE))])

    def run(batches):
        from pyspark.sql.pandas.types import to_arrow_schema

        kind = to_arrow_schema(schema).field("__samples").type
        known = lattices(path)
        for batch in batches:
            texts, seeds = batch.column(len(names) + 1), batch.column(len(names))
            sizes = pc.fill_null(pc.binary_length(texts), 0).to_pylist()
            for a, b in slices(sizes, SLICE):
                part = seeds.slice(a, b - a).to_numpy().view(np.uint64)
                made = sample_texts(known, texts.slice(a, b - a), part, k)
                columns = [batch.column(i).slice(a, b - a) for i in range(len(names))]
                yield pa.RecordBatch.from_arrays([*columns, made.cast(kind)], names=[*names, "__samples"])

    return source.mapInArrow(run, schema).select(*[F.col(f"`{c}`") for c in names], F.inline("__samples"))


@lru_cache(maxsize=1)
def spellings(vocabulary: Pieces) -> pa.Array:
    """The bytes of each id, and nothing at the end for ids outside the vocabulary; control pieces have none."""
    byte = {int(i): bytes([b]) for b, i in enumerate(vocabulary.byte)}
    made = [byte.get(i, vocabulary.names[i].replace(BLANK, " ").encode()) if i >= 3 else b"" for i in range(vocabulary.size)]
    return pa.array([*made, b""], pa.binary())


def decoded(vocabulary: Pieces, ids: pa.ListArray) -> list[bytes | None]:
    """The texts of segmentations in UTF-8 (null: None), without the blank that encoding puts first."""
    flat = ids.flatten().fill_null(-1).to_numpy()
    known = np.where((flat >= 0) & (flat < vocabulary.size), flat, vocabulary.size)
    sizes = pc.fill_null(pc.list_value_length(ids), 0).to_numpy()
    whole = spellings(vocabulary).take(pa.array(known))  # end to end already: a text is a stretch of it
    places = np.concatenate([[0], np.cumsum(pc.binary_length(whole).to_numpy())]).astype(np.int64)
    ends = places[np.concatenate([[0], np.cumsum(sizes)])].tolist()
    data = b"".join(whole.to_pylist()) if whole.buffers()[2] is None else whole.buffers()[2].to_pybytes()
    made = [data[a:b].removeprefix(b" ") for a, b in zip(ends, ends[1:], strict=False)]
    return [x if valid else None for x, valid in zip(made, ids.is_valid().to_pylist(), strict=True)]


def decode(df: DataFrame, path: str, ids: str = "ids", text: str = "text") -> DataFrame:
    """Adds ``text``, decoded from the array column ``ids`` (null: null)."""
    base = without(df, [text])
    schema = T.StructType([*base.schema, T.StructField(text, T.StringType())])
    names, at = [*base.columns, text], base.columns.index(ids)

    def run(batches):
        vocabulary = pieces(path)
        for batch in batches:
            made = decoded(vocabulary, batch.column(at).cast(pa.list_(pa.int32())))
            made = pa.array([None if x is None else x.decode(errors="replace") for x in made], pa.string())
            yield pa.RecordBatch.from_arrays([*batch.columns, made], names=names)

    return base.mapInArrow(run, schema)


def vocabulary_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


@register("op1_sampled_segmentations")
def op1_sampled_segmentations(spark, sf_dir):
    return sample(table(spark, sf_dir, "documents"), vocabulary_path(), keep=["doc_id"]).select(
        "doc_id", "sample", F.size("ids").cast("long").alias("n_pieces"), F.xxhash64("ids").alias("ids_hash"),
        "log_prob", "perturbed", "log_inclusion", "text_crc32")
