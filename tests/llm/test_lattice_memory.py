"""Lattices that a worker remembers, and steps along the trie."""

import numpy as np
import pyarrow as pa

from footfall.llm import segmentation


def known():
    return segmentation.Lattices(segmentation.pieces(segmentation.vocabulary_path()))


def words(start, n):
    return [f"▁w{start + i}x" for i in range(n)]


def test_common_chunks_stay_though_rare_ones_come_and_go(monkeypatch):
    monkeypatch.setattr(segmentation, "REMEMBERED", 60)
    lattices, built = known(), []
    real = lattices.add
    monkeypatch.setattr(lattices, "add", lambda chunks: built.extend(chunks) or real(chunks))
    common = ["▁the", "▁cat", "▁sat"]
    for batch in range(8):  # each has more rare chunks than are remembered
        lattices.codes(pa.array([*common, *words(100 * batch, 70), *common]))
    assert sum(c in common for c in built) == len(common)
    assert len(lattices.number) == len(common)


def test_samples_do_not_depend_on_what_is_remembered(monkeypatch):
    texts = [" ".join(["the cat", *(f"w{(7 * i + j) % 40}x" for j in range(12)), "ñandú the cat"]) for i in range(30)]
    seeds = np.arange(30, dtype=np.uint64) * np.uint64(7919)
    found = []
    for most in (6, 60_000):
        monkeypatch.setattr(segmentation, "REMEMBERED", most)
        lattices = known()
        rows = [segmentation.sample_texts(lattices, pa.array(texts[i : i + 5]), seeds[i : i + 5], 2).to_pylist() for i in range(0, 30, 5)]
        assert len(lattices.number) <= most
        found.append([[(s["ids"], s["text_crc32"]) for s in r] for batch in rows for r in batch])
    assert found[0] == found[1]


def test_steps_lead_where_the_trie_says():
    v = segmentation.pieces(segmentation.vocabulary_path())
    there = dict(zip(v.keys.tolist(), v.targets.tolist(), strict=True))
    draw = np.random.default_rng(5)
    key = np.concatenate([v.keys, draw.integers(0, 1 << 37, 50_000), v.keys + 1, np.zeros(1, np.int64)])
    got = v.step(key // segmentation.CODE_POINTS, key % segmentation.CODE_POINTS)
    assert got.tolist() == [there.get(k, -1) for k in key.tolist()]
