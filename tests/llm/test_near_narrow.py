"""What near-duplicates carry beside a key, and which texts they read again."""

import numpy as np
from pyspark.sql import functions as F

from footfall.llm import near_texts


def test_only_marked_texts_are_sent_again(spark):
    source = spark.range(20_000).select("id", F.xxhash64(F.col("id") % 19_000).alias("h"))
    wanted = source.where("id % 400 = 0").select("h")
    got = near_texts.marked(source, wanted)
    assert got.columns == source.columns
    must = {r.h for r in wanted.collect()}
    assert got.where(F.col("h").isin(sorted(must))).count() == source.where(F.col("h").isin(sorted(must))).count()
    assert got.count() < 200
    assert near_texts.marked(source, wanted.where("h is null")).isEmpty()


def test_a_pair_is_met_under_one_of_its_shared_keys(spark):
    draw = np.random.default_rng(3)
    rows = []
    for i in range(200):
        a = draw.integers(0, 1 << 16, near_texts.CHUNKS * near_texts.LANES).astype(np.uint64)
        b = np.where(draw.random(len(a)) < 0.15 + 0.1 * (i % 4), draw.integers(0, 1 << 16, len(a)), a).astype(np.uint64)
        packed = [(x.reshape(-1, near_texts.LANES) << (np.arange(near_texts.LANES, dtype=np.uint64) * np.uint64(16))).sum(axis=1) for x in (a, b)]
        rows.extend((2 * i + end, x.astype(np.uint64).view(np.int64).tolist()) for end, x in enumerate(packed))
    frame = spark.createDataFrame(rows, "id long, chunks array<long>").coalesce(2)
    names = [f"x{i}" for i in range(near_texts.CHUNKS)]
    keyed = frame.select("id", F.explode(near_texts.index_keys()).alias("key"), *[
        c.alias(n) for c, n in zip(near_texts.parts("chunks", len(names)), names, strict=True)])
    other = keyed.select("key", *[F.col(c).alias(c + "_b") for c in ("id", *names)])
    met = near_texts.met_first([F.col(n) for n in names], [F.col(n + "_b") for n in names], F.col("key"))
    pairs = keyed.join(other, "key").where("id < id_b")
    shared = {tuple(r) for r in pairs.select("id", "id_b").distinct().collect()}
    assert len(shared) > 190
    assert sorted(tuple(r) for r in pairs.where(met).select("id", "id_b").collect()) == sorted(shared)


def test_narrow_rows_beside_a_key():
    assert near_texts.CHUNKS + near_texts.PARITY // 64 <= 18  # 26 longs beside each key took a run on many near copies over its memory


def test_a_key_leads_by_members_outside_its_main_component(spark):
    owned = spark.createDataFrame(
        [(1, 10, 10), (1, 11, 10), (1, 12, 12), (2, 10, 10), (2, 11, 10)], "key long, id long, c long")
    got = {tuple(r) for r in near_texts.remaining(owned, False).select("key", "id", "c", "leads").collect()}
    assert got == {(1, 10, 10, False), (1, 11, 10, False), (1, 12, 12, True)}
    assert {r.leads for r in near_texts.remaining(owned, True).collect()} == {True}  # all of a small key lead
