"""Sharding by histogram sort (operator 8), with DataFrame functions only.

Rows are ordered by a 128-bit key: the hash of the text, then the hash of the id, so equal texts lie together. Candidate
boundaries are prefixes of that key. Each pass counts exact bytes and rows below every candidate; only bins in which a
wanted boundary falls, and bins that are too large for one window, are probed again with longer prefixes. When all splitters
meet the tolerance, one exchange brings each bin together and numbers its rows.

The law is ``bytes``: shards hold nearly equal bytes. Defined results: a null text counts as an empty one (size 1); equal
texts stay in one shard unless their group holds a boundary that no other edge meets within the tolerance; rows that are
equal in text and id are numbered in any order; an empty table gives an empty result; the result columns replace columns of
the same names.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, table, without
from .registry import register

STEP = 10
#: Rows of the histogram up to which it is broadcast; beyond, the join is left to Spark.
BROADCAST_BINS = 1 << 18


def _prefix(bits: int) -> tuple[Column, Column]:
    """The first ``bits`` of the key (h, g), as two columns."""
    if bits <= 64:
        return F.shiftrightunsigned("__h", 64 - bits), F.lit(0).cast("long")
    return F.col("__h"), F.shiftrightunsigned("__g", 128 - bits)


def _unsigned(value: int) -> int:
    return value & (1 << 64) - 1


def _count(rows: DataFrame, bits: int) -> list[dict]:
    """Bytes and rows below each prefix of that length, and whether all rows of the bin share one hash of the text."""
    a, b = _prefix(bits)
    found = rows.groupBy(a.alias("a"), b.alias("b")).agg(
        F.sum("__size").alias("bytes"), F.count(F.lit(1)).alias("n"), F.min("__h").alias("low"), F.max("__h").alias("high"))
    return [{**r.asDict(), "bits": bits} for r in found.collect()]


def _order(node: dict) -> tuple[int, int]:
    if node["bits"] <= 64:
        return _unsigned(node["a"]) << (64 - node["bits"]), 0
    return _unsigned(node["a"]), _unsigned(node["b"]) << (128 - node["bits"])


def _splitters(nodes: list[dict], n_shards: int) -> list[tuple[int, int, int]]:
    """For each boundary: (index of the bin after it, error in bytes, index of the bin that the exact place falls into)."""
    total, found, before, k = sum(x["bytes"] for x in nodes), [], 0, 1
    for i, x in enumerate(nodes):
        after = before + x["bytes"]
        while k < n_shards and after * n_shards >= k * total:
            low, high = k * total - before * n_shards, after * n_shards - k * total
            found.append((i, low, i) if low <= high else (i + 1, high, i))
            k += 1
        before = after
    return found


def histogram(rows: DataFrame, n_shards: int, tolerance: float) -> list[dict]:
    """Bins in key order with bytes and rows, fine enough that every boundary lies on an edge within the tolerance."""
    count = rows.count()
    first = min(20, max(STEP, math.ceil(math.log2(max(count, 1) / 250_000)) if count > 250_000 else STEP))
    nodes = sorted(_count(rows, first), key=_order)
    most = 4 * max(1, count >> first)
    total = sum(x["bytes"] for x in nodes)
    while True:
        wanted = {at for _, error, at in _splitters(nodes, n_shards) if error > tolerance * total}
        wanted |= {i for i, x in enumerate(nodes) if x["n"] > most}
        wanted = {i for i in wanted if nodes[i]["n"] > 1 and nodes[i]["bits"] < 128}
        if not wanted:
            return nodes
        asked: dict[tuple[int, int], list[dict]] = {}
        for i in wanted:
            x = nodes[i]
            finer = 64 + STEP if x["low"] == x["high"] and x["bits"] < 64 else min(x["bits"] + STEP, 64 if x["bits"] < 64 else 128)
            asked.setdefault((x["bits"], finer), []).append(x)
        nodes = [x for i, x in enumerate(nodes) if i not in wanted]
        for (bits, finer), parents in asked.items():
            a, b = _prefix(bits)
            inside = a.isin([x["a"] for x in parents])
            if bits > 64:
                inside &= F.struct(a.alias("a"), b.alias("b")).isin(
                    [F.struct(F.lit(x["a"]).cast("long").alias("a"), F.lit(x["b"]).cast("long").alias("b")) for x in parents])
            nodes += _count(rows.where(inside), finer)
        nodes.sort(key=_order)


def shard(df: DataFrame, n_shards: int = 8, tolerance: float = 0.001, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Adds ``size``, ``text_crc32``, ``shard`` and ``slot`` (gapless in each shard); ``tolerance`` is in shares of a shard."""
    value = F.coalesce(F.col(f"`{text}`").cast("string"), F.lit(""))
    keyed = df.withColumns({"__crc": F.crc32(value.cast("binary")), "__size": (F.octet_length(value) + 1).cast("long"), "__h": F.xxhash64(value),
                            "__g": F.xxhash64(F.col(f"`{key}`").cast("string"))})
    nodes = histogram(cut(keyed.select("__size", "__h", "__g")), n_shards, tolerance)
    edges = {}
    for at, _, _ in _splitters(nodes, n_shards):
        edges[at] = edges.get(at, 0) + 1
    leaves, number, start = [], 0, 0
    for i, x in enumerate(nodes):
        if edges.get(i):
            number, start = number + edges[i], 0
        leaves.append((x["bits"], x["a"], x["b"], i, number, start))
        start += x["n"]
    out = without(keyed, ["size", "text_crc32", "shard", "slot"])
    levels = sorted({x[0] for x in leaves})
    for bits in levels:
        known = df.sparkSession.createDataFrame(
            [x[1:] for x in leaves if x[0] == bits], f"__a long, __b long, __leaf{bits} int, __shard{bits} int, __start{bits} long")
        known = F.broadcast(known) if len(leaves) <= BROADCAST_BINS else known
        a, b = _prefix(bits)
        out = out.join(known, (a == F.col("__a")) & (b == F.col("__b")), "left").drop("__a", "__b")
    one = lambda name: F.coalesce(*[F.col(f"__{name}{bits}") for bits in levels] or [F.lit(0)])
    order = Window.partitionBy("__leaf").orderBy("__h", "__g", F.col(f"`{key}`"))
    out = out.withColumns({"__leaf": one("leaf"), "__shard": one("shard").cast("int"), "__start": one("start").cast("long")})
    out = out.withColumn("slot", F.col("__start") + F.row_number().over(order) - 1)
    names = [c for c in df.columns if c.lower() not in ("size", "text_crc32", "shard", "slot")]
    return out.select(
        *[F.col(f"`{c}`") for c in names], F.col("__size").alias("size"), F.col("__crc").alias("text_crc32"),
        F.col("__shard").alias("shard"), F.col("slot").cast("long"))


@register("op8_shards")
def op8_shards(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return shard(docs).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"))
