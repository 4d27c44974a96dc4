"""Best-fit packing (operator 5): documents as token pieces, placed into as few fixed-size sequences as best fit finds.

The placement is bulk-synchronous. Pieces are ranked inside their length, gaps of open sequences are kept by size, and in
each step all pieces of the next smaller length look for their successor among the gaps, the smallest one that holds them.
Pieces that want the same gap are served by rank; then the gaps are updated and the next length follows. Pieces of equal
length can be exchanged, so a step needs only how many there are: the sweep runs on at most ``size`` lengths and gaps with
their counts, whatever the size of the corpus, and gives what one-by-one best-fit decreasing gives. It yields ranges
(length, ranks, first sequence, offset), to which the ranked pieces are joined.

Defined results: a null text counts as an empty one, which is one piece with the end id alone; a text is never shortened;
rows with equal ids or texts are separate documents; an empty table gives an empty result.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Remembered, by_string, cut, map_texts, table
from .registry import register

SIZE = 2048
END = 0
#: Ranges of the plan up to which they are broadcast; beyond, the join is left to Spark.
BROADCAST_RANGES = 1 << 17
#: Texts without such characters are split as the tokenizer does it by lower case, blanks, and what is set apart below.
OTHER = r"[^\t\n\r -~À-ÖØ-öø-ÿ]"
APART = r"('(?:s|t|re|ve|m|ll|d)|[0-9]|[^\sa-zß-öø-ÿ0-9]+)"


class WordIds(Remembered):
    """Ids of lower-case words as little-endian bytes; a word is tokenized when first met."""

    def __init__(self, tokenizer) -> None:
        from tokenizers.pre_tokenizers import ByteLevel

        super().__init__(self.ids)
        as_bytes = ByteLevel(add_prefix_space=False, use_regex=False)
        self.letters = {c: as_bytes.pre_tokenize_str(chr(c))[0][0] for c in range(0xC0, 0x100)}
        self.tokenize = tokenizer.model.tokenize

    def ids(self, word: str) -> bytes:
        word = word if word.isascii() else word.translate(self.letters)
        return b"".join([x.id.to_bytes(4, "little") for x in self.tokenize(word)])


class Encoder:
    """Ids of whole texts. The vocabulary works word by word, so a batch is looked up by its distinct strings."""

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True  # their strings in a text are ordinary text
        self.words = WordIds(self.tokenizer)

    def whole(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4")

    def __call__(self, texts: pa.Array) -> Iterator[np.ndarray]:
        """The ids of each text; null counts as empty."""
        other = pc.match_substring_regex(texts, OTHER).fill_null(False)
        words = by_string(pc.if_else(other, "", texts.fill_null("")), APART)
        found = [self.words[x] if x else b"" for x in words.strings.to_pylist()]
        sizes = np.fromiter(map(len, found), np.int32, len(found)) // 4
        ids = np.frombuffer(b"".join(found), "<u4")
        counts = sizes[words.codes]
        ends = np.concatenate([[0], np.cumsum(counts, dtype=np.int32)])
        starts = (np.cumsum(sizes, dtype=np.int32) - sizes)[words.codes]
        flat = ids[np.repeat(starts - ends[:-1], counts) + np.arange(ends[-1], dtype=np.int32)]
        edges = ends[words.offsets]
        for i, odd in enumerate(other.to_pylist()):
            yield self.whole(texts[i].as_py()) if odd else flat[edges[i] : edges[i + 1]]


@lru_cache(maxsize=1)
def encoder(path: str) -> Encoder:
    """One for each Python worker, so that its words serve all tasks there."""
    return Encoder(path)


def pieces(
    df: DataFrame, path: str, size: int = SIZE, text: str = "text", keep: list[str] | None = None, ids: bool = False,
) -> DataFrame:
    """One row a piece: the columns ``keep``, ``piece``, ``start``, ``length``, ``ids_crc32`` and, if wanted, ``ids``."""
    each = "array<struct<length:bigint,ids_crc32:bigint" + (",ids:array<int>" if ids else "") + ">>"

    def make():
        encode = encoder(path)

        def split(found: np.ndarray) -> list[dict]:
            found = np.append(found, np.uint32(END))
            out = []
            for at in range(0, len(found), size):
                part = found[at : at + size]
                row = {"length": len(part), "ids_crc32": zlib.crc32(part.tobytes())}
                out.append(row | {"ids": part.view("<i4")} if ids else row)
            return out

        return lambda texts: [[split(x) for x in encode(texts)]]

    rows = map_texts(df, make, [T.StructField("__pieces", T._parse_datatype_string(each))], text, keep, arrow=True)
    names = [c for c in rows.columns if c.lower() not in ("__pieces", "piece", "start", "length", "ids_crc32", "ids")]
    return rows.select(*[F.col(f"`{c}`") for c in names], F.posexplode("__pieces").alias("piece", "__row")).select(
        *[F.col(f"`{c}`") for c in names], "piece", (F.col("piece").cast("long") * size).alias("start"), "__row.*")


def plan(counts: dict[int, int], size: int = SIZE) -> list[tuple[int, int, int, int, int, int]]:
    """Best-fit decreasing for all pieces of a length at once.

    Returns (length, first rank, end rank, first sequence, pieces a sequence, offset): the piece of rank r goes to sequence
    ``first + (r - first rank) // pieces`` at ``offset + ((r - first rank) % pieces) * length``.
    """
    gaps: dict[int, list[tuple[int, int]]] = {}  # size of the gap -> ranges of sequences; each is filled up to size - gap
    out, opened = [], 0
    for length in sorted(counts, reverse=True):
        rank, left = 0, counts[length]
        for gap in [*sorted(g for g in gaps if g >= length), size]:
            each = gap // length
            ranges = gaps.pop(gap, []) if gap < size else [(opened, opened + -(-left // each))]
            while ranges and left:
                start, end = ranges.pop()
                used = min(end - start, -(-left // each))
                full, rest = divmod(min(left, used * each), each)
                placed = full * each + rest
                out.append((length, rank, rank + placed, start, each, size - gap))
                opened = max(opened, start + used)
                if full and gap - each * length:
                    gaps.setdefault(gap - each * length, []).append((start, start + full))
                if rest and gap - rest * length:
                    gaps.setdefault(gap - rest * length, []).append((start + full, start + full + 1))
                if start + used < end:
                    ranges.append((start + used, end))
                rank, left = rank + placed, left - placed
            if ranges:
                gaps.setdefault(gap, []).extend(ranges)
            if not left:
                break
    return out


def pack(rows: DataFrame, size: int = SIZE, order: list[str] = ("doc_id", "piece")) -> DataFrame:
    """Adds ``sequence_id`` and ``offset`` to rows that have a ``length`` of at most ``size``.

    Ranks are counted in cells of one length and one hash of ``order``, so a length that a third of the rows share is no
    single task's work.
    """
    spark = rows.sparkSession
    rows = cut(rows)
    cells = max(16, rows.count() // 50_000)
    rows = rows.withColumn("__cell", F.pmod(F.xxhash64(*order), F.lit(cells)))
    counts = rows.groupBy("length", "__cell").agg(F.count(F.lit(1)).alias("__n"))
    before = Window.partitionBy("length").orderBy("__cell").rowsBetween(Window.unboundedPreceding, -1)
    first = counts.withColumn("__first", F.coalesce(F.sum("__n").over(before), F.lit(0))).drop("__n")
    lengths = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("__n").alias("n")).collect()}
    ranges = plan(lengths, size)
    known = spark.createDataFrame(
        ranges, "length long, __from long, __to long, __sequence long, __each long, __offset long")
    known = F.broadcast(known) if len(ranges) <= BROADCAST_RANGES else known
    inside = F.row_number().over(Window.partitionBy("length", "__cell").orderBy(*order)) - 1
    ranked = rows.withColumn("__rank", inside).join(first, ["length", "__cell"])
    ranked = ranked.withColumn("__rank", F.col("__rank") + F.col("__first"))
    placed = ranked.join(
        known.withColumnRenamed("length", "__length"),
        (F.col("length") == F.col("__length")) & (F.col("__rank") >= F.col("__from")) & (F.col("__rank") < F.col("__to")))
    at = F.col("__rank") - F.col("__from")
    names = [c for c in rows.columns if c not in ("__cell", "sequence_id", "offset")]
    return placed.select(
        *[F.col(f"`{c}`") for c in names],
        (F.col("__sequence") + F.floor(at / F.col("__each"))).cast("long").alias("sequence_id"),
        (F.col("__offset") + at % F.col("__each") * F.col("length")).cast("long").alias("offset"))


def vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


@register("op5_best_fit_packing")
def op5_best_fit_packing(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return pack(pieces(docs, vocabulary(), keep=["doc_id"]))
