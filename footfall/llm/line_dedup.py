"""Line dedup by winnowing (operator 3): later copies of runs of lines that hold ``MIN_WORDS`` words or more are deleted.

Each line has a hash. For every line the shortest run from it on that holds ``MIN_WORDS`` words is a window, and the
smallest line hash in it is the window's fingerprint; as windows are cut by content, every run of that many words that two
places share has a window, and so a fingerprint position, in common. A window is matched to its earliest place (by id, then
text, then line), the matches of one place are joined by the positions of their fingerprints, each match is extended both
ways while the lines agree, and the later run is deleted. Matching to the earliest place alone keeps the work linear in a
window's copies; the whole window decides what a match is, so a common single line inside it leads nowhere.

Defined results: lines are split at \\n and compared as they are; words are runs without \\x20 and \\x09-\\x0D; a null text
stays null and has no lines; a text whose lines all go becomes empty; rows equal in id and text count as one place and get
the same result; within one text the later run goes whole, also where it overlaps the earlier one (each of its lines equals
the one an offset earlier, down to a first copy that stays), so one of n copies in a row stays; result columns replace
columns of the same names; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import cut, map_texts, table, without
from .registry import register

MIN_WORDS = 50


def line_hashes(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Hash and number of words of each line."""
    import xxhash

    lines = text.encode().split(b"\n")
    hashes = np.fromiter(map(xxhash.xxh3_64_intdigest, lines), np.uint64, len(lines)).view(np.int64)
    return hashes, np.fromiter((len(x.split()) for x in lines), np.int64, len(lines))


def windows(hashes: np.ndarray, words: np.ndarray, least: int = MIN_WORDS) -> list[tuple[int, int, int]]:
    """(hash of the window, its first line, the line of its smallest hash) for every line from which a window starts."""
    import xxhash

    before = np.concatenate([[0], np.cumsum(words)])
    ends = np.searchsorted(before, before[:-1] + least)  # lines before the window's end
    out = []
    for start, end in enumerate(ends.tolist()):
        if end > len(words):
            break
        run = hashes[start:end]
        if words[start]:  # a window from a blank line on holds the one from the next line on
            out.append((xxhash.xxh3_64_intdigest(run.tobytes()) - (1 << 63), start, start + int(run.argmin())))
    return out


def lines_of(df: DataFrame, text: str, keep: list[str], least: int) -> DataFrame:
    """Adds ``hashes``, ``words`` and ``windows`` of each text."""
    window = "array<struct<window:bigint,start:int,at:int>>"
    fields = [T.StructField("hashes", T.ArrayType(T.LongType())), T.StructField("words", T.ArrayType(T.IntegerType())),
              T.StructField("windows", T._parse_datatype_string(window))]

    def work(texts):
        out = []
        for value in texts:
            hashes, words = line_hashes(value) if value is not None else (np.zeros(0, np.int64), np.zeros(0, np.int64))
            found = [dict(zip(("window", "start", "at"), x)) for x in windows(hashes, words, least)]
            out.append((hashes, words.astype(np.int32), found))
        return [list(c) for c in zip(*out)]

    return map_texts(df, lambda: work, fields, text, keep)


def extend(
    lines: np.ndarray, words: np.ndarray, first: np.ndarray, matches: list[tuple[int, int]], least: int,
) -> list[tuple[int, int]]:
    """Runs of ``lines``, as [start, end), that agree with ``first`` around the matches of line numbers."""
    runs: list[tuple[int, int]] = []
    done: dict[int, int] = {}  # offset of a match -> end of the last run at that offset
    for at, other in sorted(matches):
        offset = at - other
        if at < done.get(offset, -1):
            continue
        room = min(at, other)
        differ = np.flatnonzero(lines[at - room : at][::-1] != first[other - room : other][::-1])
        start = at - (int(differ[0]) if len(differ) else room)
        room = min(len(lines) - at, len(first) - other)
        differ = np.flatnonzero(lines[at : at + room] != first[other : other + room])
        end = at + (int(differ[0]) if len(differ) else room)
        done[offset] = end
        if words[start:end].sum() >= least:
            runs.append((start, end))
    return runs


def repeated_runs(df: DataFrame, key: str = "doc_id", text: str = "text", least: int = MIN_WORDS) -> DataFrame:
    """Places (``id``, ``h``) with their ``runs`` to delete, as array of (start, end) in lines; one row a place."""
    source = df.select(F.col(f"`{key}`").alias("id"), F.col(f"`{text}`").cast("string").alias("text"))
    source = source.withColumn("h", F.xxhash64("text"))
    rows = cut(lines_of(source, "text", ["id", "h"], least))
    found = rows.select("id", "h", F.inline("windows"))
    firsts = found.groupBy("window").agg(F.min(F.struct("id", "h", "start", "at")).alias("first"))
    firsts = firsts.select("window", *[F.col(f"first.{c}").alias(f"{c}0") for c in ("id", "h", "start", "at")])
    matches = (
        found.join(firsts, "window")
        .where(~(F.col("id").eqNullSafe(F.col("id0")) & (F.col("h") == F.col("h0")) & (F.col("start") == F.col("start0"))))
        .groupBy("id", "h", "id0", "h0").agg(F.collect_set(F.struct("at", "at0")).alias("matches")))  # at most a text's lines
    lines = rows.select("id", "h", "hashes", "words").dropDuplicates(["id", "h"])
    earlier = lines.select(F.col("id").alias("i"), F.col("h").alias("h0"), F.col("hashes").alias("first"))
    both = (
        matches.join(earlier.withColumnRenamed("h0", "hh"), F.col("id0").eqNullSafe(F.col("i")) & (F.col("h0") == F.col("hh")))
        .drop("i", "hh")
        .join(lines.select(F.col("id").alias("i"), F.col("h").alias("hh"), "hashes", "words"),
              F.col("id").eqNullSafe(F.col("i")) & (F.col("h") == F.col("hh")))
        .select("id", "h", "matches", "hashes", "words", "first"))
    schema = T.StructType([both.schema["id"], both.schema["h"],
                           T.StructField("runs", T._parse_datatype_string("array<struct<start:int,end:int>>"))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
        for batch in batches:
            out = []
            for i in range(batch.num_rows):
                matches, hashes, words, first = (batch.column(c)[i] for c in range(2, 6))
                pairs = [(m["at"], m["at0"]) for m in matches.as_py()]
                as_array = lambda x: x.values.to_numpy(zero_copy_only=False)
                found = extend(as_array(hashes), as_array(words), as_array(first), pairs, least)
                out.append([{"start": a, "end": b} for a, b in found])
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, kind)], names=["id", "h", "runs"])

    runs = both.mapInArrow(run, schema).where(F.size("runs") > 0)
    return runs.groupBy("id", "h").agg(F.flatten(F.collect_list("runs")).alias("runs"))


def dedup_lines(df: DataFrame, key: str = "doc_id", text: str = "text", least: int = MIN_WORDS) -> DataFrame:
    """The rows with shortened texts, and ``n_lines`` (before) and ``n_removed``, as long."""
    base = without(df, ["n_lines", "n_removed"])
    runs = repeated_runs(df, key, text, least).select(F.col("id").alias("__id"), F.col("h").alias("__h"), F.col("runs").alias("__runs"))
    value = F.col(f"`{text}`").cast("string")
    joined = base.join(runs, F.col(f"`{key}`").eqNullSafe(F.col("__id")) & (F.xxhash64(value) == F.col("__h")), "left")
    lines = F.split(value, "\n", -1)
    gone = lambda i: F.exists("__runs", lambda r: (r["start"] <= i) & (i < r["end"]))
    kept = F.filter(lines, lambda _, i: ~gone(i))
    total = F.when(value.isNull(), 0).otherwise(F.length(value) - F.length(F.replace(value, F.lit("\n"), F.lit(""))) + 1)
    joined = joined.withColumn("__kept", F.when(F.col("__runs").isNotNull(), kept))
    names = [F.when(F.col("__kept").isNotNull(), F.array_join("__kept", "\n")).otherwise(value).alias(c) if c == text
             else F.col(f"`{c}`") for c in base.columns]
    removed = F.when(F.col("__kept").isNotNull(), total - F.size("__kept")).otherwise(0)
    return joined.select(*names, total.cast("long").alias("n_lines"), removed.cast("long").alias("n_removed"))


@register("op3_line_dedup")
def op3_line_dedup(spark, sf_dir):
    out = dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_lines", "n_removed", F.length("text").cast("long").alias("n_chars"),
                      F.crc32(F.col("text").cast("binary")).alias("text_crc32"))
