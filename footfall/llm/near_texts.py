"""MinHash near-dedup (operator 9) by a multi-index Hamming join.

A document's signature has ``CHUNKS * LANES`` positions of 16 bits, each the low bits of a minimum over its word shingles.
The distance of two signatures is the number of positions that differ. Signatures are split into chunks of four positions:
if two differ in fewer than ``CHUNKS * (ERRORS + 1)`` positions, some chunk differs in at most ``ERRORS`` = 1 of them
(pigeonhole). Each chunk is therefore indexed under the four keys that leave one position out, and all pairs under that
distance share a key. At a similarity of 0.75 a position differs with chance 0.25; the distance bound of 20 out of 40 is
missed with chance 6e-4, and no shared key at all has chance 1.5e-6. Links are confirmed on the full shingle sets.

Documents with equal sets are one class. Within a key, members are first compared with its smallest class, then with some
``LEADERS`` of its members, then all those outside the largest component of the key with all members. Only members of different
components are compared, each pair under the first key that it shares, and keys whose members are all in one component are
done. So a group of n near copies costs about n comparisons a leader until it has grown together, what stays outside
is compared with all, and no link between different components is lost.

Defined results: words are runs without \\x20 and \\x09-\\x0D, A-Z in lower case; fewer than five words are one shingle; a
null or blank text has no shingles and links with nothing; an empty table gives an empty result. A document is its id and
text: rows equal in both are judged alike, those that share the id only are judged by their texts. A component's id is its
smallest id, and it keeps one document, of that id and then of the smallest text hash; null ids come last, so that a
document without id is kept where its component has no other.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from operator import add, and_, or_

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import cut, map_texts, table
from .components import components
from .registry import register

SHINGLE = 5
PERCENT = 75
CHUNKS, LANES, BITS, ERRORS = 10, 4, 16, 1
#: Cells of the parity bits.
PARITY = 512
#: Words of 64 bits that mark the hashes of the texts to be read again.
MARKS = 1 << 17
#: Members of a key, on average, that lead in the first round after its smallest one.
LEADERS = 32
SEED = 20240611

_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit (splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


def shingles(text: str | None) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the word shingles."""
    import xxhash

    words = text.encode().lower().split() if text else []  # bytes: exactly the contract's blanks and letters
    if not words:
        return np.zeros(0, np.uint64)
    ids = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    width = min(SHINGLE, len(words))
    found = np.zeros(len(words) - width + 1, np.uint64)
    for i in range(width):
        found = mix(found + ids[i : i + len(found)] + np.uint64(i + 1))
    return np.unique(found)


def multipliers() -> tuple[np.ndarray, np.ndarray]:
    draw = np.random.default_rng(SEED).integers(0, 2**63, (2, CHUNKS * LANES), dtype=np.uint64)
    return draw[0] * np.uint64(2) + np.uint64(1), draw[1]


def signature(found: np.ndarray, by: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """One long a chunk; a lane of 16 bits a position."""
    lanes = np.empty(CHUNKS * LANES, np.uint64)
    for i, (m, a) in enumerate(zip(*by)):
        value = found * m + a
        lanes[i] = (value ^ (value >> np.uint64(32))).min() if len(found) else 0
    lanes = mix(lanes) & np.uint64(0xFFFF)
    shifts = np.arange(LANES, dtype=np.uint64) * np.uint64(BITS)
    return (lanes.reshape(CHUNKS, LANES) << shifts).sum(axis=1, dtype=np.uint64).view(np.int64)


def parities(found: np.ndarray) -> np.ndarray:
    """For each of ``PARITY`` cells of the hash space whether the set has an odd number of shingles there, as bits of longs.

    Where two sets' bits differ, some shingle is in one of them only; so they differ in at most as many bits as shingles.
    """
    odd = np.bincount((found >> np.uint64(64 - PARITY.bit_length() + 1)).astype(np.int64), minlength=PARITY) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def signatures(df: DataFrame, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Adds ``n_shingles``, ``set_hash`` (128 bits over the whole set; null for an empty one), ``chunks`` and ``parity``."""
    fields = [T.StructField("n_shingles", T.LongType()), T.StructField("set_hash", T.StringType()),
              T.StructField("chunks", T.ArrayType(T.LongType())), T.StructField("parity", T.ArrayType(T.LongType()))]

    def make():
        import xxhash

        by = multipliers()

        def work(texts):
            found = [shingles(t) for t in texts]
            hashes = [xxhash.xxh3_128_hexdigest(x.tobytes()) if len(x) else None for x in found]
            codes = np.concatenate([signature(x, by) for x in found]) if found else np.zeros(0, np.int64)
            edges = pa.array(np.arange(0, len(found) * CHUNKS + 1, CHUNKS, dtype=np.int32))
            chunks = pa.ListArray.from_arrays(edges, pa.array(codes))
            return [[len(x) for x in found], hashes, chunks, [parities(x) for x in found]]

        return work

    return map_texts(df, make, fields, text, keep)


def index_keys() -> Column:
    """Keys under which a signature is found: each chunk with each of its positions left out; the low 6 bits tell which."""
    keys = []
    for chunk in range(CHUNKS):
        for lane in range(LANES):
            mask = ~(0xFFFF << (BITS * lane)) & (1 << 64) - 1
            mask -= (mask >> 63) << 64
            whole = F.xxhash64(F.get("chunks", F.lit(chunk)).bitwiseAND(F.lit(mask)), F.lit(chunk * LANES + lane))
            keys.append(whole.bitwiseAND(F.lit(-64)).bitwiseOR(F.lit(chunk * LANES + lane).cast("long")))
    return F.array(*keys)


def parts(array: str, n: int) -> list[Column]:
    """An array of n longs as columns."""
    return [F.get(array, F.lit(i)) for i in range(n)]


def differing(a: list[Column], b: list[Column]) -> list[Column]:
    """Positions in which two signatures differ, chunk by chunk."""
    low, high = 0x00007FFF7FFF7FFF, 0x0000800080008000
    out = []
    for p, q in zip(a, b, strict=True):
        x = p.bitwiseXOR(q)
        lanes = (x.bitwiseAND(F.lit(low)) + F.lit(low)).bitwiseOR(x).bitwiseAND(F.lit(high))  # a bit a lane but the topmost
        out.append(F.bit_count(lanes) + (F.shiftrightunsigned(x, 48) != 0).cast("int"))
    return out


def close(a: list[Column], b: list[Column]) -> Column:
    """Whether two signatures are near enough to be compared."""
    return reduce(add, differing(a, b)) < CHUNKS * (ERRORS + 1)


def met_first(a: list[Column], b: list[Column], key: Column) -> Column:
    """Whether this key is the first that two signatures share, so that a pair comes once and not under each.

    Signatures share keys of a chunk where they differ in one position of it (its key alone) or in none (all of them), so the
    first key is of the first chunk that differs in one position at most.
    """
    place = key.bitwiseAND(F.lit(63))
    earlier = [(place < LANES * (i + 1)) | (d > ERRORS) for i, d in enumerate(differing(a, b)[:-1])]
    equal = [(place >= LANES * i) & (place < LANES * (i + 1)) & (p == q) for i, (p, q) in enumerate(zip(a, b, strict=True))]
    return reduce(and_, earlier) & ((F.pmod(place, F.lit(LANES)) == 0) | ~reduce(or_, equal))


def sizes_allow(a: list[Column], b: list[Column], size: Column) -> Column:
    """Whether two sets, by their parities and the sum of their sizes, can be similar enough.

    The parities reject only what is certain: at 75 % of the union, sets differ in at most a seventh of their sizes' sum.
    """
    bits = reduce(add, [F.bit_count(p.bitwiseXOR(q)) for p, q in zip(a, b, strict=True)])
    return (100 + PERCENT) * bits <= (100 - PERCENT) * size


def confirm(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The rows of ``pairs`` whose sets ``a``, ``b`` share at least 75 % of their union. ``sets``: ``id``, ``found`` (bytes)."""
    left = sets.select(F.col("id").alias("a"), F.col("found").alias("found_a"))
    right = sets.select(F.col("id").alias("b"), F.col("found").alias("found_b"))
    names = pairs.columns
    both = pairs.join(left, "a").join(right, "b").select(*names, "found_a", "found_b")

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column(len(names)), batch.column(len(names) + 1)):
                p, q = (np.frombuffer(v.as_buffer(), np.uint64) for v in (x, y))
                shared = len(p) + len(q) - len(np.union1d(p, q))
                keep.append(100 * shared >= PERCENT * (len(p) + len(q) - shared))
            yield batch.select(names).filter(pa.array(keep, pa.bool_()))

    return both.mapInArrow(check, pairs.schema)


def marked(source: DataFrame, wanted: DataFrame, h: str = "h") -> DataFrame:
    """The rows of ``source`` whose hash may be among those of ``wanted``: all that are, and some that share a mark.

    The marks have a bounded size, so only these rows' texts have to be sent to the place of their ids.
    """
    word, bit = F.pmod(F.col(h), F.lit(MARKS)), F.shiftrightunsigned(h, 40).bitwiseAND(F.lit(63)).cast("int")
    one = F.call_function("shiftleft", F.lit(1).cast("long"), bit)
    marks = wanted.select(word.alias("word"), one.alias("one")).groupBy("word").agg(F.bit_or("one").alias("marks"))
    found = source.join(F.broadcast(marks), word == F.col("word")).where(F.col("marks").bitwiseAND(one) != 0)
    return found.drop("word", "marks")


def text_sets(df: DataFrame, text: str = "text") -> DataFrame:
    """Adds ``found``: the sorted set as bytes."""
    def work(texts):
        return [[shingles(t).tobytes() for t in texts]]

    return map_texts(df, lambda: work, [T.StructField("found", T.BinaryType())], text, ["id"])


def judged(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``near_duplicates`` with ``text_hash``: a document is its key and text, and a component keeps one."""
    source = df.select(F.col(f"`{key}`").alias("id"), F.col(f"`{text}`").cast("string").alias("text"))
    source = source.withColumn("h", F.xxhash64("text"))
    rows = cut(signatures(source, "text", ["id", "h"]))
    place = F.struct(F.col("id").isNull().alias("no_id"), "id", "h")
    classes = rows.where("set_hash is not null").groupBy("set_hash").agg(
        F.min(place).alias("first"), F.min_by(F.struct("chunks", "parity", "n_shingles"), place).alias("s"))
    # each set has a number of its own, as ids may be null or repeat; it is fixed once written
    classes = cut(classes.select(
        F.monotonically_increasing_id().alias("id"), "set_hash", "first", "s.chunks", "s.parity", F.col("s.n_shingles").alias("size")))
    keyed = classes.select("id", F.explode(index_keys()).alias("key"))
    shared = keyed.groupBy("key").agg(F.min("id").alias("least"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    index = cut(keyed.join(shared, "key"))
    names = [f"x{i}" for i in range(CHUNKS)], [f"q{i}" for i in range(PARITY // 64)]
    traits = [*names[0], *names[1]]
    members = cut(classes.join(index.select("id").distinct(), "id", "left_semi").select(
        "id", "first", "size", *[F.coalesce(v, F.lit(0)).alias(n) for n, v in zip(
            traits, [*parts("chunks", CHUNKS), *parts("parity", PARITY // 64)], strict=True)]))
    wanted = members.select(F.col("id").alias("number"), F.col("first.id").alias("first_id"), F.col("first.h").alias("first_h"))
    texts = marked(source, wanted.withColumnRenamed("first_h", "h")).join(
        wanted, F.col("id").eqNullSafe(F.col("first_id")) & (F.col("h") == F.col("first_h")))
    sets = cut(text_sets(texts.select(F.col("number").alias("id"), "text").dropDuplicates(["id"])))

    def traits_at(end: str) -> DataFrame:
        return members.select(*[F.col(c).alias(c + end) for c in ("id", "size", *traits)])

    def allowed(a: str, b: str) -> Column:
        (x, q), (y, r) = ([[F.col(n + end) for n in group] for group in names] for end in (a, b))
        return close(x, y) & sizes_allow(q, r, F.col("size" + a) + F.col("size" + b))

    stars = index.where("id > least").select(F.col("least").alias("a"), F.col("id").alias("b")).distinct()
    stars = stars.join(traits_at("_a"), F.col("a") == F.col("id_a")).join(traits_at("_b"), F.col("b") == F.col("id_b"))
    linked = components(confirm(stars.where(allowed("_a", "_b")).select("a", "b"), sets))
    found = cut(members.select("id").join(linked, "id", "left").select("id", F.coalesce("component_id", "id").alias("c")))
    index = index.select("key", "id")
    for round_ in ("leaders", "all"):
        index = remaining(index.join(found, "id"), round_ == "leaders")
        if index.isEmpty():
            break
        full = index.join(members.drop("first"), "id")
        leading = full.where("leads").select("key", *[F.col(x).alias(x + "_b") for x in ("c", "id", "size", *traits)])
        once = ~F.col("leads") | (F.col("id") < F.col("id_b"))  # two that lead meet twice
        met = met_first([F.col(x) for x in names[0]], [F.col(x + "_b") for x in names[0]], F.col("key"))
        crossing = full.join(leading, "key").where((F.col("c") != F.col("c_b")) & once & allowed("", "_b") & met).select(
            F.least("id", "id_b").alias("a"), F.greatest("id", "id_b").alias("b"), F.least("c", "c_b").alias("c"),
            F.greatest("c", "c_b").alias("c_b")).distinct()
        # links are followed between the components as they were, not between their members
        merged = components(confirm(crossing, sets).select("c", "c_b").distinct(), "c", "c_b").select(
            F.col("id").alias("c"), F.col("component_id").alias("into"))
        found = cut(found.join(merged, "c", "left").select("id", F.coalesce("into", "c").alias("c")))
        index = index.select("key", "id")
    owned = found.join(members.select("id", "first"), "id")
    firsts = owned.groupBy("c").agg(F.min("first").alias("kept_one"))
    judged_sets = owned.select("id", "c").join(firsts, "c").select("id", "kept_one")
    known = classes.select("set_hash", "id", "first").join(judged_sets, "id", "left").select(
        "set_hash", F.coalesce("kept_one", "first").alias("kept_one"))
    own = F.coalesce("kept_one", place)  # a text without words stands alone
    return rows.drop("chunks", "parity").join(known, "set_hash", "left").select(
        F.col("id").alias(key), "n_shingles", own["id"].alias("component_id"), (own == place).alias("kept"),
        F.col("h").alias("text_hash"))


def remaining(owned: DataFrame, few: bool) -> DataFrame:
    """The members (``key``, ``id``, ``c``) of keys that still hold several components, and which of them lead (``leads``).

    With ``few`` some ``LEADERS`` of a key lead; else all members outside the component that most of its members are in:
    of two members of different components one is always among these.
    """
    sizes = owned.groupBy("key", "c").agg(F.count(F.lit(1)).alias("n"))
    largest = sizes.groupBy("key").agg(
        F.sum("n").alias("n"), F.count(F.lit(1)).alias("parts"), F.max(F.struct("n", "c"))["c"].alias("main")).where("parts > 1")
    share = (F.xxhash64("id").bitwiseAND(F.lit((1 << 52) - 1)) / float(1 << 52)) * F.col("n")
    leads = share < LEADERS if few else F.col("c") != F.col("main")
    return cut(owned.join(largest.drop("parts"), "key").select("key", "id", "c", leads.alias("leads")))


def near_duplicates(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Every row's ``key`` with ``n_shingles``, ``component_id`` and ``kept``."""
    return judged(df, key, text).drop("text_hash")


@register("op9_text_near_duplicates")
def op9_text_near_duplicates(spark, sf_dir):
    return near_duplicates(table(spark, sf_dir, "documents"))
