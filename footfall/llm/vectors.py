"""Embedding near-dedup (operator 7): sign hashes in several tables, exact cosine, connected components.

Equal vectors of one label are one class, so copies are never paired with each other. Class representatives meet where the
signs of their products with ``bits`` random hyperplanes agree in one of ``tables`` tables; every pair that meets is compared
by cosine in double precision. The number of bits follows from the number of vectors (buckets stay small), the number of
tables from the wanted recall at the threshold.

Defined results: vectors that are null, empty, zero or hold null or non-finite components, and rows without a label, link
with nothing; vectors of different length are not compared; ``n_links`` counts rows, copies included; rows with equal ids
are separate vectors, so an id may be in several components and be kept in each whose smallest id it is; rows without id take
part, are never the smallest, and are kept where their component has no id at all; an empty table gives an empty result.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import cut, table
from .components import components
from .registry import register

THRESHOLD = 0.98
#: Chance that a pair exactly at the threshold meets in no table.
MISSED = 1e-6
SEED = 20240607


def parameters(rows: int, threshold: float = THRESHOLD, missed: float = MISSED) -> tuple[int, int]:
    """(bits, tables): as many bits as the rows have doublings, so that a bucket holds about one of evenly spread vectors, 16 to
    28; tables by the wanted recall."""
    bits = min(28, max(16, math.ceil(math.log2(max(rows, 1)))))
    together = (1 - math.acos(threshold) / math.pi) ** bits
    return bits, math.ceil(math.log(missed) / math.log(1 - together))


def sign_hashes(df: DataFrame, vector: str, bits: int, tables: int, seed: int = SEED) -> DataFrame:
    """Adds ``hashes``: a number a table, from the signs of products with random hyperplanes."""
    schema = T.StructType([*df.schema, T.StructField("hashes", T.ArrayType(T.LongType()))])
    names = [*df.columns, "hashes"]
    place = df.columns.index(vector)

    def run(batches):
        planes: dict[int, np.ndarray] = {}
        weights = 1 << np.arange(bits, dtype=np.int64)
        for batch in batches:
            found = batch.column(place)
            values = found.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
            sizes = np.diff(found.offsets.to_numpy())
            starts = np.cumsum(sizes) - sizes
            codes = np.zeros((len(sizes), tables), np.int64)
            for size in np.unique(sizes):
                at = np.flatnonzero(sizes == size)
                if size not in planes:
                    planes[size] = np.random.default_rng([seed, int(size)]).standard_normal((int(size), bits * tables))
                signs = values[starts[at][:, None] + np.arange(size)] @ planes[size] > 0
                codes[at] = signs.reshape(len(at), tables, bits) @ weights
            hashes = pa.ListArray.from_arrays(
                pa.array(np.arange(0, len(sizes) * tables + 1, tables, dtype=np.int32)), pa.array(codes.ravel()))
            yield pa.RecordBatch.from_arrays([*batch.columns, hashes], names=names)

    return df.mapInArrow(run, schema)


def dot(a: str, b: str) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda p, q: p * q), F.lit(0.0), lambda s, p: s + p)


def near_vectors(
    df: DataFrame, key: str = "vec_id", vector: str = "embedding", label: str = "label", threshold: float = THRESHOLD,
    missed: float = MISSED,
) -> DataFrame:
    """Every row's ``key`` with ``n_links``, ``component_id`` and ``kept``."""
    rows = df.select(
        F.col(f"`{key}`").alias("id"), F.col(f"`{label}`").alias("label"),
        F.col(f"`{vector}`").cast("array<double>").alias("vector"))
    finite = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    usable = F.coalesce(F.col("label").isNotNull() & finite & F.exists("vector", lambda x: x != 0), F.lit(False))
    rows = rows.withColumn("class", F.when(usable, F.sha2(F.to_json(F.struct("label", "vector")), 256)))
    merged = rows.where("class is not null").groupBy("class").agg(
        F.min("id").alias("rep"), F.count(F.lit(1)).alias("n"), F.first("label").alias("label"), F.first("vector").alias("vector"))
    # Classes have numbers of their own, as ids may be null or repeat; they are fixed once written, and so is each norm.
    classes = cut(merged.withColumns({"number": F.monotonically_increasing_id(), "norm": F.sqrt(dot("vector", "vector"))}))
    bits, tables = parameters(classes.count(), threshold, missed)
    hashed = sign_hashes(classes.select("number", "label", "vector"), "vector", bits, tables)
    keys = hashed.select("number", "label", F.posexplode("hashes").alias("t", "hash"))
    other = keys.withColumnRenamed("number", "other")
    pairs = keys.join(other, ["label", "t", "hash"]).where(F.col("number") < F.col("other")).select("number", "other").distinct()
    vectors = classes.select("number", "n", "vector", "norm")
    right = vectors.select(*[F.col(c).alias(f"{c}2") for c in vectors.columns])
    links = cut(
        pairs.join(vectors, "number").join(right, F.col("other") == F.col("number2"))
        .where((F.size("vector") == F.size("vector2")) & (dot("vector", "vector2") / (F.col("norm") * F.col("norm2")) >= threshold))
        .select("number", "n", "other", "n2"))
    both = links.select("number", F.col("n2").alias("n")).union(links.select("other", "n"))
    counts = both.groupBy("number").agg(F.sum("n").alias("others"))
    found = components(links, "number", "other").select(F.col("id").alias("number"), F.col("component_id").alias("c"))
    known = classes.select("class", "number", "rep", "n").join(counts, "number", "left").join(found, "number", "left").select(
        "class", "rep", (F.col("n") - 1 + F.coalesce("others", F.lit(0))).alias("n_links"), F.coalesce("c", "number").alias("c"))
    least = known.groupBy("c").agg(F.min("rep").alias("component_id"))  # null where no row of it has an id
    known = known.join(least, "c").select("class", "n_links", "component_id")
    out = rows.select("id", "class").join(known, "class", "left")
    own = F.when(F.col("n_links").isNull(), F.col("id")).otherwise(F.col("component_id"))
    return out.select(
        F.col("id").alias(key), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), own.alias("component_id"),
        F.col("id").eqNullSafe(own).alias("kept"))


@register("op7_vector_near_duplicates")
def op7_vector_near_duplicates(spark, sf_dir):
    return near_vectors(table(spark, sf_dir, "embeddings"))
