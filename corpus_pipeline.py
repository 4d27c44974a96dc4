"""A corpus from raw documents to packed token sequences.

Five stages, each a function of (spark, docs, sf_dir) that reads the ``documents`` columns its predecessor kept: toxic
documents go, later copies of line runs go, one document of each group of near-duplicates stays, secrets are masked, and
what is left is packed. Columns other than the text are carried along; ``n_chars`` follows the text.

Defined results: documents with null text pass all filters and are packed as an empty document each; a document that loses
all of its lines as copies is dropped, one that had no words before stays; rows with equal or null ids are judged by their
texts; an empty table gives an empty result.
"""

from __future__ import annotations

from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from footfall.llm import common, line_dedup, near_texts, packing, secrets, toxicity

#: The model of the first stage and the packing of the last cannot be written in SQL; tests compare with brute force.
ORACLE_SQL = None


def like_documents(df: DataFrame, docs: DataFrame) -> DataFrame:
    """The columns of ``docs``, with ``n_chars`` (where there is one) counted anew."""
    out = df.select(*[F.col(f"`{c}`") for c in docs.columns])
    if "n_chars" not in docs.columns:
        return out
    kind = docs.schema["n_chars"].dataType
    return out.withColumn("n_chars", F.length("text").cast(kind))


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose chance of being toxic is below one half; the model is fitted on the labelled ones."""
    model = toxicity.train(docs, common.table(spark, sf_dir, "labels"))
    names = {c: f"__{i}" for i, c in enumerate(docs.columns)}  # columns may be called like the results
    hidden = docs.select(*[F.col(f"`{c}`").alias(n) for c, n in names.items()])
    kept = toxicity.score(hidden, model, names["text"]).where(F.col("p_toxic") < toxicity.REJECT)
    return kept.select(*[F.col(n).alias(c) for c, n in names.items()])


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the line runs that an earlier place holds; those that lose every line are dropped."""
    names = {c: f"__{i}" for i, c in enumerate(docs.columns)}
    hidden = docs.select(*[F.col(f"`{c}`").alias(n) for c, n in names.items()])
    short = line_dedup.dedup_lines(hidden, names["doc_id"], names["text"])
    kept = short.where((F.col("n_removed") == 0) | (F.col("n_removed") < F.col("n_lines")))
    return like_documents(kept.select(*[F.col(n).alias(c) for c, n in names.items()]), docs)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays, the one with the smallest id (null last); of rows with equal id and text one stays."""
    found = near_texts.judged(docs).where("kept").select(F.col("doc_id").alias("__id"), F.col("text_hash").alias("__h")).distinct()
    same = F.col("doc_id").eqNullSafe(F.col("__id")) & (F.xxhash64(F.col("text").cast("string")) == F.col("__h"))
    kept = docs.join(found, same, "left_semi")
    words = F.length(F.trim(F.coalesce("text", F.lit(""))))
    some, none = kept.where(words > 0).dropDuplicates(["doc_id", "text"]), kept.where(words == 0)
    return some.unionByName(none).select(*[F.col(f"`{c}`") for c in docs.columns])


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with a mark in place of each secret."""
    return like_documents(secrets.redact(docs), docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row a piece of at most 2048 tokens, with its sequence and its place there."""
    return packing.pack(packing.pieces(docs, packing.vocabulary(), keep=["doc_id"]))


STAGES = [
    ("toxicity", drop_toxic),
    ("line dedup", drop_repeated_lines),
    ("near-duplicates", drop_near_duplicates),
    ("secrets", mask_secrets),
    ("packing", pack_sequences),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written as Parquet to the shared checkpoint folder and read by the next."""
    docs = common.table(spark, sf_dir, "documents")
    folder = f"{common.shared_folder(spark)}/pipeline-{uuid4().hex}"
    for i, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{i}")
        docs = spark.read.parquet(f"{folder}/{i}")
    return docs
