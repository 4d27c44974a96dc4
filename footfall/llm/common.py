"""What the operators of this subpackage share: reading tables, cutting lineage, and per-row work over whole texts."""

from __future__ import annotations

import tempfile
from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.reuse import checkpoint_dir

#: Bytes of text that one call of a per-row function gets; a longer text comes alone and whole.
SLICE_BYTES = 4 << 20


#: Entries of one generation of a ``Remembered``, of which there are two; a worker keeps them while other operators run there.
REMEMBERED = 100_000


class Remembered(dict):
    """Values by key, made when first asked for. What was not asked for during a whole generation is forgotten."""

    def __init__(self, make: Callable) -> None:
        super().__init__()
        self.make, self.old = make, {}

    def __missing__(self, key):
        value = self.old.get(key)
        if value is None:
            value = self.make(key)
        if len(self) >= REMEMBERED:
            self.old = dict(self)
            self.clear()
        self[key] = value
        return value


class Strings(NamedTuple):
    """Texts by their blank-separated strings: the distinct ones, their numbers in order, and where each text begins."""

    strings: pa.Array
    codes: np.ndarray
    offsets: np.ndarray


def by_string(texts: pa.Array, apart: str | None = None) -> Strings:
    """Texts in lower case, split at ASCII blanks and around matches of ``apart``.

    Blanks at the ends of a text give an empty string each.
    """
    texts = pc.utf8_lower(texts)
    words = pc.ascii_split_whitespace(pc.replace_substring_regex(texts, apart, r" \1 ") if apart else texts)
    coded = words.flatten().dictionary_encode()
    return Strings(coded.dictionary, coded.indices.to_numpy(), words.offsets.to_numpy())


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that ``spark.checkpoint.dir`` names.

    Where that setting is missing, a folder is made up for a local master only; on a cluster it would not be shared.
    """
    folder = checkpoint_dir(spark)
    if not folder and not spark.sparkContext.getCheckpointDir():
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="checkpoint-"))
    return folder or spark.sparkContext.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """The frame written once to the shared folder, and read from there by all later jobs."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def without(df: DataFrame, names: list[str]) -> DataFrame:
    """The frame without columns of these names, in either case."""
    low = {n.lower() for n in names}
    return df.select(*[F.col(f"`{c}`") for c in df.columns if c.lower() not in low])


def slices(sizes: list[int], most: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of consecutive rows of at most ``most`` bytes together, or of one row."""
    start, total = 0, 0
    for i, n in enumerate(sizes):
        if i > start and total + n > most:
            yield start, i
            start, total = i, 0
        total += n
    if start < len(sizes):
        yield start, len(sizes)


def map_texts(
    df: DataFrame, fn: Callable, fields: list[T.StructField], text: str = "text", keep: list[str] | None = None,
    most: int = SLICE_BYTES, arrow: bool = False,
) -> DataFrame:
    """Columns ``keep`` (default: all) and ``fields``, which ``fn`` makes from the texts.

    ``fn()`` is called once a task and returns a function from a list of texts (null: None) to the list of columns, each as
    Arrow array or list. With ``arrow`` it gets the Arrow array of the texts. Columns of ``keep`` that are called like a result are replaced by it.
    A worker serves many tasks, so memory that a batch needed is given back after it.
    """
    names = [f.name for f in fields]
    low = {n.lower() for n in names}
    kept = [c for c in (df.columns if keep is None else keep) if c.lower() not in low]
    source = df.select(*[F.col(f"`{c}`") for c in kept], F.col(f"`{text}`").cast("string").alias("__text"))
    schema = T.StructType([*[source.schema[c] for c in kept], *fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        target = to_arrow_schema(schema)
        work = fn()

        def made_of(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
            texts = batch.column(len(kept))
            sizes = pc.fill_null(pc.binary_length(texts), 0).to_pylist()
            for a, b in slices(sizes, most):
                part = texts.slice(a, b - a)
                made = work(part if arrow else part.to_pylist())
                columns = [batch.column(i).slice(a, b - a) for i in range(len(kept))]
                results = [
                    x if isinstance(x, pa.Array) else pa.array(x, type=target.field(len(kept) + j).type)
                    for j, x in enumerate(made)
                ]
                yield pa.RecordBatch.from_arrays([*columns, *results], names=[*kept, *names])

        for batch in batches:
            yield from made_of(batch)
            del batch
            pa.default_memory_pool().release_unused()

    return source.mapInArrow(run, schema)
