"""Keeping an intermediate result that several jobs read."""

from __future__ import annotations

import tempfile
from contextlib import contextmanager
from uuid import uuid4

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession


def checkpoint_dir(spark: SparkSession) -> str | None:
    """The shared folder named by the session's ``spark.checkpoint.dir``, if any. No folder is ever invented here."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or None
    if folder and not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(folder)
    return folder


@contextmanager
def persisted(df: DataFrame):
    """The frame cached for the length of a ``with`` block; lost blocks are recomputed."""
    kept = df.persist(StorageLevel.MEMORY_AND_DISK)
    try:
        yield kept
    finally:
        kept.unpersist()


@contextmanager
def held(df: DataFrame):
    """The result of a long computation for repeated reading inside a ``with`` block.

    With a checkpoint folder the rows are written there once, so a lost executor costs a file read and not the whole
    computation. Without one they are cached.
    """
    if checkpoint_dir(df.sparkSession):
        yield df.checkpoint(eager=True)
    else:
        with persisted(df) as kept:
            yield kept


def scratch_folder(spark: SparkSession) -> str:
    """A folder that all executors share: ``spark.checkpoint.dir``, or on a local master one of its own."""
    folder = checkpoint_dir(spark) or spark.sparkContext.getCheckpointDir()
    if not folder:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="footfall-")
    return folder


def written_once(df: DataFrame) -> DataFrame:
    """The frame read back from the session's checkpoint folder, for results that several later jobs start from.

    Without such a folder the frame is returned as it is, and each job computes it again.
    """
    return df.checkpoint(eager=True) if checkpoint_dir(df.sparkSession) else df


def fixed(df: DataFrame) -> DataFrame:
    """The frame written once, whatever the session names, so that what depends on the run (numbers of partitions) stays."""
    if checkpoint_dir(df.sparkSession):
        return df.checkpoint(eager=True)
    folder = f"{scratch_folder(df.sparkSession)}/fixed-{uuid4().hex}"
    df.write.parquet(folder)
    return df.sparkSession.read.parquet(folder)
