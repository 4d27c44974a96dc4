"""Dense row numbers in a given order without sorting the table in one task."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.nulls import col
from .reuse import fixed

#: Rows of a copied row that one task numbers at a time.
CHUNK = 100_000


def row_ids(df: DataFrame, order: Sequence[str | Column], name: str = "id") -> DataFrame:
    """Adds ``name``: 1..n in the order of ``order`` and then of all columns, so that only exact copies are interchangeable.

    Copies are merged and counted. The distinct rows are dealt into ranges by a sample of the order, each range is sorted by
    itself, and the counts of the ranges give the number that each starts with. The numbers do not depend on how many ranges
    there are or on the partitioning of ``df``. A row with very many copies is numbered by several tasks.
    """
    spark = df.sparkSession
    keys = [c if isinstance(c, Column) else col(c).asc_nulls_last() for c in order]
    rest = [col(c).asc_nulls_last() for c in df.columns]
    merged = df.groupBy(*[col(c) for c in df.columns]).agg(F.count(F.lit(1)).alias("__n"))
    ranges = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = merged.repartitionByRange(ranges, *keys, *rest).sortWithinPartitions(*keys, *rest).withColumns(
        {"__range": F.spark_partition_id(), "__place": F.monotonically_increasing_id()})
    rows = fixed(dealt)  # the ranges must be those that are counted
    total = 0
    starts = []
    for r in rows.groupBy("__range").agg(F.sum("__n").alias("n")).orderBy("__range").collect():
        starts.append((r["__range"], total))
        total += r["n"]
    offsets = F.broadcast(spark.createDataFrame(starts, "__range int, __start long"))
    before = F.sum("__n").over(Window.partitionBy("__range").orderBy("__place").rowsBetween(Window.unboundedPreceding, 0))
    placed = rows.join(offsets, "__range").withColumn("__first", F.col("__start") + before - F.col("__n"))
    chunk = F.explode(F.sequence(F.lit(0).cast("long"), F.col("__n") - 1, F.lit(CHUNK).cast("long")))
    single, copied = placed.where("__n = 1"), placed.where("__n > 1")
    parts = copied.withColumn("__at", chunk).repartition(ranges, "__first", "__at")
    last = F.least(F.col("__n"), F.col("__at") + CHUNK) - 1
    many = parts.withColumn("__k", F.explode(F.sequence(F.col("__at"), last)))
    names = [col(c) for c in df.columns]
    return single.select(*names, (F.col("__first") + 1).alias(name)).union(
        many.select(*names, (F.col("__first") + F.col("__k") + 1).alias(name)))
