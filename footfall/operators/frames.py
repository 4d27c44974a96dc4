"""Row filters, column selection and stacking."""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.nulls import col, quoted


def keep_rows(df: DataFrame, condition: Column, na_rows: str = "drop") -> DataFrame:
    """Rows where the condition holds.

    With ``na_rows="keep"`` a row whose condition is NULL stays, with every column NULL, which is what bracket
    subsetting of a data frame does (P12).
    """
    if na_rows == "drop":
        return df.filter(condition)
    if na_rows != "keep":
        raise ValueError("na_rows must be 'drop' or 'keep'")
    flag = "__keep"
    marked = df.withColumn(flag, condition).filter(F.col(flag).isNull() | F.col(flag))
    return marked.select(*[F.when(F.col(flag), col(c)).alias(c) for c in df.columns])


def starting_with(df: DataFrame, *prefixes: str) -> list[str]:
    """Names that begin with one of the prefixes, case ignored, in frame order (P5)."""
    low = tuple(p.lower() for p in prefixes)
    return [c for c in df.columns if c.lower().startswith(low)]


def columns_first(df: DataFrame, names: Sequence[str]) -> DataFrame:
    """The named columns first, everything else after them in its own order."""
    return df.select(*[col(c) for c in [*names, *[c for c in df.columns if c not in names]]])


def rename_by_position(df: DataFrame, old: Sequence[str], new: Sequence[str]) -> DataFrame:
    """Rename a list of columns to another list of the same length."""
    return df.withColumnsRenamed(dict(zip(old, new, strict=True)))


def to_numbers(df: DataFrame, names: Iterable[str]) -> DataFrame:
    """Text to DOUBLE; text that is no number becomes NULL."""
    return df.withColumns({c: F.expr(f"try_cast({quoted(c)} AS DOUBLE)") for c in names})


def scale_columns(df: DataFrame, names: Iterable[str], factor: Column) -> DataFrame:
    """Multiply many columns by one factor."""
    scaled = df.withColumn("__factor", factor)
    return scaled.withColumns({c: F.expr(f"{quoted(c)} * __factor") for c in names}).drop("__factor")


def stack(*frames: DataFrame) -> DataFrame:
    """Append by column name; a column missing from one frame is NULL there."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def stack_tagged(frames: Mapping[str, DataFrame], tag: str) -> DataFrame:
    """Append frames, each with its own constant in ``tag``."""
    return stack(*[df.withColumn(tag, F.lit(name)) for name, df in frames.items()])


def inline_table(spark: SparkSession, rows: Sequence[tuple], schema) -> DataFrame:
    """A literal table."""
    return spark.createDataFrame(list(rows), schema)


def top_rows(df: DataFrame, *order: Column, n: int = 6) -> DataFrame:
    """First n rows of an explicit order; planned as a distributed top-k, not a full sort."""
    return df.orderBy(*order).limit(n)


def shape(df: DataFrame) -> tuple[int, int]:
    return df.count(), len(df.columns)


def with_row(df: DataFrame, one_row: DataFrame) -> DataFrame:
    """Every column of a one-row frame on every row of ``df``.

    The row is a scalar subquery: it is computed once and enters the projection as a constant, without a join.
    """
    params = one_row.select(F.struct(*[col(c) for c in one_row.columns])).scalar()
    # One column holds the subquery, so that it is planned once and not once per parameter.
    held = df.withColumn("__row", params)
    return held.withColumns({c: F.col("__row")[c] for c in one_row.columns}).drop("__row")


def in_box(df: DataFrame, box: tuple[float, float, float, float]) -> DataFrame:
    """Rows whose extent meets the box, touching edges included.

    Plain comparisons on the stored columns, so they reach the Parquet row-group filter.
    """
    xmin, ymin, xmax, ymax = box
    return df.filter(
        (F.col("xmax") >= xmin) & (F.col("xmin") <= xmax) & (F.col("ymax") >= ymin) & (F.col("ymin") <= ymax)
    )
