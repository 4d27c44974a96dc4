"""CSV and Parquet tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.nulls import col


def read_csv(spark: SparkSession, path, schema: T.StructType) -> DataFrame:
    """The declared columns of a CSV with a header row; ``NA`` and empty text are NULL, as is text of another type.

    Columns are found by their header names, in any order and among others. A missing name is an error, and so is a folder
    whose files have different headers.
    """
    df = spark.read.option("header", True).option("nullValue", "NA").option("enforceSchema", False).csv(path)
    missing = [f.name for f in schema if f.name not in df.columns]
    if missing:
        raise ValueError(f"no column {', '.join(missing)} in the header")
    return df.select(*[col(f.name).try_cast(f.dataType).alias(f.name) for f in schema])


#: Texts that count as a missing value, and the kinds of column from narrow to wide. A missing value fits every kind.
MISSING, KINDS = ("NA", ""), ("boolean", "int", "bigint", "double", "date", "string")
_TESTS = {
    "boolean": r"^(T|F|TRUE|FALSE|true|false)$",
    "bigint": r"^[+-]?[0-9]{1,18}$",
    "double": r"^[+-]?(([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?|Inf|inf|NaN)$",
    "date": r"^[0-9]{4}-[0-9]{1,2}-[0-9]{1,2}$",
}


def _texts(spark: SparkSession, path) -> DataFrame:
    """A CSV with a header row as text, missing values as NULL, blanks around a value left out."""
    df = spark.read.option("header", True).option("enforceSchema", False).csv(path)
    trimmed = {c: F.trim(col(c)) for c in df.columns}
    return df.select(*[F.when(~v.isin(*MISSING), v).alias(c) for c, v in trimmed.items()])


def _value(c: str, kind: str) -> Column:
    """A text column as values of a kind; NULL where the text is of another."""
    v = col(c)
    if kind == "boolean":
        return F.when(v.rlike(_TESTS["boolean"]), F.upper(v).isin("T", "TRUE"))
    if kind == "date":
        return F.when(v.rlike(_TESTS["date"]), F.try_to_date(v, "yyyy-M-d"))
    if kind == "double":
        word = F.when(F.lower(v).contains("inf"), F.concat(F.regexp_extract(v, "^[+-]?", 0), F.lit("Infinity"))).otherwise(v)
        return F.when(v.rlike(_TESTS["double"]), word.try_cast("double"))
    return F.when(v.rlike(_TESTS["bigint"]), v.try_cast(kind)) if kind != "string" else v


def csv_types(spark: SparkSession, path) -> DataFrame:
    """One row a column of a CSV: ``place``, ``name``, inferred ``type``, and how many values it has and lacks.

    The type is the narrowest kind that all values fit: logical, integer, double, date, text; a number that no int holds
    widens an integer column to bigint. A column without values is logical. Each task counts what fits in its rows, and
    only the counts are merged, so all rows decide and the files may be split.
    """
    df = _texts(spark, path)
    counts = [F.count(F.lit(1)).alias("n")]
    for i, c in enumerate(df.columns):
        counts += [F.count(_value(c, k)).alias(f"{k}{i}") for k in KINDS]
    row = df.agg(*counts)
    each = [
        F.struct(
            F.lit(i).alias("place"), F.lit(c).alias("name"),
            F.coalesce(*[F.when(F.col(f"{k}{i}") == F.col(f"string{i}"), F.lit(k)) for k in KINDS]).alias("type"),
            F.col(f"string{i}").alias("n_values"), (F.col("n") - F.col(f"string{i}")).alias("n_missing"))
        for i, c in enumerate(df.columns)
    ]
    return row.select(F.inline(F.array(*each)))


def read_csv_inferred(spark: SparkSession, path) -> DataFrame:
    """A CSV with the types of ``csv_types``: one pass to find them, one to read."""
    kinds = csv_types(spark, path).orderBy("place").collect()
    return _texts(spark, path).select(*[_value(r["name"], r["type"]).alias(r["name"]) for r in kinds])


def csv_problems(spark: SparkSession, path, schema: T.StructType) -> DataFrame:
    """For each declared column of a CSV, ``n_bad`` values that are not of its type (``read_csv`` makes them NULL) and one of them."""
    df = _texts(spark, path)
    bad = {f.name: F.when(col(f.name).try_cast(f.dataType).isNull(), col(f.name)) for f in schema}
    row = df.agg(*[g(v).alias(f"{n}{i}") for i, v in enumerate(bad.values()) for n, g in (("n", F.count), ("e", F.min))])
    each = [
        F.struct(F.lit(c).alias("name"), F.col(f"n{i}").alias("n_bad"), F.col(f"e{i}").alias("example")) for i, c in enumerate(bad)
    ]
    return row.select(F.inline(F.array(*each)))


def write_csv(df: DataFrame, path: str) -> None:
    """A folder of CSV part files with headers, written by all tasks; NULL is written as ``NA``."""
    df.write.mode("overwrite").option("header", True).option("nullValue", "NA").csv(path)


def read_parquet(spark: SparkSession, path) -> DataFrame:
    return spark.read.parquet(path)


def write_parquet(df: DataFrame, path: str, partition_by: tuple[str, ...] = ()) -> None:
    """Hand-over between jobs; ``partition_by`` gives directories that later reads prune."""
    df.write.mode("overwrite").partitionBy(*partition_by).parquet(path)
