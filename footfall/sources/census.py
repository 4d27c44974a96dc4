"""Census responses landed as files: a JSON array of arrays whose first row is the header.

Files are split at the brackets that end their rows, so a large response is read by several tasks. A response given as a
column is one value.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.nulls import col
from ..names import COUNT_CODES, ZIP_COLUMN
from ..operators.frames import to_numbers

CELLS = "array<array<string>>"


def response_rows(responses: DataFrame, names: Sequence[str], text: str = "value") -> DataFrame:
    """Data rows of JSON responses with the named columns as text; other columns of ``responses`` are kept.

    A column is found by its position in the header of its own response, so responses may order their columns
    differently; a name missing from a header gives NULL.
    """
    rest = [c for c in responses.columns if c != text]
    parsed = responses.select(*[col(c) for c in rest], F.from_json(col(text), CELLS).alias("__rows"))
    headed = parsed.select(
        *[col(c) for c in rest], F.col("__rows")[0].alias("__head"), F.posexplode("__rows").alias("__pos", "__cells")
    ).filter(F.col("__pos") > 0)
    cells = [
        F.get("__cells", F.array_position("__head", F.lit(n)).cast("int") - 1).alias(n) for n in names
    ]
    return headed.select(*[col(c) for c in rest], *cells)


def acs_table(responses: DataFrame, text: str = "value") -> DataFrame:
    """``acs_raw``: name, the 41 counts as numbers, ``zip`` and whatever else ``responses`` carries, such as ``year``."""
    rows = response_rows(responses, ["NAME", *COUNT_CODES, ZIP_COLUMN], text)
    return to_numbers(rows, COUNT_CODES).withColumnRenamed(ZIP_COLUMN, "zip")


YEAR = r"(\d{4})\D*$"


def _texts(spark: SparkSession, path, pattern: str, years: Sequence[int] | None, **options) -> DataFrame:
    """``value, file, year`` of text files, of ``years`` only: by their folders ``year=...`` or else by their names."""
    texts = spark.read.text(path, **options)
    year, file = F.col("year"), F.col("_metadata.file_path").alias("file")
    if "year" not in texts.columns:
        if years is not None:
            names = "*{" + ",".join(str(int(y)) for y in years) + "}*"
            texts = spark.read.text(path, pathGlobFilter=names, **options)
        year = F.regexp_extract(F.col("_metadata.file_name"), pattern, 1).try_cast("int")
    if years is not None:
        texts = texts.where(year.isin([int(y) for y in years]))
    return texts.select("value", file, year.alias("year"))


def read_responses(spark: SparkSession, path, year_pattern: str = YEAR, years: Sequence[int] | None = None) -> DataFrame:
    """``value, year`` of one file per year (S4), the year from the folder ``year=...`` or the last four digits in the file name."""
    return _texts(spark, path, year_pattern, years, wholetext=True).select("value", "year")


def read_rows(
    spark: SparkSession, path, names: Sequence[str], year_pattern: str = YEAR, years: Sequence[int] | None = None
) -> DataFrame:
    """Data rows of the response files under ``path`` with the named columns as text, and their ``year``.

    A file is cut at each closing bracket, so its parts are read by as many tasks as it has splits; the header row of each file
    reaches its parts by a join. A bracket inside a quoted cell leaves an odd number of quotes before it: files where that
    occurs are found first and read as one value each. With ``years`` other files are not read.
    """
    parts = _texts(spark, path, year_pattern, years, lineSep="]")
    plain = F.regexp_replace("value", r"\\.", "")
    odd = (F.length(plain) - F.length(F.replace(plain, F.lit('"'), F.lit("")))) % 2 == 1
    whole = sorted(r[0] for r in parts.where(odd).select("file").distinct().collect())
    cut = parts.where(~F.col("file").isin(whole)) if whole else parts
    cells = F.from_json(F.concat(F.regexp_replace("value", r"^\s*,?\s*(\[\s*(?=\[))?", ""), F.lit("]")), "array<string>")
    rows = cut.where(F.col("value").contains("[")).select(
        "file", "year", F.col("value").rlike(r"^\s*\[\s*\[").alias("first"), cells.alias("cells"))
    heads = rows.where("first").select("file", F.col("cells").alias("head"))
    found = rows.where("not first").join(heads, "file").select("year", *[
        F.get("cells", F.array_position("head", F.lit(n)).cast("int") - 1).alias(n) for n in names])
    if not whole:
        return found
    rest = _texts(spark, path, year_pattern, years, wholetext=True).where(F.col("file").isin(whole)).select("value", "year")
    return found.unionByName(response_rows(rest, names))


def read_acs(spark: SparkSession, path, year_pattern: str = YEAR, years: Sequence[int] | None = None) -> DataFrame:
    """``acs_raw`` from response files, read in parts."""
    rows = read_rows(spark, path, ["NAME", *COUNT_CODES, ZIP_COLUMN], year_pattern, years)
    return to_numbers(rows, COUNT_CODES).withColumnRenamed(ZIP_COLUMN, "zip")
