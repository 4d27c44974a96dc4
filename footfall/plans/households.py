"""One row per household: best education, race and ethnicity rule, ZIP counts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.nulls import first_by, if_else, is_in, one_or_multi
from ..operators.groups import first_per_group, left_join


def best_education_visit(visit: DataFrame) -> DataFrame:
    """The visit with the highest education code; earliest date, then income and label on a tie."""
    ties = [F.asc_nulls_last(c) for c in ("served_date", "annual_income", "education")]
    return first_per_group(visit, ["afn"], F.desc_nulls_last("education_numeric"), *ties)


def race_table(persons: DataFrame, override: bool = True) -> DataFrame:
    """One race per household or "Multi" (A11); with ``override``, Hispanic households of unknown or other race are
    named "Hispanic/Latino" (F7). The ethnicity is that of the earliest person row, the lowest label on one date (A9)."""
    order = [c for c in ("served_date",) if c in persons.columns]
    table = persons.groupBy("afn").agg(
        one_or_multi("race").alias("race"), first_by("ethnicity", *order).alias("ethnicity")
    )
    if override:
        hispanic = (F.col("ethnicity") == "Hispanic or Latino") & is_in("race", ["Unknown", "Other"])
        table = table.withColumn("race", if_else(hispanic, "Hispanic/Latino", F.col("race")))
    return table.drop("ethnicity")


def household_table(visit: DataFrame, persons: DataFrame, na_matches: bool = False) -> DataFrame:
    """Best-education visit of each household with its race."""
    return left_join(best_education_visit(visit), race_table(persons), "afn", na_matches)


def households_by_zip(households: DataFrame, first: int | None = None, last: int | None = None) -> DataFrame:
    """Households per ZIP code, of all years or of ``first..last``, either of which may be left open."""
    if first is not None:
        households = households.filter(F.col("served_year") >= first)
    if last is not None:
        households = households.filter(F.col("served_year") <= last)
    return households.groupBy("zip").agg(F.count(F.lit(1)).alias("count"))
