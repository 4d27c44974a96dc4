"""Monthly training frame over complete years (C4)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import codes, dates
from ..names import numbered
from ..operators.groups import complete_groups, rows_with_key_in, wide_counts

EDU_FEATURES = numbered("edu", 9)
HHSIZE_FEATURES = numbered("hhsize", 6)
INCOME_FEATURES = numbered("income", 16)

# The regressors of the demand model. The household sizes add up to the label in every month, because
# each visit has a size of one or more; the fit therefore reproduces the training months almost by construction.
MODEL_FEATURES = [
    "edu1", "edu3", "edu4", "edu7", "edu8", "edu9",
    *HHSIZE_FEATURES,
    *numbered("income", 15),
]


def complete_years(first_visit: DataFrame, date_column: str = "clean_date") -> DataFrame:
    """Years in which all 12 months occur."""
    dated = first_visit.filter(F.col(date_column).isNotNull())
    return complete_groups(dated, F.year(date_column), F.month(date_column), 12, "year")


def in_complete_years(first_visit: DataFrame, date_column: str = "clean_date") -> DataFrame:
    """Rows of complete years, by semi join (J7); the years of a calendar are few, so the rows need no shuffle."""
    dated = first_visit.withColumn("year", F.year(date_column))
    return rows_with_key_in(dated, complete_years(first_visit, date_column), "year", bounded=True)


def monthly_training(first_visit: DataFrame, min_date: str | None = None) -> DataFrame:
    """One row per month of a complete year: visits, food-stamp share and 31 conditional counts.

    The table is read once: months are aggregated first (a few dozen partial rows leave each task), and incomplete years
    are dropped from the monthly rows. A year is made of whole months, so the order does not matter to the result.
    """
    if min_date is not None:
        first_visit = first_visit.filter(F.col("clean_date") > F.lit(min_date).cast("date"))
    rows = first_visit.filter(F.col("clean_date").isNotNull()).select(
        dates.month_floor("clean_date").alias("month_start"),
        codes.yes_flag("foodstamps").alias("__yes"),
        F.col("education_numeric").alias("__edu"),
        F.col("householdMembers").alias("__size"),
        codes.bracket_number("annualIncome").alias("__bracket"),
    )
    months = rows.groupBy("month_start").agg(
        F.count(F.lit(1)).alias("pantry_visits"),
        F.avg("__yes").alias("avg_foodstamps"),
        *codes.counts_by_code("__edu", range(1, 10), "edu"),
        *codes.counts_by_code("__size", range(1, 7), "hhsize", open_end=True),
        *codes.counts_by_code("__bracket", range(1, 17), "income"),
    )
    in_year = F.count(F.lit(1)).over(Window.partitionBy(F.year("month_start")))
    return months.withColumn("__months", in_year).filter(F.col("__months") == 12).drop("__months")


def education_by_month(first_visit: DataFrame) -> DataFrame:
    """Visits of complete years by month and education code, one column per code, NULL for none."""
    rows = in_complete_years(first_visit).filter(
        F.col("clean_date").isNotNull() & F.col("education_numeric").isNotNull()
    ).select(dates.month_floor("clean_date").alias("month_start"), "education_numeric")
    return wide_counts(rows, "month_start", "education_numeric", list(range(1, 10)), "edu").orderBy("month_start")
