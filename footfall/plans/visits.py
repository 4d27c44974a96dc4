"""From person rows to visits, first visits and counts over time.

Two exports are handled. In the first a household is ``houseHoldIdAfn`` and education is on the 1-9 scale; in the second
it is ``afn``, with ZIP code and 0-11 scale.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import codes, dates
from ..functions.nulls import col, n_distinct, strict_sum
from ..operators.frames import keep_rows, stack_tagged
from ..operators.groups import first_per_group, flag_group_min

HOUSEHOLD = "houseHoldIdAfn"
VISIT_KEYS = [HOUSEHOLD, "householdMembers", "foodstamps", "clean_date", "annualIncome", "education"]
VISIT_KEYS_V8 = ["afn", "served_date", "annual_income", "education"]


def clean_visits(persons: DataFrame, after: str | None = "2020-01-31", date_column: str = "servedDate",
                 forms: Sequence[tuple[str, str | None]] = dates.ISO, na_rows: str = "drop") -> DataFrame:
    """Parsed ``clean_date``; rows dated on or before ``after`` removed."""
    dated = persons.withColumn("clean_date", dates.parse_date(date_column, forms))
    if after is None:
        return dated
    return keep_rows(dated, F.col("clean_date") > F.lit(after).cast("date"), na_rows)


def clean_visits_v8(persons: DataFrame, na_rows: str = "drop") -> DataFrame:
    """Parsed dates of the second export; rows with a negative income removed."""
    parsed = persons.withColumns({c: dates.parse_date(c, dates.YMD) for c in ("served_date", "dob")})
    return keep_rows(parsed, F.col("annual_income") >= 0, na_rows)


def count_negative(df: DataFrame, column: str, name: str = "n_negative") -> DataFrame:
    """How many values are below zero."""
    return df.agg(F.count_if(col(column) < 0).alias(name))


def first_visit_table(persons: DataFrame, first_within: str = "household") -> DataFrame:
    """Person rows to household visits with size, date parts, education code and first-visit flag.

    ``householdMembers`` becomes the number of person rows; the key it replaces stays as ``householdMembers_key``. The
    flag compares with the household's earliest date; ``first_within="visit"`` compares inside the visit's own group,
    where every dated row is its own first.
    """
    if first_within not in ("household", "visit"):
        raise ValueError("first_within must be 'household' or 'visit'")
    sized = (
        persons.withColumnRenamed("householdMembers", "householdMembers_key")
        .groupBy(*["householdMembers_key" if k == "householdMembers" else k for k in VISIT_KEYS])
        .agg(F.count(F.lit(1)).alias("householdMembers"))
    )
    if first_within == "household":
        flagged = flag_group_min(sized, [HOUSEHOLD], "clean_date", "first_visit", within=persons)
    else:
        flagged = sized.withColumn("first_visit", F.when(F.col("clean_date").isNotNull(), F.lit(1)))
    return flagged.withColumns(
        {**dates.date_parts("clean_date"), "education_numeric": codes.code_of("education", codes.EDUCATION_1_9)}
    ).select(
        HOUSEHOLD, "householdMembers_key", "householdMembers", "foodstamps", "clean_date", "annualIncome", "education",
        "served_year", "served_month", "served_day_of_month", "first_visit", "education_numeric",
    )


def first_time_table(first_visit: DataFrame, ties: Sequence[str] = ()) -> DataFrame:
    """Each household's earliest visit; equal dates are decided by the group keys in order, NULLs last.

    The keys are unique in a table made by ``first_visit_table``; for other visits ``ties`` names further columns.
    """
    order = ["clean_date", "householdMembers_key", "foodstamps", "annualIncome", "education", *ties]
    return first_per_group(first_visit, [HOUSEHOLD], *[F.asc_nulls_last(c) for c in order])


def count_by(df: DataFrame, period: Column, name: str, count_name: str, *extra: Column) -> DataFrame:
    """Rows per period (A1, A2); extra aggregates may ride along. Partial counts are combined before the shuffle."""
    return df.groupBy(period.alias(name)).agg(F.count(F.lit(1)).alias(count_name), *extra)


def monthly_first_visits(first_time: DataFrame) -> DataFrame:
    """Households by month of their first visit, in order."""
    counts = count_by(first_time, dates.month_floor("clean_date"), "month_start", "num_first_visits")
    return counts.orderBy(F.asc_nulls_last("month_start"))


def monthly_totals(df: DataFrame, first: str | None = None, last: str | None = None, date_column: str = "clean_date",
                   name: str = "month_start", count_name: str = "num_total_visits") -> DataFrame:
    """Rows by month, months from ``first`` to ``last`` (C17). The limits are applied to the days, before counting."""
    kept = df.filter(dates.within_months(date_column, first, last))
    return count_by(kept, dates.month_floor(date_column), name, count_name).orderBy(F.asc_nulls_last(name))


def visit_table(persons: DataFrame, first_within: str = "household") -> DataFrame:
    """Person rows of the second export to visits (C2): size, ZIP, date parts, rounded month, code, first flag.

    The ZIP code of a visit is the lowest of its person rows, which does not depend on file order (A9).
    """
    if first_within not in ("household", "visit"):
        raise ValueError("first_within must be 'household' or 'visit'")
    sized = persons.groupBy(*VISIT_KEYS_V8).agg(
        F.count(F.lit(1)).alias("n_household"), F.min("zip").alias("zip")
    )
    if first_within == "household":
        flagged = flag_group_min(sized, ["afn"], "served_date", "first_visit", within=persons)
    else:
        flagged = sized.withColumn("first_visit", F.when(F.col("served_date").isNotNull(), F.lit(1)))
    return flagged.withColumns({
        **dates.date_parts("served_date"),
        "round_month": dates.month_round("served_date"),
        "education_numeric": codes.code_of("education", codes.EDUCATION_0_11),
    })


def rounded_month_counts(visit: DataFrame, strict: bool = True) -> DataFrame:
    """Visits and people served per rounded month (A1, A4)."""
    people = strict_sum("n_household") if strict else F.sum("n_household")
    return count_by(visit, F.col("round_month"), "round_month", "num_VISITS", people.alias("num_PEOPLE_SERVED"))


def first_visits_by_rounded_month(visit: DataFrame, after: str = "2019-01-01") -> DataFrame:
    """First visits per rounded month, later than ``after``."""
    kept = visit.filter((F.col("first_visit") == 1) & (F.col("served_date") > F.lit(after).cast("date")))
    return count_by(kept, F.col("round_month"), "round_month", "count_first_visits")


def first_visits_by_week(visit: DataFrame, year: int = 2023) -> DataFrame:
    """First visits of one year per week, weeks begin on Sunday."""
    kept = visit.filter((F.col("first_visit") == 1) & dates.within_years("served_date", year, year))
    return count_by(kept, dates.week_floor("served_date"), "week_start", "count_first_visits")


def households_per_year(df: DataFrame, household: str = HOUSEHOLD, date_column: str = "clean_date") -> DataFrame:
    """Distinct households per year, a NULL household counts as one (A10).

    Planned as de-duplication by (year, household) followed by a count, so one busy year is spread over all tasks.
    """
    return df.groupBy(F.year(date_column).alias("year")).agg(n_distinct(household).alias("unique_households"))


def households_in_year(df: DataFrame, year: int, household: str = HOUSEHOLD, date_column: str = "clean_date",
                       name: str = "total_households") -> DataFrame:
    """Distinct households of one year, as a one-row frame."""
    return df.filter(dates.within_years(date_column, year, year)).agg(n_distinct(household).alias(name))


def visits_and_households(df: DataFrame, first: int, last: int, household: str = HOUSEHOLD,
                          date_column: str = "clean_date", households: DataFrame | None = None,
                          households_after: int | None = None) -> DataFrame:
    """``served_year, value, metric``: total visits stacked on unique households.

    ``households`` (``served_year, unique_households``) replaces the count made here. ``households_after`` leaves out
    earlier household years.
    """
    kept = df.filter(dates.within_years(date_column, first, last))
    visits = count_by(kept, F.year(date_column), "served_year", "value")
    if households is None:
        households = households_per_year(kept, household, date_column).withColumnRenamed("year", "served_year")
    low = first - 1 if households_after is None else households_after
    unique = households.filter((F.col("served_year") > low) & (F.col("served_year") <= last))
    unique = unique.withColumnRenamed("unique_households", "value")
    return stack_tagged({"Total Visits": visits, "Unique Households": unique}, "metric")


def household_incomes(persons: DataFrame) -> DataFrame:
    """Person rows per household, income, family type and housing."""
    return persons.groupBy("afn", "annual_income", "family_type", "housing").agg(
        F.count(F.lit(1)).alias("n_household")
    )


def category_counts(df: DataFrame, column: str, name: str = "count") -> DataFrame:
    """Rows per category, the numbers behind a bar chart."""
    return df.groupBy(column).agg(F.count(F.lit(1)).alias(name))
