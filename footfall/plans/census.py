"""Census tables: rollups, education groups, estimates per area."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import add

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.codes import INCOME_MIDPOINTS
from ..functions.nulls import col, is_in, plain_sum, pmin, ratio, row_sum, sums_or_zero, weighted_sum
from ..names import (
    COUNT_CODES, EDU, FOODSTAMP_TOTAL, FOODSTAMP_YES, HHSIZE, INCOME, METRO_ZIPS, SHORT_NAMES,
)
from ..operators.frames import scale_columns, starting_with, with_row
from ..operators.groups import left_join

# Census education columns that make up each model code.
EDUCATION_GROUPS = {
    1: [1],
    3: [2, 3, 4],
    4: [5, 6, 7, 8],
    7: [9, 10],
    8: [11, 12],
    9: [13, 14, 15, 16],
}


def in_zips(acs_raw: DataFrame, zips: Sequence[str] = METRO_ZIPS, column: str = "zip") -> DataFrame:
    """Rows of the listed ZIP codes."""
    return acs_raw.filter(is_in(column, zips))


def with_snap_rate(df: DataFrame, name: str = "snap_rate") -> DataFrame:
    return df.withColumn(name, ratio(FOODSTAMP_YES, FOODSTAMP_TOTAL))


def _named(rolled: DataFrame) -> DataFrame:
    return with_snap_rate(rolled, "avg_foodstamps").withColumnsRenamed(SHORT_NAMES)


def by_zip(acs_raw: DataFrame) -> DataFrame:
    """Sums per year and ZIP code with short names and the food-stamp ratio of the sums."""
    return _named(acs_raw.groupBy("year", "zip").agg(*sums_or_zero(COUNT_CODES)))


def totals(acs_raw: DataFrame) -> DataFrame:
    """The same per year."""
    return _named(acs_raw.groupBy("year").agg(*sums_or_zero(COUNT_CODES)))


def by_zip_and_total(acs_raw: DataFrame) -> DataFrame:
    """Both grains from one scan (A17); the rows per year have a NULL ``zip`` and ``grain = 'metro'``."""
    both = acs_raw.groupingSets(
        [[F.col("year"), F.col("zip")], [F.col("year")]], F.col("year"), F.col("zip")
    ).agg(F.grouping_id().alias("__g"), *sums_or_zero(COUNT_CODES))
    grain = F.when(F.col("__g") == 0, "zip").otherwise("metro")
    return _named(both).withColumn("grain", grain).drop("__g")


def harmonise_education(acs: DataFrame) -> DataFrame:
    """The 16 census education columns folded into the model's codes 1, 3, 4, 7, 8, 9.

    New columns get temporary names first: Spark does not tell ``Edu1`` from ``edu1``.
    """
    folded = acs.withColumns({f"__h{g}": row_sum([f"edu{i}" for i in parts]) for g, parts in EDUCATION_GROUPS.items()})
    return folded.drop(*EDU).withColumnsRenamed({f"__h{g}": f"edu{g}" for g in EDUCATION_GROUPS})


def open_ended_size(acs: DataFrame) -> DataFrame:
    """``hhsize6`` as "six or more", which is what the training frame counts; the census has six and seven-plus apart."""
    return acs.withColumn("hhsize6", row_sum(["hhsize6", "hhsize7"])).drop("hhsize7")


def at_risk(harmonised: DataFrame, max_bracket: int = 8) -> DataFrame:
    """Upper estimate of households at risk: the smaller of the education and the income match."""
    keys = [c for c in ("year", "zip") if c in harmonised.columns]
    return harmonised.select(
        *keys,
        (F.col("edu7") + F.col("edu3") + F.col("edu4")).alias("matching_education"),
        plain_sum(INCOME[:max_bracket]).alias("matching_income"),
    ).withColumn("at_risk_estimate", pmin("matching_education", "matching_income"))


def estimated_need(acs: DataFrame, max_bracket: int = 8) -> DataFrame:
    """Households in the income brackets up to ``max_bracket`` (C9); 8 for ZIP codes, 7 for the metro estimate."""
    keys = [c for c in ("year", "zip") if c in acs.columns]
    return acs.select(*keys, plain_sum(INCOME[:max_bracket]).alias("estimated_acs_need"))


def scale_to_households(acs: DataFrame, households: DataFrame) -> DataFrame:
    """All counts times observed households over census households.

    ``households`` has a count per ``year``, so that each census year is scaled by its own households, or is one row whose
    count holds for all of ``acs``. A year without a count gives NULL.
    """
    name = next(c for c in households.columns if c != "year")
    total = households.withColumnRenamed(name, "__total")
    known = left_join(acs, total, "year") if "year" in total.columns else with_row(acs, total)
    counts = starting_with(acs, "edu", "hhsize", "income")
    factor = F.try_divide(F.col("__total").cast("double"), row_sum(starting_with(acs, "income")))
    return scale_columns(known.withColumn("scaling_factor", factor), counts, F.col("scaling_factor")).drop("__total")


def binned_means(acs: DataFrame, recycle: str = "by_column", edu_denominator: str = "education") -> DataFrame:
    """Average household size, income and education level from binned counts.

    Weight j belongs to column j. ``recycle="column_major"`` instead lets the weights run down the rows of the aggregated
    ZIP table, as vector recycling over a data frame does; rows are then numbered by year and ZIP code.
    ``edu_denominator="households"`` divides the education sum by households instead of by persons with an education.
    """
    groups = [
        ("hh", HHSIZE, [float(j) for j in range(1, 8)]),
        ("income", INCOME, [float(m) for m in INCOME_MIDPOINTS]),
        ("edu", EDU, [float(j) for j in range(1, 17)]),
    ]
    if recycle == "by_column":
        numbered = acs
        sums = {f"__{g}": weighted_sum(cols, weights) for g, cols, weights in groups}
    elif recycle == "column_major":
        years = acs.groupBy("year").agg(F.count(F.lit(1)).alias("n")).agg(
            F.collect_list(F.struct("year", "n")).alias("__years")
        )
        earlier = F.filter("__years", lambda y: y["year"] < F.col("year"))
        rows_in = lambda years: F.aggregate(years, F.lit(0).cast("bigint"), lambda total, y: total + y["n"])
        # Rows are numbered inside each year, after the rows of all earlier years.
        place = F.row_number().over(Window.partitionBy("year").orderBy("zip"))
        numbered = with_row(acs, years).withColumns({"__n": rows_in(F.col("__years")), "__i": rows_in(earlier) + place})

        def weight(j: int, weights):
            position = F.pmod(F.lit(j) * F.col("__n") + F.col("__i") - 1, F.lit(len(weights)))
            return F.array(*[F.lit(w) for w in weights])[position.cast("int")]

        sums = {
            f"__{g}": reduce(add, [col(c) * weight(j, weights) for j, c in enumerate(cols)])
            for g, cols, weights in groups
        }
    else:
        raise ValueError("recycle must be 'by_column' or 'column_major'")
    total = plain_sum(HHSIZE)
    persons = plain_sum(EDU) if edu_denominator == "education" else total
    return numbered.withColumns({**sums, "total_hh": total, "__edu_n": persons}).withColumns({
        "avg_hh_size": ratio("__hh", "total_hh"),
        "avg_income": ratio("__income", "total_hh"),
        "avg_edu_num": ratio("__edu", "__edu_n"),
        "snap_rate": F.col("avg_foodstamps"),
    }).drop(*sums, "__edu_n", "__n", "__i", "__years")
