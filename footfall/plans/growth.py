"""Growth projections."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.curves import logistic, year_grid
from ..functions.nulls import col
from ..operators.groups import cut_at_threshold, left_join

# Unique households per year of the full export.
HOUSEHOLDS_BY_YEAR = [
    (2018, 17730), (2019, 19032), (2020, 18318), (2021, 15509), (2022, 16983), (2023, 17225), (2024, 22167),
]


def logistic_curves(parameters: DataFrame, first: int, last: int, name: str = "predicted_users") -> DataFrame:
    """Each parameter row (``capacity, rate, midpoint``) over the years ``first..last``.

    The years are generated per row, so the cost is parameter rows times years and nothing is joined.
    """
    return parameters.withColumn("year", year_grid(first, last)).withColumn(
        name, logistic("year", "capacity", "rate", "midpoint")
    )


def until_saturation(parameters: DataFrame, series: Sequence[str], first: int = 2018, last: int = 2070,
                     name: str = "projected_users") -> DataFrame:
    """Logistic curves up to the first year at or above each row's ``threshold``."""
    return cut_at_threshold(logistic_curves(parameters, first, last, name), series, "year", name, "threshold")


def pad_years(actual: DataFrame, series: DataFrame, keys: Sequence[str], first: int, last: int) -> DataFrame:
    """Actual values on a full range of years, NULL where there are none yet."""
    grid = series.withColumn("year", year_grid(first, last))
    return left_join(grid, actual, [*keys, "year"])


def actual_and_projected(df: DataFrame, value: str, projected: str, boundary: int) -> DataFrame:
    """Two overlapping slices for drawing: years up to the boundary and from it on, the boundary year in both (P20).

    ``value`` is the actual number where known, else the projected one; ``type`` says which.
    """
    users = df.withColumns({
        "users": F.coalesce(col(value).cast("double"), col(projected)),
        "type": F.when(col(value).isNull(), "Projected").otherwise("Actual"),
    })
    before = users.filter(F.col("year") <= boundary).withColumn("slice", F.lit("actual"))
    after = users.filter(F.col("year") >= boundary).withColumn("slice", F.lit("projected"))
    return before.unionByName(after)
