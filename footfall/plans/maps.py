"""Frames behind the maps: measures per ZIP shape, need against current use."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.nulls import is_in
from ..names import METRO_BOX, METRO_ZIPS
from ..operators.frames import in_box
from ..operators.groups import full_join, left_join, rows_with_key_in


def known_zips(measure: DataFrame, shapes: DataFrame) -> DataFrame:
    """Measures whose ZIP code has a shape."""
    return rows_with_key_in(measure, shapes, "zip")


def map_frame(shapes: DataFrame, measure: DataFrame, box=METRO_BOX) -> DataFrame:
    """Every shape in the window with its measure, NULL where there is none.

    The crop is applied to the shapes before the join.
    """
    return left_join(in_box(shapes, box), measure, "zip")


def additional_need(counts: DataFrame, predicted: DataFrame, zips: Sequence[str] = METRO_ZIPS,
                    na_matches: bool = False) -> DataFrame:
    """Estimated need minus households served per ZIP code; a missing side counts as 0."""
    both = full_join(counts, predicted, "zip", na_matches).filter(is_in("zip", zips))
    return both.withColumn(
        "additional", F.coalesce(F.col("estimated_acs_need"), F.lit(0.0)) - F.coalesce(F.col("count"), F.lit(0))
    )
