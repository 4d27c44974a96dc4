"""Fit the monthly demand model and score census areas with it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.poisson import PoissonModel, fit_poisson
from .census import harmonise_education, open_ended_size
from .training import MODEL_FEATURES


def fit_demand(monthly: DataFrame, features=tuple(MODEL_FEATURES)) -> PoissonModel:
    """Poisson model of monthly visits (M6)."""
    return fit_poisson(monthly, "pantry_visits", list(features))


def score_areas(acs: DataFrame, model: PoissonModel, size_groups: str = "open_ended") -> DataFrame:
    """Predicted monthly and annual visits per row of a census rollup (M8, M9).

    ``size_groups="raw"`` scores the census column ``hhsize6`` as it is.
    """
    ready = harmonise_education(acs)
    if size_groups == "open_ended":
        ready = open_ended_size(ready)
    return ready.withColumn("predicted_monthly_visits", model.response()).withColumn(
        "predicted_annual_visits", F.col("predicted_monthly_visits") * 12
    )
