"""Household segments, their profiles, and growth per segment (C11)."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.codes import yes_flag_any_case
from ..functions.nulls import ratio, strict_sum
from ..operators.clusters import ClusterModel, fit_kmeans
from ..operators.groups import left_join

FEATURES = ["householdMembers", "annualIncome", "education_numeric", "food_stamps"]
ORDER = ["annualIncome", "householdMembers"]

# Census column that carries each feature.
CENSUS_COLUMNS = {
    "householdMembers": "avg_hh_size",
    "annualIncome": "avg_income",
    "education_numeric": "avg_edu_num",
}


def with_food_stamps(first_time: DataFrame) -> DataFrame:
    return first_time.withColumn("food_stamps", yes_flag_any_case("foodstamps"))


def fit_segments(first_time: DataFrame, k: int = 4, seeds: Iterable[int] = range(123, 148)) -> ClusterModel:
    return fit_kmeans(with_food_stamps(first_time), FEATURES, k=k, seeds=seeds, order_by=ORDER)


def label_households(first_time: DataFrame, model: ClusterModel) -> DataFrame:
    """Every household with its ``cluster``; NULL where a feature is missing (J1, P17: no row id is needed)."""
    return with_food_stamps(first_time).withColumn("cluster", model.label())


def profiles(labelled: DataFrame) -> DataFrame:
    """Size and means of each cluster (M3)."""
    return (
        labelled.filter(F.col("cluster").isNotNull())
        .groupBy("cluster")
        .agg(
            F.count(F.lit(1)).alias("n_families"),
            F.avg("householdMembers").alias("avg_household"),
            F.avg("annualIncome").alias("avg_income"),
            F.avg("education_numeric").alias("avg_education"),
        )
        .orderBy("cluster")
    )


def assign_areas(acs_means: DataFrame, model: ClusterModel, with_snap: bool = False) -> DataFrame:
    """Nearest segment of each census area, by the three features both sides have; ``with_snap`` adds the
    food-stamp share as the fourth (M4)."""
    columns = {**CENSUS_COLUMNS, "food_stamps": "snap_rate"} if with_snap else CENSUS_COLUMNS
    return acs_means.withColumn("assigned_cluster", model.label_on(columns))


def projection(assigned: DataFrame, cluster_profiles: DataFrame) -> DataFrame:
    """Census households per segment against known families: growth and share known.

    A frame with a ``year`` column gives a row per year and segment; census years are never added up.
    """
    keys = [c for c in ("year", "assigned_cluster") if c in assigned.columns]
    areas = assigned.groupBy(*keys).agg(strict_sum("total_hh").alias("acs_households"))
    known = cluster_profiles.withColumnRenamed("n_families", "known_families")
    return left_join(areas, known, {"assigned_cluster": "cluster"}).withColumns({
        "projected_growth": F.col("acs_households") - F.col("known_families"),
        "Percentage_Known": ratio("known_families", "acs_households"),
    })
