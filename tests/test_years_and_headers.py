"""Columns by header name, years kept apart, open ends, far-off points."""

import numpy as np
import pytest

from footfall import schemas
from footfall.operators import clusters
from footfall.plans import census, households, segments
from footfall.sources import tables


def test_csv_columns_are_found_by_name(spark, tmp_path):
    path = tmp_path / "export.csv"
    path.write_text(
        "servedDate,zip,houseHoldIdAfn,annualIncome,education,foodstamps,extra,householdMembers\n"
        "2023-03-05,50309,0017,1200.5,NA,Yes,x,3\n2023-03-06,50310,18,,Some College,NA,,many\n")
    got = tables.read_csv(spark, str(path), schemas.VISITS)
    assert got.schema == schemas.VISITS
    assert sorted(map(tuple, got.collect())) == [
        ("0017", "2023-03-05", 3, "Yes", 1200.5, None), ("18", "2023-03-06", None, None, None, "Some College")]


def test_csv_without_a_declared_column(spark, tmp_path):
    path = tmp_path / "export.csv"
    path.write_text("houseHoldIdAfn,servedDate\n1,2023-03-05\n")
    with pytest.raises(ValueError, match="householdMembers"):
        tables.read_csv(spark, str(path), schemas.VISITS)


def test_projection_keeps_years_apart(spark):
    assigned = spark.createDataFrame([(1999, 1, 400.0), (1999, 1, 100.0), (2000, 1, 600.0)],
                                     "year INT, assigned_cluster INT, total_hh DOUBLE")
    known = spark.createDataFrame([(1, 250)], "cluster INT, n_families BIGINT")
    got = {r.year: (r.acs_households, r.projected_growth) for r in segments.projection(assigned, known).collect()}
    assert got == {1999: (500.0, 250.0), 2000: (600.0, 350.0)}


def test_census_years_are_scaled_by_their_own_households(spark):
    acs = spark.createDataFrame([(1999, 10.0, 30.0), (2000, 20.0, 20.0), (2001, 1.0, 1.0)],
                                "year INT, income1 DOUBLE, income2 DOUBLE")
    count = spark.createDataFrame([(1999, 80), (2000, 20)], "year INT, unique_households BIGINT")
    got = {r.year: (r.scaling_factor, r.income1, r.income2) for r in census.scale_to_households(acs, count).collect()}
    assert got == {1999: (2.0, 20.0, 60.0), 2000: (0.5, 10.0, 10.0), 2001: (None, None, None)}
    one = spark.createDataFrame([(40,)], "total_households BIGINT")
    got = {r.year: r.scaling_factor for r in census.scale_to_households(acs, one).collect()}
    assert got == {1999: 1.0, 2000: 1.0, 2001: 20.0}


@pytest.mark.parametrize("first,last,expected", [
    (None, None, 3), (1996, None, 2), (None, 1996, 2), (1996, 1996, 1), (1999, None, 0),
])
def test_open_ended_years(spark, first, last, expected):
    df = spark.createDataFrame([("z", 1995), ("z", 1996), ("z", 1997)], "zip STRING, served_year INT")
    got = households.households_by_zip(df, first, last).collect()
    assert sum(r["count"] for r in got) == expected


def test_silhouette_does_not_depend_on_the_origin(spark):
    rng = np.random.default_rng(8)
    points = [(i, float(x), int(x > 0.5)) for i, x in enumerate(rng.random(40))]
    here = spark.createDataFrame(points, "id INT, x DOUBLE, c INT")
    far = spark.createDataFrame([(i, x + 1e8, c) for i, x, c in points], "id INT, x DOUBLE, c INT")
    widths = [
        {r["id"]: r["silhouette"] for r in clusters.silhouette_squared(df, ["x"], "c", [0, 1]).collect()} for df in (here, far)]
    assert widths[1] == pytest.approx(widths[0], abs=1e-5)
