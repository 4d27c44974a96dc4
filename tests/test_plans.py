"""The analyses on hand-worked rows, and invariants on the sf0.01 tables."""

import datetime as dt
import json
import random

import pytest
from pyspark.sql import functions as F

from footfall import names, schemas
from footfall.catalog import segments as catalog_segments
from footfall.catalog import standins
from footfall.functions import dates
from footfall.functions.nulls import n_distinct, one_or_multi, strict_sum, sums_or_zero
from footfall.plans import census, demand, growth, households, maps, segments, training, visits
from footfall.sources import census as census_files
from footfall.sources import tables

D = dt.date
SF = "/root/testdata/sf0.01"

VISITS = [
    ("1", "2023-03-05", 2, "Yes", 12000.0, "HS/HiSET Graduate"),
    ("1", "2023-03-05", 2, "Yes", 12000.0, "HS/HiSET Graduate"),
    ("1", "2023-03-05", 2, "Yes", 12000.0, "Currently K-8"),
    ("1", "2023-01-20", 2, "Yes", 12000.0, "Some College"),
    ("2", "2023-02-10", 1, "No", None, "Unknown"),
    ("3", None, 1, None, 5000.0, "No Schooling"),
    ("4", "2023-02-11", 3, "No", 9000.0, "Some College"),
    ("4", "2023-02-11", 2, "Yes", 20000.0, "Drop Out K-12"),
]


@pytest.fixture(scope="module")
def persons(spark):
    return spark.createDataFrame([(h, s, m, f, i, e) for h, s, m, f, i, e in VISITS], schemas.VISITS)


def test_visit_build(spark, persons):
    clean = visits.clean_visits(persons)
    assert clean.count() == 7
    assert visits.clean_visits(persons, na_rows="keep").filter("houseHoldIdAfn IS NULL").count() == 1
    table = visits.first_visit_table(clean)
    got = {(r.houseHoldIdAfn, r.clean_date, r.education): (r.householdMembers_key, r.householdMembers, r.education_numeric,
                                                          r.first_visit) for r in table.collect()}
    assert got == {
        ("1", D(2023, 3, 5), "HS/HiSET Graduate"): (2, 2, 7, 0),
        ("1", D(2023, 3, 5), "Currently K-8"): (2, 1, 3, 0),
        ("1", D(2023, 1, 20), "Some College"): (2, 1, 8, 1),
        ("2", D(2023, 2, 10), "Unknown"): (1, 1, None, 1),
        ("4", D(2023, 2, 11), "Some College"): (3, 1, 8, 1),
        ("4", D(2023, 2, 11), "Drop Out K-12"): (2, 1, 4, 1),
    }
    assert [(f.name, f.dataType) for f in table.schema] == [(f.name, f.dataType) for f in schemas.FIRST_VISIT]
    assert all(r.first_visit == 1 for r in visits.first_visit_table(clean, first_within="visit").collect())
    first = visits.first_time_table(table)
    assert {(r.houseHoldIdAfn, r.clean_date, r.householdMembers_key) for r in first.collect()} == {
        ("1", D(2023, 1, 20), 2), ("2", D(2023, 2, 10), 1), ("4", D(2023, 2, 11), 2)}
    assert [tuple(r) for r in visits.monthly_first_visits(first).collect()] == [(D(2023, 1, 1), 1), (D(2023, 2, 1), 2)]


def test_best_education_row(spark):
    rows = [("A", None, "2020-01-01"), ("A", 3, "2020-02-01"), ("A", 8, "2022-05-01"), ("A", 8, "2021-07-01"),
            ("B", None, "2021-03-01"), ("B", None, "2021-01-01")]
    df = spark.createDataFrame(rows, "afn STRING, education_numeric INT, d STRING").select(
        "afn", "education_numeric", F.col("d").cast("date").alias("served_date"),
        F.lit(1.0).alias("annual_income"), F.lit("x").alias("education"))
    assert {(r.afn, r.served_date) for r in households.best_education_visit(df).collect()} == {
        ("A", D(2021, 7, 1)), ("B", D(2021, 1, 1))}


def test_race_override(spark):
    rows = [("a", "Unknown", "Hispanic or Latino"), ("b", "Unknown", None), ("c", "White", None),
            ("d", "Other", "Not Hispanic"), ("e", None, "Hispanic or Latino")]
    df = spark.createDataFrame(rows, "afn STRING, race STRING, ethnicity STRING")
    assert dict(households.race_table(df).collect()) == {
        "a": "Hispanic/Latino", "b": None, "c": "White", "d": "Other", "e": None}


def test_training_invariants(spark):
    rows = standins.visit_rows(spark, SF)
    monthly = training.monthly_training(rows).collect()
    assert len(monthly) == 72
    for r in monthly:
        assert sum(r[f"hhsize{i}"] for i in range(1, 7)) == r["pantry_visits"]
        assert sum(r[f"income{i}"] for i in range(1, 17)) == r["pantry_visits"]
        assert r["edu6"] == 0
    assert min(r["month_start"] for r in training.monthly_training(rows, "1995-12-31").collect()) == D(1996, 1, 1)
    # The semi-join form keeps exactly the rows the monthly frame counts.
    assert training.in_complete_years(rows).count() == sum(r["pantry_visits"] for r in monthly)


WIDE = {**{c: float(i) for i, c in enumerate(names.INCOME_CODES, 1)},
        **{c: float(i) for i, c in enumerate(names.EDUCATION_CODES, 1)},
        **{c: float(i) for i, c in enumerate(names.HHSIZE_CODES, 1)},
        names.FOODSTAMP_TOTAL: 10.0, names.FOODSTAMP_YES: 4.0}


@pytest.fixture(scope="module")
def acs(spark):
    rows = [("Z", *[WIDE[c] for c in names.COUNT_CODES], z, 2023) for z in ("50309", "50310")]
    rows.append(("Z", *[None for _ in names.COUNT_CODES], "50309", 2023))
    rows.append(("Z", *[1.0 for _ in names.COUNT_CODES], "99999", 2023))
    return spark.createDataFrame(rows, schemas.ACS_RAW)


def test_census_rollup(acs):
    metro = census.in_zips(acs)
    by_zip = {r.zip: r for r in census.by_zip(metro).collect()}
    assert set(by_zip) == {"50309", "50310"}
    assert by_zip["50309"].income3 == 3.0 and by_zip["50309"].avg_foodstamps == 0.4
    total = census.totals(metro).first()
    assert total.income3 == 6.0 and total.hhsize7 == 14.0
    both = {(r.grain, r.zip): r.income16 for r in census.by_zip_and_total(metro).collect()}
    assert both == {("zip", "50309"): 16.0, ("zip", "50310"): 16.0, ("metro", None): 32.0}


def test_wide_census_row(spark, acs):
    by_zip = census.by_zip(census.in_zips(acs, ["50310"]))
    row = census.harmonise_education(by_zip).first()
    assert [row[f"edu{g}"] for g in (1, 3, 4, 7, 8, 9)] == [1, 9, 26, 19, 23, 58]
    assert "edu2" not in row.asDict()
    assert census.estimated_need(by_zip).first().estimated_acs_need == 36
    assert census.estimated_need(by_zip, 7).first().estimated_acs_need == 28
    assert census.at_risk(census.harmonise_education(by_zip)).first().at_risk_estimate == 36
    known = spark.createDataFrame([(500,)], "total_households BIGINT")
    scaled = census.scale_to_households(census.harmonise_education(by_zip), known).first()
    assert scaled.scaling_factor == pytest.approx(500 / 136)
    assert scaled.income2 == pytest.approx(2 * 500 / 136) and scaled.edu9 == pytest.approx(58 * 500 / 136)
    assert scaled[names.FOODSTAMP_TOTAL] == 10.0
    assert census.open_ended_size(by_zip).first().hhsize6 == 13.0


def test_binned_means(spark):
    zeros = {**{c: 0.0 for c in [*names.INCOME, *names.EDU, *names.HHSIZE]}, "avg_foodstamps": 0.1}

    def row(zip_code, h):
        r = {**zeros, "year": 2023, "zip": zip_code}
        r.update({f"hhsize{i}": float(v) for i, v in enumerate(h, 1)})
        return r

    data = [row("1", (10, 20, 30)), row("2", (1, 1, 1))]
    cols = list(data[0])
    df = spark.createDataFrame([tuple(r[c] for c in cols) for r in data],
                               ", ".join(f"{c} {'INT' if c == 'year' else 'STRING' if c == 'zip' else 'DOUBLE'}" for c in cols))
    by_column = {r.zip: (r.avg_hh_size, r.avg_edu_num) for r in census.binned_means(df).collect()}
    assert by_column == {"1": (pytest.approx(140 / 60), None), "2": (2.0, None)}
    # Weights run down the rows: of seven weights, cell (row i, column j) of two rows takes number 2 (j - 1) + i.
    recycled = {r.zip: r.avg_hh_size for r in census.binned_means(df, "column_major").collect()}
    assert recycled == {"1": pytest.approx((10 * 1 + 20 * 3 + 30 * 5) / 60), "2": pytest.approx((2 + 4 + 6) / 3)}


def test_census_files(spark, tmp_path):
    (tmp_path / "acs_2023.json").write_text('[["NAME","B1","zip"],\n["Z 1","5","50309"],\n["Z 2",null,"50310"]]')
    (tmp_path / "acs_2022.json").write_text('[["zip","NAME"],["50311","Z 3"]]')
    texts = census_files.read_responses(spark, str(tmp_path / "*.json"))
    rows = census_files.response_rows(texts, ["NAME", "B1", "zip"])
    assert {tuple(r) for r in rows.collect()} == {
        (2023, "Z 1", "5", "50309"), (2023, "Z 2", None, "50310"), (2022, "Z 3", None, "50311")}
    header = ["NAME", *names.COUNT_CODES, names.ZIP_COLUMN]
    body = ["Z", *["7"] * 40, "-", "50309"]
    folder = tmp_path / "full"
    folder.mkdir()
    (folder / "y2021.json").write_text(json.dumps([header, body]))
    row = census_files.read_acs(spark, str(folder)).first()
    assert row.year == 2021 and row.zip == "50309" and row[names.INCOME_CODES[0]] == 7.0
    assert row[names.FOODSTAMP_YES] is None


def test_csv_round_trip(spark, persons, tmp_path):
    path = str(tmp_path / "visits")
    tables.write_csv(persons, path)
    back = tables.read_csv(spark, path, schemas.VISITS)
    assert sorted(back.collect(), key=repr) == sorted(persons.collect(), key=repr)
    tables.write_parquet(persons, str(tmp_path / "p"), ("foodstamps",))
    assert tables.read_parquet(spark, str(tmp_path / "p")).count() == 8


def test_first_time_csv_with_us_dates(spark, tmp_path):
    (tmp_path / "first_time.csv").write_text(
        "houseHoldIdAfn,householdMembers_key,householdMembers,foodstamps,clean_date,annualIncome,education,served_year,"
        "served_month,served_day_of_month,first_visit,education_numeric\n007,2,2,Yes,1/5/2023,NA,Some College,2023,1,5,1,8\n")
    df = tables.read_csv(spark, str(tmp_path / "first_time.csv"), schemas.FIRST_VISIT_CSV)
    row = df.withColumn("clean_date", dates.parse_date("clean_date", dates.US)).first()
    assert (row.houseHoldIdAfn, row.clean_date, row.annualIncome) == ("007", D(2023, 1, 5), None)


def test_additional_need_and_map(spark):
    counts = spark.createDataFrame([("50309", 3), ("50310", 5), (None, 1), ("1", 9)], "zip STRING, count BIGINT")
    need = spark.createDataFrame([("50309", 10.0), ("50310", None), ("50311", 4.0)], schemas.PREDICTED_TOTALS)
    got = {r.zip: r.additional for r in maps.additional_need(counts, need).collect()}
    assert got == {"50309": 7.0, "50310": -5.0, "50311": 4.0}
    shapes = spark.createDataFrame([("50309", -93.7, 41.5, -93.6, 41.6), ("50999", -93.7, 41.5, -93.6, 41.6),
                                    ("50310", -90.0, 41.5, -89.0, 41.6)], schemas.ZIP_SHAPES)
    assert {(r.zip, r["count"]) for r in maps.map_frame(shapes, counts).collect()} == {("50309", 3), ("50999", None)}
    assert {r.zip for r in maps.known_zips(counts, shapes).collect()} == {"50309", "50310"}


def test_projection(spark):
    assigned = spark.createDataFrame([(1, 400.0), (1, 600.0), (2, 5.0), (3, 1.0), (3, None)], "assigned_cluster INT, total_hh DOUBLE")
    known = spark.createDataFrame([(1, 250), (3, 1)], "cluster INT, n_families BIGINT")
    got = {r.assigned_cluster: (r.acs_households, r.projected_growth, r.Percentage_Known)
           for r in segments.projection(assigned, known).collect()}
    assert got == {1: (1000.0, 750.0, 0.25), 2: (5.0, None, None), 3: (None, None, None)}


@pytest.mark.parametrize("k,r,x0,threshold,rows,last,value", [
    (30000.0, 0.2, 2025.0, 29900.0, 37, 2054, 29909.448),
    (37000.0, 0.3, 2030.0, 36900.0, 33, 2050, 36908.513),
    (37000.0, 0.3, 2030.0, 99999.0, 53, 2070, None),
])
def test_saturation_goldens(spark, k, r, x0, threshold, rows, last, value):
    df = spark.createDataFrame([("s", k, r, x0, threshold)], "s STRING, capacity DOUBLE, rate DOUBLE, midpoint DOUBLE, threshold DOUBLE")
    out = growth.until_saturation(df, ["s"]).orderBy("year").collect()
    assert (len(out), out[-1].year) == (rows, last)
    if value is not None:
        assert out[-1].projected_users == pytest.approx(value, abs=1e-3)


def test_actual_and_projected(spark):
    actual = growth.HOUSEHOLDS_BY_YEAR
    df = spark.createDataFrame([("all", y, u) for y, u in actual], "s STRING, year INT, actual_users INT")
    series = spark.createDataFrame([("all", 30000.0, 0.3, 2021.0)], "s STRING, capacity DOUBLE, rate DOUBLE, midpoint DOUBLE")
    padded = growth.pad_years(df, series, ["s"], 2018, 2028).withColumn(
        "p", growth.logistic("year", "capacity", "rate", "midpoint"))
    out = growth.actual_and_projected(padded, "actual_users", "p", 2024).collect()
    assert len(out) == 12 and sum(r.year == 2024 for r in out) == 2
    by_year = {r.year: (r.users, r.type) for r in out}
    assert by_year[2024] == (22167.0, "Actual") and by_year[2026] == (pytest.approx(24527.234, abs=1e-3), "Projected")


def test_segments_end_to_end(spark):
    first = catalog_segments.first_time(spark, SF)
    model = segments.fit_segments(first, seeds=range(3))
    labelled = segments.label_households(first, model)
    assert labelled.count() == first.count()
    complete = segments.with_food_stamps(first).dropna(subset=segments.FEATURES).count()
    profile = segments.profiles(labelled).collect()
    assert [r.cluster for r in profile] == sorted(model.centroids) and sum(r.n_families for r in profile) == complete
    incomes = [model.centroids[c][1] for c in sorted(model.centroids)]
    assert incomes == sorted(incomes)
    means = census.binned_means(census.by_zip(census.in_zips(standins.acs_raw(spark, SF))))
    assigned = segments.assign_areas(means, model)
    assert assigned.filter("assigned_cluster IS NULL").count() == 0
    assert segments.assign_areas(means, model, with_snap=True).filter("assigned_cluster IS NULL").count() == 0


def test_demand_model_score_equation(spark):
    monthly = training.monthly_training(standins.visit_rows(spark, SF))
    model = demand.fit_demand(monthly)
    gap = monthly.agg(F.sum(F.col("pantry_visits") - model.response())).first()[0]
    assert abs(gap) < 1e-3
    by_zip = census.by_zip(census.in_zips(standins.acs_raw(spark, SF)))
    a = {(r.year, r.zip): r for r in demand.score_areas(by_zip, model).collect()}
    b = {(r.year, r.zip): r for r in demand.score_areas(by_zip, model, size_groups="raw").collect()}
    assert len(a) == 140 and set(a) == set(b)
    for r in a.values():
        assert r.predicted_monthly_visits > 0
        assert r.predicted_annual_visits == pytest.approx(12 * r.predicted_monthly_visits)


def test_metro_is_the_sum_of_its_zips(spark):
    both = census.by_zip_and_total(census.in_zips(standins.acs_raw(spark, SF))).groupBy("year", "grain").agg(
        *[F.sum(c).alias(c) for c in names.INCOME]).collect()
    rows = {(r.year, r.grain): tuple(r)[2:] for r in both}
    for year, grain in rows:
        assert rows[(year, "zip")] == rows[(year, "metro")]


@pytest.mark.parametrize("seed", range(3))
def test_random_households_against_plain_python(spark, seed):
    """Distinct, multi, strict sum and first-per-household rules with random NULLs."""
    rng = random.Random(seed)

    def maybe(v):
        return None if rng.random() < 0.3 else v

    rows = [(str(rng.randrange(6)), maybe(rng.choice("AB")), maybe(rng.randrange(3)), maybe(float(rng.randrange(4))))
            for _ in range(60)]
    df = spark.createDataFrame(rows, "afn STRING, race STRING, code INT, x DOUBLE").repartition(4)
    got = {r[0]: tuple(r)[1:] for r in df.groupBy("afn").agg(
        one_or_multi("race"), n_distinct("race"), strict_sum("x"), *sums_or_zero(["x"])).collect()}
    for key in {r[0] for r in rows}:
        mine = [r for r in rows if r[0] == key]
        races = {r[1] for r in mine}
        xs = [r[3] for r in mine]
        expected = (next(iter(races)) if len(races) == 1 else "Multi", len(races),
                    None if None in xs else sum(xs), float(sum(x for x in xs if x is not None)))
        assert got[key] == expected
