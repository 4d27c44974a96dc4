"""Queries with one row per household."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..plans import households as H
from ..plans import visits as V
from .registry import register
from .standins import persons_v8, with_ctes
from .visits import VISIT_TABLE

_BEST = """
best AS (
  SELECT * FROM visit QUALIFY row_number() OVER (PARTITION BY afn ORDER BY education_numeric DESC NULLS LAST,
    served_date NULLS LAST, annual_income NULLS LAST, education NULLS LAST) = 1)"""
_RACE = """
multi AS (
  SELECT afn, CASE WHEN count(DISTINCT race) + max(CASE WHEN race IS NULL THEN 1 ELSE 0 END) = 1 THEN min(race)
                   ELSE 'Multi' END AS race
  FROM persons_v8 WHERE annual_income >= 0 GROUP BY afn),
eth AS (
  SELECT afn, ethnicity FROM persons_v8 WHERE annual_income >= 0
  QUALIFY row_number() OVER (PARTITION BY afn ORDER BY served_date NULLS LAST, ethnicity NULLS LAST) = 1),
race_table AS (
  SELECT multi.afn, CASE
    WHEN ethnicity = 'Hispanic or Latino' AND coalesce(race IN ('Unknown', 'Other'), false) THEN 'Hispanic/Latino'
    WHEN NOT (ethnicity = 'Hispanic or Latino' AND coalesce(race IN ('Unknown', 'Other'), false)) THEN race END AS race
  FROM multi JOIN eth ON multi.afn = eth.afn)"""


def _persons(spark, sf):
    return V.clean_visits_v8(persons_v8(spark, sf))


def _households(spark, sf):
    people = _persons(spark, sf)
    return H.household_table(V.visit_table(people), people)


@register("top_education_visit", with_ctes("persons_v8", then=VISIT_TABLE + "," + _BEST) + "SELECT * FROM best")
def top_education_visit(spark, sf):  # W1
    return H.best_education_visit(V.visit_table(_persons(spark, sf)))


@register("household_multi", with_ctes("persons_v8", then=_RACE) + "SELECT * FROM multi")
def household_multi(spark, sf):  # A11
    return H.race_table(_persons(spark, sf), override=False)


@register("race_override", with_ctes("persons_v8", then=_RACE) + "SELECT * FROM race_table")
def race_override(spark, sf):  # F7 P13
    return H.race_table(_persons(spark, sf))


@register("household_dim", with_ctes("persons_v8", then=VISIT_TABLE + "," + _BEST + "," + _RACE) + """
SELECT best.*, race FROM best LEFT JOIN race_table ON best.afn = race_table.afn""")
def household_dim(spark, sf):  # C12 J3
    return _households(spark, sf)


@register("households_by_zip", with_ctes("persons_v8", then=VISIT_TABLE + "," + _BEST) + """
SELECT 'all' AS period, zip, count(*) AS count FROM best GROUP BY zip
UNION ALL
SELECT '1996-1998', zip, count(*) FROM best WHERE served_year BETWEEN 1996 AND 1998 GROUP BY zip""")
def households_by_zip(spark, sf):  # C13
    best = H.best_education_visit(V.visit_table(_persons(spark, sf), first_within="visit"))
    every = H.households_by_zip(best).withColumn("period", F.lit("all"))
    some = H.households_by_zip(best, 1996, 1998).withColumn("period", F.lit("1996-1998"))
    return every.unionByName(some)
