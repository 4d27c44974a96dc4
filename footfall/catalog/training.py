"""Queries over the monthly training frame."""

from __future__ import annotations

from ..plans import training as T
from .registry import register, rounded
from .standins import order_visits, sql_bracket, visit_rows, with_ctes

_COUNTS = ", ".join([
    *[f"count(*) FILTER (WHERE education_numeric = {i}) AS edu{i}" for i in range(1, 10)],
    *[f"count(*) FILTER (WHERE householdMembers = {i}) AS hhsize{i}" for i in range(1, 6)],
    "count(*) FILTER (WHERE householdMembers >= 6) AS hhsize6",
    *[f"count(*) FILTER (WHERE b = {i}) AS income{i}" for i in range(1, 17)],
])
_COMPLETE = "SELECT year(clean_date) AS y FROM visit_rows GROUP BY 1 HAVING count(DISTINCT month(clean_date)) = 12"
MONTHLY = f"""
monthly AS (
  SELECT CAST(date_trunc('month', clean_date) AS DATE) AS month_start, count(*) AS pantry_visits,
         avg(CASE WHEN foodstamps = 'Yes' THEN 1.0::DOUBLE WHEN foodstamps IS NOT NULL THEN 0.0::DOUBLE END)
           AS avg_foodstamps, {_COUNTS}
  FROM (SELECT *, {sql_bracket("annualIncome")} AS b FROM visit_rows WHERE year(clean_date) IN ({_COMPLETE}))
  GROUP BY 1)"""


@register("monthly_training", with_ctes("visit_rows", then=MONTHLY) + """
SELECT * REPLACE (round(avg_foodstamps, 6) AS avg_foodstamps) FROM monthly""")
def monthly_training(spark, sf):  # C4 F3 F6 F8 F16 A6 A7 A14
    return rounded(T.monthly_training(visit_rows(spark, sf)), 6)


@register("monthly_training_after", with_ctes("visit_rows") + f"""
SELECT CAST(date_trunc('month', clean_date) AS DATE) AS month_start, count(*) AS pantry_visits
FROM visit_rows WHERE clean_date > DATE '1996-01-31' AND year(clean_date) IN (
  SELECT year(clean_date) FROM visit_rows WHERE clean_date > DATE '1996-01-31' GROUP BY 1
  HAVING count(DISTINCT month(clean_date)) = 12)
GROUP BY 1""")
def monthly_training_after(spark, sf):  # C4 on visits later than a date
    return T.monthly_training(visit_rows(spark, sf), min_date="1996-01-31").select("month_start", "pantry_visits")


@register("complete_years", """
SELECT CAST(year(o_orderdate) AS INTEGER) AS year FROM orders
GROUP BY 1 HAVING count(DISTINCT month(o_orderdate)) = 12""")
def complete_years(spark, sf):  # A14 P16
    return T.complete_years(order_visits(spark, sf))


@register("visits_in_complete_years", with_ctes("visit_rows") + f"""
SELECT visit_id, clean_date, CAST(year(clean_date) AS INTEGER) AS year FROM visit_rows
WHERE year(clean_date) IN ({_COMPLETE})""")
def visits_in_complete_years(spark, sf):  # J7
    return T.in_complete_years(visit_rows(spark, sf)).select("visit_id", "clean_date", "year")


@register("edu_by_month", with_ctes("visit_rows") + f"""
SELECT CAST(date_trunc('month', clean_date) AS DATE) AS month_start, """ + ", ".join(
    f"nullif(count(*) FILTER (WHERE education_numeric = {i}), 0) AS edu{i}" for i in range(1, 10)
) + f"""
FROM visit_rows WHERE education_numeric IS NOT NULL AND year(clean_date) IN ({_COMPLETE}) GROUP BY 1""")
def edu_by_month(spark, sf):  # A18 P15 O1
    return T.education_by_month(visit_rows(spark, sf))
