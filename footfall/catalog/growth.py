"""Queries over yearly and monthly series per ZIP code."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators.trend import loess, polynomial_fit, polynomial_forecast, quadratic_fit, quadratic_forecast
from ..plans import growth as G
from .registry import register, rounded
from .standins import with_ctes, zip_visits

_YEARLY = """
yearly AS (SELECT zip, CAST(year(clean_date) AS INTEGER) AS year, count(DISTINCT houseHoldIdAfn) AS households
           FROM zip_visits WHERE year(clean_date) IN (
             SELECT year(clean_date) FROM zip_visits GROUP BY 1 HAVING count(DISTINCT month(clean_date)) = 12)
           GROUP BY 1, 2)"""

# One literal row per scenario: name, rate, midpoint.
SCENARIOS = [("base", 0.3, 1998.0), ("slow", 0.15, 2001.0), ("late", 0.3, 2007.0)]
_PARAMETERS = """
parameters AS (SELECT zip, scenario, rate::DOUBLE AS rate, midpoint::DOUBLE AS midpoint, k * 1.5::DOUBLE AS capacity,
                      k * 1.5::DOUBLE * 0.99::DOUBLE AS threshold
               FROM (SELECT zip, max(households) AS k FROM yearly GROUP BY zip),
                    (VALUES """ + ", ".join(f"('{n}', {r}, {m})" for n, r, m in SCENARIOS) + """)
                      t(scenario, rate, midpoint)),
curves AS (SELECT *, capacity / (1 + exp(-rate * (year - midpoint))) AS users
           FROM (SELECT *, CAST(unnest(range(1995, 2036)) AS INTEGER) AS year FROM parameters))"""


def yearly(spark, sf):
    """Distinct households per ZIP code and complete year, one with visits in all of its months."""
    visits = zip_visits(spark, sf).withColumn("year", F.year("clean_date"))
    complete = visits.groupBy("year").agg(F.count_distinct(F.month("clean_date")).alias("months")).where("months = 12")
    return visits.join(complete, "year", "left_semi").groupBy("zip", "year").agg(
        F.count_distinct("houseHoldIdAfn").alias("households")
    )


def parameters(spark, sf):
    """Logistic parameters per ZIP code and scenario; the capacity follows from the busiest year."""
    scenarios = F.array(*[
        F.struct(F.lit(n).alias("scenario"), F.lit(r).alias("rate"), F.lit(m).alias("midpoint")) for n, r, m in SCENARIOS
    ])
    top = yearly(spark, sf).groupBy("zip").agg(F.max("households").alias("k"))
    return top.select("zip", (F.col("k") * 1.5).alias("capacity"), F.explode(scenarios).alias("s")).select(
        "zip", "s.*", "capacity", (F.col("capacity") * 0.99).alias("threshold")
    )


@register("logistic_growth", with_ctes("zip_visits", then=_YEARLY + "," + _PARAMETERS) + """
SELECT zip, scenario, year, round(users, 4) AS predicted_users FROM curves WHERE year <= 2010""")
def logistic_growth(spark, sf):  # M12 F21 F22 S5
    curves = G.logistic_curves(parameters(spark, sf), 1995, 2010)
    return rounded(curves.select("zip", "scenario", "year", "predicted_users"), 4)


@register("growth_cutoff", with_ctes("zip_visits", then=_YEARLY + "," + _PARAMETERS) + """
SELECT zip, scenario, year, round(users, 4) AS projected_users
FROM (SELECT *, min(CASE WHEN users >= threshold THEN year END) OVER (PARTITION BY zip, scenario) AS cut FROM curves)
WHERE cut IS NULL OR year <= cut""")
def growth_cutoff(spark, sf):  # M13 W4
    curves = G.until_saturation(parameters(spark, sf), ["zip", "scenario"], 1995, 2035)
    return rounded(curves.select("zip", "scenario", "year", "projected_users"), 4)


_QUADRATIC = """
sums AS (SELECT zip, count(*)::DOUBLE AS n, sum(t) AS t1, sum(t*t) AS t2, sum(t*t*t) AS t3, sum(t*t*t*t) AS t4,
                sum(v) AS v1, sum(t*v) AS tv, sum(t*t*v) AS ttv
         FROM (SELECT zip, (year - 1995)::DOUBLE AS t, households::DOUBLE AS v FROM yearly) GROUP BY zip),
solved AS (SELECT zip, n, (v1*(t2*t4 - t3*t3) - t1*(tv*t4 - t3*ttv) + t2*(tv*t3 - t2*ttv)) / d AS b0,
                  (n*(tv*t4 - t3*ttv) - v1*(t1*t4 - t3*t2) + t2*(t1*ttv - tv*t2)) / d AS b1,
                  (n*(t2*ttv - tv*t3) - t1*(t1*ttv - tv*t2) + v1*(t1*t3 - t2*t2)) / d AS b2
           FROM (SELECT *, n*(t2*t4 - t3*t3) - t1*(t1*t4 - t3*t2) + t2*(t1*t3 - t2*t2) AS d FROM sums))"""


@register("quadratic_trend", with_ctes("zip_visits", then=_YEARLY + "," + _QUADRATIC) + """
SELECT zip, CAST(year AS INTEGER) AS year, round(b0 + b1 * (year - 1995) + b2 * (year - 1995) * (year - 1995), 4)
  AS predicted
FROM (SELECT *, unnest(range(1995, 2006)) AS year FROM solved)""")
def quadratic_trend(spark, sf):  # M10 M11
    fit = quadratic_fit(yearly(spark, sf), ["zip"], "year", "households", 1995)
    return rounded(quadratic_forecast(fit, 1995, 2005, 1995).select("zip", "year", "predicted"), 4)


@register("quadratic_fit", with_ctes("zip_visits", then=_YEARLY + "," + _QUADRATIC) + """
SELECT solved.zip, CAST(n AS BIGINT) AS n, round(b0, 4) AS b0, round(b1, 4) AS b1, round(b2, 4) AS b2,
       round(r, 4) AS r_squared
FROM solved JOIN (
  SELECT yearly.zip, 1 - sum((households - b0 - b1 * (year - 1995) - b2 * (year - 1995) * (year - 1995)) ** 2)
    / nullif(sum((households - m) ** 2), 0) AS r
  FROM yearly JOIN solved ON yearly.zip = solved.zip
       JOIN (SELECT zip, avg(households) AS m FROM yearly GROUP BY zip) a ON a.zip = yearly.zip
  GROUP BY yearly.zip) q ON q.zip = solved.zip""")
def quadratic_fit_table(spark, sf):  # M10
    return rounded(quadratic_fit(yearly(spark, sf), ["zip"], "year", "households", 1995), 4)


@register("polynomial_trend", with_ctes("zip_visits", then=_YEARLY + "," + _QUADRATIC) + """
SELECT zip, CAST(year AS INTEGER) AS year, round(b0 + b1 * (year - 1995) + b2 * (year - 1995) * (year - 1995), 4)
  AS predicted
FROM (SELECT *, unnest(range(1995, 2006)) AS year FROM solved)""")
def polynomial_trend(spark, sf):  # M10 M11 on the orthogonal basis
    fit = polynomial_fit(yearly(spark, sf), ["zip"], "year", "households", 2)
    return rounded(polynomial_forecast(fit, 1995, 2005, 2).select("zip", "year", "predicted"), 4)


@register("actual_vs_projected", with_ctes("zip_visits", then=_YEARLY + """,
grid AS (SELECT zip, k * 1.5::DOUBLE AS capacity, CAST(unnest(range(1995, 2006)) AS INTEGER) AS year
         FROM (SELECT zip, max(households) AS k FROM yearly GROUP BY zip)),
joined AS (SELECT grid.zip, grid.year, households AS actual_users,
                  capacity / (1 + exp(-0.3::DOUBLE * (grid.year - 1998))) AS predicted_users
           FROM grid LEFT JOIN yearly ON grid.zip = yearly.zip AND grid.year = yearly.year),
typed AS (SELECT zip, year, round(coalesce(actual_users::DOUBLE, predicted_users), 4) AS users,
                 CASE WHEN actual_users IS NULL THEN 'Projected' ELSE 'Actual' END AS type FROM joined)""") + """
SELECT *, 'actual' AS slice FROM typed WHERE year <= 2001
UNION ALL SELECT *, 'projected' FROM typed WHERE year >= 2001""")
def actual_vs_projected(spark, sf):  # C19 U3 P20
    actual = yearly(spark, sf).withColumnRenamed("households", "actual_users")
    base = parameters(spark, sf).filter(F.col("scenario") == "base")
    padded = G.pad_years(actual, base, ["zip"], 1995, 2005)
    both = padded.withColumn("predicted_users", G.logistic("year", "capacity", "rate", "midpoint"))
    drawn = G.actual_and_projected(both, "actual_users", "predicted_users", 2001)
    return rounded(drawn.select("zip", "year", "users", "type", "slice"), 4)


@register("loess_series", with_ctes("zip_visits", then="""
pts AS (SELECT zip, (year(clean_date) * 12 + month(clean_date))::DOUBLE AS x, count(*)::DOUBLE AS y
        FROM zip_visits GROUP BY 1, 2),
pairs AS (SELECT a.zip, a.x AS x0, b.x - a.x AS u, b.y AS y, abs(b.x - a.x) AS gap,
                 row_number() OVER (PARTITION BY a.zip, a.x ORDER BY abs(b.x - a.x)) AS r,
                 CAST(floor(0.75::DOUBLE * count(*) OVER (PARTITION BY a.zip, a.x) + 0.00001::DOUBLE) AS INTEGER) AS k
          FROM pts a JOIN pts b ON a.zip = b.zip),
reach AS (SELECT *, max(CASE WHEN r = k THEN gap END) OVER (PARTITION BY zip, x0) AS h FROM pairs),
weighted AS (SELECT zip, x0, u, y, (1 - (gap / h) ** 3) ** 3 AS w FROM reach WHERE gap < h),
s AS (SELECT zip, x0, sum(w) AS n, sum(w*u) AS t1, sum(w*u*u) AS t2, sum(w*u*u*u) AS t3, sum(w*u*u*u*u) AS t4,
             sum(w*y) AS v1, sum(w*u*y) AS tv, sum(w*u*u*y) AS ttv FROM weighted GROUP BY zip, x0)""") + """
SELECT zip, x0 AS x, round((v1*(t2*t4 - t3*t3) - t1*(tv*t4 - t3*ttv) + t2*(tv*t3 - t2*ttv))
  / (n*(t2*t4 - t3*t3) - t1*(t1*t4 - t3*t2) + t2*(t1*t3 - t2*t2)), 4) AS smoothed FROM s""")
def loess_series(spark, sf):  # M14
    months = zip_visits(spark, sf).groupBy(
        "zip", (F.year("clean_date") * 12 + F.month("clean_date")).alias("x")
    ).agg(F.count(F.lit(1)).alias("y"))
    return rounded(loess(months, ["zip"], "x", "y"), 4)
