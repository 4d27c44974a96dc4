"""Queries over clusters and the demand model."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from ..functions import codes
from ..operators.clusters import (
    ClusterModel, descended, nearest, scale_parameters, silhouette_squared, weighted_points, z_scores,
)
from ..operators.poisson import PoissonModel, fit_poisson
from ..operators.reuse import written_once
from ..operators.silhouette import silhouette_euclidean
from ..plans import census as C
from ..plans import demand as D
from ..plans import segments as S
from ..plans import training as T
from ..plans import visits as V
from .areas import BY_ZIP, MEANS, zip_table
from .registry import register, rounded
from .standins import sql_bracket, visit_rows, with_ctes
from .training import MONTHLY

# Fixed centroids in standardised units, so that labels can be compared across engines.
CENTROIDS = {
    1: [-0.8, -0.9, 0.2, -1.0],
    2: [0.9, -0.7, -0.9, 1.0],
    3: [-0.6, 0.9, 0.8, 1.0],
    4: [1.0, 0.8, -0.5, -1.0],
}
_FEATURES = S.FEATURES
_SC = [f"sc_{f}" for f in _FEATURES]

_FIRST = """
first_time AS (
  SELECT houseHoldIdAfn, householdMembers, annualIncome, education_numeric,
         CASE WHEN lower(foodstamps) = 'yes' THEN 1 WHEN foodstamps IS NOT NULL THEN 0 END AS food_stamps
  FROM visit_rows QUALIFY row_number() OVER (PARTITION BY houseHoldIdAfn ORDER BY clean_date, householdMembers_key,
    foodstamps NULLS LAST, annualIncome, education, visit_id) = 1),
params AS (SELECT """ + ", ".join(
    f"avg({f}) AS center_{f}, stddev_samp({f}) AS scale_{f}" for f in _FEATURES
) + """ FROM first_time)"""


def _squared(c: int) -> str:
    return " + ".join(f"(sc_{f} - ({v}::DOUBLE)) * (sc_{f} - ({v}::DOUBLE))" for f, v in zip(_FEATURES, CENTROIDS[c]))


_LABELLED = """
scaled AS (SELECT houseHoldIdAfn, """ + ", ".join(
    f"({f} - center_{f}) / scale_{f} AS sc_{f}" for f in _FEATURES
) + """ FROM first_time, params),
dists AS (SELECT *, """ + ", ".join(f"{_squared(c)} AS d{c}" for c in CENTROIDS) + """ FROM scaled),
labelled AS (SELECT *, CAST(CASE WHEN d1 IS NULL THEN NULL WHEN d1 = least(d1, d2, d3, d4) THEN 1
  WHEN d2 = least(d1, d2, d3, d4) THEN 2 WHEN d3 = least(d1, d2, d3, d4) THEN 3 ELSE 4 END AS INTEGER) AS cluster
  FROM dists)"""


def first_time(spark, sf):
    """First visits, written once: scaling, fitting and labelling all start from them."""
    return written_once(V.first_time_table(visit_rows(spark, sf), ties=["visit_id"]))


def _labelled(spark, sf):
    households = S.with_food_stamps(first_time(spark, sf))
    scaled = z_scores(households, scale_parameters(households, _FEATURES), {f: f for f in _FEATURES})
    return scaled.withColumn("cluster", nearest(_SC, CENTROIDS)).select("houseHoldIdAfn", *_SC, "cluster")


@register("nearest_centroid", with_ctes("visit_rows", then=_FIRST + "," + _LABELLED) + """
SELECT houseHoldIdAfn, cluster FROM labelled""")
def nearest_centroid(spark, sf):  # J9 O3 M4
    return _labelled(spark, sf).select("houseHoldIdAfn", "cluster")


@register("zscore_reuse", with_ctes("visit_rows", "acs_raw", then=_FIRST + "," + BY_ZIP + "," + MEANS) + """
SELECT year, zip, round((avg_hh_size - "center_householdMembers") / "scale_householdMembers", 6) AS sc_avg_hh_size,
       round((avg_income - "center_annualIncome") / "scale_annualIncome", 6) AS sc_avg_income,
       round((avg_edu_num - center_education_numeric) / scale_education_numeric, 6) AS sc_avg_edu_num
FROM means, params""")
def zscore_reuse(spark, sf):  # M1 A21 F19 J8
    households = S.with_food_stamps(first_time(spark, sf))
    means = C.binned_means(zip_table(spark, sf))
    columns = {census: feature for feature, census in S.CENSUS_COLUMNS.items()}
    scaled = z_scores(means, scale_parameters(households, list(columns.values())), columns)
    return rounded(scaled.select("year", "zip", *[f"sc_{c}" for c in columns]), 6)


_STATS = """
known AS (SELECT * FROM labelled WHERE cluster IS NOT NULL),
stats AS (SELECT cluster AS k, count(*)::DOUBLE AS n, """ + ", ".join(f"sum({c}) AS s_{c}" for c in _SC) + ", sum(" + (
    " + ".join(f"{c} * {c}" for c in _SC)
) + """) AS q FROM known GROUP BY cluster),
totals AS (SELECT houseHoldIdAfn, cluster, k, n, n * (""" + " + ".join(f"{c} * {c}" for c in _SC) + ") - 2 * (" + (
    " + ".join(f"{c} * s_{c}" for c in _SC)
) + """) + q AS total FROM known, stats),
ab AS (SELECT houseHoldIdAfn, cluster, max(CASE WHEN k = cluster AND n > 1 THEN total / (n - 1) END) AS a,
              min(CASE WHEN k <> cluster THEN total / n END) AS b FROM totals GROUP BY 1, 2)"""
_WIDTH = """
SELECT houseHoldIdAfn, cluster, round(CASE WHEN a IS NULL THEN 0 ELSE coalesce((b - a) / nullif(greatest(a, b), 0), 0)
  END, 6) AS silhouette FROM ab"""


@register("silhouette_sq", with_ctes("visit_rows", then=_FIRST + "," + _LABELLED + "," + _STATS) + _WIDTH)
def silhouette_sq(spark, sf):  # M5 a
    rows = _labelled(spark, sf).filter(F.col("cluster").isNotNull())
    scored = silhouette_squared(rows, _SC, "cluster", list(CENTROIDS))
    return rounded(scored.select("houseHoldIdAfn", "cluster", "silhouette"), 6)


# Divisors of size, income bracket, education code and food stamps, which have few distinct values together.
_UNITS = {"householdMembers": 2.0, "bracket": 4.0, "education_numeric": 3.0, "food_stamps": 1.0}


@register("silhouette_euclidean", with_ctes("visit_rows", then=_FIRST + "," + _LABELLED + """,
coded AS (SELECT l.houseHoldIdAfn, l.cluster, """ + ", ".join(
    f"{sql_bracket('f.annualIncome') if c == 'bracket' else 'f.' + c} / {u}::DOUBLE AS u_{c}" for c, u in _UNITS.items()
) + """ FROM labelled l JOIN first_time f ON f.houseHoldIdAfn = l.houseHoldIdAfn WHERE l.cluster IS NOT NULL),
points AS (SELECT cluster, """ + ", ".join(f"u_{c}" for c in _UNITS) + """, count(*)::DOUBLE AS w FROM coded GROUP BY ALL),
sizes AS (SELECT cluster AS k, sum(w) AS n FROM points GROUP BY cluster),
sums AS (SELECT p.*, q.cluster AS k, sum(q.w * sqrt(""" + " + ".join(f"(p.u_{c} - q.u_{c}) ** 2" for c in _UNITS) + """)) AS total
         FROM points p, points q GROUP BY ALL),
ab AS (SELECT cluster, """ + ", ".join(f"u_{c}" for c in _UNITS) + """, max(CASE WHEN k = cluster AND n > 1 THEN total / (n - 1) END) AS a,
              min(CASE WHEN k <> cluster THEN total / n END) AS b FROM sums JOIN sizes USING (k) GROUP BY ALL)
SELECT houseHoldIdAfn, coded.cluster, round(CASE WHEN a IS NULL THEN 0 ELSE coalesce((b - a) / nullif(greatest(a, b), 0), 0)
  END, 6) AS silhouette FROM coded JOIN ab ON coded.cluster = ab.cluster AND """ + " AND ".join(
    f"coded.u_{c} = ab.u_{c}" for c in _UNITS)))
def silhouette_euclidean_exact(spark, sf):  # M5 b J10, without tolerance over points that repeat
    households = S.with_food_stamps(first_time(spark, sf))
    scaled = z_scores(households, scale_parameters(households, _FEATURES), {f: f for f in _FEATURES})
    coded = scaled.withColumns({"cluster": nearest(_SC, CENTROIDS), "bracket": codes.bracket_number("annualIncome")}).withColumns(
        {f"u_{c}": F.col(c) / F.lit(u) for c, u in _UNITS.items()})
    coded = coded.filter(F.col("cluster").isNotNull()).select("houseHoldIdAfn", "cluster", *[f"u_{c}" for c in _UNITS])
    widths = silhouette_euclidean(coded, [f"u_{c}" for c in _UNITS], "cluster")
    return rounded(widths.select("houseHoldIdAfn", "cluster", "silhouette"), 6)


@register("silhouette_bounds")
def silhouette_bounds(spark, sf):  # M5 b J10, over exact incomes: all pairs would grow with the square of the households
    rows = _labelled(spark, sf).filter(F.col("cluster").isNotNull())
    return silhouette_euclidean(rows, _SC, "cluster", tolerance=0.02).drop(*_SC)


def _fixed_model(households) -> ClusterModel:
    """The fixed centroids with the scaling of the table itself."""
    row = scale_parameters(households, _FEATURES).first()
    return ClusterModel(
        tuple(_FEATURES), {f: row[f"center_{f}"] for f in _FEATURES}, {f: row[f"scale_{f}"] for f in _FEATURES},
        {c: tuple(p) for c, p in CENTROIDS.items()}, 0.0, {},
    )


_PROFILES = """
raw AS (SELECT l.cluster, f.householdMembers, f.annualIncome, f.education_numeric
        FROM labelled l JOIN first_time f ON f.houseHoldIdAfn = l.houseHoldIdAfn WHERE l.cluster IS NOT NULL),
profiles AS (SELECT cluster, count(*) AS n_families, avg(householdMembers) AS avg_household,
                    avg(annualIncome) AS avg_income, avg(education_numeric) AS avg_education FROM raw GROUP BY cluster)"""


@register("segment_profiles", with_ctes("visit_rows", then=_FIRST + "," + _LABELLED + "," + _PROFILES) + """
SELECT cluster, n_families, round(avg_household, 4) AS avg_household, round(avg_income, 4) AS avg_income,
       round(avg_education, 4) AS avg_education FROM profiles""")
def segment_profiles(spark, sf):  # M3 A5 J1, fixed centroids
    households = S.with_food_stamps(first_time(spark, sf))
    return rounded(S.profiles(S.label_households(households, _fixed_model(households))), 4)


def _area_squared(c: int) -> str:
    parts = [(census, feature, CENTROIDS[c][_FEATURES.index(feature)]) for feature, census in S.CENSUS_COLUMNS.items()]
    return " + ".join(f'(({a} - center_{f}) / scale_{f} - ({v}::DOUBLE)) ** 2' for a, f, v in parts)


@register("segment_projection", with_ctes("visit_rows", "acs_raw", then=",".join(
    [_FIRST, _LABELLED, _PROFILES, BY_ZIP, MEANS])) + """,
area_dists AS (SELECT year, total_hh, """ + ", ".join(f"{_area_squared(c)} AS d{c}" for c in CENTROIDS) + """
               FROM means, params),
areas AS (SELECT year, CAST(CASE WHEN d1 = least(d1, d2, d3, d4) THEN 1 WHEN d2 = least(d1, d2, d3, d4) THEN 2
                      WHEN d3 = least(d1, d2, d3, d4) THEN 3 ELSE 4 END AS INTEGER) AS assigned_cluster, total_hh
          FROM area_dists),
summed AS (SELECT year, assigned_cluster, sum(total_hh) AS acs_households FROM areas GROUP BY year, assigned_cluster)
SELECT year, assigned_cluster, acs_households, n_families AS known_families, round(avg_household, 4) AS avg_household,
       round(avg_income, 4) AS avg_income, round(avg_education, 4) AS avg_education,
       acs_households - n_families AS projected_growth, round(n_families / acs_households, 6) AS "Percentage_Known"
FROM summed LEFT JOIN profiles ON assigned_cluster = cluster""")
def segment_projection(spark, sf):  # C11 M4 J2 P6 A4, fixed centroids
    households = S.with_food_stamps(first_time(spark, sf))
    model = _fixed_model(households)
    profiles = S.profiles(S.label_households(households, model))
    projected = S.projection(S.assign_areas(C.binned_means(zip_table(spark, sf)), model), profiles)
    projected = rounded(projected, 4, "avg_household", "avg_income", "avg_education")
    return rounded(projected, 6, "Percentage_Known")


_XS = ", ".join(f"x{j}" for j in range(len(_FEATURES)))


def _iteration(i: int) -> str:
    """The assignment to the centroids of iteration i, and the centroids of the next one."""
    distance = " + ".join(f"(p.x{j} - c.x{j}) ** 2" for j in range(len(_FEATURES)))
    return f"""
a{i} AS (SELECT p.*, c.cluster FROM complete p, c{i} c
         QUALIFY row_number() OVER (PARTITION BY p.houseHoldIdAfn ORDER BY {distance}, c.cluster) = 1),
c{i + 1} AS (SELECT cluster, {", ".join(f"avg(x{j}) AS x{j}" for j in range(len(_FEATURES)))} FROM a{i} GROUP BY cluster)"""


@register("kmeans_fixed_start", with_ctes("visit_rows", then=_FIRST + "," + _LABELLED + """,
complete AS (SELECT houseHoldIdAfn, """ + ", ".join(f"{c} AS x{j}" for j, c in enumerate(_SC)) + """ FROM labelled WHERE cluster IS NOT NULL),
c0 AS (SELECT * FROM (VALUES """ + ", ".join(
    f"({c}, {', '.join(f'{v}::DOUBLE' for v in point)})" for c, point in CENTROIDS.items()) + f""") AS v(cluster, {_XS})),"""
    + ",".join(_iteration(i) for i in range(6))) + """
SELECT CAST(c5.cluster AS INTEGER) AS cluster, (SELECT count(*) FROM a5 WHERE a5.cluster = c5.cluster) AS n_families, """
    + ", ".join(f"round(x{j}, 6) AS {c}" for j, c in enumerate(_SC)) + " FROM c5")
def kmeans_fixed_start(spark, sf):  # M2, five iterations from the same start as the SQL
    rows = _labelled(spark, sf).filter(F.col("cluster").isNotNull()).select(*_SC)
    points = written_once(weighted_points(rows, _SC))
    squares = points.agg(F.sum(F.col("weight") * sum(F.col(c) * F.col(c) for c in _SC))).first()[0]
    start = np.array([[CENTROIDS[c] for c in sorted(CENTROIDS)]])
    centroids, _ = descended(points, start, squares, max_iter=5, transfers=False)
    found = dict(zip(sorted(CENTROIDS), centroids[0].tolist()))
    counted = points.groupBy(nearest(_SC, found).alias("cluster")).agg(F.sum("weight").cast("long").alias("n_families"))
    named = spark.createDataFrame([(c, *p) for c, p in found.items()], ["cluster", *_SC]).withColumn("cluster", F.col("cluster").cast("int"))
    return rounded(named.join(counted, "cluster", "left").fillna(0, ["n_families"]).select("cluster", "n_families", *_SC), 6)


@register("kmeans_assign")
def kmeans_assign(spark, sf):  # M2 J1 P14 P17 F1
    households = first_time(spark, sf)
    labelled = S.label_households(households, S.fit_segments(households))
    return labelled.select("houseHoldIdAfn", *S.FEATURES, "cluster")


@register("cluster_profiles")
def cluster_profiles(spark, sf):  # M3 A5
    households = first_time(spark, sf)
    return S.profiles(S.label_households(households, S.fit_segments(households)))


@register("cluster_projection")
def cluster_projection(spark, sf):  # C11 J2 P6
    households = first_time(spark, sf)
    model = S.fit_segments(households)
    profiles = S.profiles(S.label_households(households, model))
    areas = S.assign_areas(C.binned_means(zip_table(spark, sf)), model)
    return S.projection(areas, profiles)


def _demand(spark, sf):
    return D.fit_demand(T.monthly_training(visit_rows(spark, sf)))


@register("poisson_fit")
def poisson_fit(spark, sf):  # M6 M7
    return _demand(spark, sf).table(spark)


@register("poisson_score")
def poisson_score(spark, sf):  # M8 M9 C7
    scored = D.score_areas(zip_table(spark, sf), _demand(spark, sf))
    return scored.select("year", "zip", "predicted_monthly_visits", "predicted_annual_visits")


@register("poisson_by_year", with_ctes("visit_rows", then=MONTHLY + """,
years AS (SELECT year(month_start) AS y, avg(pantry_visits) AS m, sum(pantry_visits)::DOUBLE AS s FROM monthly GROUP BY 1),
base AS (SELECT y AS y0, m AS m0, s AS s0 FROM years WHERE y = (SELECT min(y) FROM years)),
fit AS (SELECT 2 * sum(pantry_visits * ln(pantry_visits / m) - (pantry_visits - m)) AS deviance,
               2 * sum(pantry_visits * ln(pantry_visits / (SELECT avg(pantry_visits) FROM monthly))) AS null_deviance,
               2 * (SELECT count(*) FROM years) - 2 * sum(pantry_visits * ln(m) - m - lgamma(pantry_visits + 1)) AS aic
        FROM monthly JOIN years ON year(month_start) = y),
terms AS (SELECT 'y' || CAST(y AS VARCHAR) AS term, CASE WHEN y > y0 THEN ln(m / m0) END AS estimate,
                 CASE WHEN y > y0 THEN sqrt(1 / s + 1 / s0) END AS std_error, y = y0 AS aliased FROM years, base
          UNION ALL SELECT '(Intercept)', ln(m0), sqrt(1 / s0), false FROM base),
ends AS (SELECT *, least(abs(estimate / std_error), 12) AS e FROM terms),
areas AS (SELECT term, sum(CASE WHEN i IN (0, 4000) THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END * exp(-power(e * i / 4000, 2) / 2))
                       * max(e) / 12000 AS area FROM ends, generate_series(0, 4000) AS g(i) GROUP BY term)""") + """
SELECT term, round(estimate, 6) AS estimate, round(std_error, 6) AS std_error, round(estimate / std_error, 4) AS z_value,
       CASE WHEN estimate IS NOT NULL THEN round(greatest(1 - sqrt(2 / pi()) * area, 0), 6) END AS p_value, aliased, round(deviance, 4) AS deviance,
       round(null_deviance, 4) AS null_deviance, round(aic, 4) AS aic FROM ends JOIN areas USING (term), fit""")
def poisson_by_year(spark, sf):  # M6 M7 with an aliased term
    # Year flags: the model then has a closed form, and the flag of the first year is a combination of the others. The SQL
    # integrates the normal density for p values.
    monthly = T.monthly_training(visit_rows(spark, sf))
    first, *later = sorted(r[0] for r in monthly.select(F.year("month_start")).distinct().collect())
    flags = {f"y{y}": (F.year("month_start") == y).cast("int") for y in [*later, first]}
    table = fit_poisson(monthly.withColumns(flags), "pantry_visits", list(flags)).table(spark)
    return rounded(rounded(table, 6, "estimate", "std_error", "p_value"), 4, "z_value", "deviance", "null_deviance", "aic")


# Fixed coefficients, so that scoring can be compared across engines.
_COEFFICIENTS = {"edu1": 0.002, "edu7": -0.001, "hhsize6": 0.003, "income1": -0.004, "income15": 0.0005}


@register("poisson_score_fixed", with_ctes("acs_raw", then=BY_ZIP) + """
SELECT year, zip, round(p, 6) AS predicted_monthly_visits, round(p * 12, 6) AS predicted_annual_visits
FROM (SELECT year, zip, exp(1.5::DOUBLE + 0.002::DOUBLE * edu1 - 0.001::DOUBLE * (edu9 + edu10)
        + 0.003::DOUBLE * (hhsize6 + hhsize7) - 0.004::DOUBLE * income1 + 0.0005::DOUBLE * income15) AS p FROM by_zip)""")
def poisson_score_fixed(spark, sf):  # M8 M9 C7
    model = PoissonModel(tuple(_COEFFICIENTS), 1.5, _COEFFICIENTS, (), {}, {}, 0.0, 0.0, 0.0, 0)
    scored = D.score_areas(zip_table(spark, sf), model)
    return rounded(scored.select("year", "zip", "predicted_monthly_visits", "predicted_annual_visits"), 6)
