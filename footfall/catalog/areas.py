"""Queries over census-like counts and map frames."""

from __future__ import annotations

from uuid import uuid4

from pyspark.sql import functions as F

from ..functions.codes import INCOME_MIDPOINTS
from ..functions.nulls import plain_sum
from ..names import COUNT_CODES, EDU, FOODSTAMP_TOTAL, FOODSTAMP_YES, HHSIZE, INCOME, METRO_ZIPS, SHORT_NAMES, ZIP_COLUMN
from ..operators.frames import columns_first, in_box
from ..operators.reuse import scratch_folder
from ..plans import census as C
from ..plans import households as H
from ..plans import maps as M
from ..plans import visits as V
from ..sources.census import acs_table, read_acs
from .registry import register, rounded
from .standins import acs_raw, order_visits, persons_v8, table, with_ctes, zip_shapes, zip_visits
from .visits import VISIT_TABLE

_ZIPS = "(" + ", ".join(f"'{z}'" for z in METRO_ZIPS) + ")"
_SUMS = ", ".join(f"coalesce(sum({c}), 0)::DOUBLE AS {SHORT_NAMES.get(c, c)}" for c in COUNT_CODES)
_RATE = f"CASE WHEN {FOODSTAMP_TOTAL} = 0 THEN NULL ELSE {FOODSTAMP_YES} / {FOODSTAMP_TOTAL} END AS avg_foodstamps"

BY_ZIP = f"""
by_zip AS (SELECT *, {_RATE} FROM (SELECT year, zip, {_SUMS} FROM acs_raw WHERE zip IN {_ZIPS} GROUP BY year, zip))"""
_TOTALS = f"""
totals AS (SELECT *, {_RATE} FROM (SELECT year, {_SUMS} FROM acs_raw WHERE zip IN {_ZIPS} GROUP BY year))"""


def _plus(names) -> str:
    return " + ".join(f"coalesce({n}, 0)" for n in names)


_HARMONISED = """
harmonised AS (SELECT year, zip, """ + ", ".join([*INCOME, *HHSIZE]) + f""", {FOODSTAMP_TOTAL}, {FOODSTAMP_YES},
  avg_foodstamps, """ + ", ".join(
    f"{_plus([f'edu{i}' for i in parts])} AS edu{g}" for g, parts in C.EDUCATION_GROUPS.items()
) + """ FROM by_zip)"""


def zip_table(spark, sf):
    return C.by_zip(C.in_zips(acs_raw(spark, sf)))


@register("zip_filter", with_ctes("acs_raw") + f"""
SELECT *, round({FOODSTAMP_YES} / {FOODSTAMP_TOTAL}, 6) AS snap_rate FROM acs_raw WHERE zip IN {_ZIPS}""")
def zip_filter(spark, sf):  # P13 F20
    return rounded(C.with_snap_rate(C.in_zips(acs_raw(spark, sf))), 6, "snap_rate")


@register("acs_rollup", with_ctes("acs_raw", then=BY_ZIP + "," + _TOTALS) + """
SELECT 'zip' AS grain, * REPLACE (round(avg_foodstamps, 6) AS avg_foodstamps) FROM by_zip
UNION ALL BY NAME
SELECT 'metro' AS grain, CAST(NULL AS VARCHAR) AS zip, * REPLACE (round(avg_foodstamps, 6) AS avg_foodstamps)
FROM totals""")
def acs_rollup(spark, sf):  # C5 A3 A16 A17 P7
    return rounded(C.by_zip_and_total(C.in_zips(acs_raw(spark, sf))), 6, "avg_foodstamps")


@register("edu_harmonised", with_ctes("acs_raw", then=BY_ZIP + "," + _HARMONISED) + """
SELECT * REPLACE (round(avg_foodstamps, 6) AS avg_foodstamps) FROM harmonised""")
def edu_harmonised(spark, sf):  # C6 A22 P3 P4
    return rounded(columns_first(C.harmonise_education(zip_table(spark, sf)), ["zip", "year"]), 6, "avg_foodstamps")


@register("at_risk", with_ctes("acs_raw", then=BY_ZIP + "," + _HARMONISED) + f"""
SELECT year, zip, edu7 + edu3 + edu4 AS matching_education, {" + ".join(INCOME[:8])} AS matching_income,
       least(edu7 + edu3 + edu4, {" + ".join(INCOME[:8])}) AS at_risk_estimate FROM harmonised""")
def at_risk(spark, sf):  # C8 F10 P10
    return C.at_risk(C.harmonise_education(zip_table(spark, sf)))


_HARMONISED_METRO = """
harmonised AS (SELECT year, """ + ", ".join([*INCOME, *HHSIZE]) + f""", {FOODSTAMP_TOTAL}, {FOODSTAMP_YES},
  avg_foodstamps, """ + ", ".join(
    f"{_plus([f'edu{i}' for i in parts])} AS edu{g}" for g, parts in C.EDUCATION_GROUPS.items()
) + """ FROM totals)"""


def _metro(spark, sf):
    return C.harmonise_education(C.totals(C.in_zips(acs_raw(spark, sf))))


@register("edu_harmonised_metro", with_ctes("acs_raw", then=_TOTALS + "," + _HARMONISED_METRO) + """
SELECT * REPLACE (round(avg_foodstamps, 6) AS avg_foodstamps) FROM harmonised""")
def edu_harmonised_metro(spark, sf):  # C6, metro grain
    return rounded(_metro(spark, sf), 6, "avg_foodstamps")


@register("at_risk_metro", with_ctes("acs_raw", then=_TOTALS + "," + _HARMONISED_METRO) + f"""
SELECT year, edu7 + edu3 + edu4 AS matching_education, {" + ".join(INCOME[:8])} AS matching_income,
       least(edu7 + edu3 + edu4, {" + ".join(INCOME[:8])}) AS at_risk_estimate FROM harmonised""")
def at_risk_metro(spark, sf):  # C8, metro grain
    return C.at_risk(_metro(spark, sf))


@register("estimated_need", with_ctes("acs_raw", then=BY_ZIP + "," + _TOTALS) + f"""
SELECT year, zip, {" + ".join(INCOME[:8])} AS estimated_acs_need FROM by_zip
UNION ALL
SELECT year, 'metro', {" + ".join(INCOME[:7])} FROM totals""")
def estimated_need(spark, sf):  # C9 F20
    both = C.by_zip_and_total(C.in_zips(acs_raw(spark, sf)))
    # One rollup serves both grains; the ZIP estimate takes eight brackets, the metro estimate seven.
    return both.select(
        "year", F.coalesce("zip", F.lit("metro")).alias("zip"),
        F.when(F.col("grain") == "zip", plain_sum(INCOME[:8])).otherwise(plain_sum(INCOME[:7])).alias("estimated_acs_need"),
    )


@register("estimated_need_by_zip", with_ctes("acs_raw", then=BY_ZIP) + f"""
SELECT year, zip, {" + ".join(INCOME[:8])} AS estimated_acs_need FROM by_zip""")
def estimated_need_by_zip(spark, sf):  # C9 P2
    return C.estimated_need(zip_table(spark, sf))


_COUNTS = [*[f"edu{g}" for g in C.EDUCATION_GROUPS], *HHSIZE, *INCOME]


@register("scaled_acs", with_ctes("acs_raw", then=BY_ZIP + "," + _HARMONISED + """,
households AS (SELECT year(o_orderdate) AS y, count(DISTINCT o_custkey)::DOUBLE AS n FROM orders GROUP BY 1),
factors AS (SELECT harmonised.*, n / (""" + _plus(INCOME) + """) AS f FROM harmonised LEFT JOIN households ON year = y)""")
    + "SELECT year, zip, round(f, 6) AS scaling_factor, "
    + ", ".join(f"round({c} * f, 6) AS {c}" for c in _COUNTS) + " FROM factors")
def scaled_acs(spark, sf):  # C10 P5 P9, each census year by the households of that year
    households = V.households_per_year(order_visits(spark, sf))
    scaled = C.scale_to_households(C.harmonise_education(zip_table(spark, sf)), households)
    return rounded(scaled.select("year", "zip", "scaling_factor", *_COUNTS), 6)


def _weighted(names, weights) -> str:
    return "(" + " + ".join(f"{n} * {float(w)}::DOUBLE" for n, w in zip(names, weights)) + ")"


_TOTAL_HH = "(" + " + ".join(HHSIZE) + ")"
_TOTAL_EDU = "(" + " + ".join(EDU) + ")"
MEANS = f"""
means AS (SELECT year, zip, {_TOTAL_HH} AS total_hh, {_weighted(HHSIZE, range(1, 8))} / {_TOTAL_HH} AS avg_hh_size,
  {_weighted(INCOME, INCOME_MIDPOINTS)} / {_TOTAL_HH} AS avg_income,
  {_weighted(EDU, range(1, 17))} / {_TOTAL_EDU} AS avg_edu_num, avg_foodstamps AS snap_rate FROM by_zip)"""
_MEAN_COLUMNS = ["avg_hh_size", "avg_income", "avg_edu_num", "snap_rate"]
_ROUNDED_MEANS = "year, zip, total_hh, " + ", ".join(f"round({c}, 6) AS {c}" for c in _MEAN_COLUMNS)


@register("binned_means", with_ctes("acs_raw", then=BY_ZIP + "," + MEANS) + f"SELECT {_ROUNDED_MEANS} FROM means")
def binned_means(spark, sf):  # A23 F23
    means = C.binned_means(zip_table(spark, sf))
    return rounded(means.select("year", "zip", "total_hh", *_MEAN_COLUMNS), 6, *_MEAN_COLUMNS)


def _recycled(names, weights) -> str:
    listed = "[" + ", ".join(f"{float(w)}::DOUBLE" for w in weights) + "]"
    return "(" + " + ".join(
        f"{c} * ({listed})[CAST(({j} * n + i - 1) % {len(list(weights))} AS INTEGER) + 1]" for j, c in enumerate(names)
    ) + ")"


@register("recycled_means", with_ctes("acs_raw", then=BY_ZIP + """,
rows AS (SELECT *, row_number() OVER (ORDER BY year, zip) AS i, count(*) OVER () AS n FROM by_zip)""") + f"""
SELECT year, zip, round({_recycled(HHSIZE, range(1, 8))} / {_TOTAL_HH}, 6) AS avg_hh_size,
       round({_recycled(INCOME, INCOME_MIDPOINTS)} / {_TOTAL_HH}, 6) AS avg_income,
       round({_recycled(EDU, range(1, 17))} / {_TOTAL_HH}, 6) AS avg_edu_num FROM rows""")
def recycled_means(spark, sf):  # A23 W5, recycling option
    means = C.binned_means(zip_table(spark, sf), recycle="column_major", edu_denominator="households")
    return rounded(means.select("year", "zip", "avg_hh_size", "avg_income", "avg_edu_num"), 6)


def acs_responses(spark, sf):
    """One JSON response per year, as the census service would send it: header row, then one row per area.

    A zero count is sent as null in the income columns and as the text "-" in the education columns.
    """
    def cell(c):
        zero = F.lit("-") if c.startswith("B15003") else F.lit(None)
        return F.when(F.col(c) == 0, zero).otherwise(F.col(c).cast("bigint").cast("string"))

    raw = acs_raw(spark, sf)
    cells = F.array(F.col("NAME"), *[cell(c) for c in COUNT_CODES], F.col("zip"))
    header = F.array(*[F.lit(n) for n in ["NAME", *COUNT_CODES, ZIP_COLUMN]])
    # A response lists areas, so its length is the number of areas, not of visits.
    return raw.groupBy("year").agg(F.collect_list(cells).alias("rows")).select(
        "year", F.to_json(F.concat(F.array(header), F.col("rows"))).alias("value")
    )


@register("acs_json_rows", with_ctes("acs_raw") + "SELECT year, NAME, zip, "
          + ", ".join(f"nullif({c}, 0) AS {c}" for c in COUNT_CODES) + " FROM acs_raw")
def acs_json_rows(spark, sf):  # S2 S3 P8 F11 F24
    return acs_table(acs_responses(spark, sf))


@register("acs_file_rows", with_ctes("acs_raw") + "SELECT year, NAME, zip, "
          + ", ".join(f"nullif({c}, 0) AS {c}" for c in COUNT_CODES) + " FROM acs_raw WHERE year BETWEEN 1997 AND 1999")
def acs_file_rows(spark, sf):  # S2 S4, responses landed as files that are read in parts
    folder = f"{scratch_folder(spark)}/responses-{uuid4().hex}"
    acs_responses(spark, sf).write.partitionBy("year").text(folder)
    return read_acs(spark, folder, years=[1997, 1998, 1999])


_BEST_ZIP = """
best AS (
  SELECT zip, served_year FROM visit QUALIFY row_number() OVER (PARTITION BY afn ORDER BY education_numeric DESC
    NULLS LAST, served_date NULLS LAST, annual_income NULLS LAST, education NULLS LAST) = 1),
counts AS (SELECT zip, count(*) AS count FROM best WHERE served_year BETWEEN 1995 AND 1999 GROUP BY zip)"""


def _counts(spark, sf):
    visit = V.visit_table(V.clean_visits_v8(persons_v8(spark, sf)), first_within="visit")
    return H.households_by_zip(H.best_education_visit(visit), 1995, 1999)


@register("additional_need", with_ctes("persons_v8", "acs_raw", then=VISIT_TABLE + "," + _BEST_ZIP + "," + BY_ZIP) + f"""
SELECT zip, count, estimated_acs_need, coalesce(estimated_acs_need, 0) - coalesce(count, 0) AS additional
FROM counts FULL JOIN (SELECT zip, {" + ".join(INCOME[:8])} AS estimated_acs_need FROM by_zip WHERE year = 1999)
  USING (zip) WHERE zip IN {_ZIPS}""")
def additional_need(spark, sf):  # C14 J5 F9 P13
    need = C.estimated_need(zip_table(spark, sf)).filter(F.col("year") == 1999).drop("year")
    return M.additional_need(_counts(spark, sf), need)


_ZIP_COUNTS = "counts AS (SELECT zip, count(DISTINCT houseHoldIdAfn) AS count FROM zip_visits GROUP BY zip)"


@register("map_frame", with_ctes("zip_shapes", "zip_visits", then="""
counts AS (SELECT zip, count(DISTINCT houseHoldIdAfn) AS count FROM zip_visits GROUP BY zip)""")
    + """
SELECT zip_shapes.*, count FROM zip_shapes LEFT JOIN counts ON zip_shapes.zip = counts.zip
WHERE xmax >= -93.9::DOUBLE AND xmin <= -93.4::DOUBLE AND ymax >= 41.4::DOUBLE AND ymin <= 41.8::DOUBLE""")
def map_frame(spark, sf):  # C15 J4 S6 P19
    counts = zip_visits(spark, sf).groupBy("zip").agg(F.count_distinct("houseHoldIdAfn").alias("count"))
    return M.map_frame(zip_shapes(spark, sf), counts)


@register("zip_in_shapes", with_ctes("zip_shapes", "zip_visits", then=_ZIP_COUNTS) + """
SELECT * FROM counts SEMI JOIN (SELECT zip FROM zip_shapes WHERE xmax >= -93.9::DOUBLE AND xmin <= -93.4::DOUBLE
  AND ymax >= 41.4::DOUBLE AND ymin <= 41.8::DOUBLE) s ON counts.zip = s.zip""")
def zip_in_shapes(spark, sf):  # J6
    counts = zip_visits(spark, sf).groupBy("zip").agg(F.count_distinct("houseHoldIdAfn").alias("count"))
    return M.known_zips(counts, in_box(zip_shapes(spark, sf), M.METRO_BOX))


@register("bbox_rows", """
SELECT * FROM (SELECT vec_id, label, embedding[1]::DOUBLE - 0.05::DOUBLE AS xmin, embedding[2]::DOUBLE - 0.05::DOUBLE
  AS ymin, embedding[1]::DOUBLE + 0.05::DOUBLE AS xmax, embedding[2]::DOUBLE + 0.05::DOUBLE AS ymax FROM embeddings)
WHERE xmax >= -0.1::DOUBLE AND xmin <= 0.1::DOUBLE AND ymax >= -0.1::DOUBLE AND ymin <= 0.1::DOUBLE""")
def bbox_rows(spark, sf):  # P19
    x, y = F.col("embedding")[0].cast("double"), F.col("embedding")[1].cast("double")
    extents = table(spark, sf, "embeddings").select(
        "vec_id", "label", (x - 0.05).alias("xmin"), (y - 0.05).alias("ymin"),
        (x + 0.05).alias("xmax"), (y + 0.05).alias("ymax"),
    )
    return in_box(extents, (-0.1, -0.1, 0.1, 0.1))
