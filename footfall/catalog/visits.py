"""Queries over visits: cleaning, visit tables, counts over time."""

from __future__ import annotations

from uuid import uuid4

from pyspark.sql import functions as F

from ..functions import codes, dates
from ..functions.nulls import if_else
from ..operators.frames import inline_table, keep_rows, stack, top_rows
from ..operators.groups import flag_group_min
from ..operators.quantiles import group_quantiles, value_summary
from ..operators.reuse import scratch_folder
from ..operators.row_ids import row_ids
from ..plans import visits as V
from ..sources.tables import csv_types, read_csv_inferred, write_csv
from .registry import register, rounded
from .standins import (
    order_visits, persons, persons_v8, sql_bracket, sql_code, sql_zip, table, visit_rows, with_ctes, zip_of,
)


@register("clean_visits", with_ctes("persons") + """
SELECT * FROM persons WHERE clean_date > DATE '1996-12-31'""")
def clean_visits(spark, sf):  # C1 P1 P11 F12
    return V.clean_visits(persons(spark, sf), after="1996-12-31").drop("servedDate")


@register("clean_visits_v8", with_ctes("persons_v8") + """
SELECT * FROM persons_v8 WHERE annual_income >= 0""")
def clean_visits_v8(spark, sf):  # C1 P21 F14
    return V.clean_visits_v8(persons_v8(spark, sf))


@register("na_row_subset", with_ctes("visit_rows") + """
SELECT CASE WHEN foodstamps = 'Yes' THEN visit_id END AS visit_id,
       CASE WHEN foodstamps = 'Yes' THEN foodstamps END AS foodstamps,
       CASE WHEN foodstamps = 'Yes' THEN clean_date END AS clean_date
FROM visit_rows WHERE foodstamps = 'Yes' OR foodstamps IS NULL""")
def na_row_subset(spark, sf):  # P12
    df = visit_rows(spark, sf).select("visit_id", "foodstamps", "clean_date")
    return keep_rows(df, F.col("foodstamps") == "Yes", na_rows="keep")


@register("negative_count", "SELECT count(*) FILTER (WHERE c_acctbal < 0) AS n_negative FROM customer")
def negative_count(spark, sf):  # A8
    return V.count_negative(table(spark, sf, "customer"), "c_acctbal")


@register("income_summary", """
SELECT round(min(o_totalprice), 4) AS min, round(quantile_cont(o_totalprice, 0.25), 4) AS q1,
       round(quantile_cont(o_totalprice, 0.5), 4) AS median, round(avg(o_totalprice), 4) AS mean,
       round(quantile_cont(o_totalprice, 0.75), 4) AS q3, round(max(o_totalprice), 4) AS max,
       count(*) FILTER (WHERE o_totalprice IS NULL) AS n_null
FROM orders""")
def income_summary(spark, sf):  # A19
    return rounded(value_summary(table(spark, sf, "orders"), "o_totalprice"), 4)


@register("income_p95", """
SELECT zip, round(quantile_cont(o_totalprice, 0.95), 4) AS income_95th_percentile
FROM (SELECT """ + sql_zip("c_nationkey") + """ AS zip, o_totalprice
      FROM orders JOIN customer ON o_custkey = c_custkey) GROUP BY zip""")
def income_p95(spark, sf):  # A12
    rows = table(spark, sf, "orders").join(
        table(spark, sf, "customer"), F.col("o_custkey") == F.col("c_custkey")
    ).select(zip_of("c_nationkey").alias("zip"), "o_totalprice")
    return rounded(group_quantiles(rows, ["zip"], "o_totalprice", {"income_95th_percentile": 0.95}), 4)


@register("distinct_values", with_ctes("persons") + "SELECT DISTINCT education, foodstamps FROM persons")
def distinct_values(spark, sf):  # A13
    return persons(spark, sf).select("education", "foodstamps").distinct()


@register("top_rows", """
SELECT o_orderkey, o_custkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 6""")
def first_rows(spark, sf):  # O2 S9
    orders = table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_totalprice")
    return top_rows(orders, F.col("o_totalprice").desc(), F.col("o_orderkey"))


_FIRST_VISIT = f"""
sized AS (
  SELECT houseHoldIdAfn, householdMembers AS householdMembers_key, count(*) AS householdMembers, foodstamps, clean_date,
         annualIncome, education
  FROM persons GROUP BY houseHoldIdAfn, householdMembers, foodstamps, clean_date, annualIncome, education),
first_visit AS (
  SELECT *, CAST(year(clean_date) AS INTEGER) AS served_year, CAST(month(clean_date) AS INTEGER) AS served_month,
         CAST(day(clean_date) AS INTEGER) AS served_day_of_month,
         CAST(CASE WHEN clean_date = min(clean_date) OVER (PARTITION BY houseHoldIdAfn) THEN 1
              WHEN clean_date IS NOT NULL THEN 0 END AS INTEGER) AS first_visit,
         {sql_code("education", codes.EDUCATION_1_9)} AS education_numeric
  FROM sized)"""


@register("first_visit_build", with_ctes("persons", then=_FIRST_VISIT) + "SELECT * FROM first_visit")
def first_visit_build(spark, sf):  # C2 A24 F15 F4 W3
    return V.first_visit_table(V.clean_visits(persons(spark, sf), after=None))


@register("first_time", with_ctes("persons", then=_FIRST_VISIT) + """
SELECT * FROM first_visit QUALIFY row_number() OVER (PARTITION BY houseHoldIdAfn ORDER BY clean_date NULLS LAST,
  householdMembers_key NULLS LAST, foodstamps NULLS LAST, annualIncome NULLS LAST, education NULLS LAST) = 1""")
def first_time(spark, sf):  # W2 C3
    return V.first_time_table(V.first_visit_table(V.clean_visits(persons(spark, sf), after=None)))


@register("monthly_first", with_ctes("visit_rows") + """
SELECT CAST(date_trunc('month', d) AS DATE) AS month_start, count(*) AS num_first_visits
FROM (SELECT min(clean_date) AS d FROM visit_rows GROUP BY houseHoldIdAfn) GROUP BY 1""")
def monthly_first(spark, sf):  # C3 A2 F16 O1
    return V.monthly_first_visits(V.first_time_table(visit_rows(spark, sf)))


@register("first_flag", with_ctes("visit_rows") + """
SELECT visit_id, CAST(CASE WHEN clean_date = min(clean_date) OVER (PARTITION BY houseHoldIdAfn) THEN 1 ELSE 0 END
  AS INTEGER) AS first_visit FROM visit_rows""")
def first_flag(spark, sf):  # W3
    rows = visit_rows(spark, sf).select("visit_id", "houseHoldIdAfn", "clean_date")
    return flag_group_min(rows, ["houseHoldIdAfn"], "clean_date", "first_visit").select("visit_id", "first_visit")


_ROUND = """CAST(CASE WHEN 2 * (day({d}) - 1) >= day(last_day({d})) THEN date_trunc('month', {d}) + INTERVAL 1 MONTH
  ELSE date_trunc('month', {d}) END AS DATE)"""
VISIT_TABLE = f"""
visit AS (
  SELECT *, CAST(CASE WHEN served_date = min(served_date) OVER (PARTITION BY afn) THEN 1
                 WHEN served_date IS NOT NULL THEN 0 END AS INTEGER) AS first_visit,
         CAST(year(served_date) AS INTEGER) AS served_year, CAST(month(served_date) AS INTEGER) AS served_month,
         CAST(day(served_date) AS INTEGER) AS served_day_of_month, {_ROUND.format(d="served_date")} AS round_month,
         {sql_code("education", codes.EDUCATION_0_11)} AS education_numeric
  FROM (SELECT afn, served_date, annual_income, education, count(*) AS n_household, min(zip) AS zip
        FROM persons_v8 WHERE annual_income >= 0 GROUP BY afn, served_date, annual_income, education))"""


def visit_frame(spark, sf):
    return V.visit_table(V.clean_visits_v8(persons_v8(spark, sf)))


@register("visit_table", with_ctes("persons_v8", then=VISIT_TABLE) + "SELECT * FROM visit")
def visit_table(spark, sf):  # C2 A1 A9 F5 F15 F18 W3
    return visit_frame(spark, sf)


@register("round_month_visits", with_ctes("persons_v8", then=VISIT_TABLE) + """
SELECT round_month, count(*) AS "num_VISITS", CAST(sum(n_household) AS BIGINT) AS "num_PEOPLE_SERVED"
FROM visit GROUP BY round_month""")
def round_month_visits(spark, sf):  # C18 A1 A4 F18
    persons = V.clean_visits_v8(persons_v8(spark, sf))
    return V.rounded_month_counts(V.visit_table(persons, first_within="visit"))


@register("first_visits_by_month", with_ctes("persons_v8", then=VISIT_TABLE) + """
SELECT round_month, count(*) AS count_first_visits FROM visit
WHERE first_visit = 1 AND served_date > DATE '1995-06-30' GROUP BY round_month""")
def first_visits_by_month(spark, sf):  # C18
    return V.first_visits_by_rounded_month(visit_frame(spark, sf), after="1995-06-30")


@register("first_visits_by_week", with_ctes("persons_v8", then=VISIT_TABLE) + """
SELECT CAST(served_date - CAST(dayofweek(served_date) AS INTEGER) AS DATE) AS week_start,
       count(*) AS count_first_visits
FROM visit WHERE first_visit = 1 AND year(served_date) = 1995 GROUP BY 1""")
def first_visits_by_week(spark, sf):  # C18 F17
    return V.first_visits_by_week(visit_frame(spark, sf), year=1995)


@register("monthly_visits", """
SELECT CAST(date_trunc('month', o_orderdate) AS DATE) AS month_start, count(*) AS num_total_visits
FROM orders GROUP BY 1 HAVING CAST(date_trunc('month', o_orderdate) AS DATE) BETWEEN DATE '1996-01-01'
  AND DATE '2000-04-01'""")
def monthly_visits(spark, sf):  # C17 A2 F16 P11
    return V.monthly_totals(order_visits(spark, sf), "1996-01-01", "2000-04-01")


@register("weekly_events", """
SELECT CAST(CAST(ts AS DATE) - CAST(dayofweek(ts) AS INTEGER) AS DATE) AS week_start, count(*) AS n
FROM events GROUP BY 1""")
def weekly_events(spark, sf):  # F17
    return V.count_by(table(spark, sf, "events"), dates.week_floor("ts"), "week_start", "n")


@register("yearly_households", """
SELECT CAST(year(o_orderdate) AS INTEGER) AS year, count(DISTINCT o_custkey) AS unique_households
FROM orders GROUP BY 1""")
def yearly_households(spark, sf):  # A10
    return V.households_per_year(order_visits(spark, sf))


@register("households_in_year", """
SELECT count(DISTINCT o_custkey) AS total_households FROM orders
WHERE o_orderdate >= TIMESTAMP '1999-01-01' AND o_orderdate < TIMESTAMP '2000-01-01'""")
def households_in_year(spark, sf):  # A15
    return V.households_in_year(order_visits(spark, sf), 1999)


@register("yearly_metric_union", """
SELECT CAST(year(o_orderdate) AS INTEGER) AS served_year, count(*) AS value, 'Total Visits' AS metric
FROM orders WHERE year(o_orderdate) BETWEEN 1996 AND 2000 GROUP BY 1
UNION ALL
SELECT CAST(year(o_orderdate) AS INTEGER), count(DISTINCT o_custkey), 'Unique Households'
FROM orders WHERE year(o_orderdate) BETWEEN 1997 AND 2000 GROUP BY 1""")
def yearly_metric_union(spark, sf):  # C16 U2 P18
    return V.visits_and_households(order_visits(spark, sf), 1996, 2000, households_after=1996)


_GIVEN = [(1997, 17730), (1998, 19032), (1999, 18318), (2001, 15509)]


@register("visits_and_given_households", """
SELECT CAST(year(o_orderdate) AS INTEGER) AS served_year, count(*) AS value, 'Total Visits' AS metric
FROM orders WHERE year(o_orderdate) BETWEEN 1996 AND 2000 GROUP BY 1
UNION ALL
SELECT served_year, value, 'Unique Households'
FROM (VALUES (1997, 17730), (1998, 19032), (1999, 18318)) AS given(served_year, value)""")
def visits_and_given_households(spark, sf):  # C16 S5: visits against a given yearly table
    given = inline_table(spark, _GIVEN, "served_year INT, unique_households BIGINT")
    return V.visits_and_households(order_visits(spark, sf), 1996, 2000, households=given)


@register("bar_counts", with_ctes("persons_v8", then="""
hh AS (SELECT DISTINCT afn, annual_income, family_type, housing FROM persons_v8)""") + """
SELECT 'family_type' AS variable, family_type AS category, count(*) AS count FROM hh GROUP BY family_type
UNION ALL
SELECT 'housing', housing, count(*) FROM hh GROUP BY housing""")
def bar_counts(spark, sf):  # A20
    # Both charts come from one pass: each household row is counted once per variable.
    incomes = V.household_incomes(persons_v8(spark, sf))
    pairs = F.explode(F.array(*[
        F.struct(F.lit(c).alias("variable"), F.col(c).alias("category")) for c in ("family_type", "housing")
    ]))
    return incomes.select(pairs.alias("p")).select("p.*").groupBy("variable", "category").agg(
        F.count(F.lit(1)).alias("count")
    )


@register("income_brackets", f"""
SELECT 'income' || CAST({sql_bracket("o_totalprice")} AS VARCHAR) AS income_bracket, count(*) AS n
FROM orders GROUP BY 1""")
def income_brackets(spark, sf):  # F6
    return table(spark, sf, "orders").groupBy(codes.bracket_label("o_totalprice").alias("income_bracket")).agg(
        F.count(F.lit(1)).alias("n")
    )


@register("education_codes", with_ctes("persons", "persons_v8") + f"""
SELECT 'first' AS export, education, {sql_code("education", codes.EDUCATION_1_9)} AS code, count(*) AS n
FROM persons GROUP BY education
UNION ALL
SELECT 'second', education, {sql_code("education", codes.EDUCATION_0_11)}, count(*) FROM persons_v8 GROUP BY education""")
def education_codes(spark, sf):  # F4 F5
    def coded(df, export, scale):
        # Counted per label first, so the code is looked up once per label.
        return df.groupBy("education").agg(F.count(F.lit(1)).alias("n")).select(
            F.lit(export).alias("export"), "education", codes.code_of("education", scale).alias("code"), "n"
        )

    return coded(persons(spark, sf), "first", codes.EDUCATION_1_9).unionByName(
        coded(persons_v8(spark, sf), "second", codes.EDUCATION_0_11)
    )


@register("code_names", f"""
SELECT lpad(CAST(c_nationkey AS VARCHAR), 5, '0') AS area, printf('B19001_%03dE', b + 1) AS code, count(*) AS n
FROM (SELECT c_nationkey, {sql_bracket("o_totalprice")} AS b FROM orders JOIN customer ON o_custkey = c_custkey)
GROUP BY 1, 2""")
def code_names(spark, sf):  # F2
    rows = table(spark, sf, "orders").join(table(spark, sf, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    counted = rows.groupBy("c_nationkey", codes.bracket_number("o_totalprice").alias("b")).agg(
        F.count(F.lit(1)).alias("n")
    )
    return counted.select(
        F.lpad(F.col("c_nationkey").cast("string"), 5, "0").alias("area"),
        F.format_string("B19001_%03dE", F.col("b") + 1).alias("code"), "n",
    )


@register("code_lists", f"""
SELECT c_nationkey, string_agg(DISTINCT printf('B19001_%03dE', b + 1), ',' ORDER BY printf('B19001_%03dE', b + 1))
  AS codes
FROM (SELECT c_nationkey, {sql_bracket("o_totalprice")} AS b FROM orders JOIN customer ON o_custkey = c_custkey)
GROUP BY 1""")
def code_lists(spark, sf):  # at most 16 codes per area, de-duplicated before they are joined
    pairs = code_names(spark, sf).select(F.col("area").cast("int").alias("c_nationkey"), "code")
    return pairs.groupBy("c_nationkey").agg(F.listagg_distinct("code", F.lit(",")).alias("codes")).select(
        "c_nationkey", F.array_join(F.array_sort(F.split("codes", ",")), ",").alias("codes")
    )


@register("parsed_dates", """
SELECT o_orderkey, CASE WHEN o_orderpriority LIKE '5%' THEN NULL ELSE CAST(o_orderdate AS DATE) END AS clean_date
FROM orders""")
def parsed_dates(spark, sf):  # F12 F13 F14: one text form per priority, the last is no date
    day = F.col("o_orderdate")
    kind = F.substring("o_orderpriority", 1, 1)
    text = (
        F.when(kind == "1", F.date_format(day, "yyyy-MM-dd"))
        .when(kind == "2", F.date_format(day, "yyyy/M/d"))
        .when(kind == "3", F.date_format(day, "M/d/yyyy"))
        .when(kind == "4", F.date_format(day, "yyyyMMdd"))
        .otherwise("no date")
    )
    return table(spark, sf, "orders").select("o_orderkey", text.alias("t")).select(
        "o_orderkey", dates.parse_date("t", [*dates.ISO, *dates.US, *dates.YMD]).alias("clean_date")
    )


@register("append_frames", """
SELECT c_custkey AS id, c_acctbal AS balance, c_mktsegment AS segment, CAST(NULL AS INTEGER) AS nation FROM customer
UNION ALL
SELECT s_suppkey, s_acctbal, NULL, s_nationkey FROM supplier""")
def append_frames(spark, sf):  # U1
    customers = table(spark, sf, "customer").select(
        F.col("c_custkey").alias("id"), F.col("c_acctbal").alias("balance"), F.col("c_mktsegment").alias("segment")
    )
    suppliers = table(spark, sf, "supplier").select(
        F.col("s_suppkey").alias("id"), F.col("s_nationkey").alias("nation"), F.col("s_acctbal").alias("balance")
    )
    return stack(customers, suppliers)


def _order_csv(spark, sf):
    """Orders written as CSV files with a header: two columns with missing values, one that is empty, one of T and F."""
    orders = table(spark, sf, "orders").select(
        "o_orderkey", "o_custkey", F.when(F.col("o_orderkey") % 5 != 0, F.col("o_totalprice")).alias("price"),
        F.when(F.col("o_custkey") % 4 != 0, F.date_format("o_orderdate", "yyyy-MM-dd")).alias("day"),
        F.when(F.col("o_orderstatus") == "F", "T").otherwise("F").alias("done"), F.col("o_orderpriority").alias("priority"),
        F.lit(None).cast("string").alias("nothing"), F.concat(F.lit("0"), F.col("o_orderkey") % 1000, F.lit("x")).alias("code"))
    folder = f"{scratch_folder(spark)}/orders-{uuid4().hex}"
    write_csv(orders, folder)
    return folder


@register("csv_rows", """
SELECT CAST(o_orderkey AS INTEGER) AS o_orderkey, CAST(o_custkey AS INTEGER) AS o_custkey,
       CASE WHEN o_orderkey % 5 <> 0 THEN o_totalprice END AS price, CASE WHEN o_custkey % 4 <> 0 THEN CAST(o_orderdate AS DATE) END AS day,
       o_orderstatus = 'F' AS done, o_orderpriority AS priority, CAST(NULL AS BOOLEAN) AS nothing,
       '0' || CAST(o_orderkey % 1000 AS VARCHAR) || 'x' AS code FROM orders""")
def csv_rows(spark, sf):  # S1 S7, types inferred
    return read_csv_inferred(spark, _order_csv(spark, sf))


@register("csv_columns", """
SELECT CAST(place AS INTEGER) AS place, name, type, n - missing AS n_values, missing AS n_missing
FROM (SELECT count(*) AS n, count(*) FILTER (WHERE o_orderkey % 5 = 0) AS p, count(*) FILTER (WHERE o_custkey % 4 = 0) AS d FROM orders),
LATERAL (VALUES (0, 'o_orderkey', 'int', 0), (1, 'o_custkey', 'int', 0), (2, 'price', 'double', p), (3, 'day', 'date', d),
  (4, 'done', 'boolean', 0), (5, 'priority', 'string', 0), (6, 'nothing', 'boolean', n), (7, 'code', 'string', 0)) AS v(place, name, type, missing)""")
def csv_columns(spark, sf):  # S1
    return csv_types(spark, _order_csv(spark, sf))


@register("row_ids", """
SELECT o_orderkey, o_orderdate::DATE AS day, row_number() OVER (ORDER BY CAST(o_orderdate AS DATE), o_orderkey) AS id FROM orders""")
def row_ids_of_orders(spark, sf):  # P17 W5
    orders = table(spark, sf, "orders").select("o_orderkey", F.col("o_orderdate").cast("date").alias("day"))
    return row_ids(orders, ["day", "o_orderkey"])


@register("row_ids_of_copies", """
SELECT l_returnflag, l_linestatus, row_number() OVER (ORDER BY l_returnflag DESC, l_linestatus) AS id FROM lineitem""")
def row_ids_of_copies(spark, sf):  # P17 W5, few distinct rows
    return row_ids(table(spark, sf, "lineitem").select("l_returnflag", "l_linestatus"), [F.desc("l_returnflag"), "l_linestatus"])


@register("food_stamp_flags", with_ctes("visit_rows") + """
SELECT CAST(CASE WHEN foodstamps = 'Yes' THEN 1 WHEN foodstamps IS NOT NULL THEN 0 END AS INTEGER) AS exact_yes,
       CAST(CASE WHEN lower(foodstamps) = 'yes' THEN 1 WHEN foodstamps IS NOT NULL THEN 0 END AS INTEGER) AS any_yes,
       CAST(CASE WHEN householdMembers >= 6 THEN 1 ELSE 0 END AS INTEGER) AS large, count(*) AS n
FROM visit_rows GROUP BY 1, 2, 3""")
def food_stamp_flags(spark, sf):  # F1 F3 F7 F8
    return visit_rows(spark, sf).groupBy(
        codes.yes_flag("foodstamps").alias("exact_yes"),
        codes.yes_flag_any_case("foodstamps").alias("any_yes"),
        if_else(F.col("householdMembers") >= 6, 1, 0).alias("large"),
    ).agg(F.count(F.lit(1)).alias("n"))
