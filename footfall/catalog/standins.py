"""Service-demand inputs derived from the shared test tables.

The given tables hold no visits, so each input is read off them by rule, over all of their rows:

* a person row is an order line, a visit is an order with its number of lines as household size,
* a household is a customer, an area is the customer's nation under a ZIP code,
* categories (education, food stamps, race, ...) are mapped from status and priority columns, some of them to NULL.

Every function here has its SQL twin as a common table expression in ``CTE``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import codes
from ..names import (
    EDUCATION_CODES, FOODSTAMP_TOTAL, FOODSTAMP_YES, HHSIZE_CODES, INCOME_CODES, METRO_ZIPS,
)
from ..schemas import GIVEN

LABELS_1_9 = [label for label, _ in codes.EDUCATION_1_9]
LABELS_0_11 = [label for label, _ in codes.EDUCATION_0_11]
ZIPS = [*METRO_ZIPS, "51001", "51002", "51003", "51004", "51005"]
RACES = ["White", "Unknown", "Other", None, "Asian"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A given table by its declared schema, with the files that it has now."""
    return spark.read.schema(GIVEN[name]).parquet(f"{sf_dir}/{name}.parquet")


def _pick(values: list, index: Column) -> Column:
    return F.get(F.array(*[F.lit(v) for v in values]), index.cast("int"))


def _priority() -> Column:
    return F.substring("o_orderpriority", 1, 1).cast("int")


def _foodstamps() -> Column:
    return F.when(F.col("o_orderstatus") == "F", "Yes").when(F.col("o_orderstatus") == "O", "No")


def zip_of(nation: str) -> Column:
    return _pick(ZIPS, F.col(nation))


def persons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Person rows of the first export."""
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linestatus")
    orders = table(spark, sf_dir, "orders").select(
        "o_orderkey",
        F.col("o_custkey").cast("string").alias("houseHoldIdAfn"),
        F.date_format("o_orderdate", "yyyy-MM-dd").alias("servedDate"),
        (F.col("o_custkey") % 7 + 1).cast("int").alias("householdMembers"),
        _foodstamps().alias("foodstamps"),
        F.col("o_totalprice").alias("annualIncome"),
        (2 * (_priority() - 1)).alias("level"),
    )
    education = F.col("level") + (F.col("l_linestatus") == "F").cast("int")
    return (
        lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
        .withColumn("education", _pick(LABELS_1_9, education))
        .drop("l_orderkey", "l_linestatus", "o_orderkey", "level")
    )


def persons_v8(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Person rows of the second export."""
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_returnflag", "l_linestatus", "l_shipdate")
    orders = table(spark, sf_dir, "orders").select(
        "o_orderkey", "o_custkey",
        F.date_format("o_orderdate", "yyyyMMdd").alias("served_date"),
        ((_priority() - 1) * 3).alias("level"),
        F.when(F.col("o_orderstatus") == "F", "Hispanic or Latino").when(
            F.col("o_orderstatus") == "O", "Not Hispanic").alias("ethnicity"),
    )
    customers = table(spark, sf_dir, "customer").select(
        "c_custkey",
        F.col("c_custkey").cast("string").alias("afn"),
        F.col("c_acctbal").alias("annual_income"),
        zip_of("c_nationkey").alias("zip"),
        F.col("c_mktsegment").alias("family_type"),
        (F.col("c_custkey") % 3 == 0).alias("by_line"),
        _pick(RACES, F.col("c_nationkey") % 5).alias("fixed_race"),
    )
    flag = F.when(F.col("l_returnflag") == "A", 0).when(F.col("l_returnflag") == "N", 1).otherwise(2)
    line_race = F.when(F.col("l_returnflag") == "A", "White").when(F.col("l_returnflag") == "N", "Unknown")
    return (
        lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
        .join(customers, F.col("o_custkey") == F.col("c_custkey"))
        .select(
            "afn", "served_date", F.date_format("l_shipdate", "yyyy/M/d").alias("dob"), "annual_income",
            _pick(LABELS_0_11, F.col("level") + flag).alias("education"), "zip", "family_type",
            F.when(F.col("l_linestatus") == "F", "Own").otherwise("Rent").alias("housing"),
            F.when(F.col("by_line"), line_race).otherwise(F.col("fixed_race")).alias("race"), "ethnicity",
        )
    )


def visit_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Visits in the shape of the first-visit table, plus ``visit_id`` and ``customer``.

    Lines are counted per order before the join, and both sides of it use the same key, so the counts are shuffled once.
    """
    sizes = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("householdMembers"))
    orders = table(spark, sf_dir, "orders")
    label = _pick(LABELS_1_9, 2 * (_priority() - 1) + (F.col("o_orderstatus") == "F").cast("int"))
    return (
        orders.join(sizes, F.col("o_orderkey") == F.col("l_orderkey"))
        .select(
            F.col("o_orderkey").alias("visit_id"),
            F.col("o_custkey").alias("customer"),
            F.col("o_custkey").cast("string").alias("houseHoldIdAfn"),
            (F.col("o_custkey") % 7 + 1).cast("int").alias("householdMembers_key"),
            "householdMembers",
            _foodstamps().alias("foodstamps"),
            F.col("o_orderdate").cast("date").alias("clean_date"),
            F.col("o_totalprice").alias("annualIncome"),
            label.alias("education"),
        )
        .withColumn("education_numeric", codes.code_of("education", codes.EDUCATION_1_9))
    )


def order_visits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Visits without a size: household, date, income; dates stay as stored so that ranges reach the scan."""
    return table(spark, sf_dir, "orders").select(
        F.col("o_custkey").cast("string").alias("houseHoldIdAfn"),
        F.col("o_orderdate").alias("clean_date"),
        F.col("o_totalprice").alias("annualIncome"),
    )


def zip_visits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Household, date and ZIP code of every order."""
    customers = table(spark, sf_dir, "customer")
    return table(spark, sf_dir, "orders").join(customers, F.col("o_custkey") == F.col("c_custkey")).select(
        F.col("o_custkey").cast("string").alias("houseHoldIdAfn"),
        F.col("o_orderdate").cast("date").alias("clean_date"),
        zip_of("c_nationkey").alias("zip"),
    )


def acs_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Census-like counts per year, ZIP code and market segment, from visits."""
    customers = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey", "c_mktsegment")
    rows = visit_rows(spark, sf_dir).join(customers, F.col("customer") == F.col("c_custkey")).select(
        F.year("clean_date").alias("year"),
        zip_of("c_nationkey").alias("zip"),
        F.col("c_mktsegment").alias("NAME"),
        codes.bracket_number("annualIncome").alias("b"),
        (F.col("visit_id") % 16 + 1).alias("e"),
        F.least(F.col("householdMembers"), F.lit(7)).alias("h"),
        (F.col("foodstamps") == "Yes").alias("fs"),
    )
    counts = {
        **{c: f"b = {i}" for i, c in enumerate(INCOME_CODES, 1)},
        **{c: f"e = {i}" for i, c in enumerate(EDUCATION_CODES, 1)},
        **{c: f"h = {i}" for i, c in enumerate(HHSIZE_CODES, 1)},
        FOODSTAMP_TOTAL: "true",
        FOODSTAMP_YES: "fs",
    }
    return rows.groupBy("NAME", "zip", "year").agg(
        *[F.expr(f"CAST(count_if({test}) AS DOUBLE) AS {c}") for c, test in counts.items()]
    )


def zip_shapes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One rectangle per nation, along a diagonal across the metro window."""
    key = F.col("n_nationkey").cast("double")
    return table(spark, sf_dir, "nation").select(
        zip_of("n_nationkey").alias("zip"),
        (key * 0.03 - 94.0).alias("xmin"),
        (key * 0.02 + 41.3).alias("ymin"),
        (key * 0.03 - 93.96).alias("xmax"),
        (key * 0.02 + 41.33).alias("ymax"),
    )


def _sql_list(values: list) -> str:
    return "[" + ", ".join("NULL" if v is None else "'" + v.replace("'", "''") + "'" for v in values) + "]"


def sql_code(column: str, scale) -> str:
    """SQL CASE for a label scale, made from the same list the Spark side uses."""
    arms = " ".join(f"WHEN {column} = '{label}' THEN {code}" for label, code in scale if code is not None)
    return f"CAST(CASE {arms} END AS INTEGER)"


def sql_bracket(column: str) -> str:
    arms = " ".join(f"WHEN {column} < {edge} THEN {i}" for i, edge in enumerate(codes.INCOME_EDGES, 1))
    return f"CASE WHEN {column} IS NULL THEN NULL {arms} ELSE {len(codes.INCOME_EDGES) + 1} END"


_PRIORITY = "CAST(substr(o_orderpriority, 1, 1) AS INTEGER)"
_FOODSTAMPS = "CASE o_orderstatus WHEN 'F' THEN 'Yes' WHEN 'O' THEN 'No' END"


def sql_zip(nation: str) -> str:
    return f"({_sql_list(ZIPS)})[{nation} + 1]"



CTE = {
    "persons": f"""
        SELECT CAST(o_custkey AS VARCHAR) AS houseHoldIdAfn, CAST(o_orderdate AS DATE) AS clean_date,
               CAST(o_custkey % 7 + 1 AS INTEGER) AS householdMembers, {_FOODSTAMPS} AS foodstamps,
               o_totalprice AS annualIncome,
               ({_sql_list(LABELS_1_9)})[2 * ({_PRIORITY} - 1) + CASE l_linestatus WHEN 'F' THEN 1 ELSE 0 END + 1]
                 AS education
        FROM lineitem JOIN orders ON l_orderkey = o_orderkey""",
    "persons_v8": f"""
        SELECT CAST(o_custkey AS VARCHAR) AS afn, CAST(o_orderdate AS DATE) AS served_date,
               CAST(l_shipdate AS DATE) AS dob, c_acctbal AS annual_income,
               ({_sql_list(LABELS_0_11)})[({_PRIORITY} - 1) * 3
                 + CASE l_returnflag WHEN 'A' THEN 0 WHEN 'N' THEN 1 ELSE 2 END + 1] AS education,
               {sql_zip("c_nationkey")} AS zip, c_mktsegment AS family_type,
               CASE l_linestatus WHEN 'F' THEN 'Own' ELSE 'Rent' END AS housing,
               CASE WHEN c_custkey % 3 = 0 THEN CASE l_returnflag WHEN 'A' THEN 'White' WHEN 'N' THEN 'Unknown' END
                    ELSE ({_sql_list(RACES)})[c_nationkey % 5 + 1] END AS race,
               CASE o_orderstatus WHEN 'F' THEN 'Hispanic or Latino' WHEN 'O' THEN 'Not Hispanic' END AS ethnicity
        FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey""",
    "visit_rows": f"""
        SELECT o_orderkey AS visit_id, o_custkey AS customer, CAST(o_custkey AS VARCHAR) AS houseHoldIdAfn,
               CAST(o_custkey % 7 + 1 AS INTEGER) AS householdMembers_key, householdMembers, foodstamps,
               clean_date, annualIncome, education, {sql_code("education", codes.EDUCATION_1_9)} AS education_numeric
        FROM (SELECT o_orderkey, o_custkey, n AS householdMembers, {_FOODSTAMPS} AS foodstamps,
                     CAST(o_orderdate AS DATE) AS clean_date, o_totalprice AS annualIncome,
                     ({_sql_list(LABELS_1_9)})[2 * ({_PRIORITY} - 1)
                       + CASE o_orderstatus WHEN 'F' THEN 1 ELSE 0 END + 1] AS education
              FROM orders JOIN (SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY l_orderkey)
                ON o_orderkey = l_orderkey)""",
    "zip_visits": f"""
        SELECT CAST(o_custkey AS VARCHAR) AS houseHoldIdAfn, CAST(o_orderdate AS DATE) AS clean_date,
               {sql_zip("c_nationkey")} AS zip
        FROM orders JOIN customer ON o_custkey = c_custkey""",
    "zip_shapes": f"""
        SELECT {sql_zip("n_nationkey")} AS zip, CAST(n_nationkey AS DOUBLE) * 0.03::DOUBLE - 94.0::DOUBLE AS xmin,
               CAST(n_nationkey AS DOUBLE) * 0.02::DOUBLE + 41.3::DOUBLE AS ymin,
               CAST(n_nationkey AS DOUBLE) * 0.03::DOUBLE - 93.96::DOUBLE AS xmax,
               CAST(n_nationkey AS DOUBLE) * 0.02::DOUBLE + 41.33::DOUBLE AS ymax
        FROM nation""",
}


def _acs_sql() -> str:
    parts = [
        *[f"count(*) FILTER (WHERE b = {i})::DOUBLE AS {c}" for i, c in enumerate(INCOME_CODES, 1)],
        *[f"count(*) FILTER (WHERE e = {i})::DOUBLE AS {c}" for i, c in enumerate(EDUCATION_CODES, 1)],
        *[f"count(*) FILTER (WHERE h = {i})::DOUBLE AS {c}" for i, c in enumerate(HHSIZE_CODES, 1)],
        f"count(*)::DOUBLE AS {FOODSTAMP_TOTAL}",
        f"count(*) FILTER (WHERE foodstamps = 'Yes')::DOUBLE AS {FOODSTAMP_YES}",
    ]
    return f"""
        SELECT NAME, zip, year, {", ".join(parts)}
        FROM (SELECT CAST(year(clean_date) AS INTEGER) AS year, {sql_zip("c_nationkey")} AS zip,
                     c_mktsegment AS NAME, {sql_bracket("annualIncome")} AS b, visit_id % 16 + 1 AS e,
                     least(householdMembers, 7) AS h, foodstamps
              FROM visit_rows JOIN customer ON customer = c_custkey)
        GROUP BY NAME, zip, year"""


CTE["acs_raw"] = _acs_sql()
_NEEDS = {"acs_raw": ["visit_rows"]}


def with_ctes(*names: str, then: str = "") -> str:
    """``WITH`` clause of the named stand-ins and, after them, further expressions given as text."""
    ordered: list[str] = []
    for name in names:
        for n in [*_NEEDS.get(name, []), name]:
            if n not in ordered:
                ordered.append(n)
    parts = [f"{n} AS ({CTE[n]})" for n in ordered]
    if then:
        parts.append(then)
    return "WITH " + ",\n".join(parts) + "\n"
