"""Declared schemas. Identifiers and ZIP codes stay STRING; nothing is inferred."""

from __future__ import annotations

from pyspark.sql import types as T

from .names import COUNT_CODES, INCOME, EDU, HHSIZE, FOODSTAMP_TOTAL, FOODSTAMP_YES


_TYPES = {
    "STRING": T.StringType(), "INT": T.IntegerType(), "BIGINT": T.LongType(), "DOUBLE": T.DoubleType(), "DATE": T.DateType(),
}


def _ddl(text: str) -> T.StructType:
    """Schema from ``name TYPE, ...``; unlike the built-in reader of such text it needs no session."""
    return T.StructType([T.StructField(n, _TYPES[t]) for n, t in (part.split() for part in text.split(", "))])


VISITS = _ddl(
    "houseHoldIdAfn STRING, servedDate STRING, householdMembers INT, foodstamps STRING, "
    "annualIncome DOUBLE, education STRING"
)

VISITS_V8 = _ddl(
    "afn STRING, served_date STRING, dob STRING, annual_income DOUBLE, education STRING, zip STRING, "
    "family_type STRING, housing STRING, race STRING, ethnicity STRING"
)

FIRST_VISIT = _ddl(
    "houseHoldIdAfn STRING, householdMembers_key INT, householdMembers BIGINT, foodstamps STRING, "
    "clean_date DATE, annualIncome DOUBLE, education STRING, served_year INT, served_month INT, "
    "served_day_of_month INT, first_visit INT, education_numeric INT"
)

# The hand-over CSV holds the date as text, in ISO or US order; parse it with functions.dates.
FIRST_VISIT_CSV = T.StructType(
    [T.StructField(f.name, T.StringType() if f.name == "clean_date" else f.dataType) for f in FIRST_VISIT]
)

PREDICTED_TOTALS = _ddl("zip STRING, estimated_acs_need DOUBLE")

ZIP_SHAPES = _ddl("zip STRING, xmin DOUBLE, ymin DOUBLE, xmax DOUBLE, ymax DOUBLE")

YEARLY_HOUSEHOLDS = _ddl("year INT, unique_afns BIGINT")

ACS_RAW = _ddl("NAME STRING, " + ", ".join(f"{c} DOUBLE" for c in COUNT_CODES) + ", zip STRING, year INT")

ACS_BY_ZIP = _ddl(
    "year INT, zip STRING, "
    + ", ".join(f"{c} DOUBLE" for c in [*INCOME, *EDU, *HHSIZE, FOODSTAMP_TOTAL, FOODSTAMP_YES])
    + ", avg_foodstamps DOUBLE"
)

# The shared test tables that stand in for exports; reading them by a declared schema saves a look at their files.
GIVEN = {
    "nation": "n_nationkey INT, n_name STRING, n_regionkey INT",
    "customer": "c_custkey BIGINT, c_name STRING, c_nationkey INT, c_acctbal DOUBLE, c_mktsegment STRING",
    "supplier": "s_suppkey BIGINT, s_name STRING, s_nationkey INT, s_acctbal DOUBLE",
    "orders": "o_orderkey BIGINT, o_custkey BIGINT, o_orderstatus STRING, o_totalprice DOUBLE, o_orderdate TIMESTAMP_NTZ, "
    "o_orderpriority STRING",
    "lineitem": "l_orderkey BIGINT, l_partkey BIGINT, l_suppkey BIGINT, l_linenumber INT, l_quantity DOUBLE, l_extendedprice DOUBLE, "
    "l_discount DOUBLE, l_tax DOUBLE, l_returnflag STRING, l_linestatus STRING, l_shipdate TIMESTAMP_NTZ",
    "events": "event_id BIGINT, ts TIMESTAMP_NTZ, user_id BIGINT, event_type STRING, value DOUBLE, props STRING",
    "embeddings": "vec_id BIGINT, embedding ARRAY<FLOAT>, label INT",
}
