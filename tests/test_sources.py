"""Inferred CSV types, census files read in parts, dense row numbers."""

import datetime as dt
import json
import random

import pytest
from pyspark.sql import functions as F

from footfall import schemas
from footfall.operators.row_ids import row_ids
from footfall.sources import census, tables

TEXT = """a,b,c,d,e,f,g,h,my name,j
TRUE,1,1,1.5,2020-01-02,x,NA,12345678901,007,1
F,-2,2.,1e3,2021-1-3,1,,7,7, 2
NA,NA,NA,Inf,NA,,NA,NA,0x1,T
T,+3,3,-.5,2020-02-29,TRUE,NA,1,12345678901234567890,NA
"""


def test_csv_types_and_values(spark, tmp_path):
    (tmp_path / "a.csv").write_text(TEXT)
    found = {r["name"]: (r["place"], r["type"], r["n_values"], r["n_missing"]) for r in tables.csv_types(spark, str(tmp_path)).collect()}
    assert found == {
        "a": (0, "boolean", 3, 1), "b": (1, "int", 3, 1), "c": (2, "double", 3, 1), "d": (3, "double", 4, 0), "e": (4, "date", 3, 1),
        "f": (5, "string", 3, 1), "g": (6, "boolean", 0, 4), "h": (7, "bigint", 3, 1), "my name": (8, "string", 4, 0), "j": (9, "string", 3, 1)}
    df = tables.read_csv_inferred(spark, str(tmp_path))
    first, second, third, fourth = sorted(df.collect(), key=lambda r: TEXT.index(f",{r['my name']},"))
    assert tuple(first) == (True, 1, 1.0, 1.5, dt.date(2020, 1, 2), "x", None, 12345678901, "007", "1")
    assert (second["a"], second["c"], second["d"], second["e"], second["j"]) == (False, 2.0, 1000.0, dt.date(2021, 1, 3), "2")
    assert third["d"] == float("inf") and third["a"] is None and third["e"] is None
    assert fourth["d"] == -0.5 and fourth["f"] == "TRUE"


def test_types_are_merged_over_files(spark, tmp_path):
    values = {"a": ["1", "2"], "b": ["2.5", "NA"], "c": ["x", "4"]}
    for name, rows in values.items():
        (tmp_path / f"{name}.csv").write_text("\n".join(["v", *rows]))
    kind = lambda *names: tables.csv_types(spark, [str(tmp_path / f"{n}.csv") for n in names]).first()["type"]
    assert (kind("a"), kind("a", "b"), kind("a", "b", "c")) == ("int", "double", "string")
    (tmp_path / "no.csv").write_text("v,w\n")
    assert [r["type"] for r in tables.csv_types(spark, str(tmp_path / "no.csv")).collect()] == ["boolean", "boolean"]


def test_bad_text_is_counted(spark, tmp_path):
    (tmp_path / "v.csv").write_text("householdMembers,annualIncome\n3,10.5\nmany,NA\nfew,x\n")
    schema = [f for f in schemas.VISITS if f.name in ("householdMembers", "annualIncome")]
    from pyspark.sql.types import StructType
    found = {r["name"]: (r["n_bad"], r["example"]) for r in tables.csv_problems(spark, str(tmp_path / "v.csv"), StructType(schema)).collect()}
    assert found == {"householdMembers": (2, "few"), "annualIncome": (1, "x")}


HEAD = ["NAME", "a", "zip"]


def write(folder, year, rows, head=HEAD, apart=",\n"):
    (folder / f"acs_{year}.json").write_text("[" + apart.join(json.dumps(r) for r in [head, *rows]) + "]\n")


def rows_of(df):
    return sorted((tuple(r) for r in df.select("year", *HEAD).collect()), key=repr)


def test_responses_are_read_in_parts(spark, tmp_path):
    r = random.Random(1)
    texts = ["x", 'quo"te', "back\\", "comma, here", "Übung", "", "\\\"", "{}", "a b\tc"]
    made = {}
    for year in (2020, 2021, 2022):
        made[year] = [[r.choice(texts) + str(i), r.choice([None, "5", "-"]), str(i)] for i in range(400)]
        write(tmp_path, year, made[year], apart=r.choice([",", ",\n", " ,\n "]))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4k")
    try:
        df = census.read_rows(spark, str(tmp_path), HEAD)
        assert df.rdd.getNumPartitions() > 3
        whole = census.response_rows(census.read_responses(spark, str(tmp_path)), HEAD)
        assert rows_of(df) == rows_of(whole) == sorted(((y, *x) for y, rows in made.items() for x in rows), key=repr)
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_brackets_in_cells_and_other_headers(spark, tmp_path):
    write(tmp_path, 2020, [["a [b] c", "1", "1"], ["]", None, "2"], ['"]', "3", "3"]])
    write(tmp_path, 2021, [["1", "n"], ["2", "m"]], head=["zip", "NAME"])
    (tmp_path / "acs_2019.json").write_text("[]")
    found = rows_of(census.read_rows(spark, str(tmp_path), HEAD))
    assert found == sorted([(2020, "a [b] c", "1", "1"), (2020, "]", None, "2"), (2020, '"]', "3", "3"), (2021, "n", None, "1"), (2021, "m", None, "2")], key=repr)


def test_only_files_of_the_years_are_read(spark, tmp_path):
    for year in (2019, 2020, 2021):
        write(tmp_path, year, [["x", "1", str(year)]])
    df = census.read_rows(spark, str(tmp_path), HEAD, years=[2020, 2021])
    assert [r[0] for r in rows_of(df)] == [2020, 2021] and not any("2019" in f for f in df.inputFiles())
    folders = str(tmp_path / "by_year")
    census.read_responses(spark, str(tmp_path / "*.json")).write.partitionBy("year").text(folders)
    df = census.read_rows(spark, folders, HEAD, years=[2020])
    assert rows_of(df) == [(2020, "x", "1", "2020")]


@pytest.mark.parametrize("parts", [1, 7, 40])
def test_row_ids_do_not_depend_on_the_partitioning(spark, parts):
    r = random.Random(4)
    rows = [(r.choice(["a", "b", None]), r.choice([1.5, 2.5, None]), r.randrange(30)) for _ in range(600)] + [("hot", 1.0, 1)] * 400
    df = spark.createDataFrame(rows, "k STRING, v DOUBLE, n INT").repartition(parts)
    key = lambda x: ((x[0] is None, x[0] or ""), -x[2], (x[1] is None, x[1] or 0))
    got = sorted((tuple(x) for x in row_ids(df, ["k", F.desc("n")]).collect()), key=lambda x: x[3])
    assert [x[:3] for x in got] == sorted(rows, key=key) and [x[3] for x in got] == list(range(1, 1001))
    assert row_ids(df.limit(0), ["k"]).count() == 0


def test_row_ids_of_many_copies_are_numbered_in_chunks(spark, monkeypatch):
    from footfall.operators import row_ids as module

    monkeypatch.setattr(module, "CHUNK", 7)
    df = spark.range(50).select((F.col("id") % 2).alias("x"))
    got = sorted((r["id"], r["x"]) for r in module.row_ids(df, ["x"]).collect())
    assert got == [(i + 1, int(i >= 25)) for i in range(50)]
