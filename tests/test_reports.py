"""Reports: comparison, duplicates, summaries, inventory."""

from pyspark.sql import functions as F

from caseledger.operators import reports as R
from caseledger.operators.group import group_cases
from caseledger.sources.hierarchy import hierarchy_by_path
from conftest import listing_rows
from test_group import TREE


def _records(spark):
    return group_cases(hierarchy_by_path(listing_rows(spark, TREE), "strict"))


def test_compare_self_identical(spark):
    r = _records(spark)
    d = R.compare_exports(r, r).collect()
    assert d and all(x["status"] == "Identical" for x in d)


def test_compare_statuses(spark):
    a = spark.createDataFrame([("", "1", "", "", "x"), ("", "2", "", "", "y"), ("", "2", "", "", "z")],
                              "client_number string, case_no string, tm_no string, class_code string, files string")
    b = spark.createDataFrame([("", "2", "", "", "z"), ("", "3", "", "", "w")], a.schema)
    got = {r["case_no"]: r for r in R.compare_exports(a, b).collect()}
    assert got["1"]["status"] == "Removed" and got["3"]["status"] == "Added"
    assert got["2"]["status"] == "Changed" and got["2"]["n_a"] == 2 and got["2"]["n_b"] == 1  # every row counts
    b2 = spark.createDataFrame([("", "1", "", "", "q")], a.schema)
    got2 = {r["case_no"]: r for r in R.compare_exports(a, b2).collect()}
    assert got2["1"]["status"] == "Changed" and got2["1"]["changed_columns"] == "files"
    summary = {r["status"]: r["records"] for r in R.compare_summary(R.compare_exports(a, b2)).collect()}
    assert summary == {"Changed": 1, "Removed": 1}


def test_diagnosis_and_summary(spark):
    cf = hierarchy_by_path(listing_rows(spark, TREE), "token")
    diag = R.folder_diagnosis(cf)
    s = R.validation_summary(diag).first()
    assert s["cases"] == 4 and s["ok"] + s["failures"] + s["warnings"] == 4
    assert s["failures"] == 2 and s["empty"] == 1
    sig = R.naming_signatures(diag, 10).collect()
    assert sum(r["folders"] for r in sig) == 2
    assert R.failures_table(diag).count() == 2


def test_inventory(spark):
    lst = listing_rows(spark, TREE).withColumn("source", F.lit("drive"))
    clients, cases, files = R.inventory(lst)
    assert clients.count() == 2 and cases.count() == 4 and files.count() == 4
    rep = {r["metric"]: r for r in R.inventory_report(clients, cases, files).collect()}
    assert rep["total_files"]["value"] == 4
    assert rep["largest_case_files"]["value"] == 1          # every case holds one file
    assert rep["largest_case_files"]["detail"] == "Misc two"  # ties: greatest name
    types = {r["case_type"] for r in cases.collect()}
    assert "Standard" in types and "Pending / No TM No" in types


def test_duplicate_tm(spark):
    cases = spark.createDataFrame([("111111", "a"), ("111111", "b"), ("222222", "c"), ("", "d"), ("", "e")],
                                  "tm_no string, case_folder string")
    got = R.duplicate_tm(cases).collect()
    assert sorted(r["case_folder"] for r in got) == ["a", "b"] and got[0]["folders"] == 2
