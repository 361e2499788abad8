"""Keyed upsert (FIXTURES F3.7) and schema evolution."""

from caseledger.operators.upsert import evolve_schema, upsert_cases, upsert_counts

E_ROWS = [  # case_no, name, date_added, row_order
    ("K1", "old1", "01-Jan-25", 1),
    ("K2", "old2", "02-Jan-25", 2),
    ("K3", "dupA", "03-Jan-25", 3),
    ("K3", "dupB", "04-Jan-25", 4),
    ("", "blankE", "05-Jan-25", 5),
]
I_ROWS = [
    ("K1", "new1", "15-Jan-26", 1, True),
    (" K4 ", "app1", "15-Jan-26", 2, True),
    ("K4", "app2", "15-Jan-26", 3, False),
    ("K3", "first", "15-Jan-26", 4, True),
    ("K3", "last", "15-Jan-26", 5, True),
    ("", "blankI", "15-Jan-26", 6, True),
]


def test_upsert_table(spark):
    e = spark.createDataFrame(E_ROWS, "case_no string, name string, date_added string, row_order int")
    i = spark.createDataFrame(I_ROWS, "case_no string, name string, date_added string, row_order int, "
                                      "NEWRULE boolean")
    out = {(r["name"]): r for r in upsert_cases(e, i).collect()}
    assert out["new1"]["upsert_status"] == "updated" and out["new1"]["date_added"] == "01-Jan-25"
    assert out["new1"]["row_order"] == 1                   # keeps E's position
    assert "old1" not in out
    assert out["old2"]["upsert_status"] == "untouched" and out["old2"]["NEWRULE"] is None
    assert out["dupA"]["upsert_status"] == "untouched"     # first of a repeated E key
    assert "dupB" not in out and out["last"]["date_added"] == "04-Jan-25"
    assert "first" not in out                              # superseded by the last I row
    assert out["app1"]["upsert_status"] == "appended" and out["app2"]["upsert_status"] == "appended"
    assert out["blankI"]["upsert_status"] == "appended"
    assert out["blankE"]["upsert_status"] == "untouched"
    assert len(out) == 8
    c = upsert_counts(e, i).first()
    assert (c["updated"], c["appended"]) == (3, 3)


def test_upsert_twice_is_once(spark):
    e = spark.createDataFrame(E_ROWS[:2], "case_no string, name string, date_added string, row_order int")
    i = spark.createDataFrame([("K1", "n", "x", 1), ("K9", "m", "x", 2)],
                              "case_no string, name string, date_added string, row_order int")
    once = upsert_cases(e, i).drop("upsert_status")
    twice = upsert_cases(once, i).drop("upsert_status")
    key = lambda r: (r["case_no"], r["name"], r["date_added"])
    assert sorted(map(key, once.collect())) == sorted(map(key, twice.collect()))


def test_evolve(spark):
    t = spark.createDataFrame([("a",)], "x string")
    n = spark.createDataFrame([("b", True)], "x string, R boolean")
    r = evolve_schema(t, n).first()
    assert r["R"] is None and r["x"] == "a"


def test_the_order_does_not_travel_beside_its_columns(spark):
    import re
    e = spark.createDataFrame(E_ROWS, "case_no string, name string, date_added string, row_order int")
    i = spark.createDataFrame([r[:4] for r in I_ROWS], "case_no string, name string, date_added string, row_order int")
    out = upsert_cases(e, i, order_by=("row_order", "name"), keep_position=False)
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert not re.search(r"\b_ord#", plan) and not re.search(r"Project .*_e_ord#\d+, .*_i_ord#", plan)
    got = {r["name"]: (r["upsert_status"], r["date_added"]) for r in out.collect()}
    assert got["new1"] == ("updated", "01-Jan-25") and got["last"] == ("updated", "04-Jan-25")
    assert got["dupA"][0] == "untouched" and got["app1"][0] == got["app2"][0] == "appended" and len(got) == 8
