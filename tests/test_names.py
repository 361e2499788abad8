"""Golden folder-name cases (FIXTURES F3.1-F3.3) and regex dialect checks."""

import pytest
from pyspark.sql import functions as F

from caseledger.operators.parse import diagnose_cases, parse_cases, parse_clients

CLIENTS = [
    ("A-001 John Doe", ("A-001", "John Doe"), ("A-001", "John Doe")),
    ("A-001 John  Doe", ("A-001", "John  Doe"), ("A-001", "John Doe")),
    ("A-001", ("", "A-001"), ("A-001", "")),
    (" A-001 X", ("", " A-001 X"), ("A-001", "X")),
    ("Acme Ltd", ("", "Acme Ltd"), ("", "Acme Ltd")),
    ("a-001 X", ("", "a-001 X"), ("", "a-001 X")),
]

CASES = [
    ("A001-001 BRAND NAME 123456 C25", ("A001-001", "BRAND NAME", "123456", "C25"),
     ("A001-001", "BRAND NAME", "123456", "C25")),
    ("A52-029 Foo 123456 C05", ("", "", "123456", "C05"), ("A52-029", "Foo", "123456", "C05")),
    ("A51-016 M SMITH NTN", ("", "", "", ""), ("A51-016", "M SMITH NTN", "", "")),
    ("A003-001 MIXED REPLY SET", ("A003-001", "MIXED", "", ""),
     ("A003-001", "MIXED REPLY SET", "", "")),
    ("A001-002 Foo 123456 Bar 654321 C01", ("A001-002", "Foo 123456 Bar", "654321", "C01"),
     ("A001-002", "Foo", "123456", "C01")),
    ("A001-003 123456 Foo C01", ("A001-003", "Foo", "123456", "C01"),
     ("A001-003", "Foo", "123456", "C01")),
    ("123456 A001-004 Foo Bar c7", ("A001-004", "Foo Bar c7", "123456", ""),
     ("A001-004", "Foo Bar", "123456", "c7")),
    ("A001-005 Foo 123456 C123", ("A001-005", "Foo", "123456", "C123"),
     ("A001-005", "Foo", "123456", "")),
    ("A001-006 A001-007 Foo 123456", ("A001-007", "Foo", "123456", ""),
     ("A001-006", "Foo", "123456", "")),
    ("A001-008", ("A001-008", "", "", ""), ("A001-008", "", "", "")),
    ("A001-009 2nd Foo", ("A001-009", "Foo", "", ""), ("A001-009", "2nd Foo", "", "")),
    ("Misc papers", ("", "", "", ""), ("", "", "", "")),
    ("", ("", "", "", ""), ("", "", "", "")),
    ("   ", ("", "", "", ""), ("", "", "", "")),
]


def _run(spark, rows, col, fn, out=None):
    df = spark.createDataFrame([(r,) for r in rows], f"{col} string")
    return {r[out or col]: r for r in fn(df).collect()}


@pytest.mark.parametrize("parser,idx", [("legacy", 1), ("token", 2)])
def test_clients(spark, parser, idx):
    got = _run(spark, [c[0] for c in CLIENTS], "client_folder",
               lambda d: parse_clients(d, parser))
    for case in CLIENTS:
        r = got[case[0]]
        assert (r["client_number"], r["client_name"]) == case[idx], case[0]


@pytest.mark.parametrize("parser,idx", [("legacy", 1), ("token", 2)])
def test_cases(spark, parser, idx):
    got = _run(spark, [c[0] for c in CASES], "case_folder", lambda d: parse_cases(d, parser))
    for case in CASES:
        r = got[case[0]]
        assert (r["case_no"], r["case_name"], r["tm_no"], r["class_code"]) == case[idx], case[0]


def test_severity(spark):
    names = ["A001-001 X 123456 C01", "A001-001 X C01", "A001-001 X", "X 123456 C01", "X"]
    expect = {
        "A001-001 X 123456 C01": (0, 0, False, False, True),
        "A001-001 X C01": (0, 1, False, True, False),
        "A001-001 X": (0, 2, False, True, False),
        "X 123456 C01": (1, 0, True, False, False),
        "X": (1, 2, True, False, False),
    }
    got = _run(spark, names, "case_folder", diagnose_cases, "folder_name")
    for n, e in expect.items():
        r = got[n]
        assert (len(r["issues"]), len(r["warnings"]), r["is_failure"], r["is_warning"],
                r["is_ok"]) == e, n
        assert [r["is_failure"], r["is_warning"], r["is_ok"]].count(True) == 1


def test_unicode_digits_and_spaces(spark):
    # Arabic-Indic digits are \d for Python; U+00A0 and \x1c split like str.split()
    tm = "١٢٣٤٥٦"
    names = [f"A001-001 Foo {tm} C01", "A001-001\x1cFoo 123456 C01"]
    got = _run(spark, names, "case_folder", lambda d: parse_cases(d, "legacy"))
    assert got[names[0]]["tm_no"] == tm
    assert got[names[0]]["case_name"] == "Foo"
    assert got[names[1]]["case_no"] == "A001-001"


def test_client_line_terminators(spark):
    got = _run(spark, ["A-1 x\r", "A-1 x y", "A-1 x\n"], "client_folder",
               lambda d: parse_clients(d, "legacy"))
    assert got["A-1 x\r"]["client_name"] == "x\r"
    assert got["A-1 x y"]["client_name"] == "x y"
    assert got["A-1 x\n"]["client_name"] == "x"


def test_tokens_split_once(spark):
    df = spark.createDataFrame([("A-1 x", "A001-001 Foo 123456 C01")],
                               "client_folder string, case_folder string")
    for parser in ("legacy", "token"):
        p = parse_cases(df, parser)
        plan = p._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("split(") == 1, parser


def test_tokens_rejoin(spark):
    from caseledger.operators.parse import tokenize_names
    df = spark.createDataFrame([(" a  b\tc ",)], "case_folder string")
    r = tokenize_names(df).select(F.array_join(F.transform("tokens", lambda t: t["raw"]), " ")
                                  .alias("j")).first()
    assert r["j"] == "a b c"


def test_names_are_read_by_compiled_expressions(spark):
    # a lambda over a name's tokens is interpreted for every folder
    df = spark.createDataFrame([("A-1 x", "A001-001 Foo 123456 C01")], "client_folder string, case_folder string")
    for parser in ("legacy", "token"):
        p = parse_cases(parse_clients(df, parser), parser)
        assert "lambda" not in p._jdf.queryExecution().optimizedPlan().toString(), parser


def test_codes_side_by_side(spark):
    names = ["A001-001 A001-001 C01 C02 123456 123456", "A001-001 Foo A01-001 C1 Bar 123456 x 654321 C9", "A001-001 C01", "x 123456",
             "A001-001 1234567 Foo", None]
    want = {"legacy": [("A001-001", "", "123456", "C02"), ("A001-001", "Foo A01-001 Bar 123456 x", "654321", "C9"),
                       ("A001-001", "", "", "C01"), ("", "", "123456", ""), ("A001-001", "Foo", "", ""), ("", "", "", "")],
            "token": [("A001-001", "", "123456", "C01"), ("A001-001", "Foo Bar", "123456", "C1"),
                      ("A001-001", "", "", "C01"), ("", "", "123456", ""), ("A001-001", "1234567 Foo", "", ""), ("", "", "", "")]}
    for parser in ("legacy", "token"):
        got = _run(spark, names, "case_folder", lambda d: parse_cases(d, parser))
        assert [(r["case_no"], r["case_name"], r["tm_no"], r["class_code"]) for r in map(got.get, names)] == want[parser]
