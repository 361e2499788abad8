"""Rule engine (FIXTURES F3.5) and rule files."""

import json

from caseledger.operators.classify import (active_rules, classify, lint_rules,
                                           make_rule, plain_text_pattern, route_rules)
from caseledger.sources.rules import default_rules, load_rules, shipped_rules


def _flags(spark, stems_list, rules):
    rows = [("\n".join(s),) for s in stems_list]
    df = spark.createDataFrame(rows, "files string")
    return [r.asDict() for r in classify(df, rules).collect()]


def test_shipped_counts():
    rules = shipped_rules()
    assert len(rules) == 15
    assert sum(len(r["patterns"]) for r in rules) == 113
    assert len(default_rules()) == 14


def test_f35(spark):
    cases = [
        ["DATA SHEET PVT LTD"], ["DATA SHEET", "CNIC PVT"], ["DATA SHEET"], ["LEGAL", "NOTICE"],
        ["TM-11"], ["IPO-PAKISTAN__TM 16"], ["PLAN c"], [],
    ]
    got = _flags(spark, cases, shipped_rules())
    assert got[0]["COMPANY"] is True and got[0]["NTN"] is False
    assert got[1]["COMPANY"] is True and got[1]["NTN"] is True
    assert got[2]["NTN"] is True and got[2]["COMPANY"] is True
    assert got[3]["OPPO"] is True
    assert got[4]["D-NOTE"] is True and got[4]["TM-11"] is True
    assert got[5]["TM-06"] is True and got[5]["TM-16"] is True
    assert got[6]["CERTIFICATE"] is True
    assert all(v is False for k, v in got[7].items() if k != "files")
    seed = _flags(spark, [["DATA SHEET"]], default_rules())
    assert seed[0]["COMPANY"] is False and seed[0]["NTN"] is True


def test_match_crosses_files_only_when_joined(spark):
    got = _flags(spark, [["LEGAL", "NOTICE"], ["LEGAL"]], shipped_rules())
    assert got[0]["OPPO"] is True and got[1]["OPPO"] is False


def test_invalid_pattern_skipped(spark):
    rules = [{"name": "X", "patterns": ["(unclosed", r"\bFOO\b"], "target": "X"},
             {"name": "Y", "patterns": [r"(?P<n>BAR)(?P=n)"], "target": "Y"}]
    clean, msgs = lint_rules(spark, active_rules(rules))
    assert clean["X"] == [r"\bFOO\b"] and msgs
    got = _flags(spark, [["foo"], ["barbar"]], rules)
    assert got[0]["X"] is True and got[1]["Y"] is True


def test_java_only_invalid(spark):
    # valid in Python, rejected by Java: skipped, the other pattern still applies
    rules = [{"name": "Z", "patterns": [r"a{,2}x", r"\bQQ\b"], "target": "Z"}]
    clean, msgs = lint_rules(spark, active_rules(rules))
    got = _flags(spark, [["qq"]], rules)
    assert got[0]["Z"] is True


def test_active_rules_merge_and_route():
    rules = [{"name": " A ", "patterns": ["x"], "target": "T"},
             {"name": "A", "patterns": ["y"], "target": "T"},
             {"name": "", "patterns": ["z"], "target": ""},
             {"name": "B", "patterns": [], "target": "B"},
             {"name": "C", "patterns": ["w"], "target": "T"}]
    assert dict(active_rules(rules)) == {"A": ["x", "y"], "C": ["w"]}
    assert dict(route_rules(rules, "target")) == {"T": ["x", "y", "w"]}


def test_plain_text_rule():
    assert plain_text_pattern(["a.b", "c d", " "]) == r"\b(a\.b|c\ d)\b"
    r = make_rule(" new ", ["x", "y"], "", plain_text=True)
    assert r == {"name": "NEW", "patterns": [r"\b(x|y)\b"], "target": "NEW"}


def test_load_rules(spark, tmp_path):
    assert len(load_rules(spark, str(tmp_path / "missing.json"))) == 14
    good = tmp_path / "rules.json"
    good.write_text(json.dumps(shipped_rules(), indent=2))
    assert load_rules(spark, str(good)) == shipped_rules()
    bad = tmp_path / "bad.json"
    bad.write_text("[{not json")
    assert load_rules(spark, str(bad)) == []


def test_unicode_dialect(spark):
    rules = [{"name": "W", "patterns": [r"\bcafé\b"], "target": "W"},
             {"name": "S", "patterns": [r"\bSMC\b"], "target": "S"},
             {"name": "D", "patterns": [r"\bNO \d{2}\b"], "target": "D"}]
    got = _flags(spark, [["x café y"], ["ſmc"], ["no ٣٤"], ["cafés"]], rules)
    assert got[0]["W"] is True and got[1]["S"] is True and got[2]["D"] is True
    assert got[3]["W"] is False


def test_route_by_target(spark):
    rules = [{"name": "A", "patterns": [r"\bFOO\b"], "target": "T"},
             {"name": "B", "patterns": [r"\bBAR\b"], "target": "T"}]
    df = spark.createDataFrame([("bar",)], "files string")
    by_name = classify(df, rules, data_sheet_override=False).first().asDict()
    by_target = classify(df, rules, route_by="target", data_sheet_override=False).first().asDict()
    assert by_name["A"] is False and by_name["B"] is True and "T" not in by_name
    assert by_target["T"] is True and "A" not in by_target
