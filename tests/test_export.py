"""Exports: columns, sort, CSV round trip, versioned names."""

from caseledger.operators import export as X
from caseledger.sources.rules import shipped_rules


def test_export_columns():
    rules = shipped_rules() + [{"name": " TM-1 ", "patterns": ["x"], "target": ""},
                               {"name": "NEW", "patterns": ["y"], "target": ""}]
    cols = X.export_columns(rules)
    assert cols[:8] == ["CLIENT NUMBER", "CLIENT NAME", "CASE #", "CASE NAME", "TM NO", "CLASS",
                        "FILES", "EXT"]
    assert cols[-1] == "DATE ADDED" and cols.count("TM-1") == 1 and cols[-2] == "NEW"


def test_sort_and_dates(spark):
    df = spark.createDataFrame([("B-2", "A1", "n"), ("", "Z9", "m"), ("B-2", "", "k"), ("A-1", "", "j")],
                               "client_number string, case_no string, client_name string")
    got = [(r[0], r[1]) for r in X.sort_records(df).collect()]
    assert got == [("", "Z9"), ("A-1", ""), ("B-2", ""), ("B-2", "A1")]
    d = X.stamp_dates(df, "2026-08-06").first()
    assert d["date_added"] == "06-Aug-26" and d["updated_on"] == "06-Aug-26"
    t = X.stamp_dates(df, "2026-08-06 10:11:12", mode="token").first()
    assert t["date_added"] == "2026-08-06 10:11:12" and "updated_on" not in t.asDict()


def test_csv_round_trip_and_versions(spark, tmp_path):
    df = spark.createDataFrame([("a\nb", True, ""), ('q"x', False, "e")],
                               "files string, flag boolean, ext string")
    p1 = X.write_export(df.coalesce(1), str(tmp_path), "clients_data")
    p2 = X.write_export(df.coalesce(1), str(tmp_path), "clients_data")
    assert p1.endswith("clients_patterns.csv") and p2.endswith("clients_patterns_1.csv")
    back = {r["files"]: r for r in X.read_csv(spark, p1).collect()}
    assert back["a\nb"]["flag"] == "True" and back['q"x']["flag"] == "False"
    assert X.write_export(df.limit(0), str(tmp_path), "x") is None


def test_csv_files_hold_few_rows(spark, tmp_path, monkeypatch):
    """a file whose cells hold line breaks is read by one task, so one task that
    writes many rows must not write one file."""
    monkeypatch.setattr(X, "FILE_ROWS", 4)
    df = spark.range(10).selectExpr("concat('a\n', id) as files", "cast(id as string) as n").coalesce(1)
    path = str(tmp_path / "few")
    X.write_csv(df, path)
    back = X.read_csv(spark, path)
    assert len(back.inputFiles()) == 3
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, df.collect()))


def test_run_plans(spark, tmp_path):
    from caseledger.plans.scans import export_quick, export_run, upsert_run
    from caseledger.sources.hierarchy import hierarchy_by_path
    from conftest import listing_rows
    from test_group import TREE
    cf = hierarchy_by_path(listing_rows(spark, TREE), "strict")
    p = export_run(cf, str(tmp_path), "clients_data")
    assert p.endswith("clients_patterns.csv") and X.read_csv(spark, p).count() == 3
    q = export_quick(cf, str(tmp_path))
    assert X.read_csv(spark, q).columns[-1] == "DATE ADDED"
    v1 = upsert_run(cf, None, str(tmp_path / "t1"))
    v2 = upsert_run(cf, v1, str(tmp_path / "t2"))
    st = sorted(r["upsert_status"] for r in v2.collect())
    # keyed records are updated; the blank-key record is appended again
    assert st == ["appended", "untouched", "updated", "updated"]


def test_updated_on_only_on_request(spark):
    df = spark.createDataFrame([("A-1", "x", "d", "u")],
                               "client_number string, files string, date_added string, updated_on string")
    assert "UPDATED ON" not in X.project_export(df, []).columns
    assert X.project_export(df, [], include_updated_on=True).columns[-1] == "UPDATED ON"
