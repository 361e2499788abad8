"""Steps that must not grow faster than their input."""

from pyspark.sql import functions as F

from caseledger.operators import group as G
from caseledger.operators import parse as P
from caseledger.operators import rowdiff
from caseledger.plans.scans import classified_scan, export_run
from caseledger.schema import CASE_FILES


def _files(spark, rows):
    return spark.createDataFrame([(*r, f"{r[1]}/{r[2]}/{r[3]}") for r in rows], CASE_FILES)


ROWS = [("r", "A-1 Ann", "A001-001 Hot 123456 C05", f"f{i:03d}.pdf") for i in range(300)] \
    + [("r", "A-1 Ann", "A001-001  Hot 123456 C05", "a.pdf"), ("r", "B-2 Bob", "A002-001 Cold 123456 C05", "b.pdf")]


def test_a_heavy_folder_stays_in_runs_up_to_its_record(spark, monkeypatch):
    monkeypatch.setattr(G, "RUN_ROWS", 40)
    cf = _files(spark, ROWS)
    rows, heavy, _ = G.measured(G.entry_rows(cf, "token"), G.FOLDER, 100)
    runs = G._folders(rows, {"": "kept"}, heavy, runs=True).where(F.col("case_folder") == ROWS[0][2]).collect()
    assert len(runs) > 4 and sum(r["_lead"] for r in runs) == 1 and sum(r["n_files"] for r in runs) == 300
    assert max(len(r["files_text"].split("\n")) for r in runs) < 150
    plain = sorted(map(tuple, G.group_cases(cf, "token", split_hot=False).collect()))
    for args in ({"hot_files": 100}, {"hot_files": 100, "hot_folders": 1}, {"split_hot": True}):
        assert sorted(map(tuple, G.group_cases(cf, "token", **args).collect())) == plain, args
    assert ("A001-001", 2, 301) in [(r[3], r[-3], r[-2]) for r in plain]


def test_names_are_searched_once(spark):
    df = spark.createDataFrame([("A001-001 Blue star 123456 C01",)], "case_folder string")
    for parser in ("legacy", "token"):
        plan = P.parse_cases(df, parser)._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("array_position") < 12, parser


def test_keys_of_one_side_are_not_paired(spark, monkeypatch):
    seen = []
    places = rowdiff.row_positions
    monkeypatch.setattr(rowdiff, "row_positions", lambda df, *a, **k: seen.append(df.count()) or places(df, *a, **k))
    schema = "client_number string, case_no string, tm_no string, class_code string, files string"
    a = spark.createDataFrame([("A-1", f"c{i}", None, "", "x") for i in range(20)] + [("A-2", "m", None, "", "old")], schema)
    b = spark.createDataFrame([("A-3", f"c{i}", None, "", "x") for i in range(20)] + [("A-2", "m", None, "", "new")], schema)
    got = rowdiff.diff_rows(a, b)
    assert seen[0] == 2
    assert {r["change"]: r["count"] for r in got.groupBy("change").count().collect()} == {"Added": 20, "Removed": 20, "Changed": 1}


def test_sorted_scans_sort_stored_records(spark, tmp_path):
    cf = _files(spark, ROWS)
    scan = classified_scan(cf, sort=True)
    plan = scan._jdf.queryExecution().optimizedPlan().toString()
    assert "Sort [" in plan and "Aggregate" not in plan
    assert [r["case_no"] for r in scan.collect()] == ["A001-001", "A002-001"]
    assert spark.read.option("header", True).option("multiLine", True).csv(export_run(cf, str(tmp_path))).count() == 2
    assert export_run(cf.where("false"), str(tmp_path)) is None


def test_rows_are_dealt_once_and_equal_ones_span_runs(spark, monkeypatch):
    """rows are stored as they come and dealt to ranges, without a shuffle that counts
    them before and a join that finds each folder's first run behind."""
    monkeypatch.setattr(G, "RUN_ROWS", 40)
    plans, store = [], G.materialize
    monkeypatch.setattr(G, "materialize", lambda df, *a: plans.append(df._jdf.queryExecution().optimizedPlan().toString()) or store(df, *a))
    same = ("r", None, "A002-002 Same 123456 C05", "same.pdf")
    cf = spark.createDataFrame([(*r, f"{r[2]}/{r[3]}") for r in ROWS + [same] * 300] + [("r", "B-2 Bob", "A002-003 Void", None, None)], CASE_FILES)
    runs = G._folder_runs(G.entry_rows(cf), {"": "kept"})
    assert "Aggregate" not in plans[0] and "Join" not in runs._jdf.queryExecution().optimizedPlan().toString()
    got = runs.collect()
    assert sum(r["_lead"] for r in got) == 5 and sum(r["n_files"] for r in got) == 602
    equal = [r["files_text"] for r in sorted(got, key=lambda r: r["_run"]) if r["client_folder"] is None]
    assert len(equal) > 4 and "\n".join(equal) == "\n".join(["same"] * 300)
    out = sorted(map(str, G.group_cases(cf, split_hot=True).collect()))
    assert out == sorted(map(str, G.group_cases(cf, split_hot=False).collect()))
