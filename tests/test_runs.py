"""Run actions: two upsert runs, hot groups, rule messages, stored tables."""

import re

import pytest
from pyspark.sql import functions as F

from caseledger import session
from caseledger.operators import classify as C
from caseledger.operators import reports as R
from caseledger.operators.export import project_export, write_export
from caseledger.operators.group import (FOLDER, entry_rows, folder_entries, folder_entries_both, group_cases, measured,
                                        ordered_concat)
from caseledger.plans.scans import classified_scan, listing_run, scan_pair, upsert_run
from caseledger.sources.hierarchy import hierarchy_by_path, tree_by_parent
from caseledger.sources.listing import first_listed_clients, read_listing
from conftest import listing_rows

RULES = [{"name": "ACK", "patterns": ["ACK"], "target": "ACK"}]


def _case_files(spark, rows):
    return spark.createDataFrame([(r, c, k, f, f"{c}/{k}/{f}") for r, c, k, f in rows],
                                 "root string, client_folder string, case_folder string, file_name string, file_path string")


def test_two_upsert_runs_update_the_last_row(spark, tmp_path):
    rows = [("r", c, f"A{n:03d}-001 Name 123456 C05", "ACK.pdf") for n in range(20) for c in ("A-1 Ann", "B-2 Bob")]
    first = upsert_run(_case_files(spark, rows), None, str(tmp_path / "v0"), rules=RULES)
    assert first.count() == 40 and {r["upsert_status"] for r in first.collect()} == {"appended"}
    second = upsert_run(_case_files(spark, rows), first, str(tmp_path / "v1"), rules=RULES, as_of="2026-02-01 00:00:00")
    got = second.collect()
    assert len(got) == 40
    assert {(r["client_number"], r["upsert_status"]) for r in got} == {("A-1", "untouched"), ("B-2", "updated")}
    assert {r["row_order"]["run"] for r in got} == {0} and {r["date_added"] for r in got} == {"15-Jan-26"}
    more = rows + [("r", "C-3 Cid", "B777-002 New 654321 C01", "x.pdf")]
    third = upsert_run(_case_files(spark, more), second, str(tmp_path / "v2"), rules=RULES)
    new = third.where("client_number = 'C-3'").first()
    assert third.count() == 41 and new["upsert_status"] == "appended" and new["row_order"]["run"] == 1


def _big_case_files(spark):
    rows = [("r", "A-1 Ann", "A001-001 Hot 123456 C05", f"f{i % 300:03d}.pdf") for i in range(600)]
    rows += [("r", "A-1 Ann", f"A{i:03d}-002 Name 123456 C05", "a.pdf") for i in range(400)]
    rows += [("r", "B-2 Bob", f"unparsed {i:03d}", f"u{i}.pdf") for i in range(200)]
    return _case_files(spark, rows).repartition(4)


@pytest.mark.parametrize("mode", ["strict", "deep", "token"])
def test_heavy_folders_and_keys_are_found_in_the_same_scan(spark, mode):
    cf = _big_case_files(spark)
    rows, heavy, most = measured(entry_rows(cf, mode), FOLDER, 500, client=["root", "client_folder"])
    assert heavy == ["=r\x00=A-1 Ann\x00=A001-001 Hot 123456 C05"] and most == {"client": 1000}
    assert rows.count() == 1200
    plain = sorted(map(tuple, group_cases(cf, mode=mode, split_hot=False).collect()))
    for args in ({"hot_files": 500}, {"hot_folders": 100}, {"hot_files": 500, "hot_folders": 100}, {"split_hot": True}, {}):
        assert sorted(map(tuple, group_cases(cf, mode=mode, **args).collect())) == plain, args
    texts = sorted(r["files_text"] for r in folder_entries(cf, mode, split_hot=True).collect())
    assert texts == sorted(r["files_text"] for r in folder_entries(cf, mode).collect())


def test_a_hot_folder_spans_tasks_and_equal_rows_are_counted(spark):
    cf = _big_case_files(spark)
    rows = entry_rows(cf).where(F.col("case_folder").startswith("A001-001"))
    once = rows.groupBy(*FOLDER, "path", "stem", "ext").count()
    assert once.count() == 300
    parts = once.repartitionByRange(4, *FOLDER, "path", "stem", "ext")
    assert parts.select(F.spark_partition_id()).distinct().count() == 4
    again = [sorted(map(tuple, parts.withColumn("p", F.spark_partition_id()).collect())) for _ in range(2)]
    assert again[0] == again[1]
    many = rows.unionByName(rows).unionByName(rows)  # a folder of equal rows
    got = ordered_concat(many, FOLDER, "path", ["stem"], ["kept"], parts=5).first()
    assert got["stem"].split("\n") == [f"f{i:03d}" for i in range(300) for _ in range(6)]
    assert got["n_rows"] == got["kept"] == 1800


def test_runs_split_hot_groups_or_not(spark):
    cf = _big_case_files(spark)
    a = sorted(map(str, classified_scan(cf, RULES).collect()))
    for split in (True, False):
        assert a == sorted(map(str, classified_scan(cf, RULES, split_hot=split).collect()))
    pairs = [[sorted(map(str, d.collect())) for d in scan_pair(cf, RULES, split_hot=split)] for split in (None, False, True)]
    assert pairs[0][0] == a and pairs[0] == pairs[1]
    assert [len(x) for x in pairs[2]] == [len(x) for x in pairs[0]]
    both = sorted(map(str, folder_entries_both(cf).collect()))
    assert both == sorted(map(str, folder_entries_both(cf, hot_files=500).collect()))


PATTERNS = [(r"(?P<my_name>ACK)", "an ACK"), (r"(?P<a_1>x)-(?P=a_1)", "x-x"), (r"[[]x", "a[x"), (r"[a&&b]", "&"),
            (r"[]x]", "]"), (r"[^]x]", "a"), (r"[\]&[]z", "&z"), (r"end\Z", "the end"), (r"end\Z", "end\n")]


@pytest.mark.parametrize("pattern,text", PATTERNS)
def test_patterns_mean_what_python_means(spark, pattern, text):
    df = spark.createDataFrame([(text,)], "files string")
    said = []
    out = C.classify(df, [{"name": "R", "patterns": [pattern]}], messages=said, data_sheet_override=False).first()
    assert not said
    assert out["R"] == bool(re.search(pattern, text.replace("\n", " "), re.I))


def test_ascii_flags_agree_with_the_full_ones(spark):
    from caseledger.sources.rules import shipped_rules
    texts = ["DATA SHEET pvt ltd", "TM-1 ack", "reply\texamination", "Opposition no. 5", "a\x1cb ID B", "legal\x0bnotice", "\u212a id"]
    df = spark.createDataFrame([(t,) for t in texts], "t string").where(F.octet_length("t") == F.char_length("t"))
    every = [C.to_java(p) for r in shipped_rules() for p in r["patterns"]]
    same = [F.col("t").rlike(C.RULE_FLAGS + p) == F.col("t").rlike(C.ASCII_FLAGS + p) for p in every]
    assert df.count() == len(texts) - 1 and all(all(r) for r in df.select(*same).collect())


def test_patterns_that_cannot_be_converted_are_reported(spark):
    df = spark.createDataFrame([("b",)], "files string")
    said = []
    out = C.classify(df, [{"name": "R", "patterns": [r"(a)?(?(1)b|c)", "(", "b"]}], messages=said).first()
    assert out["R"] and len(said) == 2


def test_rule_names_that_differ_in_case(spark):
    df = spark.createDataFrame([("ACK x",), ("y",)], "files string")
    said = []
    out = C.classify(df, [{"name": "Ack", "patterns": ["ACK"]}, {"name": "ACK", "patterns": ["y"]},
                          {"name": "FILES", "patterns": ["x"]}], messages=said, data_sheet_override=False)
    assert len(said) == 1 and "differ in case" in said[0]
    hits = {r["rule"]: r["hits"] for r in C.rule_hit_counts(out, ["Ack", "ACK", "FILES"]).collect()}
    assert hits == {"Ack": 1, "ACK": 1, "FILES": 1}
    rules = [{"name": n} for n in ("Ack", "ACK")]
    assert project_export(out, rules).columns == ["FILES", "Ack", "ACK"]


def test_compare_counts_every_row_of_a_key(spark):
    kind = "root string, client_number string, case_no string, tm_no string, class_code string, files string"
    rows = [("r", "A-1", "1", "", "", "x"), ("r", "A-1", "1", "", "", "z"), ("s", "A-1", "1", "", "", "x")]
    a = spark.createDataFrame(rows, kind)
    b = spark.createDataFrame([rows[0][:-1] + ("y",), rows[1], rows[2]], kind)
    got = {r["root"]: r for r in R.compare_exports(a, b).collect()}
    assert got["r"]["status"] == "Changed" and got["r"]["changed_columns"] == "files" and got["r"]["n_a"] == 2
    assert got["s"]["status"] == "Identical"
    again = R.compare_exports(a, a.unionByName(a.limit(1)))
    assert {r["status"] for r in again.where("root = 'r'").collect()} == {"Changed"}
    assert {r["status"] for r in R.compare_exports(a, a.orderBy(F.desc("files"))).collect()} == {"Identical"}


def test_ids_are_told_apart_by_root(spark):
    one = listing_rows(spark, [("A", True), ("A/c", True), ("A/c/f.pdf", False)], "r")
    two = listing_rows(spark, [("A", True), ("A/c", True), ("A/c/g.pdf", False)], "s")
    lst = one.unionByName(two).withColumn("id", F.regexp_replace("id", "^[rs]/", ""))
    assert tree_by_parent(lst).count() == 2


def test_first_listed_clients_and_listing_run(spark, tmp_path):
    lst = listing_rows(spark, [("A-1 Ann", True), ("A-1 Ann/A001-001 N 123456 C05", True),
                               ("A-1 Ann/A001-001 N 123456 C05/ACK.pdf", False), ("B-2 Bob", True),
                               ("B-2 Bob/B001-001 M 123456 C05", True), ("loose.pdf", False)])
    kept = first_listed_clients(lst, 1)
    assert {r["path"] for r in kept.collect()} == {r["path"] for r in lst.collect() if not r["path"].startswith("B-2")}
    lst.write.parquet(str(tmp_path / "l"))
    out = listing_run(read_listing(spark, str(tmp_path / "l")), rules=RULES, max_clients=1).collect()
    assert [(r["client_number"], r["ACK"]) for r in out] == [("A-1", True)]
    assert listing_run(lst, rules=RULES).count() == 2
    assert hierarchy_by_path(lst, "strict").count() == 2


def test_exports_count_on(spark, tmp_path):
    df = spark.createDataFrame([("a",)], "x string")
    names = [write_export(df, str(tmp_path), "run") for _ in range(3)]
    assert [n.rsplit("/", 1)[1] for n in names] == ["run.csv", "run_1.csv", "run_2.csv"]
    assert write_export(df, str(tmp_path), "none", source=df.limit(0)) is None


def test_shared_folder_must_be_set_on_a_cluster():
    class Conf:
        def get(self, *_):
            return None

    class Fake:
        conf = Conf()

        class sparkContext:  # noqa: N801
            master = "spark://host:7077"

            @staticmethod
            def getCheckpointDir():
                return None
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        session.shared_dir(Fake())


def test_stored_tables_go(spark):
    import os
    with session.stored_tables(spark):
        df = session.materialize(spark.range(3))
        path = session._STORED[-1].replace("file://", "")
        assert df.count() == 3 and os.path.isdir(path)
    assert not os.path.isdir(path) and path not in session._STORED
