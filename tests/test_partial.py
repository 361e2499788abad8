"""Upsert in place, grouping of what changed, row-level differences, CSV by lines."""

import os
from collections import Counter

from pyspark.sql import functions as F

from caseledger.operators.export import read_csv, write_csv
from caseledger.operators.group import group_cases
from caseledger.operators.incremental import changed_folders, folder_prints, group_changed, group_first
from caseledger.operators.partial_upsert import create_target, read_target, upsert_target
from caseledger.operators.rowdiff import diff_rows
from caseledger.operators.upsert import upsert_cases


def _files(path):
    return {os.path.join(d, f): os.path.getsize(os.path.join(d, f)) for d, _, fs in os.walk(f"{path}/rows") for f in fs
            if f.endswith(".parquet")}


def _cases(spark, lo, hi, name):
    n = F.col("id")
    return spark.range(lo, hi).select(F.format_string("C%06d", n).alias("case_no"), F.concat(F.lit(name), n).alias("name"),
                                      F.lit(name).alias("date_added"), n.alias("row_order"))


def test_upsert_touches_few_parts(spark, tmp_path):
    path = str(tmp_path / "t")
    old = _cases(spark, 0, 20_000, "old").unionByName(_cases(spark, 0, 50, "blank").withColumn("case_no", F.lit(" ")))
    create_target(old, path, parts=512)
    before = _files(path)
    new = _cases(spark, 19_900, 20_100, "new").unionByName(_cases(spark, 0, 3, "b").withColumn("case_no", F.lit(None).cast("string"))) \
        .withColumn("RULE", F.lit(True))
    staged = upsert_target(new, path)
    after = _files(path)
    assert sum(before[f] for f in before if f not in after) < 0.05 * sum(before.values())
    assert {r[0]: r[1] for r in staged.groupBy("upsert_status").count().collect()}["updated"] == 100
    want = Counter(map(tuple, upsert_cases(old, new).drop("upsert_status").select("case_no", "name", "date_added", "row_order", "RULE").collect()))
    got = read_target(spark, path)
    assert Counter(map(tuple, got.select("case_no", "name", "date_added", "row_order", "RULE").collect())) == want
    again = upsert_target(new.where("case_no IS NOT NULL"), path)  # the same once more changes nothing
    assert Counter(map(tuple, read_target(spark, path).select("case_no", "name", "date_added", "row_order", "RULE").collect())) == want
    assert again.where("upsert_status = 'appended'").count() == 0
    upsert_target(new.limit(0), path)
    assert read_target(spark, path).count() == sum(want.values())


def _tree(spark, rows):
    return spark.createDataFrame([("r", c, k, f, "/".join(x for x in (c, k, f) if x)) for c, k, f in rows],
                                 "root string, client_folder string, case_folder string, file_name string, file_path string")


def test_changed_folders_are_grouped_again(spark):
    rows = [(f"A-{c} Ann", f"A{c:03d}-{k:03d} Name 123456 C05", f"f{i}.pdf") for c in range(4) for k in range(10) for i in range(3)]
    rows += [("B-1 Bob", f"unparsed {i}", "u.pdf") for i in range(6)] + [(None, None, "loose.txt"), ("B-1 Bob", None, "x.txt")]
    after = [r for r in rows if r[1] != "A001-002 Name 123456 C05"]                    # a folder goes
    after = [(c, "A002-777 Moved 123456 C05" if k == "A002-003 Name 123456 C05" else k, f) for c, k, f in after]  # renamed
    after = [(c, k, "g.docx" if (k, f) == ("unparsed 3", "u.pdf") else f) for c, k, f in after]  # one of six folders of a record
    after += [("C-9 Cid", "B777-002 New 654321 C01", None), ("A-0 Ann", "A000-000 Name 123456 C05", "f9.pdf"), (None, None, "more.txt")]
    for mode in ("strict", "deep", "token"):
        first = group_first(_tree(spark, rows), mode)
        now = _tree(spark, after)
        changed = changed_folders(first.prints, folder_prints(now))
        assert Counter(r["change"] for r in changed.collect()) == {"Removed": 2, "Added": 2, "Changed": 3}
        got = group_changed(now, first, mode)
        want = group_cases(now, mode)
        assert Counter(map(tuple, got.records.select(want.columns).collect())) == Counter(map(tuple, want.collect())), mode
    same = group_changed(now, got, "token")
    assert changed_folders(got.prints, same.prints).isEmpty() and same.records.count() == want.count()


def test_rows_of_a_key_are_compared(spark):
    schema = "client_number string, case_no string, tm_no string, class_code string, x string, y string"
    key = ("A", "1", "2", "3")
    a = [(*key, "p", "q"), (*key, "r", "s"), (*key, "same", None), (*key, "same", None), (*key, "n", "one")]
    b = [(*key, "p", "s"), (*key, "r", "q"), (*key, "same", None), (*key, "n", None), ("A", None, "2", "3", "new", "new")]
    out = diff_rows(spark.createDataFrame(a, schema), spark.createDataFrame(b, schema)).collect()
    got = Counter((r["case_no"], r["change"], r["changed_columns"], r["old_x"], r["old_y"], r["new_x"], r["new_y"]) for r in out)
    assert got == {("1", "Changed", "x", "p", "q", "r", "q"): 1, ("1", "Changed", "x", "r", "s", "p", "s"): 1,
                   ("1", "Changed", "x", "same", None, "n", None): 1, ("1", "Removed", "", "n", "one", None, None): 1,
                   (None, "Added", "", None, None, "new", "new"): 1}
    hot = spark.range(3000).select(*[F.lit(v).alias(c) for v, c in zip(key, ("client_number", "case_no", "tm_no", "class_code"))],
                                   F.concat(F.lit("x"), "id").alias("x"), F.lit("old").alias("y"))
    new = hot.withColumn("y", F.when(F.substring("x", 2, 9).cast("int") < 1000, "new").otherwise(F.col("y")))
    out = diff_rows(hot, new)
    assert {tuple(r) for r in out.groupBy("change", "changed_columns").count().collect()} == {("Changed", "y", 1000)}
    assert out.where("old_x <> new_x").isEmpty() and diff_rows(hot, hot).isEmpty() and diff_rows(hot.limit(0), hot.limit(0)).isEmpty()


def test_csv_lines_split(spark, tmp_path):
    cells = ["a\nb", 'q"u,o"te', "\r\n", "\\n", "\\s\\", "  pad ", "", None, "plain", "\\", "é\u2028x"]
    df = spark.createDataFrame([(str(i), cells[i % len(cells)], cells[(i * 7) % len(cells)]) for i in range(4000)], "i string, x string, y string")
    path = str(tmp_path / "csv")
    write_csv(df.coalesce(1), path, lines=True)
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    try:
        back = read_csv(spark, path, lines=True)
        assert back.rdd.getNumPartitions() > 2
        assert sorted(map(str, back.collect())) == sorted(map(str, df.collect()))
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)


def test_counted_folders_are_grouped_without_a_sketch(spark, monkeypatch):
    """fingerprints tell the heavy folders; entries aren't stored a second time, and
    rows of heavy folders take no part in a join."""
    from caseledger.operators import group as G
    rows = [("A-1 Ann", "A001-001 Hot 123456 C05", f"f{i:03d}.pdf") for i in range(300)] + [("A-1 Ann", "A001-002 X", "a.pdf")] * 2
    rows += [("A-1 Ann", "A001-001  Hot 123456 C05", "z.pdf"), ("B-2 Bob", "B001-001 Y", None), ("B-2 Bob", None, "l.txt"), (None, None, "n")]
    now = rows + [("A-1 Ann", "A001-001 Hot 123456 C05", "new.pdf"), ("B-2 Bob", "B001-002 New", "b.pdf")]
    want = {m: [Counter(map(tuple, group_cases(_tree(spark, r), m).collect())) for r in (rows, now)] for m in ("strict", "deep")}

    def sketch(*a, **k):
        raise AssertionError("entries were stored to be counted")
    monkeypatch.setattr(G, "measured", sketch)
    for mode in want:
        first = group_first(_tree(spark, rows), mode, hot_files=100)
        got = group_changed(_tree(spark, now), first, mode, hot_files=100)
        assert [Counter(map(tuple, x.records.collect())) for x in (first, got)] == want[mode], mode
        assert changed_folders(got.prints, folder_prints(_tree(spark, now))).isEmpty()


def test_times_of_entries_count_as_changes(spark):
    """fingerprints are summed in one pass with those of the run before."""
    old = _tree(spark, [("A-1 Ann", "A001-001 X", "a.pdf"), ("A-1 Ann", "A001-002 Y", "b.pdf")])
    timed = old.withColumn("modified_time", F.lit("2024"))
    later = timed.withColumn("modified_time", F.when(F.col("file_name") == "a.pdf", "2025").otherwise("2024"))
    first = group_first(timed)
    got = group_changed(later, first)
    assert [(r["case_folder"], r["latest"]) for r in got.prints.orderBy("case_folder").collect()] == [("A001-001 X", "2025"), ("A001-002 Y", "2024")]
    assert [r["case_folder"] for r in changed_folders(first.prints, got.prints).collect()] == ["A001-001 X"]
    assert got.records.count() == 2 and changed_folders(first.prints, folder_prints(old)).count() == 2
