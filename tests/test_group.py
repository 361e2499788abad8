"""Grouping semantics (FIXTURES F3.6) over listings rebuilt by path."""

from caseledger.operators.group import group_cases
from caseledger.sources.hierarchy import hierarchy_by_parent, hierarchy_by_path
from conftest import listing_rows

TREE = [
    ("A-1 Ann", True),
    ("A-1 Ann/Misc one", True), ("A-1 Ann/Misc one/x.pdf", False),
    ("A-1 Ann/Misc two", True), ("A-1 Ann/Misc two/y.pdf", False),
    ("A-1 Ann/A001-001 Foo 123456 C01", True),
    ("A-1 Ann/A001-001 Foo 123456 C01/desktop.ini", False),
    ("A-1 Ann/A001-002 Bar", True),
    ("A-1 Ann/A001-002 Bar/sub", True), ("A-1 Ann/A001-002 Bar/sub/deep.pdf", False),
    ("A-1 Ann/A001-002 Bar/b.txt", False),
    ("A-1 Ann/loose.pdf", False),
    ("root.pdf", False),
    ("B-2 Bob", True),
]


def _recs(spark, mode):
    cf = hierarchy_by_path(listing_rows(spark, TREE), mode)
    return {(r["client_name"], r["case_no"], r["case_name"]): r
            for r in group_cases(cf, mode=mode).collect()}


def test_strict(spark):
    recs = _recs(spark, "strict")
    merged = recs[("Ann", "", "")]
    assert merged["files"] == "x\ny" and merged["n_folders"] == 2
    noise = recs[("Ann", "A001-001", "Foo")]
    assert noise["files"] == "" and noise["n_files"] == 0
    sub = recs[("Ann", "A001-002", "Bar")]
    assert sub["files"] == "b\nsub"          # sub-folder name counts as a file
    assert len(recs) == 3


def test_token(spark):
    recs = _recs(spark, "token")
    assert recs[("Ann", "A001-002", "Bar")]["files"] == "b"
    assert recs[("Ann", "A001-001", "Foo")]["files"] == ""


def test_deep(spark):
    recs = _recs(spark, "deep")
    assert ("Ann", "A001-001", "Foo") not in recs      # desktop.ini only
    assert recs[("Ann", "A001-002", "Bar")]["files"] == "b\ndeep"
    assert recs[("Ann", "", "—")]["files"] == "loose"
    assert recs[("Root/Uncategorized", "", "—")]["files"] == "root"


def test_limit(spark):
    cf = hierarchy_by_path(listing_rows(spark, TREE), "strict")
    got = group_cases(cf, mode="strict", limit=2).collect()
    assert len(got) == 2
    first = sorted(r["first_path"] for r in group_cases(cf, mode="strict").collect())[:2]
    assert sorted(r["first_path"] for r in got) == first


def test_parent_tree(spark):
    cf = hierarchy_by_parent(listing_rows(spark, TREE)).collect()
    lonely = [r for r in cf if r["client_folder"] == "B-2 Bob"]
    assert len(lonely) == 1 and lonely[0]["case_folder"] is None
    assert not any(r["file_name"] in ("deep.pdf", "sub", "loose.pdf", "root.pdf") for r in cf)
    empty = [r for r in cf if r["case_folder"] == "A001-001 Foo 123456 C01"]
    assert [r["file_name"] for r in empty] == ["desktop.ini"]


def test_partition_count_does_not_change_output(spark):
    lst = listing_rows(spark, TREE)
    a = sorted(map(tuple, group_cases(hierarchy_by_path(lst, "strict")).collect()))
    b = sorted(map(tuple, group_cases(hierarchy_by_path(lst.repartition(7), "strict")).collect()))
    assert a == b


def test_keep_raw_folder(spark):
    cf = hierarchy_by_path(listing_rows(spark, TREE), "strict")
    recs = group_cases(cf, mode="strict", keep_raw_folder=True).collect()
    assert len(recs) == 4
    assert sorted(r["files"] for r in recs if r["case_no"] == "") == ["x", "y"]


def test_split_hot_matches_default(spark):
    lst = listing_rows(spark, TREE)
    for mode in ("strict", "deep", "token"):
        cf = hierarchy_by_path(lst, mode)
        a = sorted(map(tuple, group_cases(cf, mode=mode).collect()))
        b = sorted(map(tuple, group_cases(cf, mode=mode, split_hot=True).collect()))
        assert a == b, mode


def test_split_hot_on_a_hot_folder(spark):
    # one folder holds most files and the range partitioner spreads it
    rows = [("A-1 Ann", True), ("A-1 Ann/Misc", True)]
    rows += [(f"A-1 Ann/Misc/f{i:04d}.pdf", False) for i in range(400)]
    rows += [("A-1 Ann/A001-001 X", True), ("A-1 Ann/A001-001 X/y.pdf", False)]
    cf = hierarchy_by_path(listing_rows(spark, rows), "strict")
    a = sorted(map(tuple, group_cases(cf).collect()))
    b = sorted(map(tuple, group_cases(cf, split_hot=True).collect()))
    assert a == b
    hot = [r for r in group_cases(cf, split_hot=True).collect() if r["case_no"] == ""][0]
    assert hot["files"].split("\n") == [f"f{i:04d}" for i in range(400)]


def test_shared_folder_stage(spark):
    from caseledger.operators.group import folder_entries_both, group_folders, pick_walk
    cf = hierarchy_by_path(listing_rows(spark, TREE), "strict")   # keeps sub-folder entries
    both = folder_entries_both(cf)
    for mode, parser in (("strict", "legacy"), ("token", "token")):
        a = sorted(map(tuple, group_cases(cf, mode=mode, parser=parser).collect()))
        b = sorted(map(tuple, group_folders(pick_walk(both, mode), mode, parser).collect()))
        assert a == b, mode


def test_ordered_concat_many_runs(spark):
    from pyspark.sql import functions as F
    from caseledger.operators.group import ordered_concat
    df = spark.range(1000).select(F.lit("k").alias("key"),
                                  F.format_string("p%04d", (F.col("id") * 7919) % 1000).alias("path"),
                                  F.format_string("t%04d", (F.col("id") * 7919) % 1000).alias("txt"),
                                  F.lit(1).cast("long").alias("one"))
    r = ordered_concat(df, ["key"], "path", ["txt"], ["one"], parts=7).first()
    assert r["txt"].split("\n") == [f"t{i:04d}" for i in range(1000)]
    assert r["n_rows"] == 1000 and r["one"] == 1000 and r["first"] == "p0000"


def test_token_limit_counts_folders(spark):
    cf = hierarchy_by_path(listing_rows(spark, TREE), "token")
    recs = group_cases(cf, mode="token", limit=2).collect()
    # the first two folders by path are "A-1 Ann/A001-001 ..." and "A-1 Ann/A001-002 ..."
    assert sorted(r["case_no"] for r in recs) == ["A001-001", "A001-002"]


def test_groups_are_sorted_by_a_number(spark):
    """Rows whose lists are collected are sorted by key; names that agree in
    long beginnings are slow to compare, so a hash leads them."""
    import re
    cf = hierarchy_by_path(listing_rows(spark, TREE), "strict")
    for split in (False, True):
        plan = group_cases(cf, split_hot=split)._jdf.queryExecution().executedPlan().toString()
        keys = re.findall(r"ObjectHashAggregate\(keys=\[(\w+)", plan)
        assert keys and not any(k.startswith("root") for k in keys), keys


def test_entry_names_are_split_once(spark):
    """F16: what several columns of an entry read is computed once."""
    from caseledger.operators.group import entry_rows
    cf = hierarchy_by_path(listing_rows(spark, TREE), "strict")
    plan = entry_rows(cf)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("substring_index") <= 1 and plan.lower().count("ltrim") + plan.lower().count("trim(leading") <= 1
    rows = spark.createDataFrame(
        [("r", "A", "B", n, f"A/B/{n}" if n else None) for n in ("a.b.PDF", ".hid", "..x.y", "end.", "none", "q.INI", None, "é.ü")],
        "root string, client_folder string, case_folder string, file_name string, file_path string")
    got = {r["path"]: (r["stem"], r["ext"], r["kept"], r["kept_file"]) for r in entry_rows(rows).collect()}
    assert got == {"a.b.PDF": ("a.b", "PDF", 1, 1), ".hid": (".hid", "", 1, 1), "..x.y": ("..x", "y", 1, 1),
                   "end.": ("end", "", 1, 1), "none": ("none", "", 1, 1), "q.INI": ("q", "", 1, 1),
                   None: (None, None, 0, 0), "é.ü": ("é", "ü", 1, 1)}
