"""Paths from parent ids, trees of several roots, the shared folder."""

import os
import subprocess
import sys

import pytest
from pyspark.sql import functions as F

from caseledger.operators import reports as R
from caseledger.plans.scans import listing_run
from caseledger.sources.hierarchy import hierarchy_by_parent
from caseledger.sources.paths import paths_from_parents
from conftest import listing_rows

_COLS = "root string, id string, name string, parent_id string, is_folder boolean"


def _paths(spark, rows, **kw):
    got = paths_from_parents(spark.createDataFrame(rows, _COLS), **kw)
    return sorted((r["root"], r["id"], r["path"], r["path_state"]) for r in got.collect())


@pytest.mark.parametrize("depth", [1, 2, 3, 8, 9, 100])
def test_a_chain_of_any_depth(spark, depth):
    rows = [("r", f"d{i}", f"n{i}", f"d{i - 1}" if i else "r", True) for i in range(depth)]
    rows.append(("r", "f", "file", f"d{depth - 1}", False))
    got = dict((i, (p, s)) for _, i, p, s in _paths(spark, rows))
    for i in range(depth):
        assert got[f"d{i}"] == ("/".join(f"n{k}" for k in range(i + 1)), "ok")
    assert got["f"] == ("/".join(f"n{k}" for k in range(depth)) + "/file", "ok")


def test_rings_and_lost_entries_are_told_apart(spark):
    rows = [("r", "a", "A", "r", True), ("r", "b", "B", "a", True), ("r", "f", "F", "b", False),
            ("r", "top", "T", "r", False),
            ("r", "x", "X", "z", True), ("r", "y", "Y", "x", True), ("r", "z", "Z", "y", True),  # a ring of three
            ("r", "on", "ON", "x", True), ("r", "g", "G", "on", False), ("r", "me", "ME", "me", True),
            ("r", "o", "O", "gone", True), ("r", "p", "P", "o", True), ("r", "q", "Q", "p", True), ("r", "h", "H", "q", False),
            ("r", "n", "N", None, True), ("r", "k", "K", "n", False), ("r", "u", "U", "f", False)]
    got = {i: (p, s) for _, i, p, s in _paths(spark, rows)}
    assert got["f"] == ("A/B/F", "ok") and got["top"] == ("T", "ok")
    assert {i for i, v in got.items() if v == (None, "cycle")} == {"x", "y", "z", "on", "g", "me"}
    assert {i for i, v in got.items() if v == (None, "orphan")} == {"o", "p", "q", "h", "n", "k", "u"}


def test_roots_with_equal_ids_and_repeated_rows(spark):
    rows = [("r", "a", "A", "r", True), ("r", "f", "F", "a", False), ("s", "a", "Other", "s", True),
            ("s", "f", "F", "a", False), ("s", "f", "F", "a", False), ("s", "a", "Other", "s", True)]
    assert _paths(spark, rows) == [("r", "a", "A", "ok"), ("r", "f", "A/F", "ok"), ("s", "a", "Other", "ok"),
                                   ("s", "a", "Other", "ok"), ("s", "f", "Other/F", "ok"), ("s", "f", "Other/F", "ok")]
    roots = spark.createDataFrame([("r", "id0")], "root string, root_id string")
    assert _paths(spark, [("r", "a", "A", "id0", True), ("r", "f", "F", "a", False)], root_ids=roots) == \
        [("r", "a", "A", "ok"), ("r", "f", "A/F", "ok")]
    assert _paths(spark, []) == []


def test_paths_are_those_of_the_listing(spark):
    lst = listing_rows(spark, [("A-1 X", True), ("A-1 X/B100-200 Y 123456 C1", True), ("A-1 X/B100-200 Y 123456 C1/TM-1.pdf", False),
                               ("A-1 X/loose.txt", False), ("A-1 X/B100-200 Y 123456 C1/sub", True),
                               ("A-1 X/B100-200 Y 123456 C1/sub/deep.pdf", False), ("at root.txt", False)])
    got = paths_from_parents(lst.drop("path"))
    assert sorted(r["path"] for r in got.collect()) == sorted(r["path"] for r in lst.collect())
    for mode in ("strict", "deep", "token"):
        a, b = (sorted(map(str, listing_run(x, mode).collect())) for x in (lst, lst.drop("path")))
        assert a == b and a


def _two_roots(spark):
    """The same ids in two roots, with other contents."""
    a = listing_rows(spark, [("A-1 X", True), ("A-1 X/B100-200 Y 123456 C1", True), ("A-1 X/B100-200 Y 123456 C1/one.pdf", False)], "p")
    b = listing_rows(spark, [("A-1 X", True), ("A-1 X/B100-200 Y 123456 C1", True), ("A-1 X/B100-200 Y 123456 C1/two.pdf", False),
                             ("A-1 X/B100-200 Y 123456 C1/three.pdf", False)], "q")
    return a.unionByName(b)


def test_inventory_of_roots_with_equal_ids(spark):
    lst = _two_roots(spark)
    clients, cases, files = R.inventory(lst)
    assert (clients.count(), cases.count(), files.count()) == (2, 2, 3)
    report = {r["metric"]: r["value"] for r in R.inventory_report(clients, cases, files).collect()}
    assert report["total_cases"] == 2 and report["total_files"] == 3 and report["largest_case_files"] == 2
    tree = hierarchy_by_parent(lst)
    assert sorted((r["root"], r["file_name"]) for r in tree.collect()) == [("p", "one.pdf"), ("q", "three.pdf"), ("q", "two.pdf")]
    # a case folder of one root is none of the other's clients' cases
    lone = lst.where(~(F.col("is_folder") & (F.col("root") == "q") & (F.col("id") == "A-1 X")))
    clients, cases, files = R.inventory(lone)
    assert (clients.count(), cases.count(), files.count()) == (1, 1, 1)


def test_stored_tables_without_the_setting(tmp_path):
    """A plain local install: no spark.checkpoint.dir anywhere."""
    code = ("from caseledger.session import build_session, materialize, shared_dir\n"
            "s = build_session('local[1]')\n"
            "assert not s.conf.get('spark.checkpoint.dir', None)\n"
            "assert materialize(s.range(3)).count() == 3 and shared_dir(s) == shared_dir(s)\n")
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    env = {**os.environ, "SPARK_CONF_DIR": str(tmp_path), "PYTHONPATH": root, "TMPDIR": str(tmp_path)}
    subprocess.run([sys.executable, "-c", code], env=env, check=True, timeout=120, capture_output=True)


def test_a_run_without_paths_stores_what_it_reads(spark, monkeypatch):
    """ids, sizes and times of entries aren't carried through the joins and stored, and
    only folders that hold folders are looked up."""
    from caseledger.plans import scans
    from caseledger.sources import paths
    lst = listing_rows(spark, [("A-1 X", True), ("A-1 X/B100-200 Y 123456 C1", True), ("A-1 X/B100-200 Y 123456 C1/TM-1.pdf", False),
                               ("A-1 X/B100-200 Y 123456 C1/sub", True), ("A-1 X/B100-200 Y 123456 C1/sub/d.pdf", False),
                               ("A-1 X/B100-201 Void 123456 C1", True), ("at root.txt", False)])
    stored, store = [], scans.materialize
    monkeypatch.setattr(scans, "materialize", lambda df, *a: stored.append(df.columns) or store(df, *a))
    looked, one_round = [], paths._round
    monkeypatch.setattr(paths, "_round", lambda live, known: looked.append(sorted(r["id"] for r in known.collect())) or one_round(live, known))
    a, b = (sorted(map(str, listing_run(x).collect())) for x in (lst, lst.drop("path")))
    assert a == b and len(a) == 2
    assert ["root", "name", "path", "is_folder", "path_state"] in stored and not any("size" in c or "id" in c for c in stored)
    assert looked == [["A-1 X", "A-1 X/B100-200 Y 123456 C1"]] * 2
    assert "LeftAnti" not in paths_from_parents(lst.drop("path"))._jdf.queryExecution().optimizedPlan().toString()
