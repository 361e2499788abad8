"""Listing sources: formats, raw API shape, roots, trash, first clients."""

from pyspark.sql import functions as F

from caseledger.schema import FOLDER_MIME
from caseledger.sources.listing import (files_only, first_clients, folders_only, not_trashed,
                                        read_listing, scan_roots)
from conftest import listing_rows
from test_group import TREE


def test_read_formats(spark, tmp_path):
    lst = listing_rows(spark, TREE)
    for fmt in ("parquet", "json", "csv"):
        p = str(tmp_path / fmt)
        w = lst.write.format(fmt)
        if fmt == "csv":
            w = w.option("header", True)
        w.save(p)
        back = read_listing(spark, p, fmt)
        assert sorted(map(tuple, back.collect())) == sorted(map(tuple, lst.collect())), fmt


def test_raw_listing(spark, tmp_path):
    raw = [
        {"id": "f1", "name": "Case A", "parent_id": "c1", "mimeType": FOLDER_MIME, "size": None},
        {"id": "x1", "name": "a.pdf", "parent_id": "f1", "mimeType": "application/pdf", "size": "12"},
        {"id": "x2", "name": "b", "parent_id": "f1", "size": "n/a", "trashed": True},
    ]
    p = tmp_path / "raw.json"
    p.write_text("\n".join(__import__("json").dumps(r) for r in raw))
    got = {r["id"]: r for r in read_listing(spark, str(p), "json", root="clients", raw=True).collect()}
    assert got["f1"]["is_folder"] and got["f1"]["size"] is None and got["f1"]["root"] == "clients"
    assert got["x1"]["size"] == 12 and got["x1"]["mime_type"] == "application/pdf"
    assert got["x2"]["size"] is None and got["x2"]["mime_type"] == "" and got["x2"]["created_time"] == ""
    assert got["x2"]["trashed"] is True and got["x1"]["trashed"] is False


def test_roots_trash_first_clients(spark):
    lst = listing_rows(spark, TREE)
    both, msgs = scan_roots([("clients", lst), ("consultants", lst), ("gone", None)])
    assert msgs == ["Not found: gone"] and both.count() == 2 * lst.count()
    assert not_trashed(lst.withColumn("trashed", F.col("name") == "x.pdf")).count() == lst.count() - 1
    assert folders_only(lst).count() + files_only(lst).count() == lst.count()
    assert folders_only(lst).where(~F.col("is_folder")).count() == 0
    cf = spark.createDataFrame([("r", "B", "c", "f", "B/c/f"), ("r", "A", "c", "f", "A/c/f"),
                                ("r", "C", "c", None, None)],
                               "root string, client_folder string, case_folder string, "
                               "file_name string, file_path string")
    assert sorted(r["client_folder"] for r in first_clients(cf, 2).collect()) == ["A", "B"]
    assert first_clients(cf, 0).count() == 3
