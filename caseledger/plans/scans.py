"""End-to-end plans (the tool's run actions). Each stores the entries it groups (to
measure hot folders in the same scan) and is a lazy DataFrame from there on.

L1 classified scan: case_files -> group -> classify -> dates (-> sort at the sink)
L2 quick export:    strict scan of all roots -> 9 base columns
L3 tree inventory:  listing -> hierarchy -> token parse -> 3 tables + report
L4 token scan:      L1 with the token parser and walker
"""

from __future__ import annotations

import logging

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.classify import classify
from ..operators.export import (QUICK_EXPORT_NAME, project_export, quick_export, sort_records,
                                stamp_dates, write_export)
from ..operators.upsert import upsert_cases
from ..operators.group import (FOLDER, HOT_FILES, HOT_FOLDERS, folder_entries_both, group_cases, group_folders,
                               measured, pick_walk)
from ..sources.hierarchy import hierarchy_by_path
from ..session import materialize
from ..sources.listing import first_listed_clients, not_trashed
from ..sources.paths import OK, paths_from_parents
from ..sources.rules import shipped_rules

_LOG = logging.getLogger(__name__)

DEFAULT_AS_OF = "2026-01-15 09:30:00"


def classified_scan(case_files: DataFrame, rules=None, mode: str = "strict",
                    parser: str | None = None, as_of: str = DEFAULT_AS_OF,
                    limit: int | None = None, sort: bool = False, split_hot: bool | None = None,
                    messages: list | None = None) -> DataFrame:
    """L1 / L4: case records with one flag per rule and the date columns.

    ``split_hot``: by default folders and keys that hold very many rows are found
    while the entries are stored and only they are spread over tasks; True spreads
    all, False none. The records are the same. ``messages`` collects what the
    rules' check says.
    """
    rules = shipped_rules() if rules is None else rules
    records = group_cases(case_files, mode=mode, parser=parser, limit=limit, split_hot=split_hot)
    if sort:
        # a sort reads its input twice, so records are stored; flags and dates keep the order
        records = sort_records(materialize(records, "zstd"))
    records = classify(records, rules, messages=messages)
    return stamp_dates(records, as_of, "token" if mode == "token" else mode)


def scan_pair(case_files: DataFrame, rules=None, as_of: str = DEFAULT_AS_OF,
              split_hot: bool | None = None):
    """(L1 strict/legacy records, L4 token records) of one listing with one
    file-level pass: the folder stage of both walks is built once and stored
    in the shared checkpoint folder (a job that runs at once), then each walk
    parses and groups it. Heavy folders are spread unless ``split_hot`` is False;
    with True each walk spreads all of its own folder stage."""
    if split_hot:
        return (classified_scan(case_files, rules, as_of=as_of, split_hot=True),
                token_scan(case_files, rules, as_of=as_of, split_hot=True))
    rules = shipped_rules() if rules is None else rules
    stage = folder_entries_both(case_files, HOT_FILES if split_hot is None else None, runs=True)
    folders, _, most = measured(stage, FOLDER, HOT_FILES, client=["root", "client_folder"])
    split_keys = None if split_hot is None and most["client"] > HOT_FOLDERS else False
    out = []
    for mode, parser in (("strict", "legacy"), ("token", "token")):
        recs = classify(group_folders(pick_walk(folders, mode), mode, parser, split_hot=split_keys), rules)
        out.append(stamp_dates(recs, as_of, mode))
    return tuple(out)


def token_scan(case_files: DataFrame, rules=None, as_of: str = DEFAULT_AS_OF,
               limit: int | None = None, split_hot: bool | None = None) -> DataFrame:
    """L4: token parser and walker (only real files, empty folders kept)."""
    return classified_scan(case_files, rules, mode="token", parser="token", as_of=as_of,
                           limit=limit, split_hot=split_hot)


def listing_run(listing: DataFrame, mode: str = "strict", rules=None, as_of: str = DEFAULT_AS_OF,
                max_clients: int | None = None, split_hot: bool | None = None) -> DataFrame:
    """L1 from a listing, as a user runs it: drop trash, rebuild the tree (the
    first ``max_clients`` client folders of each root), group, classify, sort.
    A listing without a ``path`` column gets paths from parent ids; entries
    without a way to their root are left out and logged."""
    listing = not_trashed(listing)
    if "path" not in listing.columns:
        # only what names, parents and the tree are read from travels and is stored
        listing = paths_from_parents(listing.select("root", "id", "name", "parent_id", "is_folder"))
        listing = materialize(listing.select("root", "name", "path", "is_folder", "path_state"), "zstd")
        lost = listing.where(F.col("path_state") != OK).groupBy("path_state").count().collect()
        for r in lost:
            _LOG.warning("%d entries left out: %s", r["count"], r["path_state"])
        listing = listing.where(F.col("path_state") == OK).drop("path_state")
    files = hierarchy_by_path(first_listed_clients(listing, max_clients), mode)
    return classified_scan(files, rules, mode=mode, as_of=as_of, sort=True, split_hot=split_hot)


def quick_scan(case_files: DataFrame, as_of: str = DEFAULT_AS_OF, sort: bool = False) -> DataFrame:
    """L2: strict scan of every root, no limit, 9 base columns. The rule
    columns are never built: Catalyst prunes them from the plan."""
    return quick_export(classified_scan(case_files, mode="strict", as_of=as_of, sort=sort))


def export_run(case_files: DataFrame, base_dir: str, run: str = "clients_data", rules=None,
               **scan_args) -> str | None:
    """L1 to the file sink: records sorted at the sink, export columns,
    written under a new versioned name (never overwrites; skips empty)."""
    rules = shipped_rules() if rules is None else rules
    # stored: the sort reads them twice, and the test for an empty export once more
    records = materialize(classified_scan(case_files, rules, **scan_args))
    return write_export(project_export(sort_records(records), rules), base_dir, run, source=records)


def export_quick(case_files: DataFrame, base_dir: str, as_of: str = DEFAULT_AS_OF) -> str | None:
    """L2 to the file sink."""
    return write_export(quick_scan(case_files, as_of, sort=True), base_dir, QUICK_EXPORT_NAME)


def upsert_run(case_files: DataFrame, existing: DataFrame | None, target_path: str, rules=None,
               key: str = "case_no", **scan_args) -> DataFrame:
    """L1 into a table: the scan's records upserted into ``existing`` (a
    table written by an earlier run, or None for the first run) and written
    to ``target_path`` (a new version; never the path ``existing`` was read
    from). ``row_order`` is the position: the run that appended a row, then the
    order of its records (client number, case number, rest of the key, root).
    Returns the written table."""
    last = -1 if existing is None else existing.agg(F.max("row_order.run")).first()[0]
    records = classified_scan(case_files, rules, **scan_args).drop("n_folders", "n_files", "first_path")
    records = records.withColumn("row_order", F.struct(
        F.lit(0 if last is None else last + 1).alias("run"), "client_number", "case_no", "client_name",
        "case_name", "tm_no", "class_code", "root"))
    if existing is None:
        merged = records.withColumn("upsert_status", F.lit("appended"))
    else:
        merged = upsert_cases(existing.drop("upsert_status"), records, key=key,
                              order_by=("row_order",))
    merged.write.mode("errorifexists").parquet(target_path)
    return merged.sparkSession.read.parquet(target_path)
