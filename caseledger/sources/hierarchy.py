"""Rebuild the two-level tree (client / case / files) from a listing.

Output is the flattened ``case_files`` form (F1.2) plus ``entry_is_folder``:
``root, client_folder, case_folder, file_name, file_path, entry_is_folder``.
A null ``file_name`` marks an empty case folder; a null ``case_folder`` a
client without case folders.

Empty folders are found with a left-anti join against the *distinct* parent
keys of the entries. The distinct runs as a partial aggregation before the
shuffle, so a folder holding a third of all files sends one row per map task
and the anti join never sees a hot key.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

def _null(t="string"):
    return F.lit(None).cast(t)


def hierarchy_by_path(listing: DataFrame, mode: str = "deep") -> DataFrame:
    """S4 (deep), S5 (strict), S6 (token) over ``path`` components.

    deep:   every file; path[0] = client, path[1] = case, deeper files roll
            up into their level-2 case; files in the root or a client folder
            get ``""`` for the missing levels.
    strict: case folders at depth 2 with every child (folders too, Q8);
            empty case folders kept.
    token:  as strict but only files; a folder holding only sub-folders is empty.
    """
    parts = F.split(F.col("path"), "/")
    depth = F.size(parts)
    if mode == "deep":
        files = listing.where(~F.col("is_folder"))
        return files.select(
            "root",
            F.when(depth >= 2, F.get(parts, 0)).otherwise(F.lit("")).alias("client_folder"),
            F.when(depth >= 3, F.get(parts, 1)).otherwise(F.lit("")).alias("case_folder"),
            F.col("name").alias("file_name"), F.col("path").alias("file_path"),
            F.lit(False).alias("entry_is_folder"))
    if mode not in ("strict", "token"):
        raise ValueError("mode must be deep, strict or token")
    cases = listing.where(F.col("is_folder") & (depth == 2)).select(
        "root", F.get(parts, 0).alias("client_folder"), F.get(parts, 1).alias("case_folder"))
    entries = listing.where(depth == 3)
    if mode == "token":
        entries = entries.where(~F.col("is_folder"))
    entries = entries.select(
        "root", F.get(parts, 0).alias("client_folder"), F.get(parts, 1).alias("case_folder"),
        F.col("name").alias("file_name"), F.col("path").alias("file_path"),
        F.col("is_folder").alias("entry_is_folder"))
    keys = entries.select("root", "client_folder", "case_folder").distinct()
    empty = cases.join(keys, ["root", "client_folder", "case_folder"], "left_anti").select(
        "root", "client_folder", "case_folder", _null().alias("file_name"),
        _null().alias("file_path"), _null("boolean").alias("entry_is_folder"))
    return entries.unionByName(empty)


def tree_by_parent(listing: DataFrame, root_ids: DataFrame | None = None) -> DataFrame:
    """S3: client -> case -> file by ``parent_id`` with ids and metadata.

    ``root_ids`` has (root, root_id); by default the root label is the id of
    the root folder. Client folders without cases are kept once (case
    columns null), empty case folders once (file columns null). Files
    directly under a client and folders inside a case are ignored.

    Joins are equi-joins on ids; AQE turns the client side into a broadcast
    only when its measured size is below the threshold, and splits a case
    holding a very large share of the files (skew join on the inner join).
    """
    folders = listing.where(F.col("is_folder"))
    if root_ids is None:
        clients = folders.where(F.col("parent_id") == F.col("root"))
    else:
        clients = folders.join(root_ids, (folders["root"] == root_ids["root"])
                               & (folders["parent_id"] == root_ids["root_id"]), "left_semi")
    clients = clients.select(
        "root", F.col("id").alias("client_id"), F.col("name").alias("client_folder"),
        F.col("parent_id").alias("client_parent_id"),
        F.col("created_time").alias("client_created_time"),
        F.col("modified_time").alias("client_modified_time"), "source")
    cases = folders.select(
        F.col("id").alias("case_id"), F.col("name").alias("case_folder"),
        F.col("parent_id").alias("client_id"), F.col("created_time").alias("case_created_time"),
        F.col("modified_time").alias("case_modified_time"), "root")
    files = listing.where(~F.col("is_folder")).select(
        "root", F.col("id").alias("file_id"), F.col("name").alias("file_name"),
        F.col("parent_id").alias("case_id"), "mime_type", "size",
        F.col("created_time").alias("file_created_time"),
        F.col("modified_time").alias("file_modified_time"))
    # ids are unique within a root
    case_full = cases.join(clients, ["root", "client_id"])
    with_files = files.join(case_full, ["root", "case_id"])
    empty_cases = case_full.join(files.select("root", "case_id").distinct(), ["root", "case_id"], "left_anti")
    lonely = clients.join(cases.select("root", "client_id").distinct(), ["root", "client_id"], "left_anti")
    return with_files.unionByName(empty_cases, allowMissingColumns=True) \
        .unionByName(lonely, allowMissingColumns=True)


def hierarchy_by_parent(listing: DataFrame, root_ids: DataFrame | None = None) -> DataFrame:
    """S3 in the ``case_files`` form used by the grouping operators."""
    t = tree_by_parent(listing, root_ids)
    return t.select(
        "root", "client_folder", "case_folder", "file_name",
        F.when(F.col("file_name").isNull(), _null())
        .otherwise(F.concat_ws("/", "client_folder", "case_folder", "file_name")).alias("file_path"),
        F.when(F.col("file_name").isNull(), _null("boolean")).otherwise(F.lit(False))
        .alias("entry_is_folder"))
