"""S4-S6 for a listing without paths: paths from (root, id, parent_id) alone.

A remote listing names the parent of each entry, not its path. Folders find
theirs by pointer doubling: each folder knows a pointer to some ancestor and the
names between; one join of the folders with themselves replaces the pointer by
the pointer of that ancestor, so the distance doubles every round and a tree of
depth d takes about log2(d) rounds. Only folders that have not reached their root
take part in a round; those that have are looked up, not written again. Pointers lead
to folders that hold folders, so no others are looked up. Each round is stored, which
cuts lineage.

Files join the paths of their folders once, at the end.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import materialize

#: States of an entry: its path is known; an ancestor is no folder of the listing;
#: its ancestors form a ring.
OK, ORPHAN, CYCLE = "ok", "orphan", "cycle"
_LIVE = "live"


def _round(live: DataFrame, known: DataFrame) -> DataFrame:
    """Folders of ``live`` with the pointer, path and state of what they point to.
    ``known`` has one row a folder that holds folders, so a parent of very many folders
    is a hot key on one side only, which adaptive execution splits."""
    up = known.select("root", F.col("id").alias("up"), F.col("up").alias("_up"), F.col("path").alias("_path"),
                      F.col("state").alias("_state"))
    path = F.when(F.col("_path").isNotNull(), F.concat_ws("/", "_path", "path"))
    return _settled(live.join(up, ["root", "up"], "left").select(
        "root", "id", F.col("_up").alias("up"), path.alias("path"),
        F.coalesce("_state", F.lit(ORPHAN)).alias("state"), "inner"))


def _settled(folders: DataFrame) -> DataFrame:
    """``folders`` with pointers of live ones only: no others are followed."""
    return folders.withColumn("up", F.when(F.col("state") == _LIVE, F.col("up")))


def folder_paths(listing: DataFrame, root_ids: DataFrame | None = None) -> DataFrame:
    """(root, id, path, state), a row a folder. ``root_ids`` has (root, root_id);
    by default the root label is the id of the root folder. A folder listed more
    than once counts once, with the least name and parent."""
    # each folder also marks its parent in the same pass: a pointer leads to a parent,
    # later to a parent of one, so only marked folders are looked up
    own = F.struct("name", "parent_id")
    rows = listing.where("is_folder").select("root", F.inline(F.array(
        F.struct("id", own.alias("f"), F.lit(False).alias("inner")),
        F.struct(F.col("parent_id").alias("id"), F.when(F.lit(False), own).alias("f"), F.lit(True).alias("inner")))))
    folders = rows.groupBy("root", "id").agg(F.min("f").alias("f"), F.max("inner").alias("inner")).where(F.col("f").isNotNull())
    folders = folders.select("root", "id", F.col("f.parent_id").alias("up"), F.col("f.name").alias("path"), "inner")
    if root_ids is None:
        top = F.col("up") == F.col("root")
    else:
        tops = root_ids.select("root", F.col("root_id").alias("up")).distinct().withColumn("_top", F.lit(True))
        folders = folders.join(tops, ["root", "up"], "left")
        top = F.col("_top")
    state = F.when(F.coalesce(top, F.lit(False)), F.lit(OK)).when(F.col("up").isNull(), F.lit(ORPHAN)) \
        .otherwise(F.lit(_LIVE))
    rows = materialize(_settled(folders.select("root", "id", "up", "path", state.alias("state"), "inner")), "zstd")
    done, many = [], None
    while True:
        live = rows.where(F.col("state") == _LIVE)
        done.append(rows.where(F.col("state") != _LIVE))
        left = live.count()
        # after k rounds a folder outside any ring is live if it lies deeper than
        # 2^k, and then its ancestors between fall out in the next round: a count
        # that stays holds rings, and what hangs on them, alone
        if not left or left == many:
            break
        many = left
        rows = materialize(_round(live, reduce(DataFrame.unionByName, done + [live]).where("inner")), "zstd")
    done.append(live.withColumn("state", F.lit(CYCLE)))
    out = reduce(DataFrame.unionByName, done)
    path = F.when(F.col("state") == OK, F.col("path"))
    return out.select("root", "id", path.alias("path"), "state")


def paths_from_parents(listing: DataFrame, root_ids: DataFrame | None = None) -> DataFrame:
    """``listing`` with ``path`` built from parent ids (null where there is none)
    and ``path_state`` (ok, orphan, cycle). Every row stays, repeated ones too;
    entries whose parent is a root folder are at its top."""
    parents = folder_paths(listing, root_ids).select(
        "root", F.col("id").alias("parent_id"), F.col("path").alias("_path"), F.col("state").alias("_state"))
    # the root folder itself is a parent with an empty path
    if root_ids is None:
        tops = listing.select("root").distinct().withColumn("parent_id", F.col("root"))
        parents = parents.where(~F.coalesce(F.col("parent_id") == F.col("root"), F.lit(False)))
    else:
        tops = root_ids.select("root", F.col("root_id").alias("parent_id")).distinct()
        parents = parents.join(tops, ["root", "parent_id"], "left_anti")
    parents = parents.unionByName(
        tops.withColumn("_path", F.lit("")).withColumn("_state", F.lit(OK)))
    rows = listing.drop("path", "path_state").join(parents, ["root", "parent_id"], "left")
    path = F.when(F.col("_state") == OK, F.when(F.col("_path") == "", F.col("name"))
                  .otherwise(F.concat_ws("/", "_path", "name")))
    # a ring's own folders and what hangs on them are told from the lost ones
    state = F.coalesce("_state", F.lit(ORPHAN))
    columns: list[str | Column] = [path.alias("path") if c == "path" else c for c in listing.columns if c != "path_state"]
    if "path" not in listing.columns:
        columns.append(path.alias("path"))
    return rows.select(*columns, state.alias("path_state"))
