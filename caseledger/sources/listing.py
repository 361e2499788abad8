"""Listing tables (one row per folder or file).

The tool crawled a live tree; here the input is a listing table exported by
any inventory job, read with an explicit schema so Parquet pushes filters
and prunes columns.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..schema import FOLDER_MIME, LISTING, RAW_LISTING


def read_listing(spark: SparkSession, path: str, fmt: str = "parquet",
                 root: str | None = None, raw: bool = False, multi_line: bool = False) -> DataFrame:
    """Load the listing of one or more roots.

    ``raw=True`` reads the remote API shape (``RAW_LISTING``) and normalises
    it with ``classify_entries``. ``root`` fills the root label when the
    files do not carry one. ``multi_line`` reads CSV cells that hold line
    breaks; such a file can't be split, so it is off by default.
    """
    reader = spark.read.schema(RAW_LISTING if raw else LISTING).format(fmt)
    if fmt == "csv":
        # quoted "" stays the empty string, an empty field is null
        reader = (reader.option("header", True).option("multiLine", multi_line)
                  .option("escape", '"').option("nullValue", "\u0000"))
    df = reader.load(path)
    if root is not None:
        df = df.withColumn("root", F.coalesce(F.col("root"), F.lit(root)))
    return classify_entries(df) if raw else df


def classify_entries(raw: DataFrame) -> DataFrame:
    """Folder vs file by MIME type; size text -> bigint (absent or not a
    number -> null, folders null); absent text -> ``""``."""
    is_folder = F.coalesce(F.col("mimeType") == FOLDER_MIME, F.lit(False))
    text = lambda c: F.coalesce(F.col(c), F.lit(""))
    return raw.select(
        text("root").alias("root"), text("id").alias("id"), text("name").alias("name"),
        F.col("parent_id"), F.col("path"), is_folder.alias("is_folder"),
        text("mimeType").alias("mime_type"),
        F.when(is_folder, F.lit(None)).otherwise(F.expr("try_cast(size as bigint)")).alias("size"),
        text("createdTime").alias("created_time"), text("modifiedTime").alias("modified_time"),
        F.coalesce(F.col("trashed"), F.lit(False)).alias("trashed"),
        F.coalesce(F.col("source"), F.lit("drive")).alias("source"))


def not_trashed(listing: DataFrame) -> DataFrame:
    """Drop trashed entries (a pushed-down Parquet filter)."""
    return listing.where(~F.col("trashed"))


def folders_only(listing: DataFrame) -> DataFrame:
    """P2."""
    return listing.where(F.col("is_folder"))


def files_only(listing: DataFrame) -> DataFrame:
    """P2."""
    return listing.where(~F.col("is_folder"))


def scan_roots(roots) -> tuple[DataFrame | None, list[str]]:
    """UNION ALL of several roots, each labelled with its ``root``.

    ``roots`` is a list of (label, DataFrame or None); a missing root is
    reported and skipped; duplicates stay.
    """
    out, messages = None, []
    for label, df in roots:
        if df is None:
            messages.append(f"Not found: {label}")
            continue
        df = df.withColumn("root", F.lit(label))
        out = df if out is None else out.unionByName(df, allowMissingColumns=True)
    return out, messages


def first_clients(case_files: DataFrame, n: int | None) -> DataFrame:
    """O2: keep the first ``n`` client folders per root by name (0/None = all).

    Top-n per root is a window ``row_number() <= n`` that Spark plans as a
    partial group limit before the shuffle; the cut is applied by a
    left-semi join on the (small) set of kept client names.
    """
    if not n:
        return case_files
    clients = case_files.select("root", "client_folder").where(
        F.col("client_folder").isNotNull()).distinct()
    w = Window.partitionBy("root").orderBy("client_folder")
    keep = clients.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= n).drop("_rn")
    return case_files.join(keep, ["root", "client_folder"], "left_semi")


def first_listed_clients(listing: DataFrame, n: int | None) -> DataFrame:
    """O2 on a listing: the entries of the first ``n`` client folders per root by
    name, with what lies in the root itself (0/None = all). Applied before any
    tree is built, so later joins only see the kept clients."""
    if not n:
        return listing
    top = F.get(F.split("path", "/"), 0)
    names = listing.where(F.col("is_folder") & (F.size(F.split("path", "/")) == 1)) \
        .select("root", F.col("path").alias("_client")).distinct()
    w = Window.partitionBy("root").orderBy("_client")
    keep = names.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= n).drop("_rn")
    inside = listing.withColumn("_client", top).join(keep, ["root", "_client"], "left_semi").drop("_client")
    return inside.unionByName(listing.where(~F.col("is_folder") & (F.size(F.split("path", "/")) == 1)))
