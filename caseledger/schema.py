"""Schemas and column names shared by all operators."""

from __future__ import annotations

from pyspark.sql import types as T

# MIME type that marks a folder in a remote listing.
FOLDER_MIME = "application/vnd.google-apps.folder"

LISTING = T.StructType([
    T.StructField("root", T.StringType(), False),
    T.StructField("id", T.StringType(), False),
    T.StructField("name", T.StringType(), False),
    T.StructField("parent_id", T.StringType(), True),
    T.StructField("path", T.StringType(), True),
    T.StructField("is_folder", T.BooleanType(), False),
    T.StructField("mime_type", T.StringType(), False),
    T.StructField("size", T.LongType(), True),
    T.StructField("created_time", T.StringType(), False),
    T.StructField("modified_time", T.StringType(), False),
    T.StructField("trashed", T.BooleanType(), False),
    T.StructField("source", T.StringType(), False),
])

# A listing as a remote API returns it: size as text, any field may be absent.
RAW_LISTING = T.StructType([
    T.StructField("root", T.StringType(), True),
    T.StructField("id", T.StringType(), True),
    T.StructField("name", T.StringType(), True),
    T.StructField("parent_id", T.StringType(), True),
    T.StructField("path", T.StringType(), True),
    T.StructField("mimeType", T.StringType(), True),
    T.StructField("size", T.StringType(), True),
    T.StructField("createdTime", T.StringType(), True),
    T.StructField("modifiedTime", T.StringType(), True),
    T.StructField("trashed", T.BooleanType(), True),
    T.StructField("source", T.StringType(), True),
])

# Flattened hierarchy: one row per (client folder, case folder, entry).
CASE_FILES = T.StructType([
    T.StructField("root", T.StringType(), False),
    T.StructField("client_folder", T.StringType(), True),
    T.StructField("case_folder", T.StringType(), True),
    T.StructField("file_name", T.StringType(), True),
    T.StructField("file_path", T.StringType(), True),
])

RULES = T.StructType([
    T.StructField("name", T.StringType(), True),
    T.StructField("patterns", T.ArrayType(T.StringType()), True),
    T.StructField("target", T.StringType(), True),
])

# The six columns that identify one case record.
KEY = ["client_number", "client_name", "case_no", "case_name", "tm_no", "class_code"]

# Composite key used to compare two exports and to find duplicates.
COMPARE_KEY = ["client_number", "case_no", "tm_no", "class_code"]

# Internal column -> export header.
EXPORT_HEADERS = {
    "client_number": "CLIENT NUMBER",
    "client_name": "CLIENT NAME",
    "case_no": "CASE #",
    "case_name": "CASE NAME",
    "tm_no": "TM NO",
    "class_code": "CLASS",
    "files": "FILES",
    "ext": "EXT",
    "date_added": "DATE ADDED",
    "updated_on": "UPDATED ON",
}
BASE_EXPORT = ["CLIENT NUMBER", "CLIENT NAME", "CASE #", "CASE NAME", "TM NO", "CLASS",
               "FILES", "EXT"]


def by_position(df):
    """``df`` with columns named by position, and each name's column there: names
    that differ in case only stay apart."""
    from pyspark.sql import functions as F
    at = {c: F.col(f"_{i}") for i, c in enumerate(df.columns)}
    return df.toDF(*[f"_{i}" for i in range(len(df.columns))]), at
