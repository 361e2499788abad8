"""W1, J2 in place: a target partitioned by key blocks, of which an upsert reads and
rewrites only those that the incoming batch touches.

All rows of a key lie in one part, so merging the touched parts alone gives what
merging the whole target gives. A part is a hash of the key without its last ``tail``
characters: neighbouring case numbers share parts, so a batch of recent cases touches
few of them (a batch of keys from everywhere touches many, and is merged as right).
Blank keys match nothing: each upsert puts its own into a part of their own, and old
ones are never read.

The merged rows are stored in the shared folder first. Spark then replaces the touched
parts by a dynamic partition overwrite. After a lost driver the same call again
completes the work: the table becomes the same. Readers must not run meanwhile.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import materialize
from .upsert import trimmed, upsert_cases

PART = "key_part"


def _q(c: str) -> Column:
    return F.col(f"`{c}`")


def key_part(key: Column, parts: int, tail: int, blank: int = -1) -> Column:
    """Number of the part of a key; ``blank`` (negative) for blank keys."""
    k = F.coalesce(trimmed(key), F.lit(""))
    stem = k.substr(F.lit(1), F.greatest(F.length(k) - tail, F.lit(1)))
    return F.when(k == "", F.lit(blank)).otherwise(F.pmod(F.xxhash64(stem), F.lit(parts))).cast("int")


def _write_parts(rows: DataFrame, path: str) -> None:
    # one task a part, or several for a large one: adaptive execution sees their sizes
    (rows.hint("rebalance", F.col(PART)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
     .partitionBy(PART).parquet(f"{path.rstrip('/')}/rows"))


def _note(spark: SparkSession, path: str, version: int, key: str, parts: int, tail: int, schema: T.StructType) -> None:
    """One row a version: how the target is laid out and which columns it has."""
    spark.createDataFrame([(version, key, parts, tail, schema.json())],
                          "version long, key string, parts int, tail int, columns string") \
        .coalesce(1).write.mode("append").parquet(f"{path.rstrip('/')}/layout")


def _layout(spark: SparkSession, path: str):
    return spark.read.parquet(f"{path.rstrip('/')}/layout").orderBy(F.desc("version")).first()


def _rows(spark: SparkSession, path: str, layout) -> DataFrame:
    """The target's rows; files older than a column read null there."""
    schema = T.StructType.fromJson(json.loads(layout["columns"]))
    return spark.read.schema(schema.add(PART, T.IntegerType())).parquet(f"{path.rstrip('/')}/rows")


def create_target(df: DataFrame, path: str, key: str = "case_no", parts: int = 1024, tail: int = 2) -> None:
    """Write ``df`` as a new target at ``path``. Columns named key_part are not allowed."""
    if PART in df.columns:
        raise ValueError(f"{PART} is the target's own column")
    spark = df.sparkSession
    rows = df.withColumn(PART, key_part(_q(key), parts, tail))
    rows.hint("rebalance", F.col(PART)).write.mode("errorifexists").partitionBy(PART).parquet(f"{path.rstrip('/')}/rows")
    _note(spark, path, 0, key, parts, tail, df.schema)


def read_target(spark: SparkSession, path: str) -> DataFrame:
    return _rows(spark, path, _layout(spark, path)).drop(PART)


def upsert_target(incoming: DataFrame, path: str, order_by=("row_order",), date_col: str = "date_added",
                  keep_position: bool = True) -> DataFrame:
    """Upsert ``incoming`` into the target at ``path`` (semantics of ``upsert_cases``).
    Returns the rows of the rewritten parts with their ``upsert_status``; parts that
    are not named there were neither read nor written."""
    spark = incoming.sparkSession
    at = _layout(spark, path)
    key, version = at["key"], at["version"] + 1
    incoming = materialize(incoming.withColumn(PART, key_part(_q(key), at["parts"], at["tail"])))
    # at most ``parts`` numbers; as literals they prune the scan's folders
    touched = [r[0] for r in incoming.where(F.col(PART) >= 0).select(PART).distinct().collect()]
    old = _rows(spark, path, at).where(F.col(PART).isin(touched)).drop(PART)
    merged = upsert_cases(old, incoming.drop(PART), key=key, order_by=order_by, date_col=date_col,
                          keep_position=keep_position, materialize_incoming=False)
    staged = materialize(merged.withColumn(PART, key_part(_q(key), at["parts"], at["tail"], -1 - version)))
    _write_parts(staged.drop("upsert_status"), path)
    schema = T.StructType([f for f in staged.schema.fields if f.name not in (PART, "upsert_status")])
    _note(spark, path, version, key, at["parts"], at["tail"], schema)
    return staged
