"""D1, J3 by row: which rows of a repeated key differ between two exports, and in what.

1. Rows that both sides hold are cancelled, as often as both hold them (one signed
   count a distinct row, so a key with very many rows is spread over tasks).
2. Keys that one side alone still holds have no pairs: their rows are added or removed
   as they are, and take no part in what follows.
3. What is left is paired key by key: for each compared column in turn, rows that
   agree in all others; then, whatever is left, in the order of their columns. Pairs
   are changed rows and name the columns that differ.
4. Rows without a partner are added or removed.

Partners are found by equal place inside their group. Places come from dense row
positions (ranges of bounded rows), so no task holds a key.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schema import COMPARE_KEY
from ..session import materialize
from .positions import row_positions
from .reports import ADDED, CHANGED, REMOVED


def _q(c: str) -> Column:
    return F.col(f"`{c}`")


def _places(rows: DataFrame, group: list[str], order: list[str]) -> DataFrame:
    """``rows`` with _at, the place of each in its group and side, from 0."""
    own = ["_side", *group]
    # a hash leads, so that equal groups are neighbours whatever their columns are
    at = row_positions(rows.withColumn("_g", F.xxhash64(*map(_q, own))), ["_g", *own, *order], "_pos").drop("_g")
    first = at.groupBy(*map(_q, own)).agg(F.min("_pos").alias("_first"))
    first = first.toDF(*[f"_k{i}" for i in range(len(own))], "_first")
    same = [_q(c).eqNullSafe(F.col(f"_k{i}")) for i, c in enumerate(own)]
    return at.join(first, reduce(Column.__and__, same)) \
        .withColumn("_at", F.col("_pos") - F.col("_first")).select(*map(_q, rows.columns), "_at")


def _pair(rows: DataFrame, key: list[str], cols: list[str], agree: list[str]) -> tuple[DataFrame, DataFrame]:
    """(pairs: key, a, b; rows left over) of rows that agree in ``agree``."""
    group = [*key, *agree]
    placed = _places(rows, group, [c for c in cols if c not in agree])
    grouped = placed.groupBy(*map(_q, group), "_at").agg(
        F.max(F.when(F.col("_side") == 0, F.struct(*map(_q, cols)))).alias("_a"),
        F.max(F.when(F.col("_side") == 1, F.struct(*map(_q, cols)))).alias("_b"))
    grouped = materialize(grouped.select(*map(_q, key), "_a", "_b"))
    pairs = grouped.where(F.col("_a").isNotNull() & F.col("_b").isNotNull())
    alone = grouped.where(F.col("_a").isNull() | F.col("_b").isNull())
    left = alone.select(*map(_q, key), F.coalesce("_a", "_b").alias("_row"), F.when(F.col("_a").isNull(), 1).otherwise(0).alias("_side"))
    return pairs, left.select(*map(_q, key), *[F.col("_row").getField(c).alias(c) for c in cols], "_side")


def diff_rows(a: DataFrame, b: DataFrame, key=COMPARE_KEY, cols: list[str] | None = None,
              exclude=("date_added", "updated_on", "DATE ADDED", "UPDATED ON")) -> DataFrame:
    """``key``, change (Added, Removed, Changed), changed_columns, and the compared
    columns as they were (``old_*``) and are (``new_*``): one row a difference. Keys
    with the same rows on both sides give none. Null is a value of its own."""
    key = list(key)
    if "root" in a.columns and "root" in b.columns and "root" not in key:
        key = ["root", *key]
    cols = cols or [c for c in a.columns if c in b.columns and c not in key and c not in exclude]
    names = [*key, *cols]
    signed = a.select(*map(_q, names), F.lit(1).alias("_n")).unionByName(b.select(*map(_q, names), F.lit(-1).alias("_n")))
    net = signed.groupBy(*map(_q, names)).agg(F.sum("_n").alias("_n")).where("_n <> 0")
    rest = materialize(net.withColumn("_side", F.when(F.col("_n") > 0, 0).otherwise(1))
                       .withColumn("_copy", F.explode(F.sequence(F.lit(1).cast("long"), F.abs("_n")))).drop("_n", "_copy"))
    met = rest.groupBy(*map(_q, key)).agg(F.min("_side").alias("_low"), F.max("_side").alias("_high")).where("_low < _high")
    met = met.select(*[_q(c).alias(f"_k{i}") for i, c in enumerate(key)], F.lit(True).alias("_met"))
    same = [_q(c).eqNullSafe(F.col(f"_k{i}")) for i, c in enumerate(key)]
    rest = materialize(rest.join(met, reduce(Column.__and__, same), "left").select(
        *map(_q, names), "_side", F.coalesce("_met", F.lit(False)).alias("_met")))
    lone, rest = rest.where("not _met").drop("_met"), rest.where("_met").drop("_met")
    found = []
    for c in [*cols, None]:
        pairs, rest = _pair(rest, key, cols, [x for x in cols if x != c] if c else [])
        found.append(pairs)
    differs = [F.when(~F.col("_a").getField(c).eqNullSafe(F.col("_b").getField(c)), F.lit(c)) for c in cols]
    values = [F.col(s).getField(c).alias(f"{n}_{c}") for n, s in (("old", "_a"), ("new", "_b")) for c in cols]
    changed = reduce(DataFrame.unionByName, found).select(
        *map(_q, key), F.lit(CHANGED).alias("change"), F.array_join(F.array_compact(F.array(*differs)), ", ").alias("changed_columns"),
        *values)
    none = F.lit(None)
    alone = rest.unionByName(lone).select(
        *map(_q, key), F.when(F.col("_side") == 1, F.lit(ADDED)).otherwise(F.lit(REMOVED)).alias("change"),
        F.lit("").alias("changed_columns"),
        *[F.when(F.col("_side") == side, _q(c)).otherwise(none).alias(f"{n}_{c}") for side, n in ((0, "old"), (1, "new")) for c in cols])
    return changed.unionByName(alone)
