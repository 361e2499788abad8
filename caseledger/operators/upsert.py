"""Keep a target table current through a keyed upsert.

Semantics (per incoming batch I against existing table E, key trimmed):

* key in both: the *last* E row of that key is replaced by the *last* I row
  of that key; it keeps E's ``date_added``. Earlier E rows of the key stay
  untouched, earlier I rows of the key are superseded.
* key only in E: untouched.   * key only in I: every such I row is appended.
* blank key in I: always appended; blank keys in E never match.
* columns only in I (new rules) are added; old rows get null (W2).

"Last" is the greatest value of ``order_by`` (Spark tables have no row
order, so the caller names it). Both sides are reduced to one position per key
(partial aggregation, so a hot key never lands whole in one task) before the
joins, which are then unique on one side; blank keys go round them.
Write the result to a new path or table version; never read and overwrite
the same path.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

UPDATED, UNTOUCHED, APPENDED = "updated", "untouched", "appended"


def _q(c: str) -> Column:
    return F.col(f"`{c}`")


def trimmed(key: Column) -> Column:
    """``key`` without white space of any kind at either end."""
    return F.regexp_replace(key, r"(?U)^\s+|\s+$", "")


def evolve_schema(target: DataFrame, incoming: DataFrame) -> DataFrame:
    """Add the columns of ``incoming`` that ``target`` lacks (null)."""
    missing = [f for f in incoming.schema.fields if f.name not in target.columns]
    return target.select("*", *[F.lit(None).cast(f.dataType).alias(f.name) for f in missing])


def upsert_cases(existing: DataFrame, incoming: DataFrame, key: str = "case_no",
                 order_by=("row_order",), date_col: str = "date_added",
                 keep_position: bool = True, materialize_incoming: bool = True) -> DataFrame:
    """Merged table with an ``upsert_status`` column
    (updated / untouched / appended).

    ``order_by`` must be unique per key inside each table. With
    ``keep_position`` the order columns are a row position: a replaced row
    keeps E's position. Without it they are data columns and come from I.
    One small table of the keys that both sides hold says all that the rest needs:
    each side's last position, and what a replaced row hands on. It is stored, and
    each side is joined with it once. The incoming batch is read twice, so by default
    it is stored first.
    """
    from ..session import materialize
    if materialize_incoming:
        incoming = materialize(incoming)
    k = F.coalesce(trimmed(_q(key)), F.lit(""))
    order = F.struct(*[_q(c) for c in order_by])
    e, i = existing.withColumn("_k", k), incoming.withColumn("_k", k)
    i_cols = list(incoming.columns)
    # E-only columns, E's position and E's date of the replaced row are kept
    pos_cols = list(order_by) if keep_position else []
    hand_on = [c for c in existing.columns if c not in i_cols or c in pos_cols or c == date_col]
    kept = F.struct(F.lit(True).alias("_"), *[_q(c).alias(c) for c in hand_on])
    # blank keys match nothing
    e_last = e.where(F.col("_k") != "").select("_k", order.alias("_ord"), kept.alias("_kept")) \
        .groupBy("_k").agg(F.max(F.struct("_ord", "_kept")).alias("_e")) \
        .select("_k", F.col("_e._ord").alias("_e_ord"), F.col("_e._kept").alias("_e_kept"))
    i_last = i.where(F.col("_k") != "").select("_k", order.alias("_ord")).groupBy("_k").agg(F.max("_ord").alias("_i_ord"))
    both = materialize(e_last.join(i_last, "_k"))
    # blank keys pass by the joins, so no task gets them all; the order is put together
    # behind the joins, so it doesn't travel beside the columns it is made of
    untouched = e.where(F.col("_k") != "").join(both.select("_k", "_e_ord"), "_k", "left") \
        .where(F.col("_e_ord").isNull() | (order != F.col("_e_ord"))).drop("_e_ord") \
        .unionByName(e.where(F.col("_k") == "")).drop("_k").withColumn("upsert_status", F.lit(UNTOUCHED))
    tagged = i.where(F.col("_k") != "").join(both.select("_k", "_e_kept", "_i_ord"), "_k", "left") \
        .where(F.col("_i_ord").isNull() | (order == F.col("_i_ord")))
    met = F.col("_i_ord").isNotNull()

    def value(c):
        old = F.col("_e_kept").getField(c)
        if c not in i_cols:
            return old  # null for appended rows
        if c in pos_cols:
            return F.when(met, old).otherwise(_q(c))
        return F.when(met, F.coalesce(old, _q(c))).otherwise(_q(c)) if c in hand_on else _q(c)

    names = i_cols + [c for c in hand_on if c not in i_cols]
    new = tagged.select(*[value(c).alias(c) for c in names],
                        F.when(met, F.lit(UPDATED)).otherwise(F.lit(APPENDED)).alias("upsert_status"))
    blank = i.where(F.col("_k") == "").select(*[_q(c) for c in i_cols]).withColumn("upsert_status", F.lit(APPENDED))
    return untouched.unionByName(new, allowMissingColumns=True).unionByName(blank, allowMissingColumns=True)


def upsert_counts(existing: DataFrame, incoming: DataFrame, key: str = "case_no") -> DataFrame:
    """Updated / appended counts as the tool logs them: every incoming row
    with a non-blank key found in E counts as an update, the rest append."""
    e_keys = existing.select(trimmed(_q(key)).alias("_k")).where(F.col("_k") != "").distinct()
    i = incoming.select(trimmed(_q(key)).alias("_k"))
    tagged = i.join(e_keys.withColumn("_hit", F.lit(True)), "_k", "left")
    return tagged.agg(F.count_if(F.col("_hit").isNotNull()).alias("updated"),
                      F.count_if(F.col("_hit").isNull()).alias("appended"))
