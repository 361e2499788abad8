"""Dense row positions, as a sheet numbers its rows, without a window over
all rows.

Rows are dealt to ranges of the order and stored with the number of their range; a
range is numbered by itself, and a range's offset is the count of all rows before
it, from a table of one count a range.
"""

from __future__ import annotations

from itertools import accumulate

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialize


def row_positions(df: DataFrame, order_by: list[str], name: str = "position", start: int = 1) -> DataFrame:
    """``df`` with consecutive numbers from ``start`` in the order of ``order_by``
    (nulls first). Rows equal in these are told apart by a hash of the whole row, so
    a value that very many rows share spans several ranges; the numbers of wholly
    equal rows are interchangeable. Stores the rows once."""
    order: list[Column] = [F.col("`" + c.replace("`", "``") + "`") for c in order_by]
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = df.withColumn("_tie", F.xxhash64(*[F.col("`" + c.replace("`", "``") + "`") for c in df.columns]))
    rows = materialize(rows.repartitionByRange(parts, *order, "_tie").withColumn("_range", F.spark_partition_id()))
    counts = sorted((r["_range"], r["n"]) for r in rows.groupBy("_range").agg(F.count("*").alias("n")).collect())
    before = [0, *accumulate(n for _, n in counts)]
    offsets = df.sparkSession.createDataFrame([(r, b) for (r, _), b in zip(counts, before)], "_range int, _before long")
    inside = F.row_number().over(Window.partitionBy("_range").orderBy(*order, "_tie"))
    # one row a range
    return rows.withColumn("_at", inside).join(F.broadcast(offsets), "_range").select(
        *[F.col("`" + c.replace("`", "``") + "`") for c in df.columns], (F.col("_before") + F.col("_at") - 1 + start).alias(name))
