"""Dense row positions."""

import pytest
from pyspark.sql import functions as F

from caseledger.operators.positions import row_positions


def test_positions_are_those_of_a_sort(spark):
    df = spark.range(3000).select((F.col("id") * 7919 % 3000).alias("v"), F.format_string("x%d", "id").alias("t")).repartition(5)
    got = row_positions(df, ["v"], start=2)
    assert got.columns == ["v", "t", "position"]
    assert [(r["v"], r["position"]) for r in got.orderBy("position").collect()] == [(i, i + 2) for i in range(3000)]


def test_a_value_that_most_rows_share_spans_ranges(spark):
    df = spark.range(2000).select(F.when(F.col("id") % 3 > 0, F.lit("hot")).otherwise(F.concat(F.lit("k"), F.col("id"))).alias("k"),
                                  F.col("id").alias("odd`name"))
    got = row_positions(df, ["k"])
    rows = sorted((r["position"], r["k"]) for r in got.collect())
    assert [p for p, _ in rows] == list(range(1, 2001)) and [k for _, k in rows] == sorted(k for _, k in rows)
    ranged = df.withColumn("_tie", F.xxhash64("k", "`odd``name`")).repartitionByRange(4, "k", "_tie")
    assert ranged.where("k = 'hot'").select(F.spark_partition_id()).distinct().count() > 1
    # again the same
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, row_positions(df, ["k"]).collect()))


@pytest.mark.parametrize("rows", [[], [(None,)], [(None,), (1,), (1,), (1,)]])
def test_few_rows_nulls_and_equal_rows(spark, rows):
    got = row_positions(spark.createDataFrame(rows, "v int"), ["v"])
    assert [r["position"] for r in got.orderBy("position").collect()] == list(range(1, len(rows) + 1))
