"""Snapping: no row meets another, so no task holds more than one."""

from pyspark.sql import functions as F

from nearfield.operators.encode import snap_table


def test_snap_without_exchange(spark):
    codes = spark.createDataFrame([(7, 0, [1.0, 0.0]), (9, 1, [1.0, 0.0]), (4, 2, [0.0, 1.0])], "id long, at long, code array<double>")
    encoded = spark.range(3).select(F.col("id").alias("row_id"), F.when(F.col("id") == 1, F.array(F.lit(0.0), F.lit(2.0))).otherwise(F.array(F.lit(3.0), F.lit(1.0))).alias("code"))
    out = snap_table(encoded, codes)
    assert sorted(map(tuple, out.collect())) == [(0, 7), (1, 4), (2, 7)]
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Exchange hashpartitioning(row_id" not in plan
    assert snap_table(encoded, codes.limit(0)).count() == 0
