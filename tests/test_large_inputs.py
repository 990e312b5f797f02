from pyspark.sql import functions as F

from tessella.operators import statistics


def test_residuals_of_few_groups_move_no_rows(spark):
    rows = spark.range(3_000_000).select((F.col("id") % 3).alias("g"), F.col("id").cast("double").alias("y"), (F.col("id") % 97).cast("double").alias("x"))
    plan = statistics.residuals(rows, "y", "x", ["g"])._jdf.queryExecution().sparkPlan().toString()
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan
