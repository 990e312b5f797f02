from pyspark.sql import functions as F

from tessella.operators import resampling


def test_panels_of_one_file_are_drawn_by_many_tasks(spark, tmp_path):
    spark.range(5000).coalesce(1).write.parquet(f"{tmp_path}/rows")
    rows = spark.read.parquet(f"{tmp_path}/rows")
    assert resampling.replicates(rows, 3).select(F.spark_partition_id().alias("at")).distinct().count() > 1
    panels = resampling.random_panels(rows, [], "id", 7, 3, "s")
    plan = panels._jdf.queryExecution().optimizedPlan().toString() + panels._jdf.queryExecution().sparkPlan().toString()
    # Rows stay where they are until they are known to be in a panel's ranges.
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan
    u = resampling.draw("s", F.col("rep"), F.col("id"))
    drawn = resampling.replicates(rows, 3).withColumn("u", u).collect()
    for rep in (1, 2, 3):
        own = sorted((r["u"], r["id"]) for r in drawn if r["rep"] == rep)
        assert {r["id"] for r in panels.where(F.col("rep") == rep).collect()} == {i for _, i in own[:7]}
