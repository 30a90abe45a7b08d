"""Tables of very many voxels are not sent to every task, however small their files are."""

from pyspark.sql import functions as F

from tubula.operators import blocks, tables


def plan(df):
    df.write.format("noop").mode("overwrite").save()
    return df._jdf.queryExecution().executedPlan().toString()


def voxels(spark, n):
    return spark.range(n).selectExpr("CAST(id / 800 AS INT) AS z", "CAST(id % 800 AS INT) AS y")


def test_many_rows_in_small_files_are_joined_by_merging(spark):
    n = tables.BROADCAST_ROWS + 1
    large, small = tables.settled(voxels(spark, n)), tables.settled(voxels(spark, 50))
    other = voxels(spark, 1000).repartition(3)
    for df in (other.join(large, ["z", "y"]), other.join(large.where("y >= 0").select("z", "y").distinct(), ["z", "y"], "left_semi"), large.join(large, ["z", "y"])):
        assert "SortMergeJoin" in plan(df) and "BroadcastHashJoin" not in plan(df)
    assert "BroadcastHashJoin" in plan(voxels(spark, 10 * n).join(small, ["z", "y"]))
    assert large.count() == n and other.join(large, ["z", "y"]).count() == 1000


def test_bricks_are_joined_where_they_lie(spark):
    vox = spark.range(2000).selectExpr("1 AS study", "CAST(id AS INT) AS z", "0 AS y", "0 AS x", "1.0D AS v")
    table = blocks.from_voxels(vox)
    found = plan(blocks.to_voxels(table, "v").join(blocks.to_voxels(table, "v").withColumn("w", F.lit(1)).drop("v"), ["study", "z", "y", "x"]))
    assert "BroadcastHashJoin" not in found


def test_a_task_does_not_read_all_bricks_of_a_bucket_at_once(spark):
    import pyarrow.parquet as pq

    rows = spark.range(400).coalesce(1).selectExpr("1 AS study", "CAST(id AS INT) AS bz", "0 AS by", "0 AS bx", "array(CAST(id * 4 AS INT), 0, 0) AS low", "array(4, 4, 4) AS shape", "array_repeat(255.0D, 64) AS v")
    for table in (blocks.kept(rows), tables.settled(rows, bricks=True)):
        parts = [pq.ParquetFile("/" + p.removeprefix("file:").lstrip("/")).metadata for p in table.inputFiles()]
        groups = [m.row_group(i).num_rows for m in parts for i in range(m.num_row_groups)]
        assert sum(groups) == 400 == table.count() and max(groups) <= tables.BRICK_ROWS
