"""Volumes of so many slices that whole numbers of 32 bits do not hold the square of their length."""

from pyspark.sql import functions as F

from tubula.operators import studies
from tubula.plans import views as V


def test_tubes_of_very_many_slices_have_their_ball(spark, tmp_path):
    n, ball = 46_400, 10
    vectors = spark.range(n).selectExpr(f"id * {n - 20} AS vec_id", "array_repeat(CAST(0.5 AS FLOAT), 64) AS embedding", "4 AS label")
    vectors.write.parquet(f"{tmp_path}/embeddings.parquet")
    rows = V.tubes(spark, str(tmp_path), 17, 20).where("y = 12 AND x IN (12, 18, 21, 24)").select("z", "x").where("inside").collect()
    by_x = {x: sorted(r.z for r in rows if r.x == x) for x in (12, 18, 21, 24)}
    assert by_x == {12: list(range(n)), 18: list(range(ball - 4, ball + 5)), 21: list(range(ball - 2, ball + 3)), 24: []}


def test_voxels_of_one_study_are_made_by_several_tasks(spark, tmp_path):
    vectors = spark.range(6000).selectExpr("id AS vec_id", "array_repeat(CAST(0.5 AS FLOAT), 64) AS embedding", "4 AS label")
    vectors.write.parquet(f"{tmp_path}/embeddings.parquet")
    rows = V.tubes(spark, str(tmp_path))
    made = rows.groupBy(F.spark_partition_id().alias("task")).count().collect()
    assert len(made) > 1 and sum(r["count"] for r in made) == 6000 * 800
    assert "Join" not in rows._jdf.queryExecution().optimizedPlan().toString()  # nor all of them from one row


def test_places_of_one_turned_study_are_made_by_several_tasks(spark):
    n = 3000
    vox = spark.range(n * 6).selectExpr("1 AS study", "CAST(id DIV 6 AS INT) AS z", "CAST(id DIV 3 % 2 AS INT) AS y", "CAST(id % 3 AS INT) AS x", "CAST(id AS DOUBLE) AS v")
    meta = spark.createDataFrame([(1, 1.0, 1.0, 1.0, 0.0, "CT", "AXIAL")], "study int, sx double, sy double, sz double, tilt double, modality string, plane string")
    out = studies.untilted(vox, meta)
    assert out._jdf.queryExecution().optimizedPlan().toString().count("Generate explode") > 2
    assert "Repartition" in out._jdf.queryExecution().optimizedPlan().toString()  # between the slices and their voxels
    assert {(r.z, r.y, r.x): r.v for r in out.collect()} == {(i // 6, i // 3 % 2, i % 3): float(i) for i in range(n * 6)}
