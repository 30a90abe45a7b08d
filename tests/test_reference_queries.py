import pytest
from conftest import against_sql

from tubula.operators import components, detect, graph, grid
from tubula.plans import registry


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_against_sql(spark, sf, name):
    against_sql(spark, sf, registry.queries()[name], registry.oracle_sql()[name])


def test_blur_keeps_constants_and_curvature_is_flat(spark):
    vox = spark.range(343).selectExpr("0 AS study", "CAST(id / 49 AS INT) AS z", "CAST(id / 7 % 7 AS INT) AS y", "CAST(id % 7 AS INT) AS x", "5.0D AS v")
    assert {round(r.v, 9) for r in grid.blurred(vox, 1.0).collect()} == {5.0}
    assert {(r.k, r.si) for r in grid.curvature(vox).collect()} == {(0.0, 0.5)}


def test_holes(spark):
    vox = spark.range(125).selectExpr("0 AS study", "CAST(id / 25 AS INT) AS z", "CAST(id / 5 % 5 AS INT) AS y", "CAST(id % 5 AS INT) AS x", "CASE WHEN id = 62 THEN 0 ELSE 255 END AS v")
    assert {r.v for r in components.filled(vox).collect()} == {255}
    assert all(0 <= r.v for r in grid.vesselness(vox, (1.0,)).select("v").collect())


def test_resampling_a_line(spark):
    points = spark.range(5).selectExpr("1 AS branch_id", "CAST(id AS INT) AS idx", "CAST(id AS DOUBLE) AS x", "0.0D AS y", "0.0D AS z")
    got = sorted((r.i, round(r.x, 6)) for r in graph.resampled(points, 0.5).collect())
    # The end points stand twice, so the curve starts and ends slower: 0.4375 after half a segment.
    assert [x for _, x in got] == [0, 0.4375, 1, 1.5, 2, 2.5, 3, 3.5625, 4]


def test_review_takes_the_latest_decision(spark):
    found = spark.createDataFrame([(1, 2)], "branch_id long, first int")
    told = spark.createDataFrame([(1, 2, "NORMAL", 1), (1, 2, "SACCULAR", 2)], "branch_id long, first int, type string, at long")
    assert detect.review(found, told).first().type == "SACCULAR"
