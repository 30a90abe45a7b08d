"""The analysis from volumes to candidates, and operators at the edges of what they take."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tubula.operators import blocks, bricks, components, detect, grid, kernels, studies, tables
from tubula.plans import analysis, registry
from tubula.plans import views as V


def balls(spark, sf):
    return {r.study: r.ball for r in V.tubes(spark, sf).select("study", "ball").distinct().collect()}


@pytest.mark.parametrize("name", ["p1_phantom_candidates", "p3_phantom_analysis", "p4_analysis_of_studies"])
def test_volumes_of_a_table_have_their_balls_as_candidates(spark, sf, name):
    """One candidate per study, at the ball; a CT study loses what is as wide as the ball."""
    got = [r for r in registry.queries()[name](spark, sf).collect() if 5 < r.z < 44]
    want = {k: v for k, v in balls(spark, sf).items() if name != "p4_analysis_of_studies" or k % 5 != 4}
    at = {r.study: r.z for r in got if r.study in want}
    assert len(got) == len({r.study for r in got}) and set(at) == set(want) and all(abs(at[k] - z) <= 3 for k, z in want.items())


def test_from_a_noisy_volume_to_its_one_candidate(spark):
    vox = V.phantom(spark, True, 12, 30).select(*grid.AT, F.expr("20 + v * 0.7 + (x * 7 + y * 5 + z * 3) % 11").cast("double").alias("v"))
    (got,) = analysis.analyse(vox, analysis.Params(share=0.05, least_voxels=50)).collect()
    assert (got.y, got.x) == (12, 12) and 14 <= got.z <= 18 and got.max_br > 1.5 and got.max_si > 0.9


def test_studies_of_two_spacings(spark):
    """The ball is found in the one study, nothing in the plain tube of the other."""
    noise = "CAST(20 + v * 0.7 + (x * 7 + y * 5 + z * 3) % 11 AS DOUBLE) AS v"
    vox = V.phantom(spark, True, 12, 30).selectExpr("study", "z", "y", "x", noise).unionByName(V.phantom(spark, False).selectExpr("2 AS study", "z", "y", "x", noise))
    kinds = "study int, sx double, sy double, sz double, tilt double, modality string, plane string"
    (got,) = analysis.analyse_studies(vox, spark.createDataFrame([(1, 1.0, 1.0, 1.0, 0.0, "MR", "AXIAL"), (2, 0.5, 0.5, 0.5, 0.0, None, "AXIAL")], kinds), analysis.Params(share=0.05, least_voxels=50)).collect()
    assert got.study == 1 and 14 <= got.z <= 18


def test_brick_kernels_are_those_of_rows(spark):
    """Chained on bricks of two studies of different spacing and modality: the values of the row-wise operators, study by study."""
    rng = np.random.default_rng(12)
    rows = [(s, int(z), int(y), int(x), float(rng.integers(0, 256))) for s in (1, 2) for z, y, x in np.ndindex(12, 17, 14)]
    vox = spark.createDataFrame(rows, "study int, z int, y int, x int, v double")
    said = spark.createDataFrame([(1, 1.0, 1.0, 1.0, "CT"), (2, 0.5, 0.7, 1.4, None)], "study int, sx double, sy double, sz double, modality string")
    spacing = {1: (1.0, 1.0, 1.0), 2: (0.5, 0.7, 1.4)}
    table = blocks.from_voxels(vox, said)
    hats = {(r.study, r.z, r.y, r.x): r.v for r in blocks.to_voxels(kernels.top_hat(table, 2), "v").collect()}
    plain = {(r.study, r.z, r.y, r.x): r.v for r in grid.top_hat(vox.where("study = 1"), 2).collect()}
    assert all(hats[k] == (plain[k] if k[0] == 1 else v) for *k, v in rows for k in [tuple(k)])
    tubes_ = blocks.to_voxels(kernels.vesselness(table, (1.0, 1.5)), "v").collect()
    shut = {(r.study, r.z, r.y, r.x): r.v for r in blocks.to_voxels(kernels.closed(table, 1.0), "v").collect()}
    bent = {(r.study, r.z, r.y, r.x): (r.k, r.si) for r in blocks.to_voxels(kernels.curvature(table, 1.0), "v", "k", "si").collect()}
    far = {(r.study, r.z, r.y, r.x): r.mm for r in blocks.to_voxels(kernels.distance(blocks.from_voxels(vox.withColumn("v", F.when(F.col("v") > 20, 1).otherwise(0)), said)), "mm").collect()}
    for study, s in spacing.items():
        own = vox.where(F.col("study") == study)
        want = {(r.study, r.z, r.y, r.x): r.v for r in grid.vesselness(own, (1.0, 1.5), spacing=s).collect()}
        assert all(abs(r.v - want[r.study, r.z, r.y, r.x]) < 1e-6 for r in tubes_ if r.study == study)
        assert all(shut[r.study, r.z, r.y, r.x] == r.v for r in grid.closed(own, 1.0, s).collect())
        assert all(np.allclose(bent[r.study, r.z, r.y, r.x], (r.k, r.si)) for r in grid.curvature(grid.blurred(own, 1.0), s).collect())
        assert all(abs(far[r.study, r.z, r.y, r.x] - r.mm) < 1e-9 for r in grid.distance(own.withColumn("v", F.when(F.col("v") > 20, 1).otherwise(0)), s).collect())


def test_jobs_do_not_depend_on_how_many_kinds_there_are(spark):
    sc = spark.sparkContext
    vox = spark.range(6 * 20 * 12 * 12).selectExpr("CAST(id / 2880 AS INT) AS study", "CAST(id / 144 % 20 AS INT) AS z", "CAST(id / 12 % 12 AS INT) AS y", "CAST(id % 12 AS INT) AS x", "CAST(id % 97 AS DOUBLE) AS v")

    def jobs(said):
        sc.setJobGroup(str(said), "")
        rows = spark.createDataFrame([(i, *said(i)) for i in range(6)], "study int, sx double, sy double, sz double, modality string")
        analysis.enhanced(vox, meta=rows)
        return len(sc.statusTracker().getJobIdsForGroup(str(said)))

    try:
        assert jobs(lambda i: (1.0, 1.0, 1.0, "MR")) == jobs(lambda i: (1.0 + i / 10, 1.0, 0.5 + i / 7, "CT" if i % 2 else "MR"))
    finally:
        sc.setJobGroup(None, None)


@pytest.mark.parametrize("side", [5, 48])
def test_parts_on_bricks(spark, monkeypatch, side):
    """Holes filled and small parts left out as by rows, whatever the size of a brick."""
    rng = np.random.default_rng(13)
    rows = [(s, int(z), int(y), int(x), 255 if rng.random() < 0.62 - s / 5 else 0) for s in (1, 2) for z, y, x in np.ndindex(11, 9, 13)]
    vox = spark.createDataFrame(rows, "study int, z int, y int, x int, v int")
    monkeypatch.setattr(kernels, "SIDE", side)
    table = blocks.from_voxels(vox, side=side)
    full = {(r.study, r.z, r.y, r.x): int(r.v) for r in blocks.to_voxels(kernels.filled(table), "v").collect()}
    assert full == {(r.study, r.z, r.y, r.x): r.v for r in components.filled(vox).collect()} and full != {tuple(r[:4]): r[4] for r in rows}
    large = {(r.study, r.z, r.y, r.x) for r in blocks.to_voxels(kernels.without_small(table, 6), "v", where="v = 255").collect()}
    assert large == {(r.study, r.z, r.y, r.x) for r in components.without_small(vox.where("v = 255").select(*grid.AT), 6).collect()}


def test_the_thinned_path_finds_a_ball_around_it_and_none_without(spark):
    def found(*args):
        vox = V.phantom(spark, *args)
        mask = vox.where("v > 0").select(*grid.AT)
        return [r for r in analysis.again(analysis.paths(mask), mask, vox, analysis.Params()).collect() if 6 < r.z < 26]

    (got,) = found(True, 12, 30)
    assert got.z == 16 and got.n_points == 5
    assert found(False) == []


def test_other_thresholds_find_the_ball_at_the_side(spark):
    vox = V.phantom(spark)
    mask = vox.where("v > 0").select(*grid.AT)
    (got,) = analysis.again(analysis.paths(mask), mask, vox, analysis.Params(prune_mm=3.5, bulge=0.9, shape=0.57)).collect()
    assert 14 <= got.z <= 18 and got.x >= 13


def test_nearest_loses_no_voxel(spark):
    """Far voxels, studies without points, and ties, against brute force."""
    rng = np.random.default_rng(8)
    near = [(1, i, *map(int, rng.integers(-40, 40, 3))) for i in range(150)]
    far = [(1, 1000, 20_000, 0, 0), (1, 1001, -3_000_000, 5, 7), (1, 1002, 0, 900, 900), (2, 1003, 4, 4, 4), (1, 1004, None, 4, 4)]
    points = [(1, int(b), int(i), *map(int, rng.integers(0, 30, 3))) for b in range(4) for i in range(25)] + [(3, 9, 1, 4, 4, 4)]
    surface = spark.createDataFrame(near + far, "study int, id int, x int, y int, z int")
    lines = spark.createDataFrame(points, "study int, branch_id int, idx int, x int, y int, z int")
    got = {r.id: (r.branch_id, r.idx, r.d2) for r in detect.nearest(surface, lines).collect()}
    assert len(got) == len(near) + len(far)
    for study, i, *at in near + far:
        own = [(float(sum((a - b) ** 2 for a, b in zip(at, p[3:], strict=True))), p[1], p[2]) for p in points if p[0] == study and None not in at]
        want = (min(own)[1], min(own)[2], min(own)[0]) if own else (None, None, None)
        assert got[i] == want
    none = detect.nearest(surface.drop("study"), lines.drop("study").where("false")).collect()
    assert len(none) == len(near) + len(far) and {r.d2 for r in none} == {None}
    assert detect.nearest(surface.where("false"), lines).collect() == []


@pytest.mark.parametrize("size", [5, 11, 48])
def test_bricks_do_not_show(spark, size):
    """The same values whatever the size of a brick, against numpy on the whole volume."""
    rng = np.random.default_rng(9)
    cube = rng.integers(0, 256, (14, 9, 13)).astype(float)
    rows = [(1, int(z), int(y), int(x), float(cube[z, y, x])) for z, y, x in np.ndindex(cube.shape)]
    vox = spark.createDataFrame(rows, "study int, z int, y int, x int, v double")
    o = grid.ellipsoid(2, 1.5, 1)
    kernel = grid.gaussian(1.0)

    def work(v):
        return bricks.extreme(bricks.extreme(v, o, True), o, False), bricks.blurred(v, kernel), *bricks.eigenvalues(bricks.derivatives(v, 2.0, {"x": 0.5, "y": 1.0, "z": 2.0}))

    kinds = dict.fromkeys(("a", "b", "c", "d", "e"), "double")
    want = work(cube)
    for r in bricks.each(vox, 4, kinds, work, size).collect():
        assert all(abs(r[k] - w[r.z, r.y, r.x]) < 1e-9 for k, w in zip(kinds, want, strict=True))


@pytest.mark.parametrize("offsets", [grid.ALL_26, grid.FACES])
def test_components_cross_bricks(spark, offsets):
    """Against a plain flood, whatever the size of a brick."""
    rng = np.random.default_rng(10)
    full = {(int(z), int(y), int(x)) for z, y, x in np.argwhere(rng.random((9, 11, 10)) < (0.12 if len(offsets) > 6 else 0.35))}
    mask = spark.createDataFrame([(1, *v) for v in sorted(full)] + [(2, 0, 0, 0)], "study int, z int, y int, x int")
    want = {}
    for v in sorted(full):
        if v not in want:
            part, todo = {v}, [v]
            while todo:
                at = todo.pop()
                for o in offsets:
                    n = tuple(a + b for a, b in zip(at, o, strict=True))
                    if n in full and n not in part:
                        part.add(n)
                        todo.append(n)
            want |= dict.fromkeys(part, (v, len(part)))
    for size in (4, 48):
        rows = components.voxel_components(mask, offsets, size).collect()
        assert {(r.z, r.y, r.x): ((r.component.z, r.component.y, r.component.x), r.size) for r in rows if r.study == 1} == want and len(rows) == len(full) + 1


def test_distances_cross_bricks(spark):
    vox = spark.range(12 * 6 * 40).selectExpr("1 AS study", "CAST(id / 240 AS INT) AS z", "CAST(id / 40 % 6 AS INT) AS y", "CAST(id % 40 AS INT) AS x").withColumn("v", F.when((F.col("x") == 0) & (F.col("y") == 0) & (F.col("z") == 0), 0).otherwise(1))
    for size in (7, 48):
        for r in grid.distance(vox, (0.5, 0.5, 1.2), size).collect():
            a, b, c = (0.5, 0.5, 1.2)
            left, mm = [r.x, r.y, r.z], 0.0
            while any(left):
                step = [int(n > 0) for n in left]
                mm += sum((s * d) ** 2 for s, d in zip(step, (a, b, c), strict=True)) ** 0.5
                left = [n - s for n, s in zip(left, step, strict=True)]
            assert abs(r.mm - mm) < 1e-6
    assert {r.mm for r in grid.distance(vox.where("x > 0")).collect()} == {None}


def test_joins_by_study_without_broadcast(spark, monkeypatch):
    rows = spark.range(20).selectExpr("id % 4 AS study", "id AS v")
    table = spark.range(3).selectExpr("id AS study", "id * 10 AS t")
    got = sorted(map(tuple, tables.with_study(rows, table).collect()))
    monkeypatch.setattr(tables, "BROADCAST_ROWS", 1)
    assert sorted(map(tuple, tables.with_study(rows, table).collect())) == got and len(got) == 15


def test_untilting_leaves_others_and_shears(spark):
    vox = spark.createDataFrame([(s, z, y, 0, 100.0 if y == 2 else 0.0) for s in (1, 2) for z in range(4) for y in range(6)], "study int, z int, y int, x int, v double")
    meta = spark.createDataFrame([(1, 1.0, 1.0, 45.0, "CT", "AXIAL"), (2, 1.0, 1.0, 45.0, "MR", "AXIAL")], "study int, sy double, sz double, tilt double, modality string, plane string")
    out = {(r.study, r.z, r.y): round(r.v, 6) for r in studies.untilted(vox, meta).collect()}
    assert {k[2]: v for k, v in out.items() if k[:2] == (1, 3) and v} == {5: 100.0} and len(out) == 48
    assert {k[1:]: v for k, v in out.items() if k[0] == 2} == {(r.z, r.y): r.v for r in vox.where("study = 2").collect()}
    assert studies.upright(meta).where("study = 1").first().tilt == 0.0
