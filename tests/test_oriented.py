"""Stacks put on the patient's axes by their directions."""

import itertools

import numpy as np
import pytest

from tubula.operators import oriented

META = "study int, w int, h int, d int, sx double, sy double, sz double, turn array<double>, modality string"


def stack(spark, image, gaps, turn):
    d, h, w = image.shape
    rows = [(1, z, y, x, float(image[z, y, x])) for z in range(d) for y in range(h) for x in range(w)]
    return spark.createDataFrame(rows, "study int, z int, y int, x int, v double"), spark.createDataFrame([(1, w, h, d, *gaps, turn, "CT")], META)


def dense(rows, shape):
    out = np.full(shape, np.nan)
    for r in rows:
        out[r.z, r.y, r.x] = r.v
    return out


@pytest.mark.parametrize("turn", [(0, 1, 0, -1, 0, 0), (0, 0, -1, 0, -1, 0), (0, -1, 0, 0, 0, 1)])
def test_turned_and_flipped_stacks_come_back(spark, turn):
    upright = np.random.default_rng(1).normal(size=(5, 7, 6))  # by z, y, x of the patient
    units = np.array([turn[:3], turn[3:], np.abs(np.cross(turn[:3], turn[3:]))])  # a slice's columns and rows, and slices
    axes = [int(np.abs(u).argmax()) for u in units]
    # The stack's values by its own x, y, z.
    own = upright.transpose(2, 1, 0).transpose(axes)
    own = own[tuple(slice(None, None, int(u[a])) for u, a in zip(units, axes, strict=True))]
    gaps = np.array([0.5, 0.6, 1.3])[axes]
    vox, meta = stack(spark, own.transpose(2, 1, 0), [float(g) for g in gaps], [float(t) for t in turn])
    got = dense(oriented.oriented(vox, meta, 4).collect(), upright.shape)
    assert np.array_equal(got, upright)
    r = oriented.upright(meta).first()
    assert (r.w, r.h, r.d, r.sx, r.sy, r.sz, r.plane, r.modality) == (6, 7, 5, 0.5, 0.6, 1.3, "AXIAL", "CT")


def test_oblique_stacks_keep_linear_values_whatever_the_bricks(spark):
    a, b = np.radians(25), np.radians(-15)
    row = np.array([np.cos(a), np.sin(a), 0])
    col = np.array([-np.sin(a) * np.cos(b), np.cos(a) * np.cos(b), np.sin(b)])
    gaps = np.array([0.7, 0.7, 1.1])
    units = np.stack([row, col, np.cross(row, col)])
    slope = np.array([2.0, -3.0, 1.5])
    image = np.array([[[slope @ ((x, y, z) * gaps @ units) for x in range(11)] for y in range(9)] for z in range(7)])
    vox, meta = stack(spark, image, list(map(float, gaps)), [*map(float, row), *map(float, col)])
    corners = np.array([np.array(c) * gaps @ units for c in itertools.product((0, 10), (0, 8), (0, 6))])
    low = corners.min(axis=0)
    new = oriented.upright(meta).first()
    rows = oriented.oriented(vox, meta, 4).collect()
    for r in rows:
        place = low + np.array([r.x, r.y, r.z]) * [new.sx, new.sy, new.sz]
        assert abs(r.v - slope @ place) < 1e-9
    assert len({(r.z, r.y, r.x) for r in rows}) == len(rows) > 400
    # Every new place inside the stack is there.
    size = np.array([new.w, new.h, new.d])
    every = np.array(list(itertools.product(*map(range, size))))
    old = (low + every * [new.sx, new.sy, new.sz]) @ units.T / gaps
    assert len(rows) == ((old > -1e-7) & (old < np.array([10, 8, 6]) + 1e-7)).all(axis=1).sum()
    assert np.allclose(sorted(map(tuple, rows)), sorted(map(tuple, oriented.oriented(vox, meta, 32).collect())))


def test_edges(spark):
    vox, meta = stack(spark, np.ones((1, 1, 2)), [0.0, 1.0, 1.0], None)
    assert sorted(r.v for r in oriented.oriented(vox, meta).collect()) == [1.0, 1.0]
    assert oriented.oriented(vox.limit(0), meta.limit(0)).count() == 0
    # A missing voxel counts as 0; a study without metadata goes.
    assert sorted(r.v for r in oriented.oriented(vox.where("x = 0").union(vox.withColumn("study", vox.study + 1)), meta).collect()) == [0.0, 1.0]
    with pytest.raises(Exception, match="span no plane"):
        oriented.geometry(stack(spark, np.ones((1, 1, 1)), [1.0] * 3, [1.0, 0.0, 0.0, 2.0, 0.0, 0.0])[1]).collect()
