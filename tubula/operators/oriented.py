"""Volumes put upright by the directions of their rows and columns: turned, flipped or oblique stacks on the patient's axes."""

from __future__ import annotations

import itertools
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bricks import AT, spread

BRICK = 32
#: Places nearer to a voxel than this (in voxels) are that voxel, so that turning and flipping change no value.
SNAP = 1e-6
GEOMETRY = "w int, h int, d int, sx double, sy double, sz double, w0 int, h0 int, d0 int, a array<double>, t array<double>"


def _grid(size, gaps, turn):
    """The upright grid of a stack: voxels and gaps by x, y, z, and the map from its places to those of the stack."""
    import numpy as np

    row, col = (np.asarray(turn[k : k + 3], float) for k in (0, 3))
    row /= np.linalg.norm(row)
    col = col - row * (row @ col)
    col /= np.linalg.norm(col)
    normal = np.cross(row, col)
    # Slices follow each other towards the greater place on the axis that their normal is nearest to.
    normal *= 1 if normal[np.abs(normal).argmax()] >= 0 else -1
    units = np.stack([row, col, normal], axis=1)
    fit = max(itertools.permutations(range(3)), key=lambda p: sum(abs(units[k, i]) for i, k in enumerate(p)))
    step = np.empty(3)
    step[list(fit)] = gaps
    to_mm = units * np.asarray(gaps)
    corners = to_mm @ np.array(list(itertools.product(*((0, n - 1) for n in size)))).T
    low, high = corners.min(axis=1), corners.max(axis=1)
    count = np.floor((high - low) / step + SNAP).astype(int) + 1
    back = np.linalg.inv(to_mm)
    return count, step, back * step, back @ low


def geometry(studies: DataFrame) -> DataFrame:
    """studies (study, w, h, d, sx, sy, sz, turn) -> the grid of each one when upright: w, h, d, sx, sy, sz, the sizes w0, h0, d0 before,
    and the affine map from a new place (x, y, z) to an old one, as nine factors a by rows and three shifts t.

    turn holds the directions (x, y, z) in which a slice's columns and rows follow each other: six numbers, as image files give
    them. A null turn leaves the stack as it is; a gap that is null or not above 0 counts as 1. Directions that span no plane are
    refused."""
    kind = studies.schema["study"].dataType.simpleString()

    def of(batches: Iterator) -> Iterator:
        import numpy as np
        import pandas as pd

        for pdf in batches:
            rows = []
            for r in pdf.itertuples(index=False):
                size = [int(r.w), int(r.h), int(r.d)]
                gaps = [g if g is not None and g > 0 else 1.0 for g in (r.sx, r.sy, r.sz)]
                turn = [1, 0, 0, 0, 1, 0] if r.turn is None else [float(v) for v in r.turn]
                if len(turn) != 6 or not np.linalg.norm(np.cross(turn[:3], turn[3:])) > SNAP:
                    raise ValueError(f"directions {turn} span no plane")
                count, step, a, t = _grid(size, gaps, turn)
                rows.append((r.study, *map(int, count), *map(float, step), *size, a.reshape(-1).tolist(), t.tolist()))
            yield pd.DataFrame(rows, columns=["study", *(c.split()[0] for c in GEOMETRY.split(", "))])

    return studies.select("study", "w", "h", "d", "sx", "sy", "sz", "turn").mapInPandas(of, f"study {kind}, {GEOMETRY}")


def _resampled(brick: int):
    def one(key, voxels, of):
        import numpy as np
        import pandas as pd

        out = []
        if len(of):
            g = of.iloc[0]
            a, t = np.stack(g["a"]).reshape(3, 3), np.asarray(g["t"], float)
            size, new = (np.array([g[n + e] for n in "whd"]) for e in ("0", ""))
            low = np.array(key[3:0:-1]) * brick  # by x, y, z
            values = np.zeros((brick + 2,) * 3)
            at = voxels[["x", "y", "z"]].to_numpy() - low
            inside = ((at >= 0) & (at < brick + 2)).all(axis=1)
            values[tuple(at[inside].T)] = np.nan_to_num(voxels["v"].to_numpy(float)[inside])
            high = np.minimum(low + brick, size - 1)
            corners = np.linalg.solve(a, np.array(list(itertools.product(*zip(low, high, strict=True)))).T - t[:, None])
            first = np.maximum(np.floor(corners.min(axis=1) - SNAP), 0).astype(int)
            last = np.minimum(np.ceil(corners.max(axis=1) + SNAP), new - 1).astype(int)
            for z in range(first[2], last[2] + 1):
                x, y = (m.reshape(-1) for m in np.meshgrid(np.arange(first[0], last[0] + 1), np.arange(first[1], last[1] + 1)))
                old = a @ np.stack([x, y, np.full(len(x), z)]).astype(float) + t[:, None]
                whole = np.round(old)
                old = np.where(np.abs(old - whole) < SNAP, whole, old)
                own = ((old >= low[:, None]) & (old < low[:, None] + brick) & (old <= (size - 1)[:, None])).all(axis=0)
                if not own.any():
                    continue
                here = old[:, own] - low[:, None]
                base = np.floor(here).astype(int)
                part, v = here - base, 0.0
                for step in itertools.product((0, 1), repeat=3):
                    s = np.array(step)[:, None]
                    v = v + values[tuple(base + s)] * np.where(s == 1, part, 1 - part).prod(axis=0)
                out.append(pd.DataFrame({"study": key[0], "z": z, "y": y[own], "x": x[own], "v": v}))
        return pd.concat(out) if out else pd.DataFrame(columns=[*AT, "v"])

    return one


def oriented(vox: DataFrame, studies: DataFrame, brick: int = BRICK) -> DataFrame:
    """vox (study, z, y, x, v) on the grids of geometry(studies): a place's value is interpolated between the eight voxels of the old
    stack around it. Stacks whose directions follow the axes are only turned and flipped, all values as they were.

    Places that no part of the old stack covers have no row; missing voxels and null values count as 0; studies without metadata go.
    A brick of the old stack sees one voxel more and makes the new places inside it, so there is one shuffle, no row per corner, and a
    task's memory does not grow with the volume."""
    grids = geometry(studies)
    bricks_ = grids
    for a, n in zip("zyx", ("d0", "h0", "w0"), strict=True):
        bricks_ = bricks_.withColumn(f"b{a}", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col(n) - 1) / brick))))
    key = ["study", "bz", "by", "bx"]
    places = [F.col(c).cast("int").alias(c) for c in AT[1:]]
    rows = spread(vox.select("study", *places, F.col("v").cast("double").alias("v")), brick, 1)
    kind = vox.schema["study"].dataType.simpleString()
    both = rows.groupBy(*key).cogroup(bricks_.groupBy(*key))
    return both.applyInPandas(_resampled(brick), f"study {kind}, z int, y int, x int, v double")


def upright(studies: DataFrame) -> DataFrame:
    """The metadata after oriented(): its sizes and gaps, every plane AXIAL, and a turn along the axes. Other columns stay."""
    new = geometry(studies).select("study", *("w h d sx sy sz".split()))
    rest = [c for c in studies.columns if c not in (*new.columns, "plane", "turn")]
    axes = F.array(*(F.lit(float(v)) for v in (1, 0, 0, 0, 1, 0)))
    return new.join(studies.select("study", *rest), "study").withColumn("plane", F.lit("AXIAL")).withColumn("turn", axes)
