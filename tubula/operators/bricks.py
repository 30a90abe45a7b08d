"""Dense volumes in bricks: each brick of fixed size sees `halo` voxels around it, so that a neighbourhood of any shape costs one
shuffle, and the work on a brick is numpy's."""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

AT = ("study", "z", "y", "x")
#: Voxels along a brick's side.
BRICK = 48


def spread(rows: DataFrame, brick: int, halo: int) -> DataFrame:
    """rows (study, z, y, x, ...) with the number bz, by, bx of a brick: their own one and those within `halo` voxels."""
    for a in "zyx":
        rows = rows.withColumn(f"b{a}", F.explode(F.sequence(F.floor((F.col(a) - halo) / brick), F.floor((F.col(a) + halo) / brick))))
    return rows


def each(vox: DataFrame, halo: int, kinds: Mapping[str, str], work: Callable, brick: int = BRICK) -> DataFrame:
    """vox (study, z, y, x, v) -> (study, z, y, x, *kinds), kinds being names with SQL types.

    work takes a brick's values with their halo as an array by z, y, x, NaN where there is no voxel, and gives an array of the same
    shape for each name. The array ends where the volume does, and else `halo` voxels beyond the brick."""

    def one(pdf):
        import numpy as np

        at = pdf[["z", "y", "x"]].to_numpy()
        low = at.min(axis=0)
        values = np.full(at.max(axis=0) - low + 1, np.nan)
        values[tuple((at - low).T)] = pdf["v"].to_numpy(float)
        corner = pdf[["bz", "by", "bx"]].iloc[0].to_numpy() * brick
        own = ((at >= corner) & (at < corner + brick)).all(axis=1)
        places = tuple((at[own] - low).T)
        out = pdf.loc[own, list(AT)]
        for name, made in zip(kinds, work(values), strict=True):
            out[name] = made[places]
        return out

    rows = spread(vox.select(*AT, F.col("v").cast("double").alias("v")), brick, halo)
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in vox.select(*AT).schema), *(f"{n} {k}" for n, k in kinds.items())])
    return rows.groupBy("study", "bz", "by", "bx").applyInPandas(one, schema)


def extreme(values, offsets, least: bool):
    """Least or greatest value at the offsets (dz, dy, dx) of each place; places without a value are ignored, and stay so."""
    import numpy as np

    nothing = np.inf if least else -np.inf
    reach = max((abs(d) for o in offsets for d in o), default=0)
    full = np.pad(np.where(np.isnan(values), nothing, values), reach, constant_values=nothing)
    out = np.full(values.shape, nothing)
    for o in offsets:
        part = full[tuple(slice(reach + d, reach + d + n) for d, n in zip(o, values.shape, strict=True))]
        (np.minimum if least else np.maximum)(out, part, out=out)
    return np.where(np.isnan(values), np.nan, out)


def blurred(values, kernel):
    """Convolution with the same odd kernel along x, y and z; the border's value continues outside."""
    import numpy as np

    r = len(kernel) // 2
    for axis in (2, 1, 0):
        full = np.pad(values, [(r, r) if a == axis else (0, 0) for a in range(3)], mode="edge")
        n = values.shape[axis]
        parts = [np.take(full, range(k, k + n), axis=axis) * w for k, w in enumerate(kernel)]
        values = sum(parts[1:], parts[0])
    return values


def derivatives(values, scale: float, spacing: Mapping[str, float]):
    """First differences x, y, z and second ones xx, yy, zz, xy, xz, yz in mm, the latter times scale squared; borders are clamped."""
    import numpy as np

    axis = {"z": 0, "y": 1, "x": 2}
    full = np.pad(values, 1, mode="edge")

    def at(**steps: int):
        return full[tuple(slice(1 + steps.get(a, 0), 1 + steps.get(a, 0) + n) for a, n in zip("zyx", values.shape, strict=True))]

    k = scale * scale
    out = {a: (at(**{a: 1}) - at(**{a: -1})) / (2 * spacing[a]) for a in axis}
    out |= {a + a: (at(**{a: 1}) - 2 * values + at(**{a: -1})) / spacing[a] ** 2 * k for a in axis}
    for a, b in ("xy", "xz", "yz"):
        out[a + b] = ((at(**{a: 1, b: 1}) - at(**{a: 1, b: -1})) - (at(**{a: -1, b: 1}) - at(**{a: -1, b: -1}))) / (4 * spacing[a] * spacing[b]) * k
    return out


def eigenvalues(d):
    """The three eigenvalues of symmetric tensors xx .. yz by rising magnitude, in closed form."""
    import numpy as np

    off = d["xy"] ** 2 + d["xz"] ** 2 + d["yz"] ** 2
    q = (d["xx"] + d["yy"] + d["zz"]) / 3
    p = np.sqrt(((d["xx"] - q) ** 2 + (d["yy"] - q) ** 2 + (d["zz"] - q) ** 2 + 2 * off) / 6)
    w = np.where(p > 0, p, 1.0)
    a, b, c = ((d[n] - q) / w for n in ("xx", "yy", "zz"))
    e, f, g = (d[n] / w for n in ("xy", "xz", "yz"))
    phi = np.arccos(np.clip((a * (b * c - g * g) - e * (e * c - g * f) + f * (e * g - b * f)) / 2, -1, 1)) / 3
    big, small = q + 2 * p * np.cos(phi), q + 2 * p * np.cos(phi + 2 * np.pi / 3)
    plain = off == 0
    every = np.stack([np.where(plain, d["xx"], big), np.where(plain, d["yy"], 3 * q - big - small), np.where(plain, d["zz"], small)])
    return np.take_along_axis(every, np.abs(every).argsort(axis=0, kind="stable"), axis=0)
