"""Features along centrelines (branch_id, idx, x, y, z, radius, br, si, k), candidates and their scores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .tables import finished, settled, with_study

BULGE, SHAPE, GAUSS, POINTS = 1.35, 0.65, 0.0, 3


def baseline(points: DataFrame) -> DataFrame:
    """(branch_id, baseline): the exact median radius of a branch, at least 1e-6."""
    return points.groupBy("branch_id").agg(F.greatest(F.percentile("radius", F.lit(0.5)), F.lit(1e-6)).alias("baseline"))


#: Side of the cells that voxels and points meet in at first, how much larger the next round's are, points of a leaf, and voxels that
#: one task looks up at once.
CELL, WIDER, LEAF, BLOCK = 16, 8, 64, 4096


def nearest(surface: DataFrame, points: DataFrame, cell: int = CELL) -> DataFrame:
    """Of each surface voxel (id, x, y, z) the nearest point of a centreline: branch_id, idx and d2, the squared distance; of
    equally near ones the first by (branch_id, idx). Where both have a study, only points of the voxel's own count. Every voxel has
    a row, with nulls where there is no point at all for it, or where a coordinate is null.

    A cell's voxels and the points of the cells around it are one group, in which a tree of boxes over the points is searched; no
    pairs are written. What is found within a cell's side is the nearest there is; voxels without are looked up again in cells
    WIDER times as large, until none is left. A task holds BLOCK voxels and the points of 27 cells, equal places once."""
    return finished(lambda: _nearest(surface, points, cell))


def _nearest(surface: DataFrame, points: DataFrame, cell: int) -> DataFrame:
    own = [c for c in ("study",) if c in surface.columns and c in points.columns]
    placed = "x IS NOT NULL AND y IS NOT NULL AND z IS NOT NULL"
    # Of points at the same place only the first can be an answer. Numbers follow the order of (branch_id, idx).
    points = points.where(placed).groupBy(*own, "x", "y", "z").agg(F.min(F.struct("branch_id", "idx")).alias("p"))
    points = settled(points.orderBy("p").select(*own, *(F.col(a).cast("double").alias(a) for a in "xyz"), "p.branch_id", "p.idx", F.monotonically_increasing_id().alias("point")))
    rest = settled(surface.select(*own, "id", *(F.col(a).cast("double").alias(a) for a in "xyz")))
    if own:
        known = with_study(rest, points.select(*own).distinct())
    else:
        known = rest.where("false") if points.isEmpty() else rest
    known = known.where(placed)
    nothing = rest.join(known.select("id"), "id", "left_anti")
    found = nothing.select("id", F.lit(None).cast("long").alias("point"), F.lit(None).cast("double").alias("d2"))
    rest, cells = settled(known), [*own, "cx", "cy", "cz"]
    while not rest.isEmpty():
        at = {f"c{a}": F.floor(F.col(a) / cell) for a in "xyz"}
        left = rest.withColumns(at)
        there = settled(left.groupBy(*cells).agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks")))
        left = left.join(there, cells).withColumn("block", F.pmod(F.xxhash64("id"), "blocks").cast("int")).drop("blocks")
        boxes = points.withColumns(at).groupBy(*cells).agg(*(F.collect_list(c).alias(f"{c}s") for c in ("x", "y", "z", "point")))
        boxes = boxes.where(F.size("xs") > 0)
        for a in "xyz":
            boxes = boxes.withColumn("o", F.explode(F.array(*(F.lit(i) for i in (-1, 0, 1))))).withColumn(f"c{a}", F.col(f"c{a}") + F.col("o")).drop("o")
        boxes = boxes.join(there, cells).withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).drop("blocks")
        keys = [*cells, "block"]
        kinds = f"`id` {rest.schema['id'].dataType.simpleString()}, point long, d2 double"
        met = settled(left.groupBy(*keys).cogroup(boxes.groupBy(*keys)).applyInArrow(_looked_up, kinds))
        sure = met.where(F.col("d2") <= float(cell) ** 2)
        found = found.unionByName(sure)
        rest = settled(rest.join(sure.select("id"), "id", "left_anti"))
        cell *= WIDER
    return found.join(points.select("point", "branch_id", "idx"), "point", "left").select("id", "branch_id", "idx", "d2")


def _looked_up(voxels, boxes):
    """id, point and d2 of a cell's voxels, by the points of the cells around it; voxels without any are left out."""
    import numpy as np
    import pyarrow as pa

    at = np.stack([voxels.column(a).to_numpy() for a in "xyz"], axis=1)
    flat = [boxes.column(f"{c}s").combine_chunks().flatten().to_numpy(zero_copy_only=False) for c in ("x", "y", "z", "point")] if len(boxes) else [np.zeros(0)] * 4
    point, d2 = closest(at, np.stack(flat[:3], axis=1).astype(float), flat[3].astype(np.int64)) if len(at) and len(flat[3]) else (np.zeros(0, np.int64), np.zeros(0))
    ids = voxels.column("id").slice(0, len(point))
    return pa.table([ids, pa.array(point), pa.array(d2)], names=["id", "point", "d2"])


def closest(at, points, number):
    """Of each place the number of the nearest point and the squared distance to it; the smaller number of equally near ones.

    Points are halved along their widest side until LEAF are left; a place looks at the leaves' boxes, the nearest first, until none
    that is left can be as near as what it has found."""
    import numpy as np

    parts, leaves = [np.arange(len(points))], []
    while parts:
        own = parts.pop()
        if len(own) <= LEAF:
            leaves.append(own)
            continue
        axis = int(np.ptp(points[own], axis=0).argmax())
        half = len(own) // 2
        order = own[np.argpartition(points[own, axis], half)]
        parts += [order[:half], order[half:]]
    size = max(map(len, leaves))
    slots = np.stack([np.append(own, np.repeat(own[:1], size - len(own))) for own in leaves])  # short leaves repeat a point
    low, high = points[slots].min(axis=1), points[slots].max(axis=1)
    best, which = np.full(len(at), np.inf), np.full(len(at), np.iinfo(np.int64).max)
    step = max(1, (1 << 20) // len(leaves))
    for first in range(0, len(at), step):
        rows = np.arange(first, min(first + step, len(at)))
        gap = np.maximum(np.maximum(low[None] - at[rows, None], at[rows, None] - high[None]), 0)
        least = (gap * gap).sum(axis=2)
        order = np.argsort(least, axis=1)
        for k in range(len(leaves)):
            leaf = order[:, k]
            live = least[np.arange(len(rows)), leaf] <= best[rows]
            rows, least, order, leaf = rows[live], least[live], order[live], leaf[live]
            if not len(rows):
                break
            slot = slots[leaf]
            d = at[rows, None] - points[slot]
            d2 = d[..., 0] * d[..., 0] + d[..., 1] * d[..., 1] + d[..., 2] * d[..., 2]
            near = d2.min(axis=1)
            name = np.where(d2 == near[:, None], number[slot], np.iinfo(np.int64).max).min(axis=1)
            better = (near < best[rows]) | (near == best[rows]) & (name < which[rows])
            best[rows[better]], which[rows[better]] = near[better], name[better]
    return which, best


def bulges(near: DataFrame, points: DataFrame, base: DataFrame) -> DataFrame:
    """points (branch_id, idx, radius, ...) with br: the greatest of its radius and of the distances of the surface nearest to it
    (branch_id, idx, d2), over the branch's baseline."""
    wide = near.join(base, "branch_id").groupBy("branch_id", "idx").agg(F.max(F.sqrt("d2") / F.col("baseline")).alias("wide"))
    own = F.col("radius") / F.col("baseline")
    rows = points.join(base, "branch_id").join(wide, ["branch_id", "idx"], "left")
    return rows.withColumn("br", F.greatest(own, F.coalesce("wide", own))).drop("wide", "baseline")


def best_shape(samples: DataFrame) -> DataFrame:
    """samples (branch_id, idx, z, y, x, si, k) -> the si and k of each point's voxel of greatest si above -1, first by z, y, x."""
    rank = F.struct("si", (-F.col("z")).alias("z"), (-F.col("y")).alias("y"), (-F.col("x")).alias("x"))
    return samples.where("si > -1").groupBy("branch_id", "idx").agg(F.max("si").alias("si"), F.max_by("k", rank).alias("k"))


def candidates(points: DataFrame, bulge: float = BULGE, shape: float = SHAPE, gauss: float = GAUSS, least: int = POINTS) -> DataFrame:
    """Maximal runs of points that pass all three thresholds, of `least` points or more: maxima floored at 0, and the first point
    with the greatest bulge."""
    flag = (F.col("br") >= bulge) & (F.col("si") >= shape) & (F.col("k") > gauss)
    rows = points.withColumn("flag", flag)
    rows = rows.withColumn("run", F.col("idx") - F.row_number().over(W.partitionBy("branch_id", "flag").orderBy("idx"))).where("flag")
    most = lambda c: F.greatest(F.lit(0.0), F.max(c)).alias(f"max_{c}")
    peak = F.max_by("idx", F.struct("br", (-F.col("idx")).alias("i"))).alias("peak")
    out = rows.groupBy("branch_id", "run").agg(F.min("idx").alias("first"), F.count("*").alias("n_points"), most("br"), most("si"), most("k"), peak)
    return out.where(F.col("n_points") >= least).drop("run")


def saliency(si: Column, br: Column) -> Column:
    """0 to 100: a logistic curve over the mean of both features within their ranges; sphericity and compactness count as 0."""
    clamp = lambda c: F.greatest(F.lit(0.0), F.least(F.lit(1.0), c))
    base = (0.35 * clamp((si - 0.65) / 0.35) + 0.35 * clamp((br - 1.35) / 3.65)) / 0.70
    return 100 / (1 + F.exp(-10 * (base - 0.5)))


def scored(found: DataFrame) -> DataFrame:
    return found.withColumn("score", saliency(F.col("max_si"), F.col("max_br")))


def ranked(found: DataFrame) -> DataFrame:
    """By falling score, then branch and first point."""
    return scored(found).orderBy(F.desc("score"), "branch_id", "first")


def with_branches(found: DataFrame, branches: DataFrame) -> DataFrame:
    """Candidates with the columns of the branch (branch_id, ...) that each lies on."""
    return found.join(branches, "branch_id")


def labelled(branches: DataFrame) -> DataFrame:
    """branches with anatomical_label, which nothing tells yet: null."""
    return branches.withColumn("anatomical_label", F.lit(None).cast("string"))


def review(found: DataFrame, decisions: DataFrame) -> DataFrame:
    """found with type: the latest decision (branch_id, first, type, at) on it, UNKNOWN without one."""
    last = decisions.groupBy("branch_id", "first").agg(F.max_by("type", F.struct("at", "type")).alias("type"))
    return found.join(last, ["branch_id", "first"], "left").withColumn("type", F.coalesce("type", F.lit("UNKNOWN")))
