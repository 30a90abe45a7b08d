"""Operators on voxel rows (study, z, y, x, v): histograms, thresholds, neighbour joins, morphology, derivatives, distance."""

from __future__ import annotations

import itertools
import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import bricks
from .bricks import AT
from .tables import finished, released, settled, with_study

FACES = ((0, 0, 1), (0, 0, -1), (0, 1, 0), (0, -1, 0), (1, 0, 0), (-1, 0, 0))
ALL_26 = tuple(o for o in itertools.product((-1, 0, 1), repeat=3) if any(o))


def ellipsoid(rx: float, ry: float, rz: float) -> tuple[tuple[int, int, int], ...]:
    """Offsets (dz, dy, dx) within the radii, which may be 0 or fractional."""
    span = lambda r: range(-math.floor(r), math.floor(r) + 1)
    part = lambda d, r: (d / r) ** 2 if r > 0 else 0.0
    return tuple((k, j, i) for k in span(rz) for j in span(ry) for i in span(rx) if part(i, rx) + part(j, ry) + part(k, rz) <= 1 + 1e-12)


def shifted(rows: DataFrame, offsets, *keep: str) -> DataFrame:
    """Each row at each of its places plus an offset (dz, dy, dx); the offset itself comes along."""
    table = F.array(*(F.struct(*(F.lit(v).alias(n) for n, v in zip(("dz", "dy", "dx"), o, strict=True))) for o in offsets))
    rows = rows.select(*AT, *keep, F.explode(table).alias("o"))
    return rows.select("study", *((F.col(a) + F.col(f"o.d{a}")).alias(a) for a in "zyx"), *keep, *(F.col(f"o.d{a}").alias(f"d{a}") for a in "zyx"))


def to_bytes(vox: DataFrame, low: float | None = None, high: float | None = None) -> DataFrame:
    """Values as bytes, `low` and less being 0, `high` and more 255, rounded in between; by default from a study's least value to its
    greatest. Whole numbers from 0 to 255 stay as they are where the range is given as that; a range without width gives 0."""
    v = F.col("v").cast("double")
    if low is None or high is None:
        ends = vox.groupBy("study").agg(F.min(v).alias("low_"), F.max(v).alias("high_"))
        vox = with_study(vox, ends)
    a, b = (F.col("low_") if low is None else F.lit(float(low))), (F.col("high_") if high is None else F.lit(float(high)))
    share = F.when(b > a, (v - a) / F.when(b > a, b - a) * 255).otherwise(0.0)
    return vox.select(*AT, F.floor(F.greatest(F.lit(0.0), F.least(F.lit(255.0), share)) + 0.5).cast("int").alias("v"))


def histogram(vox: DataFrame, bins: int = 256) -> DataFrame:
    """(study, bin, n), every bin of every study present."""
    every = vox.select("study").distinct().select("study", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))).alias("bin"))
    n = vox.groupBy("study", F.col("v").cast("int").alias("bin")).agg(F.count("*").alias("n"))
    return every.join(n, ["study", "bin"], "left").withColumn("n", F.coalesce("n", F.lit(0)))


def percentile_threshold(vox: DataFrame, share: float = 0.005, floor: int = 30) -> DataFrame:
    """(study, threshold): the greatest value that the top `share` of the voxels reach, `floor` at least."""
    return threshold_of(histogram(vox), share, floor)


def threshold_of(bins: DataFrame, share: float, floor: int = 30) -> DataFrame:
    """The same of histograms (study, bin, n) with all bins."""
    down = W.partitionBy("study").orderBy(F.desc("bin"))
    # 256 rows per study
    h = bins.withColumn("from_top", F.sum("n").over(down))
    h = h.withColumn("target", F.floor(F.sum("n").over(W.partitionBy("study")) * F.lit(share)))
    return h.where("from_top >= target").groupBy("study").agg(F.greatest(F.lit(floor), F.max("bin")).alias("threshold"))


def binarise(vox: DataFrame, thresholds: DataFrame) -> DataFrame:
    """0 or 255 by the study's threshold."""
    return with_study(vox, thresholds).select(*AT, F.when(F.col("v") >= F.col("threshold"), 255).otherwise(0).alias("v"))


def normalised(vox: DataFrame) -> DataFrame:
    """Values as bytes: truncated shares of the study's maximum, all 0 where that is 0."""
    most = vox.groupBy("study").agg(F.max("v").alias("most"))
    share = F.when(F.col("most") > 0, F.col("v") / F.col("most") * 255).otherwise(0.0)
    return with_study(vox, most).select(*AT, F.greatest(F.lit(0.0), F.least(F.lit(255.0), share)).cast("int").alias("v"))


def degrees(mask: DataFrame) -> DataFrame:
    """mask with n, the number of its voxels among the 26 neighbours."""
    n = shifted(mask, ALL_26).groupBy(*AT).agg(F.count("*").alias("n"))
    return mask.select(*AT).join(n, [*AT], "left").withColumn("n", F.coalesce("n", F.lit(0)))


def node_kinds(skeleton: DataFrame) -> DataFrame:
    """ENDPOINT (one neighbour), BIFURCATION (three or more) or PATH; lonely voxels are left out."""
    kind = F.when(F.col("n") == 1, "ENDPOINT").when(F.col("n") >= 3, "BIFURCATION").otherwise("PATH")
    return degrees(skeleton).where("n > 0").withColumn("kind", kind)


def exposed_faces(mask: DataFrame) -> DataFrame:
    """A row for each face of a voxel that no voxel of the mask covers: the voxel and the face's direction."""
    around = shifted(mask.select(*AT), FACES)
    out = around.join(mask.select(*AT), [*AT], "left_anti")
    return out.select("study", *((F.col(a) - F.col(f"d{a}")).alias(a) for a in "zyx"), "dz", "dy", "dx")


def surface(mask: DataFrame) -> DataFrame:
    return exposed_faces(mask).select(*AT).distinct()


def shape_metrics(mask: DataFrame, spacing: tuple[float, float, float] = (1.0, 1.0, 1.0)) -> DataFrame:
    """(study, volume, area, sphericity, volume_by_area) of the mask, spacing being that of x, y and z."""
    sx, sy, sz = spacing
    face = F.when(F.col("dx") != 0, sy * sz).when(F.col("dy") != 0, sx * sz).otherwise(sx * sy)
    area = exposed_faces(mask).groupBy("study").agg(F.sum(face).alias("area"))
    volume = mask.groupBy("study").agg((F.count("*") * (sx * sy * sz)).alias("volume"))
    out = volume.join(area, "study")
    round_ = F.when(F.col("area") > 0, F.pow(F.lit(math.pi), 1 / 3) * F.pow(6 * F.col("volume"), F.lit(2 / 3)) / F.col("area")).otherwise(0.0)
    return out.withColumns({"sphericity": round_, "volume_by_area": F.when(F.col("area") > 0, F.col("volume") / F.col("area")).otherwise(0.0)})


def _reach(offsets) -> int:
    return max((abs(d) for o in offsets for d in o), default=0)


def _extremes(vox: DataFrame, least: tuple[bool, ...], offsets) -> DataFrame:
    """Erosions (least) and dilations one after the other, in one pass over bricks."""

    def work(values):
        for low in least:
            values = bricks.extreme(values, offsets, low)
        return (values,)

    kind = vox.schema["v"].dataType.simpleString()
    out = bricks.each(vox, len(least) * _reach(offsets), {"v": "double"}, work)
    return out.withColumn("v", F.col("v").cast(kind))


def eroded(vox: DataFrame, offsets) -> DataFrame:
    """Least value of the neighbourhood; places outside the volume are ignored."""
    return _extremes(vox, (True,), offsets)


def dilated(vox: DataFrame, offsets) -> DataFrame:
    return _extremes(vox, (False,), offsets)


def closed(vox: DataFrame, radius_mm: float, spacing: tuple[float, float, float]) -> DataFrame:
    """Dilation, then erosion; the radius is in mm, so it spans different numbers of voxels by axis."""
    if radius_mm <= 0:
        return vox.select(*AT, "v")
    return _extremes(vox, (False, True), ellipsoid(*(radius_mm / s for s in spacing)))


def top_hat(vox: DataFrame, radius: int) -> DataFrame:
    """What an opening of `radius` voxels removes."""
    o = ellipsoid(radius, radius, radius)
    work = lambda v: ((v - bricks.extreme(bricks.extreme(v, o, True), o, False)).clip(0),)
    kind = vox.schema["v"].dataType.simpleString()
    return bricks.each(vox, 2 * radius, {"v": "double"}, work).withColumn("v", F.col("v").cast(kind))


def _line(axis: str):
    return W.partitionBy("study", *(a for a in "zyx" if a != axis)).orderBy(axis)


def _beside(v: str | Column, axis: str, by: int) -> Column:
    """The value `by` places further along the axis; at the border that of the border. by is 1 or -1."""
    v = F.col(v) if isinstance(v, str) else v
    return F.coalesce((F.lead if by > 0 else F.lag)(v, 1).over(_line(axis)), v)


def gaussian(sigma: float) -> list[float]:
    """Weights from -ceil(4 sigma) to ceil(4 sigma), which sum to 1."""
    r = math.ceil(4 * sigma)
    kernel = [math.exp(-(k * k) / (2 * sigma * sigma)) for k in range(-r, r + 1)]
    return [w / sum(kernel) for w in kernel]


def blurred(vox: DataFrame, sigma: float) -> DataFrame:
    """Gaussian blur, one axis after the other; the kernel ends at ceil(4 sigma), the border's value continues outside. Volumes are
    dense, here and in what follows."""
    kernel = gaussian(sigma)
    return bricks.each(vox, len(kernel) // 2, {"v": "double"}, lambda v: (bricks.blurred(v, kernel),))


def hessian(vox: DataFrame, scale: float = 1.0, spacing: tuple[float, float, float] = (1.0, 1.0, 1.0)) -> DataFrame:
    """vox with the second differences xx, yy, zz, xy, xz, yz in mm, times scale squared; borders are clamped."""
    s = dict(zip("xyz", (d if d > 0 else 1.0 for d in spacing), strict=True))
    out = vox.select(*AT, "v")
    for a in "xyz":
        out = out.withColumns({f"up_{a}": _beside("v", a, 1), f"down_{a}": _beside("v", a, -1)})
    k = scale * scale
    cols = {a + a: (F.col(f"up_{a}") - 2 * F.col("v") + F.col(f"down_{a}")) / s[a] ** 2 * k for a in "xyz"}
    for a, b in ("xy", "xz", "yz"):
        d = lambda side, a=a, b=b: _beside(f"{side}_{a}", b, 1) - _beside(f"{side}_{a}", b, -1)
        cols[a + b] = (d("up") - d("down")) / (4 * s[a] * s[b]) * k
    return out.withColumns(cols).drop(*(f"{d}_{a}" for d in ("up", "down") for a in "xyz"))


def eigenvalues(rows: DataFrame) -> DataFrame:
    """rows with e1, e2, e3, the eigenvalues of the symmetric tensor xx .. yz, by rising magnitude, in closed form."""
    c = F.col
    off = c("xy") * c("xy") + c("xz") * c("xz") + c("yz") * c("yz")
    rows = rows.withColumn("q", (c("xx") + c("yy") + c("zz")) / 3).withColumn("off", off)
    spread = F.pow(c("xx") - c("q"), 2) + F.pow(c("yy") - c("q"), 2) + F.pow(c("zz") - c("q"), 2) + 2 * c("off")
    rows = rows.withColumn("p", F.sqrt(spread / 6))
    safe = F.when(c("p") > 0, c("p")).otherwise(1.0)
    a, b, d = ((c(x) - c("q")) / safe for x in ("xx", "yy", "zz"))
    e, f, g = (c(x) / safe for x in ("xy", "xz", "yz"))
    det = a * (b * d - g * g) - e * (e * d - g * f) + f * (e * g - b * f)
    rows = rows.withColumn("phi", F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), det / 2))) / 3)
    big = c("q") + 2 * c("p") * F.cos("phi")
    small = c("q") + 2 * c("p") * F.cos(c("phi") + 2 * math.pi / 3)
    diagonal = F.array("xx", "yy", "zz")
    values = F.when(c("off") == 0, diagonal).otherwise(F.array(big, 3 * c("q") - big - small, small))
    order = F.array_sort(F.transform(values, lambda v: F.struct(F.abs(v).alias("size"), v.alias("v"))))
    rows = rows.withColumn("sorted", order)
    return rows.withColumns({f"e{i + 1}": F.element_at("sorted", i + 1)["v"] for i in range(3)}).drop("q", "off", "p", "phi", "sorted")


def vesselness(vox: DataFrame, scales: tuple[float, ...] = (1.0, 2.0, 3.0), tau: float = 0.75, blur: bool = True, spacing=(1.0, 1.0, 1.0)) -> DataFrame:
    """Multi-scale response of bright tubes: by scale the volume ratio of the two greatest curvatures, the third regularised by
    tau times its greatest value, times that curvature; of all scales the greatest. One pass over bricks gives the curvatures of
    all scales, their greatest values by study come next, and the rest is columns."""
    return finished(lambda: _vesselness(vox, scales, tau, blur, _positive(spacing)))


def _vesselness(vox: DataFrame, scales: tuple[float, ...], tau: float, blur: bool, s: dict[str, float]) -> DataFrame:
    def work(values):
        out = []
        for scale in scales:
            e = bricks.eigenvalues(bricks.derivatives(bricks.blurred(values, gaussian(scale)) if blur else values, scale, s))
            out += [-e[1], -e[2]]
        return out

    halo = 1 + (max(len(gaussian(scale)) // 2 for scale in scales) if blur else 0)
    e = settled(bricks.each(vox, halo, {f"l{k}_{i}": "double" for i in range(len(scales)) for k in (2, 3)}, work))
    most = e.groupBy("study").agg(*(F.greatest(F.lit(0.0), F.max(f"l3_{i}")).alias(f"most_{i}") for i in range(len(scales))))

    def response(i: int) -> Column:
        l2, l3, floor = F.col(f"l2_{i}"), F.col(f"l3_{i}"), F.lit(tau) * F.col(f"most_{i}")
        rho = F.when(l3 <= floor, floor).otherwise(l3)
        den = F.pow(l2 + rho, 3)
        ratio = F.when(l2 >= rho / 2, 1.0).when(den > 1e-12, 27 * l2 * l2 * (rho - l2) / den).otherwise(0.0)
        v = F.when((l2 > 0) & (l3 > 0), ratio * l3).otherwise(0.0)
        return F.when(F.isnan(v) | (F.abs(v) == float("inf")), 0.0).otherwise(v)

    return with_study(e, most).select(*AT, F.greatest(F.lit(0.0), F.lit(0.0), *(response(i) for i in range(len(scales)))).alias("v"))


def _positive(spacing) -> dict[str, float]:
    return dict(zip("xyz", (d if d > 0 else 1.0 for d in spacing), strict=True))


def curvatures(values, s):
    """Gaussian curvature and shape index of an array, a volume's border being the array's."""
    import numpy as np

    d = bricks.derivatives(-values, 1.0, s)
    x, y, z, xx, yy, zz, xy, xz, yz = (d[n] for n in ("x", "y", "z", "xx", "yy", "zz", "xy", "xz", "yz"))
    n2 = x * x + y * y + z * z
    k = x * x * (yy * zz - yz * yz) + y * y * (xx * zz - xz * xz) + z * z * (xx * yy - xy * xy) + 2 * (x * y * (xz * yz - xy * zz) + y * z * (xy * xz - yz * xx) + x * z * (xy * yz - xz * yy))
    h = x * x * (yy + zz) + y * y * (xx + zz) + z * z * (xx + yy) - 2 * (x * y * xy + y * z * yz + x * z * xz)
    ok = np.zeros(values.shape, bool)
    ok[1:-1, 1:-1, 1:-1] = True
    ok &= n2 >= 1e-9
    safe = np.where(ok, n2, 1.0)
    k, h = np.where(ok, k / (safe * safe), 0.0), np.where(ok, h / (2 * safe**1.5), 0.0)
    si = 2 / np.pi * np.arctan2(h, np.sqrt(np.maximum(h * h - k, 0.0)))
    return k, np.where(ok, si, 0.5)


def curvature(vox: DataFrame, spacing=(1.0, 1.0, 1.0)) -> DataFrame:
    """Gaussian curvature k and shape index si of the level sets of -v; (0, 0.5) at borders and where it is flat."""
    s = _positive(spacing)
    return bricks.each(vox, 1, {"k": "double", "si": "double"}, lambda v: curvatures(v, s))  # bricks see one voxel more


def distance(vox: DataFrame, spacing: tuple[float, float, float] = (1.0, 1.0, 1.0), brick: int = bricks.BRICK) -> DataFrame:
    """Chamfer distance in mm from each foreground voxel (v > 0) to the background through steps to 26 neighbours, 0 in the
    background; null where a study has none. Inside a brick distances settle at once; rounds over bricks, which see one voxel
    around them, follow until none changes, so there are about as many as the longest way crosses bricks."""
    s = _positive(spacing)
    steps = {o: math.sqrt(sum((d * s[a]) ** 2 for d, a in zip(o, "zyx", strict=True))) for o in ALL_26}

    def work(values):
        import numpy as np

        now, missing = np.where(np.isnan(values), np.inf, values), np.isnan(values)
        while True:
            full, before = np.pad(now, 1, constant_values=np.inf), now
            for o, mm in steps.items():
                now = np.minimum(now, full[tuple(slice(1 + d, 1 + d + n) for d, n in zip(o, now.shape, strict=True))] + mm)
            now[missing] = np.inf
            if (now == before).all():
                return (now,)

    now, state = settled(vox.select(*AT, F.when(F.col("v") > 0, float("inf")).otherwise(0.0).alias("v"))), None
    while True:
        after = settled(bricks.each(now, 1, {"v": "double"}, work, brick))
        released(now)
        known = F.col("v") < float("inf")
        before, state = state, tuple(after.agg(F.count_if(known), F.sum(F.when(known, F.round("v", 9).cast("decimal(38,9)")))).first())
        now = after
        if before == state:
            return now.select(*AT, F.when(known, F.col("v")).alias("mm"))
