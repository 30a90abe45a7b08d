"""What a viewer shows of candidates, branches and surfaces, as columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def clamp(c: Column, low: float = 0.0, high: float = 1.0) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), c))


def rounded(c: Column) -> Column:
    """Halves go up, below 0 too."""
    return F.floor(c + 0.5)


# Where the colours of a bulge begin and how far they reach; the range of a box; the radius of full white.
def bulge_share(bulge: Column) -> Column:
    """0 for a normal vessel to 1 from half as wide again."""
    return clamp((bulge - 1.0) / 0.5)


def bulge_index(bulge: Column) -> Column:
    """Entry of a colour table of 256."""
    return clamp(bulge_share(bulge) * 255, 0.0, 255.0).cast("int")


def hue_colour(bulge: Column) -> Column:
    """struct r, g, b of 0 to 255, from blue to red, for viewers without a colour table."""
    six = (1 - bulge_share(bulge)) * 4.0  # sixths of the colour circle
    part = six - F.floor(six)
    up, down = rounded(part * 255).cast("int"), rounded((1 - part) * 255).cast("int")
    sixth, full, none = F.floor(six), F.lit(255), F.lit(0)
    pick = lambda *by: F.when(sixth == 0, by[0]).when(sixth == 1, by[1]).when(sixth == 2, by[2]).when(sixth == 3, by[3]).otherwise(by[4])
    return F.struct(pick(full, down, none, none, up).alias("r"), pick(up, full, full, down, none).alias("g"), pick(none, none, up, full, full).alias("b"))


def coloured(rows: DataFrame, lut: DataFrame, bulge: str = "br") -> DataFrame:
    """rows with r, g, b of a colour table (idx, r, g, b) of 256 entries, which is small enough to be sent to every task."""
    at = rows.withColumn("idx_", bulge_index(F.col(bulge)))
    return at.join(F.broadcast(lut.select(F.col("idx").alias("idx_"), "r", "g", "b")), "idx_", "left").drop("idx_")


def centre(at: Column, size: int, mirror: bool = False) -> Column:
    """The middle of a voxel on an axis of -0.5 to 0.5."""
    return ((F.lit(size - 1) - at if mirror else at) + 0.5) / size - 0.5


def focus(found: DataFrame, size: tuple[int, int, int]) -> DataFrame:
    """found (x, y, z) with fx, fy, fz, the place a camera looks at, on axes of -0.5 to 0.5; x is mirrored."""
    return found.withColumns({f"f{a}": centre(F.col(a), n, a == "x") for a, n in zip("xyz", size, strict=True)})


def box(found: DataFrame, size: tuple[int, int, int], spacing: tuple[float, float, float]) -> DataFrame:
    """found (x, y, z, max_br) with a box around each: cx, cy, cz and bw, bh, bd as shares of the volume; x is mirrored."""
    mm = F.least(F.lit(5.0), F.col("max_br") * 1.5) * 1.2 * 2
    out = {f"c{a}": centre(F.col(a), n, a == "x") for a, n in zip("xyz", size, strict=True)}
    return found.withColumns(out | {b: mm / (s * n) for b, s, n in zip(("bw", "bh", "bd"), spacing, size, strict=True)})


def thumbnail(found: DataFrame, size: tuple[int, int], side: int = 80) -> DataFrame:
    """found (x, y) with the window x0, y0, x1, y1 of `side` pixels around each, cut at the borders; ends are exclusive."""
    half = side // 2
    cut = lambda c, n: F.greatest(F.lit(0), F.least(F.lit(n), c))
    return found.withColumns({f"{a}{k}": cut(F.col(a) + (half if k else -half), n) for a, n in zip("xy", size, strict=True) for k in (0, 1)})


def grey_level(radius: Column, most: float = 15.0) -> Column:
    return clamp(radius / most * 255, 0.0, 255.0).cast("int")


def linear_index(x: Column, y: Column, z: Column, width: int, height: int) -> Column:
    return z.cast("long") * width * height + y * width + x


def vertex_voxel(rows: DataFrame, size: tuple[int, int, int], spacing: tuple[float, float, float]) -> DataFrame:
    """rows with the voxel vx, vy, vz of a mesh vertex x, y, z in mm; x is mirrored, places outside move to the border."""
    out = {}
    for a, n, s in zip("xyz", size, spacing, strict=True):
        at = rounded(F.col(a) / s)
        out[f"v{a}"] = F.greatest(F.lit(0), F.least(F.lit(n - 1), n - 1 - at if a == "x" else at)).cast("int")
    return rows.withColumns(out)


def branch_percent(branches: DataFrame) -> DataFrame:
    """branches (study, length_mm) with percent: the length of the study's longest branch is 100."""
    most = branches.groupBy("study").agg(F.max("length_mm").alias("longest"))
    share = F.when(F.col("longest") > 0, rounded(F.col("length_mm") / F.col("longest") * 100)).otherwise(0)
    return branches.join(most, "study").withColumn("percent", share.cast("int")).drop("longest")


def of_type(found: DataFrame, which: str = "all") -> DataFrame:
    """Candidates to show: all, normal (type NORMAL) or suspected (any other type)."""
    if which == "all":
        return found
    return found.where((F.col("type") == "NORMAL") if which == "normal" else (F.col("type") != "NORMAL"))


def status(found: DataFrame) -> DataFrame:
    """One row: n, suspected (not NORMAL), high_risk (score above 70)."""
    return found.agg(F.count("*").alias("n"), F.count_if(F.col("type") != "NORMAL").alias("suspected"), F.count_if(F.col("score") > 70).alias("high_risk"))


def decimals(c: Column, digits: int, width: int = 0) -> Column:
    """c as printf's %width.digitsf writes it: rounded by the value it has, halves of that to even. format_string would round the
    digits of its shortest form, which for 1.005 (a little less than it says) is up."""
    text = F.call_function("format_number", c, F.lit("0." + "0" * digits))
    text = F.when(F.isnan(c), "nan").when(F.abs(c) == float("inf"), F.when(c > 0, "inf").otherwise("-inf")).otherwise(text)
    return F.format_string(f"%{width}s", text) if width else text


# The format of a candidate's line, with decimals() as text, and of its details.
LINE = "Score: %s | Aneurysm [%s] at (X:%d, Y:%d, Z:%d) | BulgeRatio: %s | ShapeIndex: %s"
DETAILS = (
    "=== Aneurysm Candidate Details ===\n\n"
    "Voxel Position : (X: %d, Y: %d, Z: %d)\n"
    "Saliency Score : %.2f / 100\n"
    "Current Type   : %s\n\n"
    "--- Morphological Features ---\n"
    "Max Bulge Ratio : %.3f (Threshold: 1.35)\n"
    "Max Shape Index : %.3f (Sphere: 1.0, Tube: 0.5)\n"
    "Gaussian Curv.  : %.4f\n"
    "Vessel Radius   : %.2f mm\n"
    "Volume Est.     : %.2f mm\u00b3\n\n"
    "Status: %s"
)
CLEARED, ACTIVE = "Cleared (NORMAL)", "Active (Suspected)"


def details(found: DataFrame) -> DataFrame:
    """found (x, y, z, score, type, max_br, max_si, max_k, radius, volume) with details, a text of several lines; curvature, radius
    and volume are the candidate's own, 0 where they are null."""
    whole = (F.col(a).cast("int") for a in "xyz")
    known = (F.coalesce(F.col(c), F.lit(0.0)) for c in ("max_k", "radius", "volume"))
    state = F.when(F.col("type") == "NORMAL", CLEARED).otherwise(ACTIVE)
    return found.withColumn("details", F.format_string(DETAILS, *whole, "score", "type", "max_br", "max_si", *known, state))


def report(found: DataFrame) -> DataFrame:
    """found (score, type, x, y, z, max_br, max_si) with line, a line of text."""
    whole = (F.col(a).cast("int") for a in "xyz")
    line = F.format_string(LINE, decimals(F.col("score"), 1, 5), "type", *whole, decimals(F.col("max_br"), 2, 5), decimals(F.col("max_si"), 2))
    return found.withColumn("line", line)
