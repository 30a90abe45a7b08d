"""All queries over the driver's tables, by name, and the SQL that checks them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import display
from ..operators import components, denoise, detect, graph, grid, oriented, reform, studies, thinning
from . import analysis
from . import views as V

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
AT = "study, z, y, x"
OFF = "(SELECT dz, dy, dx FROM (SELECT unnest([-1, 0, 1]) AS dz), (SELECT unnest([-1, 0, 1]) AS dy), (SELECT unnest([-1, 0, 1]) AS dx) WHERE {})"
ALL_26, FACES = OFF.format("abs(dz) + abs(dy) + abs(dx) > 0"), OFF.format("abs(dz) + abs(dy) + abs(dx) = 1")
NEAR = "m.study = n.study AND n.z = m.z + o.dz AND n.y = m.y + o.dy AND n.x = m.x + o.dx"


def query(name: str, sql: str | None = None):
    def put(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return put


def _rounded(df: DataFrame, *cols: str, digits: int = 4) -> DataFrame:
    return df.withColumns({c: F.round(c, digits) + 0.0 for c in cols})


HIST = f"WITH {V.GREY}, h AS (SELECT s.study, b.bin, count(g.v) AS n FROM (SELECT DISTINCT study FROM grey) s CROSS JOIN (SELECT unnest(range(256)) AS bin) b LEFT JOIN grey g ON g.study = s.study AND g.v = b.bin GROUP BY ALL)"
THRESHOLD = HIST + """, c AS (SELECT *, sum(n) OVER (PARTITION BY study ORDER BY bin DESC) AS c, floor(sum(n) OVER (PARTITION BY study) * 0.005e0) AS target FROM h),
t AS (SELECT study, greatest(30, max(bin)) AS threshold FROM c WHERE c >= target GROUP BY study)"""


@query("v2_histogram", HIST + " SELECT study, CAST(bin AS INT) AS bin, n FROM h")
def _(s, d):
    return grid.histogram(V.grey(s, d))


@query("v3_percentile_threshold", THRESHOLD + " SELECT study, CAST(threshold AS INT) AS threshold FROM t")
def _(s, d):
    return grid.percentile_threshold(V.grey(s, d))


@query("v4_binarise", THRESHOLD + f" SELECT {AT}, CASE WHEN v >= threshold THEN 255 ELSE 0 END AS v FROM grey JOIN t USING (study)")
def _(s, d):
    return grid.binarise(V.grey(s, d), grid.percentile_threshold(V.grey(s, d)))


@query("j6_normalise", f"WITH {V.GREY} SELECT {AT}, CAST(trunc(greatest(0e0, least(255e0, v / max(v) OVER (PARTITION BY study) * 255))) AS INT) AS v FROM grey")
def _(s, d):
    return grid.normalised(V.grey(s, d))




@query("jn1_degree_26", f"WITH {V.MASK} SELECT m.study, m.z, m.y, m.x, count(n.x) AS n FROM mask m CROSS JOIN {ALL_26} o LEFT JOIN mask n ON {NEAR} GROUP BY ALL")
def _(s, d):
    return grid.degrees(V.mask(s, d))


@query("n2_node_kinds", f"WITH {V.MASK}, d AS (SELECT m.study, m.z, m.y, m.x, count(n.x) AS n FROM mask m CROSS JOIN {ALL_26} o LEFT JOIN mask n ON {NEAR} GROUP BY ALL) SELECT *, CASE WHEN n = 1 THEN 'ENDPOINT' WHEN n >= 3 THEN 'BIFURCATION' ELSE 'PATH' END AS kind FROM d WHERE n > 0")
def _(s, d):
    return grid.node_kinds(V.mask(s, d))


OPEN = f"WITH {V.MASK}, f AS (SELECT m.*, o.* FROM mask m CROSS JOIN {FACES} o LEFT JOIN mask n ON {NEAR} WHERE n.x IS NULL)"


@query("f1_surface", OPEN + f" SELECT DISTINCT {AT} FROM f")
def _(s, d):
    return grid.surface(V.mask(s, d))


@query("a10_shape_metrics", OPEN + """, a AS (SELECT study, sum(CASE WHEN dx <> 0 THEN 0.6e0 WHEN dy <> 0 THEN 0.6e0 ELSE 0.25e0 END) AS area FROM f GROUP BY study), v AS (SELECT study, count(*) * 0.3e0 AS volume FROM mask GROUP BY study)
SELECT study, round(volume, 4) AS volume, round(area, 4) AS area, round(pow(pi(), 1e0 / 3) * pow(6 * volume, 2e0 / 3) / area, 4) AS sphericity, round(volume / area, 4) AS volume_by_area FROM v JOIN a USING (study)""")
def _(s, d):
    return _rounded(grid.shape_metrics(V.mask(s, d), (0.5, 0.5, 1.2)), "volume", "area", "sphericity", "volume_by_area")


def _extreme(of: str, agg: str, r: int, to: str) -> str:
    off = f"(SELECT dz, dy, dx FROM (SELECT unnest(range(-{r}, {r + 1})) AS dz), (SELECT unnest(range(-{r}, {r + 1})) AS dy), (SELECT unnest(range(-{r}, {r + 1})) AS dx) WHERE dz * dz + dy * dy + dx * dx <= {r * r})"
    return f"{to} AS (SELECT m.study, m.z, m.y, m.x, {agg}(n.v) AS v FROM {of} m CROSS JOIN {off} o JOIN {of} n ON {NEAR} GROUP BY ALL)"


@query("m1_erode", f"WITH {V.GREY}, {_extreme('grey', 'min', 2, 'e')} SELECT * FROM e")
def _(s, d):
    return grid.eroded(V.grey(s, d), grid.ellipsoid(2, 2, 2))


@query("m1_dilate", f"WITH {V.GREY}, {_extreme('grey', 'max', 2, 'e')} SELECT * FROM e")
def _(s, d):
    return grid.dilated(V.grey(s, d), grid.ellipsoid(2, 2, 2))


@query("v5_closing", f"WITH {V.GREY}, {_extreme('grey', 'max', 2, 'a')}, {_extreme('a', 'min', 2, 'e')} SELECT * FROM e")
def _(s, d):
    return grid.closed(V.grey(s, d), 2.0, (1.0, 1.0, 1.0))


def _ball(of: str, agg: str, r: int, to: str) -> str:
    """The same, row by row along x: first of all widths that a row of the ball has, then of its rows. Rows of x are complete."""
    width = lambda k: f"{agg}(v) OVER (PARTITION BY study, z, y ORDER BY x ROWS BETWEEN {k} PRECEDING AND {k} FOLLOWING)"
    wide = ", ".join(f"{width(k)} AS w{k}" for k in range(r + 1))
    off = f"(SELECT dz, dy, CAST(floor(sqrt({r * r} - dz * dz - dy * dy)) AS INT) AS half FROM (SELECT unnest(range(-{r}, {r + 1})) AS dz), (SELECT unnest(range(-{r}, {r + 1})) AS dy) WHERE dz * dz + dy * dy <= {r * r})"
    pick = "CASE half " + " ".join(f"WHEN {k} THEN w{k}" for k in range(r + 1)) + " END"
    return f"{to}_w AS MATERIALIZED (SELECT {AT}, {wide} FROM {of}), {to} AS MATERIALIZED (SELECT study, z - dz AS z, y - dy AS y, x, {agg}({pick}) AS v FROM {to}_w CROSS JOIN {off} o GROUP BY ALL)"


@query("w1_top_hat", f"WITH {V.GREY}, {_ball('grey', 'min', 5, 'a0')}, a AS (SELECT a0.* FROM a0 SEMI JOIN grey USING (study, z, y, x)), {_ball('a', 'max', 5, 'e')} SELECT study, z, y, x, greatest(0, grey.v - e.v) AS v FROM grey JOIN e USING (study, z, y, x)")
def _(s, d):
    return grid.top_hat(V.grey(s, d), 5)


def _reach(mask: str, off: str) -> str:
    return f"""WITH RECURSIVE {V.VOX}, p AS (SELECT study, z, y, x FROM {mask}), m AS (SELECT *, (z * 64 + y) * 64 + x AS id FROM p),
l AS (SELECT m.study, m.id AS a, n.id AS b FROM m CROSS JOIN {off} o JOIN m n ON {NEAR}),
r(study, id, seen) AS (SELECT study, id, id FROM m UNION SELECT r.study, r.id, l.b FROM r JOIN l ON l.study = r.study AND l.a = r.seen),
c AS (SELECT study, id, min(seen) AS comp FROM r GROUP BY ALL), s AS (SELECT *, count(*) OVER (PARTITION BY study, comp) AS size FROM c)"""


@query("n9_components_26", _reach("vox WHERE v > 0.18", ALL_26) + " SELECT study, m.z, m.y, m.x, CAST(comp // 4096 AS INT) AS comp_z, CAST(comp // 64 % 64 AS INT) AS comp_y, CAST(comp % 64 AS INT) AS comp_x, size FROM m JOIN s USING (study, id)")
def _(s, d):
    out = components.voxel_components(V.mask(s, d))
    return out.select(*grid.AT, *(F.col(f"component.{a}").alias(f"comp_{a}") for a in "zyx"), "size")


@query("v7_without_small", _reach("vox WHERE v > 0.18", ALL_26) + " SELECT study, m.z, m.y, m.x FROM m JOIN s USING (study, id) WHERE size >= 4")
def _(s, d):
    return components.without_small(V.mask(s, d), 4)


@query("v7_removed", _reach("vox WHERE v > 0.18", ALL_26) + " SELECT study, count(DISTINCT comp) FILTER (size < 4) AS removed FROM s GROUP BY study")
def _(s, d):
    return components.small_ones(V.mask(s, d), 4)


HESSIAN_AXIS = {"x": "PARTITION BY study, z, y ORDER BY x", "y": "PARTITION BY study, z, x ORDER BY y", "z": "PARTITION BY study, y, x ORDER BY z"}


def _side(v: str, a: str, f: str) -> str:
    return f"coalesce({f}({v}) OVER ({HESSIAN_AXIS[a]}), {v})"


def _hessian(of: str, spacing=(1.0, 1.0, 1.0), scale: float = 1.0) -> str:
    s = dict(zip("xyz", spacing, strict=True))
    sides = ", ".join(f"{_side('v', a, f)} AS {n}_{a}" for a in "xyz" for f, n in (("lead", "up"), ("lag", "down")))
    k = f" * {scale * scale}e0" if scale != 1 else ""
    two = ", ".join(f"(up_{a} - 2 * v + down_{a}) / {s[a] ** 2}e0{k} AS {a}{a}" for a in "xyz")
    mixed = ", ".join(f"(({_side(f'up_{a}', b, 'lead')} - {_side(f'up_{a}', b, 'lag')}) - ({_side(f'down_{a}', b, 'lead')} - {_side(f'down_{a}', b, 'lag')})) / {4 * s[a] * s[b]}e0{k} AS {a}{b}" for a, b in ("xy", "xz", "yz"))
    return f"n1 AS (SELECT {AT}, v, {sides} FROM {of}), hs AS (SELECT {AT}, v, up_x, up_y, up_z, down_x, down_y, down_z, {two}, {mixed} FROM n1)"


SIX = ("xx", "yy", "zz", "xy", "xz", "yz")


@query("j1_hessian", f"WITH {V.VOX}, {_hessian('vox', (0.5, 0.5, 1.0))} SELECT {AT}, {', '.join(f'round({c}, 4) + 0e0 AS {c}' for c in SIX)} FROM hs")
def _(s, d):
    return _rounded(grid.hessian(V.vox(s, d), 1.0, (0.5, 0.5, 1.0)).drop("v"), *SIX)


EIGEN_OF_HS = """, q AS (SELECT *, (xx + yy + zz) / 3 AS q, xy * xy + xz * xz + yz * yz AS off FROM hs),
p AS (SELECT *, sqrt((pow(xx - q, 2) + pow(yy - q, 2) + pow(zz - q, 2) + 2 * off) / 6) AS p FROM q), w AS (SELECT *, CASE WHEN p > 0 THEN p ELSE 1 END AS w FROM p),
f AS (SELECT *, acos(greatest(-1e0, least(1e0, ((xx - q) * ((yy - q) * (zz - q) - yz * yz) - xy * (xy * (zz - q) - yz * xz) + xz * (xy * yz - (yy - q) * xz)) / (w * w * w) / 2))) / 3 AS phi FROM w),
g AS (SELECT *, q + 2 * p * cos(phi) AS big, q + 2 * p * cos(phi + 2 * pi() / 3) AS small FROM f),
e AS (SELECT *, CASE WHEN off = 0 THEN [xx, yy, zz] ELSE [big, 3 * q - big - small, small] END AS l FROM g),
ev AS (SELECT study, z, y, x, list_transform(list_sort(list_transform(l, lambda v: {'s': abs(v), 'v': v})), lambda r: r.v) AS l FROM e)"""
EIGEN = _hessian("vox") + EIGEN_OF_HS


def _blur(of: str, to: str, sigma: float) -> str:
    """One axis after the other; `to` has the values."""
    kernel, out = grid.gaussian(sigma), ""
    r = len(kernel) // 2
    number = lambda w: repr(w) if "e" in repr(w) else f"{w!r}e0"
    for a, name in zip("xyz", (f"{to}_x", f"{to}_y", to), strict=True):
        ends = {f: f"{f}_value(v) OVER ({HESSIAN_AXIS[a]} ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)" for f in ("first", "last")}
        at = lambda k, a=a, ends=ends: "v" if k == 0 else f"coalesce(lag(v, {-k}) OVER ({HESSIAN_AXIS[a]}), {ends['first']})" if k < 0 else f"coalesce(lead(v, {k}) OVER ({HESSIAN_AXIS[a]}), {ends['last']})"
        total = " + ".join(f"{at(k)} * {number(w)}" for k, w in zip(range(-r, r + 1), kernel, strict=True))
        out += f"{', ' if out else ''}{name} AS (SELECT {AT}, {total} AS v FROM {of})"
        of = name
    return out


def _response(of: str, scale: float) -> str:
    """A query of the response at one scale."""
    return f"""WITH {_blur(of, 'bl', scale)}, {_hessian('bl', scale=scale)} {EIGEN_OF_HS}, k AS (SELECT {AT}, -l[2] AS l2, -l[3] AS l3, greatest(0, max(-l[3]) OVER (PARTITION BY study)) * 0.75e0 AS fl FROM ev),
h AS (SELECT *, CASE WHEN l3 <= fl THEN fl ELSE l3 END AS rho FROM k)
SELECT {AT}, CASE WHEN l2 > 0 AND l3 > 0 THEN l3 * CASE WHEN l2 >= rho / 2 THEN 1 WHEN pow(l2 + rho, 3) > 1e-12 THEN 27 * l2 * l2 * (rho - l2) / pow(l2 + rho, 3) ELSE 0 END ELSE 0 END AS v FROM h"""


GREY_DOUBLE = V.GREY + ", gd AS (SELECT study, z, y, x, CAST(v AS DOUBLE) AS v FROM grey)"


@query("j2_eigenvalues", f"WITH {V.VOX}, {EIGEN} SELECT {AT}, round(l[1], 3) + 0e0 AS e1, round(l[2], 3) + 0e0 AS e2, round(l[3], 3) + 0e0 AS e3 FROM ev")
def _(s, d):
    e = grid.eigenvalues(grid.hessian(V.vox(s, d)))
    return _rounded(e.select(*grid.AT, "e1", "e2", "e3"), "e1", "e2", "e3", digits=3)


@query("j4_tube_response", f"""WITH {V.VOX}, {EIGEN}, k AS (SELECT {AT}, -l[2] AS l2, -l[3] AS l3, greatest(0, max(-l[3]) OVER (PARTITION BY study)) * 0.75e0 AS fl FROM ev),
h AS (SELECT *, CASE WHEN l3 <= fl THEN fl ELSE l3 END AS rho FROM k)
SELECT {AT}, round(CASE WHEN l2 > 0 AND l3 > 0 THEN l3 * CASE WHEN l2 >= rho / 2 THEN 1 WHEN pow(l2 + rho, 3) > 1e-12 THEN 27 * l2 * l2 * (rho - l2) / pow(l2 + rho, 3) ELSE 0 END ELSE 0 END, 3) + 0e0 AS v FROM h""")
def _(s, d):
    return _rounded(grid.vesselness(V.vox(s, d), (1.0,), blur=False), "v", digits=3)


VESSELNESS = f"WITH {GREY_DOUBLE}, {', '.join(f'r{int(k)} AS ({_response(chr(103) + chr(100), k)})' for k in (1.0, 2.0, 3.0))}, b AS (SELECT {AT}, max(v) AS v FROM (SELECT * FROM r1 UNION ALL SELECT * FROM r2 UNION ALL SELECT * FROM r3) GROUP BY ALL)"


@query("j5_vesselness", VESSELNESS + f" SELECT {AT}, CAST(trunc(CASE WHEN max(v) OVER (PARTITION BY study) > 0 THEN greatest(0e0, least(255e0, v / max(v) OVER (PARTITION BY study) * 255)) ELSE 0 END) AS INT) AS v FROM b")
def _(s, d):
    return grid.normalised(grid.vesselness(V.grey(s, d)))


@query("b1_gaussian_blur", f"WITH {GREY_DOUBLE}, {_blur('gd', 'bl', 1.5)} SELECT {AT}, round(v, 4) + 0e0 AS v FROM bl")
def _(s, d):
    return _rounded(grid.blurred(V.grey(s, d), 1.5), "v")


@query("f2_curvature", f"""WITH {GREY_DOUBLE}, {_blur('gd', 'bl', 1.5)}, neg AS (SELECT {AT}, -v AS v FROM bl), {_hessian('neg')},
g AS (SELECT *, (up_x - down_x) / 2 AS gx, (up_y - down_y) / 2 AS gy, (up_z - down_z) / 2 AS gz, z > 0 AND y > 0 AND x > 0 AND z < max(z) OVER s AND y < max(y) OVER s AND x < max(x) OVER s AS inside FROM hs WINDOW s AS (PARTITION BY study)),
n AS (SELECT *, gx * gx + gy * gy + gz * gz AS n2 FROM g),
c AS (SELECT *, inside AND n2 >= 1e-9 AS ok, gx * gx * (yy * zz - yz * yz) + gy * gy * (xx * zz - xz * xz) + gz * gz * (xx * yy - xy * xy) + 2 * (gx * gy * (xz * yz - xy * zz) + gy * gz * (xy * xz - yz * xx) + gx * gz * (xy * yz - xz * yy)) AS k4,
  gx * gx * (yy + zz) + gy * gy * (xx + zz) + gz * gz * (xx + yy) - 2 * (gx * gy * xy + gy * gz * yz + gx * gz * xz) AS h3 FROM n),
e AS (SELECT {AT}, ok, CASE WHEN ok THEN k4 / (n2 * n2) ELSE 0 END AS k, CASE WHEN ok THEN h3 / (2 * pow(n2, 1.5e0)) ELSE 0 END AS h FROM c)
SELECT {AT}, round(k, 4) + 0e0 AS k, round(CASE WHEN ok THEN 2 / pi() * atan2(h, sqrt(greatest(h * h - k, 0))) ELSE 0.5e0 END, 4) + 0e0 AS si FROM e""")
def _(s, d):
    return _rounded(grid.curvature(grid.blurred(V.grey(s, d), 1.5)), "k", "si")


@query("v6_fill_holes", f"""WITH RECURSIVE {V.VOX}, b AS (SELECT {AT} FROM vox WHERE NOT v > -0.05), e AS (SELECT study, max(z) AS mz, max(y) AS my, max(x) AS mx FROM vox GROUP BY study),
r AS (SELECT b.study, b.z, b.y, b.x FROM b JOIN e USING (study) WHERE z = 0 OR y = 0 OR x = 0 OR z = mz OR y = my OR x = mx
  UNION SELECT n.study, n.z, n.y, n.x FROM r m CROSS JOIN {FACES} o JOIN b n ON {NEAR})
SELECT study, vox.z, vox.y, vox.x, CASE WHEN r.x IS NULL THEN 255 ELSE 0 END AS v FROM vox LEFT JOIN r USING (study, z, y, x)""")
def _(s, d):
    return components.filled(V.vox(s, d).select(*grid.AT, F.when(F.col("v") > -0.05, 255).otherwise(0).alias("v")))


@query("v1_bytes", f"WITH {V.VOX}, e AS (SELECT *, min(v) OVER (PARTITION BY study) AS a, max(v) OVER (PARTITION BY study) AS b FROM vox) SELECT {AT}, CAST(floor(greatest(0e0, least(255e0, CASE WHEN b > a THEN (v - a) / (b - a) * 255 ELSE 0 END)) + 0.5e0) AS INT) AS v FROM e")
def _(s, d):
    return grid.to_bytes(V.vox(s, d))


#: All background within 3 voxels along each axis: what is nearer than 4 is among it, and nothing here is farther (else null).
@query("x1_chamfer_distance", f"""WITH {V.VOX}, f AS MATERIALIZED (SELECT {AT} FROM vox WHERE v > -0.05), b AS MATERIALIZED (SELECT {AT} FROM vox WHERE NOT v > -0.05),
o AS (SELECT dz, dy, dx, sqrt(3) * lo + sqrt(2) * (abs(dz) + abs(dy) + abs(dx) - hi - 2 * lo) + (2 * hi - abs(dz) - abs(dy) - abs(dx) + lo) AS far FROM (
  SELECT *, least(abs(dz), abs(dy), abs(dx)) AS lo, greatest(abs(dz), abs(dy), abs(dx)) AS hi FROM range(-3, 4) a(dz), range(-3, 4) b(dy), range(-3, 4) c(dx))),
p AS (SELECT study, z + dz AS z, y + dy AS y, x + dx AS x, min(far) AS far FROM b CROSS JOIN o GROUP BY ALL)
SELECT f.study, f.z, f.y, f.x, CASE WHEN far < 4 THEN round(far, 4) END AS mm FROM f LEFT JOIN p ON p.study = f.study AND p.z = f.z AND p.y = f.y AND p.x = f.x UNION ALL SELECT {AT}, 0 AS mm FROM b""")
def _(s, d):
    return _rounded(grid.distance(V.vox(s, d).withColumn("v", F.when(F.col("v") > -0.05, 1).otherwise(0))), "mm")


CAND = f"""WITH {V.CENTRELINE}, f AS (SELECT *, br >= 1.35 AND si >= 0.65 AND k > 0 AS flag FROM centreline),
g AS (SELECT *, idx - row_number() OVER (PARTITION BY branch_id, flag ORDER BY idx) AS run FROM f),
c AS (SELECT branch_id, min(idx) AS first, count(*) AS n_points, greatest(0, max(br)) AS max_br, greatest(0, max(si)) AS max_si, greatest(0, max(k)) AS max_k, arg_max(idx, row(br, -idx)) AS peak
FROM g WHERE flag GROUP BY branch_id, run HAVING count(*) >= 3)"""
SCORE = "100 / (1 + exp(-10 * ((0.35 * greatest(0, least(1, (max_si - 0.65) / 0.35)) + 0.35 * greatest(0, least(1, (max_br - 1.35) / 3.65))) / 0.70 - 0.5)))"
COLS = "branch_id, CAST(first AS INT) AS first, n_points, round(max_br, 4) AS max_br, round(max_si, 4) AS max_si, round(max_k, 4) AS max_k, CAST(peak AS INT) AS peak"


@query("n1_detect_islands", CAND + f" SELECT {COLS} FROM c")
def _(s, d):
    return _rounded(detect.candidates(V.centreline(s, d)), "max_br", "max_si", "max_k")


@query("n8_scored_candidates", CAND + f" SELECT {COLS}, round({SCORE}, 4) AS score FROM c")
def _(s, d):
    return _rounded(detect.ranked(detect.candidates(V.centreline(s, d))), "max_br", "max_si", "max_k", "score")


@query("a3_median_baseline", f"WITH {V.CENTRELINE} SELECT branch_id, greatest(median(radius), 1e-6) AS baseline FROM centreline GROUP BY branch_id")
def _(s, d):
    return detect.baseline(V.centreline(s, d))


@query("a5_best_shape", f"WITH {V.CENTRELINE} SELECT branch_id, CAST(idx % 16 AS INT) AS idx, round(max(si), 4) AS si, round(arg_max(k, row(si, -z, -y, -x, k)), 4) AS k FROM centreline WHERE si > -1 GROUP BY branch_id, idx % 16")
def _(s, d):
    p = V.centreline(s, d).withColumn("idx", F.col("idx") % 16)
    p = p.groupBy("branch_id", "idx", "z", "y", "x", "si").agg(F.max("k").alias("k"))
    return _rounded(detect.best_shape(p), "si", "k")


@query("jn4_nearest_centreline", f"""WITH {V.CENTRELINE}, p AS (SELECT DISTINCT o_orderkey AS id, o_orderkey * 7 % 61 AS x, o_orderkey * 5 % 53 AS y, o_orderkey * 3 % 47 AS z FROM orders WHERE o_orderkey % 50 = 0),
d AS (SELECT p.id, c.branch_id, c.idx, pow(p.x - c.x, 2) + pow(p.y - c.y, 2) + pow(p.z - c.z, 2) AS d2 FROM p CROSS JOIN centreline c)
SELECT id, arg_min(branch_id, row(d2, branch_id, idx)) AS branch_id, CAST(arg_min(idx, row(d2, branch_id, idx)) AS INT) AS idx, min(d2) AS d2 FROM d GROUP BY id""")
def _(s, d):
    o = F.col("o_orderkey")
    surface = V.table(s, d, "orders").where(o % 50 == 0).select(o.alias("id"), (o * 7 % 61).alias("x"), (o * 5 % 53).alias("y"), (o * 3 % 47).alias("z")).distinct()
    return detect.nearest(surface, V.centreline(s, d))


SKIN = V.CENTRELINE + """, skin AS (SELECT o_orderkey AS id, o_custkey % (SELECT max(user_id) + 1 FROM events) AS branch_id, 1 + o_orderkey % 20 AS idx, o_totalprice / 20000 AS d2 FROM orders)"""
BASE = "base AS (SELECT branch_id, greatest(median(radius), 1e-6) AS baseline FROM centreline GROUP BY branch_id)"


def _skin(s, d):
    branch = F.col("o_custkey") % (V.table(s, d, "events").agg(F.max("user_id")).first()[0] + 1)
    return V.table(s, d, "orders").select(F.col("o_orderkey").alias("id"), branch.alias("branch_id"), (1 + F.col("o_orderkey") % 20).alias("idx"), (F.col("o_totalprice") / 20000).alias("d2"))


@query("a4_widest_bulges", f"WITH {SKIN}, {BASE}, w AS (SELECT branch_id, idx, max(sqrt(d2)) AS mm FROM skin GROUP BY ALL) SELECT branch_id, CAST(idx AS INT) AS idx, round(greatest(radius, coalesce(mm, 0)) / baseline, 6) AS br FROM centreline JOIN base USING (branch_id) LEFT JOIN w USING (branch_id, idx)")
def _(s, d):
    points = V.centreline(s, d).select("branch_id", "idx", "radius")
    return _rounded(detect.bulges(_skin(s, d), points, detect.baseline(points)).select("branch_id", "idx", "br"), "br", digits=6)


@query("jn5_points_by_baseline", f"WITH {V.CENTRELINE}, {BASE} SELECT branch_id, CAST(idx AS INT) AS idx, round(radius / baseline, 6) AS ratio FROM centreline JOIN base USING (branch_id)")
def _(s, d):
    points = V.centreline(s, d)
    return _rounded(points.join(detect.baseline(points), "branch_id").select("branch_id", "idx", (F.col("radius") / F.col("baseline")).alias("ratio")), "ratio", digits=6)


@query("jn9_candidates_with_branches", CAND + ", l AS (SELECT user_id AS branch_id, count(*) AS n_on_branch, sum(value) AS length_mm FROM events GROUP BY user_id) SELECT branch_id, CAST(first AS INT) AS first, n_on_branch, round(length_mm, 4) AS length_mm, CAST(NULL AS VARCHAR) AS anatomical_label FROM c JOIN l USING (branch_id)")
def _(s, d):
    branches = V.table(s, d, "events").groupBy(F.col("user_id").alias("branch_id")).agg(F.count("*").alias("n_on_branch"), F.sum("value").alias("length_mm"))
    out = detect.with_branches(detect.candidates(V.centreline(s, d)), detect.labelled(branches))
    return _rounded(out.select("branch_id", "first", "n_on_branch", "length_mm", "anatomical_label"), "length_mm")


DECIDED = """, told AS (SELECT user_id AS branch_id, event_id % 40 + 1 AS first, CASE event_id % 3 WHEN 0 THEN 'NORMAL' WHEN 1 THEN 'SACCULAR' ELSE 'FUSIFORM' END AS type, ts AS told_at FROM events),
last AS (SELECT branch_id, first, arg_max(type, row(told_at, type)) AS type FROM told GROUP BY ALL)"""


@query("e2_decisions", CAND + DECIDED + " SELECT c.branch_id, CAST(c.first AS INT) AS first, coalesce(last.type, 'UNKNOWN') AS type FROM c LEFT JOIN last USING (branch_id, first)")
def _(s, d):
    e = F.col("event_id")
    kind = F.when(e % 3 == 0, "NORMAL").when(e % 3 == 1, "SACCULAR").otherwise("FUSIFORM")
    told = V.table(s, d, "events").select(F.col("user_id").alias("branch_id"), (e % 40 + 1).cast("int").alias("first"), kind.alias("type"), F.col("ts").alias("at"))
    return detect.review(detect.candidates(V.centreline(s, d)), told).select("branch_id", "first", "type")


def _prune(rounds: int) -> str:
    out = f"WITH {V.EDGES}, e0 AS (SELECT * FROM edges)"
    for i in range(rounds):
        out += f", d{i} AS (SELECT n, count(*) AS c FROM (SELECT u AS n FROM e{i} UNION ALL SELECT v FROM e{i} WHERE u <> v) GROUP BY n), e{i + 1} AS (SELECT e.* FROM e{i} e JOIN d{i} a ON a.n = e.u JOIN d{i} b ON b.n = e.v WHERE NOT ((a.c = 1 OR b.c = 1) AND e.length_mm < 3.0))"
    return out


@query("n5_prune_rounds", _prune(6) + " SELECT u, v, length_mm FROM e6")
def _(s, d):
    return graph.pruned(V.edges(s, d))


@query("a9_tree_statistics", f"WITH {V.EDGES}, d AS (SELECT n, count(*) AS c FROM (SELECT u AS n FROM edges UNION ALL SELECT v FROM edges WHERE u <> v) GROUP BY n) SELECT count(*) AS n_nodes, count(*) FILTER (c = 1) AS n_ends, count(*) FILTER (c >= 3) AS n_forks, (SELECT count(*) FROM edges) AS n_branches, (SELECT round(sum(length_mm), 2) FROM edges) AS length_mm FROM d")
def _(s, d):
    return _rounded(graph.statistics(V.edges(s, d)), "length_mm", digits=2)


@query("a13_node_degrees", f"WITH {V.EDGES} SELECT n AS node, count(*) AS degree FROM (SELECT u AS n FROM edges UNION ALL SELECT v FROM edges WHERE u <> v) GROUP BY n")
def _(s, d):
    return graph.node_degrees(V.edges(s, d))


SEG = f"WITH {V.CENTRELINE}, g AS (SELECT branch_id, idx, 511 - x AS x, y, z, lead(511 - x) OVER w AS x2, lead(y) OVER w AS y2, lead(z) OVER w AS z2 FROM centreline WINDOW w AS (PARTITION BY branch_id ORDER BY idx)), s AS (SELECT *, sqrt(pow((x2 - x) * 0.5, 2) + pow((y2 - y) * 0.5, 2) + pow((z2 - z) * 1.2, 2)) AS mm FROM g WHERE x2 IS NOT NULL)"


@query("n10_segments", SEG + " SELECT branch_id, CAST(idx AS INT) AS idx, x, y, z, x2, y2, z2, round(mm, 4) AS mm FROM s")
def _(s, d):
    return _rounded(graph.segments(V.centreline(s, d), (0.5, 0.5, 1.2), 512), "mm")


@query("n4_branch_lengths", SEG + " SELECT branch_id, round(sum(mm), 3) AS length_mm FROM s GROUP BY branch_id")
def _(s, d):
    return _rounded(graph.lengths(V.centreline(s, d), (0.5, 0.5, 1.2)), "length_mm", digits=3)


ALONG = f"""WITH {V.CENTRELINE}, p0 AS (SELECT branch_id, idx, x * 0.5e0 AS x, y * 0.5e0 AS y, z * 1.2e0 AS z FROM centreline),
a AS (SELECT branch_id, idx, {', '.join(f"coalesce(lag({c}) OVER w, {c}) AS {c}0, {c} AS {c}1, lead({c}) OVER w AS {c}2, coalesce(lead({c}, 2) OVER w, lead({c}) OVER w) AS {c}3" for c in 'xyz')} FROM p0 WINDOW w AS (PARTITION BY branch_id ORDER BY idx)),
b AS (SELECT *, sqrt(pow(x2 - x1, 2) + pow(y2 - y1, 2) + pow(z2 - z1, 2)) AS mm FROM a WHERE x2 IS NOT NULL),
c AS (SELECT *, sum(mm) OVER (PARTITION BY branch_id ORDER BY idx) AS upto FROM b),
s AS (SELECT *, upto - mm AS start, max(upto) OVER (PARTITION BY branch_id) AS total, idx = min(idx) OVER (PARTITION BY branch_id) AS is_first FROM c),
lh AS (SELECT *, CASE WHEN is_first THEN 0 ELSE floor(start / 0.5e0) + 1 END AS low, least(CASE WHEN upto >= total THEN ceil(total / 0.5e0) ELSE floor(upto / 0.5e0) END, ceil(total / 0.5e0)) AS high FROM s),
sm AS (SELECT *, unnest(generate_series(CAST(low AS BIGINT), CAST(high AS BIGINT))) AS i FROM lh WHERE high >= low AND (mm > 0 OR is_first)),
pl AS (SELECT *, CASE WHEN mm > 0 THEN (least(i * 0.5e0, total) - start) / mm ELSE 0 END AS u FROM sm)"""
CURVE = "0.5e0 * (2 * {0}1 + ({0}2 - {0}0) * u + (2 * {0}0 - 5 * {0}1 + 4 * {0}2 - {0}3) * u * u + (3 * {0}1 - {0}0 - 3 * {0}2 + {0}3) * u * u * u)"


@query("n11_arc_lengths", ALONG + " SELECT branch_id, CAST(idx AS INT) AS idx, round(mm, 4) + 0e0 AS mm, round(start, 4) + 0e0 AS start, round(upto, 4) + 0e0 AS upto, round(total, 4) + 0e0 AS total FROM s")
def _(s, d):
    return _rounded(graph.arc_lengths(V.centreline(s, d), (0.5, 0.5, 1.2)), "mm", "start", "upto", "total")


@query("n12_located_samples", ALONG + " SELECT branch_id, i, CAST(idx AS INT) AS idx, round(u, 4) + 0e0 AS t FROM pl")
def _(s, d):
    return _rounded(graph.located(V.centreline(s, d), 0.5, (0.5, 0.5, 1.2)), "t")


@query("n13_resampled_paths", ALONG + " SELECT branch_id, i, " + ", ".join(f"round({CURVE.format(c)}, 4) + 0e0 AS {c}" for c in "xyz") + " FROM pl")
def _(s, d):
    return _rounded(graph.resampled(V.centreline(s, d), 0.5, (0.5, 0.5, 1.2)), "x", "y", "z")


def _walk(edges: str) -> str:
    """Chains of edges(edge, u, v, mm), from both ends, step by step."""
    return edges + """, deg AS (SELECT n, count(*) AS c FROM (SELECT u AS n FROM edges UNION ALL SELECT v FROM edges WHERE u <> v) GROUP BY n), ways AS (SELECT edge, u AS a, v AS b, mm FROM edges UNION ALL SELECT edge, v, u, mm FROM edges),
walk(start, first, edge, node, mm, n) AS (SELECT a, edge, edge, b, mm, 1 FROM ways JOIN deg ON deg.n = a WHERE c <> 2 UNION ALL
  SELECT start, first, ways.edge, b, walk.mm + ways.mm, walk.n + 1 FROM walk JOIN deg ON deg.n = walk.node AND c = 2 JOIN ways ON ways.a = walk.node AND ways.edge <> walk.edge),
chain AS (SELECT start AS u, node AS v, first AS branch, mm, walk.n AS parts FROM walk JOIN deg ON deg.n = node WHERE c <> 2 AND (start, first) <= (node, edge))"""


LEFT = _prune(6).replace("WITH edges AS", "WITH RECURSIVE tree AS").replace("FROM edges)", "FROM tree)")


@query("n6_merge_degree_2", _walk(LEFT + ", edges AS (SELECT u AS edge, u, v, length_mm AS mm FROM e6)") + " SELECT branch, u, v, round(mm, 9) AS length_mm, parts FROM chain")
def _(s, d):
    return _rounded(graph.merged(graph.pruned(V.edges(s, d)).withColumn("edge", F.col("u"))), "length_mm", digits=9)


HALF_26 = OFF.format("dz > 0 OR (dz = 0 AND (dy > 0 OR (dy = 0 AND dx > 0)))")
PATHS = _walk(f"WITH RECURSIVE {V.VOX}, p AS (SELECT *, ((CAST(study AS BIGINT) * 4096 + z) * 64 + y) * 64 + x AS id FROM vox WHERE v > 0.18), edges AS (SELECT m.id * 16777216 * 256 + n.id AS edge, m.id AS u, n.id AS v, 0e0 AS mm FROM p m CROSS JOIN {HALF_26} o JOIN p n ON {NEAR})")


@query("n3_trace_branches", PATHS + " SELECT CAST(u // 16777216 AS INT) AS study, CAST(u // 4096 % 4096 AS INT) AS uz, CAST(u // 64 % 64 AS INT) AS uy, CAST(u % 64 AS INT) AS ux, CAST(v // 4096 % 4096 AS INT) AS vz, CAST(v // 64 % 64 AS INT) AS vy, CAST(v % 64 AS INT) AS vx, parts + 1 AS points FROM chain")
def _(s, d):
    ends = [F.col(f"{e}.{a}").cast("int").alias(f"{e}{a}") for e in "uv" for a in "zyx"]
    return graph.traced(V.mask(s, d)).groupBy("study", "branch", "u", "v").agg(F.count("*").alias("points")).select(F.col("study").cast("int").alias("study"), *ends, "points")


TOUCH = " AND ".join(f"abs(u // {k} % {m} - v // {k} % {m}) <= 1" for k, m in ((4096, 4096), (64, 64), (1, 64)))


@query("n3_contracted_branches", PATHS + f""", fk AS (SELECT n FROM deg WHERE c >= 3), lk AS (SELECT a, b FROM ways JOIN fk f ON f.n = a JOIN fk g ON g.n = b),
cl(n, seen) AS (SELECT n, n FROM fk UNION SELECT cl.n, lk.b FROM cl JOIN lk ON lk.a = cl.seen), rep AS (SELECT n, min(seen) AS r FROM cl GROUP BY n),
qu AS (SELECT u, v, coalesce(a.r, u) AS cu, coalesce(b.r, v) AS cv, parts + 1 AS n FROM chain LEFT JOIN rep a ON a.n = u LEFT JOIN rep b ON b.n = v)
SELECT CAST(u // 16777216 AS INT) AS study, CAST(least(cu, cv) % 16777216 AS INT) AS u_in_study, CAST(greatest(cu, cv) % 16777216 AS INT) AS v_in_study, n + CAST(u <> cu AS INT) + CAST(v <> cv AS INT) AS points
FROM qu WHERE NOT (cu = cv AND n <= 3 AND {TOUCH})""")
def _(s, d):
    at = lambda e: ((F.col(f"{e}.z") * 64 + F.col(f"{e}.y")) * 64 + F.col(f"{e}.x")).cast("int").alias(f"{e}_in_study")
    mask = V.mask(s, d)
    rows = graph.contracted(graph.traced(mask), mask)
    return rows.groupBy("study", "branch", "u", "v").agg(F.count("*").alias("points")).select(F.col("study").cast("int").alias("study"), at("u"), at("v"), "points")


POINTS = PATHS.replace("walk(start, first, edge, node, mm, n) AS (SELECT a, edge, edge, b, mm, 1 FROM", "walk(start, first, edge, node, mm, n, nodes) AS (SELECT a, edge, edge, b, mm, 1, [a, b] FROM").replace("walk.n + 1 FROM walk", "walk.n + 1, list_append(walk.nodes, b) FROM walk").replace("walk.n AS parts FROM walk", "walk.n AS parts, nodes FROM walk")


@query("n3_traced_points", POINTS + """, pt AS (SELECT u, v, unnest(nodes) AS id, unnest(range(len(nodes))) AS idx FROM chain)
SELECT CAST(u // 16777216 AS INT) AS study, CAST(u % 16777216 AS INT) AS u_in_study, CAST(v % 16777216 AS INT) AS v_in_study, idx, CAST(id // 4096 % 4096 AS INT) AS z, CAST(id // 64 % 64 AS INT) AS y, CAST(id % 64 AS INT) AS x FROM pt""")
def _(s, d):
    at = lambda e: ((F.col(f"{e}.z") * 64 + F.col(f"{e}.y")) * 64 + F.col(f"{e}.x")).cast("int").alias(f"{e}_in_study")
    rows = graph.traced(V.mask(s, d)).select(F.col("study").cast("int").alias("study"), at("u"), at("v"), F.col("idx").cast("long").alias("idx"), "z", "y", "x")
    return rows.select("study", "u_in_study", "v_in_study", "idx", *(F.col(a).cast("int").alias(a) for a in "zyx"))


@query("t1_skeleton")
def _(s, d):
    return thinning.thinned(V.vox(s, d).where("v > -0.05"))


SHIFTS = "(SELECT dy, dx FROM (SELECT unnest(range(-10, 1)) AS dy), (SELECT unnest(range(-10, 11)) AS dx) WHERE dy < 0 OR dx < 0)"


@query("d1_nlm_denoise", f"""WITH {V.IMAGES}, d AS (SELECT a.z, a.y, a.x, o.dy, o.dx, a.v AS p, b.v AS q, b.y AS qy, b.x AS qx, pow(a.v - b.v, 2) AS s FROM images a CROSS JOIN {SHIFTS} o JOIN images b ON b.z = a.z AND b.y = (a.y + o.dy + 32) % 32 AND b.x = (a.x + o.dx + 32) % 32),
f AS (SELECT d.z, (d.y - i + 32) % 32 AS y, (d.x - j + 32) % 32 AS x, dy, dx, sum(s) AS far FROM d, range(2) i(i), range(2) j(j) GROUP BY ALL),
w AS (SELECT z, y, x, dy, dx, p, q, qy, qx, CAST(floor(36e0 / (36e0 + greatest(far - 4050, 0)) * 1000 + 0.5) AS BIGINT) AS w FROM d JOIN f USING (z, y, x, dy, dx)),
c AS (SELECT z, y, x, w, w * q AS t FROM w UNION ALL SELECT z, qy, qx, w, w * p FROM w WHERE y + dy >= 0 AND x + dx BETWEEN 0 AND 31),
t AS (SELECT z, y, x, sum(w) AS w, max(w) AS top, sum(t) AS t FROM c GROUP BY ALL)
SELECT {AT}, round(CASE WHEN top = 0 THEN v ELSE (t + v * top) / (w + top) END, 4) AS v FROM images JOIN t USING (z, y, x)""")
def _(s, d):
    return _rounded(denoise.denoised(V.images(s, d)), "v")


@query("d3_nlm_colour", f"""WITH {V.COLOURS}, d AS (SELECT a.z, a.y, a.x, o.dy, o.dx, a.r AS ar, a.g AS ag, a.b AS ab, b.r AS br, b.g AS bg, b.b AS bb, b.y AS qy, b.x AS qx, pow(a.r - b.r, 2) + pow(a.g - b.g, 2) + pow(a.b - b.b, 2) AS s FROM colours a CROSS JOIN {SHIFTS} o JOIN colours b ON b.z = a.z AND b.y = (a.y + o.dy + 32) % 32 AND b.x = (a.x + o.dx + 32) % 32),
f AS (SELECT d.z, (d.y - i + 32) % 32 AS y, (d.x - j + 32) % 32 AS x, dy, dx, sum(s) AS far FROM d, range(2) i(i), range(2) j(j) GROUP BY ALL),
w AS (SELECT d.*, CAST(floor(68.0625e0 / (68.0625e0 + greatest(far - 12150, 0)) * 1000 + 0.5) AS BIGINT) AS w FROM d JOIN f USING (z, y, x, dy, dx)),
c AS (SELECT z, y, x, w, w * br AS tr, w * bg AS tg, w * bb AS tb FROM w UNION ALL SELECT z, qy, qx, w, w * ar, w * ag, w * ab FROM w WHERE y + dy >= 0 AND x + dx BETWEEN 0 AND 31),
t AS (SELECT z, y, x, CAST(sum(w) AS BIGINT) AS w, max(w) AS top, CAST(sum(tr) AS BIGINT) AS tr, CAST(sum(tg) AS BIGINT) AS tg, CAST(sum(tb) AS BIGINT) AS tb FROM c GROUP BY ALL)
SELECT {AT}, CAST(CASE WHEN top = 0 THEN r ELSE (tr + r * top) // (w + top) END AS INT) AS r, CAST(CASE WHEN top = 0 THEN g ELSE (tg + g * top) // (w + 2 * top) END AS INT) AS g, CAST(CASE WHEN top = 0 THEN b ELSE (tb + b * top) // (w + 3 * top) END AS INT) AS b FROM colours JOIN t USING (z, y, x)""")
def _(s, d):
    return denoise.denoised_colour(V.colours(s, d))


@query("d2_nlm_settings", """SELECT event_id, CASE WHEN s <= 0 THEN 5 WHEN s <= 15 THEN 1 WHEN s <= 30 THEN 2 WHEN s <= 45 THEN 3 WHEN s <= 75 THEN 4 ELSE 5 END AS n, CASE WHEN s > 0 AND s <= 30 THEN 10 ELSE 17 END AS w, CAST(CASE WHEN s <= 0 THEN 0.3 WHEN s <= 30 THEN 0.4 WHEN s <= 75 THEN 0.35 ELSE 0.3 END AS DOUBLE) AS h
FROM (SELECT event_id, event_id % 91 - 5 AS s FROM events)""")
def _(s, d):
    return V.table(s, d, "events").select("event_id", denoise.settings_column(F.col("event_id") % 91 - 5).alias("r")).select("event_id", "r.*")


@query("d2_nlm_colour_settings", """SELECT event_id, CASE WHEN s <= 0 THEN 3 WHEN s <= 25 THEN 1 WHEN s <= 55 THEN 2 ELSE 3 END AS n, CASE WHEN s > 0 AND s <= 25 THEN 10 ELSE 17 END AS w, CAST(CASE WHEN s <= 0 THEN 0.35 WHEN s <= 25 THEN 0.55 WHEN s <= 55 THEN 0.4 ELSE 0.35 END AS DOUBLE) AS h
FROM (SELECT event_id, event_id % 91 - 5 AS s FROM events)""")
def _(s, d):
    return V.table(s, d, "events").select("event_id", denoise.settings_column(F.col("event_id") % 91 - 5, denoise.COLOUR).alias("r")).select("event_id", "r.*")


@query("d4_noise_estimate", f"""WITH {V.IMAGES}, c AS (SELECT a.z, a.y, a.x, sum(b.v * CASE WHEN i = 0 THEN -2 ELSE 1 END * CASE WHEN j = 0 THEN -2 ELSE 1 END) AS v FROM images a, (SELECT unnest([-1, 0, 1]) AS i), (SELECT unnest([-1, 0, 1]) AS j), images b
WHERE a.y BETWEEN 6 AND 25 AND a.x BETWEEN 6 AND 25 AND b.z = a.z AND b.y = a.y + 6 * i AND b.x = a.x + 6 * j GROUP BY ALL) SELECT 1 AS study, z, round(sqrt(pi() / 2) / (6 * 20 * 20) * sum(abs(v)), 4) AS sigma FROM c GROUP BY z""")
def _(s, d):
    return _rounded(denoise.noise(V.images(s, d)), "sigma")


def _paths(s, d):
    return V.centreline(s, d).select("branch_id", F.col("idx").alias("i"), *(F.col(a).cast("double").alias(a) for a in "xyz"))


NEXT = f"WITH {V.CENTRELINE}, n AS (SELECT branch_id, CAST(idx AS INT) AS i, " + ", ".join(f"CAST(coalesce(lead({a}) OVER w, {a}) - coalesce(lag({a}) OVER w, {a}) AS DOUBLE) AS d{a}" for a in "xyz") + " FROM centreline WINDOW w AS (PARTITION BY branch_id ORDER BY idx)), m AS (SELECT *, sqrt(dx * dx + dy * dy + dz * dz) AS size FROM n)"


def _spread(df: DataFrame, *vectors: str) -> DataFrame:
    cols = {f"{v[0]}_{a}": F.round(F.col(v)[k], 4) + 0.0 for v in vectors for k, a in enumerate("xyz")}
    return df.select("branch_id", "i", *(c.alias(n) for n, c in cols.items()))


@query("n14_tangents", NEXT + " SELECT branch_id, i, " + ", ".join(f"CASE WHEN size > 0 THEN round(d{a} / size, 4) + 0e0 END AS t_{a}" for a in "xyz") + " FROM m")
def _(s, d):
    return _spread(reform.tangents(_paths(s, d)), "tangent")


CARRIED = NEXT.replace("WITH ", "WITH RECURSIVE ", 1) + """, t AS (SELECT branch_id, i, CASE WHEN size > 0 THEN dx / size END AS x, CASE WHEN size > 0 THEN dy / size END AS y, CASE WHEN size > 0 THEN dz / size END AS z FROM m),
c(branch_id, i, x, y, z, lx, ly, lz, p, q, r) AS (
  SELECT branch_id, 0, NULL::DOUBLE, NULL::DOUBLE, NULL::DOUBLE, NULL::DOUBLE, NULL::DOUBLE, NULL::DOUBLE, NULL::DOUBLE, NULL::DOUBLE, NULL::DOUBLE FROM t WHERE i = 1
  UNION ALL SELECT branch_id, i, x, y, z, CASE WHEN x IS NULL THEN lx ELSE x END, CASE WHEN x IS NULL THEN ly ELSE y END, CASE WHEN x IS NULL THEN lz ELSE z END, p / l, q / l, r / l FROM (
    SELECT *, CASE WHEN x IS NULL THEN 1 ELSE sqrt(p * p + q * q + r * r) END AS l FROM (
      SELECT branch_id, i, x, y, z, lx, ly, lz,
        CASE WHEN x IS NULL THEN p WHEN lx IS NULL THEN (CASE WHEN abs(z) > 0.9 THEN 0 ELSE y END) WHEN aa > 1e-8 THEN p * ca + (ay * r - az * q) * sa + ax * (ax * p + ay * q + az * r) * (1 - ca) ELSE p END AS p,
        CASE WHEN x IS NULL THEN q WHEN lx IS NULL THEN (CASE WHEN abs(z) > 0.9 THEN z ELSE -x END) WHEN aa > 1e-8 THEN q * ca + (az * p - ax * r) * sa + ay * (ax * p + ay * q + az * r) * (1 - ca) ELSE q END AS q,
        CASE WHEN x IS NULL THEN r WHEN lx IS NULL THEN (CASE WHEN abs(z) > 0.9 THEN -y ELSE 0 END) WHEN aa > 1e-8 THEN r * ca + (ax * q - ay * p) * sa + az * (ax * p + ay * q + az * r) * (1 - ca) ELSE r END AS r FROM (
          SELECT *, ax0 / w AS ax, ay0 / w AS ay, az0 / w AS az, cos(angle) AS ca, sin(angle) AS sa FROM (
            SELECT *, ax0 * ax0 + ay0 * ay0 + az0 * az0 AS aa, CASE WHEN ax0 * ax0 + ay0 * ay0 + az0 * az0 > 0 THEN sqrt(ax0 * ax0 + ay0 * ay0 + az0 * az0) ELSE 1 END AS w FROM (
              SELECT t.branch_id, t.i, t.x, t.y, t.z, c.lx, c.ly, c.lz, c.p, c.q, c.r, c.ly * t.z - c.lz * t.y AS ax0, c.lz * t.x - c.lx * t.z AS ay0, c.lx * t.y - c.ly * t.x AS az0,
                acos(greatest(-1e0, least(1e0, c.lx * t.x + c.ly * t.y + c.lz * t.z))) AS angle FROM c JOIN t ON t.branch_id = c.branch_id AND t.i = c.i + 1)))))),
b AS (SELECT *, y * r - z * q AS bx, z * p - x * r AS b_side, x * q - y * p AS bz FROM c WHERE i > 0 AND branch_id IN (SELECT branch_id FROM t WHERE i = 2)),
s AS (SELECT *, sqrt(bx * bx + b_side * b_side + bz * bz) AS bl FROM b)
SELECT branch_id, i, round(x, 4) + 0e0 AS t_x, round(y, 4) + 0e0 AS t_y, round(z, 4) + 0e0 AS t_z, round(p, 4) + 0e0 AS n_x, round(q, 4) + 0e0 AS n_y, round(r, 4) + 0e0 AS n_z, round(bx / bl, 4) + 0e0 AS b_x, round(b_side / bl, 4) + 0e0 AS b_y, round(bz / bl, 4) + 0e0 AS b_z FROM s"""


@query("n15_transported_frames", CARRIED)
def _(s, d):
    return _spread(reform.frames(_paths(s, d)), "tangent", "normal", "binormal")


@query("n18_plane_frames", NEXT + """, t AS (SELECT branch_id, i, CASE WHEN size > 0 THEN dx / size ELSE 1 END AS x, CASE WHEN size > 0 THEN dy / size ELSE 0 END AS y, CASE WHEN size > 0 THEN dz / size ELSE 0 END AS z FROM m),
up AS (SELECT *, CASE WHEN abs(y) > 0.9 THEN 0 ELSE -z END AS p, CASE WHEN abs(y) > 0.9 THEN z ELSE 0 END AS q, CASE WHEN abs(y) > 0.9 THEN -y ELSE x END AS r FROM t), u AS (SELECT branch_id, i, x, y, z, p / l AS p, q / l AS q, r / l AS r FROM (SELECT *, sqrt(p * p + q * q + r * r) AS l FROM up))
SELECT branch_id, i, round(x, 4) + 0e0 AS t_x, round(y, 4) + 0e0 AS t_y, round(z, 4) + 0e0 AS t_z, round(p, 4) + 0e0 AS n_x, round(q, 4) + 0e0 AS n_y, round(r, 4) + 0e0 AS n_z, round(y * r - z * q, 4) + 0e0 AS b_x, round(z * p - x * r, 4) + 0e0 AS b_y, round(x * q - y * p, 4) + 0e0 AS b_z FROM u""")
def _(s, d):
    return _spread(reform.plane_frames(_paths(s, d)), "tangent", "normal", "binormal")


STRAIGHT = f"""WITH {V.VOX}, {V.AXIS}, p AS (SELECT study, branch_id, i AS "row", CAST(c AS INT) AS col, x + o * 0.8e0 * cos(pi() / 6) AS x, y + o * 0.6e0 * cos(pi() / 6) AS y, z + o * sin(pi() / 6) AS z FROM axis CROSS JOIN (SELECT c, (c - 4.5e0) * 0.8e0 AS o FROM range(9) r(c))),
k AS (SELECT p.*, CAST(floor(x) AS INT) + dx AS kx, CAST(floor(y) AS INT) + dy AS ky, CAST(floor(z) AS INT) + dz AS kz, abs(1 - dx - (x - floor(x))) * abs(1 - dy - (y - floor(y))) * abs(1 - dz - (z - floor(z))) AS share FROM p, range(2) a(dx), range(2) b(dy), range(2) c(dz)),
img AS (SELECT k.study, branch_id, "row", col, sum(share * coalesce(v.v, 0)) AS v FROM k LEFT JOIN vox v ON v.study = k.study AND v.x = kx AND v.y = ky AND v.z = kz GROUP BY ALL)"""


@query("n16_straightened", STRAIGHT + ' SELECT study, branch_id, "row", col, round(v, 4) + 0e0 AS v FROM img')
def _(s, d):
    return _rounded(reform.straightened(V.axis(s, d), V.vox(s, d), 7.0, 0.8, 30.0), "v")


@query("n17_padded", STRAIGHT + """, f AS (SELECT study, study AS branch_id, unnest(range(CAST(ceil(count(*) * 0.93e0 / 0.8e0) AS BIGINT))) AS r FROM axis GROUP BY study)
SELECT f.study, f.branch_id, CAST(r AS INT) AS "row", CAST(c AS INT) AS col, round(coalesce(img.v, 0), 4) + 0e0 AS v FROM f CROSS JOIN range(9) g(c) LEFT JOIN img ON img.study = f.study AND img."row" = r AND img.col = c""")
def _(s, d):
    lengths = V.axis(s, d).groupBy("study", "branch_id").agg((F.count("*") * 0.93).alias("length_mm"))
    return _rounded(reform.padded(reform.straightened(V.axis(s, d), V.vox(s, d), 7.0, 0.8, 30.0), lengths, 0.8), "v")


@query("n19_unwrapped_rays", f"""WITH {V.MASK.replace('0.18', '-0.1')}, {V.AXIS}, r AS (SELECT study, branch_id, i, CAST(a AS INT) AS angle, x, y, z, 0.8e0 * cos(pi() * a / 6) AS dx, 0.6e0 * cos(pi() * a / 6) AS dy, sin(pi() * a / 6) AS dz FROM axis, range(12) r(a)),
w AS (SELECT r.*, n, CAST(floor(x + n * 0.5e0 * dx + 0.5e0) AS INT) AS kx, CAST(floor(y + n * 0.5e0 * dy + 0.5e0) AS INT) AS ky, CAST(floor(z + n * 0.5e0 * dz + 0.5e0) AS INT) AS kz FROM r, range(1, 14) s(n)),
o AS (SELECT w.study, branch_id, i, angle, min(n) AS n FROM w LEFT JOIN mask m ON m.study = w.study AND m.x = kx AND m.y = ky AND m.z = kz WHERE m.x IS NULL GROUP BY ALL)
SELECT study, branch_id, i, angle, round(coalesce(n, 13) * 0.5e0 * sqrt(pow(dx * 0.5, 2) + pow(dy * 0.5, 2) + pow(dz * 1.2, 2)), 4) AS mm FROM r LEFT JOIN o USING (study, branch_id, i, angle)""")
def _(s, d):
    mask = V.vox(s, d).where("v > -0.1")
    return _rounded(reform.unwrapped(V.axis(s, d), mask, 12, 6.0, 0.5, (0.5, 0.5, 1.2)), "mm")


@query("jn6_gather", f"WITH {V.CENTRELINE}, {V.VOX} SELECT c.branch_id % 10 AS study, c.branch_id, CAST(c.idx AS INT) AS idx, c.z, c.y, c.x, coalesce(round(v, 4), 0) AS value FROM centreline c LEFT JOIN vox v ON v.study = c.branch_id % 10 AND v.z = c.z AND v.y = c.y AND v.x = c.x")
def _(s, d):
    points = V.centreline(s, d).select((F.col("branch_id") % 10).alias("study"), "branch_id", "idx", "z", "y", "x")
    return _rounded(reform.gathered(points, V.vox(s, d), "value"), "value")


@query("jn8_vertex_voxel", f"WITH {V.CENTRELINE} SELECT branch_id, CAST(idx AS INT) AS idx, CAST(greatest(0, least(63, 63 - floor(br * 7 / 0.5e0 + 0.5e0))) AS INT) AS vx, CAST(greatest(0, least(31, floor(si * 20 / 0.5e0 + 0.5e0))) AS INT) AS vy, CAST(greatest(0, least(15, floor(k * 3 / 1.2e0 + 0.5e0))) AS INT) AS vz FROM centreline")
def _(s, d):
    mesh = V.centreline(s, d).select("branch_id", "idx", (F.col("br") * 7).alias("x"), (F.col("si") * 20).alias("y"), (F.col("k") * 3).alias("z"))
    return display.vertex_voxel(mesh, (64, 32, 16), (0.5, 0.5, 1.2)).select("branch_id", "idx", "vx", "vy", "vz")


SHARE = "greatest(0, least(1, (br - 1) / 0.5e0))"


@query("e6_bulge_colours", f"""WITH {V.CENTRELINE}, h AS (SELECT branch_id, idx, CAST(trunc({SHARE} * 255) AS INT) AS entry, (1 - {SHARE}) * 4 AS s FROM centreline), p AS (SELECT *, CAST(floor(s) AS INT) AS sixth, CAST(floor((s - floor(s)) * 255 + 0.5e0) AS INT) AS up, CAST(floor((1 - (s - floor(s))) * 255 + 0.5e0) AS INT) AS down FROM h)
SELECT branch_id, CAST(idx AS INT) AS idx, entry, CASE sixth WHEN 0 THEN 255 WHEN 1 THEN down WHEN 4 THEN up ELSE 0 END AS r, CASE sixth WHEN 0 THEN up WHEN 1 THEN 255 WHEN 2 THEN 255 WHEN 3 THEN down ELSE 0 END AS g, CASE sixth WHEN 0 THEN 0 WHEN 1 THEN 0 WHEN 2 THEN up ELSE 255 END AS b FROM p""")
def _(s, d):
    return V.centreline(s, d).select("branch_id", "idx", display.bulge_index(F.col("br")).alias("entry"), display.hue_colour(F.col("br")).alias("c")).select("branch_id", "idx", "entry", "c.*")


@query("e7_boxes", f"""WITH {V.CENTRELINE} SELECT branch_id, CAST(idx AS INT) AS idx, round((31 - x + 0.5e0) / 32 - 0.5e0, 9) AS cx, round((y + 0.5e0) / 32 - 0.5e0, 9) AS cy, round((z + 0.5e0) / 24 - 0.5e0, 9) AS cz,
round(least(5, br * 1.5e0) * 2.4e0 / 16, 9) AS bw, round(least(5, br * 1.5e0) * 2.4e0 / 16, 9) AS bh, round(least(5, br * 1.5e0) * 2.4e0 / 28.8e0, 9) AS bd FROM centreline""")
def _(s, d):
    cols = ("cx", "cy", "cz", "bw", "bh", "bd")
    boxes = display.box(V.centreline(s, d).withColumnRenamed("br", "max_br"), (32, 32, 24), (0.5, 0.5, 1.2))
    return _rounded(boxes.select("branch_id", "idx", *cols), *cols, digits=9)


@query("e9_thumbnails", f"WITH {V.CENTRELINE} SELECT branch_id, CAST(idx AS INT) AS idx, greatest(0, x * 9 - 40) AS x0, least(288, x * 9 + 40) AS x1, greatest(0, y * 9 - 40) AS y0, least(270, y * 9 + 40) AS y1, CAST(trunc(greatest(0, least(255, radius / 15 * 255))) AS INT) AS grey, (z * 200 + y) * 256 + x AS linear FROM centreline")
def _(s, d):
    rows = V.centreline(s, d)
    linear = display.linear_index(F.col("x"), F.col("y"), F.col("z"), 256, 200).alias("linear")
    rows = rows.select("branch_id", "idx", (F.col("x") * 9).alias("x"), (F.col("y") * 9).alias("y"), display.grey_level(F.col("radius")).alias("grey"), linear)
    return display.thumbnail(rows, (288, 270)).drop("x", "y")


@query("a12_branch_percent", "WITH b AS (SELECT user_id % 7 AS study, user_id AS branch_id, sum(value) AS length_mm FROM events GROUP BY ALL) SELECT study, branch_id, round(length_mm, 4) AS length_mm, CAST(floor(length_mm / max(length_mm) OVER (PARTITION BY study) * 100 + 0.5) AS INT) AS percent FROM b")
def _(s, d):
    b = V.table(s, d, "events").groupBy((F.col("user_id") % 7).alias("study"), F.col("user_id").alias("branch_id")).agg(F.sum("value").alias("length_mm"))
    return _rounded(display.branch_percent(b), "length_mm")


SHOWN = CAND + f", s AS (SELECT *, {SCORE} AS score, CASE WHEN branch_id % 3 = 0 THEN 'NORMAL' ELSE 'UNKNOWN' END AS type FROM c)"


def _shown(s, d):
    found = detect.scored(detect.candidates(V.centreline(s, d)))
    return found.withColumn("type", F.when(F.col("branch_id") % 3 == 0, "NORMAL").otherwise("UNKNOWN"))


@query("a11_review_status", SHOWN + " SELECT count(*) AS n, count(*) FILTER (type <> 'NORMAL') AS suspected, count(*) FILTER (score > 70) AS high_risk FROM s")
def _(s, d):
    return display.status(_shown(s, d))


@query("e1_suspected", SHOWN + " SELECT branch_id, CAST(first AS INT) AS first, round(score, 4) AS score FROM s WHERE type <> 'NORMAL'")
def _(s, d):
    return _rounded(display.of_type(_shown(s, d), "suspected").select("branch_id", "first", "score"), "score")


@query("k3_report_lines", SHOWN + " SELECT branch_id, CAST(first AS INT) AS first, printf('Score: %5.1f | Aneurysm [%s] at (X:%d, Y:%d, Z:%d) | BulgeRatio: %5.2f | ShapeIndex: %.2f', score, type, first, peak, n_points, max_br, max_si) AS line FROM s")
def _(s, d):
    rows = _shown(s, d).withColumns({"x": F.col("first"), "y": F.col("peak"), "z": F.col("n_points")})
    return display.report(rows).select("branch_id", "first", "line")


RAYS_OF_CYLINDER = f"""WITH {V.MASK.replace('0.18', '-0.1')}, {V.AXIS},
nx AS (SELECT study, branch_id, i, x, y, z, {', '.join(f"coalesce(lead({c}) OVER w, {c}) - coalesce(lag({c}) OVER w, {c}) AS d{c}" for c in 'xyz')} FROM axis WINDOW w AS (PARTITION BY study, branch_id ORDER BY i)),
tg AS (SELECT *, dx / l AS tx, dy / l AS ty, dz / l AS tz FROM (SELECT *, sqrt(dx * dx + dy * dy + dz * dz) AS l FROM nx)),
up AS (SELECT *, CASE WHEN abs(ty) > 0.9 THEN 0 ELSE -tz END AS p0, CASE WHEN abs(ty) > 0.9 THEN tz ELSE 0 END AS q0, CASE WHEN abs(ty) > 0.9 THEN -ty ELSE tx END AS r0 FROM tg),
un AS (SELECT *, p0 / l2 AS p, q0 / l2 AS q, r0 / l2 AS r FROM (SELECT *, sqrt(p0 * p0 + q0 * q0 + r0 * r0) AS l2 FROM up)),
ry AS (SELECT study, branch_id, i, CAST(a AS INT) AS angle, x, y, z, cos(pi() * a / 6) * p + sin(pi() * a / 6) * (ty * r - tz * q) AS dx, cos(pi() * a / 6) * q + sin(pi() * a / 6) * (tz * p - tx * r) AS dy, cos(pi() * a / 6) * r + sin(pi() * a / 6) * (tx * q - ty * p) AS dz FROM un, range(12) g(a)),
wk AS (SELECT ry.*, n, CAST(floor(x + n * 0.5e0 * dx + 0.5e0) AS INT) AS kx, CAST(floor(y + n * 0.5e0 * dy + 0.5e0) AS INT) AS ky, CAST(floor(z + n * 0.5e0 * dz + 0.5e0) AS INT) AS kz FROM ry, range(1, 14) s(n)),
out AS (SELECT wk.study, branch_id, i, angle, min(n) AS n FROM wk LEFT JOIN mask m ON m.study = wk.study AND m.x = kx AND m.y = ky AND m.z = kz WHERE m.x IS NULL GROUP BY ALL),
rays AS (SELECT study, branch_id, i, angle, coalesce(n, 13) * 0.5e0 * sqrt(pow(dx * 0.5, 2) + pow(dy * 0.5, 2) + pow(dz * 1.2, 2)) AS mm FROM ry LEFT JOIN out USING (study, branch_id, i, angle))"""


def _cylinder(s, d):
    return reform.cylinder(V.axis(s, d).select("study", "branch_id", "i", "x", "y", "z"), V.vox(s, d).where("v > -0.1"), 12, 6.0, 0.5, (0.5, 0.5, 1.2))


@query("n20_cylinder", RAYS_OF_CYLINDER + " SELECT study, branch_id, i, array_to_string(list(CAST(CAST(round(mm * 1000) AS BIGINT) AS VARCHAR) ORDER BY angle), ' ') AS row_um FROM rays GROUP BY ALL")
def _(s, d):
    um = F.transform("mm", lambda v: F.round(v * 1000).cast("long").cast("string"))
    return reform.map_rows(_cylinder(s, d)).select("study", "branch_id", "i", F.array_join(um, " ").alias("row_um"))


@query("n21_anomalies", RAYS_OF_CYLINDER + """, md AS (SELECT study, branch_id, i, list_sort(list(mm))[7] AS median FROM rays GROUP BY ALL), en AS (SELECT study, branch_id, min(i) AS low, max(i) AS high FROM rays GROUP BY ALL),
an AS (SELECT rays.*, mm / median AS ratio FROM rays JOIN md USING (study, branch_id, i) JOIN en USING (study, branch_id) WHERE median > 0 AND i BETWEEN low + 2 AND high - 2 AND mm - median * 1.5e0 > 1e-9),
fi AS (SELECT study, branch_id, i, min(angle) AS angle, arg_min(ratio, angle) AS ratio FROM an GROUP BY ALL)
SELECT study, branch_id, i, angle, round(ratio, 4) AS ratio, round(least(1, greatest(0, (ratio - 1) / 1.5e0)), 4) AS score FROM fi""")
def _(s, d):
    return _rounded(reform.anomalies(_cylinder(s, d), 12), "ratio", "score")


@query("e8_camera_focus", f"WITH {V.CENTRELINE} SELECT branch_id, CAST(idx AS INT) AS idx, round((31 - x + 0.5e0) / 32 - 0.5e0, 9) AS fx, round((y + 0.5e0) / 32 - 0.5e0, 9) AS fy, round((z + 0.5e0) / 24 - 0.5e0, 9) AS fz FROM centreline")
def _(s, d):
    return _rounded(display.focus(V.centreline(s, d), (32, 32, 24)).select("branch_id", "idx", "fx", "fy", "fz"), "fx", "fy", "fz", digits=9)


@query("e10_details", SHOWN + """ SELECT branch_id, CAST(first AS INT) AS first, printf('=== Aneurysm Candidate Details ===\n\nVoxel Position : (X: %d, Y: %d, Z: %d)\nSaliency Score : %.2f / 100\nCurrent Type   : %s\n\n--- Morphological Features ---\nMax Bulge Ratio : %.3f (Threshold: 1.35)\nMax Shape Index : %.3f (Sphere: 1.0, Tube: 0.5)\nGaussian Curv.  : %.4f\nVessel Radius   : %.2f mm\nVolume Est.     : %.2f mm\u00b3\n\nStatus: %s',
  first, peak, n_points, CAST(round(CAST(CAST(score AS VARCHAR) AS DECIMAL(38, 20)), 2) AS DOUBLE), type, CAST(round(CAST(CAST(max_br AS VARCHAR) AS DECIMAL(38, 20)), 3) AS DOUBLE), CAST(round(CAST(CAST(max_si AS VARCHAR) AS DECIMAL(38, 20)), 3) AS DOUBLE), max_k, 2.5e0, 0e0, CASE WHEN type = 'NORMAL' THEN 'Cleared (NORMAL)' ELSE 'Active (Suspected)' END) AS details FROM s""")
def _(s, d):
    rows = _shown(s, d).withColumns({"x": F.col("first"), "y": F.col("peak"), "z": F.col("n_points"), "radius": F.lit(2.5), "volume": F.lit(None).cast("double")})
    return display.details(rows).select("branch_id", "first", "details")


@query("e12_grey_levels", f"WITH {V.CENTRELINE} SELECT branch_id, CAST(idx AS INT) AS idx, CAST(trunc(greatest(0, least(255, radius / 15 * 255))) AS INT) AS grey FROM centreline")
def _(s, d):
    return V.centreline(s, d).select("branch_id", "idx", display.grey_level(F.col("radius")).alias("grey"))


@query("e17_linear_index", f"WITH {V.CENTRELINE} SELECT branch_id, CAST(idx AS INT) AS idx, (z * 200 + y) * 256 + x AS linear FROM centreline")
def _(s, d):
    return V.centreline(s, d).select("branch_id", "idx", display.linear_index(F.col("x"), F.col("y"), F.col("z"), 256, 200).alias("linear"))


@query("o7_points_of_all_branches", f"WITH {V.CENTRELINE} SELECT x, y, z, count(*) AS n FROM (SELECT x, y, z FROM centreline WHERE k > 0 UNION ALL SELECT x, y, z FROM centreline WHERE k <= 0) GROUP BY ALL")
def _(s, d):
    p = V.centreline(s, d).select("x", "y", "z", "k")
    return p.where("k > 0").unionByName(p.where("k <= 0")).groupBy("x", "y", "z").agg(F.count("*").alias("n"))


META = "st AS (SELECT label AS study, 8 AS w, 8 AS h, count(*) AS d, 0.5e0 AS sx, 0.5e0 AS sy, CASE WHEN label % 3 = 0 THEN 2.5e0 ELSE 0.8e0 END AS sz, CASE WHEN label % 2 = 0 THEN 12e0 - label ELSE 0e0 END AS tilt, CASE WHEN label % 5 = 4 THEN 'MR' ELSE 'CT' END AS modality, CASE label % 7 WHEN 5 THEN 'CORONAL' WHEN 3 THEN 'SAGITTAL' ELSE 'AXIAL' END AS plane, 'raw' AS kind FROM embeddings GROUP BY label)"


def _studies(s, d):
    n = F.col("study")
    rows = V.table(s, d, "embeddings").groupBy(F.col("label").alias("study")).agg(F.count("*").alias("d"))
    plane = F.when(n % 7 == 5, "CORONAL").when(n % 7 == 3, "SAGITTAL").otherwise("AXIAL")
    return rows.select("study", F.lit(8).alias("w"), F.lit(8).alias("h"), "d", F.lit(0.5).alias("sx"), F.lit(0.5).alias("sy"), F.when(n % 3 == 0, 2.5).otherwise(0.8).alias("sz"), F.when(n % 2 == 0, 12.0 - n).otherwise(0.0).alias("tilt"),
                       F.when(n % 5 == 4, "MR").otherwise("CT").alias("modality"), plane.alias("plane"), F.lit("raw").alias("kind"))


@query("k4_derived_metadata", f"WITH {META} SELECT study, w, h, d, sx, sy, CASE WHEN modality = 'CT' AND plane = 'AXIAL' THEN least(sz, 1) ELSE sz END AS sz, CASE WHEN modality = 'CT' AND plane = 'AXIAL' THEN 0 ELSE tilt END AS tilt, modality, plane, 'raw_response' AS kind FROM st")
def _(s, d):
    return studies.derived(studies.upright(_studies(s, d)), "_response")


@query("g1_untilted", f"""WITH {V.VOX}, {META}, mm AS (SELECT study, max(z) AS mz, max(y) AS my, max(x) AS mx FROM vox GROUP BY study),
tu AS (SELECT *, least(sz, 1e0) AS gap, tan(radians(tilt)) / sy AS down FROM st JOIN mm USING (study) WHERE modality = 'CT' AND plane = 'AXIAL'),
ev AS (SELECT study, n, r, c, n * gap / sz AS oz, r - n * gap * down AS oy FROM (SELECT *, unnest(range(CAST(floor(mz * sz / gap) AS BIGINT) + 1)) AS n FROM tu) CROSS JOIN range(8) a(r) CROSS JOIN range(8) b(c)),
co AS (SELECT ev.*, CAST(floor(oz) AS BIGINT) + i AS kz, CAST(floor(oy) AS BIGINT) + j AS ky, abs(1 - i - (oz - floor(oz))) * abs(1 - j - (oy - floor(oy))) AS wt FROM ev, range(2) p(i), range(2) q(j))
SELECT co.study, CAST(n AS INT) AS z, CAST(r AS INT) AS y, CAST(c AS INT) AS x, round(sum(wt * coalesce(v, 0)), 4) + 0e0 AS v FROM co LEFT JOIN vox ON vox.study = co.study AND vox.z = kz AND vox.y = ky AND vox.x = c GROUP BY ALL
UNION ALL SELECT study, z, y, x, round(v, 4) + 0e0 AS v FROM vox WHERE study NOT IN (SELECT study FROM tu)""")
def _(s, d):
    return _rounded(studies.untilted(V.vox(s, d), _studies(s, d)), "v")


@query("g1_axial", f"WITH {V.VOX}, {META} SELECT study, CASE WHEN plane = 'AXIAL' THEN z ELSE y END AS z, CASE plane WHEN 'AXIAL' THEN y WHEN 'CORONAL' THEN z ELSE x END AS y, CASE plane WHEN 'AXIAL' THEN x WHEN 'CORONAL' THEN x ELSE z END AS x, v FROM vox JOIN st USING (study)")
def _(s, d):
    return studies.axial(V.vox(s, d), _studies(s, d))


@query("g1_oriented", f"""WITH {V.VOX}, ev AS (SELECT *, round(0.8e0 * (c - 4.2e0) + 0.6e0 * r, 9) AS px, round(0.8e0 * r - 0.6e0 * (c - 4.2e0), 9) AS py FROM (SELECT DISTINCT study, z FROM vox WHERE study % 3 = 2) CROSS JOIN range(10) a(r) CROSS JOIN range(10) b(c)),
co AS (SELECT ev.*, CAST(floor(px) AS BIGINT) + i AS kx, CAST(floor(py) AS BIGINT) + j AS ky, abs(1 - i - (px - floor(px))) * abs(1 - j - (py - floor(py))) AS wt FROM ev, range(2) p(i), range(2) q(j) WHERE px BETWEEN 0 AND 7 AND py BETWEEN 0 AND 7)
SELECT co.study, CAST(co.z AS INT) AS z, CAST(r AS INT) AS y, CAST(c AS INT) AS x, round(sum(wt * coalesce(v, 0)), 4) + 0e0 AS v FROM co LEFT JOIN vox ON vox.study = co.study AND vox.z = co.z AND vox.y = ky AND vox.x = kx GROUP BY ALL
UNION ALL SELECT study, CAST(CASE WHEN study % 3 = 0 THEN z ELSE 7 - y END AS INT), CAST(CASE WHEN study % 3 = 0 THEN 7 - y ELSE z END AS INT), CAST(CASE WHEN study % 3 = 0 THEN 7 - x ELSE x END AS INT), round(v, 4) + 0e0 FROM vox WHERE study % 3 <> 2""")
def _(s, d):
    """Stacks turned by half around their axis, coronal ones that go down, and oblique ones."""
    turns = [[-1.0, 0.0, 0.0, 0.0, -1.0, 0.0], [1.0, 0.0, 0.0, 0.0, 0.0, -1.0], [0.8, 0.6, 0.0, -0.6, 0.8, 0.0]]
    turn = F.element_at(F.array(*(F.array(*map(F.lit, t)) for t in turns)), (F.col("study") % 3 + 1).cast("int"))
    return _rounded(oriented.oriented(V.vox(s, d), _studies(s, d).withColumn("turn", turn)), "v")


def _found(rows):
    return _rounded(rows.select("study", "z", "y", "x", "first", "n_points", "max_br", "max_si", "max_k", "score"), "max_br", "max_si", "max_k", "score")


def _sided(s, d):
    """Volumes of 0 and 255 with a ball at the tube's side, and their masks."""
    rows = V.tubes(s, d, 17, 20)
    vox = rows.select(*grid.AT, F.when(F.col("inside"), 255.0).otherwise(0.0).alias("v"))
    return vox, rows.where("inside").select(*grid.AT)


@query("p1_phantom_candidates")
def _(s, d):
    """A ball at the side of a tube, along the tube's own axis."""
    vox, mask = _sided(s, d)
    axis = vox.where("y = 12 AND x = 12").select("study", F.col("study").alias("branch_id"), F.col("z").alias("idx"), "z", "y", "x")
    return _found(analysis.found(analysis.features(mask, vox, axis)))


@query("p2_phantom_what_if")
def _(s, d):
    """The same along the thinned path, which bends towards the ball: with other thresholds."""
    vox, mask = _sided(s, d)
    return _found(analysis.again(analysis.paths(mask), mask, vox, analysis.Params(prune_mm=3.5, bulge=0.9, shape=0.57)))


@query("p3_phantom_analysis", "SELECT label AS study, CAST(10 + sum(vec_id) % greatest(1, count(*) - 20) AS INT) AS z, 12 AS y, 12 AS x FROM embeddings GROUP BY label")
def _(s, d):
    """From noisy volumes of a tube with a ball around it to their candidates; the SQL knows where the balls are."""
    out = analysis.analyse(V.tubes(s, d).select(*grid.AT, "v"), analysis.Params(share=0.05, least_voxels=50))
    return out.select("study", "z", "y", "x")


@query("p4_analysis_of_studies")
def _(s, d):
    """The same for studies of different spacing and modality, in one set of jobs."""
    n = F.col("study")
    meta = V.table(s, d, "embeddings").select(F.col("label").alias("study")).distinct()
    wide = F.when(n % 2 == 0, 1.0).otherwise(0.9)
    meta = meta.select("study", *(wide.alias(c) for c in ("sx", "sy", "sz")), F.lit(0.0).alias("tilt"), F.when(n % 5 == 4, "CT").otherwise("MR").alias("modality"), F.lit("AXIAL").alias("plane"))
    return _found(analysis.analyse_studies(V.tubes(s, d).select(*grid.AT, "v"), meta, analysis.Params(share=0.05, least_voxels=50)))


def queries() -> dict:
    return dict(QUERIES)


def oracle_sql() -> dict:
    return dict(ORACLES)
