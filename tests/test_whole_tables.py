"""Queries over whole tables, against brute force."""

import itertools
import math

import numpy as np

from tubula.plans import registry
from tubula.plans import views as V


def test_nearest_searches_every_branch(spark, sf):
    """All queries against brute force over all points."""
    orders, points = (t.toPandas() for t in (spark.read.parquet(f"{sf}/orders.parquet").select("o_orderkey").distinct(), V.centreline(spark, sf)))
    points = points.sort_values(["branch_id", "idx"])
    at = points[["x", "y", "z"]].to_numpy(int)
    want = {}
    for o in orders.o_orderkey[orders.o_orderkey % 50 == 0]:
        d2 = ((at - (o * 7 % 61, o * 5 % 53, o * 3 % 47)) ** 2).sum(axis=1)
        k = int(d2.argmin())
        want[o] = (points.branch_id.iloc[k], points.idx.iloc[k], float(d2[k]))
    got = {r.id: (r.branch_id, r.idx, r.d2) for r in registry.queries()["jn4_nearest_centreline"](spark, sf).collect()}
    assert got == want and any(b % 40 for b, _, _ in got.values())


def test_merging_takes_every_edge(spark, sf):
    edges = {r.u: (r.u, r.v, r.length_mm) for r in V.edges(spark, sf).collect()}
    at = {}
    for e, (u, v, _) in edges.items():
        for n in {u, v}:
            at.setdefault(n, []).append(e)
    passed = {n for n, es in at.items() if len(es) == 2 and not any(edges[e][0] == edges[e][1] for e in es)}
    want = []
    for start in at.keys() - passed:
        for first in at[start]:
            edge, node, mm, parts = first, start, 0.0, 0
            while True:
                u, v, length = edges[edge]
                node, mm, parts = u + v - node, mm + length, parts + 1
                if node not in passed:
                    break
                (edge,) = (e for e in at[node] if e != edge)
            if (start, first) <= (node, edge):
                want.append((first, start, node, parts, mm))
    got = sorted((r.branch, r.u, r.v, r.parts, r.length_mm) for r in registry.queries()["n6_merge_degree_2"](spark, sf).collect())
    assert [g[:4] for g in got] == [w[:4] for w in sorted(want)] and sum(g[3] for g in got) == len(edges)
    assert all(abs(g[4] - w[4]) < 1e-6 for g, w in zip(got, sorted(want), strict=True))


def cubes(spark, sf):
    out = {}
    for r in spark.read.parquet(f"{sf}/embeddings.parquet").orderBy("vec_id").collect():
        out.setdefault(r.label, []).append(np.array(r.embedding, float).reshape(8, 8))
    return {label: np.array(slices) for label, slices in out.items()}


def along(n):
    """The points of a path from slice 2.0213 to the last of n slices."""
    out = []
    while not out or out[-1][2] < n - 1:
        i = len(out)
        k = i % 38 if i % 38 < 20 else 38 - i % 38
        out.append((1.0331 + k * 0.31, 3.4717 + k * 0.11, 2.0213 + i * 1.49))
    return out


def test_straightened_images_go_through_all_slices(spark, sf):
    want, high, volumes = {}, {}, cubes(spark, sf)
    for label, cube in volumes.items():
        seen = set()
        for row, p in enumerate(along(len(cube))):
            for col in range(9):
                off = (col - 4.5) * 0.8
                x, y, z = p[0] + off * 0.8 * math.cos(math.pi / 6), p[1] + off * 0.6 * math.cos(math.pi / 6), p[2] + off * math.sin(math.pi / 6)
                v = 0.0
                for k in itertools.product((0, 1), repeat=3):
                    kz, ky, kx = (math.floor(a) + d for a, d in zip((z, y, x), k, strict=True))
                    seen.add(kz)
                    if 0 <= kz < len(cube) and 0 <= ky < 8 and 0 <= kx < 8:
                        v += math.prod(1 - abs(a - b) for a, b in ((z, kz), (y, ky), (x, kx))) * cube[kz, ky, kx]
                want[label, row, col] = v
        assert seen >= set(range(len(cube)))
        high[label] = math.ceil((row + 1) * 0.93 / 0.8)
    for name in ("n16_straightened", "n17_padded"):
        got = {(r.study, r.row, r.col): r.v for r in registry.queries()[name](spark, sf).collect()}
        if name == "n17_padded":
            want = {(s, r, c): want.get((s, r, c), 0.0) for s in volumes for r in range(high[s]) for c in range(9)}
        assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-4 for k in want)


def test_rays_start_in_all_slices(spark, sf):
    got = {(r.study, r.i, r.angle): r.mm for r in registry.queries()["n19_unwrapped_rays"](spark, sf).collect()}
    n = 0
    for label, cube in cubes(spark, sf).items():
        for i, p in enumerate(along(len(cube))):
            for angle in range(12):
                turn = math.pi * angle / 6
                way = (0.8 * math.cos(turn), 0.6 * math.cos(turn), math.sin(turn))
                for k in range(1, 14):
                    x, y, z = (math.floor(a + k * 0.5 * w + 0.5) for a, w in zip(p, way, strict=True))
                    if not (0 <= z < len(cube) and 0 <= y < 8 and 0 <= x < 8 and cube[z, y, x] > -0.1):
                        break
                mm = k * 0.5 * math.sqrt(sum((w * s) ** 2 for w, s in zip(way, (0.5, 0.5, 1.2), strict=True)))
                assert abs(got[label, i, angle] - mm) < 1e-4
                n += 1
    assert n == len(got)
