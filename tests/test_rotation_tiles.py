"""The rotation search deals points out by image tiles: what it finds is what every candidate's own z-buffer says."""

import numpy as np
from pyspark.sql import functions as F

from terrafold.functions import geometry as g
from terrafold.operators import optimize


def _rows(spark):
    r = np.random.default_rng(3)
    points = [(f, k, *map(float, p), int(c)) for f in (0, 1) for k, (p, c) in enumerate(zip(r.uniform(-3, 3, (300, 3)), r.integers(1, 250, 300), strict=True))]
    points += [(0, 900 + k, 0.5, 0.5, 1.0, 10 * k) for k in range(4)]  # copies: the smallest pt counts
    image = [(f, u, v, int(c)) for f in (0, 1) for (u, v), c in zip(((u, v) for u in range(0, 96, 2) for v in range(80)), r.integers(1, 250, 48 * 80), strict=True)]
    start = [(0, 0.02, -0.01, 0.1), (1, 0.0, 0.03, 0.0)]
    return points, image, start


def _brute(points, image, start, step, reach, counted):
    held, out = {(f, u, v): c for f, u, v, c in image}, {}
    for f, ax, ay, az in start:
        for n in range((2 * reach + 1) ** 2):
            i, j = n // (2 * reach + 1) - reach, n % (2 * reach + 1) - reach
            turn, near = g.rot_matrix("z", az) @ g.rot_matrix("y", ay + j * step) @ g.rot_matrix("x", ax + i * step), {}
            for h, pt, x, y, z, c in points:
                p = turn @ [x, y, z] + [0, 0, 8]
                u, v = (int((100 * p[k] + m * p[2]) / p[2] + 0.5) for k, m in ((0, 48), (1, 40)))
                if h == f and p[2] > 0 and 0 <= u < 96 and 0 <= v < 80:
                    near[u, v] = min(near.get((u, v), (np.inf,)), (p[2], pt, c))
            costs = [abs(held.get((f, *q), 0) - s[2]) for q, s in near.items() if counted(*q)]
            out.setdefault(f, []).append((round(np.mean([c for c in costs if c > 0]), 9), n))
    return {f: min(x) for f, x in out.items()}


def test_tiles_are_brute_force_and_points_are_not_copied_a_candidate(spark):
    points, image, start = _rows(spark)
    frames = [spark.createDataFrame(*x) for x in ((points, "frame int, pt long, x double, y double, z double, colour int"), (image, "frame int, u int, v int, colour int"), (start, "frame int, ax double, ay double, az double"))]
    for where, counted in ((None, lambda u, v: True), (F.col("u") + F.col("v") > 60, lambda u, v: u + v > 60)):
        got = optimize.projected_search(*frames, [[100.0, 0.0, 48.0], [0.0, 100.0, 40.0]], [0.0, 0.0, 8.0], 96, 80, by=["frame"], colours=["colour"], step=0.02, reach=2, counted=where)
        want = _brute(points, image, start, 0.02, 2, counted)
        assert {r.frame: (r.mean_cost, r.candidate) for r in got.collect()} == want
        small = optimize.projected_search(*frames, [[100.0, 0.0, 48.0], [0.0, 100.0, 40.0]], [0.0, 0.0, 8.0], 96, 80, by=["frame"], colours=["colour"], step=0.02, reach=2, counted=where, tile=16)
        assert sorted(small.collect()) == sorted(got.collect())
        assert "explode" not in got._jdf.queryExecution().optimizedPlan().toString()
