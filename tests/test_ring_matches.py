"""Correspondences by rings: the definition, row by row, and pairs that no exchange or sort sees."""

import numpy as np

from terrafold.operators import registration


def test_ring_matches_are_the_definition_and_shuffle_points_only(spark):
    r = np.random.default_rng(8)
    last = [(t, kind, k, int(r.integers(0, 9)), *map(float, np.round(r.normal(0, 2, 3), 1))) for t in (1, 2, None) for kind in ("corner", "surface") for k in range(70)]
    last += [(1, "corner", 900 + k, *row[3:]) for k, row in enumerate(last[:20])]  # copies: ties go to the smaller pt
    moved = [(t, kind, k, *map(float, np.round(r.normal(0, 4, 3), 1)), 0.5) for t in (1, 2, 3, None) for kind in ("corner", "surface") for k in range(90)]
    a = spark.createDataFrame(moved, "turn int, kind string, pt long, x double, y double, z double, share double")
    b = spark.createDataFrame(last, "turn int, kind string, pt long, ring int, x double, y double, z double")
    found = registration.ring_matches(a, b, ["turn", "kind"], 9.0)
    plan = found._jdf.queryExecution().toString()
    assert "Window" not in plan and "collect_list" not in plan
    got = {(x.turn, x.kind, x.pt): tuple(m and m.pt for m in (x.near, x.same, x.other)) for x in found.collect()}
    want = {}
    for t, kind, k, *p, _ in moved:
        near = sorted((sum((s - u) * (s - u) for s, u in zip(p, q)), n, ring) for u, v, n, ring, *q in last if t is not None and (u, v) == (t, kind))
        near = [x for x in near if x[0] < 9.0]
        if near:
            first = lambda test, near=near: next((n for _, n, ring in near if test(n, ring)), None)
            _, n0, r0 = near[0]
            want[t, kind, k] = n0, first(lambda n, ring, n0=n0, r0=r0: ring == r0 and n != n0), first(lambda n, ring, r0=r0: 0 < abs(ring - r0) <= 2.5)
    assert got == want and any(None in m for m in want.values())
