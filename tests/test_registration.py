"""Registration, pose scans and re-projection on planted scenes."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from terrafold.functions import geometry as g
from terrafold.operators import dense_map, poses, registration


def cloud(n=400, seed=0):
    r = np.random.default_rng(seed)
    return [(k, int(k * 24 // n), *map(float, r.uniform(-6, 6, 3))) for k in range(n)]


def test_odometry_finds_a_motion_with_shares_and_keeps_thin_sweeps(spark):
    pose = np.array([0.004, -0.006, 0.01, 0.08, -0.05, 0.03])
    last, points = [], []
    for sweep, rows in ((1, cloud()), (2, cloud(60, 1))):
        for k, ring, *p in rows:
            kind = "corner" if k % 3 == 0 else "surface"
            share = (k % 10 + 1) / 10
            r = g.rot_matrix("z", share * pose[2]) @ g.rot_matrix("x", share * pose[0]) @ g.rot_matrix("y", share * pose[1])
            last.append((sweep, kind, k, ring, *p))
            points.append((sweep, kind, k, *map(float, r @ np.array(p) + share * pose[3:]), share))
    points = spark.createDataFrame(points, "sweep int, kind string, pt long, x double, y double, z double, share double")
    last = spark.createDataFrame(last, "sweep int, kind string, pt long, ring int, x double, y double, z double")
    got = {r.sweep: r for r in registration.odometry(points, last, ["sweep"], iterations=10, every=2, step_scale=1.0, stop=(0.0, 0.0)).collect()}
    assert np.allclose([got[1][c] for c in registration.POSE], pose, atol=1e-6)
    assert [got[2][c] for c in registration.POSE] == [0.0] * 6 and got[2].used == 0  # 40 surface points


def test_directions_that_nothing_fixes_are_left_alone(spark):
    r = np.random.default_rng(5)
    # a floor only: turns about its normal and shifts along it cannot be seen
    flat = [(k, *map(float, (x, 1.0, z))) for k, (x, z) in enumerate(r.uniform(-2, 2, (400, 2)))]
    # corners with no line among their neighbours
    loose = [(1000 + k, *map(float, r.uniform(20, 21, 3))) for k in range(40)]
    world = [(7, "surface", *p) for p in flat] + [(7, "corner", *p) for p in loose]
    points = [(7, "surface", k, x, y - 0.05, z) for k, x, y, z in flat]
    schema = "sweep int, kind string, pt long, x double, y double, z double"
    start = spark.createDataFrame([(7, *[0.0] * 6)], "sweep int, " + ", ".join(f"{c} double" for c in registration.POSE))
    got = registration.map_match(spark.createDataFrame(points, schema), spark.createDataFrame(world, schema), start, ["sweep"], eigen_floor=1.0).first()
    assert abs(got.ty - 0.05) < 1e-6 and max(abs(got[c]) for c in ("rx", "ry", "rz", "tx", "tz")) < 1e-6
    few = registration.map_match(spark.createDataFrame(points, schema), spark.createDataFrame(world[:90], schema), start, ["sweep"]).first()
    assert few.used == 0 and few.ty == 0.0


def test_jacobians_are_derivatives(spark):
    pose = [0.2, -0.4, 0.3, 1.0, -2.0, 0.5]
    at = lambda p: spark.createDataFrame([(*p, 3.0, -1.0, 2.0, 0.7, 0.3, -0.5, 0.8)], ", ".join(f"{c} double" for c in [*registration.POSE, "x", "y", "z", "share", "nx", "ny", "nz"]))
    for place, jacobian in ((registration.with_start, registration.start_jacobian), (registration.with_map, registration.map_jacobian)):
        value = lambda p, place=place: place(at(p)).select(sum(F.col(f"n{c}") * F.col(f"_c{c}") for c in "xyz").alias("v")).first().v
        got = jacobian(place(at(pose))).select(*(f"a{k}" for k in range(6))).first()
        h = 1e-5
        want = [(value([v + h * (i == k) for i, v in enumerate(pose)]) - value([v - h * (i == k) for i, v in enumerate(pose)])) / (2 * h) for k in range(6)]
        assert np.allclose(got, want, atol=1e-8)


def test_eigenvalues_and_axes(spark):
    r = np.random.default_rng(1)
    m = [a @ a.T for a in r.normal(size=(50, 3, 3))] + [np.eye(3), np.zeros((3, 3)), np.diag([1.0, 5.0, 5.0]), np.diag([1.0, 1.0, 5.0])]
    rows = spark.createDataFrame([(k, *map(float, (a[0, 0], a[0, 1], a[0, 2], a[1, 1], a[1, 2], a[2, 2]))) for k, a in enumerate(m)], "k int, c00 double, c01 double, c02 double, c11 double, c12 double, c22 double")
    for row in registration.with_eigen(rows).collect():
        w, v = np.linalg.eigh(m[row.k])
        assert np.allclose([row.e0, row.e1, row.e2], w, atol=1e-7 * max(1, w[2]))
        if w[2] - w[1] > 1e-6:
            assert abs(abs(np.dot(v[:, 2], [row.ax, row.ay, row.az])) - 1) < 1e-9
        else:  # any of several, or none
            assert row.ax is None or abs(row.ax**2 + row.ay**2 + row.az**2 - 1) < 1e-9


def test_pose_scan_is_the_loop(spark):
    r = np.random.default_rng(2)
    steps = [(key, n * 3, *map(float, r.normal(0, 0.1, 6))) for key, many in (("a", 500), ("b", 1), (None, 40)) for n in range(many)]
    rows = spark.createDataFrame(steps, "key string, at long, " + ", ".join(f"{c} double" for c in poses.POSE))
    want = {}
    for key in ("a", "b", None):
        m = np.eye(4)
        for s in (s for s in steps if s[0] == key):
            m = g.accumulate(m, np.array(s[2:]), 1.05)
            want[key, s[1]] = m.copy()
    for bucket in (7, 100, 10**6):
        got = poses.accumulate(rows, ["key"], "at", bucket).collect()
        assert len(got) == len(want)
        for x in got:
            assert np.allclose(g.pose_matrix(*(x[c] for c in poses.POSE)), want[x.key, x["at"]], atol=1e-9)


@pytest.mark.parametrize("order", ["forward", "backward", "interleaved"])
def test_first_views_of_a_long_sequence(spark, order):
    r = np.random.default_rng(3)
    k, ext, n = np.array([[20.0, 0, 10], [0, 20, 8], [0, 0, 1]]), np.c_[np.eye(3), [0.0, 0, 4]], 40
    track = [(1, f, 0.01 * f, 0.02 * (f % 7), -0.01 * f, 0.2 * f, 0.1 * (f % 5), 0.05 * f) for f in range(n)]
    masks = {(1, f, int(u), int(v)) for f in range(n) for u, v in r.integers(0, 20, (150, 2)) if v < 16}
    wanted = [(1, f, int(u), int(v), *map(float, r.uniform(-3, 3, 3))) for f in (0, 5, 20, 39) for u, v in {tuple(x) for x in r.integers(0, 16, (30, 2))}]
    out = dense_map.first_views(spark.createDataFrame(wanted, "car int, frame int, u int, v int, x double, y double, z double"), spark.createDataFrame(track, "car int, frame int, " + ", ".join(f"{c} double" for c in poses.POSE)), spark.createDataFrame(list(masks), "car int, frame int, u int, v int"), k, ext, 20, 16, ["car"], order=order)
    got = {(x.frame, x.u, x.v): (x.source, x.su, x.sv) for x in out.collect()}
    at = {f: g.pose_matrix(*p) for _, f, *p in track}
    far = 0
    for _, f, u, v, *p in wanted:
        ahead, behind = list(range(f + 1, n)), list(range(f - 2, -1, -1))
        turns = [x for pair in zip(ahead + [None] * n, behind + [None] * n) for x in pair if x is not None]
        found = (f, u, v)
        for s in {"forward": ahead + behind, "backward": behind + ahead, "interleaved": turns}[order]:
            x = g.projection_matrix(k, np.vstack([ext, [0, 0, 0, 1]])[:3], at[f], at[s]) @ [*p, 1]
            pix = int(x[0] / x[2] + 0.5), int(x[1] / x[2] + 0.5)
            if x[2] > 0 and 0 <= pix[0] < 20 and 0 <= pix[1] < 16 and (1, s, *pix) not in masks:
                found = (s, *pix)
                break
        far += abs(found[0] - f) > 4
        assert got[f, u, v] == found
    assert len(got) == len(wanted) and far > 0
