"""Hand-checked cases and invariants."""

import itertools
import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from terrafold.functions import geometry as g
from terrafold.functions import scalars as sc
from terrafold.operators import aggs, features, joins, mrf, optimize, raster, windows
from terrafold.session import RegistrationParams


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_voxel_cells(spark):
    df = spark.createDataFrame([(0.1, 0.0, 0.0), (0.3, 0.0, 0.0), (0.5, 0.0, 0.0), (-0.1, 0.0, 0.0)], "x double, y double, z double")
    got = {r.cx: (r.n, round(r.x, 6)) for r in aggs.voxel_grid(df, 0.4).collect()}
    assert got == {0: (2, 0.2), 1: (1, 0.5), -1: (1, -0.1)}


def test_zbuffer_first_wins(spark):
    df = spark.createDataFrame([(3, 4, 5.0, 0), (3, 4, 2.0, 1), (3, 4, 2.0, 2)], "v int, u int, z double, k int")
    assert rows(aggs.zbuffer(df, ["v", "u"], "z", "k")) == [(3, 4, 2.0, 1)]


@pytest.mark.parametrize("bucket", [1, 2, 100])
def test_asof_ties_and_ends(spark, bucket):
    left = spark.createDataFrame([(t,) for t in (0, 14, 15, 20, 30, 90)], "t long")
    right = spark.createDataFrame([(t, t) for t in (10, 20, 40)], "t long, k long")
    got = dict(rows(joins.asof_nearest(left, right, "t", ["k"], bucket=bucket).select("t", "r_k")))
    assert got == {0: 10, 14: 10, 15: 20, 20: 20, 30: 40, 90: 40}


def test_asof_brute_force(spark):
    r = np.random.default_rng(0)
    left, right = r.integers(0, 1000, 80), r.integers(0, 1000, 40)
    l = spark.createDataFrame([(int(k % 3), int(t)) for k, t in enumerate(left)], "g int, t long")  # noqa: E741
    q = spark.createDataFrame([(int(k % 3), int(t), k) for k, t in enumerate(right)], "g int, t long, id long")
    for got in joins.asof_nearest(l, q, "t", ["id"], ["g"], bucket=50).collect():
        own = [(abs(int(t) - got.t), -int(t), -k) for k, t in enumerate(right) if k % 3 == got.g]
        assert -min(own)[2] == got.r_id


def test_asof_without_right_rows(spark):
    left = spark.createDataFrame([(1,)], "t long")
    right = spark.createDataFrame([], "t long, k long")
    assert rows(joins.asof_nearest(left, right, "t", ["k"])) == [(1, None, None)]


def test_curvature(spark):
    df = spark.createDataFrame([(i, float(i * i)) for i in range(11)], "i int, x double")
    out = windows.curvature(df.withColumn("g", F.lit(0)), ["x"], ["g"], ["i"])
    assert {r.i: r.curvature for r in out.collect() if r.curvature is not None} == {5: 12100.0}


def test_rigid_transform(spark):
    df = spark.createDataFrame([(1.0, 0.0, 0.0, 0.0, 0.0, math.pi / 2, 1.0, 2.0, 3.0)], "x double, y double, z double, rx double, ry double, rz double, tx double, ty double, tz double")
    out = df.select(*g.to_map(g.vec())).first()
    assert np.allclose(out, (1, 3, 3))
    m = df.select("rx", "ry", "rz", "tx", "ty", "tz", *(c.alias(n) for c, n in zip(g.to_map(g.vec()), "xyz", strict=True)))
    assert np.allclose(m.select(*g.to_local(g.vec())).first(), (1, 0, 0))


def test_pose_matrix_round_trip():
    pose = (0.1, -0.2, 0.3, 1.0, 2.0, 3.0)
    assert np.allclose(g.matrix_pose(g.pose_matrix(*pose)), pose)
    assert np.allclose(g.associate_to_map(np.eye(4), np.eye(4), g.pose_matrix(*pose)), g.pose_matrix(*pose))


def test_box_faces_and_missing_labels(spark):
    points = spark.createDataFrame([(0, 1.0, 1.0, 1.0), (0, 1.0001, 0.0, 0.0), (1, 0.0, 0.0, 0.0)], "frame int, x double, y double, z double")
    boxes = spark.createDataFrame([(0, 0.9, 0.0, 0.0, 0.0, 1.0, 1.0, 1.0)], "frame int, conf double, cx double, cy double, cz double, hx double, hy double, hz double")
    assert len(rows(joins.box_anti(points, boxes))) == 1
    assert len(rows(joins.box_anti(points, boxes, missing_labels="keep"))) == 2
    none = boxes.where("false")
    assert len(rows(joins.box_anti(points, none))) == 0
    assert len(rows(joins.box_anti(points, none, missing_labels="keep"))) == 3


def test_gap_fill(spark):
    df = spark.createDataFrame([(0, None), (1, 10.0), (2, None), (3, None), (4, 40.0), (5, None)], "i int, v double").withColumn("g", F.lit(0))
    assert [r.filled for r in windows.gap_fill(df, "v", "i", ["g"]).orderBy("i").collect()] == [None, 10.0, 20.0, 30.0, 40.0, None]


def test_suppression_is_asymmetric(spark):
    df = spark.range(30).withColumn("g", F.lit(0))
    a = windows.suppress(df, F.col("id") == 10, F.lit(False), ["g"], ["id"])
    b = windows.suppress(df, F.lit(False), F.col("id") == 10, ["g"], ["id"])
    marked = lambda d: sorted(r.id for r in d.where("picked").collect())
    assert marked(a) == list(range(5, 11)) and marked(b) == list(range(11, 17))


def test_inverse_distance(spark):
    df = spark.createDataFrame([(0, 2.0, 1.0), (0, 4.0, 3.0), (1, 7.0, 0.0), (1, 1.0, 5.0)], "k int, v double, d double")
    assert rows(aggs.inverse_distance(df, ["k"], "v", "d")) == [(0, 2.5), (1, 7.0)]


@pytest.mark.parametrize(("seen", "want"), [((3, 1), 3), ((4, 0), 4), ((0,), 0), ((1,), 2), ((), 2)])
def test_first_match(spark, seen, want):
    frames = spark.createDataFrame([(0, t) for t in range(5)], "s int, t long")
    cells = spark.createDataFrame([(0, 7, 2)], "s int, c int, t long")
    visible = spark.createDataFrame([(0, 7, t) for t in seen], "s int, c int, t long")
    assert joins.first_match(cells, frames, visible, ["c"], "t", ["s"]).first().source == want


def test_ring_laws(spark):
    deg = lambda *x: spark.createDataFrame([(float(v),) for v in x], "d double")
    assert [r[0] for r in deg(-24.33, -8.59, -8.58, 0, 2).select(sc.ring_two_slopes(F.col("d"))).collect()] == [0, 31, 32, 57, 63]
    assert [r[0] for r in deg(-15, -14, 1, 15).select(sc.ring_linear(F.col("d"), -15.0, 15.0, 16)).collect()] == [0, 1, 8, 15]
    assert [r[0] for r in deg(-3, 0.5, 9).select(sc.ring_table(F.col("d"), [0.0, 1.0, 2.0])).collect()] == [0, 0, 2]


def test_pixel_rounding(spark):
    df = spark.createDataFrame([(v,) for v in (-1.6, -1.4, -0.6, 0.4, 0.5, 2.5)], "x double")
    assert [r[0] for r in df.select(g.pixel(F.col("x"))).collect()] == [-1, 0, 0, 0, 1, 3]


@pytest.mark.parametrize(("n", "starts", "end"), [(131, [5, 25, 45, 65, 85, 105], 124), (47, [5, 11, 17, 23, 29, 35], 40)])
def test_regions(spark, n, starts, end):
    out = windows.region_split(spark.range(n).withColumn("g", F.lit(0)), ["g"], ["id"]).where("region is not null")
    assert [r.a for r in out.groupBy("region").agg(F.min("id").alias("a")).orderBy("region").collect()] == starts
    assert out.agg(F.max("id")).first()[0] == end
    assert windows.region_split(spark.range(11).withColumn("g", F.lit(0)), ["g"], ["id"]).where("region is not null").count() == 0


def test_stride_range_positive_mean(spark):
    assert [r.id for r in windows.stride(spark.range(25).withColumn("g", F.lit(0)), ["g"], ["id"]).orderBy("id").collect()] == [0, 10, 20]
    df = spark.createDataFrame([(0, 0.0), (0, 3.0), (0, 5.0), (1, 0.0)], "k int, c double")
    assert rows(aggs.positive_mean(df, ["k"], "c")) == [(0, 4.0), (1, None)]


def test_align_is_strict(spark):
    a = spark.createDataFrame([(0, 100_000, 0)], "k int, t long, id int")
    b = spark.createDataFrame([(0, 100_004, 1), (0, 100_005, 2), (0, 99_996, 3)], "k int, t long, id int")
    assert sorted(r.r_id for r in joins.align(a, b, "t", 5, ["id"], ["k"]).collect()) == [1, 3]


def test_knn_is_brute_force(spark):
    r = np.random.default_rng(1)
    xyz = r.normal(size=(150, 3)).round(3)
    p = spark.createDataFrame([(i, *map(float, v)) for i, v in enumerate(xyz)], "id int, x double, y double, z double")
    got = joins.knn_join(p, p, 4, 0.5, "id", "id").groupBy("id").agg(F.array_sort(F.collect_list("p_id")).alias("n"))
    for row in got.collect():
        d = ((xyz - xyz[row.id]) ** 2).sum(axis=1)
        assert row.n == sorted([j for j in np.lexsort((np.arange(150), d)) if d[j] < 0.5][:4])


def test_zero_pairwise_cost_is_arg_min():
    r = np.random.default_rng(2)
    unary = r.random((3, 3, 4))
    for readout in ("outgoing", "incoming"):
        assert (mrf.propagate(unary, np.zeros((3, 3, 4, 3)), np.zeros((3, 3, 4, 4, 3)), iterations=5, readout=readout) == unary.argmin(axis=2)).all()


def test_greedy_picks():
    xyz = np.stack([np.arange(60) * 0.1, np.zeros(60), np.zeros(60)], axis=1)
    xyz[30, 1] = 1.0
    label = features.pick(xyz, np.zeros(60), RegistrationParams())
    assert label[30] in (1, 2) and (label == -1).sum() > 0 and (label[:5] == 0).all()
    assert (features.pick(xyz[:11], np.zeros(11), RegistrationParams()) == 0).all()


def test_gauss_newton_recovers_pose():
    r = np.random.default_rng(3)
    pts, pose = r.normal(size=(60, 3)), np.array([0.02, -0.03, 0.01, 0.1, -0.2, 0.05])
    m = g.pose_matrix(*pose)
    got, _ = optimize.gauss_newton(pts, pts @ m[:3, :3].T + m[:3, 3], np.eye(3)[np.arange(60) % 3])
    assert np.allclose(got, pose, atol=1e-6)


def test_plane_and_sweep(spark):
    n = optimize.plane(np.array([[0, 0, 2.0], [1, 0, 2], [0, 1, 2], [1, 1, 2], [2, 1, 2]]))
    assert np.allclose(np.abs(n), [0, 0, 1, 2])
    turn = [(0, i, math.cos(-a), math.sin(-a)) for i, a in enumerate(np.linspace(0, 2 * math.pi - 0.01, 50))]
    out = windows.unwrap_sweep(spark.createDataFrame(turn, "g int, i int, x double, y double"), ["g"], ["i"]).orderBy("i").toPandas()
    assert out.sweep_share.is_monotonic_increasing and abs(out.sweep_share.iloc[-1] - 1) < 1e-6


def test_dilate_and_median(spark):
    m = spark.createDataFrame([(0, 0)], "u int, v int")
    assert len(rows(raster.dilate(m, 2, 1))) == 15
    d = spark.createDataFrame([(u, v, float(u + 5 * v)) for u, v in itertools.product(range(5), range(5))], "u int, v int, depth double")
    assert {(r.u, r.v): r.depth for r in raster.median(d, []).collect()}[2, 2] == 12.0


def test_nearest_known_with_few_pixels(spark):
    known = spark.createDataFrame([(0, 0, 0, 1.0), (0, 90, 90, 3.0)], "f int, u int, v int, depth double")
    wanted = spark.createDataFrame([(0, 1, 1), (0, 50, 50)], "f int, u int, v int")
    out = raster.nearest_known(known, wanted, 3, ["f"], longest=128)
    assert out.groupBy("u").count().where("count = 2").count() == 2


def test_params_are_validated():
    with pytest.raises(ValueError):
        RegistrationParams(feature_regions=0)
    with pytest.raises(ValueError):
        RegistrationParams(max_corner_sharp=30)
    assert pd.Series([RegistrationParams().curvature_region]).eq(5).all()


def test_last_value_and_interpolation_over_buckets_and_null_keys(spark):
    from terrafold.operators import joins

    left = spark.createDataFrame([("a", 25), ("a", 5), (None, 12), ("b", 1)], "k string, t long")
    right = spark.createDataFrame([("a", 10, 1.0), ("a", 40, 4.0), (None, 2, 7.0)], "k string, t long, x double")
    last = {(r.k, r.t): r.r_x for r in joins.last_value(left, right, "t", ["x"], ["k"], bucket=10).collect()}
    assert last == {("a", 25): 1.0, ("a", 5): None, (None, 12): 7.0, ("b", 1): None}
    at = {(r.k, r.t): r.x_at for r in joins.bracket_interpolate(left, right, "t", "x", ["k"], bucket=10).collect()}
    assert at == {("a", 25): 2.5, ("a", 5): 1.0, (None, 12): 7.0, ("b", 1): None}
