import itertools

import numpy as np
from pyspark.sql import functions as F

from terrafold.operators import inpaint as I


def test_delaunay_circles_are_empty():
    p = np.random.default_rng(0).random((25, 2)) * 50
    tris = I.delaunay(p)
    assert len(tris) > 25
    for a, b, c in tris:
        m = np.array([p[b] - p[a], p[c] - p[a]])
        o = np.linalg.solve(2 * m, [(p[b] ** 2).sum() - (p[a] ** 2).sum(), (p[c] ** 2).sum() - (p[a] ** 2).sum()])
        r = ((p[a] - o) ** 2).sum()
        assert all(((q - o) ** 2).sum() >= r - 1e-6 for q in p)


def test_homography_with_outliers():
    r = np.random.default_rng(1)
    h = np.array([[1.1, 0.1, 3], [-0.05, 0.95, 2], [1e-4, 2e-4, 1]])
    src = r.random((60, 2)) * 100
    q = np.c_[src, np.ones(60)] @ h.T
    dst = q[:, :2] / q[:, 2:]
    assert np.allclose(I.fit_homography(src, dst), h, atol=1e-6)
    dst[:15] += 40
    assert np.allclose(I.fit_homography(src, dst, rounds=200), h, atol=1e-5)


def test_nearest_field_finds_a_copy():
    r = np.random.default_rng(2)
    source = r.random((12, 12, 3))
    field = I.nearest_field(source[3:9, 4:10], source, passes=6)
    inner = [(v, u) for v in range(1, 5) for u in range(1, 5)]
    assert sum(tuple(field[v, u]) == (v + 3, u + 4) for v, u in inner) >= 14


def test_multi_scale_smooths():
    labels = np.zeros((8, 8), int)
    labels[:, 4:] = 3
    noisy = labels.copy()
    noisy[2, 2], noisy[5, 6] = 2, 0
    unary = np.abs(np.arange(4) - noisy[..., None]).astype(float)
    assert (I.multi_scale(unary, weight=1.0, cut=2.0, levels=2) == labels).mean() > 0.95
    assert (I.multi_scale(unary, weight=0.0) == noisy).all()


def test_fill_inward(spark):
    cells = list(itertools.product(range(7), range(7)))
    image = spark.createDataFrame([(v, u, 5.0) for v, u in cells], "v int, u int, x double")
    mask = spark.createDataFrame([(v, u) for v, u in cells if 1 <= v <= 5 and 1 <= u <= 5], "v int, u int")
    out = I.fill_inward(image, mask, [], ["x"])
    assert out.count() == 49 and out.where("x = 5").count() == 49


def test_costs_and_noise(spark):
    df = spark.createDataFrame([(10, 0, 0, 13, 4, 0), (0, 0, 0, 1, 1, 1)], "a int, b int, c int, d int, e int, f int")
    cost = I.colour_cost([F.col(x) for x in "abc"], [F.col(x) for x in "def"])
    assert [r[0] for r in df.select(cost).collect()] == [7, None]
    noisy = I.add_noise(spark.range(2000).select(F.lit(250.0).alias("x")), "x", 10.0)
    assert noisy.agg(F.max("x")).first()[0] == 255.0


def test_nearest_pixels_beyond_4096(spark):
    from terrafold.operators import raster

    known = spark.createDataFrame([(0, 0, 1.0), (9000, 7000, 2.0)], "u int, v int, depth double")
    wanted = spark.createDataFrame([(0, 0), (8999, 0)], "u int, v int")
    out = {(r.u, r.v): r.n for r in raster.nearest_known(known, wanted, 2, []).groupBy("u", "v").agg(F.count("*").alias("n")).collect()}
    assert out == {(0, 0): 2, (8999, 0): 2}


def test_fill_inward_leaves_what_nothing_reaches(spark):
    image = spark.createDataFrame([(0, 0, 0, 4.0)], "f int, v int, u int, x double")
    mask = spark.createDataFrame([(0, 0, 1), (0, 0, 2), (0, 0, 5), (1, 0, 0)], "f int, v int, u int")
    got = {(r.f, r.u): r.x for r in I.fill_inward(image, mask, ["f"], ["x"]).collect()}
    assert got == {(0, 0): 4.0, (0, 1): 4.0, (0, 2): 4.0}
