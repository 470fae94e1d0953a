"""Nearest-neighbour fields as joins, and the two-stage rotation search."""

import numpy as np
from pyspark.sql import functions as F

from terrafold.functions import geometry as g
from terrafold.operators import optimize, patchmatch


def raster(spark, a, name="k"):
    return spark.createDataFrame([(name, v, u, float(a[v, u])) for v in range(a.shape[0]) for u in range(a.shape[1])], "image string, v int, u int, x double")


def test_a_planted_copy_is_found_however_rows_are_dealt_out(spark):
    r = np.random.default_rng(1)
    source = r.integers(0, 50, (20, 24))
    target = source[5:15, 7:19].copy()
    a, b = raster(spark, target), raster(spark, source)
    got = patchmatch.nearest_field(a, b, ["x"], ["image"], rounds=12).collect()
    again = patchmatch.nearest_field(a.repartition(7, "u"), b.coalesce(1), ["x"], ["image"], rounds=12).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, again)) and len(got) == target.size
    # patches at the rim have fewer cells and may agree elsewhere too
    inner = [x for x in got if 0 < x.v < 9 and 0 < x.u < 11]
    assert sum((x.sv, x.su) == (x.v + 5, x.u + 7) and x.cost == 0 for x in inner) >= 0.95 * len(inner)
    for x in got:  # costs are what the patches say
        d = [(float(target[x.v + i, x.u + j]) - source[x.sv + i, x.su + j]) ** 2 for i in (-1, 0, 1) for j in (-1, 0, 1) if 0 <= x.v + i < 10 and 0 <= x.u + j < 12 and 0 <= x.sv + i < 20 and 0 <= x.su + j < 24]
        assert abs(x.cost - np.mean(d)) < 1e-9


def test_holes_and_empty_rasters(spark):
    a = raster(spark, np.arange(12).reshape(3, 4))
    assert patchmatch.nearest_field(a.where("false"), a, ["x"], ["image"], rounds=1).collect() == []
    alone = patchmatch.nearest_field(a, a.withColumn("image", F.lit("other")), ["x"], ["image"], rounds=2).collect()
    assert len(alone) == 12 and all(x.sv is None and x.cost is None for x in alone)
    holed = patchmatch.nearest_field(a.where("(u + v) % 2 = 0"), a.where("v != 1"), ["x"], ["image"], rounds=4).collect()
    assert len(holed) == 6 and all(x.sv in (0, 2) for x in holed)


def test_second_stage_goes_on_from_each_groups_own_minimum(spark):
    r = np.random.default_rng(2)
    truth = {0: (0.0031, -0.0021), 1: (-0.0022, 0.0012)}
    points, shot = [], []
    for frame, (ax, ay) in truth.items():
        turn = g.rot_matrix("y", ay) @ g.rot_matrix("x", ax)
        for k, p in enumerate(r.uniform(-2, 2, (400, 3))):
            c = (int(k * 7 % 250) + 1, int(k * 13 % 250) + 1)
            points.append((frame, k, *map(float, p), *c))
            x = turn @ p + [0, 0, 8]
            # every pixel is a little off, so that agreement costs one and not nothing, and those beside it more
            u, v = int((2000 * x[0] + 640 * x[2]) / x[2] + 0.5), int((2000 * x[1] + 480 * x[2]) / x[2] + 0.5)
            shot += [(frame, u + i, v + j, c[0] + 1 + 3 * (abs(i) + abs(j)), c[1] + 1, float(x[2])) for i in (-1, 0, 1) for j in (-1, 0, 1)]
    points = spark.createDataFrame(points, "frame int, pt int, x double, y double, z double, b int, g int")
    image = spark.createDataFrame(shot, "frame int, u int, v int, b int, g int, d double").groupBy("frame", "u", "v").agg(F.min(F.struct("d", "b", "g")).alias("m")).select("frame", "u", "v", "m.b", "m.g")
    start = spark.createDataFrame([(0, 0.0, 0.0, 0.0), (1, 0.0, 0.0, 0.0)], "frame int, ax double, ay double, az double")
    got = optimize.two_stage_search(points, image, start, [[2000.0, 0.0, 640.0], [0.0, 2000.0, 480.0]], [0.0, 0.0, 8.0], 1280, 960, by=["frame"], colours=["b", "g"], reach=4).collect()
    assert all(abs(x.ax - truth[x.frame][0]) < 5e-4 and abs(x.ay - truth[x.frame][1]) < 5e-4 for x in got) and len(got) == 2, got
