"""Points in or right beside a camera's plane have no pixel: they fall out of the image and stop nothing."""

from pyspark.sql import functions as F

from terrafold.operators import optimize, raster

NEAR = "pt long, frame int, colour long, x double, y double, z double"


def test_projection_leaves_out_points_beside_the_camera_plane(spark):
    rows = [(1, 0, 5, 0.0, 0.0, 0.0), (2, 0, 6, 2.5, 1.0, -8.0), (3, 0, 7, 2.5, 1.0, -8.0 + 1e-7), (4, 0, 8, 2.5, 1.0, -8.0 - 1e-7)]
    matrix = [2000.0, 0.0, 1280.0, 10240.0, 0.0, 2000.0, 960.0, 7680.0, 0.0, 0.0, 1.0, 8.0]
    assert [(r.pt, r.u, r.v) for r in raster.project_points(spark.createDataFrame(rows, NEAR), matrix, 2560, 1920).collect()] == [(1, 1280, 960)]


def test_rotation_search_leaves_out_points_beside_the_camera_plane(spark):
    rows = [(1, 0, 5, 0.0, 0.0, 0.0), (2, 0, 9, 0.5, 0.5, 0.0), (3, 0, 7, 2.5, 0.0, -8.0 + 1e-7), (4, 0, 7, 0.0, 0.0, -8.0)]
    start = spark.range(1).select(F.lit(0).alias("frame"), *(F.lit(0.0).alias(c) for c in ("ax", "ay", "az")))
    camera = ([[2000.0, 0.0, 1280.0], [0.0, 2000.0, 960.0]], [0.0, 0.0, 8.0], 2560, 1920)
    image = spark.createDataFrame([(0, 1280, 960, 5), (0, 1405, 1085, 8)], "frame int, u int, v int, colour long")
    search = lambda some: [tuple(r) for r in optimize.projected_search(spark.createDataFrame(some, NEAR), image, start, *camera, by=["frame"], colours=["colour"], step=1e-3, reach=0).collect()]
    assert search(rows) == search(rows[:2]) and 1.0 in search(rows)[0]
