"""Triangulation keeps its tasks apart, and a sliver costs its own pixels."""

import numpy as np
from pyspark.sql import functions as F

from terrafold.operators import inpaint, joins


def test_triangulation_is_dealt_out_over_all_partitions(spark):
    p = spark.range(21 * 200).select(F.floor(F.col("id") / 21).alias("turn"), (F.col("id") * 37 % 101).alias("u"), (F.col("id") * 53 % 97).alias("v"))
    tasks = inpaint.triangulate(p, ["turn"]).select(F.spark_partition_id().alias("p")).distinct().count()
    assert tasks == int(spark.conf.get("spark.sql.shuffle.partitions"))


def test_a_sliver_costs_its_pixels(spark):
    n = 30_000  # its box has 900 million pixels
    t = spark.createDataFrame([(1, 0.0, 0.0, float(n), float(n), 0.5, 2.5), (2, 1.0, 1.0, 6.0, 1.0, 3.0, 4.0), (3, -2.0, 3.0, 2.0, 3.0, 0.0, -1.5)], "tri int, ax double, ay double, bx double, by double, cx double, cy double")
    got = {(r.tri, r.u, r.v) for r in joins.rasterize(t).collect()}
    for tri, *xy in [tuple(r) for r in t.where("tri > 1").collect()]:
        (ax, ay), (bx, by), (cx, cy) = np.reshape(xy, (3, 2))
        det = (by - cy) * (ax - cx) + (cx - bx) * (ay - cy)
        weights = lambda u, v: (((by - cy) * (u - cx) + (cx - bx) * (v - cy)) / det, ((cy - ay) * (u - cx) + (ax - cx) * (v - cy)) / det)
        assert {(u, v) for k, u, v in got if k == tri} == {(u, v) for u in range(-9, 9) for v in range(-9, 9) for a, b in [weights(u, v)] if a > 0 and b > 0 and 1 - a - b > 0}
    assert 0 < sum(k == 1 for k, _, _ in got) < 3 * n
