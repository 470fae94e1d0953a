"""Points in boxes are found by grid cells: the same points, with few boxes left to test."""

import numpy as np

from terrafold.operators import joins


def test_cells_are_brute_force_at_several_sizes_of_boxes(spark):
    r = np.random.default_rng(5)
    xyz = np.vstack([r.uniform(-6, 6, (500, 3)), [[np.nan, 0, 0], [1.0, 2.0, 1.5], [2.0, 0.0, 0.0]]])
    points = [(int(k % 3), k, *map(float, p)) for k, p in enumerate(xyz)]
    boxes = [(int(k % 2), *map(float, c), *h) for k, c in enumerate(r.uniform(-4, 4, (12, 3))) for h in ((1.0, 2.0, 1.5), (0.1, 0.3, 0.0))]
    boxes += [(2, 0.0, 0.0, 0.0, 1.0, 2.0, 1.5), (1, 1.0, 0.0, 0.0, 1.0, 1.0, 1.0)]
    inside = {k for f, k, *p in points if any(f == b[0] and all(abs(x - c) <= h for x, c, h in zip(p, b[1:4], b[4:], strict=True)) for b in boxes)}
    p = spark.createDataFrame(points, "frame int, pt long, x double, y double, z double")
    cells = joins.box_cells(spark.createDataFrame(boxes, "frame int, cx double, cy double, cz double, hx double, hy double, hz double"))
    assert cells.select("_level").distinct().count() > 1
    assert sorted(x.pt for x in joins.by_boxes(p, cells).collect()) == sorted(inside)
    assert sorted(x.pt for x in joins.by_boxes(p, cells, inside=False).collect()) == sorted({k for _, k, *_ in points} - inside)


def test_dense_boxes_leave_few_to_test_in_a_cell(spark):
    r = np.random.default_rng(6)
    boxes = [(0, *map(float, c), 1.0, 2.0, 1.5) for c in r.uniform(-4, 4, (1500, 3))]
    cells = joins.box_cells(spark.createDataFrame(boxes, "frame int, cx double, cy double, cz double, hx double, hy double, hz double"))
    p = spark.createDataFrame([(0, k, *map(float, x)) for k, x in enumerate(r.normal(0, 2.5, (2000, 3)))], "frame int, pt long, x double, y double, z double")
    tested = p.join(cells, [p.frame == cells["_f"], *((p[d] * 2).cast("double") >= cells[f"_c{d}"] for d in "xyz"), *(p[d] * 2 < cells[f"_c{d}"] + 1 for d in "xyz")]).count()
    assert cells.select("_level").distinct().collect()[0][0] == -1
    assert tested < 10 * 2000  # all pairs are 3,000,000
