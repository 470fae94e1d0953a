"""Tiles give what the kernel gives over the whole raster."""

import numpy as np
import pytest

from terrafold.operators import inpaint, tiled


def cells(spark, unary, known=None):
    h, w, _ = unary.shape
    rows = [("m", v, u, unary[v, u].tolist()) for v in range(h) for u in range(w) if known is None or known[v, u]]
    return spark.createDataFrame(rows, "mask string, v int, u int, cost array<double>")


@pytest.mark.parametrize(("quadratic", "tile"), [(False, 16), (True, 16), (False, 64)])
def test_labels_are_those_of_the_whole_raster(spark, quadratic, tile):
    r = np.random.default_rng(3)
    truth = np.add.outer(np.arange(37) // 9, np.arange(45) // 12)
    unary = np.abs(np.arange(8) - truth[..., None]) + r.normal(0, 1.5, (37, 45, 8))
    out = tiled.multi_scale_labels(cells(spark, unary), ["mask"], weight=0.7, cut=3.0, levels=4, iterations=4, quadratic=quadratic, tile=tile)
    got = np.full(truth.shape, -1)
    for x in out.collect():
        got[x.v, x.u] = x.label
    want = inpaint.multi_scale(unary, weight=0.7, cut=3.0, levels=4, iterations=4, quadratic=quadratic)
    assert (got == want).all() and (want == truth).mean() > 0.7 > (unary.argmin(axis=2) == truth).mean()


def test_masks_of_any_shape_do_not_depend_on_tiles(spark):
    r = np.random.default_rng(4)
    unary, known = r.random((30, 41, 5)), r.random((30, 41)) < 0.7
    known[10:14] = False  # two parts that never meet at the finest level
    runs = [sorted(map(tuple, tiled.multi_scale_labels(cells(spark, unary, known), ["mask"], tile=t).collect())) for t in (8, 64)]
    assert runs[0] == runs[1] and len(runs[0]) == known.sum()
    assert tiled.multi_scale_labels(cells(spark, unary).where("false"), ["mask"]).collect() == []


def test_messages_are_the_least_costs():
    r = np.random.default_rng(5)
    base = r.random((20, 9)) * 5
    gap = np.abs(np.subtract.outer(np.arange(9), np.arange(9)))
    for quadratic, pair in ((False, gap), (True, gap**2)):
        want = (base[:, :, None] + 0.6 * np.minimum(pair, 3.0)).min(axis=1)
        assert np.allclose(tiled.sent(base, 0.6, 3.0, quadratic), want - want.mean(axis=1, keepdims=True))
