"""Whitening and hard negatives against brute force: copies, clusters, nulls, odd vectors, ties, empty tables."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from terrafold.llm import hard_negatives as hn
from terrafold.llm import whitening as wh

NAN, INF = float("nan"), float("inf")
SCHEMA = "vec_id long, embedding array<float>, label int, leaf int, row string, x array<int>"


def table(spark, rows):
    return spark.createDataFrame([(*r, 5, "z", [1]) for r in rows], SCHEMA)


def awkward(seed=0, n=240, d=6):
    r = np.random.default_rng(seed)
    middle = r.normal(0, 1.2, (5, d))
    rows = [(k, [float(np.float32(v)) for v in middle[k % 5] + r.normal(0, 0.4, d)], int(r.integers(0, 3))) for k in range(n)]
    rows += [(1000 + k, [0.5] * d, 1) for k in range(90)] + [(1000, [0.5] * d, 1)] * 2  # a third are copies, one row is repeated
    rows += [(2000, None, 1), (2001, [1.0, None, 0.0, 0.0, 0.0, 0.0], 1), (2100, [NAN] * d, 0), (2101, [INF] * d, 0), (2102, [1.0, 2.0], 0), (2103, [], 0), (2104, [0.1] * d, None), (None, [0.2] * d, 1)]
    return rows


def whole(rows, d=6):
    return [(i, np.floor(256 * np.array(v, float)).astype(int), lb) for i, v, lb in rows if v is not None and len(v) == d and None not in v and np.isfinite(np.array(v, float)).all()]


def test_whitening_is_brute_force(spark):
    rows = awkward()
    got = wh.whiten(table(spark, rows), k=4, block=2).toPandas()
    held = whole(rows)
    x = np.unique([v for _, v, _ in held], axis=0)
    n, s = len(x), x.sum(axis=0)
    assert len(got) == 4 * len(held) and set(got.n) == {n}
    values, vectors = np.linalg.eigh(np.cov(x.T, bias=True))
    assert got.identity_error.max() < 1e-9
    for c in range(1, 5):
        of = got[got.component == c]
        assert np.allclose(of.explained, values[-c] / values.sum(), rtol=1e-10)
        want = {i: ((v - s / n) @ vectors[:, -c] / np.sqrt(values[-c]), int(((n * v - s) ** 2).sum())) for i, v, _ in held}
        pairs = [(a, *want[None if np.isnan(i) else i], dev) for i, a, dev in zip(of.vec_id, of.whitened, of.deviation)]
        sign = np.sign(sum(a * b for a, b, *_ in pairs))
        assert np.allclose([a for a, *_ in pairs], [sign * b for _, b, *_ in pairs], atol=1e-8) and all(e == f for *_, e, f in pairs)


def test_whitening_without_variance(spark):
    assert wh.whiten(table(spark, [])).collect() == []
    got = wh.whiten(table(spark, [(1, [1.0, 2.0], 0), (1, [1.0, 2.0], 0)])).collect()
    assert len(got) == 4 and all(r.whitened is None and r.explained is None and r.deviation == 0 and r.identity_error is None for r in got)
    got = wh.whiten(table(spark, [(k, [float(k), 0.0, 3.0], 0) for k in range(4)])).collect()
    assert {r.component: r.whitened is None for r in got} == {1: False, 2: True, 3: True}
    huge = wh.whiten(table(spark, [(1, [1e30, 0.0], 0), (2, [-1e30, 0.0], 0)])).collect()
    assert len(huge) == 4 and all(r.deviation is None for r in huge)


def matrix(d, values, seed=1):
    q, _ = np.linalg.qr(np.random.default_rng(seed).normal(size=(d, d)))
    return q @ np.diag(values) @ q.T


@pytest.mark.parametrize("values", [np.linspace(1, 2, 40), np.append(np.ones(36), [5, 6, 7, 8]), np.append(np.zeros(38), [1, 9]), np.append(np.ones(30), [3.0] * 10), np.zeros(40)])
def test_block_lanczos_and_breakdown(values):
    a = matrix(40, values)
    got, vectors, _ = wh.block_lanczos(lambda v: a @ v, 40, 4, 3)
    assert np.allclose(got, np.sort(values)[::-1][:4], atol=1e-10)
    assert np.allclose(a @ vectors, vectors * got, atol=1e-9) and np.allclose(vectors.T @ vectors, np.eye(4), atol=1e-12)


def test_block_lanczos_restarts_within_a_small_basis():
    values = np.append(np.linspace(0, 1, 396), [1.2, 1.5, 2, 3])
    a, widest = matrix(400, values), []
    got, vectors, passes = wh.block_lanczos(lambda v: widest.append(v.shape[1]) or a @ v, 400, 4, 4, most=24)
    assert np.allclose(got, values[::-1][:4], rtol=1e-12) and passes > 6 and max(widest) == 4
    assert np.allclose(a @ vectors, vectors * got, atol=1e-9)


def mined(rows, every=10, positives=5, negatives=10, d=6):
    held = [(i, v, lb) for i, v, lb in {(i, tuple(v), lb): (i, v, lb) for i, v, lb in whole(rows, d)}.values() if i is not None and lb is not None]
    out = []
    for a, x, label in held:
        if a % every:
            continue
        scored = sorted((-int(x @ v), i, lb) for i, v, lb in held if i != a)
        for s, p, _ in [t for t in scored if t[2] == label][:positives]:
            fits = [(-m, i) for m, i, lb in scored if lb != label and 30 * -s <= 100 * -m <= 90 * -s][:negatives]
            out += [(a, p, k, i, -s, m) for k, (m, i) in enumerate(fits, 1)]
    return sorted(out)


@pytest.mark.parametrize(("leaf", "anchor"), [(16, 4), (1024, 256)])
def test_hard_negatives_are_brute_force(spark, leaf, anchor):
    rows = awkward(5)
    got = hn.hard_negatives(table(spark, rows), F.col("vec_id") % 10 == 0, leaf_rows=leaf, anchor_rows=anchor)
    assert sorted(map(tuple, got.collect())) == mined(rows)


def test_hard_negatives_of_few_rows(spark):
    assert hn.hard_negatives(table(spark, []), F.col("vec_id") % 10 == 0).collect() == []
    assert hn.hard_negatives(table(spark, [(1, [1.0], 0), (2, [2.0], 0)]), F.col("vec_id") % 10 == 0).collect() == []
    assert hn.hard_negatives(table(spark, [(10, [1.0], 0), (2, [2.0], 1)]), F.col("vec_id") % 10 == 0).collect() == []  # no positive
    rows = [(10, [1.0, 0.0], 0), (2, [2.0, 0.0], 0), (3, [1.0, 1.0], 1), (4, [-1.0, 0.0], 0), (20, [0.0, 0.0], 1)]
    got = hn.hard_negatives(table(spark, rows), F.col("vec_id") % 10 == 0)
    assert sorted(map(tuple, got.collect())) == mined(rows, d=2)


def test_walked_pairs_lose_nothing_and_prune_groups():
    r = np.random.default_rng(2)
    x = np.concatenate([r.normal(k * 40 - 80, 1, (200, 5)) for k in range(5)])
    trees = []
    for levels in (4, 3):
        t = hn.planted(x, levels)
        leaf = t.leaf(x)
        centre = np.array([x[leaf == k].mean(axis=0) if (leaf == k).any() else np.zeros(5) for k in range(2**levels)])
        radius = np.array([np.linalg.norm(x[leaf == k] - centre[k], axis=1).max(initial=0) for k in range(2**levels)])
        trees.append((hn._balls(t, centre, radius, np.bincount(leaf, minlength=2**levels)), leaf))
    (a, la), (c, lc) = trees
    low, high = np.full(16, 20000.0), np.full(16, 1e9)
    pairs = set(zip(*(p.tolist() for p in hn.walked(a, c, low, high)), strict=True))
    i, j = np.nonzero(x @ x.T >= 20000)
    assert set(zip(la[i].tolist(), lc[j].tolist(), strict=True)) <= pairs and len(pairs) < 16 * 8 / 2
