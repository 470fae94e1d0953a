"""Number, centroid and covariance within a radius, without handing on pairs."""

import numpy as np
import pytest

from terrafold import catalog
from terrafold.operators import joins

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("most", [50_000, 60])
def test_moments_are_brute_force_with_copies(spark, most):
    r = np.random.default_rng(7)
    xyz = np.vstack([r.normal(0, 1.5, (1500, 3)), r.uniform(40, 90, (5, 3)), np.repeat(r.uniform(200, 300, (1, 3)), 70, axis=0)])
    p = spark.createDataFrame([(k % 2, k, *map(float, x)) for k, x in enumerate(xyz)], "frame int, pt long, x double, y double, z double")
    got = {x.pt: x for x in joins.radius_moments(p.where("pt % 5 = 0"), p, 2.25, "pt", ["frame"], most=most).collect()}
    assert sorted(got) == list(range(0, len(xyz), 5))
    for k, x in got.items():
        near = xyz[[n for n in range(len(xyz)) if n % 2 == k % 2 and ((xyz[k] - xyz[n]) ** 2).sum() < 2.25]]
        c = np.cov(near.T, bias=True)
        assert x.n == len(near) and np.allclose([x.m0, x.m1, x.m2], near.mean(axis=0), atol=1e-9)
        assert np.allclose([x.c00, x.c01, x.c02, x.c11, x.c12, x.c22], c[np.triu_indices(3)], atol=1e-9)
        if k >= 1505:  # copies of one point have no spread at all
            assert [x.c00, x.c01, x.c02, x.c11, x.c12, x.c22] == [0.0] * 6


@pytest.mark.parametrize("name", ["neighbor_eigen", "neighbor_covariance", "radius_count"])
def test_queries_hand_on_no_pairs(spark, monkeypatch, name):
    monkeypatch.setattr(joins, "radius_join", None)
    assert catalog.QUERIES[name](spark, SF).count() == 525
