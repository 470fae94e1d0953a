"""Nearest-neighbour searches whose cost grows with the queries, not with the pairs within the radius."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from terrafold import catalog
from terrafold.operators import joins

SF = "/root/testdata/sf0.001"


def test_grown_search_is_brute_force_with_copies_and_outliers(spark):
    r = np.random.default_rng(4)
    xyz = np.vstack([r.normal(0, 0.3, (1500, 3)), r.uniform(-9, 9, (60, 3)), np.repeat(r.normal(0, 0.3, (1, 3)), 400, axis=0)])
    rows = [(k % 2, k, *map(float, p)) for k, p in enumerate(xyz)]
    p = spark.createDataFrame(rows, "frame int, pt long, x double, y double, z double")
    got = {}
    for x in joins.knn_grown(p.where("pt % 5 = 0"), p, 3, 16.0, "pt", "pt", ["frame"], where=F.col("p_pt") != F.col("pt"), spare=1).collect():
        got.setdefault(x.pt, []).append((x["rank"], x.d2, x.p_pt))
    for f, q, *a in rows:
        if q % 5 == 0:
            near = sorted((sum((s - t) * (s - t) for s, t in zip(a, b)), n) for g, n, *b in rows if g == f and n != q)
            want = [(k + 1, d, n) for k, (d, n) in enumerate(x for x in near[:3] if x[0] < 16.0)]
            assert [(k, n) for k, _, n in sorted(got.get(q, []))] == [(k, n) for k, _, n in want]


@pytest.mark.parametrize("name", ["knn1", "ring_neighbor"])
def test_searches_see_few_pairs_a_query(spark, monkeypatch, name):
    pairs, whole = [], joins.radius_join
    monkeypatch.setattr(joins, "radius_join", lambda *a, **k: pairs.append(whole(*a, **k)) or pairs[-1])
    n = catalog.QUERIES[name](spark, SF).count()
    # all pairs within the radius are 237,339 (knn1) and 23,846 (ring_neighbor)
    assert sum(p.count() for p in pairs) < 40 * n


def test_line_plane_tests_see_few_pairs_a_query(spark, monkeypatch):
    from terrafold import views as V

    pairs, whole, points = [], joins.radius_join, V.points
    monkeypatch.setattr(joins, "radius_join", lambda *a, **k: pairs.append(whole(*a, **k)) or pairs[-1])
    monkeypatch.setattr(V, "points", lambda *a: points(*a).withColumns({c: F.col(c) / 5 for c in "xyz"}))  # 125 times as dense
    n = catalog.QUERIES["line_plane_tests"](spark, SF).count()
    assert n > 400 and sum(p.count() for p in pairs) < 60 * n
