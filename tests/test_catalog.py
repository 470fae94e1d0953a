"""Every query with SQL equals it on the small tables; the others return rows."""

import os

import duckdb
import pytest

from terrafold import catalog

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


def _sorted(rows, columns):
    order = [columns.index(c) for c in sorted(columns)]
    return sorted((tuple(r[i] for i in order) for r in rows), key=lambda r: [(x is None, 0 if x is None else x) for x in r])


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, duck, name):
    df = catalog.QUERIES[name](spark, SF)
    got = [tuple(r) for r in df.collect()]
    if name not in catalog.ORACLES:
        assert got
        return
    want = duck.sql(catalog.ORACLES[name])
    assert sorted(df.columns) == sorted(want.columns)
    a, b = _sorted(got, df.columns), _sorted(want.fetchall(), want.columns)
    assert len(a) == len(b)
    for x, y in zip(a, b, strict=True):
        assert x == y or all(p == q or isinstance(p, float) and abs(p - q) <= 2e-6 * max(1, abs(p)) for p, q in zip(x, y, strict=True)), (x, y)


def test_patch_homographies_take_every_row(spark, monkeypatch):
    from terrafold import views as V
    from terrafold.operators import inpaint

    seen, whole = [], inpaint.homographies
    monkeypatch.setattr(inpaint, "homographies", lambda pairs, *a, **k: seen.append(pairs) or whole(pairs, *a, **k))
    catalog.QUERIES["patch_homographies"](spark, SF)
    assert seen[0].count() == V.pixels(spark, SF).select("u", "v").distinct().count()


def test_ring_angles_gathers_nothing(spark):
    plan = catalog.QUERIES["ring_angles"](spark, SF)._jdf.queryExecution().toString()
    assert "collect_list" not in plan
