"""Map matching finds the pose of turns with few points, too."""

from pyspark.sql import functions as F

from terrafold import catalog
from terrafold import views as V
from terrafold.operators import registration
from terrafold.plans import scene_queries

SF = "/root/testdata/sf0.001"


def test_half_filled_turns_find_their_pose(spark, monkeypatch):
    whole, frames = V.points, [2, 7, 9]
    monkeypatch.setattr(V, "points", lambda *a: whole(*a).where(F.col("frame").isin(frames) & (F.floor(F.col("pt") / 21) % 2 == 0)))
    want = {r.frame: r for r in scene_queries._small_poses(spark, SF).collect()}
    got = catalog.QUERIES["map_match_gn"](spark, SF).collect()
    assert sorted(r.turn for r in got) == frames
    for r in got:
        assert all(abs(r[c] - want[r.turn][c]) < 2e-5 for c in registration.POSE), r
