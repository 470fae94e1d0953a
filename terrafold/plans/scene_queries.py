"""Solver and scene queries; most have no SQL form."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from .. import views as V
from ..functions import geometry as g
from ..operators import aggs, dense_map, joins, mrf, poses, raster, registration
from ..storage import written
from .registry import Registry, rounded

query = Registry()
QUERIES, ORACLES = query.queries, query.oracles

#: Row-major Ry Rx Rz of a pose, in SQL.
_ROTATION_SQL = ", ".join(f"{e} AS m{k // 3}{k % 3}" for k, e in enumerate(("cos(ry)*cos(rz)+sin(ry)*sin(rx)*sin(rz)", "sin(ry)*sin(rx)*cos(rz)-cos(ry)*sin(rz)", "sin(ry)*cos(rx)", "cos(rx)*sin(rz)", "cos(rx)*cos(rz)", "-sin(rx)", "cos(ry)*sin(rx)*sin(rz)-sin(ry)*cos(rz)", "sin(ry)*sin(rz)+cos(ry)*sin(rx)*cos(rz)", "cos(ry)*cos(rx)")))


def _turns(spark, sf_dir):
    return V.turns(V.points(spark, sf_dir))


_SMALL = "SELECT frame, rx/20 AS rx, ry/20 AS ry, rz/20 AS rz, tx/20 AS tx, ty/20 AS ty, tz/20 AS tz FROM poses"
_TURNS = "SELECT *, (pt // 4200) * 1000 + frame AS turn, CASE WHEN ring % 3 = 0 THEN 'corner' ELSE 'surface' END AS kind FROM points"


def _features(points):
    return points.withColumn("kind", F.when(F.col("ring") % 3 == 0, "corner").otherwise("surface"))


def _small_poses(spark, sf_dir):
    return V.poses(spark, sf_dir).select("frame", *((F.col(c) / 20).alias(c) for c in registration.POSE))


def _moved_turns(spark, sf_dir):
    """Each turn's features, and the same seen from a sensor that moved in between: the motion has to be found again."""
    last = _features(_turns(spark, sf_dir)).select("frame", "turn", "kind", "pt", "ring", "x", "y", "z")
    moved = last.join(_small_poses(spark, sf_dir), "frame")
    at = tuple(a + b for a, b in zip(g.rotate_yxz(g.vec(), F.col("ry"), F.col("rx"), F.col("rz")), g.vec("t"), strict=True))
    return moved.select("turn", "kind", "pt", *(a.alias(c) for a, c in zip(at, "xyz", strict=True)), F.lit(1.0).alias("share")), last.drop("frame")


_KNOWN = ", ".join(f"round(CASE WHEN enough THEN {c} ELSE 0e0 END, 5) + 0e0 AS {c}" for c in registration.POSE)


@query("points poses", f"SELECT turn, {_KNOWN} FROM (SELECT turn, frame, count(*) FILTER (kind = 'corner') > 10 AND count(*) FILTER (kind = 'surface') > 100 AS enough FROM ({_TURNS}) GROUP BY 1, 2) JOIN ({_SMALL}) USING (frame)")
def odometry_gn(spark, sf_dir):
    """The motion of each turn's sensor, found from both sweeps' points alone: SQL has the motion that was put in."""
    points, last = _moved_turns(spark, sf_dir)
    out = registration.odometry(points, last, ["turn"], iterations=10, every=2, step_scale=1.0, stop=(0.0, 0.0))
    return rounded(out.drop("used"), " ".join(registration.POSE), 5)


def _sums_sql() -> str:
    cross = "(({0}y-{1}y)*({2}z-{3}z)-({0}z-{1}z)*({2}y-{3}y)) AS {4}x, (({0}z-{1}z)*({2}x-{3}x)-({0}x-{1}x)*({2}z-{3}z)) AS {4}y, (({0}x-{1}x)*({2}y-{3}y)-({0}y-{1}y)*({2}x-{3}x)) AS {4}z"
    entries = ["ny*z-nz*y", "nz*x-nx*z", "nx*y-ny*x", "-nx", "-ny", "-nz"]
    sums = ", ".join([f"round(sum(a{i}*a{j}), 3) + 0e0 AS a{i}{j}" for i in range(6) for j in range(i, 6)] + [f"round(sum(a{i}*b), 3) + 0e0 AS b{i}" for i in range(6)])
    point = lambda n: ", ".join(f"{n}.{c} AS {n}{c}" for c in "xyz")
    return f"""WITH small AS ({_SMALL}), last AS ({_TURNS}),
now AS (SELECT turn, kind, pt, cos(rz)*qx - sin(rz)*qy + tx AS x, sin(rz)*qx + cos(rz)*qy + ty AS y, qz + tz AS z FROM (SELECT turn, kind, pt, rz, tx, ty, tz, wx AS qx, cos(rx)*y - sin(rx)*wz AS qy, sin(rx)*y + cos(rx)*wz AS qz FROM (SELECT turn, kind, pt, rx, rz, tx, ty, tz, y, cos(ry)*x + sin(ry)*z AS wx, cos(ry)*z - sin(ry)*x AS wz FROM last JOIN small USING (frame)))),
pairs AS (SELECT now.*, p.pt AS p_pt, p.ring AS p_ring, p.x AS px, p.y AS py, p.z AS pz, (now.x-p.x)*(now.x-p.x)+(now.y-p.y)*(now.y-p.y)+(now.z-p.z)*(now.z-p.z) AS d2 FROM now JOIN last p USING (turn, kind)),
near AS (SELECT *, first(p_pt) OVER w AS near_pt, first(p_ring) OVER w AS near_ring FROM pairs WHERE d2 < 25 WINDOW w AS (PARTITION BY kind, pt ORDER BY d2, p_pt ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)),
m AS (SELECT turn, kind, pt, x, y, z, arg_min(struct_pack(x := px, y := py, z := pz), (d2, p_pt)) AS n, arg_min(struct_pack(x := px, y := py, z := pz), (d2, p_pt)) FILTER (p_ring = near_ring AND p_pt != near_pt) AS s, arg_min(struct_pack(x := px, y := py, z := pz), (d2, p_pt)) FILTER (p_ring != near_ring AND abs(p_ring - near_ring) <= 25e-1) AS o FROM near GROUP BY 1, 2, 3, 4, 5, 6),
f AS (SELECT turn, kind, pt, x, y, z, {point("n")}, {point("s")}, {point("o")} FROM m WHERE o IS NOT NULL AND (kind = 'corner' OR s IS NOT NULL)),
c AS (SELECT *, {cross.format("", "n", "", "o", "c")}, {cross.format("s", "n", "o", "n", "p")}, sqrt((nx-ox)*(nx-ox)+(ny-oy)*(ny-oy)+(nz-oz)*(nz-oz)) AS l FROM f),
d AS (SELECT *, sqrt(cx*cx+cy*cy+cz*cz) AS area, sqrt(px*px+py*py+pz*pz) AS size FROM c),
e AS (SELECT turn, x, y, z, CASE WHEN kind = 'corner' THEN area / l ELSE (px*(x-nx)+py*(y-ny)+pz*(z-nz)) / size END AS d,
CASE WHEN kind = 'corner' THEN ((ny-oy)*cz-(nz-oz)*cy) / (area*l) ELSE px / size END AS gx, CASE WHEN kind = 'corner' THEN ((nz-oz)*cx-(nx-ox)*cz) / (area*l) ELSE py / size END AS gy, CASE WHEN kind = 'corner' THEN ((nx-ox)*cy-(ny-oy)*cx) / (area*l) ELSE pz / size END AS gz FROM d),
r AS (SELECT turn, {", ".join(f"{t} AS a{k}" for k, t in enumerate(entries))}, -d AS b FROM (SELECT turn, x, y, z, d, gx AS nx, gy AS ny, gz AS nz FROM e WHERE d != 0))
SELECT turn, {sums}, count(*) AS n FROM r GROUP BY 1"""


@query("points poses", _sums_sql())
def odometry_sums(spark, sf_dir):
    """The first iteration of the above: correspondences by rings, residuals, weights and the 28 sums of each turn."""
    points, last = _moved_turns(spark, sf_dir)
    matched = registration.ring_matches(points, last, ["turn", "kind"])
    still = matched.select("*", *(F.lit(0.0).alias(c) for c in registration.POSE))
    sums = aggs.normal_equations(registration.sweep_residuals(still, False), [f"a{k}" for k in range(6)], "b", ["turn"], "b")
    return rounded(sums.where("n > 0"), " ".join(c for c in sums.columns if c not in ("turn", "n")), 3)


def _walls(points):
    """The points drawn to walls, floors (surfaces, three storeys apart) and edges (corners), in turns of up to 10,500 neighbours."""
    x, y, z = (F.col(c) / 2 for c in "xyz")
    storey = F.when(z < -0.5, 0).when(z > 0.5, 2).otherwise(1)
    odd = lambda c: 2 * F.floor(c / 2) + 1.0
    rows = _features(points).select("frame", (F.floor(F.col("pt") / 10_500) * 1000 + F.col("frame")).alias("turn"), "kind", "pt", x.alias("x"), y.alias("y"), (z + 3 * (storey - 1)).alias("z"), storey.alias("storey"))
    drawn = [F.when(F.when(F.col("kind") == "corner", F.lit(k < 2)).otherwise(F.col("storey") == k), odd(F.col(c))).otherwise(F.col(c)).alias(c) for k, c in enumerate("xyz")]
    return rows.select("frame", "turn", "kind", "pt", *drawn)


@query("points poses", f"SELECT turn, {_KNOWN} FROM (SELECT turn, frame, count(*) FILTER (ring % 3 = 0) > 10 AND count(*) FILTER (ring % 3 > 0) > 100 AS enough FROM (SELECT *, (pt // 10500) * 1000 + frame AS turn FROM points) GROUP BY 1, 2) JOIN ({_SMALL}) USING (frame)")
def map_match_gn(spark, sf_dir):
    """The pose of each turn in a map of walls and edges, from its points alone: lines and planes through the five nearest map points. SQL has the pose that was put in.

    A direction's eigenvalue is at most the number of rows that fix it: below one, not even one row does. The operator's own floor of 100 is made for whole
    sweeps and leaves out, in turns of a few hundred rows, directions that these do fix.
    """
    world = _walls(V.points(spark, sf_dir))
    local = world.join(_small_poses(spark, sf_dir), "frame")
    points = local.select("turn", "kind", "pt", *(a.alias(c) for a, c in zip(g.to_local(g.vec()), "xyz", strict=True)))
    start = world.select("turn").distinct().select("turn", *(F.lit(0.0).alias(c) for c in registration.POSE))
    out = registration.map_match(points, world.drop("frame"), start, ["turn"], stop=(1e-4, 1e-4), iterations=8, eigen_floor=1.0)
    return rounded(out.drop("used"), " ".join(registration.POSE), 5)


def _walk_sql() -> str:
    m = {(i, j): f"m{i}{j}" for i in range(3) for j in range(3)}
    t = ("tx", "ty", "tz * 105e-2")
    inverse = ", ".join([f"{m[j, i]} AS i{i}{j}" for i in range(3) for j in range(3)] + [f"-({' + '.join(f'{m[k, i]}*{t[k]}' for k in range(3))}) AS i{i}3" for i in range(3)])
    start = ", ".join(f"i{i}{j}" for i in range(3) for j in range(4))
    names = ", ".join(f"p{i}{j}" for i in range(3) for j in range(4))
    times = ", ".join(" + ".join(f"w.p{i}{k}*i.i{k}{j}" for k in range(3)) + (f" + w.p{i}3" if j == 3 else "") for i in range(3) for j in range(4))
    rotation = _ROTATION_SQL.replace("ry)", "ry*105e-2)")
    return f"""WITH d AS (SELECT ring, us // 86400000000 AS day, avg(value)/1e4 AS rz, count(*)/100 AS tx FROM ev GROUP BY 1, 2), s AS (SELECT ring, day, row_number() OVER (PARTITION BY ring ORDER BY day) AS k, 0e0 AS rx, 1e-2 AS ry, rz, tx, 1e-1 AS ty, 0e0 AS tz FROM d),
r AS (SELECT *, {rotation} FROM s), i AS MATERIALIZED (SELECT ring, day, k, {inverse} FROM r),
w(ring, day, k, {names}) AS (SELECT ring, day, k, {start} FROM i WHERE k = 1 UNION ALL SELECT i.ring, i.day, i.k, {times} FROM w JOIN i ON i.ring = w.ring AND i.k = w.k + 1)
SELECT ring, day, round(asin(greatest(-1e0, least(1e0, -p12))), 5) + 0e0 AS rx, round(atan2(p02, p22), 5) + 0e0 AS ry, round(atan2(p10, p11), 5) + 0e0 AS rz, round(p03, 5) + 0e0 AS tx, round(p13, 5) + 0e0 AS ty, round(p23, 5) + 0e0 AS tz FROM w"""


@query("ev", _walk_sql())
def pose_accumulation(spark, sf_dir):
    """Relative poses of a sequence (one user's days) composed in order: a scan over buckets of eight days."""
    ev = V.events(spark, sf_dir).withColumn("day", F.floor(F.col("us") / 86_400_000_000))
    steps = ev.groupBy("ring", "day").agg((F.avg("value") / 1e4).alias("rz"), (F.count("*") / 100).alias("tx"))
    steps = steps.select("ring", "day", F.lit(0.0).alias("rx"), F.lit(0.01).alias("ry"), "rz", "tx", F.lit(0.1).alias("ty"), F.lit(0.0).alias("tz"))
    return rounded(poses.accumulate(steps, ["ring"], "day", 8), "rx ry rz tx ty tz", 5)


def _associate_sql() -> str:
    rotation = lambda p: _ROTATION_SQL.replace("(r", f"({p}.r").replace(" AS m", f" AS {p}")
    at = lambda i, j: "(" + " + ".join(f"a{i}{k}*b{n}{k}*o{n}{j}" for k in range(3) for n in range(3)) + ")"
    shift = lambda i: "(atx + ".replace("atx", f"at{'xyz'[i]}") + " + ".join(f"a{i}{k}*b{n}{k}*(ot{'xyz'[n]}-bt{'xyz'[n]})" for k in range(3) for n in range(3)) + ")"
    carried = ", ".join(f"{p}.t{c} AS {p}t{c}" for p in "oba" for c in "xyz")
    return f"""WITH m AS (SELECT o.frame, {rotation("o")}, {rotation("b")}, {rotation("a")}, {carried} FROM poses o JOIN poses b ON b.frame = o.frame - 1 JOIN poses a ON a.frame = o.frame - 2)
SELECT frame, round(asin(-{at(1, 2)}), 6) + 0e0 AS rx, round(atan2({at(0, 2)}, {at(2, 2)}), 6) + 0e0 AS ry, round(atan2({at(1, 0)}, {at(1, 1)}), 6) + 0e0 AS rz, {", ".join(f"round({shift(i)}, 6) + 0e0 AS t{c}" for i, c in enumerate("xyz"))} FROM m"""


@query("poses", _associate_sql())
def associate_poses(spark, sf_dir):
    """Each frame's pose as odometry, the frame before as the odometry and the one before that as the map pose of the last correction."""
    p = V.poses(spark, sf_dir)
    older = lambda n, name: p.select((F.col("frame") + n).alias("frame"), *(F.col(c).alias(f"{name}{c}") for c in poses.POSE))
    rows = p.join(older(1, "before_"), "frame").join(older(2, "mapped_"), "frame")
    return rounded(poses.associate(rows).select("frame", *poses.POSE), " ".join(poses.POSE))


@query()
def bp_labels(spark, sf_dir):
    """Belief propagation over a small mask a frame: three candidates a pixel."""
    cells = V.points(spark, sf_dir).groupBy("frame", (F.col("ring") % 7).alias("v"), F.floor(F.col("ring") / 7).alias("u")).agg(F.avg("x").alias("a"), F.avg("y").alias("b"), F.avg("z").alias("c"))
    costs = F.array(*(F.abs(F.col(n)) for n in "abc"))
    colour = F.array(*(F.array(F.round(F.col(n) * 10), F.round(F.col(n) * 5), F.lit(0.0)) for n in "abc"))
    rows = cells.select("frame", "v", "u", costs.alias("cost"), colour.alias("colour"), F.array(colour, colour, colour, colour).alias("side"))
    return mrf.label_masks(rows, ["frame"])


def _pair_entries(k: tuple[str, str, str] = ("5e1", "32e0", "24e0")) -> list[str]:
    at = lambda i, j: "(" + " + ".join(f"b.m{k}{i}*" + (f"a.m{k}{j}" if j < 3 else f"(a.t{'xyz'[k]}-b.t{'xyz'[k]})") for k in range(3)) + ")"
    turned = lambda i, j: at((i + 2) % 3, (j + 2) % 3 if j < 3 else 3)
    focal, middle_u, middle_v = k
    return [f"{focal}*{turned(0, j)} + {middle_u}*{turned(2, j)}" for j in range(4)] + [f"{focal}*{turned(1, j)} + {middle_v}*{turned(2, j)}" for j in range(4)] + [turned(2, j) for j in range(4)]


def _pair_sql() -> str:
    return f"WITH m AS (SELECT *, {_ROTATION_SQL} FROM poses) SELECT a.frame, b.frame AS to_frame, " + ", ".join(f"round({e}, 6) + 0e0 AS p{k}" for k, e in enumerate(_pair_entries())) + " FROM m a, m b WHERE abs(a.frame - b.frame) <= 2"


#: The camera of the scene queries: 32 x 24 pixels, eight units behind the sensor.
CAMERA, SHIFT, WIDE, HIGH = np.array([[25.0, 0, 16], [0, 25, 12], [0, 0, 1]]), np.array([0.0, 0, 8]), 32, 24


def _scene(spark, sf_dir):
    """Points in the image with their pixels, those of them in no box (what stays), and the masks of all frames."""
    seen = raster.project_points(V.points(spark, sf_dir), (CAMERA @ np.c_[np.eye(3), SHIFT]).ravel().tolist(), WIDE, HIGH)
    boxes = joins.box_cells(V.boxes(spark, sf_dir))
    boxed, left = (joins.by_boxes(seen, boxes, inside=inside) for inside in (True, False))
    masks = raster.dilate(boxed.select("frame", "u", "v"), 1, 1, ["frame"]).where(f"u between 0 and {WIDE - 1} and v between 0 and {HIGH - 1}")
    return seen, left, written(masks, "masks")


def _dense_fill(spark, sf_dir, order):
    seen, left, masks = _scene(spark, sf_dir)
    # one row a pixel is written, so that no round of the searches goes back to the points
    known = written(aggs.zbuffer(left, ["frame", "u", "v"], "z_cam", "pt").withColumnRenamed("pt", "key"), "known")
    depth = raster.local_depth(known, masks, ["frame"], 10)
    at = g.back_project(F.col("u"), F.col("v"), F.col("depth"), np.linalg.inv(CAMERA), np.eye(3), SHIFT.tolist())
    wanted = depth.select("frame", "u", "v", "depth", *(c.alias(n) for c, n in zip(at, "xyz", strict=True)))
    image = aggs.zbuffer(seen.withColumn("key", F.struct("pt", "ring")), ["frame", "u", "v"], "z_cam", "key")
    image = image.select("frame", "u", "v", F.col("key.ring").alias("colour"))
    out = dense_map.fill(wanted, V.poses(spark, sf_dir), masks, image, CAMERA, np.c_[np.eye(3), SHIFT], WIDE, HIGH, order=order)
    return out.select("frame", "u", "v", "source", "colour", "label")


def _dense_sql(rank: str) -> str:
    inside = f"u BETWEEN 0 AND {WIDE - 1} AND v BETWEEN 0 AND {HIGH - 1}"
    entries = _pair_entries(("25e0", "16e0", "12e0"))
    projection = ", ".join(f"{e} + {(128, 96, 8)[k // 4] if k % 4 == 3 else 0}e0 AS p{k}" for k, e in enumerate(entries))
    return f"""WITH c AS (SELECT frame, pt, ring, x, y, z, CAST(trunc((25e0*x + 16e0*z + 128)/(z + 8) + 5e-1) AS INT) AS u, CAST(trunc((25e0*y + 12e0*z + 96)/(z + 8) + 5e-1) AS INT) AS v, z + 8 AS w FROM points),
seen AS MATERIALIZED (SELECT * FROM c WHERE w > 0 AND {inside}),
boxed AS MATERIALIZED (SELECT DISTINCT frame, pt, u, v FROM seen JOIN boxes b USING (frame) WHERE abs(x - cx) <= hx AND abs(y - cy) <= hy AND abs(z - cz) <= hz),
masks AS MATERIALIZED (SELECT DISTINCT frame, CAST(u + i AS INT) AS u, CAST(v + j AS INT) AS v FROM boxed, range(-1, 2) a(i), range(-1, 2) b(j) WHERE u + i BETWEEN 0 AND {WIDE - 1} AND v + j BETWEEN 0 AND {HIGH - 1}),
known AS MATERIALIZED (SELECT frame, u, v, min(w) AS depth FROM seen ANTI JOIN boxed USING (frame, pt) GROUP BY 1, 2, 3),
near AS (SELECT m.frame, m.u, m.v, k.depth, sqrt(CAST((m.u-k.u)*(m.u-k.u) + (m.v-k.v)*(m.v-k.v) AS DOUBLE)) AS d FROM masks m JOIN known k USING (frame) QUALIFY row_number() OVER (PARTITION BY m.frame, m.u, m.v ORDER BY (m.u-k.u)*(m.u-k.u) + (m.v-k.v)*(m.v-k.v), k.v, k.u) <= 10),
filled AS MATERIALIZED (SELECT frame, u, v, coalesce(avg(CASE WHEN d = 0 THEN depth END), sum(CASE WHEN d > 0 THEN depth / d END) / sum(CASE WHEN d > 0 THEN 1 / d END)) AS depth FROM near GROUP BY 1, 2, 3),
smooth AS (SELECT a.frame, a.u, a.v, median(b.depth) AS d FROM filled a JOIN filled b ON a.frame = b.frame AND abs(a.u-b.u) <= 2 AND abs(a.v-b.v) <= 2 GROUP BY 1, 2, 3),
wanted AS MATERIALIZED (SELECT frame, u, v, (u - 16e0)/25*d AS x, (v - 12e0)/25*d AS y, d - 8 AS z FROM smooth),
m AS (SELECT *, {_ROTATION_SQL} FROM poses),
pairs AS (SELECT a.frame, b.frame AS source, {projection} FROM m a, m b),
hits AS (SELECT frame, u, v, source, CAST(trunc((p0*x+p1*y+p2*z+p3)/(p8*x+p9*y+p10*z+p11) + 5e-1) AS INT) AS su, CAST(trunc((p4*x+p5*y+p6*z+p7)/(p8*x+p9*y+p10*z+p11) + 5e-1) AS INT) AS sv, {rank} AS rank FROM wanted JOIN pairs USING (frame) WHERE p8*x+p9*y+p10*z+p11 > 0 AND {rank} IS NOT NULL),
first AS (SELECT frame, u, v, arg_min(struct_pack(source := source, su := su, sv := sv), rank) AS s FROM hits ANTI JOIN masks q ON q.frame = source AND q.u = su AND q.v = sv WHERE su BETWEEN 0 AND {WIDE - 1} AND sv BETWEEN 0 AND {HIGH - 1} GROUP BY 1, 2, 3),
img AS (SELECT frame, u, v, arg_min(ring, struct_pack(w := w, pt := pt)) AS colour FROM seen GROUP BY 1, 2, 3),
o AS (SELECT frame, u, v, coalesce(s.source, frame) AS source, coalesce(s.su, u) AS su, coalesce(s.sv, v) AS sv FROM wanted LEFT JOIN first USING (frame, u, v))
SELECT o.frame, o.u, o.v, source, colour, CAST((source - (SELECT min(frame) FROM poses)) % 255 AS INT) AS label FROM o LEFT JOIN img ON img.frame = source AND img.u = su AND img.v = sv"""


@query("points boxes poses", _dense_sql("CASE WHEN source > frame THEN source - frame WHEN source < frame - 1 THEN 1000 + frame - source END"))
def dense_fill(spark, sf_dir):
    """Flagship fill: depth at the masked pixels of each frame, back-projection, the first frame along time that sees the point unmasked, its colour."""
    return _dense_fill(spark, sf_dir, "forward")


@query("points boxes poses", _dense_sql("CASE WHEN source > frame THEN 1000 + source - frame WHEN source < frame - 1 THEN frame - source END"))
def dense_fill_backward(spark, sf_dir):
    return _dense_fill(spark, sf_dir, "backward")


@query("points boxes poses", _dense_sql("CASE WHEN source > frame THEN 2 * (source - frame) WHEN source < frame - 1 THEN 2 * (frame - source - 1) + 1 END"))
def dense_fill_interleaved(spark, sf_dir):
    return _dense_fill(spark, sf_dir, "interleaved")


@query("points", """WITH t AS (SELECT pt, (pt // 4200) * 1000 + frame AS turn, -atan2(y, x) AS o FROM points), s AS (SELECT *, first(o) OVER w AS s, last(o) OVER w + 2*pi() AS e0 FROM t WINDOW w AS (PARTITION BY turn ORDER BY pt ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)),
e AS (SELECT *, CASE WHEN e0 - s > 3*pi() THEN e0 - 2*pi() WHEN e0 - s < pi() THEN e0 + 2*pi() ELSE e0 END AS e, CASE WHEN o < s - pi()/2 THEN o + 2*pi() WHEN o > s + pi()*3/2 THEN o - 2*pi() ELSE o END AS a FROM s),
h AS (SELECT *, coalesce(max(CASE WHEN a - s > pi() THEN 1 ELSE 0 END) OVER (PARTITION BY turn ORDER BY pt ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) = 1 AS half, o + 2*pi() AS o2 FROM e),
u AS (SELECT *, CASE WHEN NOT half THEN a WHEN o2 < e - pi()*3/2 THEN o2 + 2*pi() WHEN o2 > e + pi()/2 THEN o2 - 2*pi() ELSE o2 END AS b FROM h)
SELECT pt, round((b - s)/(e - s), 5) + 0e0 AS sweep_share FROM u""")
def sweep_shares(spark, sf_dir):
    """Share of the sweep at each point of a turn."""
    from ..operators.windows import unwrap_sweep

    return rounded(unwrap_sweep(_turns(spark, sf_dir), ["turn"], ["pt"]).select("pt", "sweep_share"), "sweep_share", 5)


@query("poses", _pair_sql())
def pose_fusion(spark, sf_dir):
    """Camera matrices of frame pairs, composed in columns."""
    a = g.with_entries(V.poses(spark, sf_dir))
    b = a.select(F.col("frame").alias("to_frame"), *(F.col(c).alias(f"b_{c}") for c in a.columns if c != "frame"))
    pairs = a.withColumn("to_frame", F.explode(F.sequence(F.col("frame") - 2, F.col("frame") + 2))).join(b, "to_frame")
    k = np.array([[50.0, 0, 32], [0, 50, 24], [0, 0, 1]])
    names = [f"p{i}" for i in range(12)]
    return rounded(pairs.select("frame", "to_frame", *(c.alias(n) for c, n in zip(g.pair_projection(k, np.eye(4)[:3]), names, strict=True))), " ".join(names))
