"""Point-cloud queries."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from .. import views as V
from ..functions import geometry as g
from ..functions import scalars as sc
from ..operators import aggs, joins, optimize, raster, registration
from .registry import Registry, rounded

query = Registry()
QUERIES, ORACLES = query.queries, query.oracles

#: Row-major 3 x 4 projection and its image size, shared with the SQL.
P = [50.0, 0.0, 32.0, 10.0, 0.0, 50.0, 24.0, 5.0, 0.0, 0.0, 1.0, 8.0]
_W = "(z + 8e0)"
_UV = f"SELECT *, trunc((50e0*x + 32e0*z + 10e0)/{_W} + 5e-1) AS uf, trunc((50e0*y + 24e0*z + 5e0)/{_W} + 5e-1) AS vf, {_W} AS w FROM points"


def _xyz(names="xyz", digits=6):
    return ", ".join(f"round({c}, {digits}) + 0e0 AS {c}" for c in names)


_ROT = {
    "z": lambda x, y, z, a: (f"(cos({a})*{x} - sin({a})*{y})", f"(sin({a})*{x} + cos({a})*{y})", z),
    "x": lambda x, y, z, a: (x, f"(cos({a})*{y} - sin({a})*{z})", f"(sin({a})*{y} + cos({a})*{z})"),
    "y": lambda x, y, z, a: (f"(cos({a})*{x} + sin({a})*{z})", y, f"(cos({a})*{z} - sin({a})*{x})"),
}


def _steps(source: str, first: str, turns: str, sign: str = "", last: str = "") -> str:
    """SQL for: an offset, three turns in order, an offset; each step a subquery so that terms stay short."""
    sql = f"SELECT pt, frame, ring, rx, ry, rz, tx, ty, tz, s, {first} FROM {source}"
    for t in turns:
        x, y, z = _ROT[t]("x", "y", "z", f"({sign}r{t})")
        sql = f"SELECT pt, frame, ring, rx, ry, rz, tx, ty, tz, s, {x} AS x, {y} AS y, {z} AS z FROM ({sql})"
    return f"SELECT pt, frame, ring, rx, ry, rz, tx, ty, tz, s, x{last and f' + {last}tx'} AS x, y{last and f' + {last}ty'} AS y, z{last and f' + {last}tz'} AS z FROM ({sql})"


_POSED = "(SELECT *, ring / 20e0 AS s FROM points JOIN poses USING (frame))"
_SAME = "x AS x, y AS y, z AS z"
_MINUS = "x - tx AS x, y - ty AS y, z - tz AS z"
_MINUS_S = "x - s*tx AS x, y - s*ty AS y, z - s*tz AS z"


def _posed(spark, sf_dir):
    # one row a frame: far below the broadcast threshold while frames are few, else a shuffled join
    return V.points(spark, sf_dir).join(V.poses(spark, sf_dir), "frame").withColumn("s", F.col("ring") / 20)


def _moved(df, v):
    return rounded(df.select("pt", "frame", *(c.alias(n) for c, n in zip(v, "xyz", strict=True))), "x y z")


@query("points", "SELECT frame, CAST(floor(x/4e-1) AS BIGINT) AS cx, CAST(floor(y/4e-1) AS BIGINT) AS cy, CAST(floor(z/4e-1) AS BIGINT) AS cz, count(*) AS n, round(avg(x),6)+0e0 AS x, round(avg(y),6)+0e0 AS y, round(avg(z),6)+0e0 AS z FROM points GROUP BY 1,2,3,4")
def voxel_grid(spark, sf_dir):
    return rounded(aggs.voxel_grid(V.points(spark, sf_dir), 0.4, ["frame"]), "x y z")


@query("points poses", f"SELECT pt, frame, {_xyz()} FROM ({_steps(_POSED, _SAME, 'zxy', '', ' ')})")
def rigid_transform(spark, sf_dir):
    return _moved(_posed(spark, sf_dir), g.to_map(g.vec()))


@query("points poses", f"SELECT pt, frame, {_xyz()} FROM ({_steps(_POSED, _MINUS, 'yxz', '-')})")
def inverse_transform(spark, sf_dir):
    return _moved(_posed(spark, sf_dir), g.to_local(g.vec()))


@query("points poses", f"SELECT pt, frame, {_xyz()} FROM ({_steps(_POSED, _MINUS_S, 'zxy', '-s*')})")
def motion_to_start(spark, sf_dir):
    return _moved(_posed(spark, sf_dir), g.to_start(g.vec(), F.col("s")))


@query("points poses", f"SELECT pt, frame, {_xyz()} FROM ({_steps(_POSED, _MINUS, 'zxy', '-')})")
def motion_start_from_end(spark, sf_dir):
    return _moved(_posed(spark, sf_dir), g.to_start(g.vec(), F.lit(1.0)))


@query("points poses", f"SELECT pt, frame, {_xyz()} FROM ({_steps('(' + _steps(_POSED, _MINUS_S, 'zxy', '-s*') + ')', _SAME, 'yxz', '', ' ')})")
def motion_correct(spark, sf_dir):
    return _moved(_posed(spark, sf_dir), g.to_end(g.vec(), F.col("s")))


@query("points poses", f"SELECT pt, frame, {_xyz()} FROM ({_steps('(' + _steps(_POSED, _MINUS_S, 'zxy', '-s*') + ')', _SAME, 'yxz', '25e-2*', '25e-2*')})")
def motion_to_time(spark, sf_dir):
    return _moved(_posed(spark, sf_dir), g.to_time(g.vec(), F.col("s"), F.lit(0.25)))


@query("points", "SELECT pt, y AS x, z AS y, x AS z FROM points")
def axis_swap(spark, sf_dir):
    p = V.points(spark, sf_dir)
    return p.select("pt", *(c.alias(n) for c, n in zip(g.swap_axes(g.vec()), "xyz", strict=True)))


@query("points", f"SELECT pt, frame, CAST(uf AS INT) AS u, CAST(vf AS INT) AS v, round(w,6) AS depth FROM ({_UV}) WHERE uf >= 0 AND uf < 96 AND vf >= 0 AND vf < 72 AND w > 0")
def project_pixels(spark, sf_dir):
    return raster.project_points(V.points(spark, sf_dir), P, 96, 72).select("pt", "frame", "u", "v", F.round("z_cam", 6).alias("depth"))


@query("pixels", "SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, round((u*z/5e1 - 64e-2*z) - 1e-1, 6)+0e0 AS x, round((v*z/5e1 - 48e-2*z) - 2e-1, 6)+0e0 AS y, round(z - 3e-1, 6) AS zz FROM pixels")
def back_project(spark, sf_dir):
    import numpy as np

    k_inv = np.array([[1 / 50, 0, -0.64], [0, 1 / 50, -0.48], [0, 0, 1]])
    x, y, z = g.back_project(F.col("u"), F.col("v"), F.col("z"), k_inv, np.eye(3), [0.1, 0.2, 0.3])
    keys = [F.col(f"key.{c}").alias(c) for c in ("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber")]
    return rounded(V.pixels(spark, sf_dir).select(*keys, x.alias("x"), y.alias("y"), z.alias("zz")), "x y zz")


@query("points", "SELECT pt FROM points WHERE isfinite(x) AND isfinite(y) AND isfinite(z) AND x*x+y*y+z*z >= 1e-4 AND sqrt(x*x+y*y+z*z) < 8")
def finite_nonzero(spark, sf_dir):
    v = g.vec()
    return V.points(spark, sf_dir).where(sc.finite(v) & (sc.norm2(v) >= 1e-4) & (F.sqrt(sc.norm2(v)) < 8)).select("pt")


@query("points", "SELECT pt, frame, ring FROM (SELECT *, row_number() OVER (PARTITION BY frame ORDER BY pt) AS k FROM points) WHERE (k-1) % 10 = 0")
def stride_sample(spark, sf_dir):
    from ..operators.windows import stride

    return stride(V.points(spark, sf_dir), ["frame"], ["pt"]).select("pt", "frame", "ring")


_BOXED = "EXISTS (SELECT 1 FROM boxes b WHERE b.frame = p.frame AND {} abs(p.x-b.cx) <= b.hx AND abs(p.y-b.cy) <= b.hy AND abs(p.z-b.cz) <= b.hz)"


@query("points boxes", f"SELECT pt, frame FROM points p WHERE NOT {_BOXED.format('')} AND frame IN (SELECT frame FROM boxes)")
def box_background(spark, sf_dir):
    return joins.box_anti(V.points(spark, sf_dir), V.boxes(spark, sf_dir)).select("pt", "frame")


@query("points boxes", f"SELECT pt, frame FROM points p WHERE NOT {_BOXED.format('b.conf > 3e-1 AND')}")
def box_confidence_filter(spark, sf_dir):
    return joins.box_anti(V.points(spark, sf_dir), V.boxes(spark, sf_dir), min_conf=0.3, missing_labels="keep").select("pt", "frame")


_MASKED = "EXISTS (SELECT 1 FROM mask m WHERE m.u = floor(p.x) AND m.v = floor(p.y))"


def _floored(spark, sf_dir):
    return V.points(spark, sf_dir).select("pt", "frame", F.floor("x").alias("u"), F.floor("y").alias("v"))


@query("points mask", f"SELECT pt FROM points p WHERE {_MASKED}")
def mask_semi(spark, sf_dir):
    return _floored(spark, sf_dir).join(V.mask(spark, sf_dir), ["u", "v"], "left_semi").select("pt")


@query("points mask", f"SELECT pt FROM points p WHERE NOT {_MASKED}")
def mask_anti(spark, sf_dir):
    return _floored(spark, sf_dir).join(V.mask(spark, sf_dir), ["u", "v"], "left_anti").select("pt")


@query("points mask", "SELECT DISTINCT m.u + i AS u, m.v + j AS v FROM mask m, range(-2,3) a(i), range(-1,2) b(j)")
def mask_dilate(spark, sf_dir):
    return raster.dilate(V.mask(spark, sf_dir), 2, 1).select("u", "v")


@query("points mask", "SELECT DISTINCT m.u + i AS u, m.v + j AS v FROM mask m, range(-2,3) a(i), range(-1,2) b(j) EXCEPT SELECT u, v FROM mask")
def mask_xor(spark, sf_dir):
    m = V.mask(spark, sf_dir)
    return raster.mask_xor(raster.dilate(m, 2, 1), m, ["u", "v"]).select("u", "v")


@query("points mask", "SELECT DISTINCT m.u + i AS u, m.v + j AS v FROM mask m, range(-6,7) a(i), range(-3,4) b(j) WHERE abs(i) <= floor(4e0 * sqrt(1 - j*j/4e0) + 5e-1) AND abs(j) <= 2")
def mask_dilate_ellipse(spark, sf_dir):
    return raster.dilate_ellipse(V.mask(spark, sf_dir), 4, 2).select("u", "v")


@query("points mask", "SELECT i AS u, j AS v FROM range(16) a(i), range(16) b(j) WHERE NOT EXISTS (SELECT 1 FROM mask m WHERE m.u = i AND m.v = j)")
def mask_complement(spark, sf_dir):
    return raster.complement(V.mask(spark, sf_dir), 16, 16).select("u", "v")


_D2 = "(q.x-p.x)*(q.x-p.x)+(q.y-p.y)*(q.y-p.y)+(q.z-p.z)*(q.z-p.z)"
_PAIRS = f"SELECT q.frame, q.pt, p.pt AS p_pt, p.ring AS p_ring, p.x AS px, p.y AS py, p.z AS pz, {_D2} AS d2 FROM points q JOIN points p ON q.frame = p.frame WHERE q.pt % 20 = 0 AND {_D2} < "


def _queries(spark, sf_dir):
    """Searches take the rows whose id is divisible by 20 as queries, against all points."""
    return V.points(spark, sf_dir).where("pt % 20 = 0")


@query("points", f"SELECT frame, pt, p_pt, CAST(rank AS INT) AS rank, round(d2,6) AS d2 FROM (SELECT *, row_number() OVER (PARTITION BY frame, pt ORDER BY d2, p_pt) AS rank FROM ({_PAIRS} 1e0)) WHERE rank <= 5")
def knn5(spark, sf_dir):
    return joins.knn_grown(_queries(spark, sf_dir), V.points(spark, sf_dir), 5, 1.0, "pt", "pt", ["frame"]).select("frame", "pt", "p_pt", "rank", F.round("d2", 6).alias("d2"))


@query("points", f"SELECT frame, pt, p_pt, round(d2,6) AS d2 FROM (SELECT *, row_number() OVER (PARTITION BY frame, pt ORDER BY d2, p_pt) AS rank FROM ({_PAIRS} 25e0) WHERE p_pt != pt) WHERE rank = 1")
def knn1(spark, sf_dir):
    near = joins.knn_grown(_queries(spark, sf_dir), V.points(spark, sf_dir), 1, 25.0, "pt", "pt", ["frame"], where=F.col("p_pt") != F.col("pt"), spare=1)
    return near.select("frame", "pt", "p_pt", F.round("d2", 6).alias("d2"))


@query("points", f"SELECT frame, pt, count(*) AS n FROM ({_PAIRS} 225e-2) GROUP BY 1, 2")
def radius_count(spark, sf_dir):
    return joins.radius_moments(_queries(spark, sf_dir), V.points(spark, sf_dir), 2.25, "pt", ["frame"]).select("frame", "pt", "n")


@query("points", f"""WITH pairs AS (SELECT *, first(p_pt) OVER w AS near, first(p_ring) OVER w AS near_ring FROM ({_PAIRS} 4e0) WHERE p_pt != pt
WINDOW w AS (PARTITION BY frame, pt ORDER BY d2, p_pt ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)), band AS (SELECT * FROM pairs WHERE abs(p_ring - near_ring) <= 25e-1)
SELECT frame, pt, first(near) AS near, arg_min(p_pt, (d2, p_pt)) FILTER (p_ring = near_ring AND p_pt != near) AS same, arg_min(p_pt, (d2, p_pt)) FILTER (p_ring != near_ring AND p_pt != near) AS other FROM band GROUP BY 1, 2""")
def ring_neighbor(spark, sf_dir):
    return joins.ring_neighbours(_queries(spark, sf_dir), V.points(spark, sf_dir), 4.0)


@query("points", f"SELECT frame, pt, round(CASE WHEN count(*) FILTER (d2 = 0) > 0 THEN avg(pz) FILTER (d2 = 0) ELSE sum(pz/sqrt(d2))/sum(1/sqrt(d2)) END, 6) + 0e0 AS z FROM ({_PAIRS} 2e0) WHERE p_pt != pt GROUP BY 1, 2")
def idw_fill(spark, sf_dir):
    pairs = joins.radius_join(_queries(spark, sf_dir), V.points(spark, sf_dir), 2.0, ["frame"]).where("p_pt != pt")
    near = pairs.select("frame", "pt", F.col("p_z").alias("z_at"), F.sqrt("d2").alias("distance"))
    return rounded(aggs.inverse_distance(near, ["frame", "pt"], "z_at", "distance").withColumnRenamed("z_at", "z"), "z")


@query("points", f"SELECT frame, pt, round(avg(px),6)+0e0 AS m0, round(avg(py),6)+0e0 AS m1, round(avg(pz),6)+0e0 AS m2, round(covar_pop(px,px),6)+0e0 AS c00, round(covar_pop(px,py),6)+0e0 AS c01, round(covar_pop(px,pz),6)+0e0 AS c02, round(covar_pop(py,py),6)+0e0 AS c11, round(covar_pop(py,pz),6)+0e0 AS c12, round(covar_pop(pz,pz),6)+0e0 AS c22 FROM ({_PAIRS} 4e0) GROUP BY 1, 2")
def neighbor_covariance(spark, sf_dir):
    near = joins.radius_moments(_queries(spark, sf_dir), V.points(spark, sf_dir), 4.0, "pt", ["frame"])
    return rounded(near.drop("n"), "m0 m1 m2 c00 c01 c02 c11 c12 c22")


#: Eigenvalues of covariances c00 … c22 from a table ``c``, in closed form.
_EIGEN = """q AS (SELECT *, (c00+c11+c22)/3 AS q FROM c), p AS (SELECT *, sqrt(((c00-q)*(c00-q)+(c11-q)*(c11-q)+(c22-q)*(c22-q)+2*(c01*c01+c02*c02+c12*c12))/6) AS p, (c00-q)*((c11-q)*(c22-q)-c12*c12) - c01*(c01*(c22-q)-c12*c02) + c02*(c01*c12-(c11-q)*c02) AS det FROM q),
f AS (SELECT *, acos(greatest(-1e0, least(1e0, CASE WHEN p > 0 THEN det/(2*p*p*p) ELSE 1e0 END)))/3 AS f FROM p), e AS (SELECT *, q + 2*p*cos(f) AS e2, q + 2*p*cos(f + 2*pi()/3) AS e0 FROM f), eigen AS (SELECT *, 3*q - e2 - e0 AS e1 FROM e)"""
_COVARIANCES = ", ".join(f"covar_pop(p{a},p{b}) AS c{i}{j}" for i, a in enumerate("xyz") for j, b in enumerate("xyz") if i <= j)


@query("points", f"WITH c AS (SELECT frame, pt, {_COVARIANCES} FROM ({_PAIRS} 4e0) GROUP BY 1, 2), {_EIGEN} SELECT frame, pt, round(e0,5)+0e0 AS e0, round(e1,5)+0e0 AS e1, round(e2,5)+0e0 AS e2, e2 > 3*e1 AS line FROM eigen")
def neighbor_eigen(spark, sf_dir):
    out = registration.with_eigen(joins.radius_moments(_queries(spark, sf_dir), V.points(spark, sf_dir), 4.0, "pt", ["frame"]))
    return rounded(out.select("frame", "pt", "e0", "e1", "e2", registration.is_line(F.col("e1"), F.col("e2")).alias("line")), "e0 e1 e2", 5)


def _fit_sql() -> str:
    sums = ", ".join([f"sum(p{i}*p{j}) AS s{i}{j}" for i, j in ("xx", "xy", "xz", "yy", "yz", "zz")] + [f"-sum(p{c}) AS s{c}" for c in "xyz"])
    minors = "syy*szz-syz*syz AS m00, sxz*syz-sxy*szz AS m01, sxy*syz-sxz*syy AS m02, sxx*szz-sxz*sxz AS m11, sxy*sxz-sxx*syz AS m12, sxx*syy-sxy*sxy AS m22"
    return f"""WITH five AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY frame, pt ORDER BY d2, p_pt) AS k, count(*) OVER (PARTITION BY frame, pt) AS n FROM ({_PAIRS} 1e0)) WHERE k <= 5 AND n >= 5),
c AS (SELECT frame, pt, {_COVARIANCES}, {sums} FROM five GROUP BY 1, 2), {_EIGEN}, m AS (SELECT *, {minors} FROM eigen), d AS (SELECT *, sxx*m00 + sxy*m01 + sxz*m02 AS dd FROM m),
w AS (SELECT *, CASE WHEN abs(dd) > 1e-12 THEN (m00*sx+m01*sy+m02*sz)/dd END AS wx, CASE WHEN abs(dd) > 1e-12 THEN (m01*sx+m11*sy+m12*sz)/dd END AS wy, CASE WHEN abs(dd) > 1e-12 THEN (m02*sx+m12*sy+m22*sz)/dd END AS wz FROM d),
far AS (SELECT frame, pt, max(abs((wx*px+wy*py+wz*pz+1)/sqrt(wx*wx+wy*wy+wz*wz))) AS worst FROM five JOIN w USING (frame, pt) GROUP BY 1, 2)
SELECT frame, pt, round(e2,5)+0e0 AS e2, e2 > 3*e1 AS line, round(worst,4)+0e0 AS worst, coalesce(worst <= 2e-1, false) AS plane FROM w JOIN far USING (frame, pt)"""


@query("points", _fit_sql())
def line_plane_tests(spark, sf_dir):
    """Whether the five nearest points of each query point lie on a line or a plane."""
    q = _queries(spark, sf_dir).select("frame", F.col("pt").alias("id"), "x", "y", "z")
    near = registration.five_nearest(q, V.points(spark, sf_dir).select("frame", "pt", "x", "y", "z"), ["frame"], "id", ["frame", "id"], joins.knn_grown)
    return rounded(registration.map_fits(near).select("frame", F.col("id").alias("pt"), "e2", "line", F.col("_worst").alias("worst"), "plane"), "e2", 5).withColumn("worst", F.round("worst", 4) + 0.0)


@query("points", "SELECT frame, round(sum(x*x),4) AS a00, round(sum(x*y),4)+0e0 AS a01, round(sum(x*z),4)+0e0 AS a02, round(sum(y*y),4) AS a11, round(sum(y*z),4)+0e0 AS a12, round(sum(z*z),4) AS a22, round(sum(x*ring),4)+0e0 AS b0, round(sum(y*ring),4)+0e0 AS b1, round(sum(z*ring),4)+0e0 AS b2, count(*) AS n FROM points GROUP BY 1")
def normal_equations(spark, sf_dir):
    return rounded(aggs.normal_equations(V.points(spark, sf_dir), ["x", "y", "z"], "ring", ["frame"]), "a00 a01 a02 a11 a12 a22 b0 b1 b2", 4)


_TURNED = "SELECT frame, pt, (i+10)*21 + j+10 AS candidate, i*1e-3 AS ax, j*1e-3 AS ay, x, y, z FROM points, range(-10,11) a(i), range(-10,11) b(j)"


@query("points", f"""WITH t AS (SELECT frame, candidate, ax, ay, x AS x0, y AS y0, z AS z0, cos(ax)*y - sin(ax)*z AS y1, sin(ax)*y + cos(ax)*z AS z1 FROM ({_TURNED})),
c AS (SELECT frame, candidate, ax, ay, abs((cos(ay)*x0 + sin(ay)*z1) - 11e-1*x0) + abs(y1 - 9e-1*y0) AS c FROM t),
m AS (SELECT frame, candidate, ax, ay, round(avg(c) FILTER (c > 0), 9) AS mean_cost FROM c GROUP BY 1,2,3,4)
SELECT frame, round(mean_cost,6) AS mean_cost, CAST(candidate AS INT) AS candidate, round(ax,6)+0e0 AS ax, round(ay,6)+0e0 AS ay FROM (SELECT *, row_number() OVER (PARTITION BY frame ORDER BY mean_cost, candidate) AS k FROM m WHERE mean_cost IS NOT NULL) WHERE k = 1""")
def rotation_grid(spark, sf_dir):
    turned = g.rot_y(g.rot_x(g.vec(), F.col("ax")), F.col("ay"))
    flat = g.rot_x(g.vec(), F.col("ax"))
    cost = F.abs(turned[0] - 1.1 * F.col("x")) + F.abs(flat[1] - 0.9 * F.col("y"))
    out = optimize.rotation_search(V.points(spark, sf_dir), cost, 1e-3, ["frame"])
    return rounded(out.select("frame", "mean_cost", F.col("candidate").cast("int"), "ax", "ay"), "mean_cost ax ay")


_SNAPS = "SELECT *, pt * 37 % 251 + 1 AS colour FROM points"


def _search_sql() -> str:
    turned = "cos(ay)*x + sin(ay)*sin(ax)*y + sin(ay)*cos(ax)*z AS cx, cos(ax)*y - sin(ax)*z AS cy, -sin(ay)*x + cos(ay)*sin(ax)*y + cos(ay)*cos(ax)*z + 8 AS cz"
    pixel = "CAST(trunc((2e3*cx + 1280*cz)/cz + 5e-1) AS INT) AS u, CAST(trunc((2e3*cy + 960*cz)/cz + 5e-1) AS INT) AS v"
    inside = "cz > 0 AND u BETWEEN 0 AND 2559 AND v BETWEEN 0 AND 1919"
    stage = lambda n, start, step: f"""t{n} AS (SELECT p.frame, pt, colour, candidate, ax, ay, {turned} FROM p JOIN (SELECT frame, (i+3)*7 + j+3 AS candidate, ax + i*{step} AS ax, ay + j*{step} AS ay FROM {start}, range(-3,4) a(i), range(-3,4) b(j)) c USING (frame)),
n{n} AS (SELECT frame, candidate, ax, ay, u, v, arg_min(colour, struct_pack(z := cz, pt := pt)) AS colour FROM (SELECT *, {pixel} FROM t{n}) WHERE {inside} GROUP BY 1,2,3,4,5,6),
m{n} AS (SELECT frame, candidate, ax, ay, round(avg(c) FILTER (c > 0), 9) AS mean_cost FROM (SELECT n.frame, candidate, ax, ay, CAST(abs(coalesce(i.colour, 0) - n.colour) AS DOUBLE) AS c FROM n{n} n LEFT JOIN img i USING (frame, u, v)) GROUP BY 1,2,3,4),
s{n} AS MATERIALIZED (SELECT * FROM m{n} WHERE mean_cost IS NOT NULL QUALIFY row_number() OVER (PARTITION BY frame ORDER BY mean_cost, candidate) = 1)"""  # noqa: E731
    return f"""WITH p AS MATERIALIZED ({_SNAPS}), f AS (SELECT DISTINCT frame, (1 + frame % 3)*1e-3 + 1e-4 AS ax, -(1 + frame % 2)*1e-3 - 1e-4 AS ay FROM p),
img AS MATERIALIZED (SELECT frame, u, v, arg_min(colour, struct_pack(z := cz, pt := pt)) AS colour FROM (SELECT *, {pixel} FROM (SELECT p.frame, pt, colour, {turned} FROM p JOIN f USING (frame))) WHERE {inside} GROUP BY 1,2,3),
z AS (SELECT DISTINCT frame, 0e0 AS ax, 0e0 AS ay FROM p), {stage(1, "z", "1e-3")}, {stage(2, "s1", "1e-4")}
SELECT frame, round(mean_cost, 6) AS mean_cost, CAST(candidate AS INT) AS candidate, round(ax, 6) + 0e0 AS ax, round(ay, 6) + 0e0 AS ay FROM s2"""


@query("points", _search_sql())
def rotation_two_stage(spark, sf_dir):
    """The turn of each frame's camera, found again from its image: steps of a thousandth, then of a tenth of that around each frame's own minimum, with a z-buffer a candidate."""
    p = V.points(spark, sf_dir).withColumn("colour", F.col("pt") * 37 % 251 + 1)
    k, shift, size = [[2000.0, 0.0, 1280.0], [0.0, 2000.0, 960.0]], [0.0, 0.0, 8.0], (2560, 1920)
    frames = p.select("frame").distinct()
    ax, ay = (1 + F.col("frame") % 3) * 1e-3 + 1e-4, -(1 + F.col("frame") % 2) * 1e-3 - 1e-4
    x, y, z = g.rot_y(g.rot_x(g.vec(), F.col("ax")), F.col("ay"))
    shot = p.join(frames.select("frame", ax.alias("ax"), ay.alias("ay")), "frame").select("frame", "pt", "colour", x.alias("x"), y.alias("y"), z.alias("z"))
    matrix = [2000.0, 0.0, 1280.0, 1280.0 * 8, 0.0, 2000.0, 960.0, 960.0 * 8, 0.0, 0.0, 1.0, 8.0]
    image = aggs.zbuffer(raster.project_points(shot, matrix, *size).withColumn("key", F.struct("pt", "colour")), ["frame", "u", "v"], "z_cam", "key").select("frame", "u", "v", "key.colour")
    start = frames.select("frame", *(F.lit(0.0).alias(c) for c in ("ax", "ay", "az")))
    out = optimize.two_stage_search(p, image, start, k, shift, *size, by=["frame"], colours=["colour"], reach=3)
    return rounded(out.select("frame", "mean_cost", F.col("candidate").cast("int"), "ax", "ay"), "mean_cost ax ay")


@query("points", "SELECT CAST(floor((20*x+25)/50) AS BIGINT) AS i, CAST(floor((20*y+25)/50) AS BIGINT) AS j, CAST(floor((20*z+25)/50) AS BIGINT) AS k, count(*) AS n FROM points GROUP BY 1,2,3")
def cube_index(spark, sf_dir):
    return V.points(spark, sf_dir).groupBy(*(sc.cube(20 * F.col(c)).alias(n) for c, n in zip("xyz", "ijk", strict=True))).agg(F.count("*").alias("n"))


_CUBES = "SELECT DISTINCT CAST(floor((20*x+25)/50) AS BIGINT) AS i, CAST(floor((20*y+25)/50) AS BIGINT) AS j, CAST(floor((20*z+25)/50) AS BIGINT) AS k FROM points"


@query("points", f"SELECT c.i, c.j, c.k, count(*) AS neighbours FROM ({_CUBES}) c JOIN ({_CUBES}) d ON abs(c.i-d.i) <= 2 AND abs(c.j-d.j) <= 2 AND abs(c.k-d.k) <= 2 GROUP BY 1,2,3")
def cube_neighbours(spark, sf_dir):
    cubes = V.points(spark, sf_dir).select(*(sc.cube(20 * F.col(c)).alias(n) for c, n in zip("xyz", "ijk", strict=True))).distinct()
    around = cubes
    for n in "ijk":
        around = around.withColumn(f"n{n}", F.explode(F.sequence(F.col(n) - 2, F.col(n) + 2)))
    hit = around.join(cubes.select(*(F.col(n).alias(f"n{n}") for n in "ijk")), ["ni", "nj", "nk"])
    return hit.groupBy("i", "j", "k").agg(F.count("*").alias("neighbours"))


_CORNER = "50*i + a.s*25 AS cx, 50*j + b.s*25 AS cy, 50*k + c.s*25 AS cz"


@query("points", f"SELECT i, j, k, bool_or(abs(cy) < cos(radians(30)) * sqrt(cx*cx + cy*cy + cz*cz)) AS visible FROM (SELECT i, j, k, {_CORNER} FROM ({_CUBES}), (VALUES (-1),(1)) a(s), (VALUES (-1),(1)) b(s), (VALUES (-1),(1)) c(s)) GROUP BY 1,2,3")
def fov_cubes(spark, sf_dir):
    cubes = V.points(spark, sf_dir).select(*(sc.cube(20 * F.col(c)).alias(n) for c, n in zip("xyz", "ijk", strict=True))).distinct()
    corners = F.array(*(F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.lit(c).alias("c")) for a in (-25, 25) for b in (-25, 25) for c in (-25, 25)))

    def inside(s):
        x, y, z = 50 * F.col("i") + s["a"], 50 * F.col("j") + s["b"], 50 * F.col("k") + s["c"]
        return F.abs(y) < 0.8660254037844387 * F.sqrt((x * x + y * y + z * z).cast("double"))

    return cubes.select("i", "j", "k", F.exists(corners, inside).alias("visible"))


@query("points", "SELECT pt, CAST(CASE WHEN d < -8.58 THEN trunc((d + 24.33)*2 + 5e-1) ELSE trunc((d + 8.33)*3 + 5e-1) + 32 END AS INT) AS two_slopes, CAST(trunc((d + 15e0)*(15e0/30e0) + 5e-1) AS INT) AS linear, CAST((SELECT arg_min(k, (abs(d - (k*2e0 - 15e0)), k)) FROM range(16) t(k)) AS INT) AS nearest FROM (SELECT pt, degrees(atan(y / sqrt(x*x + z*z))) AS d FROM points)")
def ring_lookup(spark, sf_dir):
    d = F.degrees(F.atan(F.col("y") / F.sqrt(F.col("x") * F.col("x") + F.col("z") * F.col("z"))))
    p = V.points(spark, sf_dir).select("pt", d.alias("d"))
    return p.select("pt", sc.ring_two_slopes(F.col("d")).alias("two_slopes"), sc.ring_linear(F.col("d"), -15.0, 15.0, 16).alias("linear"), sc.ring_table(F.col("d"), [2.0 * k - 15 for k in range(16)]).alias("nearest"))


@query("points", "SELECT pt, round(acos(greatest(-1e0, least(1e0, cos(x)*cos(y)))),5) AS a, round(asin(greatest(-1e0, least(1e0, sin(y)*cos(x)))), 5)+0e0 AS b, round(CASE WHEN abs(x-y) > 5 THEN 1e0 ELSE 0e0 END,0) AS far, round(greatest(abs(x), abs(y))/least(abs(x), abs(y)),4) AS ratio FROM points WHERE abs(x) > 1e-2 AND abs(y) > 1e-2")
def angle_functions(spark, sf_dir):
    x, y = F.col("x"), F.col("y")
    unit = lambda c: F.greatest(F.lit(-1.0), F.least(F.lit(1.0), c))
    p = V.points(spark, sf_dir).where((F.abs("x") > 1e-2) & (F.abs("y") > 1e-2))
    p = p.select("pt", F.acos(unit(F.cos(x) * F.cos(y))).alias("a"), F.asin(unit(F.sin(y) * F.cos(x))).alias("b"), F.when(F.abs(x - y) > 5, 1.0).otherwise(0.0).alias("far"), F.round(sc.ratio_to_one(F.abs(x), F.abs(y)), 4).alias("ratio"))
    return rounded(p, "a b", 5)


@query("points", "SELECT pt, round(x/5e0,5)+0e0 AS rx, round(y/8e0,5)+0e0 AS ry, round(z/5e0,5)+0e0 AS rz FROM points WHERE abs(x/5e0) < 3 AND abs(y/8e0) < 15e-1 AND abs(z/5e0) < 3")
def euler_round_trip(spark, sf_dir):
    """Angles to a rotation matrix and back."""
    rx, ry, rz = F.col("x") / 5, F.col("y") / 8, F.col("z") / 5
    p = V.points(spark, sf_dir).where((F.abs(rx) < 3) & (F.abs(ry) < 1.5) & (F.abs(rz) < 3))
    m = p.select("pt", *(c.alias(f"m{i}") for i, c in enumerate(g.euler_to_matrix(rx, ry, rz))))
    back = g.matrix_to_euler([F.col(f"m{i}") for i in range(9)])
    return rounded(m.select("pt", *(c.alias(n) for c, n in zip(back, ("rx", "ry", "rz"), strict=True))), "rx ry rz", 5)


@query("points", "SELECT pt, round(x/5e0,5)+0e0 AS roll, round(y/8e0,5)+0e0 AS pitch, round(z/5e0,5)+0e0 AS yaw, round(y - sin(x/5e0)*cos(y/8e0)*981e-2, 5)+0e0 AS ax FROM points WHERE abs(x/5e0) < 3 AND abs(y/8e0) < 15e-1 AND abs(z/5e0) < 3")
def quaternion_round_trip(spark, sf_dir):
    """Angles to a quaternion and back, and an acceleration without gravity."""
    r, p, y = F.col("x") / 5, F.col("y") / 8, F.col("z") / 5
    rows = V.points(spark, sf_dir).where((F.abs(r) < 3) & (F.abs(p) < 1.5) & (F.abs(y) < 3))
    ax = g.without_gravity(F.col("x"), F.col("y"), F.col("z"), r, p)[0]
    q = rows.select("pt", ax.alias("ax"), *(c.alias(n) for c, n in zip(g.rpy_to_quaternion(r, p, y), ("qx", "qy", "qz", "qw"), strict=True)))
    back = g.quaternion_to_rpy(*(F.col(n) for n in ("qx", "qy", "qz", "qw")))
    return rounded(q.select("pt", *(c.alias(n) for c, n in zip(back, ("roll", "pitch", "yaw"), strict=True)), "ax"), "roll pitch yaw ax", 5)


_ANGLES = "SELECT pt, x, y, z, x/5e0 AS rx, CASE WHEN ring = 0 THEN sign(y)*pi()/2 ELSE y/8e0 END AS ry, z/5e0 AS rz FROM points"
_EULER = ("cos(rz)*cos(ry)", "cos(rz)*sin(ry)*sin(rx)-sin(rz)*cos(rx)", "cos(rz)*sin(ry)*cos(rx)+sin(rz)*sin(rx)", "sin(rz)*cos(ry)", "sin(rz)*sin(ry)*sin(rx)+cos(rz)*cos(rx)", "sin(rz)*sin(ry)*cos(rx)-cos(rz)*sin(rx)", "-sin(ry)", "cos(ry)*sin(rx)", "cos(ry)*cos(rx)")


def _angles(spark, sf_dir):
    """An orientation a point; those of ring 0 look straight up or down."""
    ry = F.when(F.col("ring") == 0, F.signum("y") * F.pi() / 2).otherwise(F.col("y") / 8)
    return V.points(spark, sf_dir).select("pt", "x", "y", "z", (F.col("x") / 5).alias("rx"), ry.alias("ry"), (F.col("z") / 5).alias("rz"))


@query("points", f"""WITH m AS (SELECT pt, {", ".join(f"{e} AS m{k}" for k, e in enumerate(_EULER))} FROM ({_ANGLES})), l AS (SELECT *, sqrt(m0*m0 + m3*m3) < 1e-6 AS l FROM m)
SELECT pt, {", ".join(f"round(m{k}, 6) + 0e0 AS m{k}" for k in range(9))}, round(CASE WHEN l THEN atan2(-m5, m4) ELSE atan2(m7, m8) END, 6) + 0e0 AS ex, round(atan2(-m6, sqrt(m0*m0 + m3*m3)), 6) + 0e0 AS ey, round(CASE WHEN l THEN 0e0 ELSE atan2(m3, m0) END, 6) + 0e0 AS ez FROM l""")
def euler_matrix(spark, sf_dir):
    """Rotation matrices of angles, entry by entry, and the angles read back, gimbal lock included."""
    m = _angles(spark, sf_dir).select("pt", *(c.alias(f"m{k}") for k, c in enumerate(g.euler_to_matrix(F.col("rx"), F.col("ry"), F.col("rz")))))
    back = g.matrix_to_euler([F.col(f"m{k}") for k in range(9)])
    return rounded(m.select("*", *(c.alias(n) for c, n in zip(back, ("ex", "ey", "ez"), strict=True))), " ".join(c for c in [*(f"m{k}" for k in range(9)), "ex", "ey", "ez"]))


@query("points", f"""WITH a AS (SELECT *, cos(rx/2) AS cr, sin(rx/2) AS sr, cos(ry/2) AS cp, sin(ry/2) AS sp, cos(rz/2) AS cy, sin(rz/2) AS sy FROM ({_ANGLES}))
SELECT pt, round(sr*cp*cy - cr*sp*sy, 6) + 0e0 AS qx, round(cr*sp*cy + sr*cp*sy, 6) + 0e0 AS qy, round(cr*cp*sy - sr*sp*cy, 6) + 0e0 AS qz, round(cr*cp*cy + sr*sp*sy, 6) + 0e0 AS qw,
round(y - sin(rx)*cos(ry)*981e-2, 5) + 0e0 AS ax, round(z - cos(rx)*cos(ry)*981e-2, 5) + 0e0 AS ay, round(x + sin(ry)*981e-2, 5) + 0e0 AS az FROM a""")
def quaternion_parts(spark, sf_dir):
    """Quaternions of angles, part by part, and accelerations without gravity on all axes."""
    rows = _angles(spark, sf_dir)
    q = g.rpy_to_quaternion(F.col("rx"), F.col("ry"), F.col("rz"))
    out = rows.select("pt", *(c.alias(n) for c, n in zip(q, ("qx", "qy", "qz", "qw"), strict=True)), *(c.alias(n) for c, n in zip(g.without_gravity(F.col("x"), F.col("y"), F.col("z"), F.col("rx"), F.col("ry")), ("ax", "ay", "az"), strict=True)))
    return rounded(rounded(out, "qx qy qz qw"), "ax ay az", 5)


@query("points", "SELECT pt, CAST(round(255*greatest(0e0,1-2*s)) AS DOUBLE) AS b, CAST(round(255*(1-abs(2*s-1))) AS DOUBLE) AS g, CAST(round(255*greatest(0e0,2*s-1)) AS DOUBLE) AS r FROM (SELECT pt, (least(greatest(round(sqrt(x*x+y*y+z*z)*5, 3), 5e0), 50e0) - 5)/45 AS s FROM points)")
def depth_colour(spark, sf_dir):
    d = F.round(F.sqrt(sc.norm2(g.vec())) * 5, 3)
    return V.points(spark, sf_dir).select("pt", *(c.alias(n) for c, n in zip(sc.depth_colour(d), "bgr", strict=True)))


@query("poses", "SELECT a.frame, b.frame AS to_frame, round(b.tx-a.tx,6)+0e0 AS dx, round(b.ty-a.ty,6)+0e0 AS dy, round(b.tz-a.tz,6)+0e0 AS dz FROM poses a, poses b WHERE abs(a.frame - b.frame) <= 4")
def projection_matrix_pairs(spark, sf_dir):
    """Frame pairs within a bounded distance: an equi-join on exploded offsets, not a cross join."""
    a = V.poses(spark, sf_dir)
    b = a.select(F.col("frame").alias("to_frame"), *(F.col(c).alias(f"b{c}") for c in ("tx", "ty", "tz")))
    near = a.withColumn("to_frame", F.explode(F.sequence(F.col("frame") - 4, F.col("frame") + 4)))
    return rounded(near.join(b, "to_frame").select("frame", "to_frame", *((F.col(f"bt{c}") - F.col(f"t{c}")).alias(f"d{c}") for c in "xyz")), "dx dy dz")


@query("points", "SELECT frame, min(x) AS min_x, max(x) AS max_x, min(y) AS min_y, max(y) AS max_y, min(z) AS min_z, max(z) AS max_z FROM points GROUP BY 1")
def bounding_box(spark, sf_dir):
    return aggs.bounds(V.points(spark, sf_dir), ["frame"], ["x", "y", "z"])


@query("points", "SELECT frame, ring, len(list(d)) AS n, round(list_min(list(d)),5)+0e0 AS lowest FROM (SELECT frame, ring, degrees(atan2(y, x)) AS d FROM points) GROUP BY 1, 2")
def ring_angles(spark, sf_dir):
    d = F.degrees(F.atan2("y", "x"))
    return rounded(V.points(spark, sf_dir).groupBy("frame", "ring").agg(F.count(d).alias("n"), F.min(d).alias("lowest")), "lowest", 5)


@query("points", "SELECT pt, round(x - avg(x) OVER (PARTITION BY frame),6)+0e0 AS x_centred FROM points")
def message_normalize(spark, sf_dir):
    return rounded(aggs.centred(V.points(spark, sf_dir), ["frame"], "x").select("pt", "x_centred"), "x_centred")


_TRI = "SELECT vec_id AS tri, 2e1*embedding[1]+10 AS ax, 2e1*embedding[2]+10 AS ay, 2e1*embedding[3]+10 AS bx, 2e1*embedding[4]+10 AS b_y, 2e1*embedding[5]+10 AS cx, 2e1*embedding[6]+10 AS cy FROM (SELECT vec_id, list_transform(embedding, lambda e: CAST(e AS DOUBLE)) AS embedding FROM embeddings)"
_DET = "((b_y-cy)*(ax-cx)+(cx-bx)*(ay-cy))"


@query("", f"WITH t AS ({_TRI}), g AS (SELECT *, ((b_y-cy)*(u-cx)+(cx-bx)*(v-cy))/{_DET} AS w0, ((cy-ay)*(u-cx)+(ax-cx)*(v-cy))/{_DET} AS w1 FROM t, range(-20, 45) a(u), range(-20, 45) b(v)) SELECT tri, u, v, round(w0,5) AS w0, round(w1,5) AS w1 FROM g WHERE w0 > 0 AND w1 > 0 AND 1 - w0 - w1 > 0")
def rasterize_triangles(spark, sf_dir):
    e = lambda k: 20.0 * F.get("embedding", F.lit(k)).cast("double") + 10
    t = V.table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("tri"), *(e(k).alias(n) for k, n in enumerate(("ax", "ay", "bx", "by", "cx", "cy"))))
    return rounded(joins.rasterize(t).drop("w2"), "w0 w1", 5)


@query("points", "SELECT * FROM (SELECT pt, frame, ring, CAST(row_number() OVER (PARTITION BY frame ORDER BY round(x,9) DESC, pt) AS INT) AS rank FROM points) WHERE rank <= 3")
def top_points(spark, sf_dir):
    from ..operators.windows import top_k

    return top_k(V.points(spark, sf_dir), ["frame"], [F.round("x", 9).desc(), F.col("pt")], 3).select("pt", "frame", "ring", "rank")


@query("points", "SELECT frame, count(*) AS n FROM (SELECT * FROM points WHERE ring < 8 UNION ALL SELECT * FROM points WHERE ring >= 4) GROUP BY 1")
def bag_union(spark, sf_dir):
    p = V.points(spark, sf_dir)
    return p.where("ring < 8").unionByName(p.where("ring >= 4")).groupBy("frame").agg(F.count("*").alias("n"))


@query("points", "SELECT DISTINCT frame, CAST(floor(x) AS BIGINT) AS u FROM points")
def unique_sources(spark, sf_dir):
    return V.points(spark, sf_dir).select("frame", F.floor("x").alias("u")).dropDuplicates()


@query("points", "SELECT a.frame, greatest(a.lo, b.lo) AS lo, least(a.hi, b.hi) AS hi FROM (SELECT frame, min(x) AS lo, max(x) AS hi FROM points GROUP BY 1) a JOIN (SELECT frame, min(y) AS lo, max(y) AS hi FROM points GROUP BY 1) b USING (frame)")
def rect_intersection(spark, sf_dir):
    b = V.points(spark, sf_dir).groupBy("frame").agg(*(f(c).alias(f"{n}_{c}") for c in "xy" for n, f in (("lo", F.min), ("hi", F.max))))
    return b.select("frame", F.greatest("lo_x", "lo_y").alias("lo"), F.least("hi_x", "hi_y").alias("hi"))


@query()
def greedy_features(spark, sf_dir):
    """Occlusion marks, then the greedy picks of each ring (here: a turn of some hundred points)."""
    from ..operators.features import greedy_features as pick
    from ..operators.windows import occlusion

    rings = occlusion(V.turns(V.points(spark, sf_dir)), ["turn"], ["pt"])
    return pick(rings, ["turn"], "pt").select("pt", "turn", "picked", "label")


def _occlusion_sql() -> str:
    d = lambda a, b, s="": "(" + " + ".join(f"({a}{c} - {b}{c}{s})*({a}{c} - {b}{c}{s})" for c in "xyz") + ")"
    return f"""WITH t AS (SELECT *, (pt // 4200) * 1000 + frame AS turn FROM points), n AS (SELECT turn, pt, x, y, z, lead(x) OVER w AS ax, lead(y) OVER w AS ay, lead(z) OVER w AS az, lag(x) OVER w AS qx, lag(y) OVER w AS qy, lag(z) OVER w AS qz FROM t WINDOW w AS (PARTITION BY turn ORDER BY pt)),
r AS (SELECT *, sqrt(x*x+y*y+z*z) AS d, sqrt(ax*ax+ay*ay+az*az) AS dn FROM n),
j AS (SELECT *, {d("a", "")} AS gap, {d("", "q")} AS back FROM r),
f AS (SELECT *, coalesce(gap > 1e-1 AND d > dn AND sqrt({d("a", "", "*dn/d")})/dn < 1e-1, false) AS far,
coalesce(gap > 1e-1 AND d <= dn AND sqrt({d("", "a", "*d/dn")})/d < 1e-1, false) AS near, coalesce(gap > 2e-4*d*d AND back > 2e-4*d*d, false) AS flat FROM j)
SELECT turn, pt, coalesce(max(CAST(far AS INT)) OVER (v ROWS BETWEEN CURRENT ROW AND 5 FOLLOWING), 0) + coalesce(max(CAST(near AS INT)) OVER (v ROWS BETWEEN 6 PRECEDING AND 1 PRECEDING), 0) > 0 OR (flat AND NOT far) AS picked FROM f WINDOW v AS (PARTITION BY turn ORDER BY pt)"""


@query("points", _occlusion_sql())
def occlusion_marks(spark, sf_dir):
    """Points at depth jumps and on surfaces almost parallel to the beam, with their neighbours."""
    from ..operators.windows import occlusion

    return occlusion(V.turns(V.points(spark, sf_dir)), ["turn"], ["pt"]).select("turn", "pt", "picked")


@query("points", "SELECT frame, ring, pt, round((first(z) OVER w), 6)+0e0 AS first_z, round((last(z) OVER w), 6)+0e0 AS last_z FROM points WINDOW w AS (PARTITION BY frame, ring ORDER BY pt ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)")
def sweep_ends(spark, sf_dir):
    w = Window.partitionBy("frame", "ring").orderBy("pt").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return rounded(V.points(spark, sf_dir).select("frame", "ring", "pt", F.first("z").over(w).alias("first_z"), F.last("z").over(w).alias("last_z")), "first_z last_z")
