"""Raster queries over the pixel view."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import views as V
from ..operators import aggs, raster, windows
from .registry import Registry, rounded

query = Registry()
QUERIES, ORACLES = query.queries, query.oracles

_KEY = "l_orderkey, l_partkey, l_suppkey, l_linenumber, q, l_tax"
_BEST = f"SELECT u, v, z, l_orderkey, l_linenumber FROM (SELECT *, row_number() OVER (PARTITION BY u, v ORDER BY z, {_KEY}) AS k FROM pixels) WHERE k = 1"
_DEPTH = "SELECT u, v, min(z) AS depth FROM pixels GROUP BY 1, 2"


@query("pixels", _BEST)
def zbuffer(spark, sf_dir):
    return aggs.zbuffer(V.pixels(spark, sf_dir), ["u", "v"], "z", "key").select("u", "v", "z", "key.l_orderkey", "key.l_linenumber")


@query("pixels", "SELECT u, v, min(z) AS z FROM pixels GROUP BY 1, 2")
def painter_order(spark, sf_dir):
    return aggs.painter(V.pixels(spark, sf_dir), ["u", "v"], "z", "key").select("u", "v", "z")


@query("pixels", "SELECT u, v, count(*) AS votes, CAST(floor(sum(q)/count(*)) AS BIGINT) AS q FROM pixels GROUP BY 1, 2")
def pixel_vote(spark, sf_dir):
    return aggs.vote(V.pixels(spark, sf_dir), ["u", "v"], ["q"])


@query("pixels", "SELECT CAST(floor(u/2e0) AS BIGINT) AS u, CAST(floor(v/2e0) AS BIGINT) AS v, sum(q) AS q FROM pixels GROUP BY 1, 2")
def pyramid2x2(spark, sf_dir):
    return aggs.pyramid(V.pixels(spark, sf_dir), "q")


@query("pixels", "SELECT u, round(avg(q - 25) FILTER (q > 25), 6) AS mean_cost FROM pixels GROUP BY 1")
def positive_cost(spark, sf_dir):
    p = V.pixels(spark, sf_dir).withColumn("cost", F.greatest(F.col("q") - 25, F.lit(0.0)))
    return rounded(aggs.positive_mean(p, ["u"], "cost"), "mean_cost")


@query("pixels", "SELECT u, min(z) AS lowest, max(z) AS highest, count(*) FILTER (q > 10) AS valid FROM pixels GROUP BY 1")
def raster_min_max(spark, sf_dir):
    return V.pixels(spark, sf_dir).groupBy("u").agg(F.min("z").alias("lowest"), F.max("z").alias("highest"), F.count_if(F.col("q") > 10).alias("valid"))


@query("pixels", f"WITH d AS ({_DEPTH}) SELECT a.u, a.v, round(median(b.depth), 4) AS depth FROM d a JOIN d b ON abs(a.u - b.u) <= 2 AND abs(a.v - b.v) <= 2 GROUP BY 1, 2")
def median5(spark, sf_dir):
    d = V.pixels(spark, sf_dir).groupBy("u", "v").agg(F.min("z").alias("depth"))
    return rounded(raster.median(d, []), "depth", 4)


_HOLED = "SELECT u, v, min(z) AS depth FROM pixels WHERE (u * 7 + v * 3) % 11 != 0 GROUP BY 1, 2"


@query("pixels", f"WITH k AS ({_HOLED}), w AS (SELECT DISTINCT u, v FROM pixels), n AS (SELECT w.u, w.v, k.depth, sqrt(CAST((w.u-k.u)*(w.u-k.u)+(w.v-k.v)*(w.v-k.v) AS DOUBLE)) AS d, row_number() OVER (PARTITION BY w.u, w.v ORDER BY (w.u-k.u)*(w.u-k.u)+(w.v-k.v)*(w.v-k.v), k.v, k.u) AS r FROM w, k) SELECT u, v, round(coalesce(avg(depth) FILTER (d = 0), sum(depth/d)/sum(1/d)), 4) AS depth FROM (SELECT u, v, depth, d FROM n WHERE r <= 10) GROUP BY 1, 2")
def depth_fill(spark, sf_dir):
    """Inverse-distance fill from the 10 nearest known pixels; a known pixel keeps its depth."""
    p = V.pixels(spark, sf_dir).withColumn("z_cam", F.col("z"))
    known = p.where("(u * 7 + v * 3) % 11 != 0")
    return rounded(raster.local_depth(known, p, [], 10, smooth=False), "depth", 4)


@query("pixels", f"WITH d AS ({_HOLED}), g AS (SELECT w.u, w.v, d.depth FROM (SELECT DISTINCT u, v FROM pixels) w LEFT JOIN d USING (u, v)), b AS (SELECT *, max(CASE WHEN depth IS NOT NULL THEN u END) OVER (PARTITION BY v ORDER BY u ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS p, min(CASE WHEN depth IS NOT NULL THEN u END) OVER (PARTITION BY v ORDER BY u ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS n FROM g) SELECT b.u, b.v, round(coalesce(b.depth, l.depth + (b.u-p)/CAST(n-p AS DOUBLE)*(r.depth-l.depth)), 4) AS filled FROM b LEFT JOIN g l ON l.v = b.v AND l.u = p LEFT JOIN g r ON r.v = b.v AND r.u = n")
def sparse_dense(spark, sf_dir):
    p = V.pixels(spark, sf_dir)
    known = p.where("(u * 7 + v * 3) % 11 != 0").groupBy("u", "v").agg(F.min("z").alias("depth"))
    grid = p.select("u", "v").distinct().join(known, ["u", "v"], "left")
    return rounded(windows.gap_fill(grid, "depth", "u", ["v"]).select("u", "v", "filled"), "filled", 4)


@query("pixels", f"WITH d AS ({_DEPTH}), e AS (SELECT u AS pu, v AS pv, depth AS pd FROM d WHERE u < 8 AND v < 8) SELECT d.u, d.v, round(d.depth, 2) AS depth, round(e.pd, 2) AS texture FROM d LEFT JOIN e ON e.pu = d.u // 6 AND e.pv = d.v // 8")
def texture_gather(spark, sf_dir):
    """Each pixel looks its colour up in another raster: an equi-join on pixel coordinates."""
    d = V.pixels(spark, sf_dir).groupBy("u", "v").agg(F.min("z").alias("depth"))
    e = d.where("u < 8 and v < 8").select(F.col("u").alias("pu"), F.col("v").alias("pv"), F.round("depth", 2).alias("texture"))
    d = d.select("u", "v", F.round("depth", 2).alias("depth"), F.floor(F.col("u") / 6).alias("pu"), F.floor(F.col("v") / 8).alias("pv"))
    return d.join(e, ["pu", "pv"], "left").select("u", "v", "depth", "texture")


@query("pixels", f"WITH d AS (SELECT u, v, round(depth/1000) AS value FROM ({_DEPTH})), p AS (SELECT (u // 8) * 8 + (v // 8) AS patch, u, v, value FROM d), c AS (SELECT patch, dv, du, sum((p.value-d.value)*(p.value-d.value)) AS cost FROM p, range(4) a(dv), range(4) b(du) JOIN d ON d.u = p.u + du + 1 AND d.v = p.v + dv + 1 GROUP BY 1,2,3) SELECT patch, cost, dv, du FROM (SELECT *, row_number() OVER (PARTITION BY patch ORDER BY cost, dv, du) AS k FROM c) WHERE k = 1")
def template_match(spark, sf_dir):
    d = V.pixels(spark, sf_dir).groupBy("u", "v").agg(F.round(F.min("z") / 1000).alias("value"))
    patches = d.select((F.floor(F.col("u") / 8) * 8 + F.floor(F.col("v") / 8)).alias("patch"), (F.col("u") + 1).alias("u"), (F.col("v") + 1).alias("v"), "value")
    offsets = spark.range(4).select(F.col("id").alias("dv")).crossJoin(spark.range(4).select(F.col("id").alias("du")))  # 16 constants
    return raster.template_match(patches, d, offsets, []).select("patch", "cost", "dv", "du")


@query("pixels", f"WITH d AS (SELECT u, v, depth/1000 AS depth FROM ({_DEPTH})), w AS (SELECT a.u, a.v, b.depth, CASE abs(a.u-b.u) WHEN 0 THEN 1e0 WHEN 1 THEN exp(-5e-1) ELSE exp(-2e0) END AS k FROM d a JOIN d b ON a.v = b.v AND abs(a.u-b.u) <= 2) SELECT u, v, round(sum(depth*k)/sum(k), 5) AS smooth FROM w GROUP BY 1, 2")
def gaussian_smooth(spark, sf_dir):
    d = V.pixels(spark, sf_dir).groupBy("u", "v").agg((F.min("z") / 1000).alias("depth"))
    grid = d.select("v").distinct().select("v", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(47).cast("long"))).alias("u")).join(d, ["u", "v"], "left")
    return rounded(raster.gaussian_smooth(grid, "depth", 1.0, "u", ["v"], 2).where("depth is not null").select("u", "v", "smooth"), "smooth", 5)


@query("pixels", f"SELECT u // 2 AS u, v // 2 AS v, round(arg_min(depth, (v, u)), 2) AS depth FROM ({_DEPTH}) GROUP BY 1, 2")
def resize_nearest(spark, sf_dir):
    d = V.pixels(spark, sf_dir).groupBy("u", "v").agg(F.round(F.min("z"), 2).alias("depth"))
    return raster.resize(d, 0.5, ["depth"])


@query("pixels", f"SELECT u, v, CASE WHEN u BETWEEN 10 AND 20 AND v BETWEEN 10 AND 30 THEN 0e0 ELSE round(depth,2) END AS depth FROM ({_DEPTH})")
def apply_mask(spark, sf_dir):
    d = V.pixels(spark, sf_dir).groupBy("u", "v").agg(F.round(F.min("z"), 2).alias("depth"))
    return d.select("u", "v", F.when(F.col("u").between(10, 20) & F.col("v").between(10, 30), 0.0).otherwise(F.col("depth")).alias("depth"))


@query("pixels", "SELECT u, CAST(floor(299e-3*max(q) + 587e-3*min(q) + 114e-3*max(v)) AS BIGINT) AS grey, CASE WHEN max(q) > 49 THEN 255 ELSE 0 END AS bright FROM pixels GROUP BY 1")
def colour_conversion(spark, sf_dir):
    from ..functions.scalars import grey

    p = V.pixels(spark, sf_dir).groupBy("u").agg(F.max("v").alias("b"), F.min("q").alias("g"), F.max("q").alias("r"))
    return p.select("u", F.floor(grey(F.col("b"), F.col("g"), F.col("r"))).alias("grey"), F.when(F.col("r") > 49, 255).otherwise(0).alias("bright"))


@query("pixels", f"SELECT u, round(depth, 2) AS depth, v FROM (SELECT *, row_number() OVER (PARTITION BY u ORDER BY depth, v) AS k FROM ({_DEPTH})) WHERE k = 1")
def arg_min_label(spark, sf_dir):
    d = V.pixels(spark, sf_dir).groupBy("u", "v").agg(F.round(F.min("z"), 2).alias("depth"))
    return aggs.arg_min(d, ["u"], "depth", "v")


_RECT = "SELECT v AS patch, i AS u, j AS v FROM (SELECT DISTINCT v % 4 AS v FROM pixels), range(6) a(i), range(4) b(j)"


@query("pixels", f"""WITH c AS (SELECT *, least(u, 5-u, v, 3-v) AS k FROM ({_RECT})), a AS (SELECT patch, u, v, k, CASE WHEN v = k THEN u - k WHEN u = 5-k THEN 5-2*k + v-k WHEN v = 3-k THEN 5-2*k + 3-2*k + 5-k-u ELSE 2*(5-2*k) + 3-2*k + 3-k-v END AS along FROM c)
SELECT patch, u, v, CAST(row_number() OVER (PARTITION BY patch ORDER BY k, along) AS INT) AS "order" FROM a""")
def boundary_order(spark, sf_dir):
    from ..operators.inpaint import boundary_order as ordered

    longs = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n).cast("long")))
    m = V.pixels(spark, sf_dir).select((F.col("v") % 4).alias("patch")).distinct().withColumn("u", longs(5)).withColumn("v", longs(3))
    return ordered(m, ["patch"])


@query("pixels", f"SELECT d.u, d.v, CAST((i+1)*3 + j+1 AS INT) AS label, round(c.depth, 2) AS depth FROM ({_DEPTH}) d, range(-1,2) a(i), range(-1,2) b(j), ({_DEPTH}) c WHERE c.u = d.u + 2 + j AND c.v = d.v + 1 + i")
def candidate_window(spark, sf_dir):
    from ..operators.inpaint import candidate_window as window

    d = V.pixels(spark, sf_dir).groupBy("u", "v").agg(F.round(F.min("z"), 2).alias("depth"))
    rows = window(d.select("u", "v", (F.col("u") + 2).alias("su"), (F.col("v") + 1).alias("sv")), 1)
    return rows.join(d.select(F.col("u").alias("cu"), F.col("v").alias("cv"), "depth"), ["cu", "cv"]).select("u", "v", "label", "depth")


@query()
def multi_scale_labels(spark, sf_dir):
    """Depth in sixteen steps, smoothed by belief propagation from coarse to fine, a tile a task; its labels are held to the kernel over the whole raster in the tests."""
    from ..operators.tiled import multi_scale_labels as labels

    d = V.table(spark, sf_dir, "lineitem").groupBy((F.col("l_linenumber") % 4).alias("camera"), (F.col("l_partkey") % 96).alias("v"), (F.col("l_suppkey") % 96).alias("u")).agg((F.avg("l_extendedprice") / 6500).alias("d"))
    costs = d.select("camera", "v", "u", F.transform(F.sequence(F.lit(0), F.lit(15)), lambda k: F.least(F.abs(F.col("d") - k), F.lit(4.0))).alias("cost"))
    return labels(costs, ["camera"], weight=0.5, cut=4.0)


def _field_sql(rounds: int) -> str:
    draw = lambda n, c: f"coalesce(s{c}, {c}) - r + CAST('0x' || substr(md5('0:{n}:' || r || ':{c}:' || v || ':' || u), 1, 8) AS BIGINT) % (2*r + 1) AS s{c}"
    parts = [
        "t AS MATERIALIZED (SELECT u, v, round(min(z)/1000) AS x FROM pixels GROUP BY 1, 2), s AS MATERIALIZED (SELECT u, v, round(max(z)/1000) AS x FROM pixels GROUP BY 1, 2)",
        "radii(r) AS (SELECT greatest(max(v) - min(v), max(u) - min(u)) FROM s UNION ALL SELECT r // 2 FROM radii WHERE r >= 1), f0 AS (SELECT u, v, CAST(NULL AS BIGINT) AS sv, CAST(NULL AS BIGINT) AS su, CAST(NULL AS DOUBLE) AS cost FROM t)",
    ]
    for n in range(rounds):
        parts.append(f"""c{n} AS (SELECT DISTINCT v, u, sv, su FROM (SELECT v, u, {draw(n, "v")}, {draw(n, "u")} FROM f{n}, radii UNION ALL SELECT v + dv, u + du, sv + dv, su + du FROM f{n}, (SELECT d * i AS dv, d * j AS du FROM (VALUES (1), (4), (16)) d(d), (VALUES (-1, 0), (0, -1), (0, 1), (1, 0)) o(i, j)) WHERE sv IS NOT NULL) SEMI JOIN t USING (u, v)),
d{n} AS (SELECT c.v, c.u, c.sv, c.su, avg((a.x - b.x) * (a.x - b.x)) AS cost FROM c{n} c JOIN s m ON m.u = c.su AND m.v = c.sv, range(-1, 2) i(i), range(-1, 2) j(j) JOIN t a ON a.v = c.v + i AND a.u = c.u + j JOIN s b ON b.v = c.sv + i AND b.u = c.su + j GROUP BY 1, 2, 3, 4),
f{n + 1} AS MATERIALIZED (SELECT t.u, t.v, m.sv, m.su, m.cost FROM t LEFT JOIN (SELECT v, u, arg_min(struct_pack(sv := sv, su := su, cost := cost), struct_pack(cost := cost, sv := sv, su := su)) AS m FROM (SELECT v, u, sv, su, cost FROM d{n} UNION ALL SELECT v, u, sv, su, cost FROM f{n} WHERE sv IS NOT NULL) GROUP BY 1, 2) USING (v, u))""")
    return "WITH " + ", ".join(parts) + f" SELECT v, u, sv, su, round(cost, 6) AS cost FROM f{rounds}"


@query("pixels", _field_sql(3))
def nearest_field(spark, sf_dir):
    """For each patch of one raster a place in another one that looks alike: three rounds of propagation and random search."""
    from ..operators import patchmatch

    p = V.pixels(spark, sf_dir).groupBy("u", "v")
    target, source = (p.agg(F.round(f("z") / 1000).alias("x")) for f in (F.min, F.max))
    return rounded(patchmatch.nearest_field(target, source, ["x"], rounds=3), "cost")


@query()
def triangulated_fill(spark, sf_dir):
    """Each vector's 21 samples are triangulated, and the pixels inside triangles get their barycentric weights."""
    from ..operators import joins
    from ..operators.inpaint import triangulate

    p = V.points(spark, sf_dir).select(F.floor(F.col("pt") / 21).alias("turn"), F.floor(F.col("x") * 8).alias("u"), F.floor(F.col("y") * 8).alias("v"))
    t = triangulate(p, ["turn"]).withColumn("tri", F.col("turn") * 1000 + F.col("tri"))
    return rounded(joins.rasterize(t).select("tri", "u", "v", "w0", "w1", "w2"), "w0 w1 w2", 5)


@query("pixels", f"""WITH d AS (SELECT u, v, depth/100 AS depth, floor(depth/100) AS value FROM ({_DEPTH})), w AS (SELECT CAST(trunc((5e1*((u+i/2e0-24e0)/50*depth + 1) + 24*depth)/depth + 5e-1) AS INT) AS pu, CAST(trunc((5e1*((v+j/2e0-32e0)/50*depth + 3e-1) + 32*depth)/depth + 5e-1) AS INT) AS pv, depth, value, u, v FROM d, range(2) a(i), range(2) b(j))
SELECT pu AS u, pv AS v, round(arg_min(depth, (depth, v, u)), 4) AS depth, round(arg_min(value, (depth, v, u)), 4) AS value FROM w WHERE depth > 0 AND pu BETWEEN 0 AND 47 AND pv BETWEEN 0 AND 63 GROUP BY 1, 2""")
def warped_depth(spark, sf_dir):
    """The depth raster seen from a camera that stands aside."""
    import numpy as np

    from ..operators.inpaint import warp_by_depth

    d = V.pixels(spark, sf_dir).groupBy("u", "v").agg((F.min("z") / 100).alias("depth")).withColumn("value", F.floor("depth").cast("double"))
    k = np.array([[50.0, 0, 24], [0, 50, 32], [0, 0, 1]])
    m = (k @ np.c_[np.eye(3), [1.0, 0.3, 0]]).ravel().tolist()  # off the pixels' middles in both directions
    return rounded(warp_by_depth(d, np.linalg.inv(k), m, 48, 64, []), "depth value", 4)


@query()
def patch_homographies(spark, sf_dir):
    """A homography a patch column, from pixels and their shifted places."""
    from ..operators.inpaint import homographies

    d = V.pixels(spark, sf_dir).select("u", "v").distinct()
    pairs = d.select((F.col("u") % 8).alias("patch"), F.col("u").alias("su"), F.col("v").alias("sv"), (F.col("u") * 1.1 + F.col("v") * 0.2 + 3).alias("du"), (F.col("v") * 0.9 + 1).alias("dv"))
    out = homographies(pairs, ["patch"], rounds=20)
    return out.select("patch", *((F.round(F.get("h", F.lit(i)), 4) + 0.0).alias(f"h{i}") for i in range(8)))


def _inward(rounds: int) -> str:
    step = "k{n} AS MATERIALIZED (SELECT * FROM k{p} UNION ALL SELECT m.u, m.v, avg(k.depth) AS depth FROM (SELECT u, v FROM d ANTI JOIN k{p} USING (u, v)) m, range(-1, 2) a(i), range(-1, 2) b(j), k{p} k WHERE k.u = m.u + i AND k.v = m.v + j GROUP BY 1, 2)"
    head = "WITH d AS MATERIALIZED (SELECT u, v, min(z) / 7e2 AS depth FROM pixels GROUP BY 1, 2), k0 AS (SELECT * FROM d WHERE u % 16 NOT BETWEEN 4 AND 11)"
    return ", ".join([head, *(step.format(n=n, p=n - 1) for n in range(1, rounds + 1))]) + f" SELECT u, v, round(depth, 4) AS depth FROM k{rounds}"


@query("pixels", _inward(12))
def filled_inward(spark, sf_dir):
    """Stripes of the raster, eight pixels wide, filled from their rims round by round."""
    from ..operators.inpaint import fill_inward

    d = V.pixels(spark, sf_dir).groupBy("u", "v").agg((F.min("z") / 700).alias("depth"))
    return rounded(fill_inward(d, d.where("u % 16 between 4 and 11").select("u", "v"), [], ["depth"]), "depth", 4)
