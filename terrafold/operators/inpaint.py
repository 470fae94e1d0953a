"""Filling masked pixels: fill orders, candidate windows, warps, homographies, triangulation, patch search."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import geometry as g
from ..storage import written
from .aggs import zbuffer


def boundary_order(mask: DataFrame, by: list[str], guard: int = 0) -> DataFrame:
    """Fill order of rectangular masks from the outside in: ring by ring, each clockwise from its top left.

    Cells within ``guard`` of the image's top or left border are left out.
    """
    w = Window.partitionBy(*by)
    box = [f(c).over(w) for f, c in ((F.min, "u"), (F.max, "u"), (F.min, "v"), (F.max, "v"))]
    rows = mask.select(*mask.columns, *(b.alias(n) for b, n in zip(box, ("_l", "_r", "_t", "_b"), strict=True)))
    ring = F.least(F.col("u") - F.col("_l"), F.col("_r") - F.col("u"), F.col("v") - F.col("_t"), F.col("_b") - F.col("v"))
    rows = rows.withColumn("_k", ring)
    left, right, top, bottom = F.col("_l") + F.col("_k"), F.col("_r") - F.col("_k"), F.col("_t") + F.col("_k"), F.col("_b") - F.col("_k")
    wide, high = right - left, bottom - top
    along = F.when(F.col("v") == top, F.col("u") - left).when(F.col("u") == right, wide + F.col("v") - top).when(F.col("v") == bottom, wide + high + right - F.col("u")).otherwise(2 * wide + high + bottom - F.col("v"))
    rows = rows.where((F.col("u") >= guard) & (F.col("v") >= guard)).withColumn("_a", along)
    return rows.select(*mask.columns, F.row_number().over(w.orderBy("_k", "_a")).alias("order"))


def candidate_window(matched: DataFrame, reach: int = 5) -> DataFrame:
    """The ``(2 reach + 1)^2`` candidate places around each matched source pixel ``su, sv``, numbered row by row."""
    steps = F.sequence(F.lit(-reach), F.lit(reach))
    rows = matched.withColumn("_dv", F.explode(steps)).withColumn("_du", F.explode(steps))
    label = (F.col("_dv") + reach) * (2 * reach + 1) + F.col("_du") + reach
    return rows.select(*matched.columns, label.alias("label"), (F.col("su") + F.col("_du")).alias("cu"), (F.col("sv") + F.col("_dv")).alias("cv"))


def colour_cost(a: list[Column], b: list[Column], power: int = 1) -> Column:
    """L1 or squared distance of two colours; a black colour is blank and gives null."""
    blank = lambda c: sum(c) == 0
    cost = sum(F.abs(x - y) if power == 1 else (x - y) * (x - y) for x, y in zip(a, b, strict=True))
    return F.when(~blank(a) & ~blank(b), cost)


def warp_by_depth(pixels: DataFrame, k_inv: np.ndarray, matrix: list[float], width: int, height: int, by: list[str], upsample: int = 2) -> DataFrame:
    """Pixels ``u, v, depth, value`` seen from another camera: each is split into ``upsample^2`` parts, back-projected, projected, and the nearest stays."""
    n = F.sequence(F.lit(0), F.lit(upsample - 1))
    rows = pixels.withColumn("_i", F.explode(n)).withColumn("_j", F.explode(n))
    x, y, z = g.back_project(F.col("u") + F.col("_i") / upsample, F.col("v") + F.col("_j") / upsample, F.col("depth"), k_inv, np.eye(3), [0.0, 0.0, 0.0])
    u, v, w = g.project((x, y, z), matrix)
    rows = rows.select(*by, g.pixel(u).alias("wu"), g.pixel(v).alias("wv"), w.alias("wz"), F.struct("v", "u", "value").alias("key"))
    best = zbuffer(rows.where(g.in_image(F.col("wu"), F.col("wv"), F.col("wz"), width, height)), [*by, "wv", "wu"], "wz", "key")
    return best.select(*by, F.col("wv").alias("v"), F.col("wu").alias("u"), F.col("wz").alias("depth"), "key.value")


def fit_homography(src: np.ndarray, dst: np.ndarray, rounds: int = 0, tolerance: float = 2.0, seed: int = 0) -> np.ndarray:
    """3 x 3 by direct linear transform on normalised points; ``rounds`` > 0: of the largest set of agreeing pairs found."""

    def solve(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        def normal(p):
            m, s = p.mean(axis=0), np.sqrt(2) / max(p.std(), 1e-9)
            return np.array([[s, 0, -s * m[0]], [0, s, -s * m[1]], [0, 0, 1]])

        ta, tb = normal(a), normal(b)
        p, q = np.c_[a, np.ones(len(a))] @ ta.T, np.c_[b, np.ones(len(b))] @ tb.T
        zero = np.zeros_like(p)
        rows = np.concatenate([np.c_[-p, zero, q[:, :1] * p], np.c_[zero, -p, q[:, 1:2] * p]])
        h = np.linalg.inv(tb) @ np.linalg.svd(rows)[2][-1].reshape(3, 3) @ ta
        return h / h[2, 2]

    def miss(h: np.ndarray) -> np.ndarray:
        q = np.c_[src, np.ones(len(src))] @ h.T
        return np.hypot(*(q[:, :2] / q[:, 2:] - dst).T)

    if not rounds or len(src) <= 4:
        return solve(src, dst)
    r, best = np.random.default_rng(seed), np.zeros(len(src), bool)
    for _ in range(rounds):
        some = r.choice(len(src), 4, replace=False)
        with np.errstate(all="ignore"):
            good = miss(solve(src[some], dst[some])) < tolerance
        if good.sum() > best.sum():
            best = good
    return solve(src[best], dst[best]) if best.sum() >= 4 else solve(src, dst)


def homographies(pairs: DataFrame, by: list[str], rounds: int = 100, tolerance: float = 2.0) -> DataFrame:
    """One homography a group of pairs ``su, sv, du, dv``; groups under 4 pairs give none."""
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pairs.schema.fields if f.name in by) + ", h array<double>"

    def run(key: tuple, d: pd.DataFrame) -> pd.DataFrame:
        h = None if len(d) < 4 else fit_homography(d[["su", "sv"]].to_numpy(float), d[["du", "dv"]].to_numpy(float), rounds, tolerance).ravel().tolist()
        return pd.DataFrame([[*key, h]], columns=[*by, "h"])

    return pairs.groupBy(*by).applyInPandas(run, schema)


def delaunay(points: np.ndarray) -> list[tuple[int, int, int]]:
    """Triangles of a plane point set, point by point: those whose circumcircle holds the new point make way for a fan around it."""
    n = len(points)
    if n < 3:
        return []
    low, span = points.min(axis=0), max(np.ptp(points, axis=0).max(), 1.0)
    # plain floats: three points at a time are too few for arrays
    all_points = np.vstack([points, low + span * np.array([[-30, -30], [60, -30], [-30, 60]])]).astype(float).tolist()

    def around(t):
        (ax, ay), (bx, by), (cx, cy) = (all_points[k] for k in t)
        d = 2 * (ax * (by - cy) + bx * (cy - ay) + cx * (ay - by))
        if abs(d) < 1e-12:
            return math.inf, math.inf, math.inf
        a, b, c = ax * ax + ay * ay, bx * bx + by * by, cx * cx + cy * cy
        x, y = (a * (by - cy) + b * (cy - ay) + c * (ay - by)) / d, (a * (cx - bx) + b * (ax - cx) + c * (bx - ax)) / d
        return x, y, (x - ax) * (x - ax) + (y - ay) * (y - ay)

    first = (n, n + 1, n + 2)
    circles = {first: around(first)}
    for i in range(n):
        x, y = all_points[i]
        gone = [t for t, (cx, cy, r) in circles.items() if not math.isfinite(r) or (x - cx) * (x - cx) + (y - cy) * (y - cy) < r - 1e-12]
        edges: dict[tuple[int, int], int] = {}
        for t in gone:
            del circles[t]
            for a, b in ((t[0], t[1]), (t[1], t[2]), (t[2], t[0])):
                e = (min(a, b), max(a, b))
                edges[e] = edges.get(e, 0) + 1
        for (a, b), k in edges.items():
            if k == 1:
                circles[a, b, i] = around((a, b, i))
    return sorted(tuple(sorted(t)) for t in circles if max(t) < n)


def triangulate(points: DataFrame, by: list[str]) -> DataFrame:
    """Triangles ``tri, ax … cy`` of each group's points ``u, v`` (one image's samples)."""
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in points.schema.fields if f.name in by) + ", tri long, ax double, ay double, bx double, `by` double, cx double, cy double"

    def run(key: tuple, d: pd.DataFrame) -> pd.DataFrame:
        p = d[["u", "v"]].drop_duplicates().sort_values(["v", "u"]).to_numpy(float)
        rows = [[*key, k, *p[list(t)].ravel()] for k, t in enumerate(delaunay(p))]
        return pd.DataFrame(rows, columns=[*by, "tri", "ax", "ay", "bx", "by", "cx", "cy"])

    # the work lies in the triangles and not in the bytes, by which partitions would be merged
    parts = int(points.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return points.repartition(parts, *by).groupBy(*by).applyInPandas(run, schema)


def nearest_field(target: np.ndarray, source: np.ndarray, patch: int = 3, passes: int = 10, seed: int = 0) -> np.ndarray:
    """For each target pixel the source place whose patch is most alike: neighbours' offsets are tried in turn, then random places in shrinking rings."""
    h, w = target.shape[:2]
    sh, sw = source.shape[:2]
    k = patch // 2
    pad = lambda a: np.pad(a.astype(float), ((k, k), (k, k), (0, 0)), mode="edge")
    a, b = pad(target), pad(source)
    r = np.random.default_rng(seed)
    field = np.stack([r.integers(0, sh, (h, w)), r.integers(0, sw, (h, w))], axis=2)
    cost = lambda v, u, p: ((a[v : v + patch, u : u + patch] - b[p[0] : p[0] + patch, p[1] : p[1] + patch]) ** 2).sum()
    best = np.array([[cost(v, u, field[v, u]) for u in range(w)] for v in range(h)])
    for n in range(passes):
        step = 1 if n % 2 == 0 else -1
        for v in range(h)[::step]:
            for u in range(w)[::step]:
                tries = [field[v - step, u] + (step, 0)] if 0 <= v - step < h else []
                tries += [field[v, u - step] + (0, step)] if 0 <= u - step < w else []
                size = max(sh, sw)
                while size >= 1:
                    tries.append(field[v, u] + r.integers(-size, size + 1, 2))
                    size //= 2
                for p in tries:
                    if 0 <= p[0] < sh and 0 <= p[1] < sw and (c := cost(v, u, p)) < best[v, u]:
                        best[v, u], field[v, u] = c, p
    return field


def fill_inward(image: DataFrame, mask: DataFrame, by: list[str], values: list[str]) -> DataFrame:
    """Fills a mask from its rim: each round, masked pixels with known neighbours take their mean and leave the work list.

    Ends when a round fills nothing, however wide the mask is. Only the mask and the known pixels
    beside it take part in the rounds, and each round is one join and one table. Masked pixels that no known one
    reaches stay out, as masked pixels do whose image has none.
    """
    offsets = F.array(*(F.struct(F.lit(dv).alias("dv"), F.lit(du).alias("du")) for dv in (-1, 0, 1) for du in (-1, 0, 1) if dv or du))
    cell = [*by, "v", "u"]
    beside = lambda df: df.withColumn("_o", F.explode(offsets))
    known, masked = image.select(*cell, *values).join(mask, cell, "left_anti"), mask.select(*cell).distinct()
    around = beside(masked).select(*by, (F.col("v") + F.col("_o.dv")).alias("v"), (F.col("u") + F.col("_o.du")).alias("u")).distinct()
    # turn 0: known, null: open, else the round that filled it
    state = known.join(around, cell, "left_semi").withColumn("_turn", F.lit(0)).unionByName(masked.withColumn("_turn", F.lit(None).cast("int")), allowMissingColumns=True)
    state, turn = written(state, "fill"), 0
    while True:
        turn += 1
        # only the last round's pixels can bring a new open pixel into reach; all known ones beside it count in its mean
        front = beside(state.where(F.col("_turn") == turn - 1)).select(*by, (F.col("v") + F.col("_o.dv")).alias("v"), (F.col("u") + F.col("_o.du")).alias("u")).distinct()
        rim = state.where("_turn is null").select(*cell).join(front, cell, "left_semi")
        near = beside(rim).select(*cell, (F.col("v") + F.col("_o.dv")).alias("_v"), (F.col("u") + F.col("_o.du")).alias("_u"))
        seen = near.join(state.where("_turn is not null").select(*by, F.col("v").alias("_v"), F.col("u").alias("_u"), *values), [*by, "_v", "_u"])
        fresh = seen.groupBy(*cell).agg(*(F.avg(x).alias(f"_new_{x}") for x in values), F.lit(turn).alias("_now"))
        grown = state.join(fresh, cell, "left").select(*cell, *(F.coalesce(x, f"_new_{x}").alias(x) for x in values), F.coalesce("_turn", "_now").alias("_turn"))
        state = written(grown, "fill")
        if state.where(F.col("_turn") == turn).isEmpty():
            return known.unionByName(state.where("_turn > 0").select(*cell, *values))


def multi_scale(unary: np.ndarray, weight: float = 1.0, cut: float = 10.0, levels: int = 5, iterations: int = 5, quadratic: bool = False) -> np.ndarray:
    """Labels of a grid by belief propagation from coarse to fine with a truncated linear or quadratic cost between neighbours."""
    pyramid = [unary.astype(float)]
    while len(pyramid) < levels and min(pyramid[-1].shape[:2]) > 1:
        h, w = pyramid[-1].shape[:2]
        p = np.pad(pyramid[-1], ((0, h % 2), (0, w % 2), (0, 0)))
        pyramid.append(p[::2, ::2] + p[1::2, ::2] + p[::2, 1::2] + p[1::2, 1::2])
    d = np.arange(unary.shape[2])
    gap = np.abs(d[:, None] - d[None])
    pair = weight * np.minimum(gap * gap if quadratic else gap, cut)
    m = None
    for data in reversed(pyramid):
        h, w, n = data.shape
        m = np.zeros((4, h, w, n)) if m is None else np.repeat(np.repeat(m, 2, axis=1), 2, axis=2)[:, :h, :w]
        v, u = np.indices((h, w))
        for t in range(iterations):
            into = np.zeros((4, h, w, n))
            into[0, 1:], into[1, :-1], into[2, :, 1:], into[3, :, :-1] = m[1, :-1], m[0, 1:], m[3, :, :-1], m[2, :, 1:]
            turn = (v + u + t) % 2 == 0
            for k in range(4):
                base = data + into.sum(axis=0) - into[k]
                out = (base[..., None] + pair).min(axis=2)
                m[k][turn] = (out - out.mean(axis=2, keepdims=True))[turn]
    belief = unary.astype(float).copy()
    belief[1:] += m[1, :-1]
    belief[:-1] += m[0, 1:]
    belief[:, 1:] += m[3, :, :-1]
    belief[:, :-1] += m[2, :, 1:]
    return belief.argmin(axis=2)


def add_noise(df: DataFrame, value: str, sigma: float, seed: int = 0, low: float = 0.0, high: float = 255.0) -> DataFrame:
    """Gaussian noise, clamped."""
    return df.withColumn(value, F.least(F.greatest(F.col(value) + sigma * F.randn(seed), F.lit(low)), F.lit(high)))
