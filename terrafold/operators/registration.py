"""Registration of sweeps against the sweep before (odometry) or a map, as an outer loop of joins and aggregates.

Correspondences, residuals and Jacobians are columns; a sweep's 28 sums come from one aggregation, and only those reach
Python: a 6 x 6 solve on one row a sweep. Sweeps are registered at once, each against what it is given.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from ..functions import geometry as g
from ..storage import written
from .aggs import normal_equations
from .joins import knn_join

POSE = ["rx", "ry", "rz", "tx", "ty", "tz"]
_JACOBIAN = [f"a{k}" for k in range(6)]
Vec = g.Vec


def _minus(a: Vec, b: Vec) -> Vec:
    return tuple(p - q for p, q in zip(a, b, strict=True))  # type: ignore[return-value]


def _dot(a: Vec, b: Vec) -> Column:
    return a[0] * b[0] + a[1] * b[1] + a[2] * b[2]


def _cross(a: Vec, b: Vec) -> Vec:
    return a[1] * b[2] - a[2] * b[1], a[2] * b[0] - a[0] * b[2], a[0] * b[1] - a[1] * b[0]


def _scaled(a: Vec, s: Column) -> Vec:
    return tuple(p * s for p in a)  # type: ignore[return-value]


def _of(struct: str) -> Vec:
    return tuple(F.col(f"{struct}.{c}") for c in "xyz")  # type: ignore[return-value]


def staged(df: DataFrame, *stages: dict[str, Column]) -> DataFrame:
    """Columns added stage by stage: what a stage uses more than once is computed once, and expressions don't multiply out."""
    for stage in stages:
        df = df.select("*", *(c.alias(n) for n, c in stage.items()))
    return df


def _named(prefix: str, v: Vec) -> dict[str, Column]:
    return {f"{prefix}{c}": x for c, x in zip("xyz", v, strict=True)}


def with_line(df: DataFrame, p: Vec, a: Vec, b: Vec, gate: Column) -> DataFrame:
    """Unit vector ``_lx, _ly, _lz`` from the line through ``a`` and ``b`` to ``p``, and the distance ``_ld``; null unless ``gate``."""
    df = staged(df, _named("_e", _minus(a, b)) | _named("_f", _minus(p, a)) | _named("_g", _minus(p, b)), _named("_h", _cross(g.vec("_f"), g.vec("_g"))))
    df = staged(df, {"_area": F.sqrt(_dot(g.vec("_h"), g.vec("_h"))), "_long": F.sqrt(_dot(g.vec("_e"), g.vec("_e")))})
    ok = gate & (F.col("_area") > 0) & (F.col("_long") > 0)
    df = staged(df, {"_ld": F.when(ok, F.col("_area") / F.col("_long")), "_per": F.when(ok, 1 / (F.col("_area") * F.col("_long")))})
    return staged(df, _named("_l", _scaled(_cross(g.vec("_e"), g.vec("_h")), F.col("_per")))).drop("_area", "_long", "_per", *(f"_{n}{c}" for n in "efgh" for c in "xyz"))


def with_plane(df: DataFrame, p: Vec, a: Vec, b: Vec, c: Vec, gate: Column) -> DataFrame:
    """Unit normal ``_px, _py, _pz`` of the plane through three points, and ``p``'s signed distance ``_pd``; null unless ``gate``."""
    df = staged(df, _named("_e", _minus(b, a)) | _named("_f", _minus(c, a)) | _named("_g", _minus(p, a)), _named("_h", _cross(g.vec("_e"), g.vec("_f"))))
    df = staged(df, {"_area": F.sqrt(_dot(g.vec("_h"), g.vec("_h")))})
    df = staged(df, {"_per": F.when(gate & (F.col("_area") > 0), 1 / F.col("_area"))})
    df = staged(df, _named("_p", _scaled(g.vec("_h"), F.col("_per"))), {"_pd": _dot(g.vec("_p"), g.vec("_g"))})
    return df.drop("_area", "_per", *(f"_{n}{c}" for n in "efgh" for c in "xyz"))


_COVARIANCE = ["c00", "c01", "c02", "c11", "c12", "c22"]


def with_eigen(df: DataFrame) -> DataFrame:
    """Eigenvalues ``e0 <= e1 <= e2`` of symmetric matrices ``c00 … c22``, in closed form, and the unit axis ``ax, ay, az`` of the largest (any one or null where several are alike)."""
    c00, c01, c02, c11, c12, c22 = (F.col(c) for c in _COVARIANCE)
    df = staged(df, {"_mean": (c00 + c11 + c22) / 3})
    d0, d1, d2 = c00 - F.col("_mean"), c11 - F.col("_mean"), c22 - F.col("_mean")
    df = staged(
        df,
        {"_p": F.sqrt((d0 * d0 + d1 * d1 + d2 * d2 + 2 * (c01 * c01 + c02 * c02 + c12 * c12)) / 6), "_det": d0 * (d1 * d2 - c12 * c12) - c01 * (c01 * d2 - c12 * c02) + c02 * (c01 * c12 - d1 * c02)},
        {"_cos": F.when(F.col("_p") > 0, F.col("_det") / (2 * F.col("_p") * F.col("_p") * F.col("_p"))).otherwise(1.0)},
        {"_third": F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.col("_cos")))) / 3},
        {"e2": F.col("_mean") + 2 * F.col("_p") * F.cos("_third"), "e0": F.col("_mean") + 2 * F.col("_p") * F.cos(F.col("_third") + 2 * np.pi / 3)},
        {"e1": 3 * F.col("_mean") - F.col("e2") - F.col("e0")},
    )
    top = F.col("e2")
    rows = ((c00 - top, c01, c02), (c01, c11 - top, c12), (c02, c12, c22 - top))
    products = {k: _cross(rows[i], rows[j]) for k, (i, j) in enumerate(((0, 1), (0, 2), (1, 2)))}
    # the longest product of two rows of the matrix less its eigenvalue
    df = staged(df, {f"_v{k}": F.struct(_dot(v, v).alias("n"), *(x.alias(c) for x, c in zip(v, "xyz", strict=True))) for k, v in products.items()}, {"_v": F.greatest("_v0", "_v1", "_v2")})
    # rounding leaves a little where the two largest eigenvalues are one
    df = staged(df, {"_size": F.when(F.col("_v.n") > 1e-20 * F.pow("_p", F.lit(4.0)), F.sqrt("_v.n"))}, {f"a{c}": F.col(f"_v.{c}") / F.col("_size") for c in "xyz"})
    return df.drop("_mean", "_p", "_det", "_cos", "_third", "_v0", "_v1", "_v2", "_v", "_size")


def is_line(e1: Column, e2: Column, ratio: float = 3.0) -> Column:
    return e2 > ratio * e1


def with_plane_fit(df: DataFrame, points: str) -> DataFrame:
    """Unit normal ``_nx, _ny, _nz``, offset ``_no`` and largest residual ``_worst`` of the least-squares plane ``n . p = -1`` through an array of points; null where there is none."""
    add = lambda f: F.aggregate(points, F.lit(0.0), lambda s, p: s + f(p))
    sums = {f"_s{i}{j}": add(lambda p, i=i, j=j: p[i] * p[j]) for i, j in ("xx", "xy", "xz", "yy", "yz", "zz")} | {f"_s{c}": -add(lambda p, c=c: p[c]) for c in "xyz"}
    s = lambda n: F.col(f"_s{n}")
    rows = ((s("xx"), s("xy"), s("xz")), (s("xy"), s("yy"), s("yz")), (s("xz"), s("yz"), s("zz")))
    minors = [_named(f"_m{k}", _cross(rows[(k + 1) % 3], rows[(k + 2) % 3])) for k in range(3)]
    df = staged(df, sums, minors[0] | minors[1] | minors[2], {"_det": _dot(rows[0], g.vec("_m0"))})
    solve = [sum((F.col(f"_m{k}{c}") * s("xyz"[k]) for k in (1, 2)), F.col(f"_m0{c}") * s("x")) for c in "xyz"]
    df = staged(df, {f"_w{c}": F.when(F.abs("_det") > 1e-12, w / F.col("_det")) for c, w in zip("xyz", solve, strict=True)}, {"_size": F.sqrt(_dot(g.vec("_w"), g.vec("_w")))})
    df = staged(df, {"_no": F.when(F.col("_size") > 0, 1 / F.col("_size"))}, _named("_n", _scaled(g.vec("_w"), F.col("_no"))))
    far = F.array_max(F.transform(points, lambda p: F.abs(F.col("_nx") * p["x"] + F.col("_ny") * p["y"] + F.col("_nz") * p["z"] + F.col("_no"))))
    return staged(df, {"_worst": far}).drop("_det", "_size", *sums, *(f"_{n}{c}" for n in ("m0", "m1", "m2", "w") for c in "xyz"))


def with_start(df: DataFrame) -> DataFrame:
    """Points moved to their sweep's start, ``_cx, _cy, _cz``, with the steps on the way (``_a``, ``_b``) and the sines and cosines of the angles up to their ``share``."""
    s = F.col("share")
    trig = {f"_{f}{c}": h(s * F.col(f"r{c}")) for f, h in (("sin", F.sin), ("cos", F.cos)) for c in "xyz"}
    return staged(
        df, trig | _named("_o", tuple(F.col(c) - s * F.col(f"t{c}") for c in "xyz")),  # type: ignore[arg-type]
        {"_ax": F.col("_cosz") * F.col("_ox") + F.col("_sinz") * F.col("_oy"), "_ay": F.col("_cosz") * F.col("_oy") - F.col("_sinz") * F.col("_ox"), "_az": F.col("_oz")},
        {"_bx": F.col("_ax"), "_by": F.col("_cosx") * F.col("_ay") + F.col("_sinx") * F.col("_az"), "_bz": F.col("_cosx") * F.col("_az") - F.col("_sinx") * F.col("_ay")},
        {"_cx": F.col("_cosy") * F.col("_bx") - F.col("_siny") * F.col("_bz"), "_cy": F.col("_by"), "_cz": F.col("_cosy") * F.col("_bz") + F.col("_siny") * F.col("_bx")},
    )


def with_map(df: DataFrame) -> DataFrame:
    """Points in the map, ``_cx, _cy, _cz``, with the steps on the way before the shift (``_a``, ``_b``, ``_q``) and the angles' sines and cosines."""
    trig = {f"_{f}{c}": h(F.col(f"r{c}")) for f, h in (("sin", F.sin), ("cos", F.cos)) for c in "xyz"}
    return staged(
        df, trig,
        {"_ax": F.col("_cosz") * F.col("x") - F.col("_sinz") * F.col("y"), "_ay": F.col("_sinz") * F.col("x") + F.col("_cosz") * F.col("y"), "_az": F.col("z")},
        {"_bx": F.col("_ax"), "_by": F.col("_cosx") * F.col("_ay") - F.col("_sinx") * F.col("_az"), "_bz": F.col("_sinx") * F.col("_ay") + F.col("_cosx") * F.col("_az")},
        {"_qx": F.col("_cosy") * F.col("_bx") + F.col("_siny") * F.col("_bz"), "_qy": F.col("_by"), "_qz": F.col("_cosy") * F.col("_bz") - F.col("_siny") * F.col("_bx")},
        {f"_c{c}": F.col(f"_q{c}") + F.col(f"t{c}") for c in "xyz"},
    )


def start_jacobian(df: DataFrame) -> DataFrame:
    """Behind :func:`with_start`: derivatives ``a0 … a5`` of ``n . to_start(p)`` by the pose, for columns ``nx, ny, nz``."""
    n, a, b, c = g.vec("n"), g.vec("_a"), g.vec("_b"), g.vec("_c")
    sx, sy, sz, cx, cy, cz = (F.col(f"_{f}{k}") for f in ("sin", "cos") for k in "xyz")
    s = F.col("share")
    df = staged(df, {"_ux": cy * n[0] + sy * n[2], "_uz": cy * n[2] - sy * n[0]}, {"_ky": cx * n[1] - sx * F.col("_uz"), "_kz": sx * n[1] + cx * F.col("_uz")})
    by_x = n[0] * sy * b[1] + n[1] * b[2] - n[2] * cy * b[1]
    by_y = n[2] * c[0] - n[0] * c[2]
    by_z = n[0] * (cy * a[1] - sy * sx * a[0]) - n[1] * cx * a[0] + n[2] * (cy * sx * a[0] + sy * a[1])
    shift = (cz * F.col("_ux") - sz * F.col("_ky"), sz * F.col("_ux") + cz * F.col("_ky"), F.col("_kz"))
    return staged(df, {f"a{k}": s * v for k, v in enumerate((by_x, by_y, by_z))} | {f"a{3 + k}": -s * v for k, v in enumerate(shift)})


def map_jacobian(df: DataFrame) -> DataFrame:
    """Behind :func:`with_map`: derivatives ``a0 … a5`` of ``n . to_map(p)`` by the pose, for columns ``nx, ny, nz``."""
    n, a, b, q = g.vec("n"), g.vec("_a"), g.vec("_b"), g.vec("_q")
    sx, sy, cx, cy = (F.col(f"_{f}{k}") for f in ("sin", "cos") for k in "xy")
    by_x = n[0] * sy * b[1] - n[1] * b[2] + n[2] * cy * b[1]
    by_y = n[0] * q[2] - n[2] * q[0]
    by_z = n[0] * (sy * sx * a[0] - cy * a[1]) + n[1] * cx * a[0] + n[2] * (cy * sx * a[0] + sy * a[1])
    return staged(df, {f"a{k}": v for k, v in enumerate((by_x, by_y, by_z, *n))})


def _nearest_of_rings(moved: pa.Table, last: pa.Table, radius_sq: float, band: float, block: int = 1 << 20) -> pa.Table:
    """One group of :func:`ring_matches`; distances are held for ``block`` pairs at a time."""
    last = last.sort_by("pt")  # of equal distances the first
    xyz, to, ring, pt = (*(np.column_stack([t[c].to_numpy() for c in "xyz"]).astype(float) for t in (moved, last)), last["ring"].to_numpy(), last["pt"].to_numpy())
    picks, rows = {n: np.zeros(len(xyz), int) for n in ("near", "same", "other")}, max(1, block // max(1, len(to)))
    seen = {n: np.zeros(len(xyz), bool) for n in picks}
    for begin in range(0, len(xyz) if len(to) else 0, rows):
        part = slice(begin, begin + rows)
        dx, dy, dz = (xyz[part, k, None] - to[None, :, k] for k in range(3))
        d2 = dx * dx + dy * dy + dz * dz
        d2 = np.where(d2 < radius_sq, d2, np.inf)
        near = d2.argmin(axis=1)
        apart = np.abs(ring[None, :] - ring[near][:, None])
        for n, fit in (("near", True), ("same", (apart == 0) & (pt[None, :] != pt[near][:, None])), ("other", (apart > 0) & (apart <= band))):
            d = np.where(fit, d2, np.inf)
            at = d.argmin(axis=1)
            picks[n][part], seen[n][part] = at, np.isfinite(d[np.arange(len(d)), at])
    keep = pa.array(np.flatnonzero(seen["near"]))
    out = moved.take(keep)
    for n, at in picks.items():
        points = last.select(["pt", "ring", *"xyz"]).take(pa.array(at[seen["near"]])) if len(to) else last.select(["pt", "ring", *"xyz"])
        gone = pa.array(~seen[n][seen["near"]])
        out = out.append_column(n, pa.StructArray.from_arrays([c.combine_chunks() for c in points.columns], names=points.column_names, mask=gone))
    return out


def ring_matches(moved: DataFrame, last: DataFrame, by: list[str], radius_sq: float = 25.0, band: float = 2.5) -> DataFrame:
    """Each moved point with the nearest one of ``last`` (``near``), the next of its ring (``same``) and the nearest of other rings within ``band`` (``other``), as structs; null beyond the radius. Points without ``near`` are left out.

    ``moved``: ``by, pt, x, y, z`` and more; ``last``: ``by, pt, ring, x, y, z``. A group is one sweep's features against those of the sweep before, so the
    sensor bounds it; its pairs stay in the task, and only the points are shuffled.
    """
    schema, match = StructType(moved.schema.fields), StructType([StructField(c, last.schema[c].dataType) for c in ("pt", "ring", "x", "y", "z")])
    for n in ("near", "same", "other"):
        schema = schema.add(n, match)
    keys = [f"_of_{c}" for c in by]  # names of their own: both sides may come from one table
    last = last.select(*(F.col(c).alias(k) for c, k in zip(by, keys, strict=True)), *(F.col(c).alias(c) for c in match.names)).dropna(subset=keys)
    return moved.dropna(subset=by).groupBy(*by).cogroup(last.groupBy(*keys)).applyInArrow(lambda a, b: _nearest_of_rings(a, b, radius_sq, band), schema)


def _weighted(df: DataFrame, weight: Column, least: float = 0.1) -> DataFrame:
    """``nx, ny, nz`` and ``b`` times the weight; null where it is ``least`` or less. (No filter: one would be pushed below all stages and multiply them out.)"""
    df = staged(df, {"weight": weight}, {"_g": F.when(F.col("weight") > least, F.col("weight"))})
    return staged(df, {f"n{c}": F.col(f"_n{c}") * F.col("_g") for c in "xyz"} | {"b": -F.col("_d") * F.col("_g")})


def sweep_residuals(matched: DataFrame, late: bool) -> DataFrame:
    """Weighted rows ``a0 … a5, b`` of matched points with their sweep's pose: corners against lines, surfaces against planes.

    Rows whose weight is 0.1 or less, points on their line or plane and points without correspondences have nulls, which no sum counts.
    ``late``: from the sixth iteration on residuals are weighted down.
    """
    near, same, other = (_of(c) for c in ("near", "same", "other"))
    corner = F.col("kind") == "corner"
    df = with_start(matched)
    df = with_plane(with_line(df, g.vec("_c"), near, other, corner), g.vec("_c"), near, same, other, ~corner)
    df = staged(df, {f"_n{c}": F.coalesce(f"_l{c}", f"_p{c}") for c in "xyz"} | {"_d": F.nullif(F.coalesce("_ld", "_pd"), F.lit(0.0)), "_far": F.sqrt(F.sqrt(_dot(g.vec("_c"), g.vec("_c"))))})
    weight = F.lit(1.0) if not late else F.when(corner, 1 - 1.8 * F.abs("_d")).otherwise(1 - 1.8 * F.abs("_d") / F.col("_far"))
    return start_jacobian(_weighted(df, weight)).select(*matched.columns, *_JACOBIAN, "b")


def solved(rows: DataFrame, by: list[str], step_scale: float, stop: tuple[float, float], eigen_floor: float, least: int) -> DataFrame:
    """The next state of each sweep from its rows: sums, a 6 x 6 solve, a step.

    State: pose, ``done``, ``used`` (iterations) and ``basis``, the directions that the first solve found fit; others are projected out of all
    steps. Fewer than ``least`` rows give no step; a step below ``stop`` (degrees, hundredths) ends a sweep.
    """
    state = [*POSE, "done", "used", "basis"]
    sums = normal_equations(rows, _JACOBIAN, "b", [*by, *state], "b").na.fill(0.0)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields if f.name in [*by, *state])
    upper = np.triu_indices(6)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for d in batches:
            a = np.zeros((len(d), 6, 6))
            a[:, upper[0], upper[1]] = d[[f"a{i}{j}" for i, j in zip(*upper, strict=True)]].to_numpy(float)
            a = a + np.triu(a, 1).transpose(0, 2, 1)
            b = d[[f"b{i}" for i in range(6)]].to_numpy(float)
            pose, used, done, bases = d[POSE].to_numpy(float), d["used"].to_numpy().copy(), d["done"].to_numpy().copy(), list(d["basis"])
            for k in range(len(d)):
                if done[k]:
                    continue
                used[k] += 1
                if d["n"].iloc[k] < least:
                    continue
                if bases[k] is None:
                    values, vectors = np.linalg.eigh(a[k])
                    keep = vectors[:, values >= eigen_floor]
                    bases[k] = (keep @ keep.T).ravel().tolist()
                step = np.asarray(bases[k]).reshape(6, 6) @ (np.linalg.lstsq(a[k], b[k], rcond=None)[0] * step_scale)
                pose[k] = np.where(np.isfinite(pose[k] + step), pose[k] + step, 0.0)
                done[k] = np.linalg.norm(np.degrees(step[:3])) < stop[0] and 100 * np.linalg.norm(step[3:]) < stop[1]
            yield d[by].assign(**dict(zip(POSE, pose.T, strict=True)), done=done, used=used, basis=bases)

    return sums.mapInPandas(run, schema)


def _states(sweeps: DataFrame, by: list[str], start: DataFrame | None) -> DataFrame:
    state = sweeps.select(*by).distinct()
    state = state.select("*", *(F.lit(0.0).alias(c) for c in POSE)) if start is None else state.join(start.select(*by, *POSE), by)
    return state.select(*by, *POSE, F.lit(False).alias("done"), F.lit(0).alias("used"), F.lit(None).cast("array<double>").alias("basis"))


def odometry(points: DataFrame, last: DataFrame, by: list[str], start: DataFrame | None = None, iterations: int = 25, every: int = 5, step_scale: float = 0.05, stop: tuple[float, float] = (0.1, 0.1), eigen_floor: float = 10.0, least: int = 10, corners: int = 10, surfaces: int = 100) -> DataFrame:
    """The motion ``rx … tz`` of each sweep from the one before, and the iterations used.

    ``points``: ``by, kind, pt, x, y, z, share``: the sweep's sharp corners and flat surfaces (``kind`` ``corner`` or ``surface``)
    with their share of the sweep; ``last``: ``by, kind, pt, ring, x, y, z``: what the sweep before left. Correspondences are sought anew ``every``
    iterations. Sweeps whose last one has no more than ``corners`` corners or ``surfaces`` surface points keep their start.
    """
    count = lambda k: F.count_if(F.col("kind") == k)
    enough = last.groupBy(*by).agg(count("corner").alias("c"), count("surface").alias("s")).where(f"c > {corners} and s > {surfaces}").select(*by)
    state = written(_states(points, by, start), "state")
    for begin in range(0, iterations, every):
        going = state.where("not done").join(enough, by, "left_semi")
        own = [c for c in points.columns if c not in [*by, "kind", "pt"]]
        moved = with_start(points.join(going, by)).select(*by, "kind", "pt", *(F.col(c).alias(f"_own_{c}") for c in own), *(F.col(f"_c{c}").alias(c) for c in "xyz"))
        found = ring_matches(moved, last, [*by, "kind"])
        places = [F.struct(*(F.col(f"{n}.{c}").alias(c) for c in "xyz")).alias(n) for n in ("near", "same", "other")]
        matched = written(found.select(*by, "kind", "pt", *(F.col(f"_own_{c}").alias(c) for c in own), *places), "matched")
        for n in range(begin, min(iterations, begin + every)):
            # a sweep's state goes on through its own rows, so the plan stays a chain
            going = solved(sweep_residuals(matched.join(going, by), n >= 5), by, step_scale, stop, eigen_floor, least)
        going = written(going, "state")
        state = written(state.join(going, by, "left_anti").unionByName(going), "state")
        if state.where("not done").isEmpty():
            break
    return state.select(*by, *POSE, "used")


def map_fits(near: DataFrame) -> DataFrame:
    """Five map points around each point, as ``c00 … c22``, centre ``mx, my, mz`` and array ``five``: eigenvalues, axis, plane and whether they are a line and a plane."""
    df = with_plane_fit(with_eigen(near), "five")
    return staged(df, {"line": is_line(F.col("e1"), F.col("e2")), "plane": F.coalesce(F.col("_worst") <= 0.2, F.lit(False))})


def five_nearest(moved: DataFrame, world: DataFrame, by: list[str], ident: str, key: list[str], search: Callable[..., DataFrame] = knn_join) -> DataFrame:
    """``key`` of each moved point with its five nearest points of ``world`` within 1: centre, covariance, array; points with fewer have none.

    ``search``: ``knn_grown`` where ``by`` leaves more points within 1 than a sweep's map has.
    """
    five = search(moved, world, 5, 1.0, ident, "pt", by)
    covariance = [F.covar_pop(f"p_{a}", f"p_{b}").alias(f"c{i}{j}") for i, a in enumerate("xyz") for j, b in enumerate("xyz") if i <= j]
    point = F.struct(*(F.col(f"p_{c}").alias(c) for c in "xyz"))
    return five.groupBy(*key).agg(F.count("*").alias("_n"), *covariance, *(F.avg(f"p_{c}").alias(f"m{c}") for c in "xyz"), F.collect_list(point).alias("five")).where("_n = 5").drop("_n")


def map_rows(points: DataFrame, state: DataFrame, world: DataFrame, by: list[str], area: list[str]) -> DataFrame:
    """Weighted rows of points against lines or planes through their five nearest map points, with their sweep's state; those that fit none have nulls.

    A line: the five's largest eigenvalue is over three times the next; a plane: no residual over 0.2. The fifth lies within 1.
    """
    placed = written(with_map(points.join(state, by)), "placed")
    ident = F.struct(*by, "kind", "pt").alias("id")
    moved = placed.select(*dict.fromkeys([*area, "kind"]), ident, *(F.col(f"_c{c}").alias(c) for c in "xyz"))
    near = five_nearest(moved, world.select(*area, "kind", "pt", "x", "y", "z"), [*area, "kind"], "id", ["id"])
    corner = F.col("kind") == "corner"
    df = placed.withColumn("id", ident).join(map_fits(near).select("id", "mx", "my", "mz", "ax", "ay", "az", "line", "plane", *(F.col(f"_n{c}").alias(f"_p{c}") for c in "xyz"), F.col("_no").alias("_po")), "id")
    ends = [tuple(F.col(f"m{c}") + s * F.col(f"a{c}") for c in "xyz") for s in (0.1, -0.1)]
    df = with_line(df, g.vec("_c"), *ends, corner & F.col("line"))  # type: ignore[arg-type]
    gate = ~corner & F.col("plane")
    df = staged(df, {"_pd": F.when(gate, _dot(g.vec("_p"), g.vec("_c")) + F.col("_po")), "_far": F.sqrt(F.sqrt(_dot(g.vec("_c"), g.vec("_c"))))})
    df = staged(df, {f"_n{c}": F.coalesce(f"_l{c}", F.when(gate, F.col(f"_p{c}"))) for c in "xyz"} | {"_d": F.coalesce("_ld", "_pd")})
    weight = F.when(corner, 1 - 0.9 * F.abs("_d")).otherwise(1 - 0.9 * F.abs("_d") / F.col("_far"))
    return map_jacobian(_weighted(df, weight)).select(*state.columns, "kind", "pt", *_JACOBIAN, "b")


def map_match(points: DataFrame, world: DataFrame, start: DataFrame, by: list[str], area: list[str] | None = None, iterations: int = 10, stop: tuple[float, float] = (0.05, 0.05), eigen_floor: float = 100.0, least: int = 50, corners: int = 10, surfaces: int = 100, cube: float = 50.0, reach: int = 2) -> DataFrame:
    """Each sweep's pose ``rx … tz`` in the map, from ``start`` on, and the iterations used.

    ``points``: ``by, kind, pt, x, y, z`` in sensor axes; ``world``: ``area, kind, pt, x, y, z``, with ``area`` (columns of ``points``,
    ``by`` if not given) naming the map that a sweep belongs to. Sweeps with no more than ``corners`` corners or ``surfaces`` surface
    points of the map in the cubes of edge ``cube`` up to ``reach`` cubes from their start keep their start.
    """
    area = by if area is None else area
    cell = lambda prefix: [F.floor(F.col(f"{prefix}{c}") / cube + 0.5).alias(f"_c{c}") for c in "xyz"]
    held = world.groupBy(*area, *cell("")).agg(F.count_if(F.col("kind") == "corner").alias("c"), F.count_if(F.col("kind") == "surface").alias("s"))
    around = points.select(*by, *(c for c in area if c not in by)).distinct().join(start, by).select(*by, *(c for c in area if c not in by), *cell("t"))
    for c in "xyz":
        around = around.withColumn(f"_c{c}", F.explode(F.sequence(F.col(f"_c{c}") - reach, F.col(f"_c{c}") + reach)))
    enough = around.join(held, [*area, "_cx", "_cy", "_cz"]).groupBy(*by).agg(F.sum("c").alias("c"), F.sum("s").alias("s")).where(f"c > {corners} and s > {surfaces}").select(*by)
    state = written(_states(points, by, start), "state")
    enough = written(enough, "enough")
    for _ in range(iterations):
        going = state.where("not done").join(enough, by, "left_semi")
        going = written(solved(map_rows(points, going, world, by, area), by, 1.0, stop, eigen_floor, least), "state")
        state = written(state.join(going, by, "left_anti").unionByName(going), "state")
        if state.where("not done").join(enough, by, "left_semi").isEmpty():
            break
    return state.select(*by, *POSE, "used")
