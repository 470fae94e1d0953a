"""Grouped solvers: planes, eigenvalues, Gauss-Newton pose estimation, rotation search."""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType, LongType, StructField, StructType

from ..functions import geometry as g


def plane(xyz: np.ndarray) -> np.ndarray:
    """Unit normal and offset of the plane through points (least squares on ``n . p = -1``)."""
    n, *_ = np.linalg.lstsq(xyz, -np.ones(len(xyz)), rcond=None)
    size = np.linalg.norm(n)
    return np.append(n, 1.0) / (size or 1.0)


def is_line(values: np.ndarray, ratio: float = 3.0) -> bool:
    """Largest eigenvalue (of rising ones) over ``ratio`` times the next."""
    return bool(values[2] > ratio * values[1])


def eigen(covariances: DataFrame, by: list[str]) -> DataFrame:
    """Eigenvalues (rising) and the main axis of covariances ``c00 … c22``."""
    names = ["c00", "c01", "c02", "c11", "c12", "c22"]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in covariances.schema.fields if f.name in by) + ", e0 double, e1 double, e2 double, ax double, ay double, az double, line boolean"

    def run(batches):
        for d in batches:
            a = d[names].to_numpy(float)
            m = a[:, [0, 1, 2, 1, 3, 4, 2, 4, 5]].reshape(-1, 3, 3)
            w, v = np.linalg.eigh(m)
            out = d[by].copy()
            out[["e0", "e1", "e2"]], out[["ax", "ay", "az"]] = w, v[:, :, 2]
            out["line"] = w[:, 2] > 3 * w[:, 1]
            yield out

    return covariances.select(*by, *names).mapInPandas(run, schema)


def gauss_newton(points: np.ndarray, target: np.ndarray, normals: np.ndarray, start: np.ndarray | None = None, iterations: int = 25, stop: tuple[float, float] = (1e-3, 1e-3), eigen_floor: float = 1e-9, step_scale: float = 1.0) -> tuple[np.ndarray, int]:
    """Pose that brings points onto planes ``normal . (p - target) = 0``: (rx, ry, rz, tx, ty, tz), iterations used.

    Directions whose eigenvalue stays below ``eigen_floor`` are projected out of every step.
    """
    pose = np.zeros(6) if start is None else start.astype(float).copy()
    for n in range(1, iterations + 1):
        m = g.pose_matrix(*pose)
        moved = points @ m[:3, :3].T + m[:3, 3]
        residual = ((moved - target) * normals).sum(axis=1)
        jac = np.empty((len(points), 6))
        jac[:, 3:] = normals
        for k in range(3):
            h = np.zeros(6)
            h[k] = 1e-6
            turned = points @ g.pose_matrix(*(pose + h))[:3, :3].T + m[:3, 3]
            jac[:, k] = ((turned - moved) * normals).sum(axis=1) / 1e-6
        values, vectors = np.linalg.eigh(jac.T @ jac)
        keep = values > eigen_floor
        step = vectors[:, keep] @ ((vectors[:, keep].T @ (-step_scale * jac.T @ residual)) / values[keep])
        pose += step
        if np.degrees(np.linalg.norm(step[:3])) < stop[0] and 100 * np.linalg.norm(step[3:]) < stop[1]:
            break
    return pose, n


def register(source: DataFrame, by: list[str], **settings) -> DataFrame:
    """One pose a group from rows ``x, y, z, qx, qy, qz, nx, ny, nz`` (point, point on its plane, normal)."""
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in source.schema.fields if f.name in by) + ", rx double, ry double, rz double, tx double, ty double, tz double, iterations int"

    def run(key: tuple, d: pd.DataFrame) -> pd.DataFrame:
        pose, n = gauss_newton(d[["x", "y", "z"]].to_numpy(float), d[["qx", "qy", "qz"]].to_numpy(float), d[["nx", "ny", "nz"]].to_numpy(float), **settings)
        return pd.DataFrame([[*key, *pose, n]], columns=[*by, "rx", "ry", "rz", "tx", "ty", "tz", "iterations"])

    return source.groupBy(*by).applyInPandas(run, schema)


def accumulate_poses(steps: DataFrame, by: list[str], order: str, drift_scale: float = 1.05) -> DataFrame:
    """Ordered composition of relative poses per sequence."""
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in steps.schema.fields if f.name in [*by, order]) + ", rx double, ry double, rz double, tx double, ty double, tz double"

    def run(d: pd.DataFrame) -> pd.DataFrame:
        d, pose, out = d.sort_values(order), np.eye(4), []
        for row in d[["rx", "ry", "rz", "tx", "ty", "tz"]].to_numpy(float):
            pose = g.accumulate(pose, row, drift_scale)
            out.append(g.matrix_pose(pose))
        return d[[*by, order]].assign(**dict(zip(["rx", "ry", "rz", "tx", "ty", "tz"], np.array(out).reshape(-1, 6).T, strict=True)))

    return steps.groupBy(*by).applyInPandas(run, schema)


def rotation_candidates(df: DataFrame, step: float, reach: int = 10) -> DataFrame:
    """Each row with every candidate ``(2 reach + 1)^2`` of angles about x and y."""
    k = F.sequence(F.lit(-reach), F.lit(reach))
    return df.withColumn("i", F.explode(k)).withColumn("j", F.explode(k)).withColumn("candidate", (F.col("i") + reach) * (2 * reach + 1) + F.col("j") + reach).withColumn("ax", F.col("i") * step).withColumn("ay", F.col("j") * step)


def rotation_search(df: DataFrame, cost: Column, step: float, by: list[str], reach: int = 10) -> DataFrame:
    """The candidate with the smallest mean positive cost, the first on ties. Costs are averaged before the shuffle."""
    scored = rotation_candidates(df, step, reach).withColumn("_c", cost)
    mean = scored.groupBy(*by, "candidate", "ax", "ay").agg(F.avg(F.when(F.col("_c") > 0, F.col("_c"))).alias("mean_cost")).where("mean_cost is not null")
    return mean.groupBy(*by).agg(F.min(F.struct(F.round("mean_cost", 9).alias("mean_cost"), "candidate", "ax", "ay")).alias("m")).select(*by, "m.*")


def _candidate_cameras(points: pa.Table, step: float, reach: int) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """For every candidate around the rows' own angles ``ax, ay, az`` (alike in all rows): its number and the rows' places under it."""
    ax, ay, az = (points[c][0].as_py() for c in ("ax", "ay", "az"))
    x, y, z = (points[c].to_numpy().astype(float) for c in "xyz")
    for n, (i, j) in enumerate(itertools.product(range(-reach, reach + 1), repeat=2)):
        (sx, cx), (sy, cy), (sz, cz) = ((math.sin(a), math.cos(a)) for a in (ax + i * step, ay + j * step, az))
        m = (cz * cy, cz * sy * sx - sz * cx, cz * sy * cx + sz * sx, sz * cy, sz * sy * sx + cz * cx, sz * sy * cx - cz * sx, -sy, cy * sx, cy * cx)
        yield n, *(m[3 * r] * x + m[3 * r + 1] * y + m[3 * r + 2] * z for r in range(3))


def _candidate_pixels(points: pa.Table, k: np.ndarray, shift: list[float], width: int, height: int, step: float, reach: int) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Candidate, row numbers, ``u``, ``v`` and depth of what each candidate has in its image."""
    for n, *cam in _candidate_cameras(points, step, reach):
        x, y, z = (c + o for c, o in zip(cam, shift, strict=True))
        with np.errstate(all="ignore"):
            u, v = (np.trunc((float(row[0]) * x + float(row[1]) * y + float(row[2]) * z) / z + 0.5) for row in k[:2])
        at = np.flatnonzero((u >= 0) & (u < width) & (v >= 0) & (v < height) & (z > 0))
        yield n, at, u[at].astype(np.int64), v[at].astype(np.int64), z[at]


def _tile_costs(points: pa.Table, image: pa.Table, colours: list[str], tile: int, *camera) -> tuple[np.ndarray, np.ndarray]:
    """Sum and number of the positive costs of each candidate in one tile of one image."""
    reach = camera[-1]
    total, count = np.zeros((2 * reach + 1) ** 2), np.zeros((2 * reach + 1) ** 2, np.int64)
    points, corner = points.sort_by("pt"), (points["_tu"][0].as_py(), points["_tv"][0].as_py())  # of equal depths the first
    shade = [points[c].to_numpy().astype(float) for c in colours]
    black, off = [np.zeros(tile * tile) for _ in colours], np.zeros(tile * tile, bool)
    if image.num_rows:
        at = (image["_v"].to_numpy() - corner[1] * tile) * tile + image["_u"].to_numpy() - corner[0] * tile
        off[at[image["_off"].to_numpy()]] = True
        for c, b in zip(colours, black, strict=True):
            held = image[f"_i{c}"].is_valid().to_numpy()
            b[at[held]] = image[f"_i{c}"].drop_null().to_numpy()
    for n, at, u, v, z in _candidate_pixels(points, *camera):
        own = (u // tile == corner[0]) & (v // tile == corner[1])
        at, pixel, z = at[own], (v[own] - corner[1] * tile) * tile + u[own] - corner[0] * tile, z[own]
        order = np.argsort(z, kind="stable")
        pixel, first = np.unique(pixel[order], return_index=True)
        seen = at[order][first]
        cost = sum(np.abs(b[pixel] - s[seen]) for b, s in zip(black, shade, strict=True)) / len(colours)
        positive = (cost > 0) & ~off[pixel]
        total[n], count[n] = cost[positive].sum(), positive.sum()
    return total, count


def projected_search(points: DataFrame, image: DataFrame, start: DataFrame, k: np.ndarray, shift: list[float], width: int, height: int, by: list[str], colours: list[str], step: float, reach: int = 10, counted: Column | None = None, tile: int = 256) -> DataFrame:
    """The rotation about x and y, among ``(2 reach + 1)^2`` around each group's own ``ax, ay, az``, under which its points' colours differ least from the image.

    Every candidate has a z-buffer of its own: of the points in a pixel the nearest counts (then the smallest ``pt``), where ``counted`` (of
    ``u, v``) holds. A pixel's cost is the mean of its channels' differences, black where the image has none; a candidate's is the mean of
    the positive costs, and of equal ones the first candidate stays. ``by, candidate, mean_cost, ax, ay, az``.

    Points are dealt out by the image tiles of ``tile`` pixels that they fall into under some candidate (mostly one), so a point is shuffled once and not once a
    candidate; a tile's task goes through the candidates one by one and hands on their sums.
    """
    camera, side = (k, shift, width, height, step, reach), 2 * reach + 1
    types = {f.name: f.dataType for f in points.schema.fields}
    angles = ["ax", "ay", "az"]
    rows = points.select(*by, "pt", *colours, "x", "y", "z").join(start.select(*by, *(F.col(c).cast("double").alias(c) for c in angles)), by)
    dealt = StructType([*rows.schema.fields, StructField("_tu", LongType()), StructField("_tv", LongType())])

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        across = -(-width // tile)
        for batch in batches:
            table = pa.Table.from_batches([batch])
            own = np.column_stack([table[c].to_numpy() for c in angles])
            which = np.unique(own, axis=0, return_inverse=True)[1].ravel()
            for one in range(which.max(initial=-1) + 1):
                part = table.take(pa.array(np.flatnonzero(which == one)))
                hit = [np.unique(at * np.int64(across << 32) + (v // tile) * across + u // tile) for _, at, u, v, _ in _candidate_pixels(part, *camera)]
                row, cell = np.divmod(np.unique(np.concatenate(hit)), np.int64(across << 32))
                out = part.take(pa.array(row)).append_column("_tu", pa.array(cell % across)).append_column("_tv", pa.array(cell // across))
                yield from out.to_batches()

    seen = rows.mapInArrow(deal, dealt)
    keys = [f"_of_{c}" for c in by]  # names of their own: both sides may come from one table
    shown = image.select(*(F.col(c).alias(n) for c, n in zip(by, keys, strict=True)), "u", "v", *(F.col(c).cast("double").alias(f"_i{c}") for c in colours), F.lit(False).alias("_off"))
    if counted is not None:
        grid = points.sparkSession.range(width * height).select((F.col("id") % width).alias("u"), F.floor(F.col("id") / width).alias("v"))
        grid = grid.where(~F.coalesce(counted, F.lit(False))).crossJoin(start.select(*(F.col(c).alias(n) for c, n in zip(by, keys, strict=True))).distinct())
        shown = shown.unionByName(grid.withColumn("_off", F.lit(True)), allowMissingColumns=True)
    shown = shown.select(*keys, F.col("u").cast("long").alias("_u"), F.col("v").cast("long").alias("_v"), *(f"_i{c}" for c in colours), "_off")
    shown = shown.select("*", F.floor(F.col("_u") / tile).alias("_iu"), F.floor(F.col("_v") / tile).alias("_iv")).where(g.in_image(F.col("_u"), F.col("_v"), F.lit(1.0), width, height))
    costs = StructType([*(StructField(c, types[c]) for c in by), StructField("candidate", IntegerType()), StructField("_s", DoubleType()), StructField("_n", LongType())])

    def score(here: pa.Table, of: pa.Table) -> pa.Table:
        total, count = _tile_costs(here, of, colours, tile, *camera) if here.num_rows else (np.zeros(0), np.zeros(0, np.int64))
        some = np.flatnonzero(count)
        own = [here[c].take(pa.array(np.zeros(len(some), int))) for c in by]
        return pa.table([*own, pa.array(some, pa.int32()), pa.array(total[some]), pa.array(count[some])], names=costs.names)

    parts = seen.groupBy(*by, "_tu", "_tv").cogroup(shown.groupBy(*keys, "_iu", "_iv")).applyInArrow(score, costs)
    mean = parts.groupBy(*by, "candidate").agg((F.sum("_s") / F.sum("_n")).alias("mean_cost"))
    best = mean.groupBy(*by).agg(F.min(F.struct(F.round("mean_cost", 9).alias("mean_cost"), "candidate")).alias("m")).join(start.select(*by, *angles), by)
    i, j = F.floor(F.col("m.candidate") / side) - reach, F.col("m.candidate") % side - reach
    return best.select(*by, "m.candidate", "m.mean_cost", (F.col("ax") + i * step).alias("ax"), (F.col("ay") + j * step).alias("ay"), "az")


def two_stage_search(points: DataFrame, image: DataFrame, start: DataFrame, *camera, steps: tuple[float, ...] = (1e-3, 1e-4), **settings) -> DataFrame:
    """:func:`projected_search` with finer and finer steps, each around what the one before found; groups without any cost drop out."""
    from ..storage import written

    start = written(start, "rotation")
    for step in steps:
        found = written(projected_search(points, image, start, *camera, step=step, **settings), "rotation")
        start = found.select(*(c for c in start.columns))
    return found
