"""Raster operators on pixel tables ``(…, v, u, value)``."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import geometry as g
from .aggs import inverse_distance, zbuffer


def dilate(mask: DataFrame, dx: int, dy: int, by: list[str] | None = None) -> DataFrame:
    """Cells within a rectangle of half-sizes ``dx, dy`` around a mask cell: one axis, then the other."""
    by = by or []
    wide = mask.select(*by, "v", F.explode(F.sequence(F.col("u") - dx, F.col("u") + dx)).alias("u")).distinct()
    return wide.select(*by, "u", F.explode(F.sequence(F.col("v") - dy, F.col("v") + dy)).alias("v")).distinct()


def dilate_ellipse(mask: DataFrame, rx: int, ry: int, by: list[str] | None = None) -> DataFrame:
    """Cells within an ellipse: each row of it is a run."""
    by = by or []
    rows = mask.select(*by, "u", "v", F.explode(F.sequence(F.lit(-ry), F.lit(ry))).alias("_d"))
    half = F.floor(rx * F.sqrt(1 - F.col("_d") * F.col("_d") / float(ry * ry)) + 0.5)
    return rows.select(*by, (F.col("v") + F.col("_d")).alias("v"), F.explode(F.sequence(F.col("u") - half, F.col("u") + half)).alias("u")).distinct()


def mask_xor(a: DataFrame, b: DataFrame, on: list[str]) -> DataFrame:
    return a.join(b, on, "left_anti").unionByName(b.join(a, on, "left_anti"))


def complement(mask: DataFrame, width: int, height: int) -> DataFrame:
    grid = mask.sparkSession.range(width * height).select((F.col("id") % width).alias("u"), F.floor(F.col("id") / width).alias("v"))
    return grid.join(mask, ["u", "v"], "left_anti")


def project_points(points: DataFrame, matrix: list[float], width: int, height: int, front: bool = True) -> DataFrame:
    """Points that fall into the image, with pixel ``u, v`` and depth ``z_cam``."""
    u, v, w = g.project(g.vec(), matrix)
    rows = points.select("*", g.pixel(u).alias("u"), g.pixel(v).alias("v"), w.alias("z_cam"))
    return rows.where(g.in_image(F.col("u"), F.col("v"), F.col("z_cam"), width, height, front))


def tag_and_blank(projected: DataFrame, mask: DataFrame, on: list[str]) -> DataFrame:
    """Unmasked points keep their image link; masked ones lose it and their coordinates."""
    rows = projected.join(mask.select(*on, F.lit(True).alias("_m")), on, "left")
    return rows.select(*(F.when(F.col("_m").isNull(), F.col(c)).alias(c) if c in ("x", "y", "z") else F.col(c) for c in projected.columns), F.col("_m").isNull().alias("linked"))


def nearest_known(known: DataFrame, wanted: DataFrame, k: int, by: list[str], start: int = 8, longest: int | None = None) -> DataFrame:
    """The ``k`` nearest known pixels of each wanted one, exact: ``by, u, v, d2, depth``; fewer where an image has fewer.

    A grid of growing cells: a wanted pixel is done once it has ``k`` neighbours within the cell
    edge. An edge over the diagonal of all pixels, known and wanted, reaches the whole image, so what
    is left then has fewer than ``k`` known pixels in all and takes those. ``longest``: such an edge if
    the caller knows one, which saves measuring it.
    """
    from ..storage import written
    from .joins import knn_join

    ident = F.struct("v", "u").alias("id")
    p = known.select(*by, "u", "v", "depth", ident)
    done, left, edge = None, wanted.select(*by, "u", "v").distinct(), start
    if longest is None:
        box = p.select("u", "v").unionByName(left.select("u", "v")).agg(*(F.max(c) - F.min(c) for c in ("u", "v"))).first()
        longest = max(start, 2 + int(np.hypot(*(x or 0 for x in box))))
    while True:
        near = knn_join(left.select("*", ident), p, k, float(edge * edge), "id", "id", by, "uv")
        near = written(near.select(*by, "u", "v", "d2", F.col("p_depth").alias("depth"), F.count("*").over(Window.partitionBy(*by, "u", "v")).alias("_n")), "nearest")
        full = near.where((F.col("_n") == k) | F.lit(edge >= longest)).drop("_n")
        done = full if done is None else done.unionByName(full)
        if edge >= longest:
            return done
        left = written(left.join(full.select(*by, "u", "v").distinct(), [*by, "u", "v"], "left_anti"), "open")
        if left.isEmpty():
            return done
        edge = min(longest, 4 * edge)


def median(depth: DataFrame, by: list[str], reach: int = 2) -> DataFrame:
    """Median over the square of half-size ``reach`` (cells outside the raster don't count)."""
    steps = F.sequence(F.lit(-reach), F.lit(reach))
    spread = depth.withColumn("_i", F.explode(steps)).withColumn("_j", F.explode(steps))
    spread = spread.select(*by, (F.col("u") + F.col("_i")).alias("u"), (F.col("v") + F.col("_j")).alias("v"), "depth")
    m = spread.groupBy(*by, "u", "v").agg(F.median("depth").alias("median"))
    return depth.join(m, [*by, "u", "v"]).select(*by, "u", "v", F.col("median").alias("depth"))


def local_depth(samples: DataFrame, wanted: DataFrame, by: list[str], k: int = 10, smooth: bool = True) -> DataFrame:
    """Depth at the wanted pixels: z-buffer, inverse-distance mean of the ``k`` nearest, median."""
    known = zbuffer(samples, [*by, "u", "v"], "z_cam", "key").select(*by, "u", "v", F.col("z_cam").alias("depth"))
    near = nearest_known(known, wanted, k, by).select(*by, "u", "v", F.sqrt("d2").alias("distance"), "depth")
    filled = inverse_distance(near, [*by, "u", "v"], "depth", "distance")
    return median(filled, by) if smooth else filled


def gaussian_smooth(df: DataFrame, value: str, sigma: float, position: str, by: list[str], reach: int | None = None) -> DataFrame:
    """Gaussian weights along one axis, normalised over the rows there are."""
    reach = reach or int(np.ceil(4 * sigma))
    w = Window.partitionBy(*by).orderBy(position)
    weights = np.exp(-0.5 * (np.arange(-reach, reach + 1) / sigma) ** 2)
    terms = [(F.lag(value, -k).over(w), float(x)) for k, x in zip(range(-reach, reach + 1), weights, strict=True)]
    top = sum(F.coalesce(v, F.lit(0.0)) * x for v, x in terms)
    return df.select("*", (top / sum(F.when(v.isNotNull(), x).otherwise(0.0) for v, x in terms)).alias("smooth"))


def template_match(patches: DataFrame, image: DataFrame, offsets: DataFrame, by: list[str]) -> DataFrame:
    """Sum of squared differences of each patch at each offset, and the first smallest in row-major order."""
    shifted = patches.join(F.broadcast(offsets), by) if by else patches.crossJoin(F.broadcast(offsets))
    shifted = shifted.select(*by, "patch", "dv", "du", (F.col("v") + F.col("dv")).alias("v"), (F.col("u") + F.col("du")).alias("u"), F.col("value").alias("_p"))
    pairs = shifted.join(image, [*by, "v", "u"])
    cost = pairs.groupBy(*by, "patch", "dv", "du").agg(F.sum((F.col("_p") - F.col("value")) * (F.col("_p") - F.col("value"))).alias("cost"), F.count("*").alias("n"))
    return cost.groupBy(*by, "patch").agg(F.min(F.struct("cost", "dv", "du")).alias("m")).select(*by, "patch", "m.*")


def resize(df: DataFrame, factor: float, values: list[str]) -> DataFrame:
    """Nearest-neighbour scaling down: the first pixel of each target cell."""
    cell = [F.floor(F.col(c) * factor).alias(c) for c in ("u", "v")]
    first = F.min(F.struct("v", "u", *values))
    return df.groupBy(*(c.alias(f"_{n}") for c, n in zip(cell, "uv", strict=True))).agg(first.alias("m")).select(F.col("_u").alias("u"), F.col("_v").alias("v"), *(F.col(f"m.{x}").alias(x) for x in values))
