"""Multi-scale belief propagation over rasters of any size, tile by tile.

A level's messages depend on what lies as many pixels away as it has iterations. So a tile takes that many pixels more on each side,
runs all iterations of the level in its task, and keeps what is inside: exactly what a run over the whole raster gives, with one
shuffle a level instead of one an iteration, and no task ever holds more than a tile.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..storage import written


def sent(base: np.ndarray, weight: float, cut: float, quadratic: bool) -> np.ndarray:
    """For each label the least of ``base`` plus the cost of the step to it, truncated at ``weight * cut``, less the mean.

    Steps that cost in proportion take two passes over the labels; quadratic ones are compared label by label.
    """
    least = base.min(axis=-1, keepdims=True) + weight * cut
    if quadratic:
        out, n = least.repeat(base.shape[-1], axis=-1), base.shape[-1]
        for d in range(n):
            out = np.minimum(out, base[..., d : d + 1] + weight * (np.arange(n) - d) ** 2)
    else:
        out = base.copy()
        for d in range(1, base.shape[-1]):
            np.minimum(out[..., d], out[..., d - 1] + weight, out=out[..., d])
        for d in range(base.shape[-1] - 2, -1, -1):
            np.minimum(out[..., d], out[..., d + 1] + weight, out=out[..., d])
        out = np.minimum(out, least)
    return out - out.mean(axis=-1, keepdims=True)


def incoming(m: np.ndarray) -> np.ndarray:
    """What arrives at each pixel from above, below, left and right, of messages sent up, down, left and right."""
    into = np.zeros_like(m)
    into[0, 1:], into[1, :-1], into[2, :, 1:], into[3, :, :-1] = m[1, :-1], m[0, 1:], m[3, :, :-1], m[2, :, 1:]
    return into


def swept(data: np.ndarray, m: np.ndarray, known: np.ndarray, top: int, left: int, iterations: int, weight: float, cut: float, quadratic: bool) -> np.ndarray:
    """Messages after so many iterations of a checkerboard whose first pixel is ``top, left`` of the raster; pixels that aren't ``known`` send nothing."""
    v, u = np.indices(known.shape)
    m = np.where(known[None, ..., None], m, 0.0)
    for t in range(iterations):
        into = incoming(m)
        turn = known & ((v + top + u + left + t) % 2 == 0)
        total = data[turn] + into[:, turn].sum(axis=0)
        for k in range(4):
            m[k][turn] = sent(total - into[k][turn], weight, cut, quadratic)
    return m


def multi_scale_labels(cells: DataFrame, by: list[str], weight: float = 1.0, cut: float = 10.0, levels: int = 5, iterations: int = 5, quadratic: bool = False, tile: int = 64) -> DataFrame:
    """``by, v, u, label``: for rows ``by, v, u, cost array<double>`` (one cost a label) the labels of belief propagation from coarse to fine.

    Each level halves the one below by sums of 2 x 2 costs; a level starts from the messages of the next coarser one. Pixels that a raster lacks take no part.
    Of equal beliefs the smallest label wins. Each level is written, so a lost executor repeats its tiles alone.
    """
    labels = cells.agg(F.max(F.size("cost"))).first()[0]
    if labels is None:
        return cells.select(*by, "v", "u", F.lit(0).alias("label"))
    pyramid = [written(cells.select(*by, F.col("v").cast("int"), F.col("u").cast("int"), "cost"), "level")]
    while len(pyramid) < levels:
        box = pyramid[-1].agg(F.max("v").alias("v"), F.max("u").alias("u")).first()
        if min(box.v, box.u) < 1:
            break
        half = lambda c: F.floor(F.col(c) / 2).cast("int").alias(c)
        coarse = pyramid[-1].groupBy(*by, half("v"), half("u")).agg(F.array(*(F.sum(F.get("cost", F.lit(k))) for k in range(labels))).alias("cost"))
        pyramid.append(written(coarse, "level"))
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in cells.schema.fields if f.name in by)
    schema = f"{kinds}{', ' if by else ''}v int, u int, label int, messages array<double>"
    halo = iterations + 1

    def run(key: tuple, d: pd.DataFrame) -> pd.DataFrame:
        v, u = d["v"].to_numpy(int), d["u"].to_numpy(int)
        own = (v // tile == key[-2]) & (u // tile == key[-1])
        if not own.any():  # a rim beyond the raster's edge
            return d.loc[own, [*by, "v", "u"]].assign(label=pd.Series(dtype="int32"), messages=pd.Series(dtype=object))
        top, left = v.min(), u.min()
        shape = (v.max() - top + 1, u.max() - left + 1)
        data, m, known = np.zeros((*shape, labels)), np.zeros((4, *shape, labels)), np.zeros(shape, bool)
        at = (v - top, u - left)
        known[at] = True
        data[at] = np.stack(d["cost"])
        has = d["messages"].notna().to_numpy()
        if has.any():
            m[:, at[0][has], at[1][has]] = np.stack(d["messages"][has]).reshape(-1, 4, labels).transpose(1, 0, 2)
        m = swept(data, m, known, int(top), int(left), iterations, weight, cut, quadratic)
        belief = data + incoming(m).sum(axis=0)
        place = (at[0][own], at[1][own])
        out = d.loc[own, [*by, "v", "u"]]
        return out.assign(label=belief[place].argmin(axis=1).astype("int32"), messages=list(m[:, place[0], place[1]].transpose(1, 0, 2).reshape(-1, 4 * labels)))

    done = None
    for level in reversed(pyramid):
        if done is None:
            rows = level.withColumn("messages", F.lit(None).cast("array<double>"))
        else:
            half = lambda c: F.floor(F.col(c) / 2).cast("int").alias(f"_{c}")
            above = done.select(*by, F.col("v").alias("_v"), F.col("u").alias("_u"), "messages")
            rows = level.select("*", half("v"), half("u")).join(above, [*by, "_v", "_u"], "left").drop("_v", "_u")
        reach = lambda c: F.explode(F.sequence(F.floor((F.col(c) - halo) / tile), F.floor((F.col(c) + halo) / tile)))
        tiles = rows.withColumn("_tv", reach("v")).withColumn("_tu", reach("u"))
        done = written(tiles.groupBy(*by, "_tv", "_tu").applyInPandas(run, schema), "level")
    return done.drop("messages")
