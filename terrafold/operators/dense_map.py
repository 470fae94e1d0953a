"""Filling masked pixels from other frames of their sequence, by re-projection."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import geometry as g
from ..storage import written

#: Which ways along time are searched one after the other, or together.
ORDERS = {"forward": ("f", "b"), "backward": ("b", "f"), "interleaved": ("fb",)}


def first_views(wanted: DataFrame, poses: DataFrame, masks: DataFrame, k: np.ndarray, extrinsic: np.ndarray, width: int, height: int, by: list[str] | None = None, order: str = "forward", skip_adjacent: bool = True, window: int = 4) -> DataFrame:
    """For each wanted pixel ``frame, u, v`` with its point ``x, y, z`` (in its frame's axes) the first frame that sees the point: ``source, su, sv``.

    Seen: in front, in the image, not on the ``masks`` (``frame, u, v``) of that frame. Frames are searched in the order of
    ``frame`` within ``by``: those ahead first, then those behind; those behind first; or by turns. The search behind passes
    over the frame next to the own one, as the reference semantics do, unless told not to. A point that no frame sees keeps its own
    frame and pixel.

    A round projects the pixels that are still open into the next ``window`` frames, then four times as many: what most pixels
    need costs one round, and the longest sequence takes the logarithm of its frames.
    """
    by, key = by or [], [*(by or []), "frame", "u", "v"]
    ranked = poses.withColumn("_n", F.row_number().over(Window.partitionBy(*by).orderBy("frame")))
    ranked = written(g.with_entries(ranked).drop("rx", "ry", "rz"), "poses")
    most = (ranked.agg(F.max("_n")).first()[0] or 1) - 1
    to = ranked.select(*by, *(F.col(c).alias("source" if c == "frame" else f"b_{c}") for c in ranked.columns if c not in by))
    hidden = masks.select(*by, F.col("frame").alias("source"), F.col("u").alias("su"), F.col("v").alias("sv")).distinct()
    left, found = wanted.select(*key, "x", "y", "z"), []
    camera = [f"_p{i}" for i in range(12)]
    for ways in ORDERS[order]:
        begin, size = 1, window
        while begin <= most:
            steps = ranked.withColumn("_t", F.explode(F.sequence(F.lit(begin), F.lit(min(most, begin + size - 1)))))
            moves = [F.struct(F.lit(at).alias("way"), (F.col("_n") + F.col("_t") if way == "f" else F.col("_n") - F.col("_t") - int(skip_adjacent)).alias("n")) for at, way in enumerate(ways)]
            steps = steps.withColumn("_m", F.explode(F.array(*moves))).withColumn("b__n", F.col("_m.n"))
            pairs = steps.join(to, [*by, "b__n"]).select(*by, "frame", "source", F.struct("_t", "_m.way").alias("_rank"), *(c.alias(n) for c, n in zip(g.pair_projection(k, extrinsic), camera, strict=True)))
            u, v, w = g.project(g.vec(), [F.col(c) for c in camera])
            seen = left.join(pairs, [*by, "frame"]).select(*key, "source", "_rank", g.pixel(u).alias("su"), g.pixel(v).alias("sv"), w.alias("_w"))
            seen = seen.where(g.in_image(F.col("su"), F.col("sv"), F.col("_w"), width, height)).join(hidden, [*by, "source", "su", "sv"], "left_anti")
            hits = written(seen.groupBy(*key).agg(F.min(F.struct("_rank", "source", "su", "sv")).alias("_s")).select(*key, "_s.source", "_s.su", "_s.sv"), "hits")
            found.append(hits)
            begin, size = begin + size, size * 4
            left = written(left.join(hits.select(*key), key, "left_anti"), "open")
            if left.isEmpty():
                break
    own = left.select(*key, F.col("frame").alias("source"), F.col("u").alias("su"), F.col("v").alias("sv"))
    for hits in found:
        own = own.unionByName(hits)
    return own


def fill(wanted: DataFrame, poses: DataFrame, masks: DataFrame, images: DataFrame, k: np.ndarray, extrinsic: np.ndarray, width: int, height: int, by: list[str] | None = None, label_scale: int = 1, **search) -> DataFrame:
    """The wanted pixels with what their first view's image holds there (null where it holds nothing), ``source, su, sv`` and ``label``.

    ``images``: ``frame, u, v`` and colours. The label counts frames from the sequence's first one, times ``label_scale``, modulo 255.
    """
    by = by or []
    views = first_views(wanted, poses, masks, k, extrinsic, width, height, by, **search)
    colours = [c for c in images.columns if c not in [*by, "frame", "u", "v"]]
    texture = images.select(*by, F.col("frame").alias("source"), F.col("u").alias("su"), F.col("v").alias("sv"), *colours)
    start = poses.groupBy(*by).agg(F.min("frame").alias("_start"))
    out = views.join(texture, [*by, "source", "su", "sv"], "left")
    out = out.join(start, by) if by else out.crossJoin(F.broadcast(start))  # one row
    return out.select(*by, "frame", "u", "v", "source", "su", "sv", *colours, ((F.col("source") - F.col("_start")) * label_scale % 255).cast("int").alias("label"))
