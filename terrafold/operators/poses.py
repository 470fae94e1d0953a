"""Sequences of poses: ordered composition as a parallel scan, fusing odometry with a map correction."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import geometry as g
from ..storage import written

POSE = ["rx", "ry", "rz", "tx", "ty", "tz"]
#: A rigid motion as twelve columns, row-major: rotation and shift.
MOTION = [f"p{i}{j}" for i in range(3) for j in range(4)]


def motion(rx: Column, ry: Column, rz: Column, shift: g.Vec, inverse: bool = False) -> dict[str, Column]:
    """The twelve columns of a pose, or of its inverse."""
    r = g.rotation_entries(rx, ry, rz)
    if not inverse:
        return {f"p{i}{j}": r[3 * i + j] if j < 3 else shift[i] for i in range(3) for j in range(4)}
    return {f"p{i}{j}": r[3 * j + i] if j < 3 else -sum((r[3 * k + i] * shift[k] for k in (1, 2)), r[i] * shift[0]) for i in range(3) for j in range(4)}


def product(a: str, b: str) -> list[Column]:
    """The twelve columns of the motion ``a`` behind ``b`` (prefixes of column names)."""
    p, q = ([F.col(f"{x}{m}") for m in MOTION] for x in (a, b))
    return [p[4 * i] * q[j] + p[4 * i + 1] * q[4 + j] + p[4 * i + 2] * q[8 + j] + (p[4 * i + 3] if j == 3 else 0.0) for i in range(3) for j in range(4)]


def angles(prefix: str = "") -> dict[str, Column]:
    """``rx … tz`` of twelve columns."""
    p = {m: F.col(f"{prefix}{m}") for m in MOTION}
    return {"rx": F.asin(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), -p["p12"]))), "ry": F.atan2(p["p02"], p["p22"]), "rz": F.atan2(p["p10"], p["p11"]), "tx": p["p03"], "ty": p["p13"], "tz": p["p23"]}


def scanned(m: np.ndarray, new: np.ndarray) -> np.ndarray:
    """Prefix products of 4 x 4 matrices within segments that begin where ``new`` is set, in as many rounds as the longest segment has doublings."""
    begin = np.maximum.accumulate(np.where(new, np.arange(len(m)), 0))
    place, m, d = np.arange(len(m)) - begin, m.copy(), 1
    while d <= place.max(initial=0):
        at = np.flatnonzero(place >= d)
        m[at] = m[at - d] @ m[at]
        d *= 2
    return m


def _prefix(rows: DataFrame, by: list[str], order: str) -> DataFrame:
    """Prefix products of the rows' motions within ``by``, streamed: rows are dealt out by ``by`` and sorted, and only the running product is held."""
    names = [*by, order]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last, running = None, None
        for d in batches:
            if not len(d):
                continue
            m = np.tile(np.eye(4), (len(d), 1, 1))
            m[:, :3] = d[MOTION].to_numpy(float).reshape(-1, 3, 4)
            keys = list(zip(*(d[c].tolist() for c in by), strict=True)) if by else [()] * len(d)
            same = [str(a) == str(b) for a, b in zip(keys, [last, *keys[:-1]], strict=True)]
            if same[0]:
                m[0] = running @ m[0]
            m = scanned(m, np.array([True, *(not s for s in same[1:])]))
            last, running = keys[-1], m[-1]
            yield d[names].assign(**dict(zip(MOTION, m[:, :3].reshape(-1, 12).T, strict=True)))

    out = rows.select(*names, *MOTION)
    return out.repartition(*by).sortWithinPartitions(*names).mapInPandas(run, out.schema) if by else out.repartition(1).sortWithinPartitions(order).mapInPandas(run, out.schema)


def prefix_products(rows: DataFrame, by: list[str], order: str, bucket: int) -> DataFrame:
    """``by, order, p00 … p23``: each row's motion behind all earlier ones of its key.

    A parallel scan: products within each key and bucket of ``bucket`` units of ``order``, a scan over the buckets' totals, and one more product
    a row. So one key may hold any share of the rows; only its totals, one a bucket, are gone through in order.
    """
    local = written(_prefix(rows.withColumn("_b", F.floor(F.col(order) / bucket)), [*by, "_b"], order), "products")
    totals = local.groupBy(*by, "_b").agg(F.max_by(F.struct(*MOTION), order).alias("_m")).select(*by, "_b", "_m.*")
    sums = _prefix(totals, by, "_b")
    before = Window.partitionBy(*by).orderBy("_b")
    carry = sums.select(*(F.col(c).alias(f"_k_{c}") for c in [*by, "_b"]), *(F.lag(m).over(before).alias(f"_c_{m}") for m in MOTION))
    same = [F.col(c).eqNullSafe(F.col(f"_k_{c}")) for c in by]
    joined = local.join(carry, [F.col("_b") == F.col("_k__b"), *same])
    return joined.select(*by, order, *(F.when(F.col("_c_p00").isNull(), F.col(m)).otherwise(c).alias(m) for m, c in zip(MOTION, product("_c_", ""), strict=True)))


def accumulate(steps: DataFrame, by: list[str], order: str, bucket: int, drift_scale: float = 1.05) -> DataFrame:
    """Ordered composition of relative poses ``rx … tz``: the inverse of each sweep's motion behind all earlier ones; yaw and z are scaled first.

    ``order`` is a whole number. Of rows of one key and order any may come first.
    """
    shift = (F.col("tx"), F.col("ty"), F.col("tz") * drift_scale)
    rows = steps.select(*by, order, *(c.alias(n) for n, c in motion(F.col("rx"), F.col("ry") * drift_scale, F.col("rz"), shift, inverse=True).items()))
    return prefix_products(rows, by, order, bucket).select(*by, order, *(c.alias(n) for n, c in angles().items()))


def associate(rows: DataFrame, odometry: str = "", before: str = "before_", mapped: str = "mapped_") -> DataFrame:
    """The map pose of a new odometry pose: what moved since ``before`` is applied to ``mapped``; ``rx … tz`` are replaced, ``before`` and ``mapped`` stay."""
    def of(prefix: str, inverse: bool) -> dict[str, Column]:
        r = [F.col(f"{prefix}{c}") for c in POSE]
        return motion(*r[:3], (r[3], r[4], r[5]), inverse)

    staged = rows.select("*", *(c.alias(f"_{k}_{n}") for k, (p, i) in enumerate(((mapped, False), (before, True), (odometry, False))) for n, c in of(p, i).items()))
    staged = staged.select("*", *(c.alias(f"_q_{n}") for n, c in zip(MOTION, product("_0_", "_1_"), strict=True)))
    staged = staged.select("*", *(c.alias(f"_r_{n}") for n, c in zip(MOTION, product("_q_", "_2_"), strict=True)))
    new = angles("_r_")
    return staged.select(*(new[c.removeprefix(odometry)].alias(c) if c in [f"{odometry}{n}" for n in POSE] else F.col(c) for c in rows.columns))
