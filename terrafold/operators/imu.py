"""Inertial states of sweeps: interpolation, the state that odometry takes of a sweep, points moved to a sweep's start."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import geometry as g
from .joins import _bracketed

STATE = ["roll", "pitch", "yaw", "vx", "vy", "vz", "px", "py", "pz"]


def states_at(left: DataFrame, states: DataFrame, time: str, by: list[str], prefix: str = "", bucket: int = 3_600_000_000) -> DataFrame:
    """Left rows with the state (``roll … pz``) at their time, linear between the states around it and the end state beyond the ends; yaw takes the short way round. Null where a key has no state."""
    both = _bracketed(left, states.select(*by, time, *STATE), time, STATE, by, bucket)
    p, n, t = F.col("_p"), F.col("_n"), F.col(time)
    share = (t - p["_t"]) / F.nullif(n["_t"] - p["_t"], F.lit(0))

    def between(name: str) -> Column:
        step = n[name] - p[name]
        if name == "yaw":
            step = step - F.when(step > math.pi, 2 * math.pi).when(step < -math.pi, -2 * math.pi).otherwise(0.0)
        return F.when(p.isNull(), n[name]).when(n.isNull() | share.isNull(), p[name]).otherwise(p[name] + share * step)

    return both.select(*left.columns, *(between(c).alias(f"{prefix}{c}") for c in STATE))


def _back(v: g.Vec, prefix: str) -> g.Vec:
    """A vector in the axes of the sensor as it stood in the state ``prefix``."""
    return g.rotate_yxz(v, -F.col(f"{prefix}yaw"), -F.col(f"{prefix}pitch"), -F.col(f"{prefix}roll"))


def _three(prefix: str, kind: str) -> list[Column]:
    return [F.col(f"{prefix}{kind}{c}") for c in "xyz"]


def sweep_states(sweeps: DataFrame, states: DataFrame, time: str, by: list[str], begin: str = "begin", end: str = "end") -> DataFrame:
    """One row a sweep: the states at its begin (``s_…``) and end (``e_…``), and in the axes of its begin ``shift_x…`` (how far it came beyond its first velocity) and ``velo_x…`` (how its velocity changed)."""
    rows = states_at(sweeps.withColumn(time, F.col(begin)), states, time, by, "s_")
    rows = states_at(rows.withColumn(time, F.col(end)), states, time, by, "e_").drop(time)
    took = (F.col(end) - F.col(begin)) / 1e6
    shift = _back(tuple(e - s - v * took for e, s, v in zip(_three("e_", "p"), _three("s_", "p"), _three("s_", "v"), strict=True)), "s_")  # type: ignore[arg-type]
    velocity = _back(tuple(e - s for e, s in zip(_three("e_", "v"), _three("s_", "v"), strict=True)), "s_")  # type: ignore[arg-type]
    return rows.select("*", *(c.alias(f"{n}_{a}") for n, v in (("shift", shift), ("velo", velocity)) for a, c in zip("xyz", v, strict=True)))


def to_sweep_start(points: DataFrame, sweeps: DataFrame, states: DataFrame, time: str, by: list[str], sweep: list[str], begin: str = "begin") -> DataFrame:
    """Points ``x, y, z`` moved to where the sensor stood at their sweep's begin; ``sweeps`` as from :func:`sweep_states`, keyed by ``by`` and ``sweep``. Points of keys without a state stay."""
    at = states_at(points, states, time, by, "_c_")
    start = sweeps.select(*by, *sweep, F.col(begin).alias("_begin"), *(F.col(f"s_{c}").alias(f"_s_{c}") for c in STATE))
    rows = at.join(start, [*by, *sweep])
    took = (F.col(time) - F.col("_begin")) / 1e6
    turned = g.rotate_zxy(g.vec(), F.col("_c_roll"), F.col("_c_pitch"), F.col("_c_yaw"))
    # stage by stage, so that no expression multiplies out
    rows = rows.select("*", *((t + c - s - v * took).alias(f"_m_{n}") for n, t, c, s, v in zip("xyz", turned, _three("_c_", "p"), _three("_s_", "p"), _three("_s_", "v"), strict=True)))
    moved = _back(g.vec("_m_"), "_s_")
    new = {n: F.coalesce(c, F.col(n)) for n, c in zip("xyz", moved, strict=True)}
    return rows.select(*(new[c].alias(c) if c in new else F.col(c) for c in points.columns))
