"""Structured Streaming versions of the stream operators.

Event time is a TIMESTAMP column ``ts``. What comes later than the watermark is dropped by it, and no
queue drops silently.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def align(left: DataFrame, right: DataFrame, key: str, bound_ms: int = 5, delay: str = "1 second") -> DataFrame:
    """Pairs of two streams less than ``bound_ms`` apart (strict): an interval join with watermarks on both sides."""
    l = left.withWatermark("ts", delay).alias("l")  # noqa: E741
    r = right.withWatermark("ts", delay).alias("r")
    span = F.expr(f"INTERVAL {bound_ms} MILLISECONDS")
    on = (F.col(f"l.{key}") == F.col(f"r.{key}")) & (F.col("r.ts") > F.col("l.ts") - span) & (F.col("r.ts") < F.col("l.ts") + span)
    others = [c for c in right.columns if c not in (key, "ts")]
    return l.join(r, on).select("l.*", F.col("r.ts").alias("r_ts"), *(F.col(f"r.{c}").alias(f"r_{c}") for c in others))


def sweeps(stream: DataFrame, key: str, period: str = "100 milliseconds", delay: str = "1 second") -> DataFrame:
    """Counts and means per sweep period."""
    return stream.withWatermark("ts", delay).groupBy(key, F.window("ts", period)).agg(F.count("*").alias("n"), F.avg("value").alias("mean")).select(key, F.col("window.start").alias("start"), "n", "mean")


def _in_order(frames: Iterator[pd.DataFrame]) -> pd.DataFrame:
    return pd.concat(list(frames)).sort_values(["ts", "seq"])


def latest_value(stream: DataFrame, key: str) -> DataFrame:
    """Odometry rows with the newest correction so far: rows ``key, ts, seq, kind ('odometry' or 'mapping'), value``."""

    def run(k: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last, out = state.get[0] if state.exists else None, []
        for row in _in_order(frames).itertuples():
            if row.kind == "mapping":
                last = row.value
            else:
                out.append((*k, row.ts, row.seq, row.value, last))
        state.update((last,))
        yield pd.DataFrame(out, columns=[key, "ts", "seq", "value", "correction"])

    kind = stream.schema[key].dataType.simpleString()
    return stream.groupBy(key).applyInPandasWithState(run, f"{key} {kind}, ts timestamp, seq long, value double, correction double", "last double", "append", GroupStateTimeout.NoTimeout)


def integrate(stream: DataFrame, key: str) -> DataFrame:
    """Velocity and shift from accelerations ``value`` per key, carried on in state."""

    def run(k: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        at, v, s = state.get if state.exists else (None, 0.0, 0.0)
        out = []
        for row in _in_order(frames).itertuples():
            now = row.ts.value / 1e9
            dt = 0.0 if at is None else now - at
            s += v * dt + 0.5 * row.value * dt * dt
            v += row.value * dt
            at = now
            out.append((*k, row.ts, row.seq, v, s))
        state.update((at, v, s))
        yield pd.DataFrame(out, columns=[key, "ts", "seq", "velocity", "shift"])

    kind = stream.schema[key].dataType.simpleString()
    return stream.groupBy(key).applyInPandasWithState(run, f"{key} {kind}, ts timestamp, seq long, velocity double, shift double", "at double, velocity double, shift double", "append", GroupStateTimeout.NoTimeout)


def after_startup(stream: DataFrame, key: str, skip: int = 20, ratio: int = 1) -> DataFrame:
    """Leaves out each key's first ``skip`` messages and then keeps every ``ratio``-th."""
    columns = stream.columns

    def run(k: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        seen = state.get[0] if state.exists else 0
        rows = _in_order(frames)
        place = range(seen, seen + len(rows))
        state.update((seen + len(rows),))
        yield rows[[n >= skip and (n - skip) % ratio == 0 for n in place]][columns]

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in stream.schema.fields)
    return stream.groupBy(key).applyInPandasWithState(run, schema, "seen long", "append", GroupStateTimeout.NoTimeout)


def odometry(stream: DataFrame, key: str, drift_scale: float = 1.05) -> DataFrame:
    """Accumulated pose per vehicle from relative poses, one state a vehicle."""
    import numpy as np

    from ..functions import geometry as g

    names = ["rx", "ry", "rz", "tx", "ty", "tz"]

    def run(k: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        pose = g.pose_matrix(*state.get) if state.exists else np.eye(4)
        out = []
        for row in _in_order(frames)[["ts", "seq", *names]].itertuples(index=False):
            pose = g.accumulate(pose, np.array(row[2:], float), drift_scale)
            out.append((*k, row[0], row[1], *g.matrix_pose(pose)))
        state.update(tuple(g.matrix_pose(pose)))
        yield pd.DataFrame(out, columns=[key, "ts", "seq", *names])

    kind = stream.schema[key].dataType.simpleString()
    numbers = ", ".join(f"{n} double" for n in names)
    return stream.groupBy(key).applyInPandasWithState(run, f"{key} {kind}, ts timestamp, seq long, {numbers}", numbers, "append", GroupStateTimeout.NoTimeout)


def map_cubes(batch: DataFrame, batch_id: int, path: str, leaf: float = 0.4) -> None:
    """For ``foreachBatch``: a batch's points go to their cube's part of the map table, voxel by voxel; a repeated batch replaces its own files."""
    from ..functions.scalars import cube
    from ..operators.aggs import voxel_grid

    rows = voxel_grid(batch, leaf).select("x", "y", "z", "n", *(cube(F.col(c)).alias(f"cube_{c}") for c in "xyz"))
    rows.write.mode("overwrite").partitionBy("cube_x", "cube_y", "cube_z").parquet(f"{path}/batch={batch_id}")
