"""Greedy feature selection per ring: each pick suppresses its neighbours, so rows are taken in order within a ring."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from ..session import RegistrationParams


def pick(xyz: np.ndarray, picked: np.ndarray, p: RegistrationParams) -> np.ndarray:
    """Labels of one ring: 2 sharp, 1 less sharp, 0 less flat, -1 flat; margins keep 0."""
    n, reach = len(xyz), p.curvature_region
    label = np.zeros(n, np.int8)
    if n <= 2 * reach + 1:
        return label
    taken = picked.astype(bool).copy()
    c = np.cumsum(np.vstack([np.zeros(3), xyz]), axis=0)
    curve = np.full(n, np.nan)
    diff = c[2 * reach + 1 :] - c[: n - 2 * reach] - (2 * reach + 1) * xyz[reach : n - reach]
    curve[reach : n - reach] = (diff**2).sum(axis=1)
    gap = (np.diff(xyz, axis=0) ** 2).sum(axis=1)

    def mark(i: int) -> None:
        taken[i] = True
        for k in range(reach):
            if gap[i + k] > 0.05:
                break
            taken[i + k + 1] = True
        for k in range(reach):
            if gap[i - k - 1] > 0.05:
                break
            taken[i - k - 1] = True

    inner = n - 1 - 2 * reach
    for j in range(p.feature_regions):
        begin, end = reach + inner * j // p.feature_regions, reach + inner * (j + 1) // p.feature_regions
        order = begin + np.argsort(curve[begin:end], kind="stable")
        if len(order) < 2:
            continue
        sharp = 0
        for i in order[::-1]:
            if sharp >= p.max_corner_less_sharp:
                break
            if not taken[i] and curve[i] > p.surface_curvature_threshold:
                sharp += 1
                label[i] = 2 if sharp <= p.max_corner_sharp else 1
                mark(i)
        flat = 0
        for i in order:
            if flat >= p.max_surface_flat:
                break
            if not taken[i] and curve[i] < p.surface_curvature_threshold:
                flat += 1
                label[i] = -1
                mark(i)
    return label


def greedy_features(rings: DataFrame, by: list[str], order: str, params: RegistrationParams | None = None) -> DataFrame:
    """``label`` for rows with ``x, y, z, picked``; a ring (one turn of one beam) is a group of bounded size."""
    p = params or RegistrationParams()
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rings.schema.fields) + ", label int"

    def run(ring: pd.DataFrame) -> pd.DataFrame:
        ring = ring.sort_values(order)
        return ring.assign(label=pick(ring[["x", "y", "z"]].to_numpy(float), ring["picked"].to_numpy(), p).astype("int32"))

    return rings.groupBy(*by).applyInPandas(run, schema)
