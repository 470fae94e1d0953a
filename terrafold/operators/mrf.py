"""Min-sum belief propagation on a grid of labelled pixels, one mask a group."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

#: Neighbour directions: name, dv, du, the opposite.
SIDES = (("up", -1, 0, 1), ("down", 1, 0, 0), ("left", 0, -1, 3), ("right", 0, 1, 2))


def propagate(unary: np.ndarray, colours: np.ndarray, sides: np.ndarray, weight: float = 2.0, iterations: int = 50, damping: float = 0.0, readout: str = "outgoing", known: np.ndarray | None = None) -> np.ndarray:
    """Labels of an h x w grid.

    ``unary``: h x w x L costs; ``colours``: h x w x L x 3 candidate colours; ``sides``: h x w x 4 x L x 3,
    what each candidate's neighbour looks like on each side. Inner pixels send in a checkerboard
    order, all of one colour at once, for they hear only from the other; pixels that aren't ``known`` send nothing. ``readout`` sums the
    messages a pixel sent (parity) or those sent to it.
    """
    h, w, n = unary.shape
    sent = np.zeros((4, h, w, n))
    inner = np.zeros((h, w), bool)
    inner[1:-1, 1:-1] = True if known is None else known[1:-1, 1:-1]
    v, u = np.nonzero(inner)
    #: what each candidate of a pixel costs beside each of its neighbour's, a side
    pairs = [
        weight * (np.abs(colours[v, u][:, :, None] - sides[v + dv, u + du][:, back][:, None]).sum(axis=3) + np.abs(sides[v, u][:, k][:, :, None] - colours[v + dv, u + du][:, None]).sum(axis=3))
        for k, (_, dv, du, back) in enumerate(SIDES)
    ]
    turns = [np.flatnonzero((u - v - t) % 2 == 1) for t in (0, 1)]
    for t in range(iterations):
        some = turns[t % 2]
        y, x = v[some], u[some]
        incoming = np.stack([sent[back, y + dv, x + du] for _, dv, du, back in SIDES])
        base = unary[y, x] + incoming.sum(axis=0) - incoming
        for k in range(4):
            m = (base[k][:, :, None] + pairs[k][some]).min(axis=1)
            sent[k, y, x] = damping * sent[k, y, x] + (1 - damping) * (m - m.mean(axis=1, keepdims=True))
    belief = unary.copy()
    if readout == "outgoing":
        belief += sent.sum(axis=0)
    else:
        belief[1:] += sent[1, :-1]
        belief[:-1] += sent[0, 1:]
        belief[:, 1:] += sent[3, :, :-1]
        belief[:, :-1] += sent[2, :, 1:]
    return belief.argmin(axis=2)


def label_masks(cells: DataFrame, by: list[str], weight: float = 2.0, iterations: int = 50, damping: float = 0.0, readout: str = "outgoing") -> DataFrame:
    """Rows ``by…, v, u, cost array<double>, colour array<array<double>>, side array<array<array<double>>>`` of one mask a group, of any shape; returns ``by…, v, u, label``."""
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in cells.schema.fields if f.name in [*by, "v", "u"]) + ", label int"

    def run(d: pd.DataFrame) -> pd.DataFrame:
        d = d.sort_values(["v", "u"])
        v, u = ((d[c] - d[c].min()).to_numpy(int) for c in "vu")
        known = np.zeros((v.max() + 1, u.max() + 1), bool)
        known[v, u] = True

        def grid(column: str) -> np.ndarray:
            x = np.array([_deep(x) for x in d[column]], float)
            out = np.zeros((*known.shape, *x.shape[1:]))
            out[v, u] = x
            return out

        labels = propagate(grid("cost"), grid("colour"), grid("side"), weight, iterations, damping, readout, known)
        return d[[*by, "v", "u"]].assign(label=labels[v, u].astype("int32"))

    return cells.groupBy(*by).applyInPandas(run, schema)


def _deep(x):
    return [_deep(y) for y in x] if hasattr(x, "__len__") else x
