"""Embedding whitening by block Lanczos.

The covariance is never built: a pass over the different vectors multiplies a block of columns by it, centred row by
row, and partial products of fixed size (dimensions x block) are summed. Every new block is orthogonalised against all earlier
ones, twice. Where a block loses rank (an invariant subspace is found), random directions take the lost columns' place;
where the basis is full, the leading Ritz vectors stay and the search goes on from the last residual. It ends when the residuals of the wanted pairs
are small beside the largest eigenvalue, or the basis spans the space.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_schema, materialize
from .vectors import matrix, whole_vectors

LONG = (1 << 63) - 1


def orthonormal(block: np.ndarray, basis: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """``block``'s columns made orthonormal to ``basis`` and each other; those that add nothing become random directions while there is room."""
    out = basis
    for k in range(min(block.shape[1], basis.shape[0] - basis.shape[1])):
        v, fresh = block[:, k], False
        while True:
            size = np.linalg.norm(v)
            for _ in range(2):
                v = v - out @ (out.T @ v)
            left = np.linalg.norm(v)
            if left > 1e-10 * size and left > 0:
                break
            if fresh and left == 0:
                raise ArithmeticError("no direction is left")
            v, fresh = rng.standard_normal(basis.shape[0]), True
        v = v / left
        v = v - out @ (out.T @ v)
        out = np.column_stack([out, v / np.linalg.norm(v)])
    return out[:, basis.shape[1] :]


def block_lanczos(multiply: Callable[[np.ndarray], np.ndarray], d: int, k: int, block: int = 8, tolerance: float = 1e-13, most: int = 256, passes: int = 1000, seed: int = 7) -> tuple[np.ndarray, np.ndarray, int]:
    """The ``k`` largest eigenvalues (falling), their vectors as columns, and the passes used; ``multiply`` applies the symmetric matrix to columns."""
    rng = np.random.default_rng(seed)
    k, most = min(k, d), max(most, 2 * (k + block))
    basis = image = np.zeros((d, 0))
    new, best = rng.standard_normal((d, min(block, d))), np.inf
    stalled = confirmed = 0
    for used in range(1, passes + 1):
        new = orthonormal(new, basis, rng)
        turned = multiply(new)
        basis, image = np.column_stack([basis, new]), np.column_stack([image, turned])
        small = basis.T @ image
        values, turn = np.linalg.eigh((small + small.T) / 2)
        values, turn = values[::-1], turn[:, ::-1]
        rest = turned - basis @ (basis.T @ turned)
        scale = max(abs(values[0]), 1e-300)
        if basis.shape[1] >= k:
            residual = np.linalg.norm(image @ turn[:, :k] - basis @ turn[:, :k] * values[:k], axis=0).max()
            # rounding in the products may keep the residual above the tolerance
            stalled = stalled + 1 if residual > best / 2 else 0
            best = min(best, residual)
            converged = residual <= tolerance * scale or stalled >= 5 and best <= 1e-9 * scale
            # a closed subspace may lack copies of an eigenvalue: random directions have to leave the pairs as they are
            confirmed = confirmed + 1 if converged else 0
            if basis.shape[1] == d or converged and (confirmed >= 3 or np.abs(rest).max() > 1e-10 * scale):
                return values[:k], np.linalg.qr(basis @ turn[:, :k])[0], used
        new = rest
        if basis.shape[1] + block > most:
            keep = turn[:, : k + block]
            basis, image = basis @ keep, image @ keep
    raise ArithmeticError(f"no convergence in {passes} passes, residual {best:g}")


@dataclass(frozen=True)
class Whitening:
    """``n`` different vectors, their ``sums`` by dimension, eigenvalues (falling), vectors as columns, trace; ``error``: of the whitened covariance."""

    n: int
    sums: list[int]
    values: np.ndarray
    vectors: np.ndarray
    trace: float
    error: float | None
    passes: int

    def projected(self, x: np.ndarray) -> np.ndarray:
        """Whitened coordinates; those of components without variance are NaN."""
        with np.errstate(divide="ignore", invalid="ignore"):
            return (x - np.array([s / self.n for s in self.sums])) @ self.vectors / np.where(self.values > 0, np.sqrt(np.abs(self.values)), np.nan)


def deviations(x: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    """Sum over dimensions of ``(n * x - S)^2``, exact: longs where all fit, else Python's integers."""
    bound = n * int(np.abs(x.astype(float)).max(initial=0)) + max(map(abs, sums), default=0) + n
    e = n * x - np.array(sums, np.int64) if x.shape[1] * bound * bound <= LONG else n * x.astype(object) - np.array(sums, object)
    return (e * e).sum(axis=1)


def total(values: np.ndarray) -> int:
    """The exact sum of non-negative numbers."""
    return int(values.sum()) if values.dtype == object else (int((values >> 32).sum()) << 32) + int((values & 0xFFFFFFFF).sum())


def _summed(fitted: DataFrame, d: int, shape: tuple[int, int], work: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
    """The sum over all rows of ``work(batch of vectors)``, of ``shape``: one array a task, added up by place."""
    kind = arrow_schema(fitted.sparkSession, "part array<double>")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = np.zeros(shape)
        for batch in batches:
            part += work(matrix(batch.column(0), d))
        yield pa.RecordBatch.from_arrays([pa.array([part.ravel()], kind.field(0).type)], schema=kind)

    rows = fitted.select("x").mapInArrow(run, "part array<double>").select(F.posexplode("part").alias("at", "v")).groupBy("at").agg(F.sum("v").alias("v")).collect()
    out = np.zeros(shape[0] * shape[1])
    for r in rows:
        out[r["at"]] = r["v"]
    return out.reshape(shape)


def _exact_sums(fitted: DataFrame, d: int, work: Callable[[np.ndarray], list[int]]) -> list[int]:
    """Sums of whole numbers by place, exact: a few rows a task and place, 18 digits each, so that no size of number overflows."""
    schema, limb = "at int, power int, v decimal(38,0)", 10**18
    kind = arrow_schema(fitted.sparkSession, schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from decimal import Decimal

        found: list[int] = []
        for batch in batches:
            part = work(matrix(batch.column(0), d))
            found = [a + b for a, b in zip(found or [0] * len(part), part, strict=True)]
        rows = []
        for at, v in enumerate(found):
            power = 0
            while not rows or rows[-1][0] != at or v:
                rows.append((at, power, Decimal((v > 0) - (v < 0)) * (abs(v) % limb)))
                v, power = ((v > 0) - (v < 0)) * (abs(v) // limb), power + 1
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True) if rows else [[]] * 3, kind, strict=True)], schema=kind)

    out: dict[int, int] = {}
    for r in fitted.select("x").mapInArrow(run, schema).groupBy("at", "power").agg(F.sum("v").alias("v")).collect():
        out[r["at"]] = out.get(r["at"], 0) + int(r.v) * limb**r.power
    return [out[at] for at in range(len(out))]


def column_sums(x: np.ndarray) -> list[int]:
    if len(x) * float(np.abs(x.astype(float)).max(initial=0)) < 2.0**62:
        return x.sum(axis=0).tolist()
    return [int(v) for v in x.astype(object).sum(axis=0)]


def fit(whole: DataFrame, k: int = 4, block: int = 8, tolerance: float = 1e-13, most: int = 256) -> Whitening | None:
    """Fits on each different ``x`` once; None without rows."""
    fitted = materialize(whole.select("x").distinct(), "fit")
    n = fitted.count()
    if not n:
        return None
    d = len(fitted.first().x)
    sums = _exact_sums(fitted, d, column_sums)
    mean = np.array([s / n for s in sums])
    trace = _exact_sums(fitted, d, lambda x: [total(deviations(x, n, sums))])[0] / n**3
    k = min(k, d)

    def multiply(v: np.ndarray) -> np.ndarray:
        def part(x: np.ndarray) -> np.ndarray:
            c = x - mean
            return c.T @ (c @ v)

        return _summed(fitted, d, v.shape, part) / n

    values, vectors, passes = block_lanczos(multiply, d, k, block, tolerance, most) if trace > 0 else (np.zeros(k), np.eye(d)[:, :k], 0)
    values = np.where(values > 1e-14 * trace, values, 0.0)
    model = Whitening(n, sums, values, vectors, trace, None, passes)
    live = int((values > 0).sum())
    if not live:
        return model
    centre = _summed(fitted, d, (1, live), lambda x: model.projected(x)[:, :live].sum(axis=0, keepdims=True)) / n

    def square(x: np.ndarray) -> np.ndarray:
        y = model.projected(x)[:, :live] - centre
        return y.T @ y

    error = float(np.abs(_summed(fitted, d, (live, live), square) / n - np.eye(live)).max())
    return Whitening(n, sums, values, vectors, trace, error, passes)


def whiten(rows: DataFrame, k: int = 4, block: int = 8, tolerance: float = 1e-13, most: int = 256, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """``vec_id, component, n, deviation, whitened, explained, identity_error`` per row and component (1 to ``k`` or the dimensions).

    Rows without a whole vector are left out (see :func:`whole_vectors`); repeated rows and null ids are projected like others, and
    count once in the fit. A component without variance has a null ``whitened`` and 0 explained (null where nothing varies); without any,
    ``identity_error`` is null. A deviation beyond a long is null. Driver memory follows the dimensions (at most ``most`` columns), not the rows.
    """
    schema = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"
    whole = materialize(whole_vectors(rows, vector_col, [F.col(f"`{id_col}`").cast("long").alias("vec_id")]), "whole")
    model = fit(whole, k, block, tolerance, most)
    session = rows.sparkSession
    if model is None:
        return session.createDataFrame([], schema)
    kind, d, k = arrow_schema(session, schema), len(model.sums), len(model.values)
    shares = [float(v / model.trace) if model.trace > 0 else None for v in model.values]

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = matrix(batch.column(1), d)
            m, y = len(x), model.projected(x).ravel()
            told = [v if v <= LONG else None for v in deviations(x, model.n, model.sums).tolist()]
            columns = [
                batch.column(0).take(pa.array(np.repeat(np.arange(m), k))), np.tile(np.arange(1, k + 1), m), [model.n] * (m * k), [v for v in told for _ in range(k)],
                pa.array(y, mask=np.isnan(y)), shares * m, [model.error] * (m * k),
            ]
            yield pa.RecordBatch.from_arrays([c.cast(f.type) if isinstance(c, pa.Array) else pa.array(c, f.type) for c, f in zip(columns, kind, strict=True)], schema=kind)

    return whole.mapInArrow(project, schema)
