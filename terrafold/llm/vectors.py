"""Vectors as whole numbers, for the operators on embeddings."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def whole_vectors(rows: DataFrame, vector_col: str, keep: list, scale: int = 256) -> DataFrame:
    """``keep`` and ``x array<long>``: each entry times ``scale`` (as double), rounded down.

    Rows whose vector is null, empty or holds null or non-finite entries are left out, and so are those whose vector
    isn't as long as most are (of two lengths as frequent: the shorter). Numbers beyond a long stay at its ends.
    """
    v = F.col(f"`{vector_col}`").cast("array<double>")
    bad = F.exists(v, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    whole = rows.where(v.isNotNull() & (F.size(v) > 0) & ~bad)
    most = whole.groupBy(F.size(v).alias("d")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "d").first()
    return whole.where(F.size(v) == (most.d if most else 0)).select(*keep, F.transform(v, lambda c: F.floor(c * scale).cast("long")).alias("x"))


def matrix(column: pa.Array, d: int) -> np.ndarray:
    """The batch's vectors as rows, without a Python object per entry."""
    return np.asarray(column.flatten()).reshape(-1, d)
