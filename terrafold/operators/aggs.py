"""Aggregations over points and rasters."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def voxel_grid(points: DataFrame, leaf: float, by: list[str] | None = None, fields: str | list[str] = "xyz", dims: str = "xyz") -> DataFrame:
    """Centroid of all fields per cell of edge ``leaf``; partial sums are combined before the shuffle."""
    cells = [F.floor(F.col(d) / leaf).alias(f"c{d}") for d in dims]
    return points.groupBy(*(by or []), *cells).agg(F.count("*").alias("n"), *(F.avg(f).alias(f) for f in fields))


def zbuffer(samples: DataFrame, pixel: list[str], depth: str, key: str, limit: float = 1e6) -> DataFrame:
    """Nearest sample per pixel, ties to the smallest key: one ``min`` of a struct, combined before the shuffle."""
    return samples.where(F.col(depth) < limit).groupBy(*pixel).agg(F.min(F.struct(F.col(depth).alias("d"), F.col(key).alias("k"))).alias("m")).select(*pixel, F.col("m.d").alias(depth), F.col("m.k").alias(key))


def painter(samples: DataFrame, pixel: list[str], depth: str, key: str) -> DataFrame:
    """Farthest drawn first, so that the nearest stays; equal depths: the largest key stays."""
    return samples.groupBy(*pixel).agg(F.max(F.struct((-F.col(depth)).alias("d"), F.col(key).alias("k"))).alias("m")).select(*pixel, (-F.col("m.d")).alias(depth), F.col("m.k").alias(key))


def inverse_distance(pairs: DataFrame, by: list[str], value: str, distance: str) -> DataFrame:
    """``sum(v / d) / sum(1 / d)``; a neighbour at distance 0 decides alone."""
    hit = F.avg(F.when(F.col(distance) == 0, F.col(value)))
    w = F.when(F.col(distance) > 0, 1 / F.col(distance))
    return pairs.groupBy(*by).agg(F.coalesce(hit, F.sum(F.col(value) * w) / F.sum(w)).alias(value))


def positive_mean(df: DataFrame, by: list[str], cost: str) -> DataFrame:
    """Mean of the positive costs; none: null, which is never the smallest."""
    return df.groupBy(*by).agg(F.avg(F.when(F.col(cost) > 0, F.col(cost))).alias("mean_cost"))


def normal_equations(rows: DataFrame, a: list[str], b: str, by: list[str] | None = None, counted: str = "*") -> DataFrame:
    """Upper triangle of A'A and A'b in one aggregation; ``n`` counts the rows where ``counted`` isn't null."""
    sums = [F.sum(F.col(x) * F.col(y)).alias(f"a{i}{j}") for i, x in enumerate(a) for j, y in enumerate(a) if i <= j]
    return rows.groupBy(*(by or [])).agg(*sums, *(F.sum(F.col(x) * F.col(b)).alias(f"b{i}") for i, x in enumerate(a)), F.count(counted).alias("n"))


def covariance(rows: DataFrame, by: list[str], dims: list[str]) -> DataFrame:
    """Centroid and population covariance per group."""
    return rows.groupBy(*by).agg(*(F.avg(d).alias(f"m{i}") for i, d in enumerate(dims)), *(F.covar_pop(x, y).alias(f"c{i}{j}") for i, x in enumerate(dims) for j, y in enumerate(dims) if i <= j))


def vote(patches: DataFrame, pixel: list[str], values: list[str]) -> DataFrame:
    """Mean of all votes per pixel, cut to an integer."""
    return patches.groupBy(*pixel).agg(F.count("*").alias("votes"), *(F.floor(F.sum(v) / F.count("*")).alias(v) for v in values))


def last_wins(df: DataFrame, key: list[str], seq: str, values: list[str]) -> DataFrame:
    """One row per key: the one read last."""
    return df.groupBy(*key).agg(F.max(F.struct(seq, *values)).alias("m")).select(*key, F.col(f"m.{seq}").alias(seq), *(F.col(f"m.{v}").alias(v) for v in values))


def bounds(df: DataFrame, by: list[str], dims: list[str]) -> DataFrame:
    return df.groupBy(*by).agg(*(f(d).alias(f"{n}_{d}") for d in dims for n, f in (("min", F.min), ("max", F.max))))


def centred(df: DataFrame, by: list[str], value: str) -> DataFrame:
    """Minus the mean of its group: means are combined before the shuffle and joined back, so no group lands in one task."""
    means = df.groupBy(*by).agg(F.avg(value).alias("_mean"))
    return df.join(means, by).select(*df.columns, (F.col(value) - F.col("_mean")).alias(f"{value}_centred"))


def pyramid(df: DataFrame, value: str, u: str = "u", v: str = "v") -> DataFrame:
    """Sums of 2 x 2 blocks."""
    return df.groupBy(F.floor(F.col(u) / 2).alias("u"), F.floor(F.col(v) / 2).alias("v")).agg(F.sum(value).alias(value))


def arg_min(df: DataFrame, by: list[str], score: str, key: str) -> DataFrame:
    """Smallest score, ties to the smallest key."""
    return df.groupBy(*by).agg(F.min(F.struct(score, key)).alias("m")).select(*by, F.col(f"m.{score}").alias(score), F.col(f"m.{key}").alias(key))
