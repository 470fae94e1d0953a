"""Point, event and raster views over the driver's tables, as DataFrames and as SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``pt, frame, ring, x, y, z``: 21 points from each 64-dimensional vector."""
    e = table(spark, sf_dir, "embeddings").select("vec_id", "label", "embedding", F.explode(F.sequence(F.lit(0), F.lit(20))).alias("i"))
    at = lambda k: (F.lit(20.0) * F.get("embedding", F.col("i") * 3 + k).cast("double")).alias("xyz"[k])
    return e.select((F.col("vec_id") * 21 + F.col("i")).alias("pt"), F.col("label").cast("int").alias("frame"), F.col("i").alias("ring"), at(0), at(1), at(2))


def turns(points: DataFrame) -> DataFrame:
    """Points with the turn they belong to: one frame's points among 4,200 neighbours, so some hundreds and never more than those."""
    return points.withColumn("turn", F.floor(F.col("pt") / 4200) * 1000 + F.col("frame"))


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``event_id, ring, event_type, value, us``"""
    us = F.unix_micros(F.col("ts").cast("timestamp")).alias("us")
    return table(spark, sf_dir, "events").select("event_id", F.col("user_id").alias("ring"), "event_type", "value", us)


def poses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One pose a frame: ``frame, rx, ry, rz, tx, ty, tz``."""
    f = table(spark, sf_dir, "embeddings").select(F.col("label").cast("int").alias("frame")).distinct()
    d = F.col("frame").cast("double")
    return f.select("frame", (d / 100).alias("rx"), (d / 50).alias("ry"), (d / 25).alias("rz"), (d / 2).alias("tx"), (d / 4).alias("ty"), (d / 8).alias("tz"))


def boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Axis-aligned boxes ``box, frame, conf, cx, cy, cz, hx, hy, hz``, one a supplier."""
    k = F.col("s_suppkey")
    return table(spark, sf_dir, "supplier").select(
        k.alias("box"), F.pmod(k, F.lit(10)).cast("int").alias("frame"), (F.pmod(k * 7, F.lit(100)) / 100.0).alias("conf"),
        ((F.col("s_acctbal") - 4500) / 1500).alias("cx"), (F.pmod(k * 37, F.lit(800)) / 100.0 - 4).alias("cy"), (F.pmod(k * 53, F.lit(800)) / 100.0 - 4).alias("cz"),
        F.lit(1.0).alias("hx"), F.lit(2.0).alias("hy"), F.lit(1.5).alias("hz"),
    )


def mask(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cells ``u, v`` that points of frame 0 cover."""
    return points(spark, sf_dir).where("frame = 0").select(F.floor("x").alias("u"), F.floor("y").alias("v")).distinct()


def pixels(spark: SparkSession, sf_dir: str, width: int = 48, height: int = 64) -> DataFrame:
    """A depth sample ``u, v, z`` a line item, with its key columns."""
    return table(spark, sf_dir, "lineitem").select(
        F.pmod("l_suppkey", F.lit(width)).alias("u"), F.pmod("l_partkey", F.lit(height)).alias("v"), F.col("l_extendedprice").alias("z"), F.col("l_quantity").alias("q"),
        F.struct("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_tax").alias("key"),
    )


SQL = {
    "points": "SELECT vec_id * 21 + i AS pt, CAST(label AS INT) AS frame, CAST(i AS INT) AS ring, 20e0 * CAST(embedding[3*i+1] AS DOUBLE) AS x, 20e0 * CAST(embedding[3*i+2] AS DOUBLE) AS y, 20e0 * CAST(embedding[3*i+3] AS DOUBLE) AS z FROM embeddings, range(21) t(i)",
    "ev": "SELECT event_id, user_id AS ring, event_type, value, epoch_us(ts) AS us FROM events",
    "poses": "SELECT frame, frame / 100e0 AS rx, frame / 50e0 AS ry, frame / 25e0 AS rz, frame / 2e0 AS tx, frame / 4e0 AS ty, frame / 8e0 AS tz FROM (SELECT DISTINCT CAST(label AS INT) AS frame FROM embeddings)",
    "boxes": "SELECT s_suppkey AS box, CAST(s_suppkey % 10 AS INT) AS frame, (s_suppkey * 7 % 100) / 100e0 AS conf, (s_acctbal - 4500) / 1500 AS cx, (s_suppkey * 37 % 800) / 100e0 - 4 AS cy, (s_suppkey * 53 % 800) / 100e0 - 4 AS cz, 1e0 AS hx, 2e0 AS hy, 15e-1 AS hz FROM supplier",
    "mask": "SELECT DISTINCT CAST(floor(x) AS BIGINT) AS u, CAST(floor(y) AS BIGINT) AS v FROM points WHERE frame = 0",
    "pixels": "SELECT l_suppkey % 48 AS u, l_partkey % 64 AS v, l_extendedprice AS z, l_quantity AS q, l_orderkey, l_partkey, l_suppkey, l_linenumber, l_tax FROM lineitem",
}


def with_views(names: str, sql: str) -> str:
    """SQL over the named views, as common table expressions."""
    return "WITH RECURSIVE " + ", ".join(f"{n} AS ({SQL[n]})" for n in names.split()) + (", " if sql.lstrip().upper().startswith("WITH ") else " ") + (sql.lstrip()[5:] if sql.lstrip().upper().startswith("WITH ") else sql)
