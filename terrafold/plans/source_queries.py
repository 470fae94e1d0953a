"""Round trips through file formats: the views are written with the sinks and read back with the sources."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from .. import views as V
from ..functions import geometry as g
from ..sources import bags, files, sinks
from ..storage import shared_dir
from .registry import Registry

query = Registry()
QUERIES, ORACLES = query.queries, query.oracles


def _folder(spark, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def _sweeps(spark, sf_dir):
    """A sweep is a frame's points among 4,200 neighbours; a bag holds ten sweeps' worth of frames."""
    p = V.turns(V.points(spark, sf_dir))
    return p.select("turn", F.floor(F.col("turn") / 1000).alias("block"), "pt", *(F.col(c).cast("float").alias(c) for c in "xyz"), F.col("ring").cast("float").alias("intensity"), ((F.col("turn") + 1) * 1_000_000_000 + 7).alias("ts_ns"))


_CLOUDS = "SELECT CAST((pt // 4200) * 1000 + frame AS VARCHAR) AS sweep, row_number() OVER (PARTITION BY pt // 4200, frame ORDER BY pt) - 1 AS idx, CAST(x AS FLOAT) AS x, CAST(y AS FLOAT) AS y, CAST(z AS FLOAT) AS z, CAST(ring AS FLOAT) AS intensity FROM points"


@query("points", f"SELECT sweep, (CAST(sweep AS BIGINT) + 1) * 1000000000 + 7 AS ts_ns, idx, x, y, z, intensity FROM ({_CLOUDS})")
def bag_round_trip(spark, sf_dir):
    """Sweeps as point-cloud messages in bags beside another topic, read back by chunk with a topic filter and taken apart."""
    clouds = bags.cloud_messages(_sweeps(spark, sf_dir), ["block", "turn"])
    notes = clouds.select("block", "turn", F.lit("/notes").alias("topic"), F.lit("std_msgs/String").alias("type"), "ts_ns", F.col("turn").cast("string").cast("binary").alias("payload"))
    folder = _folder(spark, "bags")
    files.write_files(bags.encode_bags(clouds.unionByName(notes), "block", "bz2"), folder)
    return files.explode_clouds(bags.read_bag(spark, folder, ["/points"])).withColumnRenamed("frame_id", "sweep")


def _clouds(spark, sf_dir, kind, read):
    folder = _folder(spark, kind)
    files.write_files(files.encode_clouds(_sweeps(spark, sf_dir), "turn", "pt", kind), folder)
    return read(spark, folder).select(F.regexp_extract("path", r"(\d+)\.\w+$", 1).alias("sweep"), "idx", "x", "y", "z", "intensity")


@query("points", _CLOUDS)
def ply_round_trip(spark, sf_dir):
    return _clouds(spark, sf_dir, "ply", files.read_ply)


@query("points", _CLOUDS)
def pcd_round_trip(spark, sf_dir):
    return _clouds(spark, sf_dir, "pcd", files.read_pcd)


_IMAGE = "SELECT l_suppkey % 7 AS camera, l_partkey % 64 AS v, l_orderkey % 48 AS u, CAST(max(l_linenumber) AS INT) AS b, CAST(max(l_quantity) AS INT) AS g, CAST(min(l_quantity) AS INT) AS r FROM lineitem GROUP BY 1, 2, 3"


@query("", f"""WITH i AS ({_IMAGE}), s AS (SELECT camera, max(v) AS h, max(u) AS w FROM i GROUP BY 1), g AS (SELECT camera, CAST(unnest(range(h + 1)) AS BIGINT) AS v, w FROM s), p AS (SELECT camera, v, CAST(unnest(range(w + 1)) AS BIGINT) AS u FROM g)
SELECT CAST(camera AS VARCHAR) AS camera, CAST(v AS INT) AS v, CAST(u AS INT) AS u, coalesce(b, 0) AS b, coalesce(g, 0) AS g, coalesce(r, 0) AS r FROM p LEFT JOIN i USING (camera, v, u)""")
def image_message_round_trip(spark, sf_dir):
    """Raw images as messages in one bag a camera, read back to pixels; cells without a row are black."""
    li = V.table(spark, sf_dir, "lineitem")
    place = ((F.col("l_suppkey") % 7).alias("camera"), (F.col("l_partkey") % 64).alias("v"), (F.col("l_orderkey") % 48).alias("u"))
    pixels = li.groupBy(*place).agg(F.max("l_linenumber").cast("int").alias("b"), F.max("l_quantity").cast("int").alias("g"), F.min("l_quantity").cast("int").alias("r"))
    messages = bags.image_messages(pixels.withColumn("ts_ns", F.col("camera") * 1_000_000), ["camera"])
    folder = _folder(spark, "images")
    files.write_files(bags.encode_bags(messages, "camera"), folder)
    return bags.explode_images(bags.read_bag(spark, folder, ["/camera"])).select(F.col("frame_id").alias("camera"), "v", "u", "b", "g", "r")


@query("poses", "SELECT CAST(frame AS VARCHAR) AS name, rx, ry, rz, tx, ty, tz FROM poses")
def pose_text_round_trip(spark, sf_dir):
    folder = _folder(spark, "poses")
    files.write_poses(V.poses(spark, sf_dir).withColumn("name", F.col("frame").cast("string")), folder)
    return files.read_poses(spark, folder).select("name", "rx", "ry", "rz", "tx", "ty", "tz")


_RASTER = "SELECT l_linenumber AS line, l_partkey % 64 AS v, l_suppkey % 48 AS u, max(l_extendedprice) AS value FROM lineitem GROUP BY 1, 2, 3"


def _raster(spark, sf_dir):
    place = (F.col("l_linenumber").alias("line"), (F.col("l_partkey") % 64).alias("v"), (F.col("l_suppkey") % 48).alias("u"))
    return V.table(spark, sf_dir, "lineitem").groupBy(*place).agg(F.max("l_extendedprice").cast("double").alias("value"))


@query("", f"WITH r AS ({_RASTER}) SELECT CAST(line AS VARCHAR) AS line, CAST(v AS INT) AS v, CAST(u AS INT) AS u, CAST(CAST(value AS FLOAT) AS DOUBLE) AS depth FROM r")
def depth_round_trip(spark, sf_dir):
    """Raw depth rasters, written with a commit step and read back; cells without depth stay out."""
    folder = _folder(spark, "depth")
    sinks.write_named(sinks.encode_depth(_raster(spark, sf_dir), "line", 48), folder)
    back = files.read_depth(spark, folder, 48).where("value is not null")
    return back.select(F.regexp_extract("path", r"(\d+)_depth", 1).alias("line"), "v", "u", F.col("value").alias("depth"))


_FLAT = f"""r AS ({_RASTER}), n AS (SELECT line, max(v) + 1 AS h, max(u) + 1 AS w FROM r GROUP BY 1), f AS (SELECT line, w, unnest(range(h*w)) AS idx FROM n), d AS (SELECT f.line, idx, coalesce(CAST(value AS DOUBLE), 0e0) AS value FROM f LEFT JOIN r ON r.line = f.line AND r.v = idx // w AND r.u = idx % w)"""


@query("", f"WITH {_FLAT} SELECT CAST(line AS VARCHAR) AS line, idx, value FROM d")
def npy_round_trip(spark, sf_dir):
    """One array a line number; its header holds the sizes that its rows turn out to have."""
    folder = _folder(spark, "npy")
    sinks.write_named(sinks.encode_npy(_raster(spark, sf_dir), "line", ["v", "u"], "value"), folder)
    return sinks.explode_arrays(files.read_npy(spark, folder)).select(F.regexp_extract("path", r"(\d+)\.npy", 1).alias("line"), "idx", "value")


@query("", f"WITH {_FLAT} SELECT CAST(line % 2 AS VARCHAR) AS archive, CAST(line AS VARCHAR) AS name, idx, value FROM d")
def npz_append_round_trip(spark, sf_dir):
    """Two archives of arrays, written in two goes: the second one adds to them."""
    folder = _folder(spark, "npz")
    rows = _raster(spark, sf_dir).withColumn("archive", F.col("line") % 2)
    for part in (rows.where("line <= 3"), rows.where("line > 3")):
        sinks.append_npz(sinks.encode_npz(part, "archive", "line", ["v", "u"], "value"), folder)
    return sinks.explode_arrays(files.read_npz(spark, folder)).select(F.regexp_extract("path", r"(\d+)\.npz", 1).alias("archive"), "name", "idx", "value")


@query("poses", "SELECT CAST(frame AS VARCHAR) AS frame, round(cos(rz)*cos(ry), 9) + 0e0 AS r0, round(sin(rz)*cos(ry), 9) + 0e0 AS r3, round(-sin(ry), 9) + 0e0 AS r6, round(cos(ry)*sin(rx), 9) + 0e0 AS r7 FROM poses")
def rotation_cache_round_trip(spark, sf_dir):
    """A rotation cache a frame, written and read back."""
    folder = _folder(spark, "rotations")
    m = V.poses(spark, sf_dir).select("frame", *(c.alias(f"m{k}") for k, c in enumerate(g.euler_to_matrix(F.col("rx"), F.col("ry"), F.col("rz")))))
    sinks.write_named(sinks.encode_rotations(m, "frame", [f"m{k}" for k in range(9)]), folder)
    back = files.read_rotation(spark, folder)
    return back.select(F.regexp_extract("path", r"(\d+)\.xml", 1).alias("frame"), *((F.round(F.get("r", F.lit(k)), 9) + 0.0).alias(f"r{k}") for k in (0, 3, 6, 7)))
