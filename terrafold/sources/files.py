"""Reading and writing sensor files with Spark.

Files are read with ``binaryFile``, one row a file, from any store Spark can read, and decoded on the
executors in Arrow batches. A sweep, a raster or an array is one file of bounded size; what is decoded
leaves at most ``ROWS`` rows at a time.
"""

from __future__ import annotations

import os
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from . import bags, codecs

ROWS = 100_000
POINTS = "path string, idx long, x float, y float, z float, intensity float"


def files(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """``path`` and ``content``, in no order; sort by ``path`` where order matters."""
    return spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(path).select("path", "content")


def decoded(spark: SparkSession, path: str, pattern: str, decode: Callable[[str, bytes], Iterator[pd.DataFrame]], schema: str) -> DataFrame:
    names = StructType.fromDDL(schema).names

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for name, content in zip(batch["path"], batch["content"], strict=True):
                for frame in decode(name, content):
                    for at in range(0, len(frame), ROWS):
                        yield frame.iloc[at : at + ROWS].assign(path=name)[names]

    return files(spark, path, pattern).mapInPandas(run, schema)


def _points(read: Callable[[bytes], np.ndarray]):
    def decode(_: str, content: bytes) -> Iterator[pd.DataFrame]:
        a = read(content)
        missing = np.full(len(a), np.nan, np.float32)
        yield pd.DataFrame({"idx": np.arange(len(a)), **{f: a[f].astype(np.float32) if f in a.dtype.names else missing for f in ("x", "y", "z", "intensity")}})

    return decode


def read_ply(spark: SparkSession, path: str) -> DataFrame:
    return decoded(spark, path, "*.ply", _points(codecs.read_ply), POINTS)


def read_pcd(spark: SparkSession, path: str) -> DataFrame:
    return decoded(spark, path, "*.pcd", _points(codecs.read_pcd), POINTS)


def read_kitti(spark: SparkSession, path: str) -> DataFrame:
    return decoded(spark, path, "*.bin", _points(codecs.read_kitti), POINTS)


def _pixels(image: np.ndarray) -> pd.DataFrame:
    v, u = np.indices(image.shape[:2])
    frame = pd.DataFrame({"v": v.ravel(), "u": u.ravel()})
    if image.ndim == 3:
        return frame.assign(**dict(zip("rgb", image.reshape(-1, image.shape[2]).T.astype(int), strict=False)))
    return frame.assign(value=image.ravel().astype(float))


def read_grey(spark: SparkSession, path: str, pattern: str = "*.p[bg]m") -> DataFrame:
    return decoded(spark, path, pattern, lambda _, c: iter([_pixels(codecs.read_pnm(c))]), "path string, v int, u int, value double")


def read_colour(spark: SparkSession, path: str) -> DataFrame:
    return decoded(spark, path, "*.ppm", lambda _, c: iter([_pixels(codecs.read_pnm(c))]), "path string, v int, u int, r int, g int, b int")


def read_mask(spark: SparkSession, path: str) -> DataFrame:
    """Masked cells only: value over 0."""
    return read_grey(spark, path).where("value > 0").select("path", "v", "u")


def read_depth(spark: SparkSession, path: str, width: int) -> DataFrame:
    """Raw float rasters of a given width; the largest float means no depth."""
    def decode(_: str, content: bytes) -> Iterator[pd.DataFrame]:
        yield _pixels(np.frombuffer(content, "<f4").reshape(-1, width))

    top = float(np.finfo(np.float32).max)
    return decoded(spark, path, "*_depth.bin", decode, "path string, v int, u int, value double").withColumn("value", F.when(F.col("value") < top, F.col("value")))


def read_flow(spark: SparkSession, path: str) -> DataFrame:
    """Optical flow arrays h x w x 2."""
    def decode(_: str, content: bytes) -> Iterator[pd.DataFrame]:
        a = codecs.read_npy(content)
        v, u = np.indices(a.shape[:2])
        yield pd.DataFrame({"v": v.ravel(), "u": u.ravel(), "du": a[..., 0].ravel(), "dv": a[..., 1].ravel()})

    out = decoded(spark, path, "*.npy", decode, "path string, v int, u int, du float, dv float")
    return out.withColumn("dir", F.when(F.col("path").endswith("forward.npy"), "forward").when(F.col("path").endswith("backward.npy"), "backward"))


_ARRAY = "path string, name string, shape array<long>, dtype string, fortran boolean, data binary"


def _array_row(name: str, a: np.ndarray) -> dict:
    return {"name": name, "shape": list(a.shape), "dtype": a.dtype.str, "fortran": bool(a.flags.f_contiguous and not a.flags.c_contiguous), "data": a.tobytes()}


def read_npy(spark: SparkSession, path: str) -> DataFrame:
    return decoded(spark, path, "*.npy", lambda _, c: iter([pd.DataFrame([_array_row("", codecs.read_npy(c))])]), _ARRAY)


def read_npz(spark: SparkSession, path: str, name: str | None = None) -> DataFrame:
    """All arrays, or one by name: others are then not decoded."""
    return decoded(spark, path, "*.npz", lambda _, c: iter([pd.DataFrame([_array_row(n, a) for n, a in codecs.read_npz(c, name).items()], columns=["name", "shape", "dtype", "fortran", "data"])]), _ARRAY)


def read_rotation(spark: SparkSession, path: str, key: str = "optR") -> DataFrame:
    return decoded(spark, path, "*.xml", lambda _, c: iter([pd.DataFrame({"r": [codecs.read_matrix_xml(c, key).ravel().tolist()]})]), "path string, r array<double>")


def read_boxes(spark: SparkSession, path: str) -> DataFrame:
    schema = "path string, type string, conf double, heading double, centre array<double>, axes array<double>, half array<double>, corners array<double>"
    return decoded(spark, path, "*.txt", lambda _, c: iter([pd.DataFrame(list(codecs.read_boxes(c.decode())), columns=["type", "conf", "heading", "centre", "axes", "half", "corners"])]), schema)


def read_poses(spark: SparkSession, path: str) -> DataFrame:
    """``name rx ry rz tx ty tz`` lines; the name's last path part is the key, and the last line of a key wins."""
    words = F.split(F.trim("value"), r"\s+")
    lines = spark.read.text(path).select("value", F.monotonically_increasing_id().alias("seq")).where(F.size(words) >= 7)
    numbers = [words[k + 1].cast("double").alias(n) for k, n in enumerate(("rx", "ry", "rz", "tx", "ty", "tz"))]
    rows = lines.select(F.substring_index(words[0], "/", -1).alias("name"), "seq", *numbers)
    return rows.groupBy("name").agg(F.max(F.struct("seq", "rx", "ry", "rz", "tx", "ty", "tz")).alias("m")).select("name", *(F.col(f"m.{n}") for n in ("rx", "ry", "rz", "tx", "ty", "tz")))


def write_poses(poses: DataFrame, path: str) -> None:
    """Text files in name order."""
    poses.orderBy("name").select(F.concat_ws(" ", "name", *(F.col(n).cast("string") for n in ("rx", "ry", "rz", "tx", "ty", "tz")))).write.text(path)


def read_bag(spark: SparkSession, path: str, topics: list[str] | None = None) -> DataFrame:
    """Messages of bags, read chunk by chunk: see :func:`terrafold.sources.bags.read_bag`."""
    return bags.read_bag(spark, path, topics)


def explode_clouds(messages: DataFrame) -> DataFrame:
    """Points of point-cloud messages, fields by name."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for payload in batch["payload"]:
                stamp, frame, a = codecs.read_point_cloud(payload)
                points = next(_points(lambda _, a=a: a)("", b""))
                yield points.assign(ts_ns=stamp, frame_id=frame)[["ts_ns", "frame_id", "idx", "x", "y", "z", "intensity"]]

    return messages.select("payload").mapInPandas(run, "ts_ns long, frame_id string, idx long, x float, y float, z float, intensity float")


def encode_clouds(points: DataFrame, by: str, order: str = "idx", kind: str = "ply", fields: tuple[str, ...] = ("x", "y", "z", "intensity")) -> DataFrame:
    """One file a group: ``name``, ``content``; points of a file in ``order``."""
    write, suffix = {"ply": (codecs.write_ply, ".ply"), "pcd": (codecs.write_pcd, ".pcd")}[kind]

    def run(key: tuple, d: pd.DataFrame) -> pd.DataFrame:
        d = d.sort_values(order)
        a = np.empty(len(d), [(f, "<f4") for f in fields])
        for f in fields:
            a[f] = d[f]
        return pd.DataFrame({"name": [f"{key[0]}{suffix}"], "content": [write(a)]})

    return points.select(by, order, *fields).groupBy(by).applyInPandas(run, "name string, content binary")


def encode_rasters(pixels: DataFrame, by: str, values: tuple[str, ...] = ("value",)) -> DataFrame:
    """One image a group; cells without a row are 0."""
    def run(key: tuple, d: pd.DataFrame) -> pd.DataFrame:
        a = np.zeros((int(d["v"].max()) + 1, int(d["u"].max()) + 1, len(values)), np.uint8)
        a[d["v"], d["u"]] = np.clip(d[list(values)].to_numpy(float), 0, 255)
        image, suffix = (a, ".ppm") if len(values) == 3 else (a[..., 0], ".pgm")
        return pd.DataFrame({"name": [f"{key[0]}{suffix}"], "content": [codecs.write_pnm(image)]})

    return pixels.select(by, "v", "u", *values).groupBy(by).applyInPandas(run, "name string, content binary")


def write_files(encoded: DataFrame, directory: str) -> None:
    """Writes ``name``/``content`` rows as files into a shared directory (a path, or a URI that pyarrow knows).

    Each file is written under another name and then moved, so a task that runs again does no harm.
    """
    def write(rows) -> None:
        from pyarrow import fs

        store, root = fs.FileSystem.from_uri(directory) if "://" in directory else (fs.LocalFileSystem(), os.path.abspath(directory))
        store.create_dir(root, recursive=True)
        for row in rows:
            part = f"{root}/.{row['name']}.{uuid.uuid4().hex}"
            with store.open_output_stream(part) as out:
                out.write(bytes(row["content"]))
            store.move(part, f"{root}/{row['name']}")

    encoded.select("name", "content").foreachPartition(write)
