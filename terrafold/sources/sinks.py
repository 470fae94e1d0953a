"""Sinks with a commit step: rows ``name, content`` become files that appear when the whole job has succeeded.

Tasks write under a folder of their job's own; the driver, which hears of successful attempts only, moves each file to
its name. A task that runs twice, or a job that fails, leaves nothing behind. A file is an array, a raster or a
document of bounded size, so only names pass through the driver.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage

from . import codecs
from .stores import located

_FILES = "name string, content binary"


@dataclass
class Written(WriterCommitMessage):
    """What a task's successful attempt has written: place and name of each file."""

    files: list[tuple[str, str]]


class FileWriter(DataSourceWriter):
    def __init__(self, path: str, schema) -> None:
        if not {"name", "content"} <= set(schema.names):
            raise ValueError(f"rows need name and content: {schema.names}")
        self.path, self.job = path, uuid.uuid4().hex

    def _pending(self, root: str) -> str:
        return f"{root}/.pending-{self.job}"

    def write(self, iterator) -> Written:
        store, root = located(self.path)
        store.create_dir(self._pending(root), recursive=True)
        files = []
        for row in iterator:
            place = f"{self._pending(root)}/{uuid.uuid4().hex}"
            with store.open_output_stream(place) as out:
                out.write(bytes(row["content"]))
            files.append((place, row["name"]))
        return Written(files)

    def commit(self, messages) -> None:
        store, root = located(self.path)
        for message in messages:
            for place, name in message.files if message else ():
                store.move(place, f"{root}/{name}")
        self.abort(messages)

    def abort(self, messages) -> None:
        from pyarrow import fs

        store, root = located(self.path)
        if store.get_file_info(self._pending(root)).type == fs.FileType.Directory:
            store.delete_dir(self._pending(root))


class FileSink(DataSource):
    """``df.write.format("named_files").mode("append").save(path)``; files of the same name are replaced."""

    @classmethod
    def name(cls) -> str:
        return "named_files"

    def writer(self, schema, overwrite: bool) -> FileWriter:
        if overwrite:
            raise ValueError("named_files only appends")
        return FileWriter(self.options["path"], schema)


def write_named(encoded: DataFrame, path: str) -> None:
    """Writes ``name, content`` rows as files. Of rows of one name any may stay."""
    encoded.sparkSession.dataSource.register(FileSink)
    encoded.select("name", "content").write.format("named_files").mode("append").save(path)


def _array(d: pd.DataFrame, dims: list[str], value: str, dtype: str) -> np.ndarray:
    """The sizes are those of the rows; cells without a row are 0."""
    at = tuple(d[c].to_numpy(int) for c in dims)
    a = np.zeros([int(x.max()) + 1 for x in at], dtype)
    a[at] = d[value]
    return a


def encode_npy(rows: DataFrame, by: str, dims: list[str], value: str, dtype: str = "<f8") -> DataFrame:
    """One array a key: ``name`` (the key and ``.npy``) and ``content``."""
    def run(key: tuple, d: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"name": [f"{key[0]}.npy"], "content": [codecs.write_npy(_array(d, dims, value, dtype))]})

    return rows.select(by, *dims, value).groupBy(by).applyInPandas(run, _FILES)


def encode_npz(rows: DataFrame, by: str, array: str, dims: list[str], value: str, dtype: str = "<f8", compressed: bool = False) -> DataFrame:
    """One archive a key, with an array for each value of ``array``."""
    def run(key: tuple, d: pd.DataFrame) -> pd.DataFrame:
        arrays = {str(n): _array(part, dims, value, dtype) for n, part in d.groupby(array, sort=True)}
        return pd.DataFrame({"name": [f"{key[0]}.npz"], "content": [codecs.write_npz(arrays, compressed)]})

    return rows.select(by, array, *dims, value).groupBy(by).applyInPandas(run, _FILES)


def _merged(spark: SparkSession, encoded: DataFrame, path: str, pattern: str, join) -> DataFrame:
    """New contents where the folder has files of the same names: ``join(old, new)``; others as they are."""
    store, root = located(path)
    store.create_dir(root, recursive=True)
    old = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(path).select(F.substring_index("path", "/", -1).alias("name"), F.col("content").alias("old"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for d in batches:
            for name, new, before in zip(d["name"], d["content"], d["old"], strict=True):
                yield pd.DataFrame({"name": [name], "content": [new if before is None else join(before, new)]})

    return encoded.join(old, "name", "left").select("name", "content", "old").mapInPandas(run, _FILES)


def append_npz(encoded: DataFrame, path: str) -> None:
    """Adds arrays to the archives in ``path``, replacing those of the same name; archives that aren't there are made."""
    write_named(_merged(encoded.sparkSession, encoded, path, "*.npz", lambda a, b: codecs.write_npz(codecs.read_npz(a) | codecs.read_npz(b))), path)


def append_npy(encoded: DataFrame, path: str) -> None:
    """Puts arrays behind those of the same name along the first axis."""
    write_named(_merged(encoded.sparkSession, encoded, path, "*.npy", lambda a, b: codecs.append_npy(a, codecs.read_npy(b))), path)


def encode_depth(pixels: DataFrame, by: str, width: int, value: str = "value") -> DataFrame:
    """Raw float rasters ``<key>_depth.bin`` of a given width; cells without a row hold the largest float, which stands for no depth."""
    def run(key: tuple, d: pd.DataFrame) -> pd.DataFrame:
        a = np.full((int(d["v"].max()) + 1, width), np.finfo(np.float32).max, "<f4")
        a[d["v"], d["u"]] = d[value]
        return pd.DataFrame({"name": [f"{key[0]}_depth.bin"], "content": [a.tobytes()]})

    return pixels.select(by, "v", "u", value).groupBy(by).applyInPandas(run, _FILES)


def encode_rotations(rows: DataFrame, name: str, entries: list[str], key: str = "optR") -> DataFrame:
    """Rotation caches ``<name>.xml`` of nine columns, row-major."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for d in batches:
            matrices = d[entries].to_numpy(float).reshape(-1, 3, 3)
            yield pd.DataFrame({"name": d[name].astype(str) + ".xml", "content": [codecs.write_matrix_xml(m, key) for m in matrices]})

    return rows.select(name, *entries).mapInPandas(run, _FILES)


def explode_arrays(arrays: DataFrame) -> DataFrame:
    """``path, name, idx, value``: the entries of arrays as :func:`terrafold.sources.files.read_npy` gives them, row-major."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for d in batches:
            for path, name, dtype, data in zip(*(d[c] for c in ("path", "name", "dtype", "data")), strict=True):
                a = np.frombuffer(data, dtype)  # row-major however the file had it
                for at in range(0, len(a), 100_000):
                    part = a[at : at + 100_000].astype(float)
                    yield pd.DataFrame({"path": path, "name": name, "idx": np.arange(at, at + len(part)), "value": part})

    return arrays.mapInPandas(run, "path string, name string, idx long, value double")
