"""Bags of messages, read chunk by chunk and written with an index.

A bag's index tells where its chunks lie and how many messages of which connection each holds. It is read on the
executors, a row a chunk comes of it, chunks without a wanted topic are dropped, and what is left is dealt out: no task
ever holds more than a chunk, and nothing is read of the topics that nobody asks for (but where they share a chunk).
"""

from __future__ import annotations

import bz2
import struct
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession

from . import codecs
from .stores import located

MAGIC = b"#ROSBAG V2.0\n"
MESSAGES = "path string, topic string, type string, ts_ns long, payload binary"
_CHUNKS = "path string, at long, connections array<struct<id: int, topic: string, type: string>>"
#: Messages that leave a task together, at most, and their bytes.
BATCH, BATCH_BYTES = 256, 16 << 20


def _opened(path: str):
    """A file that can be read from anywhere within."""
    store, place = located(path)
    return store.open_input_file(place)


def _head(file, at: int) -> tuple[dict[bytes, bytes], int, int]:
    """A record's fields, where its data begins and how long it is; the data itself isn't read."""
    file.seek(at)
    (n,) = struct.unpack("<I", file.read(4))
    fields = codecs.bag_fields(file.read(n))
    (size,) = struct.unpack("<I", file.read(4))
    return fields, at + 8 + n, size


def _data(file, at: int, size: int) -> bytes:
    file.seek(at)
    return file.read(size)


def _connection(fields: dict[bytes, bytes], body: bytes) -> tuple[int, str, str]:
    return struct.unpack("<I", fields[b"conn"])[0], fields[b"topic"].decode(), codecs.bag_fields(body).get(b"type", b"").decode()


def index(file) -> Iterator[tuple[int, set[int] | None, dict[int, tuple[str, str]]]]:
    """Where each chunk begins, its connections (None: unknown) and the topics and types of all known ones.

    A bag that was closed has its index; of one that wasn't, records are gone through head by head, and chunks opened for their connections.
    """
    if _data(file, 0, len(MAGIC)) != MAGIC:
        raise ValueError("not a version 2.0 bag")
    head, begin, size = _head(file, len(MAGIC))
    at = struct.unpack("<Q", head[b"index_pos"])[0] if b"index_pos" in head else 0
    known: dict[int, tuple[str, str]] = {}
    end = file.size()
    if at:
        while at + 8 <= end:
            fields, begin, size = _head(file, at)
            at = begin + size
            body = _data(file, begin, size)
            if fields[b"op"] == b"\7":
                ident, topic, kind = _connection(fields, body)
                known[ident] = topic, kind
            elif fields[b"op"] == b"\6":
                held = np.frombuffer(body, "<u4").reshape(-1, 2)
                yield struct.unpack("<Q", fields[b"chunk_pos"])[0], set(held[held[:, 1] > 0, 0].tolist()), known
        return
    at = begin + size
    while at + 8 <= end:
        fields, begin, size = _head(file, at)
        if fields[b"op"] == b"\5":
            for inner, body in codecs.bag_records(_plain(fields, _data(file, begin, size))):
                if inner[b"op"] == b"\7":
                    ident, topic, kind = _connection(inner, body)
                    known[ident] = topic, kind
            yield at, None, dict(known)
        at = begin + size


def _plain(fields: dict[bytes, bytes], body: bytes) -> bytes:
    kind = fields[b"compression"]
    if kind not in (b"none", b"bz2"):
        raise ValueError(f"chunk compression {kind!r}")
    return bz2.decompress(body) if kind == b"bz2" else body


def _listed(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").option("pathGlobFilter", "*.bag").option("recursiveFileLookup", "true").load(path).select("path")


def read_bag(spark: SparkSession, path: str, topics: list[str] | None = None) -> DataFrame:
    """Messages ``path, topic, type, ts_ns, payload`` of a bag or a folder of bags; ``topics`` is applied while reading. Chunks may be plain or bz2."""
    wanted = None if topics is None else set(topics)

    def chunks(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for name in batch["path"]:
                with _opened(name) as file:
                    for at, held, known in index(file):
                        found = [{"id": k, "topic": t, "type": y} for k, (t, y) in known.items() if (held is None or k in held) and (wanted is None or t in wanted)]
                        if found:
                            yield pd.DataFrame({"path": [name], "at": [at], "connections": [found]})

    def messages(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        columns = ["path", "topic", "type", "ts_ns", "payload"]
        for batch in batches:
            for name, at, connections in zip(batch["path"], batch["at"], batch["connections"], strict=True):
                known = {c["id"]: (c["topic"], c["type"]) for c in connections}
                rows, held = [], 0
                with _opened(name) as file:
                    fields, begin, size = _head(file, at)
                    body = _plain(fields, _data(file, begin, size))
                for inner, data in codecs.bag_records(body):
                    if inner[b"op"] == b"\2" and (found := known.get(struct.unpack("<I", inner[b"conn"])[0])):
                        sec, nsec = struct.unpack("<II", inner[b"time"])
                        rows.append((name, *found, sec * 10**9 + nsec, data))
                        held += len(data)
                        if len(rows) == BATCH or held >= BATCH_BYTES:
                            yield pd.DataFrame(rows, columns=columns)
                            rows, held = [], 0
                if rows:
                    yield pd.DataFrame(rows, columns=columns)

    listed = _listed(spark, path)
    return listed.mapInPandas(chunks, _CHUNKS).repartition("path", "at").mapInPandas(messages, MESSAGES)


def _field(**values: bytes) -> bytes:
    return b"".join(struct.pack("<I", len(k) + 1 + len(v)) + k.encode() + b"=" + v for k, v in values.items())


def _record(head: bytes, data: bytes) -> bytes:
    return struct.pack("<I", len(head)) + head + struct.pack("<I", len(data)) + data


def write_bag(messages: list[tuple[str, str, int, bytes]], chunk: int = 768 << 10, compression: str = "none") -> bytes:
    """A bag with its index from ``topic, type, ts_ns, payload`` in order."""
    known: dict[tuple[str, str], int] = {}
    number = lambda x: struct.pack("<I", x)
    stamp = lambda ns: struct.pack("<II", *divmod(ns, 10**9))
    described = lambda topic, kind, k: _record(_field(op=b"\7", conn=number(k), topic=topic.encode()), _field(topic=topic.encode(), type=kind.encode()))
    body, out, places = b"", b"", []
    held: dict[int, int] = {}
    times: list[int] = []
    first = len(MAGIC) + len(_record(_field(op=b"\3", index_pos=b" " * 8, conn_count=b" " * 4, chunk_count=b" " * 4), b" " * 4027))

    def closed() -> bytes:
        packed = bz2.compress(body) if compression == "bz2" else body
        places.append((first + len(out), min(times), max(times), dict(held)))
        return _record(_field(op=b"\5", compression=compression.encode(), size=number(len(body))), packed)

    for topic, kind, ns, payload in messages:
        if (topic, kind) not in known:
            known[topic, kind] = len(known)
            body += described(topic, kind, known[topic, kind])
        k = known[topic, kind]
        body += _record(_field(op=b"\2", conn=number(k), time=stamp(ns)), payload)
        held[k] = held.get(k, 0) + 1
        times.append(ns)
        if len(body) >= chunk:
            out += closed()
            body, held, times = b"", {}, []
    if times:
        out += closed()
    ends = b"".join(described(t, y, k) for (t, y), k in known.items())
    for at, low, high, counts in places:
        ends += _record(_field(op=b"\6", ver=number(1), chunk_pos=struct.pack("<Q", at), start_time=stamp(low), end_time=stamp(high), count=number(len(counts))), b"".join(number(k) + number(n) for k, n in counts.items()))
    head = _record(_field(op=b"\3", index_pos=struct.pack("<Q", first + len(out)), conn_count=number(len(known)), chunk_count=number(len(places))), b" " * 4027)
    return MAGIC + head + out + ends


def encode_bags(messages: DataFrame, by: str, compression: str = "none") -> DataFrame:
    """One bag a group, ``name, content``, of ``topic, type, ts_ns, payload`` in the order of time; a group is what one file holds, such as a key's minute."""
    def run(key: tuple, d: pd.DataFrame) -> pd.DataFrame:
        d = d.sort_values(["ts_ns", "topic"])
        rows = [(t, y, int(n), bytes(p)) for t, y, n, p in zip(d["topic"], d["type"], d["ts_ns"], d["payload"], strict=True)]
        return pd.DataFrame({"name": [f"{key[0]}.bag"], "content": [write_bag(rows, compression=compression)]})

    return messages.select(by, "topic", "type", "ts_ns", "payload").groupBy(by).applyInPandas(run, "name string, content binary")


def cloud_messages(points: DataFrame, by: list[str], topic: str = "/points", order: str = "pt") -> DataFrame:
    """A point-cloud message a sweep: ``by``, ``topic, type, ts_ns, payload`` from ``by, ts_ns`` and points ``x, y, z, intensity``, in ``order``. A sweep is what one turn of the sensor yields."""
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in points.schema.fields if f.name in by) + ", topic string, type string, ts_ns long, payload binary"

    def run(key: tuple, d: pd.DataFrame) -> pd.DataFrame:
        d = d.sort_values(order)
        a = np.zeros(len(d), [(c, "<f4") for c in ("x", "y", "z", "intensity")])
        for c in a.dtype.names:
            a[c] = d[c]
        ns = int(d["ts_ns"].iloc[0])
        return pd.DataFrame([[*key, topic, "sensor_msgs/PointCloud2", ns, codecs.write_point_cloud(ns, str(key[-1]), a)]], columns=[*by, "topic", "type", "ts_ns", "payload"])

    return points.select(*by, "ts_ns", order, "x", "y", "z", "intensity").groupBy(*by).applyInPandas(run, schema)


def explode_images(messages: DataFrame) -> DataFrame:
    """Pixels ``ts_ns, frame_id, v, u, b, g, r`` of raw image messages; one-channel images have three equal ones. A row of the image at a time leaves the task at most some thousands at once."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for payload in batch["payload"]:
                ns, frame, bgr = codecs.read_image_message(payload)
                for top in range(0, len(bgr), 64):
                    part = bgr[top : top + 64]
                    v, u = np.mgrid[top : top + len(part), : part.shape[1]]
                    yield pd.DataFrame({"ts_ns": ns, "frame_id": frame, "v": v.ravel(), "u": u.ravel(), **{c: part[..., k].ravel() for k, c in enumerate("bgr")}})

    return messages.select("payload").mapInPandas(run, "ts_ns long, frame_id string, v int, u int, b int, g int, r int")


def image_messages(pixels: DataFrame, by: list[str], topic: str = "/camera") -> DataFrame:
    """A raw image message a group of pixels ``ts_ns, v, u, b, g, r``; cells without a row are black. A group is an image."""
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pixels.schema.fields if f.name in by) + ", topic string, type string, ts_ns long, payload binary"

    def run(key: tuple, d: pd.DataFrame) -> pd.DataFrame:
        a = np.zeros((int(d["v"].max()) + 1, int(d["u"].max()) + 1, 3), np.uint8)
        a[d["v"], d["u"]] = d[["b", "g", "r"]]
        ns = int(d["ts_ns"].iloc[0])
        return pd.DataFrame([[*key, topic, "sensor_msgs/Image", ns, codecs.write_image_message(ns, str(key[-1]), a)]], columns=[*by, "topic", "type", "ts_ns", "payload"])

    return pixels.select(*by, "ts_ns", "v", "u", "b", "g", "r").groupBy(*by).applyInPandas(run, schema)
