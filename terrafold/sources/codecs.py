"""File formats as pure functions between bytes and NumPy arrays."""

from __future__ import annotations

import io
import re
import struct
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import numpy as np

_PLY = {"char": "i1", "int8": "i1", "uchar": "u1", "uint8": "u1", "short": "<i2", "int16": "<i2", "ushort": "<u2", "uint16": "<u2", "int": "<i4", "int32": "<i4", "uint": "<u4", "uint32": "<u4", "float": "<f4", "float32": "<f4", "double": "<f8", "float64": "<f8"}
_PCD = {("F", 4): "<f4", ("F", 8): "<f8", ("U", 1): "u1", ("U", 2): "<u2", ("U", 4): "<u4", ("I", 1): "i1", ("I", 2): "<i2", ("I", 4): "<i4"}
#: Type codes of point fields in sensor messages.
_FIELD = {1: "i1", 2: "u1", 3: "<i2", 4: "<u2", 5: "<i4", 6: "<u4", 7: "<f4", 8: "<f8"}


def read_ply(data: bytes) -> np.ndarray:
    """Vertices as a structured array; ASCII or binary little-endian."""
    end = data.index(b"end_header")
    body = data[data.index(b"\n", end) + 1 :]
    kind, n, types, inside = "", 0, [], False
    for line in data[:end].decode("ascii").splitlines():
        words = line.split()
        if words[:1] == ["format"]:
            kind = words[1]
        elif words[:1] == ["element"]:
            inside = words[1] == "vertex"
            n = int(words[2]) if inside else n
        elif words[:1] == ["property"] and inside:
            types.append((words[-1], _PLY[words[1]]))
    if kind == "ascii":
        rows = np.loadtxt(io.BytesIO(body), max_rows=n, ndmin=2) if n else np.zeros((0, len(types)))
        return np.array([tuple(r[: len(types)]) for r in rows], types)
    if kind != "binary_little_endian":
        raise ValueError(f"PLY format {kind}")
    return np.frombuffer(body, types, n)


def write_ply(vertices: np.ndarray) -> bytes:
    names = {np.dtype(v).str: k for k, v in reversed(_PLY.items())}
    head = ["ply", "format binary_little_endian 1.0", f"element vertex {len(vertices)}"]
    head += [f"property {names[np.dtype(vertices.dtype[f]).newbyteorder('<').str]} {f}" for f in vertices.dtype.names]
    return "\n".join([*head, "end_header", ""]).encode() + np.ascontiguousarray(vertices).tobytes()


def read_pcd(data: bytes) -> np.ndarray:
    """Points as a structured array; ASCII or binary."""
    head: dict[str, list[str]] = {}
    at = 0
    while "DATA" not in head:
        end = data.index(b"\n", at)
        words = data[at:end].decode("ascii").split()
        if words and not words[0].startswith("#"):
            head[words[0]] = words[1:]
        at = end + 1
    counts = list(map(int, head.get("COUNT", ["1"] * len(head["FIELDS"]))))
    types = [(f, _PCD[t, int(s)]) if c == 1 else (f, _PCD[t, int(s)], (c,)) for f, t, s, c in zip(head["FIELDS"], head["TYPE"], head["SIZE"], counts, strict=True)]
    n = int(head["POINTS"][0])
    if head["DATA"][0] == "ascii":
        rows = np.loadtxt(io.BytesIO(data[at:]), max_rows=n, ndmin=2) if n else []
        return np.array([tuple(r) for r in rows], types)
    if head["DATA"][0] != "binary":
        raise ValueError(f"PCD data {head['DATA'][0]}")
    return np.frombuffer(data, types, n, at)


def write_pcd(points: np.ndarray) -> bytes:
    names = points.dtype.names
    kinds = [points.dtype[f] for f in names]
    lines = [
        "# .PCD v0.7 - Point Cloud Data file format", "VERSION 0.7", "FIELDS " + " ".join(names), "SIZE " + " ".join(str(k.itemsize) for k in kinds), "TYPE " + " ".join(k.kind.upper() for k in kinds),
        "COUNT " + " ".join("1" for _ in kinds), f"WIDTH {len(points)}", "HEIGHT 1", "VIEWPOINT 0 0 0 1 0 0 0", f"POINTS {len(points)}", "DATA binary", "",
    ]
    return "\n".join(lines).encode() + np.ascontiguousarray(points).tobytes()


def read_kitti(data: bytes) -> np.ndarray:
    """Records of x, y, z, intensity; an incomplete last one is left out."""
    return np.frombuffer(data, [(f, "<f4") for f in ("x", "y", "z", "intensity")], len(data) // 16)


def read_npy(data: bytes) -> np.ndarray:
    return np.load(io.BytesIO(data), allow_pickle=False)


def write_npy(array: np.ndarray) -> bytes:
    out = io.BytesIO()
    np.save(out, array, allow_pickle=False)
    return out.getvalue()


def append_npy(data: bytes, rows: np.ndarray) -> bytes:
    """Rows behind an array of the same type and the same shape but for the first axis."""
    old = read_npy(data)
    if old.dtype != rows.dtype or old.shape[1:] != rows.shape[1:]:
        raise ValueError(f"can't append {rows.dtype}{rows.shape} to {old.dtype}{old.shape}")
    return write_npy(np.concatenate([old, rows]))


def read_npz(data: bytes, name: str | None = None) -> dict[str, np.ndarray]:
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        return {n.removesuffix(".npy"): read_npy(z.read(n)) for n in z.namelist() if name is None or n == f"{name}.npy"}


def write_npz(arrays: dict[str, np.ndarray], compressed: bool = False) -> bytes:
    out = io.BytesIO()
    (np.savez_compressed if compressed else np.savez)(out, **arrays)
    return out.getvalue()


_PNM = re.compile(rb"(P[456])\s+(?:#[^\n]*\n\s*)*(\d+)\s+(?:#[^\n]*\n\s*)*(\d+)\s+(?:(?:#[^\n]*\n\s*)*(\d+)\s)?")


def read_pnm(data: bytes) -> np.ndarray:
    """Bitmap (1 = black), grey map or pixel map as h x w or h x w x 3 bytes."""
    kind, w, h = re.match(rb"(P[456])\s+(?:#[^\n]*\n\s*)*(\d+)\s+(\d+)\s", data).groups()
    w, h = int(w), int(h)
    if kind == b"P4":
        at = re.match(rb"P4\s+(?:#[^\n]*\n\s*)*\d+\s+\d+\s", data).end()
        return np.unpackbits(np.frombuffer(data, np.uint8, h * ((w + 7) // 8), at).reshape(h, -1), axis=1)[:, :w]
    m = _PNM.match(data)
    if int(m[4]) > 255:
        raise ValueError("16-bit rasters aren't supported")
    pixels = np.frombuffer(data, np.uint8, h * w * (3 if kind == b"P6" else 1), m.end())
    return pixels.reshape(h, w, 3) if kind == b"P6" else pixels.reshape(h, w)


def write_pnm(image: np.ndarray, bitmap: bool = False) -> bytes:
    h, w = image.shape[:2]
    if bitmap:
        return f"P4\n{w} {h}\n".encode() + np.packbits(image.astype(bool), axis=1).tobytes()
    return f"P{6 if image.ndim == 3 else 5}\n{w} {h}\n255\n".encode() + image.astype(np.uint8).tobytes()


def read_matrix_xml(data: bytes, key: str) -> np.ndarray:
    """A matrix of a storage file."""
    node = ElementTree.fromstring(data).find(key)
    rows, cols = int(node.findtext("rows")), int(node.findtext("cols"))
    return np.array(node.findtext("data").split(), float).reshape(rows, cols)


def write_matrix_xml(matrix: np.ndarray, key: str) -> bytes:
    r, c = matrix.shape
    body = " ".join(map(repr, matrix.ravel().tolist()))
    return f'<?xml version="1.0"?>\n<opencv_storage>\n<{key} type_id="opencv-matrix">\n<rows>{r}</rows>\n<cols>{c}</cols>\n<dt>d</dt>\n<data>\n{body}</data></{key}>\n</opencv_storage>\n'.encode()


def read_boxes(text: str) -> Iterator[dict]:
    """Rows of ``type conf heading`` and eight corners; centre, unit axes and half-lengths follow from them."""
    for line in text.splitlines():
        words = line.split()
        if len(words) < 27:
            continue
        corners = np.array(words[3:27], float).reshape(8, 3)
        edges = corners[[1, 3, 4]] - corners[0]
        length = np.linalg.norm(edges, axis=1)
        axes = edges / np.where(length > 0, length, 1)[:, None]
        yield {"type": words[0], "conf": float(words[1]), "heading": float(words[2]), "centre": corners.mean(axis=0).tolist(), "axes": axes.ravel().tolist(), "half": (length / 2).tolist(), "corners": corners.ravel().tolist()}


def bag_fields(data: bytes) -> dict[bytes, bytes]:
    out, at = {}, 0
    while at < len(data):
        (n,) = struct.unpack_from("<I", data, at)
        name, value = data[at + 4 : at + 4 + n].split(b"=", 1)
        out[name] = value
        at += 4 + n
    return out


def bag_records(data: bytes, at: int = 0) -> Iterator[tuple[dict[bytes, bytes], bytes]]:
    while at + 8 <= len(data):
        (n,) = struct.unpack_from("<I", data, at)
        head = bag_fields(data[at + 4 : at + 4 + n])
        at += 4 + n
        (n,) = struct.unpack_from("<I", data, at)
        yield head, data[at + 4 : at + 4 + n]
        at += 4 + n


def read_point_cloud(message: bytes) -> tuple[int, str, np.ndarray]:
    """A point-cloud message: stamp in nanoseconds, frame id, structured points by field name."""
    at = 4
    sec, nsec, n = struct.unpack_from("<III", message, at)
    frame = message[at + 12 : at + 12 + n].decode()
    at += 12 + n
    height, width, fields = struct.unpack_from("<III", message, at)
    at += 12
    names, formats, offsets = [], [], []
    for _ in range(fields):
        (n,) = struct.unpack_from("<I", message, at)
        names.append(message[at + 4 : at + 4 + n].decode())
        at += 4 + n
        offset, kind, _count = struct.unpack_from("<IBI", message, at)
        offsets.append(offset)
        formats.append(_FIELD[kind])
        at += 9
    _big, step, _row, n = struct.unpack_from("<BIII", message, at)
    kind = np.dtype({"names": names, "formats": formats, "offsets": offsets, "itemsize": step})
    return sec * 10**9 + nsec, frame, np.frombuffer(message, kind, height * width, at + 13)


def write_point_cloud(ns: int, frame: str, points: np.ndarray) -> bytes:
    """A point-cloud message of structured points of 32-bit floats, as :func:`read_point_cloud` reads it."""
    names, name = points.dtype.names, frame.encode()
    fields = b"".join(struct.pack("<I", len(f)) + f.encode() + struct.pack("<IBI", points.dtype.fields[f][1], 7, 1) for f in names)
    size = points.dtype.itemsize * len(points)
    return struct.pack("<III", 0, *divmod(ns, 10**9)) + struct.pack("<I", len(name)) + name + struct.pack("<III", 1, len(points), len(names)) + fields + struct.pack("<BIII", 0, points.dtype.itemsize, size, size) + points.tobytes() + b"\1"


def read_image_message(message: bytes) -> tuple[int, str, np.ndarray]:
    """A raw image message: stamp in nanoseconds, frame id, height x width x 3 bytes in the order blue, green, red."""
    at = 4
    sec, nsec, n = struct.unpack_from("<III", message, at)
    frame = message[at + 12 : at + 12 + n].decode()
    at += 12 + n
    height, width, n = struct.unpack_from("<III", message, at)
    kind = message[at + 12 : at + 12 + n].decode()
    at += 12 + n
    _big, step, _size = struct.unpack_from("<BII", message, at)
    channels = {"bgr8": 3, "rgb8": 3, "8UC3": 3, "mono8": 1, "8UC1": 1}.get(kind)
    if channels is None:
        raise ValueError(f"image encoding {kind!r}")
    rows = np.frombuffer(message, np.uint8, height * step, at + 9).reshape(height, step)[:, : width * channels].reshape(height, width, channels)
    rows = np.repeat(rows, 3, axis=2) if channels == 1 else rows[..., ::-1] if kind == "rgb8" else rows
    return sec * 10**9 + nsec, frame, rows


def write_image_message(ns: int, frame: str, bgr: np.ndarray) -> bytes:
    name, (height, width, _) = frame.encode(), bgr.shape
    return struct.pack("<III", 0, *divmod(ns, 10**9)) + struct.pack("<I", len(name)) + name + struct.pack("<III", height, width, 4) + b"bgr8" + struct.pack("<BII", 0, 3 * width, bgr.size) + bgr.astype(np.uint8).tobytes()
