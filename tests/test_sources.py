"""Formats round-trip, alone and through Spark."""

import bz2
import struct

import numpy as np
import pytest

from terrafold.sources import codecs, files


def cloud(n=5):
    a = np.zeros(n, [(f, "<f4") for f in ("x", "y", "z", "intensity")])
    for k, f in enumerate(a.dtype.names):
        a[f] = np.arange(n) + k / 10
    return a


@pytest.mark.parametrize("kind", ["ply", "pcd"])
@pytest.mark.parametrize("n", [0, 5])
def test_cloud_formats(kind, n):
    write, read = getattr(codecs, f"write_{kind}"), getattr(codecs, f"read_{kind}")
    assert (read(write(cloud(n))) == cloud(n)).all()


def test_ascii_clouds():
    a = codecs.read_ply(b"ply\nformat ascii 1.0\nelement vertex 2\nproperty float x\nproperty float y\nend_header\n1 2\n3 4\n")
    assert a["y"].tolist() == [2, 4]
    b = codecs.read_pcd(b"FIELDS x y\nSIZE 4 4\nTYPE F F\nCOUNT 1 1\nPOINTS 2\nDATA ascii\n1 2\n3 4\n")
    assert b["x"].tolist() == [1, 3]


def test_kitti_drops_an_incomplete_record():
    assert len(codecs.read_kitti(cloud(3).tobytes() + b"\0" * 7)) == 3


def test_arrays():
    a = np.arange(6, dtype="<f4").reshape(2, 3)
    assert (codecs.read_npy(codecs.append_npy(codecs.write_npy(a), a)) == np.concatenate([a, a])).all()
    with pytest.raises(ValueError):
        codecs.append_npy(codecs.write_npy(a), a[:, :2])
    for compressed in (False, True):
        assert list(codecs.read_npz(codecs.write_npz({"a": a, "b": a + 1}, compressed), "b")) == ["b"]


def test_rasters_and_matrices():
    grey = np.arange(12, dtype=np.uint8).reshape(3, 4)
    assert (codecs.read_pnm(codecs.write_pnm(grey)) == grey).all()
    assert (codecs.read_pnm(codecs.write_pnm(np.dstack([grey] * 3))) == np.dstack([grey] * 3)).all()
    assert (codecs.read_pnm(codecs.write_pnm(grey % 2, True)) == grey % 2).all()
    m = np.arange(9.0).reshape(3, 3) / 7
    assert (codecs.read_matrix_xml(codecs.write_matrix_xml(m, "optR"), "optR") == m).all()


def test_boxes():
    corners = [(0, 0, 0), (2, 0, 0), (2, 4, 0), (0, 4, 0), (0, 0, 6), (2, 0, 6), (2, 4, 6), (0, 4, 6)]
    (box,) = codecs.read_boxes("car 0.5 0.1 " + " ".join(str(v) for c in corners for v in c) + "\nshort line\n")
    assert box["centre"] == [1, 2, 3] and box["half"] == [1, 2, 3] and box["axes"] == [1, 0, 0, 0, 1, 0, 0, 0, 1]


def _field(**fields):
    out = b""
    for k, v in fields.items():
        x = k.encode() + b"=" + v
        out += struct.pack("<I", len(x)) + x
    return out


def _record(head, body):
    return struct.pack("<I", len(head)) + head + struct.pack("<I", len(body)) + body


def bag(compression="none"):
    a = cloud(4)
    fields = b"".join(struct.pack("<I", len(f)) + f.encode() + struct.pack("<IBI", 4 * k, 7, 1) for k, f in enumerate(a.dtype.names))
    message = struct.pack("<IIII", 0, 7, 5, 3) + b"lid" + struct.pack("<III", 1, 4, 4) + fields + struct.pack("<BIII", 0, 16, 64, 64) + a.tobytes() + b"\1"
    conn = _record(_field(op=b"\7", conn=struct.pack("<I", 0), topic=b"/points"), _field(topic=b"/points", type=b"sensor_msgs/PointCloud2"))
    data = conn + _record(_field(op=b"\2", conn=struct.pack("<I", 0), time=struct.pack("<II", 7, 5)), message)
    body = bz2.compress(data) if compression == "bz2" else data
    return b"#ROSBAG V2.0\n" + _record(_field(op=b"\3"), b" " * 20) + _record(_field(op=b"\5", compression=compression.encode(), size=struct.pack("<I", len(data))), body)


@pytest.mark.parametrize("compression", ["none", "bz2"])
def test_bag(spark, tmp_path, compression):
    (tmp_path / "a.bag").write_bytes(bag(compression))
    assert files.read_bag(spark, str(tmp_path), ["/other"]).count() == 0
    points = files.explode_clouds(files.read_bag(spark, str(tmp_path), ["/points"])).orderBy("idx").collect()
    assert [round(p.y, 3) for p in points] == [0.1, 1.1, 2.1, 3.1] and points[0].ts_ns == 7_000_000_005


@pytest.mark.parametrize("kind", ["ply", "pcd"])
def test_write_then_read(spark, tmp_path, kind):
    rows = spark.createDataFrame([(f"f{k % 2}", k, float(k), 0.5, 1.5, 2.0) for k in range(10)], "frame string, idx long, x float, y float, z float, intensity float")
    files.write_files(files.encode_clouds(rows, "frame", kind=kind), str(tmp_path / "out"))
    back = getattr(files, f"read_{kind}")(spark, str(tmp_path / "out"))
    assert sorted(r.x for r in back.collect()) == [float(k) for k in range(10)] and back.select("path").distinct().count() == 2


def test_rasters_poses_and_arrays_through_spark(spark, tmp_path):
    px = spark.createDataFrame([("m", v, u, float(v * 3 + u)) for v in range(2) for u in range(3)], "ts string, v int, u int, value double")
    files.write_files(files.encode_rasters(px, "ts"), str(tmp_path / "img"))
    assert sorted(r.value for r in files.read_grey(spark, str(tmp_path / "img")).collect()) == [0, 1, 2, 3, 4, 5]
    assert files.read_mask(spark, str(tmp_path / "img")).count() == 5
    (tmp_path / "poses.txt").write_text("a/b/x 1 2 3 4 5 6\nbroken\nx 7 8 9 10 11 12\n")
    poses = files.read_poses(spark, str(tmp_path / "poses.txt"))
    assert [tuple(r) for r in poses.collect()] == [("x", 7.0, 8.0, 9.0, 10.0, 11.0, 12.0)]
    files.write_poses(poses, str(tmp_path / "again"))
    assert files.read_poses(spark, str(tmp_path / "again")).collect() == poses.collect()
    (tmp_path / "f_forward.npy").write_bytes(codecs.write_npy(np.ones((2, 2, 2), "<f4")))
    assert files.read_flow(spark, str(tmp_path)).where("dir = 'forward' and du = 1").count() == 4
    (tmp_path / "a.npz").write_bytes(codecs.write_npz({"p": np.arange(3), "q": np.arange(4)}))
    assert [r.shape for r in files.read_npz(spark, str(tmp_path), "q").collect()] == [[4]]
    (tmp_path / "r_depth.bin").write_bytes(np.array([1, np.finfo("<f4").max], "<f4").tobytes())
    assert files.read_depth(spark, str(tmp_path), 2).where("value is null").count() == 1
    (tmp_path / "r.xml").write_bytes(codecs.write_matrix_xml(np.eye(3), "optR"))
    assert files.read_rotation(spark, str(tmp_path)).first().r[0] == 1.0
