"""Bags by chunk: large files, topics left unread, bags without an index, raw images."""

import struct

import numpy as np
import pytest

from terrafold.sources import bags, codecs


def number(x, kind="<I"):
    return struct.pack(kind, x)


def conn(k, topic):
    return bags._record(bags._field(op=b"\7", conn=number(k), topic=topic), bags._field(topic=topic, type=b"std_msgs/String"))


def chunk(k, topic, payload, compression=b"none"):
    body = conn(k, topic) + bags._record(bags._field(op=b"\2", conn=number(k), time=struct.pack("<II", k, 0)), payload)
    return bags._record(bags._field(op=b"\5", compression=compression, size=number(len(body))), body)


def test_bag_over_two_gigabytes_is_split_and_unwanted_chunks_stay_closed(spark, tmp_path):
    chunks = [(0, b"/a", b"none"), (1, b"/b", b"lz4"), (2, b"/a", b"none")]  # a chunk that couldn't be opened
    head = lambda at: bags.MAGIC + bags._record(bags._field(op=b"\3", index_pos=number(at, "<Q"), conn_count=number(3), chunk_count=number(3)), b" " * 100)
    with open(tmp_path / "x.bag", "wb") as f:
        f.write(head(0))
        places = []
        for k, topic, compression in chunks:
            f.seek(1_200_000_000 * k + 5000)
            places.append((f.tell(), k))
            f.write(chunk(k, topic, b"m%d" % k, compression))
        end = f.tell()
        for k, topic, _ in chunks:
            f.write(conn(k, topic))
        for at, k in places:
            f.write(bags._record(bags._field(op=b"\6", ver=number(1), chunk_pos=number(at, "<Q"), start_time=b" " * 8, end_time=b" " * 8, count=number(1)), number(k) + number(1)))
        f.seek(0)
        f.write(head(end))
    assert (tmp_path / "x.bag").stat().st_size > 2 << 30
    got = bags.read_bag(spark, str(tmp_path), ["/a"])
    assert sorted((r.topic, r.ts_ns, bytes(r.payload)) for r in got.collect()) == [("/a", 0, b"m0"), ("/a", 2_000_000_000, b"m2")]
    with pytest.raises(Exception, match="lz4"):
        bags.read_bag(spark, str(tmp_path)).collect()


def test_bag_without_an_index_is_gone_through(spark, tmp_path):
    data = bags.MAGIC + bags._record(bags._field(op=b"\3", index_pos=number(0, "<Q"), conn_count=number(0), chunk_count=number(0)), b" " * 50)
    (tmp_path / "y.bag").write_bytes(data + chunk(0, b"/a", b"one") + chunk(1, b"/b", b"two"))
    assert [(r.topic, bytes(r.payload)) for r in bags.read_bag(spark, str(tmp_path)).orderBy("ts_ns").collect()] == [("/a", b"one"), ("/b", b"two")]
    assert bags.read_bag(spark, str(tmp_path), ["/c"]).collect() == [] and bags.read_bag(spark, str(tmp_path), []).collect() == []


@pytest.mark.parametrize("compression", ["none", "bz2"])
def test_written_bags_have_an_index_of_many_chunks(tmp_path, compression):
    messages = [("/a" if k % 3 else "/b", "std_msgs/String", k * 10**8, b"x" * k) for k in range(200)]
    (tmp_path / "z.bag").write_bytes(bags.write_bag(messages, chunk=2000, compression=compression))
    with bags._opened(str(tmp_path / "z.bag")) as f:
        found = list(bags.index(f))
        assert len(found) > 5 and found[0][2] == {0: ("/b", "std_msgs/String"), 1: ("/a", "std_msgs/String")}
        assert all(bags._head(f, at)[0][b"op"] == b"\5" for at, *_ in found)
    (tmp_path / "empty.bag").write_bytes(bags.write_bag([]))
    with bags._opened(str(tmp_path / "empty.bag")) as f:
        assert list(bags.index(f)) == []


def test_raw_images_in_three_encodings():
    bgr = np.arange(24, dtype=np.uint8).reshape(2, 4, 3)
    assert (codecs.read_image_message(codecs.write_image_message(7, "cam", bgr))[2] == bgr).all()
    rgb = codecs.write_image_message(7, "cam", bgr[..., ::-1]).replace(b"bgr8", b"rgb8")
    ns, frame, back = codecs.read_image_message(rgb)
    assert (back == bgr).all() and (ns, frame) == (7, "cam")
    grey = struct.pack("<IIII", 0, 0, 7, 0) + struct.pack("<III", 2, 3, 5) + b"mono8" + struct.pack("<BII", 0, 4, 8) + bytes(range(8))  # a row has a byte to spare
    assert codecs.read_image_message(grey)[2][..., 1].tolist() == [[0, 1, 2], [4, 5, 6]]
    with pytest.raises(ValueError, match="yuv"):
        codecs.read_image_message(codecs.write_image_message(7, "cam", bgr).replace(b"bgr8", b"yuv4"))
