"""Streams give the rows of the batch computation."""

import datetime as dt

import pytest

from terrafold.streaming import operators as S

T0 = dt.datetime(2024, 1, 1, tzinfo=dt.timezone.utc)


def source(spark, path, rows, schema, parts=3):
    for k in range(parts):
        spark.createDataFrame(rows[k::parts] if parts > 1 else rows, schema).coalesce(1).write.mode("append").parquet(str(path))
    return spark.readStream.schema(spark.read.parquet(str(path)).schema).option("maxFilesPerTrigger", 1).parquet(str(path))


def result(spark, df, name, tmp_path):
    q = df.writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", str(tmp_path / f"cp-{name}")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    return spark.table(name).collect()


def at(ms):
    return T0 + dt.timedelta(milliseconds=ms)


def test_align(spark, tmp_path):
    a = source(spark, tmp_path / "a", [(0, at(100), 1), (0, at(500), 2)], "k int, ts timestamp, id int", 1)
    b = source(spark, tmp_path / "b", [(0, at(104), 7), (0, at(506), 8)], "k int, ts timestamp, id int", 1)
    assert [(r.id, r.r_id) for r in result(spark, S.align(a, b, "k"), "aligned", tmp_path)] == [(1, 7)]


def test_state_is_carried_over_batches(spark, tmp_path):
    rows = [(0, at(1000 * k), k, 1.0) for k in range(6)]
    schema = "k int, ts timestamp, seq long, value double"
    for k in range(3):
        spark.createDataFrame(rows[2 * k : 2 * k + 2], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "imu"))
    stream = spark.readStream.schema(schema).parquet(str(tmp_path / "imu"))
    got = sorted((r.seq, r.velocity, r.shift) for r in result(spark, S.integrate(stream, "k"), "imu", tmp_path))
    assert got[-1] == (5, pytest.approx(5.0), pytest.approx(12.5))
    kept = result(spark, S.after_startup(spark.readStream.schema(schema).parquet(str(tmp_path / "imu")), "k", skip=2, ratio=2), "kept", tmp_path)
    assert sorted(r.seq for r in kept) == [2, 4]


def test_latest_value(spark, tmp_path):
    rows = [(0, at(0), 0, "odometry", 1.0), (0, at(1), 1, "mapping", 9.0), (0, at(2), 2, "odometry", 2.0)]
    stream = source(spark, tmp_path / "l", rows, "k int, ts timestamp, seq long, kind string, value double", 1)
    got = sorted((r.seq, r.correction) for r in result(spark, S.latest_value(stream, "k"), "latest", tmp_path))
    assert len(got) == 2 and got[1] == (2, 9.0)


def test_odometry_and_map(spark, tmp_path):
    rows = [(0, at(k), k, 0.0, 0.0, 0.0, -1.0, 0.0, 0.0) for k in range(3)]
    stream = source(spark, tmp_path / "o", rows, "k int, ts timestamp, seq long, rx double, ry double, rz double, tx double, ty double, tz double", 1)
    got = sorted((r.seq, r.tx) for r in result(spark, S.odometry(stream, "k"), "odom", tmp_path))
    assert got == [(0, 1.0), (1, 2.0), (2, 3.0)]
    S.map_cubes(spark.createDataFrame([(0.1, 0.1, 0.1), (80.0, 0.0, 0.0)], "x double, y double, z double"), 0, str(tmp_path / "map"))
    S.map_cubes(spark.createDataFrame([(0.1, 0.1, 0.1), (80.0, 0.0, 0.0)], "x double, y double, z double"), 0, str(tmp_path / "map"))
    assert spark.read.parquet(str(tmp_path / "map")).count() == 2
