"""Sinks: files appear with the commit, failures leave nothing, appends keep what was there."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from terrafold.sources import codecs, files, sinks


def test_failed_jobs_leave_nothing_and_repeats_change_nothing(spark, tmp_path):
    rows = spark.range(40).select(F.concat("id", F.lit(".bin")).alias("name"), F.col("id").cast("string").cast("binary").alias("content")).repartition(4)
    bad = rows.withColumn("content", F.when(F.col("name") == "7.bin", F.raise_error(F.lit("lost"))).otherwise(F.col("content")))
    with pytest.raises(Exception, match="lost"):
        sinks.write_named(bad, str(tmp_path / "out"))
    assert [p for p in (tmp_path / "out").rglob("*") if p.is_file()] == []
    for _ in range(2):
        sinks.write_named(rows, f"file://{tmp_path}/out")
    found = {p.name: p.read_bytes() for p in (tmp_path / "out").iterdir()}
    assert found == {f"{k}.bin": str(k).encode() for k in range(40)}


def test_attempts_that_were_lost_do_not_count(tmp_path):
    class Schema:
        names = ["name", "content"]

    writer = sinks.FileWriter(str(tmp_path), Schema)
    writer.write([{"name": "a", "content": b"half"}])  # an executor was lost behind this
    again = writer.write([{"name": "a", "content": b"whole"}])
    assert not (tmp_path / "a").exists()
    writer.commit([again, None])
    assert (tmp_path / "a").read_bytes() == b"whole" and [p.name for p in tmp_path.iterdir()] == ["a"]


def test_arrays_are_appended(spark, tmp_path):
    one = spark.createDataFrame([("k", "x", 0, 1.0), ("k", "x", 2, 3.0), ("l", "x", 0, 5.0)], "file string, array string, i int, value double")
    two = spark.createDataFrame([("k", "y", 1, 2.0), ("k", "x", 0, 9.0)], one.schema)
    for part in (one, two):
        sinks.append_npz(sinks.encode_npz(part, "file", "array", ["i"], "value"), str(tmp_path / "z"))
    held = {n: a.tolist() for n, a in codecs.read_npz((tmp_path / "z/k.npz").read_bytes()).items()}
    assert held == {"x": [9.0], "y": [0.0, 2.0]} and codecs.read_npz((tmp_path / "z/l.npz").read_bytes())["x"].tolist() == [5.0]
    for _ in range(2):
        sinks.append_npy(sinks.encode_npy(one.where("file = 'k'"), "file", ["i"], "value"), str(tmp_path / "n"))
    assert codecs.read_npy((tmp_path / "n/k.npy").read_bytes()).tolist() == [1.0, 0.0, 3.0] * 2
    flat = sinks.explode_arrays(files.read_npy(spark, str(tmp_path / "n"))).orderBy("idx").collect()
    assert [r.value for r in flat] == [1.0, 0.0, 3.0] * 2
    (tmp_path / "f").mkdir()
    (tmp_path / "f/a.npy").write_bytes(codecs.write_npy(np.asfortranarray(np.arange(6.0).reshape(2, 3))))
    assert [r.value for r in sinks.explode_arrays(files.read_npy(spark, str(tmp_path / "f"))).orderBy("idx").collect()] == list(range(6))
