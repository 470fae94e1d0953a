"""N-way alignment as a stream, stopped and started again, gives the rows of the batch join."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from terrafold.operators import joins
from terrafold.streaming import alignment

SCHEMA = "k string, ts timestamp, id long"
T0 = dt.datetime(2024, 1, 1, tzinfo=dt.timezone.utc)
NAMES = ("view", "pose")
BOUND = 40


@pytest.fixture
def rocks(spark):
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name)
    spark.conf.set(name, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    yield
    spark.conf.set(name, before)


def rows_of(r, part, parts, n=120):
    """Rows of one part of 10 seconds, a little out of order, with ties, repeated rows and nulls."""
    out = []
    for _ in range(n):
        ms = r.randint(10_000 * part, 10_000 * (part + 1) - 1)
        out.append((r.choice(["a", "b", "b", None]), T0 + dt.timedelta(milliseconds=ms, microseconds=r.choice([0, 0, 1, 999])), r.choice([1, 2, 3, None])))
    out += [("a", T0 + dt.timedelta(milliseconds=10_000 * part + 500), 7)] * 2 + [("a", None, 1)]
    # a last row far ahead lets every watermark pass all the rows before
    return out + [("z", T0 + dt.timedelta(hours=1), 0)] * (part == parts - 1)


def run(spark, path, out, checkpoint):
    read = lambda n: spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(f"{path}/{n}")
    got = alignment.align_all(read("base"), {n: read(n) for n in NAMES}, "k", ["id"], BOUND, "2 seconds")
    q = got.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination(240)
    assert q.exception() is None and not q.isActive


def test_align_all_equals_batch_after_a_restart(spark, tmp_path, rocks):
    r, parts, base = random.Random(3), 4, str(tmp_path / "in")
    written = {n: [rows_of(r, p, parts) for p in range(parts)] for n in ("base", *NAMES)}
    for stop in (2, parts):
        for n, rows in written.items():
            for part in rows[stop - 2 : stop]:
                spark.createDataFrame(part, SCHEMA).coalesce(1).write.mode("append").parquet(f"{base}/{n}")
        run(spark, base, str(tmp_path / "out"), str(tmp_path / "cp"))
    got = spark.read.parquet(str(tmp_path / "out"))
    flat = {n: spark.read.parquet(f"{base}/{n}").select("k", F.unix_micros("ts").alias("us"), "id") for n in written}
    want = joins.align_all(flat["base"], {n: flat[n] for n in NAMES}, "us", 1000 * BOUND, ["id"], ["k"]).where("k != 'z'")
    names = ["k", "us", "id", *(f"{n}_{c}" for n in NAMES for c in ("time", "id"))]
    mine = got.select("k", F.unix_micros("ts"), "id", *(c for n in NAMES for c in (F.unix_micros(f"{n}_ts"), f"{n}_id"))).toDF(*names)
    key = lambda row: [(v is not None, v) for v in row]
    assert sorted(map(tuple, mine.collect()), key=key) == sorted(map(tuple, want.select(*names).collect()), key=key)
    assert want.count() > 30


def test_align_all_needs_names(spark):
    with pytest.raises(ValueError):
        alignment.align_all(None, {"": None}, "k", ["id"])
