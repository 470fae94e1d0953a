"""Time joins and fills stay linear in one key and bucket."""

import time

from pyspark.sql import functions as F

from terrafold.operators import joins, windows


def test_hundred_thousand_rows_a_side_in_one_bucket(spark):
    n = 100_000
    left = spark.range(n).select(F.lit("k").alias("sensor"), (F.col("id") * 10 + 3).alias("us"))
    right = spark.range(n).select(F.lit("k").alias("sensor"), (F.col("id") * 10).alias("us"), F.col("id").cast("double").alias("v"))
    began = time.time()
    out = joins.bracket_interpolate(left, right, "us", "v", ["sensor"]).agg(F.count("*"), F.sum(F.abs(F.col("v_at") - F.least(F.col("us") / 10.0, F.lit(n - 1.0))))).first()
    assert out[0] == n and out[1] < 1e-3 and time.time() - began < 20
    began = time.time()
    near = joins.asof_nearest(left, right, "us", ["v"]).agg(F.count("*"), F.sum((F.col("us") - F.col("r_time") != 3).cast("int"))).first()
    assert tuple(near) == (n, 0) and time.time() - began < 20


def test_fill_and_first_match_of_long_series(spark):
    n = 200_000
    began = time.time()
    rows = spark.range(n).select(F.lit(1).alias("line"), F.col("id").alias("u"), F.when(F.col("id") % 1000 == 0, F.col("id").cast("double")).alias("v"))
    out = windows.gap_fill(rows, "v", "u", ["line"]).agg(F.count("filled"), F.max(F.abs(F.col("filled") - F.col("u")))).first()
    assert out[0] == n - 999 and out[1] < 1e-6 and time.time() - began < 20
    began = time.time()
    seen = spark.range(n).select(F.lit(0).alias("video"), F.col("id").alias("frame"), F.lit(7).alias("cell"))
    got = joins.first_match(seen, seen, seen, ["cell"], "frame", ["video"]).groupBy((F.col("source") - F.col("frame")).alias("step")).count().collect()
    # the last frame has none ahead and passes over the one right before it
    assert {(r.step, r["count"]) for r in got} == {(1, n - 1), (-2, 1)} and time.time() - began < 20
