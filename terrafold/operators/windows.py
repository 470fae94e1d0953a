"""Windows over ordered rings and series."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _w(by: list[str], order: list[str]):
    return Window.partitionBy(*by).orderBy(*order)


def curvature(df: DataFrame, values: list[str], by: list[str], order: list[str], reach: int = 5) -> DataFrame:
    """Squared norm of the sum of the ``2 * reach`` neighbours minus as many times the row, null in the margins."""
    w = _w(by, order)
    frame = w.rowsBetween(-reach, reach)
    parts = [F.sum(v).over(frame) - (2 * reach + 1) * F.col(v) for v in values]
    return df.select("*", F.when(F.count("*").over(frame) == 2 * reach + 1, sum(p * p for p in parts)).alias("curvature"))


def neighbour_gap(df: DataFrame, values: list[str], by: list[str], order: list[str]) -> DataFrame:
    """Squared distances to the next and previous row."""
    w = _w(by, order)
    gap = lambda n: sum((F.col(v) - F.lag(v, n).over(w)) * (F.col(v) - F.lag(v, n).over(w)) for v in values)
    return df.select("*", gap(-1).alias("gap_next"), gap(1).alias("gap_previous"))


def suppress(df: DataFrame, before: Column, after: Column, by: list[str], order: list[str], reach: int = 5) -> DataFrame:
    """Marks ``[i - reach, i]`` for rows with ``before`` and ``[i + 1, i + reach + 1]`` for rows with ``after``."""
    w = _w(by, order)
    marked = F.coalesce(F.max(before.cast("int")).over(w.rowsBetween(0, reach)), F.lit(0)) + F.coalesce(F.max(after.cast("int")).over(w.rowsBetween(-reach - 1, -1)), F.lit(0))
    return df.select("*", (marked > 0).alias("picked"))


def occlusion(df: DataFrame, by: list[str], order: list[str]) -> DataFrame:
    """Rejects points at depth jumps and on surfaces almost parallel to the beam: column ``picked``."""
    from ..functions.scalars import norm2, squared

    w = _w(by, order)
    at = lambda n: tuple(F.lag(c, n).over(w) for c in "xyz")
    own, after, before = at(0), at(-1), at(1)
    d, dn = F.sqrt(norm2(own)), F.sqrt(norm2(after))
    jump = squared(after, own) > 0.1
    far = jump & (d > dn) & (F.sqrt(squared(after, own, dn / d)) / dn < 0.1)
    near = jump & (d <= dn) & (F.sqrt(squared(own, after, d / dn)) / d < 0.1)
    flat = ~F.coalesce(far, F.lit(False)) & (squared(after, own) > 0.0002 * norm2(own)) & (squared(own, before) > 0.0002 * norm2(own))
    rows = df.select("*", F.coalesce(far, F.lit(False)).alias("_a"), F.coalesce(near, F.lit(False)).alias("_b"), F.coalesce(flat, F.lit(False)).alias("_c"))
    rows = suppress(rows, F.col("_a"), F.col("_b"), by, order)
    return rows.select(*df.columns, (F.col("picked") | F.col("_c")).alias("picked"))


def region_split(df: DataFrame, by: list[str], order: list[str], regions: int = 6, reach: int = 5) -> DataFrame:
    """Region of each row of a ring, null in the margins: region j begins at ``reach + floor((n - 1 - 2 * reach) * j / regions)``."""
    w = _w(by, order)
    i, n = F.row_number().over(w) - 1, F.count("*").over(Window.partitionBy(*by))
    rows = df.select("*", i.alias("_i"), n.alias("_n"))
    inner = F.col("_n") - 1 - 2 * reach
    begin = lambda j: reach + F.floor(inner * j / regions)
    region = sum((F.col("_i") >= begin(j)).cast("int") for j in range(regions)) - 1
    return rows.select(*df.columns, F.when((inner > 0) & (F.col("_i") >= reach) & (F.col("_i") < begin(regions)), region).alias("region"))


def gap_fill(df: DataFrame, value: str, position: str, by: list[str]) -> DataFrame:
    """Linear fill between the nearest known values on both sides; the ends stay null: column ``filled``."""
    known = F.when(F.col(value).isNotNull(), F.struct(F.col(position).alias("p"), F.col(value).alias("v")))
    # what lies ahead is the last one of the falling order: frames that reach to the end are gone through again for every row
    a, b = (F.last(known, True).over(Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)) for order in (F.asc(position), F.desc(position)))
    rows = df.select("*", a.alias("_a"), b.alias("_b"))
    share = (F.col(position) - F.col("_a.p")) / (F.col("_b.p") - F.col("_a.p"))
    return rows.select(*df.columns, F.coalesce(F.col(value), F.col("_a.v") + share * (F.col("_b.v") - F.col("_a.v"))).alias("filled"))


def sticky(df: DataFrame, condition: Column, by: list[str], order: list[str], name: str = "passed") -> DataFrame:
    """Whether the condition held in an earlier row."""
    return df.select("*", F.coalesce(F.max(condition.cast("int")).over(_w(by, order).rowsBetween(Window.unboundedPreceding, -1)) == 1, F.lit(False)).alias(name))


def unwrap_sweep(df: DataFrame, by: list[str], order: list[str], x: str = "x", y: str = "y") -> DataFrame:
    """Share of the sweep at each point: angles are unwrapped around the start, and around the end once half a turn has passed.

    The flag is set by a point's adjusted angle in first-half terms and holds for all later points.
    """
    import math

    w = _w(by, order)
    whole = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    ori = -F.atan2(F.col(y), F.col(x))
    rows = df.select("*", ori.alias("_o"), F.first(ori).over(whole).alias("_s"), (F.last(ori).over(whole) + 2 * math.pi).alias("_e0"))
    s, e0 = F.col("_s"), F.col("_e0")
    e = F.when(e0 - s > 3 * math.pi, e0 - 2 * math.pi).when(e0 - s < math.pi, e0 + 2 * math.pi).otherwise(e0)
    o = F.col("_o")
    first = F.when(o < s - math.pi / 2, o + 2 * math.pi).when(o > s + math.pi * 3 / 2, o - 2 * math.pi).otherwise(o)
    rows = sticky(rows.select("*", e.alias("_e"), first.alias("_first")), F.col("_first") - s > math.pi, by, order, "_half")
    o2 = o + 2 * math.pi
    second = F.when(o2 < F.col("_e") - math.pi * 3 / 2, o2 + 2 * math.pi).when(o2 > F.col("_e") + math.pi / 2, o2 - 2 * math.pi).otherwise(o2)
    return rows.select(*df.columns, ((F.when(F.col("_half"), second).otherwise(F.col("_first")) - s) / (F.col("_e") - s)).alias("sweep_share"))


def integrate(df: DataFrame, acceleration: str, time_us: str, by: list[str]) -> DataFrame:
    """Velocity and shift from accelerations: ``v += a dt``, ``s += v_before dt + a dt^2 / 2``."""
    w = _w(by, [time_us])
    dt = F.coalesce((F.col(time_us) - F.lag(time_us).over(w)) / 1e6, F.lit(0.0))
    rows = df.select("*", dt.alias("_dt"))
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.select("*", F.sum(F.col(acceleration) * F.col("_dt")).over(upto).alias("velocity"))
    rows = rows.select("*", F.coalesce(F.lag("velocity").over(w), F.lit(0.0)).alias("_v"))
    shift = F.sum(F.col("_v") * F.col("_dt") + 0.5 * F.col(acceleration) * F.col("_dt") * F.col("_dt")).over(upto)
    return rows.select(*df.columns, "velocity", shift.alias("shift"))


def islands(df: DataFrame, position: str, by: list[str]) -> DataFrame:
    """Runs of consecutive positions: first, last, length."""
    rows = df.select(*by, position).distinct().withColumn("_g", F.col(position) - F.row_number().over(_w(by, [position])))
    return rows.groupBy(*by, "_g").agg(F.min(position).alias("first"), F.max(position).alias("last"), F.count("*").alias("length")).drop("_g")


def stride(df: DataFrame, by: list[str], order: list[str], step: int = 10) -> DataFrame:
    """Every ``step``-th row from the first."""
    return df.withColumn("_n", F.row_number().over(_w(by, order))).where((F.col("_n") - 1) % step == 0).drop("_n")


def bounded_history(df: DataFrame, value: str, by: list[str], order: list[str], n: int) -> DataFrame:
    """The last ``n`` values up to each row."""
    return df.select("*", F.collect_list(value).over(_w(by, order).rowsBetween(-(n - 1), 0)).alias("history"))


def top_k(df: DataFrame, by: list[str], order: list[Column], k: int) -> DataFrame:
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("rank") <= k)
