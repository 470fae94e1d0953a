"""Spatial and temporal joins."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import DoubleType, StructField, StructType


def _bracketed(left: DataFrame, right: DataFrame, time: str, keep: list[str], by: list[str], bucket: int, strict: bool = False) -> DataFrame:
    """Left rows with the right rows at or before (``_p``) and at or behind (``_n``) their time, as structs of ``_t`` and ``keep``; ``strict``: only those at other (whole) times.

    Repeated right times count with the largest ``keep``. Rows are dealt out by key and time bucket, so one key may
    hold any share of them; what reaches over a bucket's edge comes from one summary row a bucket. What lies behind is the last
    row of the falling order: a frame that looks ahead to the end would be gone through again for every row.
    """
    cell = F.floor(F.col(time) / bucket).alias("_cell")
    r = right.select(*by, F.struct(F.col(time).alias("_t"), *keep).alias("_r"), cell)
    r = r.groupBy(*by, "_cell", F.col("_r._t").alias("_t")).agg(F.max("_r").alias("_r"))
    cells = r.groupBy(*by, "_cell").agg(F.min("_r").alias("_lo"), F.max("_r").alias("_hi"))
    cells = cells.unionByName(left.select(*by, cell).distinct(), allowMissingColumns=True).groupBy(*by, "_cell").agg(F.min("_lo").alias("_lo"), F.max("_hi").alias("_hi"))
    other = lambda c, order: F.last(c, True).over(Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, -1))
    edges = cells.select(*by, "_cell", other("_hi", F.asc("_cell")).alias("_before"), other("_lo", F.desc("_cell")).alias("_after"))
    both = left.select("*", cell, F.col(time).alias("_t")).unionByName(r, allowMissingColumns=True)
    inside = lambda order: F.last("_r", True).over(Window.partitionBy(*by, "_cell").orderBy(order).rangeBetween(Window.unboundedPreceding, -int(strict)))
    both = both.select("*", inside(F.asc("_t")).alias("_p"), inside(F.desc("_t")).alias("_n"))
    edges = edges.select(*(F.col(c).alias(f"_e_{c}") for c in [*by, "_cell"]), "_before", "_after")
    same = [F.col(c).eqNullSafe(F.col(f"_e_{c}")) for c in [*by, "_cell"]]  # null keys form a group of their own
    rows = both.where("_r is null").join(edges, reduce(Column.__and__, same), "left")
    return rows.select(*left.columns, F.coalesce("_p", "_before").alias("_p"), F.coalesce("_n", "_after").alias("_n"))


def asof_nearest(left: DataFrame, right: DataFrame, time: str, keep: list[str], by: list[str] | None = None, tolerance: int | None = None, bucket: int = 3_600_000_000) -> DataFrame:
    """Each left row with the right row nearest in time: columns ``keep`` as ``r_*`` and ``r_time``.

    Both directions, clamped at the ends, ties to the later row, repeated right times to the largest
    ``keep``. Rows beyond ``tolerance`` (strict) get nulls.
    """
    rows = _bracketed(left, right, time, keep, by or [], bucket)
    p, n, t = F.col("_p"), F.col("_n"), F.col(time)
    best = F.when(p.isNull(), n).when(n.isNull(), p).when(n["_t"] - t <= t - p["_t"], n).otherwise(p)
    if tolerance is not None:
        best = F.when(F.abs(best["_t"] - t) < tolerance, best)
    return rows.select(*left.columns, best.alias("_b")).select(*left.columns, F.col("_b._t").alias("r_time"), *(F.col(f"_b.{c}").alias(f"r_{c}") for c in keep))


def bracket_interpolate(left: DataFrame, right: DataFrame, time: str, value: str, by: list[str], unwrap: float | None = None, bucket: int = 3_600_000_000) -> DataFrame:
    """Linear interpolation of ``right``'s value at the left times, per key; beyond the ends: the end value.

    ``unwrap``: a period; a step of more than half of it counts as one the other way round.
    """
    both = _bracketed(left, right.select(*by, time, F.col(value).cast("double").alias("_v")), time, ["_v"], by, bucket)
    step = F.col("_n._v") - F.col("_p._v")
    if unwrap:
        step = step - F.when(step > unwrap / 2, unwrap).when(step < -unwrap / 2, -unwrap).otherwise(0.0)
    share = (F.col(time) - F.col("_p._t")) / (F.col("_n._t") - F.col("_p._t"))
    out = F.when(F.col("_p").isNull(), F.col("_n._v")).when(F.col("_n").isNull() | (F.col("_n._t") == F.col("_p._t")), F.col("_p._v")).otherwise(F.col("_p._v") + share * step)
    return both.select(*left.columns, out.alias(f"{value}_at"))


def _cells(prefix: str, r: float, dims: str) -> list[Column]:
    return [F.floor(F.col(prefix + d) / r).alias(f"_c{d}") for d in dims]


def radius_join(queries: DataFrame, points: DataFrame, radius_sq: float, by: list[str] | None = None, dims: str = "xyz") -> DataFrame:
    """Pairs at squared distance below ``radius_sq``: query columns, point columns as ``p_*``, ``d2``.

    Cells of the radius' edge turn the range into an equi-join: each query looks into its own and
    the neighbouring cells, the distance is then exact.
    """
    by, edge = by or [], radius_sq**0.5
    q = queries.select("*", *_cells("", edge, dims))
    for d in dims:
        q = q.withColumn(f"_c{d}", F.explode(F.sequence(F.col(f"_c{d}") - 1, F.col(f"_c{d}") + 1)))
    p = points.select(*(F.col(c).alias(f"p_{c}") for c in points.columns)).select("*", *_cells("p_", edge, dims))
    on = [q[b] == p[f"p_{b}"] for b in by] + [q[f"_c{d}"] == p[f"_c{d}"] for d in dims]
    d2 = sum((F.col(d) - F.col(f"p_{d}")) * (F.col(d) - F.col(f"p_{d}")) for d in dims)
    return q.join(p, reduce(Column.__and__, on)).select(*queries.columns, *(f"p_{c}" for c in points.columns), d2.alias("d2")).where(F.col("d2") < radius_sq)


_MOMENTS = ["n", *(f"s{i}" for i in range(3)), *(f"s{i}{j}" for i in range(3) for j in range(i, 3))]


def _moments_within(q: np.ndarray, p: np.ndarray, radius_sq: float, block: int = 1 << 20) -> np.ndarray:
    """For each query number, sums and sums of products of the offsets ``p - q`` of the points below the radius.

    Points lie sorted in small boxes: of a box that is wholly inside only its sums are taken, of one that is cut its points are tested.
    """
    p, weight = np.unique(p, axis=0, return_counts=True)
    origin, low, size = p[0], p.min(axis=0), np.ptp(p, axis=0)
    parts = max(1, round((len(p) / 48) ** (1 / 3)))
    cell = np.minimum((p - low) / np.where(size > 0, size, 1.0) * parts, parts - 1).astype(np.int64) @ np.array([parts * parts, parts, 1])
    order = np.argsort(cell, kind="stable")
    p, w, begin = p[order], weight[order].astype(float), np.unique(cell[order], return_index=True)[1]
    end = np.append(begin[1:], len(p))
    o = p - origin
    wo = w[:, None] * o
    terms = np.column_stack([w, wo, *(wo[:, i] * o[:, j] for i in range(3) for j in range(i, 3))])
    sums, lows, highs = (f.reduceat(x, begin, axis=0) for f, x in ((np.add, terms), (np.minimum, p), (np.maximum, p)))
    out, rows = np.zeros((len(q), 10)), max(1, block // len(begin))
    for at in range(0, len(q), rows):
        part = q[at : at + rows]
        near, far = np.zeros((len(part), len(begin))), np.zeros((len(part), len(begin)))
        for k in range(3):
            under, over = lows[None, :, k] - part[:, k, None], part[:, k, None] - highs[None, :, k]
            near += np.maximum(np.maximum(under, over), 0.0) ** 2
            far += np.maximum(-under, -over) ** 2
        inside = far < radius_sq * (1 - 1e-9)
        acc = inside.astype(float) @ sums
        cut = (near < radius_sq * (1 + 1e-9)) & ~inside
        for c in np.flatnonzero(cut.any(axis=0)):
            to, step = slice(begin[c], end[c]), max(1, block // (end[c] - begin[c]))
            mine = np.flatnonzero(cut[:, c])
            for first in range(0, len(mine), step):
                m = mine[first : first + step]
                dx, dy, dz = (part[m, k, None] - p[None, to, k] for k in range(3))
                acc[m] += (dx * dx + dy * dy + dz * dz < radius_sq).astype(float) @ terms[to]
        # from the common origin to the query's own place, such that copies of one point give zeros
        a = origin - part
        moved = acc[:, 1:4] + acc[:, :1] * a
        out[at : at + rows] = np.column_stack([acc[:, 0], moved, *(acc[:, 4 + n] + acc[:, 1 + i] * a[:, j] + a[:, i] * moved[:, j] for n, (i, j) in enumerate((i, j) for i in range(3) for j in range(i, 3)))])
    return out


def radius_moments(queries: DataFrame, points: DataFrame, radius_sq: float, ident: str, by: list[str], most: int = 50_000) -> DataFrame:
    """For each query ``by, ident`` the number ``n``, centroid ``m0 … m2`` and population covariance ``c00 … c22`` of the points at squared distance below ``radius_sq``; queries without any are left out.

    The same as grouping :func:`radius_join`, but no pair leaves the task: points are dealt out once by cells of the radius' edge (a cell
    with over ``most`` points makes more shares of each), queries to the cells that they reach; partial sums are added up afterwards.
    """
    edge, dims = radius_sq**0.5, "xyz"
    p = points.select(*(F.col(c).alias(f"_of_{c}") for c in by), *(F.col(d).cast("double").alias(f"_p{d}") for d in dims)).dropna()
    cells = [F.floor(F.col(f"_p{d}") / edge).alias(f"_p_c{d}") for d in dims]
    held = p.groupBy(*(f"_of_{c}" for c in by), *cells).count().agg(F.max("count")).first()[0] or 0
    shares = max(1, -(-held // most))
    p = p.select("*", *cells, F.pmod(F.xxhash64(*(f"_p{d}" for d in dims)), F.lit(shares)).alias("_p_share"))
    q = queries.select(*by, ident, *(F.col(d).cast("double").alias(d) for d in dims)).dropna()
    for d in dims:
        q = q.withColumn(f"_c{d}", F.explode(F.sequence(F.floor(F.col(d) / edge) - 1, F.floor(F.col(d) / edge) + 1)))
    gaps = [F.greatest(F.col(f"_c{d}") * edge - F.col(d), F.col(d) - (F.col(f"_c{d}") + 1) * edge, F.lit(0.0)) for d in dims]
    q = q.where(sum(x * x for x in gaps) < radius_sq * (1 + 1e-6)).withColumn("_share", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(shares - 1).cast("long"))))
    own = [f for f in q.schema.fields if f.name in [*by, ident, *dims]]
    schema = StructType([*own, *(StructField(c, DoubleType()) for c in _MOMENTS)])

    def run(near: pa.Table, here: pa.Table) -> pa.Table:
        if not near.num_rows or not here.num_rows:
            return schema_arrow.empty_table()
        at = lambda t, prefix: np.column_stack([t[prefix + d].to_numpy() for d in dims])
        sums = _moments_within(at(near, ""), at(here, "_p"), radius_sq)
        some = pa.array(np.flatnonzero(sums[:, 0]))
        return pa.table([*(near[f.name].take(some) for f in own), *(pa.array(c[sums[:, 0] > 0]) for c in sums.T)], schema=schema_arrow)

    schema_arrow = to_arrow_schema(schema)
    parts = q.groupBy(*by, *(f"_c{d}" for d in dims), "_share").cogroup(p.groupBy(*(f"_of_{c}" for c in by), *(f"_p_c{d}" for d in dims), "_p_share")).applyInArrow(run, schema)
    total = parts.groupBy(*by, ident).agg(*(F.min(d).alias(d) for d in dims), *(F.sum(c).alias(c) for c in _MOMENTS))
    mean = [F.col(f"s{i}") / F.col("n") for i in range(3)]
    spread = [(F.col(f"s{i}{j}") / F.col("n") - mean[i] * mean[j]).alias(f"c{i}{j}") for i in range(3) for j in range(i, 3)]
    return total.select(*by, ident, F.col("n").cast("long").alias("n"), *((F.col(d) + m).alias(f"m{i}") for i, (d, m) in enumerate(zip(dims, mean, strict=True))), *spread)


def knn_join(queries: DataFrame, points: DataFrame, k: int, radius_sq: float, query_id: str, point_id: str, by: list[str] | None = None, dims: str = "xyz") -> DataFrame:
    """The ``k`` nearest points of each query below ``radius_sq``, exact; ``rank`` from 1, ties by point id."""
    pairs = radius_join(queries, points, radius_sq, by, dims)
    w = Window.partitionBy(*(by or []), query_id).orderBy("d2", f"p_{point_id}")
    return pairs.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def _fitting_edge(points: DataFrame, longest: float, most: float, by: list[str], dims: str) -> float:
    """The longest of ``longest``, its half, its quarter … whose cells hold no more than ``most`` other points in the mean over the points (eight lengths a pass; only those means reach the driver)."""
    for begin in range(0, 48, 8):
        cells = points.select(*by, *dims, F.explode(F.sequence(F.lit(begin), F.lit(begin + 7))).alias("_l"))
        cells = cells.groupBy(*by, "_l", *(F.floor(F.col(d) / (longest * F.pow(F.lit(0.5), F.col("_l")))).alias(f"_c{d}") for d in dims)).agg(F.count("*").alias("_n"))
        held = {r["_l"]: r["_m"] for r in cells.groupBy("_l").agg((F.sum(F.col("_n") * (F.col("_n") - 1)) / F.sum("_n")).alias("_m")).collect()}
        fit = [level for level in sorted(held) if held[level] <= most]
        if fit or not held:
            return longest * 0.5 ** (fit[0] if fit else 0)
    return longest * 0.5**47


def knn_grown(queries: DataFrame, points: DataFrame, k: int, radius_sq: float, query_id: str, point_id: str, by: list[str] | None = None, dims: str = "xyz", where: Column | None = None, spare: int = 0, alike: list[str] | None = None, most: float | None = None) -> DataFrame:
    """:func:`knn_join` for points that lie far more densely than the radius: the same rows, at a cost that grows with the queries and not with the pairs.

    Cells begin at a length that fits the points' density and double up to the radius. A round reaches as far as its cells are long, so a
    query that finds ``k`` points in it has its nearest ones and is done; only the others go on. ``where`` (of query columns and ``p_*``) says which pairs count. Of
    copies of a point only the ``k + spare`` first can be among the nearest: ``spare`` is how many ``where`` may leave out by their id; besides it may only
    use columns named in ``alike``, which copies must share.
    """
    from ..storage import written

    by, longest = by or [], radius_sq**0.5
    copies = Window.partitionBy(*by, *(alike or []), *dims).orderBy(point_id)
    points = written(points.withColumn("_copy", F.row_number().over(copies)).where(F.col("_copy") <= k + spare).drop("_copy"), "places")
    edge = _fitting_edge(points, longest, k if most is None else most, by, dims)
    key, left, done = [*by, query_id], queries, None
    w = Window.partitionBy(*key).orderBy("d2", f"p_{point_id}")
    while True:
        pairs = radius_join(left, points, min(edge * edge, radius_sq) if edge < longest else radius_sq, by, dims)
        near = (pairs if where is None else pairs.where(where)).withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
        near = written(near, "nearest")
        if edge >= longest:
            return near if done is None else done.unionByName(near)
        full = near.where(F.col("rank") == k).select(*key)
        near = near.join(full, key, "left_semi")
        done = near if done is None else done.unionByName(near)
        left = written(left.join(full, key, "left_anti"), "open")
        if left.isEmpty():
            return done
        edge *= 2


def contains(dims: str = "xyz") -> Column:
    """The point ``x, y, z`` lies in the box with centre ``c*`` and half-lengths ``h*``, faces included."""
    return reduce(Column.__and__, [F.abs(F.col(d) - F.col(f"c{d}")) <= F.col(f"h{d}") for d in dims])


def contains_oriented(point: list[Column], centre: Column, axes: Column, half: Column) -> Column:
    """Arrays: the point's offset along each of three unit axes is at most the half-length."""
    dot = lambda k: sum((point[i] - centre[i]) * axes[3 * k + i] for i in range(3))
    return reduce(Column.__and__, [F.abs(dot(k)) <= half[k] for k in range(3)])


def box_cells(boxes: DataFrame, frame: str = "frame") -> DataFrame:
    """Grid cells of boxes for :func:`by_boxes`: one row a cell that a box fills (no box columns), and the boxes that reach into other cells.

    A cell's edge is a quarter to an eighth of the box's longest side, so a box lies in at most a thousand cells. Where boxes lie densely, cells are mostly filled and
    their boxes drop out.
    """
    from ..storage import written

    sides = [f"{p}{d}" for p in "ch" for d in "xyz"]
    level = F.ceil(F.log2(F.greatest("hx", "hy", "hz", F.lit(1e-6)))).cast("int") - 2
    b = boxes.select(F.col(frame).alias("_f"), *sides, level.alias("_level")).withColumn("_edge", F.pow(F.lit(2.0), F.col("_level")))
    low, high = ({d: (F.col(f"c{d}") + s * F.col(f"h{d}")) / F.col("_edge") for d in "xyz"} for s in (-1, 1))
    for d in "xyz":
        b = b.withColumn(f"_c{d}", F.explode(F.sequence(F.floor(low[d] - 1e-6), F.floor(high[d] + 1e-6))))
    filled = reduce(Column.__and__, [(F.col(f"_c{d}") > low[d] + 1e-6) & (F.col(f"_c{d}") + 1 < high[d] - 1e-6) for d in "xyz"])
    keys = ["_f", "_level", "_cx", "_cy", "_cz"]
    full = written(b.where(filled).select(*keys).distinct(), "filled")
    part = b.where(~filled).select(*keys, *sides).join(full, keys, "left_anti")
    return written(full.unionByName(part, allowMissingColumns=True), "boxes")


def by_boxes(points: DataFrame, cells: DataFrame, frame: str = "frame", inside: bool = True) -> DataFrame:
    """Points in some box of their frame, or (not ``inside``) in none; ``cells`` from :func:`box_cells`. An equi-join on cells; the test by the box is then exact."""
    found, number = [], reduce(Column.__and__, [~F.isnan(d) for d in "xyz"])
    for level in sorted(r[0] for r in cells.select("_level").distinct().collect() if r[0] is not None):
        here = cells.where(F.col("_level") == level).drop("_level")
        on = reduce(Column.__and__, [F.floor(F.col(d) / 2.0**level) == F.col(f"_c{d}") for d in "xyz"], F.col(frame) == F.col("_f"))
        on = on & F.when(F.col("cx").isNull(), number).otherwise(contains())
        found.append(points.join(here, on, "left_semi"))
        points = points.join(here, on, "left_anti")
    return points if not inside else reduce(DataFrame.unionByName, found) if found else points.where("false")


def box_anti(points: DataFrame, boxes: DataFrame, frame: str = "frame", min_conf: float | None = None, missing_labels: str = "drop", labelled: DataFrame | None = None) -> DataFrame:
    """Points in no box of their frame. ``missing_labels``: whether frames without any label row are dropped or kept whole."""
    if missing_labels not in ("drop", "keep"):
        raise ValueError(missing_labels)
    frames = (boxes if labelled is None else labelled).select(frame).distinct()
    out = by_boxes(points, box_cells(boxes if min_conf is None else boxes.where(F.col("conf") > min_conf), frame), frame, inside=False)
    return out.join(frames, frame, "left_semi") if missing_labels == "drop" else out


def first_match(cells: DataFrame, frames: DataFrame, visible: DataFrame, ident: list[str], at: str, by: list[str], skip_adjacent_backward: bool = True, backward_first: bool = False, bucket: int = 4096) -> DataFrame:
    """For each cell the first frame along time in which it is visible: column ``source``.

    ``by`` names the sequence (one vehicle, one video) and is part of all three tables; ``at`` is an integer. Forward frames come
    first in rising order, then backward ones in falling order (or the other way round); no match
    gives the cell's own frame. The backward search passes over the frame right before the cell's
    own, as the reference semantics do, unless told not to. A cell that all frames see is dealt out by ``bucket`` frames.
    """
    w = Window.partitionBy(*by).orderBy(at)
    near = frames.select(*by, at).distinct().select(*by, at, (F.lag(at).over(w) if skip_adjacent_backward else F.lit(None).cast("long")).alias("_adjacent"))
    key = [*by, *ident]
    seen = visible.select(*key, at).distinct()
    # each sighting with the one before it, then each cell with the sightings on both sides
    seen = _bracketed(seen, seen, at, [], key, bucket, True).select(*key, at, F.col("_p._t").alias("_earlier"))
    both = _bracketed(cells.join(near, [*by, at], "left"), seen, at, ["_earlier"], key, bucket, True)
    back = F.when(F.col("_p._t") == F.col("_adjacent"), F.col("_p._earlier")).otherwise(F.col("_p._t"))
    found = (back, F.col("_n._t")) if backward_first else (F.col("_n._t"), back)
    return both.select(*cells.columns, F.coalesce(*found, F.col(at)).alias("source"))


def align(left: DataFrame, right: DataFrame, time: str, bound: int, keep: list[str], by: list[str]) -> DataFrame:
    """Pairs of two streams less than ``bound`` apart (strict): an equi-join on time cells of that width."""
    l = left.withColumn("_cell", F.floor(F.col(time) / bound))  # noqa: E741
    r = right.select(*by, F.col(time).alias("r_time"), *(F.col(c).alias(f"r_{c}") for c in keep))
    r = r.withColumn("_cell", F.explode(F.sequence(F.floor(F.col("r_time") / bound) - 1, F.floor(F.col("r_time") / bound) + 1)))
    return l.join(r, [*by, "_cell"]).where(F.abs(F.col(time) - F.col("r_time")) < bound).drop("_cell")


def align_all(base: DataFrame, others: dict[str, DataFrame], time: str, bound: int, keep: list[str], by: list[str]) -> DataFrame:
    """Base rows for which every other stream has a row less than ``bound`` away (strict), with each stream's newest such row as ``<name>_time`` and ``<name>_*``.

    All joins are on key and time, so the base is shuffled once. Rows of one time: the largest ``keep``.
    """
    moments, out = base.select(*by, time).distinct(), base
    for name, other in others.items():
        near = align(moments, other, time, bound, keep, by)
        newest = near.groupBy(*by, time).agg(F.max(F.struct("r_time", *(f"r_{c}" for c in keep))).alias("_m"))
        out = out.join(newest.select(*by, time, F.col("_m.r_time").alias(f"{name}_time"), *(F.col(f"_m.r_{c}").alias(f"{name}_{c}") for c in keep)), [*by, time])
    return out


def last_value(left: DataFrame, right: DataFrame, time: str, keep: list[str], by: list[str], bucket: int = 3_600_000_000) -> DataFrame:
    """Each left row with the newest right row at or before it, per key."""
    rows = _bracketed(left, right, time, keep, by, bucket)
    return rows.select(*left.columns, *(F.col(f"_p.{c}").alias(f"r_{c}") for c in keep))


def ring_neighbours(queries: DataFrame, points: DataFrame, radius_sq: float = 25.0, band: float = 2.5) -> DataFrame:
    """For each query the nearest point, and the nearest ones in the same ring or below and in higher rings, within ``band`` rings of the nearest (the whole band is searched).

    Three searches by growing cells: the nearest; its ring alone; the rings beside it.
    """
    key, others = ["frame", "pt"], F.col("p_pt") != F.col("pt")
    near = knn_grown(queries, points, 1, radius_sq, "pt", "pt", ["frame"], where=others, spare=1)
    near = near.select(*key, "x", "y", "z", F.col("p_pt").alias("near"), F.col("p_ring").alias("ring"))
    others = others & (F.col("p_pt") != F.col("near"))
    same = knn_grown(near, points, 1, radius_sq, "pt", "pt", ["frame", "ring"], where=others, spare=2)
    beside = (F.col("p_ring") != F.col("near_ring")) & (F.abs(F.col("p_ring") - F.col("near_ring")) <= band)
    other = knn_grown(near.withColumnRenamed("ring", "near_ring"), points, 1, radius_sq, "pt", "pt", ["frame"], where=others & beside, spare=2, alike=["ring"], most=4.0)
    return near.select(*key, "near").join(same.select(*key, F.col("p_pt").alias("same")), key, "left").join(other.select(*key, F.col("p_pt").alias("other")), key, "left")


def rasterize(triangles: DataFrame) -> DataFrame:
    """Pixels strictly inside triangles ``tri, ax, ay, bx, by, cx, cy`` with their barycentric weights.

    Row by row: a row's pixels lie between the places where the edges cross it, so a sliver costs its own pixels and not those of the box around it.
    """
    from ..functions.scalars import barycentric

    edges = [tuple(F.col(f"{p}{d}") for p in ends for d in "xy") for ends in ("ab", "bc", "ca")]
    row = F.explode(F.sequence(F.floor(F.least("ay", "by", "cy")), F.ceil(F.greatest("ay", "by", "cy"))))
    at = lambda ax, ay, bx, by: F.when((F.least(ay, by) <= F.col("v")) & (F.col("v") <= F.greatest(ay, by)), F.when(ay == by, ax).otherwise(ax + (F.col("v") - ay) * F.try_divide(bx - ax, by - ay)))
    t = triangles.withColumn("v", row)
    # a level edge counts by its ends, which the other two edges have as well
    t = t.select("*", *(f(*(at(*e) for e in edges)).alias(n) for f, n in ((F.least, "_from"), (F.greatest, "_to")))).where("_from is not null")
    t = t.withColumn("u", F.explode(F.sequence(F.floor(F.col("_from") - 1e-3), F.ceil(F.col("_to") + 1e-3))))
    w = barycentric((F.col("u"), F.col("v")), *((F.col(f"{k}x"), F.col(f"{k}y")) for k in "abc"))
    return t.select("tri", "u", "v", *(x.alias(f"w{k}") for k, x in enumerate(w))).where("w0 > 0 and w1 > 0 and w2 > 0")
