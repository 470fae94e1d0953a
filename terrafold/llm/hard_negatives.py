"""Hard negatives by dual-tree search.

Ball trees stand over the anchors and over the candidates: halving hyperplanes fitted on bounded samples, every row
routed to its leaf, balls around all rows of a node. The inner product of two balls' members lies within
``a.c ± (ra |c| + rc |a| + ra rc)``, so one interval settles a pair of nodes, whatever they hold. Both trees are walked down
together, and a pair of nodes goes if no anchor below can use a candidate below; the pairs of leaves that stay are scored exactly.

A search goes in rounds: each leaf of anchors meets its most promising leaf of candidates, then the next 8, the next 64 and
so on. What a round finds is what later ones must reach, so the trees are walked again before each, and a round hands on at most about 8
times what is kept. The first search finds the positives, which set the bands of the second.
Leaves are dealt out in pieces of bounded size. Of candidates with one vector and label only so many of the smallest ids can be
returned, so only these are searched.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import IntegerType, StructField, StructType

from .common import arrow_schema, materialize
from .vectors import matrix, whole_vectors

#: Rows that a tree's hyperplanes are fitted on, and its levels at most.
SAMPLE, LEVELS = 8_000, 11
#: Each round meets so many times the leaves of the one before.
GROWTH = 8
_FOUND = "anchor long, place int, score long, vec_id long"
_ENDS = -(1 << 63), (1 << 63) - 1


@dataclass(frozen=True)
class Tree:
    """A full binary tree in level order: the hyperplane of each inner node, balls of all nodes (``count`` 0: an empty one), pieces of the leaves."""

    levels: int
    direction: np.ndarray
    offset: np.ndarray
    centre: np.ndarray | None = None
    radius: np.ndarray | None = None
    count: np.ndarray | None = None
    pieces: np.ndarray | None = None

    def leaf(self, x: np.ndarray) -> np.ndarray:
        at = np.zeros(len(x), np.int64)
        for _ in range(self.levels):
            at = 2 * at + 1 + ((x * self.direction[at]).sum(axis=1) > self.offset[at])
        return at - (2**self.levels - 1)


def planted(sample: np.ndarray, levels: int) -> Tree:
    """Each node is halved at the median along the line through two members far apart."""
    inner, d = 2**levels - 1, sample.shape[1]
    direction, offset = np.zeros((inner, d)), np.zeros(inner)
    held = {0: sample}
    for at in range(inner):
        x = held.pop(at)
        if len(x):
            a = x[np.argmax(((x - x.mean(axis=0)) ** 2).sum(axis=1))]
            b = x[np.argmax(((x - a) ** 2).sum(axis=1))]
            direction[at] = (b - a) / (np.linalg.norm(b - a) or 1.0)
            along = (x * direction[at]).sum(axis=1)
            offset[at] = np.median(along)
            side = along > offset[at]
            held[2 * at + 1], held[2 * at + 2] = x[~side], x[side]
        else:
            held[2 * at + 1] = held[2 * at + 2] = x
    return Tree(levels, direction, offset)


def grown(rows: DataFrame, d: int, leaf_rows: int, name: str) -> tuple[Tree, DataFrame]:
    """A tree over rows with ``vec_id`` and, last, ``x``; and the rows with their ``leaf`` and ``piece`` of about ``leaf_rows`` rows."""
    n = rows.count()
    levels = min(LEVELS, max(0, int(np.ceil(np.log2(max(n, 1) / leaf_rows)))))
    sample = rows.orderBy(F.xxhash64("vec_id", "x")).limit(SAMPLE).select("x").toPandas()["x"] if levels else []
    tree = planted(np.array([np.asarray(v, float) for v in sample]).reshape(-1, d), levels)
    schema = StructType([*rows.schema.fields, StructField("leaf", IntegerType())])
    kind = to_arrow_schema(schema)

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(tree.leaf(matrix(batch.column(batch.num_columns - 1), d).astype(float)), pa.int32())], schema=kind)

    routed = materialize(rows.mapInArrow(route, schema), name)
    shape = arrow_schema(rows.sparkSession, "leaf int, n long, total array<double>")

    def centres(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total = np.zeros(2**levels, np.int64), np.zeros((2**levels, d))
        for batch in batches:
            leaf = batch.column(0).to_numpy()
            held = np.bincount(leaf, minlength=2**levels)
            n += held
            own, order = np.flatnonzero(held), np.argsort(leaf, kind="stable")
            if len(own):
                total[own] += np.add.reduceat(matrix(batch.column(1), d)[order].astype(float), (np.cumsum(held) - held)[own], axis=0)
        own = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(own, pa.int32()), pa.array(n[own]), pa.array(list(total[own]), shape.field(2).type)], schema=shape)

    # one row a leaf and task; what the driver gets is bounded by the leaves, not the rows
    parts = routed.select("leaf", "x").mapInArrow(centres, "leaf int, n long, total array<double>").select("leaf", "n", F.posexplode("total").alias("at", "v"))
    count, centre = np.zeros(2**levels, np.int64), np.zeros((2**levels, d))
    for r in parts.groupBy("leaf", "at").agg(F.sum("n").alias("n"), F.sum("v").alias("v")).toLocalIterator():
        count[r.leaf], centre[r.leaf, r["at"]] = r.n, r.v / r.n

    def distances(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        far = np.full(2**levels, -1.0)
        for batch in batches:
            leaf = batch.column(0).to_numpy()
            np.maximum.at(far, leaf, np.sqrt(((matrix(batch.column(1), d) - centre[leaf]) ** 2).sum(axis=1)))
        own = np.flatnonzero(far >= 0)
        yield pa.RecordBatch.from_arrays([pa.array(own, pa.int32()), pa.array(far[own])], names=["leaf", "far"])

    radius = np.zeros(2**levels)
    for r in routed.select("leaf", "x").mapInArrow(distances, "leaf int, far double").groupBy("leaf").agg(F.max("far").alias("far")).collect():
        radius[r.leaf] = r.far
    # the pieces of a leaf, in which a group of copies is spread by id
    pieces = np.maximum(1, -(-count // leaf_rows))
    sizes = rows.sparkSession.createDataFrame([(k, int(p)) for k, p in enumerate(pieces)], "leaf int, pieces int")
    routed = routed.join(F.broadcast(sizes), "leaf").withColumn("piece", F.pmod(F.xxhash64("vec_id"), F.col("pieces")).cast("int"))
    return replace(_balls(tree, centre, radius, count), pieces=pieces), routed


def _balls(tree: Tree, centre: np.ndarray, radius: np.ndarray, count: np.ndarray) -> Tree:
    """The tree with its leaves' balls, and the inner nodes' from their children's, up to the root."""
    nodes = [(centre, radius, count)]
    for _ in range(tree.levels):
        c, r, n = nodes[0]
        left, right = slice(0, None, 2), slice(1, None, 2)
        both = n[left] + n[right]
        mid = (c[left] * n[left, None] + c[right] * n[right, None]) / np.maximum(both, 1)[:, None]
        reach = np.maximum(*(np.where(n[s] > 0, np.linalg.norm(c[s] - mid, axis=1) + r[s], 0.0) for s in (left, right)))
        nodes.insert(0, (mid, reach, both))
    return Tree(tree.levels, tree.direction, tree.offset, *(np.concatenate(v) for v in zip(*nodes, strict=True)))


def interval(a: Tree, i: np.ndarray, c: Tree, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bounds of the inner products of members of nodes ``i`` and ``j``, a little wider than exact."""
    middle = (a.centre[i] * c.centre[j]).sum(axis=1)
    na, nc = np.linalg.norm(a.centre[i], axis=1), np.linalg.norm(c.centre[j], axis=1)
    spread = a.radius[i] * nc + c.radius[j] * na + a.radius[i] * c.radius[j]
    spread = spread + 1e-9 * (na * nc + spread) + 1e-6
    return middle - spread, middle + spread


def walked(a: Tree, c: Tree, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The pairs of leaves whose intervals meet ``[low, high]`` of the anchors' leaf, both trees walked down together."""
    first = 2**a.levels - 1
    lows, highs = (np.full(2 ** (a.levels + 1) - 1, v) for v in (np.inf, -np.inf))
    lows[first:], highs[first:] = low, high
    for at in range(first - 1, -1, -1):
        lows[at], highs[at] = min(lows[2 * at + 1], lows[2 * at + 2]), max(highs[2 * at + 1], highs[2 * at + 2])
    i, j, done_i, done_j = np.zeros(1, np.int64), np.zeros(1, np.int64), a.levels == 0, c.levels == 0
    while True:
        under, over = interval(a, i, c, j)
        keep = (a.count[i] > 0) & (c.count[j] > 0) & (over >= lows[i]) & (under <= highs[i])
        i, j = i[keep], j[keep]
        if done_i and done_j or not len(i):
            return i - first, j - (2**c.levels - 1)
        if not done_i:
            i, j = np.concatenate([2 * i + 1, 2 * i + 2]), np.concatenate([j, j])
            done_i = bool(i.min() >= first)
        if not done_j:
            i, j = np.concatenate([i, i]), np.concatenate([2 * j + 1, 2 * j + 2])
            done_j = bool(j.min() >= 2**c.levels - 1)


def scores(a: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Exact inner products: as doubles where every sum of products fits them, else as longs."""
    most = float(np.abs(a.astype(float)).max(initial=0)) * float(np.abs(c.astype(float)).max(initial=0)) * a.shape[1]
    return (a.astype(float) @ c.astype(float).T).astype(np.int64) if most < 2.0**53 else a @ c.T


def best(score: np.ndarray, ids: np.ndarray, fits: np.ndarray, k: int) -> np.ndarray:
    """The places of the first ``k`` that fit, by falling score, then rising id."""
    at = np.flatnonzero(fits)
    if len(at) > k:
        edge = np.partition(score[at], len(at) - k)[len(at) - k]
        at = at[score[at] >= edge]
    return at[np.lexsort((ids[at], -score[at]))][:k]


def _scored(anchors: DataFrame, candidates: DataFrame, pairs: tuple[np.ndarray, ...], d: int, same: bool, k: int) -> DataFrame:
    """Of each pair of leaves' pieces the ``k`` best a band. ``pairs``: the leaves and their numbers of pieces; a band's ``floor``: the score that its k-th has already."""
    session = anchors.sparkSession
    leaves = session.createDataFrame(list(zip(*(p.tolist() for p in pairs), strict=True)), "leaf int, c_leaf int, pieces int, c_pieces int")
    c = candidates.select(F.col("leaf").alias("c_leaf"), F.col("piece").alias("c_piece"), "vec_id", "label", "x")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    met = leaves.withColumn("piece", each("pieces")).withColumn("c_piece", each("c_pieces")).drop("pieces", "c_pieces")
    key = ["leaf", "piece", "c_leaf", "c_piece"]
    left = anchors.join(met, ["leaf", "piece"]).select(*key, "row", "vec_id", "label", "x", "bands")
    right = c.join(met, ["c_leaf", "c_piece"]).select(*(F.col(k).alias(f"to_{k}") for k in key), *(F.col(n).alias(f"c_{n}") for n in ("vec_id", "label", "x")))
    kind = arrow_schema(session, _FOUND)

    def meet(a: pa.Table, b: pa.Table) -> pa.Table:
        ids, labels = b.column("c_vec_id").to_numpy(), b.column("c_label").to_numpy()
        found: list[tuple] = []
        if len(a) and len(b):
            s = scores(*(matrix(x.combine_chunks(), d) for x in (a.column("x"), b.column("c_x"))))
            for line, row, anchor, label, bands in zip(s, *(a.column(n).to_pylist() for n in ("row", "vec_id", "label", "bands")), strict=True):
                allowed = (labels == label) == same
                if same:
                    allowed &= ids != anchor
                for band in bands:
                    at = best(line, ids, allowed & (line >= max(band["low"], band["floor"])) & (line <= band["high"]), k)
                    found += zip([row] * len(at), [band["place"]] * len(at), line[at].tolist(), ids[at].tolist(), strict=True)
        return pa.table([pa.array(v, f.type) for v, f in zip(zip(*found, strict=True) if found else [[]] * 4, kind, strict=True)], schema=kind)

    return left.groupBy(*key).cogroup(right.groupBy(*(f"to_{k}" for k in key))).applyInArrow(meet, _FOUND)


def _first(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("anchor", "place").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def search(a: Tree, anchors: DataFrame, c: Tree, candidates: DataFrame, d: int, same: bool, k: int) -> DataFrame:
    """The first ``k`` candidates of each anchor's bands: ``anchor, place, score, vec_id, rank``. ``anchors`` has a ``row`` number and ``bands array<struct<place: int, low: long, high: long>>``."""
    ends = anchors.select("leaf", F.explode("bands").alias("b")).groupBy("leaf").agg(F.min("b.low").alias("low"), F.max("b.high").alias("high")).collect()
    low, high = np.full(2**a.levels, np.inf), np.full(2**a.levels, -np.inf)
    for r in ends:
        low[r.leaf], high[r.leaf] = r.low, r.high
    first_a, first_c = 2**a.levels - 1, 2**c.levels - 1
    now = anchors.withColumn("bands", F.transform("bands", lambda b: F.struct(b["place"], b["low"], b["high"], F.lit(_ENDS[0]).alias("floor"))))
    found, done, size = None, np.zeros(0, np.int64), 1
    while True:
        i, j = walked(a, c, low, high)
        left = ~np.isin(i << c.levels | j, done)
        i, j = i[left], j[left]
        if not len(i):
            break
        # of each leaf of anchors first those whose middle comes highest within the bands
        middle = (a.centre[first_a + i] * c.centre[first_c + j]).sum(axis=1)
        order = np.lexsort((-np.minimum(middle, high[i]), i))
        i, j = i[order], j[order]
        turn = np.arange(len(i)) - np.searchsorted(i, i)
        own, other = i[turn < size], j[turn < size]
        more = _scored(now, candidates, (own, other, a.pieces[own], c.pieces[other]), d, same, k)
        found = materialize(_first(more if found is None else found.drop("rank").unionByName(more), k), "found")
        if len(own) == len(i):
            break
        done, size = np.append(done, own << c.levels | other), size * GROWTH
        # what a band has k of already is its floor; a leaf of anchors must reach the lowest of its bands
        have = found.where(F.col("rank") == k).groupBy(F.col("anchor").alias("row")).agg(F.map_from_entries(F.collect_list(F.struct("place", "score"))).alias("have"))
        floor = lambda b: F.coalesce(F.try_element_at("have", b["place"]), F.lit(_ENDS[0])).alias("floor")
        now = anchors.join(have, "row", "left").withColumn("bands", F.transform("bands", lambda b: F.struct(b["place"], b["low"], b["high"], floor(b))))
        now = materialize(now.drop("have"), "raised")
        for r in now.select("leaf", F.explode("bands").alias("b")).groupBy("leaf").agg(F.min(F.greatest("b.low", "b.floor")).alias("low")).collect():
            low[r.leaf] = r.low
    return found if found is not None else anchors.sparkSession.createDataFrame([], f"{_FOUND}, rank int")


def hard_negatives(rows: DataFrame, anchor, positives: int = 5, negatives: int = 10, low: int = 30, high: int = 90, leaf_rows: int = 1024, anchor_rows: int = 256, id_col: str = "vec_id", vector_col: str = "embedding", label=None) -> DataFrame:
    """``anchor_id, positive_id, rank, negative_id, positive_score, negative_score`` for the rows that ``anchor`` (a condition) marks.

    Positives: the first ``positives`` other rows of the anchor's label. Negatives: for each the first ``negatives`` rows of another
    label with ``low * positive_score <= 100 * negative_score <= high * positive_score``. Scores are inner products of the whole-number
    vectors; higher come first, ties by smaller id. ``label``: a column in the label's place.

    Rows with a null id, label or vector, or no whole vector, take no part. Repeated rows (id, label and vector) count once, and a
    row isn't another row for one of its own id. Anchors without positives or positives without negatives give no rows, nor do empty tables.
    """
    keep = [F.col(f"`{id_col}`").cast("long").alias("vec_id"), (F.col("label") if label is None else label).cast("long").alias("label"), F.coalesce(anchor, F.lit(False)).alias("anchor")]
    whole = materialize(whole_vectors(rows, vector_col, keep).where("vec_id is not null and label is not null").distinct(), "whole")
    head, session = whole.first(), rows.sparkSession
    schema = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    if head is None:
        return session.createDataFrame([], schema)
    d = len(head.x)
    # of one vector and label the smallest ids: the anchor's own and those that can be returned
    twins = Window.partitionBy("label", "x").orderBy("vec_id")
    fewer = materialize(whole.withColumn("twin", F.row_number().over(twins)).where(F.col("twin") <= max(positives, negatives) + 1).drop("twin", "anchor"), "fewer")
    c, candidates = grown(fewer, d, leaf_rows, "candidates")
    # rows of one id and different vectors or labels are anchors of their own
    numbered = materialize(whole.where("anchor").select(F.monotonically_increasing_id().alias("row"), "vec_id", "label", "x"), "anchors")
    a, anchors = grown(numbered, d, anchor_rows, "routed")
    anywhere = F.array(F.struct(F.lit(0).alias("place"), F.lit(_ENDS[0]).alias("low"), F.lit(_ENDS[1]).alias("high")))
    near = search(a, anchors.withColumn("bands", anywhere), c, candidates, d, True, positives)
    near = near.select(F.col("anchor").alias("row"), F.col("rank").alias("place"), F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score"))
    edge = F.struct("place", F.expr(f"(positive_score * {low} + 99) div 100").alias("low"), F.expr(f"positive_score * {high} div 100").alias("high"))
    bands = near.where("positive_score >= 0").groupBy("row").agg(F.collect_list(edge).alias("bands"))
    banded = materialize(anchors.join(bands, "row"), "banded")
    found = search(a, banded, c, candidates, d, False, negatives)
    out = found.select(F.col("anchor").alias("row"), "place", "rank", F.col("vec_id").alias("negative_id"), F.col("score").alias("negative_score"))
    ids = anchors.select("row", F.col("vec_id").alias("anchor_id"))
    return out.join(near, ["row", "place"]).join(ids, "row").select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
