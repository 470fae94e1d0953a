"""SimHash near-duplicates by anchor-point covering.

Anchors are the words of the perfect Hamming code on bits 1..63; bit 0 plays no part in them. Every
fingerprint lies within radius 1 of exactly one anchor. Fingerprints at distance ``t <= 2`` have a
point between them at distance at most 1 from both, and the anchor that covers that point is
within 1 + 1 = 2 of both. So a fingerprint goes to every anchor within the covering radius plus half
the threshold: the 32 anchors at distance 2 or less (the fingerprint's own if it is one). All links
are found, and an anchor can hold at most 2 * (1 + 63 + 63 * 31) = 4,034 different fingerprints,
whatever the size of the input.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import arrow_schema, components, materialize, per_document

#: Shingles that are turned to bits at once.
STEP = 1 << 14


def fingerprint(text: bytes, size: int = 3, seed: int = 42) -> int:
    """A bit is 1 if it is set in over half of the hashes of the text's shingles, repeats included; no words: zero."""
    words = text.lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    starts = (ends - np.fromiter(map(len, words), np.int64, len(words)) - 1).tolist()
    last = (ends - 1)[min(size, len(words)) - 1 :].tolist()
    digest = xxhash.xxh64_intdigest
    ones, n = np.zeros(64, np.int64), len(last)
    for at in range(0, n, STEP):
        h = np.array([digest(joined[a:b], seed) for a, b in zip(starts[at : at + STEP], last[at : at + STEP])], "<u8")
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, size: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id``, ``fp`` (the fingerprint's 64 bits as a signed long) per row."""

    def make():
        return lambda texts: [np.array([fingerprint(t, size) for t in texts], np.uint64).view(np.int64)]

    return per_document(docs, make, "fp long", id_col, text_col)


def anchors(fp: Column) -> Column:
    """The anchors within distance 2: flip the bits ``i`` and ``i xor s`` of every pair, s the xor of the places of the set bits (flipping place 0 means none). Bit 0 plays no part in an anchor."""
    fp = fp.bitwiseAND(F.lit(-2).cast("long"))
    s = F.lit(0)
    for k in range(6):
        mask = sum(1 << i for i in range(1, 64) if i >> k & 1)
        s = s + F.bit_count(fp.bitwiseAND(F.lit(mask - (1 << 64) if mask >> 63 else mask))) % 2 * (1 << k)

    def flip(i: Column) -> Column:
        return F.when(i == 0, F.lit(0).cast("long")).otherwise(F.call_function("shiftleft", F.lit(1).cast("long"), i.cast("int")))

    def pairs(t: Column) -> Column:
        return F.transform(F.filter(F.sequence(F.lit(0), F.lit(63)), lambda i: i < i.bitwiseXOR(t)), lambda i: fp.bitwiseXOR(flip(i)).bitwiseXOR(flip(i.bitwiseXOR(t))))

    return F.when(s == 0, F.array(fp)).otherwise(pairs(s.cast("int")))


def linked(fps: np.ndarray, threshold: int) -> np.ndarray:
    """For an anchor's fingerprints (at most 4,034), the smallest one that each reaches over links."""
    n = len(fps)
    fps = np.sort(fps)
    bits = fps.view(np.uint64)  # bitwise_count takes the absolute value of signed numbers
    root = np.arange(n)

    def top(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    for i in range(n - 1):
        for j in np.flatnonzero(np.bitwise_count(bits[i + 1 :] ^ bits[i]) <= threshold):
            a, b = top(i), top(i + 1 + int(j))
            if a != b:
                root[max(a, b)] = min(a, b)
    return np.stack([fps, fps[[top(i) for i in range(n)]]])


def links(distinct: DataFrame, threshold: int = 2) -> DataFrame:
    """A spanning forest ``(a, b)`` of the links between different fingerprints of column ``fp``: its components are those of all links."""
    if not 0 <= threshold <= 2:
        raise ValueError("the Hamming code with radius 1 covers thresholds up to 2")
    # 32 rows come of each: dealt out first, or a few small files would be as many tasks
    parts = int(distinct.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    groups = distinct.repartition(parts, "fp").select("fp", F.explode(anchors(F.col("fp"))).alias("anchor")).groupBy("anchor").agg(F.collect_list("fp").alias("fps")).where(F.size("fps") > 1)
    schema = arrow_schema(distinct.sparkSession, "a long, b long")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for group in batch.column(0):
                fps, roots = linked(np.asarray(group.values), threshold)
                keep = fps != roots
                yield pa.RecordBatch.from_arrays([pa.array(fps[keep]), pa.array(roots[keep])], schema=schema)

    return groups.select("fps").mapInArrow(compare, "a long, b long").distinct()


def simhash_groups(docs: DataFrame, threshold: int = 2, size: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: ``doc_id``, ``fingerprint`` (16 hexadecimal digits), ``component_id`` (the smallest document id reachable).

    Exact copies and empty or null texts (fingerprint zero) meet in one distinct fingerprint, so a
    group of any size costs one row in the search. Rows with a null id link like others but give a
    component no id; a component of such rows alone has a null ``component_id``.
    """
    prints = materialize(fingerprints(docs, size, id_col, text_col), "fingerprints")
    distinct = materialize(prints.groupBy("fp").agg(F.min("doc_id").alias("least")), "distinct")
    roots = materialize(components(links(distinct.select("fp"), threshold)), "roots").withColumnRenamed("node", "fp")
    named = distinct.join(roots, "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    least = named.groupBy("root").agg(F.min("least").alias("component_id"))
    named = named.select("fp", "root").join(least, "root").select("fp", "component_id")
    return prints.join(named, "fp").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
