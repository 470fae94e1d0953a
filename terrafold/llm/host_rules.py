"""Quality rules with host verdicts.

Rules are applied to every document; failures are summed by host, a host's failure rate is shrunk
towards a beta prior that is fitted to the hosts' rates (method of moments), and the verdict on the
host goes back to its documents.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BLANK, arrow_schema, materialize

_SYMBOLS = b"#*$%&|<>"
_INSIDE = bytes(range(0x80, 0xC0))
_POWERS = np.array([pow(0x9E3779B97F4A7C15, k, 1 << 64) for k in range(8)], np.uint64)


def repeated_words(words: list[bytes], size: int = 8) -> int:
    """Words that lie in a window of ``size`` words found twice or more, the first time included.

    Rolling hashes propose the windows, the words themselves confirm them.
    """
    n = len(words) - size + 1
    if n < 2:
        return 0
    h = np.fromiter(map(hash, words), np.int64, len(words)).view(np.uint64)
    rolled = np.zeros(n, np.uint64)
    for k in range(size):
        rolled += h[k : k + n] * _POWERS[k]
    order = np.argsort(rolled, kind="stable")
    same = rolled[order][1:] == rolled[order][:-1]
    if not same.any():
        return 0
    twice = np.zeros(n, bool)
    twice[order[1:][same]] = twice[order[:-1][same]] = True
    places = np.flatnonzero(twice).tolist()
    keys = [b" ".join(words[i : i + size]) for i in places]
    count = Counter(keys)
    hit = np.zeros(len(words) + 1, np.int64)
    for i, key in zip(places, keys, strict=True):
        if count[key] > 1:
            hit[i] += 1
            hit[min(i + size, len(words))] -= 1
    return int((np.cumsum(hit[:-1]) > 0).sum())


def measures(text: bytes) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words"""
    words = text.split()
    lines = [x for x in text.split(b"\n") if x and not x.isspace()]
    return len(words), len(text.translate(None, BLANK + _INSIDE)), len(text) - len(text.translate(None, _SYMBOLS)), len(lines) - len(set(lines)), repeated_words(words)


def host_rules(docs: DataFrame, max_rate: float = 0.5, least_words: int = 20, repeat_percent: int = 30, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source") -> DataFrame:
    """Per row: the measures, ``base_failed``, ``host_rate`` (shrunk) and ``kept``.

    A document is kept if it passes its own rules and its host's shrunk failure rate is at most
    ``max_rate``. A null text has no words and fails. Documents without a host get no host verdict.
    With fewer than two hosts, or hosts that don't differ, the prior weighs as 20 documents at the mean rate.
    """
    import pyarrow as pa

    spark = docs.sparkSession
    columns = "doc_id long, host string, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long"
    schema = arrow_schema(spark, columns)
    source = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{host_col}`").cast("string").alias("host"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).cast("binary").alias("text"))

    def measure(batches):
        for batch in batches:
            for start in range(0, batch.num_rows, 512):
                piece = batch.slice(start, 512)
                found = list(zip(*map(measures, piece.column(2).to_pylist()), strict=True)) or [[]] * 5
                yield pa.RecordBatch.from_arrays([piece.column(0), piece.column(1), *(pa.array(x, pa.int64()) for x in found)], schema=schema)

    rows = source.mapInArrow(measure, columns)
    failed = (F.col("n_words") < least_words) | (100 * F.col("n_repeat_words") > repeat_percent * F.col("n_words"))
    rows = materialize(rows.withColumn("base_failed", failed), "measures")
    hosts = materialize(rows.where("host is not null").groupBy("host").agg(F.count("*").alias("n"), F.sum(F.col("base_failed").cast("long")).alias("fails")), "hosts")
    rate = F.col("fails") / F.col("n")
    prior = hosts.agg(F.avg(rate).alias("mean"), F.var_samp(rate).alias("spread")).first()
    mean, spread = prior.mean or 0.0, prior.spread or 0.0
    strength = max(1.0, mean * (1 - mean) / spread - 1) if spread > 0 else 20.0
    verdicts = hosts.select("host", ((F.col("fails") + mean * strength) / (F.col("n") + strength)).alias("host_rate"))
    return rows.join(verdicts, "host", "left").select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "host", "host_rate",
        (~F.col("base_failed") & (F.coalesce("host_rate", F.lit(0.0)) <= max_rate)).alias("kept"),
    )
