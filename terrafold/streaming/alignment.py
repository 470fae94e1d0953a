"""Alignment of any number of streams: the rows of :func:`terrafold.operators.joins.align_all`, as they become certain."""

from __future__ import annotations

from bisect import bisect_left
from collections import defaultdict
from collections.abc import Iterator

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

#: the base stream's name in the state
BASE = ""


def _order(row: tuple) -> list[tuple]:
    """Nulls come first, as in Spark."""
    return [(v is not None, v) for v in row]


class Aligner(StatefulProcessor):
    """The rows of all streams that base rows of one key and cell can meet; a cell is as wide as the bound.

    A cell is certain once the watermark is a whole cell past its end. Its timer gives the base rows out and clears
    it, so state holds the rows of the watermark's delay and about three cells, and rows are only ever appended.
    """

    def __init__(self, names: list[str], keep: list[str], fields: str, out: list[str], bound_ms: int):
        self.names, self.keep, self.fields, self.bound_ms, self.bound = names, keep, fields, bound_ms, 1000 * bound_ms
        self.out = Row(*out)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getListState("held", f"_stream string, {self.fields}")

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        self.held.appendList([(row["_stream"], row["_us"], *(row[c] for c in self.keep)) for row in rows])
        self.handle.registerTimer((key[1] + 2) * self.bound_ms)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        rows = defaultdict(list)
        for stream, *row in self.held.get():
            rows[stream].append(row)
        self.held.clear()
        near = [sorted(rows[name], key=_order) for name in self.names]
        times = [[r[0] for r in n] for n in near]
        for row in rows[BASE]:
            newest = [bisect_left(t, row[0] + self.bound) - 1 for t in times]
            if all(i >= 0 and t[i] > row[0] - self.bound for i, t in zip(newest, times, strict=True)):
                yield self.out(key[0], *row, *(v for i, n in zip(newest, near, strict=True) for v in n[i]))

    def close(self) -> None:
        pass


def align_all(base: DataFrame, others: dict[str, DataFrame], key: str, keep: list[str], bound_ms: int = 5, delay: str = "1 second") -> DataFrame:
    """Base rows for which every other stream has a row less than ``bound_ms`` away (strict), with each stream's newest such row as ``<name>_ts`` and ``<name>_*``.

    All streams have ``key``, an event time ``ts`` and the columns ``keep``, of one type each. Every stream has its own watermark and the slowest one
    counts, so a stream that lags behind loses nothing. Rows of one time: the largest ``keep``; repeated base rows stay repeated. Rows without key
    or time have no partners. One shuffle by key *and* time cell for all streams, to which the other streams' rows go three times, so a key
    that holds a third of all rows is dealt out; needs the RocksDB state store.
    """
    if BASE in others:
        raise ValueError("streams need names")
    type_of = lambda c: base.schema[c].dataType.simpleString()
    us, cell = F.unix_micros("ts"), F.floor(F.unix_micros("ts") / (1000 * bound_ms))
    streams = [
        df.withWatermark("ts", delay).where(F.col(key).isNotNull() & F.col("ts").isNotNull())
        .select(key, "ts", F.lit(name).alias("_stream"), us.alias("_us"), *keep, (cell if name == BASE else F.explode(F.sequence(cell - 1, cell + 1))).alias("_cell"))
        for name, df in {BASE: base, **others}.items()
    ]
    rows = streams[0]
    for other in streams[1:]:
        rows = rows.unionByName(other)
    fields = ", ".join(["_us bigint", *(f"`{c}` {type_of(c)}" for c in keep)])
    out = {f"{n}_{c}" if n else c: c for n in (BASE, *others) for c in ("ts", *keep)}
    schema = ", ".join([f"`{key}` {type_of(key)}", *(f"`{name}` {'bigint' if c == 'ts' else type_of(c)}" for name, c in out.items())])
    found = rows.groupBy(key, "_cell").transformWithState(Aligner(list(others), keep, fields, [key, *out], bound_ms), schema, "append", "eventTime")
    return found.withColumns({name: F.timestamp_micros(f"`{name}`") for name, c in out.items() if c == "ts"})
