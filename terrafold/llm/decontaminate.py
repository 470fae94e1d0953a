"""Benchmark decontamination by a prefix-filtered set join.

A window of ``size`` consecutive item words occurs in a document only if all its words do. With words
ordered by rarity, the prefix that must be joined for full containment is one word: the window's
rarest. Documents are streamed once against the windows keyed by that word. A candidate place passes
the positional and length bounds if the whole window fits around it, and then the item-sized
stretch is compared exactly.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_schema, id_and_bytes, keep_rows, materialize

#: Fixed rule: A-Z become a-z, and every ASCII character but letters and digits separates words.
_TABLE = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))

#: The same words in SQL, of the text as it is.
_WORD = r"[0-9A-Za-z\x{80}-\x{10FFFF}]+"
#: A window costs the index at most this much beside its own text (measured: 814 where no two windows share a place, 270 on the benchmark).
WINDOW_BYTES = 1024


def words_of(text: bytes) -> list[bytes]:
    return text.translate(_TABLE).split()


def windows_of(words: list[bytes], size: int) -> list[tuple[bytes, ...]]:
    return [tuple(words[i : i + size]) for i in range(max(1, len(words) - size + 1))] if words else []


def word_counts(docs: DataFrame, vocabulary: set[bytes]) -> dict[bytes, int]:
    """Documents that hold each word of a vocabulary of bounded size, over all documents."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: Counter[bytes] = Counter()
        for batch in batches:
            for text in batch.column(0):
                total.update(vocabulary.intersection(words_of(text.as_py())))
        yield pa.RecordBatch.from_pydict({"word": list(total), "n": list(total.values())}, schema=arrow)

    arrow = arrow_schema(docs.sparkSession, "word binary, n long")
    rows = docs.select("text").mapInArrow(count, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n")).collect()
    return {bytes(r.word): r.n for r in rows}


def build_index(items: list[tuple[str, bytes]], size: int, counts: dict[bytes, int]) -> dict[bytes, dict[tuple[int, int], dict[bytes, list[int]]]]:
    """``prefix word -> (its place in the window, window length) -> window -> numbers of its items``."""
    index: dict = {}
    for k, (_, text) in enumerate(items):
        for w in windows_of(words_of(text), size):
            at = min(range(len(w)), key=lambda i: (counts.get(w[i], 0), w[i], i))
            held = index.setdefault(w[at], {}).setdefault((at, len(w)), {}).setdefault(b" ".join(w), [])
            if not held or held[-1] != k:
                held.append(k)
    return index


def find(words: list[bytes], index: dict) -> tuple[int, set[int]]:
    """How many words lie in an occurrence, and the numbers of the items that occur."""
    places = [i for i, w in enumerate(words) if w in index]
    if not places:
        return 0, set()
    hit, found, n = bytearray(len(words)), set(), len(words)
    for i in places:
        for (at, size), windows in index[words[i]].items():
            begin = i - at
            if begin >= 0 and begin + size <= n and (numbers := windows.get(b" ".join(words[begin : begin + size]))) is not None:
                hit[begin : begin + size] = b"\1" * size
                found.update(numbers)
    return sum(hit), found


def decontaminate(docs: DataFrame, benchmark: DataFrame, size: int = 13, share: int = 20, block_bytes: int = 256 << 20, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """Per row of ``docs``: ``n_words``, ``n_hit``, ``n_items``, ``items_sha256``, ``contaminated``, ``items``.

    Contaminated: some word is hit and ``share * n_hit >= n_words``. Null and empty texts have no
    words; an empty benchmark hits nothing; repeated items count once each by their id; items
    without an id are left out. The index of a block is broadcast, so items are dealt out to blocks whose
    index takes about half of ``block_bytes`` in memory by an estimate from above (``WINDOW_BYTES`` a word and ``size``
    times the text; an item larger than that is a block of its own); a larger benchmark
    takes several passes over all documents, whose hits are united exactly.
    """
    source = id_and_bytes(docs, id_col, text_col)
    items, blocks = _blocks(benchmark, block_bytes, size, item_col, item_text_col)
    if blocks <= 1:
        return _finish(_pass(source, items, size), share)
    numbered = materialize(source.withColumn("row", F.monotonically_increasing_id()), "numbered")
    return _finish(_united(numbered, items, blocks, size), share)


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, size: int = 13, share: int = 20, block_bytes: int = 256 << 20, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """The rows that aren't contaminated, with all their columns. One block: a filter in place; more: a join by row number."""
    items, blocks = _blocks(benchmark, block_bytes, size, item_col, item_text_col)
    if blocks <= 1:
        shared = _broadcast(docs.select(F.coalesce(F.col(f"`{text_col}`"), F.lit("")).cast("binary").alias("text")), items, size)

        def make():
            index, _ = shared.value

            def clean(text: bytes) -> bool:
                words = words_of(text)
                hit = find(words, index)[0]
                return not (hit and share * hit >= len(words))

            return lambda texts: list(map(clean, texts))

        return keep_rows(docs, make, text_col)
    names = [f"c{k}" for k in range(len(docs.columns))]
    numbered = materialize(docs.toDF(*names).withColumn("row", F.monotonically_increasing_id()), "numbered")
    text = F.coalesce(F.col(names[docs.columns.index(text_col)]), F.lit("")).cast("binary").alias("text")
    judged = _finish(_united(numbered.select(F.col("row").alias("doc_id"), text, "row"), items, blocks, size), share)
    return numbered.join(judged.where("not contaminated").select(F.col("doc_id").alias("row")), "row", "left_semi").drop("row").toDF(*docs.columns)


def _blocks(benchmark: DataFrame, block_bytes: int, size: int, item_col: str, text_col: str) -> tuple[DataFrame, int]:
    """Distinct items, and in how many blocks they are searched (column ``k`` if more than one)."""
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    cost = F.regexp_count(text, F.lit(_WORD)) * WINDOW_BYTES + F.octet_length(text) * size
    items = benchmark.select(F.col(f"`{item_col}`").cast("string").alias("item"), text.cast("binary").alias("text"), cost.alias("cost")).where("item is not null").distinct()
    total, count = items.agg(F.coalesce(F.sum("cost"), F.lit(0)), F.count("*")).first()
    if total <= block_bytes:
        return items, 1
    blocks = min(count, -(-2 * total // block_bytes))  # half full on average
    return materialize(items.withColumn("k", F.pmod(F.xxhash64("item", "text"), F.lit(blocks))), "items"), blocks


def _united(numbered: DataFrame, items: DataFrame, blocks: int, size: int) -> DataFrame:
    """Hit places and items of all blocks' passes, united per row."""
    places = None
    for k in range(blocks):
        part = _pass(numbered, items.where(F.col("k") == k), size, places=True)
        places = part if places is None else places.unionByName(part)
    united = places.groupBy("row").agg(F.first("doc_id").alias("doc_id"), F.first("n_words").alias("n_words"), F.array_distinct(F.flatten(F.collect_list("hit"))).alias("hit"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"))
    return united.select("doc_id", "n_words", F.size("hit").cast("long").alias("n_hit"), "items")


def _finish(rows: DataFrame, share: int) -> DataFrame:
    return rows.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.concat_ws(",", "items").cast("binary"), 256).alias("items_sha256"),
        ((F.col("n_hit") > 0) & (share * F.col("n_hit") >= F.col("n_words"))).alias("contaminated"), "items",
    )


def _broadcast(source: DataFrame, items: DataFrame, size: int):
    """The index of a block of items and the items' names."""
    held = sorted((r.item, bytes(r.text)) for r in items.select("item", "text").toLocalIterator())
    counts = word_counts(source, {w for _, text in held for w in words_of(text)}) if held else {}
    return source.sparkSession.sparkContext.broadcast((build_index(held, size, counts), [x[0] for x in held]))


def _pass(source: DataFrame, items: DataFrame, size: int, places: bool = False) -> DataFrame:
    """All rows of ``source`` against one block of items of bounded size."""
    spark = source.sparkSession
    shared = _broadcast(source, items, size)
    columns = "doc_id long, n_words long, " + ("row long, hit array<int>, items array<string>" if places else "n_hit long, items array<string>")
    schema = arrow_schema(spark, columns)

    def match(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index, names = shared.value
        for batch in batches:
            for start in range(0, batch.num_rows, 512):
                piece = batch.slice(start, 512)
                rows = []
                for r in piece.to_pylist():
                    words = words_of(r["text"])
                    if places:
                        hit, found = find_places(words, index)
                        rows.append((r["doc_id"], len(words), r["row"], hit, sorted(names[k] for k in found)))
                    else:
                        n, found = find(words, index)
                        rows.append((r["doc_id"], len(words), n, sorted({names[k] for k in found})))
                yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*rows, strict=True) if rows else [[]] * len(schema), schema, strict=True)], schema=schema)

    return source.mapInArrow(match, columns)


def find_places(words: list[bytes], index: dict) -> tuple[list[int], set[int]]:
    hit: set[int] = set()
    found: set[int] = set()
    for i, w in enumerate(words):
        for (at, size), windows in index.get(w, {}).items():
            begin = i - at
            if begin >= 0 and begin + size <= len(words) and (numbers := windows.get(b" ".join(words[begin : begin + size]))) is not None:
                hit.update(range(begin, begin + size))
                found.update(numbers)
    return sorted(hit), found
