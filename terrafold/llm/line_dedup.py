"""Line dedup by pairwise alignment.

1. Of every text the hashes of some lines are drawn: ``size`` words each, where a line or sentence of so many
   words opens and, where none opens for long, where the words' own hash is smallest. The choice depends on the words alone, and any
   ``min_words`` words in a row hold at least one such place (``line_keys``).
2. Documents that share a hash overlap. A place links to the first document (smallest id, then smallest hash of the
   text) that holds the hash with the same ``min_words - size`` words behind it, and to the first that holds it with as many
   words before it; only a place without either links to the first document with the hash alone. So whatever other documents repeat of a
   passage in part, the ``min_words`` words around a place meet a document that holds them whole. The links are
   linear in the places: no group of copies, however large, needs a cap.
3. A document is aligned with each document it is linked to by patience diff over the shared places, which neighbours
   unite to runs: runs that are unique in both and rare are ordered by the longest increasing subsequence, others fill the gaps, and what the
   first alignment leaves (moved and repeated passages) is aligned run by run, so in the end every run is aligned: what is deleted is where
   aligning the rest again and again comes to, and no order or rarity changes it, only the order of the work. Runs grow word by
   word over the earlier document's own words, so no hash is trusted. At least ``min_words`` words that stand in a row in both
   are a block; blocks are deleted from the later document and the first holder keeps them.
   Shorter repeats (a licence line, a stock phrase) stay.

What is found: of every block of ``2 * min_words - size - 1`` (31) words or more that one earlier document holds, all but up to
``min_words - size`` (12) words at either end, and these too where the linked documents hold them; of shorter blocks those of which a hash,
alone or with its neighbours, appears first in a document that holds the block. Nothing is deleted that no earlier document holds.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections import Counter
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, WindowSpec
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from .common import BLANK, arrow_schema, materialize

#: Words of an earlier document that are looked up together.
BLOCK = 32
#: Bytes of text that are hashed together.
CHUNK = 1 << 18

_DRAW = np.random.default_rng(11)
_BYTE = _DRAW.integers(1, 1 << 64, 256, np.uint64)
_BASE, _STEP = (int(x) | 1 for x in _DRAW.integers(1, 1 << 64, 2, np.uint64))
_SPACE = np.zeros(256, bool)
_SPACE[list(BLANK)] = True
_END = np.zeros(256, bool)
_END[list(b".!?")] = True
_powers: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """``base ** 0 .. base ** (n - 1)`` modulo 2^64, remembered."""
    known = _powers.get(base)
    if known is None or len(known) < n:
        known = np.full(max(n, 1 << 16), base, np.uint64)
        known[0] = 1
        _powers[base] = known = np.multiply.accumulate(known)
    return known[:n]


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


class Ranges:
    """Polynomial hashes of ``values[a:b]`` for many ranges, from one running sum."""

    def __init__(self, values: np.ndarray, base: int):
        self.sums = np.zeros(len(values) + 1, np.uint64)
        np.cumsum(values * powers(base, len(values)), dtype=np.uint64, out=self.sums[1:])
        self.back = powers(pow(base, -1, 1 << 64), len(values) + 1)

    def __call__(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return mixed((self.sums[b] - self.sums[a]) * self.back[a] + (b - a).astype(np.uint64))


class Words:
    """The words of several texts that lie one after the other in ``raw``; text k is ``raw[bounds[k] : bounds[k + 1]]``."""

    def __init__(self, raw: np.ndarray, bounds: np.ndarray):
        n = len(raw)
        solid = np.zeros(n + 2, bool)
        np.logical_not(_SPACE[raw], out=solid[1:-1])
        before, behind = solid[:-2].copy(), solid[2:].copy()
        before[bounds[:-1][bounds[:-1] < n]] = False
        behind[bounds[1:][bounds[1:] > 0] - 1] = False
        self.begin = np.flatnonzero(solid[1:-1] & ~before)
        self.stop = np.flatnonzero(solid[1:-1] & ~behind) + 1
        #: text k holds words first[k] to first[k + 1]
        self.first = np.searchsorted(self.begin, bounds)
        self.raw, self.bounds = raw, bounds

    def sentence_ends(self) -> np.ndarray:
        return _END[self.raw[self.stop - 1]]

    def unit_ends(self) -> np.ndarray:
        """Which words end a unit: a line, a sentence, the text."""
        unit = self.sentence_ends()
        last = np.searchsorted(self.begin, np.flatnonzero(self.raw == 10)) - 1
        unit[last[last >= 0]] = True
        unit[self.first[1:][self.first[1:] > self.first[:-1]] - 1] = True
        return unit


def one(text: bytes) -> Words:
    return Words(np.frombuffer(text, np.uint8), np.array([0, len(text)]))


def units(text: bytes) -> list[tuple[int, int]]:
    """Spans of a text's units (lines, and sentences within them); together they cover it, each with the blanks that follow it."""
    if not text:
        return []
    w = one(text)
    edges = [0, *w.begin[1:][w.unit_ends()[:-1]].tolist(), len(text)]
    return list(zip(edges[:-1], edges[1:], strict=True))


def least_of(values: np.ndarray, width: int) -> np.ndarray:
    """The smallest of each ``width`` neighbours."""
    have = 1
    while 2 * have <= width:
        values, have = np.minimum(values[:-have], values[have:]), 2 * have
    return values if have == width else np.minimum(values[: len(values) - (width - have)], values[width - have :])


def line_keys(w: Words, size: int, min_words: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The chosen places (word numbers), the hash of the ``size`` words there, and 16 bits each of the words behind (high) and before (low).

    A place is chosen if it has the smallest rank of some ``min_words - size + 1`` neighbours; openings of sentences of ``size`` words rank first.
    """
    n, near = len(w.begin), min_words - size
    if n < min_words:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.int64)
    hashes = Ranges(Ranges(_BYTE[w.raw], _BASE)(w.begin, w.stop), _STEP)
    counts = np.diff(w.first)
    end = np.repeat(w.first[1:], counts)
    at = np.arange(n - size + 1)
    h = hashes(at, at + size)
    sentence = w.sentence_ends()
    ended = np.append(0, np.cumsum(sentence))
    opening = np.append(True, sentence[:-1])
    opening[w.first[:-1][counts > 0]] = True
    opening = opening[: len(h)] & (ended[at + size - 1] == ended[at])
    rank = (h >> np.uint64(1)) | (~opening).astype(np.uint64) << np.uint64(63)
    least = least_of(rank, near + 1)
    whole = np.arange(len(least)) + min_words <= end[: len(least)]
    chosen = np.zeros(len(h), bool)
    for k in range(near + 1):
        chosen[k : k + len(least)] |= (rank[k : k + len(least)] == least) & whole
    at = np.flatnonzero(chosen)
    behind = hashes(at + size, np.minimum(at + size + near, end[at]))
    before = hashes(np.maximum(at - near, np.repeat(w.first[:-1], counts)[at]), at)
    return at, h[at], (behind >> np.uint64(48) << np.uint64(16) | before >> np.uint64(48)).astype(np.int64)


def rising(anchors: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The longest chain that rises in both."""
    anchors = sorted(anchors)
    tails: list[int] = []
    at: list[int] = []
    back: list[int] = []
    for i, (_, y) in enumerate(anchors):
        k = bisect_left(tails, y)
        if k == len(tails):
            tails.append(y)
            at.append(i)
        else:
            tails[k], at[k] = y, i
        back.append(at[k - 1] if k else -1)
    chain, i = [], at[-1] if at else -1
    while i >= 0:
        chain.append(anchors[i])
        i = back[i]
    chain.reverse()
    return chain


def filled(chain: list[tuple[int, int]], rest: list[tuple[int, list[int]]]) -> list[tuple[int, int]]:
    """The chain with each ``(place, rising places in the earlier one)`` that fits between its neighbours."""
    out, k, low = [], 0, -1
    for x, ys in [*sorted(rest), (1 << 62, [])]:
        while k < len(chain) and chain[k][0] < x:
            out.append(chain[k])
            low = chain[k][1]
            k += 1
        i = bisect_right(ys, low)
        if i < len(ys) and (k == len(chain) or ys[i] < chain[k][1]):
            out.append((x, ys[i]))
            low = ys[i]
    return out


def patience(pairs: list[tuple[int, int, bool]]) -> list[tuple[int, int]]:
    """Aligned places of two documents from their shared ones ``(place, place in the earlier one, unique in both)``.

    Anchors are the longest chain of unique places that rises in both; the remaining shared places join
    where they fit between their neighbouring anchors in order.
    """
    return filled(rising([p[:2] for p in pairs if p[2]]), [(x, [y]) for x, y, unique in pairs if not unique])


def aligned_blocks(own: list[bytes], known: dict[int, list[bytes]], shared: list[tuple[int, int, int, int]], min_words: int, rare_docs: int, rare_share: float) -> list[tuple[int, int]]:
    """Runs of at least ``min_words`` of a document's words that stand in a row in one earlier document too.

    ``known`` holds words of the earlier document by the number of a ``BLOCK``. ``shared``: where a run begins, where it begins in the
    earlier document, its words, holders of its rarest hash.
    """
    runs = sorted(set(shared))
    often = sorted(n for *_, n in runs)
    limit = max(rare_docs, often[min(len(often) - 1, int(rare_share * len(often)))])
    xs, ys = Counter(r[0] for r in runs), Counter(r[1] for r in runs)
    first = patience([(x, y, n <= limit and xs[x] == ys[y] == 1) for x, y, _, n in runs])
    aligned, length = set(first), {(x, y): n for x, y, n, _ in runs}
    # blocks side by side are one stretch of words
    starts: list[int] = []
    stretches: list[list[bytes]] = []
    for k in sorted(known):
        if not starts or starts[-1] + len(stretches[-1]) != k * BLOCK:
            starts.append(k * BLOCK)
            stretches.append([])
        stretches[-1] += known[k]
    grown: dict[int, list[tuple[int, int]]] = {}
    out = []
    for x, y in [*first, *(r[:2] for r in runs if r[:2] not in aligned)]:
        there = grown.setdefault(y - x, [])
        s = bisect_right(starts, y) - 1
        words, d = stretches[s], y - x - starts[s]
        low, high = max(0, -d), min(len(own), len(words) - d)
        # a run may hold words that differ between its places
        end = min(x + length[x, y], high)
        while x < end:
            k = bisect_right(there, (x, len(own)))
            if k and x < there[k - 1][1]:
                x = there[k - 1][1]
                continue
            if own[x] != words[x + d]:
                x += 1
                continue
            a, b = x, x + 1
            while a - 16 >= low and own[a - 16 : a] == words[a - 16 + d : a + d]:
                a -= 16
            while a > low and own[a - 1] == words[a - 1 + d]:
                a -= 1
            while b + 16 <= high and own[b : b + 16] == words[b + d : b + 16 + d]:
                b += 16
            while b < high and own[b] == words[b + d]:
                b += 1
            there.insert(k, (a, b))
            if b - a >= min_words:
                out.append((a, b))
            x = b
    return out


def line_dedup(docs: DataFrame, min_words: int = 20, rare_docs: int = 64, rare_share: float = 0.5, id_col: str = "doc_id", text_col: str = "text", out_col: str = "line_dedup") -> DataFrame:
    """The rows of ``docs`` with the deleted blocks gone from their text, and a struct ``n_units, n_deleted, words_deleted``.

    One row per input row; all other columns stay (``out_col`` is replaced if it is there already). ``n_deleted`` counts the units that lost words.
    Null and empty texts have no units and stay as they are. A document is
    its id and text: repeated rows are one document and lose the same blocks, different texts under one
    id are two, ordered by a hash. Rows without an id stay whole and delete nothing.

    Of two documents' shared runs those count as rare that at most ``rare_docs`` places hold, and the rarer
    ``rare_share`` of them. Rarity says where an alignment begins, never what is deleted.
    """
    kept = [c for c in docs.columns if c != out_col]
    names = [f"c{k}" for k in range(len(kept))]
    text = names[kept.index(text_col)]
    source = docs.select(*(F.col(f"`{c}`").alias(n) for c, n in zip(kept, names, strict=True)), F.col(f"`{id_col}`").cast("long").alias("doc_id"))
    source = source.withColumn("own", F.xxhash64(text).bitwiseAND(F.lit((1 << 31) - 1)))
    size = max(1, 2 * min_words // 5)
    sought = "doc_id is not null and {0} is not null".format(text)
    texts = source.where(sought)
    pairs = materialize(_pairs(_links(_keys(texts, text, size, min_words)), size, 2 * min_words), "pairs")
    near = f"transform(runs, r -> sequence(greatest(r.y - {min_words - size}, 0) div {BLOCK}, (r.y + r.n + {min_words - size} - 1) div {BLOCK}))"
    # the runs go with one of the pair's blocks
    asked = pairs.select("doc_id", "own", "a_doc", "a_own", "runs", F.posexplode(F.array_distinct(F.flatten(F.expr(near)))).alias("k", "block"))
    asked = asked.select("doc_id", "own", "a_doc", "a_own", "block", F.when(F.col("k") == 0, F.col("runs")).alias("runs"))
    # the words of earlier documents that pairs ask for, once a document and block
    wanted = asked.select("a_doc", "a_own", "block").distinct().groupBy("a_doc", "a_own").agg(F.collect_list("block").alias("blocks"))
    wanted = texts.join(wanted.toDF("doc_id", "own", "blocks"), ["doc_id", "own"]).select(*names, "doc_id", "own", "blocks")
    place = names.index(text)
    schema = "a_doc long, a_own long, block long, words binary"
    arrow = arrow_schema(docs.sparkSession, schema)

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 128):
                piece = batch.slice(start, 128)
                out = []
                for body, doc, own, blocks in zip(piece.column(place).cast(pa.binary()).to_pylist(), *(c.to_pylist() for c in piece.columns[-3:]), strict=True):
                    w = one(body)
                    out += [(doc, own, b, body[w.begin[b * BLOCK] : w.stop[min((b + 1) * BLOCK, len(w.stop)) - 1]]) for b in blocks if b * BLOCK < len(w.begin)]
                yield batch_of(out, arrow)

    blocks = wanted.mapInArrow(look, schema).dropDuplicates(["a_doc", "a_own", "block"])
    shared = asked.join(blocks, ["a_doc", "a_own", "block"]).groupBy("doc_id", "own").agg(F.collect_list(F.struct("a_doc", "a_own", "block", "words", "runs")).alias("shared"))
    joined = texts.join(shared, ["doc_id", "own"], "left").select(*names, "shared")
    whole = source.where(f"not ({sought})").select(*names, F.lit(None).cast(joined.schema["shared"].dataType).alias("shared"))
    joined = joined.union(whole)
    out = StructType([*joined.schema.fields[:-1], *(StructField(n, IntegerType()) for n in ("n_units", "n_deleted", "words_deleted"))])

    def rebuild(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 128):
                piece = batch.slice(start, 128)
                yield _rebuilt(piece, place, out.names, lambda own, s: deleted_words(own, s, min_words, rare_docs, rare_share))

    done = joined.mapInArrow(rebuild, out)
    return done.select(*(F.col(n).alias(c) for c, n in zip(kept, names, strict=True)), F.struct("n_units", "n_deleted", "words_deleted").alias(out_col))


def _keys(texts: DataFrame, text: str, size: int, min_words: int) -> DataFrame:
    """One row per hash of a batch: ``h``, the first place that holds it with the same words around it, and the batch's other places.

    Combined a batch, a passage that a third of all documents hold is one row a batch before it is shuffled. ``mark`` packs
    the document's hash (high) and the words around (low): rows as short as can be, for they are the largest shuffle but the texts.
    """
    schema = "h long, mark long, at int, doc_id long, others array<struct<doc_id: long, own: long, at: int>>"
    arrow = arrow_schema(texts.sparkSession, schema)
    lists = arrow.field("others").type

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, hashes = (batch.column(k).to_numpy() for k in (0, 1))
            found = []
            for first, w in chunks(batch.column(2)):
                word, h, around = line_keys(w, size, min_words)
                doc = np.searchsorted(w.first, word, "right") - 1
                found.append((h, around, ids[first + doc], hashes[first + doc], (word - w.first[doc]).astype(np.int32)))
            if not found:
                continue
            h, around, doc, own, at = (np.concatenate([f[k] for f in found]) for k in range(5))
            h = h.view(np.int64)
            # few hashes stand twice in a batch; the others stay as they are, in the documents' order, in which neighbouring rows are alike and pack well
            order = np.argsort(h)
            same = h[order][1:] == h[order][:-1]
            twice = order[np.append(same, False) | np.append(False, same)] if len(h) else order
            twice = twice[np.lexsort((at[twice], own[twice], doc[twice], around[twice], h[twice]))]
            first = np.append(True, (np.diff(h[twice]) != 0) | (np.diff(around[twice]) != 0))[: len(twice)]
            count = np.zeros(len(h), np.int32)
            count[twice[first]] = np.diff(np.append(np.flatnonzero(first), len(twice))) - 1
            kept = np.ones(len(h), bool)
            kept[twice[~first]] = False
            rows = np.flatnonzero(kept)
            # the others of each first place, in the order of those
            group = np.cumsum(first) - 1
            others = twice[~first][np.argsort(twice[first][group[~first]], kind="stable")]
            values = pa.StructArray.from_arrays([pa.array(x[others]) for x in (doc, own, at)], fields=list(lists.value_type))
            ends = np.append(0, np.cumsum(count[rows])).astype(np.int32)
            held = pa.ListArray.from_arrays(pa.array(ends), values, type=lists, mask=pa.array(count[rows] == 0))
            yield pa.RecordBatch.from_arrays([*(pa.array(x[rows]) for x in (h, own << 32 | around, at, doc)), held], schema=arrow)

    return texts.select("doc_id", "own", F.col(text).cast("binary").alias("body")).mapInArrow(cut, schema)


def chunks(texts: pa.Array) -> Iterator[tuple[int, Words]]:
    """Neighbouring texts of about ``CHUNK`` bytes together, whole, with the first one's number; no text is null."""
    texts = texts.cast(pa.large_binary())
    bounds = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    raw = np.frombuffer(texts.buffers()[2] or b"", np.uint8)
    at = 0
    while at < len(texts):
        end = max(at + 1, int(np.searchsorted(bounds, bounds[at] + CHUNK, "right")) - 1)
        yield at, Words(raw[bounds[at] : bounds[end]], bounds[at : end + 1] - bounds[at])
        at = end


def held_twice(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows sorted by ``h`` those whose hash another row or several places hold."""
    waiting, before = None, None
    for batch in chain((b for b in batches if b.num_rows), [None]):
        if waiting is not None:
            h = waiting.column(0).to_numpy()
            same = h[1:] == h[:-1]
            ahead = batch is not None and h[-1] == batch.column(0)[0].as_py()
            keep = np.append(same, ahead) | np.append(h[0] == before, same) | waiting.column(4).is_valid().to_numpy(zero_copy_only=False)
            yield waiting.filter(pa.array(keep))
            before = h[-1]
        waiting = batch


def _links(keys: DataFrame) -> DataFrame:
    """``doc_id, own, x, a_doc, a_own, y, holders``: later places, and the first places that hold their hash with the words behind or before it, else alone."""

    def whole(*by: str) -> WindowSpec:
        return Window.partitionBy(*by).orderBy("doc_id", "mark", "at").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)

    # most hashes stand alone and go before the windows
    keys = keys.repartition("h").sortWithinPartitions("h").mapInArrow(held_twice, keys.schema)
    behind, before = (lambda c: F.shiftright(c, 16).bitwiseAND(F.lit(0xFFFF))), (lambda c: F.col(c).bitwiseAND(F.lit(0xFFFF)))
    place = F.struct("doc_id", F.shiftright("mark", 32).alias("own"), "at")
    target = F.struct("doc_id", F.shiftright("mark", 32).alias("own"), "at", behind("mark").alias("behind"), before("mark").alias("before"))
    held = F.sum(F.lit(1) + F.coalesce(F.size("others"), F.lit(0))).over(whole("h"))
    # one shuffle by h serves all three windows
    shared = keys.select("*", F.first(target).over(whole("h")).alias("t0"), held.cast("int").alias("holders"), behind("mark").alias("behind"), before("mark").alias("before"))
    shared = shared.select("*", F.first(target).over(whole("h", "behind")).alias("t1")).select("*", F.first(target).over(whole("h", "before")).alias("t2"))
    later = shared.select(F.explode(F.concat(F.array(place), F.coalesce(F.col("others"), F.array()))).alias("c"), "t0", "t1", "t2", "behind", "before", "holders")
    # a first place is never behind the place itself, so another document is an earlier one
    other = lambda t: (F.col(f"{t}.doc_id") != F.col("c.doc_id")) | (F.col(f"{t}.own") != F.col("c.own"))
    # a document with the same words on both sides is enough
    alone = F.when(F.col("t1.before") == F.col("before"), F.array("t1")).when(F.col("t2.behind") == F.col("behind"), F.array("t2")).otherwise(F.array("t1", "t2"))
    best = F.when(other("t1") & other("t2"), alone).when(other("t1"), F.array("t1")).when(other("t2"), F.array("t2")).when(other("t0"), F.array("t0"))
    pairs = later.select("c", "holders", F.explode(best).alias("a"))
    return pairs.select("c.doc_id", "c.own", F.col("c.at").alias("x"), F.col("a.doc_id").alias("a_doc"), F.col("a.own").alias("a_own"), F.col("a.at").alias("y"), "holders")


def _pairs(links: DataFrame, size: int, reach: int) -> DataFrame:
    """``doc_id, own, a_doc, a_own, runs``: places of two documents that go on side by side within ``reach`` words are one run: ``x, y, n, holders``."""
    pair = ["doc_id", "own", "a_doc", "a_own"]
    line = Window.partitionBy(*pair, "d").orderBy("x")
    # all of a document's links meet in one task; windows and groups below need no further shuffle
    met = links.repartition("doc_id", "own").select("*", (F.col("y") - F.col("x")).alias("d"))
    met = met.select("*", F.coalesce(F.col("x") - F.lag("x").over(line) > reach, F.lit(True)).cast("int").alias("new"))
    runs = met.select("*", F.sum("new").over(line).alias("run")).groupBy(*pair, "d", "run").agg(F.min("x").alias("x"), (F.max("x") - F.min("x") + size).alias("n"), F.min("holders").alias("holders"))
    return runs.groupBy(*pair).agg(F.collect_list(F.struct("x", (F.col("x") + F.col("d")).alias("y"), "n", "holders")).alias("runs"))


def deleted_words(own: list[bytes], shared: list[tuple], min_words: int, rare_docs: int, rare_share: float) -> np.ndarray:
    """Which words of a document its aligned blocks cover; ``shared``: earlier document, block number, the block's words, runs."""
    gone = np.zeros(len(own), bool)
    by_earlier: dict[tuple, tuple[dict, list]] = {}
    for earlier, block, words, runs in shared:
        known, all_runs = by_earlier.setdefault(earlier, ({}, []))
        known[block] = words.split()
        all_runs += runs
    for known, runs in by_earlier.values():
        for a, b in aligned_blocks(own, known, runs, min_words, rare_docs, rare_share):
            gone[a:b] = True
    return gone


def _told(shared: pa.ListArray) -> tuple[list[int], list[tuple]]:
    """The links of a batch of documents: where each document's begin, and all of them as :func:`deleted_words` takes them."""
    begin, links = inner(shared)
    a_doc, a_own, block, words, runs = (links.field(k) for k in ("a_doc", "a_own", "block", "words", "runs"))
    ends, parts = inner(runs)
    places = list(zip(*(parts.field(k).to_pylist() for k in ("x", "y", "n", "holders")), strict=True))
    earlier = zip(a_doc.to_pylist(), a_own.to_pylist(), strict=True)
    own = (places[a:b] for a, b in zip(ends[:-1], ends[1:], strict=True))
    return begin, list(zip(earlier, block.to_pylist(), words.to_pylist(), own, strict=True))


def inner(lists: pa.ListArray) -> tuple[list[int], pa.Array]:
    """Where each list begins, and what they hold."""
    sizes = lists.value_lengths().fill_null(0).to_numpy()
    return [0, *np.cumsum(sizes).tolist()], lists.flatten()


def _rebuilt(piece: pa.RecordBatch, place: int, names: list[str], deleted) -> pa.RecordBatch:
    """The rows without their deleted words (each with the blanks that follow it), their units, those of them that lost words, words lost."""
    texts = piece.column(place).cast(pa.binary())
    n_units, n_deleted, lost = (np.zeros(len(texts), np.int32) for _ in range(3))
    ends, links = _told(piece.column(piece.num_columns - 1))
    new: dict[int, bytes] = {}
    for at, w in chunks(texts.fill_null(b"")):
        unit = np.append(0, np.cumsum(w.unit_ends()))
        n_units[at : at + len(w.first) - 1] = np.diff(unit[w.first])
        for k in range(at, at + len(w.first) - 1):
            if ends[k] == ends[k + 1]:
                continue
            body = texts[k].as_py()
            gone = deleted(body.split(), links[ends[k] : ends[k + 1]])
            if gone.any():
                a, b = w.first[k - at], w.first[k - at + 1]
                edge = np.diff(np.concatenate([[0], gone.astype(np.int8), [0]]))
                starts = np.append(w.begin[a:b] - w.bounds[k - at], len(body))
                kept, end = [], 0
                for x, y in zip(starts[np.flatnonzero(edge > 0)].tolist(), starts[np.flatnonzero(edge < 0)].tolist(), strict=True):
                    kept.append(body[end:x])
                    end = y
                new[k] = b"".join([*kept, body[end:]]).rstrip()
                n_deleted[k], lost[k] = len(np.unique(unit[a:b][gone])), gone.sum()
    columns = piece.columns[:-1]
    if new:
        columns[place] = pa.array([new.get(k, x) for k, x in enumerate(texts.to_pylist())], pa.binary()).cast(pa.string()).cast(piece.schema.field(place).type)
    return pa.RecordBatch.from_arrays([*columns, *map(pa.array, (n_units, n_deleted, lost))], names=names)


def batch_of(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*rows, strict=True) if rows else [[]] * len(schema), schema, strict=True)], schema=schema)
