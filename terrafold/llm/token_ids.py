"""Token-ID output: concatenated ids with Elias-Fano document boundaries.

File format (one Parquet row is one block; ascending in ``part``, ``block``, document):

* ``part``, ``block``: place of the block, ``n_tokens``: ids in it, ``width``: bytes an id takes (2 or 4),
* ``before``: ids in the part's earlier blocks,
* ``doc_ids``: the ids of its documents in order, less ``first_id``, Elias-Fano coded; ``nulls`` documents without an id come before them,
* ``bounds``: the documents' end offsets within the block, Elias-Fano coded,
* ``ids``: all token ids, little-endian.

Global offsets are never stored: a part's start is a prefix sum over the parts' sizes, a block's that
plus ``before``, a document's that plus one ``select`` in ``bounds``. The reader goes forward from one select by as many documents as it takes at once.
"""

from __future__ import annotations

import struct
import zlib
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import arrow_schema, id_and_bytes, materialize, new_path

#: Bytes of words and ids that a worker's memory of encoded words holds before it starts anew, and what an entry takes beside them.
MEMO = 256 << 20
ENTRY = 180
#: Words that go to the tokenizer in one line.
WORDS = 64
#: ASCII punctuation but the apostrophe.
_PUNCTUATION = b'!"#$%&()*+,-./:;<=>?@[\\]^_`{|}~'
#: Parts whose starts are broadcast (16 bytes each).
FEW_PARTS = 200_000
BLOCKS = "part int, block int, n_tokens long, before long, width int, nulls int, first_id long, doc_ids binary, bounds binary, ids binary"


class EliasFano:
    """A non-decreasing sequence in about ``2 + log2(u / n)`` bits a value.

    The low ``l`` bits of each value lie packed; the high parts are a bit string in which value ``i``
    sets bit ``(v >> l) + i``. ``select(i)`` needs one sampled position and a scan of at most
    ``SAMPLE`` set bits.
    """

    SAMPLE = 64
    HEAD = struct.Struct("<4sBQQ")

    def __init__(self, low_bits: int, n: int, top: int, low: np.ndarray, high: np.ndarray, marks: np.ndarray):
        self.low_bits, self.n, self.top, self.low, self.high, self.marks = low_bits, n, top, low, high, marks

    @classmethod
    def build(cls, values) -> EliasFano:
        v = np.asarray(values, np.uint64)
        n, top = len(v), int(v[-1]) if len(v) else 0
        bits = max(0, (top // n).bit_length() - 1) if n else 0
        places = (v >> np.uint64(bits)).astype(np.int64) + np.arange(n)
        high = np.zeros(int(places[-1]) + 1 if n else 0, np.uint8)
        high[places] = 1
        low = ((v[:, None] >> np.arange(bits, dtype=np.uint64)) & np.uint64(1)).astype(np.uint8).ravel()
        return cls(bits, n, top, np.packbits(low, bitorder="little"), np.packbits(high, bitorder="little"), places[:: cls.SAMPLE].astype("<u4"))

    def to_bytes(self) -> bytes:
        return self.HEAD.pack(b"EFB1", self.low_bits, self.n, self.top) + struct.pack("<QQ", len(self.low), len(self.high)) + self.low.tobytes() + self.high.tobytes() + self.marks.tobytes()

    @classmethod
    def from_bytes(cls, data: bytes) -> EliasFano:
        magic, bits, n, top = cls.HEAD.unpack_from(data)
        if magic != b"EFB1":
            raise ValueError("not an Elias-Fano block")
        at = cls.HEAD.size + 16
        n_low, n_high = struct.unpack_from("<QQ", data, cls.HEAD.size)
        body = np.frombuffer(data, np.uint8)
        return cls(bits, n, top, body[at : at + n_low], body[at + n_low : at + n_low + n_high], np.frombuffer(data, "<u4", offset=at + n_low + n_high))

    def _low(self, i: np.ndarray) -> np.ndarray:
        """The packed low bits of values ``i``: nine bytes hold any of them, wherever it begins."""
        if not self.low_bits:
            return np.zeros(len(i), np.uint64)
        padded = np.concatenate([self.low, np.zeros(9, np.uint8)])
        at = i * self.low_bits
        bytes_ = padded[(at // 8)[:, None] + np.arange(9)].astype(np.uint64)
        shift = (at % 8).astype(np.uint64)
        word = (bytes_[:, :8] << np.arange(0, 64, 8, dtype=np.uint64)).sum(axis=1, dtype=np.uint64) >> shift
        word |= np.where(shift > 0, bytes_[:, 8] << (np.uint64(64) - np.maximum(shift, np.uint64(1))), np.uint64(0))
        return word & np.uint64((1 << self.low_bits) - 1)

    def select(self, i) -> np.ndarray:
        """Values ``i`` (numbers from 0, in any order), without decoding the others: a sampled mark, a walk over the set bits of the bytes behind it, its low bits."""
        i = np.atleast_1d(np.asarray(i, np.int64))
        if len(i) and not (0 <= i.min() and i.max() < self.n):
            raise IndexError(i)
        out = np.empty(len(i), np.uint64)
        for mark in np.unique(i // self.SAMPLE):
            own = np.flatnonzero(i // self.SAMPLE == mark) if len(i) > 1 else np.zeros(1, np.int64)
            first = int(self.marks[mark])
            end = int(self.marks[mark + 1]) if mark + 1 < len(self.marks) else 8 * len(self.high)
            ones = np.flatnonzero(np.unpackbits(self.high[first // 8 : (end + 7) // 8], bitorder="little"))
            ones = ones[ones >= first % 8]
            place = ones[i[own] - mark * self.SAMPLE] + first // 8 * 8
            out[own] = (place - i[own]).astype(np.uint64) << np.uint64(self.low_bits)
        return out | self._low(i)

    def run(self, first: int, count: int) -> np.ndarray:
        """``count`` values from ``first`` on: one select finds the first set bit, and the bits behind it give the others in order."""
        if not count:
            return np.zeros(0, np.uint64)
        if first < 0 or first + count > self.n:
            raise IndexError((first, count))
        mark, last = first // self.SAMPLE, (first + count - 1) // self.SAMPLE
        begin = int(self.marks[mark])
        end = int(self.marks[last + 1]) if last + 1 < len(self.marks) else 8 * len(self.high)
        ones = np.flatnonzero(np.unpackbits(self.high[begin // 8 : (end + 7) // 8], bitorder="little"))
        ones = ones[ones >= begin % 8][first - mark * self.SAMPLE :][:count]
        i = np.arange(first, first + count)
        return (ones + begin // 8 * 8 - i).astype(np.uint64) << np.uint64(self.low_bits) | self._low(i)

    def at_most(self, value: int) -> int:
        """How many values are ``value`` or less: a binary search by selects."""
        low, high = 0, self.n
        while low < high:
            mid = (low + high) // 2
            if int(self.select(mid)[0]) <= value:
                low = mid + 1
            else:
                high = mid
        return low

    def values(self) -> np.ndarray:
        return self.run(0, self.n)


class Block:
    """The documents of one block: where each begins and ends, and its id, by selects in two coded sequences."""

    def __init__(self, nulls: int, first_id: int | None, doc_ids: bytes, bounds: bytes):
        self.nulls, self.first_id = nulls, first_id
        self.coded, self.bounds = EliasFano.from_bytes(doc_ids), EliasFano.from_bytes(bounds)

    @staticmethod
    def packed(ids: list[int | None], sizes: list[int]) -> tuple[int, int | None, bytes, bytes]:
        """From ids in rising order, nulls first, and the documents' numbers of tokens."""
        nulls = sum(i is None for i in ids)
        first = ids[nulls] if nulls < len(ids) else None
        coded = EliasFano.build(np.array([i - first for i in ids[nulls:]], np.uint64))
        return nulls, first, coded.to_bytes(), EliasFano.build(np.cumsum(sizes)).to_bytes()

    def __len__(self) -> int:
        return self.bounds.n

    def offsets(self, rank: int, count: int = 1) -> np.ndarray:
        """Begins of ``count`` documents from ``rank`` on, and the end of the last."""
        ends = self.bounds.run(max(rank - 1, 0), count + (rank > 0))
        return np.concatenate([np.zeros(0 if rank else 1, np.uint64), ends]).astype(np.int64)

    def document_at(self, offset: int) -> int:
        """The rank of the document that holds the token at ``offset``."""
        return self.bounds.at_most(offset)

    def ids(self, rank: int, count: int = 1) -> list[int | None]:
        nulls = min(max(self.nulls - rank, 0), count)
        return [None] * nulls + [self.first_id + int(v) for v in self.coded.run(max(rank - self.nulls, 0), count - nulls)]


#: Documents of a block that are read together.
FORWARD = 4096


@lru_cache(maxsize=2)
def _word_encoder(path: str):
    """From a text's bytes to its ids as little-endian uint32 bytes.

    The tokenizer's normaliser, splitter and added tokens never join text across white space, so a
    text's ids are those of its blank-separated pieces in order. Within a piece, ASCII punctuation (but
    the apostrophe, which can begin a suffix) splits off from letters and digits, and A-Z count as
    a-z. So each distinct piece is taken apart once, and each distinct part encoded once.
    """
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    added = [t.content.encode() for t in tokenizer.get_added_tokens_decoder().values()]
    memo: dict[bytes, bytes] = {}
    held = 0
    vocab = tokenizer.get_vocab()
    word_end = np.zeros(max(vocab.values(), default=0) + 1, bool)
    word_end[[i for t, i in vocab.items() if t.endswith("</w>")]] = True

    def take_apart(piece: bytes) -> list[bytes]:
        low = piece.lower()
        if low.isalnum():
            return [low]
        if b"<" in piece and any(t in piece for t in added):
            return [piece]
        body = low.rstrip(_PUNCTUATION)
        tail = low[len(body) :]
        head = body[: len(body) - len(body.lstrip(_PUNCTUATION))]
        body = body[len(head) :]
        if not (head or tail) or not body:
            return [low]
        if not (body.isalnum() or (text := body.decode())[0].isalnum() and text[-1].lower()[-1].isalnum()):
            return [low]
        return [x for x in (head, body, tail) if x]

    def learn(fresh: list[bytes]) -> None:
        for at in range(0, len(fresh), 4096):
            some = fresh[at : at + 4096]
            for x, e in zip(some, tokenizer.encode_batch_fast([x.decode() for x in some], add_special_tokens=False), strict=True):
                memo[x] = array("I", e.ids).tobytes()

    def learn_words(fresh: list[bytes]) -> None:
        """Words of letters go to the tokenizer as lines of words; each ends with its one word-end token. Where the counts differ, one by one."""
        for at in range(0, len(fresh), WORDS):
            some = fresh[at : at + WORDS]
            ids = np.array(tokenizer.encode_batch_fast([b" ".join(some).decode()], add_special_tokens=False)[0].ids, "<u4")
            ends = np.flatnonzero(word_end[ids]) + 1
            if len(ends) != len(some):
                learn(some)
                continue
            data, ends = ids.tobytes(), (4 * ends).tolist()
            memo.update((w, data[a:b]) for w, a, b in zip(some, [0, *ends], ends))

    def encode(texts: list[bytes]) -> list[bytes]:
        nonlocal held
        if held > MEMO:
            memo.clear()
            held = 0
        split = [t.split() for t in texts]
        new = {w: take_apart(w) for w in set().union(*split).difference(memo)}
        fresh = list({x for own in new.values() for x in own if x not in memo})
        letters = [x.isalpha() or not x.isascii() and x.decode().isalpha() for x in fresh]
        learn_words([x for x, plain in zip(fresh, letters, strict=True) if plain])
        learn([x for x, plain in zip(fresh, letters, strict=True) if not plain])
        for w, own in new.items():
            memo[w] = memo[own[0]] if len(own) == 1 else b"".join(map(memo.__getitem__, own))
        held += sum(ENTRY + len(x) + len(memo[x]) for x in new.keys() | set(fresh))
        return [b"".join(map(memo.__getitem__, words)) for words in split]

    return encode


def write_token_ids(docs: DataFrame, tokenizer_path: str, path: str, end_id: int = 1, block_tokens: int = 1 << 20, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Encode every whole text (null: empty), append ``end_id`` and write blocks in ascending document order.

    Documents with equal ids lie side by side, ordered by a hash of their text; null ids come first.
    An empty text gives one document that holds the end id alone; an empty table gives no blocks.
    """
    schema = arrow_schema(docs.sparkSession, BLOCKS)
    end = np.array([end_id], "<u4").tobytes()

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work, part, block = _word_encoder(tokenizer_path), TaskContext.get().partitionId(), 0
        ids: list[int] = []
        held: list[bytes] = []
        size = before = 0

        def full() -> pa.RecordBatch:
            data = np.frombuffer(b"".join(held), "<u4")
            width = 2 if not len(data) or data.max() < 1 << 16 else 4
            nulls, first, coded, bounds = Block.packed(ids, [len(x) // 4 for x in held])
            return pa.RecordBatch.from_pydict({"part": [part], "block": [block], "n_tokens": [len(data)], "before": [before], "width": [width], "nulls": [nulls], "first_id": [first], "doc_ids": [coded], "bounds": [bounds], "ids": [data.astype(f"<u{width}").tobytes()]}, schema=schema)

        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                piece = batch.slice(at, 256)
                for doc, x in zip(piece.column(0).to_pylist(), work(piece.column(1).to_pylist()), strict=True):
                    ids.append(doc)
                    held.append(x + end)
                    size += len(x) // 4 + 1
                    if size >= block_tokens:
                        yield full()
                        ids, held, size, before, block = [], [], 0, before + size, block + 1
        if held:
            yield full()

    # the text's hash and the row's place deal out an id (or null) that many documents or repeated rows share
    placed = id_and_bytes(docs, id_col, text_col).withColumn("row", F.monotonically_increasing_id())
    ordered = placed.repartitionByRange("doc_id", F.xxhash64("text"), "row").sortWithinPartitions("doc_id", F.xxhash64("text")).drop("row")
    ordered.mapInArrow(encode, BLOCKS).write.parquet(path)


def read_token_ids(spark: SparkSession, path: str, with_ids: bool = False) -> DataFrame:
    """Per document of the files: ``doc_id``, ``start`` (ids of all documents before it), ``n_tokens``, ``ids_crc32`` and, on request, ``ids``.

    The parts' starts are one row for each partition that wrote. Up to ``FEW_PARTS`` (checked) they
    are broadcast, so that no block moves; beyond, they are joined.
    """
    blocks = spark.read.schema(BLOCKS).parquet(path)
    parts = blocks.groupBy("part").agg(F.sum("n_tokens").alias("size"))
    parts = materialize(parts.select("part", (F.sum("size").over(Window.orderBy("part")) - F.col("size")).alias("start")), "parts")
    if parts.count() <= FEW_PARTS:
        parts = F.broadcast(parts)
    columns = "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids array<long>" * with_ids
    schema = arrow_schema(spark, columns)

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                ids = np.frombuffer(row["ids"], f"<u{row['width']}").astype("<u4")
                block = Block(row["nulls"], row["first_id"], row["doc_ids"], row["bounds"])
                for rank in range(0, len(block), FORWARD):
                    count = min(FORWARD, len(block) - rank)
                    offsets = block.offsets(rank, count)
                    begins, ends = offsets[:-1], offsets[1:]
                    out = {"doc_id": block.ids(rank, count), "start": row["base"] + begins, "n_tokens": ends - begins, "ids_crc32": [zlib.crc32(ids[a:b].tobytes()) for a, b in zip(begins, ends, strict=True)]}
                    if with_ids:
                        out["ids"] = [ids[a:b].astype(np.int64) for a, b in zip(begins, ends, strict=True)]
                    yield pa.RecordBatch.from_pydict(out, schema=schema)

    return blocks.join(parts, "part").select("nulls", "first_id", "doc_ids", "bounds", "ids", "width", (F.col("start") + F.col("before")).alias("base")).mapInArrow(decode, columns)


def token_ids(docs: DataFrame, tokenizer_path: str, end_id: int = 1) -> DataFrame:
    """Write the files to the shared folder and read them back; see :func:`read_token_ids`."""
    path = new_path(docs.sparkSession, "token_ids")
    write_token_ids(docs, tokenizer_path, path, end_id)
    return read_token_ids(docs.sparkSession, path)
