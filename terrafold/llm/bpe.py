"""Byte-level BPE as a bounded-lookahead streaming transducer.

BPE can be run left to right. A merge depends on what follows only through merges of higher
priority that take its right part away, those only through merges of still higher priority, and so
on; every link of such a chain reaches at most one token further. :meth:`Bpe.lookahead` is the
longest reach of any chain, found in one pass over the merge list. A token that ends that far before
the end of what has been read can never change. So long pieces are read in windows, stable tokens go
out, and the next window starts at the end of the last one that went out.

Texts are read in stretches of about ``STRETCH`` bytes that end where a piece begins whatever stands
around it: before white space, or where letters, numbers and other characters change. Beside the text
itself, memory holds one stretch and its ids; where a single piece is longer, a copy of that piece.
"""

from __future__ import annotations

import codecs
import hashlib
import heapq
import json
import re
import sys
import unicodedata
from collections.abc import Iterable, Iterator
from functools import lru_cache
from itertools import chain, islice

import numpy as np
import regex
from pyspark.sql import DataFrame

from .common import per_document

#: Fixed value: the byte-level splitting pattern of the vocabulary.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
MEMO = 260_000
#: Bytes of a text that are encoded together.
STRETCH = 1 << 16
_BETWEEN = re.compile(rb"[0-9A-Za-z](?= [0-9A-Za-z])")
#: Where a piece begins and no piece before depends on what follows: before white space, at a change of class, but not from an apostrophe to a letter.
_BEGINS = regex.compile(r"(?<=\S)(?=\s)|(?<=[\p{L}\p{N}])(?=[^\s\p{L}\p{N}])|(?<=\p{L})(?=\p{N})|(?<=\p{N})(?=\p{L})|(?<=[^\s\p{L}\p{N}'])(?=[\p{L}\p{N}])")


def newer_letters(path: str) -> str:
    """Letters and numbers of the ``regex`` module's Unicode version that the tokenizers library doesn't take for such yet.

    Only code points that Python's own tables call unassigned come into question; the library is
    asked where it splits ``'re`` off: after a letter or number, but not after anything else.
    """
    from tokenizers import Tokenizer

    split = Tokenizer.from_file(path).pre_tokenizer
    known = regex.compile(r"[\p{L}\p{N}]")
    unassigned = "".join(c for c in map(chr, range(0x80, sys.maxunicode + 1)) if unicodedata.category(c) == "Cn")
    return "".join(c for c in known.findall(unassigned) if split.pre_tokenize_str(f"{c}'re")[0][1][1] > 1)


def byte_letters() -> dict[str, int]:
    """The printable letter that stands for each byte in byte-level vocabularies: itself where printable, else the next free one from U+0100."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(other)}


class Bpe:
    def __init__(self, vocab: dict[bytes, int], merges: list[tuple[bytes, bytes]], special: dict[str, int] | None = None, newer: str = ""):
        self.special = special or {}
        self.marks = [t.encode() for t in self.special]
        self.text_of = {i: t for t, i in vocab.items()} | {i: t.encode() for t, i in self.special.items()}
        self.single = [vocab[bytes([b])] for b in range(256)]
        #: pair of ids -> rank of its merge; the id that the merge makes
        self.rank_of = {(vocab[a], vocab[b]): rank for rank, (a, b) in enumerate(merges)}
        self.made = [vocab[a + b] for a, b in merges]
        self.reach = self.lookahead(merges)
        self.window = max(4096, 2 * self.reach)
        self.split = regex.compile(PATTERN)
        self.newer = frozenset(newer)
        #: the same pattern with the newer letters and numbers among the other characters
        self.careful = regex.compile(PATTERN.replace(r"[^\s\p{L}\p{N}]", r"(?:[^\s\p{L}\p{N}]|\L<newer>)").replace(r"\p{L}+", r"(?:(?!\L<newer>)\p{L})+").replace(r"\p{N}+", r"(?:(?!\L<newer>)\p{N})+"), newer=self.newer) if newer else None
        self.cut = regex.compile("|".join(map(regex.escape, self.special))) if self.special else None
        self.pieces: dict[str, bytes] = {}
        self.chunks: dict[bytes, bytes | None] = {}

    @classmethod
    def load(cls, path: str) -> Bpe:
        with open(path, encoding="utf-8") as f:
            data = json.load(f)
        letters = byte_letters()
        to_bytes = lambda s: bytes(map(letters.__getitem__, s))
        special = {t["content"]: t["id"] for t in data["added_tokens"]}
        vocab = {to_bytes(t): i for t, i in data["model"]["vocab"].items() if t not in special}
        return cls(vocab, [tuple(map(to_bytes, m if isinstance(m, list) else m.split(" "))) for m in data["model"]["merges"]], special, newer_letters(path))

    @staticmethod
    def lookahead(merges: list[tuple[bytes, bytes]]) -> int:
        """Bytes after a token beyond which nothing can change it.

        ``far[u]``: how far past ``u`` the merges seen so far that start with ``u`` read, their own
        dependence included. A new merge ``(a, b)`` depends on earlier ones that start with ``b`` or
        with a token on the right edge of ``b``.
        """
        far: dict[bytes, int] = {}
        right: dict[bytes, bytes] = {}
        for a, b in merges:
            edge, own = b, 0
            while True:
                own = max(own, far.get(edge, 0))
                if edge not in right:
                    break
                edge = right[edge]
            far[a] = max(far.get(a, 0), len(b) + own)
            right.setdefault(a + b, b)
        return max(far.values(), default=0)

    def merge(self, data: bytes) -> list[int]:
        """All merges of one bounded stretch, lowest rank first, leftmost first."""
        ids = list(map(self.single.__getitem__, data))
        rank_of, made, none = self.rank_of.get, self.made, len(self.made)
        ranks = [rank_of(p, none) for p in zip(ids, ids[1:])]
        if len(ids) < 200:
            while ranks and (best := min(ranks)) < none:
                i = ranks.index(best)
                ids[i : i + 2] = [made[best]]
                del ranks[i]
                if i:
                    ranks[i - 1] = rank_of((ids[i - 1], ids[i]), none)
                if i < len(ranks):
                    ranks[i] = rank_of((ids[i], ids[i + 1]), none)
            return ids
        n = len(ids)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(rank, i) for i, rank in enumerate(ranks) if rank < none]
        heapq.heapify(heap)
        while heap:
            rank, i = heapq.heappop(heap)
            j = after[i]
            if ids[i] < 0 or j >= n or rank_of((ids[i], ids[j])) != rank:
                continue
            ids[i], ids[j] = made[rank], -1
            after[i] = k = after[j]
            if k < n:
                before[k] = i
                if (x := rank_of((ids[i], ids[k]))) is not None:
                    heapq.heappush(heap, (x, i))
            if (h := before[i]) >= 0 and (x := rank_of((ids[h], ids[i]))) is not None:
                heapq.heappush(heap, (x, h))
        return [x for x in ids if x >= 0]

    def stream(self, data: bytes):
        """Ids of one piece of any length, each as soon as it is stable."""
        at, n = 0, len(data)
        while n - at > self.window + self.reach:
            end, sure = at, at + self.window
            for t in self.merge(data[at : sure + self.reach]):
                if end + len(self.text_of[t]) > sure:
                    break
                end += len(self.text_of[t])
                yield t
            at = end
        yield from self.merge(data[at:])

    def piece(self, text: str) -> bytes:
        got = self.pieces.get(text)
        if got is None:
            got = np.fromiter(self.stream(text.encode()), "<u4").tobytes()
            if len(text) < 64:
                if len(self.pieces) > MEMO:
                    self.pieces.clear()
                self.pieces[text] = got
        return got

    def splitter(self, text: str) -> regex.Pattern:
        return self.split if text.isascii() or self.newer.isdisjoint(text) else self.careful

    def plain(self, text: str) -> bytes:
        return b"".join(map(self.piece, self.splitter(text).findall(text)))

    def chunk(self, data: bytes) -> bytes | None:
        """Ids of a stretch between single blanks, or None if white space at its ends would join with the blank beside it."""
        try:
            return self.chunks[data]
        except KeyError:
            text = data.decode()
            own = text[1:] if text[:1] == " " else text
            got = None if not own or own[0].isspace() or own[-1].isspace() else self.plain(text)
            if len(data) < 64:
                if len(self.chunks) > MEMO:
                    self.chunks.clear()
                self.chunks[data] = got
            return got

    def encode(self, data: bytes) -> bytes:
        """A text's ids as little-endian unsigned 32-bit integers."""
        return b"".join(self.encoded(data))

    def encoded(self, data: bytes) -> Iterator[bytes]:
        """The ids in parts, a stretch or ``STRETCH`` ids of a longer piece at a time."""
        for part in self.stretches(data):
            if len(part) <= 2 * STRETCH:
                yield self.stretch(part)
            else:
                yield from self.long(part)

    def stretches(self, data: bytes) -> Iterator[bytes]:
        """The text in stretches that can be encoded by themselves; only a piece or a run of special tokens that is longer than ``STRETCH`` makes one over twice that."""
        at = 0
        while len(data) - at > STRETCH and (end := self.edge(data, at + STRETCH)) is not None:
            yield data[at:end]
            at = end
        yield data[at:]

    def edge(self, data: bytes, at: int) -> int | None:
        """The first place from ``at`` on, found block by block, where a piece begins whatever stands around it and no special token is cut."""
        if (m := _BETWEEN.search(data, at, at + 256)) and not self.inside(data, m.end()):
            return m.end()
        while at < len(data):
            at, end = self.letter(data, at), self.letter(data, at + STRETCH)
            text = data[at:end].decode()
            for m in _BEGINS.finditer(text):
                # of the newer letters it isn't asked on which side they stand
                if self.newer.isdisjoint(text[m.start() - 1 : m.start() + 1]):
                    place = at + len(text[: m.start()].encode())
                    if not self.inside(data, place):
                        return place
            if end >= len(data):
                return None
            # the last character is read again, as the first one of the next block
            at = max(at + 1, end - len(text[-1].encode()))
        return None

    @staticmethod
    def letter(data: bytes, at: int) -> int:
        """The first place from ``at`` on where a character begins."""
        while at < len(data) and data[at] & 0xC0 == 0x80:
            at += 1
        return min(at, len(data))

    def inside(self, data: bytes, at: int) -> bool:
        """Whether a special token stands across ``at``."""
        return any(data.find(mark, max(0, at - len(mark) + 1), at + len(mark) - 1) >= 0 for mark in self.marks)

    def long(self, data: bytes) -> Iterator[bytes]:
        """Ids of a stretch that is longer than the others, piece by piece, a long piece in parts."""
        text, at = data.decode(), 0
        for m in chain(self.cut.finditer(text) if self.cut else (), [None]):
            plain = text[at : m.start() if m else len(text)]
            for p in self.splitter(plain).finditer(plain):
                ids = self.stream(p.group().encode())
                while part := np.fromiter(islice(ids, STRETCH), "<u4").tobytes():
                    yield part
            if m:
                at = m.end()
                yield np.array([self.special[m.group()]], "<u4").tobytes()

    def stretch(self, data: bytes) -> bytes:
        """Ids of a stretch.

        Where single blanks separate other characters, a piece always begins at the blank; such
        stretches are remembered whole. Texts with other white space runs go piece by piece.
        """
        if any(mark in data for mark in self.marks):
            text, out, at = data.decode(), [], 0
            for m in self.cut.finditer(text):
                out += [self.plain(text[at : m.start()]), np.array([self.special[m.group()]], "<u4").tobytes()]
                at = m.end()
            return b"".join([*out, self.plain(text[at:])])
        first, *rest = data.split(b" ")
        parts = [*([self.chunk(first)] if first else []), *map(self.chunk, [b" " + x for x in rest])]
        return self.plain(data.decode()) if None in parts else b"".join(parts)

    def decode(self, ids) -> str:
        """Text of ids: bytes go through an incremental UTF-8 machine, broken sequences become U+FFFD."""
        return "".join(self.decoded([np.array(list(ids), "<u4").tobytes()]))

    def decoded(self, parts: Iterable[bytes]) -> Iterator[str]:
        """The text of ids that come in parts, in parts."""
        machine, table = codecs.getincrementaldecoder("utf-8")("replace"), self.text_of
        for part in parts:
            yield machine.decode(b"".join(map(table.__getitem__, np.frombuffer(part, "<u4").tolist())))
        yield machine.decode(b"", True)


@lru_cache(maxsize=2)
def loaded(path: str) -> Bpe:
    return Bpe.load(path)


def bpe_round_trip(docs: DataFrame, tokenizer_path: str, with_ids: bool = False, with_text: bool = False) -> DataFrame:
    """Per document: ``n_tokens``, ``ids_sha256``, ``decoded_sha256`` and, on request, ``ids`` (binary, little-endian uint32) and ``decoded``.

    Ids and decoded text pass through the digests in parts; whole ones are held only where they are asked for.
    Null texts count as empty (no ids). Repeated rows give repeated rows.
    """

    def make():
        bpe = loaded(tokenizer_path)

        def one(data: bytes) -> tuple:
            n, ids, told, kept, text = 0, hashlib.sha256(), hashlib.sha256(), [], []

            def seen() -> Iterator[bytes]:
                nonlocal n
                for part in bpe.encoded(data):
                    n += len(part) // 4
                    ids.update(part)
                    if with_ids:
                        kept.append(part)
                    yield part

            for part in bpe.decoded(seen()):
                told.update(part.encode())
                if with_text:
                    text.append(part)
            return n, ids.hexdigest(), told.hexdigest(), *[b"".join(kept)] * with_ids, *["".join(text)] * with_text

        return lambda texts: list(map(list, zip(*map(one, texts), strict=True))) or [[]] * (3 + with_ids + with_text)

    return per_document(docs, make, "n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids binary" * with_ids + ", decoded string" * with_text)
