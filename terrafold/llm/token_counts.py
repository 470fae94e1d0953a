"""Token counts by a linear longest-match automaton.

A trie over the bytes of the vocabulary has two roots: pieces that begin a word and pieces that go on
in one. Each node has a failure link, the node where matching goes on when the next byte has no edge,
and the number of pieces that are popped on the way. So a word's number of greedy longest-match
pieces takes time linear in its length, and no piece is ever built (Song et al., 2021).
"""

from __future__ import annotations

import json
from collections import deque
from collections.abc import Iterable
from functools import lru_cache

from pyspark.sql import DataFrame

from .common import per_document

#: Words that a worker remembers before it starts anew, and the longest that it remembers at all: 40 MB or so.
MEMO = 300_000
LONGEST = 64
_FIRST, _NEXT = 0, 1


class PieceCounter:
    def __init__(self, first: Iterable[bytes], following: Iterable[bytes]):
        #: (node * 256 + byte) -> node
        self.edges: dict[int, int] = {}
        whole = [False, False]
        children: list[list[tuple[int, int]]] = [[], []]
        for root, pieces in ((_FIRST, first), (_NEXT, following)):
            for piece in pieces:
                node = root
                for byte in piece:
                    key = node << 8 | byte
                    after = self.edges.get(key)
                    if after is None:
                        after = self.edges[key] = len(whole)
                        whole.append(False)
                        children.append([])
                        children[node].append((byte, after))
                    node = after
                if piece:
                    whole[node] = True
        #: where to go on (-1: nowhere) and how many pieces that pops
        self.fail, self.pops = [-1] * len(whole), [0] * len(whole)
        queue = deque([_FIRST, _NEXT])
        while queue:
            parent = queue.popleft()
            for byte, node in children[parent]:
                queue.append(node)
                if whole[node]:
                    self.fail[node], self.pops[node] = _NEXT, 1
                    continue
                at, popped = self.fail[parent], self.pops[parent]
                while at >= 0 and (at << 8 | byte) not in self.edges:
                    popped += self.pops[at]
                    at = self.fail[at]
                if at >= 0:
                    self.fail[node], self.pops[node] = self.edges[at << 8 | byte], popped
        self.memo: dict[bytes, int] = {}

    def count(self, word: bytes) -> int:
        """Pieces of a word; 1 (the unknown token) if it can't be covered."""
        edges, fail, pops, node, total = self.edges, self.fail, self.pops, _FIRST, 0
        for byte in word:
            while (after := edges.get(node << 8 | byte)) is None:
                total += pops[node]
                node = fail[node]
                if node < 0:
                    return 1
            node = after
        while node != _NEXT:
            total += pops[node]
            node = fail[node]
            if node < 0:
                return 1
        return total

    def text(self, text: bytes) -> tuple[int, int]:
        """Words (separated by ASCII white space) and pieces of a text."""
        words, memo = text.split(), self.memo
        if len(memo) > MEMO:
            memo.clear()
        long: dict[bytes, int] = {}
        for w in set(words).difference(memo):
            (memo if len(w) <= LONGEST else long)[w] = self.count(w)
        if not long:
            return len(words), sum(map(memo.__getitem__, words))
        return len(words), sum(long[w] if len(w) > LONGEST else memo[w] for w in words)


@lru_cache(maxsize=2)
def counter(path: str) -> PieceCounter:
    """From a byte-level vocabulary file: tokens that begin with a blank begin words, those without white space go on in them."""
    from .bpe import byte_letters

    letters = byte_letters()
    with open(path, encoding="utf-8") as f:
        data = json.load(f)
    special = {t["content"] for t in data["added_tokens"]}
    tokens = [bytes(map(letters.__getitem__, t)) for t in data["model"]["vocab"] if t not in special]
    return PieceCounter([t[1:] for t in tokens if t[:1] == b" " and len(t.split()) == 1], [t for t in tokens if not t[:1].isspace()])


def token_counts(docs: DataFrame, vocabulary_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id``, ``n_words``, ``n_tokens`` per row; null and empty texts have none."""

    def make():
        pieces = counter(vocabulary_path)
        return lambda texts: [list(x) for x in zip(*map(pieces.text, texts), strict=True)] or [[], []]

    return per_document(docs, make, "n_words long, n_tokens long", id_col, text_col)
