"""Toxicity: a bidirectional gated recurrent network over words and their characters.

A word enters as the sum of its own embedding (words seen often enough in training) and those of its
character trigrams, so unseen words with a known stem still speak. A run of letters longer than ``LETTERS``
bytes (glued words, scripts without blanks) enters as overlapping pieces, each a step of its own. Two GRUs read a window of words in
both directions, attention weighs the states, a logistic unit gives the window's score. All windows
of ``WINDOW`` words at every ``STRIDE`` words are scored; a document's score is its highest
window's. Training in numpy follows the same rule: each document learns through the window that
scores highest, with Adam on the logistic loss.
"""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bucket, keep_rows, materialize, per_document

WINDOW, STRIDE = 48, 24
HIDDEN, WIDTH, GRAMS, LETTERS = 8, 12, 8192, 20
_WORD = re.compile(rb"[0-9A-Za-z\x80-\xff]+")
#: Words whose input parts a worker remembers.
MEMO = 100_000


def words_of(text: bytes) -> list[bytes]:
    """Words; of longer ones pieces of ``LETTERS`` bytes that overlap by two, so that every trigram lies in one of them."""
    found = _WORD.findall(text.lower())
    if max(map(len, found), default=0) <= LETTERS:
        return found
    return [w[at : at + LETTERS] for w in found for at in range(0, max(1, len(w) - 2), LETTERS - 2)]


def grams_of(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashed character trigrams, place by place, of words with an opening and a closing mark; the second array is 0 where a word has ended."""
    short = [b"^" + w + b"$" for w in words]
    n = np.fromiter(map(len, short), np.int64, len(short))
    raw = np.frombuffer(b"".join(w.ljust(LETTERS + 2, b"\0") for w in short), np.uint8).reshape(-1, LETTERS + 2).astype(np.int64)
    code = (raw[:, :-2] * 7919 + raw[:, 1:-1] * 104729 + raw[:, 2:] * 1299709 >> 3) % GRAMS
    return code, (np.arange(LETTERS) < (n - 2)[:, None]).astype(np.float32)


def sigmoid(x):
    return 0.5 * np.tanh(0.5 * x) + 0.5


def start(vocab: list[bytes], seed: int = 7) -> dict[str, np.ndarray]:
    r = np.random.default_rng(seed)
    draw = lambda *shape, s=0.3: (r.standard_normal(shape) * s).astype(np.float32)
    m = {"word": draw(len(vocab) + 1, WIDTH, s=0.05), "gram": draw(GRAMS, WIDTH, s=0.05), "v": draw(2 * HIDDEN), "out": draw(2 * HIDDEN), "bias": np.full(1, -0.5, np.float32)}
    for d in "fb":
        m |= {f"W{d}": draw(WIDTH, 3 * HIDDEN), f"U{d}": draw(HIDDEN, 3 * HIDDEN), f"c{d}": np.zeros(3 * HIDDEN, np.float32)}
    return m


def inputs(m: dict, numbers: np.ndarray, code: np.ndarray, real: np.ndarray) -> np.ndarray:
    """A word's vector: its embedding (number 0: unknown) plus those of its trigrams."""
    out = m["word"][numbers].copy()
    for k in range(LETTERS):
        some = real[:, k] > 0
        if some.any():
            out[some] += m["gram"][code[some, k]]
    return out


def gru(px: np.ndarray, u: np.ndarray, mask: np.ndarray, back: bool, keep: bool):
    """States of one direction. px: time x 3H x rows input parts; a masked step carries the state on."""
    steps, _, rows = px.shape
    h = np.zeros((HIDDEN, rows), np.float32)
    states = np.empty((steps, HIDDEN, rows), np.float32)
    trace, turned, half = [], np.ascontiguousarray(u.T), np.float32(0.5)
    whole = mask.all(axis=1)
    for t in range(steps - 1, -1, -1) if back else range(steps):
        hu = turned @ h
        zr = np.tanh((px[t, : 2 * HIDDEN] + hu[: 2 * HIDDEN]) * half) * half + half
        z, r = zr[:HIDDEN], zr[HIDDEN:]
        g = np.tanh(px[t, 2 * HIDDEN :] + r * hu[2 * HIDDEN :])
        a = 1 - z if whole[t] else (1 - z) * mask[t]
        if keep:
            trace.append((t, h, z, r, g, hu[2 * HIDDEN :], a))
        h = h + a * (g - h)
        states[t] = h
    return states, trace


def forward(m: dict, p: np.ndarray, mask: np.ndarray, keep: bool = False):
    """Scores (before the logistic) of windows; p: time x 6H x rows, the two directions' input parts."""
    sf, tf = gru(p[:, : 3 * HIDDEN], m["Uf"], mask, False, keep)
    sb, tb = gru(p[:, 3 * HIDDEN :], m["Ub"], mask, True, keep)
    e = np.matmul(m["v"][:HIDDEN], sf) + np.matmul(m["v"][HIDDEN:], sb) + (mask - 1) * np.float32(1e9)
    w = np.exp(e - e.max(axis=0))
    w /= w.sum(axis=0)
    pooled = np.concatenate([np.einsum("tn,thn->hn", w, sf), np.einsum("tn,thn->hn", w, sb)])
    return m["out"] @ pooled + m["bias"][0], (sf, sb, w, pooled, tf, tb)


def backward(m: dict, p: np.ndarray, mask: np.ndarray, kept, d: np.ndarray):
    """Gradients of the parameters and of p, from those of the scores."""
    sf, sb, w, pooled, tf, tb = kept
    s = np.concatenate([sf, sb], axis=1)
    g = {"out": pooled @ d, "bias": np.array([d.sum()])}
    dp = m["out"][:, None] * d
    dw = (s * dp).sum(axis=1)
    de = w * (dw - (w * dw).sum(axis=0))
    g["v"] = np.einsum("tn,thn->h", de, s)
    ds = w[:, None] * dp + de[:, None] * m["v"][:, None]
    px = np.zeros_like(p)
    for x, (name, trace) in enumerate((("Uf", tf), ("Ub", tb))):
        u, gu, dh = m[name], np.zeros_like(m[name]), 0
        for t, h, z, r, gate, hu, a in reversed(trace):
            dh = dh + ds[t][x * HIDDEN : (x + 1) * HIDDEN]
            dg = dh * a * (1 - gate * gate)
            dz = dh * (h - gate) * mask[t] * z * (1 - z)
            dr = dg * hu * r * (1 - r)
            px[t, 3 * HIDDEN * x : 3 * HIDDEN * (x + 1)] = np.concatenate([dz, dr, dg])
            through = np.concatenate([dz, dr, dg * r])
            gu += h @ through.T
            dh = dh * (1 - a) + u @ through
        g[name] = gu
    return g, px


def cut(numbers: np.ndarray) -> np.ndarray:
    """A document's windows over word numbers, -1 behind its end; together they cover every word. No words: one empty window."""
    n = len(numbers)
    count = max(1, -(-max(0, n - WINDOW) // STRIDE) + 1)
    out = np.full((count, WINDOW), -1, np.int64)
    for k in range(count):
        part = numbers[k * STRIDE : k * STRIDE + WINDOW]
        out[k, : len(part)] = part
    return out


def gathered(parts: np.ndarray, places: np.ndarray) -> np.ndarray:
    """time x 6H x rows"""
    return np.ascontiguousarray(parts[places].transpose(0, 2, 1))


def score_windows(m: dict, parts: np.ndarray, windows: np.ndarray, step: int = 1024) -> np.ndarray:
    """parts: distinct words x 6H (the last row for places behind the end)."""
    out = []
    for at in range(0, len(windows), step):
        w = windows[at : at + step].T
        out.append(forward(m, gathered(parts, w), (w >= 0).astype(np.float32))[0])
    return np.concatenate(out)


def parts_of(m: dict, x: np.ndarray) -> np.ndarray:
    own = np.concatenate([x @ m["Wf"] + m["cf"], x @ m["Wb"] + m["cb"]], axis=1)
    return np.concatenate([own, np.zeros((1, own.shape[1]), np.float32)])


def train(texts: list[bytes], labels: list[int], epochs: int | None = None, steps: int = 200, rate: float = 0.015, least: int = 3, seed: int = 7) -> dict:
    """Weights and vocabulary from labelled texts; one class only: a constant score.

    Adam makes ``steps`` steps of 128 windows, whatever the sample's size (``epochs``: that many passes instead). Every
    weight begins at random, so all that the network knows comes from its training.
    """
    y = np.array(labels, np.float32)
    if not len(y) or y.min() == y.max():
        return {"m": None, "constant": float(y.mean()) if len(y) else 0.0}
    docs = [words_of(t) for t in texts]
    held = Counter(w for d in docs for w in set(d))
    vocab = sorted(w for w, n in held.items() if n >= least)
    number = {w: i + 1 for i, w in enumerate(vocab)}
    words = sorted(held)
    place = {w: i for i, w in enumerate(words)}
    numbers = np.array([number.get(w, 0) for w in words])
    code, real = grams_of(words)
    m = start(vocab, seed)
    windows = [cut(np.array([place[w] for w in d], np.int64)) for d in docs]
    flat, owner = np.concatenate(windows), np.repeat(np.arange(len(docs)), list(map(len, windows)))
    r = np.random.default_rng(seed)
    mean, square, t = {k: np.zeros_like(v) for k, v in m.items()}, {k: np.zeros_like(v) for k, v in m.items()}, 0
    places_of = np.split(np.arange(len(flat)), np.cumsum(list(map(len, windows)))[:-1])
    end = steps if epochs is None else epochs * -(-(len(docs) + int((y == 0).sum())) // 128)
    while t < end:
        scores = score_windows(m, parts_of(m, inputs(m, numbers, code, real)), flat)
        order = np.lexsort((scores, owner))
        last = np.append(owner[order][1:] != owner[order][:-1], True)
        chosen = order[last]
        # clean documents also learn from one more window
        more = np.array([places_of[k][r.integers(len(places_of[k]))] for k in np.flatnonzero(y == 0)])
        take = r.permutation(np.concatenate([chosen, more]))
        for at in range(0, min(len(take), 128 * (end - t)), 128):
            rows = take[at : at + 128]
            w = flat[rows].T
            used, back = np.unique(w[w >= 0], return_inverse=True)
            t += 1
            if not len(used):
                continue
            x = inputs(m, numbers[used], code[used], real[used])
            local = np.full(w.shape, -1)
            local[w >= 0] = back
            p, mask = gathered(parts_of(m, x), local), (w >= 0).astype(np.float32)
            score, kept = forward(m, p, mask, True)
            g, px = backward(m, p, mask, kept, ((sigmoid(score) - y[owner[rows]]) / len(rows)).astype(np.float32))
            gx = np.zeros((len(used) + 1, 6 * HIDDEN), np.float32)
            np.add.at(gx, local.ravel(), px.transpose(0, 2, 1).reshape(-1, 6 * HIDDEN))
            gx = gx[:-1]
            f, b = gx[:, : 3 * HIDDEN], gx[:, 3 * HIDDEN :]
            g |= {"Wf": x.T @ f, "Wb": x.T @ b, "cf": f.sum(axis=0), "cb": b.sum(axis=0)}
            d = f @ m["Wf"].T + b @ m["Wb"].T
            g["word"] = np.zeros_like(m["word"])
            np.add.at(g["word"], numbers[used], d)
            g["gram"] = np.zeros_like(m["gram"])
            rows_, cols = np.nonzero(real[used])
            np.add.at(g["gram"], code[used][rows_, cols], d[rows_])
            for k, v in m.items():
                mean[k] = 0.9 * mean[k] + 0.1 * g[k]
                square[k] = 0.99 * square[k] + 0.01 * g[k] ** 2
                v -= (rate * mean[k] / (1 - 0.9**t) / (np.sqrt(square[k] / (1 - 0.99**t)) + 1e-6)).astype(np.float32)
    return {"m": m, "number": number}


class Scorer:
    """Scores texts; the input parts of words are remembered up to ``MEMO`` words."""

    def __init__(self, model: dict):
        self.model = model
        self.place: dict[bytes, int] = {}
        self.parts, self.used = np.zeros((1, 6 * HIDDEN), np.float32), 0

    def __call__(self, texts: list[bytes]) -> np.ndarray:
        m = self.model["m"]
        if m is None:
            return np.full(len(texts), self.model["constant"])
        if len(self.place) > MEMO:
            self.place, self.used = {}, 0
        docs = [words_of(t) for t in texts]
        new = list(set().union(*docs).difference(self.place))
        if new:
            code, real = grams_of(new)
            own = parts_of(m, inputs(m, np.array([self.model["number"].get(w, 0) for w in new]), code, real))[:-1]
            end = self.used + len(new)
            if end >= len(self.parts):
                self.parts = np.concatenate([self.parts[: self.used], np.zeros((end + 20_000, 6 * HIDDEN), np.float32)])
            self.parts[self.used : end] = own
            self.place.update(zip(new, range(self.used, end)))
            self.used = end
        windows = [cut(np.fromiter(map(self.place.__getitem__, d), np.int64, len(d))) for d in docs]
        counts = np.array(list(map(len, windows)))
        scores = score_windows(m, self.parts, np.concatenate(windows))
        best = sigmoid(np.maximum.reduceat(scores, np.concatenate([[0], np.cumsum(counts)[:-1]])).astype(np.float64))
        return np.where([bool(d) for d in docs], best, 0.0)


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, folds: int, held: int, bound: int, longest: int = 1 << 17) -> tuple[list[bytes], list[int]]:
    """At most ``bound`` labelled rows a class, outside the held-out fold, chosen by a hash of the id: (texts, labels).

    Of several texts under one id the one with the smallest hash counts, and texts of more than ``longest`` bytes aren't learned from,
    so at most ``2 * bound * longest`` bytes come to the driver.
    """
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("int").alias("y")).where(F.col("y").isin(0, 1) & F.col("doc_id").isNotNull() & (bucket("doc_id", folds) != held)).distinct()
    ranked = [known.where(F.col("y") == k).orderBy(F.xxhash64("doc_id"), "doc_id").limit(bound) for k in (0, 1)]
    chosen = materialize(ranked[0].union(ranked[1]), "sample")  # at most 2 * bound rows of two numbers
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text")).where(F.octet_length("text") <= longest)
    rows = texts.join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "y").agg(F.min_by("text", F.struct(F.xxhash64("text"), "text")).alias("text")).toLocalIterator()
    rows = sorted((r.doc_id, r.text, r.y) for r in rows)
    return [t.encode() for _, t, _ in rows], [y for *_, y in rows]


def fit(docs: DataFrame, labels: DataFrame, bound: int = 1200, folds: int = 4, held: int = 2) -> dict:
    return train(*labelled_sample(docs, labels, "toxic", folds, held, bound))


def toxicity(docs: DataFrame, model: dict, threshold: float = 0.3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id``, ``score`` (0 to 1), ``predicted`` per row. Texts without words (null and empty ones too) have nothing that speaks for toxicity: score 0."""

    def make():
        scorer = Scorer(model)

        def work(texts: list[bytes]) -> list[list]:
            s = np.clip(np.concatenate([scorer(texts[at : at + 128]) for at in range(0, len(texts), 128)]), 0, 1) if texts else np.zeros(0)
            return [s, (s >= threshold).astype(int)]

        return work

    return per_document(docs, make, "score double, predicted int", id_col, text_col)


def drop_toxic(docs: DataFrame, model: dict, threshold: float = 0.3, text_col: str = "text") -> DataFrame:
    """The rows that score below ``threshold``, with all their columns."""

    def make():
        scorer = Scorer(model)
        return lambda texts: np.concatenate([scorer(texts[at : at + 128]) < threshold for at in range(0, len(texts), 128)])

    return keep_rows(docs, make, text_col)
