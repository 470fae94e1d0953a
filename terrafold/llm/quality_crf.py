"""Quality: a linear-chain conditional random field over a document's lines.

Every line is good or bad. Its own features and those of the lines before and behind it speak for
either label, and a pair of neighbouring labels has a weight that also depends on how alike the two
lines are. Forward-backward gives each line's probability of being good; the document's score is
their mean weighted by line length. Only documents are labelled, so the lines' labels are latent: training
fits the weighted mean itself to the document's label, and a bad document may hold good lines.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame

from .common import per_document
from .toxicity import labelled_sample

_SYMBOLS, _DIGITS = b"#*$%&|<>{}[]=_~^@+/\\", b"0123456789"
_UPPER, _MARKS = bytes(range(65, 91)), b"!?.,;:"
OWN = 16
#: Lines, padding included, whose marginals are taken at once.
CELLS = 1 << 18


def line_features(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Features of each line with a word, and their lengths in bytes; a text without words is one empty line."""
    rows, done, sizes, seen = [], [], [], set()
    before: set[bytes] = set()
    for line in text.split(b"\n"):
        words = line.split()
        if not words:
            continue
        n, k, kinds = len(line), len(words), set(words)
        cut = lambda drop: n - len(line.translate(None, drop))  # noqa: E731, B023
        marks, symbols = cut(_MARKS), cut(_SYMBOLS)
        low = {w.lower() for w in kinds}
        rows.append((
            1.0, min(k, 100) / 50, k < 4, k < 12, (n - k + 1) / k / 10, cut(_UPPER) / n, cut(_DIGITS) / n * 3, symbols / n * 5, marks / n * 3,
            line.count(b"!") / n * 5, len(kinds) / k, k > 8 and 2 * len(kinds) < k, line in seen, len(low & before) / len(low), words[-1][-1:] in b".!?", line[:1].isupper(),
        ))
        sizes.append(n)
        seen.add(line)
        before = low
        if len(rows) == 4096:
            done.append(np.array(rows, np.float32))
            rows.clear()
    if not sizes:
        rows, sizes = [(1.0, *[0.0] * (OWN - 1))], [1]
    return np.concatenate([*done, np.array(rows, np.float32).reshape(-1, OWN)]), np.array(sizes, np.float64)


def with_neighbours(f: np.ndarray) -> np.ndarray:
    """A line's features, the previous line's, the next line's (zeros at the ends)."""
    zero = np.zeros((1, OWN))
    return np.concatenate([f, np.concatenate([zero, f[:-1]]), np.concatenate([f[1:], zero])], axis=1)


def likeness(f: np.ndarray) -> np.ndarray:
    """How alike neighbouring lines are, 0 to 1."""
    return np.exp(-np.abs(f[1:, 4:10] - f[:-1, 4:10]).sum(axis=1) * 2)


def chains(docs: list[np.ndarray]):
    """Documents by falling number of lines: order, lengths, padded features, likeness of neighbouring lines."""
    order = np.argsort([-len(d) for d in docs], kind="stable")
    n = np.array([len(docs[i]) for i in order])
    x, like = np.zeros((n[0], len(docs), 3 * OWN)), np.ones((n[0] - 1, len(docs)))
    for k, i in enumerate(order):
        x[: n[k], k] = with_neighbours(docs[i])
        like[: n[k] - 1, k] = likeness(docs[i])
    return order, n, x, like


def marginals(w: dict, n: np.ndarray, x: np.ndarray, like: np.ndarray):
    """P(good) of each line, P(equal labels) of each pair of neighbours and log Z of each document. Potentials: +-e/2 for a line, +-c/2 for a pair."""
    return forward_backward(n, np.clip(x @ w["line"], -30, 30), pair_field(w, like))


def pair_field(w: dict, like: np.ndarray) -> np.ndarray:
    return np.clip(w["pair"][0] + w["pair"][1] * like, -10, 10)


def line_field(w: dict, f: np.ndarray) -> np.ndarray:
    own, before, behind = np.split(w["line"], 3)
    e = f @ own
    e[1:] += f[:-1] @ before
    e[:-1] += f[1:] @ behind
    return np.clip(e, -30, 30)


def forward_backward(n: np.ndarray, e: np.ndarray, c: np.ndarray):
    """As :func:`marginals`, from padded fields: lines x documents, and one row less."""
    (steps, rows), e, c = e.shape, e / 2, c / 2
    alive = np.arange(steps)[:, None] < n
    fore = np.zeros((steps, rows, 2))
    back = np.zeros((steps, rows, 2))
    own = np.stack([-e, e], axis=2)
    fore[0] = own[0]
    for t in range(1, steps):
        k = int(np.searchsorted(-n, -t, "left"))  # documents of more than t lines; n falls
        a, s = fore[t - 1, :k], c[t - 1, :k, None]
        fore[t, :k] = own[t, :k] + np.logaddexp(a + s, a[:, ::-1] - s)
    for t in range(steps - 2, -1, -1):
        k = int(np.searchsorted(-n, -t - 1, "left"))
        a, s = back[t + 1, :k] + own[t + 1, :k], c[t, :k, None]
        back[t, :k] = np.logaddexp(a + s, a[:, ::-1] - s)
    both = fore + back
    z = np.logaddexp(both[0, :, 0], both[0, :, 1])
    good = np.exp(np.minimum(0, both[..., 1] - z)) * alive
    a, b = fore[:-1], back[1:] + own[1:]
    equal = np.logaddexp(a[..., 0] + b[..., 0], a[..., 1] + b[..., 1]) + c
    return good, np.exp(np.minimum(0, equal - z)) * alive[1:], z, alive


def batches(lengths: list[int]) -> list[list[int]]:
    """Documents by falling length in groups of at most ``CELLS`` padded lines; a longer one stands alone."""
    out: list[list[int]] = []
    for i in sorted(range(len(lengths)), key=lambda i: -lengths[i]):
        longest = lengths[out[-1][0]] if out else 0
        # of like length, so that padding stays small
        if out and (len(out[-1]) + 1) * longest <= CELLS and 2 * lengths[i] + 8 >= longest:
            out[-1].append(i)
        else:
            out.append([i])
    return out


def padded(w: dict, docs: list[np.ndarray], likes: list[np.ndarray]):
    """Lengths and padded fields of documents that come by falling length."""
    n = np.array(list(map(len, docs)))
    e, like = np.zeros((n[0], len(docs))), np.ones((n[0] - 1, len(docs)))
    for k, (f, own) in enumerate(zip(docs, likes, strict=True)):
        e[: n[k], k] = line_field(w, f)
        like[: n[k] - 1, k] = own
    return n, e, like


def gradient(w: dict, docs: list[np.ndarray], likes: list[np.ndarray], shares: list[np.ndarray], y: np.ndarray, weight: np.ndarray, step: float = 1e-3) -> dict[str, np.ndarray]:
    """The gradient of the weighted log likelihood of the documents' labels under their aggregated marginals.

    A score is the expectation of ``f = sum(share * label)``, so its derivative by a potential is the covariance of f
    with that potential's indicator: how the marginals move when every line's field moves along its share.
    """
    g = {"line": np.zeros(3 * OWN), "pair": np.zeros(2)}
    for part in batches(list(map(len, docs))):
        n, e, like = padded(w, [docs[i] for i in part], [likes[i] for i in part])
        tilt = np.zeros_like(e)
        for k, i in enumerate(part):
            tilt[: n[k], k] = shares[i]
        c = pair_field(w, like)
        good, *_ = forward_backward(n, e, c)
        up, up_equal, *_ = forward_backward(n, e + step * tilt, c)
        down, down_equal, *_ = forward_backward(n, e - step * tilt, c)
        score = np.clip((good * tilt).sum(axis=0), 1e-4, 1 - 1e-4)
        slope = (y[part] - score) / (score * (1 - score)) * weight[part]
        lines, pairs = (up - down) / (2 * step) * slope, (up_equal - down_equal) / (2 * step) * slope
        for k, i in enumerate(part):
            f, moved = docs[i], lines[: n[k], k]
            g["line"] += np.concatenate([moved @ f, moved[1:] @ f[:-1], moved[:-1] @ f[1:]])
        g["pair"] += np.array([pairs.sum(), (pairs * like).sum()])
    return g


def train(texts: list[bytes], labels: list[int], epochs: int | None = None, steps: int = 300, rate: float = 0.05, decay: float = 1e-3, seed: int = 5) -> dict:
    """Weights after ``steps`` steps of Adam on 64 documents each, whatever the sample's size (``epochs``: that many passes instead); one class only: a constant score."""
    y = np.array(labels, np.float64)
    if not len(y) or y.min() == y.max():
        return {"constant": float(y.mean()) if len(y) else 1.0}
    made = [line_features(t) for t in texts]
    docs, shares = [f for f, _ in made], [s / s.sum() for _, s in made]
    likes = [likeness(f) for f in docs]
    w = {"line": np.zeros(3 * OWN), "pair": np.zeros(2)}
    mean, square = {k: np.zeros_like(v) for k, v in w.items()}, {k: np.zeros_like(v) for k, v in w.items()}
    weight = np.where(y > 0, 0.5 / y.sum(), 0.5 / (len(y) - y.sum())) * len(y)
    r, parts = np.random.default_rng(seed), []
    total = steps if epochs is None else epochs * max(1, len(docs) // 64)
    for t in range(1, total + 1):
        parts = parts or np.array_split(r.permutation(len(docs)), max(1, len(docs) // 64))
        part = parts.pop()
        g = gradient(w, [docs[i] for i in part], [likes[i] for i in part], [shares[i] for i in part], y[part], weight[part] / len(part))
        for k in w:
            d = g[k] - decay * w[k]
            mean[k] = 0.9 * mean[k] + 0.1 * d
            square[k] = 0.99 * square[k] + 0.01 * d * d
            w[k] += rate * mean[k] / (1 - 0.9**t) / (np.sqrt(square[k] / (1 - 0.99**t)) + 1e-8)
    return w


def line_marginals(w: dict, texts: list[bytes]) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """P(good) and length of each line of each text."""
    made = [line_features(t) for t in texts]
    out: list = [None] * len(texts)
    for part in batches([len(f) for f, _ in made]):
        docs = [made[i][0] for i in part]
        n, e, like = padded(w, docs, [likeness(f) for f in docs])
        good = forward_backward(n, e, pair_field(w, like))[0]
        for k, i in enumerate(part):
            out[i] = good[: n[k], k]
    return out, [s for _, s in made]


def scores(w: dict, texts: list[bytes]) -> np.ndarray:
    if "constant" in w:
        return np.full(len(texts), w["constant"])
    return np.array([float((p * s).sum() / s.sum()) for p, s in zip(*line_marginals(w, texts), strict=True)])


def fit(docs: DataFrame, labels: DataFrame, bound: int = 1000, folds: int = 3, held: int = 1) -> dict:
    return train(*labelled_sample(docs, labels, "quality", folds, held, bound))


def quality(docs: DataFrame, model: dict, threshold: float = 0.5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id``, ``score`` (0 to 1), ``predicted`` per row. Null and empty texts count as one empty line."""

    def make():
        def work(texts: list[bytes]) -> list[list]:
            # few texts at a time, so that the features of long ones aren't all held
            s = np.clip(np.concatenate([scores(model, texts[at : at + 64]) for at in range(0, len(texts), 64)]), 0, 1) if texts else np.zeros(0)
            return [s, (s >= threshold).astype(int)]

        return work

    return per_document(docs, make, "score double, predicted int", id_col, text_col)
