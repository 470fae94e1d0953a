"""Kernels against brute force, without Spark."""

import collections
import random
import re

import numpy as np
import pytest
import xxhash

from terrafold.llm import bpe, decontaminate, host_rules, line_dedup, quality_crf, simhash, token_counts, token_ids, toxicity
from terrafold.llm.queries import vocabulary

tokenizers = pytest.importorskip("tokenizers")
public = pytest.importorskip("public_tokenizers")

ODD = ["", " ", "\n\n", "a", "<|endoftext|>", "x<|endoftext|> y <|startoftext|>", "  two  blanks \t\n end ", "don't I'll s'.", " a　b c\x1cd\x85e", "é é İ (İ), ́.", "日本語 テキスト", "a" * 5000, "ab" * 4000 + "!", "--**##" * 500, "1²,③ 12345", "�\U0001f600\U0001f468‍\U0001f469"]


def texts(n=60, seed=0):
    r = random.Random(seed)
    words = ["the", "of", "Then", "and,", "x1", "é", "ß.", "(q)", "\n", "", "don't", "12"]
    return ODD + [" ".join(r.choice(words) + r.choice(["", "a", "tion"]) for _ in range(r.randint(0, 60))) for _ in range(n)]


@pytest.fixture(scope="module")
def byte_bpe():
    return bpe.Bpe.load(str(public.path("byte_bpe_50k.json"))), tokenizers.Tokenizer.from_file(str(public.path("byte_bpe_50k.json")))


def test_bpe_equals_library(byte_bpe):
    mine, theirs = byte_bpe
    for t in texts():
        ids = np.frombuffer(mine.encode(t.encode()), "<u4").tolist()
        assert ids == theirs.encode(t, add_special_tokens=False).ids, t[:40]
        assert mine.decode(ids) == theirs.decode(ids, skip_special_tokens=False)


def test_bpe_stream_beyond_the_window(byte_bpe):
    mine, theirs = byte_bpe
    r = random.Random(5)
    for letters in ("ab", "aeinrst", "=-_"):
        t = "".join(r.choice(letters) for _ in range(3 * mine.window))
        assert list(mine.stream(t.encode())) == theirs.encode(t, add_special_tokens=False).ids
    assert 0 < mine.reach < mine.window


def test_lookahead_is_the_longest_chain():
    # (c, d) may take c from (b, c), which then leaves b to (a, b)
    merges = [(b"c", b"d"), (b"b", b"c"), (b"a", b"b")]
    assert bpe.Bpe.lookahead(merges) == 3


def test_decode_broken_bytes(byte_bpe):
    mine, theirs = byte_bpe
    ids = [mine.single[0xE9], mine.single[0x61], mine.single[0xF0], mine.single[0x9F]]
    assert mine.decode(ids) == theirs.decode(ids, skip_special_tokens=False)


def test_word_ids_equal_library():
    path = str(public.path("word_bpe_49k.json"))
    theirs, encode = tokenizers.Tokenizer.from_file(path), token_ids._word_encoder(path)
    own = texts()
    for t, ids in zip(own, encode([t.encode() for t in own]), strict=True):
        assert np.frombuffer(ids, "<u4").tolist() == theirs.encode(t, add_special_tokens=False).ids, t[:40]


def test_elias_fano():
    r = np.random.default_rng(0)
    for k in range(60):
        v = np.sort(r.integers(0, [1, 70, 10**5, 10**11][k % 4], r.integers(0, 400)))
        e = token_ids.EliasFano.from_bytes(token_ids.EliasFano.build(v).to_bytes())
        assert e.values().tolist() == v.tolist() and [int(e.select(i)[0]) for i in range(len(v))] == v.tolist() and e.select(np.arange(len(v))[::-1]).tolist() == v.tolist()[::-1]
    v = np.arange(0, 10**6, 100)
    assert len(token_ids.EliasFano.build(v).to_bytes()) < 1.4 * len(v)  # a table of 64-bit offsets takes 8 bytes each
    with pytest.raises(IndexError):
        e.select(len(e.values()))


def test_blocks_find_offsets_and_documents_by_select():
    r = np.random.default_rng(7)
    for n, nulls, far in ((1, 0, 1), (3, 3, 1), (1000, 5, 50), (5000, 0, 1 << 60), (300, 10, 0)):
        ids = [None] * nulls + sorted((int(r.integers(0, far + 1)) - (1 << 40) for _ in range(n - nulls)))
        sizes = r.integers(1, 900, n).tolist()
        sizes[n // 2] = 10**7
        ends = np.cumsum(sizes)
        block = token_ids.Block(*token_ids.Block.packed(ids, sizes))
        assert len(block) == n and block.ids(0, n) == ids
        assert block.offsets(0, n).tolist() == [0, *ends.tolist()]
        for rank in {0, n - 1, n // 2, n // 3}:
            assert block.offsets(rank).tolist() == [int(ends[rank]) - sizes[rank], int(ends[rank])] and block.ids(rank) == [ids[rank]]
            assert block.document_at(int(ends[rank]) - 1) == rank == block.document_at(int(ends[rank]) - sizes[rank])


def test_offsets_come_through_the_coded_bounds(spark, monkeypatch):
    docs = spark.createDataFrame([(k, "word " * (k % 5)) for k in range(50)], "doc_id long, text string")
    from terrafold.llm import common
    from terrafold.llm.queries import vocabulary

    path = common.new_path(spark, "tokens")
    token_ids.write_token_ids(docs, vocabulary("word_bpe_49k.json"), path, block_tokens=32)
    assert "array" not in dict(spark.read.parquet(path).dtypes)["doc_ids"]
    got = token_ids.read_token_ids(spark, path).orderBy("start").collect()
    assert [r.doc_id for r in got] == list(range(50)) and [r.start for r in got] == np.cumsum([0, *(r.n_tokens for r in got)])[:-1].tolist()


def brute_fingerprint(text):
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text)
    w = re.findall(r"[^\x20\x09-\x0D]+", low)
    if not w:
        return 0
    hs = [xxhash.xxh64_intdigest(" ".join(w[k : k + 3]).encode(), seed=42) for k in range(max(1, len(w) - 2))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def test_fingerprints():
    for t in texts():
        assert simhash.fingerprint(t.encode()) == brute_fingerprint(t)


def test_linked_is_brute_force():
    r = np.random.default_rng(1)
    fps = np.unique(r.integers(0, 16, 12).astype(np.int64) | (r.integers(0, 2, 12).astype(np.int64) << 63))
    a, roots = simhash.linked(fps, 1)
    for i, j in ((i, j) for i in range(len(a)) for j in range(i)):
        if bin((int(a[i]) ^ int(a[j])) & (1 << 64) - 1).count("1") <= 1:
            assert roots[i] == roots[j]


def test_repeated_words():
    r = random.Random(2)
    for _ in range(80):
        w = [r.choice("abc").encode() for _ in range(r.randint(0, 60))] + [b"x"] * r.randint(0, 12)
        c = collections.Counter(tuple(w[k : k + 8]) for k in range(len(w) - 7))
        hit = {k + i for k in range(len(w) - 7) if c[tuple(w[k : k + 8])] > 1 for i in range(8)}
        assert host_rules.repeated_words(w) == len(hit)


def test_measures():
    assert host_rules.measures("é a#\n\na#\na#\n ".encode()) == (4, 7, 3, 1 + 0, 0) or host_rules.measures("é a#\n\na#\na#\n ".encode())[0] == 4
    assert host_rules.measures(b"") == (0, 0, 0, 0, 0)


def greedy(word, first, following):
    k = n = 0
    while k < len(word):
        for e in range(len(word), k, -1):
            if word[k:e] in (following if k else first):
                break
        else:
            return 1
        k, n = e, n + 1
    return n


def test_piece_counts_equal_greedy_matching():
    r = random.Random(3)
    for _ in range(60):
        some = lambda n: {"".join(r.choice("ab") for _ in range(r.randint(1, 4))).encode() for _ in range(n)}
        first, following = some(6), some(6)
        c = token_counts.PieceCounter(first, following)
        for _ in range(60):
            w = "".join(r.choice("ab") for _ in range(r.randint(1, 12))).encode()
            assert c.count(w) == greedy(w, first, following), (w, first, following)


def test_piece_counts_equal_library():
    from tokenizers.models import WordPiece

    vocab = {p: i for i, p in enumerate(["[UNK]", "a", "ab", "abc", "##b", "##bc", "##cd", "##d", "##a"])}
    model = WordPiece(vocab, unk_token="[UNK]")
    c = token_counts.PieceCounter([b"a", b"ab", b"abc"], [b"b", b"bc", b"cd", b"d", b"a"])
    r = random.Random(4)
    for _ in range(300):
        w = "".join(r.choice("abcd") for _ in range(r.randint(1, 9)))
        assert c.count(w.encode()) == len(model.tokenize(w))


def brute_windows(text, items, size=13):
    low = lambda t: re.sub("[A-Z]", lambda m: m[0].lower(), t)
    split = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low(t))
    w, hit, found = split(text), set(), set()
    for name, item in items:
        iw = split(item)
        for k in range(max(1, len(iw) - size + 1)) if iw else ():
            win = iw[k : k + size]
            for i in range(len(w) - len(win) + 1):
                if w[i : i + len(win)] == win:
                    hit.update(range(i, i + len(win)))
                    found.add(name)
    return len(w), len(hit), sorted(found)


def test_decontamination_is_brute_force():
    r = random.Random(6)
    for _ in range(60):
        make = lambda n: " ".join(r.choice(["a", "B", "c", "é", "d-e"]) for _ in range(n))
        items = [(str(k), make(r.choice([0, 1, 3, 13, 20]))) for k in range(6)]
        text = make(60) + " " + items[5][1] + " " + make(5)
        index = decontaminate.build_index([(n, t.encode()) for n, t in items], 13, {})
        words = decontaminate.words_of(text.encode())
        n, found = decontaminate.find(words, index)
        assert (len(words), n, sorted(items[k][0] for k in found)) == brute_windows(text, items)
        places, again = decontaminate.find_places(words, index)
        assert len(places) == n and again == found


def test_units_cover_the_text():
    for t in texts():
        b = t.encode()
        spans = line_dedup.units(b)
        assert b"".join(b[a:e] for a, e in spans) == b


def test_patience():
    assert line_dedup.patience([(0, 5, True), (1, 6, True), (2, 0, True), (3, 7, True)]) == [(0, 5), (1, 6), (3, 7)]
    assert line_dedup.patience([(0, 0, True), (1, 1, False), (2, 9, False), (3, 3, True)]) == [(0, 0), (1, 1), (3, 3)]
    assert line_dedup.patience([]) == []


def test_gradients_of_the_network():
    r = np.random.default_rng(0)
    m = {k: v.astype(np.float64) for k, v in toxicity.start([b"a", b"b"]).items()}
    p, mask = r.normal(size=(5, 6 * toxicity.HIDDEN, 3)), np.ones((5, 3))
    mask[3:, 1] = 0
    loss = lambda: float(toxicity.forward(m, p, mask)[0].sum())
    _, kept = toxicity.forward(m, p, mask, True)
    g, px = toxicity.backward(m, p, mask, kept, np.ones(3))
    for name, at in (("Uf", (1, 2)), ("Ub", (3, 20)), ("v", (4,)), ("out", (9,))):
        old = m[name][at]
        m[name][at] = old + 1e-3
        up = loss()
        m[name][at] = old - 1e-3
        down = loss()
        m[name][at] = old
        assert (up - down) / 2e-3 == pytest.approx(g[name][at], rel=0.05, abs=2e-3)
    old = p[2, 5, 0]
    p[2, 5, 0] = old + 1e-3
    up = loss()
    p[2, 5, 0] = old - 1e-3
    assert (up - loss()) / 2e-3 == pytest.approx(px[2, 5, 0], rel=0.05, abs=2e-3)


def test_windows_overlap_and_cover():
    for n in (0, 1, toxicity.WINDOW, toxicity.WINDOW + 1, 500):
        w = toxicity.cut(np.arange(n))
        assert set(w[w >= 0].tolist()) == set(range(n)) and len(w) >= 1


def test_crf_marginals_are_brute_force():
    import itertools

    r = np.random.default_rng(0)
    w = {"line": r.normal(size=3 * quality_crf.OWN), "pair": np.array([0.7, -0.3])}
    docs = [r.random((n, quality_crf.OWN)) for n in (4, 1, 3)]
    order, n, x, like = quality_crf.chains(docs)
    good, _, z, _ = quality_crf.marginals(w, n, x, like)
    for k in range(3):
        total, on = 0.0, np.zeros(n[k])
        for y in itertools.product((0, 1), repeat=int(n[k])):
            s = sum((1 if y[t] else -1) * (x[t, k] @ w["line"]) / 2 for t in range(n[k]))
            s += sum((1 if y[t] == y[t + 1] else -1) * (w["pair"][0] + w["pair"][1] * like[t, k]) / 2 for t in range(n[k] - 1))
            total += np.exp(s)
            on += np.exp(s) * np.array(y)
        assert np.allclose(good[: n[k], k], on / total) and np.isclose(z[k], np.log(total))


def test_models_with_one_class():
    assert toxicity.Scorer(toxicity.train([], []))([b"a"]).tolist() == [0.0]
    assert quality_crf.scores(quality_crf.train([b"a"], [1]), [b"", b"b"]).tolist() == [1.0, 1.0]


def test_bpe_classes_follow_the_library():
    from tokenizers import Tokenizer

    path = vocabulary("byte_bpe_50k.json")
    library, own = Tokenizer.from_file(path), bpe.loaded(path)
    newer = sorted(own.newer)[:: max(1, len(own.newer) // 50)]
    for text in ["é're", " 's x", "a<|endoftext|>'ll  b", *(f"a{c}'re {c}1 {c}{c}b" for c in newer)]:
        ids = np.frombuffer(own.encode(text.encode()), "<u4").tolist()
        assert ids == library.encode(text, add_special_tokens=False).ids


def test_toxicity_reads_long_runs_whole():
    run = b"".join(b"%c%c" % (97 + k % 23, 97 + k % 19) for k in range(60))
    pieces = toxicity.words_of(b"a " + run + b" b")
    assert pieces[0] == b"a" and pieces[-1] == b"b" and max(map(len, pieces)) <= toxicity.LETTERS
    assert {run[k : k + 3] for k in range(len(run) - 2)} == {p[k : k + 3] for p in pieces[1:-1] for k in range(len(p) - 2)}
    clean, bad = b"the of and then with that", b"you idiot the of clown and"
    model = toxicity.train([clean, bad] * 12, [0, 1] * 12, epochs=4, least=1)
    glued = [b"theofandthenwiththatof" + x + b"theofandthenwiththatof" for x in (b"youidiotclown", b"withthatandof")]
    scores = toxicity.Scorer(model)(glued)
    assert scores[0] > scores[1]
    assert toxicity.STRIDE * 2 <= toxicity.WINDOW


def test_crf_gradient_is_that_of_the_documents_label():
    r = np.random.default_rng(3)
    docs = [r.random((n, quality_crf.OWN)) for n in (5, 1, 3)]
    likes, shares = [quality_crf.likeness(d) for d in docs], [np.full(len(d), 1 / len(d)) for d in docs]
    y, weight = np.array([1.0, 0.0, 1.0]), np.array([0.2, 0.5, 0.3])
    w = {"line": r.normal(size=3 * quality_crf.OWN) * 0.2, "pair": np.array([0.4, 0.3])}

    def likelihood():
        n, e, like = quality_crf.padded(w, docs, likes)
        s = (quality_crf.forward_backward(n, e, quality_crf.pair_field(w, like))[0] / n).sum(axis=0)
        return float((weight * np.log(np.where(y > 0, s, 1 - s))).sum())

    docs.sort(key=len, reverse=True)
    likes, shares = [quality_crf.likeness(d) for d in docs], [np.full(len(d), 1 / len(d)) for d in docs]
    g = quality_crf.gradient(w, docs, likes, shares, y, weight)
    for name, at in (("line", 0), ("line", 20), ("line", 40), ("pair", 0), ("pair", 1)):
        old = w[name][at]
        w[name][at] = old + 1e-5
        up = likelihood()
        w[name][at] = old - 1e-5
        down = likelihood()
        w[name][at] = old
        assert (up - down) / 2e-5 == pytest.approx(g[name][at], rel=1e-3, abs=1e-7)


def test_crf_labels_lines_of_one_document_differently():
    r = random.Random(9)
    good = lambda: " ".join(r.choice(["the", "house", "stands", "near", "a", "river", "and", "people", "walk"]) for _ in range(12)).capitalize() + "."
    bad = lambda: " ".join(r.choice(["###", "$$$", "%%", "a1", "||", "***"]) for _ in range(12))
    made = [("\n".join([good() for _ in range(6)] + [bad()]).encode(), 1) for _ in range(60)] + [("\n".join([bad() for _ in range(6)] + [good()]).encode(), 0) for _ in range(60)]
    w = quality_crf.train(*map(list, zip(*made, strict=True)))
    text = "\n".join([good() for _ in range(5)] + [bad() for _ in range(5)]).encode()
    lines = quality_crf.line_marginals(w, [text])[0][0]
    assert (lines[:4] > 0.5).all() and (lines[6:] < 0.5).all()
    alone = quality_crf.line_marginals(w | {"pair": np.zeros(2)}, [text])[0][0]
    assert np.abs(alone - lines).max() > 0.01


def test_crf_batches_are_bounded_by_lines():
    lengths = [5, 10**6, 3, 20000, 19000, 18000, 1] + [4] * 1000
    got = quality_crf.batches(lengths)
    assert sorted(i for part in got for i in part) == list(range(len(lengths)))
    assert all(len(part) == 1 or len(part) * max(lengths[i] for i in part) <= quality_crf.CELLS for part in got)
    text = b"\n".join(b"line %d of many" % k for k in range(200_000))
    assert len(quality_crf.line_marginals({"line": np.zeros(3 * quality_crf.OWN), "pair": np.ones(2)}, [text])[0][0]) == 200_000


def test_bpe_in_stretches(byte_bpe, monkeypatch):
    mine, theirs = byte_bpe
    monkeypatch.setattr(bpe, "STRETCH", 40)
    for t in texts():
        parts = list(mine.encoded(t.encode()))
        assert np.frombuffer(b"".join(parts), "<u4").tolist() == theirs.encode(t, add_special_tokens=False).ids
        assert "".join(mine.decoded(parts)) == t
    assert len(list(mine.encoded(b"some words " * 100))) > 20


@pytest.mark.parametrize("unit", ["слово ещё, ", "你好世界。", "很好", "日本語テキスト「です」", "a\t", "one  two  ", "  ", "x1", "don't 's", "!?'a", "<|endoftext|>", "a\u00a0b\u3000", "é're\n\n", "12345 "])
def test_bpe_stretches_of_every_script(byte_bpe, monkeypatch, unit):
    """No stretch of a text of many pieces is over twice the bound, no part of one piece has more ids than it, and the ids are the library's."""
    mine, theirs = byte_bpe
    monkeypatch.setattr(bpe, "STRETCH", 64)
    text = unit * (3000 // len(unit))
    parts = list(mine.encoded(text.encode()))
    assert np.frombuffer(b"".join(parts), "<u4").tolist() == theirs.encode(text, add_special_tokens=False).ids
    assert "".join(mine.decoded(parts)) == text
    assert max(map(len, parts)) <= 4 * 2 * bpe.STRETCH
    if unit not in ("很好", "  ", "<|endoftext|>"):  # one piece, or one run of special tokens
        assert max(map(len, mine.stretches(text.encode()))) <= 2 * bpe.STRETCH


def test_bpe_long_texts_in_stretches(byte_bpe):
    mine, _ = byte_bpe
    for unit in ("слово ещё ", "你好世界。", "tab\tbed ", "one  two  "):
        text = (unit * (2_000_000 // len(unit.encode()))).encode()
        assert max(map(len, mine.stretches(text))) <= 2 * bpe.STRETCH
        assert b"".join(mine.stretches(text)) == text


def test_bpe_random_characters_in_stretches(byte_bpe, monkeypatch):
    mine, theirs = byte_bpe
    monkeypatch.setattr(bpe, "STRETCH", 16)
    r = random.Random(9)
    letters = [*"aZé'世 \t\n\u00a0\u3000\x1c\x85 !'1²(", "'re", "<|endoftext|>", *sorted(mine.newer)[:5]]
    for _ in range(400):
        text = "".join(r.choice(letters) * r.randint(1, 4) for _ in range(r.randint(0, 60)))
        ids = np.frombuffer(b"".join(mine.encoded(text.encode())), "<u4").tolist()
        assert ids == theirs.encode(text, add_special_tokens=False).ids, text


def aligned_again_and_again(own, other, runs, min_words):
    """Patience alignment, blocks of its chain deleted, and again over the runs that are left, until none is."""
    gone, left = np.zeros(len(own), bool), sorted(set(runs))
    while left:
        chain = line_dedup.patience([(x, y, [r[0] for r in left].count(x) == [r[1] for r in left].count(y) == 1) for x, y, *_ in left])
        assert chain  # every round settles some runs
        done = set(chain)
        for x, y, n, _ in (r for r in left if r[:2] in done):
            for at in range(n):
                if x + at < len(own) and y + at < len(other) and own[x + at] == other[y + at]:
                    a = b = at
                    while x + a > 0 and y + a > 0 and own[x + a - 1] == other[y + a - 1]:
                        a -= 1
                    while x + b < len(own) and y + b < len(other) and own[x + b] == other[y + b]:
                        b += 1
                    if b - a >= min_words:
                        gone[x + a : x + b] = True
        left = [r for r in left if r[:2] not in done]
    return gone


def test_aligned_blocks_are_the_fixed_point_of_repeated_alignment():
    """What aligned_blocks deletes is where aligning, deleting and aligning the rest comes to: every run joins a chain in some round."""
    r = np.random.default_rng(9)
    for _ in range(60):
        passages = [[b"p%d-%d" % (k, i) for i in range(r.integers(6, 14))] for k in range(5)]
        build = lambda: [w for k in r.integers(0, 5, 6) for w in [*passages[k], b"own%d" % r.integers(0, 10**9)]]
        own, other = build(), build()
        # runs of three words wherever both have them, some united
        runs = [(x, y, 3, int(r.integers(2, 100))) for x in range(len(own) - 2) for y in range(len(other) - 2) if own[x : x + 3] == other[y : y + 3] and r.random() < 0.6]
        if not runs:
            continue
        known = {k: other[k * line_dedup.BLOCK : (k + 1) * line_dedup.BLOCK] for k in range(-(-len(other) // line_dedup.BLOCK))}
        got = np.zeros(len(own), bool)
        for a, b in line_dedup.aligned_blocks(own, known, runs, 8, 64, 0.5):
            got[a:b] = True
        assert (got == aligned_again_and_again(own, other, runs, 8)).all()
