"""Operators on small tables: nulls, empty and very long texts, ties, repeated rows, empty tables, clashing columns."""

import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from terrafold.llm import bpe, common, decontaminate, host_rules, line_dedup, pii, quality_crf, simhash, token_counts, token_ids, toxicity
from terrafold.llm.queries import vocabulary

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, h long, own long, fp long, row long, c0 string"
LONG = " ".join(f"w{k % 997}x" for k in range(30000))
ROWS = [
    (1, "One two three four. " * 9, "en", "a", 1), (2, None, None, None, None), (3, "", "en", "a", 0), (4, LONG, "en", "b", 9), (5, "same text here", "en", "a", 1), (5, "same text here", "en", "a", 1),
    (6, "same text here", "en", "b", 1), (None, "no id", "en", "a", 5), (7, "other under one id", "en", "a", 1), (7, "a second text", "en", "a", 1),
]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(*r, 0.5, 1, 2, 3, 4, "z") for r in ROWS], SCHEMA)


def model():
    clean, bad = b"the of and then with that", b"you idiot the of clown and"
    return toxicity.train([clean, bad] * 12, [0, 1] * 12, epochs=4, least=1)


def quality_model():
    return quality_crf.train([b"A fine line of words.\nAnother one here.", b"### $$$ ***\n&&& ### !!"] * 12, [1, 0] * 12, epochs=4)


OPERATORS = {
    "token_ids": lambda d: token_ids.token_ids(d, vocabulary("word_bpe_49k.json")),
    "bpe": lambda d: bpe.bpe_round_trip(d, vocabulary("byte_bpe_50k.json"), with_ids=True),
    "toxicity": lambda d: toxicity.toxicity(d, model()),
    "line_dedup": line_dedup.line_dedup,
    "decontaminate": lambda d: decontaminate.decontaminate(d, d.sparkSession.createDataFrame([(1, "same text here"), (2, None), (None, "x")], "item_id long, text string")),
    "simhash": simhash.simhash_groups,
    "host_rules": host_rules.host_rules,
    "token_counts": lambda d: token_counts.token_counts(d, vocabulary("byte_bpe_50k.json")),
    "pii": lambda d: pii.pii_digest(pii.find_pii(d)),
    "quality": lambda d: quality_crf.quality(d, quality_model()),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_awkward_rows_and_empty_tables(docs, name):
    out = OPERATORS[name](docs)
    got = out.collect()
    assert len(got) == len(ROWS)
    assert sorted(r.doc_id or -1 for r in got) == sorted(r[0] or -1 for r in ROWS)
    assert OPERATORS[name](docs.where("false")).collect() == []
    same = {str(tuple(r)[1:]) for r in out.select("doc_id", *[c for c in out.columns if c not in ("doc_id", "start", "line_dedup")]).collect() if r.doc_id == 5}
    assert len(same) == 1  # repeated rows have one result


def test_token_offsets(spark, docs):
    got = token_ids.token_ids(docs, vocabulary("word_bpe_49k.json")).orderBy("start").collect()
    assert [r.start for r in got] == np.cumsum([0, *(r.n_tokens for r in got)])[:-1].tolist()
    assert [r.doc_id for r in got] == sorted((r.doc_id for r in got), key=lambda x: -1 if x is None else x)
    path = common.new_path(spark, "tokens")
    token_ids.write_token_ids(docs, vocabulary("word_bpe_49k.json"), path, block_tokens=8)
    again = token_ids.read_token_ids(spark, path, with_ids=True).orderBy("start").collect()
    assert [(r.start, r.n_tokens, r.ids_crc32) for r in again] == [(r.start, r.n_tokens, r.ids_crc32) for r in got]
    assert all(r.ids[-1] == 1 and len(r.ids) == r.n_tokens for r in again)


def test_simhash_components_are_brute_force(spark):
    r = np.random.default_rng(0)
    base = r.integers(0, 2**62, 6)
    fps = [int(b) ^ sum(1 << int(k) for k in r.choice(64, r.integers(0, 4), replace=False)) for b in base for _ in range(12)]
    fps = sorted({f - (1 << 64) if f >= 1 << 63 else f for f in fps})
    edges = simhash.links(spark.createDataFrame([(f,) for f in fps], "fp long"))
    roots = {x.node: x.root for x in common.components(edges).collect()}
    parent = {f: f for f in fps}

    def top(f):
        while parent[f] != f:
            f = parent[f]
        return f

    for i, a in enumerate(fps):
        for b in fps[:i]:
            if bin((a ^ b) & ((1 << 64) - 1)).count("1") <= 2:
                x, y = sorted((top(a), top(b)))
                parent[y] = x
    assert all(roots.get(f, f) == top(f) for f in fps)


def test_anchors_cover_every_pair(spark):
    r = np.random.default_rng(2)
    pairs = []
    for _ in range(60):
        a = int(r.integers(-(2**63), 2**63 - 1))
        b = a
        for k in r.choice(64, 2, replace=False):
            b ^= -(1 << 63) if k == 63 else 1 << int(k)
        pairs.append((a, b))
    df = spark.createDataFrame(pairs, "a long, b long").select(simhash.anchors(F.col("a")).alias("x"), simhash.anchors(F.col("b")).alias("y"))
    for row in df.collect():
        assert len(set(row.x)) in (1, 32) and set(row.x) & set(row.y)


def test_components_of_a_long_path_and_a_star(spark):
    edges = [(k, k + 1) for k in range(60)] + [(1000, 1000 + k) for k in range(1, 200)]
    got = {r.node: r.root for r in common.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert all(got[k] == 0 for k in range(61)) and all(got[1000 + k] == 1000 for k in range(200))


PASSAGE = "The quick passage begins here with many words. It goes on for a second sentence that is long enough. A third sentence ends the passage with yet more words in it."


def test_line_dedup(spark):
    rows = [(1, "Alpha line stands first. " + PASSAGE + " Omega."), (2, "Other words before it and " + "then. " + PASSAGE + " Tail stays."), (3, "All rights reserved.\nOwn words only."), (4, "All rights reserved.\nMore own words."), (5, PASSAGE)]
    got = {r.doc_id: r for r in line_dedup.line_dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[1].text == rows[0][1] and got[3].text == rows[2][1] and got[4].text == rows[3][1]
    assert got[2].text == "Other words before it and then. Tail stays."
    assert got[5].text == "" and got[5].line_dedup.n_deleted == 3


def test_line_dedup_of_a_large_group_of_copies(spark):
    df = spark.range(400).select(F.col("id").alias("doc_id"), F.lit(PASSAGE).alias("text"))
    out = line_dedup.line_dedup(df, rare_docs=2, rare_share=1.0)
    assert out.where("text <> ''").collect()[0].doc_id == 0 and out.where("text <> ''").count() == 1


def test_decontamination_in_blocks(spark):
    r = np.random.default_rng(1)
    words = [f"w{k}" for k in range(30)]
    text = lambda n: " ".join(r.choice(words, n))
    items = [(k, text(20)) for k in range(12)]
    docs = [(k, text(40) + " " + items[k % 12][1] + " " + text(10)) for k in range(10)] + [(10, None), (11, text(30))]
    d, b = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    whole, parts = (sorted(tuple(x) for x in decontaminate.decontaminate(d, b, block_bytes=n).drop("items").collect()) for n in (1 << 20, 200))
    assert whole == parts and sum(x[-1] for x in whole) == 10
    kept = [sorted(x.doc_id for x in decontaminate.drop_contaminated(d, b, block_bytes=n).collect()) for n in (1 << 20, 200)]
    assert kept == [[10, 11], [10, 11]]


def test_host_verdict(spark):
    good = "word " * 7 + " ".join(f"v{k}" for k in range(30))
    rows = [(k, "too short", "bad") for k in range(40)] + [(40, good, "bad")] + [(100 + k, good, "fine") for k in range(40)] + [(200, good, None)]
    got = {r.doc_id: r for r in host_rules.host_rules(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()}
    assert not got[40].kept and not got[40].base_failed and got[40].host_rate > 0.5
    assert got[100].kept and got[200].kept and not got[0].kept


CARD, IBAN = "4111 1111 1111 1111", "DE89 3704 0044 0532 0130 00"


@pytest.mark.parametrize(
    "text",
    ["", "a@b.c_d@e.f", "mail me.x+y@h-1.co.uk.", "1.2.3.4.5.6.7.8", "256.1.1.1 0255.001.1.1", f"pay {CARD} now 4111111111111112", "+49 (30) 123-45.67 +1 2", "é" * 30 + " q@w.de", "@@@ a@b a@b.", f"account {IBAN}.", "my ssn 123-45-6789 and 123-45-6789", "9" * 3000, "a" * 20000, "+1" + "-" * 3000 + "2", "1 2 3 4 5 6 7 8 9 0 1 2 3"],
)
def test_pii_is_brute_force(spark, text):
    kinds = [("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"), ("card", r"[0-9]([\x20-]?[0-9])+"), ("phone", r"\+[0-9][\x20().0-9-]+[0-9]")]

    def holds(kind, value):
        digits = re.sub("[^0-9]", "", value)
        if kind == "ip":
            return all(int(x) <= 255 for x in value.split("."))
        if kind == "card":
            return 12 <= len(digits) <= 19 and sum(sum(divmod(int(c) * (1 + k % 2), 10)) for k, c in enumerate(digits[::-1])) % 10 == 0
        return kind != "phone" or 9 <= len(digits) <= 15

    if len(text) < 5000:  # the plain email pattern takes quadratic time
        want = sorted((m.start(), n, m.end()) for n, (k, p) in enumerate(kinds) for m in re.finditer(p, text) if holds(k, m[0]))
        found = pii.find_pii(spark.createDataFrame([(1, text)], "doc_id long, text string")).first().found
        assert [(s.begin, s.kind, s.stop) for s in found if s.kind < 4] == want
        if IBAN in text:
            assert any(pii.KINDS[s.kind].name == "iban" and text[s.begin : s.stop] == IBAN for s in found)
        if "ssn" in text:
            assert [pii.KINDS[s.kind].name for s in found].count("ssn") == 2 - ("and" in text and len(text) > 60)
    else:
        assert pii.find_pii(spark.createDataFrame([(1, text)], "doc_id long, text string")).first().found == []


def test_broken_checksums_are_dropped(spark):
    found = pii.find_pii(spark.createDataFrame([(1, f"account {IBAN[:-1]}1 card 4111 1111 1111 1112")], "doc_id long, text string")).first().found
    assert not [s for s in found if pii.KINDS[s.kind].name in ("iban", "card")]


def test_models_learn(spark):
    r = np.random.default_rng(0)
    clean = [f"the of and n{k}" for k in range(40)]
    rows = []
    for k in range(400):
        words = list(r.choice(clean, 60))
        if k % 4 == 0:
            words[int(r.integers(60))] = f"badstem{k}"
        rows.append((k, " ".join(words), int(k % 4 == 0)))
    docs = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    m = toxicity.fit(docs, docs.select("doc_id", "toxic"), bound=300)
    out = toxicity.toxicity(docs, m).join(docs.where(common.bucket("doc_id", 4) == 2).select("doc_id", "toxic"), "doc_id")
    assert out.where("predicted = toxic").count() / out.count() > 0.95
    assert toxicity.drop_toxic(docs, m).columns == docs.columns


@pytest.mark.parametrize("chunk", [1, 4, 256])
def test_pii_positions_over_chunks_of_matches(spark, monkeypatch, chunk):
    monkeypatch.setattr(pii, "CHUNK", chunk)
    text = "é ".join(f"w{k} a{k}@b.com ssn {100 + k}-45-6789, {100 + k}-45-6780 card {CARD}." if k % 3 else f"x{k}y 12 34" for k in range(40))
    found = pii.find_pii(spark.createDataFrame([(1, text)], "doc_id long, text string")).first().found
    seen = [(pii.KINDS[s.kind].name, text[s.begin : s.stop]) for s in found]
    want = [w for k in range(40) if k % 3 for w in [("email", f"a{k}@b.com"), ("ssn", f"{100 + k}-45-6789"), ("ssn", f"{100 + k}-45-6780"), ("card", CARD)]]
    assert seen == want


def test_pii_takes_linear_time_in_the_matches(spark):
    text = " ".join(f"w{k % 997}x" for k in range(200_000))
    assert pii.find_pii(spark.createDataFrame([(1, text)], "doc_id long, text string")).first().found == []


def _sentence(r, n):
    return " ".join(f"s{k}" for k in r.integers(0, 10**6, n)) + ". "


def test_line_dedup_in_broken_sentences(spark):
    r = np.random.default_rng(3)
    own = lambda n: " ".join(f"own{k}" for k in r.integers(0, 10**6, n))
    long = _sentence(r, 70).split()
    text = "".join(_sentence(r, n) for n in (30, 8, 30)).split()
    cases = [long[9:61], text[17:53], text[:30] + text[38:], long[30:50]]  # inside one sentence; two broken ones around a short one; an edit; as few words as count
    rows = [(1, " ".join(long) + " " + " ".join(text))] + [(k, f"{own(7)} {' '.join(c)} {own(6)}") for k, c in enumerate(cases, 2)] + [(9, f"{own(7)} {' '.join(long[20:39])} {own(6)}")]
    got = {x.doc_id: x for x in line_dedup.line_dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[1].text == rows[0][1].rstrip() and got[9].text == rows[-1][1]
    for k, c in enumerate(cases, 2):
        assert got[k].line_dedup.words_deleted == len(c), k
        assert got[k].text == " ".join(w for w in rows[k - 1][1].split() if w.startswith("own"))


def test_line_dedup_aligns_again(spark):
    r = np.random.default_rng(4)
    part = lambda n: "".join(_sentence(r, 9) for _ in range(n))
    p, q, u = part(4), part(4), part(5)
    rows = [(1, p + q), (2, q + "One. " + p), (3, "Two. " + u), (4, u + "Three. " + u + "Four. " + u), (5, p + "Five. " + p + "Six. " + q)]
    got = {x.doc_id: x.text for x in line_dedup.line_dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: p + q, 2: "One.", 3: "Two. " + u, 4: "Three. Four.", 5: "Five. Six."}


def test_line_dedup_of_lines_that_most_documents_hold(spark):
    r = np.random.default_rng(6)
    line = "".join(_sentence(r, 13) for _ in range(2))
    rows = [(k, f"Begin{k}. {line}End{k}.") for k in range(9)]
    got = {x.doc_id: x.text for x in line_dedup.line_dedup(spark.createDataFrame(rows, "doc_id long, text string"), rare_docs=2).collect()}
    assert got == {0: rows[0][1], **{k: f"Begin{k}. End{k}." for k in range(1, 9)}}


def test_added_kinds_and_their_context(spark):
    hexes, key = "04dbebab91ab85687d33eeaaf9ac699e1188f962", "AKIA" + "ABCD1234EFGH5678"
    nir = "1850575123456" + f"{97 - 1850575123456 % 97:02d}"
    rows = [
        ("secret", f'Thst token = "{hexes}" and on', hexes, 60), ("secret", f"{hexes} was the password", hexes, 60), (None, f"commit {hexes} was fine", None, 0), (None, "token " + "a" * 40, None, 0),
        ("key", f"see {key}.", key, 90), ("dni", "DNI 12345678Z", "12345678Z", 65), (None, "DNI 12345678A", None, 0), (None, "thing 12345678Z", None, 0), ("nir", f"numéro {nir}!", nir, 55), (None, f"numéro {nir[:-1]}{(int(nir[-1]) + 1) % 10}!", None, 0),
    ]
    df = spark.createDataFrame([(k, r[1]) for k, r in enumerate(rows)], "doc_id long, text string")
    got = {r.doc_id: r for r in pii.pii_digest(pii.find_pii(df)).collect()}
    for k, (kind, text, value, score) in enumerate(rows):
        want = [(f"{kind}:{text.index(value)}:{text.index(value) + len(value)}", str(score))] if kind else []
        found = [(s, c) for s, c in zip(got[k].spans.split(","), got[k].scores.split(","), strict=True) if s and s.split(":")[0] not in ("card", "phone")]
        assert found == want, text


def _covered(texts):
    """Words of each text within 20 words that an earlier text holds too."""
    seen, out = set(), []
    for t in texts:
        w = (t or "").encode().split()
        grams = [tuple(w[k : k + 20]) for k in range(len(w) - 19)]
        on = np.zeros(len(w), bool)
        for k, g in enumerate(grams):
            if g in seen:
                on[k : k + 20] = True
        seen.update(grams)
        out.append((w, on))
    return out


def test_line_dedup_against_all_pairs(spark):
    """On whole documents: no word goes that no earlier document holds in 20 words in a row, and over 0.99 of those that one holds go."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = sorted((r.doc_id, r.text) for r in docs.collect())
    got = {r.doc_id: r for r in line_dedup.line_dedup(docs).collect()}
    held = gone = 0
    for (k, text), (w, on) in zip(rows, _covered([t for _, t in rows]), strict=True):
        lost = got[k].line_dedup.words_deleted
        assert lost <= on.sum()
        assert len((got[k].text or "").split()) == len((text or "").split()) - lost
        if lost == on.sum():
            assert [x.encode() for x in (got[k].text or "").split()] == [x for x, o in zip(w, on, strict=True) if not o]
        held, gone = held + on.sum(), gone + lost
    assert gone >= 0.99 * held


def test_line_dedup_links_beyond_the_first_holder(spark):
    r = np.random.default_rng(8)
    x, y, z = (_sentence(r, 13) for _ in range(3))
    own = lambda k: f"Own{k} words{k} stay{k}. "
    # C is a copy of B, while all its sentences stand first in A in another order; E joins what stands apart in A and D, so nothing of it is a block
    rows = [(1, y + own(1) + x), (2, x + y), (3, x + y), (4, z), (5, own(5) + y + z)]
    got = {q.doc_id: q.text for q in line_dedup.line_dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: rows[0][1], 2: rows[1][1], 3: "", 4: rows[3][1], 5: rows[4][1]}


def test_line_dedup_of_many_copies_under_default_parameters(spark):
    near = lambda k: PASSAGE.replace("quick", f"quick{k}")
    rows = [(k, PASSAGE if k % 2 else near(k)) for k in range(400)]
    got = {r.doc_id: r.line_dedup.words_deleted for r in line_dedup.line_dedup(spark.createDataFrame(rows, "doc_id long, text string").repartition(7)).collect()}
    n = len(PASSAGE.split())
    # the first loses nothing, its near copies all behind the changed word, exact ones all but the second
    assert got[0] == 0 and all(got[k] == (n if k % 2 and k > 1 else n - 2) for k in range(1, 400))


def test_decontamination_index_takes_no_more_than_estimated(spark):
    import tracemalloc

    r = np.random.default_rng(9)
    texts = [" ".join(f"w{k}" for k in range(4000)), " ".join(map(str, r.integers(0, 30, 3000))), "ü. " * 500, "A-b" * 700, ""]
    b = spark.createDataFrame([(str(k), t) for k, t in enumerate(texts)], "item_id string, text string")
    items, _ = decontaminate._blocks(b, 1 << 40, 13, "item_id", "text")
    for row in items.collect():
        words = decontaminate.words_of(bytes(row.text))
        assert row.cost == len(words) * decontaminate.WINDOW_BYTES + 13 * len(row.text)
        tracemalloc.start()
        index = decontaminate.build_index([(row.item, bytes(row.text))], 13, {})
        used = tracemalloc.get_traced_memory()[0]
        tracemalloc.stop()
        assert len(index) <= len(words) and used <= row.cost + 4096


def test_memories_of_words_are_bounded_in_bytes(spark, monkeypatch):
    pieces = token_counts.PieceCounter([b"a", b"ab"], [b"a", b"b"])
    long = b"ab" * 5000
    assert pieces.text(b"ab a " + long + b" ab " + long) == (5, 3 + 2 * pieces.count(long))
    assert max(map(len, pieces.memo)) <= token_counts.LONGEST
    path = vocabulary("word_bpe_49k.json")
    texts = [b"some words and https://example.org/" + str(k).encode() * 50 for k in range(40)]
    want = token_ids._word_encoder(path)(texts)
    monkeypatch.setattr(token_ids, "MEMO", 500)
    small = token_ids._word_encoder(path)
    assert [small([t])[0] for t in texts] == want


def test_one_id_for_many_documents_is_dealt_out(spark):
    docs = spark.range(400).select(F.lit(None).cast("long").alias("doc_id"), F.concat(F.lit("text "), "id").alias("text"))
    out = token_ids.token_ids(docs, vocabulary("word_bpe_49k.json")).orderBy("start").collect()
    assert len(out) == 400 and out[0].start == 0
    assert all(a.start + a.n_tokens == b.start for a, b in zip(out, out[1:]))
