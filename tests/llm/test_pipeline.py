"""The pipeline against stage-by-stage brute force, and its stages' contract."""

import os
import re

import numpy as np
import pytest

import corpus_pipeline as P

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


def test_stages_keep_columns_and_drop_what_they_should(spark):
    from test_kernels import brute_fingerprint, brute_windows

    from terrafold.llm.queries import table

    docs = table(spark, SF, "documents")
    items = [(str(r.item_id), r.text) for r in table(spark, SF, "benchmark").collect()]
    labels = {r.doc_id: r.toxic for r in table(spark, SF, "labels").collect()}
    before = {r.doc_id: r for r in docs.collect()}
    for name, stage in P.STAGES:
        out = P.materialize(stage(spark, docs, SF), "test")
        after = {r.doc_id: r for r in out.collect()}
        if name != "encoding":
            assert out.columns == docs.columns
            assert set(after) <= set(before)
        if name == "toxicity":
            gone = set(before) - set(after)
            known = [k for k in before if k in labels]
            assert sum((k in gone) == bool(labels[k]) for k in known) / len(known) > 0.85  # 64 documents teach it here
        elif name == "line dedup":
            for k, r in after.items():
                assert r.text == before[k].text or len(r.text) < len(before[k].text) and set(re.findall(r"\S+", r.text)) <= set(re.findall(r"\S+", before[k].text))
                assert r.n_chars == len(r.text)
        elif name == "near copies":
            fp = {k: brute_fingerprint(r.text) for k, r in before.items()}
            kept = np.array([fp[k] for k in after], np.uint64)
            for k in set(before) - set(after):
                near = [j for j in before if j != k and bin(fp[j] ^ fp[k]).count("1") <= 2]
                assert near
            assert len(kept) == len(set(kept.tolist()))
            for i, a in enumerate(kept):
                assert not (np.bitwise_count(kept[i + 1 :] ^ a) <= 2).any()
        elif name == "decontamination":
            for k, r in before.items():
                n, hit, _ = brute_windows(r.text, items)
                assert (k in after) == (not (hit and 20 * hit >= n))
        else:
            from tokenizers import Tokenizer

            theirs = Tokenizer.from_file(P.vocabulary("byte_bpe_50k.json"))
            for k, r in before.items():
                assert np.frombuffer(after[k].ids, "<u4").tolist() == theirs.encode(r.text, add_special_tokens=False).ids
        docs, before = out, after


def test_run_equals_the_stages(spark):
    docs = P.table(spark, SF, "documents")
    for _, stage in P.STAGES:
        docs = P.materialize(stage(spark, docs, SF), "again")
    assert sorted(map(tuple, docs.collect())) == sorted(map(tuple, P.run(spark, SF).collect()))


@pytest.mark.parametrize("name, stage", P.STAGES)
def test_stages_on_awkward_rows(spark, name, stage):
    """Nulls in any column, empty and long texts, repeated rows, clashing columns, an empty table."""
    long = " ".join(f"w{k % 997}x{k // 997}" for k in range(20000))
    rows = [(1, "A first text of some words.", "en", "a", 27), (2, None, None, None, None), (3, "", "en", "a", 0), (4, long, "en", "b", 9), (5, "same text here", "en", "a", 14), (5, "same text here", "en", "a", 14), (None, "no id", "en", "a", 5)]
    extra = "doc_id long, text string, lang string, source string, n_chars long, row long, lost string, _row long, score double, h long, own long, c0 string"
    docs = spark.createDataFrame([(*r, 1, "x", 2, 0.5, 3, 4, "y") for r in rows], extra)
    out = stage(spark, docs, SF)
    got = out.collect()
    if name == "encoding":
        assert len(got) == len(rows) and {r.n_tokens for r in got if r.doc_id in (2, 3)} == {0}
    else:
        assert out.columns == docs.columns
        # of equal texts (null and empty ones count as equal) the near-copy stage keeps one
        assert len(got) == {"near copies": 5}.get(name, len(rows))
        assert {(r.row, r.lost, r._row, r.own, r.c0) for r in got} == {(1, "x", 2, 4, "y")}
    assert stage(spark, docs.where("false"), SF).collect() == []
