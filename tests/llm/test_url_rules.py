"""URL rules against brute force, on rules that fill many chunks."""

import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from terrafold.llm import url_rules

RULES = "host string, path string, verdict string"


def judged(url, rules, default="allow"):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    host = re.match("[^/?#]*", rest)[0]
    path = re.match("[^?#]*", rest[len(host) :])[0]
    host = "".join(c.lower() if c.isascii() else c for c in host)
    fits = [(len(h) + len(p), len(h), h + p, v) for h, p, v in rules if (host == h or host.endswith(f".{h}")) and path.startswith(p)]
    return host, path, *((max(fits)[2:]) if fits else (None, default))


@pytest.mark.parametrize("chunk", [4, 512])
def test_against_brute_force(spark, chunk):
    r = np.random.default_rng(3)
    word = lambda: r.choice(["a", "b", "com", "en", "x-y", "ä"])
    host = lambda n: ".".join(word() for _ in range(n))
    path = lambda: "/" + "".join(r.choice(["a", "b", "/"], r.integers(0, 6)))
    rules = list({(host(r.integers(1, 4)), path() if k % 9 else ""): None for k in range(700)})
    rules = [(h, p, "block" if k % 2 else "allow") for k, (h, p) in enumerate(rules)]
    urls = [f"{r.choice(['http', 'https', ''])}://{host(r.integers(1, 5)).upper() if k % 7 == 0 else host(r.integers(1, 5))}{path()}{r.choice(['', '?q=/a', '#/b', '?u=http://z'])}" for k in range(1500)]
    urls += [None, "", "no scheme", "://", "http:///a", "http://COM", "http://com?x", "http://a..com/", "x://b.com/a://c.com/b"] + ["http://hot.a.com/a"] * 300
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    got = {x.page_id: tuple(x)[1:] for x in url_rules.judge_urls(pages, spark.createDataFrame(rules, RULES), chunk=chunk).collect()}
    assert len(got) == len(urls)
    wrong = [(urls[k], v, judged(urls[k], rules)) for k, v in got.items() if v != judged(urls[k], rules)]
    assert not wrong, wrong[:3]


def test_stacks_of_many_chunks(spark, monkeypatch):
    calls = []
    was = url_rules.nested
    monkeypatch.setattr(url_rules, "nested", lambda rules, chunk: calls.append(chunk) or was(rules, chunk))
    r = np.random.default_rng(4)
    keys = sorted({"".join(r.choice(list("abc"), r.integers(1, 7))) for _ in range(700)})
    rules = spark.createDataFrame([(k, k, "block") for k in keys], "key string, rule string, verdict string")
    got = {x.key: [o.key for o in x.stack] for x in url_rules.nested(rules, 8).collect()}
    assert len(calls) >= 2  # chunks of chunks
    assert got == {k: [o for o in keys if k.startswith(o)] for k in keys}


def test_awkward_rows(spark):
    rules = spark.createDataFrame([(None, "/", "block"), ("COM", None, "block"), ("com", "", "allow"), ("a/b", "/", "block"), ("b.com", "no", "allow"), ("b.com", "/x", None)], RULES)
    pages = spark.createDataFrame([(1, "http://B.com/x", "k", 1), (1, "http://B.com/x", "k", 1), (None, "http://b.org", "k", 2), (3, None, None, 3)], "page_id long, url string, key string, part int")
    got = url_rules.judge_urls(pages, rules)
    assert sorted((r.page_id or -1, r.host, r.path, r.rule, r.verdict) for r in got.collect()) == [
        (-1, "b.org", "", None, "allow"), (1, "b.com", "/x", "com", "block"), (1, "b.com", "/x", "com", "block"), (3, "", "", None, "allow"),
    ]
    assert url_rules.judge_urls(pages.where("false"), rules).collect() == []
    assert {r.verdict for r in url_rules.judge_urls(pages, rules.where("false"), default="block").collect()} == {"block"}


def test_plan_is_native(spark):
    pages = spark.createDataFrame([(1, "http://b.com/x")], "page_id long, url string")
    plan = url_rules.judge_urls(pages, spark.createDataFrame([("com", "/", "block")], RULES)).select(F.count("*"))._jdf.queryExecution().toString()
    assert not re.search("Python|Arrow|Pandas", plan)
