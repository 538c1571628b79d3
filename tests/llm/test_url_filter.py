"""Bloom cascades and url verdicts against plain versions."""

import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from rhetree.llm import bloom_cascade as B
from rhetree.llm import url_filter as U

URLS = [
    None, "", "no scheme", "http://", "https://EXAMPLE.org/es/x", "http://a.b.example.org/en/12?q=/es/", "http://example.org/en/2", "http://org", "http://org/",
    "http://x.com/fr/", "http://x.com/fr", "http://x.com/de/a", "ftp://notexample.org/es/", "http://spam-farm.example.net/q", "http://m.SPAM-farm.example.com/fr/1",
    "http://xspam-farm.example.com/", "x://a?b/c", "x://a#b", "http://é.org/ü", "a://b://org/", "http://" + "a." * 5000 + "com/de/", "http://c.com/" + "x" * 100_000,
    "http://spam-farm.example.com\n/de/", "http://org//", "http://.org/", "http://org./",
]


def plain(url, rules=U.RULES, hosts=U.BLOCKED_HOSTS):
    m = re.search(U.PARTS, url or "")
    host, path = (re.sub("[A-Z]", lambda x: x[0].lower(), m[1]), m[2]) if m else ("", "")
    under = lambda h: host == h or host.endswith("." + h)
    fit = sorted(((len(h + p), h.count("."), h + p, v) for h, p, v in rules if under(h) and path.startswith(p)), reverse=True)
    if fit:
        return host, path, *fit[0][2:]
    return host, path, None, "block" if any(map(under, hosts)) else "allow"


def test_verdicts(spark):
    rows = [(i % 7 or None, u, "h", 1, "r", "k") for i, u in enumerate(URLS)] * 2
    pages = spark.createDataFrame(rows, "page_id long, url string, host string, `a.b` int, _row string, _keys string")
    got = U.judge_urls(pages)
    assert got.columns == ["page_id", "url", "a.b", "_row", "_keys", "host", "path", "rule", "verdict"]
    want = sorted(((i % 7 or None, u, *plain(u)) for i, u in enumerate(URLS)), key=repr) * 2
    assert sorted((tuple(r) for r in got.select("page_id", "url", "host", "path", "rule", "verdict").collect()), key=repr) == sorted(want, key=repr)
    assert U.url_digest(pages.limit(0)).collect() == []
    assert U.url_digest(pages).count() == len(rows)


def test_other_lists(spark):
    rng = random.Random(5)
    name = lambda: ".".join(rng.choice("abc") for _ in range(rng.randrange(1, 5)))
    path = lambda: "/" + "".join(rng.choice("xy/") for _ in range(rng.randrange(6)))
    rules = list({(h, p): (h, p, rng.choice(["allow", "block"])) for h, p in ((name(), path()) for _ in range(60))}.values())
    hosts = [name() for _ in range(20)]
    urls = [f"http://{name()}{path()}" for _ in range(800)]
    pages = spark.createDataFrame([(u,) for u in urls], "url string")
    lists = spark.createDataFrame(rules, "host string, path string, verdict string"), spark.createDataFrame([(h,) for h in hosts], "host string")
    want = sorted(((u, *plain(u, rules, hosts)) for u in urls), key=repr)
    for limit in (U.MOST_BYTES, 1):  # the cascade, and the join that takes over from it
        got = U.judge_urls(pages, *lists, most_bytes=limit)
        assert sorted((tuple(r) for r in got.collect()), key=repr) == want
    none = U.judge_urls(pages, lists[0].limit(0), lists[1].limit(0))
    assert {(r.rule, r.verdict) for r in none.collect()} == {(None, "allow")}
    with pytest.raises(ValueError, match="two verdicts"):
        U.judge_urls(pages, spark.createDataFrame([("a", "/", "allow"), ("a", "/", "block")], lists[0].schema))


@pytest.mark.parametrize("n_listed,n_all", [(0, 100), (1, 1), (500, 20_000), (3000, 3000), (7, 0)])
def test_cascade_is_exact_over_its_universe(spark, n_listed, n_all):
    listed = spark.range(n_listed).select(F.concat(F.lit("k"), F.col("id") * 5).alias("key")).unionByName(spark.createDataFrame([(None,)], "key string"))
    universe = spark.range(n_all).select(F.concat(F.lit("k"), "id").alias("key"))
    cascade = B.build_cascade(listed, universe.unionByName(universe), "key")
    h1, h2 = (np.array(x, np.int64) for x in zip(*universe.select(*B.hashes(F.col("key"))).collect(), strict=True)) if n_all else (np.zeros(0, np.int64),) * 2
    keys = [r.key for r in universe.collect()]
    got = cascade.contains(h1, h2)
    assert [k for k, x in zip(keys, got, strict=True) if x] == [k for k in keys if int(k[1:]) % 5 == 0 and int(k[1:]) < 5 * n_listed]
    if n_listed == 500:
        assert len(cascade.levels) > 2 and cascade.n_bytes < 3000
        with pytest.raises(ValueError, match="bytes"):
            B.build_cascade(listed, universe, "key", most_bytes=100)
