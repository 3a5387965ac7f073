import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from strandspark.llm.q_urls import RULES, TERMS, query
from strandspark.llm.urls import Cascade, Rule, build_cascades, filter_urls, flagged_hosts, shard_of


def parts(url):
    _, found, rest = (url or "").partition("://")
    cut = next((i for i, c in enumerate(rest) if c in "/?#"), len(rest)) if found else 0
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:cut])
    return host, re.split("[?#]", rest[cut:])[0] if found else ""


def under(host, entry):
    return bool(host) and (host == entry or host.endswith("." + entry))


def brute(url, rules, listed):
    """``listed``: pairs of host and path."""
    host, path = parts(url)
    fits = [r for r in rules if under(host, r.host) and path.startswith(r.path)]
    if fits:
        best = max(fits, key=lambda r: len(r.key))
        return host, path, best.key, best.action
    return host, path, None, "block" if any(under(host, h) and (path or "/").startswith(p) for h, p in listed) else "allow"


def flagged(urls, terms=TERMS):
    out = set()
    for u in urls:
        labels = parts(u)[0].split(".")
        at = [i for i, x in enumerate(labels[:-1]) if set(x.split("-")) & set(terms)]
        if at:
            out.add((".".join(labels[at[-1] :]), "/"))
    return out


URLS = [
    None, "", "no scheme", "http://", "http://org", "http://org/", "https://A.Example.ORG/es/1", "https://example.org/es", "https://example.org/en/1x?q#f", "ftp://x.com/fr/a#b", "http://com/de/", "http://m.adult-x.net/en/",
    "http://free-bets.example.net", "http://free-bets.example.net/x", "http://xcom/de/", "://host.com/de/1", "http://a.b.c.d.e.com?x=/de/", "http://example.org.evil.net/es/", "http://é.org/ß", "http://ÉX.org/", "a://b://c/d", "http://sex.example.com/de/1",
]


def test_against_brute_force(spark):
    rows = [(i, u, "x", "y") for i, u in enumerate(URLS)] + [(3, URLS[6], "x", "y"), (None, URLS[6], None, None)]
    df = spark.createDataFrame(rows, "page_id long, url string, rule string, keys string")
    listed = flagged_hosts(df, TERMS)
    assert {tuple(r) for r in listed.collect()} == flagged(URLS) and len(flagged(URLS)) > 2
    got = sorted((tuple(r) for r in filter_urls(df, RULES, listed).collect()), key=str)
    assert got == sorted(((i, *brute(u, RULES, flagged(URLS))) for i, u, _, _ in rows), key=str)


LISTED = [("bad.com", "/very/long/"), ("casino.com", "/"), ("a.b.c.d.e.com", "/x"), ("net", "/only/this"), ("é.org", "/ß"), ("bad.com", "/de/")]


@pytest.mark.parametrize("max_bytes", [64 << 20, 100])
def test_entries_of_all_sizes(spark, max_bytes):
    """Whatever the sizes of the entries, and in one shard or many."""
    r = random.Random(3)
    urls = URLS + ["http://bad.com/very/long/x", "http://bad.com/very/long", "https://casino.com?x=1", "http://casino.com", "http://www.casino.com#a", "http://ecasino.com/", "http://x.net/only/this?", "http://x.net/only/thi"]
    urls += [f"http://{r.choice(['', 'www.', 'a.b.'])}{r.choice(['bad', 'casino', 'good'])}.{r.choice(['com', 'net'])}{r.choice(['', '/', '/very/long/', '/de/', '/only/this', '/fr/'])}{r.choice(['', 'x', '?q'])}" for _ in range(300)]
    df = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string").repartition(3)
    listed = spark.createDataFrame(LISTED + LISTED[:1], "host string, path string")
    got = {r["page_id"]: tuple(r)[1:] for r in filter_urls(df, RULES, listed, max_bytes=max_bytes).collect()}
    want = {i: brute(u, RULES, LISTED) for i, u in enumerate(urls)}
    assert got == want and {v for *_, v in want.values()} == {"allow", "block"}


def cascades_of(spark, keys, max_bytes=64 << 20):
    df = spark.createDataFrame(keys, "key string, listed boolean").repartition(5)
    made = build_cascades(df, len(keys), max_bytes)
    h = spark.createDataFrame(keys, "key string, listed boolean").select(F.xxhash64("key").alias("a"), F.xxhash64("key", F.lit(1)).alias("b"), "listed")
    h = h.withColumn("shard", shard_of(F.col("b"), len(made))).toPandas()
    for i, c in enumerate(made):
        own = h[h["shard"] == i]
        got = c.member(own["a"].to_numpy().view(np.uint64), own["b"].to_numpy().view(np.uint64))
        assert (got == own["listed"].to_numpy()).all()
    return made


@pytest.mark.parametrize("share", [0.0, 0.02, 0.5, 1.0])
def test_cascade_is_exact(spark, share):
    r = random.Random(5)
    keys = [(f"host{i}.net/", r.random() < share) for i in range(4000)]
    (c,) = cascades_of(spark, keys + keys[:50])
    assert isinstance(c, Cascade) and (share in (0.0, 1.0) or len(c.levels) > 2)


def test_shards_are_exact_and_bounded(spark):
    r = random.Random(6)
    keys = [(f"host{i}.net/", r.random() < 0.3) for i in range(3000)]
    made = cascades_of(spark, keys, 500)
    assert len(made) > 3 and max(c.n_bytes for c in made) < 1000


def test_size_follows_the_list(spark):
    """Ten times the corpus, the same list: a few bits more for each listed key."""
    size = [cascades_of(spark, [(f"host{i}.net/", i < 200) for i in range(n)])[0].n_bytes for n in (1_000, 10_000)]
    assert size[1] < 2.5 * size[0]


def test_very_long_urls(spark):
    """A host of very many labels has no more keys than any other."""
    urls = ["http://" + "casino." * 20_000 + "com/" + "x" * 100_000, "http://" + "a." * 20_000 + "bad.com/very/long/" + "y/" * 50_000]
    df = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    listed = flagged_hosts(df, TERMS).union(spark.createDataFrame(LISTED, "host string, path string"))
    assert {r["page_id"]: r["verdict"] for r in filter_urls(df, RULES, listed).collect()} == {0: "block", 1: "block"}


def test_empty_table_and_list(spark):
    df = spark.createDataFrame([(1, "http://a.b/x"), (2, "http://c.d/x")], "page_id long, url string")
    nothing = spark.createDataFrame([], "host string, path string")
    assert {r["verdict"] for r in filter_urls(df, [], nothing).collect()} == {"allow"}
    assert {r["verdict"] for r in filter_urls(df, [Rule("block", "b", "")], nothing).collect()} == {"allow", "block"}
    assert filter_urls(df.limit(0), RULES, flagged_hosts(df.limit(0), TERMS)).collect() == []


def test_whole_table(spark):
    sf = "/root/testdata/sf0.001"
    rows = spark.read.parquet(f"{sf}/pages.parquet").select("page_id", "url").collect()
    listed = flagged([r["url"] for r in rows])
    assert sorted(map(tuple, query(spark, sf).collect())) == sorted((r["page_id"], *brute(r["url"], RULES, listed)) for r in rows)
