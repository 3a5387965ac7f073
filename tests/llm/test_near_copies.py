"""Near copies by five-word similarity, against all pairs."""

import random

import numpy as np

import corpus_pipeline
from strandspark.llm.near_copies import sketch, without_near_copies


def grams(text):
    w = [x for x in (text or "").encode().lower().split()]
    return {b" ".join(w[i : i + 5]) for i in range(max(1, len(w) - 4))}


def brute_kept(pairs):
    """(doc_id, text) pairs of the rows that stay: the smallest id of each component."""
    texts = sorted({t or "" for _, t in pairs})
    sets, root = [grams(t) for t in texts], list(range(len(texts)))

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(texts)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if both and 5 * both >= 4 * (len(sets[a]) + len(sets[b]) - both):
                root[top(a)] = top(b)
    groups = {}
    for i, t in pairs:
        groups.setdefault(top(texts.index(t or "")), []).append((i is None, i or 0))
    return sorted(None if no else i for no, i in (min(g) for g in groups.values())), len(groups)


def edited(r, words, n):
    w = list(words)
    for k in r.sample(range(len(w)), n):
        w[k] = f"new{r.randrange(10**6)}"
    return " ".join(w)


def chain():
    """A base with copies near and far from one another, of similarity about 0.8."""
    r = random.Random(4)
    out = []
    for g in range(12):
        base = [f"w{g}x{r.randrange(5000)}" for _ in range(200)]
        out += [edited(r, base, n) for n in (0, 1, 2, 3, 4, 4, 4, 5, 6, 8)]
    return list(enumerate(out))


def test_pairs_that_fingerprints_miss(spark):
    pairs = chain()
    got = [r["doc_id"] for r in corpus_pipeline.near_dedup(spark, spark.createDataFrame(pairs, "doc_id long, text string").repartition(3), "").collect()]
    want, n = brute_kept(pairs)
    assert sorted(got) == want and n < 60


def test_whole_table(spark):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    got = [r["doc_id"] for r in corpus_pipeline.near_dedup(spark, docs, sf).collect()]
    assert sorted(got) == brute_kept([(r["doc_id"], r["text"]) for r in docs.collect()])[0]


def apart(a, b):
    """Minhashes whose two bits differ, one by one."""
    x, y = (np.stack([np.unpackbits(np.ascontiguousarray(v[k::2]).view(np.uint8)) for k in range(2)]) for v in (a, b))
    return sum(bool((x[:, i] != y[:, i]).any()) for i in range(x.shape[1]))


def test_places_are_counted_the_same_in_columns(spark):
    from pyspark.sql import functions as F

    from strandspark.llm.near_copies import differing

    rng = np.random.default_rng(1)
    a, b = (rng.integers(-(1 << 63), 1 << 63, (300, 2), np.int64) for _ in range(2))
    b[::2] = a[::2]
    b[::2, rng.integers(0, 2)] ^= np.int64(1) << rng.integers(0, 63, 150)
    df = spark.createDataFrame([(x.tolist(), y.tolist()) for x, y in zip(a, b)], "a array<long>, b array<long>")
    got = df.select("a", "b", differing([F.col("a")[k] for k in range(2)], [F.col("b")[k] for k in range(2)]).alias("n")).collect()
    assert all(r["n"] == apart(np.array(r["a"]), np.array(r["b"])) for r in got) and {r["n"] for r in got} > {1}


def test_filters_keep_close_pairs():
    """Pairs of similarity 0.8 share a band and stay within the bits that may differ."""
    from strandspark.llm.near_copies import APART, shingles

    r, near = random.Random(9), 0
    for _ in range(400):
        base = [f"w{r.randrange(10**6)}" for _ in range(r.randint(60, 300))]
        a, b = " ".join(base), edited(r, base, max(1, len(base) // 50))
        x, y = set(shingles(a).tolist()), set(shingles(b).tolist())
        if 5 * len(x & y) >= 4 * len(x | y):
            near += 1
            (ka, ba), (kb, bb) = sketch(a), sketch(b)
            assert (ka == kb).any()
            assert apart(ba, bb) <= APART
    assert near > 100


def test_one_row_of_repeated_and_missing_ids(spark):
    r = random.Random(2)
    a, b, c, d = ([f"{x}{r.randrange(9999)}" for _ in range(100)] for x in "abcd")
    rows = [
        (1, " ".join(a)), (1, " ".join(a)), (2, edited(r, a, 1)),  # a repeated row and a near copy of it
        (3, " ".join(b)), (None, " ".join(b)), (None, " ".join(c)), (None, " ".join(c)),  # with and without an id
        (5, " ".join(d)), (5, edited(r, c, 60)), (4, edited(r, d, 1)), (7, edited(r, c, 60)),  # one id of two texts
        (8, None), (9, ""), (10, " \n "),
    ]
    for n in (1, 4):
        got = without_near_copies(spark.createDataFrame(rows, "doc_id long, text string").repartition(n)).collect()
        assert sorted((x["doc_id"] for x in got), key=str) == sorted([1, 3, None, 4, 5, 7, 8], key=str)
        assert {x["text"] for x in got if x["doc_id"] == 5} == {rows[8][1]}


def test_group_of_near_copies_of_one_text(spark):
    """Most link through the central text; those that don't are still compared with all others."""
    r = random.Random(6)
    base = [f"w{r.randrange(5000)}" for _ in range(150)]
    texts = [edited(r, base, r.choice([1, 1, 2, 2, 3, 4, 5, 9])) for _ in range(150)]
    far = [edited(r, base, 5).split() for _ in range(6)]  # groups of their own, away from the centre
    texts += [edited(r, f, 1) for f in far for _ in range(4)]
    pairs = list(enumerate(texts))
    r.shuffle(pairs)
    got = [x["doc_id"] for x in without_near_copies(spark.createDataFrame(pairs, "doc_id long, text string").repartition(3)).collect()]
    want, n = brute_kept(pairs)
    assert sorted(got) == want and 5 < n < 150
