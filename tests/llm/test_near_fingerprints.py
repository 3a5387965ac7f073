"""The SimHash steps of the near-duplicate stage: fingerprints, keys and Hamming check give links of their own."""

import random

import numpy as np
import xxhash

from strandspark.llm import near_copies
from strandspark.llm.simhash import BLOCK, majority


def test_majority():
    r = np.random.default_rng(1)
    h = r.integers(0, 1 << 63, BLOCK + 5, np.uint64)
    want = sum(1 << b for b in range(64) if 2 * sum((h >> np.uint64(b)) & np.uint64(1)) > len(h))
    assert majority(h) == want and majority(h[:1]) == int(h[0])


def test_pairs_by_fingerprint_are_linked_without_a_band(spark, monkeypatch):
    """With bands that no two texts share what SimHash finds is still linked, if it is alike."""
    r = random.Random(2)
    texts = []
    for _ in range(12):
        words = [f"w{r.randrange(10**6)}" for _ in range(1500)]
        texts += [words, [*words[:700], "changed", *words[701:]]]
    texts = [" ".join(w) for w in texts]
    prints = [majority(near_copies.shingles(t)) for t in texts]
    near = [k for k in range(0, 24, 2) if (prints[k] ^ prints[k + 1]).bit_count() <= 3]
    monkeypatch.setattr(near_copies, "minima", lambda grams: (np.array([xxhash.xxh64_intdigest(grams.tobytes()) >> 1], np.int64), np.zeros(near_copies.WORDS, np.int64)))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    kept = sorted(x["doc_id"] for x in near_copies.without_near_copies(docs).collect())
    assert kept == [k for k in range(24) if k - 1 not in near] and len(near) >= 6


def test_pairs_are_never_more_than_texts(spark):
    rows = [(k, [k], [0] * near_copies.WORDS, 1 << (k % 3) if k < 30 else 0) for k in range(40)]
    sketches = spark.createDataFrame(rows, "node long, keys array<long>, bits array<long>, fp long")
    got = near_copies.fingerprint_pairs(sketches, 40)
    assert got.count() == got.distinct().count() == 39 and not got.where("u <= v").count()
